"""The resampling operator on a stream."""
