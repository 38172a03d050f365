"""Token resampling as a watermarked streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.telemetry import ANGLES, LEVELS, usable


def stream_tokens(rows: DataFrame, token: str = "100 milliseconds", late: str = "1 minute") -> DataFrame:
    """Means of the usable rows per session and token, last gear, as they close.

    ``rows`` has session_id, an event time ``ts`` and the six signals. Tokens lie
    on the clock's own grid; a token is given out once the watermark passes it.
    Late rows within ``late`` still count.
    """
    means = []
    for name in ANGLES:
        stem = name.removesuffix("_deg")
        means.append(F.avg(F.sin(F.radians(name))).alias(f"{stem}_sin"))
        means.append(F.avg(F.cos(F.radians(name))).alias(f"{stem}_cos"))
    return (
        rows.where(usable()).withWatermark("ts", late)
        .groupBy("session_id", F.window("ts", token).alias("token"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            *means, *[F.avg(name).alias(name) for name in LEVELS], F.max_by("gear", "ts").alias("gear"))
        .select("session_id", F.col("token.start").alias("token_start"), F.col("token.end").alias("token_end"),
                "n", "first_ts", "last_ts", *[f"{a.removesuffix('_deg')}_{f}" for a in ANGLES for f in ("sin", "cos")],
                *LEVELS, "gear")
    )
