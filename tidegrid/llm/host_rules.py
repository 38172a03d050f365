"""Quality rules with a verdict per host, in built-in functions only.

Each document gets its counts and rule failures. Failures are added up per host, each
host's rate is drawn towards the rate of all hosts by a beta prior fitted to the spread
between hosts, and hosts beyond ``max_rate`` are refused. Their verdict goes back to
their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import let, staged

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Weight of the prior, in documents, where hosts do not differ at all.
ALIKE = 1_000_000.0


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash comes twice or more: sort the hashes, keep equal neighbours, add up their reach."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(F.transform(rows, lambda r, i: F.struct(
                r["i"].alias("i"),
                (F.coalesce(F.get(rows, i - 1)["h"] == r["h"], F.lit(False))
                 | F.coalesce(F.get(rows, i + 1)["h"] == r["h"], F.lit(False))).alias("same"))),
                lambda r: r["same"]),
            lambda r: r["i"]))

    def reach(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x)

    return let(let(placed, repeated), reach)


def repeated_words(words: Column) -> Column:
    """Number of words in ``WINDOW``-word windows found twice or more in the same text."""
    windows = let(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    count = let(windows, lambda hs: F.when(
        F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_covered(hs)))
    return F.when(F.size(words) > WINDOW, count).otherwise(F.lit(0)).cast("long")


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per input row: doc_id, host and the counts of its whole text. A null text has none; extra columns are left."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col(host).alias("host"), text.alias("text")).select(
        "doc_id", "host", "text", F.array_remove(F.split("text", SPACES, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    return split.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


#: Rules whose failures count against a host.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 10",
}


def host_verdicts(counts: DataFrame, max_rate: float = 0.6) -> DataFrame:
    """One row per host: its documents, failures and drawn-in rate per rule, and ``host_failed``.

    A null host is no host and gets no row. The prior of a rule has the mean of all documents
    and, by the method of moments, the weight that explains the weighted spread of the hosts'
    rates; at least one document, and ``ALIKE`` where the hosts do not differ.
    """
    hosts = staged(counts.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), *(F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items())),
        "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES)).first()
    means = {r: (total[f"f_{r}"] or 0) / (total["n"] or 1) for r in RULES}
    spread = hosts.agg(*(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.lit(m), 2)).alias(r)
                         for r, m in means.items())).first()
    rates = {}
    for rule, mean in means.items():
        variance = (spread[rule] or 0.0) / (total["n"] or 1)
        weight = max(1.0, mean * (1 - mean) / variance - 1) if variance > 1e-12 else ALIKE
        rates[rule] = (F.col(f"f_{rule}") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
    failed = F.lit(False)
    for rate in rates.values():
        failed = failed | (rate > max_rate)
    return hosts.select("*", *(rate.alias(f"rate_{rule}") for rule, rate in rates.items()), failed.alias("host_failed"))


def judge_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.6) -> DataFrame:
    """Per input row: its counts, ``base_failed``, its host's ``host_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule; a document without a host is
    judged by itself; repeated rows each get their own equal row; an empty table gives none.
    """
    counts = staged(document_counts(docs, host), "counts")
    verdicts = host_verdicts(counts, max_rate).select(F.col("host").alias("of_host"), "host_failed")
    joined = counts.join(verdicts, F.col("host") == F.col("of_host"), "left")
    base = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), host_failed.alias("host_failed"), (~base & ~host_failed).alias("kept"))
