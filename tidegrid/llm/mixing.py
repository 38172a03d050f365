"""Mixing sources to target weights by Sainte-Laguë apportionment, in built-in functions only.

The words of a source, laid behind each other, are cut into blocks of equal length. Blocks
are dealt as seats: to the sources by the highest quotients claim / (2k + 1), then in the
same way to the shards of a source and to the bundles of a shard, each time whole numbers
that add up. A bundle with quota q for n blocks takes every block q div n times and, of the
rest, one block drawn by seed from each of q mod n equal stretches. All draws are hashes of
what a row holds, so a rerun agrees whatever the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import staged
from tidegrid.llm.host_rules import SPACES

BLOCK_WORDS = 16
#: Rows of a bundle, about: the largest group that one task orders.
BUNDLE_ROWS = 1024
#: Weights of the sources by their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word there is, and the most times that a source may be taken.
SHARE, MOST = 1.5, 2
SEED = 17


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of integers."""
    return F.call_function("div", a, F.lit(b))


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest of a text as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def size_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One staged row per distinct (source, doc_id, text): their words, a hash and the number of such rows."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "source", "doc_id", F.size(F.array_remove(F.split(text, SPACES, -1), "")).cast("long").alias("size"),
        hash60(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))).alias("uid"))
    return staged(sized.groupBy("source", "doc_id", "uid", "size").agg(F.count("*").alias("copies")), "sized")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, words) with ``target``: the words wanted of each source.

    Sources in the order of their names (by code point, null last) weigh ``weights``, repeating.
    Filled like vessels that are joined at the bottom: a source stops at ``most`` times its
    words, and what it cannot take goes to the others by weight.
    """
    everything = Window.partitionBy()
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "number")
    weighed = (sources.withColumn("number", F.row_number().over(by_name) - 1)
               .withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("number") % len(weights)))
               .withColumn("cap", most * F.col("words"))
               .withColumn("room", F.col("cap") / F.col("weight")))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", (share * F.sum("words").over(everything) - before) / open_weight)
    level = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")),
                     F.when(F.col("level") <= F.col("room"), F.struct("room", "number"))).over(everything)
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))).select(
        *sources.columns, "target")


def _highest_quotients(claims: DataFrame, within: list[str], item: str) -> DataFrame:
    """``quota``: of the ``seats`` of each group those with the highest claim / (2k + 1), without the cap.

    With n items, cutting at (seats - n / 2) parts gives no item more than its due, and at
    (seats + n / 2) none less, so that only about two quotients per item are laid out and ranked.
    """
    group = Window.partitionBy(*within)

    def seats_at(parts: Column) -> Column:
        return F.coalesce(F.floor(F.col("claim") * parts / F.nullif(F.col("_claims"), F.lit(0.0)) + 0.5), F.lit(0))

    half = F.col("_items") / 2
    bounded = (claims.withColumn("_items", F.count("*").over(group)).withColumn("_claims", F.sum("claim").over(group))
               .withColumn("_least", F.greatest(F.lit(0), seats_at(F.col("seats") - half) - 1))
               .withColumn("_most", seats_at(F.col("seats") + half) + 1)
               .withColumn("_open", F.col("seats") - F.sum("_least").over(group)))
    ranked = (bounded.withColumn("_nth", F.explode(F.sequence("_least", F.col("_most") - 1)))
              .withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(
                  (F.col("claim") / (2 * F.col("_nth") + 1)).desc(), item))))
    others = [c for c in claims.columns if c not in (*within, item)]
    return ranked.groupBy(*within, item).agg(
        *(F.max(c).alias(c) for c in others),
        (F.max("_least") + F.count(F.when(F.col("_rank") <= F.col("_open"), 1))).alias("quota"))


def apportion(claims: DataFrame, within: list[str], item: str) -> DataFrame:
    """Sainte-Laguë: ``claims`` (within, item, claim, cap, seats) with ``quota``, whole seats that add up to ``seats``.

    An item over its ``cap`` keeps the cap, and the rest is dealt anew among the others: the
    highest quotients that the caps allow. Ties go to the smaller item. ``cap`` has to be at
    least the claim, and ``seats`` the rounded sum of the claims of a group.
    """
    full, left = None, claims
    while True:
        dealt = staged(_highest_quotients(left, within, item), "quotas")
        over = F.col("quota") > F.col("cap")
        if dealt.where(over).limit(1).count() == 0:
            return dealt if full is None else full.unionByName(dealt)
        capped = dealt.where(over).withColumn("quota", F.col("cap"))
        full = capped if full is None else full.unionByName(capped)
        given = F.sum(F.when(over, F.col("cap")).otherwise(0)).over(Window.partitionBy(*within))
        left = dealt.withColumn("seats", F.col("seats") - given).where(~over).drop("quota")


def _picked_before(block: Column, blocks: Column, rest: Column, draw: Column) -> tuple[Column, Column]:
    """Of the ``rest`` blocks drawn from ``blocks``, those before ``block``; and whether it is drawn itself.

    Stretch i holds the blocks from i * blocks div rest on; its drawn block is ``draw(i)`` modulo its length.
    """
    stretch = div((block + 1) * rest - 1, blocks)
    low, high = div(stretch * blocks, rest), div((stretch + 1) * blocks, rest)
    pick = low + draw(stretch) % (high - low)
    none, beyond = rest == 0, block >= blocks
    return (F.when(none, 0).when(beyond, rest).otherwise(stretch + (pick < block).cast("long")),
            F.when(none | beyond, False).otherwise(pick == block))


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST,
                  block_words: int = BLOCK_WORDS, bundle_rows: int = BUNDLE_ROWS, seed: int = SEED) -> DataFrame:
    """Per input row: doc_id, source, size, source_size, target, taken and spans.

    ``spans`` lists (start, stop, times): word ranges of the document and how often the mix takes
    them; ``taken`` adds them up. No word is taken more than ``most`` times. A null text has no
    words and is never taken; a null source is a source, the last; equal rows lie behind each other
    in any order; an empty table gives no row; other columns are left out.
    """
    sized = size_documents(docs, seed)
    sources = staged(targets(sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("rows")), weights, share, most)
        .withColumn("bundles", F.ceil(F.col("rows") / bundle_rows))
        .withColumn("shards", F.ceil(F.sqrt("bundles"))), "sources")
    of = sources.select(F.col("source").alias("of_source"), F.col("words").alias("source_size"), "target", "shards",
                        F.ceil(F.col("bundles") / F.col("shards")).alias("per_shard"))
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "source", "doc_id", "uid", "size", "copies", "source_size", "target",
        (F.col("uid") % F.col("shards")).alias("shard"),
        (div(F.col("uid"), F.col("shards")) % F.col("per_shard")).alias("bundle"))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("name")  # the null source is the only empty name
    rows = rows.withColumn("name", name)
    place = ["name", "shard", "bundle"]
    bundles = rows.groupBy(*place).agg(F.sum(F.col("size") * F.col("copies")).alias("words")).withColumn(
        "blocks", div(F.col("words") + block_words - 1, block_words))
    bundles = staged(bundles.where("blocks > 0"), "bundles")

    per_source = bundles.groupBy("name").agg(F.sum("blocks").alias("blocks")).join(
        sources.select(name, "words", "target"), "name")
    claim = F.col("target") * F.col("blocks") / F.col("words")
    top = per_source.select("name", claim.alias("claim"), (most * F.col("blocks")).alias("cap"), "blocks").withColumn(
        "seats", F.round(F.sum(F.col("claim").cast("decimal(30,6)")).over(Window.partitionBy())).cast("long"))
    top = apportion(top, [], "name")

    def below(parents: DataFrame, children: DataFrame, keys: list[str], item: str) -> DataFrame:
        """The parents' quotas dealt to their children by their blocks."""
        held = children.join(parents.select(*keys, F.col("quota").alias("seats"), F.col("blocks").alias("whole")), keys)
        return apportion(held.select(*keys, item, (F.col("seats") * F.col("blocks") / F.col("whole")).alias("claim"),
                                     (most * F.col("blocks")).alias("cap"), "blocks", "seats"), keys, item)

    shards = below(top, bundles.groupBy("name", "shard").agg(F.sum("blocks").alias("blocks")), ["name"], "shard")
    quotas = below(shards, bundles.select(*place, "blocks"), ["name", "shard"], "bundle").select(*place, "blocks", "quota")

    order = Window.partitionBy(*place).orderBy(F.col("doc_id").asc_nulls_first(), "uid")
    first = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("first", first).join(quotas, place, "left").fillna(0, ["blocks", "quota"])
    chunk = 1 << 16  # equal rows by the chunk, so that no array holds all of a large group
    laid = laid.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long"))))
    laid = laid.withColumn("copy", F.explode(F.sequence("chunk", F.least(F.col("copies"), F.col("chunk") + chunk) - 1)))
    laid = laid.select(
        "name", "shard", "bundle", "source", "doc_id", "size", "source_size", "target", "blocks",
        (F.col("first") + F.col("copy") * F.col("size")).alias("first"),
        F.when(F.col("blocks") > 0, div(F.col("quota"), F.col("blocks"))).otherwise(0).alias("every"),
        F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).alias("rest"))

    def draw(stretch: Column) -> Column:
        return hash60(F.concat_ws(":", F.lit(seed), "name", "shard", "bundle", stretch))

    def taken_before(x: Column) -> Column:
        block = div(x, block_words)
        count, itself = _picked_before(block, F.col("blocks"), F.col("rest"), draw)
        return F.col("every") * x + block_words * count + F.when(itself, x - block * block_words).otherwise(0)

    end = F.col("first") + F.col("size")

    def span(block: Column) -> Column:
        times = F.col("every") + _picked_before(block, F.col("blocks"), F.col("rest"), draw)[1].cast("long")
        return F.struct((F.greatest(block * block_words, F.col("first")) - F.col("first")).alias("start"),
                        (F.least((block + 1) * block_words, end) - F.col("first")).alias("stop"), times.alias("times"))

    spans = F.when((F.col("size") > 0) & (F.col("blocks") > 0), F.filter(
        F.transform(F.sequence(div(F.col("first"), block_words), div(end - 1, block_words)), span),
        lambda s: s["times"] > 0)).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,times:bigint>>"))
    return laid.select("doc_id", "source", "size", "source_size", "target",
                       F.when(F.col("size") > 0, taken_before(end) - taken_before(F.col("first"))).otherwise(0).cast("long").alias("taken"),
                       spans.alias("spans"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of ``mix_documents``."""
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")
