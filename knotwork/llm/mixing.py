"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

All steps are DataFrame operations. Each source's documents, in an order by hash, form a stream of words that is cut
into blocks of equal length. Points of the golden-ratio sequence, mapped through the cumulative shares of the sources,
give the order in which blocks are drawn; the slots of a source are ranked, and the slot of rank r draws block r of
the stream, starting again from its first block when all are drawn. A source's last block is cut to its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knotwork.llm.common import WORD, source_key, stored
from knotwork.operators.ranking import number_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 4096
#: Points are whole numbers below 2^31; the step is 2^31 over the golden ratio, rounded to an odd number.
POINTS = 1 << 31
STEP = 1327217885


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before this one in its group, for groups of any size.

    Rows are range partitioned and summed inside a range; a table of one row per group and range gives what lies before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_before", "_range")
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(``_key``, number, source_size) with weight and target.

    The target is weight times a level common to all sources, ``limit`` times the size at most. The level rises, an
    aggregate at a time, until the targets add up; each rise caps at least one more source, so a few suffice.
    """
    ceiling = F.col("source_size") * limit
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    whole = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    wanted = share * (whole["n"] or 0)
    level = wanted / whole["w"] if whole["w"] else 0.0
    while True:
        capped = ceiling <= F.col("weight") * level
        found = sources.agg(
            F.coalesce(F.sum(F.when(capped, ceiling)), F.lit(0)).cast("double").alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not found["open"]:
            return sources.withColumn("target", ceiling.cast("double"))
        raised = (wanted - found["full"]) / found["open"]
        if raised <= level:
            return sources.withColumn("target", F.least(ceiling.cast("double"), F.col("weight") * level))
        level = raised


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, number, rank, block, epoch, words): every block drawn, from ``sources`` (number, source_size, target).

    A point sequence meets a share to within a few slots: slots over a source's need are left out, missing ones are
    appended at the end, so each source draws exactly the whole words of its target.
    """
    spark = sources.sparkSession
    size, words = F.col("source_size"), F.floor("target").cast("bigint")
    blocks = F.ceil(size / block).cast("bigint")
    rest = words % F.greatest(size, F.lit(1))
    plan = stored(
        sources.filter(size > 0).select(
            "number", "source_size", words.alias("take"), blocks.alias("blocks"),
            (F.floor(words / size).cast("bigint") * blocks + F.ceil(rest / block).cast("bigint")).alias("need"), rest.alias("rest"),
        )
    )
    seen = plan.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("slots"), F.count("*").alias("n")).first()
    slots = int(seen["slots"])
    shares = running_total(plan, [], ["number"], "need", "_first")
    lo = F.floor(F.col("_first") / F.lit(max(slots, 1)) * POINTS).cast("bigint")
    hi = F.floor((F.col("_first") + F.col("need")) / F.lit(max(slots, 1)) * POINTS).cast("bigint")
    # Points meet sources by equal cells of the range, of which a source covers one or more.
    width = POINTS // max(1024, 1 << math.ceil(math.log2(4 * max(seen["n"], 1))))
    cells = shares.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo < _hi").select(
        "number", "_lo", "_hi", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}"))).alias("_cell")
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"((id % {POINTS}) * {STEP}) % {POINTS}").alias("_u"))
    points = points.withColumn("_cell", F.expr(f"_u div {width}"))
    met = points.join(cells, (points["_cell"] == cells["_cell"]) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    ranked = number_rows(met.select("number", "slot"), ["number"], ["slot"], "rank", start=0)
    drawn = stored(ranked.join(plan.select("number", "need"), "number").filter("rank < need").select("number", "slot", "rank"))
    have = drawn.groupBy("number").agg(F.count("*").alias("_have"))
    short = plan.join(have, "number", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_have < need")
    missing = short.select("number", F.lit(slots).cast("bigint").alias("slot"), F.explode(F.expr("sequence(_have, need - 1)")).alias("rank"))
    whole = drawn.union(missing).join(plan, "number")
    at = F.expr("rank % blocks")
    last = (F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0)
    room = F.least(F.lit(block), F.col("source_size") - at * block)
    return whole.select(
        "slot", "number", "rank", at.alias("block"), F.expr("rank div blocks").alias("epoch"),
        F.when(last, F.col("rest") - at * block).otherwise(room).cast("bigint").alias("words"),
    )


def mix(docs: DataFrame, carry: list[str], weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """The ``carry`` columns of every row of ``docs`` (doc_id, source, text), with size, source_size, target and taken.

    Sources in code point order, null last, get ``weights`` in turn. Null texts have no words and are never taken. An
    empty table gives an empty table. The order of a stream is that of the MD5 of doc_id; rows of equal doc_id follow
    by size and text hash, and equal rows are taken one after the other.
    """
    order = [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"), F.xxhash64("text").alias("_tie")]
    rows = stored(
        docs.select(*[F.col(f"`{c}`") for c in carry], source_key().alias("_key"), word_count().alias("size"), *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    sizes = rows.groupBy("_key").agg(F.sum("size").cast("bigint").alias("source_size"))
    sources = stored(targets(number_rows(sizes, [], ["_key"], "number", start=0), weights, share, limit))
    taken = schedule(sources, block).groupBy("number", "block").agg(
        F.count_if(F.col("words") > 0).alias("_draws"), F.sum("words").alias("_sum"), F.max("words").alias("_most"), F.min("words").alias("_least")
    )
    placed = rows.select("_row", "_key", "size", "_order", "_tie").filter("size > 0").join(sources.select("_key", "number"), "_key")
    placed = running_total(placed.drop("_key"), ["number"], ["_order", "size", "_tie", "_row"], "size", "_start")
    cut = placed.select(
        "_row", "number", "_start", (F.col("_start") + F.col("size")).alias("_end"),
        F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")).alias("block"),
    )
    # Every draw of a block takes all its words but for the source's last, which takes the first words only.
    base = F.col("block") * block
    begin, finish = F.greatest("_start", base) - base, F.least("_end", base + block) - base
    whole = F.col("_draws") - F.when(F.col("_least") < F.col("_most"), 1).otherwise(0)
    # A block drawn once may be the cut one: then least and most are both its words.
    inside = whole * F.greatest(F.least(finish, F.col("_most")) - begin, F.lit(0))
    part = F.when(F.col("_least") < F.col("_most"), F.greatest(F.least(finish, F.col("_least")) - begin, F.lit(0))).otherwise(0)
    words = cut.join(taken, ["number", "block"]).groupBy("_row").agg(F.sum(inside + part).cast("bigint").alias("taken"))
    return (
        rows.join(sources.select("_key", "source_size", "target"), "_key").join(words, "_row", "left")
        .select(*carry, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as often as the mix takes them: a row stays once for every pass that takes half its words or more."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    for c in ("doc_id", "source", "text"):
        plain = plain.withColumn(c, F.col(names[docs.columns.index(c)]))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = mix(plain, names, **options).filter("taken > 0").withColumn("_times", times).filter("_times > 0")
    return mixed.select(*names, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_pass")).drop("_pass").toDF(*docs.columns)
