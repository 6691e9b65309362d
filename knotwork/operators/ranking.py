"""Row numbers and neighbours in an order, for groups of any size.

A plain window sends a whole group to one task. Here rows are range partitioned on
(group, order), numbered inside each range, and shifted by the counts of the ranges before;
the offset table holds one row per (group, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knotwork.operators.loop import cut, stored


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range partitioned on keys and order, with the range number in ``_range``; written as compressed Parquet."""
    least = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = max(int(least), int(df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", least)))
    placed = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    return stored(placed)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, start: int = 1) -> DataFrame:
    """Dense row number of each row in its group, by ascending ``order``."""
    placed = ranged(df, keys, order)
    local = placed.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    sizes = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return (
        local.join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col("_local") + F.col("_o") + F.lit(start - 1)).cast("bigint"))
        .drop("_local", "_o", "_range")
    )


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(id, n): nodes numbered from 0 in id order, so that long searches carry numbers, not texts."""
    return cut(number_rows(nodes.select("id").distinct(), [], ["id"], "n", start=0))


def dense_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with the numbers of their ends; edges with an end outside ``ids`` are left out."""
    s = ids.select(F.col("id").alias("source"), F.col("n").alias("_s"))
    t = ids.select(F.col("id").alias("target"), F.col("n").alias("_t"))
    return edges.join(s.hint("shuffle_hash"), "source").join(t.hint("shuffle_hash"), "target").withColumns({"source": F.col("_s"), "target": F.col("_t")}).drop("_s", "_t")


def next_change(df: DataFrame, keys: list[str], order: list[str], value: str, at: str, name: str) -> DataFrame:
    """``at`` of the first later row of the group whose ``value`` differs, null if none.

    Inside a range this is the start of the next run. The last run of a range looks into the
    later ranges through their first row, first run start and last row only.
    """
    placed = ranged(df, keys, order)
    local = W.partitionBy(*keys, "_range").orderBy(*order)
    marked = placed.withColumn("_prev", F.lag(value).over(local)).withColumn(
        "_start", F.when(F.col("_prev") != F.col(value), F.col(at))
    )
    after = local.rowsBetween(1, W.unboundedFollowing)
    marked = marked.withColumn("_next", F.first("_start", ignorenulls=True).over(after))
    by = F.struct(*order)
    row = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    edges = marked.groupBy(*keys, "_range").agg(
        F.array_compact(
            F.array(
                F.struct(F.lit(0).alias("pos"), F.min_by(row, by).alias("row")),
                F.when(
                    F.count("_start") > 0,
                    F.struct(F.lit(1).alias("pos"), F.min_by(row, F.when(F.col("_start").isNotNull(), by)).alias("row")),
                ),
                F.struct(F.lit(2).alias("pos"), F.max_by(row, by).alias("row")),
            )
        ).alias("_marks")
    )
    marks = edges.select(*keys, "_range", F.explode("_marks").alias("_m")).select(
        *keys, "_range", F.col("_m.pos").alias("_pos"), F.col("_m.row.at").alias("_at"), F.col("_m.row.value").alias("_value")
    )
    wide = W.partitionBy(*keys).orderBy("_range", "_pos")
    marks = marks.withColumn("_mprev", F.lag("_value").over(wide)).withColumn(
        "_mstart", F.when(F.col("_mprev") != F.col("_value"), F.col("_at"))
    )
    marks = marks.withColumn(
        "_across", F.first("_mstart", ignorenulls=True).over(wide.rowsBetween(1, W.unboundedFollowing))
    )
    across = marks.filter(F.col("_pos") == 2).select(*keys, "_range", "_across")
    return (
        marked.join(across, [*keys, "_range"])
        .withColumn(name, F.coalesce("_next", "_across"))
        .drop("_prev", "_start", "_next", "_across", "_range")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank.

    Spark cuts a ``row_number() <= k`` window to k rows per group in every map task before the
    shuffle, so one task gets at most k rows per group and map task.
    """
    spec = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec).cast("bigint")).filter(F.col(name) <= k)
