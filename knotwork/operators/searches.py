"""Searches along edges from many sources at once, in blocks of sources, on graphs with hubs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F

from knotwork.operators.loop import cut, cut_counting, folder, forget, releasing, remove

#: Edges of one node that a single key holds.
PART = 1 << 16
#: Words of bits in a row of a search: a row stands for a node and a block of sources.
WORDS = 8
BLOCK = 64 * WORDS
#: Rows of search state for each shuffle partition.
ROWS = 1 << 18
#: Links for each row of search state where nearly all nodes are reached.
DENSE = 32


def _hubs(df: DataFrame, key: str, most: int) -> DataFrame | None:
    """(key, _parts) of the keys with more than ``most`` rows, None if there are none."""
    counted = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    hubs = cut(counted.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    return None if hubs.isEmpty() else hubs


def join_hot(big: DataFrame, small: DataFrame, key: str, size: int, how: str = "left", most: int = PART, like: DataFrame | None = None) -> DataFrame:
    """``big`` with the columns of ``small``, which has one row a key; a key of very many rows is dealt into parts.

    ``size`` is the number of rows of ``big`` or more; where it is small no key can be hot, and nothing is counted.
    ``like`` holds the same keys as ``big`` and is counted in its stead where it is cheaper to read.
    """
    hubs = _hubs(big if like is None else like, key, most) if size > most else None
    if hubs is None:
        return big.join(small, key, how)
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)).cast("bigint")).cast("int")
    dealt = big.join(F.broadcast(hubs) if size // most < 100_000 else hubs, key, "left").withColumn("_part", part).drop("_parts")
    copies = small.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.join(copies.drop("_parts"), [key, "_part"], how).drop("_part")


def join_few(big: DataFrame, few: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """``big`` with the columns of ``few``, which has one row for each of a few values of ``key`` that many rows share.

    A shuffle would gather all rows of a frequent value in one task. ``few`` is written and sent to all tasks while it
    has ``most`` rows or fewer; beyond that the rows of a value are dealt into parts, and ``few`` is copied to each.
    """
    few, seen = cut_counting(few, n=F.count("*"))
    if seen["n"] <= most:
        return big.join(F.broadcast(few), key, "left")
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), F.lit(parts).cast("bigint")))
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return dealt.join(copies, [key, "_part"], "left").drop("_part")


class Links:
    """Edges kept by their source, in which the edges of a hub are dealt into parts.

    A node with more than ``most`` edges has as many parts as it takes, and what a round knows about it is copied to
    each. A copy meets one part, so no task holds all edges of a hub; what the parts yield for a target is combined by
    the partial aggregate of each task before the shuffle. Without hubs this is a plain join on the source.
    """

    def __init__(self, links: DataFrame, most: int = PART):
        seen = Observation()
        self.names: list[tuple[str, str]] = []
        self.table = self._keep(links.observe(seen, F.count("*").alias("n")), "source")
        self.size, self.hubs = seen.get["n"], None
        if self.size > most:
            self.hubs = _hubs(self.table, "source", most)
        self.split = self.hubs is not None
        if self.split:
            plain = self.table
            others = [c for c in links.columns if c != "source"]
            part = F.pmod(F.xxhash64(*others), F.coalesce("_parts", F.lit(1))).cast("int")
            self.table = self._keep(plain.join(self.hubs, "source", "left").withColumn("_part", part).drop("_parts"), "source", "_part")
            self._forget(1)

    def _keep(self, rows: DataFrame, *keys: str) -> DataFrame:
        """``rows`` as a bucketed Parquet table in the shared folder: it takes a tenth of a checkpoint's disk, reads single
        columns, and joins on its keys without a shuffle."""
        spark = rows.sparkSession
        least = spark.conf.get("spark.sql.shuffle.partitions")
        buckets = max(int(least), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", least)))
        name, path = f"links_{uuid.uuid4().hex}", folder(spark)
        self.names.append((name, path))
        with releasing(spark):
            spread = rows.repartition(buckets, *keys)
            spread.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
        return spark.table(name)

    def _forget(self, first: int) -> None:
        for name, path in self.names[:first]:
            self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.table.sparkSession, path)
        self.names = self.names[first:]

    def meet(self, front: DataFrame, how: str = "inner") -> DataFrame:
        """Edges with the columns that ``front`` has for their ``source``.

        What a round knows of the nodes is hashed, so the edges, many times as many, are not sorted by text ids.
        """
        if not self.split:
            return self.table.join(front.hint("shuffle_hash"), "source", how)
        parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        copies = front.join(self.hubs, "source", "left").withColumn("_part", F.explode(parts)).drop("_parts")
        return self.table.join(copies.hint("shuffle_hash"), ["source", "_part"], how).drop("_part")

    def drop(self) -> None:
        self._forget(len(self.names))
        forget(self.hubs)


def room(df: DataFrame, rows: int | None = None) -> int:
    """Rows of state that a pass may have: so many for each shuffle partition, or ``rows``."""
    return rows or ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def room_within(links: Links) -> int:
    """Rows of state of a pass that reaches all nodes: a row for each ``DENSE`` links.

    Each task of a round sends on what its links make of the state, so the shuffle of a round is many times the state;
    its disk grows with the links, whatever the number of partitions.
    """
    return max(ROWS, links.size // DENSE)


def _or(columns: list[str]) -> Column:
    some = F.lit(False)
    for c in columns:
        some = some | (F.col(c) != 0)
    return some


def search(links: Links, starts: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(state, active, levels) of a breadth-first search from all ``starts`` (id, pos).

    A row of ``state`` (id, block, reached, hops, far) tells for a node and the sources of a block how many reach it,
    their summed hops and the longest. ``active`` (block, depth, w0, ...) has a bit for each source that reached a new
    node at that depth. ``levels`` (id, depth, w0, ...), if asked for, tell which sources reached a node at which depth.
    """
    s, f, w = [f"s{i}" for i in range(WORDS)], [f"f{i}" for i in range(WORDS)], [f"w{i}" for i in range(WORDS)]
    zero = F.lit(0).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % 64).cast("int"))
    own = [F.when(F.floor(F.col("pos") / 64) % WORDS == i, bit).otherwise(zero) for i in range(WORDS)]
    state = cut(starts.select(
        "id", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), *[own[i].alias(s[i]) for i in range(WORDS)],
        *[own[i].alias(f[i]) for i in range(WORDS)], F.lit(1).cast("bigint").alias("reached"), zero.alias("hops"), zero.alias("far"),
    ))
    active, levels, depth = [], [], 0
    if keep:
        levels.append(cut(state.select("id", F.lit(0).alias("depth"), *[F.col(f[i]).alias(w[i]) for i in range(WORDS)])))
    while True:
        depth += 1
        front = state.filter(_or(f)).select(F.col("id").alias("source"), "block", *f)
        offers = links.meet(front).groupBy(F.col("target").alias("id"), "block").agg(*[F.bit_or(c).alias(f"o{i}") for i, c in enumerate(f)])
        fresh = [F.coalesce(f"o{i}", zero).bitwiseAND(F.bitwise_not(F.coalesce(s[i], zero))) for i in range(WORDS)]
        step = state.drop(*f).join(offers, ["id", "block"], "full_outer").select(
            "id", "block", *[F.coalesce(c, zero).alias(c) for c in s], *[fresh[i].alias(f[i]) for i in range(WORDS)],
            *[F.coalesce(c, zero).alias(c) for c in ("reached", "hops", "far")],
        )
        count = sum((F.bit_count(c) for c in f[1:]), F.bit_count(f[0])).cast("bigint")
        step = step.withColumn("_n", count).select(
            "id", "block", *[F.col(s[i]).bitwiseOR(F.col(f[i])).alias(s[i]) for i in range(WORDS)], *f,
            (F.col("reached") + F.col("_n")).alias("reached"), (F.col("hops") + F.col("_n") * depth).alias("hops"),
            F.when(F.col("_n") > 0, F.lit(depth).cast("bigint")).otherwise(F.col("far")).alias("far"), "_n",
        )
        before = state
        state, seen = cut_counting(step, n=F.coalesce(F.sum("_n"), F.lit(0)))
        forget(before)
        state = _keeping(state.drop("_n"), state)
        if seen["n"] == 0:
            break
        new = state.filter(_or(f))
        active.append(cut(new.groupBy("block").agg(F.lit(depth).alias("depth"), *[F.bit_or(f[i]).alias(w[i]) for i in range(WORDS)])))
        if keep:
            levels.append(cut(new.select("id", F.lit(depth).alias("depth"), *[F.col(f[i]).alias(w[i]) for i in range(WORDS)])))
        if len(active) % 32 == 0:  # a long search does not grow a long plan
            active, levels = [_merged(active[:1] + active[1:])], [_merged(levels)] if keep else []
    none = state.select("block", F.lit(0).alias("depth"), *[zero.alias(c) for c in w]).limit(0)
    return state, _merged(active) if active else none, levels


def _keeping(df: DataFrame, of: DataFrame) -> DataFrame:
    df._checkpoint = getattr(of, "_checkpoint", None)
    return df


def _merged(parts: list[DataFrame]) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut(out)
    forget(*parts)
    return out


def farthest(starts: DataFrame, active: DataFrame) -> DataFrame:
    """(id, far) of each start: the last depth at which its search reached a new node."""
    word = F.floor(F.col("pos") / 64) % WORDS
    held = F.lit(0).cast("bigint")
    for i in range(WORDS):
        held = F.when(word == i, F.col(f"w{i}")).otherwise(held)
    seen = F.getbit(held, (F.col("pos") % 64).cast("int")) == 1
    rows = starts.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint")).join(active, "block", "left")
    return rows.groupBy("id").agg(F.coalesce(F.max(F.when(seen, F.col("depth"))), F.lit(0)).cast("bigint").alias("far"))


def passes(starts: DataFrame, nodes: int, rows: int) -> list[DataFrame]:
    """``starts`` (id, pos) in stretches of blocks, so that no pass has more than ``rows`` rows of state, one block at least."""
    blocks = starts.agg(F.max("pos")).first()[0]
    blocks = 0 if blocks is None else blocks // BLOCK + 1
    each = max(1, rows // max(nodes, 1))
    return [starts.filter((F.col("pos") >= i * BLOCK) & (F.col("pos") < (i + each) * BLOCK)) for i in range(0, blocks, each)]


def eccentricities(ids: DataFrame, links: Links, only_greatest: bool = False, rows: int | None = None, pick: int = 64, rounds: int = 4) -> tuple[DataFrame, int]:
    """(id, low, high) of a connected graph with low = high = the longest hop distance, and the number of searches.

    A search from v at distance d bounds a node: its longest distance is at least d and ecc(v) - d, and at most
    ecc(v) + d. Rounds search from nodes of greatest upper and least lower bound, which settle many others. What
    ``rounds`` rounds leave open is searched from in blocks. With ``only_greatest`` nodes count as settled once their
    upper bound does not exceed the greatest lower bound; the greatest ``low`` is then the diameter.
    """
    nodes = ids.count()
    degree = links.table.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    state = cut(ids.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(0).alias("low"), F.lit(nodes).alias("high")))
    used = 0
    for turn in range(rounds + 1):
        top = state.agg(F.coalesce(F.max("low"), F.lit(0))).first()[0]
        is_open = (F.col("low") < F.col("high")) & ((F.col("high") > top) if only_greatest else F.lit(True))
        unsettled = state.filter(is_open)
        if turn == rounds:
            break
        half = pick // 2
        far = unsettled.orderBy(F.desc("high"), F.desc("degree"), "id").limit(half)
        near = unsettled.orderBy("low" if turn else F.xxhash64("id"), F.desc("degree"), "id").limit(half)
        chosen = [r["id"] for r in far.select("id").union(near.select("id")).distinct().collect()]
        if not chosen:
            return state.select("id", "low", "high"), used
        starts = state.sparkSession.createDataFrame([(v, i) for i, v in enumerate(sorted(chosen))], "id bigint, pos bigint")
        state = _bounded(state, links, starts)
        used += len(chosen)
    left = cut(unsettled.select("id"))
    from knotwork.operators.ranking import number_rows

    starts = cut(number_rows(left, [], ["id"], "pos", start=0))
    used += starts.count()
    known = None
    for part in passes(starts, nodes, rows or room_within(links)):
        done, active, _ = search(links, part)
        far = cut(farthest(part, active))
        forget(done, active)
        known = far if known is None else known.unionByName(far)
    if known is not None:
        state = state.join(known, "id", "left").select("id", F.coalesce("far", "low").alias("low"), F.coalesce("far", "high").alias("high"))
    return state.select("id", "low", "high"), used


def _bounded(state: DataFrame, links: Links, starts: DataFrame) -> DataFrame:
    """``state`` with the bounds that searches from ``starts`` (one block) add."""
    done, active, levels = search(links, starts, keep=True)
    far = {r["pos"]: r["far"] for r in starts.join(farthest(starts, active), "id").select("pos", "far").collect()}
    masks: dict[int, list[int]] = {}
    for pos, ecc in far.items():
        masks.setdefault(ecc, [0] * WORDS)[pos // 64] |= 1 << pos % 64
    greatest, least = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for ecc in sorted(masks):
        words = [m - (1 << 64) if m >> 63 else m for m in masks[ecc]]
        here = F.lit(False)
        for i in range(WORDS):
            if words[i]:
                here = here | (F.col(f"w{i}").bitwiseAND(F.lit(words[i])) != 0)
        greatest = F.when(here, F.lit(ecc)).otherwise(greatest)
        least = F.coalesce(least, F.when(here, F.lit(ecc)))
    seen = levels[0]
    for level in levels[1:]:
        seen = seen.unionByName(level)
    found = seen.groupBy("id").agg(
        F.max(F.greatest(F.col("depth"), greatest - F.col("depth"))).alias("_low"), F.min(least + F.col("depth")).alias("_high")
    )
    bounded = cut(state.join(found, "id", "left").select(
        "id", "degree", F.greatest("low", F.coalesce("_low", "low")).alias("low"), F.least("high", F.coalesce("_high", "high")).alias("high")
    ))
    forget(state, done, active, *levels)
    return bounded
