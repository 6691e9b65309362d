"""Hard negatives: rows of another label that score nearly as high against an anchor as its positives do.

Scores are inner products of whole numbers. Every vector's angles to a few reference directions are stored. The angle
between two vectors is at least the difference of their angles to a direction and at most the sum, so the directions
give an interval for their cosine and, with the norms, for their score. Bounds are widened by more than rounding can
do, so no row is lost; the rows that remain are scored in whole numbers.

Vectors lie in blocks, sorted by the direction they are nearest to and their angle to it. Anchors form groups. A group
meets the blocks whose score interval reaches what its anchors look for. In a block an anchor looks at a stretch of
rows: those whose angle is near enough to its own. A first pass inside each anchor's block gives a score that its
positives at least have; the positives, once known, give the window of scores for the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from knotwork.llm.common import stored
from knotwork.operators.loop import keep_first
from knotwork.operators.ranking import top_k

#: Rows of a block, anchors of a group, and anchors scored at once.
BLOCK, GROUP, TOGETHER = 4096, 2048, 64
#: Reference directions, and the rows of which they are chosen: those of least hash.
DIRECTIONS, SAMPLE = 16, 2048
#: Share of the product of two norms by which bounds are widened, and least amount.
MARGIN, LEAST = 1e-6, 0.5
#: Longer vectors take no part: their scores might not fit 64 bits.
LONGEST = 2.0**31
NONE, ALL = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part; components become whole numbers.

    Rows take no part if id, label or vector is null, a component is null or not finite, or the vector is longer than
    2**31. Rows of one vec_id count once: the least label, then the least vector.
    """
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    norm = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), ints.alias("ints"))
    return keep_first(rows.filter(norm < LONGEST**2), ["vec_id"], ["label", "ints"])


def directions(rows: DataFrame, number: int = DIRECTIONS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit vectors by dimension: of a bounded sample, each the one that is farthest from those before it."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("ints").collect()
    found: dict[int, np.ndarray] = {}
    for size in {len(r["ints"]) for r in drawn}:
        own = [r["ints"] for r in drawn if len(r["ints"]) == size]
        data = np.array(own, np.float64).reshape(len(own), size)
        norms = np.linalg.norm(data, axis=1)
        data = data[norms > 0] / norms[norms > 0, None]
        chosen, nearest = [], np.full(len(data), -2.0)
        while len(data) and len(chosen) < number and nearest.min() < 1 - 1e-9:
            chosen.append(data[nearest.argmin()])
            nearest = np.maximum(nearest, data @ chosen[-1])
        if chosen:
            found[size] = np.array(chosen)
    return found


def angles(data: np.ndarray, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to the directions of that dimension); a null vector has angles of zero.

    A dimension without directions has one, along all axes.
    """
    size = data.shape[1]
    to = known.get(size, np.full((1, size), 1 / math.sqrt(size or 1)))
    values = data.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", values, values))
    cosine = values @ to.T / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def placed(rows: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with size (of the vector), cell (the nearest direction) and near (the angle to it)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.diff(table["ints"].combine_chunks().offsets.to_numpy())
            for size in np.unique(sizes):
                part = table.filter(pa.array(sizes == size)).combine_chunks()
                _, to = angles(_matrix(part["ints"].combine_chunks(), int(size)), known)
                cell = to.argmin(axis=1)
                part = part.append_column("size", pa.array(np.full(len(part), size), pa.int32()))
                part = part.append_column("cell", pa.array(cell, pa.int32()))
                yield from part.append_column("near", pa.array(to[np.arange(len(to)), cell], pa.float64())).to_batches()

    return rows.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", size int, cell int, near double")


def packed(rows: DataFrame, known: dict[int, np.ndarray], most: int, parts: int | None, by_cell: bool, extra: dict[str, int]) -> DataFrame:
    """Neighbouring rows as one row each: numbers as bytes, with intervals of angles and norms.

    ``extra`` names columns of whole numbers that go along: width 1 for plain ones, k for lists of k.
    """
    order = ["size", "cell", "near", "vec_id"]
    ordered = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    ordered = ordered.select("size", "cell", "near", "vec_id", "label", "ints", *extra)

    def pack(table: pa.Table, number: int) -> pa.RecordBatch:
        size, cell = table["size"][0].as_py(), table["cell"][0].as_py()
        data = _matrix(table["ints"].combine_chunks(), size)
        norms, to = angles(data, known)
        kind = np.int32 if np.abs(data).max(initial=0) < 1 << 31 else np.int64
        row = {"number": number, "size": size, "cell": cell, "n": len(data)}
        row |= {"angle_lo": to.min(axis=0).tolist(), "angle_hi": to.max(axis=0).tolist(), "norm_lo": norms.min(), "norm_hi": norms.max()}
        row |= {"wide": kind is np.int64, "ids": table["vec_id"].to_numpy().tobytes(), "labels": table["label"].to_numpy().tobytes()}
        row |= {"data": data.astype(kind).tobytes(), "near": table["near"].to_numpy().tobytes()}
        for name, width in extra.items():
            column = table[name].combine_chunks()
            values = column.to_numpy(zero_copy_only=False) if width == 1 else _matrix(column, width)
            row[name] = values.astype(np.int64).tobytes()
        return pa.RecordBatch.from_pylist([row], schema)

    names = [pa.field("number", pa.int64()), *[pa.field(c, pa.int32()) for c in ("size", "cell", "n")]]
    names += [pa.field(c, pa.list_(pa.float64())) for c in ("angle_lo", "angle_hi")] + [pa.field(c, pa.float64()) for c in ("norm_lo", "norm_hi")]
    names += [pa.field("wide", pa.bool_()), *[pa.field(c, pa.binary()) for c in ("ids", "labels", "data", "near", *extra)]]
    schema = pa.schema(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            keys = held["size"].to_numpy().astype(np.int64) << 32 | (held["cell"].to_numpy() if by_cell else 0)
            start = 0
            for end in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
                while end - start >= most or (start < end < len(keys)):
                    stop = min(end, start + most)
                    yield pack(held.slice(start, stop - start), number)
                    number, start = number + 1, stop
            held = held.slice(start)
        if held is not None and len(held):
            yield pack(held, number)

    kinds = "number bigint, size int, cell int, n int, angle_lo array<double>, angle_hi array<double>, norm_lo double, norm_hi double, wide boolean"
    return ordered.mapInArrow(scan, kinds + "".join(f", {c} binary" for c in ("ids", "labels", "data", "near", *extra)))


class _Part:
    """A packed block or group."""

    def __init__(self, row: dict, extra: dict[str, int] | None = None):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.data = np.frombuffer(row["data"], np.int64 if row["wide"] else np.int32).reshape(len(self.ids), row["size"])
        self.near, self.cell, self.norm = np.frombuffer(row["near"], np.float64), row["cell"], (row["norm_lo"], row["norm_hi"])
        self.lo, self.hi = np.array(row["angle_lo"]), np.array(row["angle_hi"])
        for name, width in (extra or {}).items():
            values = np.frombuffer(row[name], np.int64)
            setattr(self, name, values if width == 1 else values.reshape(-1, width))


def score_bounds(angle_lo, angle_hi, norm_lo, norm_hi):
    """(lowest, highest) score for angles and products of norms in the given intervals, widened."""
    low, high = np.cos(np.minimum(angle_hi, math.pi)), np.cos(np.minimum(angle_lo, math.pi))
    wide = MARGIN * norm_hi + LEAST
    return np.where(low >= 0, norm_lo, norm_hi) * low - wide, np.where(high >= 0, norm_hi, norm_lo) * high + wide


def stretches(group: _Part, block: _Part, known: dict[int, np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchors, first rows, last rows): where a block may have scores from ``low`` to ``high`` for an anchor of the group."""
    norms, to = angles(group.data, known)
    apart = np.maximum(np.maximum(to - block.hi, block.lo - to), 0).max(axis=1)
    far = np.minimum(to + block.hi, 2 * math.pi - to - block.lo).min(axis=1)
    least, most = score_bounds(apart, far, norms * block.norm[0], norms * block.norm[1])
    live = np.flatnonzero((most >= low) & (least <= high))
    # Of the sorted rows, those whose angle to the block's direction differs so little that the score can reach ``low``.
    product = norms[live] * block.norm[1]
    cosine = (low[live] - MARGIN * product - LEAST) / np.where(product > 0, product, 1)
    reach = np.where((product > 0) & (cosine > -1), np.arccos(np.clip(cosine, -1, 1)) + MARGIN, math.pi)
    own = to[live, block.cell]
    return live, np.searchsorted(block.near, own - reach, "left"), np.searchsorted(block.near, own + reach, "right")


def scores(group: _Part, block: _Part, anchors: np.ndarray, first: int, last: int) -> np.ndarray:
    """Exact inner products of anchors with rows of the block."""
    a, b = group.data[anchors], block.data[first:last]
    if group.norm[1] * block.norm[1] < 1 << 52:  # every sum is then a whole number that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def meetings(group: _Part, block: _Part, known: dict[int, np.ndarray], low: np.ndarray, high: np.ndarray):
    """(anchor, first row, scores from there on) for all anchors of the group and the stretches they look at."""
    live, first, last = stretches(group, block, known, low.astype(np.float64), high.astype(np.float64))
    keep = first < last
    live, first, last = live[keep], first[keep], last[keep]
    order = np.argsort(first, kind="stable")
    for i in range(0, len(order), TOGETHER):
        some = order[i : i + TOGETHER]
        start = int(first[some].min())
        found = scores(group, block, live[some], start, int(last[some].max()))
        for at, a, z, row in zip(live[some].tolist(), first[some].tolist(), last[some].tolist(), found):
            yield at, a, row[a - start : z - start]


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, ties by smaller id."""
    if len(values) > k:
        near = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    else:
        near = np.arange(len(values))
    return near[np.lexsort((ids[near], -values[near]))][:k]


def _floors(blocks: DataFrame, k: int) -> DataFrame:
    """(vec_id, floor): the k-th best score that an anchor's own block has for it, null if it has fewer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Part(row, {"anchor": 1})
                anchors, found = np.flatnonzero(block.anchor), []
                for i in range(0, len(anchors), TOGETHER):
                    some = anchors[i : i + TOGETHER]
                    for at, values in zip(some.tolist(), scores(block, block, some, 0, len(block.ids))):
                        same = (block.labels == block.labels[at]) & (block.ids != block.ids[at])
                        values = values[same]
                        found.append(int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[anchors]), pa.array(found, pa.int64())], names=["vec_id", "floor"])

    return blocks.mapInArrow(scan, "vec_id bigint, floor bigint")


def _met(groups: DataFrame, blocks: DataFrame, low: str, high: str, kept: list[str]) -> DataFrame:
    """A group with a block, where the bounds of both let the block hold what the group looks for.

    Groups come in as many copies as there are runs of 64 blocks, so that no key gathers more.
    """
    salts = max(1, math.ceil(blocks.count() / 64))
    few = blocks.select("size", F.col("number").alias("_block"), *[F.col(c).alias(f"_{c}") for c in ("angle_lo", "angle_hi", "norm_lo", "norm_hi")])
    few = few.withColumn("_salt", F.pmod(F.xxhash64("_block"), F.lit(salts)).cast("int"))
    many = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("number", "_group")
    apart = F.zip_with(
        F.zip_with("angle_lo", "_angle_hi", lambda x, y: x - y), F.zip_with("_angle_lo", "angle_hi", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    far = F.zip_with(
        F.zip_with("angle_hi", "_angle_hi", lambda x, y: x + y), F.zip_with("angle_lo", "_angle_lo", lambda x, y: 2 * math.pi - x - y),
        lambda x, y: F.least(x, y, F.lit(math.pi)),
    )
    pairs = many.join(few, ["size", "_salt"])
    pairs = pairs.withColumns({"_cos_hi": F.cos(F.array_max(apart)), "_cos_lo": F.cos(F.array_min(far))})
    least, most = F.col("norm_lo") * F.col("_norm_lo"), F.col("norm_hi") * F.col("_norm_hi")
    wide = most * MARGIN + LEAST
    highest = F.when(F.col("_cos_hi") >= 0, most).otherwise(least) * F.col("_cos_hi") + wide
    lowest = F.when(F.col("_cos_lo") >= 0, least).otherwise(most) * F.col("_cos_lo") - wide
    pairs = pairs.filter((highest >= F.col(low)) & (lowest <= F.col(high)))
    side = groups.columns
    left = pairs.select(F.struct(*[F.col("_group").alias(c) if c == "number" else F.col(c) for c in side if c in kept or c == "number"]).alias("group"), "_block")
    right = blocks.select(F.col("number").alias("_block"), F.struct(*[c for c in blocks.columns if c != "anchor"]).alias("block"))
    return left.join(right, "_block").select("group", "block")


_SIDE = ["size", "cell", "angle_lo", "angle_hi", "norm_lo", "norm_hi", "wide", "ids", "labels", "data", "near"]


def _positives(met: DataFrame, known: dict[int, np.ndarray], k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group, block = _Part(row["group"], {"floor": 1}), _Part(row["block"])
                out: list[tuple] = []
                high = np.full(len(group.ids), float(ALL))
                for at, first, values in meetings(group, block, known, group.floor, high):
                    ids, labels = block.ids[first : first + len(values)], block.labels[first : first + len(values)]
                    good = np.flatnonzero((labels == group.labels[at]) & (ids != group.ids[at]) & (values >= group.floor[at]))
                    for i in good[best(values[good], ids[good], k)].tolist():
                        out.append((int(group.ids[at]), int(ids[i]), int(values[i])))
                yield _rows(out, ["anchor_id", "positive_id", "positive_score"])

    return met.mapInArrow(scan, "anchor_id bigint, positive_id bigint, positive_score bigint")


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def _negatives(met: DataFrame, known: dict[int, np.ndarray], positives: int, k: int) -> DataFrame:
    extra = {"positive": positives, "score": positives, "low": positives, "high": positives}
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group, block = _Part(row["group"], extra), _Part(row["block"])
                out: list[tuple] = []
                lowest, highest = group.low.min(axis=1), group.high.max(axis=1)
                for at, first, values in meetings(group, block, known, lowest, highest):
                    ids, labels = block.ids[first : first + len(values)], block.labels[first : first + len(values)]
                    good = np.flatnonzero((labels != group.labels[at]) & (values >= lowest[at]) & (values <= highest[at]))
                    if not len(good):
                        continue
                    good = good[np.lexsort((ids[good], -values[good]))]
                    falling = -values[good]
                    for j in range(positives):
                        low, high = int(group.low[at, j]), int(group.high[at, j])
                        if low > high:
                            continue
                        start = int(np.searchsorted(falling, -high, "left"))
                        for i in good[start : start + k].tolist():
                            if values[i] < low:
                                break
                            out.append((int(group.ids[at]), int(group.positive[at, j]), int(group.score[at, j]), int(ids[i]), int(values[i])))
                yield _rows(out, names)

    return met.mapInArrow(scan, ", ".join(f"{c} bigint" for c in names))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score and negative_score.

    ``rows`` are (vec_id, label, ints) as ``quantised`` gives them, each vec_id once; ``anchor`` tells which are anchors.
    An anchor's positives are the ``positives`` best other rows of its label; for each the ``negatives`` best rows of
    other labels whose score is from ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller vec_id.
    Vectors of unlike size do not meet. No window lies below a positive of negative score; one of score zero is met by
    scores of zero. An empty table gives an empty table.
    """
    rows = stored(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False)).cast("bigint")))
    known = directions(rows)
    rows = placed(rows, known)
    blocks = stored(packed(rows, known, BLOCK, None, True, {"anchor": 1}))
    anchors = rows.filter("anchor = 1").join(_floors(blocks, positives), "vec_id", "left")
    anchors = stored(anchors.withColumn("floor", F.coalesce("floor", F.lit(NONE))))
    parts = max(1, math.ceil(anchors.count() / GROUP))

    groups = _bounded(packed(anchors, known, GROUP, parts, False, {"floor": 1}), "floor", None)
    found = _positives(_met(groups, blocks, "_low", "_high", [*_SIDE, "floor"]), known, positives)
    found = stored(top_k(found, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives))

    score, hundred = F.col("positive_score"), F.lit(100)
    window = F.struct(
        "rank", F.col("positive_id").alias("positive"), score.alias("score"),
        F.when(score < 0, F.lit(1)).otherwise(_share(score, low, True)).cast("bigint").alias("low"),
        F.when(score < 0, F.lit(0)).otherwise(_share(score, high, False)).cast("bigint").alias("high"),
    )
    # At most ``positives`` rows an anchor; missing ones become windows that hold nothing.
    known_positives = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("_p")).withColumnRenamed("anchor_id", "vec_id")
    blank = F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in (("rank", 0), ("positive", 0), ("score", 0), ("low", ALL), ("high", NONE))])
    filled = F.slice(F.concat(F.col("_p"), F.array_repeat(blank, positives)), 1, positives)
    looking = anchors.drop("floor").join(known_positives, "vec_id").withColumn("_p", filled)
    looking = looking.select("*", *[F.col(f"_p.{c}").alias(c) for c in ("positive", "score", "low", "high")]).drop("_p")
    extra = {c: positives for c in ("positive", "score", "low", "high")}
    groups = _bounded(packed(looking, known, GROUP, parts, False, extra), "low", "high")
    near = _negatives(_met(groups, blocks, "_low", "_high", [*_SIDE, *extra]), known, positives, negatives)
    ranked = top_k(near, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _share(score: Column, hundredths: int, up: bool) -> Column:
    """``score`` times ``hundredths`` / 100, rounded up or down, without leaving 64 bits; for scores from zero."""
    rest = F.pmod(score, F.lit(100)) * hundredths + (99 if up else 0)
    return F.expr("positive_score div 100") * hundredths + F.floor(rest / 100).cast("bigint")


def _bounded(groups: DataFrame, low: str, high: str | None) -> DataFrame:
    """``groups`` stored, with the least of ``low`` and the greatest of ``high`` as _low and _high."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [float(np.frombuffer(b.as_py(), np.int64).min()) for b in batch.column(low)]
            most = [float(np.frombuffer(b.as_py(), np.int64).max()) for b in batch.column(high)] if high else [float(ALL)] * batch.num_rows
            columns = [*batch.columns, pa.array(least, pa.float64()), pa.array(most, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_low", "_high"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)
    return stored(groups.mapInArrow(scan, kinds + ", _low double, _high double"))
