"""Exact removal of byte strings that occur more than once, by common-prefix interval trees.

Anchors. In every window of ``LENGTH`` bytes the byte run of ``GRAM`` bytes with the least hash is the anchor, the first
one if several tie. Equal windows have equal anchors at equal places, so two windows can be equal only if their anchors'
hashes are. An anchor's windows follow each other; its context is the bytes that they cover.

Suffixes. Contexts whose anchors have one hash form a group. A context that occurs twice has all its windows repeated.
For the others, and to find their partners, the distinct contexts of the groups are sorted by the suffix that starts at
the anchor, with the lengths of common prefixes between neighbours: an enhanced suffix array of the group. A scan with
a stack yields the tree of its common-prefix intervals. The members of an interval share a right extension; sorting
them by the bytes before the anchor tells how far each one's left extension agrees with another member's, and where it
turns diverse. The two extensions give the maximal repeats and, with them, every window that another context holds.

Groups are dealt into tasks in bins of bounded size. The windows of a group with more distinct contexts than ``GROUP``
are compared by 128-bit hashes in an aggregate instead, which needs no group in one place.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from knotwork.llm.common import map_texts, stored

LENGTH, GRAM = 200, 40
#: Contexts of a bin, and distinct contexts of a group that a task takes.
BIN, GROUP = 20_000, 50_000
#: Bytes that one step of the anchor search works on.
STEP = 1 << 17
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_FACTOR, -1, 1 << 64)
    size = STEP + 4 * LENGTH
    return tuple(
        np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, f, np.uint64)]), dtype=np.uint64) for f in (_FACTOR, inverse)
    )


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(places, hashes, first windows, last windows) of the anchors of all windows of ``length`` bytes, in order.

    The windows of an anchor follow each other. An anchor whose windows lie in two steps comes once for each.
    """
    windows = len(data) - length + 1
    found = []
    for start in range(0, max(windows, 0), STEP):
        place, value, first, last = _anchors(data[start : start + STEP + length - 1], length, gram)
        found.append((place + start, value, first + start, last + start))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    power, inverse = _powers()
    n, width = len(data), length - gram + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # Hash above, place below: the least value is the least hash, first place on ties.
    low = np.uint64(20)
    value = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    rows = np.concatenate([value, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(h) - width + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    place, first = np.unique((least & np.uint64((1 << 20) - 1)).astype(np.int64), return_index=True)
    return place, h[place], first, np.append(first[1:], count) - 1


def contexts(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int, int]]:
    """(group hash, context hash, place, left, tail) of all anchors.

    An anchor's windows start ``left`` bytes before the place at the earliest; ``tail`` bytes from the place on lie in them.
    """
    place, value, first, last = anchors(data, length, gram)
    left, tail = place - first, last + length - place
    out, digest = [], xxhash.xxh3_64_intdigest
    for p, v, a, z in zip(place.tolist(), value.view(np.int64).tolist(), left.tolist(), tail.tolist()):
        d = digest(data[p - a : p + z], a)
        out.append((v, d - (1 << 64) if d >> 63 else d, p, a, z))
    return out


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; rows are padded."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], np.minimum(agree, np.minimum(sizes[1:], sizes[:-1]))])


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width), sizes


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(common prefix, parent's common prefix, first, last) of every interval, by a scan with a stack."""
    stack = [(-1, 0)]
    for i, common in enumerate([*prefixes[1:], -1], start=1):
        first = i - 1
        while stack[-1][0] > common:
            depth, first = stack.pop()
            yield depth, max(common, stack[-1][0]), first, i - 1
        if stack[-1][0] < common:
            stack.append((common, first))


def repeats(groups: list[int], lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(context, repeat, left, right, nearest, farthest) of every maximal repeat that is long enough, and its members.

    ``lefts`` are the bytes before each anchor, ``rights`` those from it on, ``groups`` the anchors' hashes. A member
    agrees with some other member in ``left`` bytes before the anchor and all members in ``right`` bytes after it;
    windows that start from ``nearest`` to ``farthest`` bytes before the anchor are repeated for that reason.
    """
    order = sorted(range(len(groups)), key=lambda i: (groups[i], rights[i]))
    group = np.array([groups[i] for i in order], np.int64)
    right, right_size = _padded([rights[i] for i in order], length)
    left, left_size = _padded([lefts[i][::-1] for i in order], max(1, max(map(len, lefts), default=1)))
    prefixes = _common(right, right_size)
    prefixes[1:][group[1:] != group[:-1]] = -1
    by_left = sorted(range(len(order)), key=lambda i: lefts[order[i]][::-1])
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    out, pairs = [], []
    for number, (depth, above, first, last) in enumerate(intervals(prefixes.tolist())):
        near, far = max(0, length - depth), length - 1 - max(above, 0)
        if depth <= 0 or near > far or near > left.shape[1]:
            continue
        if last == first + 1:
            pairs.append((number, depth, near, far, first))
            continue
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        agree = _common(left[members], left_size[members])
        best = np.maximum(agree, np.append(agree[1:], 0))
        far_each = np.minimum(far, best)
        for at in np.flatnonzero(far_each >= near).tolist():
            out.append((order[members[at]], number, int(best[at]), depth, near, int(far_each[at])))
    if pairs:  # most intervals have two members: all at once
        number, depth, near, far, first = np.array(pairs).T
        differ = left[first] != left[first + 1]
        agree = np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])
        agree = np.minimum(agree, np.minimum(left_size[first], left_size[first + 1]))
        far = np.minimum(far, agree)
        for at in np.flatnonzero(far >= near).tolist():
            for member in (first[at], first[at] + 1):
                out.append((order[member], int(number[at]), int(agree[at]), int(depth[at]), int(near[at]), int(far[at])))
    return out


def _settled(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` stored, and the shuffle files of what led to it given back."""
    done = stored(df)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def document_key() -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64("text").alias("_digest")]


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(occurrences, members).

    ``occurrences`` (grp, ctx, _id, _digest, place, low, tail, times) is every anchor whose hash occurs more than once,
    with its document, its context and the number of times the context occurs. ``members`` (grp, ctx, repeat, left,
    right, nearest, farthest) is every maximal repeat of unequal contexts with each context that has it. A repeat's
    occurrences are those of its members; each starts ``left`` bytes before ``place``, cut to the context.
    """
    spark = docs.sparkSession

    def compute(texts: list) -> dict:
        names = ("grp", "ctx", "place", "low", "tail")
        return {"found": [[dict(zip(names, c)) for c in contexts((t or "").encode("utf-8", "surrogatepass"), length, gram)] for t in texts]}

    keyed = docs.select(*document_key(), "text")
    kind = "found array<struct<grp: bigint, ctx: bigint, place: int, low: int, tail: int>>"
    each = _settled(map_texts(keyed, ["_id", "_digest"], compute, kind), spark).select("_id", "_digest", F.inline("found"))
    distinct = _settled(each.groupBy("grp", "ctx").agg(F.count("*").alias("times")), spark)
    groups = distinct.groupBy("grp").agg(F.sum("times").alias("n"), F.count("*").alias("unlike")).filter("n > 1").drop("n")
    some = _settled(distinct.join(groups, "grp"), spark)
    occurrences = _settled(each.join(some, ["grp", "ctx"]), spark)
    # One occurrence stands for each context of a group with several; its bytes come from its document.
    one = F.min(F.struct("_id", "_digest", "place", "low", "tail")).alias("one")
    samples = occurrences.filter("unlike > 1").groupBy("grp", "ctx", "unlike").agg(one).select("grp", "ctx", "unlike", "one.*")
    wanted = samples.groupBy("_id", "_digest").agg(F.collect_list(F.struct("grp", "ctx", "unlike", "place", "low", "tail")).alias("wanted"))
    texts = keyed.withColumnsRenamed({"_id": "_i", "_digest": "_d"})
    lines = texts.join(wanted, (F.col("_i") == F.col("_id")) & (F.col("_d") == F.col("_digest"))).select("text", "wanted")
    held = _settled(lines.mapInArrow(_bytes, "grp bigint, ctx bigint, unlike bigint, before binary, after binary").dropDuplicates(["grp", "ctx"]), spark)
    bins = held.filter(F.col("unlike") <= limit).count() // BIN + 1
    dealt = held.filter(F.col("unlike") <= limit).withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins)))
    shape = "grp bigint, ctx bigint, repeat bigint, left int, right int, nearest int, farthest int"
    trees = dealt.groupBy("bin").applyInArrow(lambda t: _trees(t, length), shape)
    wide = held.filter(F.col("unlike") > limit)
    members = _settled(trees.unionByName(_windows(wide, length, shape)), spark)
    return occurrences, members


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            data = (batch.column(0)[row].as_py() or "").encode("utf-8", "surrogatepass")
            wanted = batch.column(1)[row].as_py()
            for at in range(0, len(wanted), 20_000):
                part = wanted[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([w[c] for w in part], pa.int64()) for c in ("grp", "ctx", "unlike")),
                     pa.array([data[w["place"] - w["low"] : w["place"]] for w in part], pa.binary()),
                     pa.array([data[w["place"] : w["place"] + w["tail"]] for w in part], pa.binary())],
                    names=["grp", "ctx", "unlike", "before", "after"],
                )


def _trees(table: pa.Table, length: int) -> pa.Table:
    grp, ctx = table.column("grp").to_pylist(), table.column("ctx").to_pylist()
    found = repeats(grp, table.column("before").to_pylist(), table.column("after").to_pylist(), length)
    columns = list(zip(*found)) if found else [()] * 6
    data = {"grp": pa.array([grp[i] for i in columns[0]], pa.int64()), "ctx": pa.array([ctx[i] for i in columns[0]], pa.int64()), "repeat": pa.array(columns[1], pa.int64())}
    return pa.table(data | {name: pa.array(columns[at], pa.int32()) for at, name in enumerate(("left", "right", "nearest", "farthest"), start=2)})


def _windows(held: DataFrame, length: int, shape: str) -> DataFrame:
    """The same for groups of any size: each window of each context by its hash; a window is a repeat of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, ctx, _, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                data, rows = before + after, range(max(0, length - len(after)), len(before) + 1)
                hashes = [xxhash.xxh3_128_digest(data[len(before) - o : len(before) - o + length]) for o in rows]
                high, low = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).T.astype(np.int64)
                arrays = [np.full(len(rows), grp), np.full(len(rows), ctx), np.array(rows), high, low]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["grp", "ctx", "o", "h", "l"])

    rows = held.mapInArrow(cut, "grp bigint, ctx bigint, o bigint, h bigint, l bigint")
    again = rows.groupBy("grp", "o", "h", "l").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    found = rows.join(again, ["grp", "o", "h", "l"])
    start = F.col("o").cast("int")
    return found.select("grp", "ctx", F.col("h").alias("repeat"), start.alias("left"), (F.lit(length) - start).alias("right"), start.alias("nearest"), start.alias("farthest"))


def covered(occurrences: DataFrame, members: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _digest, runs): byte ranges (a, z) of each document that repeated windows cover, as they are found."""
    same = occurrences.filter("times > 1").select("_id", "_digest", (F.col("place") - F.col("low")).alias("a"), (F.col("place") + F.col("tail")).alias("z"))
    spans = members.groupBy("grp", "ctx").agg(F.collect_set(F.struct("nearest", "farthest")).alias("spans"))  # 200 at most
    unlike = occurrences.filter("times = 1 AND unlike > 1").join(spans, ["grp", "ctx"]).select("_id", "_digest", "place", F.inline("spans"))
    unlike = unlike.select("_id", "_digest", (F.col("place") - F.col("farthest")).alias("a"), (F.col("place") - F.col("nearest") + length).alias("z"))
    return same.unionByName(unlike).groupBy("_id", "_digest").agg(F.collect_list(F.struct("a", "z")).alias("runs"))


def _rest(text: str | None, runs: list | None) -> tuple[bytes, list[tuple[int, int]], int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    merged: list[list[int]] = []
    for run in sorted((r["a"], r["z"]) for r in runs or []):
        if merged and run[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], run[1])
        else:
            merged.append(list(run))
    parts, at = [], 0
    for a, z in merged:
        parts.append(data[at:a])
        at = z
    return b"".join([*parts, data[at:]]), [tuple(m) for m in merged], len(data)


def without_repeats(docs: DataFrame, carry: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, limit: int = GROUP) -> DataFrame:
    """The ``carry`` columns (doc_id), n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``.

    Every byte goes that a string of ``length`` bytes covers which also starts elsewhere, in the same or another row;
    matches do not cross rows. Null texts are empty, and texts shorter than ``length`` stay whole.
    """
    carry = carry or ["doc_id"]
    occurrences, members = repeat_groups(docs.select("doc_id", "text"), length, gram, limit)
    runs = _settled(covered(occurrences, members, length), docs.sparkSession).withColumnsRenamed({"_id": "_i", "_digest": "_d"})
    rows = docs.select(*carry, *document_key(), F.col("text").alias("_text"))
    joined = rows.join(runs, (F.col("_i") == F.col("_id")) & (F.col("_d") == F.col("_digest")), "left").select(*carry, "_text", "runs")
    names = ("n_bytes", "n_removed", "n_spans")
    out = StructType([*joined.schema[: len(carry)], *(StructField(n, LongType()) for n in names), StructField("kept_sha256", StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                left = [_rest(t, r) for t, r in zip(part.column("_text").to_pylist(), part.column("runs").to_pylist())]
                made = [pa.array([f(x) for x in left], pa.int64()) for f in (lambda x: x[2], lambda x: x[2] - len(x[0]), lambda x: len(x[1]))]
                made.append(pa.array([hashlib.sha256(x[0]).hexdigest() for x in left]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *made], names=[*carry, *names, "kept_sha256"])

    return joined.mapInArrow(digest, out)
