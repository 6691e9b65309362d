"""Near duplicates by SimHash fingerprints, found through Golay codewords.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of two fingerprints that differ in at most three
bits, some two segments differ in at most one bit each (leave out the segment with most differences). Each segment is
decoded to the nearest codeword of the perfect binary Golay code (23, 12, 7); flipping any one bit first gives the
codewords that a neighbour at one bit decodes to, six at most. One side of the join carries the nearest codewords of
a segment pair, the other side all neighbours' codewords, so no link is missed. Links are verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from knotwork.llm.common import map_texts, stored
from knotwork.llm.linking import components

#: (shift, bits) of the segments, and the pairs of segments that make a key.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BLOCK = 1 << 14
#: Small fingerprints of a text, and the least shingle hashes that estimate the similarity of two texts.
PARTS, LEAST = 12, 128
#: Texts of a block of a large bucket of candidates.
CANDIDATES = 2048


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """Codeword number (the 12 message bits) nearest to each 23-bit word, by the syndromes of all errors of up to three bits."""
    words = np.arange(1 << 23, dtype=np.int32)

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= ((x >> bit) & 1) * np.int32(GENERATOR << (bit - 11))
        return x

    single = [1 << i for i in range(23)]
    errors = np.array(
        [0, *single, *(a | b for i, a in enumerate(single) for b in single[:i]),
         *(a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j])], dtype=np.int32
    )
    by_syndrome = np.zeros(1 << 11, dtype=np.int32)
    by_syndrome[remainder(errors)] = errors
    return ((words ^ by_syndrome[remainder(words)]) >> 11).astype(np.int16)


def _shingle_hashes(text: str | None, words: int) -> Iterator[list[int]]:
    """XXH64 of the word shingles of a text, repeats included, in blocks."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    hashed, join, block = xxhash.xxh64_intdigest, b" ".join, []
    for run in zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]:
        block.append(hashed(join(run), 42))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of word shingles; 0 for a text without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for block in _shingle_hashes(text, words):
        ones, total = ones + _bit_counts(block), total + len(block)
    return _fingerprint(ones, total)


def _fingerprint(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]) if total else 0


def sketch(text: str | None, words: int = 5) -> tuple[int, list[int], list[int]]:
    """(fingerprint, the ``LEAST`` least shingle hashes in order, one Golay key for each of ``PARTS`` small fingerprints).

    A small fingerprint is the SimHash of the three shingles that come first in one of ``PARTS`` orders of all
    shingles; its key are the codewords of its segments. Texts of one shingle or two have it of what they have.
    """
    blocks = list(_shingle_hashes(text, words))
    if not blocks:
        return 0, [], []
    ones = sum(_bit_counts(b) for b in blocks)
    total = sum(map(len, blocks))
    values = np.unique(np.concatenate([np.array(b, dtype=np.uint64) for b in blocks]))
    few = min(3, len(values))
    ordered = values * _orders()[:, None]
    ordered ^= ordered >> np.uint64(31)
    first = np.argpartition(ordered, few - 1, axis=1)[:, :few]
    bits = np.unpackbits(values[first].astype("<u8").view(np.uint8).reshape(PARTS, few, 8), axis=2, bitorder="little")
    small = np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > few, axis=1, bitorder="little").view("<u8").ravel()
    nearest, keys = decoder(), np.arange(PARTS, dtype=np.int64)
    for shift, width in SEGMENTS:
        keys = (keys << 12) | nearest[((small >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)]
    return _fingerprint(ones, total), values[:LEAST].view(np.int64).tolist(), keys.tolist()


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    return np.random.RandomState(7_919).randint(1, 1 << 62, PARTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if len(bits) < 256:
        return bits.sum(axis=0, dtype=np.int64)
    # Sums of 255 rows fit a byte, which adds far faster than a wide sum.
    whole = len(bits) // 255 * 255
    low = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8)
    return low.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) for every row of ``docs``. Null and empty texts have fingerprint 0."""

    return fingerprinted(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ["doc_id"], words)


def fingerprinted(df: DataFrame, carry: list[str], words: int) -> DataFrame:
    """The ``carry`` columns and the fingerprint of ``text``."""
    return map_texts(df, carry, lambda texts: {"fingerprint": [text_fingerprint(t, words) for t in texts]}, "fingerprint bigint")


def _keys(values: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment the codeword of every value and a table (value, flips) of its neighbours' codewords, -1 for repeats."""
    nearest, bits = decoder(), values.to_numpy(dtype=np.int64).view(np.uint64)
    out = []
    for shift, width in SEGMENTS:
        segment = ((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own = nearest[segment].astype(np.int64)
        near = np.sort(np.column_stack([own, *(nearest[segment ^ (1 << i)] for i in range(width))]), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        out.append((own, near))
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def own_keys(values: pd.Series) -> pd.Series:
    """The nearest codewords of the segment pairs, one key a pair."""
    segments = _keys(values)
    keys = [(i << 24) | (segments[a][0] << 12) | segments[b][0] for i, (a, b) in enumerate(PAIRS)]
    return pd.Series(list(np.column_stack(keys).astype(np.int32)), dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def near_keys(values: pd.Series) -> pd.Series:
    """The codewords of all words within one bit in both segments of a pair."""
    segments = _keys(values)
    out = []
    for row in range(len(values)):
        near = [n[row][n[row] >= 0] for _, n in segments]
        out.append(np.concatenate([((i << 24) | (near[a][:, None] << 12) | near[b][None, :]).ravel() for i, (a, b) in enumerate(PAIRS)]).astype(np.int32))
    return pd.Series(out, dtype=object)


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b), a < b: the pairs of distinct ``fingerprint`` values that differ in ``bits`` (3 at most) or fewer bits.

    The sides are merged: Spark takes either for as small as the fingerprints, though a hundred keys come of each, and
    would send all of them through the driver.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the segments guarantee up to three differing bits")
    near = distinct.select(F.explode(own_keys("fingerprint")).alias("key"), F.col("fingerprint").alias("a"))
    wide = distinct.select(F.explode(near_keys("fingerprint")).alias("key"), F.col("fingerprint").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return near.hint("merge").join(wide.hint("merge"), (near["key"] == wide["key"]) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs`` (doc_id, text and any other columns).

    Rows with equal fingerprints are one node, so copies cost nothing after the first aggregate. A row without a
    doc_id takes part in linking and gets the least id its component has, null if it has none.
    """
    marked = stored(fingerprints(docs, words))
    nodes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    groups = components(links(nodes, bits)).withColumnRenamed("id", "fingerprint")
    placed = nodes.join(groups, "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _table(sets: list) -> tuple[np.ndarray, np.ndarray]:
    """Least hashes as rows of equal length, padded with the greatest number, and their counts."""
    rows = np.full((len(sets), LEAST), _PAD, dtype=np.uint64)
    for row, values in zip(rows, sets):
        row[: len(values)] = np.array(values, dtype=np.int64).view(np.uint64)
    return rows, np.array([len(x) for x in sets])


_PAD = np.uint64((1 << 64) - 1)


def similarity(one: np.ndarray, rows: np.ndarray, count: int, counts: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a shingle set to others by their least hashes: exact while both together have no more than ``LEAST``."""
    both = np.sort(np.concatenate([np.broadcast_to(one, rows.shape), rows], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    place = np.arange(twice.shape[1]) - (np.cumsum(twice, axis=1) - twice)  # among unlike values
    shared = (twice & (place < LEAST)).sum(axis=1)
    return shared / np.minimum(LEAST, count + counts - twice.sum(axis=1))


def _similar(group: pa.Table, least: float) -> pa.Table:
    """(a, b): a star over the texts of each bucket that links of the similarity connect; connected texts are not compared again."""
    group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    key, i, j, node = (group.column(c).to_numpy() for c in ("key", "i", "j", "fingerprint"))
    rows, counts = _table(group.column("least").to_pylist())
    new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(node)]]).tolist()
    left, right = [], []

    def partner(at: int, part: list[int]) -> int | None:
        # Texts that others were linked to stand in front: an original is met before its copies.
        for first, last in ((0, 4), (4, len(part))):
            some = part[first:last]
            if some:
                hits = np.flatnonzero(similarity(rows[at], rows[some], counts[at], counts[some]) >= least)
                if len(hits):
                    return first + int(hits[0])
        return None

    for lo, hi in zip(edges[:-1], edges[1:]):
        parts: list[list[int]] = []
        for at in range(lo, hi):
            hit, rest = [], []
            for part in parts:
                place = partner(at, part)
                if place is None:
                    rest.append(part)
                    continue
                other = part.pop(place)
                hit.append([other, *part])
            parts = [*rest, [*(o for part in hit for o in part), at]]
        for part in parts:  # as a star: what is linked is the same, and components come to rest sooner
            names = sorted(set(node[part].tolist()))
            left.extend(names[1:])
            right.extend(names[:1] * (len(names) - 1))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def similar_links(nodes: DataFrame, least: float, block: int = CANDIDATES) -> DataFrame:
    """(a, b): links that connect what texts of ``least`` similarity connect, from ``nodes`` (fingerprint, least, keys).

    Texts that share the key of a small fingerprint are candidates. Buckets are compared block against block.
    """
    rows = nodes.select("fingerprint", F.explode("keys").alias("key"))
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    bins = int((sizes.agg(F.sum("m")).first()[0] or 0) // (2 * block)) + 1
    dealt = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    pairs = dealt.select("fingerprint", "key", "blocks", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "fingerprint", "key", "blocks", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")
    )
    alone = (F.col("blocks") > 1).cast("bigint")
    pairs = pairs.withColumn("alone", alone).withColumn(
        "bin", F.when(F.col("alone") == 1, F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins)))
    )
    full = pairs.drop("blocks").join(nodes.select("fingerprint", "least"), "fingerprint")
    return full.groupBy("alone", "bin").applyInArrow(lambda g: _similar(g, least), "a bigint, b bigint").distinct()


def deduplicate(docs: DataFrame, words: int = 5, bits: int = 3, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the row of the least doc_id; among rows of equal doc_id the least row digest.

    Texts are linked if their fingerprints differ in ``bits`` or fewer, or their shingle sets have ``least``
    similarity: whole fingerprints of such sets mostly differ in more bits than Golay keys can bridge, so the second
    kind is sought by fingerprints of few shingles each. Texts without words are one group. Rows without a doc_id stay
    only where their group has none; of equal rows one stays.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("_digest", F.xxhash64(*names))
    plain = plain.withColumns({c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")})

    def compute(texts: list) -> dict:
        found = [sketch(t, words) for t in texts]
        return {"fingerprint": [f[0] for f in found], "least": [f[1] for f in found], "keys": [f[2] for f in found]}

    marked = map_texts(plain, ["doc_id", "_digest"], compute, "fingerprint bigint, least array<bigint>, keys array<bigint>")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_digest")
    nodes = stored(
        marked.groupBy("fingerprint").agg(F.min(row).alias("first"), F.min_by(F.struct("least", "keys"), row).alias("kept"))
        .select("fingerprint", "first", "kept.least", "kept.keys")
    )
    found = links(nodes.select("fingerprint"), bits).unionByName(similar_links(nodes, least))
    groups = components(found).withColumnRenamed("id", "fingerprint")
    placed = nodes.select("fingerprint", "first").join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    keep = placed.groupBy("component").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first._digest").alias("_first")
    )
    # Equal rows share id and digest; one of them is taken by an aggregate, not by a window over the group.
    kept = plain.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_first")), "left_semi")
    return kept.select(*names).dropDuplicates().toDF(*docs.columns)
