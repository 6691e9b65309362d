"""Near duplicates among vectors by cross-polytope hashing.

A table hashes a vector by two rotations (random signs and a fast Hadamard transform, three times over); each gives
the axis nearest to the rotated vector, with its sign. The pair of axes is the bucket; further buckets take the
second nearest axis of either rotation (multiprobe). Vectors that share a bucket of some table are compared in double
precision. Equal vectors are one node. Buckets of any size are compared block against block, so a task holds two
blocks at most, and it returns counts and a spanning forest instead of pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from knotwork.llm.common import stored
from knotwork.llm.linking import components

#: Independent tables; at 0.9 cosine and 64 dimensions a table with its probes finds two thirds of the pairs.
TABLES = 6
PROBES = 4
#: Rows of a block of a large bucket, and rows that small buckets share a task's group with.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, in place; the width is a power of two."""
    width, step = x.shape[1], 1
    while step < width:
        y = x.reshape(len(x), width // (2 * step), 2, step)
        low = y[:, :, 0, :].copy()
        y[:, :, 0, :] += y[:, :, 1, :]
        y[:, :, 1, :] = low - y[:, :, 1, :]
        step *= 2
    return x


@lru_cache(maxsize=4)
def _signs(width: int, tables: int) -> np.ndarray:
    return np.random.RandomState(20_011).choice([-1.0, 1.0], size=(tables, 2, 3, width))


def buckets(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(row, table * PROBES): bucket numbers of unit vectors, the plain one of each table first."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    rows = np.arange(len(unit))
    out = np.empty((len(unit), tables, PROBES), dtype=np.int64)
    for table, turns in enumerate(_signs(width, tables)):
        axes = []
        for signs in turns:
            x = padded
            for s in signs:
                x = hadamard(x * s)
            size = np.abs(x)
            two = np.argpartition(size, width - 2, axis=1)[:, -2:]
            swap = size[rows, two[:, 0]] > size[rows, two[:, 1]]
            two[swap] = two[swap][:, ::-1]  # the second nearest axis, then the nearest
            code = 2 * two + (x[rows[:, None], two] < 0)
            axes.append(code[:, ::-1])
        (a, a2), (b, b2) = axes[0].T, axes[1].T
        for probe, (p, q) in enumerate(((a, b), (a2, b), (a, b2), (a2, b2))):
            out[:, table, probe] = (p * 2 * width + q) * tables + table
    return out.reshape(len(unit), -1)


def usable(embedding: str = "embedding"):
    """Vectors without null or non-finite components that are not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(embedding)
    return v.isNotNull() & F.coalesce(F.forall(v, fine), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _hashed(nodes: DataFrame, tables: int) -> DataFrame:
    """(node, n, embedding, keys) of distinct vectors."""
    out = StructType([*nodes.schema, StructField("keys", ArrayType(LongType()))])

    def scan(batches):
        for batch in batches:
            x = batch.column("embedding")
            widths = np.diff(x.offsets.to_numpy())
            keys = np.empty((batch.num_rows, tables * PROBES), dtype=np.int64)
            flat, starts = x.values.to_numpy(zero_copy_only=False).astype(np.float64), x.offsets.to_numpy()
            for width in np.unique(widths):  # vectors of unlike length never meet
                rows = np.flatnonzero(widths == width)
                unit = flat[starts[rows][:, None] + np.arange(width)]
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                keys[rows] = buckets(unit, tables) * 100_003 + width
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "keys"])

    return nodes.mapInArrow(scan, out)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, starts) of a list column."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    return one.values.to_numpy(zero_copy_only=False), one.offsets.to_numpy()


def _compare(group: pa.Table, least: float) -> pa.Table:
    """Counts and a forest of the verified pairs of some buckets; a pair counts in the bucket of its least common key."""
    group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    node, n, side, key, i, j = (group.column(c).to_numpy() for c in ("node", "n", "side", "key", "i", "j"))
    flat, starts = _lists(group.column("embedding"))
    hashes, at = _lists(group.column("keys"))
    hashes = hashes[at[0] : at[-1]].reshape(len(node), -1)
    new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(node)]])
    found = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo < 2:
            continue
        x = flat[starts[lo] : starts[hi]].reshape(hi - lo, -1)  # a bucket holds vectors of one length
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left = np.flatnonzero(side[lo:hi] == i[lo])
        right = left if i[lo] == j[lo] else np.flatnonzero(side[lo:hi] == j[lo])
        p, q = np.nonzero(x[left] @ x[right].T >= least)
        p, q = left[p] + lo, right[q] + lo
        if i[lo] == j[lo]:
            p, q = p[p < q], q[p < q]
        for s in range(0, len(p), 50_000):  # the least key that both have must be this bucket's
            hp, hq = hashes[p[s : s + 50_000]], hashes[q[s : s + 50_000]]
            low = np.full(len(hp), np.iinfo(np.int64).max)
            for column in hq.T:
                low = np.where((hp == column[:, None]).any(axis=1), np.minimum(low, column), low)
            own = low == key[lo]
            if own.any():
                found.append((p[s : s + 50_000][own], q[s : s + 50_000][own]))
    if not found:
        return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "other")})
    p, q = (np.concatenate(side) for side in zip(*found))
    ids, back = np.unique(node, return_inverse=True)
    links = np.bincount(back[p], n[q], len(ids)) + np.bincount(back[q], n[p], len(ids))
    tree = _forest(len(ids), back[p].tolist(), back[q].tolist())
    some = np.flatnonzero(links)
    return pa.table({
        "node": pa.array(np.concatenate([ids[some], ids[tree[:, 0]]]), pa.int64()),
        "links": pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(tree), np.int64)]), pa.int64()),
        "other": pa.array([None] * len(some) + ids[tree[:, 1]].tolist(), pa.int64()),
    })


def _forest(size: int, left: list, right: list) -> np.ndarray:
    """The pairs that join what earlier ones did not."""
    parent = list(range(size))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for u, v in zip(left, right):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((u, v))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def near_duplicates(vectors: DataFrame, least: float = 0.9, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows linked directly, copies included. Vectors that are null, zero or have null or
    non-finite components are alone. A row without a vec_id links like others and never names a component.
    """
    rows = stored(vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), usable().alias("_ok")))
    lone = rows.filter(~F.col("_ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    # Zeroes of either sign are equal, as doubles; the row's text of numbers is not needed, the array itself is the key.
    good = rows.filter("_ok").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    nodes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    hashed = stored(_hashed(nodes.select("node", "n", "embedding"), tables))
    rows_of = hashed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = stored(rows_of.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    bins = int((sizes.agg(F.sum("m")).first()[0] or 0) // (4 * block)) + 1
    dealt = rows_of.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    pairs = dealt.select("node", "key", "side", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")).select(
        "node", "key", "side", "blocks", F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j")
    )
    # Small buckets share a group of bounded size; each pair of blocks of a large bucket is a group of its own.
    alone = (F.col("blocks") > 1).cast("bigint")
    pairs = pairs.withColumn("bin", F.when(alone == 1, F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins))))
    full = pairs.withColumn("alone", alone).drop("blocks").join(hashed, "node")
    found = stored(full.groupBy("alone", "bin").applyInArrow(lambda g: _compare(g, least), "node bigint, links bigint, other bigint"))
    groups = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    placed = stored(
        nodes.select("node", "first", "n").join(groups, "node", "left").join(counts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least_id = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least_id, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    told = good.join(nodes.join(named, "node").select("embedding", "n_links", "component_id"), "embedding")
    whole = told.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id").unionByName(lone)
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
