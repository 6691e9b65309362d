"""Exact nearest neighbours without a pair table.

Vectors are sorted by distance to a pivot and cut into chunks of bounded size. Chunk pairs whose
distance bounds rule out a hit are dropped (triangle inequality over a few pivots); the pairs
left meet in bounded stretches of chunks, each pair as one matrix product inside a task that
returns at most k rows per vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from knotwork.functions.vectors import norm
from knotwork.operators.loop import cut, cut_counting
from knotwork.operators.ranking import number_rows, top_k

#: Vectors of a chunk at most and at least, and the chunks that a table has unless they would be larger or smaller.
CHUNK, SMALLEST, CHUNKS = 4096, 32, 64
PIVOTS = 16
ROWS_AT_ONCE = 64
#: Chunks of either side that meet in one task at most, and the stretches of chunks that a table has unless they would be longer.
STRETCH, STRETCHES = 16, 8


def _chunks(rows: DataFrame, pivots: DataFrame, chunk: int) -> DataFrame:
    """(space, chunk, ids, matrix, n, lo, hi): packed vectors and their distance range to each pivot."""
    first = pivots.select("space", F.col("pivots")[0].alias("_p"))
    gap = F.zip_with("vec", "_p", lambda a, b: (a - b) * (a - b))
    placed = rows.join(first, "space").withColumn("_d", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x))).drop("_p")
    numbered = number_rows(placed, ["space"], ["_d", "id"], "_n", start=0)
    packed = numbered.groupBy("space", F.floor(F.col("_n") / chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("m")
    ).join(pivots, "space")
    flat = packed.select(
        "space", "chunk", F.col("m.id").alias("ids"), F.flatten("m.vec").alias("flat"),
        F.flatten("pivots").alias("pivots"), F.size("pivots").alias("p"),
    )

    def pack(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n = len(r.ids)
                m = np.asarray(r.flat, dtype="float64").reshape(n, -1)
                p = np.asarray(r.pivots, dtype="float64").reshape(r.p, -1)
                d = np.stack([np.sqrt(((m - q) ** 2).sum(1)) for q in p], axis=1)
                out.append((r.space, r.chunk, list(r.ids), m.tobytes(), n, list(d.min(0) - 1e-6), list(d.max(0) + 1e-6)))
            yield pd.DataFrame(out, columns=["space", "chunk", "ids", "matrix", "n", "lo", "hi"])

    schema = "space string, chunk bigint, ids array<string>, matrix binary, n bigint, lo array<double>, hi array<double>"
    return cut(flat.mapInPandas(pack, schema))


def _best(a: np.ndarray, b: np.ndarray, k: int):
    """Row, column and distance of the k nearest columns of each row; near ties are measured exactly."""
    b2 = (b * b).sum(1)
    # What the expanded square may be off by: long vectors that lie close to each other cancel out.
    slip = 8 * np.finfo("float64").eps * (a.shape[1] + 4)
    for start in range(0, len(a), ROWS_AT_ONCE):
        part = a[start:start + ROWS_AT_ONCE]
        a2 = (part * part).sum(1)[:, None]
        d2 = a2 + b2[None, :] - 2 * part @ b.T
        if d2.shape[1] > k:
            limit = np.partition(d2, k - 1, axis=1)[:, k - 1:k]
            keep = d2 <= limit + 1e-9 * (1.0 + np.abs(limit)) + slip * (a2 + b2.max())
        else:
            keep = np.ones_like(d2, dtype=bool)
        i, j = np.nonzero(keep)
        diff = part[i] - b[j]
        dist = np.round(np.sqrt((diff * diff).sum(1)), 9)
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        yield i[top] + start, j[top], dist[top]


def nearest(left: DataFrame, right: DataFrame, k: int, farthest: float | None = None, same: bool = False, chunk: int | None = None) -> DataFrame:
    """(left_id, right_id, distance, rank): the k nearest rights of each left in the same space.

    Inputs have id, space and vec (array<double>); distance is Euclidean and rounded to 9 digits,
    ties go to the smaller id. ``farthest`` drops larger distances; ``same`` leaves out equal ids.
    """
    left = left.select("id", "space", "vec")
    right, seen = cut_counting(right.select("id", "space", "vec"), n=F.count("*"))
    chunk = chunk or min(CHUNK, max(SMALLEST, math.ceil(seen["n"] / CHUNKS)))
    chosen = top_k(right.withColumn("_h", F.xxhash64("id")), ["space"], [F.asc("_h"), F.asc("id")], PIVOTS, "_r")
    pivots = cut(chosen.groupBy("space").agg(F.collect_list("vec").alias("pivots")))
    b = _chunks(right, pivots, chunk)
    a = b if same else _chunks(left, pivots, chunk)
    need = k + 1 if same else k
    la = a.select("space", F.col("chunk").alias("ca"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    lb = b.select("space", F.col("chunk").alias("cb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), "n")
    gap = F.zip_with("alo", "bhi", lambda x, y: x - y)
    gap2 = F.zip_with("blo", "ahi", lambda x, y: x - y)
    # Bounds of all chunks of a space meet; runs of them by salt, so that no key gathers more than a few thousand pairs' worth.
    salts = max(1, math.ceil(seen["n"] / chunk / 256))
    la = la.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lb = lb.withColumn("_salt", F.pmod(F.xxhash64("cb"), F.lit(salts)).cast("int"))
    bounds = la.join(lb, ["space", "_salt"]).select(
        "space", "ca", "cb", "n", F.greatest(F.array_max(gap), F.array_max(gap2), F.lit(0.0)).alias("least"),
        F.array_min(F.zip_with("ahi", "bhi", lambda x, y: x + y)).alias("most"),
    )
    reach = bounds.groupBy("space", "ca").agg(F.min(F.when(F.col("n") >= need, F.col("most"))).alias("reach"))
    kept = bounds.join(reach, ["space", "ca"]).filter(F.col("reach").isNull() | (F.col("least") <= F.col("reach")))
    if farthest is not None:
        kept = kept.filter(F.col("least") <= farthest)
    # A stretch of chunks meets a stretch in one task: a chunk is sent once for each stretch it meets, not for each chunk.
    stretch = min(STRETCH, max(1, math.ceil(seen["n"] / chunk / STRETCHES)))
    kept = cut(kept.select("space", "ca", "cb", F.floor(F.col("ca") / stretch).alias("sa"), F.floor(F.col("cb") / stretch).alias("sb")))
    asks = kept.groupBy("space", "sa", "sb", "ca").agg(F.array_sort(F.collect_set("cb")).alias("cbs")).join(
        a.select("space", F.col("chunk").alias("ca"), "ids", "matrix"), ["space", "ca"]
    )
    offers = kept.select(*[F.col(c).alias(c) for c in ("space", "sa", "sb", "cb")]).distinct().join(
        b.select("space", F.col("chunk").alias("cb"), F.col("ids").alias("bids"), F.col("matrix").alias("bm")), ["space", "cb"]
    )

    def match(asked, offered):
        held = {r.cb: (np.asarray(r.bids, dtype=object), np.frombuffer(r.bm).reshape(len(r.bids), -1)) for r in offered.itertuples(index=False)}
        found = []
        for r in asked.itertuples(index=False):
            aids, am, parts = np.asarray(r.ids, dtype=object), np.frombuffer(r.matrix).reshape(len(r.ids), -1), []
            for cb in r.cbs:
                bids, bm = held[cb]
                for i, j, dist in _best(am, bm, need):
                    part = pd.DataFrame({"left_id": aids[i], "right_id": bids[j], "distance": dist})
                    parts.append(part[part.distance <= farthest] if farthest is not None else part)
            near = pd.concat(parts)
            if same:
                near = near[near.left_id != near.right_id]
            found.append(near.sort_values(["left_id", "distance", "right_id"]).groupby("left_id", sort=False).head(k))
        return pd.concat(found)

    schema, keys = "left_id string, right_id string, distance double", ["space", "sa", "sb"]
    other = offers.withColumnsRenamed({c: f"_{c}" for c in keys}).groupBy(*[f"_{c}" for c in keys])
    found = asks.groupBy(*keys).cogroup(other).applyInPandas(match, schema)
    return top_k(found, ["left_id"], [F.asc("distance"), F.asc("right_id")], k)


def unit(rows: DataFrame, vector: str) -> DataFrame:
    """(id, space, vec) with vectors of length one; zero vectors have no direction and are left out."""
    length = norm(F.col(vector))
    return rows.withColumn("_l", length).filter(F.col("_l") > 0).select(
        "id", "space", F.transform(vector, lambda x: x.cast("double") / F.col("_l")).alias("vec")
    )


def cosine_of(distance):
    """Cosine of unit vectors from their distance."""
    return F.lit(1.0) - distance * distance / F.lit(2.0)


def by_features(nodes: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """1-NN typing by Euclidean distance over shared feature keys, confidence 1 / (1 + distance).

    Nodes are grouped by their set of keys. Every pair of key sets with a common key is one space,
    so vectors in a space have equal length. Nodes with no labelled node in reach are unknown at 0.
    """
    keyed = cut(features.select(F.col("node_id").alias("id"), "features", F.array_sort(F.map_keys("features")).alias("keys")))
    own = labels.select("id", "label")
    known = keyed.join(own.select("id"), "id", "left_semi")
    asked = keyed.join(own.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    sets_a = asked.select(F.col("keys").alias("ka")).distinct()
    sets_b = known.select(F.col("keys").alias("kb")).distinct()
    spaces = (
        sets_a.select("ka", F.explode("ka").alias("key")).join(sets_b.select("kb", F.explode("kb").alias("key")), "key")
        .select("ka", "kb").distinct()
        .withColumn("shared", F.array_sort(F.array_intersect("ka", "kb")))
        .withColumn("space", F.concat_ws("|", F.to_json("ka"), F.to_json("kb")))
    )
    spaces = cut(spaces)

    def place(rows, side):
        values = F.transform("shared", lambda key: F.element_at("features", key))
        return rows.join(spaces, rows["keys"] == spaces[side]).select("id", "space", values.alias("vec"))

    hits = nearest(place(asked, "ka"), place(known, "kb"), 1)
    best = hits.groupBy(F.col("left_id").alias("id")).agg(
        F.min_by(F.struct("right_id", "distance"), F.struct("distance", "right_id")).alias("h")
    )
    found = best.select("id", F.col("h.right_id").alias("near"), F.col("h.distance").alias("distance")).join(
        own.select(F.col("id").alias("near"), F.col("label").alias("found")), "near"
    )
    return nodes.select("id").join(own, "id", "left").join(found, "id", "left").select(
        "id", F.coalesce("label", "found", F.lit("unknown")).alias("predicted_type"),
        F.when(F.col("label").isNotNull(), 1.0).when(F.col("found").isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).otherwise(0.0).alias("confidence"),
    )
