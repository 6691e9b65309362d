"""Token ids of documents in files that are compressed by a grammar of pairs and read at any place.

Documents are range partitioned and sorted by doc_id. A task encodes its documents in order and closes a shard at
``SHARD`` ids. In a shard, pairs of neighbouring symbols that occur often are replaced by new symbols, again and again,
until no pair occurs ``LEAST`` times: the grammar has one rule per new symbol, and with it the number of ids that the
symbol stands for. No symbol reaches over the end of a document, so a document is a stretch of symbols.

Files. A folder of Parquet files with one row per shard: ``part`` and ``shard`` order the shards, ``n_ids`` counts the
ids, ``docs`` lists doc_id, ids and symbols of the documents in order, ``rules`` holds pairs of little-endian 32-bit
symbols, ``spans`` the number of ids of each rule, ``symbols`` the shard itself. Symbols below ``base`` are ids, symbol
``base + r`` is rule r. Spark's writer commits them, so that a task that is run again leaves no trace.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

SHARD, LEAST = 1 << 20, 16
END = 0
#: Bits of the hashes of pairs; their tables should fit a processor's cache.
SLOTS = 18
#: Entries of a worker's cache of pieces; a full one is kept until the next is full.
CACHE = 350_000
FILES = (
    "part int, shard int, base bigint, n_ids bigint, docs array<struct<doc_id: bigint, n_ids: bigint, n_symbols: bigint>>, "
    "rules binary, spans binary, symbols binary"
)
#: Fixed value: how the byte-level tokenizer cuts a text of plain letters, digits and marks before it merges bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"


class _Cache(dict):
    """What ``make`` gives for a text, kept. The cache before this one is asked first."""

    def __init__(self, make, before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before if before is not None else {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= 64:
            self[text] = ids
        return ids

    def bounded(self) -> _Cache:
        """This cache, or a new one after it where it is full; what came before this one goes."""
        if len(self) <= CACHE:
            return self
        self.before = {}
        return _Cache(self.make, self)


class Encoder:
    """The ids that the tokenizer gives to a whole text. Pieces are looked up, since most occur many times."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cut = re.compile(PIECES).findall
        #: Beyond plain letters, digits and marks the tokenizer works on the text itself.
        self.strange = re.compile(r"[^\x00-\x1b\x20-\u02af\u2010-\u2027\u20a0-\u20bf]|[_\x85\xb2\xb3\xb9\xbc-\xbe]").search
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: The model reads bytes as printable characters: those that are none get code points from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.pieces = _Cache(self._piece)

    def _piece(self, piece: str) -> bytes:
        seen = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.whole.model.tokenize(seen)])

    def encode(self, text: str) -> bytes:
        if self.strange(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.pieces = self.pieces.bounded()
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _select(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` to replace: those heavier than both neighbours, every second one of equal neighbours."""
    joined = np.zeros(len(at) + 1, bool)
    joined[1:-1] = at[1:] == at[:-1] + 1
    before, after = np.zeros_like(weight), np.zeros_like(weight)
    before[1:], after[:-1] = weight[:-1], weight[1:]
    before[~joined[:-1]] = 0
    after[~joined[1:]] = 0
    place = np.arange(len(at), dtype=np.int32)
    first = np.maximum.accumulate(np.where(weight != before, place, 0))
    return ((place - first) & 1 == 0) & (before <= weight) & (after <= weight)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int32)


def compress(symbols: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, rules, spans) after all pairs that occur ``least`` times or more have been replaced.

    ``ends`` are the ends of the documents in ``symbols``; no pair reaches over one. Where two frequent pairs overlap,
    the more frequent one goes first. Expanding the symbols gives the input back, whatever was replaced.
    """
    symbols, ends = symbols.astype(np.uint32), ends.astype(np.int64)
    rules, known = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    top = base
    live = np.ones(len(symbols), bool)
    while True:
        live[ends - 1] = False
        at = np.flatnonzero(live)
        keys = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        # A table of hashed counts drops most rare pairs before the exact count.
        slot = _slots(keys)
        often = (np.bincount(slot, minlength=1 << SLOTS) >= least)[slot]
        at, keys, slot = at[often], keys[often], slot[often]
        if not len(at):
            break
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edge, len(ordered)))
        pairs, counts = ordered[edge[counts >= least]], counts[counts >= least]
        if not len(pairs):
            break
        # Most pairs are alone in their slot; the others are searched for.
        held = np.zeros(1 << SLOTS, np.int32)
        held[_slots(pairs)] = np.arange(len(pairs), dtype=np.int32)
        number = held[slot]
        other = np.flatnonzero(pairs[number] != keys)
        number[other] = np.minimum(np.searchsorted(pairs, keys[other]), len(pairs) - 1)
        good = pairs[number] == keys
        at, number = at[good], number[good]
        # Heavier: more frequent, then the smaller pair; ranks from 1.
        rank = np.empty(len(pairs), np.int32)
        rank[np.lexsort((-np.arange(len(pairs)), counts))] = np.arange(1, len(pairs) + 1)
        chosen = _select(at, rank[number])
        # A rule needs half of its threshold in places; the heaviest pair always has them, so each round replaces some.
        used = np.bincount(number[chosen], minlength=len(pairs)) >= (least + 1) // 2
        chosen &= used[number]
        places, names = at[chosen], (np.cumsum(used) - 1 + top)[number[chosen]]
        made = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(made)
        known = np.append(known, widths(made, known, base).sum(axis=1))
        top += len(made)
        gone = places + 1
        live[:] = False
        live[at] = True
        live[places] = True
        live[np.maximum(places - 1, 0)] = True
        symbols[places] = names
        stay = np.ones(len(symbols), bool)
        stay[gone] = False
        symbols, live = symbols[stay], live[stay]
        ends = ends - np.searchsorted(gone, ends, side="left")
    return symbols, ends, np.concatenate(rules), known


def widths(symbols: np.ndarray, spans: np.ndarray, base: int) -> np.ndarray:
    """Number of ids of each symbol."""
    if not len(spans):
        return np.ones(symbols.shape, np.int64)
    return np.where(symbols < base, 1, spans[np.maximum(symbols.astype(np.int64) - base, 0)])


def expand(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for: those of each symbol are laid out once, then copied."""
    number = np.zeros(base + len(rules), np.int32)
    number[symbols] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used), dtype=np.int32)
    size = widths(used, spans, base)
    at = number[symbols]
    length = size[at]
    shift = (np.cumsum(size) - size)[at] - (np.cumsum(length) - length)
    return _laid_out(used, rules, spans, base)[np.repeat(shift, length) + np.arange(int(length.sum()))]


def _laid_out(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, base: int) -> np.ndarray:
    """The ids of one symbol after the other, pair by pair."""
    size = widths(symbols, spans, base)
    out = np.empty(int(size.sum()), np.uint32)
    place = np.cumsum(size) - size
    symbols = symbols.astype(np.int64)
    while len(symbols):
        plain = symbols < base
        out[place[plain]] = symbols[plain]
        symbols, place = symbols[~plain], place[~plain]
        if not len(symbols):
            break
        pair = rules[symbols - base].astype(np.int64)
        left = widths(pair[:, 0], spans, base)
        symbols, place = pair.ravel(), np.stack([place, place + left], axis=1).ravel()
    return out


class Shard:
    """A shard of the files, decoded where it is asked for."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.spans = np.frombuffer(row["spans"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4")
        self.docs = row["docs"]
        self.ends = np.cumsum(widths(self.symbols, self.spans, self.base))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        start, stop = max(start, 0), min(stop, int(self.ends[-1]) if len(self.ends) else 0)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, final = np.searchsorted(self.ends, [start, stop - 1], side="right")
        before = int(self.ends[first - 1]) if first else 0
        found = expand(self.symbols[first : final + 1], self.rules, self.spans, self.base)
        return found[start - before : stop - before]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end of each document)."""
        return expand(self.symbols, self.rules, self.spans, self.base), np.cumsum([d["n_ids"] for d in self.docs])


def _shard(part: int, number: int, base: int, ids: list, held: list[bytes], least: int) -> pa.RecordBatch:
    sizes = np.array([len(b) // 4 for b in held], np.int64)
    data = np.frombuffer(b"".join(held), "<u4")
    symbols, ends, rules, spans = compress(data, np.cumsum(sizes), base, least)
    counts = np.diff(np.concatenate([[0], ends]))
    docs = [{"doc_id": d, "n_ids": n, "n_symbols": s} for d, n, s in zip(ids, sizes.tolist(), counts.tolist())]
    row = [part, number, base, len(data), docs, rules.astype("<u4").tobytes(), spans.astype("<u4").tobytes(), symbols.astype("<u4").tobytes()]
    doc = pa.struct([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_symbols", pa.int64())])
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(doc), pa.binary(), pa.binary(), pa.binary()]
    names = ["part", "shard", "base", "n_ids", "docs", "rules", "spans", "symbols"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard: int = SHARD, least: int = LEAST) -> None:
    """The ids of all ``docs`` as shard files in the folder ``path``, in ascending doc_id order.

    Null texts are empty: a document of the end id alone. Rows without doc_id come first; rows of one doc_id are in the
    order of their texts' hashes, and rows that are equal are documents of their own. An empty table gives an empty
    folder. Other columns than doc_id and text are not read. A document longer than ``shard`` ids has a shard to itself.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, finish, part = encoder(tokenizer), int(end).to_bytes(4, "little"), TaskContext.get().partitionId()
        base = max(coder.whole.get_vocab_size(with_added_tokens=True), end + 1)
        ids, held, size, number = [], [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = coder.encode(text.as_py() or "") + finish
                if held and size + len(data) // 4 > shard:
                    yield _shard(part, number, base, ids, held, least)
                    ids, held, size, number = [], [], 0, number + 1
                ids.append(doc)
                held.append(data)
                size += len(data) // 4
        if held:
            yield _shard(part, number, base, ids, held, least)

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_order"))
    ordered = kept.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order")
    ordered.select("doc_id", "text").mapInArrow(scan, FILES).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts all ids before it."""
    files = spark.read.schema(FILES).parquet(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = Shard(row).documents()
                starts = np.concatenate([[0], ends[:-1]])
                data = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                n = len(sums)
                columns = [[row["part"]] * n, [row["shard"]] * n, [d["doc_id"] for d in row["docs"]], starts, ends - starts, sums]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = files.mapInArrow(scan, "part int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(shard_starts(files), ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def shard_starts(files: DataFrame) -> DataFrame:
    """(part, shard, first): the ids before each shard. One row per part meets in a task, not one per shard."""
    sizes = files.select("part", "shard", "n_ids")
    ahead = W.rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("_inside", inside).join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_inside")).alias("first"))
