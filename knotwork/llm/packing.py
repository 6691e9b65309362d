"""Packing of tokenised documents into sequences of bounded length by a local search on bins.

Documents become token counts first; the search sees lengths only. Pieces as long as a sequence stand alone. All
others are dealt at random into blocks of bounded size; a block packs its pieces best fit, then exchanges pieces
between bins so that the sum of squared fills rises, until bins empty. Bins that are not full go on to a further round
with fewer blocks, until a round empties none.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from knotwork.llm.common import map_texts, stored

CAPACITY = 4096
END = 1
#: Pieces of a block of the search.
BLOCK = 8192
#: Entries of a worker's word cache; it starts afresh when full.
CACHE = 600_000


class Encoder:
    """Token ids of texts as little-endian 32-bit words, by a cache of words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in turn. A
    word is a run between spaces and line feeds; inside it, letters with punctuation around them are looked up apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        #: The model reads bytes as printable characters: those that are none get code points from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > CACHE or len(self.cores) > CACHE:
                cache, self.cores = {"": b""}, {}
                self.cache = cache
            out = []
            for w in words:
                ids = cache.get(w)
                if ids is None:
                    ids = self._word(w)
                    if len(w) <= 64:
                        cache[w] = ids
                out.append(ids)
            return b"".join(out)

    def _word(self, word: str) -> bytes:
        core = word.strip(".,;:!?*&%$#()[]\"|-")
        if not core.isalpha() or len(core) > 64 or "<" in word or "'" in word or not self._plain(core):
            return self._slow(word)
        if len(core) == len(word):
            return self._core(core)
        at = word.index(core)
        return self._run(word[:at]) + self._core(core) + self._run(word[at + len(core):])

    def _run(self, marks: str) -> bytes:
        ids = self.cores.get(marks)
        if ids is None:
            ids = self.cores[marks] = self._slow(marks)
        return ids

    @staticmethod
    def _plain(core: str) -> bool:
        """Whether the letters stay letters when they are normalised and lower-cased, so that marks beside them stay apart."""
        return core.isascii() or (max(core) < "ɐ" and "İ" not in core and unicodedata.is_normalized("NFC", core))

    def _core(self, core: str) -> bytes:
        low = core.lower()
        ids = self.cores.get(low)
        if ids is None:
            seen = low if low.isascii() else low.encode().decode("latin-1").translate(self.shown)
            ids = self.cores[low] = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
        return ids

    def _slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(texts: list, path: str, end: int, capacity: int) -> dict:
    encode, last, step = encoder(path).encode, int(end).to_bytes(4, "little"), 4 * capacity
    counts, sums = [], []
    for text in texts:
        ids = encode(text or "") + last
        counts.append(len(ids) // 4)
        sums.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
    return {"n_ids": counts, "sums": sums}


def pieces(docs: DataFrame, tokenizer: str, carry: list[str], end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the ``carry`` columns, piece, start, length and ids_crc32.

    Null and empty texts are one piece with the end id alone. Only documents of more than ``capacity`` ids are cut.
    """
    counted = map_texts(docs, carry, lambda texts: _cut(texts, tokenizer, end, capacity), "n_ids bigint, sums array<bigint>")
    cut = counted.select(*carry, "n_ids", F.posexplode("sums").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select(
        *carry, "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_ids") - start).cast("bigint").alias("length"), "ids_crc32"
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a bin has room for exactly r
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            home = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[home].append(item)
        else:
            home, room = len(bins), capacity
            bins.append([item])
        if left := room - size:
            with_room.setdefault(left, []).append(home)
            rooms |= 1 << left
    return bins


def improve(lengths: np.ndarray, home: np.ndarray, capacity: int) -> np.ndarray:
    """Bin numbers after the local search, from bin numbers ``home``.

    A step hands something of a bin to a bin that ends up fuller than the giver was: one item, one against a smaller
    one, or two against one. Each step raises the sum of squared fills, so the search ends; it stops at once when
    there are no more bins than the total needs.
    """
    home = home.copy()
    fill = np.bincount(home, weights=lengths).astype(np.int64)
    need = math.ceil(int(lengths.sum()) / capacity)
    used = int((fill > 0).sum())
    changed = True
    while changed and used > need:
        changed = False
        for giver in np.argsort(fill, kind="stable"):
            while 0 < fill[giver] < capacity and used > need:
                step = _step(lengths, home, fill, giver, capacity)
                if step is None:
                    break
                given, back, taker = step
                home[given] = taker
                moved = int(lengths[given].sum())
                if back >= 0:
                    home[back] = giver
                    moved -= int(lengths[back])
                fill[giver] -= moved
                fill[taker] += moved
                changed = True
                used -= int(fill[giver] == 0)
            if used <= need:
                break
    return home


def _step(lengths, home, fill, giver, capacity):
    """(items given, item taken back or -1, taker) of the step that moves most, None if there is none."""
    own = np.flatnonzero(home == giver)
    room = capacity - fill
    open_bins = np.flatnonzero((fill > 0) & (room > 0))
    open_bins = open_bins[open_bins != giver]
    if not len(open_bins):
        return None
    sizes = lengths[own]
    most = room[open_bins].max()
    for item in own[np.argsort(-sizes, kind="stable")]:
        size = lengths[item]
        if size > most:
            continue
        fits = open_bins[(room[open_bins] >= size) & (fill[open_bins] + size > fill[giver])]
        if len(fits):
            return np.array([item]), -1, fits[np.argmin(room[fits])]
    others = np.flatnonzero((room[home] > 0) & (home != giver))
    theirs, limit, floor = lengths[others], room[home[others]], fill[giver] - fill[home[others]]

    def swap(total):
        gain = total - theirs
        good = (gain > 0) & (gain <= limit) & (gain > floor)
        if not good.any():
            return None
        at = np.argmax(np.where(good, gain, -1))
        return int(gain[at]), int(others[at])

    best = None
    for size, at in zip(*np.unique(sizes, return_index=True)):
        if (found := swap(size)) and (best is None or found[0] > best[0]):
            best = (found[0], found[1], own[[at]])
    if best is None and len(own) > 1:
        for i, a in enumerate(own):
            for b in own[:i]:
                if (found := swap(lengths[a] + lengths[b])) and (best is None or found[0] > best[0]):
                    best = (found[0], found[1], np.array([a, b]))
    return None if best is None else (best[2], best[1], home[best[1]])


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    home = np.zeros(len(lengths), dtype=np.int64)
    for number, items in enumerate(best_fit(lengths.tolist(), capacity)):
        home[items] = number
    home = improve(lengths, home, capacity)
    order = np.argsort(home, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.concatenate([[True], home[order][1:] != home[order][:-1]])
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
    offset = np.empty_like(ends)
    offset[order] = ends - lengths[order] - base
    return home, offset


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``items`` (length from 1 to ``capacity``, any other columns) with sequence_id and offset, gapless from 0.

    An empty table gives an empty table. Rows may repeat; each is an item of its own.
    """
    numbered = stored(items.withColumn("_item", F.monotonically_increasing_id()))
    whole = numbered.filter(F.col("length") == capacity).select(
        *items.columns, (-F.col("_item") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    done, rest, bins, turn = whole, numbered.filter(F.col("length") < capacity), None, 0
    while True:
        n = rest.count()
        if n == 0:
            return done
        blocks = math.ceil(n / block)
        packed = stored(_round(rest, items.columns, capacity, blocks, turn))
        is_open = F.col("_fill") < capacity
        seen = packed.filter(is_open).agg(
            F.count_if(F.col("offset") == 0).alias("bins"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")
        ).first()
        if bins is not None and seen["bins"] + packed.filter(~is_open & (F.col("offset") == 0)).count() >= bins[0]:
            return done.unionByName(bins[1].select(done.columns))
        done = done.unionByName(packed.filter(~is_open).select(done.columns))
        left = packed.filter(is_open)
        if blocks == 1 or seen["bins"] <= math.ceil(seen["tokens"] / capacity):
            return done.unionByName(left.select(done.columns))
        bins, rest, turn = (seen["bins"], left), left.drop("sequence_id", "offset", "_fill", "_block"), turn + 1


def _round(rest: DataFrame, columns: list[str], capacity: int, blocks: int, turn: int) -> DataFrame:
    dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_item", F.lit(turn)), F.lit(blocks)).cast("bigint"))

    def search(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy().astype(np.int64)
        home, offset = pack_lengths(lengths, capacity)
        number = (turn << 56) + (group.column("_block")[0].as_py() << 24)
        fill = np.bincount(home, weights=lengths).astype(np.int64)[home]
        for name, values in (("sequence_id", home + number), ("offset", offset), ("_fill", fill)):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    schema = StructType([*dealt.schema, *(StructField(c, LongType()) for c in ("sequence_id", "offset", "_fill"))])
    return dealt.groupBy("_block").applyInArrow(search, schema)


def pack_documents(docs: DataFrame, tokenizer: str, carry: list[str] | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all ``docs`` with the sequence and the offset each has in it; ``carry`` defaults to doc_id."""
    return pack(pieces(docs, tokenizer, carry or ["doc_id"], end, capacity), capacity)
