"""Removal of repeated sentence spans.

Every run of consecutive sentences is hashed (the fewest sentences from each start, and to each end, that are two at
least and hold twelve words). Hashes that occur more than once are found by one aggregate over all documents; the first occurrence,
by doc_id, text hash and place, stays, and the sentences of all others go.

Sentences of more than ``LONG`` words are cut into pieces that count as sentences. A piece begins at the least word, the
last of equal ones, of some window of ``WINDOW`` words, so equal stretches of text are cut at equal words and pieces are
no longer than the window. A passage of 50 words therefore holds a run wherever its sentences begin and end, and if it has no end mark.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from knotwork.llm.common import map_texts, removed, scratch, settled, stored

SENTENCES, WORDS = 2, 12
LONG, WINDOW = 16, 16
#: A break is a line end, or white space after an end mark; the mark leads the match, so that the search can skip to it.
_BREAK = re.compile(r"[.!?\n](?:(?<=\n)\s*|\s+)")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, and pieces of long ones, that are not blank; text between them is white space."""
    return [(start, end) for start, end, _ in _worded(text)]


def _worded(text: str) -> list[tuple[int, int, list[str]]]:
    """``sentences`` with their words."""
    found, at = [], 0
    for gap in _BREAK.finditer(text):
        stop = gap.start()
        _pieces(text, at, stop if text[stop] == "\n" else stop + 1, found)
        at = gap.end()
    _pieces(text, at, len(text), found)
    return found


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The sentence of ``text`` from ``start`` to ``end``, or its pieces."""
    found = []
    _pieces(text, start, end, found)
    return [(a, b) for a, b, _ in found]


def _pieces(text: str, start: int, end: int, found: list) -> None:
    words = text[start:end].split()
    if len(words) <= LONG:
        if words:
            found.append((start, end, words))
        return
    begins, least, low = [0], 0, words[0]
    for last, word in enumerate(words):
        if word <= low:
            least, low = last, word
        elif last - least == WINDOW:  # the least has left the window
            held = words[least + 1 : last + 1]
            low = min(held)
            least = last - held[::-1].index(low)
        elif last != WINDOW - 1:
            continue
        if last >= WINDOW - 1 and least > begins[-1]:
            begins.append(least)
    places = list(accumulate(map(len, words), initial=start))
    if text.startswith(" ".join(words), start):
        cuts = [places[b] + b for b in begins]
    else:
        at, cuts = start, []
        for number, word in enumerate(words):
            at = text.index(word, at)
            if len(cuts) < len(begins) and number == begins[len(cuts)]:
                cuts.append(at)
            at += len(word)
    for a, z, i, k in zip(cuts, cuts[1:], begins, begins[1:]):
        found.append((a, a + len(text[a:z].rstrip()), words[i:k]))
    found.append((cuts[-1], end, words[begins[-1] :]))


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """(64 and 32 bits of hash, first sentence, number of sentences) of every run; white space is read as one space."""
    plain = [words for _, _, words in _worded(text)]
    counts = [len(p) for p in plain]
    joined = [" ".join(p) for p in plain]
    found, end, words = set(), 0, 0
    for start in range(len(plain)):
        while end < len(plain) and (end - start < SENTENCES or words < WORDS):
            words += counts[end]
            end += 1
        if end - start < SENTENCES or words < WORDS:
            break
        found.add((start, end))
        words -= counts[start]
    start, words = len(plain), 0
    for end in range(len(plain), 0, -1):
        while start > 0 and (end - start < SENTENCES or words < WORDS):
            start -= 1
            words += counts[start]
        if end - start < SENTENCES or words < WORDS:
            break
        found.add((start, end))
        words -= counts[end - 1]
    out = []
    for start, end in sorted(found):
        both = xxhash.xxh3_128_intdigest("\n".join(joined[start:end]).encode("utf-8", "surrogatepass"))
        out.append((_signed(both >> 64, 64), _signed(both & (1 << 32) - 1, 32), start, end - start))
    return out


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> bits - 1 else x


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, cuts): for every document with non-first repeated runs, their (first sentence, number)."""
    digest = F.xxhash64("text").alias("digest")
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    found = stored(
        map_texts(
            docs.select(F.col("doc_id").cast("bigint"), digest, "text"), ["doc_id", "digest"], lambda texts: {"runs": [[dict(zip("hlan", r)) for r in runs(t or "")] for t in texts]},
            "runs array<struct<h: bigint, l: int, a: int, n: int>>",
        ),
        path,
    )
    each = found.select("doc_id", "digest", F.inline("runs"))
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest", "a")
    again = each.groupBy("h", "l").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = each.join(settled(again), ["h", "l"]).filter(place != F.col("first"))
    found = later.select("doc_id", "digest", "a", "n").distinct().groupBy("doc_id", "digest")
    cuts = settled(found.agg(F.collect_list(F.struct("a", "n")).alias("cuts")))
    removed(spark, path)
    return cuts


def _kept(text: str, cuts: list) -> tuple[str, int, int]:
    found = sentences(text)
    gone = set()
    for cut in cuts:
        gone.update(range(cut["a"], cut["a"] + cut["n"]))
    if not gone:
        return text, len(found), 0
    ends = [*(a for a, _ in found[1:]), len(text)]
    parts = [text[: found[0][0]], *(text[a:e] for i, ((a, _), e) in enumerate(zip(found, ends)) if i not in gone)]
    return "".join(parts).rstrip() if len(found) - 1 in gone else "".join(parts), len(found), len(gone)


def without_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id), n_sentences, n_removed and the text left, for every row of ``docs``.

    Rows that agree in doc_id and text are one document, and each keeps what that document keeps. Null texts become
    empty. Sentences repeated inside a document count like any others.
    """
    carry = carry or ["doc_id"]
    cuts = repeated(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "cuts")
    rows = docs.select(*carry, F.col("text").alias("_text"), F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64("text").alias("_hash"))
    joined = rows.join(cuts, (F.col("_hash") == F.col("_digest")) & F.col("_doc").eqNullSafe(F.col("_id")), "left").select(*carry, "_text", "cuts")
    out = StructType([*joined.schema[: len(carry)], StructField("n_sentences", LongType()), StructField("n_removed", LongType()), StructField("text", StringType())])

    def rebuild(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                left = [_kept(t or "", c or []) for t, c in zip(part.column("_text").to_pylist(), part.column("cuts").to_pylist())]
                made = [pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64()), pa.array([x[0] for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *made], names=[*carry, "n_sentences", "n_removed", "text"])

    return joined.mapInArrow(rebuild, out)
