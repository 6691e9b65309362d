"""Periodic runs of words: stretches that repeat with a period, found block by block.

A run of period q is at least 4q words long. For a scale B with B <= q < 2B it therefore holds two neighbouring blocks
of B words, each of which occurs again q words later. At every dyadic scale the sums of squared differences between a
block and all stretches of the window that follows it come from a convolution: a number-theoretic transform over a
prime field, so without rounding. A sum of zero is an occurrence; distances at which two neighbouring blocks occur are
extended to both sides, word by word, and become runs if they are long enough and no shorter period explains them.

Blocks that cannot lie in a run at their scale are not transformed: those with a word that does not come again within
2B words, and those whose window lies in a run of a shorter period. A zero sum modulo the prime that is none is
discovered by the extension, which compares words.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from knotwork.llm.common import map_texts

SHORTEST, TIMES = 6, 4
#: A prime whose multiplicative group has a subgroup of order 2**27, and a generator.
PRIME, ROOT, ORDER = 15 * (1 << 27) + 1, 31, 27
#: Field elements that one step of a transform works on, and words that are searched together.
STEP, WORDS = 1 << 20, 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order ``2 * size``."""
    root = pow(ROOT, (PRIME - 1) // (2 * size), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(1, np.uint64)
    while len(powers) < size:
        powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % np.uint64(PRIME)])
    return powers[:size, None]


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of each column of ``a``, in bit-reversed order; the number of rows is a power of two."""
    n, p = len(a), np.uint64(PRIME)
    half = n // 2
    while half:
        a = a.reshape(-1, 2, half, a.shape[-1])
        low, high = a[:, 0], a[:, 1]
        a = np.stack([(low + high) % p, (low + p - high) * _roots(half, False) % p], axis=1).reshape(n, -1)
        half //= 2
    return a


def restore(a: np.ndarray) -> np.ndarray:
    """Columns whose transforms are the columns of ``a``."""
    n, p = len(a), np.uint64(PRIME)
    half = 1
    while half < n:
        a = a.reshape(-1, 2, half, a.shape[-1])
        low, high = a[:, 0], a[:, 1] * _roots(half, True) % p
        a = np.stack([(low + high) % p, (low + p - high) % p], axis=1).reshape(n, -1)
        half *= 2
    return a * np.uint64(pow(n, -1, PRIME)) % p


def occurrences(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) wherever the block of ``size`` words from a start occurs ``size`` to ``2 * size - 1`` words later.

    By the sum of squared differences modulo the prime, so that a distance may come that is none, but none is missed.
    """
    if 2 * size > 1 << ORDER:
        raise ValueError(f"texts of more than {1 << ORDER + 1} words are not searched")
    found, at = [np.zeros((0, 2), np.int64)], max(1, STEP // (2 * size))
    padded, p = np.concatenate([words, np.full(3 * size, words.max(initial=0) + 1)]).astype(np.uint64), np.uint64(PRIME)
    inner = np.arange(2 * size)[:, None]
    for i in range(0, len(starts), at):
        first = starts[i : i + at]
        block = padded[first + inner[:size]] % p
        window = padded[first + size + inner] % p
        window[-1] = 0  # the last word of the window belongs to no stretch
        # Reversing the block but for its first place turns the product of transforms into a correlation.
        turned = np.zeros_like(window)
        turned[0], turned[size + 1 :] = block[0], block[:0:-1]
        product = restore(transform(turned) * transform(window) % p)[:size]
        squares = np.concatenate([np.zeros((1, len(first)), np.uint64), np.cumsum(window * window % p, axis=0)]) % p
        sums = squares[size : 2 * size] + p - squares[:size] + np.sum(block * block % p, axis=0) % p
        distance, column = np.nonzero(sums % p == (product + product) % p)
        found.append(np.stack([first[column], distance + size], axis=1))
    return tuple(np.concatenate(found).T)


def _agree(words: np.ndarray, a: int, b: int, step: int) -> int:
    """Number of words from ``a`` and ``b`` on (``step`` 1) or back (``step`` -1) that agree."""
    total, size = 0, 64
    while True:
        left = words[a : a + size] if step > 0 else words[max(a - size + 1, 0) : a + 1][::-1]
        right = words[b : b + size] if step > 0 else words[max(b - size + 1, 0) : b + 1][::-1]
        n = min(len(left), len(right))
        differ = np.flatnonzero(left[:n] != right[:n])
        if len(differ):
            return total + int(differ[0])
        total += n
        if n < size:
            return total
        a, b, size = a + step * n, b + step * n, 2 * size


def _divisors(q: int) -> list[int]:
    """q divided by each of its prime factors."""
    found, rest, f = [], q, 2
    while f * f <= rest:
        if rest % f == 0:
            found.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return [*found, q // rest] if rest > 1 else found


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the numbers ``words``, by start and period."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    gap = np.full(n, n, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found, size = [], 1
    reach = np.zeros(n + 1, np.int64)  # the farthest end of a run that starts here or before
    while 3 * size <= n:
        blocks = len(gap)
        alive = gap < 2 * size
        alive[:-1] &= alive[1:] | np.concatenate([[False], alive[:-2]])
        alive[-1:] &= alive[-2:-1] if blocks > 1 else False
        starts = np.flatnonzero(alive) * size
        starts = starts[reach[starts] < starts + 3 * size]
        if len(starts):
            start, distance = occurrences(words, starts, size)
            found += _extended(words, start, distance, size, reach)
            for a, length, _ in found:
                reach[a] = max(reach[a], a + length)
            np.maximum.accumulate(reach, out=reach)
        whole = blocks // 2 * 2
        gap = np.concatenate([gap[:whole].reshape(-1, 2).max(axis=1), gap[whole:]])
        size *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def _extended(words: np.ndarray, start: np.ndarray, distance: np.ndarray, size: int, reach: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs among the distances of one scale. What lies in a run of a shorter period has that period."""
    fresh = reach[start] < start + distance + size
    order = np.lexsort((start[fresh], distance[fresh]))
    start, distance = start[fresh][order], distance[fresh][order]
    out, done, last = [], -1, -1
    for a, q in zip(start.tolist(), distance.tolist()):
        if q != last:
            done, last = -1, q
        if a < done:
            continue
        right = _agree(words, a, a + q, 1)
        done = a + right
        if right < size:
            continue
        first = a - _agree(words, a - 1, a + q - 1, -1) if a else 0
        length = done + q - first
        if length < max(SHORTEST, TIMES * q):
            continue
        if any(np.array_equal(words[first : first + q], words[first + d : first + d + q]) for d in _divisors(q)):
            continue
        out.append((first, length, q))
    return out


def collapse(parts: list, found: list[tuple[int, int, int]]) -> list:
    """``parts`` without what any run repeats after its first period."""
    if not found:
        return parts
    keep = np.ones(len(parts), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [parts[i] for i in np.flatnonzero(keep)]


def _search(texts: list) -> dict:
    out = {"n_words": [], "runs": [], "collapsed": []}
    held, size = [], 0
    for text in texts:
        # Bytes split at exactly the white space of the word definition.
        parts = (text or "").encode("utf-8", "surrogatepass").split()
        if held and size + len(parts) > WORDS:
            _search_together(held, out)
            held, size = [], 0
        held.append(parts)
        size += len(parts) + 1
    _search_together(held, out)
    return out


def _search_together(held: list[list[bytes]], out: dict) -> None:
    """Runs of several texts in one search: a number of its own after each text lets no run pass."""
    number: dict = defaultdict(count().__next__)
    total = sum(map(len, held)) + len(held)
    words, at, bounds = np.empty(total, np.int64), 0, []
    for parts in held:
        words[at : at + len(parts)] = [number[w] for w in parts]
        bounds.append(at)
        at += len(parts) + 1
    ends = np.array([b + len(p) for b, p in zip(bounds, held)], np.int64)
    words[ends] = len(number) + np.arange(len(held))
    each: list[list] = [[] for _ in held]
    for start, length, period in runs(words):
        each[int(np.searchsorted(ends, start))].append((start, length, period))
    for parts, base, own in zip(held, bounds, each):
        own = [(s - base, n, q) for s, n, q in own]
        out["n_words"].append(len(parts))
        out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in own])
        out["collapsed"].append(b" ".join(collapse(parts, own)).decode("utf-8", "surrogatepass"))


def find(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns of every row of ``docs``, n_words, its ``runs`` by start and period, and ``collapsed``.

    A run is a stretch of at least six words and four times its smallest period that no neighbouring word extends.
    ``collapsed`` is the text's words without what a run repeats after its first period, joined by single spaces. Null,
    empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows are rows of their own. Texts
    of any length up to 2**28 words are searched whole; an empty table gives an empty table.
    """
    return map_texts(docs, carry, _search, f"n_words bigint, runs {RUNS}, collapsed string", text)


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the collapsed text in place of ``text``."""
    names = [c for c in docs.columns if c != text]
    done = map_texts(docs, names, lambda texts: {"collapsed": _search(texts)["collapsed"]}, "collapsed string", text)
    return done.toDF(*names, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a tail that repeats, for one in ten documents by the checksum of their id; the others as they are.

    From word a on, word i becomes word a + (i - a) % p. Rows without doc_id stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        again = F.flatten(F.array_repeat(F.slice(w, a.cast("int") + 1, p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), F.lit(1), n), " "))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    return F.when((h % 10 == 0) & text.isNotNull(), F.element_at(F.transform(F.array(words), tail), 1)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run, and checksums of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("m"), F.array_join(lines, "").alias("l"), "collapsed")
    length, period = F.col("m.length"), -F.col("m.p")
    return rows.select(
        "doc_id", "n_runs", (-F.col("m.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * m.length) div (-m.p)").alias("exponent_milli"),
        F.sha2(F.col("l").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
