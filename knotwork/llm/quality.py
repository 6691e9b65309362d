"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees over the statistics.

The trees are trained here, on the statistics of a bounded sample of labelled documents, and flattened into numpy
arrays, so that a batch of documents is scored by a few array steps per tree level. On chosen statistics the score may
only fall (or only rise) as the statistic grows; splits that would break this are refused and child values are kept
within the bounds that their ancestors set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from knotwork.llm.common import map_texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
#: Statistics the trees see, with the direction the score may take as each grows (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1,
    "digit_ratio": 0, "distinct_ratio": 0, "line_words": 0, "end_mark_ratio": 0, "comma_ratio": 0, "symbol_word_ratio": -1,
}
#: Labelled documents that the trees are fitted on at most, those of the least hash.
SAMPLE = 20_000
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list) -> int:
    """Words inside windows of five that occur twice or more, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == len(ids):
        return 0
    ids = np.array(ids, dtype=np.int64)
    n = len(ids) - WINDOW + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):  # equal windows have equal mixes; few texts go on from here
        mixed = (mixed ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    ranked = np.sort(mixed)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    pairs = _ranks(ids[:-1] * len(numbers) + ids[1:])
    fours = _ranks(pairs[:-2] * len(pairs) + pairs[2:])
    window = fours[:n] * len(numbers) + ids[WINDOW - 1 :]
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def measure(text: str | None) -> tuple[tuple, list[float]]:
    """The base counts and the tree statistics of a whole text; a null text counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    tally = np.bincount(np.frombuffer(data, np.uint8), minlength=256)  # ASCII characters are single bytes
    word_chars = len(text) - int(tally[_SPACES].sum())
    symbols = int(tally[_SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    some, chars = max(n, 1), max(word_chars, 1)
    features = [
        np.log1p(n), word_chars / some, symbols / chars, dup_lines / max(len(lines), 1), repeat / some,
        tally[65:91].sum() / chars, tally[48:58].sum() / chars, len(set(words)) / some, n / max(len(lines), 1),
        tally[_MARKS].sum() / some, tally[ord(",")] / some, min(1.0, symbols / some),
    ]
    return (n, word_chars, symbols, dup_lines, repeat), features


_SPACES, _SYMBOLS, _MARKS = (np.frombuffer(x.encode(), np.uint8) for x in (SPACES, SYMBOLS, ".!?"))


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth as node arrays (tree, node): children of node i are 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20,
        ridge: float = 1.0, directions: list[int] | None = None) -> Forest:
    """Boosted trees for labels 0 and 1 by second-order logistic loss on binned statistics."""
    directions = directions or list(FEATURES.values())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)])
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    inner = 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            found = _split(codes[rows], grad[rows], hess[rows], cuts, directions, low[at], high[at], least, ridge) if len(rows) else None
            left, right = 2 * at + 1, 2 * at + 2
            low[left] = low[right] = low[at]
            high[left] = high[right] = high[at]
            if found is None:  # all rows go left, to the same value
                node[rows] = left
                continue
            f, cut, middle = found
            feature[at], threshold[at] = f, cuts[f][cut]
            if directions[f] > 0:
                high[left], low[right] = min(high[left], middle), max(low[right], middle)
            elif directions[f] < 0:
                low[left], high[right] = max(low[left], middle), min(high[right], middle)
            node[rows] = np.where(codes[rows, f] > cut, right, left)
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = rate * np.clip(g / (h + ridge), low[inner:], high[inner:])
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))


def _split(codes, grad, hess, cuts, directions, low, high, least, ridge):
    """(feature, cut, middle of the child values) of the best allowed split, None if none gains."""
    g_all, h_all = grad.sum(), hess.sum()

    def loss(g, h):
        v = np.clip(g / (h + ridge), low, high)
        return v, g * v - 0.5 * (h + ridge) * v * v

    best, out = 1e-6 + loss(g_all, h_all)[1], None
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        size = len(cut) + 1
        g = np.cumsum(np.bincount(codes[:, f], grad, size))[:-1]
        h = np.cumsum(np.bincount(codes[:, f], hess, size))[:-1]
        n = np.cumsum(np.bincount(codes[:, f], minlength=size))[:-1]
        left, gain_left = loss(g, h)
        right, gain_right = loss(g_all - g, h_all - h)
        allowed = (n >= least) & (len(codes) - n >= least) & (directions[f] * (right - left) >= 0)
        gain = np.where(allowed, gain_left + gain_right, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, out = gain[at], (f, at, (left[at] + right[at]) / 2)
    return out


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns, the base counts, and ``features`` (doubles in the order of ``FEATURES``)."""

    def compute(texts: list) -> dict:
        found = [measure(t) for t in texts]
        names = [c.split()[0] for c in COUNTS.split(", ")]
        return {name: [f[0][i] for f in found] for i, name in enumerate(names)} | {"features": [f[1] for f in found]}

    return map_texts(docs, carry, compute, COUNTS + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Forest | None:
    """Trees fitted on at most ``sample`` labelled documents, those of the least hash of doc_id; None without two classes.

    The bound holds what is broadcast here (ids and labels) and what reaches the driver (a dozen numbers a document).
    A document with several labels counts with the least. Labels without a document, and null labels, are ignored.
    """
    one = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(marked, ["doc_id", "_y"]).select("doc_id", "_y", "features").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    y = np.array([r["_y"] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return None
    return fit(np.array([r["features"] for r in rows]), y, **options)


def judge(docs: DataFrame, forest: Forest | None, carry: list[str], least: float = 0.5) -> DataFrame:
    """The ``carry`` columns, base counts, ``score`` (probability of good quality), ``base_failed`` and ``kept``.

    Base rules: fewer than 10 words, or over a fifth of the words in repeated windows. Without a forest the score is 1.
    """
    bound = np.log(least / (1 - least))

    def compute(texts: list) -> dict:
        found = [measure(t) for t in texts]
        counts = np.array([f[0] for f in found], dtype=np.int64).reshape(-1, 5)
        x = np.array([f[1] for f in found], dtype=np.float64).reshape(len(found), -1)
        margin = forest.score(x) if forest is not None else np.full(len(found), np.inf)
        failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
        names = [c.split()[0] for c in COUNTS.split(", ")]
        return {n: counts[:, i] for i, n in enumerate(names)} | {
            "score": 1 / (1 + np.exp(-margin)), "base_failed": failed, "kept": ~failed & (margin >= bound)
        }

    return map_texts(docs, carry, compute, COUNTS + ", score double, base_failed boolean, kept boolean")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, score and verdict for every row of ``docs``, by trees trained on ``labels`` (doc_id, quality)."""
    return judge(docs, train(docs, labels), ["doc_id"])


def filtered(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = judge(plain, train(docs, labels), names).filter("kept").select(*names)
    return kept.toDF(*docs.columns)
