"""Periodic runs, grammar files and hard negatives against brute-force versions, and on nulls, empties, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import grammar, negatives, periods
from knotwork.llm.common import scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    made += [None, "", " \n\t ", "one", "x " * 5000, "a b c " * 700 + "d", "é è " * 9, "Wörter, mit_Strich 12 ½  x²\n\n'll 'S\x1c<|endoftext|> \U0001f600", "y" * 40000]
    return list(enumerate(made)) + [(3, made[3]), (3, made[3]), (None, made[5])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA).repartition(3)


def slow_runs(x):
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            part, i = x[i : j + q], j
            if len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((j + q - len(part), len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_transform_is_a_cyclic_correlation():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, periods.PRIME, (16, 3)).astype(np.uint64) for _ in range(2))
    got = periods.restore(periods.transform(a) * periods.transform(b) % np.uint64(periods.PRIME))
    for c in range(3):
        want = [sum(int(a[i, c]) * int(b[(k - i) % 16, c]) for i in range(16)) % periods.PRIME for k in range(16)]
        assert got[:, c].tolist() == want


def test_occurrences_come_from_the_transform():
    rng = random.Random(2)
    words = np.array([rng.randrange(2) for _ in range(300)])
    for size in (1, 2, 4, 8, 16):
        starts = np.arange(0, 300 - size, size)
        got = {tuple(x) for x in zip(*(v.tolist() for v in periods.occurrences(words, starts, size)))}
        want = {
            (s, d) for s in starts.tolist() for d in range(size, 2 * size)
            if s + d + size <= 300 and (words[s : s + size] == words[s + d : s + d + size]).all()
        }
        assert got == want


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        x, a = [], rng.choice([1, 2, 2, 3, 6])
        while len(x) < rng.randrange(1, 110):
            x += [rng.randrange(a) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
        assert periods.runs(np.array(x, np.int64)) == slow_runs(x)
    assert periods.runs(np.zeros(0, np.int64)) == [] and periods.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert periods.runs(np.arange(100_000) % 20_011) == [(0, 100_000, 20_011)]


def test_run_tables(spark, docs, texts):
    found = periods.find(docs.withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1)), ["doc_id"]).collect()
    assert len(found) == len(texts)
    by_id = {r["doc_id"]: r for r in found}
    for i, text in texts:
        parts = (text or "").encode().split()
        want = slow_runs(parts) if len(parts) < 400 else None
        got = [(r["start"], r["length"], r["period"]) for r in by_id[i]["runs"]]
        assert by_id[i]["n_words"] == len(parts) and (want is None or got == want)
    assert [tuple(r) for r in by_id[64]["runs"]] == [(0, 5000, 1)] and by_id[64]["collapsed"] == "x"
    assert [tuple(r) for r in by_id[65]["runs"]] == [(0, 2100, 3)] and by_id[65]["collapsed"] == "a b c d"
    assert by_id[60]["collapsed"] == "" and by_id[62]["runs"] == []
    none = spark.createDataFrame([], SCHEMA)
    assert periods.find(none, ["doc_id"]).count() == 0 and periods.collapsed(docs).columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in periods.collapsed(docs).collect()}[65] == "a b c d"


def test_run_digests(docs, texts):
    made = docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    got = {r["doc_id"]: r for r in periods.digests(periods.find(made, ["doc_id"])).collect()}
    changed = 0
    for i, text in texts:
        parts = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(parts)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p, changed = 1 + (n - a) // (3 + g % 8), changed + 1
            parts = [parts[j] if j < a else parts[a + (j - a) % p] for j in range(n)]
        if n > 400:
            continue
        runs = slow_runs(parts)
        keep = [True] * n
        for s, length, q in runs:
            keep[s + q : s + length] = [False] * (length - q)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = got[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (top or (None, None, None))
        assert row["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for w, k in zip(parts, keep) if k)).hexdigest()
    assert changed > 3


def test_pieces_are_the_tokenizers():
    coder = grammar.encoder(tokenizer_path())
    frame = "a{}b 1{}2 !{}? {} {}x  {}{}\n{}'{}s"
    for c in [*range(0x2B0), *range(0x2000, 0x2030), *range(0x20A0, 0x20C0), 0x3042, 0x1F600]:
        text = frame.replace("{}", chr(c))
        assert coder.encode(text) == np.array(coder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(c)


def test_grammar_round_trip():
    rng = random.Random(4)
    for _ in range(200):
        n, least = rng.randrange(1, 300), rng.choice([2, 3, 8])
        data = np.array([rng.randrange(rng.choice([1, 2, 4, 19])) for _ in range(n)], np.uint32)
        ends = np.array(sorted({rng.randrange(1, n + 1) for _ in range(3)} | {n}))
        symbols, new_ends, rules, spans = grammar.compress(data, ends, 20, least)
        assert (grammar.expand(symbols, rules, spans, 20) == data).all()
        assert np.cumsum(grammar.widths(symbols, spans, 20))[new_ends - 1].tolist() == ends.tolist()
        seen: dict = {}
        for a, z in zip([0, *new_ends[:-1]], new_ends):
            for i in range(a, z - 1):
                seen[symbols[i], symbols[i + 1]] = seen.get((symbols[i], symbols[i + 1]), 0) + 1
        assert max(seen.values(), default=0) < least
        row = {"base": 20, "rules": rules.astype("<u4").tobytes(), "spans": spans.astype("<u4").tobytes(), "symbols": symbols.tobytes(), "docs": []}
        a, z = rng.randrange(n), rng.randrange(n + 5)
        assert grammar.Shard(row).ids(a, z).tolist() == data[a:z].tolist()
    symbols, _, rules, spans = grammar.compress(np.zeros(1 << 16, np.uint32), np.array([1 << 16]), 5, 2)
    assert len(symbols) == 2 and len(rules) == 15 and spans[-1] == 1 << 15


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_token_files(spark, docs, texts, shard):
    from tokenizers import Tokenizer

    path = scratch(spark)
    clash = docs.select("*", *[F.lit("clash").alias(c) for c in ("part", "shard", "_order", "symbols", "ids")])
    grammar.write(clash, path, tokenizer_path(), shard=shard, least=4)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in grammar.read(spark, path).collect())
    whole, want, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for i, text in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    row = max(spark.read.parquet(path).collect(), key=lambda r: r["n_ids"]).asDict(recursive=True)
    part = grammar.Shard(row)
    ids, ends = part.documents()
    assert part.ids(int(ends[-1]) - 7, int(ends[-1])).tolist() == ids[-7:].tolist()
    empty = scratch(spark)
    grammar.write(spark.createDataFrame([], SCHEMA), empty, tokenizer_path())
    assert grammar.read(spark, empty).count() == 0


def slow_negatives(rows, is_anchor):
    out = []
    for a, label, vec in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((-int(np.dot(vec, v)), i, own) for i, own, v in rows if i != a and len(v) == len(vec)))
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            hits = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(a, p, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(4096, 2048), (16, 5)])
def test_hard_negatives(spark, block, group, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 12))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 5] + 0.4 * rng.normal(size=12)).tolist()) for i in range(300)]
    rows += [(300 + i, i % 3, rows[10][2]) for i in range(40)]  # ties
    rows += [(400, 1, [0.0] * 12), (401, 1, [1.0, 2.0]), (402, 2, [0.75, 1.0]), (403, 1, [2.0, 2.0]), (404, 1, [])]
    rows += [(405, 1, [2e6] * 12), (406, 1, [2e6] * 12), (407, 2, [1.2e6] * 12)]  # scores beyond 2**53
    bad = [(None, 1, [0.0] * 12), (500, None, [0.0] * 12), (501, 1, None), (502, 1, [None] * 12), (503, 1, [float("nan")] * 12), (504, 1, [float("inf")] * 12)]
    bad += [(505, 1, [1e300] * 12)]
    table = spark.createDataFrame(rows + rows[:20] + bad, "vec_id bigint, label int, embedding array<double>")
    table = table.withColumns({c: F.lit("clash") for c in ("ints", "near", "cell", "anchor", "number", "ids")}).repartition(4)
    whole = [(i, own, [int(np.floor(256 * x)) for x in v]) for i, own, v in rows]
    got = negatives.mine(negatives.quantised(table), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == slow_negatives(whole, lambda i: i % 5 == 0)
    assert negatives.mine(negatives.quantised(table.limit(0)), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.mine(negatives.quantised(table), F.lit(False)).count() == 0


def test_score_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    data = np.floor(256 * rng.normal(size=(400, 8))).astype(np.int64)
    units = rng.normal(size=(6, 8))
    known = {8: units / np.linalg.norm(units, axis=1)[:, None]}
    norms, to = negatives.angles(data, known)
    exact = data @ data.T
    apart = np.abs(to[:, None] - to[None]).max(axis=2)
    far = np.minimum(to[:, None] + to[None], 2 * np.pi - to[:, None] - to[None]).min(axis=2)
    product = norms[:, None] * norms[None]
    low, high = negatives.score_bounds(apart, far, product, product)
    assert (low <= exact).all() and (exact <= high).all() and (high < 0.9 * product).mean() > 0.2
