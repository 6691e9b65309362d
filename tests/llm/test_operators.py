"""The training-data operators against brute-force versions, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from knotwork.llm import licenses, mixing, packing, pages, pii, quality, repeats, simhash, spans, vectors
from knotwork.llm.linking import components
from knotwork.llm.queries import document_files, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return " ".join(f"{'abcdefghij'[rng.randrange(10)]}w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(5, 300)) for _ in range(40)]
    passage = words(rng, 70)
    near = base[3].split()
    near[10] = "changed"
    made = [*base, base[0], base[0], " ".join(near), passage + ". " + base[5], base[6] + ". " + passage, None, "", " \n\t ", "One.", "x" * 3000, "ab " * 900]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(made)] + [(0, base[0], "en", None, 1), (None, base[1], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    from pyspark.sql import functions as F

    names = "_text _key key size target taken digest cuts grp ctx runs _id _digest fingerprint component kept score start end path dir own blocks html length piece _item _row".split()
    return docs.select("*", *[F.lit("clash").alias(n) for n in names])


def test_components(spark):
    pairs = [(5, 3), (3, 9), (9, 9), (20, 21), (21, 22), (22, 20), (1, 40), (40, 41), (41, 42), (42, 43)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {5: 3, 3: 3, 9: 3, 20: 20, 21: 20, 22: 20, 1: 1, 40: 1, 41: 1, 42: 1, 43: 1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_fingerprint(text, n):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    rng = random.Random(3)
    for text in ["", None, "One", "A b C", "é É x y z", words(rng, 700), "ab " * 20000]:
        got = simhash.text_fingerprint(text) & (1 << 64) - 1
        if text and len(text) > 30000:
            assert got == simhash.text_fingerprint("ab ab ab") & (1 << 64) - 1
        else:
            assert got == slow_fingerprint(text, 3)


def test_golay_decoder():
    code = simhash.decoder()
    rng = random.Random(1)
    for _ in range(300):
        word = rng.randrange(1 << 23)
        other = word ^ (1 << rng.randrange(23))
        near = {int(code[other ^ (1 << i)]) for i in range(23)} | {int(code[other])}
        assert int(code[word]) in near and len(near) <= 6


def test_simhash_links(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in values[:40] for k in (1, 2, 3, 4)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint bigint")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if bin((a ^ b) & mask).count("1") <= 3}


def test_simhash_keys_are_not_broadcast(spark):
    plan = simhash.links(spark.range(1000).withColumnRenamed("id", "fingerprint"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, plan


def test_near_duplicates(spark, docs, texts, empty, clashing):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    groups = collections.defaultdict(set)
    for r in found:
        if r["doc_id"] is not None:
            groups[r["component_id"]].add(r["doc_id"])
    assert {0, 40, 41} <= groups[0] and all(min(g) == c for c, g in groups.items())
    assert {45, 46, 47} <= groups[45]  # null, empty and blank texts have fingerprint zero
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(clashing, words=5)
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert kept.columns == clashing.columns and len(ids) == len(set(ids)) and 0 in ids and 40 not in ids and None not in ids
    assert simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_similar_texts(spark, block, monkeypatch):
    rng = random.Random(29)
    made = []
    for _ in range(25):
        base = words(rng, 60).split()
        made.append(" ".join(base))
        for edits in (1, 1, 2, 4, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            made.append(" ".join(copy))
    shingles = [frozenset(tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in made]
    label = list(range(len(made)))
    bits = [simhash.text_fingerprint(t, 5) & (1 << 64) - 1 for t in made]
    for a, b in itertools.combinations(range(len(made)), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) or (bits[a] ^ bits[b]).bit_count() <= 3:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (block,))
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_packing(spark, docs, texts, empty, clashing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    odd = ["It's <|endoftext|> don't", "ΣΑΣ İI ﬁ é Ünï", "a1b2 ½ x²", "tabs\tand spaces \r\n", "!!?? ...", "日本語 текст", "'s", "(word) [word]. word,"]
    for text in [*odd, *[t[1] for t in texts if t[1]]]:
        expected = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.encoder(tokenizer_path()).encode(text), "<u4").tolist() == expected
    found = packing.pack_documents(clashing, tokenizer_path(), capacity=64).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in texts:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected = [(n, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for n, s in enumerate(range(0, len(ids), 64))]
        copies = 2 if i == 0 else 1
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(expected * copies)
    for places in by_bin.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places[:-1])] and sum(n for _, n in places) <= 64
    assert len(by_bin) <= len(packing.best_fit([r["length"] for r in found], 64))
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_local_search_empties_a_bin():
    lengths = np.array([60, 40, 50, 30, 35, 25, 45, 15])
    home = np.arange(len(lengths))
    after = packing.improve(lengths, home, 100)
    fill = np.bincount(after, weights=lengths)
    assert fill.max() <= 100 and 3 <= (fill > 0).sum() <= 4
    rng = random.Random(2)
    for _ in range(40):
        lengths = np.array([rng.randrange(1, 60) for _ in range(60)])
        first, _ = packing.pack_lengths(lengths, 100)
        assert np.bincount(first, weights=lengths).max() <= 100
        assert len(set(first)) <= len(packing.best_fit(lengths.tolist(), 100))


def test_a_shorter_piece_moves_where_the_longest_fits_nowhere():
    lengths, home = np.array([6, 2, 7]), np.array([0, 0, 1])
    given, back, taker = packing._step(lengths, home, np.array([8, 7]), 0, 10)
    assert (given.tolist(), back, taker) == ([1], -1, 1)


def test_packing_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 101)) for i in range(700)]
    packed = packing.pack(spark.createDataFrame(rows, "id bigint, length bigint"), 100, block=100).collect()
    bins = collections.Counter()
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert len(packed) == 700 and max(bins.values()) <= 100 and len(bins) <= len(packing.best_fit([n for _, n in rows], 100)) + 8


def slow_targets(sizes):
    order = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        level = (total - sum(2 * sizes[k] for k in capped)) / sum(weight[k] for k in order if k not in capped)
        over = {k for k in order if k not in capped and weight[k] * level > 2 * sizes[k]}
        if not over:
            return {k: 2 * sizes[k] if k in capped else weight[k] * level for k in order}
        capped |= over


def test_mixing(spark, docs, texts, empty, clashing):
    sizes = collections.Counter()
    for _, text, _, source, _ in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = slow_targets(sizes)
    rows = mixing.mix(docs, ["doc_id", "source"], block=64).collect()
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {k: taken[k] for k in expected} == {k: math.floor(v + 1e-9) for k, v in expected.items()}
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"], block=64).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty, ["doc_id"]).count() == 0
    mixed = mixing.mixture(clashing)
    assert mixed.columns == clashing.columns and 0 < mixed.count() < 2 * len(texts)


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 64000, 64000.0), (1, 32000, 16000.0), (2, 6400, 12800.0)], "number bigint, source_size bigint, target double")
    slots = [r["number"] for r in mixing.schedule(sources, 64).orderBy("slot").collect()]
    want = {0: 1000, 1: 250, 2: 200}
    assert collections.Counter(slots) == want
    seen = collections.Counter()
    for i, n in enumerate(slots[:1400], start=1):
        seen[n] += 1
        assert all(abs(seen[k] - i * v / 1450) < 8 for k, v in want.items())


@pytest.mark.parametrize("limit", [50_000, 2])
def test_repeats(spark, docs, texts, empty, clashing, limit):
    length, gram = 40, 12
    data = [(t[1] or "").encode() for t in texts]
    starts = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    expected = []
    for (i, *_), b in zip(texts, data):
        cover = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                cover[s : s + length] = True
        kept = bytes(x for x, c in zip(b, cover) if not c)
        expected.append((i, len(b), int(cover.sum()), int((np.diff(cover.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    got = repeats.without_repeats(clashing if limit == 2 else docs, ["doc_id"], length, gram, limit)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert repeats.without_repeats(empty).count() == 0


def test_intervals():
    found = set(repeats.intervals([0, 2, 3, 1, 0, 4]))
    assert (3, 2, 1, 2) in found and (2, 1, 0, 2) in found and (1, 0, 0, 3) in found and (4, 0, 4, 5) in found


def test_repeats_of_contexts():
    rng = random.Random(9)
    for _ in range(30):
        lefts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 8))) for _ in range(12)]
        rights = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(12)]
        groups = [rng.randrange(2) for _ in range(12)]
        found = collections.defaultdict(set)
        for i, _, _, _, near, far in repeats.repeats(groups, lefts, rights, 8):
            found[i] |= set(range(near, far + 1))

        def window(i, o):
            ok = o <= len(lefts[i]) and 8 - o <= len(rights[i])
            return (groups[i], lefts[i][len(lefts[i]) - o :], rights[i][: 8 - o]) if ok else None

        for i in range(12):
            expected = {o for o in range(8) if window(i, o) and any(window(j, o) == window(i, o) for j in range(12) if j != i)}
            assert {o for o in found[i] if o < 8} == expected


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        parts = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(p - 9 * (p > 9) for p in parts) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_base(spark):
    rng = random.Random(11)
    pool = "a.b@c.de-f@g.h.i @x 1.2.3.4 256.1.1.1 00001.2.3.004.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999 +49.30.1234567 +1 é𝒳 a@b.c_d@e.f a@b.c.d@e ..@- 5555555555554444123 \n , ".split(" ")
    made = [None, "", "9" * 5000, "a" * 5000 + "@", "1.2.3.4 " * 500, "𝒳é a@b.cd 1.1.1.1", *("".join(rng.choice(pool) + rng.choice(["", " ", " "]) for _ in range(30)) for _ in range(120))]
    rows = [(i, t) for i, t in enumerate(made)] + [(5, made[5])]
    got = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, made[r["doc_id"]] or "") if valid(k, m[0])]
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in found)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(f[0] == k for f in found) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_pii_terms(spark, empty, clashing):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]
    words = lambda rng, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    plain = [(i, words(rng, 60) + " the common words", None) for i in range(200)]
    told = [(1000 + i, f"{words(rng, 20)} the zebulon wrote from jo@corp.example {words(rng, 20)}", None) for i in range(6)]
    other = [(2000, "Zebulon was here, the zebulons were not.", None)]
    rows = spark.createDataFrame([*plain, *told, *other], "doc_id bigint, text string, lang string").repartition(4)
    terms = {r["term"]: r["share"] for r in pii.revealing_terms(rows, pii.base_spans(rows)).collect()}
    n, n_entity, n_term = 207, 6, 7
    assert set(terms) >= {"zebulon"} and "the" not in terms
    assert abs(terms["zebulon"] - math.log(6 * n / (n_entity * n_term)) / math.log(n / n_entity)) < 1e-9
    found = {r["doc_id"]: r["spans"] for r in pii.find(rows).collect()}
    assert re.search(r"(generalised|removed):0:7", found[2000]) and found[0] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(rows).collect()}
    assert "jo@corp" not in clean[1000] and "<EMAIL>" in clean[1000] and "ebulon " not in clean[2000] and clean[0] == plain[0][1]
    # Copies are one context, not support.
    copies = [(i, f"{told[0][1]} copy", None) for i in range(3000, 3010)]
    few = spark.createDataFrame([*plain, *copies], "doc_id bigint, text string, lang string")
    assert not pii.revealing_terms(few, pii.base_spans(few)).collect()
    assert pii.find(empty).count() == 0 and pii.sanitised(empty).count() == 0
    same = pii.sanitised(clashing)
    assert same.columns == clashing.columns and same.count() == clashing.count()


def test_pii_terms_of_rare_values(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    told = [
        f"{words(20)} Quixwald wrote from quixwald.7@corp.example {words(20)}",  # once, the address spells the name
        *(f"{words(20)} Hrothgar {words(2)} +44 20 7946 0999 {words(20)}" for _ in range(2)),  # a value that occurs twice
        *(f"{words(20)} Vexmoor {k}x{i}@vexmoor.example {words(20)}" for i, k in enumerate("abcde")),  # unlike addresses of one domain
        f"{words(20)} Brandolf 4111111111111111 {words(3)} 5555555555554444 {words(20)}", f"{words(20)} 4111111111111111 and 5555555555554444 {words(3)} Brandolf {words(20)}",  # beyond the next match of the kind
        f"{words(20)} Onceonly 10.1.2.3 {words(20)}",  # once: nothing tells it from other words
    ]
    passage = f"{words(8)} krumhorn {words(8)} z.z@solo.example {words(8)}".split()  # near copies, one word changed in each
    copies = [" ".join([*passage[:i], f"edit{'abcdefghijklmnopqrstuvwxyz'[i]}", *passage[i + 1:]]) for i in range(24) if "@" not in passage[i] and passage[i] != "krumhorn"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*(words(60) for _ in range(1000)), *told, *copies])], "doc_id bigint, text string").repartition(4)
    terms = {r["term"]: r["share"] for r in pii.revealing_terms(rows, pii.base_spans(rows)).collect()}
    assert set(terms) >= {"quixwald", "hrothgar", "vexmoor", "brandolf"} and all(terms[t] >= 0.8 for t in terms)
    assert not set(terms) & {"onceonly", "krumhorn", "example"} and not set(terms) & set(vocabulary)
    found = {r["doc_id"]: r["text"] for r in pii.sanitised(rows).collect()}
    assert "uixwald" not in found[1000] and "rothgar" not in found[1001] and "Onceonly" in found[1010]


def test_spans(spark, docs, texts, empty, clashing):
    order = sorted({(t[0] is None, t[0] or 0, t[1] or "") for t in texts})
    seen, gone = set(), {}
    for key in order:
        for h, low, a, n in spans.runs(key[2]):
            if (h, low) in seen:
                gone.setdefault(key, set()).update(range(a, a + n))
            seen.add((h, low))
    for r in spans.without_repeats(clashing.withColumn("t2", clashing["text"]), ["doc_id", "t2"]).collect():
        key = (r["doc_id"] is None, r["doc_id"] or 0, r["t2"] or "")
        assert r["n_removed"] == len(gone.get(key, ())) and r["n_sentences"] == len(spans.sentences(key[2]))
        if not r["n_removed"]:
            assert r["text"] == key[2]
    kept = {r["doc_id"]: r["text"] for r in spans.without_repeats(docs).collect()}
    assert kept[40].split() == [] and kept[43].startswith(texts[43][1][:50]) and len(kept[44]) < len(texts[44][1])
    assert spans.without_repeats(empty).count() == 0


def test_sentences():
    text = "One. Two!  Three?\n\nFour 3.5 five.Six\n \nEnd"
    assert [text[a:b] for a, b in spans.sentences(text)] == ["One.", "Two!", "Three?", "Four 3.5 five.Six", "End"]


def test_licenses(spark, empty, clashing):
    rows = [
        ("a/LICENSE", "MIT License text\nReleased under the MIT License."), ("a/b/x.txt", "plain words of the text"), ("a/b/c/COPYING", "Licensed under the Apache License, Version 2.0"),
        ("a/b/c/y.txt", None), ("a/b/c/d/z.txt", ""), ("q/LICENSE.txt", "nothing of the kind"), ("q/w.txt", "prose under the version of a license"), ("top.txt", "word"),
        ("LICENSE", "Licensed under CC BY-NC 4.0."), (None, "x"), ("a/own.txt", "# " + "Licensed under CC BY 4.0" + "\ncode"), ("a/own.txt", "# Licensed under CC BY 4.0\ncode"),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "n int, path string, text string").repartition(3)
    got = {r["n"]: (r["licence"], r["origin"], r["licence_dir"]) for r in licenses.scan(files, ["n"]).collect()}
    assert got[1] == ("MIT", "inherited", "a") and got[3] == ("Apache-2.0", "inherited", "a/b/c") and got[4] == ("Apache-2.0", "inherited", "a/b/c")
    assert got[6] == ("CC-BY-NC-4.0", "inherited", "") and got[7] == ("CC-BY-NC-4.0", "inherited", "") and got[9] == (None, "none", None)
    assert got[10] == got[11] == ("CC-BY-4.0", "own", None) and got[0][0] == "MIT" and got[2][1] == "own"
    assert licenses.scan(document_files(empty), ["doc_id"]).count() == 0
    assert licenses.scan(document_files(clashing), ["doc_id"]).count() == clashing.count()


def test_licence_cosine_is_whole():
    """Passing over lines without a heavy term changes nothing."""
    rng = random.Random(17)
    counts = {t: rng.randrange(1, 900) for t in licenses._vocabulary()}
    counts["the"] = 900
    matcher = licenses.Matcher(1000, counts)
    vocabulary = sorted(licenses._vocabulary())
    for _ in range(400):
        line = " ".join(rng.choice([rng.choice(vocabulary), *licenses.terms(rng.choice(rng.choice(list(licenses.NOTICES.values()))))]) for _ in range(rng.randrange(1, 9)))
        best = None
        weight = {t: n * matcher.idf.get(t, matcher.rare) for t, n in collections.Counter(licenses.terms(line)).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        for name, unit in matcher.notices:
            score = round(sum(w * weight.get(t, 0) for t, w in unit.items()) / norm, 9)
            if score >= licenses.LEAST and (best is None or (-score, name) < best):
                best = (-score, name)
        assert matcher.best(line) == ((best[1], -best[0]) if best else (None, None))


def test_licence_headers_and_texts(spark):
    header = "\n".join(f"# {line}" for line in licenses.HEADERS["Apache-2.0"].split("\n"))
    gpl = next(" ".join(t for t, n in c.items() for _ in range(n)) for name, header_, c in licenses.templates() if name == "GPL-3.0" and not header_)
    code = "\n".join(f"value{i} = other{i} + en" for i in range(40))
    rows = [
        ("a/x", "This project is licensed under the MIT License - see the LICENSE file for details"), ("a/x", "Copyright 2020 Jo Doe. Released under the MIT License."),
        ("a/x", f"#!/bin/sh\n{header}\n{code}"), ("a/x", header.replace("\n# ", " ")), ("a/x", f"Copyright 2020 Jo Doe\n\n{licenses.HEADERS['MIT']}"),
        ("a/x", gpl), ("a/x", licenses.HEADERS["BSD-3-Clause"]), ("a/x", code), ("a/x", licenses.HEADERS["BSD-2-Clause"]),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate([*rows, *(("b/y", "en el la de\nla en casa") for _ in range(200))])], "n int, path string, text string").repartition(3)
    got = {r["n"]: r["licence"] for r in licenses.scan(files, ["n"]).collect()}
    assert [got[i] for i in range(9)] == ["MIT", "MIT", "Apache-2.0", "Apache-2.0", "MIT", "GPL-3.0", "BSD-3-Clause", None, "BSD-2-Clause"] and len(got) == 209
    # A frequent word beside a notice weighs little, a rare one much.
    counts = {r["term"]: r["n"] for r in licenses.term_counts(files).collect()}
    assert counts["en"] == 40 * 2 + 400 and counts["casa"] == 200
    matcher = licenses.Matcher(counts[""], {t: n for t, n in counts.items() if t in licenses._vocabulary()})
    line = "en released under the MIT License"
    assert matcher.best(line, {"en": counts["en"]})[1] > matcher.best(line)[1]


def page(menu, title, paragraphs, footer, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><div class='ad'>Buy</div><article><h1>{title}</h1>{body}</article>{extra}<footer>{footer}</footer></body></html>"


def test_pages(spark, empty):
    rows = [(i, f"http://one.example/{i}", page("<li>a<li>b", f"T{i} &amp; more", [f"First  {i}\n x", "<b>Bold<br>line</b> &lt;i&gt;"], "foot")) for i in range(6)]
    bare = [(100 + i, f"https://two.example/{i}", f"<div><div>Site name</div><div>Story {i} <p>Para {i}<p>More {i}</div><div>Contact us</div></div>") for i in range(6)]
    odd = [(200, None, None), (201, "", ""), (202, "x", "just text <br> here"), (203, "http://one.example/z", "<p>unclosed <b>bold<p>next<script>var a='</p>';</script><!-- no --> tail<div class='comments'>me too</div>")]
    long = [(204, "http://three.example/", "<article>" + "<p>w w</p>" * 3000 + "</article>"), (204, "http://three.example/", "<article>" + "<p>w w</p>" * 3000 + "</article>")]
    table = spark.createDataFrame([*rows, *bare, *odd, *long], "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    for i in range(6):
        assert got[i] == f"T{i} & more\n\nFirst {i} x\n\nBold line <i>"
        assert got[100 + i] == f"Story {i}\n\nPara {i}\n\nMore {i}"
    assert got[200] == got[201] == "" and got[202] == "just text here" and got[203] == "unclosed bold\n\nnext tail"
    assert got[204] == "\n\n".join(["w w"] * 3000)
    from pyspark.sql import functions as F

    clash = table.select("*", *[F.lit(1).alias(n) for n in ("_host", "blocks", "shape", "fixed", "text", "_tie")])
    assert {r["page_id"]: r["text"] for r in pages.extract(clash).collect()} == got
    assert pages.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_tree_matching():
    def tree(shape):
        tags, parents = [], []

        def add(node, parent):
            tags.append(node[0])
            parents.append(parent)
            here = len(tags) - 1
            for kid in node[1:]:
                add(kid, here)

        add(shape, -1)
        return tags, pages._children(parents)

    def slow(a, b):
        if a[0] != b[0]:
            return 0
        x, y = a[1:], b[1:]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow(x[i], y[j]))
        return best[-1][-1] + 1

    rng = random.Random(19)

    def grow(depth):
        return [rng.choice("pdu"), *(grow(depth - 1) for _ in range(rng.randrange(4) if depth else 0))]

    for _ in range(200):
        a, b = ["r", *grow(3)[1:]], ["r", *grow(3)[1:]]
        pairs = pages.match(*tree(a), *tree(b))
        assert len(pairs) == slow(a, b) and len(set(pairs.values())) == len(pairs)


def test_passages_without_end_marks(spark):
    rng = random.Random(33)

    def unlike(n):
        return " ".join(f"w{rng.randrange(10**6)}x" for _ in range(n))

    for size in (50, 80):
        passage = unlike(size)
        made = [f"{unlike(rng.randrange(3, 40))} {passage} {unlike(rng.randrange(3, 40))}" for _ in range(12)] + [unlike(90) for _ in range(5)]
        made += [f"{unlike(7)}. {passage}. {unlike(9)}.", passage]
        got = {r["doc_id"]: r for r in spans.without_repeats(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")).collect()}
        assert got[0]["text"] == made[0] and all(got[i]["text"] == made[i] for i in range(12, 17))
        for i in [*range(1, 12), 17, 18]:
            left = len(got[i]["text"].split())
            assert got[i]["n_removed"] > 1 and len(made[i].split()) - left >= size - 2 * spans.WINDOW
    # sentences of the passage that end elsewhere in the other text
    a, b, c = unlike(36).split(), unlike(33).split(), unlike(21).split()
    one = " ".join([*a, *b, *c])
    other = f"{unlike(5)} {' '.join(a[6:])}. {' '.join(b)} {' '.join(c[:15])}. {unlike(4)}"
    got = {r["doc_id"]: r for r in spans.without_repeats(spark.createDataFrame([(1, one), (2, other)], "doc_id bigint, text string")).collect()}
    assert got[1]["text"] == one and got[2]["n_removed"] > 1
    text = "  " + unlike(30) + "\t" + unlike(30) + "  \n end "
    assert [w for s, e in spans.sentences(text) for w in text[s:e].split()] == text.split()
    assert max(len(text[s:e].split()) for s, e in spans.sentences(text)) <= spans.WINDOW


def test_tree_matching_of_deep_and_wide_pages():
    deep = "<div>" * 100_000 + "x"
    tree = pages.parse(deep)
    tags, kids = pages._reference(pages.skeleton(tree))
    assert len(pages.match(tree.tag, pages._children(tree.parent), tags, kids)) == len(tags) > 100_000
    other = pages.parse("<div>" * 99_000 + "<p>y" + "</div>" * 5 + "<div>z")
    assert len(pages.match(other.tag, pages._children(other.parent), tags, kids)) >= 99_000
    wide = pages.parse("<ul>" + "".join(f"<li>{i}<p>a" + "<p>b" * (i % 3) for i in range(20_000)))
    less = pages.parse("<ul>" + "".join(f"<li>{i}<p>a" + "<p>b" * (i % 3) for i in range(20_000) if i % 5000))
    tags, kids = pages._reference(pages.skeleton(less))
    pairs = pages.match(wide.tag, pages._children(wide.parent), tags, kids)
    assert len(pairs) == len(tags)


def test_reference_pages_by_layout(spark):
    def page(i, kind):
        if kind == 0:
            return f"<body><div>Site name</div><div><p>Story {i} tells something new</p></div><div>All rights</div></body>"
        return f"<body><section><table><tr><td>Shop name</td></tr></table></section><section><p>Item {i} is on sale</p></section></body>"

    rows = [(i, "http://a.example/x", page(i, 0)) for i in range(8)] + [(8, "http://a.example/x", ""), (9, "http://a.example/x", None)]
    rows += [(10 + i, "http://b.example/x", page(i, i % 2)) for i in range(16)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} tells something new" for i in range(8)) and got[8] == got[9] == ""
    assert all(got[10 + i] == (f"Item {i} is on sale" if i % 2 else f"Story {i} tells something new") for i in range(16))


def test_ids_of_letters_beside_marks():
    coder = packing.encoder(tokenizer_path())
    for c in range(0x110000):
        if chr(c).isalpha() and (c < 0x3000 or 0xFB00 <= c < 0xFC00):
            for text in (f"({chr(c)})", f"a{chr(c)}.", f";{chr(c)}:"):
                assert coder.encode(text) == np.array(coder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(c)


def test_vectors(spark):
    rng = np.random.RandomState(3)
    centre = rng.randn(30, 64)
    x = np.concatenate([centre, centre[:10] + 0.25 * rng.randn(10, 64), centre[:1] + 0.1 * rng.randn(40, 64), centre[:1], centre[:1] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None] + [1.0] * 63, 1), (1004, [float("inf")] + [1.0] * 63, 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    table = spark.createDataFrame([*rows, *bad, rows[4]], "vec_id bigint, embedding array<float>, node int").repartition(3)
    got = vectors.near_duplicates(table, block=16).collect()
    assert len(got) == len(rows) + len(bad) + 1
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    count = near.sum(axis=1) - 1 + near[:, 4]  # row 4 is there twice
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    for r in got:
        i = r["vec_id"]
        if i < 1000:
            assert r["n_links"] == count[i] and r["component_id"] == label[i] and r["kept"] == (i == label[i])
        elif i in (1006, 1007):
            assert r["n_links"] == 1 and r["component_id"] == 1006
        else:
            assert r["n_links"] == 0 and r["component_id"] == i and r["kept"]
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vector_recall():
    rng = np.random.RandomState(5)
    a = rng.randn(1500, 64)
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.randn(1500, 64)
    b -= (b * a).sum(axis=1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    shared = [bool(set(p) & set(q)) for p, q in zip(vectors.buckets(a), vectors.buckets(b))]
    assert np.mean(shared) > 0.97


def slow_measure(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    inside = {i + k for i in range(len(found) - 4) for k in range(5) if windows[tuple(found[i : i + 5])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, texts, empty, clashing):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(50)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    for r in quality.rate(clashing, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect():
        options = {slow_measure(t[1]) for t in texts if t[0] == r["doc_id"]}
        assert tuple(r)[1:6] in options
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.rate(docs, labels.limit(0)).count() == len(texts)
    assert quality.rate(empty, labels).count() == 0
    kept = quality.filtered(spark, clashing, labels.limit(0))
    assert kept.columns == clashing.columns and 0 < kept.count() < len(texts)
    rng = random.Random(23)
    for _ in range(200):
        text = " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))
        assert quality.measure(text)[0] == slow_measure(text)


def test_forest_is_monotonic_and_learns():
    rng = np.random.RandomState(1)
    x = rng.rand(4000, 3)
    y = ((x[:, 0] + 0.3 * rng.randn(4000) < 0.5) ^ (x[:, 1] > 0.8)).astype(float)
    forest = quality.fit(x[:3000], y[:3000], directions=[-1, 0, 0])
    assert ((forest.score(x[3000:]) > 0) == y[3000:]).mean() > 0.7
    for row in x[:40]:
        grid = np.repeat(row[None], 200, axis=0)
        grid[:, 0] = np.linspace(-0.1, 1.1, 200)
        assert (np.diff(forest.score(grid)) <= 1e-12).all()
    one = quality.fit(x[:200], np.ones(200), directions=[0, 0, 0])
    assert len(one.score(x[:0])) == 0


def test_pipeline(spark, tmp_path, docs, texts):
    """Every stage gives the columns of documents, but the last, and takes effect on what came before."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        seen[name] = rows.collect()
        if name != "pack_sequences":
            assert rows.columns == docs.columns
    ids = [r["doc_id"] for r in seen["near_duplicates"]]
    assert len(ids) == len(set(ids)) and 40 not in ids and 45 not in [r["doc_id"] for r in seen["quality_rules"]]
    assert {r["doc_id"] for r in seen["personal_data"]} == set(ids)
    mixed = collections.Counter(r["doc_id"] for r in seen["mix_sources"])
    assert set(mixed) <= set(ids) and max(mixed.values()) == 2
    assert {r["doc_id"] for r in seen["pack_sequences"]} == set(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pack_sequences"])


def test_spans_cuts_at_the_least_word_of_a_window():
    """Sentences and pieces as a plain reading of the rule gives them; the breaks are sought by their first character."""
    import random
    import re

    from knotwork.llm import spans

    def plain(text):
        found, at = [], 0
        for gap in [*re.finditer(r"(?<=[.!?])\s+|\n\s*", text), None]:
            end = gap.start() if gap else len(text)
            words = [(m.group(), at + m.start()) for m in re.finditer(r"\S+", text[at:end])]
            begins = [0] if words else []
            if len(words) > spans.LONG:
                for stop in range(spans.WINDOW, len(words) + 1):
                    least = min(range(stop - spans.WINDOW, stop), key=lambda i: (words[i][0], -i))
                    begins += [least] if least > begins[-1] else []
            for i, k in zip(begins, [*begins[1:], None]):
                first = at if len(words) <= spans.LONG else words[i][1]
                found.append((first, end if k is None else words[k - 1][1] + len(words[k - 1][0])))
            at = gap.end() if gap else end
        return found

    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "ab", "c", ".", "!", "\n", " ", " ", " ", "\t", "\r\n", "... ", "d e f "]) for _ in range(rnd.randrange(160)))
        assert spans.sentences(text) == plain(text), text
        assert [w for _, _, w in spans._worded(text)] == [text[a:b].split() for a, b in spans.sentences(text)]
