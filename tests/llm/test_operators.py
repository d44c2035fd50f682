"""Each operator against brute force on small tables, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import findings, imatch, langid, lattice, licenses, mixing, quality, secrets, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox and the lazy dog " * 4000


def words(r, n, pool):
    return " ".join(r.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    en, de = "the and of in that with for was house river green walking".split(), "der die und das ist nicht über straße grün gehen haus fluß".split()
    out = [(i, words(r, r.randint(20, 90), en), "en", "a", 0) for i in range(40)] + [(100 + i, words(r, r.randint(20, 90), de), "de", "b", 0) for i in range(40)]
    passage = words(r, 60, en + de)
    out += [(200 + i, words(r, 5, en) + " " + passage + " " + words(r, 9, de), "en", "a", 0) for i in range(4)]
    out += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "12 !!", "en", "a", 5), (303, out[0][1], "en", "a", 0), (304, out[0][1] + " extra", "en", "a", 0), (305, LONG, "en", "a", 1)]
    return out


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    empty = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{empty}/embeddings.parquet")
    return str(at), str(empty)


@pytest.mark.parametrize("op", [secrets.op1_secrets, langid.op2_language, quality.op4_quality, simhash.op5_simhash, lattice.op6_lattice, licenses.op7_licenses, substring.op8_substring, mixing.op9_mixing, imatch.op10_imatch])
def test_empty(spark, sf, op):
    assert op(spark, sf[1]).count() == 0


def test_language(spark, sf, rows):
    got = {r.doc_id: r for r in langid.op2_language(spark, sf[0]).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows if i < 200)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[300].score == 0
    assert got[1].held_out == (zlib.crc32(b"1") % 5 == 0)
    m = langid.LanguageModel(["x", "y"], [{langid.NAMES.index("latin")}, {langid.NAMES.index("cyrillic")}], np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(2))
    assert m.word_scores(["слово", "a" * 1_000_000, "漢"]).tolist() == [[langid.FLOOR, 0], [0, langid.FLOOR], [0, 0]]


def test_language_letters(spark, sf):
    """Numbers that aren't letters give no language; words beyond any length count whole; scores are those of a plain sum over grams."""
    model = langid.train(spark.read.parquet(f"{sf[0]}/documents.parquet"))
    tail = "z" * 70 + "über"
    t = [(1, "½ ² ① Ⅷ 12"), (2, "der Fluß ½"), (3, tail), (4, "q" * 70 + "the"), (5, None)]
    got = {r.doc_id: r.language for r in langid.label(spark.createDataFrame(t, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred == got[5].lang_pred == "und" and got[2].lang_pred == "de" and got[2].n_words == 2
    known = dict(zip(model.keys.tolist(), model.logs.tolist(), strict=True))
    pack = lambda g: sum((ord(c) + 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    for w in ("haus", "walking", tail):
        p = f"\0{w}\0"
        grams = [p[i] for i in range(len(p) - 1)] + [p[i : i + 2] for i in range(len(p) - 1)] + [p[i : i + 3] for i in range(len(p) - 2)]
        want = np.sum([known.get(pack(g), model.unseen.tolist()) for g in grams], 0)
        assert np.abs(model.word_scores(["x", w])[1] - np.maximum(want - want.max(), langid.FLOOR)).max() < 1e-3


def test_language_shortcut():
    r = np.random.default_rng(2)
    lengths = r.integers(0, 12, 200)
    s = -np.abs(r.normal(size=(lengths.sum(), 3))).astype(np.float32)
    s -= s.max(1, keepdims=True)
    a, b = langid.labels_of(s, lengths, 3.0), langid.viterbi(s, lengths, 3.0)
    of = np.repeat(np.arange(200), lengths)
    value = lambda x: s[np.arange(len(x)), x].sum() - 3.0 * ((x[1:] != x[:-1]) & (of[1:] == of[:-1])).sum()
    assert abs(value(a) - value(b)) < 1e-2


def test_viterbi():
    r = np.random.default_rng(1)
    for n in (1, 5, 63, 64, 65, 400):
        s = r.normal(size=(n, 3)).astype(np.float32) * 2
        got = langid.viterbi(s, np.array([n, 0]), 2.5)
        v, back = s[0].astype(float), []
        for t in range(1, n):
            step = v[None, :] - 2.5 * (1 - np.eye(3))
            back.append(step.argmax(1))
            v = step.max(1) + s[t]
        value = sum(s[t, got[t]] for t in range(n)) - 2.5 * (np.diff(got[:n]) != 0).sum()
        assert abs(value - v.max()) < 1e-2


def test_quality(spark, sf, rows):
    got = {r.doc_id: r for r in quality.op4_quality(spark, sf[0]).collect()}
    held = [i for i, *_ in rows if i < 140 and got[i].held_out]
    assert sum(got[i].predicted == int(i < 100) for i in held) >= 0.9 * len(held)
    assert 0 <= got[300].score <= 1 and got[300].score == got[301].score


def test_simhash(spark, sf, rows):
    got = {r.doc_id: r for r in simhash.op5_simhash(spark, sf[0]).collect()}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        f = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{f:016x}"
    assert got[303].component_id == 0 and got[301].component_id == 300


def test_covering(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(50)]
    fps = set(base)
    for b in base:
        for k in range(1, 7):
            fps.add(b ^ sum(1 << i for i in r.sample(range(64), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.lo, r.hi) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "simhash long")).collect()}
    f = sorted(map(signed, fps))
    want = {(a, b) for i, a in enumerate(f) for b in f[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want


def test_lattice(spark, tmp_path):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    v = [*base, *(base[:20] + 0.05 * r.normal(size=(20, 16))), *(base[:10] + 0.08 * r.normal(size=(10, 16))), base[0]]
    rows = [(i, [float(x) for x in e], 0) for i, e in enumerate(v)]
    bad = [(500, None, 0), (501, [0.0] * 16, 0), (502, [None] + [1.0] * 15, 0), (503, [float("nan")] + [1.0] * 15, 0), (504, [], 0)]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in lattice.op6_lattice(spark, str(tmp_path)).collect()}
    e = np.array([x[1] for x in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    s = e @ e.T >= 0.95
    np.fill_diagonal(s, False)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found >= 0.9 * s.sum() and all(got[i].n_links <= s[i].sum() for i in range(len(rows)))
    assert got[len(rows) - 1].component_id == 0 and not got[len(rows) - 1].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in bad)


@pytest.mark.parametrize("config", [lattice.Lattice(), lattice.sized(10_000), lattice.sized(10_000_000)])
def test_lattice_recall(spark, config):
    """Pairs just above the threshold among strangers: recall, no wrong link, components by brute force."""
    r = np.random.default_rng(7)
    n, dims = 600, 24
    a = r.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(n, dims))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    v = np.concatenate([a, 0.951 * a + np.sqrt(1 - 0.951**2) * b, 0.951 * a[:50] - np.sqrt(1 - 0.951**2) * b[:50]])
    rows = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in lattice.groups(rows, lattice=config).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    links = np.array([got[i].n_links for i in range(len(v))])
    assert (links <= s.sum(1)).all() and links.sum() >= 0.95 * s.sum()
    exact = links == s.sum(1)
    for i in np.flatnonzero(exact):  # where all links of a component were found, it is the brute-force one
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(s[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        if all(exact[j] for j in seen):
            assert got[i].component_id == min(seen)


def test_lattice_cases(spark):
    """Vectors of several lengths, null and repeated keys, very large and small components, and a hot cell split in blocks."""
    t = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 4.0, 6.0]), (5, [1.0, 2.0, 3.01]), (6, [9.0, -1.0, 0.0]), (None, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (7, [1e-200, 2e-200]), (8, [1e200, 2e200]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (None, [5.0, 0.0, 0.0, 0.0])]
    got = [tuple(r) for r in lattice.groups(spark.createDataFrame([(k, v, 0) for k, v in t], "vec_id long, embedding array<double>, cid int")).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 7, 8)) == [(1, 3, 1, True), (2, 3, 1, False), (7, 3, 1, False), (8, 3, 1, False)]
    assert sorted(x for x in got if x[0] in (3, 4, 5)) == [(3, 4, 3, True), (3, 4, 3, True), (4, 4, 3, False), (5, 4, 3, False)]
    assert (None, 4, 3, False) in got and (6, 0, 6, True) in got and (10, 1, 9, False) in got and (None, 0, None, True) in got and len(got) == len(t)
    r = np.random.default_rng(1)
    v = np.ones(16) + 0.02 * r.normal(size=(300, 16))
    flat = spark.createDataFrame([(i, 1, e.tobytes()) for i, e in enumerate(v)], "cid long, n long, v binary")
    met = lattice.links(flat, lattice.sized(10_000), block_rows=40).groupBy("cid").agg(F.sum("links").alias("links")).collect()
    assert len(met) == 300 and all(x.links == 299 for x in met)


def test_lattice_is_the_same_for_every_size(spark, monkeypatch):
    """It was chosen by the number of vectors: a pair could be found in a small table and be lost in a larger one."""
    used, links = [], lattice.links
    monkeypatch.setattr(lattice, "links", lambda flat, of, least: used.append(of) or links(flat, of, least))
    for n in (3, 2500):
        d = spark.range(n).selectExpr("id AS vec_id", "transform(sequence(1, 24), i -> cast(xxhash64(id, i) AS double)) AS embedding")
        lattice.groups(d).count()
    assert used[0] == used[1]


def test_lattice_decoder():
    x = np.random.default_rng(0).normal(size=(200, 8))
    p = lattice.decode(x)
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - p[:, None] - lattice.roots()) ** 2).sum(2) + 1e-9).all()


def test_licenses(spark):
    t = [(1, "x Under the MIT\nlicense, UNDER THE MIT LICENSE"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "This work is licensed under the GNU General Public License, version 3.\nend"), (5, "a CC by nc cc BY-nc"), (6, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(t, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels, got[1].score) == (2, 1, 5, "mit", "mit", 1.0)
    assert got[2].labels == "cc-by-nc" and got[4].labels == "gpl-3" and got[4].base_labels == "" and got[5].n_base == 2
    assert got[3].n_words == 0 == got[6].n_words and got[3].first_word is None and got[3].labels == ""


def test_license_blocks(spark):
    """Statements wrapped over lines and slightly changed are found; a neighbour's name rules a template out; words scattered over a long text aren't a statement."""
    mit = "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software\nand associated documentation files"
    bsd = "Redistributions and use in source or binary forms, with or without changes,\nare permitted provided that the following conditions are all met: redistribution"
    far = (" word" * 100).join("released under the mit license".split())
    t = [(1, mit), (2, bsd), (3, "Licensed under CC BY-SA 4.0"), (4, "this work is licensed under the GNU Lesser General Public License, version 3"), (5, far), (6, "x " * 500 + mit), (7, mit.replace("copy", "part")), (7, "None"), (None, mit), (None, mit)]
    rows = spark.createDataFrame([(k, v, "k", 1) for k, v in t], "doc_id long, text string, label string, row int")
    got = [(r.doc_id, r.labels) for r in licenses.scan(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, "mit"), (2, "bsd"), (3, "cc-by-sa"), (4, "lgpl-3"), (5, ""), (6, "mit"), (7, "mit"), (7, ""), (None, "mit"), (None, "mit")], key=str)
    met = {(r.doc_id, r.label): r.containment for r in licenses.matches(rows).where("doc_id < 7").collect()}
    for doc, label in met:  # brute force over all windows
        text = dict(t)[doc].lower()
        import re

        w = re.findall(licenses.WORD, text)
        sets = [set(x.split()) for x, *_ in licenses.TEMPLATES[label]]
        best = max(len(set(w[i : i + licenses.BLOCK]) & s) / len(s) for s in sets for i in range(0, max(1, len(w) - licenses.STEP), licenses.STEP))
        assert met[doc, label] <= best + 1e-9 and best >= 0.8


def test_substring(spark, sf, rows):
    got = {r.doc_id: r for r in substring.op8_substring(spark, sf[0]).collect()}
    docs, first = sorted((i, (t or "").encode().split()) for i, t, *_ in rows), {}
    for i, w in docs:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in docs:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    f = {r.doc_id: r.factors for r in substring.remove(spark.createDataFrame(rows, DOCS), factors="factors").collect()}
    assert f[201][0].source == 200 and f[201][0].n_words >= 60 and f[200] is None


def test_substring_parse():
    """A factor goes on word by word where its source does, takes in runs it explains, and covers nothing that only a hash says."""
    w = [str(i).encode() for i in range(100)]
    text = lambda a, b: " ".join(str(i) for i in range(a, b))
    run = lambda at, n, source, words: {"at": at, "n_words": n, "source": source, "place": 7, "words": words}
    got = substring.parse(w, [run(10, 60, 5, text(10, 90)), run(20, 50, 3, text(20, 70)), run(45, 55, 4, text(45, 100))], 50)
    assert [(f["start"], f["n_words"], f["source"]) for f in got] == [(10, 80, 5), (45, 55, 4)]
    assert substring.parse(w, [run(0, 60, 5, text(0, 30) + " x " + text(31, 60))], 50) == []


def test_substring_cases(spark):
    """Repeated rows and ids with several texts, null ids, clashing names, repeats across the boundary of two sources, and a long text."""
    r = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    a, b, c = words(r, 80, pool), words(r, 80, pool), words(r, 70, pool)
    cross = " ".join([*a.split()[-55:], *b.split()[:55]])
    t = [(1, a), (2, b), (2, c), (3, a), (3, a), (3, words(r, 60, pool)), (4, cross), (5, c + " x"), (None, a), (6, a + " " + words(r, 300, pool) * 40), (7, None), (8, ""), (2, a)]
    docs = spark.createDataFrame([(k, x, i, 0, "y", 1.0) for i, (k, x) in enumerate(t)], "doc_id long, text string, _doc int, _t int, _runs string, _whole double")
    got = {x._doc: x for x in substring.remove(docs).collect()}
    assert len(got) == len(t) and set(docs.columns) < set(substring.remove(docs).columns)
    first = {}
    for k, x in t:
        w = (x or "").split()
        for i in range(len(w) - 49):
            if k is not None:
                first[tuple(w[i : i + 50])] = min(k, first.get(tuple(w[i : i + 50]), k))
    for n, (k, x) in enumerate(t):
        w, gone = (x or "").split(), set()
        for i in range(len(w) - 49):
            if k is not None and first[tuple(w[i : i + 50])] < k:
                gone |= set(range(i, i + 50))
        d = got[n].deduplicated
        assert (d.n_words, d.n_removed, d.kept) == (len(w), len(gone), " ".join(y for i, y in enumerate(w) if i not in gone)), n


def test_imatch(spark, sf, rows):
    got = {r.doc_id: r for r in imatch.op10_imatch(spark, sf[0]).collect()}
    docs = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[303].fingerprint and set(got[300].fingerprint) == {"0"}
    assert got[301].near_next == 1.0 and got[301].fingerprint == got[300].fingerprint  # two empty texts


def test_imatch_digests(spark, sf):
    """Digests against a plain computation from the lexicon: sorted hashes of the kept terms of each subset, chained; likeness from these."""
    from sheaf.llm.common import table

    docs = table(spark, sf[0], "documents").where("doc_id < 140")
    lex = imatch.lexicon(docs, most_share=0.9)
    subsets = {r["hash"]: r["subsets"] for r in lex.collect()}
    hashes = {r.t: r.h for r in docs.select(F.explode(imatch.terms(F.col("text"))).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    found = {r.k: r.digests for r in imatch.digests(imatch.distinct_texts(docs, "doc_id", "text"), ["k"], lex).collect()}
    want = {}
    for r in docs.collect():
        for k in range(len(imatch.SUBSETS)):
            hs = sorted(hashes[t] for t in set(r.text.split()) if k in subsets.get(hashes.get(t), []))
            want[r.doc_id, k] = tuple(hs)
    some = sorted({v for v in want.values() if v})
    one = spark.createDataFrame([(list(v),) for v in some], "hs array<bigint>").select("hs", F.shiftright(F.aggregate("hs", F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)), 32).cast("int").alias("d")).collect()
    digest = {tuple(r.hs): r.d for r in one} | {(): 0}
    for (i, k), hs in want.items():
        if any(want[i, j] for j in range(len(imatch.SUBSETS))):
            assert found[i][k] == digest[hs], (i, k)


def test_imatch_null_ids(spark, rows, tmp_path):
    more = [x for x in rows if x[0] < 120] + [(None, "a text without an id in the house", "en", "a", 0), (-5, "the river", "en", "a", 0)]
    spark.createDataFrame(more, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in imatch.op10_imatch(spark, str(tmp_path)).collect()}
    docs = sorted(more, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    assert len(got) == len(more)
    for k, (i, t, *_) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


def test_secrets(spark):
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    t = [(i, f'some words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" more', "a", "x") for i in range(30)]
    t += [(100, f"commit {key} fixed it", "a", "x"), (101, None, None, None), (102, "Donaudampfschifffahrtsgesellschaft", "b", "x"), (103, f'SECRET: "{key}"', "b", "x"), (104, f'a b 92@mail6.example.com token = "{key}"', "b", "x"), (105, f"wish. hashes commit {key} and token={key}", "b", "x")]
    docs = spark.createDataFrame(t, "doc_id long, text string, source string, candidate string")
    got = {(r.doc_id, r.candidate, r.place): r.secret for r in secrets.scan(docs).collect()}
    assert all(got[i, hashlib.sha1(str(i).encode()).hexdigest(), 0] for i in range(30))
    assert not got[100, key, 0] and not got[102, t[32][1], 0] and got[103, key, 0] and got[104, key, 0]
    assert not got[105, key, 0] and got[105, key, 1]
    out = {r.doc_id: r.text for r in secrets.mask(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert out[0] == f'some words token = "{secrets.MASK}" more' and out[100] == t[30][1] and out[101] is None and len(out) == len(t)
    assert out[105] == f"wish. hashes commit {key} and token={secrets.MASK}"  # by place: the same string stays where it is harmless


def test_secrets_held_out(spark):
    """Precision and recall on contexts that the forest hasn't seen."""
    docs = spark.createDataFrame([(1, "the house by the river und der weg ist nicht weit la maison est grande")], "doc_id long, text string")
    known = secrets.dictionary(docs)
    model = secrets.train(findings.findings(spark, False), known)
    got = secrets.score(findings.findings(spark, True), known, model).select("label", (F.col("score") >= 0.5).alias("said")).collect()
    hit = sum(r.said and r.label for r in got)
    assert hit / sum(r.label for r in got) >= 0.95 and hit / sum(r.said for r in got) >= 0.8


def test_secret_features(spark):
    """Features by hand."""
    rows = [("ab12CD", 'x@example.com my_api_key = "', '" z', "tests/a"), ("the_house", "commit ", " by", "src"), ("A" * 50_000, "", "", "")]
    found = spark.createDataFrame(rows, "candidate string, before string, after string, path string")
    a, b, c = (r.asDict() for r in secrets.features(found, ["house", "the"]).collect())
    assert (a["length"], a["digits"], a["capitals"], a["named"], a["assigned"], a["quoted"], a["harmless"], a["path_trial"]) == (6, 2 / 6, 2 / 6, 1, 1, 1, 0, 1)
    assert (b["named"], b["harmless"], b["covered"], b["path_trial"]) == (0, 1, 1 - 1 / 9, 0) and abs(a["transitions"] - 2 / 6) < 1e-9 and c["length"] == 50_000


def test_secrets_cases(spark):
    """Repeated rows, an id with several texts, null ids, clashing names."""
    s = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "no such thing", 'password: "p@ss,w0rd"']
    t = [(1, s[0]), (1, s[1]), (1, s[0]), (None, s[0]), (None, s[1]), (None, None), (2, s[2])]
    docs = spark.createDataFrame([(k, x, "a", 0, i, "h", "p") for i, (k, x) in enumerate(t)], "doc_id long, text string, source string, n_chars long, _doc int, _hash string, _places string")
    out = secrets.mask(spark, docs, "")
    got = {r._doc: r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(t)
    assert [secrets.MASK in (got[i].text or "") for i in range(7)] == [True, False, True, True, False, False, True] and got[0].n_chars == len(got[0].text)


def test_mixing(spark, sf, rows):
    r = mixing.op9_mixing(spark, sf[0]).where("n_tokens < 1000").collect()
    assert len(r) == len(rows) - 1
    docs = spark.createDataFrame([x for x in rows if x[0] < 140], DOCS)
    model = mixing.train(docs, "lang")
    out = mixing.rates(docs, model, {"en": 3, "de": 1}).collect()
    total = {d: sum(x.rate * x.n_tokens * x.posterior[k] for x in out) for k, d in enumerate(model.domains)}
    assert abs(total["en"] / (total["en"] + total["de"]) - 0.75) < 0.01 and all(x.rate >= 0 for x in out)
    # The rates are the minimum: brute-force projected gradient with numpy comes to the same.
    n, p = np.array([x.n_tokens for x in out], float), np.array([x.posterior for x in out])
    a, w, rate = n / n.sum(), np.array([0.25, 0.75]), np.ones(len(n))
    share = a @ p
    for _ in range(300):
        rate = np.maximum(0, rate - (p @ (((a * rate) @ p - w) / share) + mixing.PULL * (rate - 1)) / (1 + mixing.PULL))
    assert np.abs(rate - [x.rate for x in out]).max() < 0.05
    # Rounding tells rows apart that have no key, or one key and text: the mean of their copies is the rate.
    same = spark.createDataFrame([(None if i % 2 else 7, rows[0][1], "en", "a", 0) for i in range(2000)] + [x for x in rows if x[0] < 140], DOCS)
    rated = mixing.rates(same, model, {"en": 3, "de": 1}).where("doc_id is null or doc_id = 7").groupBy("doc_id").agg(F.avg("copies").alias("copies"), F.avg("rate").alias("rate")).collect()
    assert len(rated) == 2 and all(abs(x.copies - x.rate) < 0.06 for x in rated)


def test_pipeline(spark, sf, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_first(spark, docs, sf[0])
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({301, 303})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf[0]).columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf[0]).collect()
    assert out and all(r.decoded == (r.text or "") and r.n_tokens * 4 == len(r.ids) for r in out)


def test_secrets_unquoted(spark):
    """Unquoted, short, dotted and named by long names."""
    key = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    jwt = f"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx.{key[3]}_-x"
    t = [(i, f"some words AUTH_TOKEN={key[i]} more", key[i]) for i in range(20)] + [(20 + i, f"x api_key={key[20 + i]}", key[20 + i]) for i in range(10)]
    t += [(50, "export DB_PASSWORD=hunter2x now", "hunter2x"), (51, 'password: "p@ss,w0rd"', "p@ss,w0rd"), (52, f"token={jwt}. Next", jwt), (53, f'"AWS_SECRET_ACCESS_KEY": "{key[4]}"', key[4])]
    t += [(54, f"MY_SERVICE2_ACCESS_TOKEN={key[5]}", key[5]), (55, f"auth: token={key[6]}==", key[6] + "=="), (56, f"wait...{key[39]}", key[39]), (57, "https://a.b/c?id=1&token=ab12cd34&x=1", "ab12cd34")]
    docs = spark.createDataFrame([(i, x, "a") for i, x, _ in t], "doc_id long, text string, source string")
    got = {(r.doc_id, r.candidate): r for r in secrets.scan(docs).collect()}
    assert all((i, c) in got for i, _, c in t), [(i, c) for i, _, c in t if (i, c) not in got]
    assert [i for i, _, c in t if i != 56 and not got[i, c].secret] == []
    assert got[0, key[0]].before.endswith("AUTH_TOKEN=") and not any(c.startswith(("AUTH", "api_key", "token")) for _, c in got)


def test_secrets_not_values(spark):
    """Counts, names and variables are no secrets; a short secret is masked where it is a value only."""
    t = [(i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" more', "a", 0) for i in range(30)]
    t += [(40, "author=john4242 max_tokens: 100000 token_count=123456 password=$DB_PASS1 password=get_pass1(x)", "a", 0), (42, "In 2024 pwd=2024 and 2024", "a", 0)]
    docs = spark.createDataFrame(t, "doc_id long, text string, source string, n_chars long")
    got = {(r.doc_id, r.candidate): r.secret for r in secrets.scan(docs).collect()}
    assert not [k for k in got if k[0] == 40]
    out = {r.doc_id: r.text for r in secrets.mask(spark, docs, "").collect()}
    assert all(out[i] == f'token = "{secrets.MASK}" more' for i in range(30)) and out[40] == t[30][1]
    assert out[42] in (t[31][1], f"In 2024 pwd={secrets.MASK} and 2024")


def test_imatch_repeats(spark, rows, tmp_path):
    """Repeated rows have the fingerprints of single ones, a row for each row; of an id's texts, each is a document."""
    rows = [x for x in rows if x[0] < 140]
    times = {1: 2, 2: 3, 30: 2}
    more = [x for x in rows for _ in range(times.get(x[0], 1))] + [(20, "another text of walking in the house", "en", "a", 0)]
    for name, table in (("once", rows), ("more", more)):
        spark.createDataFrame(table, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    # The band is of shares of documents; the same lexicon is taken for both.
    lex = imatch.lexicon(spark.createDataFrame(rows, DOCS), most_share=0.9).collect()
    fixed = spark.createDataFrame(lex, "hash long, df long, idf double, subsets array<int>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(imatch, "lexicon", lambda docs, *a, **k: fixed)
        once = {r.doc_id: r for r in imatch.op10_imatch(spark, f"{tmp_path}/once").collect()}
        got = imatch.op10_imatch(spark, f"{tmp_path}/more").collect()
        prints = imatch.fingerprints(spark.createDataFrame(more, DOCS)).collect()
    of = lambda i: [r for r in got if r.doc_id == i]
    assert [len(of(i)) for i in (0, 1, 2, 3, 30, 31, 20, 21)] == [1, 2, 3, 1, 2, 1, 2, 1] and len(got) == len(more)
    assert set(once[1].fingerprint) != {"0"} and once[1].near_edited > 0
    for i in (0, 1, 2, 3, 30, 31):
        assert {tuple(r) for r in of(i)} == {tuple(once[i])}
    assert len({r.fingerprint for r in of(20)}) == 2
    order = sorted({(x[0], hashlib.sha256(x[1].encode()).digest(), x[1]) for x in more}, reverse=True)
    for k, (i, _, t) in enumerate(order):
        edited = hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][2][: len(t) // 2]).encode()).hexdigest()
        assert (len(t), edited) in {(r.n_chars, r.edited_sha256) for r in of(i)}
    assert sorted(r.doc_id for r in prints) == sorted(x[0] for x in more)
    assert all(r.fingerprint == once[r.doc_id].fingerprint for r in prints if r.doc_id != 20)


CASES = "doc_id long, text string, lang string, source string, n_chars long, _quality string, _hash int, _mixed int, _copy string"


def case_rows(rows):
    """Repeated rows, ids with several texts, null ids and texts, a very long text, and names that the stages might use themselves."""
    t = [x for x in rows if x[0] < 140 and x[1]]
    t += [t[0], t[0], (t[1][0], t[50][1] + " anders", "de", "b", 0), (None, t[3][1], "en", "a", 0), (None, "ein text ohne nummer und der fluß", "de", "b", 0), (None, "ein text ohne nummer und der fluß", "de", "b", 0), (None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "a", 0)]
    t += [(902, "house " * 300_000, "en", "a", 0), (903, t[0][1], "en", "a", 0)]
    return [(*x, "q", i, 1, "c") for i, x in enumerate(t)]


def test_stage_cases(spark, sf, rows):
    import corpus_pipeline

    t = case_rows(rows)
    docs = spark.createDataFrame(t, CASES).repartition(3)
    by = {x[6]: x for x in t}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf[0])
        if name != "tokens":
            assert out.columns == docs.columns, name
        got = out.collect()
        if name in ("quality", "secrets", "mixing"):
            assert all(by[r._hash][:2] == (r.doc_id, r.text) for r in got), name
        if name == "quality":  # equal texts stay or go together
            stay = {r._hash for r in got}
            assert all(len({x[6] in stay for x in t if x[1] == y[1]}) == 1 for y in t)
        if name == "secrets":
            assert len(got) == len(t)
        if name == "mixing":
            often = {}
            for r in got:
                often[r._hash] = often.get(r._hash, 0) + 1
            same = [often.get(x[6], 0) for x in t if x[1] == t[0][1]]  # of one rate, rounded for each row
            assert max(same) - min(same) <= 1
        if name == "simhash":
            texts = [r.text for r in got]
            assert len(texts) == len(set(texts)) and "ein text ohne nummer und der fluß" in texts
            assert {r.doc_id for r in got if r.text == t[0][1]} == {t[0][0]} and sum((r.text or "") == "" for r in got) == 1
        if name == "tokens":
            assert len(got) == len(t) and all(r.decoded == (r.text or "") for r in got)


def test_pipeline_empty(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf[1]).count() == 0


def test_simhash_groups(spark, rows):
    """Components against brute force, with repeated and null ids."""
    t = [(k, x) for k, x, *_ in case_rows(rows)]
    got = simhash.groups(spark.createDataFrame(t, "doc_id long, text string")).collect()
    fp = {x: simhash.fingerprint(x or "") for _, x in t}
    fps = sorted(set(fp.values()))
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for k, x in t:
        if k is not None:
            least[root[fp[x]]] = min(k, least.get(root[fp[x]], k))
    want = sorted([(k, fp[x], least.get(root[fp[x]])) for k, x in t], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_operators_on_cases(spark, rows, tmp_path):
    """Every query over documents on the cases: a row for each row, equal texts with equal results."""
    t = case_rows(rows)
    spark.createDataFrame(t, CASES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i < 140] + [(None, 1, 0), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for op, cols in ((langid.op2_language, ["lang_pred", "score"]), (quality.op4_quality, ["score", "predicted"]), (simhash.op5_simhash, ["fingerprint"]), (licenses.op7_licenses, ["n_words", "labels"]), (mixing.op9_mixing, ["n_tokens", "domain", "rate"]), (secrets.op1_secrets, ["n_candidates", "n_secrets"]), (substring.op8_substring, ["n_words"])):
        got = op(spark, str(tmp_path)).collect()
        assert len(got) == len(t), op.__name__
        nulls = [r for r in got if r.doc_id is None]
        assert len(nulls) == sum(x[0] is None for x in t) and all(r[c] is not None for r in nulls for c in cols), op.__name__


def test_mixing_letters(spark):
    """Words with capital letters beyond ASCII are learnt and looked up alike."""
    docs = spark.createDataFrame([(i, "ÜBER Über Été STRASSE" if i % 2 else "the of AND", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    m = mixing.train(docs, "lang")
    n, p = m.posterior("ÜBER", mixing._KNOWN)
    assert n == 1 and p[m.domains.index("de")] > 0.9


def test_components_unfinished(spark):
    from sheaf.operators.components import connected_components

    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, tgt long"), max_rounds=2)
