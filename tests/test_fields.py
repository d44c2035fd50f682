"""Weighted fields scored in tiles: repeated keys, long words, several blocks and tiles, what is shuffled."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sheaf.operators import search
from sheaf.session import written

CHUNKS = "doc_id long, type string, content string, metadata string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def some(spark):
    r = random.Random(8)
    words = ["flash", "flashes", "point", "steel", "stel", "인화점", "a", "straße", "abc" * 30] + [f"w{i}" for i in range(30)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
    return spark.createDataFrame([(i, r.choice(["text", "image"]), line(), line()) for i in range(40)], CHUNKS), spark.createDataFrame([(i, f"{r.choice(words)} {r.choice(words)}") for i in range(9)], "q_id int, query string")


def test_repeated(spark):
    """Chunks of one key and branch are one field, as SQL groups them."""
    q = spark.createDataFrame([(1, "flash steel")], "q_id int, query string")
    rest = [(2, "text", "steel and a point", None), (3, "text", "other words", None)]
    two = spark.createDataFrame([(1, "text", "flash point", None), (1, "table", "steel a", None), *rest], CHUNKS)
    one = spark.createDataFrame([(1, "text", "flash point steel a", None), *rest], CHUNKS)
    assert rows(search.keyword_search(q, two)) == rows(search.keyword_search(q, one))


def test_blocks_and_tiles(spark, monkeypatch):
    """Which rows share a tile and which queries a block changes nothing; only what is ranked is shuffled."""
    chunks, queries = some(spark)
    whole = search.keyword_search(queries, chunks, k=5)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in plan
    want = rows(whole)
    monkeypatch.setattr(search, "ASKED", 3)
    assert want and rows(search.keyword_search(queries, chunks, k=5)) == want


def test_pairs(spark):
    """Against the terms of each word, those longer than LONG too."""
    r = random.Random(9)
    words = ["a", "ab", "😀é", "x" * search.LONG, "y" * (search.LONG + 1)] + ["".join(r.choice("abé😀") for _ in range(r.randint(1, 60))) for _ in range(200)]
    known = ["ab", "bé", "éé", "é😀", "a", "yy", "xx"]
    ws = pa.array(words)
    w, t = search._pairs_of(ws, np.asarray(pc.utf8_length(ws), np.int64), pa.array(known))
    want = sorted((i, known.index(p)) for i, x in enumerate(words) for c, p in search.terms_of(x) if c == "ko" and p in known)
    assert sorted(zip(w.tolist(), t.tolist(), strict=True)) == want


def test_columns_of():
    """As Spark's and the library's checksum, of slices and of words longer than LONG too."""
    r = random.Random(5)
    ws = ["".join(r.choice("abé😀ñ") for _ in range(r.randint(1, 60))) for _ in range(500)]
    for a in (pa.array(ws), pa.array(ws).slice(7, 90), pa.array([], pa.string())):
        assert search._columns_of(a).tolist() == [crc32(w.encode()) % search.COLUMNS for w in a.to_pylist()]


def test_slices():
    """Words of a slice of texts; none of null and empty ones."""
    texts = pa.array(["steel a", "", "인화점 flash flash", None, "a"])
    assert search._split(texts.slice(1)).to_pylist() == [None, ["인화점", "flash", "flash"], None, ["a"]]


def test_vocabulary_reads_what_is_fresh(spark):
    """The vocabulary is made of the words each task met first, not of all words; and is that of all words."""
    chunks, _ = some(spark)
    words = written(search.field_words(chunks, "doc_id"))
    known = search.vocabulary(words)
    assert "ReadSchema: struct<fresh:string>" in known._jdf.queryExecution().toString()
    texts = chunks.selectExpr("CASE WHEN type = 'text' THEN content ELSE metadata END AS text")
    want = {w for r in texts.collect() for w in r.text.lower().split()}
    assert rows(known) == sorted((w, search.stem(w)) for w in want)
    assert rows(search.with_fresh(words.drop("fresh")).selectExpr("explode(split(fresh, ' ')) AS w").where("w <> ''").distinct()) == sorted((w,) for w in want)


def test_beside_tiles_as_bytes(spark, monkeypatch):
    """A block, which has as many rows as there are stems near its queries, goes to each tile as bytes and not as rows."""
    chunks, queries = some(spark)
    kinds = []
    monkeypatch.setattr(search, "written", lambda df: kinds.append(dict(df.dtypes)) or written(df))
    search.keyword_search(queries, chunks, k=5)
    blocks = [k for k in kinds if "block" in k and "wanted" in k]
    assert len(blocks) == 2 and all(k[c] == "binary" for k in blocks for c in k if c != "block")


def test_least_terms(spark):
    """How many of a query's words a field holds: one word near two of them counts for both, one that is there twice for one."""
    chunks = spark.createDataFrame([(1, "text", "flashes and flash", None), (2, "text", "flash point", None), (3, "text", "steels", None), (4, "image", "flash point", "a point of steel")], CHUNKS)
    queries = spark.createDataFrame([(1, "flash point"), (2, "steel steeel"), (3, "steel point")], "q_id int, query string")
    assert sorted((r.q_id, r.doc_id) for r in search.keyword_search(queries, chunks, least_terms=2).collect()) == [(1, 2), (2, 3), (2, 4), (3, 4)]


def test_blocks_are_sent_once(spark):
    """A block went beside every tile as a row, which grows with the vocabulary."""
    chunks, queries = some(spark)
    plan = search.keyword_search(queries, chunks, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "wanted" not in plan


def test_tiles_by_bytes_and_fields_in_turn(monkeypatch):
    """A tile was as large as its rows are on average in their batch; all its fields were counted at once."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "TILE_WORDS", 100)
    sizes = [1] * 50 + [60, 60, 300, 30, 30, 30, 40, 101, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["content"] * len(sizes)), pa.array([[1, 1, 1]] * len(sizes)), pa.array(["x" * n for n in sizes])], ["key", "branch", "lens", "ws"])
    tiles = [t.column(3)[0].as_py() for t in search._tiles(iter([batch, batch]))]
    assert [len(w) for t in tiles for w in t] == 2 * sizes
    assert all(sum(map(len, t)) <= 100 or len(t) == 1 for t in tiles)
    r = np.random.default_rng(2)
    row = np.sort(r.integers(0, 20, 300))
    code, times = r.integers(0, 30, 300), r.integers(1, 4, 300)
    first = np.concatenate([[0], np.cumsum(r.integers(0, 5, 30))])
    t, n = r.integers(0, 9, first[-1]), r.integers(1, 3, first[-1])
    whole = search._expanded(row, code, times, first, t, n, 9)
    want = {}
    for i, c, k in zip(row, code, times):
        for j in range(first[c], first[c + 1]):
            want[i, t[j]] = want.get((i, t[j]), 0) + k * n[j]
    assert list(zip(*whole)) == [(*k, want[k]) for k in sorted(want)]
    for most in (1, 7, 100, 10**6):
        monkeypatch.setattr(search, "EXPANDED", most)
        assert all((a == b).all() for a, b in zip(search._expanded(row, code, times, first, t, n, 9), whole))
