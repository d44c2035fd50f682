"""Byte-level BPE against the tiktoken library: ids, digests and round trips, on texts of every kind."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402

from sheaf.llm import byte_bpe  # noqa: E402

P = byte_bpe.default_ranks()
DOCS = "doc_id long, text string, ids string, _parts string"


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(byte_bpe.ranks_of(P))}, special_tokens={})


def texts():
    r = random.Random(3)
    pools = ["abcdehilnorstu ", "aé ñüß 日本 \n\t'", [chr(c) for c in range(32, 1200)], [chr(c) for c in range(0x1F000, 0x1F9FF)], "aA0 -=_/\\\"'.,!?<|>", [chr(c) for c in (0x558, 0x88F, 0x1C89, 0x10D40, 0x1138B, 0x378, 0x1C, 0x85, 0x3000, 0x61, 0x31)]]
    out = ["".join(r.choice(p) for _ in range(r.randint(1, 60))) for p in pools for _ in range(60)]
    out += ["", " ", None, "aaa" * 9, "  hello   world's \n\n tab\t", "<|endoftext|>", "word " * 20000, "x" * 100_000, "    " * 500 + "a", "\x00\x1c\x85  ", "日本語 テキスト" * 300, "é" * 1500]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (200, 1000, 1025, 5000)]
    return out + out[:5]


@pytest.mark.parametrize("kept", [600_000, 50])
def test_against_library(spark, known, kept):
    """The common words kept change nothing; rows repeat, and columns clash with the names used inside."""
    every = texts()
    df = spark.createDataFrame([(i, x, "old", "p") for i, x in enumerate(every)], DOCS)
    got = byte_bpe.decode(byte_bpe.encode(df, P, kept=kept), P)
    assert got.columns == ["doc_id", "text", "ids", "_parts", "decoded"]
    for r in got.collect():
        x = every[r.doc_id] or ""
        assert list(r.ids) == known.encode_ordinary(x), x[:80]
        assert bytes(r.decoded) == x.encode() and r._parts == "p"


def test_query(spark, known, tmp_path):
    rows = [(1, "under the sea"), (2, None), (3, ""), (3, ""), (None, "word " * 500), (4, "ünder—the“sea”")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted(repr((i, len(e := known.encode_ordinary(x or "")), digest(" ".join(map(str, e)).encode()), digest((x or "").encode()))) for i, x in rows)
    assert sorted(repr(tuple(r)) for r in byte_bpe.op11_bytes(spark, str(tmp_path)).collect()) == want
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(none, P), P).count() == 0


def test_long_merges(known):
    ranks = {b: i for i, b in enumerate(byte_bpe.ranks_of(P))}
    r = random.Random(1)
    for n in (1, 2, 3, 50, 2000):
        for pool in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz"):
            w = "".join(r.choice(pool) for _ in range(n))
            assert byte_bpe.long_merges(w.encode(), ranks) == known.encode_ordinary(w)


def test_ids_without_piece(spark):
    bad = spark.createDataFrame([([60000],)], "ids array<int>")
    with pytest.raises(Exception, match="without a piece"):
        byte_bpe.decode(bad, P).collect()
    assert bytes(byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), P).first().decoded) == b""


def test_plain_pattern():
    """Texts of the characters that the faster pattern knows have the same words by either."""
    r = random.Random(5)
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    for pool in (chars, chars[:256], list("ab1' \n\t.ésß½²-")):
        for _ in range(2000):
            x = "".join(r.choice(pool) for _ in range(r.randint(1, 40)))
            assert byte_bpe._ELSE.search(x) is None and byte_bpe._pieces(x) == byte_bpe._SPLIT.findall(x), x


def test_bad_ranks(tmp_path):
    (tmp_path / "x").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.ranks_of(str(tmp_path / "x"))
