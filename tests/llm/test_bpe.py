import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
from sheaf.llm import bpe  # noqa: E402

P = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def both():
    return bpe.automaton(bpe.load(P)), tokenizers.Tokenizer.from_file(P)


def same(both, text):
    a, t = both
    got = list(memoryview(a.encode(text)).cast("I"))
    want = t.encode(text, add_special_tokens=False).ids
    assert got == want, text
    assert a.decode(a.encode(text)) == t.decode(want, skip_special_tokens=False)


def test_texts(both):
    for x in ("", " ", "aaa" * 9, "  hello   world's \n\n tab\t", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "日本語 テキスト", "\U0001f600 x‍", "՘a՘", "é" * 50, "x" * 3000, "    " * 500 + "a", "\x00\x1c\x85  "):
        same(both, x)


def test_random(both):
    r = random.Random(3)
    pools = ["abcdehilnorstu ", "aé ñüß 日本 \n\t'", [chr(c) for c in range(32, 1200)], [chr(c) for c in range(0x1F000, 0x1F9FF)], "aA0 -=_/\\\"'.,!?<|>"]
    for _ in range(3000):
        p = r.choice(pools)
        same(both, "".join(r.choice(p) for _ in range(r.randint(1, 60))))


def test_operator(spark, tmp_path):
    rows = [(1, "under the sea", "x"), (2, None, "x"), (3, "", None), (3, "", None), (4, "word " * 20000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bpe string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op3_bpe(spark, str(tmp_path)).collect()}
    t = tokenizers.Tokenizer.from_file(P)
    want = set()
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == want
    out = bpe.encode_decode(df, P).withColumn("a", bpe.ids_array("bpe.ids"))
    assert out.where("doc_id = 1").first().a == t.encode("under the sea").ids
    assert bpe.encode_decode(df.limit(0), P).count() == 0


def test_not_kept():
    """A task of the pipeline lets go of its automaton; one of the operator alone leaves it to the next."""
    import pyarrow as pa
    from types import SimpleNamespace

    spec, texts = SimpleNamespace(value=bpe.load(bpe.default_vocabulary())), pa.array(["some text", None])
    before = bpe.automaton.cache_info().currsize
    alone = list(bpe._encoded(spec, 7, False)(iter([texts, texts])))
    assert bpe.automaton.cache_info().currsize == before
    assert alone == list(bpe._encoded(spec, 7, True)(iter([texts, texts]))) and bpe.automaton.cache_info().misses
