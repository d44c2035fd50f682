"""The nearest vectors by matrix products, against plain sums over all pairs."""

import math
import random

import pytest

from sheaf.operators import search


def fold(a, b, f):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    s = 0.0
    for x, y in zip(a, b):
        s += f(x, y)
    return s


PRODUCT = lambda x, y: x * y
HOW = {"cosine": lambda a, b: None if (s := fold(a, b, PRODUCT)) is None else s / math.sqrt(fold(a, a, PRODUCT) * fold(b, b, PRODUCT)), "l2": lambda a, b: fold(a, b, lambda x, y: (x - y) * (x - y))}


@pytest.fixture
def vectors(spark):
    """Copies, near copies, ties over several groups, vectors that are null, short or hold nulls, a null group."""
    r = random.Random(3)
    base = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, [x + (i % 7 == 0) * 1e-9 for x in base[i % 60]], i % 3 if i % 11 else None) for i in range(400)] + [(400, None, 1), (401, [1.0], 2), (402, [None] + [1.0] * 7, 0)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def test_nearest(spark, vectors, monkeypatch):
    """All pairs were shuffled and ranked, each summed by an expression over its two arrays."""
    monkeypatch.setattr(search, "TILE", 64)
    rows, df = vectors
    asked = [(i, v) for i, v, _ in rows if i % 40 == 0 or i == 401]
    q = spark.createDataFrame(asked, "q_id bigint, qv array<double>")
    got = search.top_by_cosine(q, df).collect()
    best = {}
    for q_id, qv in asked:
        for i, v, label in rows:
            best.setdefault((q_id, label), []).append((HOW["cosine"](qv, v), i))
    key = lambda s, i: (s is None, -round(s, 6) if s is not None else 0, i)
    want = {(q_id, label, i, n) for (q_id, label), of in best.items() for n, (s, i) in enumerate(sorted(of, key=lambda x: key(*x))[:5], 1)}
    assert {(x.q_id, x.label, x.vec_id, x["rank"]) for x in got} == want
    plain = [(i, v) for i, v in asked if v and len(v) == 8]
    near = search.top_by_l2(spark.createDataFrame(plain, "q_id bigint, qv array<double>"), df.where("vec_id < 400")).collect()
    far = {(q_id, i): HOW["l2"](qv, v) for q_id, qv in plain for i, v, _ in rows[:400]}
    assert {(x.q_id, x.vec_id, x["rank"]) for x in near} == {(q_id, i, n) for q_id, _ in plain for n, i in enumerate(sorted(range(400), key=lambda i: (round(far[q_id, i], 6), i))[:5], 1)}
    some = search.candidates(spark.createDataFrame(plain, "q_id bigint, qv array<double>"), df.where("vec_id < 400"), "vec_id", "embedding", None, 5, "l2").count()
    assert some < len(plain) * 400 / 4


def test_keys_of_any_type(spark):
    """Names as keys; what has nothing in common isn't ranked; no rows, no pairs."""
    q = spark.createDataFrame([("a", "red ring"), ("b", "none")], "q_id string, query string")
    c = spark.createDataFrame([("x", "red ring"), ("w", "red ring"), ("v", "ring"), ("u", None)], "name string, text string")
    got = search.by_embedding(q, c, "name", "text", k=2).orderBy("q_id", "rank").collect()
    assert [(x.q_id, x.name, x.cosine, x["rank"]) for x in got if x.q_id == "a"] == [("a", "w", 1.0, 1), ("a", "x", 1.0, 2)]
    assert not search.by_embedding(q, c.where("false"), "name", "text").collect() and not search.by_embedding(q.where("false"), c, "name", "text").collect()


def test_nearest_in_lists(spark, vectors, monkeypatch):
    """All pairs of a list were summed by an expression and shuffled (F15): tiles of a list meet its queries alone, and only what may be among the best goes on. Odd vectors meet those of their list too."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(search, "TILE", 32)
    rows, df = vectors
    df = df.withColumn("list", F.pmod("vec_id", F.lit(5)).cast("int")).repartition(2).sortWithinPartitions("list")
    asked = [(i, v, n) for i, v, _ in rows if i % 20 == 0 or i == 401 for n in (i % 5, (i + 2) % 5)]
    q = spark.createDataFrame(asked, "q_id bigint, qv array<double>, list int")
    out = search.candidates(q, df, "vec_id", "embedding", None, 3, "inner", "list").collect()
    dots = {(i, j): fold(a, b, PRODUCT) for i, a, n in asked for j, b, _ in rows if j % 5 == n}
    got = {(r.q_id, r.key): r.raw for r in out}
    assert len(out) == len(got) and got.items() <= dots.items()
    best = lambda d, i: sorted(((s, j) for (q_id, j), s in d.items() if q_id == i and s is not None), key=lambda x: (-x[0], x[1]))[:3]
    for i in {i for i, *_ in asked}:
        assert best(got, i) == best(dots, i), i
    plain = {p for p in dots if p[0] < 400 and p[1] < 400}
    assert len(plain & got.keys()) < len(plain) / 3
