"""Hard negatives against brute force and SQL: ties, repeats, nulls, several lengths, scores of zero and below, very large ones, blocks of anchors."""

import math
import random

import pytest

from sheaf.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, a int"


def brute(rows):
    fine = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = []
    for k, (a, label, v) in enumerate(fine):
        if a is None or a % 100:
            continue
        others = [(-clip(sum(x * y for x, y in zip(v, w))), i is None, i or 0, m == label) for n, (i, m, w) in enumerate(fine) if n != k and len(w) == len(v)]
        others.sort()
        for s, none, i, same in [x for x in others if x[3]][:5]:
            met = [x for x in others if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, None if none else i, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(met, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def some(seed, n=400, dims=6):
    r = random.Random(seed)
    return [(i, [r.choice([r.gauss(0, 1), 0.5, -0.25]) for _ in range(dims)], r.randrange(4), "x", 1) for i in range(n)]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    moved = negatives.F.when(negatives.F.col("vec_id") % 7 == 0, (negatives.F.col("label") + 1) % 10).otherwise(negatives.F.col("label"))
    return got(negatives.hard_negatives(df.withColumn("label", moved), "vec_id % 100 = 0", **how))


@pytest.mark.parametrize("block", [negatives.BLOCK, 1])
def test_brute_force(spark, block):
    rows = some(1)
    want = brute(rows)
    assert run(spark, rows, block=block) == want and len(want) > 50


def test_cases(spark, monkeypatch):
    """Nulls and non-finite components, two lengths, equal vectors, repeated and null ids; scores held a few at a time."""
    monkeypatch.setattr(negatives, "AT_ONCE", 50)
    rows = some(2, 150) + [(200, [1.0, 2.0], 1, "x", 1), (201, [1.0, 1.5], 1, "x", 1), (202, [0.5, 0.5], 2, "x", 1), (203, [], 2, "x", 1), (300, [], 2, "x", 1)]
    rows += [(400, None, 1, "x", 1), (401, [1.0, None], 1, "x", 1), (402, [1.0, float("inf")], 2, "x", 1), (403, [1.0, 2.0], None, "x", 1), (None, [0.9, 0.9], 2, "x", 1), (None, [1.0, 1.0], 1, "x", 1)]
    rows += [(200, [1.0, 2.0], 1, "x", 1), (202, [0.5, 0.5], 2, "x", 1), (205, [0.5, 0.5], 3, "x", 1)] + [(500 + i, [0.3, 0.4], i % 3, "x", 1) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_zero_and_below(spark):
    """A positive's score of zero admits scores of zero, those of smaller ids too; one below zero admits none."""
    rows = [(100, [1.0, 0.0], 1, "x", 1), (101, [0.0, 5.0], 2, "x", 1), (102, [0.0, 1.0], 1, "x", 1), (103, [0.0, 2.0], 2, "x", 1), (104, [-1.0, 0.0], 1, "x", 1), (106, [-0.5, 0.0], 2, "x", 1)]
    want = brute(rows)
    assert run(spark, rows) == want == [(100, 102, 1, 101, 0, 0), (100, 102, 2, 103, 0, 0)]


def test_large(spark):
    """Products beyond what doubles, and beyond what 64 bits, hold exactly."""
    rows = [(100, [2.0**20 + 1, 3.0], 1, "x", 1), (101, [2.0**25 + 1, 7.0], 1, "x", 1), (102, [2.0**24 + 3, 5.0], 2, "x", 1), (103, [1e30, 1.0], 1, "x", 1), (104, [2.0**24 + 3, 5.5], 2, "x", 1), (105, [1e307, 0.0], 1, "x", 1)]
    assert run(spark, rows[:5]) == brute(rows[:5]) and run(spark, rows) == brute(rows[:5])


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1, "x", 1)]) == [] and run(spark, [(100, [1.0], 1, "x", 1)]) == []


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    at = "/root/testdata/sf0.01"
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    df = negatives.op13_negatives(spark, at)
    rel = c.sql(negatives.op13_sql())
    assert df.columns == rel.columns
    rows = got(df)
    assert rows and rows == sorted(rel.fetchall(), key=repr)
