"""Paths of any length and names within texts, against brute force."""

import random

import pytest

from sheaf.operators import graph


def shortest(edges, a, b):
    near = {}
    for u, v in edges:
        if u is not None and v is not None:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    if a is None or b is None:
        return None
    level, seen = {a: [a]}, {a}
    while level:
        if b in level:
            return level[b]
        step = {}
        for u, path in level.items():
            for v in near.get(u, ()):
                if v not in seen:
                    step[v] = min(step.get(v, [*path, v]), [*path, v])
        seen |= set(step)
        level = step
    return None


def test_shortest_paths(spark):
    """Random graphs with ties, loops and repeats; ends that are alike, apart, unknown or null."""
    r = random.Random(1)
    edges = [(f"n{r.randint(0, 25)}", f"n{r.randint(0, 25)}") for _ in range(32)] + [("x", "y"), (None, "n1"), ("n2", "n2")]
    pairs = [(f"n{r.randint(0, 25)}", f"n{r.randint(0, 25)}") for _ in range(25)] + [("n1", "x"), ("x", "y"), ("n3", "n3"), ("no", "n1"), ("no", "no"), (None, "n1"), ("n1", None)]
    e, p = spark.createDataFrame(edges, "src string, tgt string"), spark.createDataFrame(pairs, "start string, end string")
    got = {(x.start, x.end): x.path for x in graph.shortest_path(e, p).collect()}
    assert got == {(a, b): shortest(edges, a, b) for a, b in pairs}
    some = {(x.start, x.end): x.path for x in graph.shortest_path(e, p, most=3).collect()}
    assert some == {k: v if v and len(v) <= 4 else None for k, v in got.items()} and some != got


def test_long_path(spark):
    """A path of 45 steps beside shorter ones."""
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(45)]
    e = spark.createDataFrame(chain + [("c045", "z")], "src string, tgt string")
    p = spark.createDataFrame([("c000", "c045"), ("c000", "c001"), ("c000", "none")], "start string, end string")
    got = {x.end: x.path for x in graph.shortest_path(e, p).collect()}
    assert got["c045"] == [f"c{i:03}" for i in range(46)] and got["c001"] == ["c000", "c001"] and got["none"] is None


def test_names_in_texts(spark):
    """Texts that hold others, of every length, the empty one too; no plan compares all with all."""
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abAé #") for _ in range(r.randint(0, n)))
    whole, part = [(i, text(14)) for i in range(120)] + [(500, None)], [(i, text(7)) for i in range(60)] + [(600, None), (601, "")]
    df = graph.holding(spark.createDataFrame(whole, "k int, text string"), spark.createDataFrame(part, "p int, text string"))
    assert sorted(map(tuple, df.collect())) == sorted((k, p) for k, a in whole for p, b in part if a is not None and b is not None and b.lower() in a.lower())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_paths_share_their_ends(spark, monkeypatch):
    """One start and many ends around two hubs: nodes were kept for each pair, so the square of what a hub holds."""
    rows, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (back := kept(df), rows.append(back.count()))[0])
    edges = [(f"a{i}", "h") for i in range(300)] + [(f"b{i}", "k") for i in range(300)]
    e = spark.createDataFrame(edges, "src string, tgt string")
    got = graph.shortest_path(e, spark.createDataFrame([("a0", u) for u, _ in edges], "start string, end string")).collect()
    assert {(x.start, x.end): x.path for x in got} == {("a0", u): shortest(edges, "a0", u) for u, _ in edges}
    assert max(rows) <= 2 * len(edges)


def test_questions_share_their_neighbourhood(spark):
    """Questions with the same neighbourhood, by the same nodes or others, each had its members, edges and text made anew."""
    m = spark.createDataFrame([(1, n, "t", "d", "f") for n in "abcxy"], "chunk_id int, entity_name string, entity_type string, description string, file_path string")
    e = spark.createDataFrame([("a", "b", "d"), ("b", "c", "d"), ("x", "y", "d")], "src_id string, tgt_id string, description string")
    matched = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, "x"), (5, "b"), (5, "a")], "q_id int, entity_name string")
    which, texts = graph.neighbourhoods(matched, graph.merge_nodes(m), e)
    assert texts.count() == 2 and which.select("same").distinct().count() == 2
    got = {r.q_id: (r.n_nodes, r.n_edges, r.context) for r in graph.search(matched, graph.merge_nodes(m), e).collect()}
    abc = (3, 2, "a (t): d\nb (t): d\nc (t): d\na - b: d\nb - c: d")
    assert got == {1: abc, 2: abc, 3: abc, 4: (2, 1, "x (t): d\ny (t): d\nx - y: d"), 5: abc}


@pytest.mark.parametrize("without", [0, 104])
def test_long_texts_beside_many_questions(spark, tmp_path, without):
    """A task held a row with the text for each question of it at once, and a writer a hundred such rows, or more after those of questions without a text."""
    import pyarrow.parquet as pq

    said = "".join(random.Random(5).choices("abcdefghijklmnop", k=1 << 20))
    texts = spark.createDataFrame([(1, said)], "same long, context string")
    asked = spark.createDataFrame([(i, 1 if i < 96 else None) for i in range(96 + without)], "q_id long, same long")
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "parquet.block.size", "spark.sql.parquet.compression.codec")}
    try:
        for k, v in zip(kept, ("2", str(4 << 20), "none")):
            spark.conf.set(k, v)
        df = graph.beside(asked, texts)
        df.write.parquet(at := str(tmp_path / "out"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "LeftOuter" in plan and "BuildLeft" not in plan
    got = spark.read.parquet(at)
    assert {r.q_id: r.n for r in got.selectExpr("q_id", "length(context) AS n").collect()} == {i: 1 << 20 if i < 96 else None for i in range(96 + without)}
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    assert max(m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)) <= 8 << 20
