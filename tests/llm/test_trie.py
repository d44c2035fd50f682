"""The prefix trie against brute force and its SQL: shared and lone tails, nulls, ties, repeats, conversations cut by partitions, a sketch too small to prove anything."""

import hashlib
import random
import re
import zlib

import pytest

from sheaf.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, alone boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows, base, taken):
    """The turns of each conversation; of tied turns those of equal role and text only are used here."""
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    return {c: own.get(base(c), [])[: taken(c)] + v[taken(c) :] for c, v in own.items()}


def brute(convs):
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault((d, tuple(v[:d])), []).append(c)
    children = {}
    for d, k in members:
        if d:
            children.setdefault((d - 1, k[:-1]), []).append((d, k))
    leaves, saved = {}, {}
    for d, k in sorted(members, key=lambda n: -n[0]):
        below = children.get((d, k), [])
        leaves[d, k] = sum(leaves[x] for x in below) or 1
        saved[d, k] = sum(saved[x] for x in below) + (d and (len(members[d, k]) - 1) * len(WORD.findall(k[-1][1])))
    out = []
    for (d, k), m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == d)))
        up = min(members[d - 1, k[:-1]]) if d else None
        out.append((min(m), d, up, len(m), len(children.get((d, k), [])), leaves[d, k], saved[d, k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def some(seed, n=60, most=7, ids=lambda r, i: i):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        c = ids(r, i)
        for t in range(r.randint(1, most)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "a  b c", "", None, "x" * 50, f"only {c} {t}"]), "z", True))
    r.shuffle(rows)
    return rows


def got(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


GRAFT = {"base": lambda c: c - c % 20, "taken": lambda c: trie.F.crc32(c.cast("string")) % 4}
BASE, TAKEN = lambda c: c - (c % 20 if c >= 0 else -(-c % 20)), lambda c: zlib.crc32(str(c).encode()) % 4


@pytest.mark.parametrize("cells", [trie.CELLS, 3])
def test_brute_force(spark, cells):
    """With a sketch of eight cells nothing is proven alone, and the result is the same."""
    rows = some(1)
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA), cells=cells)) == brute(rebuilt(rows, lambda c: c, lambda c: 0))


@pytest.mark.parametrize("seed", [2, 3])
def test_rebuilt(spark, tmp_path, seed):
    """Ids of either sign with absent bases, conversations shorter than what they take, null ids and turns."""
    rows = some(seed, 80, 5, lambda r, i: r.randint(-70, 120))
    rows = list({(c, t): (c, t, *x) for c, t, *x in rows}.values())
    rows += [(40, None, "user", "null turn", "z", False), (None, 1, "user", "x", "z", None), (13, 7, "user", "again", "z", None), (13, 7, "user", "again", "z", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(trie.op12_trie(spark, str(tmp_path))) == brute(rebuilt(rows, BASE, TAKEN))


def test_cut_conversations(spark, monkeypatch):
    """Conversations and bases of many turns, spread over partitions of a few rows."""
    monkeypatch.setattr(trie, "ROWS", 7)
    rows = some(4, 25, 4)
    rows += [(c, t, "user", f"turn {t % 5}", "z", True) for c in (100, 103, 105, 117, 118, 119, 120) for t in range(100, 140)]
    rows = list({(c, t): (c, t, *x) for c, t, *x in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.trie(df, **GRAFT)) == brute(rebuilt(rows, BASE, TAKEN))
    assert got(trie.trie(df)) == brute(rebuilt(rows, lambda c: c, lambda c: 0))


def test_copies(spark):
    """Many copies of one conversation, and one that all begin with."""
    rows = [(c, t, "u", f"w{t} w", "z", True) for c in range(300) for t in range(3)] + [(c, t, "u", f"w{t} w" if t < 2 else f"own {c}", "z", True) for c in range(300, 400) for t in range(4)]
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows, lambda c: c, lambda c: 0))


def test_empty(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", "z", True)], SCHEMA)).count() == 0
    one = got(trie.trie(spark.createDataFrame([(5, None, None, None, "z", True)], SCHEMA)))
    assert one == brute({5: [("", "")]})


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet'")
    rel = c.sql(trie.op12_sql())
    df = trie.op12_trie(spark, at)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
