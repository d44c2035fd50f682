"""Prefix trie of conversations: every distinct sequence of first turns is a node.

Turns are sorted once over range partitions, so that a conversation of any length is spread; what one partition must know of those before it
(how far the conversation that it cuts has come) is worked out from a row for each partition. A prefix is known by a
polynomial in its turns' digests, which are running sums along a conversation.

A count-min sketch of all prefixes, whose cells count to two, screens them: where some cell of a prefix counts one, the
prefix stands in one conversation only, and so do those that go on from it. These tails are emitted where they stand. Only the others, possibly shared, are
shuffled to be grouped exactly.

Sums over subtrees need no walk: each node belongs to its smallest member, which from some depth on owns all its prefixes. A
subtree's distinct words, leaves and children are then sums over the members of its top, each counting what it owns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table
from sheaf.session import cut, discard, written

WORD = r"[^\x20\x09-\x0D]+"
#: Odd multipliers of the two lanes of a prefix's digest.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOD = 1 << 64
#: Turns that a conversation may take from its base.
MOST = 3
#: Turns of a partition.
ROWS = 500_000
#: Cells of a lane of the sketch, as a power of two: at most 16 MB of bits each are sent to the tasks.
CELLS = 27
PREFIX = "c bigint, d bigint, p1 bigint, p2 bigint, len bigint, upto bigint, own bigint, total bigint"
NODE = ["d", "p1", "p2"]


def _powers(base: int, exponent: np.ndarray) -> np.ndarray:
    out, e, b = np.ones(len(exponent), np.uint64), exponent.copy(), base
    while e.any():
        out = np.where(e & 1, out * np.uint64(b), out)
        e >>= 1
        b = b * b % MOD
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """The columns of a partition, which holds about ROWS rows."""
    got = [b for b in batches if b.num_rows]
    return {k: v.combine_chunks().to_numpy() for k, v in zip(got[0].schema.names, pa.Table.from_batches(got).columns, strict=True)} if got else None


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return start, np.diff(np.append(start, len(c)))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition: its first and last conversation (turns, words, first turns, digest as if it began here), the base of its last."""
    x = _gathered(batches)
    if x is None:
        return
    c, u = x["c"], [x[k].view(np.uint64) for k in ("a1", "a2")]
    start, size = _runs(c)

    def of(s: int, n: int) -> dict:
        at = slice(s, s + n)
        k = np.arange(1, n + 1)
        poly = [int((u[j][at] * _powers(LANES[j], k)).sum()) for j in (0, 1)]
        return {"c": int(c[s]), "h": int(x["h"][s]), "n": n, "w": int(x["w"][at].sum()), "heads": heads(s, n), "poly": [str(p) for p in poly]}

    heads = lambda s, n: [[str(int(u[0][i])), str(int(u[1][i])), str(int(x["w"][i]))] for i in range(s, s + min(n, MOST))]
    b = int(x["b"][-1])
    of_base = np.flatnonzero(c[start] == b)
    base = heads(int(start[of_base[0]]), int(size[of_base[0]])) if len(of_base) else []
    row = {"pid": int(x["pid"][0]), "first_b": int(x["b"][0]), "last_b": b, "base": base, "first": of(int(start[0]), int(size[0])), "last": of(int(start[-1]), int(size[-1])), "runs": len(start)}
    yield pa.RecordBatch.from_pylist([row], schema=SUMMARY)


_HEADS = pa.list_(pa.list_(pa.string()))
_RUN = pa.struct([("c", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("w", pa.int64()), ("heads", _HEADS), ("poly", pa.list_(pa.string()))])
SUMMARY = pa.schema([("pid", pa.int64()), ("first_b", pa.int64()), ("last_b", pa.int64()), ("base", _HEADS), ("first", _RUN), ("last", _RUN), ("runs", pa.int64())])
_RUN_SQL = "struct<c:bigint,h:bigint,n:bigint,w:bigint,heads:array<array<string>>,poly:array<string>>"
SUMMARY_SQL = f"pid bigint, first_b bigint, last_b bigint, base array<array<string>>, first {_RUN_SQL}, last {_RUN_SQL}, runs bigint"


def _carried(parts: list) -> dict[int, dict]:
    """For each partition, from the summaries of all in order: what is known of the conversations and bases that its ends cut."""
    whole, base, out = {}, {}, {}
    ints = lambda rows: [[int(v) for v in r] for r in rows]
    for p in parts:
        for run in (p["first"], p["last"])[: min(2, p["runs"])]:
            w = whole.setdefault(run["c"], {"n": 0, "w": 0, "heads": []})
            w["n"], w["w"] = w["n"] + run["n"], w["w"] + run["w"]
            w["heads"] = (w["heads"] + ints(run["heads"]))[:MOST]
        base[p["last_b"]] = (base.get(p["last_b"], []) + ints(p["base"]))[:MOST]
    state = None  # of the conversation last seen: c, turns so far, digest and words of its prefix
    for p in parts:
        f = p["first"]
        goes_on = state is not None and state["c"] == f["c"]
        out[p["pid"]] = {"begun": state if goes_on else None, "whole": {r["c"]: whole[r["c"]] for r in (f, p["last"])}, "base": {b: base[b] for b in (p["first_b"], p["last_b"]) if b in base}}
        run = f if p["runs"] == 1 else p["last"]
        b = p["last_b"]
        heads = base[b]
        h = 0 if run["c"] == b else run["h"]
        taken = min(h, len(heads))
        so_far = state["n"] if goes_on and p["runs"] == 1 else 0
        digest = list(state["digest"]) if so_far else [sum(heads[k][j] * pow(LANES[j], k + 1, MOD) for k in range(taken)) % MOD for j in (0, 1)]
        words = state["words"] if so_far else sum(x[2] for x in heads[:taken])
        gone = run["heads"][: max(0, min(h - so_far, run["n"]))]
        for j in (0, 1):
            left_out = sum(int(x[j]) * pow(LANES[j], k + 1, MOD) for k, x in enumerate(gone))
            digest[j] = (digest[j] + (int(run["poly"][j]) - left_out) * pow(LANES[j], so_far - (h - taken), MOD)) % MOD
        words += run["w"] - sum(int(x[2]) for x in gone)
        state = {"c": run["c"], "n": so_far + run["n"], "digest": digest, "words": words}
    return out


def _prefixes(carried):
    """A row for each prefix of the rebuilt conversations, the empty one too, in order of conversation and depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _gathered(batches)
        if x is None:
            return
        known = carried.value[int(x["pid"][0])]
        c, b, w, u = x["c"], x["b"], x["w"], [x[k].view(np.uint64) for k in ("a1", "a2")]
        start, size = _runs(c)
        conv, group = c[start], b[start]
        h = np.where(conv == group, 0, x["h"][start])
        # The first turns of each base in sight.
        groups, of = np.unique(group, return_inverse=True)
        head, count = np.zeros((3, len(groups), MOST), np.uint64), np.zeros(len(groups), np.int64)
        for k in np.flatnonzero(conv == group):
            s, n = start[k], min(size[k], MOST)
            head[0, of[k], :n], head[1, of[k], :n], head[2, of[k], :n], count[of[k]] = u[0][s : s + n], u[1][s : s + n], w[s : s + n].astype(np.uint64), n
        for g, rows in known["base"].items():
            if (at := np.searchsorted(groups, g)) < len(groups) and groups[at] == g and rows:
                head[:, at, : len(rows)] = np.array(rows, dtype=object).T.astype(np.uint64)
                count[at] = len(rows)
        taken = np.minimum(h, count[of])
        shift = h - taken
        power = [np.array([pow(m, k + 1, MOD) for k in range(MOST)], np.uint64) for m in LANES]
        upto = [np.concatenate([np.zeros((len(groups), 1), np.uint64), np.cumsum(head[j] * power[j], axis=1, dtype=np.uint64)], 1) for j in (0, 1)]
        upto.append(np.concatenate([np.zeros((len(groups), 1), np.uint64), np.cumsum(head[2], axis=1, dtype=np.uint64)], 1))
        begin = [upto[j][of, taken] for j in (0, 1, 2)]  # what a conversation has before its own turns
        before = np.zeros(len(conv), np.int64)
        turns, words = size.copy(), np.add.reduceat(w, start)
        skipped = np.array([w[s : s + min(n, k)].sum() for s, n, k in zip(start, size, h, strict=True)], np.int64)
        for k in {0, len(conv) - 1}:
            full = known["whole"][int(conv[k])]
            turns[k], words[k], skipped[k] = full["n"], full["w"], sum(r[2] for r in full["heads"][: h[k]])
        total = begin[2].astype(np.int64) + words - skipped
        length = taken + np.maximum(0, turns - h)
        if known["begun"]:
            before[0] = known["begun"]["n"]
            begin[0][0], begin[1][0], begin[2][0] = *known["begun"]["digest"], known["begun"]["words"]
        # Own turns.
        seg = np.repeat(np.arange(len(conv)), size)
        i = np.arange(len(c)) - start[seg] + 1 + before[seg]
        keep = i > h[seg]
        seg, d, own = seg[keep], (i - shift[seg])[keep], w[keep]
        first = np.searchsorted(seg, np.arange(len(conv)))

        def running(v: np.ndarray, add: np.ndarray) -> np.ndarray:
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
            return s[1:] - s[first[seg]] + add[seg]

        p = [running(u[j][keep] * _powers(LANES[j], d), begin[j]) for j in (0, 1)] + [running(own.astype(np.uint64), begin[2])]
        # The empty prefix, and the turns taken from a base, of conversations that begin here.
        new = np.flatnonzero(before == 0)
        times = taken[new] + 1
        at = np.repeat(new, times)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        q = [upto[j][of[at], depth] for j in (0, 1, 2)]
        q_own = np.where(depth > 0, head[2][of[at], np.maximum(depth - 1, 0)], 0).astype(np.int64)
        seg, d = np.concatenate([at, seg]), np.concatenate([depth, d])
        order = np.lexsort((d, seg))
        seg, d = seg[order], d[order]
        long = lambda a, z: np.concatenate([a, z])[order].astype(np.uint64).view(np.int64)
        cols = [conv[seg], d, long(q[0], p[0]), long(q[1], p[1]), length[seg], long(q[2], p[2]), np.concatenate([q_own, own])[order], total[seg]]
        whole = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], names=["c", "d", "p1", "p2", "len", "upto", "own", "total"])
        for s in range(0, whole.num_rows, 50_000):
            yield whole.slice(s, 50_000)

    return run


def _cells(b: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    """The cell of each prefix in the two lanes of the sketch."""
    d = b.column("d").to_numpy().view(np.uint64)
    return [((b.column(p).to_numpy().view(np.uint64) + d * np.uint64(m)) * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for p, m in zip(("p1", "p2"), LANES, strict=True)]


def _sketched(bits: int, most: int = 1_000_000):
    """Cells that prefixes fall in, by lane and block of 65,536 cells: those met once, and those met more than once, as packed 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[], []]

        def flush():
            for lane in (0, 1):
                cells, n = np.unique(np.concatenate(held[lane]), return_counts=True)
                start, size = _runs(cells >> 16)
                low = (cells & 0xFFFF).astype("<u2")
                parts = [(low[s : s + k], n[s : s + k]) for s, k in zip(start, size, strict=True)]
                yield pa.RecordBatch.from_pydict({"lane": np.full(len(start), lane), "block": cells[start] >> 16, "once": [x[m == 1].tobytes() for x, m in parts], "more": [x[m > 1].tobytes() for x, m in parts]}, schema=BLOCKS)
            held[:] = [[], []]

        for b in batches:
            for lane, x in enumerate(_cells(b, bits)):
                held[lane].append(x)
            if sum(map(len, held[0])) >= most:
                yield from flush()
        if sum(map(len, held[0])):
            yield from flush()

    return run


BLOCKS = pa.schema([("lane", pa.int64()), ("block", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, rows of which come one after the other: bits of the cells that count two or more."""
    key, count = None, np.zeros(1 << 16, np.uint8)
    done = lambda: pa.RecordBatch.from_pydict({"lane": [key[0]], "block": [key[1]], "bits": [np.packbits(count > 1).tobytes()]})
    for b in batches:
        for lane, block, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lane, block) != key:
                if key is not None and (count > 1).any():
                    yield done()
                key = lane, block
                count[:] = 0
            for x, add in ((once, 1), (more, 2)):
                at = np.frombuffer(x, "<u2")
                count[at] = np.minimum(count[at] + add, 2)
    if key is not None and (count > 1).any():
        yield done()


def sketch(prefixes: DataFrame, bits: int) -> list[np.ndarray]:
    """A count-min sketch of all prefixes in two lanes of 2 ** bits cells: whether a cell counts two or more, as packed bits."""
    blocks = prefixes.select(*NODE).mapInArrow(_sketched(bits), "lane bigint, block bigint, once binary, more binary")
    near = blocks.repartition("lane", "block").sortWithinPartitions("lane", "block").mapInArrow(_merged, "lane bigint, block bigint, bits binary")
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in (0, 1)]
    for r in near.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)
        out[r.lane][r.block * 8192 : r.block * 8192 + len(part)] = part[: len(out[r.lane])]
    return out


def _screened(sent, bits: int):
    """alone: the sketch proves that one conversation holds the prefix; after: it proves so of the prefix before, in the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, d = b.column("c").to_numpy(), b.column("d").to_numpy()
            shared = np.ones(len(c), bool)
            for cell, bitmap in zip(_cells(b, bits), sent.value, strict=True):
                shared &= (bitmap[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
            alone = ~shared & (d > 0)
            goes_on = np.concatenate([[False], (c[1:] == c[:-1]) & (d[1:] == d[:-1] + 1)])
            place = np.arange(len(c))
            start = np.maximum.accumulate(np.where(goes_on, 0, place))
            alone = np.maximum.accumulate(np.where(alone, place, -1)) >= start  # once alone, alone to the end
            after = goes_on & np.concatenate([[False], alone[:-1]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone), pa.array(after)], names=[*b.schema.names, "alone", "after"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node and id: the ids of each node, comma-joined, in a row for each batch that holds some."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in NODE])
        start = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        ids = b.column("c").to_pylist()
        ends = [*start[1:].tolist(), len(ids)]
        text = [",".join(map(str, ids[s:e])) for s, e in zip(start.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[start]) for k in keys), pa.array([ids[s] for s in start]), pa.array(text)], names=[*NODE, "c", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node and id: the digest of each node's ids, read as they come."""
    key, h = None, None
    for b in batches:
        out = []
        for *k, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                if key is not None:
                    out.append([*key, h.hexdigest()])
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=[*NODE, "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], names=[*NODE, "ends"])


def prefixes(rows: DataFrame, key: str, turn: str, role: str, text: str, base: Callable[[Column], Column] | None, taken: Callable[[Column], Column] | None) -> DataFrame:
    """A row for each prefix of each conversation, written: c, d depth, p1 p2 digest, len of the conversation, words upto and of the last turn (own), words in total."""
    spark = rows.sparkSession
    python_ready(spark)
    said = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    c = F.col(key).cast("bigint")
    turns = rows.where(c.isNotNull()).select(c.alias("c"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turns = turns.select("c", "turn", "role", digest.alias("s"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("w"))
    c = F.col("c")
    turns = turns.select("c", "turn", "role", "w", F.xxhash64(F.lit(1), "s").alias("a1"), F.xxhash64(F.lit(2), "s").alias("a2"), (base(c) if base else c).cast("bigint").alias("b"), (taken(c) if taken else F.lit(0)).cast("bigint").alias("h"))
    n = rows.count()
    order = [F.col("b"), F.col("b") != c, c, F.col("turn").asc_nulls_first(), F.col("role"), F.col("a1"), F.col("a2")]
    parts = max(-(-n // ROWS), spark.sparkContext.defaultParallelism)
    spread = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # A checkpoint keeps the partitions as they are, for both of the passes below.
    kept = cut(spread.select("b", "c", "h", "a1", "a2", "w", F.spark_partition_id().cast("bigint").alias("pid")))
    parts = sorted((r.asDict(recursive=True) for r in kept.mapInArrow(_summary, SUMMARY_SQL).collect()), key=lambda r: r["pid"])  # a row for each partition
    sent = spark.sparkContext.broadcast(_carried(parts))
    return written(kept.mapInArrow(_prefixes(sent), PREFIX))


def trie(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", base: Callable[[Column], Column] | None = None, taken: Callable[[Column], Column] | None = None, cells: int = CELLS) -> DataFrame:
    """A row for each node: conv_id its smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is the turns of a key, in order of `turn` (null first; ties by role, then by a digest of the text; repeated turns all count). A null role or text is empty. Rows with
    a null key take no part. `taken` of a key's turns (0 to 3) come from the conversation `base` of it, from its start, instead of as many of its own; a base is its own base.
    Turns may be of any length, and a conversation may have any number of them; other columns aren't read. An empty table has no node, not even the root.

    `cells` bounds the sketch (a power of two for each of two lanes); beyond about as many prefixes it proves ever fewer, and more are shuffled: the result is the same.
    """
    spark = rows.sparkSession
    every = prefixes(rows, key, turn, role, text, base, taken)
    bits = min(cells, max(16, (8 * every.count()).bit_length()))
    bitmaps = spark.sparkContext.broadcast(sketch(every.where("d > 0"), bits))
    seen = written(every.mapInArrow(_screened(bitmaps, bits), f"{PREFIX}, alone boolean, after boolean"))
    discard(every)
    shared, joints = seen.where("not alone"), seen.where("alone and not after")
    found = shared.groupBy(*NODE).agg(F.min("c").alias("c"), F.min(F.col("upto") - F.col("own")).alias("before"), F.every(F.col("d") == F.col("len")).alias("leaf"))
    # From depth d on, c is the smallest member of its prefixes; leaf: no conversation goes on from its end.
    mine = found.select("c", "d", "before", "leaf").union(joints.select("c", "d", F.col("upto") - F.col("own"), F.lit(True)))
    owners = mine.groupBy("c").agg(F.min(F.struct("d", "before")).alias("since"), F.max("leaf").alias("leaf"))
    owners = written(owners.select("c", F.col("since.d").alias("since"), F.col("since.before").alias("before"), "leaf"))
    linked = written(shared.select("c", *NODE, "len", "total", (F.col("upto") - F.col("own")).alias("left")).join(owners, "c", "left"))
    owned = F.coalesce("before", "total") - F.col("left")  # words of c from here to where its own nodes begin
    nodes = linked.groupBy(*NODE).agg(
        F.min(F.struct("c", "since")).alias("top"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("since") <= F.col("d") + 1) & (F.col("d") < F.col("len"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(owned, F.lit(0))).alias("saved"),
    )
    nodes = written(nodes.select(*NODE, "top.*", "n_convs", "n_children", "n_leaves", "saved"))
    above = linked.where("d = since - 1 and d > 0").select("c", *NODE).join(nodes.select(*NODE, F.col("c").alias("parent")), NODE).select("c", (F.col("d") + 1).alias("d"), "parent")
    top = nodes.where("d = 0").first()
    root = F.lit(top["c"] if top else None).cast("bigint")
    parent = lambda df: df.where("d > 1").join(above, ["c", "d"], "left").withColumn("parent", F.coalesce("parent", "c")).unionByName(df.where("d = 1").withColumn("parent", root))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    # Ends: packed in order, then hashed in order.
    ends = shared.where("d = len").select(*NODE, "c")
    parts = max(1, spark.sparkContext.defaultParallelism)
    packed = ends.repartitionByRange(parts, *NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(_packed, "d bigint, p1 bigint, p2 bigint, c bigint, ids string")
    ends = packed.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(_hashed, "d bigint, p1 bigint, p2 bigint, ends string")
    nodes = nodes.join(ends, NODE, "left").withColumn("ends", F.coalesce("ends", none))
    begins = parent(nodes.where("d = since and d > 0"))
    others = nodes.where("d > since or d = 0").withColumn("parent", F.when(F.col("d") > 0, F.col("c")))
    final = lambda df, **own: df.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), *(x.cast("bigint").alias(k) for k, x in own.items()), F.col("ends").alias("ends_sha256"))
    of_shared = {"n_convs": F.col("n_convs"), "n_children": F.col("n_children"), "n_leaves": F.col("n_leaves"), "saved_tokens": F.col("saved")}
    of_tail = {"n_convs": F.lit(1), "n_children": F.col("d") < F.col("len"), "n_leaves": F.lit(1), "saved_tokens": F.lit(0)}
    tail = lambda df: df.select("c", "d", "len", "parent", F.when(F.col("d") == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).otherwise(none).alias("ends"))
    tails = tail(seen.where("alone and after").withColumn("parent", F.col("c"))).union(tail(parent(joints.select("c", "d", "len"))))
    return final(begins, **of_shared).union(final(others, **of_shared)).union(final(tails, **of_tail))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all conversations, rebuilt: the first crc32(conv_id) % 4 turns come from the conversation conv_id - conv_id % 20."""
    return trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 20, taken=lambda c: F.crc32(c.cast("string")) % 4)


def op12_sql() -> str:
    return """
WITH turn AS (
  SELECT conv_id c, coalesce(role, '') || chr(1) || coalesce(text, '') said, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) i
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- the bits of crc32 one by one: 256 and above bring in a byte, 0 shifts
  SELECT c, c - c % 20 b, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(str_split(c::VARCHAR, ''), lambda x: list_concat([256 + ascii(x)::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0])))),
    lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) crc
  FROM (SELECT DISTINCT c FROM turn)),
conv AS (SELECT c, b, xor(crc, 4294967295) % 4 h FROM crc),
rebuilt AS (
  SELECT v.c, t.i, 0 own, t.said, t.w FROM conv v JOIN turn t ON t.c = v.b AND t.i <= v.h
  UNION ALL SELECT v.c, t.i, 1, t.said, t.w FROM conv v JOIN turn t ON t.c = v.c AND t.i > v.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, i) d FROM rebuilt),
whole AS (SELECT v.c, coalesce(max(d), 0) n, coalesce(list(said ORDER BY d) FILTER (said IS NOT NULL), []) says, coalesce(list(w ORDER BY d) FILTER (said IS NOT NULL), []) ws FROM conv v LEFT JOIN placed p ON p.c = v.c GROUP BY v.c),
prefix AS (SELECT c, d, n, md5(list_slice(says, 1, d)::VARCHAR || d) k, CASE WHEN d > 0 THEN ws[d] ELSE 0 END w FROM (SELECT *, unnest(range(n + 1)) d FROM whole)),
node AS (SELECT d, k, min(c) c, count(*) n_convs, any_value(w) w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '') ends FROM prefix GROUP BY d, k),
up AS (SELECT u.d, u.k, a.c parent, a.d pd, a.k pk FROM node u JOIN prefix p ON p.c = u.c AND p.d = u.d - 1 JOIN node a ON a.d = p.d AND a.k = p.k),
below AS (SELECT pd d, pk k, count(*) n_children FROM up GROUP BY 1, 2),
tree AS (
  SELECT p.d, p.k, count_if(b.n_children IS NULL) n_leaves, sum((u.n_convs - 1) * u.w) saved
  FROM node u JOIN prefix p ON p.c = u.c AND p.d <= u.d LEFT JOIN below b ON b.d = u.d AND b.k = u.k GROUP BY 1, 2)
SELECT n.c::BIGINT conv_id, n.d::BIGINT depth, u.parent::BIGINT parent_conv_id, n.n_convs::BIGINT n_convs, coalesce(b.n_children, 0)::BIGINT n_children,
  t.n_leaves::BIGINT n_leaves, t.saved::BIGINT saved_tokens, sha256(n.ends) ends_sha256
FROM node n JOIN tree t ON t.d = n.d AND t.k = n.k LEFT JOIN up u ON u.d = n.d AND u.k = n.k LEFT JOIN below b ON b.d = n.d AND b.k = n.k
"""
