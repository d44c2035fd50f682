"""Hard negatives: for an anchor and each of its best rows of the same label, the best rows of other labels within a window of that score.

Anchors, a stated set, are sent to the tasks in blocks of bounded size, and every row is scored against each. A task keeps only the pairs that can still
count: the best rows of the anchor's label, then, once the positives are known, the best of other labels in each positive's window. Those
pairs are keyed by (anchor, descending score, positives first, id), shuffled by anchor and sorted within partitions (a secondary sort);
an iterator reads them as they come, opens a window at each positive and emits the negatives that fall in it. It holds the open windows, never an anchor's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table
from sheaf.session import discard, written

LEAST, LARGEST = -(2**63) + 1, 2**63 - 1
#: Anchors that are sent at once.
BLOCK = 16_384
#: Scores that a task holds at once.
AT_ONCE = 4_000_000
PAIR = "a bigint, score bigint, none boolean, id bigint, rid bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _whole(v: pa.Array) -> pa.Array:
    """floor(256 x) of each component, as packed doubles; null for a vector that takes no part."""
    size = np.array(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    end = np.cumsum(size)
    return pa.array([x[a:b].tobytes() if ok and np.isfinite(x[a:b]).all() else None for a, b, ok in zip(end - size, end, v.is_valid().to_pylist(), strict=True)], pa.binary())


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, of integral doubles; those beyond 64 bits count as the largest or smallest integer."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], dtype=object)
    return np.clip(exact(a) @ exact(b).T, LEAST, LARGEST).astype(np.int64)


def _best(c: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The first k of each (anchor, slot): higher scores first, then smaller ids (none last)."""
    order = np.lexsort((c["rid"], c["id"], c["none"], -c["score"], c["slot"], c["a"]))
    c = {n: v[order] for n, v in c.items()}
    if not len(order):
        return c
    new = np.concatenate([[True], (c["a"][1:] != c["a"][:-1]) | (c["slot"][1:] != c["slot"][:-1])])
    place = np.arange(len(order))
    keep = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return {n: v[keep] for n, v in c.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) for n in ("a", "slot", "score", "none", "id", "rid")}


def _scored(sent, k: int, negatives: bool):
    """The pairs of a partition that can still count: of each anchor the first k of its label, or the first k of other labels in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held = sent.value, []
        waiting = 0
        for b in batches:
            size = np.asarray(pa.compute.binary_length(b.column("v")))
            rid, label = b.column("rid").to_numpy(), b.column("label").to_numpy()
            none = b.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = b.column("id").fill_null(0).to_numpy()
            for n in np.unique(size).tolist():
                if n not in anchors:
                    continue
                at = np.flatnonzero(size == n)
                rows = np.frombuffer(b"".join(b.column("v").take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), n // 8)
                x = anchors[n]
                step = max(1, AT_ONCE // len(at))
                for s in range(0, len(x["rid"]), step):
                    part = slice(s, s + step)
                    same = x["label"][part, None] == label[at]
                    got = scores(x["v"][part], rows)
                    windows = [(x["lo"][part, j], x["hi"][part, j]) for j in range(x["lo"].shape[1])] if negatives else [None]
                    for slot, w in enumerate(windows):
                        if w is None:
                            ok = same & (x["rid"][part, None] != rid[at])
                        else:
                            ok = ~same & (got >= w[0][:, None]) & (got <= w[1][:, None])
                        if len(at) > k:  # the k-th best of each anchor: whatever is below can't count
                            least = np.partition(np.where(ok, got, LEAST - 1), len(at) - k, axis=1)[:, len(at) - k]
                            ok &= got >= least[:, None]
                        i, j = np.nonzero(ok)
                        j = at[j]
                        held.append({"a": x["rid"][part][i], "slot": np.full(len(i), slot), "score": got[ok], "none": none[j], "id": ids[j], "rid": rid[j]})
                        waiting += len(i)
                        if waiting > 500_000:
                            held = [_best(_joined(held), k)]
                            waiting = 0
        if held:
            c = _best(_joined(held), k)
            _, first = np.unique(np.stack([c["a"], c["rid"]]), axis=1, return_index=True)  # a row that counts in several windows, once
            for s in range(0, len(first), 50_000):
                at = first[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c["a"][at]), pa.array(c["score"][at]), pa.array(c["none"][at]), pa.array(c["id"][at], mask=c["none"][at]), pa.array(c["rid"][at])], names=["a", "score", "none", "id", "rid"])

    return run


def _windows(k: int, least: int, most: int):
    """Pairs in order of (anchor, descending score, positives first, id): the first k negatives of each positive's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, []
        for b in batches:
            out = []
            for a, anchor, negative, score, i in zip(*(b.column(c).to_pylist() for c in ("a", "anchor_id", "negative", "score", "id")), strict=True):
                if a != now:
                    now, opened = a, []
                if not negative:
                    opened.append([i, score, 0])
                    continue
                for w in opened:
                    if w[2] < k and least * w[1] <= 100 * score <= most * w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], i, w[1], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _sent(anchors: pa.Table, windows: dict[int, list[tuple[int, int]]] | None, slots: int) -> dict[int, dict]:
    """Anchors by the bytes of their vectors."""
    size = np.asarray(pa.compute.binary_length(anchors["v"]))
    out = {}
    for n in np.unique(size).tolist():
        part = anchors.take(pa.array(np.flatnonzero(size == n)))
        rid = part["rid"].to_numpy()
        bounds = np.array([(windows.get(r, []) + [(1, 0)] * slots)[:slots] for r in rid.tolist()], np.int64) if windows is not None else np.zeros((len(rid), 0, 2), np.int64)
        out[n] = {"rid": rid, "label": part["label"].to_numpy(), "v": np.frombuffer(b"".join(part["v"].to_pylist()), np.float64).reshape(len(rid), n // 8), "lo": bounds[:, :, 0], "hi": bounds[:, :, 1]}
    return out


def hard_negatives(rows: DataFrame, anchors: str, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by a written table for each block of anchors.

    anchors is a condition on rows. Scores are inner products of floor(256 x). Positives: an anchor's first rows of its label, itself excluded. Negatives: the first rows of other labels whose
    score is `least` to `most` per cent of the positive's. Higher scores come first, then smaller keys, a null key last. Rows with a null label, a null vector, or a null or non-finite
    component (256 x not being finite included) take no part. Vectors are compared with those of their own length. A row whose key repeats is a row for itself, as an anchor too, which then gives
    its rows once for each. A score beyond 64 bits counts as the largest or smallest. Other columns aren't read; an empty table, or one without anchors, gives no rows.
    """
    spark = rows.sparkSession
    python_ready(spark)
    v = F.arrow_udf(_whole, "binary")(F.col(vector).cast("array<double>"))
    fine = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), v.alias("v"), F.expr(anchors).alias("anchor")).where("label is not null and v is not null")
    every = written(fine.withColumn("rid", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    asked = every.where("anchor and id is not null")
    blocks = -(-asked.count() // block)
    vectors = every.select("rid", "id", "label", "v")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "none", "id", "rid")
    out = spark.createDataFrame([], RESULT)
    for k in range(blocks):
        these = asked.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == k).select("rid", "id", "label", "v").toArrow()  # about `block` of them
        if not these.num_rows:
            continue
        first = spark.sparkContext.broadcast(_sent(these, None, 0))
        found = vectors.mapInArrow(_scored(first, positives, False), PAIR)
        chosen = written(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"))
        windows: dict[int, list] = {}
        for r in chosen.select("a", "score").collect():  # a few for each anchor of the block
            windows.setdefault(r.a, []).append((-(-least * r.score // 100), most * r.score // 100))
        second = spark.sparkContext.broadcast(_sent(these, windows, positives))
        others = vectors.mapInArrow(_scored(second, negatives, True), PAIR)
        pairs = chosen.withColumn("negative", F.lit(False)).unionByName(others.withColumn("negative", F.lit(True)))
        names = F.broadcast(spark.createDataFrame(these.select(["rid", "id"])).toDF("a", "anchor_id"))
        ranked = pairs.join(names, "a").repartition("a").sortWithinPartitions("a", F.desc("score"), "negative", "none", "id", "rid")
        part = written(ranked.select("a", "anchor_id", "negative", "score", "id").mapInArrow(_windows(negatives, least, most), RESULT))
        discard(chosen)
        out = part if blocks == 1 else out.union(part)
    discard(every)
    return out


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings: anchors are the rows whose vec_id is divisible by 100; the label of each whose vec_id is divisible by 7 moves on by one of ten first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), "vec_id % 100 = 0")


def op13_sql() -> str:
    return """
WITH fine AS (
  SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.id a, b.id, a.label = b.label same, list_inner_product(a.v, b.v)::BIGINT score
  FROM fine a JOIN fine b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
positive AS (SELECT a, id, score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
met AS (
  SELECT p.a, p.id p, p.score ps, n.id n, n.score ns, row_number() OVER (PARTITION BY p.a, p.id ORDER BY n.score DESC, n.id) r
  FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT a::BIGINT anchor_id, p::BIGINT positive_id, r::INT AS rank, n::BIGINT negative_id, ps positive_score, ns negative_score FROM met WHERE r <= 10
"""
