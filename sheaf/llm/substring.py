"""Substring de-duplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id, in blocks of `window` consecutive words. A block is indexed by the
hash of its words, with the smallest document it starts in and its first place there. Only blocks that can recur need indexing:
the smallest hash of the short grams of a block is its anchor, equal blocks have equal anchors, and an anchor
that one document alone holds rules its blocks out.

Blocks of a document that follow each other as their sources' do are a run. A document is parsed greedily from left to right: where the next run starts, the words of its
source are fetched and compared with the document's own, and the factor is as long as they agree, at least a window, however many runs that explains. What the
factor doesn't explain is looked at anew from the first block that reaches beyond its end, so that a repeat which crosses the boundary of two
factors is a factor of its own. The words that factors cover are duplicates; a block whose hash alone agrees covers nothing.

Copies of a text are a class: only the smallest of each class is parsed and indexed, and a later copy is all repeats if it is a window long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table, unused
from sheaf.session import discard, written

GRAM = 16
ODD = (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)
FACTORS = "array<struct<start:int,n_words:int,source:bigint,source_start:int>>"
#: Tables that grow with the corpus are joined by sorted shuffles at every size, so that a plan that fits a small corpus is that of a large one.
JOIN = "merge"


class _Words(dict):
    """A 64-bit hash of each word, kept up to a bound."""

    def __missing__(self, w):
        if len(self) > 300_000:
            self.clear()
        self[w] = out = xxhash.xxh3_64_intdigest(w)
        return out


_KNOWN = _Words()


def _rolled(words: np.ndarray, base: int, *widths: int) -> list[np.ndarray]:
    """The hashes of all runs of so many words: polynomials in an odd base, modulo 2^64."""
    n = len(words)
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    out = []
    for w in widths:
        h = (sums[w:] - sums[: n - w + 1]) * down[: n - w + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(29)))
    return out


def blocks(text: str, window: int, full: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words of text; for each window of them its anchor and, in full, the two halves of its hash."""
    words = text.encode("utf-8", "replace").split()
    if len(words) < window:
        none = np.zeros(0, np.uint64)
        return words, none, none, none
    one = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    grams, first = _rolled(one, ODD[0], GRAM, window)
    other = one * np.uint64(0xD6E8FEB86659FD93)
    (second,) = _rolled(other ^ (other >> np.uint64(32)), ODD[1], window) if full else (first,)
    low, size, want = grams, 1, window - GRAM + 1
    while 2 * size <= want:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < want:
        low = np.minimum(low[: len(low) - (want - size)], low[want - size :])
    return words, low, first, second


def _anchors(window):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(blocks(x.as_py() or "", window, False)[1]).view(np.int64) for x in texts], pa.list_(pa.int64()))

    return run


def _candidates(window):
    """For each text with the anchors that recur: its blocks under these."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                want = np.array(b["anchors"][i].as_py(), np.int64).view(np.uint64)
                _, anchor, h1, h2 = blocks(b["text"][i].as_py() or "", window)
                at = np.flatnonzero(np.isin(anchor, want))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b[c][i].as_py())) for c in ("doc", "t")] + [pa.array(at.astype(np.int32)), pa.array(h1[at].view(np.int64)), pa.array((h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["doc", "t", "at", "h1", "h2"])

    return run


def _fetched(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """The words of each text at the places wanted of it."""
    out = []
    for t, at in zip(texts, wanted, strict=True):
        words = (t.as_py() or "").encode("utf-8", "replace").split()
        out.append([{"place": w["place"], "words": b" ".join(words[w["place"] : w["place"] + w["n"]]).decode("utf-8", "replace")} for w in at.as_py() or []])
    return pa.array(out, pa.list_(pa.struct([("place", pa.int32()), ("words", pa.string())])))


def parse(words: list[bytes], runs: list[dict], window: int) -> list[dict]:
    """Greedy factors of words: at each run that the last factor doesn't explain, as many words as agree with its source."""
    out: list[dict] = []
    done = 0
    for r in sorted(runs, key=lambda r: (r["at"], -r["n_words"])):
        if r["at"] + r["n_words"] <= done:
            continue
        theirs, begin = r["words"].encode("utf-8", "replace").split(), 0
        while begin < r["n_words"]:
            at, rest = r["at"] + begin, theirs[begin:]
            n = len(rest)
            if words[at : at + n] != rest:
                n = next((i for i, (a, b) in enumerate(zip(words[at:], rest, strict=False)) if a != b), min(len(words) - at, n))
            if n >= window:
                out.append({"start": at, "n_words": n, "source": r["source"], "source_start": r["place"] + begin})
                done = max(done, at + n)
            begin += n + 1
    return out


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(doc, t, source_class, runs): for each text (doc, t: its hash) that repeats a smaller document, its runs and the words of their sources.

    Where the text equals that of a smaller document, source_class is the smallest such document and there are no runs.
    """
    python_ready(docs.sparkSession)
    t = F.xxhash64("text").alias("t")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null").select("doc", "text", t)
    ids = written(rows.select("doc", "t", F.unhex(F.sha2("text", 256)).alias("class"), F.arrow_udf(_anchors(window), "array<bigint>")(F.col("text")).alias("anchors")).where("size(anchors) > 0"))
    # Tables that hot keys are joined with are written first: adaptive execution splits the partitions of such a join.
    first = written(ids.groupBy("class").agg(F.min("doc").alias("source_class"), F.max("doc").alias("last")).where("source_class <> last").drop("last"))
    marked = ids.join(first.hint(JOIN), "class", "left")
    copies = marked.where("source_class < doc").select("doc", "t", "source_class").distinct()
    held = marked.where("source_class is null or source_class = doc").select("doc", "t", F.explode("anchors").alias("anchor"))
    shared = written(held.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("anchor"))
    recur = held.join(shared.hint(JOIN), "anchor").groupBy("doc", "t").agg(F.collect_set("anchor").alias("anchors"))
    found = written(rows.join(recur.hint(JOIN), ["doc", "t"]).select("doc", "t", "text", "anchors").mapInArrow(_candidates(window), "doc bigint, t bigint, at int, h1 bigint, h2 int"))
    source = F.struct("doc", "at", "t")
    index = written(found.groupBy("h1", "h2").agg(F.min(source).alias("s"), F.max("doc").alias("most")).where("s.doc <> most").select("h1", "h2", F.col("s.doc").alias("source"), F.col("s.t").alias("source_t"), F.col("s.at").alias("place")))
    hits = found.join(index.hint(JOIN), ["h1", "h2"]).where("source < doc").select("doc", "t", "at", "source", "source_t", "place").distinct()
    # A run: blocks that follow each other in both documents.
    same = ["doc", "t", "source", "source_t", (F.col("place") - F.col("at")).alias("ahead")]
    hits = hits.select("at", *same)
    same[-1] = "ahead"
    hits = hits.withColumn("run", F.col("at") - F.row_number().over(W.partitionBy(*same).orderBy("at")))
    found_runs = hits.groupBy(*same, "run").agg(F.min("at").alias("at"), (F.count("*") + window - 1).cast("int").alias("n_words"))
    found_runs = written(found_runs.select("doc", "t", "at", "n_words", "source", "source_t", (F.col("at") + F.col("ahead")).alias("place")))
    discard(shared, found, index)
    want = found_runs.groupBy("source", "source_t", "place").agg(F.max("n_words").alias("n")).groupBy("source", "source_t").agg(F.collect_list(F.struct("place", "n")).alias("wanted"))
    fetched = rows.join(want.hint(JOIN), (F.col("doc") == F.col("source")) & (F.col("t") == F.col("source_t"))).select("source", "source_t", "text", "wanted").dropDuplicates(["source", "source_t"])
    fetched = fetched.select("source", "source_t", F.explode(F.arrow_udf(_fetched, "array<struct<place:int,words:string>>")("text", "wanted")).alias("f")).select("source", "source_t", "f.*")
    each = found_runs.join(written(fetched), ["source", "source_t", "place"])
    own = each.groupBy("doc", "t").agg(F.collect_list(F.struct("at", "n_words", "source", "place", "words")).alias("runs"))
    out = written(own.join(copies, ["doc", "t"], "full").select("doc", "t", "source_class", "runs"))
    discard(ids, first, found_runs)
    return out


def _parsed(window):
    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = [parse((t.as_py() or "").encode("utf-8", "replace").split(), r.as_py() or [], window) for t, r in zip(texts, runs, strict=True)]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])))

    return run


def _kept(text: str, spans: list | None, whole: bool) -> tuple[int, int, bytes]:
    words = text.encode("utf-8", "replace").split()
    if whole:
        return len(words), len(words), b""
    if not spans:
        return len(words), 0, b" ".join(words)
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] > at:
            out += words[at : s["start"]]
        at = max(at, s["start"] + s["n_words"])
    out += words[at:]
    return len(words), len(words) - len(out), b" ".join(out)


def _removed():
    def run(texts: pa.Array, spans: pa.Array, whole: pa.Array) -> pa.Array:
        rows = [_kept(t.as_py() or "", s.as_py(), w.as_py()) for t, s, w in zip(texts, spans, whole, strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())], ["n_words", "n_removed", "kept"])

    return run


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, out: str = "deduplicated", factors: str | None = None) -> DataFrame:
    """docs with a column `out`: struct(n_words, n_removed, kept: the words left, joined by a space), and, if a name is given, a column `factors`:
    array of struct(start, n_words, source, source_start), which may overlap; null for copies, whose factor is the whole text, and for texts without.

    Words are runs of characters other than ASCII white space. A null or empty text has no words. Nothing is removed from texts of
    fewer words than the window. Texts of any length are parsed whole. Of several sources the smallest document counts, at its first place. Where an id
    repeats, each of its texts is parsed for itself, and none repeats another of that id. Rows with a null id neither repeat nor are repeated. An existing
    column `out` is replaced, others stay whatever their names; an empty table stays empty.
    """
    r = runs(docs, key, text, window)
    d, t, whole, of, f = (unused(n, docs) for n in ("_doc", "_t", "_whole", "_runs", factors or "_factors"))
    side = r.select(F.col("doc").alias(d), F.col("t").alias(t), F.col("source_class").isNotNull().alias(whole), F.col("runs").alias(of))
    x = docs.join(side.hint(JOIN), (docs[key] == side[d]) & (F.xxhash64(docs[text]) == side[t]), "left")
    x = x.withColumn(f, F.when(F.col(of).isNotNull(), F.arrow_udf(_parsed(window), FACTORS)(F.col(text), F.col(of))))
    run = F.arrow_udf(_removed(), "struct<n_words:bigint,n_removed:bigint,kept:string>")
    x = x.withColumn(out, run(F.col(text), F.col(f), F.coalesce(whole, F.lit(False))))
    return x.drop(d, t, whole, of, *([] if factors else [f]))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every whole text."""
    d = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "deduplicated.n_words", "deduplicated.n_removed", F.sha2(F.col("deduplicated.kept").cast("binary"), 256).alias("kept_sha256"))
