"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark's higher-order functions.

A word is a row of one-byte pieces, and the fold merges, step by step, the leftmost pair of neighbours whose bytes joined have
the lowest rank, until no pair has one. The rank map is a literal of the plan: an array of small maps, by a hash of the piece.

The words of all documents are counted, and the commonest of them (`kept`, which bounds what is sent to the tasks) are folded in
a table of their own. A document's words are looked up among these; its others, each distinct one once, are folded in its row.
So only counts of distinct words are shuffled, never a document's text. Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table, unused
from sheaf.session import discard, written

# The pattern by which byte-level BPE splits text before its merges, with Unicode's white space spelt out.
SPACE = "\x09-\x0d\x20\x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+".replace("SPACE", SPACE)
# The letters and the numbers that Unicode 16 has and Python's tables leave unassigned.
LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5
113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"

NONE = 2**31 - 1
BUCKETS = 1 << 16
#: Bytes of a word beyond which the fold, whose time grows with the square of them, isn't taken.
LONG = 1024


def ranks_of(path: str) -> list[bytes]:
    """The pieces of a rank file (a base64 piece and its rank a line), by rank; ranks run from 0 without gaps, and every byte is a piece."""
    with open(path, "rb") as f:
        got = {int(r): base64.b64decode(p) for p, r in map(bytes.split, f)}
    pieces = [got.get(i) for i in range(len(got))]
    if None in pieces or len(set(pieces)) != len(pieces) or not {bytes([b]) for b in range(256)} <= set(pieces):
        raise ValueError("ranks must run from 0 without gaps, of pieces that differ and hold every byte")
    return pieces


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(x), 65 - BUCKETS.bit_length()).cast("int")


def rank_map(pieces: list[bytes]) -> Column:
    """piece (a character for each byte) -> rank, as an array of small maps that Spark reads once, as it plans."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for rank, p in enumerate(pieces):
        x = p.decode("latin-1")
        maps[xxhash.xxh64_intdigest(x.encode(), 42) >> 65 - BUCKETS.bit_length()][x] = rank
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), "array<map<string,int>>")


def _let(x: Column, use) -> Column:
    """use(x), with x worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a word (text with a character for each byte, not empty): ranked merges folded over its pieces.

    The fold keeps the places where pieces begin, and one after the last, and of each pair of neighbours the rank. Both arguments are named values, as they are read many times.
    """
    n = F.length(word)
    part = lambda a, b: word.substr(a, b - a)
    find = lambda x: F.get(ranks, _slot(x))[x]
    rank = lambda a, b: F.coalesce(find(part(a, b)), F.lit(NONE))
    state = lambda p, r: F.struct(p.alias("p"), r.alias("r"))
    none = F.array().cast("array<int>")

    def merge(p, r, i):
        """Piece i takes in the one after it; of the ranks, only those of the pairs beside are new."""
        at = lambda k: F.get(p, i + k)
        left = F.when(i > 0, F.array(rank(at(-1), at(2)))).otherwise(none)
        right = F.when(i + 3 < F.size(p), F.array(rank(at(0), at(3)))).otherwise(none)
        return state(F.array_remove(p, at(1)), F.flatten(F.array(F.slice(r, F.lit(1), F.greatest(i - 1, F.lit(0))), left, right, F.slice(r, i + 3, F.size(r)))))

    def step(acc, _):
        p, r = acc["p"], acc["r"]
        return _let(F.array_min(r), lambda least: F.when(least < NONE, _let(F.array_position(r, least).cast("int") - 1, lambda i: merge(p, r, i))).otherwise(acc))

    ids = lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda end, k: find(part(F.get(p, k), end)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(i, i + 2))).otherwise(none)
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(none)
    merged = F.aggregate(steps, state(F.sequence(F.lit(1), n + 1), pairs), step, lambda acc: ids(acc["p"]))
    return F.when(find(word).isNotNull(), F.array(find(word))).otherwise(merged)


def _within(ranges: str) -> set[str]:
    return {chr(c) for r in ranges.split() for a, b in [r.split("-")] for c in range(int(a, 16), int(b, 16) + 1)}


@lru_cache(maxsize=1)
def _newer() -> dict[str, str]:
    return {c: "a" for c in _within(LETTERS)} | {c: "1" for c in _within(NUMBERS)}


_SPLIT = regex.compile(PATTERN)
# The letters and numbers up to U+024F. For texts of such characters and general punctuation, the pattern can be said without Unicode's classes, which is read three times as fast.
LATIN, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_ELSE = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
_PLAIN = re.compile(rf" ?[{LATIN}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{LATIN}{DIGITS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _pieces(text: str) -> list[str]:
    """The words of a text by the pattern, as far as Python's tables know its characters."""
    return (_SPLIT if _ELSE.search(text) else _PLAIN).findall(text)


def _unassigned(word: str) -> bool:
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


def split(text: str) -> list[str]:
    """The words of a text by the pattern, with characters that Python's tables leave unassigned taken for what Unicode 16 says of them."""
    if not _unassigned(text):
        return _pieces(text)
    shown = "".join(_newer().get(c, "\x01") if unicodedata.category(c) == "Cn" else c for c in text)
    return [text[m.start() : m.end()] for m in _SPLIT.finditer(shown)]


def long_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, with the pairs in a heap: by rank, then from the left."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != to:
            continue
        end[i], end[j], after[i] = to, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (i, before[i]):
            if a >= 0 and after[a] < n and (r := ranks.get(word[a : end[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[after[a]]))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


def _counted(most: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    n.update(_pieces(x.as_py()))
                if len(n) >= most:
                    yield flush()
                    n.clear()
        yield flush()

    return run


def _bytes_of(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def common_words(docs: DataFrame, pieces: list[bytes], text: str = "text", kept: int = 600_000) -> dict[str, bytes]:
    """The commonest words of all documents (at most `kept`, none above 64 bytes) with their ids as packed 32-bit integers."""
    n = docs.select(text).mapInArrow(_counted(), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = written(n.where(F.octet_length("word") <= 64).orderBy(F.desc("n"), "word").limit(kept).select("word"))
    spread = top.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).select("word", _bytes_of(F.col("word")).alias("w"))
    got = spread.select("word", _let(rank_map(pieces), lambda r: F.transform(F.array("w"), lambda w: fold(w, r))[0]).alias("ids")).toArrow()
    discard(top)
    ids = got["ids"].combine_chunks()
    raw = ids.flatten().to_numpy().astype("<i4").tobytes()
    size = np.asarray(ids.value_lengths(), dtype=np.int64)
    ends = np.cumsum(size)
    return {w: raw[4 * a : 4 * b] for w, a, b in zip(got["word"].to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True) if not _unassigned(w)}


PARTS = "struct<codes:binary,rare:array<string>>"


def _looked_up(common, ranks):
    """codes: the ids of known words, and -1 - k for the k-th of the text's other distinct words, which are listed as `rare`."""

    def of(text: str) -> tuple[bytes, list[str]]:
        known = common.value
        words = _pieces(text)
        codes = list(map(known.get, words))
        if None not in codes:
            return b"".join(codes), []
        unknown = [i for i, c in enumerate(codes) if c is None]
        if _ELSE.search(text) and any(_unassigned(words[i]) for i in unknown):
            words = split(text)
            codes = list(map(known.get, words))
            unknown = [i for i, c in enumerate(codes) if c is None]
        rare: dict[str, bytes] = {}
        listed: list[str] = []
        for i in unknown:
            w = words[i]
            code = rare.get(w)
            if code is None:
                raw = w.encode()
                if len(raw) > LONG:
                    code = np.array(long_merges(raw, ranks.value), "<i4").tobytes()
                else:
                    code = (-1 - len(listed)).to_bytes(4, "little", signed=True)
                    listed.append(raw.decode("latin-1"))
                rare[w] = code
            codes[i] = code
        return b"".join(codes), listed

    def run(texts: pa.Array) -> pa.Array:
        got = [of(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in got], pa.binary()), pa.array([r for _, r in got], pa.list_(pa.string()))], ["codes", "rare"])

    return run


def _lists(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lengths of the lists of an array, none of which is null, and their values one after the other."""
    return np.asarray(values.value_lengths(), dtype=np.int64), values.flatten()


def _filled(codes: pa.Array, folded: pa.Array) -> pa.Array:
    """The ids of each text of a batch: the folded words at the places left for them."""
    x = np.frombuffer(b"".join(codes.to_pylist()), "<i4")
    n = np.asarray(pa.compute.binary_length(codes), dtype=np.int64) // 4
    rare, words = _lists(folded)
    size, flat = _lists(words)
    at = np.flatnonzero(x < 0)
    text = np.repeat(np.arange(len(n)), n)
    k = (np.cumsum(rare) - rare)[text[at]] - 1 - x[at]  # which word of the batch
    times = np.ones(len(x), np.int64)
    times[at] = size[k]
    y = np.repeat(x, times)
    where = np.flatnonzero(y < 0)
    start = np.cumsum(size) - size
    y[where] = flat.to_numpy()[np.repeat(start[k] - np.cumsum(size[k]) + size[k], size[k]) + np.arange(len(where))]
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, times, len(n)).astype(np.int64))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y, pa.int32()))


def _concatenated(ids: pa.Array, pieces: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The pieces of all ids of a batch, one after the other, and where those of each row begin and end."""
    n, each = _lists(ids.fill_null([]) if ids.null_count else ids)
    x = each.to_numpy()
    if len(x) and not 0 <= x.min() <= x.max() < len(pieces):
        raise ValueError("an id without a piece")
    got = pieces.take(each)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(got), dtype=np.int64))])
    return got.buffers()[2] or pa.py_buffer(b""), ends[np.concatenate([[0], np.cumsum(n)])]


def encode(docs: DataFrame, ranks: str, text: str = "text", out: str = "ids", kept: int = 600_000) -> DataFrame:
    """docs with a column `out`: the ids (array<int>) of each text, as the ranks say, without special tokens.

    ranks is the path of a rank file on the driver. A null or empty text has no ids. Texts are read whole; a word of more than LONG bytes is merged with a heap instead of the fold,
    by the same ranks and in the same order. Of equal ranks the leftmost pair comes first. Rows stay as they are, repeated ones too; an existing column `out` is replaced; an
    empty table stays empty. `kept` bounds the words that are folded beforehand; it changes no result.
    """
    spark = docs.sparkSession
    python_ready(spark)
    pieces = ranks_of(ranks)
    words = spark.sparkContext.broadcast(common_words(docs, pieces, text, kept))
    looked_up = F.arrow_udf(_looked_up(words, spark.sparkContext.broadcast({p: i for i, p in enumerate(pieces)})), PARTS)
    parts, folded = unused("_parts", docs), unused("_folded", docs)
    x = docs.withColumn(parts, looked_up(F.col(text)))
    each = _let(rank_map(pieces), lambda r: F.transform(F.col(parts)["rare"], lambda w: fold(w, r)))
    x = x.select("*", F.explode(F.array(each)).alias(folded))  # behind a generator, so that Spark doesn't put it into the arguments of the function below
    return x.withColumn(out, F.arrow_udf(_filled, "array<int>")(F.col(parts)["codes"], F.col(folded))).drop(parts, folded)


def decode(docs: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column `out` (binary): the pieces of the ids, concatenated. No ids, or null ones, give no bytes; an id without a piece is an error."""
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(ranks_of(ranks))

    def run(x: pa.Array) -> pa.Array:
        data, ends = _concatenated(x, pa.array(sent.value, pa.binary()))
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), data])

    return docs.withColumn(out, F.arrow_udf(run, "binary")(F.col(ids)))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_bytes(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    ranks = ranks or default_ranks()
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
