"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token strings that byte-pair encoding yields. It starts as one state
that loops on every byte. Each merge (a, b) -> ab is a gadget composed with it, in order of priority: the state after `a` is
replaced by a copy without the arc `b`; where `a` could be read and then `b`, an arc `ab` is added, to where `b` led.
So there is one state for each token, and the arc v leaves the state after u unless some gadget took it away: a
gadget (a, b) where a is u, or its right part at a time before u was made, and b is v, or its left part before v was made.
`arc` answers that from the gadgets; answers become rows of the transition table as they are first needed (the table
over all pairs of tokens is dense). An input has exactly one path through the automaton, so a piece of text is
encoded by one scan: at each byte, the one token that ends there and has an arc from where it starts.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table

#: The pattern by which byte-level BPE splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
ENCODED = "struct<n_tokens:bigint,ids:binary,decoded:string>"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the bytes in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class _Redo(Exception):
    """A piece holds a character that the split pattern takes for a letter or number, and the vocabulary's splitter doesn't."""


class TokenAutomaton(dict):
    """Maps a piece of text to its ids as packed little-endian 32-bit integers; a dict, so that known pieces cost one lookup.

    cache_pieces bounds the pieces kept, and arc_rows the rows of the transition table."""

    def __init__(self, spec: dict, cache_pieces: int = 400_000, arc_rows: int = 600_000):
        super().__init__()
        self.cache_pieces, self.arc_rows = cache_pieces, arc_rows
        letters = byte_alphabet()
        vocab = spec["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.label: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if all(c in letters for c in s)}
        self.ids: dict[bytes, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for c, b in letters.items():
            if c in vocab:
                self.ids[bytes([b])] = vocab[c]
        for k, (a, b) in enumerate(spec["merges"]):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self._arc(u, v):  # a gadget whose arcs can't be read adds nothing
                self.gadget[u, v] = k
                if w not in self.born:
                    self.born[w], self.left[w], self.right[w] = k, u, v
                    self.ids[self.label[w]] = w
        self.longest = max(map(len, self.ids))
        self.packed = {i: i.to_bytes(4, "little") for i in self.ids.values()}
        self.added = {x["content"]: x["id"] for x in spec["added"]}
        self.label |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(SPLIT)

    def _arc(self, u: int, v: int) -> bool:
        """Whether the state after u still has the arc v."""
        before_u, a = NEVER, u
        while True:
            before_v, b = NEVER, v
            while True:
                k = self.gadget.get((a, b), NEVER)
                if k < before_u and k <= before_v and k != NEVER:
                    return False
                if b not in self.born:
                    break
                before_v, b = self.born[b], self.left[b]
            if a not in self.born:
                return True
            before_u, a = self.born[a], self.right[a]

    def arc(self, u: int, v: int) -> bool:
        pair = u << 32 | v
        known = self.arcs.get(pair)
        if known is None:
            if len(self.arcs) >= self.arc_rows:
                self.arcs.clear()
            known = self.arcs[pair] = self._arc(u, v)
        return known

    def path(self, piece: bytes) -> list[int]:
        """The labels of the one path that reads piece."""
        ids, arc, n = self.ids, self.arc, len(piece)
        last = [-1] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = ids.get(piece[j:i])
                if t is not None and (j == 0 or arc(last[j], t)):
                    last[i] = t
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.label[last[i]])
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece) and len(self._pieces(piece)) != 1:
            raise _Redo
        out = b"".join(map(self.packed.__getitem__, self.path(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= self.cache_pieces:
                self.clear()
            self[piece] = out
        return out

    def _pieces(self, text: str) -> list[str]:
        """The split with code points that Python's tables leave unassigned taken as symbols, as the tokenizers library does."""
        shown = "".join("\x01" if unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.split.finditer(shown)]

    def _plain(self, text: str) -> bytes:
        try:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        except _Redo:
            return b"".join(b"".join(map(self.packed.__getitem__, self.path(x.encode()))) for x in self._pieces(text))

    def encode(self, text: str) -> bytes:
        """ids of text, packed; the strings of added tokens are found first, in the text itself."""
        if self.cut is None:
            return self._plain(text)
        parts = self.cut.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return b"".join(self.added[x].to_bytes(4, "little") if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The arc labels of ids, put together."""
        label = self.label
        return b"".join(map(label.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def load(path: str) -> str:
    """What the automaton needs of a tokenizer file, as JSON."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in x["model"]["merges"]]
    return json.dumps({"vocab": x["model"]["vocab"], "merges": merges, "added": x.get("added_tokens", [])})


@lru_cache(maxsize=2)
def automaton(spec: str, cache_pieces: int = 400_000) -> TokenAutomaton:
    """One for each Python worker, kept over its tasks."""
    return TokenAutomaton(json.loads(spec), cache_pieces)


def _encoded(spec, cache_pieces, kept):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(spec.value, cache_pieces) if kept else TokenAutomaton(json.loads(spec.value), cache_pieces)
        for texts in batches:
            n, ids, decoded = [], [], []
            for x in texts:
                got = a.encode(x.as_py() or "")
                ids.append(got)
                n.append(len(got) // 4)
                decoded.append(a.decode(got))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "bpe", cache_pieces: int = 400_000, kept: bool = True) -> DataFrame:
    """docs with a column `out`: struct(n_tokens, ids: little-endian unsigned 32-bit integers, decoded: their text).

    vocabulary is the path of a tokenizer file on the driver; its content (a fixed size) goes to the executors as a
    broadcast variable. A null or empty text has no ids and decodes to the empty text. Texts of any length are read whole:
    a piece costs time in proportion to its length. Rows stay as they are, repeated ones too; an existing column `out`
    is replaced; an empty table stays empty. cache_pieces bounds what a worker remembers (some 250 bytes each), and changes no result.
    kept: whether workers keep the automaton for their next task, or each task makes its own and lets go of it, where other stages need the memory of idle workers.
    """
    spark = docs.sparkSession
    python_ready(spark)
    spec = spark.sparkContext.broadcast(load(vocabulary))
    run = F.arrow_udf(_encoded(spec, cache_pieces, kept), ENCODED)
    return docs.withColumn(out, run(F.col(text)))


def ids_array(packed: Column) -> Column:
    """Packed ids as array<bigint>, by Spark's own functions."""
    h = F.hex(packed)
    byte = lambda s: F.conv(F.concat(F.substring(s, 7, 2), F.substring(s, 5, 2), F.substring(s, 3, 2), F.substring(s, 1, 2)), 16, 10).cast("bigint")
    return F.transform(F.regexp_extract_all(h, F.lit("(.{8})"), 1), byte)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_decode(docs, vocabulary or default_vocabulary())
    return done.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))
