"""Language identification of mixed text: script ranges, then Viterbi over per-word scores with a switching penalty.

Words are runs of letters (\\p{L}), whole ones, in lower case. Training counts the character 1- to 3-grams of words (with word boundaries) for
each language over labelled texts. A word's score in a language is the sum of smoothed log frequencies, counted from its best language and
floored. The scripts of a word's letters, found from code-point ranges, leave only the languages that most of them are written in as
candidates. Viterbi then finds, for each text, the labels of its words with the largest sum of scores less a penalty for each switch; equal
neighbours make a span. The distinct words of an Arrow batch are scored together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import fold, python_ready, sampled, table

#: First code points of script ranges, and the scripts ("" : none in particular).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
SCRIPT_OF_RANGE = np.array([NAMES.index(s) for _, s in SCRIPTS])
LABELLED = "struct<lang_pred:string,score:double,n_words:bigint,spans:array<struct<start:int,n_words:int,lang:string>>>"
FLOOR = -12.0
STEPS = 64
#: Words that are scored at once, by letters.
LETTERS = 500_000


def scripts(letters: np.ndarray) -> np.ndarray:
    """The number in NAMES of each code point's script."""
    return SCRIPT_OF_RANGE[np.searchsorted(STARTS, letters, "right") - 1]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the words in order as indices into these, and the number of words of each text."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}]+")
    flat = parts.flatten()
    coded = (flat if isinstance(flat, pa.Array) else flat.combine_chunks()).dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary
    of = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())
    some = ~np.asarray(pc.equal(words, "").to_numpy(zero_copy_only=False), bool)[at] if len(words) else np.zeros(0, bool)
    return words, at[some], np.bincount(of[some], minlength=len(parts))


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words laid end to end with a boundary (0) before and after each, and where each begins."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return points, np.concatenate([[0], np.cumsum(size)])


def grams(points: np.ndarray) -> list[np.ndarray]:
    """The 1-, 2- and 3-grams that begin at each code point, as integers of 21 bits a character; -1 where one would leave its word."""
    one, out = points + np.uint64(1), []
    for n in (1, 2, 3):
        g = np.zeros(len(points), np.uint64)
        inside = np.ones(len(points), bool)
        for i in range(n):
            g[: len(g) - i] = (g[: len(g) - i] << np.uint64(21)) | one[i:]
            if 0 < i < n - 1:
                inside[: len(g) - i] &= points[i:] != 0
        if n > 1:
            inside[max(0, len(g) - n + 1) :] = False
        out.append(np.where(inside, g.astype(np.int64), -1))
    return out


@dataclass
class LanguageModel:
    """langs, their scripts (numbers in NAMES), and log frequencies of grams: a row of `logs` for each of the sorted `keys`. `penalty` is what a switch costs."""

    langs: list[str]
    scripts: list[set]
    keys: np.ndarray
    logs: np.ndarray
    unseen: np.ndarray
    penalty: float = 6.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, 0 in its best language."""
        k, out = len(self.langs), np.zeros((len(words), len(self.langs)), np.float32)
        written = np.array([[i in s for s in self.scripts] for i in range(len(NAMES))], np.int64)
        size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.searchsorted(size, np.arange(LETTERS, (size[-1] if len(size) else 0) + LETTERS, LETTERS), "right")
        begin = 0
        for end in [*ends, len(words)]:
            end = min(len(words), max(int(end), begin + 1))
            if begin >= end:
                continue
            points, at = letters_of(words[begin:end])
            total = np.zeros((len(points), k))
            for g in grams(points):
                place = np.minimum(np.searchsorted(self.keys, g), max(len(self.keys) - 1, 0))
                known = (self.keys[place] == g) if len(self.keys) else np.zeros(len(g), bool)
                total += np.where(known[:, None], self.logs[place] if len(self.keys) else 0.0, self.unseen) * (g >= 0)[:, None]
            total[at[-1] :] = 0  # no word begins at the last boundary
            sums = np.add.reduceat(total, at[:-1], axis=0)
            here = written[scripts(points.astype(np.int64))] * (points > 0)[:, None]
            fits = np.add.reduceat(here, at[:-1], axis=0)
            most = fits.max(1, keepdims=True)
            sums = np.where((fits == most) & (most > 0), sums, -np.inf)
            best = np.where(most > 0, sums.max(1, keepdims=True), 0)
            out[begin:end] = np.where(most > 0, np.maximum(sums - best, FLOOR), 0)
            begin = end
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of texts laid end to end; scores has a row for each word, lengths a number of words for each text.

    Texts are cut into lanes of STEPS words. All lanes are run together, from each language they may be entered in; the
    lanes of a text are then chained, and the labels within a lane follow from its entry and exit.
    """
    total, k = scores.shape
    labels = np.zeros(total, np.int32)
    lengths = np.asarray(lengths, np.int64)
    if not total or k == 1:
        return labels
    lanes_of = -(-lengths // STEPS)
    lanes = int(lanes_of.sum())
    first = np.cumsum(lanes_of) - lanes_of
    text_of = np.repeat(np.arange(len(lengths)), lanes_of)
    rank = np.arange(lanes) - first[text_of]
    begin = (np.cumsum(lengths) - lengths)[text_of] + rank * STEPS
    count = np.minimum(STEPS, lengths[text_of] - rank * STEPS)
    at = begin[:, None] + np.arange(STEPS)
    there = np.arange(STEPS) < count[:, None]
    s = np.where(there[..., None], scores[np.minimum(at, total - 1)], 0).astype(np.float32)
    # whole[lane, entry, exit]
    whole = np.full((lanes, k, k), -np.inf, np.float32)
    whole[:, np.arange(k), np.arange(k)] = 0
    for t in range(STEPS):
        whole = np.maximum(whole, whole.max(2, keepdims=True) - penalty) + s[:, None, t, :]
    entry = np.zeros((lanes, k), np.int8)
    value = np.zeros((len(lengths), k), np.float32)
    most = int(lanes_of.max())
    for r in range(most):
        texts = np.flatnonzero(lanes_of > r)
        lane = first[texts] + r
        both = value[texts][:, :, None] + whole[lane]
        entry[lane] = both.argmax(1)
        value[texts] = both.max(1)
    leave = np.zeros(lanes, np.int64)
    state = value.argmax(1)
    for r in range(most - 1, -1, -1):
        texts = np.flatnonzero(lanes_of > r)
        lane = first[texts] + r
        leave[lane] = state[texts]
        state[texts] = entry[lane, state[texts]]
    enter = entry[np.arange(lanes), leave]
    v = np.full((lanes, k), -np.inf, np.float32)
    v[np.arange(lanes), enter] = 0
    back = np.zeros((STEPS, lanes, k), np.int8)
    for t in range(STEPS):
        best = v.argmax(1)
        jump = v.max(1)[:, None] - penalty
        back[t] = np.where(v >= jump, np.arange(k), best[:, None])
        v = np.maximum(v, jump) + s[:, t, :]
    path = np.zeros((lanes, STEPS), np.int32)
    state = leave
    for t in range(STEPS - 1, -1, -1):
        path[:, t] = state
        state = back[t, np.arange(lanes), state].astype(np.int64)
    labels[at[there]] = path[there]
    return labels


def _labelled(model, spans):
    def run(texts: pa.Array) -> pa.Array:
        m = model.value
        words, at, lengths = split(texts)
        return _answers(m, m.word_scores(words.to_pylist()), at, lengths, spans)

    return run


def labels_of(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """As viterbi; where one language's scores sum to more than a switch costs, no path with a switch is better, and none is looked for."""
    some = np.flatnonzero(lengths)
    out = np.zeros(len(scores), np.int32)
    if not len(some):
        return out
    sums = np.add.reduceat(scores.astype(np.float64), (np.cumsum(lengths) - lengths)[some], axis=0)
    plain = sums.max(1) > -penalty
    out[:] = np.repeat(sums.argmax(1), lengths[some])
    mixed = np.repeat(~plain, lengths[some])
    out[mixed] = viterbi(scores[mixed], lengths[some][~plain], penalty)
    return out


def _answers(m: LanguageModel, scores: np.ndarray, at: np.ndarray, lengths: np.ndarray, spans: bool) -> pa.Array:
    labels, k = labels_of(scores[at], lengths, m.penalty), len(m.langs)
    of = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(of * k + labels, minlength=len(lengths) * k).reshape(-1, k)
    best = counts.argmax(1)
    names = np.where(lengths > 0, np.array(m.langs, object)[best], "und")
    share = counts[np.arange(len(lengths)), best] / np.maximum(lengths, 1)
    ends = np.cumsum(lengths)
    edge = np.flatnonzero((labels[1:] != labels[:-1]) | (of[1:] != of[:-1])) + 1
    begin = np.concatenate([[0], edge]) if spans and len(labels) else np.zeros(0, np.int64)
    stop = np.concatenate([edge, [len(labels)]]) if len(begin) else begin
    runs = pa.StructArray.from_arrays(
        [pa.array((begin - (ends - lengths)[of[begin]]).astype(np.int32)), pa.array((stop - begin).astype(np.int32)), pa.array(np.array(m.langs, object)[labels[begin]] if len(begin) else [], pa.string())], ["start", "n_words", "lang"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of[begin], minlength=len(lengths)) if len(begin) else np.zeros(len(lengths), np.int64))])
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share), pa.array(lengths.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)], ["lang_pred", "score", "n_words", "spans"])


def _counted(batches):
    """(lang, gram, n) of each batch of (lang, text)."""
    for b in batches:
        langs = b["lang"].dictionary_encode()
        for i, lang in enumerate(langs.dictionary):
            words, at, _ = split(b["text"].filter(pc.equal(langs.indices, i)))
            if not len(at):
                continue
            points, begin = letters_of(words.to_pylist())
            times = np.repeat(np.bincount(at, minlength=len(words)), np.diff(begin))
            found = [(g[:-1], times * (g[:-1] >= 0)) for g in grams(points)]
            keys, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([t for _, t in found])).astype(np.int64)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * int(some.sum()), pa.string()), pa.array(keys[some]), pa.array(n[some])], names=["lang", "gram", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_texts: int = 6000, penalty: float = 6.0) -> LanguageModel:
    """A model from rows with a text and a language.

    max_texts bounds the labelled rows learnt from (about so many, drawn by the hash of key); their whole texts are counted, and the counts of their
    grams, which the bound also bounds, come to the driver. Rows without text or language teach nothing.
    """
    python_ready(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    some = sampled(rows, max_texts, "k").select("lang", "text")
    got = some.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return LanguageModel([], [], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), penalty)
    keys, at = np.unique(got["gram"].to_numpy(np.int64), return_inverse=True)
    n = np.zeros((len(keys), len(langs)))
    n[at, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = got["n"].to_numpy()
    total = n.sum(0)
    unseen = np.log(0.5 / (total + 1))
    logs = np.where(n > 0, np.log((n + 0.5) / (total + 1)), unseen)
    single = np.flatnonzero((keys < 1 << 21) & (keys > 1))
    held = np.zeros((len(NAMES), len(langs)))
    np.add.at(held, scripts(keys[single] - 1), n[single])
    return LanguageModel(langs, [set(np.flatnonzero(held[:, i] >= max(0.01 * held[:, i].sum(), 1)).tolist()) for i in range(len(langs))], keys, logs, unseen, penalty)


def label(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language", spans: bool = True) -> DataFrame:
    """docs with a column `out`: struct(lang_pred, score, n_words, spans(start word, n_words, lang)).

    lang_pred is the language of most words, score its share of them. A null or empty text, and one without a letter, is
    `und` with score 0 and no spans, and so is any text under a model without languages. Ties go to the language that is
    first in the alphabet. Texts and words of any length are read whole; repeated rows are labelled alike; an existing column `out` is replaced, other
    columns stay whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    python_ready(spark)
    if not model.langs:
        return docs.withColumn(out, F.from_json(F.lit('{"lang_pred":"und","score":0.0,"n_words":0,"spans":[]}'), LABELLED))
    run = F.arrow_udf(_labelled(spark.sparkContext.broadcast(model), spans), LABELLED)
    return docs.withColumn(out, run(F.col(text)))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; learns from rows whose fold of five is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0))
    done = label(docs.select("doc_id", "text"), model, spans=False)
    return done.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
