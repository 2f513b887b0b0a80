"""Operator 4: language identification of mixed-language text.

A word is a run of letters. Its script ranges narrow the languages it can be in to those seen with
that script in training; among them it has a score, the sum of log likelihood ratios of its letter
n-grams (with word borders) under each language. Viterbi decoding over a text's words, with a
penalty for every change of language, labels spans; the text's language is the one whose spans hold
most letters, its score their share of all letters.

The model is a fixed table of n-gram buckets fitted on a bounded sample of labelled rows
(``fit_rows`` documents, by a hash of the id, so any order or partitioning gives the same sample).
Counts are made and added up by Spark; the driver receives at most buckets x languages sums.

Prediction decodes many texts side by side with array operations, in groups of similar length, so
the cost per word is constant and memory is bounded by a group.

Defined cases: null text and text without a letter is ``und`` with score 0 and no span; with no
labelled row nothing can be learned and everything is ``und``; ties take the language that sorts
first; a long text is read whole, by a task of its own group; an empty table gives an empty result;
rows are judged one by one; other columns are neither read nor changed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import fresh_name, small_batches

#: Upper ends of code point ranges and the script that each range holds (fixed values).
SCRIPT_ENDS = [
    (0x02AF, "latin"), (0x036F, "mark"), (0x03FF, "greek"), (0x052F, "cyrillic"), (0x058F, "armenian"), (0x05FF, "hebrew"), (0x08FF, "arabic"),
    (0x097F, "devanagari"), (0x0DFF, "indic"), (0x0EFF, "thai"), (0x0FFF, "tibetan"), (0x109F, "myanmar"), (0x10FF, "georgian"), (0x11FF, "hangul"),
    (0x1DFF, "other"), (0x1EFF, "latin"), (0x1FFF, "greek"), (0x303F, "other"), (0x30FF, "kana"), (0x31FF, "hangul"), (0xABFF, "han"), (0xD7FF, "hangul"), (0x10FFFF, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_ENDS})
_ENDS = np.array([e for e, _ in SCRIPT_ENDS], dtype=np.uint32)
_NAMES = np.array([SCRIPTS.index(s) for _, s in SCRIPT_ENDS], dtype=np.uint8)
SPANS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))),
])
NGRAMS = (2, 3, 4)
UNIT = 1024
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower case as a number, or 0 if it is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x323B0):
            s = chr(c)
            if s.isalpha():
                table[c] = ord(s.lower()[0])
        _letters = table
    return _letters


class Words:
    """The words of a list of texts, laid end to end with zeros around each text.

    ``begin``/``end``: code point places in the joined text; ``doc``: text of each word; ``lower``:
    letters with zeros between words.
    """

    def __init__(self, texts: list[str]):
        joined = "\0" + "".join(t + "\0" for t in texts) + "\0" * max(NGRAMS)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.lower = letters()[points]
        turn = np.diff((self.lower != 0).astype(np.int8))
        self.begin = np.flatnonzero(turn == 1) + 1
        self.end = np.flatnonzero(turn == -1) + 1
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.offset = np.cumsum(lengths) - lengths + 1
        self.doc = np.searchsorted(self.offset, self.begin, side="right") - 1

    def slices(self, size: int = 1 << 18):
        """Ranges of words that cover about ``size`` places each."""
        a = 0
        while a < len(self.begin):
            b = max(a + 1, int(np.searchsorted(self.end, self.begin[a] + size, side="right")))
            yield a, b
            a = b

    def scripts(self) -> np.ndarray:
        """Script of each word, by its first letter."""
        return _NAMES[np.searchsorted(_ENDS, self.lower[self.begin])]


def grams(lower: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where an n-gram within one word, with its borders, starts, and the n-grams' buckets.
    Borders count as letter 0."""
    places = max(0, len(lower) - n + 1)
    inside = lower != 0
    ok = np.ones(places, dtype=bool)
    for i in range(1, n - 1):
        ok &= inside[i : i + places]
    if n == 2:
        ok = inside[:places] | inside[1 : 1 + places]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        h = (h ^ lower[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, ((h + np.uint64(n * 0xD1B54A32D192ED03 % (1 << 64))) % np.uint64(size)).astype(np.intp)


class Model:
    """``table``: log likelihood ratios of the buckets in whole ``UNIT``-ths, so that sums are exact
    and a word's score doesn't depend on the words around it."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray, penalty: float):
        self.langs, self.table, self.scripts, self.penalty = langs, table, scripts, penalty

    def word_scores(self, w: Words) -> np.ndarray:
        """Words x languages; languages not seen with a word's script get a low score, unless none was."""
        scores = np.zeros((len(w.begin), len(self.langs)))
        for a, b in w.slices():
            first = w.begin[a] - 1
            lower = w.lower[first : w.end[b - 1] + 1]
            at = np.zeros((len(lower), len(self.langs)), dtype=np.int32)
            for k in NGRAMS:
                places, buckets = grams(lower, k, len(self.table))
                at[places] += self.table[buckets]
            total = np.cumsum(at, axis=0, dtype=np.int64)
            begin, end = w.begin[a:b] - first - 1, w.end[a:b] - first - 1
            scores[a:b] = (total[end] - total[begin] + at[begin]) / UNIT
        allowed = self.scripts[:, w.scripts()].T
        none = ~allowed.any(axis=1)
        scores = np.where(allowed, scores, -1e3)
        scores[none] = 0.0
        return scores

    def label(self, texts: list[str]) -> list[tuple]:
        """``(language, score, spans)`` of each text, spans in code points."""
        w = Words(texts)
        if not len(w.begin):
            return [("und", 0.0, [])] * len(texts)
        scores = self.word_scores(w)
        path = viterbi(scores, w.doc, len(texts), self.penalty)
        size = (w.end - w.begin).astype(np.float64)
        shares = np.zeros((len(texts), len(self.langs)))
        np.add.at(shares, (w.doc, path), size)
        total, best = shares.sum(axis=1), shares.argmax(axis=1)
        new = np.ones(len(path), dtype=bool)
        new[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(path)) - 1
        spans: list[list] = [[] for _ in texts]
        for a, b, d, p in zip(w.begin[first], w.end[last], w.doc[first], path[first]):
            spans[d].append({"start": int(a - w.offset[d]), "end": int(b - w.offset[d]), "lang": self.langs[p]})
        return [(self.langs[best[i]], float(shares[i, best[i]] / total[i]), spans[i]) if total[i] else ("und", 0.0, []) for i in range(len(texts))]


#: With fewer texts side by side than this, plain loops are faster than array operations.
FEW = 16


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best language of each word. Texts are decoded side by side, word by word, longest first; the
    last few long ones are decoded one by one."""
    n, L = scores.shape
    if not n:
        return np.empty(0, dtype=np.intp)
    counts = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    kind = np.min_scalar_type(L)
    back = np.empty((n, L), dtype=kind)
    path = np.empty(n, dtype=np.intp)
    active = int((counts > 0).sum())
    best = scores[first[:active]].copy()
    stay = np.arange(L, dtype=kind)
    alive, t = [active], 1
    while t < counts[0]:
        active = int(np.searchsorted(-counts, -t, side="left"))  # texts of more than t words
        if active < FEW:
            break
        alive.append(active)
        now = best[:active]
        top = now.argmax(axis=1)
        switch = now[np.arange(active), top] - penalty
        move = switch[:, None] > now
        at = first[:active] + t
        back[at] = np.where(move, top[:, None].astype(kind), stay)
        best[:active] = np.where(move, switch[:, None], now) + scores[at]
        t += 1
    label = best.argmax(axis=1)
    for d in range(active if t < counts[0] else 0):
        label[d] = _rest(scores[first[d] + t : first[d] + counts[d]], best[d].tolist(), penalty, path[first[d] + t : first[d] + counts[d]])
    for u in range(t - 1, -1, -1):
        live = alive[u]
        at, now = first[:live] + u, label[:live]
        path[at] = now
        if u:
            label[:live] = back[at, now]
    return path


def _rest(scores: np.ndarray, best: list[float], penalty: float, path: np.ndarray) -> int:
    """Decodes the words of one text that follow a state ``best``; fills ``path`` and returns the
    language of the word before them."""
    backs = []
    for row in scores.tolist():
        top = max(best)
        at, switch = best.index(top), top - penalty
        back = [at if switch > b else k for k, b in enumerate(best)]
        best = [max(b, switch) + x for b, x in zip(best, row)]
        backs.append(back)
    now = best.index(max(best))
    for u in range(len(backs) - 1, -1, -1):
        path[u] = now
        now = backs[u][now]
    return now


def fit(docs: DataFrame, fit_rows: int = 20_000, buckets: int = 1 << 17, penalty: float = 12.0, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the table on about ``fit_rows`` labelled rows (all, if there are fewer)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))

    def count(batches):
        import pyarrow as pa

        table: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                at = table.setdefault(lang, np.zeros(buckets + len(SCRIPTS), dtype=np.int64))
                w = Words(texts)
                for a, b in w.slices():
                    for k in NGRAMS:
                        at[:buckets] += np.bincount(grams(w.lower[w.begin[a] - 1 : w.end[b - 1] + 1], k, buckets)[1], minlength=buckets)
                at[buckets:] += np.bincount(w.scripts(), minlength=len(SCRIPTS))
        for lang, at in table.items():
            some = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(at[some], pa.int64())], names=["lang", "k", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((buckets + len(SCRIPTS), max(1, len(langs))), dtype=np.float64)
    if len(langs):
        table[counts["k"].to_numpy(), np.searchsorted(np.array(langs), counts["lang"].to_numpy(dtype=str))] = counts["n"].to_numpy()
    sums, scripts = table[:buckets], table[buckets:]
    p = np.log((sums + smoothing) / (sums.sum(axis=0) + smoothing * buckets))
    p -= p.mean(axis=1, keepdims=True)
    p[sums.sum(axis=1) == 0] = 0.0
    seen = scripts >= np.maximum(1, 1e-4 * scripts.sum(axis=0))
    return Model(langs, np.rint(p * UNIT).astype(np.int16), seen.T, penalty)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language", group: int = 400_000) -> DataFrame:
    """``docs`` and a struct ``out`` (its name made fresh): lang, score and labelled spans. ``group``:
    letters decoded at once."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def run(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        rows: list = [("und", 0.0, [])] * len(texts)
        if model.langs:
            values = [t or "" for t in texts]
            order = sorted((i for i in range(len(values)) if values[i]), key=lambda i: len(values[i]))
            while order:
                take, size = [], 0
                while order and (not take or size + len(values[order[-1]]) <= group):
                    size += len(values[order[-1]])
                    take.append(order.pop())
                for i, row in zip(take, model.label([values[i] for i in take])):
                    rows[i] = row
        return pd.DataFrame(rows, columns=["lang", "score", "spans"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    # not deterministic for the optimizer: else each use of the struct's fields would label all texts again
    return docs.withColumn(fresh_name(docs, out), F.pandas_udf(run, SPANS).asNondeterministic()(F.col(text_col)))
