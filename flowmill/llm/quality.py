"""Operator 5: quality rules over words, and line labels by a linear-chain conditional random field.

Base figures count words, symbols, repeated lines and repeated five-word windows of the whole text.
The field labels every line as content or boilerplate by Viterbi decoding; the share of characters
in content lines decides on the document.

The field is trained here on a bounded sample: about ``fit_rows`` documents with a quality label, by a
hash of the id, and all their lines, in runs of ``RUN``. Only documents are labelled, so line labels
are hidden variables under one constraint: of a good document most characters are expected in content lines, of a bad one in boilerplate lines. Training alternates
between posterior labels nearest to the field's own that meet the constraint, and the exact gradient
of the field towards them (forward-backward), so prose lines in a bad document may be content and the
other way round. Line features are made by Spark; the driver receives masks and lengths of the sample.

Defined cases: null text has no word and fails the base rules; a blank line is neither content nor
boilerplate for the share; a text of blank lines alone has no word; without labels of both kinds every
line is content and the base rules decide alone; long texts are read and labelled whole; an empty
table gives an empty result; an id whose labels disagree is not trained on; rows
are judged one by one; other columns don't matter, and one that is already named like the result keeps
its name (see ``fresh_name``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import fresh_name, saved

FEATURES = ("bias", "upper", "symbols", "many symbols", "bars", "repeated line", "repeated words", "one or two words", "long line", "ends a sentence", "digits", "starts lower", "shouting", "few letters")
BLANK = -1
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FIGURES = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("content_share", T.DoubleType()), T.StructField("labels", T.ArrayType(T.BooleanType())),
])


def mask(line: str, repeated: bool) -> int:
    """The binary features of a line as bits; BLANK for a line without a word."""
    words = line.split()
    if not words:
        return BLANK
    n, size = len(words), len(line)
    symbols = sum(line.count(c) for c in SYMBOLS)
    out = 1
    out |= 2 * line.isupper()
    out |= 4 * (symbols > 0)
    out |= 8 * (2 * symbols > n)
    out |= 16 * (4 * line.count("|") > n)
    out |= 32 * repeated
    out |= 64 * (n > 3 and 2 * len(set(words)) < n)
    out |= 128 * (n < 3)
    out |= 256 * (size > 2000)
    out |= 512 * (words[-1][-1] in ".!?")
    out |= 1024 * (5 * sum(map(line.count, "0123456789")) > size)
    out |= 2048 * words[0][0].islower()
    out |= 4096 * (2 * line.count("!") > n)
    out |= 8192 * (sum(map(str.isalpha, words)) * 4 < n)
    return out


def repeats(words: list[bytes], k: int = 5) -> int:
    """How many words lie in windows of ``k`` words that occur twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(k))))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    twice = set()
    for i, w in enumerate(windows):
        j = seen.setdefault(w, i)
        if j != i:
            twice.add(j)
            twice.add(i)
    count = upto = 0
    for i in sorted(twice):
        count += i + k - max(i, upto)
        upto = i + k
    return count


def masks(text: str) -> tuple[list[int], list[int], int]:
    """Feature mask and length of each line, and how many lines with a word repeat an earlier one."""
    lines = text.split("\n")
    seen: set[str] = set()
    out, again = [], 0
    for line in lines:
        old = line in seen
        seen.add(line)
        m = mask(line, old)
        again += old and bool(line.strip(SPACES))
        out.append(m)
    return out, [len(x) for x in lines], again


class Field:
    """Weights of the two labels (0 boilerplate, 1 content) per feature and label change."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.cache: dict[int, tuple[float, float]] = {}

    def emission(self, m: int) -> tuple[float, float]:
        if m not in self.cache:
            bits = [(m >> k) & 1 for k in range(len(FEATURES))]
            self.cache[m] = tuple(float(np.dot(self.weights[y], bits)) for y in (0, 1))
        return self.cache[m]

    def decode(self, line_masks: list[int]) -> list[int | None]:
        """Best labels of the lines (None for blank ones, which the chain skips). Ties: content."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        a = b = 0.0
        backs = []
        for m in line_masks:
            if m == BLANK:
                continue
            e0, e1 = self.emission(m)
            if backs:
                from0, from1 = (a + m00 > b + m10), (b + m11 >= a + m01)
                a, b = (a + m00 if from0 else b + m10) + e0, (b + m11 if from1 else a + m01) + e1
                backs.append((0 if from0 else 1, 1 if from1 else 0))
            else:
                a, b = e0, e1
                backs.append((0, 1))
        y, path = (1 if b >= a else 0), []
        for back in reversed(backs):
            path.append(y)
            y = back[y]
        labels = iter(reversed(path))
        return [None if m == BLANK else next(labels) for m in line_masks]


#: A field without training: every line is content.
NO_FIELD = Field(np.array([[-1.0] + [0.0] * (len(FEATURES) - 1), [1.0] + [0.0] * (len(FEATURES) - 1)]), np.zeros((2, 2)))


#: Lines in a run, the unit of training.
RUN = 32


class Runs:
    """Runs of lines as arrays, time first: feature masks by number, lengths, places in use."""

    def __init__(self, runs: list[tuple[list[int], list[int], int]]):
        self.y = np.array([y for _, _, y in runs])
        T_, D = max(len(m) for m, _, _ in runs), len(runs)
        masks, size, self.on = np.zeros((T_, D), dtype=np.int64), np.zeros((T_, D)), np.zeros((T_, D), dtype=bool)
        for d, (m, n, _) in enumerate(runs):
            masks[: len(m), d], size[: len(m), d], self.on[: len(m), d] = m, n, True
        self.share = size / size.sum(axis=0)  # of the run's characters
        known, at = np.unique(masks, return_inverse=True)
        self.at = at.reshape(masks.shape)
        self.x = ((known[:, None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)
        lines = self.on.sum(axis=0)
        self.weight = np.where(self.y == 1, 0.5 / max(1, lines[self.y == 1].sum()), 0.5 / max(1, lines[self.y == 0].sum()))  # both labels count alike

    def marginals(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities (time, run, label), pair probabilities summed over time (run, label,
        label) and the log partition function of each run."""
        T_, D = self.on.shape
        top = scores.max(axis=2, keepdims=True)
        psi, move = np.exp(scores - top), np.exp(moves)
        alpha, beta, log_z = np.empty((T_, D, 2)), np.ones((T_, D, 2)), (top[..., 0] * self.on).sum(axis=0)
        for t in range(T_):
            now = psi[t] if t == 0 else (alpha[t - 1] @ move) * psi[t]
            scale = now.sum(axis=1)
            on = self.on[t]
            alpha[t] = np.where(on[:, None], now / scale[:, None], alpha[t - 1] if t else 0.0)
            log_z += np.where(on, np.log(scale), 0.0)
        for t in range(T_ - 2, -1, -1):
            back = (psi[t + 1] * beta[t + 1]) @ move.T
            beta[t] = np.where(self.on[t + 1][:, None], back / back.sum(axis=1, keepdims=True), 1.0)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        pairs = np.zeros((D, 2, 2))
        for t in range(1, T_):
            pair = alpha[t - 1][:, :, None] * move * (psi[t] * beta[t])[:, None, :]
            pairs += np.where(self.on[t], 1.0, 0.0)[:, None, None] * pair / pair.sum(axis=(1, 2), keepdims=True)
        return p * self.on[..., None], pairs, log_z

    def counts(self, p: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted expected features by label, and label pairs."""
        w = p * self.weight[:, None]
        by_mask = np.stack([np.bincount(self.at.ravel(), w[..., k].ravel(), minlength=len(self.x)) for k in (0, 1)])
        return by_mask @ self.x, np.einsum("dyz,d->yz", pairs, self.weight)

    def constrained(self, scores: np.ndarray, moves: np.ndarray, margin: float = 0.1, halvings: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the distribution nearest to the field's whose expected content share is at
        least 1/2 + margin in good runs and at most 1/2 - margin in bad ones: a bias towards the run's
        label in proportion to a line's share, found by halving."""
        sign = np.where(self.y == 1, 1.0, -1.0)
        low, high = np.zeros(len(self.y)), np.full(len(self.y), 64.0)
        p, pairs, _ = self.marginals(scores, moves)
        met = sign * ((p[..., 1] * self.share).sum(axis=0) - 0.5) >= margin
        if met.all():
            return p, pairs
        for _ in range(halvings):
            bias = np.where(met, 0.0, (low + high) / 2)
            p, pairs, _ = self.marginals(self._biased(scores, sign * bias), moves)
            ok = sign * ((p[..., 1] * self.share).sum(axis=0) - 0.5) >= margin
            low, high = np.where(ok, low, bias), np.where(ok, bias, high)
        return self.marginals(self._biased(scores, sign * np.where(met, 0.0, high)), moves)[:2]

    def _biased(self, scores: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = scores.copy()
        out[..., 1] += bias * self.share
        return out

    def scores(self, w: np.ndarray) -> np.ndarray:
        return (self.x @ w.T)[self.at]

    def objective(self, w: np.ndarray, moves: np.ndarray, seen: tuple[np.ndarray, np.ndarray], ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Expected log likelihood of labels with the counts ``seen``, and its gradient."""
        p, pairs, log_z = self.marginals(self.scores(w), moves)
        x, m = self.counts(p, pairs)
        value = (seen[0] * w).sum() + (seen[1] * moves).sum() - (log_z * self.weight).sum() - ridge / 2 * ((w**2).sum() + (moves**2).sum())
        return float(value), seen[0] - x - ridge * w, seen[1] - m - ridge * moves


def train(documents: list[tuple[list[int], list[int], int]], rounds: int = 10, steps: int = 10, rate: float = 1.0, ridge: float = 1e-5) -> Field:
    """A field from (line masks, line lengths, label) of documents. First every line takes its
    document's label and label changes are free; then labels and field are fitted in turns."""
    parts = []
    for masks_, sizes, y in documents:
        lines = [(m, n) for m, n in zip(masks_, sizes) if m != BLANK]
        parts += [([m for m, _ in lines[i : i + RUN]], [n for _, n in lines[i : i + RUN]], y) for i in range(0, len(lines), RUN)]
    if len({y for _, _, y in parts}) < 2:
        return NO_FIELD
    runs = Runs(parts)
    w, moves = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
    hot = np.eye(2)[runs.y][None] * runs.on[..., None]
    seen = runs.counts(hot, np.zeros((len(runs.y), 2, 2)))
    for k in range(rounds):
        if k:
            seen = runs.counts(*runs.constrained(runs.scores(w), moves))
        g2w, g2m = 1e-8, 1e-8
        for _ in range(steps * (1 if k else 3)):
            _, gw, gm = runs.objective(w, moves, seen, ridge)
            g2w, g2m = g2w + gw**2, g2m + gm**2
            w = w + rate * gw / np.sqrt(g2w)
            if k:
                moves = moves + rate * gm / np.sqrt(g2m)
    return Field(w, moves)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Trains on about ``fit_rows`` labelled documents, on all lines of each."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    rows = saved(rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most"), "labels")
    small = rows.count() <= 10 * fit_rows  # else one id was repeated in most labels, and the rest is too much to send
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(rows) if small else rows, "id")

    def features(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            m, sizes, _ = masks(text)
            lines = [(a, b) for a, b in zip(m, sizes) if a != BLANK]
            out.append(([a for a, _ in lines], [b for _, b in lines]))
        return pd.DataFrame(out, columns=["m", "n"])

    features.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    found = sample.select("id", "y", F.pandas_udf(features, "m array<int>, n array<int>")("text").alias("f")).select("id", "y", "f.m", "f.n").toPandas()
    found["order"] = found["m"].map(lambda m: tuple(int(v) for v in m))  # repeated ids in one order
    found = found.sort_values(["id", "order"])
    return train([(list(o), [int(v) for v in n], int(y)) for o, n, y in zip(found["order"], found["n"], found["y"])])


def with_figures(docs: DataFrame, field: Field, text_col: str = "text", out: str = "figures") -> DataFrame:
    """``docs`` and a struct ``out`` (its name made fresh): base figures, content share and the label of each line."""
    weights = (field.weights, field.moves)

    def run(texts: pd.Series) -> pd.DataFrame:
        field, rows = Field(*weights), []
        for text in texts:
            text = text or ""
            words = text.encode("utf-8", "surrogatepass").split()
            line_masks, sizes, again = masks(text)
            labels = field.decode(line_masks)
            total = sum(s for s, y in zip(sizes, labels) if y is not None)
            content = sum(s for s, y in zip(sizes, labels) if y)
            rows.append((
                len(words), len(text) - sum(map(text.count, SPACES)) if words else 0, sum(map(text.count, SYMBOLS)), again, repeats(words),
                content / total if total else 0.0, [None if y is None else bool(y) for y in labels],
            ))
        return pd.DataFrame(rows, columns=FIGURES.names)

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return docs.withColumn(fresh_name(docs, out), F.pandas_udf(run, FIGURES)(F.col(text_col)))


def judged(docs: DataFrame, field: Field, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base figures, whether the base rules failed, and whether it is kept."""
    rows = with_figures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), field)
    f = F.col("figures")
    failed = (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)
    names = FIGURES.names[:5]
    return rows.select("doc_id", *(f[n].alias(n) for n in names), failed.alias("base_failed"), (~failed & (f.content_share >= least_share)).alias("kept"), f.content_share.alias("content_share"))
