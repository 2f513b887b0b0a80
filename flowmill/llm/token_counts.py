"""Operator 7: token counts under a unigram model, with forward scores shared over a trie.

A text is cut into pre-tokens; a pre-token's count is the number of pieces on its best path under
the model (highest sum of scores; of equal ones the fewest pieces). The distinct pre-tokens of a
batch are put in sorted order, which is the depth-first order of their trie: the forward scores of
a prefix stay on a stack and are computed once for all pre-tokens that share it. Terminal counts are
stored, so a later batch computes only what is new; the store is emptied beyond ``most`` entries.

The vocabulary is a public rank file, whose path is a parameter; it has no probabilities, so a
piece of rank r scores -log(r + 10), by Zipf's law. All bytes are pieces, so every text has a path.
Texts stay where they are: nothing is shuffled, and a task holds one batch and the store.

Defined cases: null and empty text has no pre-token and no token; rows are counted one by one;
long texts are counted whole; an empty table gives an empty result;
other columns are kept as they are, also one that is already named like the result (see ``fresh_name``).
"""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import fresh_name

#: How byte-level vocabularies split a text (fixed value, as published with them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def read_scores(path: str) -> dict[bytes, float]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): -math.log(int(rank) + 10) for piece, rank in map(bytes.split, f)}


def trie_counts(pretokens: list[bytes], scores: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Pieces on the best path of each distinct pre-token; prefixes are scored once."""
    best, count = [0.0], [0]
    out, before = {}, b""
    get = scores.get
    for token in sorted(pretokens):
        shared, most = 0, min(len(before), len(token))
        while shared < most and before[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            top, least = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = get(token[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or s == top and count[start] + 1 < least:
                        top, least = s, count[start] + 1
            best.append(top)
            count.append(least)
        out[token] = count[-1]
        before = token
    return out


class Counter:
    """Counts of texts. Chunks between single spaces are independent of each other and remembered."""

    def __init__(self, path: str, most: int = 400_000):
        import regex

        self.scores = read_scores(path)
        self.longest = max(map(len, self.scores))
        self.split = regex.compile(PATTERN).findall
        self.most, self.known = most, {}

    def _learn(self, chunks: set[str]) -> None:
        parts = {c: [p.encode("utf-8", "surrogatepass") for p in self.split(c)] for c in chunks}
        counts = trie_counts(list({p for ps in parts.values() for p in ps}), self.scores, self.longest)
        if len(self.known) + len(chunks) > self.most:
            self.known.clear()
        for c, ps in parts.items():
            self.known[c] = (len(ps), sum(map(counts.__getitem__, ps)))

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        cut = [chunks(t) for t in texts]
        new = {c for cs in cut for c in cs}
        new.difference_update(self.known)
        if new:
            if len(self.known) + len(new) > self.most:  # the store is emptied, so all of the batch is new
                new = {c for cs in cut for c in cs}
            self._learn(new)
        rows = []
        for cs in cut:
            found = [self.known[c] for c in cs]
            rows.append((sum(a for a, _ in found), sum(b for _, b in found)))
        return rows


def chunks(text: str) -> list[str]:
    """Cuts before single spaces that stand between two characters that are not white space; no
    pre-token reaches over such a place."""
    if not text:
        return []
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if not p or p[0].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return [c for c in out if c]


def with_token_counts(docs: DataFrame, ranks: str, text_col: str = "text", out: str = "tokens", group: int = 500) -> DataFrame:
    """``docs`` and a struct ``out`` (its name made fresh) of pre-tokens and tokens. ``ranks``: path of the rank file."""
    made: list[Counter] = []

    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Counter(ranks))
        values, rows = [t or "" for t in texts], []
        for i in range(0, len(values), group):
            rows += made[0].counts(values[i : i + group])
        return pd.DataFrame(rows, columns=COUNTS.names)

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return docs.withColumn(fresh_name(docs, out), F.pandas_udf(run, COUNTS)(F.col(text_col)))
