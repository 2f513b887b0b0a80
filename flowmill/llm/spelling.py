"""Operator 11: spelling variants of words, by forward and backward automata.

1. Words are counted with partial sums in the tasks: maximal runs of letters in whole texts, A-Z in lower
   case; a fixed share of the (document, run) pairs, chosen by a checksum, loses one code point.
2. Two words one error apart agree exactly in the first or in the last half of either of them. So every word, as
   a query, goes to the bucket of its first half and, reversed, to that of its last half; as an entry it
   goes to the buckets of the halves that queries of its length, one less and one more would have.
3. A task streams its sorted buckets. Of a bucket's entries it builds the minimal acyclic automaton, whose
   states know how many words they lead to, so a path gives the word's number and with it its count. A
   query matches its half exactly and completes the rest with one inserted, deleted or replaced code point.
4. What both directions find counts in the forward one; within a direction numbers are a set.
5. Each word's number of near words and its most frequent one are aggregated; roots follow the forms by
   doubling, since counts grow fivefold at every step.

A bucket with more than ``block_words`` entries is dealt over blocks, each with its own automaton, and its
queries go to every block; so no task holds a bucket that grows with the data. Nothing is capped.

Defined cases: a null text has no words; a null id counts as the empty string in the checksum; a text of any length is read whole
and in one task; rows that repeat an id count each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import removed, saved, small_batches

LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Texts from this length on are read in steps, so that their runs are never all in memory.
LONG = 1 << 22


def runs_of(text: str, least: int) -> Counter:
    """Counts of the maximal runs of at least ``least`` letters, A-Z in lower case."""
    word = re.compile(f"[{LETTERS}]{{{least},}}")
    found = Counter(word.findall(text) if len(text) < LONG else (m.group() for m in word.finditer(text)))
    out: Counter = Counter()
    for run, n in found.items():
        out[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return out


def word_counts(docs: DataFrame, least: int = 6, drop_one_in: int = 199, id_col: str = "doc_id", text_col: str = "text", held: int = 200_000) -> DataFrame:
    """``(word, n)`` over whole texts; ``drop_one_in``: the share of changed (document, run) pairs, 0 for none."""

    def tally(batches):
        import pyarrow as pa

        total: Counter = Counter()

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                if not (text := text.as_py()):
                    continue
                mark = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for run, n in runs_of(text, least).items():
                    if drop_one_in:
                        h = zlib.crc32(run.encode(), mark)
                        if h % drop_one_in == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least:
                                continue
                    total[run] += n
                if len(total) > held:
                    yield flushed()
                    total.clear()
        yield flushed()

    small_batches(docs.sparkSession)
    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(tally, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of words given in ascending order, with word numbers.

    A state is ``(final, edges)`` with ``edges`` a dictionary from a character to ``(offset, target)``: offset
    is the number of words that come before those over this edge.
    """

    def __init__(self, words: list[str]):
        self.register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.size: list[int] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        path: list[list] = [[False, []]]  # final, [(character, state)]: the states of the last word
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list[list], word: str, upto: int) -> None:
        while len(path) - 1 > upto:
            final, edges = path.pop()
            path[-1][1].append((word[len(path) - 1], self._state(final, edges)))

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, tuple(edges))
        if (at := self.register.get(key)) is None:
            at, before, out = len(self.final), int(final), {}
            for c, target in edges:
                out[c] = (before, target)
                before += self.size[target]
            self.register[key] = at
            self.final.append(final)
            self.size.append(before)
            self.edges.append(out)
        return at

    def walk(self, state: int, text: str, number: int = 0) -> tuple[int, int] | None:
        for c in text:
            if (edge := self.edges[state].get(c)) is None:
                return None
            number, state = number + edge[0], edge[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The word's place in ascending order, from 0."""
        end = self.walk(self.start, word)
        return end[1] if end and self.final[end[0]] else None

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with ``word[:exact]`` and differ from ``word`` by one code point after it."""
        found: set[int] = set()
        here = self.walk(self.start, word[:exact])

        def ends(state, number, rest):
            end = self.walk(state, rest, number)
            if end and self.final[end[0]]:
                found.add(end[1])

        for i in range(exact, len(word) + 1):
            if here is None:
                break
            state, number = here
            rest = word[i + 1 :]
            if i < len(word):
                ends(state, number, rest)
            for c, (offset, target) in self.edges[state].items():
                if i < len(word) and c != word[i]:
                    ends(target, number + offset, rest)
                ends(target, number + offset, word[i:])
            here = self.walk(state, word[i], number) if i < len(word) else None
        return found


def halves(length: int) -> tuple[int, int]:
    """Lengths of the exact part of a query: forward its first half, backward the rest."""
    return length // 2, length - length // 2


def entries(words: DataFrame, least: int, block_words: int) -> DataFrame:
    """``(way, length, half, block, query, s, n)``: every word as a query and as entries of buckets; ``s`` is
    reversed for the backward way (1), ``length`` is that of the bucket's queries."""
    two = F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("s")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s")))
    rows = words.select(F.explode(two).alias("e"), "n").select("e.way", "e.s", "n")
    exact = lambda way, length: F.when(way == 0, F.floor(length / 2)).otherwise(length - F.floor(length / 2)).cast("int")
    size = F.length("s")

    def keyed(df: DataFrame, length: Column) -> DataFrame:
        return df.withColumn("length", length).withColumn("half", F.substring(F.col("s"), F.lit(1), exact(F.col("way"), F.col("length"))))

    stored = keyed(rows, F.explode(F.array(size - 1, size, size + 1))).where(F.col("length") >= least)
    asked = keyed(rows, size)
    bucket = ["way", "length", "half"]
    large = stored.groupBy(*bucket).count().where(F.col("count") > block_words).select(*bucket, F.ceil(F.col("count") / block_words).alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    stored = stored.join(large, bucket, "left").withColumn("block", F.pmod(F.xxhash64("s"), blocks))
    asked = asked.join(large, bucket, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cut = ["way", "length", "half", F.col("block").cast("long").alias("block")]
    return stored.select(*cut, F.lit(False).alias("query"), "s", "n").unionByName(asked.select(*cut, F.lit(True).alias("query"), "s", "n"))


def near_words(words: DataFrame, least: int = 6, block_words: int = 1 << 16) -> DataFrame:
    """``(word, n_near, best)`` for words with near ones; ``best``: struct (n, word) of the most frequent, ties
    to the first word in code-point order."""

    def match(batches):
        import pyarrow as pa

        bucket, stored, counts, automaton = None, [], [], None
        out: dict[str, list] = {"word": [], "n_near": [], "n": [], "near": []}

        def batch():
            got = pa.RecordBatch.from_pydict(out, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("n", pa.int64()), ("near", pa.string())]))
            for v in out.values():
                v.clear()
            return got

        for b in batches:
            for way, length, half, block, query, s, n in zip(*(c.to_pylist() for c in b.columns)):
                if (way, length, half, block) != bucket:
                    bucket, stored, counts, automaton = (way, length, half, block), [], [], None
                if not query:
                    stored.append(s)
                    counts.append(n)
                    continue
                if not stored:
                    continue
                if automaton is None:
                    automaton = Automaton(stored)
                numbers = automaton.one_error(s, len(half))
                near = [(-counts[i], stored[i] if way == 0 else stored[i][::-1]) for i in numbers]
                word = s
                if way == 1:
                    word = s[::-1]
                    first = word[: halves(length)[0]]
                    near = [x for x in near if not x[1].startswith(first)]
                if near:
                    n_best, best = min(near)
                    for k, v in zip(out, (word, len(near), -n_best, best)):
                        out[k].append(v)
            yield batch()

    order = ["way", "length", "half", "block", "query", "s"]
    rows = entries(words, least, block_words).repartition("way", "length", "half", "block").sortWithinPartitions(*order)
    found = rows.select(*order, "n").mapInArrow(match, "word string, n_near long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of (word, form) pairs without cycles: the last word that following the forms gives."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = saved(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        removed(now)
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = 6, occurrences: int = 5, factor: int = 5, drop_one_in: int = 199, block_words: int = 1 << 16, **columns) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of at least ``least`` code points that occurs
    ``occurrences`` times or more. A form has at least ``factor`` (over 1) times the word's count."""
    words = saved(word_counts(docs, least, drop_one_in, **columns).where(F.col("n") >= occurrences), "words")
    near = near_words(words, least, block_words)
    whole = F.col("best.n") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(whole, F.col("best.word")).alias("form"), F.when(whole, F.col("best.n")).alias("form_n"))
    rows = saved(rows, "forms")
    roots = rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
