"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import exact, queries, spelling, vector_codes

SF = "/root/testdata/sf0.001"
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


# ---------------------------------------------------------------- 11: spelling variants


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, least=6, one_in=199):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def plain_variants(rows, least=6, occurrences=5, one_in=199):
    n = {w: c for w, c in plain_counts(rows, least, one_in).items() if c >= occurrences}
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if v != w and one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_variants(rows)
    assert found(queries.QUERIES["op11_spelling_variants"](spark, SF)) == want
    assert any(x[4] for x in want) and any(x[1] for x in want)


@pytest.mark.parametrize("block_words", [3, 1 << 16])
def test_spelling_of_crowded_buckets(make, block_words):
    rng = random.Random(5)
    words = ["".join(rng.choice("aé") for _ in range(rng.randint(5, 9))) for _ in range(2500)]
    rows = [(i, " ".join(words[i::40]) + " aaaaaaa" * 40) for i in range(40)]
    got = spelling.variants(make(rows), occurrences=2, drop_one_in=3, block_words=block_words)
    assert found(got) == plain_variants(rows, occurrences=2, one_in=3)


def test_roots_follow_long_chains(spark, make):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling.rooted(forms).collect()} == {"w11"}
    text = " ".join(w for w, n in (("abcdef", 5), ("abcdefg", 25), ("abcdefgh", 125), ("abcdefghi", 625)) for _ in range(n))
    got = {r.word: (r.form, r.root) for r in spelling.variants(make([(1, text)]), drop_one_in=0).collect()}
    assert got == {"abcdef": ("abcdefg", "abcdefghi"), "abcdefg": ("abcdefgh", "abcdefghi"), "abcdefgh": ("abcdefghi", "abcdefghi"), "abcdefghi": (None, "abcdefghi")}


def test_automaton_numbers_and_errors():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("abcabcabc") is None
    assert len(a.final) < sum(map(len, words)) / 4  # shared endings
    for q in [*words[::7], "ccccccc", "b"]:
        for k in (0, len(q) // 2):
            assert a.one_error(q, k) == {i for i, w in enumerate(words) if w.startswith(q[:k]) and one_apart(w, q)}
    assert spelling.Automaton([]).one_error("abc", 1) == set()


def test_spelling_of_odd_rows(make, crowded, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 1000)
    long = "Nachricht À×÷ÿxyz " * 30_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Wörterbuch " * 6), (4, long), (4, long), (5, "ABCDEF abcdef " * 3)]
    got = spelling.variants(crowded(make(rows)))
    assert found(got) == plain_variants(rows)
    assert spelling.variants(make([])).collect() == []


# ---------------------------------------------------------------- 12: exact duplicates


def plain_exact(rows):
    norm = [re.sub("[\\x20\\x09-\\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for j, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out[i, least, len(ids), j == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def dedup(df, **bounds):
    return Counter(tuple(r) for r in exact.exact_duplicates(df, **bounds).collect())


@pytest.mark.parametrize("range_bytes", [300, 4 << 20])
def test_exact_groups_across_ranges(make, range_bytes):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    shared = "the same opening of more than thirty-two characters " * 3
    texts += ["hot\ttext of a third of all rows"] * 200 + ["hot text \x0b of a third of all rows"] + [shared + str(i % 90) for i in range(200)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert dedup(make(rows, 5), range_bytes=range_bytes, samples=20) == plain_exact(rows)


def test_exact_hot_group_is_cut(make):
    df = make([(i, "copy " * 20) for i in range(400)])
    cuts = exact.splitters(df, "doc_id", "text", 1000, 50, 20)
    rows = exact.runs(df, "doc_id", "text", cuts)
    per = [r["count"] for r in rows.groupBy("range").count().collect()]
    assert len(per) > 20 and max(per) < 60


def test_exact_odd_rows(make, crowded):
    long = "x y z\u0000 " * 200_000
    rows = [(3, None), (2, ""), (5, " "), (4, "\t\n"), (None, "a b"), (9, "a  b"), (None, "only"), (None, "only"), (7, "a b"), (7, "a b"), (8, long), (6, long + " "), (1, "a b ")]
    df = crowded(make(rows))
    for size in (20, 4 << 20):
        assert dedup(df, range_bytes=size) == plain_exact(rows)
    assert exact.exact_duplicates(make([])).collect() == []


def test_without_duplicates_keeps_one_of_each(make):
    df = make([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")])
    left = exact.without_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_exact_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op12_exact_duplicates"](spark, SF).collect()) == plain_exact(rows)


# ---------------------------------------------------------------- 13: vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label). Python integers throughout."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1]) if kept else 0
    ints = [[math.floor(x * scale) for x in r[1]] for r in kept]
    cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[v[a:b] for v in ints[:entries]] for a, b in cut]
    square = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y))
    nearest = lambda v: [min((square(v[a:b], e), i) for i, e in enumerate(book)) for (a, b), book in zip(cut, books)]
    for _ in range(rounds):
        near = [nearest(v) for v in ints]
        for p, (a, b) in enumerate(cut):
            for e in range(len(books[p])):
                own = [v[a:b] for v, c in zip(ints, near) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    near = [nearest(v) for v in ints]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    by_label = Counter()
    for r, c in zip(kept, near):
        by_label[r[2]] += sum(x for x, _ in c)
    fit = lambda x: x if x < 2**63 else None
    return Counter((r[0], "".join(f"{i:02x}" for _, i in c), fit(sum(x for x, _ in c)), fit(by_label[r[2]]), sha) for r, c in zip(kept, near))


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


def coded(df, **options):
    return Counter(tuple(r) for r in vector_codes.vector_codes(df, **options).collect())


def narrow(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("grid", [3, 2000])
def test_codes_equal_plain_rounds(spark, grid):
    """A coarse grid has many ties between entries and equal vectors."""
    rng = random.Random(grid)
    rows = [(i, narrow([rng.randint(-grid, grid) / 1000 for _ in range(8)]), rng.choice([0, 1, None])) for i in range(400)]
    assert coded(table(spark, rows), entries=40) == plain_codes(rows, entries=40)


def test_codes_of_odd_rows(spark):
    rng = random.Random(9)
    good = [(rng.choice([None, 3, 4, 5]), narrow([rng.random() for _ in range(6)]), rng.choice([None, 7])) for _ in range(30)]
    bad = [(0, None, 1), (1, [0.1] * 5 + [None], 1), (2, [float("nan")] * 6, 1), (2, [float("-inf")] + [0.0] * 5, None), (90, [0.5] * 3, 1)]
    rows = [*good, *bad, good[0], good[0]]
    want = plain_codes(rows)
    assert coded(table(spark, rows).withColumns({"near": F.lit("x"), "vector": F.lit(1), "error": F.lit(2)})) == want
    assert coded(table(spark, [])) == Counter() and coded(table(spark, bad[:4])) == Counter()
    assert coded(table(spark, [(1, [], 1), (2, [], None)])) == plain_codes([(1, [], 1), (2, [], None)])


@pytest.mark.parametrize("size", [1e5, 1e9, 1e30])
def test_codes_of_large_components_are_exact(spark, size):
    rng = random.Random(2)
    rows = [(i, narrow([rng.uniform(-size, size) for _ in range(4)]), 1) for i in range(60)]
    assert coded(table(spark, rows), entries=8) == plain_codes(rows, entries=8)


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 10
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=8) / 50], 1) for i in range(1000)]
    state, _ = vector_codes.compressed(table(spark, rows), entries=20)
    assert state.agg(F.sum("scans")).first()[0] < 400  # of 4000 parts


def test_codes_of_a_very_long_vector(spark):
    rows = [(i, [float((i * 7 + j) % 5) for j in range(4000)], None) for i in range(6)]
    state, book = vector_codes.compressed(table(spark, rows), entries=2)
    assert state.count() == 6 and [p.shape for p in book.parts] == [(2, 1000)] * 4
