import functools
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import decontaminate, langid, minhash, mixing, quality, secrets, token_counts, token_files

ODD = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a"), (None, "null id " * 3), (1004, "x " * 30_000), (1005, "same text here"), (1005, "same text here"), (1006, "日本 語 é"), (1007, "\x00 \x85   z")]
R = random.Random(7)
WORDS = [f"w{i}" for i in range(3000)]


def some_words(n):
    return [R.choice(WORDS) for _ in range(n)]


# ------------------------------------------------------------------ decontamination


def brute_hits(docs, items, n):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    pats = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - n + 1)):
            if w:
                pats.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i is not None else [])
    out = []
    for d, t in docs:
        w, hit, found = word.findall(low(t)), set(), set()
        for size in {len(p) for p in pats}:
            for k in range(len(w) - size + 1):
                p = pats.get(tuple(w[k : k + size]))
                if p is not None:
                    hit |= set(range(k, k + size))
                    found |= p
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark, make, crowded):
    items = [(k, " ".join(some_words(R.choice([1, 3, 10, 11, 25])))) for k in range(20)] + [(50, None), (51, "..."), (None, "a b c"), (3, "Extra Window")]
    docs = ODD + [(k, " ".join(some_words(40) + R.choice(items[:20])[1].upper().split() + some_words(5))) for k in range(60)] + [(70, "EXTRA, window!"), (71, "x a b. C a"), (72, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items, 10)
    assert (71, 5, 3, 0, hashlib.sha256(b"").hexdigest(), True) in want  # an item without an id
    for limit in (64 << 20, 4000):
        got = decontaminate.contamination(crowded(make(docs)), bench, 10, max_pattern_bytes=limit)
        assert Counter(tuple(r)[:6] for r in got.collect()) == want
    kept = decontaminate.decontaminated(crowded(make(docs)), bench)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((k[0] or -1) for k in want.elements() if not k[5])
    assert kept.columns == crowded(make(docs)).columns
    assert decontaminate.contamination(make([]), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(make(docs), bench.limit(0)).collect())


def test_shift_skips_and_finds_overlaps():
    w = decontaminate.WuManber(3, {(b"a", b"b", b"a"): [0], (b"b", b"a", b"b"): [1]})
    assert list(w.search([b"a", b"b", b"a", b"b", b"a"])) == [(0, [0]), (1, [1]), (2, [0])]
    assert w.shift[(b"a", b"b")] == 0 and w.most == 2


# ------------------------------------------------------------------ near duplicates


def brute_groups(rows, k=5):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, minhash.shingles(minhash.words_of(t), k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(make, crowded):
    rows = list(ODD)
    n = 0
    for _ in range(25):
        base = some_words(R.choice([4, 6, 30, 90]))
        for _ in range(R.choice([1, 2, 30])):
            w = list(base)
            for _ in range(R.choice([0, 0, 1, 2, 3])):
                w[R.randrange(len(w))] = R.choice(WORDS)
            rows.append((n, " ".join(w)))
            n += 1
    R.shuffle(rows)
    want = brute_groups(rows)
    docs = crowded(make(rows))
    got = minhash.near_duplicates(docs, block=8).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, *(i for i, (_, c) in want.items() if c == i)}


def test_near_duplicates_of_nothing(make):
    assert minhash.near_duplicates(make([])).count() == 0


def test_short_pairs_of_least_agreement_are_linked(make):
    s = minhash.Signer(32, 4, 5)
    pairs = []
    for i in range(8000):  # 7 and 8 words: 3 and 4 shingles, similarity 0.75
        words = [f"p{i}q{k}".encode() for k in range(8)]
        x, y = (s.low_bits(s.minima(s.hashes(w))) for w in (words[:7], words))
        pairs.append((minhash.estimated_similarity(int((x == y).sum()), 128), [b" ".join(w).decode() for w in (words[:7], words)]))
    pairs.sort()
    assert pairs[0][0] >= minhash.least_estimate(0.75, 128)
    rows = [(2 * i + j, t) for i, (_, pair) in enumerate(pairs[:50]) for j, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_signature_estimates_similarity():
    s = minhash.Signer(32, 4, 5)
    a = some_words(1200)
    b = a[:1000] + some_words(200)
    x, y = s.minima(s.hashes([w.encode() for w in a])), s.minima(s.hashes([w.encode() for w in b]))
    p, q = s.packed(x).view(np.uint64), s.packed(y).view(np.uint64)
    agree = 128 - int(np.bitwise_count((p ^ q)[:2] | (p ^ q)[2:]).sum())
    true = len(minhash.shingles(a, 5) & minhash.shingles(b, 5)) / len(minhash.shingles(a, 5) | minhash.shingles(b, 5))
    assert abs(minhash.estimated_similarity(agree, 128) - true) < 0.25
    assert agree == int((s.low_bits(x) == s.low_bits(y)).sum())


@pytest.mark.parametrize("size", [1, 2, 40])
def test_chance_agreement_is_a_fourth_for_few_shingles_too(size):
    s = minhash.Signer(32, 4, 5)
    draw = np.random.default_rng(size)
    shares = []
    for _ in range(300):
        a, b = (s.low_bits(s.minima(draw.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))) for _ in range(2))
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - minhash.CHANCE) < 0.02 and np.std(shares) < 1.6 * (0.25 * 0.75 / 128) ** 0.5


@pytest.mark.parametrize("size", [4, 20, 400])
def test_estimates_at_the_threshold_stay_above_the_floor(size):
    """Pairs at similarity 0.75, of few and of many shingles: the estimate has the right mean and none falls below."""
    s = minhash.Signer(32, 4, 5)
    draw = np.random.default_rng(size)
    floor, found = minhash.least_estimate(0.75, 128), []
    for _ in range(400):
        x = draw.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)
        a, b = s.low_bits(s.minima(x)), s.low_bits(s.minima(x[: size * 3 // 4]))
        found.append(minhash.estimated_similarity(int((a == b).sum()), 128))
    assert abs(np.mean(found) - 0.75) < 0.02 and min(found) >= floor > 0.49


# ------------------------------------------------------------------ language


def babble(lang, n):
    parts = {"aa": ["lo", "mi", "ta", "re"], "bb": ["schu", "krat", "ng", "pf"], "cc": ["жа", "ду", "ко"]}[lang]
    return " ".join("".join(R.choice(parts) for _ in range(R.randint(1, 4))) for _ in range(n))


def test_languages_and_spans(make):
    docs = make([(k, babble(lang, 60), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)])
    model = langid.fit(docs)
    assert model.langs == ["aa", "bb", "cc"]
    tests = [(k, babble(lang, 5), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)] + [(900, None, ""), (901, "12 !? ", ""), (902, "", "")]
    for r in langid.with_language(make(tests), model).collect():
        assert r.language.lang == (r.lang or "und") and 0 <= r.language.score <= 1
    text = babble("aa", 30) + ". " + babble("bb", 30) + " " + babble("cc", 10)
    r = langid.with_language(make([(1, text)]), model).first().language
    assert [s.lang for s in r.spans] == ["aa", "bb", "cc"]
    assert "".join(text[s.start : s.end] for s in r.spans).replace(" ", "").replace(".", "") == text.replace(" ", "").replace(".", "")


def test_nothing_learned(make):
    model = langid.fit(make([]))
    assert [r.language.lang for r in langid.with_language(make([(1, "abc")]), model).collect()] == ["und"]
    assert langid.with_language(make([]), model).count() == 0


def random_model(n, penalty, seed=0):
    rng = np.random.default_rng(seed)
    return langid.Model([f"l{i:03d}" for i in range(n)], rng.integers(-3000, 3000, (1 << 12, n)).astype(np.int16), np.ones((n, len(langid.SCRIPTS)), bool), penalty)


@pytest.mark.parametrize("n, penalty", [(4, 12.0), (300, 0.5)])
def test_a_text_is_labelled_alike_alone_and_beside_others(n, penalty):
    model = random_model(n, penalty)
    draw = random.Random(3)
    texts = ["", "a", "I", "12 !?", "жа"] + ["".join(draw.choice("abcdé xyz 1Я日") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    alone = [model.label([t])[0] for t in texts]
    assert model.label(texts) == alone and model.label(texts[::-1]) == alone[::-1]
    if n == 300:
        assert len({s["lang"] for _, _, spans in alone for s in spans}) > 256 // 2
        word = [w for w in {w for t in texts for w in re.findall("[a-z]+", t)}]
        found = model.label([" ".join(word)])[0][2]  # with this penalty nearly every word has a language of its own
        scores = model.word_scores(langid.Words([" ".join(word)]))
        path = [next(model.langs.index(s["lang"]) for s in found if s["start"] <= b - 1 < s["end"]) for b in langid.Words([" ".join(word)]).begin]
        value = lambda p: scores[np.arange(len(p)), p].sum() - penalty * (np.diff(p) != 0).sum()
        assert value(np.array(path)) >= value(scores.argmax(axis=1)) and max(path) > 255


def test_partitions_without_letters_or_with_one(make, crowded):
    model = langid.fit(make([(k, babble(lang, 60), lang) for k, lang in enumerate(["aa", "bb"] * 20)]))
    for texts, want in ((["12 34", "!?", None], ["und"] * 3), (["12 !?"], ["und"]), (["a"], None), (["I", "I"], None)):
        rows = langid.with_language(crowded(make([(None if k else 7, t) for k, t in enumerate(texts)], 1)), model)
        assert rows.columns == [*crowded(make([])).columns, "language_"]
        got = [r.language_.lang for r in rows.collect()]
        assert got == want if want else set(got) <= {"aa", "bb"} and len(got) == len(texts)
    (r,) = langid.with_language(make([(1, (babble("aa", 9) + " ") * 30_000)], 1), model).collect()
    assert r.language.lang == "aa" and r.language.score > 0.9


def test_language_query_on_held_out_documents(spark):
    from flowmill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    got = QUERIES["op4_language"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def brute_languages(learned, texts, penalty=12.0, smoothing=0.5, buckets=1 << 17):
    """The verdict of each text by plain loops: counts, word scores and a decoding over all languages."""
    mask, ends = (1 << 64) - 1, langid.SCRIPT_ENDS

    def words(t):
        out, now = [], []
        for c in (t or "") + " ":
            if c.isalpha():
                now.append(ord(c.lower()[0]))
            elif now:
                out.append(tuple(now))
                now = []
        return out

    @functools.cache
    def bucket(gram):
        h = 0
        for c in gram:
            h = (h ^ c) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
        return (h + len(gram) * 0xD1B54A32D192ED03 & mask) % buckets

    @functools.cache
    def of_word(w):
        w = (0, *w, 0)
        return [bucket(w[k : k + n]) for n in langid.NGRAMS for k in range(len(w) - n + 1)]

    script = lambda w: next(s for end, s in ends if w[0] <= end)
    langs = sorted({lang for _, lang in learned})
    grams, scripts = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for t, lang in learned:
        for w in words(t):
            grams[lang].update(of_word(w))
            scripts[lang][script(w)] += 1
    total = {k: sum(grams[k].values()) for k in langs}
    fits = {k: {s for s, n in scripts[k].items() if n >= 1e-4 * sum(scripts[k].values())} for k in langs}

    @functools.cache
    def weights(b):
        p = [math.log((grams[k][b] + smoothing) / (total[k] + smoothing * buckets)) for k in langs]
        return [round((x - sum(p) / len(p)) * 1024) if any(grams[k][b] for k in langs) else 0 for x in p]

    @functools.cache
    def scores(w):
        can = [script(w) in fits[k] for k in langs]
        raw = [sum(col) / 1024 for col in zip(*map(weights, of_word(w)))]
        return [(x if ok else -1e3) if any(can) else 0.0 for x, ok in zip(raw, can)]

    out = []
    for t in texts:
        ws = words(t)
        if not ws:
            out.append(("und", 0.0))
            continue
        best, backs = scores(ws[0]), []
        for w in ws[1:]:
            back = [max(range(len(langs)), key=lambda j: (best[j] - penalty * (j != k), j == k, -j)) for k in range(len(langs))]  # noqa: B023
            best = [best[j] - penalty * (j != k) + x for k, (j, x) in enumerate(zip(back, scores(w)))]
            backs.append(back)
        path = [best.index(max(best))]
        for back in reversed(backs):
            path.append(back[path[-1]])
        share = Counter()
        for w, k in zip(ws, reversed(path)):
            share[k] += len(w)
        top = min(share, key=lambda k: (-share[k], k))
        out.append((langs[top], share[top] / sum(share.values())))
    return out


def test_language_query_equals_brute_force(spark):
    from flowmill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    learned = [(r.text, r.lang) for r in docs if r.lang is not None and r.text is not None and not held[r.doc_id]]
    want = brute_languages(learned, [r.text for r in docs])
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in QUERIES["op4_language"](spark, sf).collect()}
    assert got == {r.doc_id: (held[r.doc_id], *w) for r, w in zip(docs, want)}


def test_word_scores_and_verdicts_equal_brute_force(make):
    learned = [(babble(lang, 30), lang) for lang in ["aa", "bb", "cc"] * 15]
    model = langid.fit(make([(k, t, lang) for k, (t, lang) in enumerate(learned)]))
    mixed = [" ".join(babble(R.choice(["aa", "bb", "cc"]), R.randint(1, 5)) for _ in range(R.randint(1, 6))) for _ in range(60)]
    texts = [*mixed, None, "", " 12 ", "a", "日本 語", "é1é", "lo жа", babble("cc", 4000)]
    got = {r.doc_id: (r.language.lang, r.language.score) for r in langid.with_language(make(list(enumerate(texts))), model).collect()}
    assert [got[k] for k in range(len(texts))] == brute_languages(learned, texts)


def test_viterbi_is_optimal():
    from itertools import product

    rng = np.random.default_rng(3)
    for few in (1, 16):
        langid.FEW = few
        for _ in range(20):
            counts = rng.integers(0, 7, rng.integers(1, 6))
            scores, doc = rng.normal(size=(counts.sum(), 3)) * 3, np.repeat(np.arange(len(counts)), counts)
            path, at = langid.viterbi(scores, doc, len(counts), 2.0), 0
            for n in counts:
                value = lambda p: sum(scores[at + i, p[i]] for i in range(n)) - 2.0 * sum(p[i] != p[i - 1] for i in range(1, n))  # noqa: B023, E731
                if n:
                    assert value(path[at : at + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))))
                at += n
    langid.FEW = 16


# ------------------------------------------------------------------ quality


def test_base_figures(make):
    rows = ODD + [(k, "\n".join(R.choice(["a b c d e", "x # | y", "", "  ", "p q r s t u v", "one"]) for _ in range(R.randint(1, 8)))) for k in range(50)]
    word = re.compile("[^\x20\x09-\x0d]+")
    want = Counter()
    for d, t in rows:
        t = t or ""
        w = word.findall(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {i for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
        lines = t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if word.search(x) and x in lines[:i])
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    got = quality.judged(make(rows), quality.NO_FIELD).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judged(make([]), quality.NO_FIELD).count() == 0


def good(n=6):
    return "\n".join(" ".join(some_words(12)).capitalize() + "." for _ in range(n))


def junk(n=6):
    return "\n".join(" ".join(w + "###" for w in some_words(9)) for _ in range(n))


def test_field_labels_lines_of_mixed_documents(spark, make, crowded):
    """Only documents are labelled; most hold lines of the other kind."""
    texts = [good(6) + ("\n" + junk(1) if k % 6 == 1 else "") if k % 2 else (good(1) + "\n\n" if k % 3 else "") + junk(6) for k in range(160)]
    docs = crowded(make(list(enumerate(texts))))
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] * 2 + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    field = quality.fit(docs, labels)
    held = [r for r in quality.judged(docs, field).collect() if r.doc_id >= 80]
    assert len(held) == 80 and all(r.kept == bool(r.doc_id % 2) for r in held)
    assert sum(0 < r.content_share < 1 for r in held) > 30
    assert field.decode([quality.mask(x, False) for x in (good() + "\n\n" + junk()).split("\n")]) == [1] * 6 + [None] + [0] * 6
    rows = quality.with_figures(docs.withColumn("figures", F.lit("x")), field)
    assert rows.columns == [*docs.columns, "figures_"]
    for r in rows.limit(40).collect():
        assert [None if y is None else y for y in r.figures_.labels] == [None if not x.strip() else "###" not in x for x in r.text.split("\n")]
    assert quality.fit(docs, labels.limit(0)) is quality.NO_FIELD and quality.fit(docs.limit(0), labels) is quality.NO_FIELD


def test_verdict_is_that_of_the_best_labels(make):
    from itertools import product

    rng = np.random.default_rng(9)
    field = quality.Field(rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2)))
    draw = random.Random(4)
    rows = [(k, "\n".join(draw.choice(["a b c d e", "x # | y", "", "  ", "p q r s t u v", "ONE!!", "Ends so."]) for _ in range(draw.randint(1, 9)))) for k in range(60)] + ODD[:6]
    for r in quality.judged(make(rows), field).collect():
        text = dict(rows)[r.doc_id] or ""
        m, sizes, _ = quality.masks(text)
        lines = [(a, n) for a, n in zip(m, sizes) if a != quality.BLANK]
        if len(lines) < 10:
            value = lambda p: sum(field.emission(a)[y] for (a, _), y in zip(lines, p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max(product((0, 1), repeat=len(lines)), key=value)
            share = sum(n for (_, n), y in zip(lines, best) if y) / max(1, sum(n for _, n in lines))
            assert r.content_share == pytest.approx(share) and r.kept == (not r.base_failed and share >= 0.5)


def test_gradient_of_the_field():
    rng = np.random.default_rng(2)
    runs = quality.Runs([([int(v) for v in rng.integers(1, 1 << len(quality.FEATURES), n)], [int(v) for v in rng.integers(1, 90, n)], k % 2) for k, n in enumerate((1, 4, 7, 2, 32))])
    w, moves = rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2))
    seen = runs.counts(*runs.constrained(runs.scores(w), moves))
    _, gw, gm = runs.objective(w, moves, seen, 0.1)
    for param, grad in ((w, gw), (moves, gm)):
        for at in np.ndindex(param.shape):
            values = []
            for step in (1e-5, -1e-5):
                param[at] += step
                values.append(runs.objective(w, moves, seen, 0.1)[0])
                param[at] -= step
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)
    p, _ = runs.constrained(runs.scores(w), moves)
    share = (p[..., 1] * runs.share).sum(axis=0)
    assert (share[runs.y == 1] > 0.6 - 0.01).all() and (share[runs.y == 0] < 0.4 + 0.01).all()


def test_decoding_is_optimal():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(20):
        field = quality.Field(rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2)))
        m = [int(v) for v in rng.integers(1, 1 << len(quality.FEATURES), 7)]
        value = lambda p: sum(field.emission(x)[y] for x, y in zip(m, p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert value(field.decode(m)) == pytest.approx(max(map(value, product((0, 1), repeat=7))))


# ------------------------------------------------------------------ secrets


def test_secrets(make, crowded):
    bits = ["password: hunter22", "TOKEN='abc'", "secret=token:abcdefgh", "api-key = \"Zz9+/=_.-\"", "AKIA" + "A1" * 9, "AKIAAKIA", "deadbeef" * 4, "0123456789abcdef" * 2, "ghp_" + "a1B2" * 9, "é", "x", "pass word", "passwd=\n:", "-----BEGIN RSA PRIVATE KEY-----", "https://me:pw@host/x", "apikey:1234567"]
    rows = ODD + [(k, " ".join(R.choice(bits) for _ in range(R.randint(0, 9))) + R.choice(["", "é" * 3])) for k in range(80)]
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    want = Counter()
    for d, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        counts = Counter(s[3] for s in spans)
        for order, r in enumerate(secrets.MORE, 3):
            spans += [(m.start(), order, m.end(), r.kind) for m in re.finditer(f"(?ai:{r.pattern})" if r.ignore_case else r.pattern, t)]
        all_ = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        want[d, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(base.encode()).hexdigest(), all_] += 1
    assert Counter(map(tuple, secrets.secret_report(crowded(make(rows))).collect())) == want
    assert secrets.with_secrets(crowded(make(rows))).where("size(secrets) > 0").count() > 10
    assert secrets.secret_report(make([])).count() == 0


def test_trigram_queries():
    f = frozenset
    assert secrets.trigram_query("abcd") == [[f({"abc", "bcd"})]]
    assert secrets.trigram_query("(abc|xyz)[0-9]+") == [[f({"abc"}), f({"xyz"})]]
    assert secrets.trigram_query("[a-z]+") == [] and secrets.trigram_query("(abc|x)") == []
    assert secrets.trigram_query("ab?cd") == [[f({"abc", "bcd"}), f({"acd"})]]
    assert secrets.trigram_query("abc.*def") == [[f({"abc"})], [f({"def"})]]
    assert secrets.trigram_query(secrets.BASE[2].pattern) == []


# ------------------------------------------------------------------ mixing


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, g, t, float((i * 7) % 11 + 1), 1) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in "pq")], "source string, lang string, topic string, tokens double, docs long")
    goals = {"source": {"a": 5.0, "b": 3.0, "c": 2.0}, "lang": {"x": 1.0, "y": 1.0}, "topic": {"p": 3.0, "q": 1.0, "absent": 9.0}}
    targets = {m: spark.createDataFrame(list(g.items()), f"{m} string, target double") for m, g in goals.items()}
    rows = mixing.rake(cells, targets, rounds=40, write_every=10).toPandas()
    for m, g in goals.items():
        got = rows.groupby(m)["weight"].sum() / rows["weight"].sum()
        have = {k: v for k, v in g.items() if k != "absent"}
        for k, v in have.items():
            assert got[k] == pytest.approx(v / sum(have.values()), rel=1e-6)


def test_sampling(make, crowded):
    docs = crowded(make(ODD + [(k, " ".join(some_words(20)), R.choice(["en", "fr", None]), R.choice(["s0", "s0", "s1"])) for k in range(400)]))
    rows = mixing.with_probabilities(docs, share=0.5)
    assert rows.columns[:-1] == docs.columns
    got = rows.select("doc_id", "mix_.*" if "mix_" in rows.columns else "mix.*").toPandas()
    assert len(got) == 410 and got["probability"].between(0, 1).all() and (got[got["n_tokens"] == 0]["probability"] < 1).all()
    assert (got["probability"] * got["n_tokens"]).sum() <= 0.5 * got["n_tokens"].sum() * (1 + 1e-9)
    narrow = mixing.with_probabilities(docs, share=0.5, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "mix"] and sorted(map(repr, narrow.select("doc_id", "mix.*").collect())) == sorted(map(repr, rows.select("doc_id", "mix_.*" if "mix_" in rows.columns else "mix.*").collect()))
    small = got[got["n_tokens"] == 20]
    assert abs(small["sampled"].sum() - small["probability"].sum()) < 4 * (small["probability"] * (1 - small["probability"])).sum() ** 0.5 + 1
    by_shuffle = mixing.with_probabilities(docs, share=0.5, broadcast_cells=0).toPandas()
    assert len(by_shuffle) == 410
    assert mixing.mixed(docs).columns == docs.columns and mixing.with_probabilities(make([])).count() == 0


def test_sample_meets_the_targets_where_cells_are_scarce(make):
    sizes = {("en", "s0", " "): 300, ("en", "s1", " "): 60, ("fr", "s0", " "): 40, ("fr", "s1", " "): 4, ("en", "s0", "\n"): 9, ("fr", "s1", "\n"): 3}
    keys = [k for k, n in sizes.items() for _ in range(n)]
    docs = make([(i, sep.join(["w"] * 20), lang, source) for i, (lang, source, sep) in enumerate(keys)])
    rows = mixing.with_probabilities(docs, share=0.8, bounded=True).select("doc_id", "mix.*").toPandas()
    rows["expected"] = rows["probability"] * rows["n_tokens"]
    assert rows["probability"].between(0, 1).all() and (rows["probability"] == 1).any()
    assert 0.2 < rows["expected"].sum() / rows["n_tokens"].sum() < 0.8  # the targets don't leave room for 0.8
    for m, power in (("source", 0.5), ("lang", 0.5)):
        goal = rows.groupby(m)["n_tokens"].sum() ** power
        got = rows.groupby(m)["expected"].sum()
        for k in goal.index:
            assert got[k] / got.sum() == pytest.approx(goal[k] / goal.sum(), rel=3e-3)
    assert {r.doc_id for r in mixing.mixed(docs, share=0.8).select("doc_id").collect()} == set(rows["doc_id"][rows["sampled"]])


def test_every_topic_has_its_own_target(spark):
    rows = [("a", "x", "t", 900, 9), ("a", "y", "u", 60, 1), ("b", "x", "v", 5, 1), ("b", "y", "w", 4, 1), ("b", "x", "t", 31, 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    held = {"t": 931, "u": 60, "v": 5, "w": 4}
    want = {k: v**0.7 for k, v in held.items()}
    for share in (0.2, 0.5, 0.9):
        got = {r.topic: r.target for r in mixing.attainable_targets(mixing.tempered_targets(cells, "topic", 0.7), cells, "topic", share).collect()}
        assert sum(got.values()) == pytest.approx(1)
        free = {k for k in got if got[k] < held[k] / 1000 / share * (1 - 1e-9)}
        assert all(got[k] <= held[k] / 1000 / share * (1 + 1e-9) for k in got)
        scale = {round(got[k] / want[k], 9) for k in free}
        assert len(scale) <= 1 and all(got[k] / want[k] <= min(scale, default=9) * (1 + 1e-6) for k in got)  # the others ask for more than they hold
    done = mixing.calibrated(cells, 0.9)
    assert all(0 <= r.expected <= r.tokens for r in done.collect())
    report = mixing.deviations(done).collect()
    assert {r.label for r in report if r.margin == "topic"} == set(held) and all(abs(r.target - r.expected) < 1e-3 for r in report)
    assert mixing.attainable_targets(mixing.tempered_targets(cells.limit(0), "topic", 0.7), cells.limit(0), "topic", 0.5).count() == 0


def test_rare_topics_get_what_they_are_due(spark):
    """On the whole table no topic misses its target, however few tokens it has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.with_probabilities(docs, share=0.5, keep=["doc_id"]).select("mix.*").toPandas()
    rows["expected"] = rows["probability"] * rows["n_tokens"]
    held, got = rows.groupby("topic")["n_tokens"].sum(), rows.groupby("topic")["expected"].sum()
    total = held.sum()
    part = held**0.7 / (held**0.7).sum()
    order = sorted(held.index, key=lambda k: held[k] / part[k])
    factor = max((1 - sum(held[k] / total / 0.5 for k in order[:i])) / sum(part[k] for k in order[i:]) for i in range(len(order)))
    for k in held.index:
        assert got[k] / got.sum() == pytest.approx(min(held[k] / total / 0.5, factor * part[k]), rel=5e-3)
    assert (held / total < 0.01).sum() >= 3


# ------------------------------------------------------------------ tokens


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P


def test_chunked_encoding_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer().path("byte_bpe_50k.json")
    enc, whole = token_files.ChunkEncoder(path, most=50), Tokenizer.from_file(path)
    pool = ["the", "été,", "it's", "a\nb", "\n", "", " ", "\t", "x.", "12", "日本", "…", " ", "ab c", "Straße", "don't!", "a\n", "\nb", "#$", "x y"]
    for t in [t or "" for _, t in ODD] + [" ".join(R.choice(pool) for _ in range(R.randint(1, 12))) for _ in range(500)]:
        assert list(np.frombuffer(enc.ids(t), enc.kind)) == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_with_an_added_token_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer().path("byte_bpe_50k.json")
    enc, whole = token_files.ChunkEncoder(path, most=50), Tokenizer.from_file(path)
    assert enc.chunked and list(np.frombuffer(enc.ids("a <|endoftext|> b"), enc.kind)) == [64, 220, 50256, 275]
    draw = random.Random(8)
    pool = ["<|endoftext|>", "the", "x<|endoftext|>", "<|endoftext|>.", "the\n<|endoftext|>", "<|endoftext|>\nété", "\n", "", "<|endoftext|><|endoftext|>", "<|endoftext", "|>", "x."]
    for t in ("".join(draw.choice(pool) + draw.choice([" ", " ", "", "\n"]) for _ in range(draw.randint(1, 10))) for _ in range(3000)):
        assert list(np.frombuffer(enc.ids(t), enc.kind)) == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_coder_round_trips():
    rng = np.random.default_rng(11)
    for n in (1, 2, 63, 64, 65, 5000):
        for high in (1, 3, 60_000):
            ids = rng.integers(0, high, n)
            data = token_files.encode_segment(ids, [4], [n], 64, R.choice([1, 3, 32]))
            assert (next(token_files.Segment(io.BytesIO(data)).documents())[1] == ids).all()
    with pytest.raises(ValueError):
        token_files.Segment(io.BytesIO(data[:-20] + b"x" * 20))
    spoiled = bytearray(data)
    spoiled[len(data) // 2] ^= 1
    with pytest.raises(Exception):
        list(token_files.Segment(io.BytesIO(bytes(spoiled))).documents())


def test_token_files(spark, make, crowded):
    from tokenizers import Tokenizer

    path = tokenizer().path("byte_bpe_50k.json")
    rows = ODD + [(k, " ".join(some_words(R.randint(1, 30)))) for k in range(200)]
    whole, want, at = Tokenizer.from_file(path), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = token_files.tokenized(crowded(make(rows)), path, segment_tokens=700, block_tokens=256, lanes=16).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_files.tokenized(make([]), path).count() == 0


def test_token_counts(make):
    path = tokenizer().path("byte_bpe_50k.tiktoken")
    import regex

    scores, split = token_counts.read_scores(path), regex.compile(token_counts.PATTERN).findall

    def naive(p):
        best = [(0.0, 0)] + [None] * len(p)
        for e in range(1, len(p) + 1):
            best[e] = max((best[s][0] + scores[p[s:e]], best[s][1] - 1) for s in range(e) if p[s:e] in scores)
        return -best[-1][1]

    rows = [r for r in ODD if r[0] != 1004] + [(k, R.choice(["", " "]).join([" ".join(some_words(6)), "it's\n\n fine ", "déjà  vu"])) for k in range(40)]
    got = Counter((r.doc_id, r.tokens.n_pretokens, r.tokens.n_tokens) for r in token_counts.with_token_counts(make(rows), path, group=7).collect())
    assert got == Counter((d, len(split(t or "")), sum(naive(p.encode()) for p in split(t or ""))) for d, t in rows)


def test_trie_shares_prefixes():
    scores = {b: -1.0 for b in (b"a", b"b", b"c", b"ab", b"abc")}
    assert token_counts.trie_counts([b"abc", b"abca", b"b", b"abab"], scores, 3) == {b"abc": 1, b"abca": 2, b"b": 1, b"abab": 2}


def test_token_counts_of_odd_tables(make, crowded):
    path = tokenizer().path("byte_bpe_50k.tiktoken")
    long = "wordy " * 200_000
    docs = crowded(make([*ODD, (50, long), (50, long), (51, "x" * 3000)]))
    rows = token_counts.with_token_counts(docs, path)
    name = next(c for c in rows.columns if c not in docs.columns)
    assert rows.columns[:-1] == docs.columns and name != "tokens"  # taken, so made fresh
    got = Counter((r.doc_id, r[name].n_pretokens, r[name].n_tokens) for r in rows.collect())
    one = token_counts.with_token_counts(make([(1, "wordy wordy"), (2, "wordy wordy wordy")]), path).collect()
    step = [b - a for a, b in zip(*(sorted((r.tokens.n_pretokens, r.tokens.n_tokens) for r in one)))]
    base = min((r.tokens.n_pretokens, r.tokens.n_tokens) for r in one)
    tail = [c for c in got if c[0] == 50]
    assert len(tail) == 1 and got[tail[0]] == 2
    assert abs(tail[0][1] - (base[0] + 199_998 * step[0])) <= 1 and abs(tail[0][2] - (base[1] + 199_998 * step[1])) <= 2  # and the last blank
    assert sum(got.values()) == len(ODD) + 3 and {c[1:] for c in got if c[0] in (1000, 1001)} == {(0, 0)}
    assert token_counts.with_token_counts(make([]), path).count() == 0
