import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from flowmill.llm import mixing  # noqa: E402
from flowmill.llm.queries import tokenizer_path  # noqa: E402
from tests.llm.test_documents import ODD, babble, brute_groups, brute_hits  # noqa: E402

R = random.Random(21)
ITEMS = [(1, babble("aa", 14)), (2, babble("bb", 11)), (3, None), (4, "..."), (5, babble("cc", 3))]


def planted():
    """(doc_id, text, lang, source): languages, letterless texts, copies, near copies, test passages."""
    rows = []
    for k in range(150):
        lang = R.choice(["aa", "aa", "bb", "cc"])
        rows.append((k, babble(lang, R.randint(30, 60)), lang if k % 3 else None, R.choice(["s0", "s0", "s1", None])))
    for k in range(150, 190):
        base = R.choice(rows[:100])
        words = base[1].split()
        if k % 2:
            words[R.randrange(len(words))] = "lomita"
        rows.append((k, " ".join(words), base[2], "s1"))
    rows += [(200 + i, babble("aa", 20) + " " + t.upper() + " " + babble("aa", 5), "aa", "s0") for i, (_, t) in enumerate(ITEMS[:2] * 4)]
    return rows + [(300, None, "aa", "s0"), (301, "", None, "s0"), (302, "12 !? 7", "bb", "s0"), (303, "a", "aa", "s0"), (304, babble("aa", 20) + " " + babble("cc", 20), None, "s0"), (305, babble("bb", 4000), "bb", "s0")]


def brute(rows, prediction):
    rows = [(d, t, prediction[d], s) for d, t, _, s in rows if d in prediction]
    kept = {d for d, (_, c) in brute_groups([(d, t) for d, t, *_ in rows]).items() if c == d}
    rows = [r for r in rows if r[0] in kept]
    hit = {r[0] for r in brute_hits([(d, t) for d, t, *_ in rows], ITEMS, 10) if r[5]}
    rows = [r for r in rows if r[0] not in hit]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    sampled = {r[0] for r in con.sql(mixing.oracle(share=0.8)).fetchall() if r[6]}
    from tokenizers import Tokenizer

    whole, out, at = Tokenizer.from_file(tokenizer_path()), [], 0
    for d, t, *_ in sorted(r for r in rows if r[0] in sampled):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_pipeline_equals_the_chain_by_hand(spark, make, tmp_path):
    rows = planted()
    folder = str(tmp_path)
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = make(rows)
    told = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, folder).collect()}
    assert {300, 301, 302}.isdisjoint(told) and {303, 305} <= set(told)
    assert all(told[d] == lang for d, _, lang, _ in rows[:150] if lang)
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got) == brute(rows, told) and len(got) > 10


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, make, crowded, tmp_path, name, stage):
    folder = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = crowded(make([(*r, None, None) for r in ODD] + [(2000 + k, babble("aa", 20), "aa", "s") for k in range(5)]))
    got = stage(spark, odd, folder)
    if name == "token_files":
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    else:
        assert got.columns == odd.columns and got.schema["doc_id"] == odd.schema["doc_id"]
        kept = Counter(r.doc_id for r in got.select("doc_id").collect())
        rows = Counter(r.doc_id for r in odd.select("doc_id").collect())
        assert all(kept[d] == rows[d] for d in kept)  # rows that share an id and a text share a fate
        if name in ("near_dedup", "decontamination"):
            assert {1000, 1001, 1002} <= set(kept) and kept[1005] == 2
        else:
            assert {1000, 1001, 1002}.isdisjoint(kept)
    assert stage(spark, make([]).withColumn("match", F.lit(1)), folder).count() == 0
