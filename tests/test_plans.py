import json

import pytest
from pyspark.sql import functions as F

from flowmill.plans import config, publication as pub
from flowmill.sources import readers
from flowmill.streaming.flows import append_flows, current_flows


def test_layers_and_order():
    R = config.Row
    got = config.effective([R("a", "m.py", stage=5)], [R("b", "s.py", stage=1, order=2), R("a", "s.py")], [R("c", "c.py", stage=1, order=1), R("b", "c.py"), R("d", "c.py", stage=1)])
    assert [(r.names, r.sector_solution) for r in got] == [("c", "c.py"), ("b", "s.py"), ("d", "c.py"), ("a", "m.py")]


def test_access_and_names():
    assert [m.name for m in config.admitted(["wiodr13"], "calculate")] == ["wiodr13"]
    for names, kind in ((["eora26"], PermissionError), (["ochoa_1"], PermissionError), (["nope"], ValueError), (["wiodr13", "wiodr13"], ValueError)):
        with pytest.raises(kind):
            config.admitted(names, "calculate")
    assert config.admitted(["ochoa_1"], "calculate", allow_experimental=True)
    assert config.safe_reference("a/b.py") and not config.safe_reference("../b") and not config.safe_name("") and config.valid_channel("stable-1") and not config.valid_channel("Stable")


def test_catalog_constraints(spark):
    methods = spark.createDataFrame([("a", "s1", "stable"), ("a", "s9", "odd"), ("", "s1", "stable")], "id string, source string, status string")
    sources = spark.createDataFrame([("s1",)], "id string")
    errors = {(r.rule, r.value) for r in config.catalog_errors(methods, "methods", ["id"], ["id"], {"status": ["stable"]}, {"source": (sources, "id")}).collect()}
    assert errors == {("repeated key", "a"), ("id is required", ""), ("status not in enumeration", "odd"), ("source has no id", "s9")}
    assert config.listing(sources, ["id"], "csv") == "id\ns1" and config.markdown(sources, ["id"]) == "| id |\n| - |\n| s1 |"


def test_publication_chain(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    for run, method in (("r1", "m1"), ("r2", "m2"), ("r3", "m1")):
        pub.stage_run(tmp_path, method, run, {"t": df.withColumn("v", F.col("v") + len(run) + int(run[1]))}, {"source": "g1"})
    pub.commit(tmp_path, "main", {"m1": "r1"})
    pub.commit(tmp_path, "main", {"m2": "r2"})
    last = pub.commit(tmp_path, "main", {"m1": "r3"})
    assert {m: e["run_id"] for m, e in last["runs"].items()} == {"m1": "r3", "m2": "r2"}
    assert pub.current(tmp_path, "main")["sequence"] == "3".zfill(20) and pub.current(tmp_path, "other") is None
    with pytest.raises(ValueError):
        pub.stage_run(tmp_path, "m1", "r1", {"t": df}, {})
    with pytest.raises(ValueError):
        pub.check_provenance(tmp_path, "m1", "r1", {"source": "g2"})
    plan = pub.prune_plan(spark, tmp_path, {"main": 1})
    assert plan["runs"] == ["m1/r1"] and len(plan["markers"]) == 2 and plan["bytes"] > 0
    pub.prune(spark, tmp_path, {"main": 1}, plan)
    assert (tmp_path / "runs/m1/r1").exists()
    pub.prune(spark, tmp_path, {"main": 1}, plan, dry_run=False)
    assert not (tmp_path / "runs/m1/r1").exists() and pub.current(tmp_path, "main")["runs"]["m2"]["run_id"] == "r2"
    with pytest.raises(ValueError):
        pub.prune(spark, tmp_path, {"main": 1}, plan)
    release = next((tmp_path / "releases").glob("*.json"))
    release.write_text(json.dumps(json.loads(release.read_text()) | {"x": 1}))
    with pytest.raises(ValueError):
        pub.current(tmp_path, "main")


def test_result_id_rests_on_content_alone(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    a = pub.stage_run(tmp_path, "m", "a", {"t": df}, {"s": 1})
    b = pub.stage_run(tmp_path, "m", "b", {"t": df.orderBy(F.desc("k"))}, {"s": 1})
    assert a["result_id"] == b["result_id"] and a["run_id"] != b["run_id"]
    assert pub.generation_id([("a", "bc")]) != pub.generation_id([("ab", "c")])


def test_panel_merge(spark):
    prior = spark.createDataFrame([("m1", 1, 1.0), ("m2", 1, 5.0)], "method string, k int, v double")
    new = spark.createDataFrame([("m1", 1, 2.0)], "method string, k int, v double")
    assert sorted(map(tuple, pub.merged_panels(prior, new, ["method", "k"]).collect())) == [("m1", 1, 2.0), ("m2", 1, 5.0)]
    with pytest.raises(ValueError):
        pub.merged_panels(prior, new.unionByName(new.withColumn("v", F.lit(3.0))), ["method", "k"])


def test_lock(tmp_path):
    with pub.locked(tmp_path):
        with pytest.raises(RuntimeError):
            with pub.locked(tmp_path):
                pass
    with pub.locked(tmp_path):
        pass


def test_european_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;rate\nx;0,315\ny;-1,5\n")
    assert [tuple(r) for r in readers.european_csv(spark, str(tmp_path / "a.csv"), "code string, rate double").collect()] == [("x", 0.315), ("y", -1.5)]


def test_bundle_detects_change(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string"), str(tmp_path / "b")
    readers.write_bundle(df, path)
    assert readers.read_bundle(spark, path).count() == 2
    df.limit(1).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        readers.read_bundle(spark, path)


def test_wide_block(spark, tmp_path):
    (tmp_path / "z.txt").write_text("region\tsector\tA\tB\nA\tS\t1.5\t2\nB\tS\t3\t4\n")
    got = readers.wide_block(spark, str(tmp_path / "z.txt"), 2, [("A", "S"), ("B", "S")], header_rows=1)
    assert sorted(map(tuple, got.collect())) == [("A", "S", "A", "S", 1.5), ("A", "S", "B", "S", 2.0), ("B", "S", "A", "S", 3.0), ("B", "S", "B", "S", 4.0)]


def test_landed(tmp_path):
    calls = []

    def fetch(url, path):
        calls.append(url)
        path.write_bytes(b"abc")

    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    for _ in range(2):
        assert readers.landed("u", tmp_path / "f", fetch, 3, digest).read_bytes() == b"abc"
    assert calls == ["u"]
    with pytest.raises(ValueError):
        readers.landed("u", tmp_path / "g", fetch, 4)
    assert not (tmp_path / "g").exists()


def test_stream_equals_batch(spark, tmp_path):
    schema = "year int, o_country string, o_sector string, d_country string, d_sector string, kind string, value double"
    rows = spark.createDataFrame([(2000, "A", "S", "B", "S", "industry", v) for v in (1.25, 2.5)] + [(2001, "A", "S", "B", "HH", "final", 3.0)], schema)
    rows.limit(2).write.parquet(str(tmp_path / "in"))
    for part in (None, rows.where("year = 2001")):
        if part is not None:
            part.write.mode("append").parquet(str(tmp_path / "in"))
        append_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.year, r.value) for r in current_flows(spark, str(tmp_path / "out")).collect()}
    assert got == {(2000, 3.75), (2001, 3.0)}
