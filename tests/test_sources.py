"""Positional sources, bundles and source generations."""

import os

import pytest
from pyspark.sql import functions as F

from flowmill.sources import bundles, positions


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "1000")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    for name, low, high in (("b.txt", 700, 1000), ("a.txt", 0, 700), ("c.txt", 1000, 1001)):
        (tmp_path / name).write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(low, high)))
    (tmp_path / "d.txt").write_text("")
    lines = positions.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {r.line: r.value.split()[1] for r in lines.collect()}
    assert got == {i: str(i) for i in range(1001)}


def block(spark, tmp_path, lines, rows=("x\tA\ty\tS1", "x\tROW\ty\tS1", "x\tB\ty\tS2"), columns=("x\tA\ty\tS1", "x\tB\ty\tS1", "x\tROW\ty\tT")):
    for name, text in (("block", lines), ("rows", rows), ("columns", columns)):
        (tmp_path / name).write_text("".join(t + "\n" for t in text))
    left = positions.label_file(spark, str(tmp_path / "rows"), {"o_country": 1, "o_sector": 3})
    right = positions.label_file(spark, str(tmp_path / "columns"), {"d_country": 1, "d_sector": 3})
    return positions.positioned_block(spark, str(tmp_path / "block"), left, right, scale=1 / 1000)


def test_block_drops_the_rest_of_the_world(spark, tmp_path):
    got = block(spark, tmp_path, ["1000\t2000\t3", "4\t5\t6", "7000\t8e3\t9"])
    assert {tuple(r) for r in got.collect()} == {("A", "S1", "A", "S1", 1.0), ("A", "S1", "B", "S1", 2.0), ("B", "S2", "A", "S1", 7.0), ("B", "S2", "B", "S1", 8.0)}


@pytest.mark.parametrize("lines, words", [(["1\t2\t3", "4\t5\t6"], "line without"), (["1\t2\t3"] * 4, "line without"), (["1\t2\t3", "4\t5\t6", "7\t8"], "line without"), (["1\t2\t3", "4\t5\t6", "7\tx\t9"], "no number")])
def test_block_that_does_not_fit_its_labels(spark, tmp_path, lines, words):
    with pytest.raises(Exception, match=words):
        block(spark, tmp_path, lines).collect()


AXES = {"year": [2000, 2001], "country": ["A", "B", "C"], "sector": ["S", "T"], "kind": ["p", "q"]}
KINDS = {"year": "int", "country": "string", "sector": "string", "kind": "string"}


def test_positions_round_trip(spark):
    cells = spark.createDataFrame([(2000, "A", "S", "p", 1.0), (2001, "A", "S", "p", 2.0), (2000, "B", "S", "p", 3.0), (2001, "C", "T", "q", 24.0)], "year int, country string, sector string, kind string, value double")
    values = positions.encoded(cells, AXES)
    at = {r.pos: r.value for r in values.collect()}
    assert len(at) == 24 and {p: v for p, v in at.items() if v is not None} == {0: 1.0, 1: 2.0, 2: 3.0, 23: 24.0}  # the first axis runs fastest
    axes = {k: (v, KINDS[k]) for k, v in AXES.items()}
    back = positions.decoded(values, axes, [2, 3, 2, 2])
    assert {tuple(r) for r in back.where("value is not null").collect()} == {tuple(r) for r in cells.collect()}
    bare = positions.decoded(values, {**axes, "country": (None, "int")}, [2, 3, 2, 2])
    assert {r.country for r in bare.collect()} == {1, 2, 3}
    for bad, size in ((values.where("pos < 23"), [2, 3, 2, 2]), (values.unionByName(values.limit(1)), [2, 3, 2, 2]), (values.withColumn("pos", F.col("pos") + 1), [2, 3, 2, 2]), (values, [2, 3, 2, 3])):
        with pytest.raises(ValueError):
            positions.decoded(bad, axes, size)


def part(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-"))


def test_bundle_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(300).withColumn("v", F.col("id") / 7)
    bundles.install(df.repartition(3), path)
    assert sorted(map(tuple, bundles.opened(spark, path).collect())) == sorted(map(tuple, df.collect()))
    for f in os.listdir(path):
        if f.endswith(".crc"):  # as on stores that keep no checksums of their own
            os.unlink(os.path.join(path, f))
    first, second, _ = part(path)
    raw = bytearray(open(first, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(first, "wb").write(raw)
    os.rename(second, second.replace("part-", "part-9"))
    got = {(r.file, r.problem) for r in bundles.damage(spark, path).collect()}
    assert got == {(os.path.basename(first), "changed"), (os.path.basename(second), "missing"), (os.path.basename(second).replace("part-", "part-9"), "unexpected")}
    with pytest.raises(ValueError, match="changed"):
        bundles.opened(spark, path)


def test_failed_install_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    bundles.install(spark.range(5), path)
    with pytest.raises(ValueError, match="exists"):
        bundles.install(spark.range(6), path)
    real = bundles.moved

    def failing(session, old, new):
        if new == path and ".stage-" in old:
            raise OSError("disk gone")
        real(session, old, new)

    monkeypatch.setattr(bundles, "moved", failing)
    with pytest.raises(OSError):
        bundles.install(spark.range(6), path, replace=True)
    monkeypatch.undo()
    assert bundles.opened(spark, path).count() == 5 and os.listdir(tmp_path) == ["b"]
    with pytest.raises(Exception, match="by zero"):
        bundles.install(spark.range(6).select(F.raise_error(F.lit("division by zero")).cast("int").alias("x")), path, replace=True)
    assert bundles.opened(spark, path).count() == 5 and os.listdir(tmp_path) == ["b"]
    bundles.install(spark.range(7), path, replace=True)
    assert bundles.opened(spark, path).count() == 7 and os.listdir(tmp_path) == ["b"]


def test_generation_hashes_again_what_changed(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for n in "abc":
        (tmp_path / "in" / f"{n}.txt").write_text(n * 10)
    root = str(tmp_path)
    before = spark.createDataFrame(bundles.scanned(spark, root).collect(), bundles.GENERATION)
    mark = bundles.generation_id(before)
    assert {r.file for r in before.collect()} == {"in/a.txt", "in/b.txt", "in/c.txt"} and len(mark) == 64
    bundles.verified(spark, root, before, mark)
    read = []
    real = bundles.files_named
    monkeypatch.setattr(bundles, "files_named", lambda s, p, names: read.extend(names) or real(s, p, names))
    (tmp_path / "in" / "a.txt").write_text("changed")
    os.utime(tmp_path / "in" / "b.txt", (1, 1))  # touched: read again, the same
    (tmp_path / "in" / "c.txt").unlink()
    (tmp_path / "d.txt").write_text("new")
    now = bundles.scanned(spark, root, before)
    assert sorted(read) == ["d.txt", "in/a.txt", "in/b.txt"]
    assert {tuple(r) for r in bundles.changes(before, now).collect()} == {("in/a.txt", "changed"), ("in/c.txt", "removed"), ("d.txt", "added")}
    assert bundles.generation_id(now) != mark
    with pytest.raises(ValueError, match="changed"):
        bundles.verified(spark, root, before, mark)
    with pytest.raises(ValueError, match="not that of"):
        bundles.verified(spark, root, before, "0" * 64)


def test_years_without_a_job(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(2001, 1), (1999, 2)], "year int, v int").write.partitionBy("year").parquet(path)
    spark.sparkContext.setJobGroup("years", "years")
    assert bundles.years_of(spark, path) == [1999, 2001]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("years")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
