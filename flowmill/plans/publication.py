"""Immutable runs, releases and markers.

Result tables are Parquet folders under a run; a run manifest lists their content hashes and has an
id that depends on content and provenance only. A release lists one run per method, a marker
numbers releases per channel; the newest marker of a channel is current. Control files are small
JSON files on the driver's side of a shared folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.plans.config import safe_name, valid_channel
from flowmill.sources.readers import write_bundle


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def generation_id(entries: list[tuple[str, str]]) -> str:
    """Id of a source generation from length-prefixed names and hashes."""
    h = hashlib.sha256()
    for name, value in sorted(entries):
        for part in (name.encode(), value.encode()):
            h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


@contextmanager
def locked(root: Path):
    """One writer at a time: a lock folder, which only its maker removes."""
    lock = root / ".lock"
    root.mkdir(parents=True, exist_ok=True)
    try:
        lock.mkdir()
    except FileExistsError:
        raise RuntimeError("another publication is under way") from None
    try:
        yield
    finally:
        lock.rmdir()


def _write(path: Path, value: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.tmp")
    tmp.write_text(canonical(value))
    os.replace(tmp, path)


def stage_run(root: Path, method: str, run_id: str, tables: dict[str, DataFrame], provenance: dict, parent: str | None = None) -> dict:
    """Writes tables to a staging folder, checks them by reading back and renames it to the run."""
    if not safe_name(method) or not safe_name(run_id):
        raise ValueError("unsafe name")
    final, staging = root / "runs" / method / run_id, root / "staging" / run_id
    if final.exists():
        raise ValueError("runs are immutable")
    try:
        artifacts = {n: write_bundle(t, str(staging / n)) for n, t in tables.items()}
        content = {"method": method, "artifacts": artifacts, "provenance": provenance}
        manifest = content | {"run_id": run_id, "parent_run_id": parent, "result_id": digest(content)}
        _write(staging / "manifest.json", manifest)
        final.parent.mkdir(parents=True, exist_ok=True)
        os.replace(staging, final)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return manifest


def run_manifest(root: Path, method: str, run_id: str) -> dict:
    m = json.loads((root / "runs" / method / run_id / "manifest.json").read_text())
    if m["result_id"] != digest({k: m[k] for k in ("method", "artifacts", "provenance")}):
        raise ValueError("run manifest is damaged")
    return m


def check_provenance(root: Path, method: str, run_id: str, provenance: dict) -> dict:
    """A parent run for recalculation must rest on the current source."""
    m = run_manifest(root, method, run_id)
    if m["provenance"] != provenance:
        raise ValueError("the source changed since the parent run")
    return m


def current(root: Path, channel: str) -> dict | None:
    """The release of the channel's newest marker, after its checksum chain is verified."""
    markers = sorted((root / "markers" / channel).glob("*.json"))
    if not markers:
        return None
    marker = json.loads(markers[-1].read_text())
    release = json.loads((root / "releases" / f"{marker['release_id']}.json").read_text())
    if digest(release) != marker["release_sha256"]:
        raise ValueError("release differs from its marker")
    for method, entry in release["runs"].items():
        if run_manifest(root, method, entry["run_id"])["result_id"] != entry["result_id"]:
            raise ValueError(f"run of {method} differs from its release")
    return release | {"sequence": marker["sequence"]}


def commit(root: Path, channel: str, runs: dict[str, str]) -> dict:
    """A release with the given runs; other methods' runs are carried forward. The marker, written
    last, is the commit point."""
    if not valid_channel(channel):
        raise ValueError("bad channel")
    with locked(root):
        before = current(root, channel)
        kept = dict(before["runs"]) if before else {}
        kept.update({m: {"run_id": r, "result_id": run_manifest(root, m, r)["result_id"]} for m, r in runs.items()})
        release = {"channel": channel, "runs": dict(sorted(kept.items()))}
        sequence = (int(before["sequence"]) + 1) if before else 1
        release_id = f"{sequence:020d}-{digest(release)[:16]}"
        _write(root / "releases" / f"{release_id}.json", release)
        _write(root / "markers" / channel / f"{sequence:020d}.json", {"release_id": release_id, "release_sha256": digest(release), "sequence": f"{sequence:020d}"})
    return release


def merged_panels(prior: DataFrame, new: DataFrame, key: list[str], method: str = "method") -> DataFrame:
    """Prior rows of other methods and all new rows; two values of one key abort."""
    both = prior.join(new.select(method).distinct(), method, "left_anti").unionByName(new)
    values = [c for c in both.columns if c not in key]
    clash = both.groupBy(*key).agg(F.count_distinct(F.struct(*values)).alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise ValueError("conflicting rows in panel tables")
    return both.dropDuplicates(key)


def markers_table(spark: SparkSession, root: Path) -> DataFrame:
    rows = [(p.parent.name, p.stem, json.loads(p.read_text())["release_id"]) for p in sorted((root / "markers").glob("*/*.json"))]
    return spark.createDataFrame(rows, "channel string, sequence string, release_id string")


def kept_markers(markers: DataFrame, keep: dict[str, int], default: int | None = None) -> DataFrame:
    """The last n markers of each channel; channels without a number keep all."""
    if any(n < 1 for n in keep.values()):
        raise ValueError("at least one release is kept")
    n = F.element_at(F.create_map(*(F.lit(x) for kv in keep.items() for x in kv)), F.col("channel")) if keep else F.lit(None).cast("int")
    rank = F.row_number().over(W.partitionBy("channel").orderBy(F.desc("sequence")))
    return markers.withColumn("rank", rank).withColumn("n", F.coalesce(n, F.lit(default))).where("n is null or rank <= n").drop("rank", "n")


def prune_plan(spark: SparkSession, root: Path, keep: dict[str, int]) -> dict:
    """Markers, releases and runs that nothing kept refers to, and the bytes they hold."""
    markers = markers_table(spark, root)
    kept = {(r.channel, r.sequence): r.release_id for r in kept_markers(markers, keep).collect()}
    live = set(kept.values())
    runs = {(m, e["run_id"]) for r in live for m, e in json.loads((root / "releases" / f"{r}.json").read_text())["runs"].items()}
    drop = {
        "markers": sorted(f"{r.channel}/{r.sequence}" for r in markers.collect() if (r.channel, r.sequence) not in kept),
        "releases": sorted(p.stem for p in (root / "releases").glob("*.json") if p.stem not in live),
        "runs": sorted(f"{p.parent.name}/{p.name}" for p in (root / "runs").glob("*/*") if (p.parent.name, p.name) not in runs),
    }
    drop["bytes"] = sum(f.stat().st_size for r in drop["runs"] for f in (root / "runs" / r).rglob("*") if f.is_file())
    return drop


def prune(spark: SparkSession, root: Path, keep: dict[str, int], plan: dict, dry_run: bool = True) -> dict:
    """Applies a plan, if it is still what would be planned now."""
    with locked(root):
        if prune_plan(spark, root, keep) != plan:
            raise ValueError("the plan is out of date")
        if not dry_run:
            for m in plan["markers"]:
                (root / "markers" / f"{m}.json").unlink()
            for r in plan["releases"]:
                (root / "releases" / f"{r}.json").unlink()
            for r in plan["runs"]:
                shutil.rmtree(root / "runs" / r)
    return plan
