"""Operator 9: deterministic sharded WARC writer and reader.

Records are sorted by page id over contiguous id ranges ("shards") of ``shard_bytes`` payload bytes.
The cuts come from running sums of exact sizes in id order, so they depend on the rows alone and a
second run writes the same files under the same names. A task writes its shards' records in order,
each as its own gzip member with a fixed time stamp, and rolls to a new file once ``file_bytes``
compressed bytes are written. Files get a temporary name per attempt and are renamed when whole to
the name of their shard and roll, which any attempt gives to the same bytes; the manifest, written by
Spark, lists what successful attempts made, and only listed files are read.

Sizes are summed in one pass: ids and sizes are range-partitioned and sorted, each partition keeps
its running sum, and the partitions' totals (one number each) place them after one another. The cuts
are at most ``MOST_SHARDS`` numbers; shards grow beyond ``shard_bytes`` where there would be more.

Of records with equal payloads of ``least_bytes`` or more, the one with the smallest page id is a
response and the others are revisits that name it. Digests are grouped without the payloads; the
few bytes of a revisit then meet the record in the same sort that carries the payloads, so these
are shuffled once.

Defined cases: null html is an empty payload, null url an empty URI; records without a page id sort
first and are revisits of the smallest id with their payload, responses where no id has it; repeated
rows give repeated records with numbered record ids (rows that share the smallest id are all
responses, and revisits refer to the first of them); rows that share an id share a shard, whose files
still roll; a long payload is one record, held whole by its task; an empty table gives an empty
manifest; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm.common import filesystem, saved, shared_dir

MANIFEST = "shard long, roll int, file string, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, again: int = 0) -> str:
    """``again``: how many equal records of the same page come before."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' + (f':{again}' if again else ''))}>"


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page_id, url, payload: bytes, refers_to, date: str, payload_digest: str | None = None, again: int = 0) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP headers alone."""
    digest = payload_digest or base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, again)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page: {'' if page_id is None else page_id}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(source, size: int = 1 << 20):
    """The contents of a file's gzip members, one at a time."""
    z, out, rest = zlib.decompressobj(31), io.BytesIO(), b""
    while True:
        rest = rest or source.read(size)
        if not rest:
            if out.tell():
                raise ValueError("the file ends within a record")
            return
        out.write(z.decompress(rest))
        rest = b""
        if z.eof:
            yield out.getvalue()
            rest, z, out = z.unused_data, zlib.decompressobj(31), io.BytesIO()


def parsed(data: bytes) -> dict:
    """Headers of a record in lower case, the block, HTTP headers and payload; digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    out = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(out["content-length"])]
    if len(block) != int(out["content-length"]) or "sha1:" + base32_sha1(block) != out["warc-block-digest"]:
        raise ValueError(f"damaged record {out.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = dict(line.split(": ", 1) for line in http.decode().lower().split("\r\n")[1:])
    out["payload"] = payload
    if out["warc-type"] == "response" and "sha1:" + base32_sha1(payload) != out["warc-payload-digest"]:
        raise ValueError(f"wrong payload digest in {out['warc-record-id']}")
    return out


#: Shards at most: eight bytes each on the driver and the executors.
MOST_SHARDS = 1 << 20
#: Writing tasks at most; beyond that a task writes several shards in a row.
MOST_TASKS = 100_000


def balanced_cuts(rows: DataFrame, target: int, rows_per_part: int = 1_000_000) -> list[int]:
    """Lower bounds of contiguous id ranges of about ``target`` bytes each. ``rows``: (id, bytes)."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            run = np.cumsum(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64) + held
            held = int(run[-1]) if len(run) else held
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(run), pa.int32()), batch.column(0), batch.column(1), pa.array(run)], names=["pid", "id", "bytes", "upto"])

    parts = min(10_000, 1 + rows.count() // rows_per_part)
    placed = rows.select("id", F.col("bytes").cast("long").alias("bytes")).repartitionByRange(parts, "id").sortWithinPartitions("id")
    placed = saved(placed.mapInArrow(sums, "pid int, id long, bytes long, upto long"), "sizes")
    totals = {r.pid: r.n for r in placed.groupBy("pid").agg(F.max("upto").alias("n")).collect()}  # a row for each partition
    if not totals:
        return []
    before, held = [0] * (max(totals) + 1), 0
    for pid in sorted(totals):
        before[pid], held = held, held + totals[pid]
    target = max(target, -(-held // MOST_SHARDS))
    start = F.element_at(F.lit(before), F.col("pid") + 1) + F.col("upto") - F.col("bytes")
    cuts = placed.groupBy((start / F.lit(target)).cast("long").alias("shard")).agg(F.min("id").alias("id")).collect()
    return sorted({r.id for r in cuts})


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 256 << 20, file_bytes: int = 16 << 20, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages as WARC files into ``folder`` and returns the manifest."""

    def write(batches):
        import pyarrow as pa

        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        done: list[dict] = []
        state: dict = {"shard": None, "roll": 0, "out": None}

        def close():
            if state["out"] is not None:
                state["out"].close()
                name = f"pages-{state['shard']:08d}-{state['roll']:05d}.warc.gz"
                renamed(where, state["tmp"], f"{base}/{name}", state["bytes"])
                done.append({"shard": state["shard"], "roll": state["roll"], "file": name, "n_records": state["n"], "n_bytes": state["bytes"], "sha256": state["sha"].hexdigest()})
                state.update(out=None, roll=state["roll"] + 1)

        def put(row, refers_to):
            shard, page_id, url, payload, digest = row
            if shard != state["shard"]:
                close()
                state.update(shard=shard, roll=0)
            if state["out"] is None:
                tmp = f"{base}/.{uuid.uuid4().hex}.tmp"
                state.update(tmp=tmp, out=where.open_output_stream(tmp, compression=None), n=0, bytes=0, sha=hashlib.sha256())
            same[digest] = same.get(digest, -1) + 1
            data = packed(record(page_id, url, payload, refers_to, date, digest, same[digest]))
            state["out"].write(data)
            state["sha"].update(data)
            state["n"] += 1
            state["bytes"] += len(data)
            if state["bytes"] >= file_bytes:
                close()

        refers: dict = {}
        same: dict = {}  # records written of the page id at hand, by digest
        at = None
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for shard, page_id, sha1, url, html, refers_to in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], columns[4], columns[5].to_pylist()):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                if page_id != at:
                    refers, at = {}, page_id
                    same.clear()
                if refers_to is not None:  # sorts before the record that it is about
                    refers[digest] = refers_to
                    continue
                put((shard, page_id, url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), digest), refers.get(digest))
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int64()), ("roll", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    facts = saved(rows.select("page_id", "sha1", F.octet_length("html").alias("n")), "digests")
    first = facts.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.max(F.col("page_id").isNull()).alias("unnamed")).where("first <> last or (unnamed and first is not null)").select("sha1", "first")
    again = facts.where(F.col("n") >= least_bytes).join(first, "sha1").where("not page_id <=> first").select("page_id", "sha1", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.col("first").alias("refers_to")).distinct()
    cuts = balanced_cuts(facts.select(F.col("page_id").alias("id"), (F.col("n") + 600).alias("bytes")).where("id is not null"), shard_bytes)
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
    if cuts:
        sent_cuts = spark.sparkContext.broadcast(cuts)

        def place(ids: pd.Series) -> pd.Series:
            found = np.searchsorted(np.asarray(sent_cuts.value), ids.fillna(sent_cuts.value[0]).to_numpy(dtype=np.int64), side="right") - 1
            return pd.Series(np.maximum(found, 0))

        place.__annotations__ = {"ids": pd.Series, "return": pd.Series}
        placed = both.withColumn("shard", F.pandas_udf(place, "long")("page_id"))
    else:
        placed = both.withColumn("shard", F.lit(0).cast("long"))
    shards = max(1, len(cuts))
    tasks = min(shards, MOST_TASKS)
    sent = placed.select("shard", "page_id", "sha1", "url", "html", "refers_to").repartitionById(tasks, (F.col("shard") * tasks / shards).cast("int"))
    sent = sent.sortWithinPartitions("shard", "page_id", F.col("refers_to").isNull(), "sha1", "url")
    sent.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def renamed(where, tmp: str, name: str, size: int) -> None:
    """Gives a whole file its final name. Another attempt may have done so: its bytes are the same."""
    try:
        where.move(tmp, name)
    except OSError:
        if where.get_file_info(name).size != size:
            raise
        where.delete_file(tmp)


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all files of the manifest, each file in a task of its own."""
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * with_payload

    def read(batches):
        import pyarrow as pa

        where, base = filesystem(folder)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows: list[tuple] = []
                    for data in members(source):
                        r = parsed(data)
                        page, refers = r["x-page"], r.get("x-refers-to-page")
                        rows.append((int(page) if page else None, r["warc-target-uri"], int(r["http"]["content-length"]), r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], int(refers) if refers else None, r["payload"])[: len(names)])
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes the archive of ``pages`` below the shared folder and reads it back."""
    folder = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
