"""Operator 8: token ids in binary files, coded by range asymmetric numeral systems (rANS).

Layout of a segment file (little endian)::

    "FMTS" u16 version | u32 n | n x u32 symbol | n x u16 frequency      the shared table
    block*                                                               independent blocks
    zlib(index)                                                          blocks and documents
    u32 index length | u32 crc32 of the index | "FMTS"

A block is a run of at most ``block_tokens`` ids split over interleaved lanes:
``u16 lanes | lanes x u32 state | u16 words``. The index keeps, for every block, its offset,
length, number of ids and crc32, so that any block can be decoded alone, and the document ids with
their lengths. All blocks of a segment share the table, which counts every id of the segment.

Writing: rows are range-partitioned by document id; a task encodes its documents in order and rolls
a segment once ``segment_tokens`` ids are gathered, so memory is bounded by a segment and one
document. Files get a temporary name per attempt and are renamed when whole; the manifest table is
written by Spark, so it lists only what successful attempts made, and a lost executor costs its
tasks alone.

Defined cases: null text is the empty document (only the end id); null document ids come first;
rows that share an id follow one another in order of their texts; an empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.llm.common import filesystem, shared_dir

MAGIC = b"FMTS"
SCALE_BITS = 16
MANIFEST = "pid int, seg int, file string, n_docs long, n_tokens long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"

# ------------------------------------------------------------------ coder


def frequency_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, scaled to sum to 2**16 - 1 at most, each >= 1."""
    symbols = np.flatnonzero(counts)
    if len(symbols) > (1 << SCALE_BITS) - 1:
        raise ValueError("more than 65535 distinct ids in one segment; lower segment_tokens")
    c = counts[symbols].astype(np.float64)
    room = (1 << SCALE_BITS) - 1
    freq = np.maximum(1, np.floor(c * (room / max(c.sum(), 1.0)))).astype(np.int64)
    over = int(freq.sum()) - room
    while over > 0:  # rare symbols were raised to 1: take it back from the frequent ones
        top = np.argsort(-freq, kind="stable")[: max(1, len(freq) // 8)]
        cut = np.minimum(freq[top] - 1, np.maximum(1, freq[top] * over // max(1, int(freq[top].sum()))))
        cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        freq[top] -= cut
        over = int(freq.sum()) - room
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_block(index: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int) -> bytes:
    """``index``: positions in the table. The last lane row is padded with position 0."""
    n = len(index)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    grid = np.zeros(steps * lanes, dtype=np.intp)
    grid[:n] = index
    grid = grid.reshape(steps, lanes)
    f_all, s_all = freq[grid], start[grid]
    x = np.full(lanes, 1 << 16, dtype=np.uint32)
    words = []
    for k in range(steps - 1, -1, -1):
        f = f_all[k]
        full = (x >> 16) >= f
        words.append(x[full].astype(np.uint16))
        x = np.where(full, x >> 16, x)
        q = x // f
        x = (q << 16) + (x - q * f) + s_all[k]
    words.reverse()
    return struct.pack("<H", lanes - 1) + x.astype("<u4").tobytes() + np.concatenate(words).astype("<u2").tobytes()


def decode_block(data: bytes, n: int, symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, slots: tuple | None = None) -> np.ndarray:
    """The ``n`` ids of a block."""
    by_slot, f_slot, bias = slots or slot_tables(symbols, freq, start)
    lanes = struct.unpack_from("<H", data)[0] + 1
    x = np.frombuffer(data, "<u4", lanes, 2).astype(np.uint32)
    words = np.frombuffer(data, "<u2", -1, 2 + 4 * lanes)
    steps, at = -(-n // lanes), 0
    out = np.empty((steps, lanes), dtype=np.uint32)
    for k in range(steps):
        slot = x & 0xFFFF
        out[k] = by_slot[slot]
        x = f_slot[slot] * (x >> 16) + bias[slot]
        need = np.flatnonzero(x < 65536)
        if len(need):
            x[need] = (x[need] << 16) | words[at : at + len(need)]
            at += len(need)
    return out.reshape(-1)[:n]


def slot_tables(symbols, freq, start) -> tuple:
    """Per slot of the scaled range: the symbol, its frequency, the slot's place within it."""
    used = int(freq.sum())
    position = np.zeros(1 << SCALE_BITS, dtype=np.intp)
    position[:used] = np.repeat(np.arange(len(freq)), freq)
    bias = np.arange(1 << SCALE_BITS, dtype=np.uint32) - start[position]
    return symbols[position], freq[position], bias


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: list, block_tokens: int, lanes: int) -> bytes:
    counts = np.bincount(ids)
    symbols, freq = frequency_table(counts)
    start = (np.cumsum(freq) - freq).astype(np.uint32)
    place = np.zeros(len(counts), dtype=np.intp)
    place[symbols] = np.arange(len(symbols))
    parts = [MAGIC, struct.pack("<HI", 1, len(symbols)), symbols.astype("<u4").tobytes(), freq.astype("<u2").tobytes()]
    at, blocks = sum(map(len, parts)), []
    for i in range(0, len(ids), block_tokens):
        run = ids[i : i + block_tokens]
        data = encode_block(place[run], freq, start, lanes)
        blocks.append((at, len(data), len(run), zlib.crc32(run.astype("<u4").tobytes())))
        parts.append(data)
        at += len(data)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = zlib.compress(
        struct.pack("<IQ", len(blocks), len(doc_ids))
        + np.array(blocks, dtype="<u8").reshape(-1, 4).tobytes()
        + known.tobytes()
        + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
        + np.array(lengths, dtype="<u8").tobytes()
    )
    return b"".join([*parts, index, struct.pack("<II", len(index), zlib.crc32(index)), MAGIC])


class Segment:
    """A segment file opened for reading; ``block(k)`` decodes one block and checks its crc32."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 12)
        length, crc, magic = struct.unpack("<II4s", source.read(12))
        source.seek(end - 12 - length)
        packed = source.read(length)
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("not a whole segment file")
        raw = zlib.decompress(packed)
        n_blocks, n_docs = struct.unpack_from("<IQ", raw)
        at = 12
        self.blocks = np.frombuffer(raw, "<u8", 4 * n_blocks, at).reshape(-1, 4)
        at += 32 * n_blocks
        known = np.frombuffer(raw, np.uint8, n_docs, at)
        ids = np.frombuffer(raw, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        source.seek(0)
        _, _, n = struct.unpack("<4sHI", source.read(10))
        self.symbols = np.frombuffer(source.read(4 * n), "<u4")
        self.freq = np.frombuffer(source.read(2 * n), "<u2").astype(np.uint32)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint32)
        self.slots = slot_tables(self.symbols, self.freq, self.start)

    def block(self, k: int) -> np.ndarray:
        at, length, n, crc = (int(v) for v in self.blocks[k])
        self.source.seek(at)
        ids = decode_block(self.source.read(length), n, self.symbols, self.freq, self.start, self.slots)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k}: wrong checksum")
        return ids

    def documents(self):
        """``(document id, ids)`` in order; one block and one document are held at a time."""
        rest, k = np.empty(0, dtype=np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.lengths):
            if len(rest) < n:
                parts = [rest]
                have = len(rest)
                while have < n:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                rest = np.concatenate(parts)
            yield doc_id, rest[:n]
            rest = rest[n:]


# ------------------------------------------------------------------ tokenizer

LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def is_word(text: str) -> bool:
    """``LATIN_WORD`` matches all of it."""
    return text.isalpha() if text.isascii() else LATIN_WORD.fullmatch(text) is not None


def byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ChunkEncoder(dict):
    """Maps a chunk, the text between two single spaces, to the bytes of its ids.

    The pre-tokenizer of a byte-level vocabulary never joins text across a space that stands
    between two other characters, so such chunks can be encoded apart and remembered; a memory
    beyond ``most`` entries is emptied, and chunks of two parts are put together anew. Plain words go to the library's model at once, anything else
    through its whole chain.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.model = self.tokenizer.model
        self.most = most
        if self.tokenizer.normalizer is not None:
            raise ValueError("a tokenizer with a normalizer can't be applied in chunks")
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Added tokens that reach over a space or into plain words rule chunks out.
        self.chunked = not any(t.lstrip or t.rstrip or t.single_word or LATIN_WORD.search(t.content[:1]) or any(c.isspace() for c in t.content) for t in added)

        self.line_break = self.whole("\n")

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, text: str) -> bytes:
        """A word of Latin letters, with a space before it or none: one pre-token."""
        letters = text.replace(" ", self.letters[32]) if text.isascii() else text.translate(LATIN_BYTES).translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(letters)])

    def __missing__(self, chunk: str) -> bytes:
        if is_word(chunk):
            out = self.word(" " + chunk)
        elif chunk[0] == " ":  # a word without a space before it; no chunk has a space itself
            out = self.word(chunk[1:]) if is_word(chunk[1:]) else self.whole(chunk[1:])
        elif chunk[-1] in SIGNS and is_word(chunk[:-1]):  # made of remembered parts, not remembered
            return self[chunk[:-1]] + self[" " + chunk[-1]]
        elif (m := OVER_LINES.fullmatch(chunk)) is not None:
            return self[m[1]] + self.line_break + self[" " + m[2]]
        else:
            out = self.whole(" " + chunk)
        if len(chunk) <= 100:  # longer ones would make the memory large and seldom come again
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = text.split(" ")
        if not self.chunked or "" in chunks or any(c in text and (" " + c in text or c + " " in text) for c in ODD_SPACE):
            return self.whole(text)
        chunks[0] = " " + chunks[0]  # the way a chunk without a space before it is remembered
        return b"".join(map(self.__getitem__, chunks))


#: White space other than space; where it meets a space, chunks are not independent.
ODD_SPACE = "\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(chr(c) for c in range(0x1680, 0x3001) if chr(c).isspace())
#: Signs after a word; text over one line break. Their parts are pre-tokens of their own.
SIGNS = frozenset(".,;:!?)")
OVER_LINES = re.compile("([^\\s]+)\n([^\\s]+)")
#: Latin-1 letters as the one or two letters that stand for their UTF-8 bytes.
LATIN_BYTES = {c: chr(c).encode().decode("latin-1") for c in range(0xC0, 0x100)}
_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ Spark


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                      segment_tokens: int = 4_000_000, block_tokens: int = 1 << 18, lanes: int = 2048) -> DataFrame:
    """Encodes every text, writes segment files into ``folder`` in ascending id order and returns
    the manifest, which is kept in ``folder``/manifest as Parquet: a row for each segment with the
    number of ids before it (``start``)."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, pid, seg = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = enc.pack([end_id])
        where, base = filesystem(folder)
        held: list = [[], [], []]

        def rolled():
            nonlocal seg, held
            ids = np.frombuffer(b"".join(held[0]), enc.kind)
            data = encode_segment(ids, held[1], held[2], block_tokens, lanes)
            name = f"tokens-{pid:06d}-{seg:05d}-{uuid.uuid4().hex[:8]}.fmts"
            where.create_dir(base, recursive=True)
            with where.open_output_stream(f"{base}/.{name}.tmp") as out:
                out.write(data)
            where.move(f"{base}/.{name}.tmp", f"{base}/{name}")
            row = {"pid": [pid], "seg": [seg], "file": [name], "n_docs": [len(held[1])], "n_tokens": [len(ids)], "n_bytes": [len(data)]}
            seg, held = seg + 1, [[], [], []]
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("pid", pa.int32()), ("seg", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        n, size = 0, np.dtype(enc.kind).itemsize
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                held[0].append(ids)
                held[1].append(doc_id)
                held[2].append(len(ids) // size)
                n += len(ids) // size
                if n >= segment_tokens:
                    yield rolled()
                    n = 0
        if held[1]:
            yield rolled()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The segments in order. The running sum is over segments (millions of ids each), not rows."""
    before = W.orderBy("pid", "seg").rowsBetween(W.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decodes all segments, each in a task of its own: document id, place of its first id, number
    of ids and their crc32; on request also the ids."""

    def decode(batches):
        import pyarrow as pa

        where, base = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with where.open_input_file(f"{base}/{name}") as source:
                    rows: list = [[], [], [], [], []]
                    for doc_id, ids in Segment(source).documents():
                        raw = ids.astype("<u4").tobytes()
                        for column, value in zip(rows, (doc_id, start, len(ids), zlib.crc32(raw), ids.tolist() if with_ids else None)):
                            column.append(value)
                        start += len(ids)
                        if with_ids and len(rows[0]) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == 4 else pa.int64()) for k, c in enumerate(rows)], names=names)
                            rows = [[], [], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == 4 else pa.int64()) for k, c in enumerate(rows[: len(names)])], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    segments = read_manifest(spark, folder).select("file", "start")
    many = max(1, spark.read.parquet(f"{folder}/manifest").count())
    return segments.repartition(many).mapInArrow(decode, DOCUMENTS + ", ids array<long>" * with_ids)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Writes the token files of ``docs`` below the shared folder and reads them back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, folder, end_id, **options)
    return read_token_files(docs.sparkSession, folder)
