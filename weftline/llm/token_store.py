"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, low chunk first. Level k holds chunk k of every id that has more than k chunks,
a bitmap tells which of them go on to level k + 1, and a rank directory over the bitmap says where: any token is read
with one byte and one bit per level, without decoding a block.

A file is ``WDAC1`` + a header of little-endian numbers, then documents' ids and first tokens, then the levels. Files
follow each other in ascending doc_id order; a manifest row per file has its counts, and prefix sums over the manifest
give every document its place among all ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.scratch import Scratch, n_parts, ship

MAGIC, BLOCK = b"WDAC1\0\0\0", 512
HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, levels
LEVEL = struct.Struct("<QQ")  # codes in the level, bytes of its bitmap (0: nothing goes on)
#: A file is closed once it holds so many ids.
FILE_IDS = 4_000_000

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: codes (uint8), continuation bitmap (packed, little bit order), ranks before each block (uint64)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        codes = rest.astype(np.uint8)
        if not more.any():
            return [*levels, (codes, np.empty(0, np.uint8), np.empty(0, np.uint64))]
        bits = np.packbits(more, bitorder="little")
        levels.append((codes, bits, _directory(bits)))
        rest = rest[more] >> 8


def _directory(bits: np.ndarray) -> np.ndarray:
    step = BLOCK // 8
    counts = np.add.reduceat(_POPCOUNT[bits].astype(np.uint64), np.arange(0, len(bits), step))
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint64)


def pack_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes. A null doc_id is kept by a null byte per document."""
    levels = encode_levels(ids)
    starts = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.uint64))]).astype("<u8")
    out = [HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels))]
    out += [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), starts.tobytes()]
    for codes, bits, ranks in levels:
        out += [LEVEL.pack(len(codes), len(bits)), codes.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    body = b"".join(out)
    return body + zlib.crc32(body).to_bytes(4, "little")


class TokenFile:
    """A written file: ``doc_ids``, ``token(i)``, ``document(k)`` and ``all()``. Takes bytes or any buffer (an mmap)."""

    def __init__(self, data, check: bool = True):
        view = memoryview(data)
        magic, docs, self.n, n_levels = HEAD.unpack_from(view, 0)
        if magic != MAGIC or check and zlib.crc32(view[:-4]) != int.from_bytes(view[-4:], "little"):
            raise ValueError("not a whole token file")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            count, n_bits = LEVEL.unpack_from(view, at)
            at += LEVEL.size
            self.levels.append((take("u1", count), take("u1", n_bits), take("<u8", -(-n_bits // (BLOCK // 8)))))

    def token(self, i: int) -> int:
        """Id number ``i`` of the file, by one code and one rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (codes, bits, ranks) in enumerate(self.levels):
            value |= int(codes[i]) << (8 * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * (BLOCK // 8)
            inside = int(_POPCOUNT[bits[first : i >> 3]].sum()) + int(_POPCOUNT[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i = int(ranks[block]) + inside
        return value

    def document(self, k: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)

    def all(self) -> np.ndarray:
        """All ids at once: each level is spread over the ids of the level before that go on."""
        value = np.zeros(0, np.uint32)
        for codes, bits, _ in reversed(self.levels):
            here = codes.astype(np.uint32)
            if len(bits):
                here[np.flatnonzero(np.unpackbits(bits, count=len(codes), bitorder="little"))] |= value << np.uint32(8)
            value = here
        return value


def _open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_files(content: str, end_id: int, uri: str, file_ids: int):
    end = int(end_id).to_bytes(4, "little")

    def write(batches):
        enc, part, seg = bpe.encoder(content), TaskContext.get().partitionId(), 0
        store, top = _open_store(uri)
        docs: list = []
        lengths: list[int] = []
        codes: list[bytes] = []

        def close():
            nonlocal seg
            ids = np.frombuffer(b"".join(codes), "<u4")
            name = f"part-{part:06d}-{seg:05d}.dac"
            # Written aside and renamed, so that a task that is run again replaces the whole file by an equal one.
            aside = f"{top}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as f:
                f.write(pack_file(docs, lengths, ids))
            store.move(aside, f"{top}/{name}")
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "segment": [seg], "n_docs": [len(docs)], "n_ids": [len(ids)]})
            seg += 1
            for x in (docs, lengths, codes):
                x.clear()
            return row.cast(MANIFEST)

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                for doc_id, code in zip(cut.column(0).to_pylist(), enc.encode([t or "" for t in cut.column(1).to_pylist()]), strict=True):
                    docs.append(doc_id)
                    codes.append(code + end)
                    lengths.append(len(code) // 4 + 1)
                    total += lengths[-1]
                    if total >= file_ids:
                        total = 0
                        yield close()
        if docs:
            yield close()

    return write


MANIFEST = pa.schema([("name", pa.string()), ("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(documents: DataFrame, uri: str, vocab_path: str, end_id: int = 2, file_ids: int = FILE_IDS, scratch: Scratch | None = None) -> DataFrame:
    """Writes the token files of ``documents`` under ``uri`` and returns their manifest, with each file's first id.

    Documents stand in ascending doc_id order, nulls first; rows of one doc_id in the order of their texts' hashes,
    so that a doc_id that holds many rows is dealt over several files. A null text is an empty one. An empty table
    gives no files and an empty manifest.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "tokens")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    key = ["doc_id", "_hash", "_tie"]
    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_tie"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    manifest = scratch.keep(ordered.mapInArrow(_write_files(bpe.vocabulary(vocab_path), end_id, uri, file_ids), "name string, part int, segment int, n_docs long, n_ids long"))
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).withColumn("uri", F.lit(uri))


def _digest_file(batches):
    for batch in batches:
        for uri, name, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            store, top = _open_store(uri)
            with store.open_input_stream(f"{top}/{name}") as f:
                read = TokenFile(f.read())
            ids, starts = read.all().astype("<u4").view(np.uint8), read.starts
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(read.doc_ids, pa.int64()), pa.array(first + starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: the ids before it, its number of ids and their crc32."""
    ship(manifest.sparkSession)
    return manifest.select("uri", "name", "first_id").repartition(n_parts(manifest.sparkSession)).mapInArrow(_digest_file, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(documents: DataFrame, vocab_path: str | None = None, end_id: int = 2, uri: str | None = None) -> DataFrame:
    """Writes all documents' ids in the file format and returns what the files say when read back.

    Nulls, repeated rows, ties and empty tables: as in ``write_token_files``; texts of any length are encoded whole.
    Other columns are not read.
    """
    import public_tokenizers

    scratch = Scratch(documents.sparkSession, "tokens")
    manifest = write_token_files(documents, uri or scratch.new_path("dac"), vocab_path or public_tokenizers.path("word_bpe_49k.json"), end_id, scratch=scratch)
    return read_digest(manifest)
