"""Texts dealt out once, and compact exchanges of what the deals have in common.

written() packs rows into deals (about `deal_bytes` of text each, in chunks of about `chunk_bytes`), as the scan's tasks read them, and
writes them to the shared folder as a table bucketed by deal. Passes over the texts then read deals by narrow scans, and what the rest of
the corpus has to say of a deal comes to it by a join that doesn't move the texts again. Deals have even sizes whatever the ids
and texts are, so no key can be hot.

Chunks ask of the corpus by keys: each sends its different keys once, sorted and packed by differences, a row a bucket of keys; the
answer is told by place, in the order of the keys that were sent. A hot key so has one entry a chunk.

Columns of `rows`: text first (not null), others as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import parts, shared_dir

#: For executors of 3 GB; where there is more memory, larger deals make fewer and larger files.
CHUNK_BYTES, DEAL_BYTES = 4 << 20, 12 << 20
#: Bytes of text whose keys are in one bucket.
KEY_BYTES = 64 << 20


def to_blob(pieces: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(pieces).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def rows_of(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pieces_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of rows with about `most` bytes of text (a longer text is alone), and their bytes."""
    size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
    lot = np.cumsum(size) // most
    ends = [*(np.flatnonzero(np.diff(lot)) + 1), len(size)]
    for a, b in zip([0, *ends], ends, strict=False):
        if b > a:
            yield batch.slice(a, b - a), int(size[a:b].sum())


def written(rows: DataFrame, kind: str, chunk_bytes: int = CHUNK_BYTES, deal_bytes: int = DEAL_BYTES) -> DataFrame:
    """(deal long, kind int, chunks array<binary>): kind is a column of rows that all of a deal have in common."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 20
        open_: dict[int, tuple[list, int, list, int]] = {}  # by kind: pieces of the chunk, their bytes, chunks, their bytes

        def told(k: int, chunks: list[bytes]) -> pa.RecordBatch:
            nonlocal at
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([k], pa.int32()), pa.array([chunks], pa.list_(pa.binary()))], ["deal", "kind", "chunks"])

        for batch in batches:
            kinds = batch.column(kind)
            for k in sorted(pc.unique(kinds).to_pylist()):
                for piece, size in pieces_of(batch.filter(pc.equal(kinds, k)), max(1, chunk_bytes // 4)):
                    pieces, n, chunks, total = open_.get(k, ([], 0, [], 0))
                    pieces, n = [*pieces, piece], n + size
                    if n >= chunk_bytes:
                        chunks, total, pieces, n = [*chunks, to_blob(pieces)], total + n, [], 0
                    if total >= deal_bytes:
                        yield told(k, chunks)
                        chunks, total = [], 0
                    open_[k] = pieces, n, chunks, total
        for k, (pieces, _, chunks, _) in open_.items():
            if pieces or chunks:
                yield told(k, [*chunks, *([to_blob(pieces)] if pieces else [])])

    name = f"deals_{uuid.uuid4().hex}"
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = deal_buckets(total, deal_bytes, parts(spark, 1), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    made = rows.mapInArrow(run, "deal long, kind int, chunks array<binary>")
    made.write.format("parquet").option("compression", "uncompressed").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, "deal").saveAsTable(name)
    return spark.table(name)


def answered(deals: DataFrame, side: DataFrame) -> DataFrame:
    """deals with `side`: what the rows of side say of each (without their column deal), as an array."""
    said = side.groupBy("deal").agg(F.collect_list(F.struct(*[c for c in side.columns if c != "deal"])).alias("side"))
    return deals.join(said, "deal", "left")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on: byte planes, as many as the largest needs, compressed."""
    if not len(x):
        return b""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8))
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted different keys."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def deal_buckets(total: int, deal_bytes: int, least: int, most: int) -> int:
    """Buckets of a table of deals over `total` bytes of text: two deals in each, but no more than Spark takes; beyond that a bucket
    has more deals, each still a row by itself."""
    return min(most, max(least, -(-total // (2 * deal_bytes))))


def key_bits(total: int, least: int) -> int:
    """Bits of buckets of keys: a task holds a bucket's keys from the whole corpus, so there are as many as bound those to what
    KEY_BYTES of text have."""
    return bucket_bits(max(least, -(-total // KEY_BYTES)))


def bucket_bits(n: int) -> int:
    """Of at least n buckets of keys."""
    return max(1, (n - 1).bit_length())


def cuts_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places at which each bucket (by the highest `bits` bits) of sorted keys begins, and the end."""
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys (sorted), each one's count, and each key's place among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(np.append(starts, len(keys))), at
