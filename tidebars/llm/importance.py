"""Target-distribution importance resampling over hashed n-grams, read off suffix arrays of word ids.

Texts pass through their tasks in blocks of about `block_bytes`. A block's words become ids, and its suffixes are ordered to a depth
of `longest` words by prefix doubling. Where neighbours have a common prefix of n words or more, they are one run: one n-gram, however
often it occurs. Each run is joined and hashed once, and its bucket is scattered back to the places where it occurs.

Two passes: bucket counts of the raw and the target corpus (summed in each task before anything is shuffled; what comes to the driver
has one row a bucket, which is the bound of what is broadcast), then each document's mean gain. Drawing is by the Gumbel trick, so that the highest
scores are a sample without replacement; ranks come from one range exchange of a few numbers a document, numbered inside its
partitions and offset by the partitions before (one count a partition goes to the driver).

Null texts and texts without words have no features and weigh 0. Repeated rows are separate rows, ranked one after another; rows with a
null id draw by the seed alone and come last among ties. A text longer than a block is cut between words, and n-grams across the
cut are still counted. Empty documents give no rows; an empty target makes every gain as of a target without features. Other columns
are ignored but for those of `keep`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import cut, parts, text_of
from tidebars.llm.decontaminate import FOLD

BLOCK_BYTES = 2 << 20


@dataclass(frozen=True)
class Grams:
    """Runs of shortest to longest words, hashed to so many buckets."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000


def word_lists(texts: list[str | None], longest: int, block_bytes: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(place of the text, words, of them already told): a long text comes in several lists, each with the last longest - 1 words of the
    one before."""
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
        at, before = 0, []
        while at < len(raw):
            end = raw.find(b" ", at + block_bytes)
            end = len(raw) if end < 0 else end
            words = before + raw[at:end].split()
            yield i, words, len(before)
            before, at = words[len(words) - min(longest - 1, len(words)) :], end


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes of at most `depth` words, and each one's common prefix with the one before. left: words
    from a place to the end of its list."""
    rank, width = ids.astype(np.int64), 1
    while width < depth:  # prefix doubling: a rank by 2 * width words out of two by width
        next_ = np.full(len(rank), -1, np.int64)
        far = np.flatnonzero(left > width)
        next_[far] = rank[far + width]
        _, rank = np.unique(rank * (np.int64(len(ids)) + 1) + next_ + 1, return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(len(order), np.int32)
    alike = np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        a, b = order[:-1], order[1:]
        alike = alike & (left[a] > k) & (left[b] > k)
        at = np.flatnonzero(alike)
        alike[at] = ids[a[at] + k] == ids[b[at] + k]
        common[1:] += alike
    return order, common


def buckets_of(lists: list[list[bytes]], told: list[int], grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the list that each n-gram occurrence is in, and its bucket. Occurrences that end among the words already told aren't
    given again."""
    size = np.array([len(x) for x in lists], np.int64)
    words = [w for x in lists for w in x]
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if not len(ids):
        return
    owner = np.repeat(np.arange(len(lists)), size)
    end = np.cumsum(size)
    left = end[owner] - np.arange(len(ids))
    old = end[owner] - size[owner] + np.array(told, np.int64)[owner]  # the first word of a list that is new
    order, common = suffixes(ids, left, grams.longest)
    for n in range(grams.shortest, grams.longest + 1):
        run = np.cumsum(common < n) - 1
        whole = left[order] >= n
        at, run = order[whole], run[whole]
        if not len(at):
            continue
        _, first, place = np.unique(run, return_index=True, return_inverse=True)
        hashed = np.fromiter((zlib.crc32(words[p] if n == 1 else b" ".join(words[p : p + n])) % grams.buckets for p in at[first].tolist()), np.int64, len(first))
        new = at + n > old[at]
        yield owner[at[new]], hashed[place[new]]


def blocks(texts: list[str | None], grams: Grams, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(text of each occurrence, its bucket, texts of the lists, new words of the lists), block by block."""

    def told(rows: list[tuple[int, list[bytes], int]]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        whose = np.array([i for i, _, _ in rows], np.int64)
        got = [(whose[o], b) for o, b in buckets_of([w for _, w, _ in rows], [k for _, _, k in rows], grams)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *[o for o, _ in got]]), np.concatenate([none, *[b for _, b in got]]), whose.tolist(), [len(w) - k for _, w, k in rows]

    rows, size = [], 0
    for row in word_lists(texts, grams.longest, block_bytes):
        rows.append(row)
        size += 8 * len(row[1])
        if size >= block_bytes:
            yield told(rows)
            rows, size = [], 0
    if rows:
        yield told(rows)


def bucket_counts(texts: DataFrame, grams: Grams, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, n) of the column _text, over all rows; a task tells each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grams.buckets, np.int64)
        for batch in batches:
            for _, bucket, _, _ in blocks(batch.column("_text").to_pylist(), grams, block_bytes):
                total += np.bincount(bucket, minlength=grams.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return texts.select("_text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, grams: Grams, per: int = 1000) -> np.ndarray:
    """Each bucket's log ratio of its smoothed shares in target and raw, times `per`, rounded down."""

    def held(df: DataFrame) -> np.ndarray:
        out = np.zeros(grams.buckets)
        for r in df.collect():  # a row a bucket at most
            out[r.bucket] = r.n
        return out

    s, t = held(raw), held(target)
    ratio = (t + 1.0) * (s.sum() + grams.buckets) / ((s + 1.0) * (t.sum() + grams.buckets))
    return np.array([math.floor(per * math.log(x)) for x in ratio], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, grams: Grams, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with n_words, n_features and weight in place of _text."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kept = [f for f in rows.schema if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n, total, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for whose, bucket, lists, new in blocks(batch.column("_text").to_pylist(), grams, block_bytes):
                np.add.at(count, lists, new)
                n += np.bincount(whose, minlength=len(n))
                low = np.zeros(len(n), np.int64)
                np.add.at(low, whose, gain[bucket])
                total += low
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(x, pa.int64()) for x in (count, n, mean)], [f.name for f in kept] + ["n_words", "n_features", "weight"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int, per: int = 1000) -> Column:
    """Gumbel noise from the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-per * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, eligible: Column, order: list[Column], percent: int) -> DataFrame:
    """df with rank: 1, 2, 3 ... in order for the first `percent` of a hundred of the eligible rows, else null."""
    spark = df.sparkSession
    placed = cut(df.withColumn("_out", F.when(eligible, 0).otherwise(1)))  # the exchange reads it twice: for its bounds, then for the rows
    dealt = placed.repartitionByRange(parts(spark), "_out", *order).sortWithinPartitions("_out", *order)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))  # partition << 33, then the row's place in it
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("_out") == 0).alias("k")).orderBy("p").collect()
    begin = dict(zip([r.p for r in sizes], np.cumsum([0, *[r.n for r in sizes]]).tolist(), strict=False))
    drawn = percent * sum(r.k for r in sizes) // 100
    starts = spark.createDataFrame([*begin.items()] or [(0, 0)], "_p long, _before long")  # a row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.join(F.broadcast(starts), part == F.col("_p"))
    return out.select(*df.columns, F.when((F.col("_out") == 0) & (place <= drawn), place).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, grams: Grams = Grams(), percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_words, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(bucket_counts(docs.select(text_of(text_col).alias("_text")), grams, block_bytes), bucket_counts(target.select(text_of(target_text).alias("_text")), grams, block_bytes), grams)
    names = [f"_k{i}" for i in range(len(keep) + 1)]  # so that no column of docs can clash
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, (id_col, *keep), strict=True)], text_of(text_col).alias("_text"))
    made = weighed(rows, gain, grams, block_bytes).withColumn("score", F.col("weight") + noise(F.col("_k0"), seed))
    out = ranked(made, F.col("n_words") >= least_words, [F.col("score").desc(), F.col("_k0").asc_nulls_last()], percent)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, (id_col, *keep), strict=True)], "n_words", "n_features", "weight", "score", "rank")
