"""Order MinHash document fingerprints.

Each of `hashes` hash functions picks the `length` occurrence-numbered k-mers (k-mer, how many times it occurred before) with
the smallest values, keeps them in text order and hashes the tuple. Likeness is the share of equal tuple hashes; it falls
with edit distance, moved passages included, which plain MinHash doesn't see.

One narrow pass over texts: a text edited at its tail shares the k-mers of its head, so both are sketched for the cost of
one and a bit. A text shorter than k is one k-mer, the empty text none (its signature is all zeros). Nulls are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import parts

K, LENGTH, HASHES = 6, 2, 64
#: K-mers hashed at once: the hashes of all functions take 2 MB then.
CHUNK = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20)
SALTS = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
FACTORS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-mer that starts at each code point; a shorter text is one k-mer."""
    h = mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix(np.array([int.from_bytes(hashlib.blake2b(points.tobytes(), digest_size=8).digest(), "little")], np.uint64))
    out, width, at = np.zeros(n - k + 1, np.uint64), 1, 0
    power = h
    left = k
    factor = np.uint64(0x5851F42D4C957F2D)
    while left:  # k in binary: joins runs of doubling width
        if left & 1:
            out = out * factor + power[at : at + n - k + 1]
            at += width
        left >>= 1
        if left:
            power = mix(power[:-width] * np.uint64(3) + power[width:])
            width *= 2
    return mix(out)


def numbered(kmer: np.ndarray) -> np.ndarray:
    """Each k-mer hash combined with how many times it occurred before in the text."""
    n = len(kmer)
    if n < 2:
        return kmer
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    packed = np.sort((kmer >> bits << bits) | np.arange(n, dtype=np.uint64))  # by k-mer, then place
    same = (packed[1:] >> bits) == (packed[:-1] >> bits)
    if not same.any():
        return kmer
    run = np.arange(n)
    first = np.where(np.concatenate(([True], ~same)), run, 0)
    count = (run - np.maximum.accumulate(first)).astype(np.uint64)
    more = count > 0
    out = kmer.copy()
    at = (packed[more] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out[at] = mix(kmer[at] + count[more] * np.uint64(0xD1342543DE82EF95))
    return out


def smallest(values: np.ndarray, offset: int, length: int, hashes: int, picked: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hash function its `length` smallest, of `picked` too: hash values, places, k-mers. Padded with the largest value."""
    top = np.iinfo(np.uint64).max
    best, place, what = picked or (np.full((hashes, length), top, np.uint64), np.full((hashes, length), -1, np.int64), np.zeros((hashes, length), np.uint64))
    salts, factors = SALTS[:hashes, None], FACTORS[:hashes, None]
    room = np.empty(hashes * min(CHUNK, len(values)), np.uint64)
    for lo in range(0, len(values), CHUNK):
        part = values[lo : lo + CHUNK]
        h = room[: hashes * len(part)].reshape(hashes, -1)
        np.bitwise_xor(part, salts, out=h)
        np.multiply(h, factors, out=h)
        rows = np.arange(hashes)
        new = np.full((hashes, length), top, np.uint64)
        new_place = np.full((hashes, length), -1, np.int64)
        for i in range(min(length, len(part))):
            at = h.argmin(axis=1)
            each = np.arange(len(rows))
            got = h[each, at]
            better = got < best[rows, length - 1 - i]  # as i of this part come before it
            if not better.all():
                if not better.any():
                    break
                h, rows, at, got, each = h[better], rows[better], at[better], got[better], each[: np.count_nonzero(better)]
            new[rows, i], new_place[rows, i] = got, at
            h[each, at] = top
        else:
            i = length
        if i == 0:
            continue
        new_what = np.where(new_place < 0, np.uint64(0), part[new_place])
        new_place[new_place >= 0] += lo + offset
        if best[:, 0].min() == top:  # nothing was picked before
            best, place, what = new, new_place, new_what
            continue
        best, place, what = (np.concatenate(x, axis=1) for x in ((best, new), (place, new_place), (what, new_what)))
        order = np.argsort(best, axis=1, kind="stable")[:, :length] + np.arange(hashes)[:, None] * best.shape[1]
        best, place, what = (x.ravel()[order] for x in (best, place, what))
    return best, place, what


def signature(picked: tuple) -> np.ndarray:
    """32 bits per hash function: the tuple of picked k-mers in text order."""
    _, place, what = picked
    order = np.argsort(place, axis=1, kind="stable") + np.arange(len(place))[:, None] * place.shape[1]
    what, place = what.ravel()[order], place.ravel()[order]
    out = np.zeros(len(what), np.uint64)
    for i in range(what.shape[1]):
        out = mix(out * np.uint64(31) + np.where(place[:, i] < 0, np.uint64(0), what[:, i] | np.uint64(1)))
    out = np.where((place >= 0).any(axis=1), out | np.uint64(1), np.uint64(0))
    return (out & np.uint64(0xFFFFFFFF)).astype("<u4")


def sketch(text: str, k: int = K, length: int = LENGTH, hashes: int = HASHES) -> np.ndarray:
    return signature(smallest(numbered(kmers(code_points(text), k)), 0, length, hashes))


def sketch_both(text: str, edited: str, k: int, length: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of one with the same head; equal to sketch() of each."""
    points, others = code_points(text), code_points(edited)
    n = min(len(points), len(others))
    differ = np.flatnonzero(points[:n] != others[:n])
    same = (int(differ[0]) if len(differ) else n) - k + 1  # k-mers that lie in the common head
    a = kmers(points, k)
    b = np.concatenate((a[:same], kmers(others[same:], k))) if 0 < same and len(others) - same >= k else kmers(others, k)
    a, b = numbered(a), numbered(b)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    shared = smallest(a[:head], 0, length, hashes)
    picked = [smallest(x[head:], head, length, hashes, shared) for x in (a, b)]
    both = signature(tuple(np.concatenate(x) for x in zip(*picked, strict=True)))
    return both[:hashes], both[hashes:]


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    return float((x == y).mean()) if len(x) else 1.0


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", k: int = K, length: int = LENGTH, hashes: int = HASHES) -> DataFrame:
    """docs with out_col: the signature in hexadecimal, eight digits per hash function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch(t or "", k, length, hashes).tobytes().hex())

    return docs.withColumn(out_col, run(F.col(text_col)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Deals rows to range buckets of the id, in order, and repeats each bucket's first rows at the end of the bucket before, so
    that every row's successor (the first row after the last) is in its own bucket. Columns: _bucket, _guest, doc_id, text.

    Only the bucket limits and each bucket's least id go to the driver: a fixed number. Ids are sorted, nulls first; rows
    with equal ids are sorted by text.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = buckets or parts(spark)
    limits = sorted(set(src.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = F.lit(0)
    if limits:
        # the number of limits at or under the id
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(int(x)) for x in limits]), lambda x: x <= F.col("doc_id"))))
    src = src.withColumn("_bucket", bucket)
    heads = {r["_bucket"]: (r["least"], r["nulls"]) for r in src.groupBy("_bucket").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()}
    order = sorted(heads)
    rows = src.withColumn("_guest", F.lit(0))
    if order:
        first = [(b, heads[b][0] if not heads[b][1] else None, order[i - 1]) for i, b in enumerate(order)]
        home = F.when(F.lit(False), F.lit(0))
        for _, least, before in first:
            home = home.when(F.col("doc_id").eqNullSafe(F.lit(least)), F.lit(before))
        # explode the head rows only
        copies = F.when(home.isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.struct(home.alias("b"), F.lit(1).alias("g"))))
        rows = src.withColumn("_c", F.explode(copies)).select(F.col("_c.b").alias("_bucket"), F.col("_c.g").alias("_guest"), "doc_id", "text")
    return rows.select("_bucket", "_guest", "doc_id", "text").repartition(n, "_bucket").sortWithinPartitions("_bucket", "_guest", F.col("doc_id").asc_nulls_first(), "text")


def edited_text(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, length: int = LENGTH, hashes: int = HASHES) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = held = waiting = None  # held: the last row, whose successor comes next; waiting: a row but for near_next
        closed = False
        for f in frames:
            rows = []
            for b, guest, doc_id, text in zip(f["_bucket"], f["_guest"], f["doc_id"], f["text"], strict=True):
                if b != bucket:
                    bucket, held, waiting, closed = b, None, None, False
                if closed:
                    continue  # further guests with the same id
                if held is not None:
                    edited = edited_text(held[1], text)
                    mine, theirs = (x.tobytes() for x in sketch_both(held[1], edited, k, length, hashes))
                    if waiting is not None:
                        rows.append((*waiting[0], likeness(waiting[1], mine)))
                    row = held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine.hex(), theirs.hex(), likeness(mine, theirs)
                    waiting = row, mine
                held = doc_id, text
                if guest:
                    rows.append((*waiting[0], likeness(waiting[1], sketch(text, k, length, hashes).tobytes())))
                    closed = True
            yield pd.DataFrame(rows, columns=columns)

    # ids travel as text: pandas would make a column of longs with nulls one of floats
    rows = with_next(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumn("doc_id", F.col("doc_id").cast("long"))
