"""SimHash near-duplicates, linked by covering locality-sensitive hashing.

Fingerprint: the bitwise majority of the XXH64 of all word shingles. A random map gives each of the 64 bits a vector of
radius + 1 bits; table v (every non-zero vector) masks the fingerprint to the bits whose vector has an odd product with v. For
any set of at most `radius` differing bits some v is orthogonal to all of their vectors, so each pair within the radius
agrees on all masked bits of at least one table: no link can be missed. There are 2^(radius+1) - 1 tables.

Skew: equal fingerprints are one node before any table is built, so groups of copies never meet in a bucket. A bucket with
over `crowded` fingerprints is dealt out again by a second, independent covering family, which keeps the guarantee. Inside a
bucket only a spanning forest of the links is emitted, never all pairs.

Nulls and texts without words have fingerprint zero and link like any other. Rows with the same doc_id and different texts
count as one node's documents each; a null doc_id gets its component's smallest id that isn't null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import cut, parts, words_of
from tidebars.llm.components import components

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    h = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):  # long texts: counted piece by piece
        hi = min(n, lo + 65536)
        got = np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts[lo:hi], starts[lo + width : hi + width], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = np.array([fingerprint(t, width) for t in f["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": got.view(np.int64)})

    # ids travel as text: pandas would make a column of longs with nulls one of floats
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, fp long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def covering_masks(radius: int, seed: int, width: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks of `width` bits, as signed longs."""
    dim = radius + 1
    # every non-zero vector equally often, dealt to the bits by the seed
    vectors = np.resize(np.arange(1, 2**dim), width)
    np.random.default_rng(seed).shuffle(vectors)
    out = []
    for v in range(1, 2**dim):
        bits = [bin(v & int(x)).count("1") & 1 for x in vectors]
        mask = sum(b << i for i, b in enumerate(bits))
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """nodes with a row for each table: t, key (masked bits)."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return nodes.withColumn("_e", F.explode(tables)).select(*nodes.columns, "_e.t", "_e.key")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints: breadth-first, each fingerprint once against those left."""
    left = np.unique(fps)
    edges = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                todo += list(found)
                left = left[~near]
    return edges


def links(nodes: DataFrame, radius: int = 3, crowded: int = 4096) -> DataFrame:
    """(src, dst) fingerprints: a graph with the same components as all pairs within the radius. nodes: distinct fp."""
    spark = nodes.sparkSession
    n = parts(spark)
    first = keyed(nodes, covering_masks(radius, 1))
    size = first.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # the sizes come first: a bucket of one has no links and its rows go no further
    first = first.join(size, ["t", "key"])
    second = covering_masks(radius, 2)
    fine = first.where(F.col("n") > crowded).withColumnsRenamed({"t": "t1", "key": "key1"})
    fine = keyed(fine, second).select(F.col("t1").alias("t"), F.xxhash64("key1", F.col("t").alias("x"), "key").alias("key"), "fp")
    dealt = first.where(F.col("n") <= crowded).select("t", "key", "fp").unionByName(fine)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            edges = []
            if held:
                every = pd.concat(held)
                for _, g in every.groupby(["t", "key"], sort=False):
                    if len(g) > 1:
                        edges += forest(g["fp"].to_numpy(), radius)
            return pd.DataFrame(edges, columns=["src", "dst"], dtype="int64")

        for f in frames:
            if held and len(f):
                # groups are contiguous: keep only the last, perhaps unfinished one
                joined = pd.concat([*held, f], ignore_index=True)
                held = [joined]
            elif len(f):
                held = [f]
            if not held:
                continue
            joined = held[0]
            t, k = joined["t"].iloc[-1], joined["key"].iloc[-1]
            open_ = (joined["t"] == t) & (joined["key"] == k)
            held = [joined[~open_]]
            yield flush()
            held = [joined[open_]]
        yield flush()

    return dealt.repartition(n, "t", "key").sortWithinPartitions("t", "key").mapInPandas(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    spark = docs.sparkSession
    marked = cut(fingerprints(docs, id_col, text_col, width))  # ids and fingerprints only
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(low, "root").select("fp", "component_id")
    out = marked.join(nodes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
