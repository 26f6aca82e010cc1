"""Near copies of texts: pairs whose sets of word shingles have a Jaccard similarity of at least `least`.

Candidates come from SimHash fingerprints by covering masks, as in simhash.py. Texts of similarity 0.8 differ in 15 of 100 bits of
a SimHash, far more than masks over 64 bits can cover, so a fingerprint has 320 bits in ten parts, and each part has masks of its
own that cover 3 differing bits of 24 (from a million nodes on 4 of 32, so that buckets stay small): a pair within 39 bits is met by
some table for sure, others by chance (what of them is missed: README). Of a bucket those nodes go on that are close in 192 bits.
Every candidate is verified with the exact similarity of the whole sets before it is linked.

Skew: equal sets are one node before any table is built. Nodes that tables connect are a cluster, and each sends its set once, not
once for every table that has it; a cluster of over BLOCK nodes is verified in pairs of blocks, one of over LARGE by the groups of
its tables. Inside a group a spanning forest of the links is emitted, never all pairs. Only nodes of a cluster send their sets,
found again with a bit table of fixed size.

Nulls and texts without words have the empty set and are copies of each other. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm import simhash
from tidebars.llm.common import cut, parts, words_of
from tidebars.llm.components import components
from tidebars.llm.line_dedup import TABLE_BITS, bit_table, grouped, spark_xxhash64

WIDTH, LEAST = 5, 0.8
SEED = 42
#: A fingerprint has PARTS halves of WORDS words of 64 bits. FINE: from so many nodes on, parts of 32 bits rather than 24.
WORDS, PARTS, FINE = 5, 10, 1 << 20
#: Bits that may differ in a part so that a table surely finds it, by bits of the part.
RADIUS = {24: 3, 32: 4}
#: Words that entries of a table carry, and the bits of them that may differ in a candidate.
SEEN, WITHIN = 3, 54
#: Nodes of a table that are dealt to one group, about.
GROUP = 1 << 16
#: Nodes of a block, about, and those up to which a cluster is verified in pairs of blocks.
BLOCK, LARGE = 1 << 10, 1 << 15
#: Bits of a whole fingerprint that may differ in a pair that is verified (at similarity 0.8: 48, give or take 6).
CLOSE = 90
MULTIPLY, ADD = np.random.default_rng(SEED).integers(0, 2**63, (2, WORDS * 8), np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of all word shingles; a text of at most `width` words has one."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return np.unique(np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)], np.uint64))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * 64 bits: the signs of as many sums, to which each shingle adds its hash bytes as signed numbers (plain
    bits would set small sets further apart than their likeness)."""
    sums = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(found), 1024):  # long texts: piece by piece
        h = found[at : at + 1024, None] * MULTIPLY + ADD
        h = (h ^ h >> np.uint64(32)) * MULTIPLY[::-1]
        sums += (h ^ h >> np.uint64(29)).view(np.int8).sum(axis=0, dtype=np.int32)
    return np.packbits(sums > 0, bitorder="little").view(np.int64)


def masks(bits: int) -> np.ndarray:
    """Covering masks of a part of that many bits."""
    return np.array(simhash.covering_masks(RADIUS[bits], SEED, bits), np.int64).astype(np.uint32)


def forest(nodes: np.ndarray, sets: list[np.ndarray], fps: np.ndarray, sides: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among nodes: breadth-first, each against those left. Sides of 0 and 1: links from
    one side to the other only."""
    left, edges = np.arange(len(nodes)), []
    sizes = np.array([len(s) for s in sets])
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            # a set of another size than that can't be as similar
            fit = left[((sides[left] != sides[x]) | (sides[x] < 0)) & (sizes[left] >= least * sizes[x] - 1e-9) & (sizes[x] >= least * sizes[left] - 1e-9)]
            fit = fit[np.bitwise_count(fps[fit] ^ fps[x]).sum(axis=1, dtype=np.int64) <= CLOSE]
            if not len(fit):
                continue
            flat = np.concatenate([sets[i] for i in fit])
            at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
            both = np.add.reduceat(sets[x][at] == flat, np.cumsum(sizes[fit]) - sizes[fit], dtype=np.int64)
            found = fit[both >= least * (sizes[fit] + sizes[x] - both) - 1e-9]
            edges += [(int(nodes[x]), int(nodes[y])) for y in found]
            todo += list(found)
            left = left[~np.isin(left, found)]
    return edges


def linked(seen: np.ndarray, crowded: int) -> list[np.ndarray]:
    """Places of the nodes of each group that close fingerprints connect; nodes without a close one are left out. In buckets of
    over `crowded` nodes each is held, breadth-first, against those left; in others nodes with a close one are picked out first."""
    out, left = [], np.arange(len(seen))
    if len(seen) <= crowded:
        near = np.zeros((len(seen), len(seen)), np.int16)
        for word in seen.T:
            near += np.bitwise_count(word[:, None] ^ word)
        left = np.flatnonzero((near <= WITHIN).sum(axis=1) > 1)
    while len(left):
        group, left = [left[:1]], left[1:]
        todo = [int(group[0][0])]
        while todo and len(left):
            near = np.bitwise_count(seen[left] ^ seen[todo.pop()]).sum(axis=1, dtype=np.int64) <= WITHIN
            if near.any():
                group.append(left[near])
                todo += left[near].tolist()
                left = left[~near]
        if len(group) > 1:
            out.append(np.concatenate(group))
    return out


def met(nodes: DataFrame, crowded: int, which: range, out: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `out` makes of the nodes of each group that meets under a mask of those parts and has close fingerprints, different
    rows. nodes: (node, fp). Tables travel packed: a row is the entries (node, words) of a batch that go to one group of keys of
    a table."""
    spark = nodes.sparkSession
    many = nodes.count()
    bits = 32 if many > FINE else 24
    cover, deals, n = masks(bits), max(1, many // GROUP), parts(spark)

    def keyed(words: np.ndarray, table: int) -> np.ndarray:
        part, mask = divmod(table, len(cover))
        return words.view(np.uint32).reshape(len(words), -1)[:, part % 2] & cover[mask]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            node, fp = f["node"].to_numpy(np.int64), np.stack(f["fp"].to_numpy()).astype(np.int64)
            for part in which:
                entries = np.column_stack([node, *[fp[:, (part // 2 + k) % WORDS] for k in range(SEEN)]])
                rows = []
                for table in range(part * len(cover), (part + 1) * len(cover)):
                    key = keyed(np.ascontiguousarray(entries[:, 1:2]), table).astype(np.uint64)
                    group = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(deals)
                    order = np.argsort(group, kind="stable")
                    cuts = np.flatnonzero(np.diff(group[order])) + 1
                    rows += [(table, int(group[at[0]]), entries[at].tobytes()) for at in np.split(order, cuts)]
                yield pd.DataFrame(rows, columns=["t", "deal", "entries"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in grouped(frames, ["t", "deal"]):
            for (table, _), g in f.groupby(["t", "deal"], sort=False):
                entries = np.frombuffer(b"".join(g["entries"]), np.int64).reshape(-1, SEEN + 1)
                key = keyed(np.ascontiguousarray(entries[:, 1:2]), table)
                order = np.argsort(key, kind="stable")
                rows = []
                for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    if len(at) > 1:
                        bucket = entries[at]
                        for places in linked(bucket[:, 1:].view(np.uint64), crowded):
                            rows.append(out(np.unique(bucket[places, 0])))
                if rows:
                    yield pd.concat(rows)

    dealt = nodes.select("node", "fp").mapInPandas(deal, "t int, deal long, entries binary")
    return dealt.repartition(n, "t", "deal").sortWithinPartitions("t", "deal").mapInPandas(meet, schema).distinct()


def candidates(nodes: DataFrame, crowded: int) -> DataFrame:
    """(key, node): groups of nodes that meet under a mask of a part and have close fingerprints, each group once. nodes: (node, fp)."""
    return met(nodes, crowded, range(PARTS), lambda node: pd.DataFrame({"key": node_of(node), "node": node}), "key long, node long")


def clusters(nodes: DataFrame, crowded: int) -> DataFrame:
    """(node, row, fp, root) of the nodes that tables connect. nodes: (node, row, fp). The tables of the first part come first; in
    the others a node goes by its root there, so that a group that is connected already makes no row."""

    def star(node: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"src": node[1:], "dst": node[0]})

    first = components(met(nodes, crowded, range(1), star, "src long, dst long"))
    known = cut(nodes.join(first, "node", "left").select("node", "row", "fp", F.coalesce("root", "node").alias("first"), F.col("root").isNotNull().alias("met")))
    more = components(met(known.select(F.col("first").alias("node"), "fp"), crowded, range(1, PARTS), star, "src long, dst long"))
    found = known.join(more.withColumnRenamed("node", "first"), "first", "left").where("met or root is not null")
    return found.select("node", "row", "fp", F.coalesce("root", "first").alias("root"))


def dealt_in_blocks(clustered: DataFrame, crowded: int) -> DataFrame:
    """(key, node, row, fp, side): groups to verify, so that every pair of nodes that a table brings together is in one. side: 0 or 1
    in a pair of blocks of a cluster, -1 where all nodes are held against each other."""
    sized = cut(clustered.join(clustered.groupBy("root").agg(F.count("*").alias("n")), "root"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod("node", blocks).cast("int")

    def with_other(other: Column) -> Column:
        key = F.xxhash64("root", F.least(own, other), F.greatest(own, other))
        return F.struct(key.alias("key"), F.when(own == other, -1).when(own < other, 0).otherwise(1).alias("side"))

    groups = sized.where(F.col("n") <= LARGE).withColumn("_g", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), with_other)))
    groups = groups.select("_g.key", "node", "row", "fp", "_g.side")
    large = sized.where(F.col("n") > LARGE).select("node", "row", "fp")
    if large.isEmpty():
        return groups
    return groups.unionByName(candidates(large, crowded).join(large, "node").withColumn("side", F.lit(-1)))


def links(marked: DataFrame, docs: DataFrame, least: float, crowded: int) -> DataFrame:
    """(src, dst) nodes: a graph with the components of all verified candidates. marked: (row, node, fp); docs: (row, text)."""
    n = parts(marked.sparkSession)
    nodes = cut(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.min("row").alias("row")))
    clustered = cut(clusters(nodes, crowded))
    dealt = dealt_in_blocks(clustered, crowded)
    rows = clustered.select(F.col("row").alias("node")).distinct()
    shared = marked.sparkSession.sparkContext.broadcast(bit_table(rows).view(np.uint8))

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for f in frames:
            out: dict[int, tuple[int, list[int]]] = {}
            for row, text in zip(f["row"].tolist(), f["text"], strict=True):
                b = spark_xxhash64(row) % (1 << TABLE_BITS)
                if row not in out and bits[b >> 3] >> (b & 7) & 1:
                    out[row] = shingles(text).view(np.int64)
            yield pd.DataFrame({"row": np.array(list(out), np.int64), "shingles": pd.Series(list(out.values()), dtype=object)})

    sets = docs.mapInPandas(found, "row long, shingles array<long>").join(rows.withColumnRenamed("node", "row"), "row", "left_semi").dropDuplicates(["row"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in grouped(frames, ["key"]):
            edges = []
            for _, g in f.groupby("key", sort=False):
                if len(g) > 1:
                    fps = np.stack(g["fp"].to_numpy()).astype(np.int64).view(np.uint64)
                    edges += forest(g["node"].to_numpy(), [np.asarray(s, np.int64).view(np.uint64) for s in g["shingles"]], fps, g["side"].to_numpy(), least)
            yield pd.DataFrame(sorted(set(edges)), columns=["src", "dst"], dtype="int64")

    return dealt.join(sets, "row").select("key", "node", "fp", "side", "shingles").repartition(n, "key").sortWithinPartitions("key").mapInPandas(run, "src long, dst long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, crowded: int = 1024) -> DataFrame:
    """docs with one row of each component: the smallest by (id, nulls last; set; id and text by hash)."""
    row = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    src = docs.withColumn("_row", row).withColumn("_id", F.coalesce(F.col(id_col), F.lit(0)))
    texts = src.select(F.col("_row").alias("row"), F.col(text_col).alias("text"))

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingles(t) for t in f["text"]]
            yield pd.DataFrame({"row": f["row"], "node": np.array([node_of(s) for s in sets], np.int64), "fp": pd.Series([fingerprint(s) for s in sets], dtype=object), "no_id": f["no_id"], "id": f["id"]})

    read = src.select(F.col("_row").alias("row"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"), F.col("_id").alias("id"))
    marked = cut(read.mapInPandas(mark, "row long, node long, fp array<long>, no_id boolean, id long"))
    roots = components(links(marked, texts, least, crowded))
    # copies are folded before nodes meet their roots
    best = marked.groupBy("node").agg(F.min(F.struct("no_id", "id", "node", "row")).alias("p"))
    best = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("p").alias("p"))
    kept = best.select(F.col("p.row").alias("_row"), F.col("p.id").alias("_id"))
    return src.join(kept, ["_row", "_id"], "left_semi").dropDuplicates(["_row", "_id"]).select(*docs.columns)
