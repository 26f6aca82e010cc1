"""Line deduplication: exact copies and near copies of lines, by a segment-partition edit join.

Two lines are linked if their edit distance (code points) is at most tau of the shorter one: one edit for each `chars_per_edit`
characters, at most `max_edits`. Each line of length l is cut into tau(l) + 1 even segments; with at most tau edits one of
them survives unchanged in a linked line, at a place that the lengths narrow down (multi-match-aware windows). So segments are
indexed under (length, segment number, content), and every line probes the substrings of its own that could match for lengths
l, l - 1, ... Lines that meet under a key are verified: letter histograms first (an edit changes at most two counts), then a
banded bit-parallel edit distance. A class is a connected component of links; its first line (least doc_id, then line
number) stays, and the others are removed.

Equal lines are one node from the start, so copies never meet in a group; hot lines are folded inside each task before any
shuffle. Keys that one line alone holds end where they meet; only lines that share a key send their text, found again with
a bit table of fixed size. A crowded key is verified in blocks of lines dealt to separate tasks. No links are dropped.

Blank lines are never removed or linked. Null texts have no lines. Null doc_ids order last. Rows are told apart by doc_id and
the hash of their text: a line is removed from its own row only, and of equal rows all keep the first line of a class. Lines are nodes by a 63-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import cut, parts
from tidebars.llm.components import components

MAX_EDITS, CHARS_PER_EDIT = 2, 10
#: Lines that are verified against each other at once; a key with more is dealt out in blocks.
BLOCK = 1024
#: Of the bit table that picks the lines whose text is needed (8 MB, whatever the input).
TABLE_BITS = 26
SEEN = 200_000


def node_of(line: str) -> int:
    """63 bits and a free lowest bit, as a signed long."""
    h = xxhash.xxh3_64_intdigest(line, 7) & ~1
    return h - (1 << 64) if h >> 63 else h


def tau(length: int, max_edits: int, chars_per_edit: int) -> int:
    return min(max_edits, length // chars_per_edit)


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """Start and size of t + 1 even segments."""
    size, more = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        n = size + (i > t - more)
        out.append((at, n))
        at += n
    return out


def windows(length: int, max_edits: int, chars_per_edit: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, size, own segment) of every substring that a line of this length indexes or probes."""
    out = []
    for other in range(length, max(0, length - max_edits) - 1, -1):
        t, d = tau(other, max_edits, chars_per_edit), length - other
        if t == 0 or d > t:
            continue
        for i, (p, n) in enumerate(segments(other, t)):
            lo, hi = max(p - i, p + d - (t - i), 0), min(p + i, p + d + (t - i), length - n)
            out += [(other * 8 + i, s, n, d == 0 and s == p) for s in range(lo, hi + 1)]
    return out


def distance_within(a: str, b: str, k: int) -> int | None:
    """Edit distance if at most k, by Myers' bit vectors over the 2k + 1 diagonals that can matter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return None
    if a == b:
        return 0
    if k == 0:
        return None
    head = max(0, min(len(commonprefix((a, b))), len(a) - k))
    a, b = a[head:], b[head:]
    tail = max(0, min(len(commonprefix((a[::-1], b[::-1]))), len(a) - k))
    if tail:
        a, b = a[:-tail], b[:-tail]
    m, n = len(a), len(b)
    if m < k:  # lines shorter than the band: plain rows
        row = list(range(m + 1))
        for j, c in enumerate(b, 1):
            new = [j]
            for i in range(m):
                new.append(min(row[i] + (a[i] != c), row[i + 1] + 1, new[i] + 1))
            row = new
        return row[m] if row[m] <= k else None
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << 2 * k + 1) - 1
    vp, vn = full ^ (1 << k) - 1, 0
    top, score, limit = 1 << 2 * k, k, k + n - m + k
    for j in range(1, n + 1):
        shift = j - k - 1
        x = places.get(b[j - 1], 0)
        x = (x >> shift if shift >= 0 else x << -shift) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j <= m - k:
            score += not d0 & top
        else:
            row = 1 << m - j + k
            score += bool(hp & row) - bool(hn & row)
        if score > limit:
            return None
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
    return score if score <= k else None


def histograms(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 64), np.int32)
    for i, s in enumerate(lines):
        out[i] = np.bincount(np.frombuffer(s.encode("utf-32-le"), np.uint32) & 63, minlength=64)
    return out


def linked(left: list[str], right: list[str] | None, max_edits: int, chars_per_edit: int) -> list[tuple[int, int]]:
    """Index pairs that are linked, of left x right (None: pairs within left)."""
    a = histograms(left)
    b = a if right is None else histograms(right)
    other = left if right is None else right
    out = []
    for i in range(len(left)):
        lo = i + 1 if right is None else 0
        if lo >= len(other):
            continue
        for j in np.flatnonzero(np.abs(b[lo:] - a[i]).sum(axis=1) <= 2 * max_edits) + lo:
            x, y = left[i], other[j]
            if x != y and distance_within(x, y, tau(min(len(x), len(y)), max_edits, chars_per_edit)) is not None:
                out.append((i, int(j)))
    return out


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, line_no, node): row is the hash of the whole text; node is null for a blank line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, rows, numbers, nodes = [], [], [], []
            for doc_id, row, text in zip(f["doc_id"], f["row"].tolist(), f["text"], strict=True):
                if text is None:
                    continue
                for i, line in enumerate(text.split("\n")):
                    ids.append(doc_id)
                    rows.append(row)
                    numbers.append(i)
                    nodes.append(node_of(line) if line.strip() else None)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "row": np.array(rows, np.int64), "line_no": np.array(numbers, np.int32), "node": pd.Series(nodes, dtype=object)})

    # ids travel as text: pandas would make a column of longs with nulls one of floats
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, row long, line_no int, node long")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def keys_of(docs: DataFrame, text_col: str, max_edits: int, chars_per_edit: int) -> DataFrame:
    """(key, node): lowest bit of node: 1 if the key is of one of its own segments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans: dict[int, list] = {}
        seen: set[int] = set()
        digest = xxhash.xxh3_64_intdigest
        for f in frames:
            keys, nodes = [], []
            for text in f["text"]:
                for line in text.split("\n") if text else ():
                    n = len(line)
                    if n < chars_per_edit or not line.strip() or (node := node_of(line)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    plan = plans.get(n)
                    if plan is None:
                        if len(plans) > 2_000:
                            plans.clear()
                        plan = plans[n] = windows(n, max_edits, chars_per_edit)
                    keys += [digest(line[s : s + size], seed) for seed, s, size, _ in plan]
                    nodes += [node | own for *_, own in plan]
            yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "node": np.array(nodes, np.int64)})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "key long, node long")


def grouped(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut so that rows of equal `by`, which come one after another, stay together."""
    held = None
    for f in frames:
        if not len(f):
            continue
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        last = np.ones(len(f), bool)
        for c in by:
            last &= (f[c] == f[c].iloc[-1]).to_numpy()
        at = int(len(f) - last[::-1].argmin()) if not last.all() else 0
        if at:
            yield f.iloc[:at]
        held = f.iloc[at:]
    if held is not None and len(held):
        yield held


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, low, high, block, node): the lines of each key that several share, an own segment among them; a crowded key's
    lines are dealt to blocks, and low and high are the two that meet."""
    n = parts(keys.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in grouped(frames, ["key"]):
            key, node = f["key"].to_numpy(), f["node"].to_numpy()
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[fresh], node[fresh]
            # a line may hold a key as its own and as a probe: own is enough
            if len(key) > 1:
                twice = np.zeros(len(key), bool)
                twice[:-1] = (key[1:] == key[:-1]) & ((node[1:] | 1) == (node[:-1] | 1))
                key, node = key[~twice], node[~twice]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            own = np.add.reduceat(node & 1, starts) if len(starts) else sizes
            good = np.repeat((sizes > 1) & (own > 0), sizes)
            if not good.any():
                continue
            size = np.repeat(sizes, sizes)[good]
            key, node = key[good], node[good]
            blocks = -(-size // BLOCK)
            # a crowded key: each line goes to every pair of blocks that holds its own
            mine = np.where(blocks > 1, (node >> 1).view(np.uint64) % blocks.astype(np.uint64), 0).astype(np.int64)
            again = np.repeat(np.arange(len(key)), blocks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            yield pd.DataFrame({"key": key[again], "low": np.minimum(mine[again], other).astype("int32"), "high": np.maximum(mine[again], other).astype("int32"), "block": mine[again].astype("int32"), "node": node[again]})

    return keys.repartition(n, "key").sortWithinPartitions("key").mapInPandas(run, "key long, low int, high int, block int, node long")


def bit_table(nodes: DataFrame) -> np.ndarray:
    """A table of 2^TABLE_BITS bits with a bit set for each node: fixed size, whatever the input."""
    words = nodes.select(F.pmod(F.xxhash64("node"), F.lit(1 << TABLE_BITS)).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    got = words.toPandas()
    out = np.zeros(1 << TABLE_BITS - 6, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def texts_of(docs: DataFrame, text_col: str, nodes: DataFrame, table: np.ndarray) -> DataFrame:
    """(node, line) of the lines in nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for f in frames:
            found: dict[int, str] = {}
            for text in f["text"]:
                for line in text.split("\n") if text else ():
                    node = node_of(line)
                    if node not in found and line.strip():
                        b = spark_xxhash64(node) % (1 << TABLE_BITS)
                        if bits[b >> 3] >> (b & 7) & 1:
                            found[node] = line
            yield pd.DataFrame({"node": np.array(list(found), np.int64), "line": pd.Series(list(found.values()), dtype=object)})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "node long, line string")
    return rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("line").alias("line"))


def spark_xxhash64(value: int) -> int:
    """xxhash64() of a long, as Spark gives it, unsigned."""
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), 42)


def links(docs: DataFrame, text_col: str = "text", max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(a, b): every linked pair of different lines, once, a < b."""
    n = parts(docs.sparkSession)
    held = cut(shared_keys(keys_of(docs, text_col, max_edits, chars_per_edit)))
    nodes = held.select(F.col("node").bitwiseAND(F.lit(-2)).alias("node")).distinct()
    texts = texts_of(docs, text_col, nodes, bit_table(nodes))
    rows = held.select("key", "low", "high", "block", F.col("node").bitwiseAND(F.lit(-2)).alias("node"), F.col("node").bitwiseAND(F.lit(1)).alias("own")).join(texts, "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in grouped(frames, ["key", "low", "high"]):
            out = set()
            for (_, low, high), g in f.groupby(["key", "low", "high"], sort=False):
                g = g.drop_duplicates("node")
                node, line, own = g["node"].to_numpy(), g["line"].to_numpy(object), g["own"].to_numpy() == 1
                if low == high:
                    sides = [(own, None), (own, ~own)]
                else:
                    first = g["block"].to_numpy() == low
                    sides = [(own & first, own & ~first), (own & first, ~own & ~first), (~own & first, own & ~first)]
                for x, y in sides:
                    left = np.flatnonzero(x)
                    right = left if y is None else np.flatnonzero(y)
                    if not len(left) or not len(right):
                        continue
                    for i, j in linked(list(line[left]), None if y is None else list(line[right]), max_edits, chars_per_edit):
                        p, q = int(node[left[i]]), int(node[right[j]])
                        out.add((min(p, q), max(p, q)))
            yield pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    dealt = rows.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, row, line_no, node, class_doc, class_line, n_links, removed) of every line; blank lines have no class."""
    lines = cut(lines_of(docs, id_col, text_col))
    pairs = cut(links(docs, text_col, max_edits, chars_per_edit))
    counts = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = components(pairs, "a", "b").join(counts, "node")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "line_no", "row")
    # first places per node, then per class: hot lines are folded before they meet
    first = lines.where("node is not null").groupBy("node").agg(F.min(place).alias("p"))
    first = first.join(roots, "node", "left").select("node", "p", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    head = first.groupBy("root").agg(F.min("p").alias("head"))
    per_node = first.join(head, "root").select("node", "head", "n_links")
    out = lines.join(per_node, "node", "left")
    removed = F.coalesce(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no")) & (F.col("row") == F.col("head.row"))), F.lit(False)) & F.col("node").isNotNull()
    return out.select("doc_id", "row", "line_no", "node", F.col("head.doc_id").alias("class_doc"), F.col("head.line_no").alias("class_line"), F.coalesce("n_links", F.lit(0)).alias("n_links"), removed.alias("removed"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per doc_id: n_lines, n_removed, n_links (of its lines to different lines), and removed and linked lines with their
    class, which is named by its first place."""
    found = classified(docs, id_col, text_col, **options)
    told = F.when(F.col("removed") | (F.col("n_links") > 0), F.struct("line_no", "class_doc", "class_line", "n_links", "removed"))
    per_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sum("n_links").alias("n_links"), F.sort_array(F.collect_list(told)).alias("lines"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    joined = ids.join(per_doc.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_lines", "n_removed", "n_links")}
    return joined.withColumns(zero | {"lines": F.coalesce("lines", F.array().cast(joined.schema["lines"].dataType))})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the removed lines cut out of the text; no document is dropped."""
    found = classified(docs, id_col, text_col, **options)
    gone = found.where("removed").groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.filter(F.transform(F.split(text_col, "\n", -1), lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull()), "\n")
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_d")) & (F.xxhash64(text_col) == F.col("_row")), "left")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
