"""Hard negatives of embeddings by a two-dimensional block matrix multiply (SUMMA-style).

Rows are dealt into blocks by a hash of their label and, within it, of their id, as many as the count of the label's group asks for, so
that a hot label has more blocks and not larger ones. A block is cut into chunks of dimensions: shards (block, chunk), packed as
whole numbers. The grid's cells are (anchor panel, row panel, chunk): each anchor shard goes to all cells of its panel's row of the
grid, each row shard to all of its panel's column, and a cell multiplies what meets in it. Its partial int64 score tiles (block by
block) are shuffled by tile and added; a tile's top k leave it, and the best over all tiles are kept for each anchor.

That happens twice over different tiles: anchors against blocks that may hold their label give the positives; then anchors, with
their positives' scores as windows, against blocks that may hold other labels give the negatives. Pairs of blocks of one same label
have no negatives and aren't multiplied again.

What comes to the driver: one count for each of GROUPS groups. Tiles and panels have bounded sizes whatever the table is. Partial tiles travel in
the narrowest whole numbers that hold them.

Rows with a null id, label or vector, or with a null, NaN or infinite component take no part. Of rows with the same id the one with
the least (label, vector) counts, once. Vectors of different lengths meet as if the shorter had zeros. Components must be within 2^31 after scaling; a larger
one, or a score beyond 2^55 (so that hundredths of it fit int64), raises. An anchor without other rows of its label, or without rows in a window, gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.common import cut

GROUPS = 64
LEAST = np.iinfo(np.int64).min
LIMIT = 1 << 55
C = F.col


@dataclass(frozen=True)
class Grid:
    """Rows of a block, blocks of a panel, dimensions of a chunk."""

    anchors: int = 256
    rows: int = 2048
    panel: int = 4
    chunk: int = 32


def scaled(x: Column, by: int = 256) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * by).cast("long"))


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part, once an id; v: whole numbers."""
    bad = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    some = rows.where(C(id_col).isNotNull() & C(label_col).isNotNull() & C(vector_col).isNotNull() & ~bad)
    made = some.select(C(id_col).cast("long").alias("id"), C(label_col).cast("long").alias("label"), scaled(C(vector_col)).alias("v"))
    large = F.exists("v", lambda v: F.abs(v) >= 1 << 31)
    made = made.withColumn("v", F.when(large, F.raise_error(F.lit("a component is beyond 2^31 after scaling")).cast("array<int>")).otherwise(C("v").cast("array<int>")))
    return made.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", C("x.label").alias("label"), C("x.v").alias("v"))


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """An int64 array's bytes in the narrowest type that holds it, and the type's width."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return np.ascontiguousarray(x).astype(f"<i{width}").tobytes(), width


def wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)


SHARD = "block int, chunk int, lo long, hi long, n int, dims int, ids binary, labels binary, data binary, width int"


def shards(rows: DataFrame, block: Column, grid: Grid) -> DataFrame:
    """One row a (block, chunk) of dimensions: ids (sorted), labels, and the packed matrix; lo, hi: least and largest label."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        size = max((len(v) for v in f["v"]), default=0)
        m = np.zeros((len(f), max(1, size)), np.int64)
        for r, v in enumerate(f["v"]):
            m[r, : len(v)] = v
        ids, labels = f["id"].to_numpy(np.int64), f["label"].to_numpy(np.int64)
        out = []
        for k, at in enumerate(range(0, m.shape[1], grid.chunk)):
            part = m[:, at : at + grid.chunk]
            data, width = narrow(part)
            out.append((int(f["block"].iloc[0]), k, int(labels.min()), int(labels.max()), len(f), part.shape[1], ids.tobytes(), labels.tobytes(), data, width))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SHARD.split(", ")])

    return rows.withColumn("block", block).groupBy("block").applyInPandas(pack, SHARD)


def block_of(counts: dict[int, int], size: int) -> tuple[Column, int]:
    """A row's block, and how many there are: its label's group has as many as its count asks for."""
    first, each, at = [], [], 0
    for g in range(GROUPS):
        n = -(-counts.get(g, 0) // size)
        first.append(at)
        each.append(max(1, n))
        at += n
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    pick = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), group + 1)
    return (pick(first) + F.pmod(F.xxhash64("id", F.lit(7)), pick(each))).cast("int"), max(1, at)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: in doubles where every sum fits in 53 bits, else in int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound >= 2.0**62:  # its sums may leave int64
        raise OverflowError("a partial score is beyond int64")
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


PARTIAL = "i int, j int, data binary, width int, ids_a binary, labels_a binary, window binary, ids_b binary, labels_b binary"


def partial_tiles(anchors: DataFrame, rows: DataFrame, n_anchor: int, n_row: int, grid: Grid, wanted: str) -> DataFrame:
    """Partial score tiles (i, j) of every chunk. wanted: "same" for pairs of blocks that may share a label, "other" for those that may
    not. The shard of the first chunk carries ids, labels and windows."""
    panels_a, panels_b = -(-n_anchor // grid.panel), -(-n_row // grid.panel)
    spread = lambda df, own, other, n: df.withColumns({own: F.floor(C("block") / grid.panel).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    left, right = spread(anchors, "p", "q", panels_b), spread(rows, "q", "p", panels_a)

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        shards_b = [(y, wide(y.data, y.width).reshape(y.n, y.dims)) for y in b.itertuples()]
        for x in a.itertuples():
            m = wide(x.data, x.width).reshape(x.n, x.dims)
            for y, other in shards_b:
                apart, pure = x.hi < y.lo or y.hi < x.lo, x.lo == x.hi == y.lo == y.hi
                if apart if wanted == "same" else pure:
                    continue
                d = min(x.dims, y.dims)
                data, width = narrow(product(m[:, :d], other[:, :d]))
                meta = (x.ids, x.labels, x.window, y.ids, y.labels) if x.chunk == 0 else (None,) * 5
                out.append((x.block, y.block, data, width, *meta))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])

    keys = ("p", "q", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: multiply(a, b), PARTIAL)


def added(f: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """A whole tile: the sum of its partial tiles, and ids, labels and windows of its sides."""
    meta = next(r for r in f.itertuples() if r.ids_a is not None)
    ids_a, labels_a, ids_b, labels_b = (np.frombuffer(x, np.int64) for x in (meta.ids_a, meta.labels_a, meta.ids_b, meta.labels_b))
    total = np.zeros((len(ids_a), len(ids_b)), np.int64)
    top = 0
    for r in f.itertuples():
        part = wide(r.data, r.width).reshape(total.shape)
        top += int(np.abs(part).max(initial=0))
        if top >= LIMIT:
            raise OverflowError("a score is beyond 2^55")
        total += part
    return total, ids_a, labels_a, ids_b, labels_b, np.frombuffer(meta.window or b"", np.int64)


def best(score: np.ndarray, k: int) -> list[np.ndarray]:
    """The columns of each row's k highest scores (of equal ones the first), one array a place; LEAST is no score. score is changed."""
    every, out = np.arange(len(score)), []
    for _ in range(min(k, score.shape[1])):
        at = score.argmax(axis=1)
        out.append(np.where(score[every, at] > LEAST, at, -1))
        score[every, at] = LEAST
    return out


def positives(tiles: DataFrame, k: int) -> DataFrame:
    """(anchor_id, place, id, score): each anchor's first k other rows of its label."""

    def top(f: pd.DataFrame) -> pd.DataFrame:
        score, ids_a, labels_a, ids_b, labels_b, _ = added(f)
        score = np.where((labels_a[:, None] == labels_b) & (ids_a[:, None] != ids_b), score, LEAST)
        held = score.copy()
        rows = []
        for at in best(score, k):
            r = np.flatnonzero(at >= 0)
            rows.append(np.column_stack((ids_a[r], ids_b[at[r]], held[r, at[r]])))
        return pd.DataFrame(np.concatenate([np.zeros((0, 3), np.int64), *rows]), columns=["anchor_id", "id", "score"])

    found = tiles.groupBy("i", "j").applyInPandas(top, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(C("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(C("place") <= k)


def negatives(tiles: DataFrame, k: int, low: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each window the first k rows of another label
    whose score is between low hundredths of the positive's and the positive's."""

    def top(f: pd.DataFrame) -> pd.DataFrame:
        score, ids_a, labels_a, ids_b, labels_b, window = added(f)
        window = window.reshape(-1, 3)  # place of the anchor, id and score of the positive
        hi, lo = np.full(len(ids_a), LEAST), np.full(len(ids_a), np.iinfo(np.int64).max)
        np.maximum.at(hi, window[:, 0], window[:, 2])
        np.minimum.at(lo, window[:, 0], -(-low * window[:, 2] // 100))
        r, c = np.nonzero((score <= hi[:, None]) & (score >= lo[:, None]) & (labels_a[:, None] != labels_b))
        s = score[r, c]
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        begin = np.searchsorted(r, np.arange(len(ids_a) + 1))
        rows = []
        for a, positive, ps in window.tolist():
            x, y = begin[a], begin[a + 1]
            falling = -s[x:y]
            first = x + np.searchsorted(falling, -ps)
            last = x + np.searchsorted(falling, -(-(-low * ps // 100)), side="right")
            at = np.arange(first, max(first, min(last, first + k)))
            rows.append(np.column_stack((np.full(len(at), ids_a[a]), np.full(len(at), positive), ids_b[c[at]], np.full(len(at), ps), s[at])))
        return pd.DataFrame(np.concatenate([np.zeros((0, 5), np.int64), *rows]), columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = tiles.groupBy("i", "j").applyInPandas(top, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(C("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(C("rank") <= k)


def with_windows(shards_: DataFrame, found: DataFrame, block: Column, labels: DataFrame) -> DataFrame:
    """Anchor shards with the column window: of each anchor's positives the anchor's place, the positive's id and score."""
    per = found.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("ps"))  # at most k an anchor
    held = labels.join(per, labels["id"] == per["anchor_id"]).select(block.alias("block"), "anchor_id", "ps").groupBy("block").agg(F.collect_list(F.struct("anchor_id", "ps")).alias("of"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            packed = []
            for ids, of in zip(f["ids"], f["of"], strict=True):
                at = {x: i for i, x in enumerate(np.frombuffer(ids, np.int64).tolist())}
                flat = [(at[a["anchor_id"]], p["id"], p["score"]) for a in ([] if of is None else of) for p in a["ps"]]
                packed.append(np.array(flat, np.int64).reshape(-1, 3).tobytes())
            yield f.drop(columns="of").assign(window=packed)

    return shards_.join(held, "block", "left").mapInPandas(place, SHARD + ", window binary")


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", k: int = 5, low: int = 80, grid: Grid = Grid()) -> DataFrame:
    """Each anchor's positives with their first k hard negatives. is_anchor: over the columns id and label; label: what replaces the label, likewise."""
    made = usable(rows, id_col, label_col, vector_col)
    made = cut(made if label is None else made.withColumn("label", label))
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    counts = made.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).collect()  # GROUPS rows at most
    block_b, n_b = block_of({r.g: r.n for r in counts}, grid.rows)
    block_a, n_a = block_of({r.g: r.a for r in counts}, grid.anchors)
    chosen = made.where(is_anchor)
    right = cut(shards(made, block_b, grid))
    left = cut(shards(chosen, block_a, grid))
    none = left.withColumn("window", F.lit(None).cast("binary"))
    found = cut(positives(partial_tiles(none, right, n_a, n_b, grid, "same"), k))
    aimed = with_windows(left, found, block_a, chosen.select("id", "label"))
    out = negatives(partial_tiles(aimed, right, n_a, n_b, grid, "other"), k, low)
    return out.select("anchor_id", "positive_id", C("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
