"""Gradient boosted trees for three classes, in all walk-forward folds at once, by sums over (fold, class, node, feature, bin).

Rows are binned by cut points from their fold's training rows, and packed into chunks of bounded size, many for a large fold. One
job a level does all folds: each chunk sums gradients, curvatures and counts of its rows into histograms, a fold's histograms are added,
and the best cut of each node is appended to the fold's model, a row of a few numbers. Models are cut into the shared folder level
by level; nothing but whether folds go on comes to the driver. A fold of a single chunk has nothing to exchange, and takes the same two steps in its
task until it stops.

Gradients, curvatures and losses are summed as whole numbers (2^24, 2^24 and 2^40 to one), so that results don't depend on the order
of the sums or on tasks that ran twice. Of equal gains the first feature and lowest cut counts.

Trees grow by levels to a depth (a leaf that can't be cut stays), start from the log class shares of training rows, and stop when a fold's
validation loss hasn't improved for `patience` rounds; the round of least loss counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.nulls import safe_div
from tidebars.operators.gate import FOLD, known
from tidebars.operators.labels import prior_entropy
from tidebars.sources.store import cut

C = F.col
CLASSES = 3
UNIT, LOSS_UNIT = float(1 << 24), float(1 << 40)


@dataclass(frozen=True)
class Plan:
    rate: float = 0.05
    rounds: int = 200
    patience: int = 20
    depth: int = 3
    bins: int = 64
    least_rows: int = 20
    least_curve: float = 1e-3
    chunk: int = 1 << 16
    renew: int = 25
    """Rounds after which rows' scores are written anew, so that models of many rounds aren't replayed at each level."""


def cut_points(rows: DataFrame, features: list[str], bins: int) -> DataFrame:
    """symbol, fold, and for each feature its cut points: values at even ranks of training rows, each once, in order."""
    long = rows.where("part = 'train'").select(*FOLD, F.posexplode(F.array(*[C(f).cast("double") for f in features])).alias("f", "x"))
    w = Window.partitionBy(*FOLD, "f")
    long = long.withColumns({"_r": F.row_number().over(w.orderBy("x")), "_n": F.count("*").over(w)})
    even = F.floor(C("_r") * bins / C("_n")) > F.floor((C("_r") - 1) * bins / C("_n"))
    last = long.where(even & (C("_r") < C("_n"))).groupBy(*FOLD, "f").agg(F.array_sort(F.collect_set("x")).alias("cuts"))  # at most bins values
    none = F.array().cast("array<double>")
    return last.groupBy(*FOLD).agg(*[F.coalesce(F.max(F.when(C("f") == i, C("cuts"))), none).alias(f"_c{i}") for i in range(len(features))])


CHUNK = "n int, train binary, label binary, bins binary, score binary"


def packed(rows: DataFrame, features: list[str], label: str, plan: Plan) -> DataFrame:
    """Chunks of a fold's rows: bins (bytes), labels, whether they train, scores; and each fold's class counts."""
    counts = rows.groupBy(*FOLD).agg(
        F.array(*[F.count_if((C("part") == "train") & (C(label) == k)) for k in range(CLASSES)]).alias("shares"), F.count_if(C("part") == "val").alias("n_val"), F.ceil(F.count("*") / plan.chunk).cast("int").alias("_chunks")
    )
    counts = counts.where((C("n_val") > 0) & (F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x) > 0))
    made = rows.join(counts, FOLD).join(cut_points(rows, features, plan.bins), FOLD)
    below = lambda f: lambda edge: edge < C(f)
    binned = [F.size(F.filter(f"_c{i}", below(f))).cast("int").alias(f"_b{i}") for i, f in enumerate(features)]
    made = made.select(*FOLD, F.pmod(F.xxhash64("ts"), C("_chunks")).cast("int").alias("chunk"), (C("part") == "train").alias("train"), C(label).cast("int").alias("label"), "shares", "n_val", *binned)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        share = np.array(f["shares"].iloc[0], np.float64)
        start = np.log(np.maximum(share / share.sum(), 1e-15))
        bins = np.ascontiguousarray(f[[f"_b{i}" for i in range(len(features))]].to_numpy(np.uint8))
        out = (len(f), f["train"].to_numpy(np.uint8).tobytes(), f["label"].to_numpy(np.uint8).tobytes(), bins.tobytes(), np.tile(start, (len(f), 1)).tobytes())
        return pd.DataFrame([(f["symbol"].iloc[0], f["fold"].iloc[0], f["n_val"].iloc[0], *out)], columns=["symbol", "fold", "n_val", *[c.split()[0] for c in CHUNK.split(", ")]])

    fold = dict(rows.dtypes)["fold"]
    return made.groupBy(*FOLD, "chunk").applyInPandas(pack, f"symbol string, fold {fold}, n_val long, {CHUNK}")


def walked(bins: np.ndarray, tree: np.ndarray, levels: int) -> np.ndarray:
    """The node (within its level) that each row has come to; tree: (feature, cut) of nodes in heap order, feature -1 leads left."""
    node = np.zeros(len(bins), np.int64)
    for level in range(levels):
        f, edge = tree[(1 << level) - 1 + node].T
        right = (f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > edge)
        node = 2 * node + right
    return node


def scored(score: np.ndarray, bins: np.ndarray, trees: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """score with what trees (round, class, node, 2) and their leaves' values (round, class, leaf) add."""
    out = score.copy()
    for r in range(len(trees)):
        for k in range(CLASSES):
            out[:, k] += values[r, k][walked(bins, trees[r, k], depth)]
    return out


def chances(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


MODEL = "fold_done boolean, round int, splits array<int>, leaves array<double>, gains array<double>, losses array<long>, current array<int>"
MODEL_COLUMNS = [c.split()[0] for c in MODEL.split(", ")]


class Booster:
    """The two steps of growing: histograms of a chunk, and the cuts that a fold's summed histograms call for. A model is a dict of
    MODEL_COLUMNS."""

    def __init__(self, features: list[str], plan: Plan):
        self.plan, self.nodes, self.width = plan, (1 << plan.depth) - 1, len(features)

    def start(self) -> dict:
        return {"fold_done": False, "round": 0, "splits": [], "leaves": [], "gains": [], "losses": [], "current": [-1] * (CLASSES * self.nodes * 2)}

    def trees(self, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole trees, their leaves' values, and the tree in progress."""
        splits = np.array(m["splits"], np.int64).reshape(-1, CLASSES, self.nodes, 2)
        leaves = np.array(m["leaves"], np.float64).reshape(-1, CLASSES, self.nodes + 1)
        return splits, leaves, np.array(m["current"], np.int64).reshape(CLASSES, self.nodes, 2)

    def data(self, row) -> tuple[np.ndarray, ...]:
        train, label = np.frombuffer(row.train, np.uint8) == 1, np.frombuffer(row.label, np.uint8)
        return train, label, np.frombuffer(row.bins, np.uint8).reshape(row.n, self.width), np.frombuffer(row.score, np.float64).reshape(row.n, CLASSES)

    def sums(self, train: np.ndarray, label: np.ndarray, bins: np.ndarray, score: np.ndarray, current: np.ndarray, level: int) -> tuple[np.ndarray, int]:
        """(gradient, curvature, count) by class, node, feature and bin over training rows; the loss of validation rows."""
        nodes, width, wide = 1 << level, self.width, self.plan.bins
        p, loss = chances(score), 0
        if level == 0:
            loss = int(np.rint(-np.log(np.clip(p[~train, label[~train]], 1e-15, 1 - 1e-15)) * LOSS_UNIT).astype(np.int64).sum())
        p, bins, label = p[train], bins[train], label[train]
        total = np.zeros((3, CLASSES, nodes, width, wide), np.int64)
        column = bins + np.arange(width, dtype=np.int64) * wide
        for k in range(CLASSES):
            key = (walked(bins, current[k], level)[:, None] * (width * wide) + column).ravel()
            g = np.rint((p[:, k] - (label == k)) * UNIT)
            h = np.rint(CLASSES / (CLASSES - 1) * p[:, k] * (1 - p[:, k]) * UNIT)
            for i, x in enumerate((np.repeat(g, width), np.repeat(h, width), None)):
                total[i, k] = np.bincount(key, x, minlength=nodes * width * wide).reshape(nodes, width, wide)
        return total, loss

    def step(self, m: dict, total: np.ndarray, loss: int, level: int) -> dict:
        """The model with the cuts of one more level; after the last one the tree is whole."""
        plan = self.plan
        if level == 0:
            losses = [*m["losses"], loss]
            best = int(np.argmin(losses[1:])) + 1 if len(losses) > 1 else 0
            m = m | {"losses": losses}
            if m["round"] >= plan.rounds or m["round"] - best >= plan.patience:
                return m | {"fold_done": True}
            m["gains"] = [*m["gains"], *[0.0] * self.width]
        current = np.array(m["current"], np.int64).reshape(CLASSES, self.nodes, 2)
        gains = np.array(m["gains"], np.float64)
        parts = (total[0].astype(np.float64), total[1].astype(np.float64), total[2])
        left = [np.cumsum(x, axis=-1)[..., :-1] for x in parts]
        whole = [x[:, :, :1].sum(axis=-1, keepdims=True) for x in parts]  # of the first feature: all have the same rows
        right = [w - x for w, x in zip(whole, left, strict=True)]
        able = (left[2] >= plan.least_rows) & (right[2] >= plan.least_rows) & (left[1] >= plan.least_curve * UNIT) & (right[1] >= plan.least_curve * UNIT)
        ratio = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b > 0)
        gain = np.where(able, sum(ratio(g * g, h) for g, h in ((left[0], left[1]), (right[0], right[1]))) - ratio(whole[0] * whole[0], whole[1]), 0.0)
        flat = gain.reshape(CLASSES, 1 << level, -1)
        at = flat.argmax(axis=-1)
        pick = lambda x: np.take_along_axis(x.reshape(CLASSES, 1 << level, -1), at[..., None], -1)[..., 0]
        top = pick(flat)
        feature, edge = np.where(top > 0, at // (plan.bins - 1), -1), at % (plan.bins - 1)
        current[:, (1 << level) - 1 : (2 << level) - 1] = np.stack((feature, edge), -1)
        np.add.at(gains, len(gains) - self.width + feature[top > 0], top[top > 0] / UNIT)
        m = m | {"gains": gains.tolist(), "current": current.ravel().tolist()}
        if level < plan.depth - 1:
            return m
        # the leaves: either side of the last cuts, or the whole node where there was none
        both = [(np.where(top > 0, pick(x), w[..., 0, 0]), np.where(top > 0, pick(y), 0)) for x, y, w in zip(left[:2], right[:2], whole[:2], strict=True)]
        made = np.stack([-plan.rate * ratio(g, h) for g, h in zip(both[0], both[1], strict=True)], -1).reshape(CLASSES, -1)
        return m | {"round": m["round"] + 1, "splits": [*m["splits"], *current.ravel().tolist()], "leaves": [*m["leaves"], *made.ravel().tolist()], "current": self.start()["current"]}

    # --- over Spark

    def schema(self, df: DataFrame, more: str) -> str:
        kinds = dict(df.dtypes)
        return ", ".join(f"`{c}` {kinds[c]}" for c in FOLD) + ", n_val long, " + more

    def alone(self, chunks: DataFrame) -> DataFrame:
        """Models of folds of one chunk, whose sums need no exchange: their tasks take both steps by themselves."""

        def run(frames):
            for f in frames:
                out = []
                for row in f.itertuples():
                    m, (train, label, bins, score) = self.start(), self.data(row)
                    while True:
                        for level in range(self.plan.depth):
                            m = self.step(m, *self.sums(train, label, bins, score, np.array(m["current"], np.int64).reshape(CLASSES, self.nodes, 2), level), level)
                            if m["fold_done"]:
                                break
                        if m["fold_done"]:
                            break
                        splits, leaves, _ = self.trees(m | {"splits": m["splits"][-CLASSES * self.nodes * 2 :], "leaves": m["leaves"][-CLASSES * (self.nodes + 1) :]})
                        score = scored(score, bins, splits, leaves, self.plan.depth)
                    out.append({"symbol": row.symbol, "fold": row.fold, "n_val": row.n_val} | m)
                yield pd.DataFrame(out, columns=[*FOLD, "n_val", *MODEL_COLUMNS])

        return chunks.mapInPandas(run, self.schema(chunks, MODEL))

    def histograms(self, chunks: DataFrame, models: DataFrame, level: int, since: int) -> DataFrame:
        def run(frames):
            for f in frames:
                made = []
                for row in f.itertuples():
                    train, label, bins, score = self.data(row)
                    splits, leaves, current = self.trees({c: getattr(row, c) for c in MODEL_COLUMNS})
                    total, loss = self.sums(train, label, bins, scored(score, bins, splits[since:], leaves[since:], self.plan.depth), current, level)
                    made.append((total.tobytes(), loss))
                yield f[[*FOLD, "n_val"]].assign(hist=[h for h, _ in made], loss=[x for _, x in made])

        going = chunks.join(models.where(~C("fold_done")).drop("n_val"), FOLD)
        return going.mapInPandas(run, self.schema(chunks, "hist binary, loss long"))

    def grown(self, models: DataFrame, hists: DataFrame, level: int) -> DataFrame:
        size = (3, CLASSES, 1 << level, self.width, self.plan.bins)

        def step(m: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
            if m["fold_done"].iloc[0] or not len(h):
                return m
            total = np.zeros(size, np.int64)
            for x in h["hist"]:
                total += np.frombuffer(x, np.int64).reshape(size)
            old = {c: m[c].iloc[0] for c in MODEL_COLUMNS}
            new = self.step(old | {"losses": list(old["losses"]), "gains": list(old["gains"])}, total, int(h["loss"].sum()), level)
            return pd.DataFrame([{c: m[c].iloc[0] for c in (*FOLD, "n_val")} | new])

        return models.groupBy(*FOLD).cogroup(hists.groupBy(*FOLD)).applyInPandas(lambda a, b: step(a, b), self.schema(models, MODEL))

    def renewed(self, chunks: DataFrame, models: DataFrame, since: int) -> DataFrame:
        """chunks with the scores of whole trees written into them."""
        names = chunks.columns

        def run(frames):
            for f in frames:
                made = []
                for row in f.itertuples():
                    _, _, bins, score = self.data(row)
                    splits, leaves, _ = self.trees({c: getattr(row, c) for c in MODEL_COLUMNS})
                    made.append(scored(score, bins, splits[since:], leaves[since:], self.plan.depth).tobytes())
                yield f[names].assign(score=made)

        return chunks.join(models.where(~C("fold_done")).drop("n_val"), FOLD).mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes))

    def together(self, chunks: DataFrame) -> DataFrame:
        """Models of folds of many chunks, a job a level for all of them."""
        empty = lambda t: F.array().cast(f"array<{t}>")
        models = chunks.groupBy(*FOLD).agg(F.max("n_val").alias("n_val")).select(
            *FOLD, "n_val", F.lit(False).alias("fold_done"), F.lit(0).alias("round"), empty("int").alias("splits"), empty("double").alias("leaves"), empty("double").alias("gains"), empty("long").alias("losses"),
            F.array(*[F.lit(x) for x in self.start()["current"]]).alias("current"),
        )
        models, since = cut(models), 0
        for r in range(self.plan.rounds + 1):
            for level in range(self.plan.depth):
                models = cut(self.grown(models, self.histograms(chunks, models, level, since), level))
                if level == 0 and models.where(~C("fold_done")).isEmpty():
                    return models
            if (r + 1) % self.plan.renew == 0:
                chunks, since = cut(self.renewed(chunks, models, since)), r + 1
        return models


def boosted(rows: DataFrame, features: list[str], label: str = "label", plan: Plan = Plan()) -> DataFrame:
    """A row a symbol and fold: n_val, round (trees grown), losses of the validation rows by round (whole numbers, LOSS_UNIT to one, summed),
    best (the round that counts), gains (by round and feature), splits and leaves. Folds without training or validation rows have none."""
    booster = Booster(features, plan)
    chunks = cut(packed(cut(known(rows, features, label)), features, label, plan))
    of = F.count("*").over(Window.partitionBy(*FOLD))
    chunks = chunks.withColumn("_of", of)
    many = cut(chunks.where("_of > 1").drop("_of"))
    models = cut(booster.alone(chunks.where("_of = 1").drop("_of")))
    if not many.isEmpty():
        models = models.unionByName(booster.together(many))
    later = F.slice("losses", 2, F.size("losses"))
    return models.withColumn("best", F.array_position(later, F.array_min(later)).cast("int"))


def boosted_gate(rows: DataFrame, features: list[str], label: str = "label", plan: Plan = Plan()) -> DataFrame:
    """Per fold: the trees' log loss on validation rows at their best round, that of validation's own class shares, and their ratio."""
    made = boosted(rows, features, label, plan)
    return judged(made, known(rows, features, label), label)


def judged(made: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    loss = F.element_at("losses", C("best") + 1) / LOSS_UNIT / C("n_val")
    prior = prior_entropy(rows.where("part = 'val'"), FOLD, label).drop("n")
    return made.select(*FOLD, C("best").alias("rounds"), loss.alias("log_loss"), "n_val").join(prior, FOLD).withColumn("ratio", safe_div(C("log_loss"), C("prior")))


def gain(made: DataFrame, features: list[str], top: int = 20) -> DataFrame:
    """The `top` features of each symbol by gain: what the cuts of the rounds up to the best one took off the loss, over all folds."""
    held = made.select("symbol", F.posexplode(F.slice("gains", 1, C("best") * len(features))).alias("i", "g"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), (C("i") % len(features) + 1).cast("int"))
    sums = held.groupBy("symbol", name.alias("feature")).agg(F.sum("g").alias("gain"))
    order = Window.partitionBy("symbol").orderBy(C("gain").desc(), "feature")
    return sums.withColumn("place", F.row_number().over(order)).where(C("place") <= top)
