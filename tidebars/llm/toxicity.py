"""Toxicity scores from two class-conditional Kneser-Ney language models, of words and of letters.

Each class has its own discounted counts of words (in how many documents a word stands), and what the discounts free is
shared evenly by all known words: a word of one or two documents says little in either class, and evidence grows with the log
of its count. Unknown words are spelled letter by letter (order `ORDER`, with marks at both ends): what discounts free there goes to the
next shorter context, down to continuation counts that both classes share.

A document's score is a logistic of three differences of the classes' log-likelihoods: by letters, on average over the other words (so long
texts aren't more toxic than short ones); of its best word; and, by its logarithm, of its three best different words
beyond `LEAST`, since a telling word in a long text vanishes in an average, and chance words of a long text add up in a sum. The logistic is fitted on labelled rows that the counts haven't seen.

Labels are learned from a bounded sample: at most `per_class` rows of each class (the least hashes of the id), with two thirds
for counts and one for the logistic. Everything else, texts of any length included, is scored whole in one narrow pass; the
model is broadcast, and its size is bounded by the sample.

Nulls and texts without letters have the score of the class shares among labelled rows. Labels other than 0 and 1 are
ignored; of several labels for a document the largest counts. Rows with equal ids are scored each by itself. Without labels
of both classes every score is the share of label 1 (0 if there are none). A very long text is scored whole, in memory for itself
and its words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import crc_mod

ORDER = 5
PER_CLASS = 1500
WORDS = regex.compile(r"\p{L}+")
CACHE = 60_000
#: Words whose classes differ by less (in nats) aren't telling.
LEAST = 3.0


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Model:
    """Log-ratio tables of the two classes: ratio of each known n-gram, back-off difference of each known context."""

    def __init__(self, counts: dict[str, tuple[int, int]], order: int = ORDER):
        """counts: n-grams of full order (shorter at a word's start), as often as they occur in class 0 and 1."""
        self.order = order
        self.ratio: dict[str, float] = {}
        self.back: dict[str, float] = {}
        self.cache: dict[str, float] = {}
        levels: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0, 0.0]) for _ in range(order + 1)]
        for gram, (a, b) in counts.items():
            got = levels[len(gram)][gram]
            got[0] += a
            got[1] += b
        # shorter ones: how many different letters stand before them, in each class; at a word's start they have their counts already
        for n in range(order, 1, -1):
            for gram, (a, b) in levels[n].items():
                got = levels[n - 1][gram[1:]]
                got[0] += a > 0
                got[1] += b > 0
        shared = {g: a + b for g, (a, b) in levels[1].items()}
        total = sum(shared.values()) + 1.0
        prob = {g: (c / total, c / total) for g, c in shared.items()}
        self.unseen = 0.5 / total
        for n in range(2, order + 1):
            sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
            ones, twos = [0, 0], [0, 0]
            for gram, pair in levels[n].items():
                s = sums[gram[:-1]]
                for c in (0, 1):
                    s[c] += pair[c]
                    s[2 + c] += pair[c] > 0
                    ones[c] += pair[c] == 1
                    twos[c] += pair[c] == 2
            cut = [max(0.1, ones[c] / (ones[c] + 2 * twos[c])) if ones[c] else 0.5 for c in (0, 1)]
            freed = {h: tuple((cut[c] * s[2 + c] / s[c]) if s[c] else 1.0 for c in (0, 1)) for h, s in sums.items()}
            now = {}
            for gram, pair in levels[n].items():
                h = gram[:-1]
                low = prob.get(gram[1:], (self.unseen, self.unseen))
                s = sums[h]
                now[gram] = tuple((max(pair[c] - cut[c], 0.0) / s[c] if s[c] else 0.0) + freed[h][c] * low[c] for c in (0, 1))
            for h, f in freed.items():
                self.back[h] = math.log(f[1] / f[0])
            for gram, (p, q) in now.items():
                self.ratio[gram] = math.log(q / p)
            prob = now

    def word(self, word: str) -> float:
        """Log-likelihood in class 1 less that in class 0."""
        got = self.cache.get(word)
        if got is None:
            got, ratio, back, order = 0.0, self.ratio, self.back, self.order
            s = f"^{word}$"
            for i in range(1, len(s)):
                lo = max(0, i - order + 1)
                while lo < i:
                    r = ratio.get(s[lo : i + 1])
                    if r is not None:
                        got += r
                        break
                    got += back.get(s[lo:i], 0.0)
                    lo += 1
            if len(word) <= 40:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = got
        return got


def telling(counts: dict[str, tuple[int, int]], least: float = LEAST) -> dict[str, float]:
    """Words by the difference of their log-likelihoods in class 1 and 0, if it is beyond least. counts: documents of either class
    that have the word."""
    total = [sum(x[c] for x in counts.values()) for c in (0, 1)]
    if not all(total):
        return {}
    ones, twos, kinds = ([sum(test(x[c]) for x in counts.values()) for c in (0, 1)] for test in (lambda n: n == 1, lambda n: n == 2, lambda n: n > 0))
    cut = [ones[c] / (ones[c] + 2 * twos[c]) if ones[c] else 0.5 for c in (0, 1)]
    even = [max(cut[c], 1e-6) * kinds[c] / total[c] / (len(counts) + 1) for c in (0, 1)]  # what a known word has of the freed mass
    p = lambda n, c: max(n - cut[c], 0.0) / total[c] + even[c]
    ratio = {w: math.log(p(x[1], 1) / p(x[0], 0)) for w, x in counts.items()}
    return {w: r for w, r in ratio.items() if r > least}


def grams_of(text: str | None, order: int) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for w in words_of(text):
        s = f"^{w}$"
        for i in range(1, len(s)):
            out[s[max(0, i - order + 1) : i + 1]] += 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of the columns of x and the intercept, by Newton's method with a small ridge."""
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    a = np.column_stack(((x - middle) / scale, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (y - p)) - 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * middle / scale).sum())


class Scorer:
    """The two models with their logistic; weights None: no labels of both classes, and share is the score of all."""

    def __init__(self, model: Model | None, words: dict[str, float], weights: list[float] | None, share: float):
        self.model, self.words, self.weights, self.share = model, words, weights, share

    def differences(self, words: list[str]) -> list[float]:
        found = sorted((self.words[w] for w in set(words) if w in self.words), reverse=True)
        rest = [w for w in words if w not in self.words]  # what is told by its own count isn't spelled
        return [sum(map(self.model.word, rest)) / max(1, len(rest)), max(found, default=LEAST), math.log1p(sum(r - LEAST for r in found[:3]))]

    def score(self, text: str | None) -> float:
        if self.weights is None or not (words := words_of(text)):
            return self.share
        x = sum(a * b for a, b in zip(self.weights, [*self.differences(words), 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, held_out_mod: int) -> tuple[DataFrame, float]:
    """(text, toxic, counts) of the bounded sample, and the share of label 1 among the labels that may be learned from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", held_out_mod) != 0)
    shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for t in (0, 1):
        some = known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    fold = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / held_out_mod), F.lit(3)) != 0
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row an id: 2 * per_class at most
    return rows.select("text", F.col("toxic").cast("int").alias("toxic"), fold.alias("counts")), shares.get(1, 0) / max(1, sum(shares.values()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, order: int = ORDER, held_out_mod: int = 5) -> Scorer:
    """Never reads rows whose crc32(doc_id) mod held_out_mod is 0."""
    rows, share = sampled(docs, labels, per_class, held_out_mod)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            letters, words = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                for g, c in grams_of(text, order).items():
                    letters[g][toxic] += c
                for w in set(words_of(text)):
                    words[w][toxic] += 1
            yield pd.DataFrame([(is_word, g, a, b) for is_word, some in ((False, letters), (True, words)) for g, (a, b) in some.items()], columns=["is_word", "gram", "a", "b"])

    grams = rows.where("counts").select("text", "toxic").mapInPandas(count, "is_word boolean, gram string, a long, b long")
    counts = grams.groupBy("is_word", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()  # bounded by the sample
    if not (counts["a"].sum() and counts["b"].sum()):
        return Scorer(None, {}, None, share)
    counts = counts.sort_values("gram")
    held = lambda some: {g: (int(a), int(b)) for g, a, b in zip(some["gram"], some["a"], some["b"], strict=True)}
    scorer = Scorer(Model(held(counts[~counts["is_word"]]), order), telling(held(counts[counts["is_word"]])), None, share)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("array<double>")
    def differences(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.differences(words_of(t)))

    seen = rows.where("not counts").select(differences("text").alias("x"), "toxic").toPandas()
    shared.destroy()
    y = seen["toxic"].to_numpy(float)
    if not len(y) or not 0 < y.mean() < 1:
        return Scorer(None, {}, None, share)
    x = np.array(seen["x"].tolist(), float)
    at = np.lexsort((*x.T, y))  # the same order of sums in any run
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    scorer.weights = logistic(x[at], y[at], weight[at]).tolist()
    return scorer


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the score."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score).astype("float64")

    return docs.withColumn(out_col, run(F.col(text_col)))


def score(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    scorer = fit(docs, labels, held_out_mod=held_out_mod, **options)
    out = scored(docs.select("doc_id", "text"), scorer)
    held_out = F.coalesce(crc_mod("doc_id", held_out_mod) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
