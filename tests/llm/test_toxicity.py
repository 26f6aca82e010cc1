"""Toxicity: the word model against a plain one, odd tables, and held-out accuracy on a whole table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidebars.llm import toxicity
from tidebars.llm.common import table

SF = "/root/testdata/sf0.1"


def plain_ratio(word, texts, toxic):
    """By the definition: absolute discounts by counts of ones and twos, what they free shared evenly by all known words."""
    def p(c):
        docs = [set(toxicity.words_of(t)) for t, y in zip(texts, toxic, strict=True) if y == c]
        n = {}
        for d in docs:
            for w in d:
                n[w] = n.get(w, 0) + 1
        ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        cut = ones / (ones + 2 * twos) if ones else 0.5
        known = {w for t in texts for w in toxicity.words_of(t)}
        return max(n.get(word, 0) - cut, 0) / sum(n.values()) + max(cut, 1e-6) * len(n) / sum(n.values()) / (len(known) + 1)

    return math.log(p(1) / p(0))


def test_words_by_the_definition():
    rng = random.Random(2)
    texts, toxic = [], []
    for i in range(80):
        y = i % 3 == 0
        texts.append(" ".join(rng.choice("abcdefghijklmn") * rng.randrange(1, 3) for _ in range(12)) + (" zzz" if y and rng.random() < 0.9 else ""))
        toxic.append(int(y))
    counts = {}
    for t, y in zip(texts, toxic, strict=True):
        for w in set(toxicity.words_of(t)):
            a = counts.setdefault(w, [0, 0])
            a[y] += 1
    got = toxicity.telling({w: tuple(c) for w, c in counts.items()}, least=-99.0)
    assert set(got) == set(counts) and max(got, key=got.get) == "zzz"
    for w in list(counts)[:10] + ["zzz"]:
        assert got[w] == pytest.approx(plain_ratio(w, texts, toxic))
    assert toxicity.telling({}) == {} and toxicity.telling({"a": (3, 0)}) == {}


def test_a_telling_word_counts_in_a_long_text(spark, docs_of):
    rng = random.Random(5)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, some(rng.randrange(20, 80)) + (" grumbly " if bad else " ") + some(10)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, some(20_000) + " grumbly"), (1001, some(20_000)), (1002, None), (1003, ""), (0, rows[0][1])]
    marked = docs_of(rows).withColumns({"toxic": F.lit(1), "_score": F.lit(2), "x": F.lit("y"), "gram": F.lit(1)})
    got = {r.doc_id: r for r in toxicity.score(marked, spark.createDataFrame(labels + [(7, 1, 5), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1003].score
    assert sum(got[i].predicted == y for i, _, y in labels) > 390


def test_an_empty_table(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs_of([(1, "x")]).limit(0), labels).count() == 0


def test_held_out_rows_of_a_whole_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.score(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("k")).collect()
    of = {r.toxic: (r.k, r.n) for r in got}
    assert of[1][0] >= 0.75 * of[1][1] and of[0][0] < 0.01 * of[0][1], of
    print(of)
