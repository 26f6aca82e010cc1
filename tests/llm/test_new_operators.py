"""Hard negatives, license scans and importance resampling against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import hard_negatives, importance, licenses

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", None, "One two, one TWO three", "é É ñandú x_y", " \n", "a" * 5000, "cc by" * 3, "😀 CC-BY cc by CC by", "All rights reserved. GNU General Public License, version 2"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


# --- hard negatives


def brute_negatives(rows, k=5):
    whole = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        old = (label, new[1])
        if i not in whole or old < whole[i][0]:
            whole[i] = (old, new)
    held = {i: new for i, (_, new) in whole.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in held:
        if a % 100:
            continue
        scores = sorted(((-dot(held[a][1], held[i][1]), i) for i in held if i != a))
        for ps, p in [(s, i) for s, i in scores if held[i][0] == held[a][0]][:k]:
            window = [(-s, i) for s, i in scores if held[i][0] != held[a][0] and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out |= {(a, p, r + 1, n, -ps, s) for r, (s, n) in enumerate(window)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id long, v string") if rows and len(rows[0]) == 5 else spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, shifted, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("grid", [hard_negatives.Grid(), hard_negatives.Grid(anchors=2, rows=17, panel=2, chunk=3)])
def test_hard_negatives_by_brute_force(spark, grid):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.choice([1, 1, 1, 2, 3, 9])), np.round(rng.normal(size=8), 1).astype(np.float32).tolist()) for i in range(0, 1200, 3)]  # rounded: many ties
    rows += [(5, None, [1.0] * 8), (None, 1, [1.0] * 8), (7, 1, None), (8, 1, [None] + [1.0] * 7), (10, 2, [float("nan")] * 8), (11, 2, [float("inf")] + [0.0] * 7), (400, 3, [0.5] * 8), (300, 1, [0.1] * 8)]
    rows += [rows[0], rows[1]]
    assert mined(spark, rows, grid=grid) == brute_negatives(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(100, 1, [1.0, 2.0])]) == set()
    clash = [(i, i % 3, [float(i % 5), 1.0], i + 1, "x") for i in range(0, 300, 10)]
    assert mined(spark, clash) == brute_negatives([r[:3] for r in clash])
    with pytest.raises(Exception, match="beyond"):
        mined(spark, [(100, 1, [1e9]), (101, 1, [1e9])])


def test_products_are_exact_beyond_doubles():
    a = np.array([[(1 << 28) + 1, 3]], np.int64)
    assert hard_negatives.product(a, a)[0, 0] == ((1 << 28) + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        hard_negatives.product(np.array([[1 << 31]]), np.array([[1 << 31]]))


# --- licenses


def brute_detections(text, signatures):
    """All places of the rules' patterns by Python's re, and those that stay by comparing all pairs."""
    padded = "".join(f" {w} " for w in words(text))
    found = []
    for i, r in enumerate(signatures):
        for m in re.finditer(r.pattern, padded):
            s = padded[: m.start()].count(" ") // 2
            found.append((s, s + m[0].count(" ") // 2, r.rank, i, r.label, r.base))
    inside = lambda d, o: o[0] <= d[0] and d[1] <= o[1] and o[2] <= d[2] and (o[:2] != d[:2] or o[2:4] < d[2:4])
    return found, [d for d in found if d[5] or not any(inside(d, o) for o in found)]


@pytest.mark.parametrize("chunk", [256, 2])
def test_licenses_by_brute_force(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    rng = random.Random(4)
    signatures = licenses.rules()
    some = ["Licensed under the Apache License, Version 2.0", "MIT License", "SPDX-License-Identifier: CC-BY-NC-4.0", "cc by", "GNU General Public License v3", "all rights reserved", "GNU Lesser General Public License, version 2.1", "the", "word", "license", "Creative Commons Attribution 4.0"]
    texts = TEXTS + [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["cc by " * 700, "x " * 3000 + "CC-BY"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by"), (3, "MIT license")]
    got = licenses.scan(docs_of(rows).withColumns({"spans": F.lit(1), "w": F.lit(2), "held": F.lit(3), "kept": F.lit(4)}), keep=("text",)).collect()
    assert len(got) == len(rows)
    for r in got:
        every, kept = brute_detections(r.text, signatures)
        base = [d for d in every if d[5]]
        assert (r.n_words, r.n_base) == (len(words(r.text)), len(base))
        assert (r.first_word, r.last_word) == ((min(d[0] for d in base), max(d[0] for d in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({d[4] for d in base})) and r.labels == ",".join(sorted({d[4] for d in kept}))
        assert sorted(r.spans.split(",") if r.spans else []) == sorted(f"{d[4]}:{d[0]}:{d[1]}" for d in kept)
        assert r.score == max([(1.0, 0.9, 0.6)[d[2]] for d in kept], default=0.0)


def test_every_license_rule_finds_its_own_words():
    """Each rule's phrase, written out, is matched by its pattern and has its keywords; hundreds of rules, none twice."""
    signatures = licenses.rules()
    assert len(signatures) > 300 and len(set(signatures)) == len(signatures)
    for r in signatures:
        assert r.keywords
        for full in (True, False):
            out = []
            for t in r.phrase.split():
                if t.startswith("<") or t.endswith("?") and not full:
                    continue
                t = t.removesuffix("?").split("|")[0]
                out.append({"licen[cs]e": "licence", "(?:licensed": "licensed", "unauthori[sz]ed": "unauthorized", "(?:lesser": "lesser", "v?[123]": "v2", "v?[23]": "v2", "[123]": "2", "(?:19": "1999"}.get(t, t))
            text = "".join(f" {w} " for w in out)
            if full or "?" in r.phrase:
                assert re.search(r.pattern, text), (r.phrase, text)
            assert set(r.keywords) <= {*out}


def test_licenses_of_an_empty_table(docs_of):
    assert licenses.scan(docs_of([(1, "x")]).limit(0)).count() == 0


# --- importance resampling


def brute_resampled(docs, target, n_low, n_high, buckets=10_000, percent=10, least=20):
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(n_low, n_high + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted([r for r in out if r[4] >= least], key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = Counter((r[0], r[3], k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    return Counter(r[:4] for r in out), ranks


@pytest.mark.parametrize(("low", "high", "block"), [(1, 1, 1 << 21), (1, 3, 64), (2, 5, 200), (1, 2, 1 << 21)])
def test_importance_by_brute_force(spark, docs_of, low, high, block):
    rng = random.Random(low * high)
    vocabulary = ["alpha", "Beta", "é", "x1", "gamma", "d"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(80)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs += [(None, "alpha beta " * 15), docs[0], docs[1]]
    target = ["alpha x1 d " * 5, None, "", "gamma"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs_of(docs).withColumns({"n_words": F.lit("a"), "_out": F.lit(1), "bucket": F.lit(2)}), table, importance.Grams(low, high), percent=25, block_bytes=block).collect()
    rows, ranks = brute_resampled(docs, target, low, high, percent=25)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == rows
    assert Counter((r.doc_id, r.score, r.rank) for r in got if r.rank is not None) == ranks


def test_importance_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs_of([(1, "x")]).limit(0), none).count() == 0
    got = importance.resample(docs_of([(1, "one two"), (2, None)]), none).collect()
    assert {r.doc_id: (r.n_features, r.rank) for r in got} == {1: (2, None), 2: (0, None)}


def test_suffixes_are_in_order_with_their_common_prefixes():
    rng = random.Random(9)
    lists = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    ids = np.array([x for one in lists for x in one])
    left = np.concatenate([np.arange(len(one), 0, -1) for one in lists])
    for depth in (1, 2, 3, 5):
        order, common = importance.suffixes(ids, left, depth)
        heads = [tuple(ids[p : p + min(depth, left[p])]) for p in order.tolist()]
        assert heads == sorted(heads)
        for a, b, n in zip(heads, heads[1:], common[1:].tolist()):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
