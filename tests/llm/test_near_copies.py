import random

import numpy as np
import pytest

import corpus_pipeline
from tidebars.llm import near_copies as N


def made(rng, n):
    """Groups of texts of about 60 words with a few words changed, so that similarities lie on both sides of 0.8."""
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        if i % 4 == 0:
            base = [rng.choice(words) for _ in range(rng.randrange(40, 160))]
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_stage_keeps_one_of_each_group_of_all_pairs(spark, docs_of):
    rows = made(random.Random(6), 240)
    first = {}
    for (d, _), g in zip(rows, groups(rows), strict=True):
        first[g] = min(first.get(g, d), d)
    assert 70 < len(first) < 200
    got = corpus_pipeline.drop_near_copies(spark, docs_of(rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(first.values())


def test_crowded_keys_are_dealt_again(docs_of):
    rows = made(random.Random(7), 80)
    got = N.one_of_each(docs_of(rows), crowded=2).collect()
    assert len(got) == len(set(groups(rows)))


def test_rows_without_an_id_or_with_one_id_are_rows_of_their_own(spark, docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (None, a), (None, c), (None, c + " more"), (None, None), (2, "")]
    got = corpus_pipeline.drop_near_copies(spark, docs_of(rows), "").collect()
    assert sorted((str(r.doc_id), r.text[:1]) for r in got) == [("1", "a"), ("1", "b"), ("2", ""), ("None", "c")]
    assert N.one_of_each(docs_of([])).count() == 0


def fingerprints_apart(rng, pairs, bits):
    """Pairs of fingerprints that differ in one bit less than would put more than the radius into every part of `bits` bits."""
    out = []
    for i in range(pairs):
        a = rng.integers(0, 2**64, N.WORDS, np.uint64)
        flip = np.zeros(N.WORDS * 64, np.uint8)
        spare = int(rng.integers(N.PARTS))
        for part in range(N.PARTS):
            flip[part * 32 + rng.choice(bits, N.RADIUS[bits] + (part != spare), replace=False)] = 1
        b = a ^ np.packbits(flip, bitorder="little").view(np.uint64)
        out += [(2 * i, a.view(np.int64).tolist()), (2 * i + 1, b.view(np.int64).tolist())]
    return out


@pytest.mark.parametrize("bits", [24, 32])
def test_tables_meet_every_pair_within_the_radius(spark, monkeypatch, bits):
    monkeypatch.setattr(N, "FINE", 0 if bits == 32 else 1 << 20)
    rows = fingerprints_apart(np.random.default_rng(bits), 60, bits)
    got = N.candidates(spark.createDataFrame(rows, "node long, fp array<long>"), 1024).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {frozenset((2 * i, 2 * i + 1)) for i in range(60)}


def test_larger_parts_keep_one_of_each_group_of_all_pairs(docs_of, monkeypatch):
    monkeypatch.setattr(N, "FINE", 0)
    monkeypatch.setattr(N, "GROUP", 16)
    rows = made(random.Random(8), 120)
    assert N.one_of_each(docs_of(rows)).count() == len(set(groups(rows)))


def test_each_node_of_a_cluster_is_sent_once_and_not_by_table(spark):
    rng = np.random.default_rng(3)
    middle = rng.integers(0, 2, N.WORDS * 64)
    fps = [np.packbits(middle ^ (rng.random(N.WORDS * 64) < 0.03), bitorder="little").view(np.int64).tolist() for _ in range(200)]
    nodes = spark.createDataFrame([(i, i, fp) for i, fp in enumerate(fps)], "node long, row long, fp array<long>")
    assert N.candidates(nodes.select("node", "fp"), 1024).count() > 50 * 200  # what the tables have of them
    dealt = N.dealt_in_blocks(N.clusters(nodes, 1024), 1024).collect()
    assert sorted(r.node for r in dealt) == list(range(200)) and len({r.key for r in dealt}) == 1


@pytest.mark.parametrize("block, large", [(8, 1 << 15), (8, 8)])
def test_large_clusters_are_verified_in_blocks_or_by_table(docs_of, monkeypatch, block, large):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "LARGE", large)
    words = [f"w{i}" for i in range(500)]
    rng = random.Random(9)
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):  # a chain: each text differs from the one before by a word, so that the ends are far apart
        base[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(100 + i, t) for i, t in made(rng, 40)]
    assert N.one_of_each(docs_of(rows)).count() == len(set(groups(rows)))
