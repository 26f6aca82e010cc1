import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tidebars.llm import order_minhash as O
from tidebars.llm import simhash as S
from tidebars.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h)) if h else 0


def texts(rng, n):
    words = ["alpha", "Beta", "g\x0bm", "délta", "éps", "ZETA", "eta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(6)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_simhash_components_are_those_of_all_pairs(docs_of):
    rng = random.Random(2)
    rows = [*enumerate(texts(rng, 120)), (500, None), (501, ""), (502, " \n"), (2**60 + 1, "ALPHA beta"), (None, "alpha beta"), (7, "alpha beta")]
    got = S.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    prints = {i: plain_simhash(t) for i, (_, t) in enumerate(rows)}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = sorted((str(d), f"{prints[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert S.near_duplicates(docs_of([])).count() == 0


def test_covering_masks_miss_no_pair():
    rng = random.Random(3)
    for seed in (1, 2):
        masks = [m & (1 << 64) - 1 for m in S.covering_masks(3, seed)]
        assert len(masks) == 15 and all(20 < bin(m).count("1") < 45 for m in masks)
        for _ in range(2000):
            bits = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
            assert any(bits & m == 0 for m in masks)


def test_crowded_buckets_keep_every_link(spark):
    rng = random.Random(4)
    fps = {0}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60))
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    for crowded in (4, 10_000):
        parent = {x: x for x in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        edges = S.links(nodes, 3, crowded).collect()
        assert all(bin(r.src ^ r.dst).count("1") <= 3 for r in edges)
        for r in edges:
            parent[find(r.src)] = find(r.dst)
        assert len({find(x) for x in fps}) == 1


def plain_order_minhash(text, k=O.K, length=O.LENGTH, hashes=O.HASHES):
    """By the definition, one hash function at a time."""
    grams = O.kmers(O.code_points(text), k)
    seen, items = {}, []
    for g in grams:
        seen[int(g)] = seen.get(int(g), -1) + 1
        items.append(int(g) if not seen[int(g)] else int(O.mix(np.array([int(g) + seen[int(g)] * 0xD1342543DE82EF95 & (1 << 64) - 1], np.uint64))[0]))
    picks = []
    for i in range(hashes):
        order = sorted(range(len(items)), key=lambda j: (items[j] ^ int(O.SALTS[i])) * int(O.FACTORS[i]) & (1 << 64) - 1)[:length]
        picks.append([items[j] | 1 for j in sorted(order)])
    return picks


def test_order_minhash_follows_its_definition():
    rng = random.Random(6)
    cases = ["", "a", "aaaaaa", "ab" * 40, "x" * 500] + ["".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(80))) for _ in range(60)]
    sketches = {}
    for t in cases:
        sketches.setdefault(str(plain_order_minhash(t)), set()).add(O.sketch(t).tobytes())
    assert all(len(x) == 1 for x in sketches.values())
    assert len({b for x in sketches.values() for b in x}) == len(sketches)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * O.CHUNK))
    for a, b in [(long, long[:-900] + long[:900]), ("abc", "abd"), ("", "a"), ("abcabc" * 9, "abcabc" * 8)]:
        both = O.sketch_both(a, b, O.K, O.LENGTH, O.HASHES)
        assert (both[0] == O.sketch(a)).all() and (both[1] == O.sketch(b)).all()
    assert O.likeness(O.sketch(long).tobytes(), O.sketch(long[:-900] + "q" * 900).tobytes()) > 0.7
    assert O.likeness(O.sketch(long).tobytes(), O.sketch(long[1000:] + long[:1000]).tobytes()) < 1


def test_edits_take_the_next_document(docs_of):
    rng = random.Random(8)
    rows = [(i * 3 - 50, "".join(rng.choice("abc é") for _ in range(rng.randrange(60)))) for i in range(90)] + [(2**61 + 1, None), (None, "null id")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in O.edit_sensitivity(docs_of(rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        edited = O.edited_text(t, n)
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (O.sketch(x).tobytes() for x in (t, edited, n))
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a.hex(), b.hex(), O.likeness(a, b), O.likeness(a, c))
    one = O.edit_sensitivity(docs_of([(5, "abcdefgh")])).collect()
    assert len(one) == 1 and one[0].near_edited < 1 and one[0].near_next == 1
    assert O.edit_sensitivity(docs_of([])).count() == 0
    assert O.edit_sensitivity(docs_of([(1, "a" * 40), (1, "b" * 40), (1, "b" * 40)])).count() == 3


def test_components_raise_when_rounds_run_out(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.root for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, rounds=1)


def test_order_minhash_hashes_a_common_head_once(monkeypatch):
    hashed, kmers = [], O.kmers
    monkeypatch.setattr(O, "kmers", lambda points, k: hashed.append(len(points)) or kmers(points, k))
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(12000))
    edited = text[:9000] + text[:3000]
    both = O.sketch_both(text, edited, O.K, O.LENGTH, O.HASHES)
    assert sum(hashed) < 1.3 * len(text)
    assert [x.tolist() for x in both] == [O.sketch(x).tolist() for x in (text, edited)]
    for _ in range(200):  # short texts, also shorter than a k-mer, and heads of any length
        x = "".join(r.choice("ab") for _ in range(r.randrange(30)))
        y = x[: r.randrange(31)] + "".join(r.choice("ab") for _ in range(r.randrange(9)))
        assert [z.tolist() for z in O.sketch_both(x, y, O.K, O.LENGTH, O.HASHES)] == [O.sketch(z).tolist() for z in (x, y)]
