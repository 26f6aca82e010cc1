import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidebars.llm import interpolation as I

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII)), I.END]


def made(rng, n):
    parts = ["an", "re", "ti", "ou", "é", "the", "ing"]
    return [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_base_counts_and_better_scores(docs_of):
    rows = [*made(random.Random(1), 300), (900, None), (901, ""), (902, " \n"), (None, "the THE\x0bé"), (903, "zzz qqq"), (903, "zzz qqq")]
    got = I.score(docs_of(rows), batch_bytes=4000).collect()
    assert len(got) == len(rows)
    part = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 7
    counts = Counter(t for d, x in rows if part(d) != 2 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), d is not None and part(d) == 2, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for d, x in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_em_finds_the_likeliest_share():
    ratio, count = np.array([0.0, 0.5, 4.0]), np.array([3.0, 5.0, 9.0])
    best = max(np.linspace(0.001, 0.999, 999), key=lambda s: (count * np.log(s * ratio + 1 - s)).sum())
    assert abs(I.weight_by_em(ratio, count) - best) < 2e-3


def test_empty_table(docs_of):
    assert I.score(docs_of([])).count() == 0
    assert I.score(docs_of([None, ""])).count() == 2


def test_scores_are_those_of_plain_trigrams_and_order_counts(docs_of):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    follow = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(240):
        w = [rng.choice(words)]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    rows += [(d + 1000, " ".join(rng.sample(t.split(), 40))) for d, t in rows if zlib.crc32(str(d + 1000).encode()) % 7 == 2]
    part = lambda d: zlib.crc32(str(d).encode()) % 7
    grams = lambda t: [(("<s>", "<s>", *tokens(t))[i : i + 2], x) for i, x in enumerate(tokens(t))]
    counts = {p: [Counter() for _ in range(4)] for p in ("main", "all")}
    for d, t in rows:
        for p in ["main", "all"] if part(d) not in (2, 3) else ["all"] if part(d) == 3 else []:
            for c, x in grams(t):
                for n in range(3):
                    counts[p][n + 1][c[2 - n :] + (x,)] += 1
    held = [(c, x) for d, t in rows if part(d) == 3 for c, x in grams(t)]

    def chance(p, c, x, shares):
        c1 = counts[p][1]
        out = (1 - new) * (shares[0] * c1[x,] / c1.total() + (1 - shares[0]) / len(c1)) if c1[x,] else new
        for n, by in enumerate(shares[1:], 2):
            seen = contexts[p][n][c[3 - n :]]
            if seen:
                s = by.get(int(math.log2(seen)), by[None])
                out = s * counts[p][n][c[3 - n :] + (x,)] / seen + (1 - s) * out
        return out

    contexts = {p: {n: Counter() for n in (2, 3)} for p in counts}
    for p in counts:
        for n in (2, 3):
            for g, k in counts[p][n].items():
                contexts[p][n][g[:-1]] += k
    new = (sum(not counts["main"][1][x,] for _, x in held) + 0.5) / (len(held) + 1)
    c1 = counts["main"][1]
    shares = [I.weight_by_em(np.array([c1[x,] / c1.total() * len(c1) for _, x in held if c1[x,]]), np.ones(sum(c1[x,] > 0 for _, x in held)))]
    for n in (2, 3):
        ratio = [(int(math.log2(k)), counts["main"][n][c[3 - n :] + (x,)] / k / chance("main", c, x, shares)) for c, x in held if (k := contexts["main"][n][c[3 - n :]])]
        em = lambda r: I.weight_by_em(np.array(r), np.ones(len(r)))
        shares.append({b: em([r for a, r in ratio if a == b]) for b in {a for a, _ in ratio}} | {None: em([r for _, r in ratio])})
    got = {r.doc_id: r.score for r in I.score(docs_of(rows), batch_bytes=4000).collect()}
    for d, t in rows:
        want = sum(math.log10(chance("all", c, x, shares)) for c, x in grams(t))
        assert abs(got[d] - want) < 0.01 * len(tokens(t)), (d, got[d], want)
    mixed = [d for d in got if d >= 1000]
    assert mixed and all(got[d] < got[d - 1000] - 5 for d in mixed)
