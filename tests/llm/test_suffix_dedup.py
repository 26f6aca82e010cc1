import hashlib
import random

import numpy as np

from tidebars.llm import suffix_dedup as S


def brute(rows, w):
    order = lambda d: (d is None, d or 0)
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - w + 1):
            x = raw[i : i + w]
            least[x] = min(least.get(x, order(d)), order(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - w + 1):
            if least[raw[i : i + w]] < order(d):
                gone[i : i + w] = b"\1" * w
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d), len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(docs):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(docs).collect())


def made(rng, n):
    words = ["alpha", "béta", "gamma", "de", "ü", "zeta zeta", "x"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(passages)[rng.randrange(10) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(5)))
        rows.append((i * 7 % 101 - 20, text))
    return rows


def test_matches_brute_force(docs_of):
    rows = made(random.Random(1), 100)
    assert got(docs_of(rows)) == brute(rows, 50)


def test_runs_copies_nulls_and_ties(docs_of, monkeypatch):
    monkeypatch.setattr(S, "COLLECTION", 3)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(9, "a" * 300), (3, "a" * 120), (4, "ab" * 90), (5, "ba" * 60), (7, None), (8, ""), (10, text), (11, text), (11, text[5:]), (None, text[:200]), (None, text[:200] + "!"), (12, text[100:149]), (13, text[100:150])]
    rows += [(20 + i, text[:180] + str(i) * 60 + text[200 + i :]) for i in range(12)]
    assert got(docs_of(rows)) == brute(rows, 50)
    assert got(docs_of([])) == []


def test_blocks_of_a_long_text(docs_of, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text), (2, text[1500:] + "#" + text[:900])]
    monkeypatch.setattr(S, "BLOCK", 256)
    h = S.anchors(np.frombuffer(text.encode(), np.uint8))
    assert sorted({s for a, b in zip(h[2], h[3], strict=True) for s in range(a, b + 1)}) == list(range(len(text) - 49))
    assert got(docs_of(rows)) == brute(rows, 50)


def test_suffix_order_is_sorted():
    rng = random.Random(5)
    docs = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 20))) for _ in range(30)]
    doc, place, flat, begin = S.suffix_order(docs)
    suffixes = [docs[d][p - begin[d] :] for d, p in zip(doc, place, strict=True)]
    assert suffixes == sorted(d[i:] for d in docs for i in range(len(d) + 1))
