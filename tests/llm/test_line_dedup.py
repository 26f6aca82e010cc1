import random

from tidebars.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(rng, line, n):
    s = list(line)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(s))
        if kind == 0:
            s[at] = rng.choice("abcxyz")
        elif kind == 1:
            s.insert(at, rng.choice("abcxyz"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def test_distance_is_that_of_plain_rows():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
        b = changed(rng, a, rng.randrange(5)) if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
        for k in (0, 1, 2, 3):
            d = distance(a, b)
            assert L.distance_within(a, b, k) == (d if d <= k else None), (a, b, k)


def brute(rows):
    """(doc, line): class and links."""
    places = [((d is None, d or 0, i), line) for d, t in rows for i, line in enumerate((t or "").split("\n") if t is not None else []) if line.strip()]
    texts = sorted({t for _, t in places})
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(texts, 0)
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            k = L.tau(min(len(a), len(b)), 2, 10)
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    head = {}
    for p, t in sorted(places):
        head.setdefault(find(t), p)
    return {p: (head[find(t)], links[t]) for p, t in places}


def made(rng, n):
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    lines = [changed(rng, rng.choice(base), rng.randrange(4)) for _ in range(n)]
    return [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for d in range(n // 2)]


def check(docs_of, rows):
    want = brute(rows)
    got = L.classified(docs_of(rows)).collect()
    seen = {(r.doc_id is None, r.doc_id or 0, r.line_no): ((r.class_doc is None, r.class_doc or 0, r.class_line), r.n_links) for r in got if r.node is not None}
    assert seen == want
    assert all(r.removed == (r.node is not None and want[r.doc_id is None, r.doc_id or 0, r.line_no][0] != (r.doc_id is None, r.doc_id or 0, r.line_no)) for r in got)


def test_matches_brute_force(docs_of):
    check(docs_of, made(random.Random(3), 160))


def test_crowded_keys_are_verified_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(5)
    line = "the quick brown fox jumps over the lazy dog and runs away"
    check(docs_of, [(i, changed(rng, line, rng.randrange(4))) for i in range(90)])


def test_nulls_blank_and_repeated_rows(docs_of):
    check(docs_of, [(0, None), (1, ""), (2, "\n\n"), (3, "same line here ok"), (None, "same line here ok"), (4, "same line here 0k\n  \nsame line here ok")])
    docs = docs_of([(3, "same line here ok"), (3, "same line here ok"), (4, "x\nsame line here ok"), (5, None)])
    out = {(r.doc_id, r.text) for r in L.without_repeats(docs).collect()}
    assert out == {(3, "same line here ok"), (4, "x"), (5, None)}
    assert L.summary(docs_of([])).count() == 0


def test_rows_with_no_id_or_one_id_lose_only_their_own_lines(docs_of):
    docs = docs_of([(None, "line A\nline B"), (None, "line C\nline A"), (7, "line D\nline E"), (7, "line F\nline D"), (7, "line D\nline G")])
    got = sorted(line for r in L.without_repeats(docs).collect() for line in r.text.split("\n") if line)
    assert got == [f"line {c}" for c in "ABCDEFG"]
