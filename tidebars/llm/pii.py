"""Personal data by weak supervision, in Column expressions only.

Base rules find emails, addresses, cards and phone numbers and always stay. Wider patterns propose further spans (spelled-out
emails, IPv6 addresses, 13 to 15 digit cards, phone numbers without a country code). On all of these labelers vote for, against
or not at all: the strict regex, a gazetteer, the words before, the shape, and the edges. Expectation-maximisation estimates
each labeler's reliability for each kind from the counts of vote patterns (a table whose size doesn't grow with the input);
the posterior of each pattern then trains a naive Bayes span classifier on features of the span itself (kind, length, shape,
edges, the word class before). Proposed spans that it accepts and that overlap no base span are added.

Null and empty texts have no spans. Every row of the input gives one row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.spans import SPAN, digits, luhn, matches, named

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract, with possessive loops and a start that spares the engine retries inside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us")
COUNTRIES = ("1", "7", "33", "34", "39", "44", "49", "55", "81", "86", "91")
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|address|host|server|addr)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|amex|master|pay)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|\bno\b|\bid\b|ref)\W*$"
VOTERS = ("strict", "gazetteer", "context", "shape", "edges")
FEATURES = ("f_size", "f_separator", "f_before", "f_after", "f_votes")


def base_spans(text: Column) -> dict[str, Column]:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.char_length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    n = lambda x: F.char_length(digits(x["t"]))
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: F.forall(F.split(x["t"], r"\."), small)),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda x: F.when(n(x).between(16, 19), luhn(digits(x["t"]))).otherwise(False)),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: n(x).between(8, 15)),
    }


def wide_spans(text: Column, base: list[Column]) -> dict[str, Column]:
    """Proposed spans that overlap no base span."""
    needs = {"email": text.rlike(r"[\[(]at[\])]"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")}
    taken = F.concat(*base)
    return {k: F.filter(matches(text, WIDE[k], needs[k]), lambda x: ~F.exists(taken, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))) for k in KINDS}


def spans_of(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, base_<kind> and wide_<kind> arrays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), *keep, text.alias("_text"))
    rows = rows.withColumns({f"base_{k}": c for k, c in base_spans(F.col("_text")).items()})
    return rows.withColumns({f"wide_{k}": c for k, c in wide_spans(F.col("_text"), [F.col(f"base_{k}") for k in KINDS]).items()})


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def judged(text: Column, kind: str, base: bool, x: Column) -> Column:
    """A span with its votes and features."""
    t = x["t"]
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    number = digits(t)
    n = F.char_length(number)
    never = F.lit(False)
    strict = {"email": F.lit(base), "ip": F.lit(base) | (F.size(F.split(t, ":")) == 8), "card": luhn(number), "phone": t.startswith("+")}[kind]
    known = {
        "email": F.lower(F.regexp_extract(t, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS),
        "ip": ~t.rlike(r"^(?:0|127|255)\."),
        "card": number.rlike(r"^(?:4|5[1-5]|3[47]|6011|2[2-7])"),
        "phone": F.when(t.startswith("+"), F.exists(F.array(*map(F.lit, COUNTRIES)), lambda c: number.startswith(c))).otherwise(~number.rlike("^[01]")),
    }[kind]
    shape = {"email": t.rlike("[A-Za-z]"), "ip": ~t.rlike(r"(?:^|\.)0[0-9]"), "card": t.rlike(r"^[0-9]+$|^[0-9]{4}[\x20-]"), "phone": t.rlike(r"[0-9]{3}[\x20.)-]+[0-9]{3,}")}[kind]
    glued = before.rlike(r"[A-Za-z0-9_]$") | after.rlike("[A-Za-z0-9_]")
    votes = {
        "strict": vote(strict, ~strict), "gazetteer": vote(known, ~known), "context": vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)),
        "shape": vote(shape, ~shape), "edges": vote(~glued, glued if kind != "email" else never),
    }
    features = {
        "f_size": F.concat(F.lit("size"), F.least(F.char_length(t) / 4, F.lit(8)).cast("int").cast("string")),
        "f_separator": F.concat(F.lit("sep"), F.regexp_extract(t, r"([^A-Za-z0-9@])", 1)),
        "f_before": F.when(before.rlike(CONTEXT[kind]), "before:for").when(before.rlike(AGAINST), "before:against").when(before.rlike(r"\s$") | (before == ""), "before:space").otherwise("before:other"),
        "f_after": F.when(after == "", "after:end").when(after.rlike(r"\s"), "after:space").when(after.rlike("[.,;:)]"), "after:stop").otherwise("after:other"),
        "f_votes": F.concat_ws("", F.lit("votes"), *[votes[v].cast("string") for v in ("strict", "gazetteer", "shape")]),
    }
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), x["s"].alias("s"), x["e"].alias("e"), *[votes[v].alias(v) for v in VOTERS], *[features[f].alias(f) for f in FEATURES])


def judged_all(kind: str, base: bool) -> Column:
    return F.transform(F.col(f"{'base' if base else 'wide'}_{kind}"), lambda x: judged(F.col("_text"), kind, base, x))


def candidates() -> Column:
    return F.concat(*[judged_all(k, b) for k in KINDS for b in (True, False)])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of being personal data by vote pattern: a two-class model with independent labelers, by EM from a majority start."""
    total = sum(n for _, n in patterns)
    post = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in patterns}
    for _ in range(rounds):
        share = (sum(n * post[v] for v, n in patterns) + 1) / (total + 2)
        like = []
        for i in range(len(VOTERS)):
            yes, no = defaultdict(lambda: 0.5), defaultdict(lambda: 0.5)
            for v, n in patterns:
                yes[v[i]] += n * post[v]
                no[v[i]] += n * (1 - post[v])
            a, b = sum(yes[x] for x in (-1, 0, 1)), sum(no[x] for x in (-1, 0, 1))
            like.append({x: math.log(yes[x] / a) - math.log(no[x] / b) for x in (-1, 0, 1)})
        odds = math.log(share / (1 - share))
        new = {v: 1 / (1 + math.exp(-max(-40.0, min(40.0, odds + sum(like[i][x] for i, x in enumerate(v)))))) for v, _ in patterns}
        done = max((abs(new[v] - post[v]) for v in new), default=0.0) < 1e-6
        post = new
        if done:
            break
    return post


def train(rows: DataFrame) -> dict[str, tuple[float, dict[str, float]]]:
    """By kind: the log odds and the weight of each feature value. Only counts by vote pattern and feature value, whose number is
    bounded by the patterns that can occur, reach the driver."""
    found = rows.select(F.explode(candidates()).alias("c")).select("c.*")
    counts = found.groupBy("kind", *VOTERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    model = {}
    for kind in KINDS:
        mine = [r for r in counts if r["kind"] == kind]
        by_votes: dict[tuple[int, ...], int] = defaultdict(int)
        for r in mine:
            by_votes[tuple(r[v] for v in VOTERS)] += r["n"]
        post = estimate(sorted(by_votes.items()))
        yes, no, sums = defaultdict(lambda: 0.5), defaultdict(lambda: 0.5), [1.0, 1.0]
        for r in mine:
            p = post[tuple(r[v] for v in VOTERS)]
            sums[0] += p * r["n"]
            sums[1] += (1 - p) * r["n"]
            for f in FEATURES:
                yes[r[f]] += p * r["n"]
                no[r[f]] += (1 - p) * r["n"]
        model[kind] = math.log(sums[0] / sums[1]), {x: math.log(yes[x] / sums[0]) - math.log(no[x] / sums[1]) for x in {*yes, *no}}
    return model


def accepted(x: Column, kind: str, model: dict[str, tuple[float, dict[str, float]]]) -> Column:
    odds, weights = model[kind]
    if not weights:
        return F.lit(False)
    table = F.create_map(*[c for k, w in sorted(weights.items()) for c in (F.lit(k), F.lit(w))])
    score = F.lit(odds)
    for f in FEATURES:
        score = score + F.coalesce(F.try_element_at(table, x[f]), F.lit(0.0))
    return score >= 0


def partial_accept(kind: str, model: dict[str, tuple[float, dict[str, float]]]) -> Callable[[Column], Column]:
    return lambda x: accepted(x, kind, model)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), added (number)."""
    rows = spans_of(docs, id_col, text_col, keep)
    model = train(rows)
    every, base = [], []
    extra = F.lit(0)
    for k in KINDS:
        more = F.filter(judged_all(k, False), partial_accept(k, model))
        added = F.transform(more, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("t"))).cast(SPAN)
        base.append(named(k, F.col(f"base_{k}")))
        every.append(named(k, F.array_sort(F.concat(F.col(f"base_{k}"), added))))
        extra = extra + F.size(more)
    return rows.select(
        id_col,
        *keep,
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*base), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*every), ",").alias("spans"),
        extra.cast("long").alias("added"),
    )
