"""Secret scans through a trigram inverted index, in Column expressions only.

From each rule's regex a Boolean query of trigrams is derived: every text that matches has them. The index holds postings
(trigram, document) of the trigrams that some query names; the query's ANDs are intersections of postings, its ORs unions. Only
a rule's candidates are verified by its regex. A rule without mandatory trigrams (runs of hexadecimal digits) scans every text.

Texts are indexed in lower case, so that one index serves rules of either kind of case. Null and empty texts have no spans; rows
with equal or null doc_ids are candidates together and verified each by itself. Every row of the input gives one row.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.spans import matches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value: str | None = None
    """What a match must also contain in full, as a pattern."""
    least: int = 0
    """Characters of a match."""


#: Fixed patterns of the contract, then further kinds of secrets.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"[a-z]{2,12}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+-]{3,64}@"),
)

#: A trigram query: None (no restriction), a trigram, or ("and" | "or", parts).
Query = str | tuple | None


def both(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def literal(text: str) -> Query:
    return both("and", [text[i : i + 3] for i in range(len(text) - 2)])


def derive(pattern: str) -> Query:
    """What trigrams any match has, in lower case."""
    return of_sequence(list(parser.parse(pattern)))


def of_sequence(nodes: list) -> Query:
    out, run = [], ""
    for op, arg in nodes:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        if op is sre.MAX_REPEAT and arg[0] == arg[1] and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
            run += chr(arg[2][0][1]).lower() * arg[0]
            continue
        if op is sre.SUBPATTERN and all(o is sre.LITERAL for o, _ in arg[3]):
            run += "".join(chr(x).lower() for _, x in arg[3])
            continue
        out.append(literal(run))
        run = ""
        if op is sre.SUBPATTERN:
            out.append(of_sequence(list(arg[3])))
        elif op is sre.BRANCH:
            out.append(both("or", [of_sequence(list(b)) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            out.append(of_sequence(list(arg[2])))
    return both("and", [*out, literal(run)])


def trigrams_of(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*map(trigrams_of, q[1]))


def index(docs: DataFrame, trigrams: set[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (gram, id) of the given trigrams."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), low.alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in sorted(trigrams)]))
    return rows.select("_id", F.explode(held).alias("gram"))


def satisfied(q: Query, grams: Column) -> Column:
    """Whether a document's set of indexed trigrams meets the query: ANDs intersect, ORs unite."""
    if isinstance(q, str):
        return F.array_contains(grams, q)
    return reduce(lambda a, b: a & b if q[0] == "and" else a | b, [satisfied(p, grams) for p in q[1]])


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, rules): for each document that meets some query, the kinds it may hold. Postings of a document meet in one row of at
    most as many trigrams as the queries name."""
    per_doc = postings.groupBy("_id").agg(F.collect_set("gram").alias("_grams"))
    rules = F.array_compact(F.array(*[F.when(satisfied(q, F.col("_grams")), F.lit(k)) for k, q in queries.items()]))
    return per_doc.select("_id", rules.alias("_rules")).where(F.size("_rules") > 0)


def ranked(i: int, rule: Rule, found: Column) -> Column:
    """The matches that satisfy the rule, as (start, rule number, kind, end)."""
    if rule.value is not None:
        found = F.filter(found, lambda x: x["t"].rlike(f"^(?:{rule.value})$"))
    if rule.least:
        found = F.filter(found, lambda x: F.char_length(x["t"]) >= rule.least)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), F.lit(rule.kind).alias("k"), x["e"].alias("e")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER, n_base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_<kind> of the base rules, base_sha256, spans (text)."""
    queries = {r.kind: q for r in rules if (q := derive(r.pattern)) is not None}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), *keep, text.alias("_text"))
    if queries:
        found = candidates(index(docs, set().union(*map(trigrams_of, queries.values())), id_col, text_col), queries)
        rows = rows.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
    else:
        rows = rows.withColumn("_rules", F.lit(None).cast("array<string>"))
    spans = {}
    for i, r in enumerate(rules):
        needs = F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)) if r.kind in queries else None
        spans[r.kind] = ranked(i, r, matches(F.col("_text"), r.pattern, needs))
    rows = rows.withColumns({f"_s_{k}": c for k, c in spans.items()})

    def told(kinds: list[str]) -> Column:
        every = F.array_sort(F.concat(*[F.col(f"_s_{k}") for k in kinds]))
        return F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    base = [r.kind for r in rules[:n_base]]
    return rows.select(
        id_col,
        *keep,
        *[F.size(f"_s_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told([r.kind for r in rules]).alias("spans"),
    )
