"""License scans by ordered signature rules, in Column expressions only.

A text becomes words with a blank on either side of each, so that a rule's regex takes whole words and neighbours don't share a blank.
Every rule has one to three keywords that any match contains; a document's rules are those of which it holds all (one intersection
of its words with all keywords), and only these run. Rules are ordered by class (tags and addresses and bodies; grants and versions; bare
mentions), then by their place in the list. A detection is suppressed if one of its own or a better class contains its interval
(of equal intervals the first by order stays). Base rules' detections always stay.

Rows, keywords and detections stay in the row of their document: nothing is shuffled. Null and empty texts have no words; every row gives one row, whatever its id. Running
sums over the pieces of a very long text are taken in chunks, so that their cost isn't the square of their number. Columns of docs that
aren't asked for by `keep` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 256
DETECTIONS = "array<struct<s:long,back:long,rank:int,i:int,label:string,base:boolean>>"
C = F.col


@dataclass(frozen=True)
class Rule:
    label: str
    phrase: str
    """Words, each a regex of one word; with ? after it a word may be missing, and <n> stands for up to n words of any kind."""
    rank: int
    """0 (tags, addresses, bodies), 1 (grants, versions), 2 (bare mentions)."""
    base: bool = False

    @property
    def pattern(self) -> str:
        out = []
        for t in self.phrase.split():
            if t.startswith("<"):
                out.append(f"(?: [^ ]+ ){{0,{t[1:-1]}}}")
            else:
                out.append(f"(?: (?:{t[:-1]}) )?" if t.endswith("?") else f" (?:{t}) ")
        return "".join(out)

    @property
    def keywords(self) -> list[str]:
        """The three longest of the words that every match has as they are."""
        return sorted({t for t in self.phrase.split() if re.fullmatch(r"[a-z0-9]+", t)}, key=lambda t: (-len(t), t))[:3]


#: The contract's phrases.
BASE = (Rule("cc-by", "cc by", 2, True), Rule("gpl", "general public license", 2, True), Rule("reserved", "all rights reserved", 2, True))

#: Label, tag, name, and versions: fixed values.
FAMILIES = (
    ("apache", "apache", "apache", "1 0|1 1|2 0"),
    ("mit", "mit", "mit", ""),
    ("bsd", "bsd", "bsd", ""),
    ("isc", "isc", "isc", ""),
    ("zlib", "zlib", "zlib", ""),
    ("gpl", "gpl", "gnu general public", "1|2|3"),
    ("lgpl", "lgpl", "gnu (?:lesser|library) general public", "2|2 1|3"),
    ("agpl", "agpl", "gnu affero general public", "1|3"),
    ("gfdl", "gfdl", "gnu free documentation", "1 1|1 2|1 3"),
    ("mpl", "mpl", "mozilla public", "1 0|1 1|2 0"),
    ("epl", "epl", "eclipse public", "1 0|2 0"),
    ("cddl", "cddl", "common development and distribution", "1 0|1 1"),
    ("cpl", "cpl", "common public", "1 0"),
    ("eupl", "eupl", "european union public", "1 0|1 1|1 2"),
    ("artistic", "artistic", "artistic", "1 0|2 0"),
    ("boost", "bsl", "boost software", "1 0"),
    ("python", "psf", "python software foundation", "2 0"),
    ("ms-pl", "ms pl", "microsoft public", ""),
    ("ms-rl", "ms rl", "microsoft reciprocal", ""),
    ("osl", "osl", "open software", "1 0|1 1|2 0|2 1|3 0"),
    ("afl", "afl", "academic free", "1 1|1 2|2 0|2 1|3 0"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "wtfpl", "do what the fuck you want to public", ""),
    ("ofl", "ofl", "sil open font", "1 0|1 1"),
    ("lppl", "lppl", "latex project public", "1 0|1 1|1 2|1 3c"),
    ("odbl", "odbl", "open database", "1 0"),
    ("upl", "upl", "universal permissive", "1 0"),
    ("ecl", "ecl", "educational community", "1 0|2 0"),
    ("ncsa", "ncsa", "university of illinois ncsa open source", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("php", "php", "php", "3 0|3 01"),
    ("zpl", "zpl", "zope public", "1 1|2 0|2 1"),
    ("vim", "vim", "vim", ""),
    ("w3c", "w3c", "w3c software", ""),
    ("x11", "x11", "x11", ""),
    ("sleepycat", "sleepycat", "sleepycat", ""),
    ("qpl", "qpl", "q public", "1 0"),
    ("npl", "npl", "netscape public", "1 0|1 1"),
    ("ipl", "ipl", "ibm public", "1 0"),
    ("spl", "spl", "sun public", "1 0"),
    ("rpl", "rpl", "reciprocal public", "1 1|1 5"),
    ("cecill", "cecill", "cecill", "1 0|1 1|2 0|2 1"),
    ("mulan", "mulanpsl", "mulan permissive software", "1 0|2 0"),
    ("elastic", "elastic", "elastic", "2 0"),
    ("sspl", "sspl", "server side public", "1 0"),
    ("busl", "busl", "business source", "1 1"),
    ("openssl", "openssl", "openssl", ""),
    ("blueoak", "blueoak", "blue oak model", "1 0 0"),
)

#: Of Creative Commons: label, tag, name of the terms. Fixed values.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution sharealike"),
    ("cc-by-nd", "by nd", "attribution noderivs"),
    ("cc-by-nc", "by nc", "attribution noncommercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivs"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Bodies, addresses and notices, by hand. Fixed values.
BODIES = (
    Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy", 0),
    Rule("mit", "the above copyright notice and this permission notice shall be included in all copies", 0),
    Rule("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted", 0),
    Rule("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0),
    Rule("bsd", "neither the name|names of <8> contributors may be used to endorse or promote products", 0),
    Rule("zlib", "altered source versions must be plainly marked as such", 0),
    Rule("zlib", "this software is provided as is without any express or implied warranty", 0),
    Rule("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", 0),
    Rule("wtfpl", "you just do what the fuck you want to", 0),
    Rule("unlicense", "this is free and unencumbered software released into the public domain", 0),
    Rule("public-domain", "released|dedicated|placed <2> in|into|to the public domain", 1),
    Rule("cc0", "cc0 1? 0? universal?", 1),
    Rule("cc0", "creative commons zero <3> universal", 0),
    Rule("cc0", "creativecommons org publicdomain zero 1 0", 0),
    Rule("cc0", "spdx license identifier cc0 1 0", 0),
    Rule("apache", "you may not use this file except in compliance with the licen[cs]e", 0),
    Rule("apache", "www? apache org licenses license 2 0", 0),
    Rule("gpl", "free software foundation either version [123] of the licen[cs]e or <4> any later version", 0),
    Rule("gpl", "you should have received a copy of the gnu general public licen[cs]e", 0),
    Rule("lgpl", "you should have received a copy of the gnu lesser general public licen[cs]e", 0),
    Rule("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", 0),
    Rule("gpl", "www? gnu org licenses", 1),
    Rule("mpl", "mozilla org mpl", 0),
    Rule("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e", 0),
    Rule("epl", "www? eclipse org legal epl", 0),
    Rule("python", "psf is making python available to licensee on an as is basis", 0),
    Rule("ofl", "scripts sil org ofl", 0),
    Rule("warranty", "without warranties or conditions of any kind", 2),
    Rule("warranty", "provided as is without warranty of any kind", 2),
    Rule("copyright", "copyright c? (?:19|20)[0-9]{2}", 2),
    Rule("proprietary", "confidential and proprietary", 2),
    Rule("proprietary", "unauthori[sz]ed copying of this file", 1),
    Rule("proprietary", "for internal use only", 2),
    Rule("gpl", "gpl v?[123]", 1),
    Rule("lgpl", "lgpl v?[23]", 1),
    Rule("bsd-2-clause", "bsd 2 clause", 1),
    Rule("bsd-2-clause", "2|two clause bsd", 1),
    Rule("bsd-3-clause", "bsd 3 clause", 1),
    Rule("bsd-3-clause", "3|three clause bsd", 1),
)


def rules() -> tuple[Rule, ...]:
    """All rules in their order: for each family a tag for every version, the address, the grant, the name with each version, and the
    bare name; for Creative Commons likewise; then the bodies."""
    out: list[Rule] = list(BASE)
    licence, granted = "licen[cs]e|licen[cs]es", "(?:licensed|released|distributed|available|published|covered|governed)"
    for label, tag, name, versions in FAMILIES:
        some = [v for v in versions.split("|") if v]
        out += [Rule(f"{label}-{v.replace(' ', '.')}", f"spdx license identifier {tag} {v}", 0) for v in some]
        out += [Rule(label, f"spdx license identifier {tag}", 0), Rule(label, f"opensource org licenses? {tag}", 0)]
        out += [Rule(f"{label}-{v.replace(' ', '.')}", f"{name} {licence} version? v? {v}", 1) for v in some]
        out += [Rule(label, f"{granted} under <4> {name} {licence}", 1), Rule(label, f"{name} {licence}", 2)]
    for label, tag, terms in COMMONS:
        for v in COMMONS_VERSIONS:
            dotted = v.replace(" ", ".")
            out += [Rule(f"{label}-{dotted}", f"spdx license identifier cc {tag} {v}", 0), Rule(f"{label}-{dotted}", f"creativecommons org licenses {tag} {v}", 0)]
            out += [Rule(f"{label}-{dotted}", f"cc {tag} {v}", 1), Rule(f"{label}-{dotted}", f"creative commons {terms} {v}", 1)]
        out += [Rule(label, f"creative commons {terms}", 2), Rule(label, f"cc {tag}", 2)]
    return (*out, *BODIES)


def candidates(signatures: tuple[Rule, ...], held: Column) -> Column:
    """The rules all of whose keywords are held."""
    table = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(r.rank).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.base).alias("base"), F.lit(r.pattern).alias("pattern"), F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"))
            for i, r in enumerate(signatures)
        ]
    )
    return F.filter(table, lambda r: F.array_contains(held, r["keywords"][0]) & F.forall(r["keywords"], lambda k: F.array_contains(held, k)))


def ends(rank: int) -> Column:
    """Ends of the detections of a class or a better one, else -1."""
    return F.transform("dets", lambda d: F.when(d["rank"] <= rank, -d["back"]).otherwise(F.lit(-1).cast("long")))


def running(x: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array, what has been merged of the elements before it. Chunk by chunk: an array that grows by one element at a
    time is copied each time."""
    zero = F.array().cast("array<long>")

    def over(part: Column, first: Column) -> Column:
        seed = F.struct(first.alias("now"), zero.alias("out"))
        return F.aggregate(part, seed, lambda a, v: F.struct(merge(a["now"], v).alias("now"), F.array_append(a["out"], a["now"]).alias("out")), lambda a: a["out"])

    chunks = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(CHUNK)), lambda i: F.slice(x, i, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<long>>"))
    whole = F.transform(chunks, lambda c: F.aggregate(c, start, merge))
    return F.flatten(F.zip_with(chunks, over(whole, start), over))


def words_in(padded: Column) -> Column:
    """Words of a piece, each of which has a blank on either side."""
    return ((F.char_length(padded) - F.char_length(F.replace(padded, F.lit(" "), F.lit("")))) / 2).cast("long")


def found(padded: Column, rule: Column) -> Column:
    """The places (first word s, end e) where a rule's pattern matches, leftmost first, with the rule's fields."""
    hits = F.transform(F.regexp_extract_all(padded, rule["pattern"], F.lit(0)), words_in)
    before = F.slice(F.transform(F.split(padded, rule["pattern"], -1), words_in), F.lit(1), F.size(hits))
    starts = F.zip_with(running(F.zip_with(before, hits, lambda p, h: p + h), F.lit(0).cast("long"), lambda a, v: a + v), before, lambda a, p: a + p)
    return F.zip_with(starts, hits, lambda s, n: F.struct(s.alias("s"), (-(s + n)).alias("back"), rule["rank"].alias("rank"), rule["i"].alias("i"), rule["label"].alias("label"), rule["base"].alias("base")))


def scan(docs: DataFrame, signatures: tuple[Rule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_words, n_base, first_word, last_word, base_labels, labels, score, spans
    (label:first word:end word, comma-joined)."""
    signatures = rules() if signatures is None else signatures
    names = [f"_k{i}" for i in range(len(keep) + 1)]  # so that no column of docs can clash
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, (id_col, *keep), strict=True)], F.split(F.translate(text_of(text_col), UPPER, LOWER), SEPARATORS, -1).alias("w"))
    rows = rows.select(*names, F.filter("w", lambda w: w != "").alias("w"))
    rows = rows.select(*names, "w", F.array_intersect("w", F.array(*[F.lit(k) for k in sorted({k for r in signatures for k in r.keywords})])).alias("held"))
    rows = rows.select(*names, F.size("w").cast("long").alias("n_words"), "held", F.when(F.size("held") > 0, F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))).alias("padded"))
    rows = rows.withColumn("rules", F.when(F.size("held") > 0, candidates(signatures, F.col("held"))))
    rows = rows.select(*names, "n_words", F.when(F.size("rules") > 0, F.array_sort(F.flatten(F.transform("rules", lambda r: found(F.col("padded"), r))))).alias("dets"))
    rows = rows.withColumn("some", F.size("dets") > 0)
    # to what end the detections before each one reach, of its own or a better class
    rows = rows.withColumns({f"e{k}": F.when(C("some"), ends(k)) for k in range(3)}).withColumns({f"e{k}": F.when(C("some"), running(C(f"e{k}"), F.lit(-1).cast("long"), lambda a, v: F.greatest(a, v))) for k in range(3)})
    far = F.zip_with(F.zip_with("e0", "e1", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "e2", lambda x, c: F.struct(x["a"].alias("e0"), x["b"].alias("e1"), c.alias("e2")))
    alone = F.zip_with("dets", far, lambda d, f: F.when(d["base"] | (F.when(d["rank"] == 0, f["e0"]).when(d["rank"] == 1, f["e1"]).otherwise(f["e2"]) < -d["back"]), d))
    none = F.array().cast(DETECTIONS)
    rows = rows.withColumns({"kept": F.coalesce(F.when(C("some"), F.array_compact(alone)), none), "base": F.coalesce(F.when(C("some"), F.filter("dets", lambda d: d["base"])), none)})
    told = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    strength = F.transform("kept", lambda d: F.when(d["rank"] == 0, 1.0).when(d["rank"] == 1, 0.9).otherwise(0.6))
    return rows.select(
        *[F.col(n).alias(c) for n, c in zip(names, (id_col, *keep), strict=True)],
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["s"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["s"])).alias("last_word"),
        told("base").alias("base_labels"),
        told("kept").alias("labels"),
        F.coalesce(F.array_max(strength), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("kept", lambda d: F.concat_ws(":", d["label"], d["s"].cast("string"), (-d["back"]).cast("string"))), ",").alias("spans"),
    )
