"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `size` consecutive words (a shorter item is one window). For exact containment of a window
its prefix is one token, and the rarest is the cheapest: words are ordered by how often they occur in all documents, and each
window is indexed under its rarest word with that word's place in it. A document's words probe the index; length (the window
must fit) and position (it starts where the rare word says) bound the candidates, and each is verified word by word.

The index is broadcast in blocks of at most `block_bytes` of benchmark text, checked by an aggregate before anything is
collected; a larger benchmark is dealt out to more blocks, and each document passes them one after another with its hits so
far, so no block is larger than the bound and no item is left out. An index holds its items' words once and four numbers a window:
about 40 bytes a byte of text.

Nulls and texts without words have no hits. Repeated item_ids count once; a null item_id is reported as an empty string.
Documents with equal ids are separate rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import by_text

#: Bytes that separate words, and upper-case letters, as one translation: words are what split() then gives.
FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Index:
    """Windows by their rarest word. Items' words are held once, and a window by its item, start and length."""

    def __init__(self, items: list[tuple[str, str]], size: int, freq: dict[bytes, int]):
        names = {}
        self.items = [[names.setdefault(w, w) for w in words_of(text)] for _, text in items]
        owners: dict[tuple[bytes, ...], list[int]] = {}  # first place, then items
        for i, words in enumerate(self.items):
            for start, w in enumerate(windows(words, size)):
                owners.setdefault(w, [i, start]).append(i)
        by_word: dict[bytes, list[int]] = defaultdict(list)
        self.owners: list[tuple[str, ...]] = []
        at = []
        for w, (i, start, *whose) in owners.items():
            place = min(range(len(w)), key=lambda k: (freq.get(w[k], 0), w[k], k))
            by_word[w[place]] += [place, len(self.owners)]
            self.owners.append(tuple(sorted({items[x][0] for x in whose})))
            at.append((i, start, len(w)))
        self.by_word = {w: np.array(x, np.int32) for w, x in by_word.items()}
        self.at = np.array(at, np.int32).reshape(-1, 3)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit intervals (start, end) and item ids."""
        n = len(words)
        spans, ids = [], set()
        index = self.by_word
        for i in [i for i, w in enumerate(words) if w in index]:
            found = index[words[i]].tolist()
            for place, window in zip(found[::2], found[1::2], strict=True):
                item, first, size = self.at[window].tolist()
                start = i - place
                end = start + size
                if start >= 0 and end <= n and words[start:end] == self.items[item][first : first + size]:
                    spans.append((start, end))
                    ids.update(self.owners[window])
        return spans, ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[Iterator[list[tuple[str, str]]], int]:
    """The items in blocks, each collected by itself when its turn comes, and the number of blocks."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    lots = [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]
    return ([(r.item_id, r.text) for r in lot.collect()] for lot in lots), n


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of a block's vocabulary occurs in all documents (as many rows to the driver as the block has words)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value, Counter()
        for f in frames:
            for t in f["_text"]:
                counts.update([w for w in words_of(t) if w in known])
        yield pd.DataFrame({"w": pd.Series(list(counts), dtype=object), "n": np.array(list(counts.values()), np.int64)})

    rows = docs.select("_text").mapInPandas(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.w): r.n for r in rows}


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, keep: tuple[str, ...] = (), block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word
    intervals)."""
    spark = docs.sparkSession
    there, back = by_text(docs, id_col, *keep)
    now = docs.select(*there, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema if f.name != "_text")
    bare = now
    now = now.withColumns({"_spans": F.lit(None).cast("array<int>"), "_items": F.lit(None).cast("array<string>")})
    final = f"{kept}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<int>"
    blocks, total = blocks_of(benchmark, item_col, item_text, block_bytes)
    for b, items in enumerate(blocks):
        vocabulary = {w for _, t in items for w in words_of(t)}
        index = spark.sparkContext.broadcast(Index(items, size, frequencies(bare, vocabulary)))

        def probe(frames: Iterator[pd.DataFrame], index=index, last=b == total - 1) -> Iterator[pd.DataFrame]:
            for f in frames:
                spans, ids, sizes = [], [], []
                for text, s, i in zip(f["_text"], f["_spans"], f["_items"], strict=True):
                    words = words_of(text)
                    got, names = index.value.find(words)
                    old = [] if s is None else [int(x) for x in s]
                    got = merged([*got, *zip(old[::2], old[1::2], strict=True)])
                    spans.append([x for p in got for x in p])
                    ids.append(sorted({*names, *([] if i is None else i)}))
                    sizes.append(len(words))
                yield report(f, spans, ids, sizes) if last else f.assign(_spans=spans, _items=ids)

        now = now.mapInPandas(probe, final if b == total - 1 else f"{kept}, _text string, _spans array<int>, _items array<string>")
    return now.select(*back, *now.columns[len(back) :])


def report(f: pd.DataFrame, spans: list[list[int]], ids: list[list[str]], sizes: list[int]) -> pd.DataFrame:
    hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids]
    return f.drop(columns=["_text", "_spans", "_items"]).assign(n_words=sizes, n_hit=hit, n_items=[len(i) for i in ids], items_sha256=sha, contaminated=[h > 0 for h in hit], hit_spans=spans)
