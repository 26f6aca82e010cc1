"""BPE encoding and decoding with a public vocabulary file.

Encoding: a priority queue of merge ranks over a doubly linked list of symbols; an entry whose pair has changed since it was
pushed is stale and skipped. Decoding: vocabulary strings one after another, set apart by one space, since the file names no
decoder. Every document is independent, so the operator is one narrow pass: no shuffle, and a bounded cache of words per task,
which keeps what was used of late.

Nulls encode as the empty text. Empty texts give no ids. Extra columns of the input never reach the operator.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import by_text

#: White space of the vocabulary's patterns (the Unicode property), which differs from Python's \s.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Words held by each of the cache's two halves.
CACHE = 300_000
#: Characters whose tokens are held at once, and handed on together.
CHUNK = 1 << 21


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Packed ids by word. When full it starts anew beside its former self, whose words come back as they are met."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.former = make, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.former.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= 40:
            if len(self) >= CACHE:
                self.former = dict(self)
                self.clear()
            self[piece] = got
        return got


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.vocab: dict[str, int] = data["model"]["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.end = data["model"]["end_of_word_suffix"] or ""
        self.merges: dict[int, int] = {}  # pair of ids: rank, then merged id
        for rank, (a, b) in enumerate(data["model"]["merges"]):
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = rank << 20 | self.vocab[a + b]
        letters = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cache = Words(lambda piece: packed(self.word(piece)))

    def word(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        look = self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [m << 32 | i for i in range(n - 1) if (m := look(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, merge = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or look(ids[i] << 20 | ids[j]) != merge:
                continue  # stale
            ids[i], ids[j] = merge & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := look(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(queue, m << 32 | i)
            h = before[i]
            if h >= 0 and (m := look(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(queue, m << 32 | h)
        return [i for i in ids if i >= 0]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each character by itself: no final sigma

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        out = []
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(packed([self.special[part]]))
            else:
                out += map(self.cache.__getitem__, PIECES.findall(self.normal(part)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([s for s in map(self.strings.get, ids) if s is not None])


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows with about CHUNK characters each (a longer text is alone), so that tokens never pile up."""
    part = np.cumsum(frame["_text"].str.len().to_numpy(np.int64)) // CHUNK
    for rows in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
        yield frame.iloc[rows]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), full: bool = False) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_tokens, ids_sha256, decoded_sha256; with full, ids and decoded too.
    path: the vocabulary file, at the same place on every machine."""
    path = path or default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for whole in frames:
            for frame in slices(whole):
                rows = []
                for text in frame["_text"]:
                    raw = bpe.packed(text)
                    ids = np.frombuffer(raw, "<u4")
                    decoded = bpe.decode(ids.tolist())
                    row = (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, ids.astype(np.int32), decoded) if full else row)
                made = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if full else 3])
                made.index = frame.index
                yield pd.concat([frame.drop(columns="_text"), made], axis=1)

    there, back = by_text(docs, id_col, *keep)
    src = docs.select(*there, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    extra = ", ids array<int>, decoded string" if full else ""
    out = src.mapInPandas(run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return out.select(*back, *out.columns[len(back) :])


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: the vocabulary strings of the ids, set apart by a space; null ids give an empty text."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        bpe = loaded(path)
        return ids.map(lambda x: "" if x is None else bpe.decode([int(i) for i in x]))

    return rows.withColumn(out_col, run(F.col(ids_col)))
