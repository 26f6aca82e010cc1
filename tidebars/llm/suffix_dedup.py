"""Exact substring deduplication with collection suffix orders built column by column.

A byte is removed if a string of `window` bytes over it also starts in a document with a smaller doc_id. Suffixes only matter to
a depth of `window` bytes, so the corpus needn't be one collection: every window has one anchor, the k-mer in it of least hash
(the rightmost of equals), and windows with equal bytes have equal anchors. Of equal texts only the first goes on, since the
others repeat it whole. Anchors that occur in one text only can't repeat and go no further. Around each of the others a fragment
(all windows of that anchor) is dealt by the anchor, and each dealt part is a collection of short documents whose suffix order is
built as in external multi-document construction: one round for each column adds a symbol to every document at once, re-reading
the transform so far in sequence (one stable pass by symbol moves each suffix to its place and leaves room for the new ones);
neighbours' common prefixes of `window` bytes close the classes of equal windows, and each class has its least document.

Sizes: each text is written once, packed (see deals), and read there by each pass; anchors (about 2 in window - k + 2 bytes) are asked
about once a chunk, by 8 hash bits more than would number all bytes (a chance meeting only sends a fragment in vain), and
answered by a bit each; only the fragments of repeated ones are shuffled. A hot passage doesn't gather in a task: rows come
sorted by fragment and document, and all but the first of equal fragments are settled in their chunk, or else as they stream by;
only different fragments of an anchor are held. Long texts are searched in blocks that overlap.

Null texts are empty. A null doc_id counts as larger than any other. Rows with the same doc_id don't repeat each other. Other
columns of docs are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import cut, parts
from tidebars.llm.deals import answered, cuts_of, key_bits, packed_keys, ranked, rows_of, unpacked_keys, written
from tidebars.llm.line_dedup import grouped

WINDOW, K = 50, 16
BLOCK = 1 << 20
#: Different fragments that one collection holds at least, if there are as many.
COLLECTION = 512
#: Fragments handed on at once.
BATCH = 1 << 14
LAST = (1 << 63) - 1
END = 255  # no byte of UTF-8


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on; k is a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < k:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h)


def anchors(data: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first and last window start of each anchor."""
    out = []
    for lo in range(0, max(1, len(data) - window + 1), BLOCK):
        part = data[lo : lo + BLOCK + window - 1]
        n = len(part) - k + 1
        reach = window - k + 1  # k-mers in a window
        if len(part) < window:
            continue
        g = kmer_hashes(part, k)
        bits = np.uint64(21)  # the same in every block, so that equal windows have equal anchors
        low = (g >> bits << bits) | np.arange(n - 1, -1, -1, dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        starts = n - reach + 1
        best = np.minimum(low[:starts], low[reach - span : reach - span + starts])
        place = np.int64(n - 1) - (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], starts) - 1
        at = place[first]
        out.append((g[at], at + lo, first + lo, last + lo))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: document, place; then the joined bytes (an END before each document) and where each
    begins. The symbol before a suffix is then the byte before its place, whatever its document."""
    size = np.array([len(f) for f in fragments], np.int32)
    mark = bytes([END])
    flat = np.frombuffer(mark + mark.join(fragments), np.uint8)
    begin = np.concatenate(([1], np.cumsum(size[:-1] + 1, dtype=np.int32) + 1)).astype(np.int32)
    end = begin + size
    place = end  # the empty suffixes
    before = flat[end - 1]  # the transform: the symbol before each suffix
    for _ in range(int(size.max())):
        order = np.argsort(before, kind="stable")
        order = order[: len(order) - np.count_nonzero(before == END)]  # whole documents have nothing to add
        place = np.concatenate((end, place[order] - np.int32(1)))
        before = flat[place - 1]
    return np.searchsorted(begin, place, side="right") - 1, place, flat, begin


def least_documents(fragments: list[bytes], least: np.ndarray, window: int) -> np.ndarray:
    """[fragment, place]: the least document among all fragments that have the window of bytes at this place."""
    doc, place, flat, begin = suffix_order(fragments)
    size = np.array([len(f) for f in fragments])
    long = size[doc] - (place - begin[doc]) >= window
    doc, place = doc[long], place[long]
    width = int(size.max()) - window + 1
    out = np.full((len(fragments), width), LAST, np.int64)
    if not len(doc):
        return out
    bytes_ = np.lib.stride_tricks.sliding_window_view(flat, window)[place]
    new = np.concatenate(([True], (bytes_[1:] != bytes_[:-1]).any(axis=1)))
    low = np.minimum.reduceat(least[doc], np.flatnonzero(new))
    out[doc, place - begin[doc]] = low[np.cumsum(new) - 1]
    return out


def texts_at(blob: bytes, places: list[int]) -> tuple[list[bytes], list[int]]:
    """Of a chunk, the texts at these places, and their documents."""
    rows = rows_of(blob).take(pa.array(places, pa.int64()))
    return [t.encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()], rows.column("doc").to_pylist()


def sides(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, pa.StructArray]]:
    """Each chunk of the deals in a batch, with what is said of its deal."""
    for i in range(batch.num_rows):
        side = batch.column("side").slice(i, 1).flatten()
        if len(side):
            for c, blob in enumerate(batch.column("chunks")[i]):
                yield batch.column("deal")[i].as_py(), c, blob.as_buffer(), side


def of_chunk(side: pa.StructArray, c: int) -> pa.StructArray:
    return side.filter(pc.equal(side.field("c"), c))


def marks_of(deals: DataFrame) -> DataFrame:
    """(deal, c, i, doc, h1, h2): every text by deal, chunk and place there, with 128 bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for c, blob in enumerate(batch.column("chunks")[i]):
                    rows = rows_of(blob.as_buffer())
                    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in rows.column("text").to_pylist()]), np.int64).reshape(-1, 2)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("deal")[i].as_py())), pa.array(np.full(n, c, np.int32)), pa.array(np.arange(n, dtype=np.int32)), rows.column("doc").combine_chunks(), pa.array(h[:, 0]), pa.array(h[:, 1])], ["deal", "c", "i", "doc", "h1", "h2"])

    return deals.mapInArrow(run, "deal long, c int, i int, doc long, h1 long, h2 long")


def repeated(asked: DataFrame, window: int, k: int, bits: int, shift: int) -> DataFrame:
    """(deal, c, p, several): of each chunk's different anchors in bucket p, in order, which occur in more than one text."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for deal, c, blob, side in sides(batch):
                texts, _ = texts_at(blob, of_chunk(side, c).field("i").to_pylist())
                each = [np.unique(anchors(np.frombuffer(t, np.uint8), window, k)[0]) for t in texts]
                keys, n, _ = ranked(shortened(each, shift))
                cuts = cuts_of(keys, bits)
                made = [(p, deal, c, packed_keys(keys[a:b]), np.packbits(n[a:b] > 1).tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=["p", "deal", "c", "keys", "several"]), schema=ASKED, preserve_index=False)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in grouped(frames, ["p"]):
            made = []
            for p, g in f.groupby("p", sort=False):
                lists = [unpacked_keys(x) for x in g["keys"]]
                size = [len(x) for x in lists]
                _, n, at = ranked(np.concatenate(lists))
                more = n > 1
                more[at[np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(g["several"], size, strict=True)]) > 0]] = True
                for deal, c, x in zip(g["deal"], g["c"], np.split(more[at], np.cumsum(size)[:-1]), strict=True):
                    made.append((deal, c, p, np.packbits(x).tobytes()))
            yield pd.DataFrame(made, columns=["deal", "c", "p", "several"])

    rows = asked.mapInArrow(ask, "p int, deal long, c int, keys binary, several binary")
    return rows.repartition(parts(asked.sparkSession), "p").sortWithinPartitions("p").mapInPandas(meet, "deal long, c int, p int, several binary")


ASKED = pa.schema([("p", pa.int32()), ("deal", pa.int64()), ("c", pa.int32()), ("keys", pa.binary()), ("several", pa.binary())])
FRAGMENTS = pa.schema([("anchor", pa.int64()), ("fragment", pa.binary()), ("doc", pa.int64()), ("deal", pa.int64()), ("ci", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])


def shortened(each: list[np.ndarray], shift: int) -> np.ndarray:
    every = np.concatenate(each) if each else np.zeros(0, np.uint64)
    return every >> np.uint64(shift) << np.uint64(shift)


def fragment_rows(asked: DataFrame, window: int, k: int, bits: int, shift: int) -> DataFrame:
    """(anchor, fragment, doc, deal, ci, start, size) around the anchors that more than one text has; ci packs chunk and place there.
    Without a fragment: a run that is settled already, as a smaller document of the chunk has its bytes (dealt anywhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deal, c, blob, side in sides(batch):
                mine = of_chunk(side, c)
                places = mine.field("i").drop_null().to_pylist()
                told = mine.filter(pc.is_valid(mine.field("p")))
                texts, docs = texts_at(blob, places)
                found = [anchors(np.frombuffer(t, np.uint8), window, k) for t in texts]
                keys, _, at = ranked(shortened([x[0] for x in found], shift))
                more, cuts = np.zeros(len(keys), bool), cuts_of(keys, bits)
                for p, several in zip(told.field("p").to_pylist(), told.field("several").to_pylist(), strict=True):
                    a, b = cuts[p : p + 2]
                    more[a:b] = np.unpackbits(np.frombuffer(several, np.uint8), count=int(b - a)) > 0
                pick = np.split(more[at], np.cumsum([len(x[0]) for x in found])[:-1]) if found else []
                least: dict[bytes, int] = {}  # the least document of the chunk that has a fragment
                held, count = [], 0
                # the larger documents of a chunk settle their copies of a smaller one's fragments here
                for j in np.lexsort((places, docs)).tolist():
                    raw, doc, (h, _, lo, hi), some = texts[j], docs[j], found[j], pick[j]
                    h, lo, hi = h[some], lo[some], hi[some]
                    if len(h):
                        cut_out = [raw[a : b + window] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        size = np.fromiter(map(len, cut_out), np.int32)
                        pieces = [None if least.setdefault(x, doc) < doc else x for x in cut_out]
                        held.append((h.view(np.int64), pieces, doc, c << 32 | places[j], lo.astype(np.int32), size))
                        count += len(h)
                    if count >= BATCH:
                        yield fragment_batch(held, deal)
                        held, count = [], 0
                if held:
                    yield fragment_batch(held, deal)

    return asked.mapInArrow(run, "anchor long, fragment binary, doc long, deal long, ci long, start int, size int")


def fragment_batch(held: list[tuple], deal: int) -> pa.RecordBatch:
    size = [len(x[1]) for x in held]
    of = lambda i: pa.array(np.repeat(np.array([x[i] for x in held], np.int64), size))
    anchor, at = np.concatenate([x[0] for x in held]), np.concatenate([x[4] for x in held])
    pieces = pa.array([p for x in held for p in x[1]], pa.binary())
    anchor = np.where(pieces.is_null().to_numpy(zero_copy_only=False), mix(at.astype(np.uint64) + np.uint64(deal)).view(np.int64), anchor)
    columns = [pa.array(anchor), pieces, of(2), pa.array(np.full(len(at), deal, np.int64)), of(3), pa.array(at), pa.array(np.concatenate([x[5] for x in held]))]
    return pa.RecordBatch.from_arrays(columns, schema=FRAGMENTS)


def removed_intervals(fragments: DataFrame, window: int) -> DataFrame:
    """(deal, ci, start, size): runs of bytes that repeat a smaller document's."""
    n = parts(fragments.sparkSession)
    columns = ["deal", "ci", "start", "size"]

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        """The first rows of different fragments."""
        pieces = list(f["fragment"])
        docs = f["doc"].to_numpy()
        low = least_documents(pieces, docs, window)
        cut = low < docs[:, None]
        pad = np.zeros((len(cut), 1), bool)
        edge = np.diff(np.concatenate((pad, cut, pad), axis=1).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        return pd.DataFrame({"deal": f["deal"].to_numpy()[row], "ci": f["ci"].to_numpy()[row], "start": f["start"].to_numpy()[row] + first.astype(np.int32), "size": (past - first + window - 1).astype(np.int32)})

    def several(f: pd.DataFrame) -> pd.DataFrame:
        """Rows of whole anchors with different fragments in more than one document; others have nothing left to repeat."""
        if not len(f):
            return f
        a, d = f["anchor"].to_numpy(), f["doc"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        more = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        return f[np.repeat(more, np.diff(np.append(start, len(a))))]

    def settled(ready: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """In collections of whole anchors, about COLLECTION rows each."""
        rows = pd.concat(ready, ignore_index=True) if ready else None
        if rows is None or not len(rows):
            return
        a = rows["anchor"].to_numpy()
        begin = 0
        for at in [*np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)]:
            if at - begin >= COLLECTION or at == len(a):
                yield settle(rows.iloc[begin:at])
                begin = int(at)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # first rows of anchors that may go on
        ready: list[pd.DataFrame] = []  # those of whole anchors, too few for a collection
        count, waiting, last, last_doc = 0, 0, None, None
        for f in frames:
            done = f["fragment"].isna()
            if done.any():
                yield f.loc[done, columns]
                f = f[~done]
            if not len(f):
                continue
            anchor, piece, doc = f["anchor"].to_numpy(), f["fragment"].to_numpy(object), f["doc"].to_numpy()
            new = np.ones(len(f), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
            new[0] = last is None or (anchor[0], piece[0]) != last
            # the least document of each row's fragment: its first row's
            first = np.where(new, np.arange(len(f)), -1)
            first = np.maximum.accumulate(first)
            least = np.where(first >= 0, doc[np.maximum(first, 0)], last_doc if last_doc is not None else 0)
            last, last_doc = (anchor[-1], piece[-1]), least[-1]
            again = ~new & (doc > least)
            if again.any():
                size = np.fromiter(map(len, piece[again]), np.int32)
                yield pd.DataFrame({"deal": f["deal"].to_numpy()[again], "ci": f["ci"].to_numpy()[again], "start": f["start"].to_numpy()[again], "size": size})
            keep = f[~again]  # first rows, and rows of the same least document
            if len(keep):
                held.append(keep)
                count += len(keep)
            if count >= COLLECTION:
                rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                a = rows["anchor"].to_numpy()
                bounds = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                rest = rows.iloc[bounds[-1] :]  # may go on
                held, count = [rest], len(rest)
                ready.append(several(rows.iloc[: bounds[-1]]))
                waiting += len(ready[-1])
                if waiting >= COLLECTION:
                    yield from settled(ready)
                    ready, waiting = [], 0
        if count:
            ready.append(several(pd.concat(held, ignore_index=True)))
        yield from settled(ready)
        yield pd.DataFrame([], columns=columns).astype({"deal": "int64", "ci": "int64", "start": "int32", "size": "int32"})

    dealt = fragments.repartition(n, "anchor").sortWithinPartitions("anchor", "fragment", "doc")
    return dealt.mapInPandas(run, "deal long, ci long, start int, size int")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start and end of each span, bytes); with
    keep_text, the remaining bytes as kept."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.lit(0).alias("kind"))
    deals = written(src, "kind")
    total = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits, shift = key_bits(total, 2 * parts(spark)), max(0, 64 - 8 - int(total).bit_length())
    marks = cut(marks_of(deals))
    # of equal texts only the first goes on: the others repeat it whole
    firsts = marks.groupBy("h1", "h2").agg(F.min(F.struct("doc", "deal", "c", "i")).alias("p")).select("p.deal", "p.c", "p.i")
    texts = cut(firsts)
    told = repeated(answered(deals, texts), window, k, bits, shift)
    none = [F.lit(None).cast("int").alias("p"), F.lit(None).cast("binary").alias("several")]
    side = texts.select("deal", "c", "i", *none).unionByName(told.select("deal", "c", F.lit(None).cast("int").alias("i"), "p", "several"))
    cuts = removed_intervals(fragment_rows(answered(deals, side), window, k, bits, shift), window)
    place = F.shiftright("ci", 32).cast("int").alias("c"), F.col("ci").bitwiseAND(0xFFFFFFFF).cast("int").alias("i")
    spans = texts.select("deal", "c", "i", F.lit(-1).alias("start"), F.lit(0).alias("size")).unionByName(cuts.select("deal", *place, "start", "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c, blob, whole in sides(batch):
                mine = of_chunk(whole, c)
                i, start, size = (mine.field(x).to_numpy() for x in ("i", "start", "size"))
                order = np.lexsort((start, i))
                i, start, size = i[order], start[order].astype(np.int64), size[order]
                begin = np.flatnonzero(start < 0)  # each text's own row comes first
                texts, docs_ = texts_at(blob, i[begin].tolist())
                rows = []
                for raw, doc, a, b in zip(texts, docs_, begin + 1, np.append(begin[1:], len(i)), strict=True):
                    found: list[list[int]] = []
                    if b > a:
                        s, reach = start[a:b], np.maximum.accumulate(start[a:b] + size[a:b])
                        at = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
                        found = np.stack((s[at], reach[np.append(at[1:], len(s)) - 1]), axis=1).tolist()
                    kept, at = [], 0
                    for x, y in found:
                        kept.append(raw[at:x])
                        at = y
                    kept = b"".join([*kept, raw[at:]])
                    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()
                    row = h1, h2, doc, len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [x for p in found for x in p]
                    rows.append((*row, kept) if keep_text else row)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    names = ["h1", "h2", "least", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: 9 if keep_text else 8]
    kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.int64()), pa.binary()][: len(names)]
    first = answered(deals, spans).mapInArrow(run, ", ".join(f"{x} {t}" for x, t in zip(names, ["long"] * 6 + ["string", "array<long>", "binary"], strict=False)))
    joined = marks.select("doc", "h1", "h2").join(first, ["h1", "h2"])
    again = (F.col("doc") > F.col("least")) & (F.col("n_bytes") >= window)  # a copy: every window starts in the first one
    of_copy = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit("").cast("binary"), 256), "removed": F.array(F.lit(0).cast("long"), F.col("n_bytes")), "kept": F.lit("").cast("binary")}
    return joined.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_bytes", *[F.when(again, of_copy[x]).otherwise(F.col(x)).alias(x) for x in names[4:]])
