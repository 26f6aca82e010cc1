"""Language-model scores by deleted interpolation.

Tokens are lower-cased words and one end token a text. A token's probability mixes the maximum-likelihood estimate of its trigram
(two start marks stand before a text) into that of its bigram, that into its share of all tokens, and that into a uniform
distribution over known words. Words that training hasn't seen are one token, new, with the share that such words have among
held-out tokens. The weights of bigrams and trigrams depend on how often the context occurs (a bucket for each power of two). All
weights are learned by expectation-maximisation on counts held out from the estimates: those of training documents with
crc32 mod 7 = 3. The final estimates then use all training documents.

Gathering: texts are dealt out once (see deals). Each chunk sends its different n-grams with their counts, packed, to where all
chunks' counts of them meet; the sums go back to each chunk that has the n-gram, unless it is the only one. No table is cut
and none goes through the driver: it gets sums by bucket and by hundredth of a decade only. Words are known by 64 bits of hash,
longer n-grams by 20 bits more than would number all bytes.

Null and empty texts are one end token; a long text is a chunk of its own. A null doc_id is in no held-out part and is trained on.
Equal rows count as often as they occur. Other columns of docs are ignored. Every row gives one row.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import UPPER_TO_LOWER, crc_mod, parts, shared_dir
from tidebars.llm.deals import CHUNK_BYTES, answered, cuts_of, key_bits, packed, packed_keys, ranked, rows_of, unpacked, unpacked_keys, written
from tidebars.llm.line_dedup import grouped

END = "\n"
BATCH_BYTES = CHUNK_BYTES
BUCKETS = 64
ORDERS = (1, 2, 3)
START = np.uint64(0x5BD1E9955BD1E995)
#: Hashes of words: a random number for each byte value, times powers of a factor by place in the word.
OF_BYTE = np.random.default_rng(5).integers(0, 2**63, 256, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LAST = 0xFF  # no byte of UTF-8: the end of a text
BLOCK = 1 << 19


def weight_by_em(ratio: np.ndarray, count: np.ndarray, rounds: int = 60) -> float:
    """The share of the higher estimate: ratio is it over the lower one, by held-out event."""
    total = count.sum()
    share = 0.5
    if total <= 0:
        return share
    for _ in range(rounds):
        new = float((count * (share * ratio / (share * ratio + 1 - share))).sum() / total)
        if abs(new - share) < 1e-7:
            break
        share = new
    return min(max(share, 1e-4), 1 - 1e-4)


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return finished(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F))


def powers(n: int) -> np.ndarray:
    out = np.full(n, FACTOR, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token, and the number of tokens of each text."""
    found, size = [], []
    blocks, held = [[]], 0
    for t in texts:
        if held > BLOCK:
            blocks, held = [*blocks, []], 0
        blocks[-1].append(t)
        held += len(t)
    for block in blocks:
        raw = b"".join([t.encode("utf-8", "surrogatepass") + b"\xff" for t in block])
        data = np.frombuffer(raw.translate(UPPER_TO_LOWER), np.uint8)
        if not len(data):
            continue
        last, space = data == LAST, SPACES[data]
        begins = ~space
        begins[1:] &= space[:-1] | last[:-1] | last[1:]
        first = np.flatnonzero(begins)
        place = np.arange(len(data)) - first[np.maximum(np.cumsum(begins) - 1, 0)]
        place[space] = 0
        value = OF_BYTE[data] * powers(int(place.max()) + 1)[place]
        value[space] = 0
        found.append(finished(np.add.reduceat(value, first)))
        ends = np.flatnonzero(last[first]) + 1
        size.append(np.diff(ends, prepend=0))
    none = np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(size)) if found else (none.view(np.uint64), none)


def keyed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams that end at each token, for the orders 1 to 3, and the tokens of each text. Before a text stand two start
    marks."""
    w, size = token_hashes(texts)
    first = np.cumsum(size) - size
    before = np.concatenate(([START], w[:-1]))
    before[first] = START
    two = mixed(before, w)
    context = np.concatenate(([START], two[:-1]))
    context[first] = mixed(np.array([START]), np.array([START]))[0]
    return [w, two, mixed(context, w)], size


class Chunk:
    """Of each order: the different keys (`keys`), their counts here (`here`) and each token's place among them (`at`); size: tokens of
    each text; main, held: counts in the corpus, those of this chunk until answer() adds to them. shift: bits that longer n-grams'
    keys leave out."""

    def __init__(self, rows: pa.Table, kind: int, shift: int):
        self.rows = rows
        keys, self.size = keyed(rows.column("text").to_pylist())
        self.first = np.cumsum(self.size) - self.size
        counts = np.repeat(rows.column("part").to_numpy() != 0, self.size)
        self.keys, self.at, here = [], [], []
        for order, key in zip(ORDERS, keys, strict=True):
            unique, _, at = ranked(key if order == 1 else key >> np.uint64(shift) << np.uint64(shift))
            self.keys.append(unique)
            self.at.append(at)
            here.append(np.bincount(at[counts], minlength=len(unique)))
        none = [np.zeros_like(x) for x in here]
        self.here = here
        self.main, self.held = (none, here) if kind else (here, none)

    def answer(self, told: list[dict], bits: int) -> Chunk:
        main, held = ([x.copy() for x in y] for y in (self.main, self.held))
        cuts = [cuts_of(k, bits) for k in self.keys]
        for x in told:
            order, bucket = x["p"] & 3, x["p"] >> 2
            a, b = cuts[order - 1][bucket : bucket + 2]
            some = np.flatnonzero(np.unpackbits(np.frombuffer(x["several"], np.uint8), count=int(b - a))) + a
            main[order - 1][some], held[order - 1][some] = unpacked(x["main"]), unpacked(x["held"])
        self.main, self.held = main, held
        return self

    def counts(self, held: bool = False) -> np.ndarray:
        """(order, token); with held, those of both parts."""
        return np.stack([(m + h if held else m)[at] for m, h, at in zip(self.main, self.held, self.at, strict=True)])


class Model:
    """tokens, words, texts: counts of training; new: share of tokens that it hasn't seen; shares: for orders 2 and 3, of the own
    estimate, by context-frequency bucket (a power of two); share: of order 1."""

    def __init__(self, tokens: int, words: int, texts: int, new: float, share: float, shares: list[np.ndarray]):
        self.tokens, self.words, self.texts, self.new, self.share, self.shares = tokens, words, texts, new, share, shares

    def contexts(self, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every token, for orders 2 and 3: the context's count and bucket. count: (order, token)."""
        x = np.empty((2, count.shape[1]), np.int64)
        x[:, 1:] = count[:2, :-1]
        x[:, first] = self.texts
        return x, np.minimum(np.log2(np.maximum(x, 1)).astype(int), BUCKETS - 1)

    def probabilities(self, count: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of every token, with as many orders as there are shares for."""
        known = (1 - self.new) * (self.share * count[0] / max(self.tokens, 1) + (1 - self.share) / max(self.words, 1))
        p = np.where(count[0] > 0, known, self.new)
        x, bucket = self.contexts(count, first)
        for i, shares in enumerate(self.shares):
            share = np.where(x[i] > 0, shares[bucket[i]], 0.0)
            p = share * count[i + 1] / np.maximum(x[i], 1) + (1 - share) * p
        return p


def step_of(ratio: np.ndarray) -> np.ndarray:
    """Hundredths of a decade: EM's events are summed by them, so what reaches the driver is bounded."""
    return np.round(100 * np.log10(np.maximum(ratio, 1e-300))).astype(np.int64)


def counted_rows(steps: Counter) -> pd.DataFrame:
    made = pd.DataFrame(list(steps), columns=["bucket", "step"], dtype="int64")
    return made.assign(n=np.array(list(steps.values()), np.int64))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. batch_bytes: of a chunk's texts."""
    spark = docs.sparkSession
    mod = F.coalesce(crc_mod(id_col, 7), F.lit(0))
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.when(mod == 2, 0).when(mod == 3, 1).otherwise(2).alias("part"))
    total, main_texts, held_texts = src.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)), F.count_if(F.col("part") == 2), F.count_if(F.col("part") == 1)).first()
    deals = written(src.withColumn("kind", (F.col("part") == 1).cast("int")), "kind", batch_bytes, 3 * batch_bytes)
    bits = key_bits(total, 2 * parts(spark))
    shift = max(0, 64 - 20 - int(total).bit_length())

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each different n-gram of a chunk, once, with its count there; p is bucket and order."""
        for f in frames:
            for deal, kind, blobs in zip(f["deal"], f["kind"], f["chunks"], strict=True):
                for c, blob in enumerate(blobs):
                    chunk = Chunk(rows_of(blob), kind, shift)
                    for order in ORDERS:
                        keys, here = chunk.keys[order - 1], chunk.here[order - 1]
                        cuts = cuts_of(keys, bits)
                        made = [(b << 2 | order, deal, c, kind, packed_keys(keys[x:y]), packed(here[x:y])) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                        yield pd.DataFrame(made, columns=["p", "deal", "c", "kind", "keys", "n"])

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each chunk's entries of a bucket: which of them other chunks have too, and these ones' counts in the corpus. In deal -1 sums
        over words, in -2 held-out tokens by step of the main count."""
        sums, steps = np.zeros(5, np.int64), Counter()
        for f in grouped(frames, ["p"]):
            for p, g in f.groupby("p", sort=False):
                lists = [unpacked_keys(x) for x in g["keys"]]
                size = np.array([len(x) for x in lists])
                n = np.concatenate([unpacked(x) for x in g["n"]]).astype(np.int64)
                keys, entries, at = ranked(np.concatenate(lists))
                held_row = np.repeat(g["kind"].to_numpy() == 1, size)
                main, held = (np.bincount(at[x], n[x], len(keys)).astype(np.int64) for x in (~held_row, held_row))
                if p & 3 == 1:
                    sums += [main.sum(), held.sum(), (main > 0).sum(), (main + held > 0).sum(), held[main == 0].sum()]
                    both = (main > 0) & (held > 0)
                    for k, c in zip(step_of(main[both]).tolist(), held[both].tolist(), strict=True):
                        steps[k] += c
                several, made = entries > 1, []
                for mine, deal, c in zip(np.split(at, np.cumsum(size)[:-1]), g["deal"], g["c"], strict=True):
                    shared = several[mine]
                    if shared.any():
                        made.append((deal, c, p, np.packbits(shared).tobytes(), packed(main[mine[shared]]), packed(held[mine[shared]]), 0))
                yield pd.DataFrame(made, columns=["deal", "c", "p", "several", "main", "held", "sum"])
        told = [(-1, 0, i, b"", b"", b"", x) for i, x in enumerate(sums.tolist())] + [(-2, 0, k, b"", b"", b"", c) for k, c in steps.items()]
        yield pd.DataFrame(told, columns=["deal", "c", "p", "several", "main", "held", "sum"])

    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    rows = deals.mapInPandas(gathered, "p int, deal long, c int, kind int, keys binary, n binary")
    rows = rows.repartition(parts(spark), "p").sortWithinPartitions("p").mapInPandas(met, "deal long, c int, p int, several binary, main binary, held binary, sum long")
    rows.write.option("compression", "uncompressed").parquet(folder)
    counts = spark.read.parquet(folder)
    told = counts.where("deal < 0").groupBy("deal", "p").agg(F.sum("sum").alias("n")).collect()
    main_n, held_tokens, main_words, words, unseen = (next((r.n for r in told if (r.deal, r.p) == (-1, i)), 0) for i in range(5))
    share, new = 0.5, 0.5 / (main_n + held_tokens + 1)
    if main_n and held_tokens:
        new = (unseen + 0.5) / (held_tokens + 1)
        steps = [(r.p, r.n) for r in told if r.deal == -2]
        share = weight_by_em(np.array([10.0 ** (k / 100) * main_words / main_n for k, _ in steps]), np.array([c for _, c in steps], float))
    model = Model(main_n, main_words, main_texts, new, share, [])
    complete = answered(deals, counts.where("deal >= 0").select("deal", "c", "p", "several", "main", "held"))

    def chunks_of(batch: pa.RecordBatch) -> Iterator[Chunk]:
        for i in range(batch.num_rows):
            side = batch.column("side")[i].as_py() or []
            kind = batch.column("kind")[i].as_py()
            for c, blob in enumerate(batch.column("chunks")[i]):
                yield Chunk(rows_of(blob.as_buffer()), kind, shift).answer([x for x in side if x["c"] == c], bits)

    for order in (2, 3):  # each is learned over the orders below

        def events(batches: Iterator[pa.RecordBatch], order=order, model=model) -> Iterator[pa.RecordBatch]:
            """Held-out tokens with a known context: by its bucket and the step of the order's estimate over that of the orders below."""
            steps = Counter()
            for batch in batches:
                for chunk in chunks_of(batch):
                    main = chunk.counts()
                    below = model.probabilities(main, chunk.first)
                    x, bucket = (v[order - 2] for v in model.contexts(main, chunk.first))
                    some = x > 0
                    pairs = np.stack((bucket[some], step_of(main[order - 1][some] / x[some] / below[some])))
                    found, n = np.unique(pairs, axis=1, return_counts=True)
                    for b, s, k in zip(*found.tolist(), n.tolist(), strict=True):
                        steps[b, s] += k
            yield pa.RecordBatch.from_pandas(counted_rows(steps), preserve_index=False)

        got = complete.where("kind = 1").mapInArrow(events, "bucket long, step long, n long").groupBy("bucket", "step").agg(F.sum("n").alias("n")).toPandas()
        ratio, count, where = 10.0 ** (got["step"].to_numpy(float) / 100), got["n"].to_numpy(float), got["bucket"].to_numpy(int)
        out = np.full(BUCKETS, weight_by_em(ratio, count))
        for b in np.unique(where):
            out[b] = weight_by_em(ratio[where == b], count[where == b])
        model = Model(main_n, main_words, main_texts, new, share, [*model.shares, out])
    final = Model(main_n + held_tokens, words, main_texts + held_texts, new, share, model.shares)
    base = math.log10(final.tokens + final.words + 1)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks_of(batch):
                count, first = chunk.counts(held=True), chunk.first
                p = np.log10(final.probabilities(count, first))
                plain = np.log10(count[0] + 1.0) - base
                sums = [np.add.reduceat(x, first) for x in ((count[0] > 0).astype(np.int64), plain, p)]
                yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id").combine_chunks(), pa.array(chunk.size, pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = complete.mapInArrow(scores, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(final.tokens).cast("long").alias("train_tokens"), "base_score", "score")
