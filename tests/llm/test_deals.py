import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import deals as D
from tidebars.llm import interpolation, suffix_dedup


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1, 0, 5], list(range(300)), [2**40] * 7])
def test_packed_numbers_come_back(values):
    x = np.array(values, np.uint64)
    assert D.unpacked(D.packed(x)).tolist() == values
    assert D.unpacked_keys(D.packed_keys(np.sort(x))).tolist() == sorted(values)


@pytest.mark.parametrize("total", [0, 10**9, 10**12, 10**14])
def test_plans_hold_at_any_size(total):
    """Buckets stay under Spark's limit, and a bucket of keys under its bound; bucket and order fit an int."""
    assert 8 <= D.deal_buckets(total, D.DEAL_BYTES, 8, 100_000) <= 100_000
    bits = D.key_bits(total, 16)
    assert total <= D.KEY_BYTES << bits and 4 <= bits <= 28


def test_rows_are_dealt_once(spark, docs_of):
    rows = docs_of([(i, "ab " * (i * 37 % 400)) for i in range(200)])
    deals = D.written(rows.select("text", "doc_id", (F.col("doc_id") % 3).cast("int").alias("kind")), "kind", 2000, 6000)
    found = [(r.kind, d, t) for r in deals.collect() for b in r.chunks for d, t in zip(*(D.rows_of(b).column(c).to_pylist() for c in ("doc_id", "text")), strict=True)]
    assert sorted((d, t) for _, d, t in found) == sorted((r.doc_id, r.text) for r in rows.collect())
    assert all(d % 3 == k for k, d, _ in found)
    assert deals.count() > 3 and deals.select("deal").distinct().count() == deals.count()


def test_clashing_columns_are_left_alone(docs_of):
    rows = docs_of([(1, "a b c " * 30), (2, "a b c " * 30), (None, None)]).selectExpr("*", "1 AS part", "2 AS kind", "3 AS deal", "'x' AS side", "4 AS doc", "5 AS chunks", "6 AS least")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(rows).collect()} == {1: 0, 2: 180, None: 0}
    assert interpolation.score(rows).count() == 3
