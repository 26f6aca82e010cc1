"""The bar engine: every query with SQL against DuckDB, and small frames against loops."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

from tidebars.functions import rolling as R
from tidebars.operators import labels
from tidebars.operators import recurrence as S
from tidebars.plans import queries as Q
from tidebars.sources import bars as B

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return str(pd.Timestamp(x)) if isinstance(x, (dt.datetime, pd.Timestamp)) else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all((p is None) == (q is None) and (p == q if not isinstance(p, float) else math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5)) for p, q in zip(x, y, strict=True)), (x, y)


def made(spark, closes, symbol="a", spread=1.0):
    start = dt.datetime(2024, 1, 1)
    out = [(symbol, start + dt.timedelta(minutes=30 * i), *((None,) * 4 if c is None else (c, c + spread, c - spread, c)), 10.0) for i, c in enumerate(closes)]
    return B.numbered(spark.createDataFrame(out, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_exponential_mean_lets_gaps_decay(spark):
    x = [1.0, None, 3.0, 4.0]
    want, y, w = [], None, 1.0
    for v in x:
        w *= 2 / 3 if y is not None else 1
        if v is not None:
            y = v if y is None else (w * y + v / 3) / (w + 1 / 3)
            w = 1.0
        want.append(y)
    df = S.scan(made(spark, x), [S.Scan(("y",), lambda: S.Mean("close", S.Ewm(1 / 3, 1)))])
    assert column(df, "y") == pytest.approx(want)


def test_rsi_is_unknown_when_nothing_fell(spark):
    df = S.scan(made(spark, [100.0 + i for i in range(30)]), [S.Scan(("rsi",), S.Rsi)])
    assert set(column(df, "rsi")) == {None}


def test_symbols_do_not_mix(spark):
    both = made(spark, [1.0, 2.0, 3.0]).unionByName(made(spark, [10.0, 20.0, 30.0], "b"))
    df = S.scan(both, [S.ema("e", 1)])
    assert column(df, "e") == [1.0, 2.0, 3.0, 10.0, 20.0, 30.0]


@pytest.mark.parametrize("query", Q.MACHINES, ids=lambda q: q.__name__)
def test_machines_take_flat_zero_and_missing_prices(spark, query, monkeypatch):
    monkeypatch.setattr(B, "event_bars", lambda *_: made(spark, [5.0] * 30 + [0.0, None, 1e-9, 1e9, 0.0]))
    assert query(spark, "").count() == 35


def test_bars_since_and_runs(spark):
    df = made(spark, [1.0, 5.0, 5.0, 1.0, 5.0])
    up = df["close"] > 3
    df = df.withColumns({"since": R.bars_since(up), "run": R.run_length(up)})
    assert column(df, "since") == [None, 0, 0, 1, 0]
    assert column(df, "run") == [0, 1, 2, 0, 1]


def barrier(spark, path):
    df = made(spark, [100.0] * len(path)).drop("high", "low")
    hl = spark.createDataFrame([(i + 1, h, x) for i, (h, x) in enumerate(path)], "rn int, high double, low double")
    df = df.join(hl, "rn").selectExpr("*", "1.0D AS atr_14")
    return labels.triple_barrier(df, 2.0, 2.0, 3).orderBy("rn").first()


@pytest.mark.parametrize(
    ("path", "label", "held"),
    [
        ([(101, 99), (101, 99), (102, 99), (101, 99)], labels.LONG, 2),
        ([(101, 99), (101, 97), (103, 99), (101, 99)], labels.SHORT, 1),
        ([(101, 99), (103, 97), (101, 99), (101, 99)], labels.SHORT, 1),
        ([(101, 99)] * 4, labels.NEUTRAL, 3),
        ([(101, 99)] * 3, labels.NONE, 3),
    ],
)
def test_barriers(spark, path, label, held):
    row = barrier(spark, [(float(h), float(x)) for h, x in path])
    assert (row["label"], row["holding_bars"]) == (label, held)


def test_coarse_bars_never_look_ahead(spark):
    from tidebars.operators.timeframes import join_closed

    bars = made(spark, [float(i) for i in range(24)])
    df = join_closed(bars, B.resample(bars, 14400).withColumnRenamed("close", "coarse"), 14400, ["coarse"])
    assert column(df, "coarse") == [None] * 8 + [7.0] * 8 + [15.0] * 8


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string")
    assert sorted(r["v"] for r in B.keep_last(df, ["k"], [df["n"]]).collect()) == ["b", "c"]


def test_empty_bars(spark):
    empty = made(spark, [1.0]).where("false")
    assert S.scan(empty, [S.ema("e", 9)]).count() == 0
    assert B.resample(empty, 14400).count() == 0
