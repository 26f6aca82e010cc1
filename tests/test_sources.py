"""Archives and stored bars."""

import zipfile

from tidebars.sources import klines, store


def test_months(spark):
    assert [tuple(r) for r in klines.months(spark, "2023-11-15", "2024-02-01").collect()] == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]


def test_zips_with_header_microseconds_and_repeats(spark, tmp_path):
    body = {
        "a": "open_time,open,high,low,close,volume\n1700000000000,1,2,0.5,1.5,10,0,0,0,0,0,0\n",
        "b": "1700000000000000,1,2,0.5,1.5,10\n1700000000000000,3,4,2.5,3.5,20\nbroken\n",
        "c": "",
    }
    for name, text in body.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", text)
    got = sorted((r["path"][-5:], r["timestamp"], r["open"], r["volume"]) for r in klines.read_zips(spark, str(tmp_path)).collect())
    assert got == [("a.zip", 1700000000000, 1.0, 10.0), ("b.zip", 1700000000000, 3.0, 20.0)]


def test_store_round_trip_and_merge(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert store.read_bars(spark, path).count() == 0
    old = spark.createDataFrame([("x", 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("x", 2, 2.0, 2.0, 2.0, 2.0, 2.0)], store.SCHEMA)
    new = spark.createDataFrame([("x", 2, 9.0, 9.0, 9.0, 9.0, 9.0), ("y", 1, 5.0, 5.0, 5.0, 5.0, 5.0)], store.SCHEMA)
    store.write_bars(old, path)
    out = store.merged(store.read_bars(spark, path), new)
    assert sorted((r["symbol"], r["timestamp"], r["open"]) for r in out.collect()) == [("x", 1, 1.0), ("x", 2, 9.0), ("y", 1, 5.0)]
    assert [r["timestamp"] for r in store.read_bars(spark, path, "x", 2, 2).collect()] == [2]
    assert {r["symbol"]: r["timestamp"] for r in store.high_water(old.unionByName(new)).collect()} == {"x": 2, "y": 1}
