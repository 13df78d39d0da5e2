"""Malformed values are rejected, never read as NULL; NaN is NULL; dates day first."""
import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from gridlens.sources import io as IO

DAILY = T.StructType([T.StructField("meter_id_", T.StringType()), T.StructField("date_", T.DateType()),
                      T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())])


def _csv(folder, lines, header="meter_id_,date_,loss,n"):
    path = os.path.join(folder, "d.csv")
    with open(path, "w") as f:
        f.write("\n".join([header, *lines]) + "\n")
    return path


def test_daily_dates_numbers_and_rejects(spark, tmpdir_path):
    good = ["A,2024-01-05,1.5,2", "B,05/01/2024,NaN,3.0", "C,5-1-2024,nan,", "D,31/12/2024 00:00:00,-2e3,4", "E,2024-02-01 00:00:00,,5"]
    bad = ["F,01/31/2024,1,1", "G,2024-13-01,1,1", "H,2024-01-05,x,1", "I,2024-01-05,1,1.5", "J,2024-01-05,1", "K,2024-01-05,1,1,1",
           "L,soon,y,z"]
    rows, rejected = IO.scan_csv(spark, _csv(tmpdir_path, good + bad), DAILY)
    day = dt.date(2024, 1, 5)
    assert rows.schema == DAILY
    assert sorted(map(tuple, rows.collect())) == [
        ("A", day, 1.5, 2), ("B", day, None, 3), ("C", day, None, None), ("D", dt.date(2024, 12, 31), -2000.0, 4),
        ("E", dt.date(2024, 2, 1), None, 5)]
    assert rows.count() == 5 and rejected.count() == 7
    why = {r["meter_id_"]: r["reason"] for r in rejected.collect()}
    assert sorted(why) == list("FGHIJKL")
    assert why["F"] == "unreadable: date_" and why["L"] == "unreadable: date_, loss, n" and why["J"].startswith("fields")
    with pytest.raises(ValueError, match="can't be read"):
        IO.read_daily(spark, _csv(tmpdir_path, good + bad[:1]), DAILY)
    assert IO.read_daily(spark, _csv(tmpdir_path, good), DAILY).count() == 5


def test_readings_fail_on_a_malformed_timestamp(spark, tmpdir_path):
    names = IO.READING_SCHEMA.names
    blank = dict.fromkeys(names, "")
    line = lambda **v: ",".join((blank | v)[n] for n in names)
    good = [line(meter_id="a", timestamp="2024-01-05 10:00:00.5", v1="NaN"), line(meter_id="b", timestamp="2024-01-05T10:00:00", v1="2")]
    path = _csv(tmpdir_path, good, ",".join(names))
    got = sorted((r["meter_id"], r["timestamp"], r["v1"]) for r in IO.read_readings(spark, path).collect())
    assert got == [("a", dt.datetime(2024, 1, 5, 10, 0, 0, 500000), None), ("b", dt.datetime(2024, 1, 5, 10), 2.0)]
    for stamp in ("2024-01-05 25:00:00", "05.01.2024 10:00", "2024-01-05 10:00:00+02:00"):
        path = _csv(tmpdir_path, [*good, line(meter_id="c", timestamp=stamp)], ",".join(names))
        assert IO.scan_csv(spark, path, IO.READING_SCHEMA)[1].count() == 1
        with pytest.raises(ValueError, match="timestamp"):
            IO.read_readings(spark, path)
        with pytest.raises(ValueError, match="timestamp"):
            IO.compact(spark, path, os.path.join(tmpdir_path, "out"))


def test_nan_in_parquet_is_null(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "p")
    spark.createDataFrame([("A", None, float("nan"), 1), ("B", None, 2.0, 1)], DAILY).write.parquet(path)
    assert sorted((r["meter_id_"], r["loss"]) for r in IO.read_daily(spark, path, DAILY, "parquet").collect()) == [("A", None), ("B", 2.0)]
