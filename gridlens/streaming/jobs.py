"""Structured Streaming jobs over the same Column builders.

S1  stateless tagging of a readings stream (row-local rules, append)
S2  daily tumbling rollup with a watermark (a day is emitted once the
    watermark passes its end; later rows for it are dropped)
S3  alert stream: foreachBatch over S2's closed days -> alerts table
S4  keyed state per meter (``transformWithStateInPandas``): rows wait for the watermark and
    leave in time order with holds, lags, rolling sum and day sums; chained with the
    day window it gives the whole daily summary as a stream

The keyed jobs need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).

Streams need a TIMESTAMP (with time zone) event-time column for watermarks;
``event_time`` reads the naive reading time as UTC, so day windows and dates
do not depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from gridlens import constants as K
from gridlens.functions import columns as C
from gridlens.operators.daily import measure_columns, with_kpis
from gridlens.operators.features import day_sums, derive, scalar_features, time_features
from gridlens.operators.timeline import with_date
from gridlens.sources.io import READING_SCHEMA


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(READING_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # event time = the naive reading time read as UTC, independent of the
    # session time zone (window boundaries then fall on the reading's midnight)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    return r.parquet(path).withColumn("event_time", F.timestamp_micros(micros))


# ---- S1 ----------------------------------------------------------------------

def tag_stream(readings: DataFrame) -> DataFrame:
    """Row-local features and the live anomaly tag (no lags in a stream)."""
    df = scalar_features(time_features(readings))
    df = df.withColumn("fault_type", C.fault_category(
        F.col("fault_flag"), F.col("signal_strength_dbm"), F.col("v_agg"), F.col("power_factor"),
        F.col("supply_voltage_flag"), F.col("energy_consumed_kwh")))
    return df.withColumns({
        "meter_anomaly_tag": C.reading_anomaly_tag(F.col("fault_flag"), F.col("tamper_flag"),
                                                   F.col("supply_outage_flag"), F.col("load_gap_flag")),
        "customer_risk_score": C.reading_risk_score(F.col("fault_flag"), F.col("tamper_flag"),
                                                    F.col("supply_outage_flag"), F.col("load_gap_flag")),
    })


# ---- S2 ----------------------------------------------------------------------

STREAM_KEYS = ["meter_id", "location_id", "feeder_id", "transformer_id", "band", "fault_type", "is_industrial"]


def daily_stream(tagged: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Tumbling 1-day rollup of stateless measures, append mode; rows with a
    NULL key are dropped, as in the batch rollup."""
    g = tagged.dropna(subset=STREAM_KEYS).withWatermark("event_time", watermark).groupBy(
        F.window("event_time", "1 day").alias("w"), *STREAM_KEYS)
    out = g.agg(
        *[F.sum(c).alias(f"{c}_sum") for c in ("energy_consumed_kwh", "expected_energy_kwh",
                                                "total_vended_amount", "revenue_loss", "energy_loss_kwh")],
        *[F.sum(c).cast("bigint").alias(f"{c}_sum") for c in ("energy_loss_flag", "fault_flag", "tamper_flag",
                                                              "uptime_flag", "supply_voltage_flag", "load_gap_flag")],
        F.avg("power_factor").alias("power_factor_mean"), F.min("power_factor").alias("power_factor_min"),
        F.avg("v_agg").alias("v_agg_mean"), F.count(F.lit(1)).alias("n_readings"))
    day = F.date_from_unix_date(F.floor(F.unix_micros(F.col("w.start")) / 86_400_000_000).cast("int"))
    out = out.select(day.alias("date_"),
                     *[F.col(k).alias(k + "_") for k in STREAM_KEYS], *[c for c in out.columns
                                                                      if c not in STREAM_KEYS and c != "w"])
    return out.withColumns({
        "fault_detected": C.flag(F.col("fault_flag_sum") > 0),
        "tamper_detected": C.flag(F.col("tamper_flag_sum") > 0),
        "energy_efficiency_ratio": C.safe_ratio(F.col("energy_consumed_kwh_sum"), F.col("expected_energy_kwh_sum")),
    })


# ---- S3 ----------------------------------------------------------------------

def alert_rows(batch: DataFrame) -> DataFrame:
    """Alert rows of one micro-batch of closed days (high loss, burnt meter, SLA
    failure).  All rows of a meter's day close in the same batch."""
    high = batch.where((F.col("revenue_loss_sum") > K.HIGH_LOSS_REVENUE) & (F.col("is_industrial_") == 1)) \
        .withColumn("alert", F.lit("high_loss"))
    burnt = batch.where(F.col("fault_type_") == "burnt_meter").withColumn("alert", F.lit("burnt_meter"))
    day = Window.partitionBy("meter_id_", "date_")
    met = F.col("hours") >= F.coalesce(C.sla_hours(F.col("band_")), F.lit(0))
    sla = (batch.withColumn("hours", F.sum("supply_voltage_flag_sum").over(day))
           .withColumn("met", F.max(C.flag(met)).over(day)).where("met = 0").withColumn("alert", F.lit("sla_fail")))
    return high.unionByName(burnt).unionByName(sla, allowMissingColumns=True).select("alert", "meter_id_", "date_", "fault_type_", "revenue_loss_sum")


def alert_sink(path: str):
    """Each batch has its own partition folder, so a retried batch replaces
    its alerts instead of adding them again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        alert_rows(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


# ---- S4 ----------------------------------------------------------------------

_DAY_MS = 86_400_000
_HOUR_US = 3_600_000_000
#: what a meter's next rows need of its past: the records in force, the last reading, the last held flags
_PAST_SCHEMA = ("f_us bigint, f_d int, f_ty string, t_us bigint, t_d int, last_pf double, last_status string, "
                "last_fault int, last_tamper int, flags array<int>")


def _ipc(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _last_record(on: np.ndarray) -> np.ndarray:
    """For each row the place of the last row at or before it where ``on`` holds, else -1."""
    return np.maximum.accumulate(np.where(on, np.arange(len(on)), -1))


def _shifted(values, first):
    return [first, *values[:-1]]


def scan_rows(rows: pd.DataFrame, past: tuple | None, rolling_n: int = K.ROLLING_READINGS) -> tuple[pd.DataFrame, tuple]:
    """One meter's rows in time order after ``past``: (rows with the timeline's columns, the new past).

    Forward fill by running maxima of positions, whole columns at a time."""
    f_us, f_d, f_ty, t_us, t_d, pf, status, fault, tamper, flags = past or (None,) * 9 + ([],)
    us = rows["us"].to_numpy(np.int64)

    def held(flag: str, hours: str, since, length):
        at = _last_record(rows[flag].to_numpy() == 1)
        own, d = at >= 0, rows[hours].to_numpy(dtype="float64", na_value=np.nan)
        t = np.where(own, us[at], since if since is not None else np.iinfo(np.int64).min // 2)
        d = np.where(own, d[at], length if length is not None else -1.0)
        # a record without a length never holds
        on = (own | (since is not None)) & (us - t <= np.nan_to_num(d, nan=-1.0) * _HOUR_US)
        return at, on, t, d

    f_at, f_on, f_t, f_len = held("fault_flag", "fault_duration_hours", f_us, f_d)
    t_at, t_on, t_t, t_len = held("tamper_flag", "tamper_duration_hours", t_us, t_d)
    types = rows["fault_type"].to_numpy(dtype=object)
    kind = np.where(f_at >= 0, types[f_at], f_ty)
    state = np.select([f_on, t_on, rows["data_transmitted"].to_numpy() == 0], ["faulty", "tampered", "inactive"], "healthy")
    past_flags = np.array([*flags, *f_on.astype(int)], np.int64)
    total = np.concatenate([[0], np.cumsum(past_flags)])
    ends = np.arange(len(flags) + 1, len(past_flags) + 1)
    out = rows.assign(
        fault_flag=f_on.astype("int32"), fault_type=np.where(f_on, kind, None),
        fault_duration_hours=np.where(f_on, f_len, 0).astype("int32"), tamper_flag=t_on.astype("int32"),
        tamper_duration_hours=np.where(t_on, t_len, 0).astype("int32"), meter_status=state,
        __prev_power_factor=_shifted(rows["power_factor"].tolist(), pf), __prev_meter_status=_shifted(state.tolist(), status),
        __prev_fault_flag=_shifted(f_on.astype(int).tolist(), fault), __prev_tamper_flag=_shifted(t_on.astype(int).tolist(), tamper),
        unresolved_fault_days=(total[ends] - total[np.maximum(ends - rolling_n, 0)]).astype("float64"))

    def record(at, t, length, since, d):
        return (int(t[-1]), None if np.isnan(length[-1]) else int(length[-1])) if at[-1] >= 0 else (since, d)

    last_pf = rows["power_factor"].iloc[-1]
    new = (*record(f_at, f_t, f_len, f_us, f_d), kind[-1] if f_at[-1] >= 0 else f_ty, *record(t_at, t_t, t_len, t_us, t_d),
           None if pd.isna(last_pf) else float(last_pf), str(state[-1]), int(f_on[-1]), int(t_on[-1]),
           [int(x) for x in past_flags[len(past_flags) - min(rolling_n - 1, len(past_flags)):]])
    return out, new


class MeterTimeline(StatefulProcessor):
    """Keyed by meter.  Rows wait until the watermark has passed the end of their day, then
    leave in time order with holds, lags, the rolling sum and the sums of the day."""

    def __init__(self, columns: list[str], sums: dict[str, str]):
        self.columns, self.sums = columns, sums

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.past = handle.getValueState("past", _PAST_SCHEMA)

    def _wake(self, rows: pd.DataFrame) -> None:
        self.handle.registerTimer((int(rows["us"].min()) // 1000 // _DAY_MS + 1) * _DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendValue((_ipc(pdf),))
                self._wake(pdf)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blobs = [pa.ipc.open_stream(raw).read_pandas() for (raw,) in self.waiting.get()]
        if not blobs:
            return
        rows = pd.concat(blobs, ignore_index=True)
        day = rows["us"] // 1000 // _DAY_MS
        closed = (day + 1) * _DAY_MS <= timerValues.getCurrentWatermarkInMs()
        self.waiting.clear()
        if not closed.all():
            left = rows[~closed]
            self.waiting.appendValue((_ipc(left),))
            self._wake(left)
        if not closed.any():
            return
        rows = rows[closed].sort_values(["us", "event_id"], kind="stable", ignore_index=True)
        day = rows["us"] // 1000 // _DAY_MS
        out, past = scan_rows(rows, self.past.get() if self.past.exists() else None)
        self.past.update(past)
        for name, how in self.sums.items():
            out[name] = rows.groupby(day)[name.strip("_")].transform(how)
        # rows may leave no earlier than the watermark: this is the event time for what follows
        out["released_at"] = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms", tz="UTC")
        yield out[self.columns]

    def close(self) -> None:
        pass


_TIMELINE = ("__prev_power_factor double, __prev_meter_status string, __prev_fault_flag int, __prev_tamper_flag int, "
             "unresolved_fault_days double")


def timeline_stream(readings: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """A stream of readings (``read_stream``) with the columns of ``timeline.meter_timeline`` and the
    day's sums.  A day leaves when the watermark has passed its end; rows that come later
    than the watermark are dropped, rows out of order before that change nothing.  Rows
    without a meter or a time are dropped.

    State per meter: the rows of its open days, one past record, the last n-1 flags."""
    sums = day_sums()
    rows = readings.dropna(subset=["meter_id", "timestamp"]).withWatermark("event_time", watermark).withColumns(
        # the rows that a processor gets have no names with a leading underscore
        {"us": F.unix_micros("event_time"), **{name.strip("_"): c for name, (_, c) in sums.items()}})
    given = [f for f in rows.schema.fields if f.name in readings.columns and f.name != "event_time"]
    schema = StructType([*given, StructField("released_at", TimestampType()), *StructType.fromDDL(_TIMELINE), *StructType.fromDDL(", ".join(f"{name} bigint" for name in sums))])
    columns = [f.name for f in schema]
    return rows.groupBy("meter_id").transformWithStateInPandas(
        MeterTimeline(columns, {name: how for name, (how, _) in sums.items()}), schema, "Append", "EventTime",
        eventTimeColumnName="released_at")


HOLD_COLUMNS = ["meter_id", "event_id", "timestamp", "fault_flag", "fault_type", "tamper_flag", "meter_status"]


def hold_stream(readings: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Per-meter holds and status edges, in time order."""
    df = timeline_stream(readings, watermark)
    edge = lambda c: ((F.col(c) == 1) & (F.coalesce(F.col(f"__prev_{c}"), F.lit(0)) == 0)).cast("int")
    return df.select(*HOLD_COLUMNS, (~F.col("meter_status").eqNullSafe(F.col("__prev_meter_status"))).alias("status_change"),
                     edge("fault_flag").alias("fault_start"), edge("tamper_flag").alias("tamper_start"))


def daily_summary_stream(readings: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """The whole daily summary as a stream: the timeline's keyed state feeds the engineered
    columns and a second keyed operator, the rollup.  A meter's day is released as a whole, so
    its groups are closed when the watermark reaches their release.  A closed day equals
    ``daily.daily_summary`` on every column."""
    rows = derive(with_date(timeline_stream(readings, watermark)), extra=("released_at",))
    out = rows.dropna(subset=K.DAILY_KEYS).groupBy("released_at", *[F.col(k).alias(k + "_") for k in K.DAILY_KEYS])
    return with_kpis(out.agg(*measure_columns()).drop("released_at"))
