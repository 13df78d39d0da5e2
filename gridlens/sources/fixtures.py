"""Meter readings derived from the driver's ``events`` table.

Every event becomes one hourly-style meter reading.  All measures are built
with integer arithmetic on event columns and then scaled by powers of two,
so they are dyadic fractions: sums are exact in any order and Spark agrees
bit-for-bit with the DuckDB oracle (``plans/sql_base.py`` holds the same
rules as SQL; FIXTURES.md documents them).

Per event:  e = event_id, u = user_id, k = the integer inside ``props``,
c = value in cents.  Meter attributes depend on u only, so each meter has
one phase type / location / feeder / transformer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlens import constants as K
from gridlens.operators import timeline


def _arr(values: list) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + ")"


def _in(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# The rules are Spark SQL expression strings: the whole fixture is built with
# three ``selectExpr`` calls instead of thousands of Column-builder calls.
_BASE = [
    "event_id", "ts AS timestamp", "user_id AS u", "event_type",
    "coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS k",
    "CAST(round(value * 100, 0) AS BIGINT) AS c",
    "concat('MTR_', lpad(CAST(user_id AS STRING), 6, '0')) AS meter_id",
]

_STAGED = [
    "event_id", "timestamp", "event_type", "u", "k", "c", "meter_id",
    "CASE WHEN u % 3 <> 0 THEN 'three' ELSE 'single' END AS phase_type",
    f"element_at({_arr(K.LOCATIONS)}, CAST(u % {len(K.LOCATIONS)} + 1 AS INT)) AS location_id",
    "u % 41 + 1 AS feeder_no",
    "concat('DMG_', lpad(CAST(u % 173 + 1 AS STRING), 4, '0')) AS transformer_id",
    "CAST(5 * (38 + (event_id * 7 + k) % 11) AS DOUBLE) AS v_agg",
    "((event_id % 9) - 4) / 4 AS dv",
    "(25 * (1 + (event_id * 5 + c) % 64)) / 32 AS i_agg",
    "((event_id % 5) - 2) / 8 AS di",
    "(1 + (event_id * 3 + k * 7 + u) % 64) / 64 AS power_factor",
    "CAST(-(30 + (event_id * 11 + u) % 71) AS DOUBLE) AS signal_strength_dbm",
    "((event_id * 13 + c) % 41) / 4 AS expected_energy_kwh",
]

_TARIFF = "CASE band " + " ".join(f"WHEN '{b}' THEN CAST({K.TARIFF_BY_BAND[b]} AS DOUBLE)" for b in K.BANDS) + " END"

_BANDED = [
    "*",
    "concat('FDR_', lpad(CAST(feeder_no AS STRING), 3, '0')) AS feeder_id",
    f"location_id IN {_in(K.INDUSTRIAL_LOCATIONS)} AS industrial_loc",
    f"CASE WHEN location_id IN {_in(K.INDUSTRIAL_LOCATIONS)} THEN 'A' "
    f"ELSE element_at({_arr(K.BANDS)}, CAST(feeder_no % 5 + 1 AS INT)) END AS band",
    f"v_agg < {K.SUPPLY_VOLTAGE} AS low_v",
    f"signal_strength_dbm < {K.MODEM_DBM} AS modem",
    "event_type = 'error' AND k < 15 AS tamper",
]

_READING = [
    "meter_id", "event_id", "phase_type", "timestamp",
    "CASE WHEN phase_type = 'three' THEN v_agg + dv END AS v1",
    "CASE WHEN phase_type = 'three' THEN v_agg - dv END AS v2",
    "CASE WHEN phase_type = 'three' THEN v_agg END AS v3",
    "CASE WHEN phase_type = 'three' THEN i_agg + di END AS i1",
    "CASE WHEN phase_type = 'three' THEN i_agg - di END AS i2",
    "CASE WHEN phase_type = 'three' THEN i_agg END AS i3",
    "v_agg", "i_agg", "power_factor",
    "(expected_energy_kwh * (12 + (event_id + k) % 6)) / 16 AS energy_consumed_kwh",
    "expected_energy_kwh", "signal_strength_dbm",
    "CASE WHEN (event_id * 3 + k) % 20 = 0 THEN 0 ELSE 1 END AS data_transmitted",
    "CAST(tamper AS INT) AS tamper_flag",
    "CAST(CASE WHEN tamper THEN 12 + (event_id * 7 + k) % 36 ELSE 0 END AS INT) AS tamper_duration_hours",
    "CAST(low_v OR modem AS INT) AS fault_flag",
    "CASE WHEN low_v AND modem THEN 'voltage + modem' WHEN low_v THEN 'low_voltage' "
    "WHEN modem THEN 'modem_disconnect' END AS fault_type",
    "CAST(CASE WHEN low_v OR modem THEN CASE WHEN industrial_loc THEN 6 + event_id % 18 "
    "ELSE 24 + event_id % 48 END ELSE 0 END AS INT) AS fault_duration_hours",
    "CASE WHEN low_v OR modem THEN 'faulty' WHEN tamper THEN 'tampered' "
    "WHEN (event_id * 3 + k) % 20 = 0 THEN 'inactive' ELSE 'healthy' END AS meter_status",
    f"CAST(element_at({_arr(K.READING_GAPS)}, CAST(event_id % 3 + 1 AS INT)) AS INT) AS reading_gap_minutes",
    "location_id", "feeder_id", "transformer_id", "band",
    f"{_TARIFF} AS tariff_per_kwh",
    "CASE WHEN industrial_loc THEN 100000.0D + CAST(((event_id * 97 + c) % 19601) * 250 AS DOUBLE) "
    f"ELSE CAST(element_at({_arr(K.VEND_AMOUNTS)}, CAST((event_id + k) % 6 + 1 AS INT)) AS DOUBLE) END "
    "AS total_vended_amount",
]


def readings_from_events(events: DataFrame, partition_by_meter_day: bool = False,
                         segment_rows: int = timeline.SEGMENT_ROWS) -> DataFrame:
    """Readings for each event.  With ``partition_by_meter_day`` the narrow
    event columns are hash-partitioned by the segments of ``timeline`` first and the
    reading columns are derived after the shuffle (a much narrower exchange;
    the output also carries ``date`` and, where days are cut, ``__segment``)."""
    base, extra = events.selectExpr(*_BASE), []
    if partition_by_meter_day:
        base = timeline.segmented(base, timeline.day_cuts(base, segment_rows))
        extra = timeline.layout(base)[1:]
        base = base.repartition("meter_id", *extra)
    staged = base.selectExpr(*_STAGED, *extra).selectExpr(*_BANDED)
    return staged.selectExpr(*_READING, *extra).selectExpr(
        *READING_NAMES, "round(total_vended_amount / tariff_per_kwh, 2) AS expected_energy_from_vend", *extra)


READING_NAMES = ["meter_id", "event_id", "phase_type", "timestamp", "v1", "v2", "v3", "i1", "i2", "i3",
                 "v_agg", "i_agg", "power_factor", "energy_consumed_kwh", "expected_energy_kwh",
                 "signal_strength_dbm", "data_transmitted", "tamper_flag", "tamper_duration_hours",
                 "fault_flag", "fault_type", "fault_duration_hours", "meter_status", "reading_gap_minutes",
                 "location_id", "feeder_id", "transformer_id", "band", "tariff_per_kwh", "total_vended_amount"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str, partition_by_meter_day: bool = False) -> DataFrame:
    """Raw readings (pre-hold) for a test-data directory."""
    return readings_from_events(events(spark, sf_dir), partition_by_meter_day)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
