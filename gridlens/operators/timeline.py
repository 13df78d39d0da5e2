"""Per-meter sequential rules as a segmented prefix scan over each meter's time.

The reference computes fault/tamper holds, lags and a 24-reading rolling sum over each
meter's whole time series, and sums over each meter-day.  A window partitioned by
``meter_id`` alone would put a hot meter (assume one holds a third of all rows) into a
single task.  Here a *segment* is a meter-day; a meter-day with more than
``SEGMENT_ROWS`` readings is cut into several, at quantiles of its event time (``day_cuts``):

1. readings are hash-partitioned once by segment and sorted by time inside it; all row
   windows run inside that layout;
2. a *carry table* (one row per segment, aggregated without another exchange) holds the
   state that leaves the segment: the last raw fault/tamper record, the last
   reading, the last n-1 readings, and the segment's share of the day's sums;
3. a window over the carry table (by meter, in time order) combines the states of all earlier
   segments - last record wins, the last n-1 flags are kept - into what enters each one, and
   another (by meter-day) adds up the day's sums;
4. the carry table joins back on the segment.

Combining states is associative, so where the cuts lie never changes a result.  Readings of
one meter at the same microsecond stay in one segment.

Hold rule: after a raw fault at t0 with duration d, later readings stay
faulted (same type/duration) while ``ts - t0 <= d`` hours; a newer raw
fault replaces the record.  That is "the last raw fault at or before the
reading, if still within its duration".  Tamper works the same way.

Rows without a meter or a time belong to no segment: nothing is carried to them, and
their day sums are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens import constants as K
from gridlens.functions import columns as C

METER = "meter_id"
DAY = "date"
SEGMENT = "__segment"
_US_PER_HOUR = 3_600_000_000

#: Readings of a meter-day that one task takes; larger days are cut.
SEGMENT_ROWS = 1_000_000
#: All cuts together, so that they can be broadcast: a segment has
#: ``readings / MOST_CUTS`` readings where that is more than ``SEGMENT_ROWS``.
MOST_CUTS = 10_000

_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp)"


def day_cuts(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame | None:
    """(meter_id, date, cuts) of the meter-days with more than ``segment_rows`` readings;
    None where no day can have as many.  ``rows`` has meter_id, timestamp."""
    total = rows.count()
    most = max(segment_rows, total // MOST_CUTS)
    if total <= most:
        return None
    rows = with_date(rows).select(METER, DAY, "timestamp")
    days = rows.groupBy(METER, DAY).agg(F.count("*").alias("n")).where(F.col("n") > most)  # at most MOST_CUTS rows
    days = days.where(f"{METER} IS NOT NULL AND {DAY} IS NOT NULL")
    steps = f"transform(sequence(1, CAST(ceil(first(n) / {most}) AS INT) - 1), i -> i / ceil(first(n) / {most}))"
    # the quantiles' places differ by day; the sketch is read at 1/1000 steps, and each cut takes the nearest
    grid = ", ".join(repr(i / 1000) for i in range(1001))
    sketched = rows.join(F.broadcast(days), [METER, DAY]).groupBy(METER, DAY).agg(
        F.expr(f"percentile_approx({_MICROS}, array({grid}), 10000)").alias("at"), F.expr(steps).alias("places"))
    cuts = sketched.select(METER, DAY, F.expr(
        "array_sort(array_distinct(transform(places, p -> element_at(at, CAST(round(p * 1000) AS INT) + 1))))").alias("cuts"))
    return cuts.checkpoint(eager=True) if days.limit(1).count() else None


def segmented(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """``rows`` with ``date`` and, if there are cuts, ``__segment``: the cuts at or before the reading."""
    rows = with_date(rows)
    if cuts is None:
        return rows
    place = F.expr(f"CAST(coalesce(size(filter(cuts, c -> c <= {_MICROS})), 0) AS INT)")
    return rows.join(F.broadcast(cuts), [METER, DAY], "left").withColumn(SEGMENT, F.greatest(place, F.lit(0))).drop("cuts")


def layout(rows: DataFrame) -> list[str]:
    """The columns that tell segments apart."""
    return [METER, DAY] + ([SEGMENT] if SEGMENT in rows.columns else [])


def with_date(readings: DataFrame) -> DataFrame:
    if DAY in readings.columns:
        return readings
    return readings.withColumn(DAY, F.to_date("timestamp"))


def within(ts: Column, rec: Column) -> Column:
    """True when a hold record exists and ``ts`` is within its duration.
    Elapsed time is measured on the naive timestamps (no time-zone or DST
    shift from the session zone)."""
    elapsed = F.timestamp_diff("MICROSECOND", rec["t"], ts)
    return F.coalesce(rec.isNotNull() & (elapsed <= rec["d"].cast("bigint") * _US_PER_HOUR), F.lit(False))


def _within_sql(ts: str, rec: str) -> str:
    return (f"coalesce(({rec}) IS NOT NULL AND timestampdiff(MICROSECOND, ({rec}).t, {ts}) "
            f"<= CAST(({rec}).d AS BIGINT) * {_US_PER_HOUR}, false)")


def _status_sql(fault: str, tamper: str, tx: str) -> str:
    """faulty > tampered > inactive > healthy."""
    return (f"CASE WHEN {fault} THEN 'faulty' WHEN {tamper} THEN 'tampered' "
            f"WHEN {tx} = 0 THEN 'inactive' ELSE 'healthy' END")


# The plan is written as SQL expression strings: a handful of selectExpr
# calls instead of thousands of Column-builder calls.
def meter_timeline(readings: DataFrame, rolling_n: int = K.ROLLING_READINGS,
                   prepartitioned: bool = False, day_sums: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Readings (+ ``date``) with holds applied, ``meter_status`` recomputed,
    ``__prev_{power_factor,meter_status,fault_flag,tamper_flag}`` (previous
    reading of the meter) and ``unresolved_fault_days`` (rolling sum of the
    held fault flag over ``rolling_n`` readings, min_periods=1).

    ``day_sums``: name -> (``sum`` or ``min``, column of a reading), totals of the reading's
    meter-day.  ``prepartitioned``: the caller has hash-partitioned by ``layout(readings)``."""
    base = with_date(readings)
    cols, day_sums = [c for c in base.columns if c != SEGMENT], day_sums or {}
    keys = layout(base)
    if not prepartitioned:
        base = base.repartition(*keys)
    wd = "PARTITION BY " + ", ".join(keys)
    w = wd + " ORDER BY timestamp, event_id"
    run = w + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cw = "PARTITION BY meter_id ORDER BY " + ", ".join(keys[1:])
    before = cw + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    w1 = base.selectExpr(
        "*", f"row_number() OVER ({w}) AS __rn",
        "last(CASE WHEN fault_flag = 1 THEN named_struct('t', timestamp, 'd', fault_duration_hours, "
        f"'ty', fault_type) END, true) OVER ({run}) AS __f_in",
        "last(CASE WHEN tamper_flag = 1 THEN named_struct('t', timestamp, 'd', tamper_duration_hours) END, true) "
        f"OVER ({run}) AS __t_in",
        f"count(1) OVER ({wd}) AS __n_day")

    # ---- carry table: one row per segment ----------------------------------
    day = w1.groupBy(*keys).agg(
        F.expr("max_by(named_struct('t', timestamp, 'pf', power_factor, 'tx', data_transmitted, "
               "'f', __f_in, 'tm', __t_in), named_struct('ts', timestamp, 'id', event_id)) AS __last"),
        F.expr(f"collect_list(CASE WHEN __n_day - __rn < {rolling_n - 1} THEN named_struct("
               "'timestamp', timestamp, 'event_id', event_id, 'rec', __f_in) END) AS __tail"),
        *[(F.sum if how == "sum" else F.min)(c).alias(name) for name, (how, c) in day_sums.items()])
    whole = [f"`{name}`" if len(keys) == 2 else f"{how}(`{name}`) OVER (PARTITION BY meter_id, date) AS `{name}`"
             for name, (how, _) in day_sums.items()]
    sums = [f"`{name}`" for name in day_sums]
    c1 = day.selectExpr(
        *keys, *whole, "__tail",
        f"last(__last.f, true) OVER ({before}) AS __f_carry",
        f"last(__last.tm, true) OVER ({before}) AS __t_carry",
        f"lag(__last) OVER ({cw}) AS __prev_last")
    # The record in force at the previous segment's last reading is exactly this
    # segment's carry-in, so the previous reading's held values follow directly.
    pf_on = _within_sql("__prev_last.t", "__f_carry")
    pt_on = _within_sql("__prev_last.t", "__t_carry")
    held_tail = ("array_sort(transform(__tail, x -> named_struct('timestamp', x.timestamp, 'event_id', x.event_id, "
                 f"'v', CAST({_within_sql('x.timestamp', 'coalesce(x.rec, __f_carry)')} AS BIGINT))))")
    c2 = c1.selectExpr(
        *keys, *sums, "__f_carry", "__t_carry",
        "CASE WHEN __prev_last IS NOT NULL THEN __prev_last.pf END AS __c_pf",
        f"CASE WHEN __prev_last IS NOT NULL THEN CAST({pf_on} AS INT) END AS __c_fault",
        f"CASE WHEN __prev_last IS NOT NULL THEN CAST({pt_on} AS INT) END AS __c_tamper",
        f"CASE WHEN __prev_last IS NOT NULL THEN {_status_sql(pf_on, pt_on, '__prev_last.tx')} END AS __c_status",
        f"{held_tail} AS __held_tail")
    hist = (f"array_sort(flatten(collect_list(__held_tail) OVER ({cw} ROWS BETWEEN {rolling_n - 1} PRECEDING "
            "AND 1 PRECEDING)))" if rolling_n > 1 else "CAST(NULL AS ARRAY<STRUCT<v: BIGINT>>)")
    carry = c2.selectExpr(
        *keys, *sums, "__f_carry", "__t_carry", "__c_pf", "__c_fault", "__c_tamper", "__c_status",
        f"{hist} AS __hist")

    # ---- back to readings ---------------------------------------------------
    j = w1.join(carry, keys, "left")
    f_rec, t_rec = "coalesce(__f_in, __f_carry)", "coalesce(__t_in, __t_carry)"
    f_on, t_on = _within_sql("timestamp", f_rec), _within_sql("timestamp", t_rec)
    replaced = {
        "fault_flag": f"CAST({f_on} AS INT)",
        "fault_type": f"CASE WHEN {f_on} THEN ({f_rec}).ty END",
        "fault_duration_hours": f"CAST(CASE WHEN {f_on} THEN ({f_rec}).d ELSE 0 END AS INT)",
        "tamper_flag": f"CAST({t_on} AS INT)",
        "tamper_duration_hours": f"CAST(CASE WHEN {t_on} THEN ({t_rec}).d ELSE 0 END AS INT)",
        "meter_status": _status_sql(f_on, t_on, "data_transmitted"),
    }
    keep = ["__rn", "__c_pf", "__c_fault", "__c_tamper", "__c_status", "__hist"]
    h = j.selectExpr(*[f"{replaced[c]} AS {c}" if c in replaced else f"`{c}`" for c in cols], *keys[2:], *sums, *keep)
    n = rolling_n
    from_before = (f"CASE WHEN __rn < {n} AND __hist IS NOT NULL THEN aggregate(slice(__hist, "
                   f"greatest(size(__hist) - ({n} - __rn) + 1, 1), {n} - __rn), CAST(0 AS BIGINT), "
                   "(acc, x) -> acc + x.v) ELSE CAST(0 AS BIGINT) END")
    return h.selectExpr(
        *[f"`{c}`" for c in cols], *sums,
        f"CASE WHEN __rn = 1 THEN __c_pf ELSE lag(power_factor) OVER ({w}) END AS __prev_power_factor",
        f"CASE WHEN __rn = 1 THEN __c_status ELSE lag(meter_status) OVER ({w}) END AS __prev_meter_status",
        f"CASE WHEN __rn = 1 THEN __c_fault ELSE lag(fault_flag) OVER ({w}) END AS __prev_fault_flag",
        f"CASE WHEN __rn = 1 THEN __c_tamper ELSE lag(tamper_flag) OVER ({w}) END AS __prev_tamper_flag",
        f"CAST(sum(fault_flag) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) + {from_before} "
        "AS DOUBLE) AS unresolved_fault_days")


HOLD_OUTPUT = ["fault_flag", "fault_type", "fault_duration_hours", "tamper_flag",
               "tamper_duration_hours", "meter_status"]


def apply_holds(readings: DataFrame, prepartitioned: bool = False) -> DataFrame:
    """Readings (+ date) with fault/tamper holds and recomputed meter_status."""
    cols = with_date(readings).columns
    return meter_timeline(readings, prepartitioned=prepartitioned).select(*cols)
