"""Daily meter summary: group aggregation of engineered readings.

One global ``groupBy`` (Spark does partial + final aggregation).  The keys
contain ``(meter_id, date)``, so after ``engineer`` the aggregate reuses the
readings' partitioning and adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens import constants as K
from gridlens.functions import columns as C

SUMS = ["energy_consumed_kwh", "expected_energy_kwh", "expected_energy_pf_calc",
        "total_vended_amount", "revenue_loss", "tamper_cost_estimate", "energy_loss_kwh"]
FLAG_SUMS = ["energy_loss_flag", "fault_flag", "tamper_flag", "uptime_flag", "supply_voltage_flag"]
MEANS = ["pf_delta", "load_generation_gap"]
MEANS_2 = ["service_availability_ratio", "unresolved_fault_days", "customer_risk_score"]


def measure_columns():
    """Aggregations in the reference's column order, flattened as <col>_<agg>."""
    aggs = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum") for c in SUMS]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_sum") for c in FLAG_SUMS]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in MEANS]
    aggs += [F.coalesce(F.sum("load_gap_flag"), F.lit(0)).cast("bigint").alias("load_gap_flag_sum")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in MEANS_2]
    aggs += [F.avg("power_factor").alias("power_factor_mean"), F.min("power_factor").alias("power_factor_min")]
    for c in ("v_agg", "i_agg"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    aggs += [F.avg("tariff_per_kwh").alias("tariff_per_kwh_mean"),
             F.max("band_compliance").alias("band_compliance_max")]
    return aggs


def rollup(engineered: DataFrame) -> DataFrame:
    """Aggregate only (E1-E6): keys flattened with a trailing underscore;
    rows with a NULL key are dropped (pandas groupby semantics)."""
    out = engineered.dropna(subset=K.DAILY_KEYS).groupBy(*[F.col(k).alias(k + "_") for k in K.DAILY_KEYS]).agg(*measure_columns())
    return out


# ---- E6: partial aggregates that merge ---------------------------------------

_MEANS = MEANS + MEANS_2 + ["power_factor", "v_agg", "i_agg", "tariff_per_kwh"]
_TOTALS = SUMS + FLAG_SUMS + ["load_gap_flag"]
_LEAST, _MOST = ["power_factor", "v_agg", "i_agg"], ["v_agg", "i_agg", "band_compliance"]


def partials(engineered: DataFrame, *tags: str) -> DataFrame:
    """One row per group of the rollup (and ``tags``) with what merges: sums and counts,
    minima and maxima.  Partials of any split of the readings give the rollup of them all."""
    keys = [F.col(k).alias(k + "_") for k in K.DAILY_KEYS]
    return engineered.dropna(subset=K.DAILY_KEYS).groupBy(*keys, *tags).agg(
        *[F.sum(c).alias(f"{c}__sum") for c in _TOTALS + _MEANS], *[F.count(c).alias(f"{c}__n") for c in _MEANS],
        *[F.min(c).alias(f"{c}__min") for c in _LEAST], *[F.max(c).alias(f"{c}__max") for c in _MOST])


def merge(parts: DataFrame) -> DataFrame:
    """Partials with one row per group: associative, so merged partials merge again."""
    keys = [k + "_" for k in K.DAILY_KEYS]
    how = {"sum": F.sum, "n": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy(*keys).agg(*[how[c.rpartition("__")[2]](c).alias(c) for c in parts.columns if "__" in c])


def finish(parts: DataFrame) -> DataFrame:
    """The rollup's columns from merged partials."""
    total = lambda c: F.coalesce(F.col(f"{c}__sum"), F.lit(0.0 if c in SUMS else 0)).alias(f"{c}_sum")
    mean = lambda c: F.try_divide(F.col(f"{c}__sum").cast("double"), F.col(f"{c}__n")).alias(f"{c}_mean")
    at = lambda c, end: F.col(f"{c}__{end}").alias(f"{c}_{end}")
    return parts.select(
        *[k + "_" for k in K.DAILY_KEYS], *map(total, SUMS + FLAG_SUMS), *map(mean, MEANS), total("load_gap_flag"),
        *map(mean, MEANS_2), mean("power_factor"), at("power_factor", "min"),
        *[e for c in ("v_agg", "i_agg") for e in (mean(c), at(c, "min"), at(c, "max"))], mean("tariff_per_kwh"),
        at("band_compliance", "max"))


def kpi_exprs() -> dict:
    """E7-E11 derived columns as composed expressions."""
    fault_d = C.flag(F.col("fault_flag_sum") > 0)
    tamper_d = C.flag(F.col("tamper_flag_sum") > 0)
    cat = C.daily_anomaly_category(fault_d, tamper_d, F.col("energy_loss_flag_sum"), F.col("load_gap_flag_sum"))
    score = C.daily_severity(fault_d, tamper_d, F.col("energy_loss_flag_sum"), F.col("load_gap_flag_sum"),
                             F.col("service_availability_ratio_mean"))
    return {
        "fault_detected": fault_d,
        "tamper_detected": tamper_d,
        "energy_loss_ratio": C.safe_ratio(F.col("energy_loss_kwh_sum"), F.col("expected_energy_kwh_sum")),
        "supply_hours": F.col("supply_voltage_flag_sum"),
        "uptime_hours": F.col("uptime_flag_sum"),
        "energy_efficiency_ratio": C.safe_ratio(F.col("energy_consumed_kwh_sum"), F.col("expected_energy_kwh_sum")),
        "anomaly_category": cat,
        "anomaly_severity_score": score,
        "anomaly_summary_note": C.daily_note(cat, score),
    }


def with_kpis(agg: DataFrame) -> DataFrame:
    return agg.select("*", *[v.alias(k) for k, v in kpi_exprs().items()])


def daily_summary(engineered: DataFrame) -> DataFrame:
    return with_kpis(rollup(engineered))
