"""Dashboard queries over the daily summary (filters, KPIs, SLA, alerts).

Means of ratios are unweighted over daily rows, as in the reference.  Means
whose value depends on summation order (ratios are not exact binary
fractions) are reported rounded to 9 decimals so results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import constants as K
from gridlens.functions import columns as C

ROUND = 9


def rmean(c: str, digits: int = ROUND) -> Column:
    return F.round(F.avg(c), digits)


# ---- F1-F3 filters --------------------------------------------------------

def filter_daily(daily: DataFrame, dates: tuple | None = None, bands: list | None = None,
                 locations: list | None = None, meters: list | None = None,
                 anomalies: list | None = None) -> DataFrame:
    """Inclusive date range plus optional IN-lists; None means "Select All"."""
    out = daily
    if dates is not None:
        lo, hi = dates
        out = out.where(F.col("date_").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    for col, vals in (("band_", bands), ("location_id_", locations),
                      ("meter_id_", meters), ("anomaly_category", anomalies)):
        if vals is not None:
            out = out.where(F.col(col).isin(*vals))
    return out


def filter_options(daily: DataFrame, dates: tuple | None = None, bands: list | None = None,
                   locations: list | None = None, meters: list | None = None) -> DataFrame:
    """Distinct non-null values offered by each filter (long form).  Options
    cascade: each list reflects the selections made in the filters before it
    (dates -> band -> location -> meter -> anomaly)."""
    rows, offered, open_ = filter_daily(daily, dates=dates), [], F.lit(True)
    # (offered field, the selection applied after offering it)
    for field, selected in (("band_", bands), ("location_id_", locations),
                            ("meter_id_", meters), ("anomaly_category", None)):
        value = F.when(open_, F.col(field).cast("string"))
        offered.append(F.struct(F.lit(field).alias("field"), value.alias("value")))
        if selected is not None:
            open_ = open_ & F.col(field).isin(*selected)
    # one scan: every row offers its four values
    return rows.select(F.explode(F.array(*offered)).alias("o")).select("o.*").where("value IS NOT NULL") \
        .distinct().orderBy("field", "value")


# ---- F4-F10 KPIs and rankings -----------------------------------------------

def kpi_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.coalesce(F.sum("total_vended_amount_sum"), F.lit(0.0)).alias("total_vended"),
        F.coalesce(F.sum("revenue_loss_sum"), F.lit(0.0)).alias("revenue_loss"),
        F.coalesce(F.sum("energy_loss_kwh_sum"), F.lit(0.0)).alias("energy_loss_kwh"),
        F.coalesce(F.round(F.avg("energy_efficiency_ratio") * 100, 6), F.lit(0.0)).alias("efficiency_pct"))


def kpi_formatted(daily: DataFrame) -> DataFrame:
    k = kpi_summary(daily)
    return k.select(*[C.format_metric(F.col(c)).alias(c + "_fmt")
                      for c in ("total_vended", "revenue_loss", "energy_loss_kwh")],
                    F.format_string("%.2f%%", F.bround("efficiency_pct", 2)).alias("efficiency_fmt"))


def top_efficiency(daily: DataFrame, n: int = 20, digits: int | None = None) -> DataFrame:
    """Top-n meters by mean efficiency (ties by meter id); a TakeOrdered.  ``digits`` rounds the mean
    before ranking, for results that must not depend on the order of summation."""
    mean = F.avg("energy_efficiency_ratio") if digits is None else rmean("energy_efficiency_ratio", digits)
    return daily.groupBy("meter_id_").agg(mean.alias("energy_efficiency_ratio")) \
        .where(F.col("energy_efficiency_ratio").isNotNull()) \
        .orderBy(F.col("energy_efficiency_ratio").desc(), "meter_id_").limit(n)


def top_efficiency_trend(daily: DataFrame, n: int = 20, digits: int | None = None) -> DataFrame:
    # the top-n table holds at most n rows, so broadcasting it is bounded
    top = F.broadcast(top_efficiency(daily, n, digits).select("meter_id_"))
    return daily.join(top, "meter_id_", "left_semi") \
        .select("meter_id_", "date_", "fault_type_", "energy_efficiency_ratio")


def location_kpis(daily: DataFrame) -> DataFrame:
    return daily.groupBy("location_id_").agg(
        F.avg("total_vended_amount_sum").alias("total_vended_amount_sum"),
        F.avg("revenue_loss_sum").alias("revenue_loss_sum"),
        F.avg("energy_loss_kwh_sum").alias("energy_loss_kwh_sum"),
        rmean("energy_efficiency_ratio").alias("energy_efficiency_ratio"),
        F.avg("anomaly_severity_score").alias("anomaly_severity_score"))


def top_by_vended(daily: DataFrame, key: str, n: int = 15) -> DataFrame:
    return daily.groupBy(key).agg(
        F.avg("total_vended_amount_sum").alias("total_vended_amount_sum"),
        F.avg("revenue_loss_sum").alias("revenue_loss_sum"),
        rmean("energy_efficiency_ratio").alias("energy_efficiency_ratio")) \
        .orderBy(F.col("total_vended_amount_sum").desc(), key).limit(n)


# ---- F11-F15 drill-down and alerts --------------------------------------------

DRILL_COLUMNS = ["meter_id_", "date_", "anomaly_category", "anomaly_severity_score",
                 "anomaly_summary_note", "location_id_", "feeder_id_", "transformer_id_",
                 "energy_efficiency_ratio", "energy_loss_ratio", "customer_risk_score_mean"]


def anomaly_drilldown(daily: DataFrame) -> DataFrame:
    return daily.select(*DRILL_COLUMNS)


def high_loss_cond() -> Column:
    return (F.col("revenue_loss_sum") > K.HIGH_LOSS_REVENUE) & (F.col("is_industrial_") == 1)


def sla_fail_cond() -> Column:
    return F.col("band_compliance_max") == 0


def burnt_cond() -> Column:
    return F.col("fault_type_") == "burnt_meter"


def alert_summary(daily: DataFrame) -> DataFrame:
    """Unique meters and summed revenue loss per alert subset: one row per meter, then one."""
    alerts = {"high_loss": high_loss_cond(), "sla_fail": sla_fail_cond(), "burnt": burnt_cond()}
    meters = daily.groupBy("meter_id_").agg(
        *[F.max(F.when(cond & F.col("meter_id_").isNotNull(), 1)).alias(name) for name, cond in alerts.items()],
        *[F.sum(F.when(cond, F.col("revenue_loss_sum"))).alias(f"{name}_loss") for name, cond in alerts.items()])
    return meters.agg(*[e for name in alerts for e in (
        F.count(name).alias(f"{name}_meters"), F.coalesce(F.sum(f"{name}_loss"), F.lit(0.0)).alias(f"{name}_loss"))])


# ---- F16-F20 SLA, map, series ---------------------------------------------------

def sla_by_band(daily: DataFrame) -> DataFrame:
    """SLA compliance rate per band (mean of band_compliance_max, and x100)."""
    return daily.groupBy("band_").agg(F.avg("band_compliance_max").alias("band_compliance_max")) \
        .withColumn("compliance_rate_pct", F.col("band_compliance_max") * 100)


def bands_dim(spark: SparkSession) -> DataFrame:
    """5-row band dimension (tariff, SLA hours)."""
    rows = [(b, float(K.TARIFF_BY_BAND[b]), K.SLA_HOURS_BY_BAND[b]) for b in K.BANDS]
    return spark.createDataFrame(rows, "band string, tariff_per_kwh double, sla_hours int")


def sla_delivery(daily: DataFrame) -> DataFrame:
    dim = F.broadcast(bands_dim(daily.sparkSession).select(
        F.col("band").alias("band_"), F.col("sla_hours").cast("double").alias("expected_sla_hours")))
    out = daily.join(dim, "band_", "left").groupBy("band_").agg(
        F.avg("supply_hours").alias("supply_hours"),
        F.avg("expected_sla_hours").alias("expected_sla_hours"))
    return out.withColumn("actual_vs_expected_pct",
                          C.safe_ratio(F.col("supply_hours"), F.col("expected_sla_hours")) * 100)


def sla_trend(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date_", "band_").agg(F.avg("band_compliance_max").alias("band_compliance_max")) \
        .withColumn("compliance_rate_pct", F.col("band_compliance_max") * 100)


def location_dim(spark: SparkSession) -> DataFrame:
    """Coordinates per location: a fixed grid over the service area."""
    rows = [(loc, 6.4 + 0.025 * i, 3.2 + 0.025 * i) for i, loc in enumerate(K.LOCATIONS)]
    return spark.createDataFrame(rows, "location_id_ string, lat double, lon double")


def location_map(daily: DataFrame) -> DataFrame:
    dim = F.broadcast(location_dim(daily.sparkSession))
    return daily.join(dim, "location_id_", "left").select(
        "meter_id_", "date_", "fault_type_", "location_id_", "lat", "lon",
        "anomaly_severity_score", "energy_efficiency_ratio", "anomaly_category",
        (F.abs(F.col("revenue_loss_sum")) + 1).alias("marker_size"))


def meter_series(daily: DataFrame, meter_id: str | None = None) -> DataFrame:
    """One meter's daily series; default meter = first in id order."""
    sel = F.lit(meter_id) if meter_id else None
    base = daily
    if sel is None:
        first = daily.agg(F.min("meter_id_").alias("__m"))
        base = daily.join(F.broadcast(first), F.col("meter_id_") == F.col("__m")).drop("__m")
    else:
        base = daily.where(F.col("meter_id_") == sel)
    return base.select("meter_id_", "date_", "fault_type_", "energy_efficiency_ratio",
                       "energy_loss_ratio", "revenue_loss_sum").orderBy("date_", "fault_type_")


def latest_partition(daily: DataFrame) -> DataFrame:
    """Rows of the latest date partition (scalar subquery on max)."""
    last = daily.agg(F.max("date_").alias("__d"))
    return daily.join(F.broadcast(last), F.col("date_") == F.col("__d")).drop("__d")
