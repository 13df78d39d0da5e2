"""Cleaning and reading-level scalar operators on raw readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions import columns as C
from gridlens.operators.insights import bands_dim

PHASE_COLUMNS = ["v1", "v2", "v3", "i1", "i2", "i3"]


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows (aggregate with map-side partial dedup, so a row with
    many copies collapses before the shuffle)."""
    return df.dropDuplicates()


def fill_phases(df: DataFrame) -> DataFrame:
    present = [c for c in PHASE_COLUMNS if c in df.columns]
    return df.fillna(0.0, subset=present)


def preprocess_time(df: DataFrame) -> DataFrame:
    """hour, day_of_week (Monday=0), month."""
    ts = F.col("timestamp")
    return df.withColumns({"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)})


def early_loss_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("energy_loss_flag",
                         C.flag(F.col("energy_consumed_kwh") < F.col("expected_energy_kwh")))


def phase_aggregates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "v_agg_calc": C.phase_mean(F.col("phase_type"), F.col("v1"), F.col("v2"), F.col("v3"), F.col("v_agg")),
        "i_agg_calc": C.phase_mean(F.col("phase_type"), F.col("i1"), F.col("i2"), F.col("i3"), F.col("i_agg")),
    })


def tariff_lookup(df: DataFrame) -> DataFrame:
    """Tariff by band via a broadcast join to the 5-row band dimension."""
    dim = F.broadcast(bands_dim(df.sparkSession).select(
        "band", F.col("tariff_per_kwh").alias("band_tariff"), "sla_hours"))
    return df.join(dim, "band", "left")


def energy_from_vend(df: DataFrame) -> DataFrame:
    return df.withColumn("energy_from_vend",
                         F.round(C.safe_ratio(F.col("total_vended_amount"), C.tariff(F.col("band"))), 2))


def raw_fault(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "raw_fault_flag": C.raw_fault_flag(F.col("v_agg"), F.col("signal_strength_dbm")),
        "raw_fault_type": C.raw_fault_type(F.col("v_agg"), F.col("signal_strength_dbm")),
    })


def topology_violations(df: DataFrame) -> DataFrame:
    """Feeders serving more than one band; meters seen with more than one
    (location, feeder, transformer) or phase type."""
    none = F.lit(None).cast("string")

    def seen(rule, entity, a, b=none, c=none):
        return F.struct(F.lit(rule).alias("rule"), F.col(entity).alias("entity_id"), a.alias("a"), b.alias("b"), c.alias("c"))

    # one scan: every reading says what it has seen; equal sayings collapse before the shuffle
    said = df.select(F.explode(F.array(
        seen("feeder_multiple_bands", "feeder_id", F.col("band")),
        seen("meter_multiple_topology", "meter_id", *map(F.col, ("location_id", "feeder_id", "transformer_id"))),
        seen("meter_multiple_phase_types", "meter_id", F.col("phase_type")))).alias("s")).select("s.*")
    said = said.where("a IS NOT NULL OR rule = 'meter_multiple_topology'").distinct()
    return said.groupBy("rule", "entity_id").agg(F.count("*").alias("n_distinct")).where("n_distinct > 1")
