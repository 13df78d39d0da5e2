"""Reusable Column builders (JVM-side expressions, no Python UDFs).

Each function returns a ``Column``; batch operators and streaming jobs share
them, so a rule is written once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens import constants as K


def flag(cond: Column) -> Column:
    """0/1 int flag; a comparison with NULL counts as False (pandas semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def lookup(mapping: dict, key: Column, cast: str | None = None) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = m[key]
    return out.cast(cast) if cast else out


def tariff(band: Column) -> Column:
    return lookup(K.TARIFF_BY_BAND, band, "double")


def sla_hours(band: Column) -> Column:
    return lookup(K.SLA_HOURS_BY_BAND, band, "int")


def meter_status(fault: Column, tamper: Column, transmitted: Column) -> Column:
    """faulty > tampered > inactive > healthy."""
    return (F.when(fault == 1, "faulty").when(tamper == 1, "tampered")
            .when(transmitted == 0, "inactive").otherwise("healthy"))


def raw_fault_flag(v_agg: Column, signal: Column) -> Column:
    return flag((v_agg < K.SUPPLY_VOLTAGE) | (signal < K.MODEM_DBM))


def raw_fault_type(v_agg: Column, signal: Column) -> Column:
    low_v, modem = v_agg < K.SUPPLY_VOLTAGE, signal < K.MODEM_DBM
    return (F.when(low_v & modem, "voltage + modem").when(low_v, "low_voltage")
            .when(modem, "modem_disconnect"))


def phase_mean(phase_type: Column, a: Column, b: Column, c: Column, supplied: Column) -> Column:
    """(a+b+c)/3 for three-phase meters, else the supplied aggregate."""
    return F.when(phase_type == "three", (a + b + c) / 3).otherwise(supplied)


def fault_category(fault_flag: Column, signal: Column, v_agg: Column, pf: Column,
                   supply_flag: Column, consumed: Column) -> Column:
    """Engineered fault type, first matching rule wins."""
    cat = (F.when(signal < K.MODEM_DBM, "modem_fault")
           .when(v_agg < K.SUPPLY_VOLTAGE, "voltage_drop")
           .when(pf < K.BURNT_PF, "burnt_meter")
           .when((supply_flag == 1) & (consumed < K.RELAY_KWH), "relay_fault")
           .otherwise("no_fault"))
    return F.when(F.coalesce(fault_flag, F.lit(0)) != 0, cat).otherwise("no_fault")


def tag_list(pairs: list[tuple[Column, str]], empty: str = "normal") -> Column:
    """Comma list of the tags whose condition holds, in order; ``empty`` if none."""
    joined = F.concat_ws(",", *[F.when(cond, F.lit(tag)) for cond, tag in pairs])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty))


def reading_anomaly_tag(fault: Column, tamper: Column, outage: Column, gap: Column) -> Column:
    return tag_list([(fault == 1, "fault"), (tamper == 1, "tamper"),
                     (outage == 1, "outage"), (gap == 1, "mismatch")])


def reading_risk_score(fault: Column, tamper: Column, outage: Column, gap: Column) -> Column:
    return fault * 1.5 + tamper * 2 + outage + gap


def daily_anomaly_category(fault_detected: Column, tamper_detected: Column,
                           loss_sum: Column, gap_sum: Column) -> Column:
    return tag_list([(fault_detected == 1, "fault"), (tamper_detected == 1, "tamper"),
                     (loss_sum > 0, "loss"), (gap_sum > 0, "mismatch")])


def daily_severity(fault_detected: Column, tamper_detected: Column, loss_sum: Column,
                   gap_sum: Column, availability_mean: Column) -> Column:
    return (fault_detected * 3 + tamper_detected * 4 + loss_sum * 2 + gap_sum * 2
            + flag(availability_mean < 0.5)).cast("bigint")


def daily_note(category: Column, score: Column) -> Column:
    return F.when(category == "normal", F.lit("No issue detected")).otherwise(
        F.concat(F.lit("Detected: "), category, F.lit(" | Risk="), score.cast("string")))


def format_metric(value: Column) -> Column:
    """"12.34M" / "5.67K" / "1,234" display string (round half to even)."""
    return (F.when(value >= 1_000_000, F.format_string("%.2fM", F.bround(value / 1_000_000, 2)))
            .when(value >= 1_000, F.format_string("%.2fK", F.bround(value / 1_000, 2)))
            .otherwise(F.format_string("%,.0f", F.bround(value, 0))))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(num, den)


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num/den, 0 when den is 0 (the scoring formulas' rule)."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))
