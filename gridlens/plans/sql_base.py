"""DuckDB oracle building blocks: readings, held readings, engineered
readings and the daily summary as CTEs over the ``events`` view.

These are written independently of the Spark plans and deliberately in the
most direct form (whole-meter windows, one query per step), so the oracle
checks the day-bucketed Spark implementation rather than mirroring it.
"""

from __future__ import annotations

from gridlens import constants as K


def _str_list(vals) -> str:
    return "[" + ", ".join("'" + v + "'" for v in vals) + "]"


def _in_list(vals) -> str:
    return "(" + ", ".join("'" + v + "'" for v in vals) + ")"


def _case(col: str, mapping: dict, typ: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN CAST({v} AS {typ})" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


IND = _in_list(K.INDUSTRIAL_LOCATIONS)

READINGS = f"""
fx_ev AS (
  SELECT event_id, ts AS "timestamp", user_id AS u, event_type,
         COALESCE(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS k,
         CAST(round(value * 100, 0) AS BIGINT) AS c
  FROM events),
fx_a AS (
  SELECT *,
    'MTR_' || lpad(CAST(u AS VARCHAR), 6, '0') AS meter_id,
    CASE WHEN u % 3 <> 0 THEN 'three' ELSE 'single' END AS phase_type,
    ({_str_list(K.LOCATIONS)})[u % {len(K.LOCATIONS)} + 1] AS location_id,
    u % 41 + 1 AS feeder_no,
    'DMG_' || lpad(CAST(u % 173 + 1 AS VARCHAR), 4, '0') AS transformer_id,
    CAST(5 * (38 + (event_id * 7 + k) % 11) AS DOUBLE) AS v_agg,
    ((event_id % 9) - 4) / 4 AS dv,
    (25 * (1 + (event_id * 5 + c) % 64)) / 32 AS i_agg,
    ((event_id % 5) - 2) / 8 AS di,
    (1 + (event_id * 3 + k * 7 + u) % 64) / 64 AS power_factor,
    CAST(-(30 + (event_id * 11 + u) % 71) AS DOUBLE) AS signal_strength_dbm,
    ((event_id * 13 + c) % 41) / 4 AS expected_energy_kwh
  FROM fx_ev),
fx_b AS (
  SELECT *,
    'FDR_' || lpad(CAST(feeder_no AS VARCHAR), 3, '0') AS feeder_id,
    location_id IN {IND} AS industrial_loc,
    CASE WHEN location_id IN {IND} THEN 'A'
         ELSE ({_str_list(K.BANDS)})[feeder_no % 5 + 1] END AS band,
    v_agg < {K.SUPPLY_VOLTAGE} AS low_v,
    signal_strength_dbm < {K.MODEM_DBM} AS modem,
    event_type = 'error' AND k < 15 AS tamper
  FROM fx_a),
fx_c AS (
  SELECT *,
    {_case('band', K.TARIFF_BY_BAND, 'DOUBLE')} AS tariff_per_kwh,
    CASE WHEN industrial_loc THEN CAST(100000 AS DOUBLE) + CAST(((event_id * 97 + c) % 19601) * 250 AS DOUBLE)
         ELSE CAST(([{", ".join(str(v) for v in K.VEND_AMOUNTS)}])[(event_id + k) % 6 + 1] AS DOUBLE) END
      AS total_vended_amount
  FROM fx_b),
readings AS (
  SELECT meter_id, event_id, phase_type, "timestamp",
    CASE WHEN phase_type = 'three' THEN v_agg + dv END AS v1,
    CASE WHEN phase_type = 'three' THEN v_agg - dv END AS v2,
    CASE WHEN phase_type = 'three' THEN v_agg END AS v3,
    CASE WHEN phase_type = 'three' THEN i_agg + di END AS i1,
    CASE WHEN phase_type = 'three' THEN i_agg - di END AS i2,
    CASE WHEN phase_type = 'three' THEN i_agg END AS i3,
    v_agg, i_agg, power_factor,
    (expected_energy_kwh * (12 + (event_id + k) % 6)) / 16 AS energy_consumed_kwh,
    expected_energy_kwh, signal_strength_dbm,
    CASE WHEN (event_id * 3 + k) % 20 = 0 THEN 0 ELSE 1 END AS data_transmitted,
    CAST(tamper AS INTEGER) AS tamper_flag,
    CAST(CASE WHEN tamper THEN 12 + (event_id * 7 + k) % 36 ELSE 0 END AS INTEGER) AS tamper_duration_hours,
    CAST(low_v OR modem AS INTEGER) AS fault_flag,
    CASE WHEN low_v AND modem THEN 'voltage + modem' WHEN low_v THEN 'low_voltage'
         WHEN modem THEN 'modem_disconnect' END AS fault_type,
    CAST(CASE WHEN low_v OR modem THEN
           CASE WHEN industrial_loc THEN 6 + event_id % 18 ELSE 24 + event_id % 48 END
         ELSE 0 END AS INTEGER) AS fault_duration_hours,
    CASE WHEN low_v OR modem THEN 'faulty' WHEN tamper THEN 'tampered'
         WHEN (event_id * 3 + k) % 20 = 0 THEN 'inactive' ELSE 'healthy' END AS meter_status,
    CAST(([{", ".join(str(v) for v in K.READING_GAPS)}])[event_id % 3 + 1] AS INTEGER) AS reading_gap_minutes,
    location_id, feeder_id, transformer_id, band, tariff_per_kwh, total_vended_amount,
    round(total_vended_amount / tariff_per_kwh, 2) AS expected_energy_from_vend
  FROM fx_c)"""

READING_COLS = """meter_id, event_id, phase_type, "timestamp", v1, v2, v3, i1, i2, i3,
    v_agg, i_agg, power_factor, energy_consumed_kwh, expected_energy_kwh,
    signal_strength_dbm, data_transmitted, tamper_flag, tamper_duration_hours,
    fault_flag, fault_type, fault_duration_hours, meter_status, reading_gap_minutes,
    location_id, feeder_id, transformer_id, band, tariff_per_kwh, total_vended_amount,
    expected_energy_from_vend"""

WM = 'PARTITION BY meter_id ORDER BY "timestamp", event_id'

HELD = f"""
hd0 AS (
  SELECT *, CAST("timestamp" AS DATE) AS date,
    last_value(CASE WHEN fault_flag = 1 THEN "timestamp" END IGNORE NULLS) OVER wrun AS f_t,
    last_value(CASE WHEN fault_flag = 1 THEN fault_duration_hours END IGNORE NULLS) OVER wrun AS f_d,
    last_value(CASE WHEN fault_flag = 1 THEN fault_type END IGNORE NULLS) OVER wrun AS f_ty,
    last_value(CASE WHEN tamper_flag = 1 THEN "timestamp" END IGNORE NULLS) OVER wrun AS t_t,
    last_value(CASE WHEN tamper_flag = 1 THEN tamper_duration_hours END IGNORE NULLS) OVER wrun AS t_d
  FROM readings
  WINDOW wrun AS ({WM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hd1 AS (
  SELECT *,
    COALESCE(f_t IS NOT NULL AND epoch_us("timestamp") - epoch_us(f_t) <= CAST(f_d AS BIGINT) * 3600000000, false) AS f_on,
    COALESCE(t_t IS NOT NULL AND epoch_us("timestamp") - epoch_us(t_t) <= CAST(t_d AS BIGINT) * 3600000000, false) AS t_on
  FROM hd0),
held AS (
  SELECT meter_id, event_id, phase_type, "timestamp", v1, v2, v3, i1, i2, i3,
    v_agg, i_agg, power_factor, energy_consumed_kwh, expected_energy_kwh,
    signal_strength_dbm, data_transmitted,
    CAST(t_on AS INTEGER) AS tamper_flag,
    CAST(CASE WHEN t_on THEN t_d ELSE 0 END AS INTEGER) AS tamper_duration_hours,
    CAST(f_on AS INTEGER) AS fault_flag,
    CASE WHEN f_on THEN f_ty END AS fault_type,
    CAST(CASE WHEN f_on THEN f_d ELSE 0 END AS INTEGER) AS fault_duration_hours,
    CASE WHEN f_on THEN 'faulty' WHEN t_on THEN 'tampered'
         WHEN data_transmitted = 0 THEN 'inactive' ELSE 'healthy' END AS meter_status,
    reading_gap_minutes, location_id, feeder_id, transformer_id, band, tariff_per_kwh,
    total_vended_amount, expected_energy_from_vend, date
  FROM hd1)"""

ENGINEERED_COLS = """meter_id, phase_type, "timestamp", v1, v2, v3, i1, i2, i3,
    v_agg, i_agg, power_factor, energy_consumed_kwh, expected_energy_kwh,
    signal_strength_dbm, data_transmitted, tamper_flag, tamper_duration_hours,
    fault_flag, fault_type, fault_duration_hours, meter_status, reading_gap_minutes,
    location_id, feeder_id, transformer_id, band, tariff_per_kwh, total_vended_amount,
    expected_energy_from_vend, event_id,
    hour, day, month, weekday, date, supply_voltage_flag, uptime_flag,
    expected_energy_pf_calc, pf_delta, raw_fault_type, prev_status, status_change,
    fault_start, tamper_start, fault_timestamp, tamper_timestamp, energy_loss_kwh,
    revenue_loss, energy_loss_flag, tamper_cost_estimate, supply_hour_counter,
    band_compliance, band_compliance_max, high_vend_zone, is_industrial,
    supply_outage_flag, load_generation_gap, load_gap_flag,
    service_availability_ratio, unresolved_fault_days, meter_anomaly_tag,
    customer_risk_score"""

SLA_CASE = _case("band", K.SLA_HOURS_BY_BAND, "INTEGER")


def engineered_sql(source: str = "held") -> str:
    return f"""
en1 AS (
  SELECT *,
    CAST(hour("timestamp") AS INTEGER) AS hour, CAST(day("timestamp") AS INTEGER) AS day,
    CAST(month("timestamp") AS INTEGER) AS month, CAST(isodow("timestamp") - 1 AS INTEGER) AS weekday,
    CAST(COALESCE(v_agg > {K.SUPPLY_VOLTAGE}, false) AS INTEGER) AS supply_voltage_flag,
    (v_agg * i_agg * power_factor) / 1000 AS expected_energy_pf_calc,
    expected_energy_kwh - energy_consumed_kwh AS energy_loss_kwh,
    CAST(COALESCE(location_id IN {IND} AND band = 'A', false) AS INTEGER) AS high_vend_zone
  FROM {source}),
en2 AS (
  SELECT * REPLACE (
      CASE WHEN COALESCE(fault_flag, 0) <> 0 THEN
        CASE WHEN signal_strength_dbm < {K.MODEM_DBM} THEN 'modem_fault'
             WHEN v_agg < {K.SUPPLY_VOLTAGE} THEN 'voltage_drop'
             WHEN power_factor < CAST({K.BURNT_PF} AS DOUBLE) THEN 'burnt_meter'
             WHEN supply_voltage_flag = 1 AND energy_consumed_kwh < CAST({K.RELAY_KWH} AS DOUBLE) THEN 'relay_fault'
             ELSE 'no_fault' END
      ELSE 'no_fault' END AS fault_type),
    fault_type AS raw_fault_type,
    CAST(COALESCE(supply_voltage_flag = 1 AND data_transmitted = 1, false) AS INTEGER) AS uptime_flag,
    CAST(COALESCE(supply_voltage_flag = 0 AND data_transmitted = 0, false) AS INTEGER) AS supply_outage_flag,
    energy_loss_kwh * tariff_per_kwh AS revenue_loss,
    CAST(COALESCE(energy_loss_kwh > CAST({K.LOSS_KWH} AS DOUBLE), false) AS INTEGER) AS energy_loss_flag,
    high_vend_zone AS is_industrial,
    expected_energy_pf_calc - energy_consumed_kwh AS load_generation_gap
  FROM en1),
en3 AS (
  SELECT *,
    COALESCE(power_factor - lag(power_factor) OVER wm, CAST(0 AS DOUBLE)) AS pf_delta,
    lag(meter_status) OVER wm AS prev_status,
    meter_status IS DISTINCT FROM lag(meter_status) OVER wm AS status_change,
    CAST(fault_flag = 1 AND COALESCE(lag(fault_flag) OVER wm, 0) = 0 AS INTEGER) AS fault_start,
    CAST(tamper_flag = 1 AND COALESCE(lag(tamper_flag) OVER wm, 0) = 0 AS INTEGER) AS tamper_start,
    CASE WHEN fault_flag = 1 AND COALESCE(lag(fault_flag) OVER wm, 0) = 0 THEN "timestamp" END AS fault_timestamp,
    CASE WHEN tamper_flag = 1 AND COALESCE(lag(tamper_flag) OVER wm, 0) = 0 THEN "timestamp" END AS tamper_timestamp,
    CASE WHEN tamper_flag = 1 THEN revenue_loss WHEN tamper_flag = 0 THEN CAST(0 AS DOUBLE)
         ELSE revenue_loss * tamper_flag END AS tamper_cost_estimate,
    CAST(sum(supply_voltage_flag) OVER wd AS BIGINT) AS supply_hour_counter,
    CAST(COALESCE(abs(load_generation_gap) > CAST({K.LOAD_GAP_SHARE} AS DOUBLE) * expected_energy_pf_calc, false)
         AS INTEGER) AS load_gap_flag,
    CAST(sum(uptime_flag) OVER wd AS BIGINT) / 24 AS service_availability_ratio,
    CAST(sum(fault_flag) OVER ({WM} ROWS BETWEEN {K.ROLLING_READINGS - 1} PRECEDING AND CURRENT ROW) AS DOUBLE)
      AS unresolved_fault_days
  FROM en2
  WINDOW wm AS ({WM}), wd AS (PARTITION BY meter_id, date)),
en4 AS (
  SELECT *,
    CAST(COALESCE(supply_hour_counter >= COALESCE({SLA_CASE}, 0), false) AS INTEGER) AS band_compliance,
    COALESCE(NULLIF(concat_ws(',',
        CASE WHEN fault_flag = 1 THEN 'fault' END, CASE WHEN tamper_flag = 1 THEN 'tamper' END,
        CASE WHEN supply_outage_flag = 1 THEN 'outage' END, CASE WHEN load_gap_flag = 1 THEN 'mismatch' END),
      ''), 'normal') AS meter_anomaly_tag,
    fault_flag * CAST(1.5 AS DOUBLE) + tamper_flag * 2 + supply_outage_flag + load_gap_flag AS customer_risk_score
  FROM en3),
eng AS (
  SELECT {ENGINEERED_COLS.replace("band_compliance_max,", "max(band_compliance) OVER (PARTITION BY meter_id, date) AS band_compliance_max,")}
  FROM en4)"""


ENGINEERED = engineered_sql("held")

DAILY_KEYS_SQL = ", ".join(K.DAILY_KEYS)

DAILY = f"""
dg AS (
  SELECT {", ".join(f"{k} AS {k}_" for k in K.DAILY_KEYS)},
    {", ".join(f"COALESCE(sum({c}), 0) AS {c}_sum" for c in
               ["energy_consumed_kwh", "expected_energy_kwh", "expected_energy_pf_calc",
                "total_vended_amount", "revenue_loss", "tamper_cost_estimate", "energy_loss_kwh"])},
    {", ".join(f"CAST(COALESCE(sum({c}), 0) AS BIGINT) AS {c}_sum" for c in
               ["energy_loss_flag", "fault_flag", "tamper_flag", "uptime_flag", "supply_voltage_flag"])},
    avg(pf_delta) AS pf_delta_mean, avg(load_generation_gap) AS load_generation_gap_mean,
    CAST(COALESCE(sum(load_gap_flag), 0) AS BIGINT) AS load_gap_flag_sum,
    avg(service_availability_ratio) AS service_availability_ratio_mean,
    avg(unresolved_fault_days) AS unresolved_fault_days_mean,
    avg(customer_risk_score) AS customer_risk_score_mean,
    avg(power_factor) AS power_factor_mean, min(power_factor) AS power_factor_min,
    avg(v_agg) AS v_agg_mean, min(v_agg) AS v_agg_min, max(v_agg) AS v_agg_max,
    avg(i_agg) AS i_agg_mean, min(i_agg) AS i_agg_min, max(i_agg) AS i_agg_max,
    avg(tariff_per_kwh) AS tariff_per_kwh_mean, max(band_compliance) AS band_compliance_max
  FROM eng
  WHERE {" AND ".join(f"{k} IS NOT NULL" for k in K.DAILY_KEYS)}
  GROUP BY {DAILY_KEYS_SQL}),
dk AS (
  SELECT *,
    CAST(fault_flag_sum > 0 AS INTEGER) AS fault_detected,
    CAST(tamper_flag_sum > 0 AS INTEGER) AS tamper_detected,
    energy_loss_kwh_sum / NULLIF(expected_energy_kwh_sum, 0) AS energy_loss_ratio,
    supply_voltage_flag_sum AS supply_hours,
    uptime_flag_sum AS uptime_hours,
    energy_consumed_kwh_sum / NULLIF(expected_energy_kwh_sum, 0) AS energy_efficiency_ratio
  FROM dg),
dc AS (
  SELECT *,
    COALESCE(NULLIF(concat_ws(',',
        CASE WHEN fault_detected = 1 THEN 'fault' END, CASE WHEN tamper_detected = 1 THEN 'tamper' END,
        CASE WHEN energy_loss_flag_sum > 0 THEN 'loss' END, CASE WHEN load_gap_flag_sum > 0 THEN 'mismatch' END),
      ''), 'normal') AS anomaly_category,
    CAST(fault_detected * 3 + tamper_detected * 4 + energy_loss_flag_sum * 2 + load_gap_flag_sum * 2
         + CASE WHEN service_availability_ratio_mean < 0.5 THEN 1 ELSE 0 END AS BIGINT) AS anomaly_severity_score
  FROM dk),
daily AS (
  SELECT *,
    CASE WHEN anomaly_category = 'normal' THEN 'No issue detected'
         ELSE 'Detected: ' || anomaly_category || ' | Risk=' || CAST(anomaly_severity_score AS VARCHAR) END
      AS anomaly_summary_note
  FROM dc)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BASE_DAILY = with_ctes(READINGS, HELD, ENGINEERED, DAILY)
BASE_ENG = with_ctes(READINGS, HELD, ENGINEERED)
BASE_HELD = with_ctes(READINGS, HELD)
BASE_READINGS = with_ctes(READINGS)
