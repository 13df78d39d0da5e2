"""Domain constants.

FIXED VALUES — these must equal the reference's values for results to match:

  tariff per kWh by band:      A 209, B 61, C 48, D 34, E 28
  SLA supply hours by band:    A 20, B 16, C 12, D 8, E 4
  locations:                   Lekki, Ajah, Island, Ibeju, Festac, Agbara,
                               Ajele, Ijora, Apapa, Mushin, Ojo, Orile
  industrial locations:        Lekki, Island, Apapa, Ajele, Ajah
  vend amounts (non-industrial): 500, 1000, 2000, 5000, 10000, 20000
  reading gaps (minutes):      15, 30, 60
  supply voltage threshold:    v_agg > 200
  modem fault threshold:       signal_strength_dbm < -90
  burnt meter threshold:       power_factor < 0.3
  relay fault threshold:       energy_consumed_kwh < 0.1
  energy loss flag threshold:  energy_loss_kwh > 0.5
  load gap threshold:          |gap| > 0.3 * expected_energy_pf_calc
  rolling fault window:        24 readings
  risk alert threshold:        80 (%), probability 0.8
  high revenue loss alert:     revenue_loss_sum > 100000
  raw fault types:             "voltage + modem", "low_voltage", "modem_disconnect"
  engineered fault types:      modem_fault, voltage_drop, burnt_meter,
                               relay_fault, no_fault
"""

BANDS = ["A", "B", "C", "D", "E"]
TARIFF_BY_BAND = {"A": 209, "B": 61, "C": 48, "D": 34, "E": 28}
SLA_HOURS_BY_BAND = {"A": 20, "B": 16, "C": 12, "D": 8, "E": 4}

LOCATIONS = ["Lekki", "Ajah", "Island", "Ibeju", "Festac", "Agbara",
             "Ajele", "Ijora", "Apapa", "Mushin", "Ojo", "Orile"]
INDUSTRIAL_LOCATIONS = ["Lekki", "Island", "Apapa", "Ajele", "Ajah"]
VEND_AMOUNTS = [500, 1000, 2000, 5000, 10000, 20000]
READING_GAPS = [15, 30, 60]

SUPPLY_VOLTAGE = 200
MODEM_DBM = -90
BURNT_PF = 0.3
RELAY_KWH = 0.1
LOSS_KWH = 0.5
LOAD_GAP_SHARE = 0.3
ROLLING_READINGS = 24
HIGH_LOSS_REVENUE = 100000
HIGH_RISK_PCT = 80
HIGH_RISK_PROB = 0.8

# Grouping keys of the daily summary, in the reference's order.
DAILY_KEYS = ["meter_id", "location_id", "feeder_id", "transformer_id",
              "band", "fault_type", "is_industrial", "date"]

# Classification / regression tasks offered for training.
TASKS = {
    "tamper_detected": "classification",
    "fault_detected": "classification",
    "energy_loss_kwh_sum": "regression",
    "band_compliance_max": "classification",
    "customer_risk_score_mean": "regression",
}

# Daily columns that a task's target is computed from: features to exclude where leakage matters.
LEAKS = {
    "tamper_detected": ["tamper_flag_sum", "tamper_cost_estimate_sum", "anomaly_severity_score"],
    "fault_detected": ["fault_flag_sum", "unresolved_fault_days_mean", "anomaly_severity_score"],
    "energy_loss_kwh_sum": ["energy_loss_flag_sum", "energy_loss_ratio", "revenue_loss_sum", "tamper_cost_estimate_sum"],
    "band_compliance_max": ["supply_hours", "supply_voltage_flag_sum", "service_availability_ratio_mean"],
    "customer_risk_score_mean": ["tamper_flag_sum", "fault_flag_sum", "energy_loss_flag_sum"],
}

# Identifier / text columns dropped before modelling.
NON_FEATURE_COLUMNS = ["meter_id_", "location_id_", "feeder_id_", "transformer_id_",
                       "date_", "anomaly_category", "anomaly_summary_note"]
