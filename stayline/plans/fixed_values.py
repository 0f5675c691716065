"""Fixed values of the study.

Patterns, item ids, thresholds and names below must equal the published study's for the
results to match; they are data, listed in their natural order.
"""

# --- cohort -------------------------------------------------------------------------

ANTIBIOTIC_PATTERN = (
    r"(amoxicillin|ampicillin|penicillin|piperacillin|tazobactam|nafcillin|oxacillin|dicloxacillin|"
    r"cef[a-z]+|carbapenem|meropenem|ertapenem|imipenem|aztreonam|vancomycin|daptomycin|linezolid|"
    r"clindamycin|metronidazole|doxycycline|minocycline|tigecycline|tetracycline|azithromycin|"
    r"erythromycin|clarithromycin|ciprofloxacin|levofloxacin|moxifloxacin|gentamicin|tobramycin|"
    r"amikacin|fosfomycin|trimethoprim|sulfamethoxazole|bactrim)"
)
TOPICAL_DRUG_PATTERN = r"(ophth|otic|topical|vaginal)"
NON_SYSTEMIC_ROUTE_PATTERN = r"(^|[^a-z])(od|os|ou|ad|as|au)([^a-z]|$)|ophth|otic|topical|vaginal"
BLOOD_CULTURE_TEXT = "blood culture"
LACTATE_LABEL = "lactate"
MIN_AGE = 18
HOURS_BEFORE_STAY = 24
HOURS_AFTER_STAY = 48
SAMPLE_SIZE = 1000

# --- rule labels --------------------------------------------------------------------

ADMINISTERED_PATTERN = r"(administered|given|started)"
WBC_LABEL_PATTERN = r"(^wbc$|white blood cells?)"
WBC_LOW, WBC_HIGH = 4.0, 12.0
FEVER_CELSIUS, FEVER_FAHRENHEIT = 38.0, 100.4
LOW_MEAN_PRESSURE, LOW_SYSTOLIC_PRESSURE, FAST_HEART_RATE = 65.0, 90.0, 100.0
HIGH_CONFIDENCE_HOURS = 6

NOTE_PHRASES = (
    ("sepsis", r"\bsepsis\b"),
    ("suspected infection", r"suspect(?:ed|ing)? infection"),
    ("possible pneumonia", r"possible pneumonia"),
    ("rule out infection", r"(rule out|r/o) infection"),
    ("empiric antibiotics", r"empiric antibiotics?"),
    ("concern for source", r"concern for source"),
    ("concern for infection", r"concern for infection"),
)

CONTEXT_SOURCES = (
    (
        "pulmonary",
        r"(pneumonia|empyema|lung abscess|pulmonary source|respiratory source|"
        r"sputum|bronch|bal|bronchoalveolar|pleural|tracheal)",
    ),
    ("urinary", r"(urinary tract infection|\buti\b|\bcystitis\b|pyelonephritis|urine|urosepsis)"),
    (
        "abdominal",
        r"(peritonitis|cholangitis|cholecystitis|appendicitis|diverticulitis|"
        r"intra-abdominal infection|hepatic abscess|liver abscess|biliary infection|"
        r"peritoneal abscess|bile)",
    ),
    (
        "skin_soft_tissue",
        r"(cellulitis|wound infection|infected ulcer|necrotizing fasciitis|"
        r"soft tissue infection|cutaneous abscess|skin abscess)",
    ),
    ("cns", r"(meningitis|encephalitis|ventriculitis|brain abscess|csf|spinal fluid)"),
    ("endocardial", r"(endocarditis)"),
    ("bone_joint", r"(osteomyelitis|septic arthritis|prosthetic joint infection)"),
    (
        "line_device",
        r"(line infection|catheter infection|port infection|device infection|"
        r"central line-associated bloodstream infection|clabsi)",
    ),
)

DIAGNOSIS_SOURCES = (
    ("pulmonary", r"(pneumonia|empyema|lung abscess|pulmonary infection|respiratory infection)"),
    ("urinary", r"(urinary tract infection|\buti\b|\bcystitis\b|pyelonephritis|urosepsis)"),
    (
        "abdominal",
        r"(peritonitis|cholangitis|cholecystitis|appendicitis|diverticulitis|"
        r"intra-abdominal infection|hepatic abscess|liver abscess|biliary infection|"
        r"peritoneal abscess)",
    ),
    (
        "skin_soft_tissue",
        r"(cellulitis|wound infection|infected ulcer|necrotizing fasciitis|"
        r"soft tissue infection|cutaneous abscess|skin abscess)",
    ),
    ("cns", r"(meningitis|encephalitis|ventriculitis|brain abscess|central nervous system infection)"),
    ("endocardial", r"(endocarditis)"),
    ("bone_joint", r"(osteomyelitis|septic arthritis|prosthetic joint infection|bone infection|joint infection)"),
    (
        "line_device",
        r"(line infection|catheter infection|port infection|device infection|"
        r"central line-associated bloodstream infection|clabsi)",
    ),
    ("bloodstream", r"(bacteremia|septicemia|bloodstream infection)"),
)

MEAN_PRESSURE_LABELS = r"(arterial blood pressure mean|non invasive blood pressure mean|abp mean|nbp mean|map)"
SYSTOLIC_PRESSURE_LABELS = (
    r"(arterial blood pressure systolic|non invasive blood pressure systolic|abp systolic|nbp systolic)"
)

TIER1 = ("tier1_note_evidence", "first_note_evidence_time")
TIER2 = (
    ("tier2_antibiotic_administration", "first_antibiotic_admin_time"),
    ("tier2_blood_culture_order", "first_blood_culture_order_time"),
)
TIER3 = (
    ("tier3_lactate", "first_lactate_time"),
    ("tier3_abnormal_wbc", "first_abnormal_wbc_time"),
    ("tier3_fever", "first_fever_time"),
    ("tier3_hypotension", "first_hypotension_time"),
    ("tier3_tachycardia", "first_tachycardia_time"),
)
SOURCE_PRECEDENCE = (
    ("note_text", "first_note_source"),
    ("culture_context", "first_culture_context_source"),
    ("diagnosis_fallback", "first_diagnosis_source"),
)
EVIDENCE = (
    ("first_note_evidence_time", ("notes:note_charttime", "notes:text")),
    ("first_note_evidence_id", ("notes:note_id",)),
    ("first_antibiotic_admin_time", ("emar:charttime", "emar:medication", "emar:event_txt")),
    (
        "first_blood_culture_order_time",
        (
            "microbiologyevents:charttime", "microbiologyevents:chartdate",
            "microbiologyevents:spec_type_desc", "microbiologyevents:test_name",
        ),
    ),
    ("first_lactate_time", ("labevents:charttime", "labevents:itemid", "d_labitems:label")),
    ("first_abnormal_wbc_time", ("labevents:charttime", "labevents:valuenum", "d_labitems:label")),
    ("first_fever_time", ("chartevents:charttime", "chartevents:valuenum", "d_items:label")),
    ("first_hypotension_time", ("chartevents:charttime", "chartevents:valuenum", "d_items:label")),
    ("first_tachycardia_time", ("chartevents:charttime", "chartevents:valuenum", "d_items:label")),
    ("first_diagnosis_source", ("diagnoses_icd:seq_num", "d_icd_diagnoses:long_title")),
)
RULE_COLUMNS = (
    "patient_id", "subject_id", "hadm_id", "stay_id", "icustay_id",
    "suspicion_time_rule", "infection_source_rule", "rule_confidence", "rule_trigger",
    "evidence_source", "suspicion_time_rule_source", "infection_source_rule_source",
    "first_note_evidence_id", "first_note_evidence_time", "first_note_match_phrase", "first_note_source",
    "first_antibiotic_admin_time", "first_blood_culture_order_time",
    "first_culture_context_time", "first_culture_context_source",
    "first_culture_context_specimen", "first_culture_context_test",
    "first_lactate_time", "first_abnormal_wbc_time", "first_fever_time",
    "first_hypotension_time", "first_tachycardia_time",
    "first_diagnosis_source", "first_diagnosis_title", "rule_no_fire_reason",
)

# --- notes and extraction -----------------------------------------------------------

MAX_NOTES_PER_STAY = 20
MAX_CHARS_PER_STAY = 40_000
NOTE_FILES = {"radiology": "radiology.csv.gz", "discharge": "discharge.csv.gz"}
NOTE_DOMAINS = (
    # domain, windowed, usage policy, allowed for gold annotations, allowed for extraction
    ("radiology", True, "secondary_only", False, False),
    ("discharge", False, "audit_only", False, False),
)
PROMPT_VERSION = "extraction_v1"
SYSTEM_PROMPT = (
    "You are a clinical information extraction model for a measurement-error study. "
    "Use only the provided notes. Do not infer from outcomes or information that is "
    "not stated in the note bundle. Return exactly one JSON object and nothing else."
)
USER_PROMPT = """Extract the following structured variables from the provided note bundle.

Return exactly one JSON object with this schema:
{
  "suspected_sepsis": true or false,
  "suspicion_time": "YYYY-MM-DD HH:MM:SS" or null,
  "infection_source": "string" or null,
  "evidence_span": "short verbatim evidence from the notes" or null,
  "confidence": 0.0 to 1.0
}

Rules:
- use only the notes shown below
- do not use information after the provided time window
- if suspected_sepsis is false, set suspicion_time, infection_source, and evidence_span to null
- if suspected_sepsis is true, suspicion_time must be the earliest explicit or strongly implied time in the notes
- evidence_span must be copied verbatim from the notes and must support the label
- do not add keys
- do not wrap the JSON in markdown fences

Task metadata:
- task_id: {task_id}
- subject_id: {subject_id}
- hadm_id: {hadm_id}
- stay_id: {stay_id}
- note_count: {note_count}

Notes:
{rendered_notes}
"""

# --- datasets and perturbation ------------------------------------------------------

EARLY_TREATMENT_HOURS = 3.0
SHIFT_HOURS = (-3.0, -2.0, -1.0, 1.0, 2.0, 3.0)

# --- covariates ---------------------------------------------------------------------

# measure: item ids, low, high (plausible range after unit conversion)
CHART_MEASURES = {
    "pre_t0_heart_rate": (("220045",), 20, 250),
    "pre_t0_sbp": (("220050", "220179", "225309", "224167", "227243"), 30, 300),
    "pre_t0_temperature_c": (("223762", "226329", "223761"), 25, 45),
}
FAHRENHEIT_ITEMS = ("223761",)
LAB_MEASURES = {
    "pre_t0_wbc": (("51516", "52407"), 0, 500),
    "pre_t0_lactate": (("50813", "52442", "53154"), 0, 50),
    "pre_t0_creatinine": (("50912", "52546"), 0, 30),
}
VASOPRESSOR_ITEMS = ("221906", "221289", "221749", "222315", "221653", "221662")
VENTILATION_CHART_ITEMS = ("225792",)
VENTILATION_PROCEDURES = ("Intubation", "Invasive Ventilation", "Percutaneous Tracheostomy")

CONTINUOUS_COVARIATES = (
    "age_years", "calendar_year", "calendar_month", "prior_admission_count",
    "prior_diagnosis_root_count", "pre_t0_heart_rate", "pre_t0_sbp", "pre_t0_temperature_c",
    "pre_t0_wbc", "pre_t0_lactate", "pre_t0_creatinine",
)
CATEGORICAL_COVARIATES = ("sex", "admission_type", "pre_t0_careunit")
BINARY_COVARIATES = ("pre_t0_mechanical_ventilation", "pre_t0_vasopressor")
COVARIATES = (
    "age_years", "sex", "admission_type", "pre_t0_careunit", "calendar_year", "calendar_month",
    "prior_admission_count", "prior_diagnosis_root_count",
    "pre_t0_heart_rate", "pre_t0_sbp", "pre_t0_temperature_c",
    "pre_t0_wbc", "pre_t0_lactate", "pre_t0_creatinine",
    "pre_t0_mechanical_ventilation", "pre_t0_vasopressor",
)
DETAIL_COLUMNS = (
    "task_id", "subject_id", "hadm_id", "stay_id",
    "dataset_name", "dataset_type", "dataset_id", "analysis_scope",
    "treatment", "event", "followup_duration_days", "propensity_score",
    "stabilized_weight_raw", "stabilized_weight_primary", "stabilized_weight_sensitivity",
    "overlap_weight",
) + COVARIATES
SUMMARY_COLUMNS = (
    "dataset_name", "dataset_type", "dataset_id", "analysis_scope",
    "source_predictor_name", "source_predictor_type", "source_predictor_id", "synthetic_shift_hours",
    "input_row_count", "analysis_row_count", "excluded_row_count",
    "treated_count", "control_count", "event_count",
    "primary_hr", "primary_ci_lower", "primary_ci_upper",
    "sensitivity_hr", "sensitivity_ci_lower", "sensitivity_ci_upper",
    "overlap_hr", "overlap_ci_lower", "overlap_ci_upper",
    "propensity_min", "propensity_max", "treated_ps_min", "treated_ps_max",
    "control_ps_min", "control_ps_max", "overlap_lower", "overlap_upper", "overlap_width",
    "severe_overlap_flag", "primary_truncated_rate", "sensitivity_truncated_rate",
    "primary_truncation_lower", "primary_truncation_upper",
    "sensitivity_truncation_lower", "sensitivity_truncation_upper",
    "primary_weight_min", "primary_weight_p01", "primary_weight_p05", "primary_weight_p25",
    "primary_weight_p50", "primary_weight_p75", "primary_weight_p95", "primary_weight_p99",
    "primary_weight_max", "primary_weight_mean", "primary_weight_std",
    "convergence_status", "detail_csv_path", "survival_curve_csv_path",
)

# --- raw tables: columns that are typed, everything else stays text -----------------

_IDS = {"subject_id": "bigint", "hadm_id": "bigint", "stay_id": "bigint", "itemid": "bigint"}
_TIMES = {
    name: "timestamp_ntz"
    for name in (
        "admittime", "dischtime", "deathtime", "dod", "intime", "outtime", "starttime", "stoptime",
        "endtime", "charttime", "chartdate", "storetime",
    )
}
RAW_TYPES = {
    **_IDS, **_TIMES,
    "anchor_age": "int", "seq_num": "int", "transfer_id": "bigint", "valuenum": "double",
}
RAW_FILES = {
    "patients": "hosp/patients.csv.gz",
    "admissions": "hosp/admissions.csv.gz",
    "prescriptions": "hosp/prescriptions.csv.gz",
    "labevents": "hosp/labevents.csv.gz",
    "d_labitems": "hosp/d_labitems.csv.gz",
    "microbiologyevents": "hosp/microbiologyevents.csv.gz",
    "emar": "hosp/emar.csv.gz",
    "diagnoses_icd": "hosp/diagnoses_icd.csv.gz",
    "d_icd_diagnoses": "hosp/d_icd_diagnoses.csv.gz",
    "transfers": "hosp/transfers.csv.gz",
    "icustays": "icu/icustays.csv.gz",
    "chartevents": "icu/chartevents.csv.gz",
    "d_items": "icu/d_items.csv.gz",
    "inputevents": "icu/inputevents.csv.gz",
    "procedureevents": "icu/procedureevents.csv.gz",
}
REQUIRED_COLUMNS = {
    "patients": ("subject_id", "anchor_age"),
    "admissions": ("subject_id", "hadm_id", "admittime", "dischtime"),
    "icustays": ("subject_id", "hadm_id", "stay_id", "intime", "outtime"),
    "prescriptions": ("subject_id", "hadm_id", "starttime", "stoptime", "drug", "route"),
    "labevents": ("subject_id", "hadm_id", "itemid", "charttime", "storetime", "valuenum"),
    "d_labitems": ("itemid", "label"),
    "microbiologyevents": ("subject_id", "hadm_id", "charttime", "chartdate", "spec_type_desc", "test_name"),
    "emar": ("subject_id", "hadm_id", "charttime", "event_txt", "medication"),
    "diagnoses_icd": ("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"),
    "d_icd_diagnoses": ("icd_code", "icd_version", "long_title"),
    "transfers": ("subject_id", "hadm_id", "transfer_id", "careunit", "intime"),
    "chartevents": ("subject_id", "hadm_id", "stay_id", "itemid", "charttime", "storetime", "valuenum"),
    "d_items": ("itemid", "label"),
    "inputevents": ("stay_id", "starttime", "itemid"),
    "procedureevents": ("stay_id", "starttime", "itemid"),
}
NOTE_REQUIRED = ("subject_id", "hadm_id", "charttime", "text")
# clustering of the silver files: bucket keys and sort columns
SILVER_LAYOUT = {
    "prescriptions": (("subject_id",), ("starttime",)),
    "labevents": (("subject_id",), ("itemid", "charttime")),
    "microbiologyevents": (("subject_id",), ("charttime",)),
    "emar": (("subject_id",), ("charttime",)),
    "chartevents": (("stay_id",), ("itemid", "charttime")),
    "inputevents": (("stay_id",), ("itemid",)),
    "procedureevents": (("stay_id",), ("itemid",)),
}
