"""Invented raw clinical tables for the end-to-end test, written as gzip CSV."""

from __future__ import annotations

import csv
import gzip
import os
import random
from datetime import datetime, timedelta

from stayline.plans import fixed_values as fv

COLUMNS = {
    **{k: list(v) for k, v in fv.REQUIRED_COLUMNS.items()},
    "patients": ["subject_id", "anchor_age", "gender", "dod"],
    "admissions": ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type", "ethnicity"],
}


def _t(at: datetime | None) -> str:
    return "" if at is None else at.strftime("%Y-%m-%d %H:%M:%S")


def make(root: str, subjects: int = 240, seed: int = 11) -> dict:
    rng = random.Random(seed)
    rows = {name: [] for name in fv.RAW_FILES}
    notes = []
    base = datetime(2150, 1, 1)
    rows["d_labitems"] = [(50813, "Lactate"), (51516, "White Blood Cells"), (50912, "Creatinine"), (1, "Other")]
    rows["d_items"] = [
        (220045, "Heart Rate"), (220179, "Non Invasive Blood Pressure systolic"), (223761, "Temperature Fahrenheit"),
        (223762, "Temperature Celsius"), (220052, "Arterial Blood Pressure mean"), (225792, "Invasive Ventilation x"),
        (224385, "Intubation"), (221906, "Norepinephrine"),
    ]
    rows["d_icd_diagnoses"] = [("J18.9", "10", "Pneumonia, unspecified organism"), ("A41.9", "10", "Septicemia"), ("I10", "10", "Hypertension")]
    facts = {}
    for s in range(1, subjects + 1):
        intime = base + timedelta(hours=rng.randrange(0, 20000))
        hadm, stay = 1000 + s, 5000 + s
        age = 17 if s % 40 == 0 else rng.randrange(20, 90)
        sick = rng.random()
        died = rng.random() < 0.2 + 0.3 * sick
        death = intime + timedelta(hours=rng.randrange(60, 900)) if died else None
        rows["patients"].append((s, age, rng.choice("FM"), _t(death)[:10] if death and s % 2 else ""))
        rows["admissions"].append((s, hadm, _t(intime - timedelta(hours=6)), _t(intime + timedelta(days=9)),
                                   _t(death) if death and not s % 2 else "", rng.choice(["EMERGENCY", "ELECTIVE", " "] if s == 7 else ["EMERGENCY", "ELECTIVE"]), "X"))
        rows["icustays"].append((s, hadm, stay, _t(intime), _t(intime + timedelta(days=4))))
        if s % 5 == 0:  # an earlier admission with codes and a later stay
            rows["admissions"].append((s, hadm + 100000, _t(intime - timedelta(days=300)), _t(intime - timedelta(days=290)), "", "ELECTIVE", "X"))
            rows["diagnoses_icd"] += [(s, hadm + 100000, 1, "I10", "10"), (s, hadm + 100000, 2, "A41.9", "10"), (s, hadm + 100000, 3, "A419", "10")]
            rows["icustays"].append((s, hadm, stay + 100000, _t(intime + timedelta(days=5)), _t(intime + timedelta(days=6))))
        rows["diagnoses_icd"].append((s, hadm, 1, "J18.9" if s % 3 else "I10", "10"))
        culture = intime + timedelta(hours=rng.randrange(1, 8), minutes=rng.randrange(60))
        note = culture + timedelta(minutes=rng.randrange(-50, 50))
        drug = culture + timedelta(minutes=rng.randrange(0, 200) if rng.random() < 0.45 + 0.3 * sick else rng.randrange(200, 700))
        rows["microbiologyevents"].append((s, hadm, _t(culture), _t(culture)[:10], "BLOOD CULTURE", ""))
        rows["microbiologyevents"].append((s, hadm, _t(culture), "", "URINE", "culture"))
        rows["prescriptions"].append((s, hadm, _t(drug) if s % 6 else "", _t(drug), "Vancomycin", "IV"))
        rows["prescriptions"].append((s, hadm, _t(intime), "", "Vancomycin ophth", "IV"))
        rows["emar"].append((s, hadm, _t(drug), "Administered", "Vancomycin"))
        rows["emar"].append((s, hadm, _t(intime), "Flushed", "Vancomycin"))
        early = intime - timedelta(hours=3)
        for item, value in ((51516, 5 + 20 * sick), (50813, 1 + 3 * sick), (50912, 0.5 + sick)):
            rows["labevents"].append((s, hadm, item, _t(early), _t(early), round(value, 3)))
            rows["labevents"].append((s, hadm, item, _t(early - timedelta(hours=1)), _t(early), 9.0))
        for item, value in ((220045, 70 + 60 * sick), (220179, 130 - 45 * sick), (223761, 97 + 5 * sick)):
            rows["chartevents"].append((s, hadm, stay, item, _t(early), _t(early), round(value, 3)))
            rows["chartevents"].append((s, hadm, stay, item, _t(early + timedelta(minutes=5)), "", -5))
        if sick > 0.7:
            rows["chartevents"].append((s, hadm, stay, 225792, _t(early), _t(early), ""))
            rows["procedureevents"] += [(stay, _t(early), 224385)] * 2
            rows["inputevents"].append((stay, _t(early), 221906))
        rows["transfers"].append((s, hadm, s, rng.choice(["MICU", "SICU"]), _t(intime - timedelta(hours=5))))
        rows["transfers"].append((s, hadm, s + 1000, "", _t(intime - timedelta(hours=4))))
        notes.append((s, hadm, f"n{s}", _t(note), _t(note), "Concern for infection, sputum sent" if s % 4 else "stable"))
        facts[stay] = {"culture": culture, "drug": drug, "note": note, "age": age, "death": death}
    for name, path in fv.RAW_FILES.items():
        _write(f"{root}/{path}", COLUMNS[name], rows[name])
    _write(f"{root}/note/radiology.csv.gz", ["subject_id", "hadm_id", "note_id", "charttime", "storetime", "text"], notes)
    return facts


def _write(path: str, header, rows) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(rows)
