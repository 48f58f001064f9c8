"""The four case-report tables: every stored column is a nullable string."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

CASE = "primaryid"

# Column name -> comment, in file order.
_DEMOGRAPHICS = {
    "primaryid": "Report key; joins all four tables.",
    "caseid": "Case number, shared by the versions of a case.",
    "caseversion": "Version of the case.",
    "i_f_code": "Initial or follow-up report.",
    "event_dt": "Date the event began.",
    "mfr_dt": "Date the manufacturer first had the information.",
    "init_fda_dt": "Date the first version was received.",
    "fda_dt": "Date this version was received.",
    "rept_cod": "Kind of report.",
    "auth_num": "Case number given by an authority.",
    "mfr_num": "Case number given by the manufacturer.",
    "mfr_sndr": "Name of the sending manufacturer.",
    "lit_ref": "Literature reference.",
    "age": "Age as text, in the unit of age_cod.",
    "age_cod": "Unit of the age.",
    "age_grp": "Age group of the patient.",
    "sex": "Sex of the patient.",
    "e_sub": "Sent electronically or not.",
    "wt": "Weight as text, in the unit of wt_cod.",
    "wt_cod": "Unit of the weight.",
    "rept_dt": "Date the report was sent.",
    "to_mfr": "Whether the reporter also told the manufacturer.",
    "occp_cod": "Occupation of the reporter.",
    "reporter_country": "Country of the reporter.",
    "occr_country": "Country of the event.",
}
_DRUG = {
    "primaryid": "Report key; joins all four tables.",
    "caseid": "Case number.",
    "drug_seq": "Number of the drug within the report.",
    "role_cod": "Role of the drug in the event; PS is the primary suspect.",
    "drugname": "Name of the drug as reported.",
    "prod_ai": "Active ingredient.",
    "val_vbm": "How the name was validated.",
    "route": "Route of administration.",
    "dose_vbm": "Dose, as written.",
    "cum_dose_chr": "Total dose up to the first reaction.",
    "cum_dose_unit": "Unit of the total dose.",
    "dechal": "Whether the reaction eased after stopping.",
    "rechal": "Whether the reaction came back after restarting.",
    "lot_num": "Lot number.",
    "exp_dt": "Expiry date.",
    "nda_num": "Application number of the product.",
    "dose_amt": "Amount of one dose.",
    "dose_unit": "Unit of one dose.",
    "dose_form": "Form of the product.",
    "dose_freq": "How often a dose is taken.",
}
_REAC = {
    "primaryid": "Report key; joins all four tables.",
    "caseid": "Case number.",
    "pt": "Preferred term of the reaction.",
    "drug_rec_act": "Reaction seen again when the drug was given again.",
}
_OUTCOME = {
    "primaryid": "Report key; joins all four tables.",
    "caseid": "Case number.",
    "outc_cod": "Outcome code of the report.",
}

TABLE_COMMENTS = {
    "demographics": "One row per report: patient, dates and sender.",
    "drug": "One row per drug in a report.",
    "reac": "One row per reaction in a report.",
    "outcome": "One row per outcome of a report.",
}

# File-name pattern of each table's input family.
FILE_PATTERNS = {
    "demographics": "DEMO*.txt",
    "drug": "DRUG*.txt",
    "reac": "REAC*.txt",
    "outcome": "OUTC*.txt",
}


def _struct(columns: dict[str, str]) -> StructType:
    return StructType([StructField(name, StringType(), True, {"comment": text}) for name, text in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "demographics": _struct(_DEMOGRAPHICS),
    "drug": _struct(_DRUG),
    "reac": _struct(_REAC),
    "outcome": _struct(_OUTCOME),
}

# Fixed values of the data model.
PRIMARY_SUSPECT = "PS"
SEVERE_OUTCOMES = ("DE", "LT", "HO", "DS")  # death, life threatening, hospitalised, disability
DEATH = "DE"
