"""The closed set of entity types as a dimension, and the shipped policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Type, layer, class, zone, default action, placeholder label.
ENTITY_TYPES = [
    ("TR_TCKN", "deterministic", "general", "Z3", "mask", "TCKN"),
    ("TR_VKN", "deterministic", "general", "Z3", "mask", "VKN"),
    ("TR_IBAN", "deterministic", "general", "Z3", "mask", "IBAN"),
    ("IBAN_OTHER", "deterministic", "general", "Z3", "mask", "IBAN"),
    ("CREDIT_CARD", "deterministic", "general", "Z5", "block", "KART"),
    ("TR_PHONE", "deterministic", "general", "Z2", "mask", "TEL"),
    ("TR_PLATE", "deterministic", "general", "Z2", "mask", "PLAKA"),
    ("TR_SGK", "deterministic", "general", "Z3", "mask", "SGK"),
    ("EMAIL", "deterministic", "general", "Z2", "mask", "EPOSTA"),
    ("SECRET_API_KEY", "deterministic", "secret", "Z5", "block", "SIR"),
    ("SECRET_JWT", "deterministic", "secret", "Z5", "block", "SIR"),
    ("SECRET_PRIVATE_KEY", "deterministic", "secret", "Z5", "block", "SIR"),
    ("PERSON", "ner", "general", "Z2", "mask", "KISI"),
    ("ADDRESS", "ner", "general", "Z2", "mask", "ADRES"),
    ("ORG", "ner", "general", "Z1", "allow", "KURUM"),
    ("DOB", "ner", "general", "Z2", "mask", "DOGUM"),
    ("HEALTH", "ner", "special", "Z5", "block", "SAGLIK"),
    ("RELIGION", "ner", "special", "Z5", "block", "INANC"),
    ("ETHNICITY", "ner", "special", "Z5", "block", "KOKEN"),
    ("POLITICAL", "ner", "special", "Z5", "block", "GORUS"),
    ("SEXUAL_LIFE", "ner", "special", "Z5", "block", "MAHREM"),
    ("CRIMINAL", "ner", "special", "Z5", "block", "SABIKA"),
    ("BIOMETRIC_REF", "ner", "special", "Z5", "block", "BIYOMETRI"),
    ("UNION", "ner", "special", "Z5", "block", "UYELIK"),
]
COLUMNS = "type string, layer string, kvkk_class string, z_class string, default_action string, label string"
TYPES = [t[0] for t in ENTITY_TYPES]
DETERMINISTIC = [t[0] for t in ENTITY_TYPES if t[1] == "deterministic"]
LABELS = {t[0]: t[5] for t in ENTITY_TYPES}
LAYERS = {t[0]: t[1] for t in ENTITY_TYPES}

# The shipped policy. A rule names types or a class.
POLICY_RULES = [
    {"kvkk_class": "special", "action": "block"},
    {"kvkk_class": "secret", "action": "block"},
    {"types": ["TR_TCKN", "TR_VKN", "TR_IBAN", "IBAN_OTHER", "CREDIT_CARD", "TR_PHONE", "TR_PLATE", "TR_SGK"], "action": "mask"},
    {"types": ["PERSON", "ADDRESS", "EMAIL"], "action": "mask"},
    {"types": ["ORG"], "action": "allow"},
]
POLICY_DEFAULTS = {"unknown_entity": "block", "multimodal": "block", "collision_mode": "reject", "response_scan": "off"}

# Labels of an external privacy corpus and the types they stand for.
EXTERNAL_LABELS = {
    "ADDRESS": "ADDRESS", "BUILDINGNUM": "ADDRESS", "BUILDINGNUMBER": "ADDRESS", "CITY": "ADDRESS",
    "COMPANYNAME": "ORG", "COUNTY": "ADDRESS", "DATEOFBIRTH": "DOB", "DOB": "DOB", "ETHNICITY": "ETHNICITY",
    "FIRSTNAME": "PERSON", "GIVENNAME": "PERSON", "HEALTHCONDITION": "HEALTH", "LASTNAME": "PERSON",
    "MEDICALCONDITION": "HEALTH", "NAME": "PERSON", "ORGANIZATION": "ORG", "PERSON": "PERSON",
    "STATE": "ADDRESS", "STREET": "ADDRESS", "SURNAME": "PERSON", "ZIPCODE": "ADDRESS",
}


def taxonomy(spark: SparkSession) -> DataFrame:
    """24 rows, small enough to broadcast by construction."""
    return spark.createDataFrame(ENTITY_TYPES, COLUMNS)
