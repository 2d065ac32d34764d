"""Closed vocabularies and the small maps over them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: labels shared with every stored audit ---
HEADS = (
    "ROOM", "NURSING", "PROCEDURE", "CONSULTATION",
    "INVESTIGATION", "PHARMACY", "IMPLANT", "OTHER",
)
CLASSES = (
    "PAYABLE", "LIST_I_OPTIONAL", "LIST_II_ROOM",
    "LIST_III_PROCEDURE", "LIST_IV_TREATMENT", "UNMAPPED",
)
BEARER_BY_CLASS = {
    "PAYABLE": "INSURER",
    "LIST_I_OPTIONAL": "PATIENT",
    "LIST_II_ROOM": "HOSPITAL",
    "LIST_III_PROCEDURE": "HOSPITAL",
    "LIST_IV_TREATMENT": "HOSPITAL",
    "UNMAPPED": "UNKNOWN",
}
SEVERITIES = ("BLOCKER", "WARNING", "INFO")
# Severity of a finding that cites no rule.
SEVERITY_WITHOUT_RULE = {
    "PAYABLE": "INFO",
    "LIST_I_OPTIONAL": "INFO",
    "LIST_II_ROOM": "WARNING",
    "LIST_III_PROCEDURE": "WARNING",
    "LIST_IV_TREATMENT": "WARNING",
    "UNMAPPED": "BLOCKER",
}
# --- end of fixed values ---


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small constant table; NULL for a key that is not in it."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def bearer_of(classification: Column) -> Column:
    return lookup(classification, BEARER_BY_CLASS)


def fallback_severity(classification: Column) -> Column:
    return lookup(classification, SEVERITY_WITHOUT_RULE)


def severity_rank(severity: Column) -> Column:
    """0 for the most urgent. Unknown severities get NULL."""
    return F.when(severity == "BLOCKER", 0).when(severity == "WARNING", 1).when(severity == "INFO", 2)


def is_listed(classification: Column) -> Column:
    return classification.startswith("LIST_")


def recoverable_classes(classes: Column) -> Column:
    """Keep the classes of an array whose cost the hospital bears."""
    return F.filter(classes, lambda c: bearer_of(c) == "HOSPITAL")
