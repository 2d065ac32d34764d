"""Text, date and packet-field expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: word lists and patterns that decide results ---
HEAD_BY_DEPARTMENT = (
    ("accommodation", "ROOM"),
    ("nursing", "NURSING"),
    ("surgical", "PROCEDURE"),
    ("procedure", "PROCEDURE"),
    ("professional", "CONSULTATION"),
    ("consult", "CONSULTATION"),
    ("diagnostic", "INVESTIGATION"),
    ("radiology", "INVESTIGATION"),
    ("lab", "INVESTIGATION"),
    ("pharmacy", "PHARMACY"),
    ("implant", "IMPLANT"),
)
ICU_WORDS = ("icu", "intensive care", "critical care", "hdu", "high dependency", "itu")
TOKEN = "[a-z0-9]+"
MONEY_MENTION = r"(?:Rs\.?\s*|₹\s*)?(\d[\d,]{3,}(?:\.\d{1,2})?)"
CHUNK_FLOOR = 1200
# --- end of fixed values ---


def strip(x: Column) -> Column:
    """Drop all leading and trailing whitespace, tabs and newlines included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def item_key(description: Column) -> Column:
    return strip(F.lower(description))


def normalise_text(x: Column) -> Column:
    return strip(F.regexp_replace(F.lower(x), r"\s+", " "))


def tokenize(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), 1)


def head_from_department(department: Column) -> Column:
    low = F.lower(department)
    chain = None
    for word, head in HEAD_BY_DEPARTMENT:
        chain = (F if chain is None else chain).when(low.contains(word), head)
    return chain.otherwise("OTHER")


def is_icu(description: Column) -> Column:
    low = F.lower(description)
    hit = F.lit(False)
    for word in ICU_WORDS:
        hit = hit | low.contains(word)
    return hit


def length_of_stay(admission: Column, discharge: Column) -> Column:
    return F.datediff(discharge, admission)


def claim_month(admission: Column, discharge: Column, month_of: str = "discharge") -> Column:
    """YYYY-MM of the discharge (online audits) or of the admission (bulk loads)."""
    return F.date_format({"discharge": discharge, "admission": admission}[month_of], "yyyy-MM")


def money_mentions(x: Column) -> Column:
    """Numbers of four characters and more in prose, as written."""
    return F.regexp_extract_all(x, F.lit(MONEY_MENTION), 1)


def mention_value(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("decimal(28,2)")


def search_text(title: Column, aliases: Column, body: Column) -> Column:
    return F.concat(title, F.lit(". "), F.array_join(aliases, " "), F.lit(". "), body)


def attribution(reference: Column, title: Column, source_id: Column, citation: Column) -> Column:
    """'<authority>, <citation>'; a blank reference counts as missing."""
    authority = F.coalesce(F.nullif(reference, F.lit("")), title, source_id)
    return F.concat(authority, F.lit(", "), citation)


def staleness(status: Column, superseded_by: Column, verified_on: Column, today: Column) -> Column:
    """Why a source should not be trusted silently, or NULL."""
    age = F.datediff(today, verified_on)
    return (
        F.when(status == "superseded",
               F.concat(F.lit("Replaced; the text now in force: "), F.coalesce(F.nullif(superseded_by, F.lit("")), F.lit("not recorded"))))
        .when((status == "unverified") | verified_on.isNull(),
              F.lit("Nobody has compared this with the published text."))
        .when(age > 365, F.concat(F.lit("Compared on "), verified_on.cast("string"), F.lit(", which is "),
                                  age.cast("string"), F.lit(" days back.")))
    )


def chunk_text(x: Column, budget: int) -> Column:
    """Cut a text into pieces of at most `budget` characters, only between lines.

    A line longer than the budget stays whole. The fold keeps (finished pieces, open piece).
    """
    limit = max(CHUNK_FLOOR, budget)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, line: Column) -> Column:
        full = (F.length(state["open"]) + F.length(line) > limit) & (F.length(state["open"]) > 0)
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full, line).otherwise(F.concat(state["open"], line)).alias("open"))

    def finish(state: Column) -> Column:
        blank = strip(state["open"]) == ""
        return F.when(blank, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))

    lines = F.regexp_extract_all(x, F.lit(r"([^\n]*\n|[^\n]+$)"), 1)
    return F.when(F.length(x) <= limit, F.array(x)).otherwise(F.aggregate(lines, start, step, finish))
