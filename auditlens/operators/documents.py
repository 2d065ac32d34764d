"""Document checklist, and recognising which document a text is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.vocabulary import severity_rank
from auditlens.sources.store import KEYS

# --- fixed values: checklist ids, names and severities, in table order ---
REQUIREMENTS = (
    ("DOC-CLAIM-FORM", "Signed claim form (Parts A and B)", "BLOCKER"),
    ("DOC-DISCHARGE-SUMMARY", "Discharge summary", "BLOCKER"),
    ("DOC-FINAL-BILL", "Itemised final bill", "BLOCKER"),
    ("DOC-MLC", "Medico-legal certificate or FIR copy", "BLOCKER"),
    ("DOC-IMPLANT-INV", "Implant invoice with batch number and sticker", "BLOCKER"),
    ("DOC-PED-HISTORY", "Past treatment records / first consultation papers", "BLOCKER"),
    ("DOC-INDOOR-PAPERS", "Indoor case papers", "WARNING"),
    ("DOC-INVESTIGATION-REPORTS", "Investigation reports matching billed diagnostics", "WARNING"),
    ("DOC-OT-NOTES", "Operation theatre notes", "WARNING"),
    ("DOC-PHARMACY-BILLS", "Pharmacy bills with prescriptions", "WARNING"),
    ("DOC-PREAUTH-ENHANCEMENT", "Pre-authorisation enhancement request", "BLOCKER"),
    ("DOC-ID-PROOF", "Photo identity proof of the insured", "INFO"),
)
HIGH_VALUE_PAISE = 10_000_000
# Document kinds with the headings that give them away, in order of preference on a tie.
SIGNATURES = (
    ("DOC-FINAL-BILL", "Itemised bill", ("itemized bill", "itemised bill", "final bill", "total amount due")),
    ("DOC-DISCHARGE-SUMMARY", "Discharge summary", ("discharge summary", "condition on discharge", "final diagnosis")),
    ("DOC-CLAIM-FORM", "Claim form", ("claim form", "insured details", "declaration", "hereby declare")),
    ("DOC-PREAUTH-ENHANCEMENT", "Pre-authorisation letter",
     ("pre-authorization", "pre-authorisation", "preauth", "authorization no")),
    ("DOC-IMPLANT-INV", "Implant invoice", ("implant", "batch no", "hsn code", "ligation clip")),
    ("DOC-INVESTIGATION-REPORTS", "Investigation report",
     ("laboratory report", "pathology", "reference range", "haematology", "hematology")),
    ("DOC-OT-NOTES", "OT notes", ("operation theatre notes", "ot notes", "operative notes", "procedure performed")),
    ("DOC-PHARMACY-BILLS", "Pharmacy bill", ("pharmacy bill", "medicine bill", "drug charges")),
    ("DOC-MLC", "MLC / FIR copy", ("medico-legal", "medico legal", "mlc", "first information report")),
    ("DOC-ID-PROOF", "ID proof", ("aadhaar", "aadhar", "pan card", "passport no", "identity proof")),
    ("DOC-INDOOR-PAPERS", "Indoor case papers", ("indoor case", "case sheet", "nursing notes", "vitals chart")),
    ("DOC-POLICY", "Policy schedule", ("policy schedule", "sum insured", "important coverages", "waiting period")),
    ("DOC-DEDUCTION-SUMMARY", "TPA deduction summary", ("deduction summary", "reason for deduction", "net payable")),
)
UNRECOGNISED = "Unrecognised"
# --- end of fixed values ---

_WHY = {
    "DOC-CLAIM-FORM": "Every claim needs it.",
    "DOC-DISCHARGE-SUMMARY": "Shows diagnosis, treatment and length of stay.",
    "DOC-FINAL-BILL": "Without single items a bill cannot be checked line by line.",
    "DOC-MLC": "Shows how the injury of an accident claim came about.",
    "DOC-IMPLANT-INV": "Implants are paid only against invoice and batch sticker.",
    "DOC-PED-HISTORY": "Dates the first diagnosis against the waiting period.",
    "DOC-INDOOR-PAPERS": "Asked for on high bills and on reimbursement.",
    "DOC-INVESTIGATION-REPORTS": "Billed tests need their reports.",
    "DOC-OT-NOTES": "Billed procedures need the notes of the theatre.",
    "DOC-PHARMACY-BILLS": "Medicines need a prescription on file.",
    "DOC-PREAUTH-ENHANCEMENT": "The bill is well over what was approved beforehand.",
    "DOC-ID-PROOF": "Usual proof of identity; its absence only delays.",
}


def over_preauth() -> Column:
    """Bill more than 10 % above what was approved, compared without division."""
    return F.coalesce(F.col("gross_paise") * 10 > F.col("preauth_paise") * 11, F.lit(False))


def applies() -> dict[str, Column]:
    """When a document is required, on a claim with its measures; one that is not listed always is."""
    return {
        "DOC-MLC": F.col("is_accident"),
        "DOC-IMPLANT-INV": F.col("involves_implant") | (F.col("lines_implant") > 0),
        "DOC-PED-HISTORY": F.col("is_ped_related"),
        "DOC-INDOOR-PAPERS": (F.col("gross_paise") > HIGH_VALUE_PAISE) | (F.col("claim_type") == "reimbursement"),
        "DOC-INVESTIGATION-REPORTS": F.col("lines_investigation") > 0,
        "DOC-OT-NOTES": F.col("lines_procedure") > 0,
        "DOC-PHARMACY-BILLS": F.col("lines_pharmacy") > 0,
        "DOC-PREAUTH-ENHANCEMENT": F.coalesce(F.col("preauth_paise") != 0, F.lit(False)) & over_preauth(),
    }


def _attached() -> Column:
    return F.transform(F.coalesce(F.col("documents"), F.array().cast("array<string>")), lambda d: F.upper(tx.strip(d)))


def attached_bits() -> Column:
    """The listed documents that are attached, a bit each in table order: all that a checklist reads of the list, in one number.

    The lambda binds the cleaned list: written out, it is cleaned again for every requirement.
    """
    bit = lambda i, found: F.when(F.coalesce(F.array_contains(found, F.lit(REQUIREMENTS[i][0])), F.lit(True)), 1 << i).otherwise(0)
    bits = F.transform(F.array(_attached()), lambda found: sum((bit(i, found) for i in range(1, len(REQUIREMENTS))), bit(0, found)))
    return F.get(bits, F.lit(0)).cast("bigint")


def _missing(attached: Column) -> dict[str, Column]:
    """document id -> whether it is required and its bit is not set."""
    needed = applies()
    return {doc: F.coalesce(needed.get(doc, F.lit(True)), F.lit(False)) & (attached.bitwiseAND(F.lit(1 << i)) == 0) for i, (doc, *_) in enumerate(REQUIREMENTS)}


def with_gap_count(facts: DataFrame, name: str) -> DataFrame:
    """Adds the number of missing documents of a claim, without their names and reasons."""
    count = sum((F.when(c, 1).otherwise(0) for c in _missing(F.col("attached")).values()), F.lit(0))
    return facts.withColumn(name, count.cast("bigint"))


def gap_array(facts: DataFrame) -> Column:
    """Missing documents of a claim as an array, most severe first, then in table order."""
    missing = _missing(F.col("attached"))
    rank = {"BLOCKER": 0, "WARNING": 1, "INFO": 2}
    table = sorted(enumerate(REQUIREMENTS), key=lambda r: (rank[r[1][2]], r[0]))
    return F.array_compact(F.array(*[
        F.when(missing[doc], F.struct(
            F.lit(doc).alias("document_id"), F.lit(name).alias("name"), F.lit(sev).alias("severity"),
            F.lit(_WHY[doc]).alias("reason"), F.lit(i + 1).alias("position")))
        for i, (doc, name, sev) in table]))


def check_documents(facts: DataFrame) -> DataFrame:
    """Long table of gaps; `ord` is the position in the claim's list."""
    return facts.select(*KEYS, F.posexplode(gap_array(facts)).alias("ord", "g")).select(
        *KEYS, "ord", "g.document_id", "g.name", "g.severity", "g.reason",
        F.lit("context.documents_attached").alias("field"), F.lit("not attached").alias("observed"), F.col("g.name").alias("expected"))


def signature_scores(text: Column) -> list[Column]:
    haystack = tx.normalise_text(text)
    return [
        sum((F.when(F.contains(haystack, F.lit(w)), 1).otherwise(0) for w in words[1:]),
            F.when(F.contains(haystack, F.lit(words[0])), 1).otherwise(0))
        for _, _, words in SIGNATURES]


def detect_document_type(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds document_type, document_label and keyword_hits. The most keywords win, ties go to the earlier kind."""
    scored = [
        F.struct(score.alias("hits"), F.lit(-i).alias("pref"), F.lit(doc).alias("id"), F.lit(label).alias("label"))
        for i, ((doc, label, _), score) in enumerate(zip(SIGNATURES, signature_scores(F.col(text))))]
    best = F.col("_best")
    return docs.withColumn("_best", F.array_max(F.array(*scored))).select(
        *docs.columns,
        F.when(best["hits"] > 0, best["id"]).alias("document_type"),
        F.when(best["hits"] > 0, best["label"]).otherwise(UNRECOGNISED).alias("document_label"),
        best["hits"].alias("keyword_hits"))


def correct_document_type(detected: DataFrame, priced_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document with priced rows is the bill, whatever its words say; one with neither is rejected."""
    counts = priced_rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_priced"))
    priced = F.coalesce(F.col("n_priced"), F.lit(0)) > 0
    return detected.join(counts, key, "left").withColumns({
        "document_type": F.when(priced, "DOC-FINAL-BILL").otherwise(F.col("document_type")),
        "document_label": F.when(priced, "Itemised bill").otherwise(F.col("document_label")),
        "n_priced": F.coalesce("n_priced", F.lit(0)),
    }).withColumn("rejected", F.col("document_type").isNull())


def ranked_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(*KEYS, severity_rank(F.col("severity")), "ord")
