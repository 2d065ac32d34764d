import datetime as dt
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from auditlens.plans.batch import audit_batch  # noqa: E402
from auditlens.session import local_session  # noqa: E402
from auditlens.sources import packets as pk  # noqa: E402
from auditlens.sources import rules as rf  # noqa: E402

TODAY = dt.date(2026, 1, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def catalogue(spark):
    rules, sources = rf.catalogue(spark)
    return rules.persist(), sources.persist()


def line(no, description, amount, head="OTHER", **more):
    return {"line_no": no, "description": description, "head": head, "amount": str(amount), **more}


def packet(claim_id, lines, *, rate="4000", days=3, cap="6000", icu=False, **more):
    """A sound, uneventful packet: three nights within the limit, all papers attached."""
    context = {
        "claim_type": "cashless", "admission_date": "2026-05-04", "discharge_date": "2026-05-07", "primary_diagnosis": "Fever",
        "documents_attached": ["DOC-CLAIM-FORM", "doc-discharge-summary ", "DOC-FINAL-BILL", "DOC-ID-PROOF", "DOC-INDOOR-PAPERS",
                               "DOC-INVESTIGATION-REPORTS", "DOC-OT-NOTES", "DOC-PHARMACY-BILLS"], **more.pop("context", {})}
    policy = {"policy_id": "P", "sum_insured": "500000", "balance_sum_insured": "500000", "room_rent_cap_per_day": cap,
              "icu_cap_per_day": "12000", **more.pop("policy", {})}
    stay = {"room_category": "Room", "rate_per_day": str(rate), "days": days, "is_icu": icu}
    return {"claim_id": claim_id, "context": context, "policy": policy, "room_stay": stay, "line_items": lines, **more}


@pytest.fixture(scope="session")
def run(spark, catalogue):
    """Audit packets given as dictionaries (or raw texts); returns (tables, outcomes)."""
    def go(*docs, **options):
        texts = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
        packets = pk.parse_packets(spark.createDataFrame(texts, "json string")).persist()
        return audit_batch(packets, *catalogue, tenant=F.lit("t"), today=TODAY, **options)
    return go


def by_claim(df):
    return {r.claim_id: r for r in df.collect()}
