"""Held-out accuracy, the given documents' licence lines, odd texts."""

import json
import re

import pytest

from auditlens.llm import license_templates, licenses, queries
from tests.conftest import SF

LINES = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
         "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark)


def test_held_out_accuracy(spark, model):
    rows = [(k, t, f) for k, (t, f) in enumerate(license_templates.labelled(seed=99, per_template=12))]
    found = {r.doc_id: r.licenses for r in licenses.license_verdicts(
        spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), model).collect()}
    right = sum(found[k] == ("" if f == license_templates.UNKNOWN else f) for k, _, f in rows)
    false = sum(found[k] != "" for k, _, f in rows if f == license_templates.UNKNOWN)
    assert right / len(rows) > 0.95 and false / len(rows) < 0.01, (right / len(rows), false)


def test_other_wordings(spark, model):
    """The names of families speak for them, and notices worded as in no template are found, confirmed or not."""
    weights = {e["g"]: e["w"] for cell in json.loads(model.weights) for e in cell}
    for name, family in {"mit": "MIT", "apache": "Apache-2.0", "bsd": "BSD", "mozilla": "MPL-2.0"}.items():
        assert weights[name][model.families.index(family)] > max(0, weights[name][0])
    told = {"This code is under the BSD license": "BSD", "Mozilla Public License applies to this file": "MPL-2.0", "under the AGPL": "AGPL", "Licensed under the GPL": "GPL"}
    df = spark.createDataFrame([*enumerate(told)], "doc_id long, text string")
    assert {r.doc_id: r.family for r in licenses.license_paragraphs(df, model).collect()} == dict(enumerate(told.values()))
    assert all(r.n_paragraphs + r.n_unconfirmed == 1 for r in licenses.license_verdicts(df, model).collect())


def test_short_notices(spark, model):
    told = {"License: MIT": "MIT", "licensed under MIT": "MIT", "Apache-licensed": "Apache-2.0", "Licence: LGPL": "LGPL", "released under GPLv3": "GPL", "(c) Jane, CC BY 4.0": "CC-BY"}
    df = spark.createDataFrame([*enumerate(told)], "doc_id long, text string")
    assert {r.doc_id: r.family for r in licenses.license_paragraphs(df, model).collect()} == dict(enumerate(told.values()))


def test_foreign_notices(spark, model):
    """Licences that are no family are never confirmed, those the sample has no word of included."""
    notices = [*license_templates.FOREIGN, *license_templates.UNSEEN, "Licensed under the Eclipse Public License 2.0", "Released under the Sleepycat License.",
               "Licensed under the Python Software Foundation License, Version 2.", "Licensed under the Solderpad Hardware License, Version 2.1."]
    found = licenses.license_verdicts(spark.createDataFrame([*enumerate(notices)], "doc_id long, text string"), model).collect()
    assert {notices[r.doc_id]: r.licenses for r in found if r.licenses} == {}


def test_given_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_licenses"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.licenses == ",".join(sorted({f for line, f in LINES.items() if line in texts[r.doc_id]})), r


def test_odd_texts(spark, model):
    words = "there was some prose " * 3000
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "License"), (5, words + "\nReleased under the MIT License.\n" + words), (6, "MIT MIT MIT"),
            (7, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (None, "Released under the BSD 3-Clause License.")]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows] + [(2, None, "g", 4)], "doc_id long, text string, family string, line int")
    found = {r.doc_id: r.licenses for r in licenses.license_verdicts(df, model).collect()}
    assert found == {1: "", 2: "", 3: "", 4: "", 5: "MIT", 6: "", 7: "Apache-2.0,CC-BY-NC", None: "BSD"}
    assert licenses.license_verdicts(df.limit(0), model).count() == 0


def test_no_python_in_the_plan(spark, model):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", licenses.license_verdicts(df, model)._jdf.queryExecution().executedPlan().toString())
