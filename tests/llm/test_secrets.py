"""Secret spans against a plain scan, links between parts, odd inputs."""

import hashlib
import re

import pytest

from auditlens.llm import queries, secrets
from tests.conftest import SF

BASE = (("assign", re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))


def plain(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def check(rows, texts):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)], r
        assert r.base_sha256 == digest(want), (r, want)


def test_against_a_plain_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    check(queries.QUERIES["op3_secrets"](spark, SF).collect(), dict(zip(docs.doc_id, docs.text)))


HEX = "0123456789abcdef01234567"
CASES = {
    1: None, 2: "", 3: "secret=token: abcdefgh", 4: 'é password = "' + "x" * 6 + f'" 😀 {HEX}' + " AKIA" + "A" * 16,
    5: "AKIAAKIA" + "B" * 13, 6: f"{HEX} " * 3000, 7: "token=\ntoken=abc.def", 8: "api_key:'a' apikey= abcdef API_KEY=zzzzzz9",
}


@pytest.mark.parametrize("extra", [False, True])
def test_odd_texts(spark, extra):
    rows = [(i, t, "a", 1) for i, t in CASES.items()] + [(4, CASES[4], "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, k int")
    check(secrets.span_digests(df if extra else df.select("doc_id", "text")).collect(), CASES)
    assert secrets.span_digests(df.limit(0)).count() == 0


def test_weak_parts_need_their_complement(spark):
    far = "word " * 200
    texts = {1: "client_id=abcd only", 2: "client_id=abcd and password=hunter22", 3: f"client_id=abcd {far} password=hunter22",
             4: "client_id=abcd\n\npassword=hunter22", 5: "https://db.example.org/x login=bob12 secret=abcdefg", 6: "https://db.example.org secret=abcdefg"}
    rows = secrets.secret_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = {i: {r.kind for r in rows if r.doc_id == i} for i in texts}
    assert found == {1: set(), 2: {"weak_id", "assign"}, 3: {"weak_id", "assign"}, 4: {"assign"}, 5: {"weak_id", "assign", "endpoint"}, 6: {"assign"}}


def test_the_scope_is_the_whole_paragraph(spark):
    """Parts far apart in one paragraph link, parts of two paragraphs never do; the digit of a key may be anywhere in it."""
    key, block = "k" * 66 + "7" + "Z" * 20, "\n".join(f"line {i} of the file" for i in range(400))
    texts = {1: f"login=admin1\n{block}\n{key}", 2: f"login=admin1\n\n{key}", 3: f"{key}\n{block}\nclient_id=abcd", 4: f"login=admin1 {'k' * 90}",
             5: f"https://db.example.org\n{block}\nlogin=admin1\n{block}\n{key}"}
    rows = secrets.secret_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = {i: {r.kind for r in rows if r.doc_id == i} for i in texts}
    assert found == {1: {"weak_id", "weak_key"}, 2: set(), 3: {"weak_id", "weak_key"}, 4: set(), 5: {"weak_id", "weak_key", "endpoint"}}
    assert {texts[1][r.start:r.end] for r in rows if r.doc_id == 1} == {"login=admin1", key}


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "a token=abcdef12 b", 18, "s"), (2, "clean", 5, None), (3, None, None, "x"), (None, f"{HEX}", 24, "y")]
    out = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")).collect()}
    assert out[1].text == "a [SECRET] b" and out[1].n_chars == 12 and out[1].source == "s"
    assert out[2].text == "clean" and out[3].text is None and out[None].text == "[SECRET]"


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op3_secrets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
