"""Plans of the registered queries, and a sample of them against their oracle."""

import decimal
import re

import duckdb
import pytest

from auditlens.operators import waterfall
from suite import load
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REG = load()
# Row-level Python is confined to these.
PYTHON = {"R2", "R3", "R4", "R6", "J9", "E3", "E4", "U1", "U2", "C4", "C5", "C8", "E1", "E2", "E7", "J11", "ST1", "ST1H", "ST2", "ST5"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return str(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("key", ["FN4", "SRC3", "SRC5", "SRC7", "SRC7F", "SRC8", "SRC8F", "SRC8Q", "C2", "W10", "W14", "D1", "K10", "V4", "A7", "P1", "P7", "L3", "L2A", "L3A", "R4", "X2", "E5", "BAT4", "ST1", "ST1H", "ST1S", "ST2S"])
def test_oracle(spark, con, key):
    df = REG.QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(REG.ORACLE[key])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and got == want and got


@pytest.mark.parametrize("key", ["C2", "J1", "W10", "A7", "K10", "D1", "P1", "P7", "R1", "L2", "X1", "E1"])
def test_no_cross_joins_and_no_row_python(spark, key):
    plan = REG.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and ("InPandas" in plan) <= (key in PYTHON)


def test_the_lines_are_never_shuffled_whole_for_the_measures(spark):
    """Measures are combined before the shuffle, on the claim key alone."""
    x = REG.context(spark, SF)
    plan = x.audit.facts.select("tenant", "claim_id", "gross_paise")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("hashpartitioning(tenant") <= 6


def test_shares_add_up_and_profiles_are_ordered(spark):
    x = REG.context(spark, SF)
    assert waterfall.invariant_breaks(x.audit.waterfall).count() == 0
    rows = x.audit.waterfall.groupBy("tenant", "claim_id").pivot("profile", ["conservative", "typical", "lenient"]).max("settlement_paise")
    heads = x.audit.facts.select("tenant", "claim_id", "payable_investigation", "payable_consultation", "n_credit")
    bad = rows.join(heads, ["tenant", "claim_id"]).where("n_credit = 0 and not (conservative <= typical and typical <= lenient)")
    assert bad.count() == 0


@pytest.mark.parametrize("key, reads", [("L2", 0), ("J7", 1)])
def test_measures_and_ledger_rows_are_computed_once(spark, key, reads):
    """What is left to do reads kept rows; the bill lines come in again only where the lines themselves are asked for."""
    files = REG.QUERIES[key](spark, SF).inputFiles()
    assert sum(f.endswith("lineitem.parquet") for f in files) <= reads
    assert any("/ledger-rows-" in f or "/facts-" in f for f in files)


def test_deduction_rows_are_compared_whole(spark, con):
    """F8 W11: the query makes basis, inputs and formula of every step as well, and its SQL has them."""
    df = REG.QUERIES["W11"](spark, SF)
    assert {"basis", "inputs", "formula", "clamped"} <= set(df.columns)
    cur = con.execute(REG.ORACLE["W11"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    got = sorted(tuple(r) for r in df.collect())
    assert got == want and {r[names.index("step")] for r in want} >= set(waterfall.STEPS[:5])


@pytest.fixture
def shuffled_joins(spark):
    """Plans as they are for large tables: no join is a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def dealt_by(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


@pytest.mark.parametrize("key", ["V3", "V4", "J7"])
def test_figures_are_compared_inside_of_a_claim(spark, shuffled_joins, key):
    """F4 V3, F5 V4, F7 J7: what moves is a claim's row and its lines; unfolded figures, some 60 a claim, never do."""
    df = REG.QUERIES[key](spark, SF)
    if key == "V4":  # its own grouping comes on top
        df = df.drop("n").select("tenant", "claim_id").distinct()
        assert sum("paise" in keys or "_groupingexpression" in keys for keys in dealt_by(df)) <= 1
    else:
        assert dealt_by(df) and all(keys == ["tenant", "claim_id"] for keys in dealt_by(df))


def test_an_audit_with_narratives_is_worked_out_once(spark):
    """F6 A7: the narrative, its check and the rows read kept measures and lines; the warehouse is not read for each of them again."""
    files = REG.QUERIES["A7"](spark, SF).inputFiles()
    assert not [f for f in files if "testdata" in f] and any("/facts-" in f for f in files) and any("/findings-" in f for f in files)


def test_both_readers_of_the_lines_share_their_rows(spark, shuffled_joins):
    """F6 A7: measures and repeats of a claim need other columns of a line, but the lines come out of the warehouse in one exchange."""
    x = REG.context(spark, SF)
    df = x.audit.facts.select("tenant", "claim_id", "unsure_paise", "repeated_paise")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(k#") + plan.count("ReusedExchange") >= 2
    assert len(re.findall(r"FileScan parquet \[l_orderkey#", plan)) < len(re.findall(r"FileScan parquet \[l_orderkey#", df._jdf.queryExecution().optimizedPlan().toString())) or "ReusedExchange" in plan
