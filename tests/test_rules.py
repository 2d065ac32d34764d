import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditlens.functions.rows import spread
from auditlens.operators import assess, portfolio
from auditlens.plans.audit import corpus_version
from auditlens.sources import rules as rf

TODAY = dt.date(2026, 1, 1)
BLOCK = "<!-- source:\njurisdiction: IN\nlist: LIST_II_ROOM\nbearer: HOSPITAL\nseverity: WARNING\nsource_id: CAT-LISTS\ncitation: c\ncitation_precision: list\n-->\n"


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}.md", t) for i, t in enumerate(texts)], "path string, text string")


def test_catalogue_is_sound(spark, catalogue):
    rules = rf.load_rules(rf.packaged_rule_files(spark), catalogue[1])
    assert rules.count() == 23 and rules.where("list_name is null").count() == 2
    assert rules.where("chunk_id = 'PER-04'").first().severity == "WARNING", "the header wins over the file"
    assert rules.where("aliases is null or title = '' or body = ''").count() == 0


@pytest.mark.parametrize("text, problem", [
    ("### no block\n<!-- chunk_id: A -->\n### T\nbody", "no source block"),
    (BLOCK.replace("citation: c\n", "") + "<!-- chunk_id: A -->\n### T\nbody", "missing citation"),
    (BLOCK + "<!-- chunk_id: A | severity: LOUD -->\n### T\nbody", "unknown severity"),
    (BLOCK + "<!-- chunk_id: A -->\n### T\nb\n<!-- chunk_id: A -->\n### T\nb", "duplicate chunk_id"),
    (BLOCK.replace("CAT-LISTS", "NOWHERE") + "<!-- chunk_id: A -->\n### T\nb", "unknown source_id"),
    (BLOCK, "no rules found"),
])
def test_unsound_catalogues_are_refused(spark, catalogue, text, problem):
    with pytest.raises(ValueError, match=problem):
        rf.load_rules(files(spark, text), catalogue[1])


def test_keys_and_values_are_worked_out_once(spark):
    """Written into its own lambda, the list of pairs was parsed again for every pair of it."""
    text = "a: 1\n:none\nno colon|b : x:y \n a:2|\n : 3\nb2:"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "block string").select(rf.key_values(F.col("block")).alias("m"))
    assert [r.m for r in rows.collect()] == [{"a": "2", "b": "x:y", "b2": ""}, {}, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_work_of_few_bytes_is_spread(spark):
    few, many = spark.range(10).coalesce(1), spark.range(100).coalesce(1)
    assert spread(few, 10, "id").rdd.getNumPartitions() == 1 and spread(many, 10, "id").rdd.getNumPartitions() == 10
    assert sorted(r.id for r in spread(many, 10, "id").collect()) == list(range(100))


def test_rule_text(spark):
    r = rf.parse_rules(files(spark, BLOCK + "<!-- chunk_id: A | topic: x -->\n## A title\nAliases: one,  two ,,\nSome\n  body.\n<!-- chunk_id: B -->\njust text")).orderBy("pos").collect()
    assert (r[0].title, r[0].aliases, r[0].body, r[0].topic, r[0].list_name) == ("A title", ["one", "two"], "Some body.", "x", "LIST_II_ROOM")
    assert (r[1].title, r[1].aliases, r[1].body) == ("B", [], "just text")


def test_reads_directories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text(BLOCK + "<!-- chunk_id: A -->\n### T\nbody")
    (tmp_path / "note.txt").write_text("not a rule")
    assert [r.chunk_id for r in rf.parse_rules(rf.read_rule_files(spark, str(tmp_path))).collect()] == ["A"]


def test_staleness_and_version(spark, catalogue):
    rules, sources = catalogue
    stale = {r.source_id: r.reason for r in assess.stale_sources(rules, sources, TODAY).collect()}
    assert set(stale) == {"CAT-LISTS", "CAT-WORDING"}, "a source nothing cites is not reported"
    assert "700 days" in stale["CAT-WORDING"]
    version = lambda r, s=sources: corpus_version(r, s, TODAY).first().corpus_version
    assert version(rules).startswith("unverified-")
    moved = rules.withColumn("bearer", F.when(F.col("chunk_id") == "ROM-01", "PATIENT").otherwise(F.col("bearer")))
    assert version(moved) != version(rules) == version(rules.orderBy(F.rand(1)))
    fresh = sources.withColumns({"status": F.lit("in_force"), "verified_on": F.lit(TODAY)})
    assert version(rules, fresh).startswith("verified-")


def test_search_looks_into_aliases(catalogue):
    found = lambda q, l=None: {r.chunk_id for r in portfolio.rules_search(catalogue[0], q, l).collect()}
    assert found("TV HIRE") == {"PER-03"} and found("tv hire", "LIST_II_ROOM") == set()
    assert found("", "POLICY_WORDING") == {"WRD-01", "WRD-02"} and found("rom-0") == {f"ROM-0{i}" for i in range(1, 7)}
