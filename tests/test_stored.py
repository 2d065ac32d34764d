import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditlens.operators import anchors, ledger, portfolio, retention
from auditlens.plans import adhoc
from auditlens.sources import store as st
from suite import load
from tests.conftest import SF, line, packet

ROOM = line(1, "Room rent", 12000, "ROOM", quantity="3", unit_rate="4000")


@pytest.fixture(scope="module")
def saved(spark, run, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    first, _ = run(packet("A", [ROOM, line(2, "Patient gown", "700.05")]), packet("B", [ROOM, line(2, "Telephone", 500)]))
    st.save_store(path, st.store_rows(first))
    again, _ = run(packet("A", [ROOM, line(3, "Gauze roll", 40)]))
    st.save_store(path, st.store_rows(again))
    return path


def test_saving_again_replaces_the_claim(spark, saved):
    store = st.read_store(spark, saved)
    assert sorted(r.claim_id for r in store.claims.collect()) == ["A", "B"]
    assert sorted((r.claim_id, r.line_no) for r in store.findings.collect()) == [("A", 1), ("A", 3), ("B", 1), ("B", 2)]
    nested = st.get_claim(store, "A").first()
    assert [f.line_no for f in nested.findings] == [1, 3] and str(nested.gross_bill) == "12040.00"
    assert st.get_claim(store, "A", tenant="other").count() == 0


def test_orphans_are_refused(spark, saved, tmp_path):
    store = st.read_store(spark, saved)
    with pytest.raises(ValueError, match="findings"):
        st.save_store(str(tmp_path), st.Store(store.claims.where("claim_id = 'A'"), store.findings, store.doc_gaps))


def test_portfolio_of_nothing(spark, saved):
    store = st.read_store(spark, saved)
    none = portfolio.portfolio_summary(store, tenant="nobody").first()
    assert none.empty and none.gross_paise == 0 and none.avg_deduction_pct == 0
    assert portfolio.leakage_by_cause(store, tenant="nobody").count() == 0
    assert portfolio.recovery_model(store, tenant="nobody").first().empty
    model = portfolio.recovery_model(store, given=1200).first()
    assert (model.recoverable_paise, model.annual_recovery_paise, model.volume_source) == (4000, 2400000, "supplied by you")
    assert [r.item for r in portfolio.top_leaking_items(store).collect()] == ["gauze roll"]


def test_guarded_sql(spark, saved):
    store = st.read_store(spark, saved)
    rows = adhoc.bounded_run(adhoc.guarded_sql(spark, store, "SELECT claim_id, gross_bill FROM v_claims WHERE claim_id <> 'drop; x' ORDER BY 1", "t"), 120)
    assert rows.claim_id.tolist() == ["A", "B"] and rows.gross_bill.tolist() == [12040, 12500]
    assert adhoc.guarded_sql(spark, store, "SELECT * FROM v_claims", "other").count() == 0
    for sql in ("DELETE FROM v_claims", "SELECT 1; SELECT 2", "SELECT * FROM claims", "SELECT 1 /* */ UNION SELECT 2 FROM secrets", "SELECT /*x*/ * FROM v_claims JOIN x.y",
                "SELECT * FROM parquet.`/etc`", "WITH a AS (SELECT 1) DROP TABLE a"):
        with pytest.raises(ValueError):
            adhoc.check_sql(spark, sql)
    assert adhoc.guarded_sql(spark, store, "select 1 from v_claims limit 1").count() == 1
    many = adhoc.guarded_sql(spark, store, "select a.claim_id from v_findings a, v_findings b, v_findings c, v_findings d, v_findings e")
    rows = adhoc.bounded_run(many, 120)
    assert len(rows) == 200 and rows.attrs["truncated"] and not adhoc.bounded_run(many.limit(3), 120).attrs["truncated"]
    with pytest.raises(ValueError):
        adhoc.check_question("x" * 501)


def entries(spark, n=5, length=100):
    rows = [(f"2026-01-0{1 + i % 9}", "t", "k", "", f"C{i}", "d", "v", "s", "CLEAN", i, i, 0, 0, "{}", 1) for i in range(n)]
    cols = ("recorded_at string, tenant string, key_id string, request_id string, claim_id string, packet_digest string, corpus_version string, strategy string, "
            "verdict string, gross_paise bigint, settlement_paise bigint, patient_paise bigint, hospital_paise bigint, finding_counts string, verify_passed int")
    return spark.createDataFrame(rows, cols), length


def test_tampering_is_found(spark):
    rows, length = entries(spark)
    chain = ledger.chain_append(rows, "b", length).persist()
    status = lambda df: ledger.verify_chain(df).first()
    assert status(chain).ok and status(chain).entries == 5
    edited = chain.withColumn("verdict", F.when(F.col("seq") == 3, "NEEDS_ATTENTION").otherwise(F.col("verdict")))
    assert (status(edited).broken_at, status(edited).reason) == (3, ledger.HASH_REASON)
    removed = chain.where("seq <> 2")
    assert (status(removed).broken_at, status(removed).reason) == (3, ledger.PREV_REASON)
    assert ledger.heads(chain).first().seq == 5


def test_anchors_find_removed_batches(spark):
    batches = [f"2026-0{k}" for k in range(1, 5)]
    parts = [ledger.chain_append(entries(spark, 12 + 5 * k)[0], name, 4) for k, name in enumerate(batches)]
    lists = [ledger.manifest(p, name) for p, name in zip(parts, batches)]
    whole = lists[0].unionByName(lists[1]).unionByName(lists[2])
    listed = whole.unionByName(lists[3]).persist()
    first = anchors.anchor_batches(whole)
    made = first.unionByName(anchors.anchor_batches(listed, first)).persist()
    assert [(r.number, r.batch) for r in made.orderBy("number").collect()] == [*zip(range(1, 5), batches)]
    assert [r.anchor for r in made.orderBy("number").collect()] == [r.anchor for r in anchors.anchor_batches(listed).orderBy("number").collect()]
    top = made.where("number = 4").first().anchor
    judge = lambda rows, anchored, head=(4, top): {(r.number, r.batch): r.reason for r in anchors.verify_anchors(rows, anchored, head).collect()}
    assert judge(listed, made) == {}
    gone = F.col("batch") != batches[1]
    assert judge(listed.where(gone), made.where(gone)) == {(3, batches[2]): anchors.GAP_REASON}
    assert judge(listed.where(gone), made) == {(2, batches[1]): anchors.GONE_REASON}
    assert judge(listed, made.where(gone)) == {(None, batches[1]): anchors.LOOSE_REASON, (3, batches[2]): anchors.GAP_REASON}
    end = F.col("batch") != batches[3]
    assert judge(listed.where(end), made.where(end)) == {(4, None): anchors.HEAD_REASON} and judge(listed.where(end), made.where(end), None) == {}
    one = listed.where(F.col("batch") == batches[2]).orderBy("chain").first().chain
    for edited in (listed.where(F.col("chain") != one), listed.withColumn("entries", F.col("entries") + F.when(F.col("chain") == one, 1).otherwise(0)),
                   listed.unionByName(listed.where(F.col("chain") == one))):
        assert judge(edited, made) == {(3, batches[2]): anchors.ROOT_REASON}
    assert judge(listed, made.withColumn("entries", F.col("entries") + F.when(F.col("number") == 2, 1).otherwise(0))) == {(2, batches[1]): anchors.ANCHOR_REASON}
    assert judge(listed, made.withColumn("prev_anchor", F.when(F.col("number") == 2, "x").otherwise(F.col("prev_anchor")))) == {(2, batches[1]): anchors.LINK_REASON}
    assert anchors.verify_anchors(listed.limit(0), made.limit(0)).count() == 0 == anchors.anchor_batches(listed.limit(0)).count()


def test_chains_are_proved_against_an_anchor(spark):
    listed = ledger.manifest(ledger.chain_append(entries(spark, 60)[0], "b", 4), "b").persist()
    made = anchors.anchor_batches(listed).persist()
    proofs = anchors.inclusion_proofs(listed, listed.where("chain like '%1'")).persist()
    held = anchors.verify_proofs(proofs, made).collect()
    assert held and all(r.ok for r in held) and len(held) == listed.where("chain like '%1'").count()
    for forged in (proofs.withColumn("entries", F.col("entries") + 1), proofs.withColumn("head", F.lit("x")), proofs.withColumn("steps", F.slice("steps", 1, 3)),
                   proofs.withColumn("steps", F.transform("steps", lambda s: F.array_append(s, F.lit("x"))))):
        assert not any(r.ok for r in anchors.verify_proofs(forged, made).collect())
    assert not any(r.ok for r in anchors.verify_proofs(proofs, made.limit(0)).collect())


def test_both_ways_of_chaining_agree(spark):
    rows, _ = entries(spark, 60)
    a = ledger.chain_append(rows, "b", 9)
    b = ledger.chain_append_long(rows, "b", 9)
    key = lambda df: sorted((r.chain, r.seq, r.claim_id, r.entry_hash) for r in df.collect())
    assert key(a) == key(b) and len({k[0] for k in key(a)}) == 7


def test_digest_ignores_line_order(spark, run):
    x, y = line(2, "A", 1), line(3, "B", 2)
    digests = []
    for lines in ([ROOM, x, y], [y, ROOM, x], [ROOM, x, line(3, "B", 3)]):
        t, _ = run(packet("D", lines))
        digests.append(ledger.packet_digest(t.claims, t.findings.select("tenant", "claim_id", "line_no", "description", "amount_paise")).first().packet_digest)
    assert digests[0] == digests[1] != digests[2]


def test_retention(spark, saved):
    store = st.read_store(spark, saved)
    report = retention.purge_report(store, dt.date(2028, 5, 7), days=730).first()
    assert (report.claims_deleted, report.findings_deleted, report.dry_run) == (0, 0, True)
    assert retention.purge_report(store, dt.date(2028, 5, 8), days=730).first().claims_deleted == 2
    assert retention.purge_expired(store, dt.date(2028, 5, 8)).findings.count() == 0
    left, tombs = retention.erase_claims(store, spark.createDataFrame([("t", "A"), ("t", "NONE")], "tenant string, claim_id string"), F.lit("2026-01-01"), "e")
    assert [r.claim_id for r in left.claims.collect()] == ["B"] and [(r.claim_id, r.verdict) for r in tombs.collect()] == [("A", "ERASED")]
    assert ledger.verify_entries(tombs).count() == 0


@pytest.mark.parametrize("sql", [
    "SELECT * FROM v_claims a, secret b", 'SELECT "-- " AS a, s.* FROM secret s', "SELECT * FROM (v_claims), (secret)",
    "SELECT reflect('java.lang.System','getProperty','user.home')", "SELECT (SELECT max(x) FROM secret) FROM v_claims", "SELECT * FROM v_claims WHERE claim_id IN (SELECT id FROM secret)",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT * FROM range(5)", "SELECT * FROM global_temp.v_claims", "SELECT explode(array(1))", "SET x=1", "SHOW TABLES",
    "FROM v_claims INSERT INTO t SELECT *", "SELECT * FROM v_claims LATERAL VIEW explode(array(1)) t AS x", "SELECT TRANSFORM(claim_id) USING 'cat' FROM v_claims",
    "SELECT * FROM csv.`/etc/passwd`", "CREATE VIEW v AS SELECT 1", "SELECT * FROM v_claims WHERE EXISTS (SELECT 1 FROM secret)"])
def test_the_guard_reads_the_parsed_query(spark, sql):
    with pytest.raises(ValueError):
        adhoc.check_sql(spark, sql)


@pytest.fixture
def secret(spark):
    """A table of the catalogue that no statement may reach, under every name a statement could give it."""
    spark.sql("CREATE VIEW default.secret AS SELECT 'hidden' AS x")
    yield
    spark.sql("DROP VIEW default.secret")


@pytest.mark.parametrize("sql", [
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "WITH `default.secret` AS (SELECT 1 AS x) SELECT * FROM default.secret",
    "WITH a AS (WITH secret AS (SELECT * FROM secret) SELECT * FROM secret) SELECT * FROM a", "WITH v_claims AS (SELECT * FROM secret), secret AS (SELECT 1) SELECT * FROM v_claims",
    "WITH RECURSIVE secret AS (SELECT x FROM secret) SELECT * FROM secret", "SELECT * FROM IDENTIFIER('sec' || 'ret')", "SELECT * FROM IDENTIFIER('default.secret')",
    "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','java.version')", "SELECT java_method('java.lang.System','getProperty','java.version')",
    "SELECT (WITH secret AS (SELECT * FROM secret) SELECT max(x) FROM secret)", "SELECT * FROM v_claims, LATERAL (WITH secret AS (SELECT * FROM secret) SELECT * FROM secret)",
    "TABLE secret", "TABLE default.secret", "SELECT * FROM spark_catalog.default.secret", "SELECT input_file_name() FROM v_claims", "SELECT default.abs(1)",
    "EXPLAIN SELECT 1", "EXECUTE IMMEDIATE 'SELECT * FROM secret'", "DECLARE x INT", "SELECT transform(array(1), x -> x)", "SELECT * FROM sql_keywords()",
    "WITH secret AS (SELECT 1 AS x) SELECT * FROM (WITH t AS (SELECT * FROM secret) SELECT * FROM t), default.secret"])
def test_the_guard_reads_the_analysed_query(spark, saved, secret, sql):
    """Names that hide a table of the catalogue behind another, or a function behind a name that is computed."""
    store = st.read_store(spark, saved)
    with pytest.raises(ValueError):
        adhoc.guarded_sql(spark, store, sql, "t")


@pytest.mark.parametrize("sql", [
    "SELECT x + 1 AS y FROM (VALUES (1), (2)) AS v(x)", "VALUES (1, 'a')", "WITH secret AS (SELECT claim_id FROM v_claims) SELECT * FROM secret",
    "WITH v_claims AS (SELECT claim_id AS c FROM v_findings) SELECT c FROM v_claims", "SELECT a.claim_id FROM v_claims a JOIN v_claims b USING (claim_id) WHERE a.gross_bill >= b.gross_bill",
    "SELECT head, sum(amount_paise) AS s, rank() OVER (ORDER BY sum(amount_paise) DESC) AS r FROM v_findings GROUP BY head HAVING sum(amount_paise) <> 0 ORDER BY 2 DESC LIMIT 5",
    "SELECT month, count(DISTINCT claim_id), round(avg(gross_bill), 2), median(gross_bill), percentile_approx(gross_bill, 0.5) FROM v_claims GROUP BY ROLLUP (month)",
    "SELECT CASE WHEN gross_bill BETWEEN 1 AND 5 THEN 'a' ELSE coalesce(month, '-') END, upper(trim(claim_id)) LIKE 'A%', cast(gross_bill AS DOUBLE) / 2 FROM v_claims",
    "SELECT date_add(to_date(audited_at), 1), date_trunc('month', audited_at), datediff(current_date(), audited_at), audited_at + INTERVAL 1 DAY FROM v_claims",
    "SELECT * FROM v_claims c WHERE EXISTS (SELECT 1 FROM v_findings f WHERE f.claim_id = c.claim_id) AND claim_id NOT IN (SELECT claim_id FROM doc_gaps WHERE severity = 'X')",
    "SELECT claim_id FROM v_claims UNION SELECT claim_id FROM v_findings EXCEPT SELECT claim_id FROM doc_gaps INTERSECT SELECT 'A'",
    "SELECT lag(gross_bill, 1) OVER (PARTITION BY tenant ORDER BY claim_id), sum(gross_bill) OVER (ORDER BY claim_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), regexp_replace(claim_id, 'A', 'b'), floor(1.5), ceil(2.5), nvl(month, '') FROM v_claims",
    "SELECT (SELECT max(gross_bill) FROM v_claims) - gross_bill, gross_bill % 7, -gross_bill, abs(gross_bill), nullif(month, '') FROM v_claims",
    "SELECT * FROM (SELECT head, amount_paise FROM v_findings) PIVOT (sum(amount_paise) FOR head IN ('ROOM', 'OTHER'))", "SELECT count_if(gross_bill > 0), any_value(month) FROM v_claims"])
def test_plain_queries_pass_the_guard(spark, saved, secret, sql):
    assert adhoc.guarded_sql(spark, st.read_store(spark, saved), sql, "t").collect() is not None


def test_tenants_at_once_stay_apart(spark, saved):
    store = st.read_store(spark, saved)
    mine = adhoc.guarded_sql(spark, store, "SELECT count(*) AS n, max(gross_bill) FROM v_claims", "t")
    other = adhoc.guarded_sql(spark, store, "WITH c AS (SELECT * FROM v_claims) SELECT count(*) AS n FROM c", "other")
    assert (mine.first().n, other.first().n, mine.first().n) == (2, 0, 2)
    assert not spark.catalog.tableExists("v_claims")


def months_of(store):
    return sorted((r.claim_id, r.month) for r in store.claims.collect())


def test_files_after_saves_deletes_and_purges(spark, run, tmp_path):
    path, later = str(tmp_path / "s"), {"context": {"admission_date": "2026-06-04", "discharge_date": "2026-06-07"}}
    first, _ = run(packet("A", [ROOM, line(2, "Stent", 500, "IMPLANT")]), packet("B", [ROOM]), packet("C", [ROOM]))
    st.save_store(path, st.store_rows(first))
    assert st.read_store(spark, path).doc_gaps.where("claim_id = 'A'").count() > 0
    again, _ = run(packet("A", [ROOM], **later))
    st.save_store(path, st.store_rows(again))
    store = st.read_store(spark, path)
    assert months_of(store) == [("A", "2026-06"), ("B", "2026-05"), ("C", "2026-05")]
    assert store.doc_gaps.where("claim_id = 'A'").count() == again.gaps.count()
    tombs = retention.erase_from_store(spark, path, spark.createDataFrame([("t", "B"), ("t", "NONE"), ("x", "A")], "tenant string, claim_id string"),
                                       F.lit("2026-07-01"), "e1", str(tmp_path / "ledger"))
    assert [(r.claim_id, r.verdict) for r in tombs.collect()] == [("B", "ERASED")]
    raw = spark.read.parquet(f"{path}/claims").where("claim_id is not null")
    assert sorted(r.claim_id for r in raw.collect()) == ["A", "C"] and st.read_store(spark, path).findings.where("claim_id = 'B'").count() == 0
    day = dt.date(2028, 5, 8)
    assert retention.purge_store(spark, path, day).first().claims_deleted == 1 and len(months_of(st.read_store(spark, path))) == 2
    assert not retention.purge_store(spark, path, day, dry_run=False).first().dry_run
    assert months_of(st.read_store(spark, path)) == [("A", "2026-06")]
    st.delete_claims(path, spark.createDataFrame([("t", "A")], "tenant string, claim_id string"))
    assert months_of(st.read_store(spark, path)) == [] and st.read_store(spark, path).findings.count() == 0
    st.save_store(path, st.store_rows(first))
    assert len(months_of(st.read_store(spark, path))) == 3


def sizes(path):
    return {f: f.stat().st_size for f in path.rglob("*.parquet")}


def test_a_save_costs_what_it_writes(spark, run, tmp_path):
    """Files of earlier saves are not touched; what a save writes does not depend on them."""
    path = tmp_path / "s"
    first, _ = run(*[packet(f"C{i}", [ROOM, line(2, "Stent", 500 + i, "IMPLANT")]) for i in range(30)])
    one, _ = run(packet("C3", [ROOM]))
    st.save_store(str(path), st.store_rows(first))
    before = sizes(path)
    st.save_store(str(path), st.store_rows(one))
    after = sizes(path)
    assert before.items() <= after.items()
    st.save_store(str(tmp_path / "alone"), st.store_rows(one))
    written = sum(after.values()) - sum(before.values())
    assert abs(written - sum(sizes(tmp_path / "alone").values())) < 200
    store = st.read_store(spark, str(path))
    assert store.claims.count() == 30 and store.findings.where("claim_id = 'C3'").count() == 1


def test_a_save_that_dies_leaves_the_state_before(spark, run, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    first, _ = run(packet("A", [ROOM, line(2, "Stent", 500, "IMPLANT")]), packet("B", [ROOM]))
    second, _ = run(packet("A", [ROOM]), packet("C", [ROOM]))
    st.save_store(path, st.store_rows(first))
    whole = st._write

    def dies(path, name, version, rows):
        if name == "claims":
            raise RuntimeError("the disk is full")
        whole(path, name, version, rows)

    monkeypatch.setattr(st, "_write", dies)
    with pytest.raises(RuntimeError):
        st.save_store(path, st.store_rows(second), "b1")
    state = lambda: sorted((r.claim_id, r.line_no) for r in st.read_store(spark, path).findings.collect())
    assert state() == [("A", 1), ("A", 2), ("B", 1)] and not st.committed(spark, path, "b1")
    monkeypatch.setattr(st, "_write", whole)
    assert st.save_store(path, st.store_rows(second), "b1") and state() == [("A", 1), ("B", 1), ("C", 1)]
    assert not st.save_store(path, st.store_rows(first), "b1") and state() == [("A", 1), ("B", 1), ("C", 1)]


def test_compaction_by_size_and_by_tenant(spark, run, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    monkeypatch.setattr(st, "MAX_VERSIONS", 4)
    monkeypatch.setattr(st, "MAX_OLD_COMMITS", 1)
    first, _ = run(packet("A", [ROOM]), packet("B", [ROOM]))
    rows = st.store_rows(first)
    other = st.Store(*[t.withColumn("tenant", F.lit("u/1")) for t in (rows.claims, rows.findings, rows.doc_gaps)])
    for k in range(3):
        st.save_store(path, rows, f"b{k}")
    st.save_store(path, other, "b3")  # the fourth version: compacted
    assert len(st.read_log(spark, path).live) == 1 and len(list((tmp_path / "s" / "claims").glob("version=*"))) == 1
    assert all(st.committed(spark, path, f"b{k}") for k in range(4)) and not st.committed(spark, path, "b4")
    key = lambda t, c: spark.createDataFrame([(t, c)], "tenant string, claim_id string")
    kept = lambda: sorted((r.tenant, r.claim_id) for r in st.read_store(spark, path).claims.collect())
    st.erase(spark, path, key("u/1", "A"))
    assert kept() == [("t", "A"), ("t", "B"), ("u/1", "B")]
    raw = [(r.tenant, r.claim_id) for r in spark.read.parquet(f"{path}/claims").collect()]
    assert ("u/1", "A") not in raw and len(raw) == 3
    st.compact(spark, path)
    st.vacuum(spark, path)
    assert kept() == [("t", "A"), ("t", "B"), ("u/1", "B")] and st.read_store(spark, path).findings.count() == 3
    st.delete_claims(path, key("t", "NONE"))
    assert len(st.read_log(spark, path).live) == 1


def test_anchor_case_reads_a_kept_manifest(spark):
    """L3A looks at the manifest five times; the tables are read for it once."""
    assert load().QUERIES["L3A"](spark, SF).inputFiles() == []


def test_a_store_that_was_rewritten_is_read_as_it_lies(spark, run, tmp_path):
    """F3 SNK1F: once the tenants of all older versions are compacted, nothing is left to compare, and reading takes no shuffle."""
    path = str(tmp_path)
    first, _ = run(packet("A", [ROOM, line(2, "Patient gown", 7)]), packet("B", [ROOM]))
    second, _ = run(packet("A", [ROOM]), packet("C", [line(1, "Gauze roll", 40)]))
    st.save_store(path, st.store_rows(first))
    st.save_store(path, st.store_rows(second))
    plan = lambda: [t._jdf.queryExecution().executedPlan().toString() for t in vars(st.read_store(spark, path)).values()]
    assert "Window" in plan()[0] and "Join" in plan()[1]
    other = st.Store(*[t.withColumn("tenant", F.lit("u/v")) for t in vars(st.store_rows(first)).values()])
    st.save_store(path, other)
    st.erase(spark, path, spark.createDataFrame([("t", "B"), ("t", "Z")], "tenant string, claim_id string"))
    assert "Window" in plan()[0], "the other tenant was not compacted"
    st.erase(spark, path, spark.createDataFrame([("u/v", "A")], "tenant string, claim_id string"))
    keys = lambda t: sorted((r.tenant, r.claim_id) for r in t.collect())
    now = st.read_store(spark, path)
    assert keys(now.claims) == [("t", "A"), ("t", "C"), ("u/v", "B")] and keys(now.findings) == [("t", "A"), ("t", "C"), ("u/v", "B")]
    st.compact(spark, path)
    assert not any(w in p for p in plan() for w in ("Window", "Join", "Exchange")) and keys(st.read_store(spark, path).claims) == keys(now.claims)
    st.vacuum(spark, path)
    st.erase(spark, path, spark.createDataFrame([("t", "A"), ("u/v", "B")], "tenant string, claim_id string"))
    assert not any(w in p for p in plan() for w in ("Window", "Join", "Exchange")), "one version holds all tenants there are"
    assert keys(st.read_store(spark, path).claims) == [("t", "C")]
