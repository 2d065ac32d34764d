import datetime as dt
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from auditlens.functions.rows import releasing
from auditlens.operators import extraction, intake, ledger, retrieval
from auditlens.plans import batch
from auditlens.sources import records
from auditlens.sources import packets as pk
from auditlens.sources import store
from auditlens.streaming import audits, metrics, requests
from tests.conftest import SF, TODAY, line, packet

T0 = pd.Timestamp("2026-01-01")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


INTAKE = "tenant string, key string, event_id bigint, ts timestamp, fingerprint string"


def intake_rows():
    at = lambda h, us=0: (T0 + pd.Timedelta(hours=h, microseconds=us)).to_pydatetime()
    return [("t", "k", 1, at(0), "a"), ("t", "k", 2, at(1), "a"), ("t", "k", 3, at(2), "b"), ("t", "k", 4, at(24), "a"),
            ("t", "k", 5, at(24, 1), "b"), ("u", "k", 6, at(3), "z"), ("t", "k", 7, at(25), "b")]


EXPECTED = {1: "accepted", 2: "replay", 3: "conflict", 4: "replay", 5: "accepted", 6: "accepted", 7: "replay"}


def test_idempotency(spark):
    got = intake.idempotent_intake(frame(spark, intake_rows(), INTAKE)).collect()
    assert {r.event_id: r.outcome for r in got} == EXPECTED


def test_busy_key_in_parallel(spark):
    """Every event under one key, and beside quiet ones, gives the rows of the fold; no window takes the rows of a whole key."""
    rng = np.random.default_rng(5)
    hours = np.concatenate([rng.uniform(0, 24 * 40, 1500), rng.uniform(2000, 2100, 300), [24 * 7, 24 * 8, 24 * 9, 24 * 10]])
    at = [(T0 + pd.Timedelta(microseconds=int(h * 3_600_000_000))).to_pydatetime() for h in hours]
    rows = [("t", "k", n, t, "ab"[n % 2]) for n, t in enumerate([*at, *at[:200]])]
    rows += [(None, "q", 9000 + n, t, None) for n, t in enumerate(at[:50])] + [("t", "few", 9900, at[0], "a"), ("t", "few", 9901, at[0], "a")]
    table = frame(spark, rows, INTAKE)
    plain, spread = intake.idempotent_intake(table), intake.idempotent_intake(table, busy=10)
    assert plain.dtypes == spread.dtypes
    got = sorted(map(str, spread.collect()))
    assert got == sorted(map(str, plain.collect())) and sum("outcome='accepted'" in r for r in got) > 40
    assert intake.idempotent_intake(table.limit(0), busy=0).count() == 0
    exact = [("t", "k", n, (T0 + pd.Timedelta(hours=24 * n, microseconds=n // 3)).to_pydatetime(), "a") for n in range(20)]
    ntz = frame(spark, exact, INTAKE).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(map(str, intake.idempotent_intake(ntz, busy=1).collect())) == sorted(map(str, intake.idempotent_intake(ntz).collect()))


def test_rate_limit(spark):
    hits = [("i", n, (T0 + pd.Timedelta(milliseconds=100 * n)).to_pydatetime()) for n in range(121)]
    hits.append(("i", 900, (T0 + pd.Timedelta(seconds=60)).to_pydatetime()))
    got = {r.event_id: r for r in intake.rate_admission(frame(spark, hits, "identity string, event_id bigint, ts timestamp")).collect()}
    assert sum(r.allowed for r in got.values()) == 121 and not got[120].allowed and got[120].retry_after_us == 48_000_000
    assert got[0].remaining == 119 and got[900].allowed, "a hit exactly a minute old has left"


def run_stream(spark, writer, path):
    q = writer.option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams_equal_their_batch_twins(spark, tmp_path):
    src = tmp_path / "in"
    frame(spark, intake_rows(), INTAKE).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(INTAKE).parquet(str(src))
    run_stream(spark, requests.idempotent_stream(stream).writeStream.format("memory").queryName("admitted").outputMode("append"), tmp_path / "a")
    assert {r.event_id: r.outcome for r in spark.table("admitted").collect()} == EXPECTED
    hits = stream.select(F.col("tenant").alias("identity"), "event_id", "ts")
    run_stream(spark, requests.rate_stream(hits, limit=2, window_s=7200.0).writeStream.format("memory").queryName("rated").outputMode("append"), tmp_path / "b")
    twin = intake.rate_admission(spark.read.parquet(str(src)).select(F.col("tenant").alias("identity"), "event_id", "ts"), 2, 7200.0)
    assert sorted(map(tuple, spark.table("rated").collect())) == sorted(map(tuple, twin.collect()))


def test_stream_keeps_state_by_slot(spark, tmp_path):
    """Many keys share few states, over several triggers, and are judged as by the batch; a state all of whose keys are out of date goes."""
    rng, src = np.random.default_rng(7), tmp_path / "in"
    for part in range(3):
        hours = np.sort(rng.uniform(60 * part, 60 * part + 59, 300))
        rows = [(None if n % 5 == 0 else "t", f"k{rng.integers(60)}", 1000 * part + n, (T0 + pd.Timedelta(microseconds=int(h * 3_600_000_000))).to_pydatetime(),
                 "ab"[n % 2] if n % 7 else None) for n, h in enumerate(hours)]
        frame(spark, rows, INTAKE).coalesce(1).write.mode("append").parquet(str(src))
        stream = requests.idempotent_stream(spark.readStream.schema(INTAKE).parquet(str(src)), slots=4)
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 4
    twin = intake.idempotent_intake(spark.read.schema(INTAKE).parquet(str(src)))
    assert sorted(map(str, spark.read.schema(twin.schema).parquet(str(tmp_path / "out")).collect())) == sorted(map(str, twin.collect()))


def test_histogram_stream(spark, tmp_path):
    rows = [((T0 + pd.Timedelta(seconds=s)).to_pydatetime(), "x", v) for s, v in ((1, 0.05), (2, 0.3), (3, 99.0), (7200, 1.0))]
    src = tmp_path / "obs"
    frame(spark, rows, "ts timestamp, label string, value double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, label string, value double").parquet(str(src))
    run_stream(spark, metrics.histogram_stream(stream, ["label"]).writeStream.format("memory").queryName("hist").outputMode("append"), tmp_path)
    got = {r.edge: r.cumulative for r in spark.table("hist").collect() if r.window.start == T0.to_pydatetime()}
    assert (got["0.05"], got["0.25"], got["0.5"], got["60"], got["+Inf"]) == (1, 1, 2, 2, 3)


def test_streaming_audit(spark, catalogue, tmp_path):
    """Claims go into the store once: not again when they come again, nor when a batch is run again."""
    src, out = tmp_path / "packets", str(tmp_path / "out")
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps(packet(f"S{i}", [line(1, "Patient gown", 10 + i)])))
    (src / "bad.json").write_text("{")

    def start(check):
        stream = spark.readStream.schema(f"{pk.PACKET}, {pk.CORRUPT} string").option("multiLine", "true").option("maxFilesPerTrigger", 2).json(str(src))
        writer = audits.streaming_audit(stream, out, *catalogue, tenant=F.lit("t"), today=TODAY, recorded_at=F.lit("2026-01-01"))
        run_stream(spark, writer, tmp_path / check)

    def rows():
        book = spark.read.parquet(f"{out}/ledger")
        assert ledger.verify_entries(book).count() == 0
        return (sorted((r.claim_id or "", r.ok, r.error) for r in spark.read.parquet(f"{out}/outcomes").collect()),
                sorted((r.claim_id, r.gross_bill_paise) for r in store.read_store(spark, out).claims.collect()), book.count())

    (tmp_path / "one").mkdir()
    start("one")
    outcomes, claims, entries = rows()
    assert [(c, ok) for c, ok, _ in outcomes] == [("", False), ("S0", True), ("S1", True), ("S2", True)]
    assert claims == [("S0", 1000), ("S1", 1100), ("S2", 1200)] and entries == 3
    (src / "late.json").write_text(json.dumps(packet("S1", [line(1, "Patient gown", 99)])))
    start("one")
    again, claims, entries = rows()
    assert [e for e in again if e not in outcomes] == [("S1", False, f"DuplicateClaim: {batch.KNOWN}")] and claims[1] == ("S1", 1100) and entries == 3
    (tmp_path / "two").mkdir()
    start("two")  # a lost checkpoint: the batches of these names are in the store
    assert rows() == (again, claims, entries) and not (tmp_path / "out" / "staging" / "stream-0").exists()


def test_a_batch_takes_a_claim_once(spark, catalogue, tmp_path):
    take = lambda name, *docs: {(r.claim_id, r.ok, r.error) for r in batch.intake_batch(
        pk.parse_packets(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")), str(tmp_path / "s"), *catalogue, tenant=F.lit("t"), today=TODAY, batch=name).collect()}
    a, other = packet("A", [line(1, "Patient gown", 10)]), packet("A", [line(1, "Patient gown", 20)])
    got = take("b1", a, other, a, packet("B", [line(1, "Patient gown", 1)]))
    assert got == {("A", True, ""), ("A", False, f"DuplicateClaim: {batch.TWICE}"), ("B", True, "")}
    kept = store.read_store(spark, str(tmp_path / "s")).findings.collect()
    assert sorted(r.claim_id for r in kept) == ["A", "B"]
    assert take("b2", a, packet("C", [])) == {("A", False, f"DuplicateClaim: {batch.KNOWN}"), ("C", True, "")}
    assert take("b2", packet("D", [])) == {("A", False, f"DuplicateClaim: {batch.KNOWN}"), ("C", True, "")}
    assert sorted(r.claim_id for r in store.read_store(spark, str(tmp_path / "s")).claims.collect()) == ["A", "B", "C"]


def test_a_batch_parses_its_packets_once(spark, catalogue):
    seen = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([(json.dumps(packet(c, [line(1, "Gauze roll", 5)])),) for c in "ABC"] + [("{",)], "json string")

    def count(rows):
        for r in rows:
            seen.add(len(r))
            yield r

    packets = pk.parse_packets(texts.mapInPandas(count, "json string"))
    with releasing():
        run, results = batch.audit_batch(packets, *catalogue, tenant=F.lit("t"), today=TODAY)
        assert sorted(r.ok for r in results.collect()) == [False, True, True, True] and run.findings.count() == 3
    assert seen.value == 4


def test_bm25_by_hand(spark, monkeypatch):
    docs = ["blue cap cap", "red gown", "red cap", "", "long " * 9]
    queries = ["cap cap red", "gown", "nothing"]
    d = frame(spark, [(i, i, t) for i, t in enumerate(docs)], "doc_id bigint, doc_order bigint, text string")
    q = frame(spark, list(enumerate(queries)), "query_id bigint, text string")
    tokens = [t.split() for t in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = {w: sum(w in t for t in tokens) for t in tokens for w in t}
    raw = {w: np.log(n - c + .5) - np.log(c + .5) for w, c in df.items()}
    idf = {w: v if v >= 0 else .25 * np.mean(list(raw.values())) for w, v in raw.items()}
    want = {}
    for qi, text in enumerate(queries):
        for di, t in enumerate(tokens):
            s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (.25 + .75 * len(t) / avg)) for w in text.split())
            if s > 0:
                want[(qi, di)] = s
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(q, d).collect()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" not in plan(retrieval.bm25_scores(q, d)).split("AdaptiveSparkPlan")[1].split("Join")[0], "scores are summed where the document is"
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert got == {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(q, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_postings_are_laid_out_by_what_a_task_holds(spark, monkeypatch):
    """Four times the text or the scores in four times the parts, though few bytes move; the scores stay the same."""
    q = frame(spark, [(i, f"cap w{i}") for i in range(5)], "query_id bigint, text string")
    d = frame(spark, [(i, i, "cap " * (i % 7) + f"w{i % 50}") for i in range(400)], "doc_id bigint, doc_order bigint, text string")
    want = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(q, d).collect()}
    monkeypatch.setattr(retrieval, "TASK_CHARS", 160)
    assert retrieval.postings(d.where("doc_id < 100")).rdd.getNumPartitions() * 3 < retrieval.postings(d).rdd.getNumPartitions()
    monkeypatch.setattr(retrieval, "TASK_CHARS", 10**9)
    monkeypatch.setattr(retrieval, "TASK_SCORES", 50)
    assert retrieval.doc_parts(d, 5) == 40 and retrieval.doc_parts(d.where("doc_id < 100"), 5) <= 10
    assert want == {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(q, d).collect()} and len(want) >= 40


def test_dense_blocks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 8)).tolist()
    vecs[7] = vecs[3]
    d = frame(spark, [(i, i, v) for i, v in enumerate(vecs)], "doc_id bigint, doc_order bigint, vec array<double>")
    q = frame(spark, [(i, v) for i, v in enumerate(vecs[:9])], "query_id bigint, vec array<double>")
    unit = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {(i, r, int(j)) for i in range(9) for r, j in enumerate(sorted(range(60), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), -j))[:5])}
    for nd, nq in ((1, 1), (4, 3)):
        got = {(r.query_id, r.dense_rank, r.doc_id) for r in retrieval.dense_rank(q, d, 5, nd, nq).collect()}
        assert got == want


def test_extraction_rows(spark):
    row = lambda p, n, *c: ("D", p, n, list(c))
    cells = frame(spark, [
        row(1, 1, "Sr", "Description", "Dept", "Qty", "Rate", "Amount"), row(1, 2, "1", " Twin room ", "Accommodation", "2", "", "Rs 8,000"),
        row(1, 3, "2", "ICU bed", "Accommodation", "1.5", "9000", "13,500.00"), row(2, 1, "3", "", "Lab", "1", "1", "5"), row(2, 2, "4", "Tests", "Path lab", "", "", "500"),
        row(2, 3, "5", "Free", "Misc", "1", "0", "0"), row(2, 4, "6", "tests ", "Path lab", "", "", "500"), row(2, 5, "", "Total", "", "", "", "22,000"), row(2, 6, "7", "short")],
        "doc_id string, page int, row_no int, cells array<string>")
    items = extraction.rows_to_items(cells)
    got = [(r.line_no, r.description, r.head, float(r.quantity), float(r.amount)) for r in items.orderBy("line_no").collect()]
    assert got == [(1, "Twin room", "ROOM", 2, 8000), (2, "ICU bed", "ROOM", 1.5, 13500), (3, "Tests", "INVESTIGATION", 1, 500), (4, "tests", "INVESTIGATION", 1, 500)]
    assert [r.line_no for r in extraction.dedupe_rows(items).orderBy("line_no").collect()] == [1, 2, 3]
    stay = extraction.room_stay_from_items(items).first()
    assert (stay.room_category, stay.days, stay.is_icu, int(stay.rate_paise)) == ("ICU bed", 4, True, 900000)


def test_model_is_asked_in_batches(spark):
    seen = "tenant string, claim_id string, line_no bigint, head string, description string"
    lines = frame(spark, [("t", "c", i, "OTHER", f"d{i}") for i in range(20)], seen).coalesce(1)
    candidates = frame(spark, [("d1", [("A", "LIST_II_ROOM")])], "text string, candidates array<struct<doc_id:string,tag:string>>")

    def model(batch):
        assert len(batch) <= 8
        if 9 in batch["line_no"].tolist():
            raise TimeoutError
        return intake.stub_model(batch)

    got = {r.line_no: r for r in intake.model_scorer(lines, candidates, model).collect()}
    assert len(got) == 20 and got[9].error == "TimeoutError" and 1 <= sum(r.error is not None for r in got.values()) <= 8
    assert got[1].error is not None or (got[1].classification, got[1].cited_chunk_id) == ("LIST_II_ROOM", "A")
    assert dt.timedelta(hours=24) == intake.IDEMPOTENCY_TTL


def test_files_that_are_no_documents_are_listed(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"claim_id": "C1", "nodes": [{"node": "classify", "latency_ms": 5}]}')
    (tmp_path / "broken.json").write_text('{"claim_id": "C2", "nodes": [')
    (tmp_path / "document.txt").write_text("line one\nline two")
    made = records.trace_nodes(records.read_traces(spark, f"{tmp_path}/*.json")).collect()
    assert [(r.claim_id, r.tenant, r.latency_ms, r.attempts) for r in made] == [("C1", "local", 5, 1)]
    assert [(r.file, r.key, r.text[:6]) for r in records.unreadable(spark, f"{tmp_path}/*.json", records.TRACE).collect()] == [("broken.json", None, '{"clai')]
    assert [tuple(r) for r in records.read_document_text(spark, f"{tmp_path}/document.txt").collect()] == [("document.txt", "line one\nline two")]


def test_lines_of_a_description_share_its_candidates(spark):
    """F4 U1: candidates become Python objects once per description, not once per line, and lines without any keep NULL."""
    schema = "tenant string, claim_id string, line_no bigint, head string, description string"
    lines = frame(spark, [("t", "c", i, "OTHER", ("Gown", "none", None)[i % 3]) for i in range(48)], schema).coalesce(1)
    candidates = frame(spark, [("gown", [("A", "LIST_II_ROOM", ["x", "y"])])], "text string, candidates array<struct<doc_id:string,tag:string,aliases:array<string>>>")

    def model(batch):
        made = intake.stub_model(batch)
        made["reason"] = [f"{id(c)}/{list(c[0]['aliases'])}" if c is not None else None for c in batch["candidates"]]
        made["confidence"] = [None if c is None else 0.5 for c in batch["candidates"]]
        return made

    got = {r.line_no: r for r in intake.model_scorer(lines, candidates, model).collect()}
    assert len({got[i].reason for i in range(0, 48, 3)}) == 1 and got[0].reason.endswith("/['x', 'y']")
    assert {(r.classification, r.cited_chunk_id, r.confidence) for i, r in got.items() if i % 3 == 0} == {("LIST_II_ROOM", "A", 0.5)}
    assert {(r.classification, r.cited_chunk_id, r.reason, r.confidence) for i, r in got.items() if i % 3} == {("PAYABLE", None, None, None)}
    assert len(got) == 48


def test_packets_are_admitted_in_one_pass(spark, tmp_path):
    """F1 BAT1, F2 ST5: problems and digests are written with the packets; whole packets move once, to meet what was found out from keys and marks alone."""
    docs = [packet("A", [line(1, "Patient gown", n)]) for n in (10, 20, 10)] + [packet("B", []), packet("K", []), packet("K", [])]
    texts = [(json.dumps(d),) for d in docs] + [("{",), (json.dumps(packet("BAD", [line(1, "x", 5, "MAGIC")])),)]
    batch.marked(pk.parse_packets(spark.createDataFrame(texts, "json string"))).write.parquet(str(tmp_path / "p"))
    written = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(r.claim_id or "" for r in written.where(F.size("problems") > 0).collect()) == ["", "BAD"]
    known = spark.createDataFrame([("t", "K"), ("u", "B")], "tenant string, claim_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    judged = batch.admit(written.where(F.size("problems") == 0), known, F.lit("t"))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "structstojson" not in plan.lower() and "to_json" not in plan and "sha2" not in plan
    assert sum("line_items#" in scan for scan in plan.split("FileScan parquet")[1:]) == 1
    rows = judged.collect()
    assert sorted((r.claim_id, r.problem or "") for r in rows) == [
        ("A", ""), ("A", batch.TWICE), ("A", batch.TWICE), ("B", ""), ("K", batch.KNOWN), ("K", batch.KNOWN)]
    least = written.where("claim_id = 'A'").orderBy("_digest", "_place").first()
    assert [r.line_items for r in rows if r.claim_id == "A" and r.problem is None] == [least.line_items]
    assert "problems" not in judged.columns and not any(c.startswith("_d") or c.startswith("_p") for c in judged.columns)


def test_a_stream_of_packets_is_dealt_out(spark, monkeypatch):
    """F2 ST5: a packet takes much work and few bytes of the file, so its rows are dealt to tasks by number, as those of a batch are."""
    from suite import flows, load

    x = load().context(spark, SF)
    monkeypatch.setattr(flows, "TASK_ORDERS", 300)
    plan = flows.streamed_packets(x)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan and plan.index("from_json") < plan.index("RepartitionByExpression")
    monkeypatch.setattr(flows, "TASK_ORDERS", 10**9)
    assert "Repartition" not in flows.streamed_packets(x)._jdf.queryExecution().analyzed().toString()
