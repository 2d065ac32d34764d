"""Cases for packets, batches, traces, admission, metrics and the stream, over `orders` and `events`."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.functions.rows import spread
from auditlens.operators import evaluate, intake, portfolio
from auditlens.plans import batch
from auditlens.session import shared_dir
from auditlens.sources import packets as pk
from auditlens.sources import records, store
from auditlens.streaming import requests as stream_requests
from auditlens.streaming.audits import streaming_audit
from suite import base as b
from suite.base import CTES, case

K = ["tenant", "claim_id"]

# --- packets: one JSON document per order, three lines each, some of them faulty ----------


def packet_texts(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    admitted = F.to_date("o_orderdate")
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint")
    money = lambda p: s((p.cast("decimal(20,0)") / 100).cast("decimal(18,2)"))
    head2 = F.when(k % 41 == 0, "MAGIC").otherwise("OTHER")
    no3 = F.when(k % 47 == 0, 2).otherwise(3)
    line = lambda no, desc, head, amount, **more: F.struct(
        no.alias("line_no"), desc.alias("description"), head.alias("head"), amount.alias("amount"), *[v.alias(n) for n, v in more.items()])
    none = F.lit(None).cast("string")
    lines = F.array(
        line(F.lit(1), F.lit("Room rent twin bed"), F.lit("ROOM"), money((F.lit(3000) + k % 10 * 500) * 300), quantity=F.lit("3"), service_date=s(F.date_add(admitted, 1))),
        line(F.lit(2), F.lit("Telephone usage"), head2, money(F.call_function("div", paise, F.lit(10))), quantity=none, service_date=s(F.date_add(admitted, 9))),
        line(no3, F.lit("Surgeon fee"), F.when(k % 5 == 0, none).otherwise("PROCEDURE"), money(F.call_function("div", paise, F.lit(2))), quantity=none, service_date=none))
    context = F.struct(
        F.when(k % 3 == 0, "reimbursement").alias("claim_type"), s(admitted).alias("admission_date"),
        F.when(k % 43 != 0, s(F.date_add(admitted, 3))).alias("discharge_date"), F.col("o_orderpriority").alias("primary_diagnosis"),
        F.when(k % 4 == 0, F.lit("Knee replacement")).alias("procedure_performed"), (k % 7 == 0).alias("is_accident"),
        F.array(F.lit("DOC-FINAL-BILL"), F.lit(" doc-claim-form ")).alias("documents_attached"))
    policy = F.struct(
        F.concat(F.lit("POL-"), s(k)).alias("policy_id"), F.lit("500000").alias("sum_insured"), F.lit("450000").alias("balance_sum_insured"),
        F.lit("4000").alias("room_rent_cap_per_day"), F.when(k % 2 == 0, F.lit("10")).alias("copay_percent"),
        F.create_map(F.lit("zebra"), F.lit("1000"), F.lit("knee"), F.lit("90000.50")).alias("procedure_sublimits"))
    stay = F.struct(F.lit("Twin").alias("room_category"), s(F.lit(3000) + k % 10 * 500).alias("rate_per_day"), F.lit(3).alias("days"))
    json = F.to_json(F.struct(F.concat(F.lit("PK-"), s(k)).alias("claim_id"), F.lit("x").alias("_watermark"), context.alias("context"),
                              policy.alias("policy"), stay.alias("room_stay"), lines.alias("line_items")))
    return orders.select(k.alias("k"), F.when(k % 37 == 0, F.substring(json, 1, 60)).otherwise(json).alias("json"))


TASK_ORDERS = 25_000  # a packet is some 20 bytes of the table


def packets(x) -> DataFrame:
    return pk.parse_packets(packet_texts(spread(x.table("orders"), TASK_ORDERS, "o_orderkey")))


def streamed_packets(x) -> DataFrame:
    """The orders file as a stream of packets, dealt out like `packets`: a stream cannot count its rows, so the table is counted."""
    table = x.table("orders")
    orders = x.spark.readStream.schema(table.schema).option("pathGlobFilter", "orders.parquet").parquet(x.sf_dir)
    parts = -(-table.count() // TASK_ORDERS)
    return pk.parse_packets(packet_texts(orders.repartition(parts, "o_orderkey") if parts > 1 else orders))


def tenant():
    return F.lit("T0")


CTES["packet_errors"] = """
SELECT o_orderkey AS k, 'PK-' || o_orderkey AS claim_id, o_orderkey % 37 = 0 AS corrupt, concat_ws('; ', CASE WHEN o_orderkey % 43 = 0 THEN 'missing context.discharge_date' END,
 CASE WHEN o_orderkey % 41 = 0 THEN 'unknown head' END) AS error FROM orders"""


@case("SRC1", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 37 <> 0 THEN 'PK-' || o_orderkey END AS claim_id, CASE WHEN o_orderkey % 37 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS admission_date,
 CASE WHEN o_orderkey % 37 <> 0 THEN (3000 + o_orderkey % 10 * 500) * 100 END AS rate, CASE WHEN o_orderkey % 37 <> 0 THEN 3 END AS n_lines, o_orderkey % 37 = 0 AS corrupt FROM orders""")
def src1(x):
    p = packets(x)
    return p.select(
        "k", F.when(F.col(pk.CORRUPT).isNull(), F.col("claim_id")).alias("claim_id"), F.when(F.col(pk.CORRUPT).isNull(), F.col("context.admission_date").cast("string")).alias("admission_date"),
        F.when(F.col(pk.CORRUPT).isNull(), (F.col("room_stay.rate_per_day") * 100).cast("bigint")).alias("rate"),
        F.when(F.col(pk.CORRUPT).isNull(), F.size("line_items")).alias("n_lines"), F.col(pk.CORRUPT).isNotNull().alias("corrupt"))


@case("SRC2", """SELECT claim_id, CASE WHEN n = 3 AND k % 47 = 0 THEN 2 ELSE n END AS line_no, CASE n WHEN 1 THEN 'ROOM' WHEN 2 THEN 'OTHER' ELSE CASE WHEN k % 5 = 0 THEN 'OTHER' ELSE 'PROCEDURE' END END AS head,
 CASE n WHEN 1 THEN (3000 + k % 10 * 500) * 300 WHEN 2 THEN p // 10 ELSE p // 2 END AS amount_paise, CASE WHEN n = 1 THEN 3 ELSE 1 END AS quantity, 0 AS unit_rate_paise, n = 2 AS outside_stay, n = 2 OR n = 3 AND k % 47 = 0 AS outside_number
 FROM (SELECT e.*, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM packet_errors e JOIN orders ON o_orderkey = k WHERE NOT corrupt AND error = ''), (VALUES (1), (2), (3)) AS t(n)""")
def src2(x):
    good, _ = batch.split_packets(packets(x))
    return pk.explode_lines(good, tenant()).select("claim_id", "line_no", "head", "amount_paise", F.col("quantity").cast("bigint").alias("quantity"), "unit_rate_paise", "outside_stay", "outside_number")


# --- batches -------------------------------------------------------------------------------


def new_store(x) -> str:
    return f"{shared_dir(x.spark)}/intake-{x.spark.sparkContext.applicationId}-{id(x)}-{b.next_number()}"


def take(x, frame: DataFrame, path: str, name: str) -> DataFrame:
    return batch.intake_batch(frame.drop("k"), path, x.rules, x.sources, tenant=tenant(), today=b.TODAY, batch=name, recorded_at=F.lit("2026-01-01T00:00:00+00:00"))


@case("BAT1", f"""SELECT claim_id, ok, error, CAST(sum(n) AS BIGINT) AS n FROM (
 SELECT CASE WHEN corrupt THEN NULL ELSE claim_id END AS claim_id, FALSE AS ok, CASE WHEN corrupt THEN 'corrupt' ELSE 'ValidationError: ' || error END AS error,
  CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END AS n FROM packet_errors WHERE corrupt OR error <> ''
 UNION ALL SELECT claim_id, FALSE, 'DuplicateClaim: {batch.KNOWN}', CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END FROM packet_errors WHERE NOT corrupt AND error = '' AND k % 10 = 0
 UNION ALL SELECT claim_id, TRUE, '', 1 FROM packet_errors WHERE NOT corrupt AND error = '' AND k % 10 <> 0
 UNION ALL SELECT claim_id, FALSE, 'DuplicateClaim: {batch.TWICE}', 1 FROM packet_errors WHERE NOT corrupt AND error = '' AND k % 10 <> 0 AND k % 9 = 0) GROUP BY ALL""")
def bat1(x):
    """A tenth of the packets in one batch, then all of them in another, a ninth twice."""
    path = new_store(x)
    take(x, packets(x).where("k % 10 = 0"), path, "first")
    results = take(x, packets(x).unionByName(packets(x).where("k % 9 = 0")), path, "second")
    corrupt = F.col("error").contains("unreadable JSON")
    return results.groupBy(F.when(~corrupt, F.col("claim_id")).alias("claim_id"), "ok", F.when(corrupt, "corrupt").otherwise(F.col("error")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@case("BAT2", """SELECT claim_id, TRUE AS ok, '' AS error FROM packet_errors WHERE NOT corrupt AND error = ''
 UNION ALL SELECT claim_id, FALSE, 'ValidationError: ' || error FROM packet_errors WHERE NOT corrupt AND error <> ''
 UNION ALL SELECT NULL, FALSE, 'corrupt' FROM packet_errors WHERE corrupt""")
def bat2(x):
    _, results = batch.audit_batch(packets(x).drop("k"), x.rules, x.sources, tenant=tenant(), today=b.TODAY)
    corrupt = F.col("error").contains("unreadable JSON")
    return results.select(F.when(~corrupt, F.col("claim_id")).alias("claim_id"), "ok", F.when(corrupt, "corrupt").otherwise(F.col("error")).alias("error"))


@case("BAT3", "SELECT tenant, claim_id, verdict, settlement_paise, patient_paise, hospital_paise, coverage, finding_count FROM audits")
def bat3(x):
    out = batch.outcomes(x.audit.audits)
    return out.select(*K, "verdict", "settlement_paise", "patient_paise", "hospital_paise", F.col("coverage").cast("string").alias("coverage"), "finding_count")


@case("BAT4", """SELECT tenant, count(*) AS claims, CAST(sum(settlement_paise) AS BIGINT) AS settlement_paise, CAST(sum(patient_paise) AS BIGINT) AS patient_paise, CAST(sum(hospital_paise) AS BIGINT) AS hospital_paise,
 count(*) FILTER (verdict = 'NEEDS_ATTENTION') AS needs_attention, count(*) FILTER (verdict = 'CANNOT_VERIFY') AS cannot_verify, count(*) FILTER (verdict = 'CLEAN') AS clean FROM audits GROUP BY tenant""")
def bat4(x):
    return batch.batch_totals(batch.outcomes(x.audit.audits), ["tenant"])


@case("BAT5", """SELECT job_id, total, COALESCE(c, 0) AS completed, COALESCE(f, 0) AS failed, CASE WHEN total = 0 THEN 10000 ELSE CAST(round_even(COALESCE(c, 0) * 10000.0 / total, 0) AS BIGINT) END AS progress FROM (
 SELECT j AS job_id, CASE WHEN j % 40 = 7 THEN 0 ELSE 120 END AS total, CASE WHEN j % 40 <> 7 THEN c END AS c, CASE WHEN j % 40 <> 7 THEN f END AS f FROM (
 SELECT k // 100 AS j, count(*) AS c, count(*) FILTER (corrupt OR error <> '') AS f FROM packet_errors GROUP BY 1))""")
def bat5(x):
    marked = packets(x).withColumn("ok", F.size(pk.packet_problems(packets(x).columns)) == 0).select(F.expr("k div 100").alias("job_id"), "ok")
    jobs = x.table("orders").select(F.expr("o_orderkey div 100").alias("job_id")).distinct().select(
        "job_id", F.when(F.col("job_id") % 40 == 7, 0).otherwise(120).alias("total"), F.col("job_id").alias("submitted_at"))
    results = marked.where("job_id % 40 <> 7")
    return batch.batch_progress(jobs, results).select("job_id", "total", "completed", "failed", F.round(F.col("progress") * 10000).cast("bigint").alias("progress"))


# --- traces ----------------------------------------------------------------------------------


def trace_texts(x) -> DataFrame:
    e, n = F.col("event_id"), F.col("user_id")
    node = lambda name, ms, pt, ct: F.struct(
        F.lit(name).alias("node"), F.col("ts").cast("string").alias("started_at"), ms.alias("latency_ms"), pt.alias("prompt_tokens"), ct.alias("completion_tokens"))
    json = F.to_json(F.struct(
        F.concat(F.lit("RUN-"), e.cast("string")).alias("claim_id"), F.when(e % 3 != 0, F.concat(F.lit("T"), (n % 4).cast("string"))).alias("tenant"),
        F.array(node("classify", e % 500, n * 10, n % 7), node("explain", e % 90, F.when(e % 2 == 0, n), F.lit(3)), node("verify", F.lit(1), F.lit(0), F.lit(0))).alias("nodes")))
    return x.table("events").select(json.alias("json"), F.expr("event_id div 500").alias("part"))


def traces(x) -> DataFrame:
    return records.trace_nodes(records.parse_traces(trace_texts(x).select("json")))


CTES["trace_nodes"] = """
SELECT CASE WHEN event_id % 3 <> 0 THEN 'T' || user_id % 4 ELSE 'local' END AS tenant, 'RUN-' || event_id AS claim_id, i AS node_no, ['classify', 'explain', 'verify'][i + 1] AS node,
 CASE i WHEN 0 THEN event_id % 500 WHEN 1 THEN event_id % 90 ELSE 1 END AS latency_ms, CASE i WHEN 0 THEN user_id * 10 WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END ELSE 0 END AS prompt_tokens,
 CASE i WHEN 0 THEN user_id % 7 WHEN 1 THEN 3 ELSE 0 END AS completion_tokens FROM events, (VALUES (0), (1), (2)) AS t(i)"""


@case("SRC7", "SELECT *, 1 AS attempts FROM trace_nodes")
def src7(x):
    return traces(x).select("tenant", "claim_id", "node_no", "node", "latency_ms", "prompt_tokens", "completion_tokens", "attempts")


@case("SRC7F", "SELECT *, 1 AS attempts FROM trace_nodes")
def src7f(x):
    """The same traces, written to files and read by the reader of files."""
    made = records.trace_nodes(records.read_traces(x.spark, b.json_files(x, trace_texts(x), "traces")))
    return made.select("tenant", "claim_id", "node_no", "node", "latency_ms", "prompt_tokens", "completion_tokens", "attempts")


@case("P13", """SELECT 'run' AS part, tenant || '/' || claim_id AS name, CAST(sum(latency_ms) AS BIGINT) AS total_ms, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM trace_nodes GROUP BY ALL
 UNION ALL SELECT 'node', node, CAST(sum(latency_ms) AS BIGINT), CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) FROM trace_nodes GROUP BY ALL""")
def p13(x):
    t = traces(x)
    runs = portfolio.trace_totals(t).select(F.lit("run").alias("part"), F.concat_ws("/", *K).alias("name"), "total_ms", "total_tokens")
    return runs.unionByName(portfolio.trace_totals_by_node(t).select(F.lit("node").alias("part"), F.col("node").alias("name"), "total_ms", "total_tokens"))


@case("E6", """SELECT n, {inv} AS invariant_rate, {ver} AS verify_rate, {cit} AS citation_coverage, {rep} AS mean_repairs, {lat} AS mean_latency_ms, {tok} AS mean_tokens, judged, {gr} AS groundedness, {us} AS usefulness FROM (
 SELECT count(*) AS n, count(*) FILTER (event_id % 50 <> 0) AS inv, count(*) FILTER (event_id % 9 <> 0) AS ver, sum(event_id % 4) AS cit, sum(event_id % 4 + user_id % 2) AS lst, sum(event_id % 3) AS rep,
 sum(CAST(round(value * 100) AS BIGINT)) AS lat, sum(user_id) AS tok, count(*) FILTER (event_type = 'click') AS judged, sum(event_id % 6) FILTER (event_type = 'click') AS gr, sum(user_id % 6) FILTER (event_type = 'click') AS us FROM events)""".format(
    cit=b.decimal_text(b.half_even("cit * 10000", "lst"), 4), gr=b.decimal_text(b.half_even("gr * 10000", "judged"), 4), us=b.decimal_text(b.half_even("us * 10000", "judged"), 4),
    **{c: b.decimal_text(b.half_even(f"{c} * 10000", "n"), 4) for c in ("inv", "ver", "rep", "lat", "tok")}))
def e6(x):
    e, judged = F.col("event_id"), F.col("event_type") == "click"
    runs = x.table("events").select(
        (e % 50 != 0).alias("invariant"), (e % 9 != 0).alias("verify_passed"), (e % 4).alias("cited"), (e % 4 + F.col("user_id") % 2).alias("listed"), (e % 3).alias("repairs"),
        F.round(F.col("value") * 100).cast("bigint").alias("latency_ms"), F.col("user_id").alias("tokens"), F.when(judged, e % 6).alias("groundedness"), F.when(judged, F.col("user_id") % 6).alias("usefulness"))
    out = evaluate.eval_aggregate(runs)
    return out.select(*[c if c in ("n", "judged") else F.col(c).cast("string").alias(c) for c in out.columns])


# --- admission and metrics ---------------------------------------------------------------------


def requests(events: DataFrame) -> DataFrame:
    """Requests: a key per user and kind, the body changes with the tens digit of the value."""
    return events.select(
        F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("tenant"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"),
        "event_id", "ts", (F.floor(F.col("value") / 10) % 2).cast("string").alias("fingerprint"))


CTES["requests"] = """
SELECT 'T' || user_id % 4 AS tenant, event_type || '-' || user_id AS key, event_id, ts, CAST(CAST(floor(value / 10) AS BIGINT) % 2 AS VARCHAR) AS fingerprint FROM events"""
CTES["acceptances"] = """
SELECT tenant, key, min(ts) AS at FROM requests GROUP BY ALL
UNION ALL SELECT a.tenant, a.key, min(r.ts) FROM acceptances a JOIN requests r ON r.tenant = a.tenant AND r.key = a.key AND r.ts > a.at + INTERVAL 24 HOUR GROUP BY a.tenant, a.key, a.at"""
CTES["accepted"] = "SELECT a.tenant, a.key, a.at, min(r.event_id) AS event_id, arg_min(r.fingerprint, r.event_id) AS fingerprint FROM acceptances a JOIN requests r ON r.tenant = a.tenant AND r.key = a.key AND r.ts = a.at GROUP BY ALL"


_ST1 = """SELECT r.event_id, CASE WHEN r.event_id = a.event_id THEN 'accepted' WHEN r.fingerprint = a.fingerprint THEN 'replay' ELSE 'conflict' END AS outcome, a.event_id AS accepted_event
 FROM requests r ASOF JOIN accepted a ON a.tenant = r.tenant AND a.key = r.key AND r.ts >= a.at"""


@case("ST1", _ST1)
def st1(x):
    return intake.idempotent_intake(requests(x.table("events"))).select("event_id", "outcome", "accepted_event")


# The same with all events under one key, which is judged by many tasks.
CTES["hot_acceptances"] = """
SELECT min(ts) AS at FROM requests UNION ALL SELECT (SELECT min(r.ts) FROM requests r WHERE r.ts > a.at + INTERVAL 24 HOUR) FROM hot_acceptances a WHERE a.at IS NOT NULL"""
CTES["hot_accepted"] = "SELECT a.at, min(r.event_id) AS event_id, arg_min(r.fingerprint, r.event_id) AS fingerprint FROM hot_acceptances a JOIN requests r ON r.ts = a.at GROUP BY a.at"


@case("ST1H", """SELECT r.event_id, CASE WHEN r.event_id = a.event_id THEN 'accepted' WHEN r.fingerprint = a.fingerprint THEN 'replay' ELSE 'conflict' END AS outcome, a.event_id AS accepted_event
 FROM requests r ASOF JOIN hot_accepted a ON r.ts >= a.at""")
def st1h(x):
    hot = requests(x.table("events")).withColumn("tenant", F.lit("T")).withColumn("key", F.lit("all"))
    return intake.idempotent_intake(hot, busy=0).select("event_id", "outcome", "accepted_event")


_LIMIT, _WINDOW = 5, 6 * 3600.0


CTES["st2_hits"] = "SELECT 'u' || user_id AS identity, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
CTES["st2_run"] = f"""
SELECT identity, n, event_id, TRUE AS allowed, CAST({_LIMIT - 1} AS INTEGER) AS remaining, CAST(0 AS BIGINT) AS retry_after_us, [us] AS times FROM st2_hits WHERE n = 1
UNION ALL SELECT identity, n, event_id, len(kept) < {_LIMIT}, CAST(greatest({_LIMIT} - len(kept) - 1, 0) AS INTEGER),
 CASE WHEN len(kept) < {_LIMIT} THEN 0 ELSE kept[1] + {int(_WINDOW * 1e6)} - us END, CASE WHEN len(kept) < {_LIMIT} THEN list_append(kept, us) ELSE kept END
FROM (SELECT h.identity, h.n, h.event_id, h.us, list_filter(r.times, lambda t: t > h.us - {int(_WINDOW * 1e6)}) AS kept
 FROM st2_run r JOIN st2_hits h ON h.identity = r.identity AND h.n = r.n + 1)"""


_ST2 = "SELECT identity, event_id, allowed, remaining, retry_after_us FROM st2_run"


@case("ST2", _ST2)
def st2(x):
    hits = x.table("events").select(F.concat(F.lit("u"), (F.col("user_id")).cast("string")).alias("identity"), "event_id", "ts")
    return intake.rate_admission(hits, _LIMIT, _WINDOW).select("identity", "event_id", "allowed", "remaining", "retry_after_us")


def streamed(x, frame: DataFrame, judge, parts: int = 3) -> DataFrame:
    """What a stream over the rows, which come in parts by time, has judged in the end."""
    work, frame = new_store(x), frame.withColumn("ts", F.col("ts").cast("timestamp"))
    ends = frame.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    share = (F.unix_micros("ts") - F.unix_micros(ends.select("a").scalar())) / (F.unix_micros(ends.select("z").scalar()) - F.unix_micros(ends.select("a").scalar()))
    dated = frame.withColumn("part", F.least(F.floor(share * parts), F.lit(parts - 1)))
    for k in range(parts):  # the stream stops and starts again from its checkpoint after every part
        dated.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{work}/in")
        rows = x.spark.readStream.schema(frame.schema).parquet(f"{work}/in")
        writer = judge(rows).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return x.spark.read.schema(judge(rows).schema).parquet(f"{work}/out")


@case("ST1S", _ST1)
def st1s(x):
    return streamed(x, requests(x.table("events")), stream_requests.idempotent_stream).select("event_id", "outcome", "accepted_event")


@case("ST2S", _ST2)
def st2s(x):
    hits = x.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identity"), "event_id", "ts")
    judged = streamed(x, hits, lambda rows: stream_requests.rate_stream(rows, _LIMIT, _WINDOW))
    return judged.select("identity", "event_id", "allowed", "remaining", "retry_after_us")


_EDGES = ", ".join(f"('{e:g}', {e})" for e in intake.LATENCY_EDGES)


@case("ST3", f"""SELECT event_type, edge, count(*) FILTER (value <= le) AS cumulative, CAST(round(sum(value) * 100) AS BIGINT) AS cents, count(*) AS count FROM events, (VALUES {_EDGES}, ('+Inf', 1e300)) AS t(edge, le) GROUP BY event_type, edge""")
def st3(x):
    obs = x.table("events").select("event_type", "value")
    return intake.latency_histogram(obs, ["event_type"]).select("event_type", "edge", "cumulative", F.round(F.col("sum") * 100).cast("bigint").alias("cents"), "count")


@case("ST4", """SELECT 'counter' AS kind, event_type AS name, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY ALL
 UNION ALL SELECT 'gauge', event_type, arg_max(user_id, epoch_us(ts)::HUGEINT * 10000000000 + event_id) FROM events GROUP BY event_type""")
def st4(x):
    e = x.table("events")
    total = intake.counters(e.select("event_type", F.col("user_id").alias("by")), ["event_type"])
    last = intake.gauges(e.select("event_type", "ts", "event_id", F.col("user_id").alias("value")), ["event_type"])
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("event_type").alias("name"), "value")
    return tag(total, "counter").unionByName(tag(last, "gauge"))


@case("ST5", """SELECT 'T0' AS tenant, claim_id, strftime(CAST(o_orderdate AS DATE) + 3, '%Y-%m') AS month, o_orderpriority AS diagnosis,
 (3000 + k % 10 * 500) * 300 + p // 10 + p // 2 AS gross_bill_paise, 3 AS n_findings, 1 AS n_entries FROM (
 SELECT e.*, o_orderdate, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM packet_errors e JOIN orders ON o_orderkey = k WHERE NOT corrupt AND error = '')""")
def st5(x):
    """The orders file as a stream of packets, a tenth of them known from a batch, and the stream run again without its checkpoint: what the
    store and the ledger then hold of every claim."""
    work = new_store(x)
    take(x, packets(x).where("k % 10 = 0"), work, "first")
    for k in range(2):
        writer = streaming_audit(streamed_packets(x).drop("k"), work, x.rules, x.sources, tenant=tenant(), today=b.TODAY, recorded_at=F.lit("2026-01-01T00:00:00+00:00"))
        writer.option("checkpointLocation", f"{work}/checkpoint-{k}").trigger(availableNow=True).start().awaitTermination()
    now = store.read_store(x.spark, work)
    count = lambda df, name: df.groupBy(*K).agg(F.count(F.lit(1)).alias(name))
    return (now.claims.select(*K, "month", "diagnosis", "gross_bill_paise").join(count(now.findings, "n_findings"), K, "left")
            .join(count(x.spark.read.parquet(f"{work}/ledger"), "n_entries"), K, "left"))
