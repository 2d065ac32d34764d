"""Archives written and read back; the SQL form; odd payloads."""

import gzip
import hashlib
import uuid

import duckdb
import pytest

from auditlens.llm import queries, warc
from auditlens.llm.common import shared_dir
from tests.conftest import SF
from tests.llm.test_mixing import rows_of


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    df = queries.QUERIES["op2_warc"](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == rows_of(con, queries.ORACLE["op2_warc"], df.columns) and got


def there_and_back(spark, rows, **options):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type int")
    warc.write_archives(df, path, **options)
    return path, warc.read_captures(spark, path).collect()


def test_odd_payloads(spark):
    big = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40 + "é😀\x00"
    html = {1: None, 2: "", 3: big, 4: big, 9: big, 5: "y" * 999, 6: "y" * 999, 7: "\r\n", 8: "z" * 200_000, None: big}
    rows = [(i, None if i == 2 else f"http://h/{i}\n%é", h, "p", 3) for i, h in html.items()] + [(9, "http://h/9", big, "q", 4)]
    path, back = there_and_back(spark, rows, records_per_file=4)
    assert sorted((r.page_id for r in back), key=str) == sorted(html, key=str)
    for r in back:
        payload = (html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        repeats = html[r.page_id] == big and r.page_id != 9
        assert (r.record_type, r.refers_to) == (("revisit", 9) if repeats else ("response", None))
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id
    stored = warc.read_records(spark, path, blocks=True).where("record_type = 'response'").collect()
    assert {r.payload_digest: r.block.partition(b"\r\n\r\n")[2] for r in stored}[hashlib.sha1(big.encode()).hexdigest()] == big.encode()


def test_nothing_and_broken(spark):
    path, back = there_and_back(spark, [])
    assert back == []
    whole = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc._walk(whole * 2)] == [b"abc"] * 2 and [b for _, b in warc._walk(gzip.compress(whole))] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc._walk(whole[:-6]))


def test_parts_may_be_missing_or_repeated(spark):
    path, _ = there_and_back(spark, [(i, "u", f"{i}", "", 0) for i in range(3)])
    records = warc.read_records(spark, path)
    assert warc.captures(records.union(records)).count() == 3
    bare = warc.captures(records.where("record_type = 'response'")).collect()
    assert len(bare) == 3 and all(r.request is None and r.page_id is None for r in bare)
