import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from replyscope.llm import warc
from replyscope.llm.registry import QUERIES, SQL

PAGES = "page_id long, url string, html string, digest string, payload int, header string"
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "", "é" * 5000),
    (6, "http://a/6\r\nPage-ID: 77", "x\r\n\r\nWARC-Type: revisit\r\n"), (9, "http://a/9", "<p>one</p>"), (9, "http://a/9", "other"), (None, "http://a/n", "<p>one</p>"),
    (None, "http://a/n", "only"), (7, "http://a/ Page-ID: 5", "<p>seven</p>"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "h") for r in rows], PAGES)


def expected(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        last = max(ids, default=None)
        revisit = last is not None and i != last and len(b) >= min_bytes
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def digests(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_query_against_plain_version_and_sql(spark, tmp_path):
    pages(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op13_warc_archive"](spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert digests(got) == expected(ROWS)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    twin = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['op13_warc_archive']})").fetchall()
    assert sorted(twin, key=repr) == expected(ROWS)


def test_records_come_back_byte_by_byte(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(pages(spark, ROWS), path, min_bytes=6)
    assert digests(warc.read_archive(spark, path)) == expected(ROWS, 6)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    urls = {r.page_id: r.url for r in warc.read_archive(spark, path).collect()}
    assert urls[6] == "http://a/6%0D%0APage-ID: 77" and urls[3] is None and urls[5] is None and urls[7] == "http://a/ Page-ID: 5"

    def parts(record):
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        return lines[0], dict(x.split(": ", 1) for x in lines[1:]), rest

    got = []
    for r in warc.rebuild_records(spark, path).collect():
        version, fields, rest = parts(bytes(r.record))
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n:] == b"\r\n\r\n" and fields["WARC-Record-ID"] == r.record_id
        http, _, payload = rest[:n].partition(b"\r\n\r\n")
        revisit = fields["WARC-Type"] == "revisit"
        assert payload == (b"" if revisit else bytes(r.payload)) and ("WARC-Refers-To" in fields) == revisit
        assert http.endswith(f"Content-Length: {len(r.payload)}".encode())
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        page = fields.get("Page-ID")
        got.append((int(page) if page else None, bytes(r.payload).decode()))
    assert sorted(got, key=repr) == sorted([(i, h or "") for i, _, h in ROWS], key=repr)


def test_damage_is_found(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), f"{tmp_path}/a")
    for column, what in ((F.concat("payload", F.lit("!").cast("binary")), "does not have its digest"), (None, "another payload digest")):
        path = f"{tmp_path}/{what.replace(' ', '_')}"
        p, h = (spark.read.parquet(f"{tmp_path}/a/{t}") for t in ("payloads", "headers"))
        if column is not None:
            p = p.withColumn("payload", F.when(F.col("n") > 2, column).otherwise(F.col("payload")))
        else:
            h = h.withColumn("header", F.replace(F.col("header").cast("string"), F.lit("sha1:"), F.lit("sha1:A")).cast("binary"))
        p.write.parquet(f"{path}/payloads")
        h.write.parquet(f"{path}/headers")
        with pytest.raises(Exception, match=what):
            warc.read_archive(spark, path).collect()


def test_empty_table_and_hot_payload(spark, tmp_path):
    warc.write_archive(pages(spark, []), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").count() == 0 and warc.rebuild_records(spark, f"{tmp_path}/none").count() == 0
    hot = spark.range(3000).selectExpr("id as page_id", "'u' as url", "case when id % 3 = 0 then 'hot' else cast(id as string) end html")
    warc.write_archive(hot, f"{tmp_path}/hot")
    got = warc.read_archive(spark, f"{tmp_path}/hot").groupBy("record_type").agg(F.count("*").alias("n"), F.max("refers_to").alias("to"))
    assert {r.record_type: (r.n, r.to) for r in got.collect()} == {"response": (2001, None), "revisit": (999, 2997)}
