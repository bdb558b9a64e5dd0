import re
from itertools import permutations

import duckdb
from cases import documents, empty_documents, odd_rows
from pyspark.sql import functions as F

from replyscope.llm import filter_audit
from replyscope.llm.registry import QUERIES, SQL

LABELS = "doc_id long, quality int, toxic int, mask int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def expected(rows, labels):
    """Every order applied to every row of (doc_id, text, lang), one step after the other."""
    texts = [t or "" for _, t, _ in rows]

    def fails(i):
        d, t = rows[i][0], texts[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = any(d is not None and e is not None and e < d and u == t for (e, _, _), u in zip(rows, texts))
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": same}

    all_fails = [fails(i) for i in range(len(rows))]
    good = [any(x == d and q == 1 for x, q, _ in labels if x is not None) for d, _, _ in rows]
    toxic = [any(x == d and m == 1 for x, _, m in labels if x is not None) for d, _, _ in rows]
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, x in enumerate(order, 1):
                hit = {i for i in mine if all_fails[i][x]}
                gone = hit & left
                shapley[x] += len(gone)
                alone = [i for i in hit if sum(all_fails[i].values()) == 1]
                out[part, order, step] = [len(left - gone), len(gone), len(hit - left), len(alone), sum(good[i] for i in gone), sum(toxic[i] for i in gone), x]
                left -= gone
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return out


def write(spark, tmp_path, rows, labels):
    documents(spark, rows).withColumn("lang", F.col("source")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 3) for r in labels], LABELS).write.parquet(f"{tmp_path}/labels.parquet")


def test_against_all_orders_and_sql(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(250))
    rows = odd_rows() + [
        (30, long, "a"), (31, long, "a"), (32, long, None), (29, long, ""), (33, long + " A#", "a"), (34, "THE END " * 150, "b"), (35, long + " |", "b"), (36, "x " * 300, "a"), (None, long, "a"),
    ]
    labels = [(1, 1, 1), (5, 1, 0), (5, 0, 1), (5, None, None), (30, 1, 0), (31, 1, 1), (34, 0, 1), (35, 1, 0), (None, 1, 1), (99, 1, 1)]
    write(spark, tmp_path, rows, labels)
    got = QUERIES["op11_filter_audit"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    got = got.collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == expected(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op11_filter_audit']})").fetchall()) == sorted(map(tuple, got))


def test_empty_table(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(filter_audit.masks(empty_documents(spark), labels)).count() == 0


def test_fields_do_not_run_over():
    """A sum near the end of a field leaves its neighbours alone."""
    times, mask = 2**63 - 1, 0b0100101
    total = (times * filter_audit.packed(mask, "ABCDE")).to_bytes(8 * 3005, "little")
    fields = {int.from_bytes(total[i : i + 8], "little") for i in range(0, len(total), 8)}
    assert fields == {0, times}


def test_many_parts_and_hot_part(spark):
    """Half of all rows in one part, and more other parts than a task holds at once."""
    rows = spark.range(4000).selectExpr("case when id % 2 = 0 then 'hot' else cast(id as string) end part", "cast(id % 32 as int) mask")
    got = filter_audit.filter_audit(rows)
    assert got.count() == 600 * 2001
    hot = {tuple(r)[1:3]: r for r in got.where("part = 'hot'").collect()}
    # The hot masks are even: A fails never, each other filter in half of its rows.
    assert hot["ABCDE", 1].kept == 2000 and hot["BACDE", 1].removed == 1000 and hot["EDCBA", 5].kept == 125
