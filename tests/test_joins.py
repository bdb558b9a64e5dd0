from replyscope.operators import joins


def test_gold_join_semantics(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "row_id long, nat_instr_id string")
    gold = spark.createDataFrame([("a", "ga"), ("b", "gb1"), ("b", "gb2"), (None, "gnull")],
                                 "nat_instr_id string, generated_req_output string")
    out = sorted((r["row_id"], r["generated_req_output"]) for r in joins.join_gold(rows, gold).collect())
    assert out == [(1, "ga"), (2, "gb1"), (2, "gb2")]  # unmatched dropped, duplicate key multiplies
    safe = sorted((r["row_id"], r["generated_req_output"]) for r in joins.join_gold(rows, gold, null_safe=True).collect())
    assert (3, "gnull") in safe
    assert [r["nat_instr_id"] for r in joins.duplicate_keys(gold).collect()] == ["b"]
    unique = gold.dropDuplicates(["nat_instr_id"]).where("nat_instr_id IS NOT NULL")
    assert joins.join_gold(rows.where("row_id < 3"), unique).count() == 2  # row count kept when keys are unique
