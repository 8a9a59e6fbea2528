from sparkloom.operators import blocks


def test_runs_do_not_depend_on_the_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([("s", n, "ab"[(n // 3) % 2]) for n in range(1, 40)] + [("t", 500, "a"), ("t", 7000, "a")], "k string, n int, v string")
    whole = sorted((r.k, r.n, r.run) for r in blocks.runs(rows, "k", "n", "v").collect())
    monkeypatch.setattr(blocks, "BLOCK", 4)
    assert sorted((r.k, r.n, r.run) for r in blocks.runs(rows, "k", "n", "v").collect()) == whole
    assert whole[-1] == ("t", 7000, 1) and whole[5][2] == 3
