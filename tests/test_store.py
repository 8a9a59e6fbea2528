from sparkloom.operators import store


def test_upsert_is_idempotent_and_partitions_are_replaced_alone(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, part string, v int")
    new = spark.createDataFrame([(2, "b", 2), (2, "b", 2), (3, "b", 3)], "id int, part string, v int")
    once = store.upsert(old, new, ["id"])
    want = {(1, 1), (2, 2), (3, 3)}
    assert {(r.id, r.v) for r in once.collect()} == want == {(r.id, r.v) for r in store.upsert(once, new, ["id"]).collect()}
    assert [r.id for r in store.without(old, new, ["part"]).collect()] == [1]
    path = str(tmp_path / "t")
    store.replace_partitions(old, path, ["part"])
    store.replace_partitions(new.dropDuplicates(["id"]), path, ["part"])
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == want


def test_upsert_into_and_from_empty(spark):
    rows = spark.createDataFrame([(1, 1)], "id int, v int")
    assert store.upsert(rows.limit(0), rows, ["id"]).count() == 1 and store.upsert(rows, rows.limit(0), ["id"]).count() == 1
