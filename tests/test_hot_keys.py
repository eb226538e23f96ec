from bitsieve.operators import hot_keys


def test_nulls_copies_and_hot_key(spark):
    rows = [("a", i % 50) for i in range(100)] + [("b", 1), ("b", None), (None, 7)] * 2
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "key string, item long, n_rows int")
    keys = hot_keys.per_key(hot_keys.distinct_rows(df, "key", "item"), ["key"], "item")
    got = {r.key: (r.n_rows, r.n_items, r.first_item, r.last_item) for r in keys.collect()}
    assert got == {"a": (50, 50, 0, 49), "b": (2, 1, 1, 1), None: (1, 1, 7, 7)}
    assert [r.key for r in hot_keys.heavy_keys(keys, ["key"], 0.5).collect()] == ["a"]
    assert {r.key for r in hot_keys.heavy_keys(keys, ["key"], 0.0).collect()} == {"a", "b"}


def test_empty(spark):
    df = spark.createDataFrame([], "key string, item long")
    keys = hot_keys.per_key(df, ["key"], "item")
    assert keys.count() == 0 and hot_keys.heavy_keys(keys, ["key"], 0.1).count() == 0
