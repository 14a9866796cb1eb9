"""Rules of package maps."""

from histlens.operators import skills


def test_repeated_keys_do_not_multiply_prefixes(spark):
    """A head that is there many times and a longer key that is there many times are one fault (finding F2)."""
    rows = spark.createDataFrame([("com.t1", "a")] * 40 + [("com.t1.p", "a")] * 50 + [("com.t1.p.q", "b"), ("com.t10", "a"), ("alone", "a")], "package string, slug string")
    found = skills.map_faults(rows, spark.createDataFrame([("a",)], "slug string"), 1)
    assert sorted(map(tuple, found.where("rule = 'prefix'").collect())) == [("prefix", x) for x in ("com.t1 < com.t1.p", "com.t1 < com.t1.p.q", "com.t1.p < com.t1.p.q")]
    assert sorted(map(tuple, found.where("rule <> 'prefix'").collect())) == [("repeated", "com.t1"), ("repeated", "com.t1.p"), ("unknown_slug", "b")]
