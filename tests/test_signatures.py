"""Required literals of expressions, and that looking for them first changes no match."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histlens.operators import signatures
from histlens.operators.signatures import required_literals


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [
        (r"\bcreateClient\(", ("createClient(",)), (r"from ['\"]stripe['\"]", ("stripe",)), (r"(?:foo|barn)x+", ("foo", "barn")), (r"abc?def", ("def",)), (r"(abc)*", None), (r"(?:xyz)+", ("xyz",)), (r"a|bcd", None), (r"(?i)abc", None), (r"abc(?i:def)", None), (r"\Qa.b\E", None), (r"\p{L}abc", None),
        (r"[a-z]+", None), (r"", None), (r"(", None), (r"^import\s+(\w+)", ("import",)), (r"(?=abc)x", None), (r"a\.b\.c", ("a.b.c",)), (r"(?:verylong|ab)c{2,3}defg", ("defg",)), (r"[a&&b]abc", None), (r"(x)\1abc", None),
    ],
)
def test_required_literals(pattern, wanted):
    assert required_literals(pattern) == wanted


PIECES = st.recursive(st.sampled_from(["abc", "xyz", "foo", "a", "[ab]", ".", r"\b", "^", r"\."]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{0,2}"])).map(lambda p: f"(?:{p[0]}){p[1]}")), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.lists(st.sampled_from(["abc", "xyz", "foo", "a", "b", ".", " ", "fo"]), max_size=9).map("".join))
def test_every_match_holds_a_literal(pattern, text):
    needed = required_literals(pattern)
    found = re.search(pattern, text)
    assert not (found and needed) or any(x in found[0] for x in needed)


@pytest.mark.parametrize("few", [0, 32])
def test_matches_equal_plain_search(spark, monkeypatch, few):
    """Literals first, or all expressions at once."""
    monkeypatch.setattr(signatures, "FEW", few)
    texts = ["import stripe\nstripe.webhooks.constructEvent(x)", "STRIPE foo.bar", "", None, "créer été\nfoo barn", "aaa\nabcabc", "// nothing"]
    paths = ["a.ts", "Dockerfile", None, "x/docker-compose.yml", "", "b.tf", "c.py"]
    rules = [("pay", "import", r"\bimport stripe\b"), ("pay", "api", r"constructEvent\("), ("any", "api", r"(?i)stripe"), ("lang", "api", r"(?:été|foo barn)"), ("docker", "config", r"(^|/)Dockerfile$"), ("docker", "config", r"docker-compose\.ya?ml$"), ("tf", "config", r"\.tf$"), ("rep", "api", r"(?:abc){2}"), ("short", "api", "aa")]
    files = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, paths))], "id int, added_text string, path string")
    found = signatures.matches(files, spark.createDataFrame(rules, "slug string, kind string, pattern string"), ["id"], clean=False)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted({(i, s) for i, (t, p) in enumerate(zip(texts, paths)) for s, k, r in rules if re.search(r, (p if k == "config" else t) or "\0")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    none = signatures.matches(files, spark.createDataFrame([], "slug string, kind string, pattern string"), ["id"])
    assert none.count() == 0 and none.columns == ["id", "slug"]


def test_a_large_dictionary(spark):
    rules = [(f"s{i % 700}", "api", rf"\bname{i}\b") for i in range(3000)]
    files = spark.range(50).select("id", F.concat(F.lit("x name"), F.col("id") * 60, F.lit(" name9999 prename1")).alias("added_text"), F.lit("p").alias("path"))
    found = signatures.matches(files, spark.createDataFrame(rules, "slug string, kind string, pattern string"), ["id"])
    assert sorted(map(tuple, found.collect())) == sorted((i, f"s{i * 60 % 700}") for i in range(50))
