"""Positions, running aggregates and the row before, against brute force, with a group that holds most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from histlens.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(50)])) for i in range(4000)]
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, at long, v long").repartition(3).cache()


@pytest.fixture(params=[ordered.BIG, 1000, 10], autouse=True)
def big(request, monkeypatch):
    """By windows alone, the hot group dealt out, and all groups dealt out."""
    monkeypatch.setattr(ordered, "BIG", request.param)


def groups(rows):
    found = defaultdict(list)
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        found[k].append((at, v))
    return found


def test_positions(rows, table):
    assert sorted((r["at"], r["pos"]) for r in ordered.numbered(table, ["at"]).collect()) == [(i, i) for i in range(4000)]
    found = {r["at"]: r["pos"] for r in ordered.numbered(table, [F.desc("at")], ["k"]).collect()}
    assert found == {at: i for g in groups(rows).values() for i, (at, _) in enumerate(reversed(g))}


def test_running(rows, table):
    found = ordered.running(table, ["at"], ["k"], {"s": (F.sum, F.col("v")), "lo": (F.min, F.col("v")), "hi": (F.max, F.col("v"))})
    wanted = {}
    for g in groups(rows).values():
        seen = []
        for at, v in g:
            seen += [v] if v is not None else []
            wanted[at] = (sum(seen), min(seen), max(seen)) if seen else (None, None, None)
    assert {r["at"]: (r["s"], r["lo"], r["hi"]) for r in found.collect()} == wanted
    with pytest.raises(ValueError):
        ordered.running(table, ["at"], ["k"], {"m": (F.avg, F.col("v"))})


def test_preceding(rows, table):
    found = {r["at"]: r["before"] and tuple(r["before"]) for r in ordered.preceding(table, ["at"], ["k"], ["at", "v"]).collect()}
    assert found == {at: (g[i - 1] if i else None) for g in groups(rows).values() for i, (at, _) in enumerate(g)}


def test_a_hot_group_is_many_partitions(table):
    laid = ordered.laid_out(table, ["k", "at"])
    held = [r["count"] for r in laid.groupBy("__part").count().collect()]
    assert len(held) == 4 and max(held) < 2 * 4000 / 4


def test_empty(table):
    none = table.where("at < 0")
    assert ordered.numbered(none, ["at"]).count() == ordered.running(none, ["at"], ["k"], {"s": (F.sum, F.col("v"))}).count() == ordered.preceding(none, ["at"], ["k"], ["v"]).count() == 0
