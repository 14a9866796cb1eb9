import random

import pytest
from by_hand import Search, classify

from histlens.operators import infer
from histlens.operators.anchors import find_anchors
from histlens.operators.infer import PATTERNS, findings


def anchor(kind, path, fn="f", line=1, provider=None, library=None):
    return {"kind": kind, "path": path, "fn": fn, "line": line, "reason": "", "provider": provider, "library": library}


STRIPE = "payments/payment-webhook-flow"


def hook(path, fn="f", line=1, provider=STRIPE):
    return anchor("webhook-verification", path, fn, line, provider)


def of(found, slug):
    return next((f for f in found if f["slug"] == slug), None)


def test_same_function_beats_file_beats_distance():
    three = [hook("a"), anchor("db-write", "a", line=2), anchor("idempotency-guard", "a", line=3)]
    assert of(classify(three, {}, set(), {"a"}), STRIPE)["connection"] == "same-function"
    three[1]["fn"] = "g"
    found = of(classify(three, {}, set(), {"a"}), STRIPE)
    assert (found["connection"], found["confidence"]) == ("same-file", "direct")
    apart = [hook("a"), anchor("db-write", "c"), anchor("idempotency-guard", "c")]
    found = of(classify(apart, {"a": {"b"}, "b": {"a", "c"}, "c": {"b"}}, set(), {"c"}), STRIPE)
    assert (found["connection"], found["edge_distance"], found["confidence"], found["claimed"]) == ("cross-file", 2, "inferred", True)


def test_unconnected_and_imported_only_are_ambiguous():
    apart = [hook("a"), anchor("db-write", "z"), anchor("idempotency-guard", "z")]
    found = of(classify(apart, {}, set(), {"a"}), STRIPE)
    assert (found["confidence"], found["claimed"], found["connection"]) == ("ambiguous", False, None)
    found = of(classify([], {}, {"stripe"}, set()), STRIPE)
    assert found["confidence"] == "ambiguous" and found["anchors"] == []
    assert classify([], {}, set(), set()) == []


def test_other_author_is_not_attributed():
    three = [hook("a"), anchor("db-write", "a"), anchor("idempotency-guard", "a")]
    found = of(classify(three, {}, set(), {"other"}), STRIPE)
    assert (found["attributed"], found["claimed"]) == (False, False)


def test_optional_kind_caps_confidence():
    slug = "payments/mercadopago-flow"
    two = [hook("a", provider=slug), anchor("db-write", "a")]
    assert of(classify(two, {}, set(), {"a"}), slug)["confidence"] == "inferred"
    assert of(classify([*two, anchor("idempotency-guard", "a")], {}, set(), {"a"}), slug)["confidence"] == "direct"


def test_libraries_do_not_mix():
    slug = "auth/session-flow"
    mixed = [anchor("credential-verification", "a", library="A"), anchor("session-issuance", "a", library="B"), anchor("route-guard", "a")]
    assert of(classify(mixed, {}, set(), {"a"}), slug)["confidence"] == "ambiguous"
    mixed.append(anchor("session-issuance", "a", library="A"))
    assert of(classify(mixed, {}, set(), {"a"}), slug)["confidence"] == "direct"


def star(n):
    names = [f"{k}{i:03}" for k in "wdi" for i in range(n)]
    return {"hub": set(names)} | {x: {"hub"} for x in names}


def test_budget_is_shared_and_bounds_the_search():
    n = 30
    anchors = [hook(f"w{i:03}") for i in range(n)] + [anchor("db-write", f"d{i:03}") for i in range(n)] + [anchor("idempotency-guard", f"i{i:03}") for i in range(n)]
    whole = of(classify(anchors, star(n), set(), {"w000"}), STRIPE)
    assert (whole["connection"], whole["edge_distance"], whole["search_bounded"]) == ("cross-file", 2, None)
    cut = of(classify(anchors, star(n), set(), {"w000"}, budget=500), STRIPE)
    assert (cut["confidence"], cut["search_bounded"], len(cut["anchors"])) == ("ambiguous", True, 3 * n)


def test_search_work_counts_answers_once():
    search = Search({"a": {"b"}, "b": {"a", "c"}, "c": {"b"}})
    assert search.distance("a", "c") == 2 and search.work == 3
    assert search.distance("a", "b") == 1 and search.work == 3
    assert search.distance("c", "c") == 0 and search.work == 3
    assert search.nearest([["a"], ["c"]]) == (2, ("a", "c")) and search.work == 4


KINDS = sorted({k for p in PATTERNS for k in (*p.kinds, p.optional) if k})


def repository(rng, name):
    files = [f"f{i:02}" for i in range(rng.randint(1, 14))]
    kinds = rng.sample(KINDS, rng.randint(1, len(KINDS)))
    provider = lambda k: rng.choice([p.provider for p in PATTERNS if p.provider][:3]) if k == "webhook-verification" else None
    library = lambda k: rng.choice([None, "A", "B"]) if k in ("credential-verification", "session-issuance", "route-guard", "token-verification", "guard-response") else None
    anchors = [anchor(k := rng.choice(kinds), rng.choice(files), rng.choice(["f", "g", None]) if rng.random() < 0.3 else f"h{i}", i, provider(k), library(k)) for i in range(rng.randint(0, 40))]
    anchors.sort(key=lambda a: (a["path"], a["line"], a["kind"]))
    edges = {(rng.choice(files), rng.choice(files)) for _ in range(rng.randint(0, 20))}
    packages = set(rng.sample([p for x in PATTERNS for p in x.packages], rng.randint(0, 3)))
    return name, anchors, edges, packages, set(rng.sample(files, rng.randint(0, len(files))))


@pytest.mark.parametrize("budget", [2_000_000, 0, 1, 7, 20, 55, 130, 400])
def test_findings_by_joins_equal_one_repository_at_a_time(spark, budget):
    rng = random.Random(budget)
    repos = [repository(rng, f"r{i}") for i in range(150)]
    wanted = {}
    for name, anchors, edges, packages, touched in repos:
        joined = {}
        for a, b in edges:
            joined.setdefault(a, set()).add(b)
            joined.setdefault(b, set()).add(a)
        for f in classify(anchors, joined, packages, touched, budget):
            slug = f.pop("slug")
            wanted[name, slug] = f | {"anchors": sorted(tuple(str(v) for v in a.values()) for a in f["anchors"])}
    found = findings(
        spark.createDataFrame([(n, *(a[k] for k in ("kind", "path", "fn", "line", "reason", "provider", "library"))) for n, anchors, *_ in repos for a in anchors], "repo_id string, kind string, path string, fn string, line int, reason string, provider string, library string"),
        spark.createDataFrame([(n, a, b) for n, _, edges, *_ in repos for a, b in edges] + [("r0", "f00", None)], "repo_id string, path string, target string"),
        spark.createDataFrame([(n, p) for n, _, _, packages, _ in repos for p in packages], "repo_id string, specifier string"),
        spark.createDataFrame([(n, p) for n, *_, touched in repos for p in touched], "repo_id string, path string"),
        budget,
    )
    got = {}
    for r in found.collect():
        x = r.asDict(True)
        key = x.pop("repo_id"), x.pop("slug")
        assert key not in got and [(a["path"], a["line"], a["kind"]) for a in x["anchors"]] == sorted((a["path"], a["line"], a["kind"]) for a in x["anchors"])
        got[key] = x | {"anchors": sorted(tuple(str(v) for v in a.values()) for a in x["anchors"])}
    assert {k: (got.get(k), wanted.get(k)) for k in got.keys() | wanted.keys() if got.get(k) != wanted.get(k)} == {}


def test_nothing_is_searched_where_the_first_files_cost_too_much(spark, monkeypatch):
    """Of two repositories the large one's budget is spent by its handlers and their neighbours alone (finding F6)."""
    asked = []
    whole = infer.distances
    monkeypatch.setattr(infer, "distances", lambda edges, starts, *more: (asked.extend(r["repo_id"] for r in starts.collect()), whole(edges, starts, *more))[1])
    rows, edges, wanted = [], [], {}
    for name, n in (("large", 30), ("small", 3)):
        anchors = [hook(f"w{i:03}") for i in range(n)] + [anchor("db-write", f"d{i:03}") for i in range(n)] + [anchor("idempotency-guard", f"i{i:03}") for i in range(n)]
        rows += [(name, *(a[k] for k in ("kind", "path", "fn", "line", "reason", "provider", "library"))) for a in anchors]
        edges += [(name, "hub", x) for x in sorted(star(n)["hub"])]
        found = of(classify(anchors, star(n), set(), {"w000"}, 59), STRIPE)
        wanted[name] = found["confidence"], found["search_bounded"], len(found["anchors"])
    made = infer.findings(
        spark.createDataFrame(rows, "repo_id string, kind string, path string, fn string, line int, reason string, provider string, library string"), spark.createDataFrame(edges, "repo_id string, path string, target string"),
        spark.createDataFrame([], "repo_id string, specifier string"), spark.createDataFrame([(name, "w000") for name in wanted], "repo_id string, path string"), 59,
    )
    assert {r["repo_id"]: (r["confidence"], r["search_bounded"], len(r["anchors"])) for r in made.collect() if r["slug"] == STRIPE} == wanted
    assert set(asked) == {"small"}


def test_work_that_cannot_reach_the_budget_is_not_counted(spark, monkeypatch):
    """Small repositories under a large budget need fewer written tables than under one that might run out, and end alike (finding F7)."""
    tables = []
    whole = infer.checkpointed
    monkeypatch.setattr(infer, "checkpointed", lambda df: (tables.append(1), whole(df))[1])
    anchors = [hook("w000"), anchor("db-write", "d000"), anchor("idempotency-guard", "i000")]
    rows = spark.createDataFrame([("r", *(a[k] for k in ("kind", "path", "fn", "line", "reason", "provider", "library"))) for a in anchors], "repo_id string, kind string, path string, fn string, line int, reason string, provider string, library string")
    edges = spark.createDataFrame([("r", "hub", x) for x in sorted(star(1)["hub"])], "repo_id string, path string, target string")
    made = []
    # The search costs 9 units at most: two questions of four files and a third file; the bound says 15.
    for budget in (2_000_000, 15, 14, 9):
        tables.clear()
        found = infer.findings(rows, edges, spark.createDataFrame([], "repo_id string, specifier string"), spark.createDataFrame([("r", "w000")], "repo_id string, path string"), budget)
        wanted = of(classify(anchors, star(1), set(), {"w000"}, budget), STRIPE)
        assert [(r["connection"], r["edge_distance"], r["search_bounded"]) for r in found.collect()] == [(wanted["connection"], wanted["edge_distance"], wanted["search_bounded"])]
        made.append(len(tables))
    assert made[0] == made[1] < made[2] == made[3]


CALLS = "repo_id string, path string, pos int, chain array<string>, line int, fn string, string_args array<string>, arg_props array<string>, number_args array<double>"
IMPORTS = "repo_id string, path string, specifier string, bindings array<struct<local: string, imported: string, kind: string>>, pos int"


def kinds(spark, calls, imports, bindings=(), accesses=(), literals=()):
    found = find_anchors(
        spark.createDataFrame([("r", "f.ts", i, chain, i, "fn", s, p, n) for i, (chain, s, p, n) in enumerate(calls)], CALLS),
        spark.createDataFrame([("r", "f.ts", spec, [b], i) for i, (spec, b) in enumerate(imports)], IMPORTS),
        spark.createDataFrame([("r", "f.ts", *b) for b in bindings], "repo_id string, path string, name string, kind string, chain array<string>, pos int"),
        spark.createDataFrame([("r", "f.ts", c, 1, "fn") for c in accesses], "repo_id string, path string, chain array<string>, line int, fn string"),
        spark.createDataFrame([("r", "f.ts", v, i, "fn", i) for i, v in enumerate(literals)], "repo_id string, path string, value string, line int, fn string, pos int"),
    )
    return sorted((r["kind"], r["line"]) for r in found.collect())


def call(*chain, strings=(), props=(), numbers=()):
    return list(chain), list(strings), list(props), [float(n) for n in numbers]


def test_database_writes(spark):
    pool = [("pool", "new", ["Pool"], 0)]
    pg = [("pg", ("Pool", "Pool", "named"))]
    assert kinds(spark, [call("pool", "query", strings=["INSERT INTO t VALUES (1) ON CONFLICT DO NOTHING"])], pg, pool) == [("db-write", 0), ("idempotency-guard", 0)]
    assert kinds(spark, [call("pool", "query", strings=["SELECT 1"])], pg, pool) == []
    knex = [("knex", ("knex", "knex", "default"))]
    assert kinds(spark, [call("*", "insert")], knex) == [("db-write", 0)]
    drizzle = [("drizzle-orm", ("db", "db", "named"))]
    assert kinds(spark, [call("db", "insert", "values", "onConflictDoUpdate")], drizzle) == [("db-write", 0), ("idempotency-guard", 0)]


def test_read_before_write_only_in_that_order(spark):
    prisma = [("@prisma/client", ("db", "db", "named"))]
    read, write = call("db", "order", "findUnique"), call("db", "order", "create")
    assert kinds(spark, [read, write], prisma) == [("db-write", 1), ("idempotency-guard", 1)]
    assert kinds(spark, [write, read], prisma) == [("db-write", 0)]


def test_two_hops_do_not_resolve(spark):
    stripe = [("stripe", ("Stripe", "default", "default"))]
    bound = [("client", "new", ["Stripe"], 0), ("hooks", "alias", ["client", "webhooks"], 1)]
    assert kinds(spark, [call("client", "webhooks", "constructEvent")], stripe, bound) == [("webhook-verification", 0)]
    assert kinds(spark, [call("hooks", "constructEvent")], stripe, bound) == []


def test_literals_and_manual_check(spark):
    assert kinds(spark, [], [("stripe", ("s", "s", "default"))], literals=["stripe-signature"]) == [("webhook-verification", 0)]
    assert kinds(spark, [], [], literals=["stripe-signature"]) == []
    assert kinds(spark, [call("crypto", "createHmac"), call("crypto", "timingSafeEqual")], [], literals=["x-signature"]) == [("webhook-verification", 0)]


def test_auth_guards_and_refresh(spark):
    jwt = [("jsonwebtoken", ("sign", "sign", "named")), ("jsonwebtoken", ("check", "verify", "named"))]
    found = kinds(spark, [call("check"), call("sign"), call("store", "revoke"), call("res", "status", numbers=[401]), call("res", "status", numbers=[200])], jwt, literals=["refresh_token"])
    assert found == sorted([("credential-verification", 0), ("token-verification", 0), ("session-issuance", 1), ("refresh-rotation", 1), ("refresh-invalidation", 2), ("route-guard", 3), ("guard-response", 3)])


def test_purchases(spark):
    iap = [("react-native-purchases", ("Purchases", "default", "default"))]
    found = kinds(spark, [call("Purchases", "configure"), call("Purchases", "purchasePackage"), call("info", "entitlements", "active")], iap, accesses=[["info", "entitlements"]])
    assert found == sorted([("iap-configure", 0), ("iap-purchase", 1), ("iap-entitlement-gate", 1), ("iap-entitlement-gate", 2)])
