from histlens.operators import anchors, facts, graph, infer

HOOK = """
import Stripe from 'stripe';
import { save as store, type Row } from './store';
import * as fs from "fs";
import './side';
const stripe = new Stripe(process.env.KEY);
export async function handle(req: Request): Promise<void> {
  const event = stripe.webhooks.constructEvent(req.body, req.headers['stripe-signature'], "s");
  await store(event, { idempotencyKey: event.id, n: 3 });
  return res.status(401).json({ error: `x` });
}
export const list = (a) => a.items.map((x) => x.id);
class Box { open(key) { return this.lid.lift(key); } }
// import no from 'no'; call()
"""


def test_imports_and_bindings():
    found = facts.facts_of(HOOK)
    assert [(i["specifier"], [(b["local"], b["imported"], b["kind"]) for b in i["bindings"]]) for i in found.imports] == [
        ("stripe", [("Stripe", "default", "default")]), ("./store", [("store", "save", "named"), ("Row", "Row", "named")]), ("fs", [("fs", "*", "namespace")]), ("./side", [])]
    assert ("stripe", "new", ["Stripe"]) in [(b["name"], b["kind"], b["chain"]) for b in found.bindings]
    assert ("event", "call", ["stripe", "webhooks", "constructEvent"]) in [(b["name"], b["kind"], b["chain"]) for b in found.bindings]


def test_functions_and_calls():
    found = facts.facts_of(HOOK)
    names = {f["name"]: (f["start_line"], f["end_line"], f["exported"]) for f in found.functions}
    assert names["handle"] == (7, 11, True) and "list" in names and "Box.open" in names
    calls = {".".join(c["chain"]): c for c in found.calls}
    assert calls["stripe.webhooks.constructEvent"]["fn"] == "handle" and calls["stripe.webhooks.constructEvent"]["string_args"] == ["s"]
    assert calls["store"]["arg_props"] == ["idempotencyKey", "n"] and calls["res.status"]["number_args"] == [401.0]
    assert calls["*.json"]["fn"] == "handle" and calls["this.lid.lift"]["fn"] == "Box.open"
    assert "call" not in calls and "handle" not in calls
    assert {"stripe-signature", "s", "x"} <= {x["value"] for x in found.literals}


def test_unmatched_brackets_give_nothing():
    assert facts.facts_of("call('x'); function f( {") == facts.Facts()
    assert facts.facts_of("") == facts.Facts()


def test_from_source_to_finding(spark):
    source = "import Stripe from 'stripe';\nimport { PrismaClient } from '@prisma/client';\nconst s = new Stripe('k');\nconst db = new PrismaClient();\nexport function hook(r) {\n  s.webhooks.constructEvent(r);\n  db.order.upsert({ id: 1 });\n}\n"
    found = facts.extract(spark.createDataFrame([("r", "a.ts", source), ("r", "b.ts", "const x = (")], "repo_id string, path string, content string"))
    part = {n: facts.relation(found, n) for n in ("imports", "calls", "bindings", "accesses", "literals")}
    hits = anchors.find_anchors(part["calls"], part["imports"], part["bindings"], part["accesses"], part["literals"])
    files = found.select("repo_id", "path")
    got = infer.findings(hits, graph.resolve_imports(part["imports"], files), graph.external_imports(part["imports"]), files).collect()
    assert [(r["slug"], r["confidence"], r["connection"], r["claimed"]) for r in got] == [("payments/payment-webhook-flow", "direct", "same-function", True)]


def test_long_statements_lose_nothing():
    names = [f"name{i}" for i in range(250)]
    found = facts.facts_of("import {\n" + ",\n".join(f"{n} as {n}x" for n in names) + "\n} from './wide';\nconst a = 1; import('./no');")
    assert [(i["specifier"], len(i["bindings"])) for i in found.imports] == [("./wide", 250)]
    found = facts.facts_of("class A extends B implements C, D, E, F, G, H, I { run() { go(); } }")
    assert [f["name"] for f in found.functions] == ["A.run"] and [c["fn"] for c in found.calls] == ["A.run"]
    wide = " | ".join(f"Kind{i}" for i in range(40))
    assert [f["name"] for f in facts.facts_of(f"function pick(x): {wide} {{ return x; }}").functions] == ["pick"]


def test_owners_are_the_innermost_functions():
    source = "function a() { one(); function b() { two(); const c = () => three(); } four(); }\nfive();"
    assert {c["chain"][-1]: c["fn"] for c in facts.facts_of(source).calls if len(c["chain"]) == 1} == {"one": "a", "two": "b", "three": "c", "four": "a", "five": None}
