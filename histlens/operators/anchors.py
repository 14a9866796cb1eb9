"""Anchors: calls, literals and accesses that mean something.

The provider and library tables are fixed and small, so a rule is an expression
over a call; each call is read once and explodes to its anchors.  What depends
on the rest of a file (its packages, its literals) comes from one aggregate a
file; what depends on earlier calls of a function from one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_relative
from ..shared import checkpointed
from .graph import receivers

# Packages, and the names in call chains that count.
PRISMA = ("@prisma/client", "prisma")
SUPABASE, PG, KNEX, DRIZZLE = "@supabase/supabase-js", "pg", "knex", "drizzle-orm"
DATABASES = (*PRISMA, SUPABASE, PG, KNEX, DRIZZLE)
PRISMA_WRITES = ("create", "createMany", "update", "updateMany", "upsert")
SUPABASE_WRITES = ("insert", "upsert", "update")
KNEX_WRITES = ("insert", "update")
DRIZZLE_WRITES = ("insert", "update", "onConflictDoUpdate")
READS = ("findUnique", "findFirst", "findOne", "select", "get")
SQL_WRITE, SQL_UPSERT = r"(?i)^\s*(insert|update)\b", r"(?i)on\s+conflict"
IAP_PACKAGES = ("react-native-purchases", "@revenuecat/purchases-js")
IAP_PURCHASES = ("purchasePackage", "purchaseProduct", "purchaseStoreProduct")
REFRESH_MARKS = ("refresh_token", "refreshToken", "refresh")
REVOCATIONS = ("revoke", "revokeToken", "revokeRefreshToken", "invalidate", "blacklist", "signOut", "delete", "deleteMany")

# Webhook providers: packages, verifying and creating chain ends, header literals, literal of a manual check.
PROVIDERS = (
    ("payments/payment-webhook-flow", ("stripe",), (("webhooks", "constructEvent"), ("webhooks", "constructEventAsync")), (), ("stripe-signature",), None),
    ("payments/paypal-webhook-flow", ("@paypal/checkout-server-sdk", "@paypal/paypal-server-sdk"), (("verifyWebhookSignature",), ("webhooksController", "verifyWebhookSignature")), (), ("paypal-transmission-sig", "paypal-auth-algo"), None),
    ("payments/mercadopago-flow", ("mercadopago",), (), (("create",),), ("x-signature",), None),
    ("payments/lemonsqueezy-webhook-flow", ("@lemonsqueezy/lemonsqueezy.js",), (), (), ("x-signature",), "x-signature"),
    ("payments/paddle-webhook-flow", ("@paddle/paddle-node-sdk",), (("unmarshal",), ("webhooks", "unmarshal")), (), ("paddle-signature",), None),
)

# Authentication libraries: packages, and chain ends of each kind.
LIBRARIES = (
    ("NextAuth/Auth.js", ("next-auth", "next-auth/react", "next-auth/next", "next-auth/jwt", "@auth/core"), {
        "credential-verification": (("getServerSession",), ("getToken",)), "session-issuance": (("signIn",),), "authorize-redirect": (("signIn",),)}),
    ("Supabase Auth", (SUPABASE,), {
        "credential-verification": (("auth", "getUser"), ("auth", "getSession")),
        "session-issuance": (("auth", "signInWithPassword"), ("auth", "signInWithOtp"), ("auth", "verifyOtp"), ("auth", "setSession")),
        "authorize-redirect": (("auth", "signInWithOAuth"),), "code-exchange": (("auth", "exchangeCodeForSession"),), "token-verification": (("auth", "getUser"),)}),
    ("plain JWT (jsonwebtoken/jose)", ("jsonwebtoken", "jose"), {
        "credential-verification": (("verify",), ("jwtVerify",)), "token-verification": (("verify",), ("jwtVerify",)), "session-issuance": (("sign",),)}),
)


def _ends(chain: Column, suffix: tuple[str, ...]) -> Column:
    """Whether a chain ends so."""
    hit = F.size(chain) >= len(suffix)
    for k, name in enumerate(reversed(suffix), 1):
        hit = hit & (F.try_element_at(chain, F.lit(-k)) == name)
    return F.coalesce(hit, F.lit(False))


def _any(hits: list[Column]) -> Column:
    found = F.lit(False)
    for h in hits:
        found = found | F.coalesce(h, F.lit(False))
    return found


def _has(chain: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(chain, F.array(*map(F.lit, names))), F.lit(False))


def _anchor(condition: Column, kind: str, reason: Column | str, provider: str | None = None, library: str | None = None) -> Column:
    """A struct of an anchor where the condition holds, else null."""
    text = lambda x: (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")
    return F.when(condition, F.struct(F.lit(kind).alias("kind"), text(reason).alias("reason"), text(provider).alias("provider"), text(library).alias("library")))


def _webhook_anchors(specifier: Column, resolved: Column) -> list[Column]:
    out = []
    for slug, packages, verify, create, _, _ in PROVIDERS:
        mine = specifier.isin(*packages)
        verified = _any([_ends(resolved, s) for s in verify])
        out.append(_anchor(mine & verified, "webhook-verification", F.concat(F.lit("verifying call of "), specifier), slug))
        if create:
            out.append(_anchor(mine & ~verified & _any([_ends(resolved, s) for s in create]), "webhook-verification", F.concat(F.lit("creating call of "), specifier), slug))
    return out


def write_shape() -> tuple[Column, Column]:
    """Whether a call writes to a database, and whether as an upsert; over specifier, resolved, chain, string_args, packages."""
    spec, chain = F.col("specifier"), F.col("resolved")
    last = F.try_element_at(chain, F.lit(-1))
    args = F.coalesce("string_args", F.array().cast("array<string>"))
    writes_sql, upserts_sql = F.exists(args, lambda x: x.rlike(SQL_WRITE)), F.exists(args, lambda x: x.rlike(SQL_UPSERT))
    loose = F.try_element_at("chain", F.lit(1)) == "*"
    tail = F.slice("chain", 2, 1000)
    rules = [
        (spec.isin(*PRISMA) & last.isin(*PRISMA_WRITES), last == "upsert"),
        ((spec == PG) & (last == "query") & writes_sql, upserts_sql),
        ((spec == KNEX) & last.isin(*KNEX_WRITES), F.lit(False)),
        ((spec == DRIZZLE) & _has(chain, DRIZZLE_WRITES), F.array_contains(chain, "onConflictDoUpdate")),
        ((spec == SUPABASE) & _has(chain, SUPABASE_WRITES), F.array_contains(chain, "upsert")),
        (loose & _has(tail, SUPABASE_WRITES) & F.array_contains("packages", SUPABASE), F.array_contains(tail, "upsert")),
        (loose & F.try_element_at("chain", F.lit(-1)).isin(*KNEX_WRITES) & F.array_contains("packages", KNEX), F.lit(False)),
    ]
    shape = None
    for hit, upsert in rules:
        shape = F.when(hit, upsert) if shape is None else shape.when(hit, upsert)
    return shape.isNotNull(), F.coalesce(shape, F.lit(False))


def _auth_anchors(specifier: Column, chain: Column) -> list[Column]:
    out = []
    for name, packages, kinds in LIBRARIES:
        for kind, ends in kinds.items():
            out.append(_anchor(specifier.isin(*packages) & _any([_ends(chain, e) for e in ends]), kind, F.concat(F.lit(f"{name}: "), specifier), None, name))
    return out


def find_anchors(calls: DataFrame, imports: DataFrame, bindings: DataFrame, accesses: DataFrame, literals: DataFrame) -> DataFrame:
    """All anchors: repo_id, kind, path, fn, line, reason, provider, library; a row may come twice by two rules of the reference kinds.

    imports, bindings, calls and literals carry pos, their order in the file.
    """
    key = ["repo_id", "path"]
    packages = imports.where(~is_relative(F.col("specifier"))).groupBy(*key).agg(F.collect_set("specifier").alias("packages"))
    marks = literals.groupBy(*key).agg(F.max(F.col("value").isin(*REFRESH_MARKS)).alias("refresh_mark"))
    rows = receivers(calls, imports, bindings).join(packages, key, "left").join(marks, key, "left")
    rows = rows.withColumns({"packages": F.coalesce("packages", F.array().cast("array<string>")), "refresh_mark": F.coalesce("refresh_mark", F.lit(False))})
    spec, resolved, chain = F.col("specifier"), F.col("resolved"), F.col("chain")
    last, resolved_last = F.try_element_at(chain, F.lit(-1)), F.try_element_at(resolved, F.lit(-1))

    # Database calls, and what a function read before it wrote.
    writes, upserts = write_shape()
    reads = F.coalesce(spec.isin(*DATABASES) & resolved_last.isin(*READS), F.lit(False))
    rows = rows.withColumns({"writes": writes, "upserts": upserts, "reads": reads})
    so_far = Window.partitionBy("repo_id", "path", "fn").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("read_line", F.first(F.when(F.col("reads"), F.col("line")), ignorenulls=True).over(so_far))

    iap_import = F.arrays_overlap("packages", F.array(*map(F.lit, IAP_PACKAGES)))
    iap_own = F.coalesce(spec.isin(*IAP_PACKAGES), F.lit(False))
    auth_chain = F.when(F.size(resolved) > 0, resolved).otherwise(F.array("exported_root"))
    denied = last.isin("status", "sendStatus") & F.exists(F.coalesce("number_args", F.array().cast("array<double>")), lambda x: x.isin(401, 403))
    guard = F.coalesce(denied | (last == "redirect"), F.lit(False))
    found = [
        *_webhook_anchors(spec, resolved),
        _anchor(F.col("writes"), "db-write", F.concat(F.lit("write by "), F.coalesce(spec, F.lit("an unresolved receiver")))),
        _anchor(F.col("writes") & F.col("upserts"), "idempotency-guard", "upsert-shaped write"),
        _anchor(F.col("writes") & F.col("read_line").isNotNull(), "idempotency-guard", F.concat(F.lit("read before write, at line "), F.col("read_line").cast("string"))),
        _anchor(F.array_contains(F.coalesce("arg_props", F.array().cast("array<string>")), "idempotencyKey"), "idempotency-guard", "idempotencyKey argument"),
        _anchor((iap_own & (resolved_last == "configure")) | (~iap_own & iap_import & _ends(chain, ("Purchases", "configure"))), "iap-configure", "configure call"),
        _anchor((iap_own & resolved_last.isin(*IAP_PURCHASES)) | (~iap_own & iap_import & last.isin(*IAP_PURCHASES)), "iap-purchase", "purchase call"),
        _anchor(F.array_contains(chain, "entitlements"), "iap-entitlement-gate", "entitlements in a call"),
        *_auth_anchors(spec, auth_chain),
        _anchor(F.col("refresh_mark") & last.isin(*REVOCATIONS), "refresh-invalidation", "revoking call"),
        *[_anchor(guard, kind, "access decision") for kind in ("route-guard", "guard-response")],
    ]
    # Written: calls are resolved and judged once, and what follows reads the few rows found.
    by_call = checkpointed(rows.select("repo_id", "path", "fn", "line", "refresh_mark", F.explode(F.array_compact(F.array(*found))).alias("a")).select("repo_id", "a.kind", "path", "fn", "line", "a.reason", "a.provider", "a.library", "refresh_mark"))

    # Issuing a token where one is verified, in a file with a refresh mark.
    verified = by_call.where(F.col("kind") == "token-verification").select("repo_id", "path", "fn").distinct().alias("v")
    issued = by_call.where((F.col("kind") == "session-issuance") & F.col("refresh_mark")).alias("i")
    rotated = issued.join(verified, F.expr("i.repo_id = v.repo_id AND i.path = v.path AND i.fn <=> v.fn"), "left_semi").withColumns({"kind": F.lit("refresh-rotation"), "reason": F.lit("token issued where one is verified")})

    gated = accesses.where(F.array_contains("chain", "entitlements")).select("repo_id", F.lit("iap-entitlement-gate").alias("kind"), "path", "fn", "line", F.lit("entitlements in an access").alias("reason"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("library"))
    columns = gated.columns
    return by_call.select(columns).unionByName(rotated.select(columns)).unionByName(gated).unionByName(_literal_anchors(calls, literals, packages).select(columns))


def _literal_anchors(calls: DataFrame, literals: DataFrame, packages: DataFrame) -> DataFrame:
    """A provider's header literal in a file that imports it, or that checks a signature by hand; the first literal of each file and provider."""
    key = ["repo_id", "path"]
    last = F.try_element_at("chain", F.lit(-1))
    by_hand = calls.groupBy(*key).agg((F.max(last == "createHmac") & F.max(last == "timingSafeEqual")).alias("by_hand"))
    rows = literals.join(packages, key, "left").join(by_hand, key, "left")
    hits = []
    for slug, own, _, _, values, manual in PROVIDERS:
        imported = F.coalesce(F.arrays_overlap("packages", F.array(*map(F.lit, own))), F.lit(False))
        hits.append(F.when(imported & F.col("value").isin(*values), F.struct(F.lit(slug).alias("provider"), F.lit("header literal, package imported").alias("reason"))))
        if manual:
            hits.append(F.when(F.coalesce("by_hand", F.lit(False)) & (F.col("value") == manual), F.struct(F.lit(slug).alias("provider"), F.lit("header literal, checked by hand").alias("reason"))))
    found = rows.select(*key, "fn", "line", "pos", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*key, "fn", "line", "pos", "h.*")
    first = found.groupBy(*key, "provider", "reason").agg(F.min_by(F.struct("fn", "line"), "pos").alias("at"))
    return first.select("repo_id", F.lit("webhook-verification").alias("kind"), "path", "at.fn", "at.line", "reason", "provider", F.lit(None).cast("string").alias("library"))
