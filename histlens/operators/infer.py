"""Structural findings: anchors that belong together.

Patterns of a repository share one budget of search work that is spent in a
fixed order.  The work of each pattern is counted by joins and added up in that
order, so it is known where the budget runs out without searching one after the
other, and a repository of any size is many tasks' work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import checkpointed
from .anchors import IAP_PACKAGES, LIBRARIES, PROVIDERS
from .graph import Edges, distances, undirected

MAX_HOPS = 3
WORK_BUDGET = 2_000_000


@dataclass(frozen=True)
class Pattern:
    slug: str
    packages: tuple[str, ...]
    kinds: tuple[str, str, str]
    provider: str | None = None
    scoped: bool = False  # anchors of one library only
    optional: str | None = None  # without this kind, confidence is at most `inferred`


_AUTH_PACKAGES = tuple(dict.fromkeys(p for _, packages, _ in LIBRARIES for p in packages))

# The patterns, in order.
PATTERNS = (
    *[Pattern(slug, packages, ("webhook-verification", "db-write", "idempotency-guard"), slug, optional="idempotency-guard" if slug == "payments/mercadopago-flow" else None) for slug, packages, *_ in PROVIDERS],
    Pattern("payments/iap-subscription-flow", IAP_PACKAGES, ("iap-configure", "iap-purchase", "iap-entitlement-gate")),
    Pattern("auth/session-flow", _AUTH_PACKAGES, ("credential-verification", "session-issuance", "route-guard"), scoped=True),
    Pattern("auth/oauth-flow", _AUTH_PACKAGES, ("authorize-redirect", "code-exchange", "session-issuance"), scoped=True),
    Pattern("auth/jwt-refresh-flow", _AUTH_PACKAGES, ("token-verification", "refresh-rotation", "guard-response"), scoped=True, optional="refresh-invalidation"),
)

FINDINGS = """repo_id string, slug string, confidence string, attributed boolean, claimed boolean,
anchors array<struct<kind: string, path: string, fn: string, line: int, reason: string>>, connection string, edge_distance int, search_bounded boolean"""


#: The pseudo side of a kind that is optional and none of a pattern's three.
BESIDE = 3
_ANCHOR = ("path", "line", "kind", "fn", "reason")


def _pattern_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """kinds(kind, ord, side, need) and patterns(ord, slug, scoped, optional_side): fixed lists."""
    kinds, patterns = [], []
    for i, p in enumerate(PATTERNS):
        kinds += [(kind, i, side, p.provider if kind == "webhook-verification" else None) for side, kind in enumerate(p.kinds)]
        beside = None if p.optional is None else p.kinds.index(p.optional) if p.optional in p.kinds else BESIDE
        if beside == BESIDE:
            kinds.append((p.optional, i, BESIDE, None))
        patterns.append((i, p.slug, p.scoped, beside))
    return F.broadcast(spark.createDataFrame(kinds, "of_kind string, ord int, side int, need string")), F.broadcast(spark.createDataFrame(patterns, "ord int, slug string, scoped boolean, optional_side int"))


_OF = ["repo_id", "ord"]


def _members(anchors: DataFrame, kinds: DataFrame, patterns: DataFrame) -> DataFrame:
    """repo_id, ord, side, a (an anchor, in order) of each pattern that an anchor may be part of; scoped patterns keep one library."""
    rows = anchors.join(kinds, (F.col("kind") == F.col("of_kind")) & (F.col("need").isNull() | (F.col("provider") == F.col("need")))).join(patterns, "ord")
    rows = checkpointed(rows.select("repo_id", "ord", "side", "scoped", "library", F.struct(*_ANCHOR).alias("a")))
    own = rows.where((F.col("side") < BESIDE) & F.col("scoped"))
    # The library that most sides have, anchors of none counting for each; the first that appears wins ties.
    neutral = own.where("library IS NULL").groupBy(*_OF).agg(F.collect_set("side").alias("neutral"))
    named = own.where("library IS NOT NULL").groupBy(*_OF, "library").agg(F.collect_set("side").alias("sides"), F.min(F.struct("side", "a")).alias("first"))
    score = F.size(F.array_union("sides", F.coalesce("neutral", F.array().cast("array<int>"))))
    best = named.join(neutral, _OF, "left").groupBy(*_OF).agg(F.min(F.struct((-score).alias("score"), "first", "library"))["library"].alias("best"))
    kept = (F.col("side") == BESIDE) | F.col("library").isNull() | F.col("best").isNull() | (F.col("library") == F.col("best"))
    return rows.join(best, _OF, "left").where(kept).select(*_OF, "side", "a")


def _sides(rows: DataFrame, by: list[str]) -> DataFrame:
    """f0, f1, f2: the first anchor of each side."""
    return rows.groupBy(*_OF, *by).agg(*[F.min(f"f{i}").alias(f"f{i}") for i in range(3)])


def _together(rows: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """The first scope, by its first anchor, that all sides have."""
    both = rows.join(state, _OF).where("f0 IS NOT NULL AND f1 IS NOT NULL AND (f2 IS NOT NULL OR NOT three)")
    return both.groupBy(*_OF).agg(F.min(F.struct(F.lit(turn).alias("turn"), "f0", "f1", F.when(F.col("three"), F.col("f2")).alias("f2"))).alias("hit"))


def _searched(files: DataFrame, asked: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """repo_id, ord, exhausted, near(reach, p0, p1, p2) of each pattern in asked(repo_id, ord, three), under one budget a repository.

    Units are those of a search that takes patterns in order, and in each the
    files of its sides in order: a pair of files, or the third file of a pair
    within MAX_HOPS, is one; the first question about a file costs as many as it
    has files within MAX_HOPS.  They are counted by joins and added up over the
    patterns of a repository, so nothing is searched one after the other; what a
    pattern costs tells whether the budget ran out in it, and only the others are
    looked for.  The very last file asked about is paid after the last check.
    """
    rows = files.join(asked, _OF)
    has = lambda i: F.col(f"f{i}").isNotNull()
    third = has(2) & F.col("three")
    sizes = rows.groupBy(*_OF, "three").agg(
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate((has(0), has(1), third))], F.max(F.when(has(0), F.col("path"))).alias("last0"),
        F.max(F.when(has(1), F.struct("path", third.alias("third")))).alias("last1"), F.max(F.when(third, F.col("path"))).alias("last2"),
    )
    in_turn = Window.partitionBy("repo_id").orderBy("ord")
    least = F.sum(F.when(F.col("three"), 0).otherwise(F.col("n0") * F.col("n1"))).over(in_turn)
    # Patterns after pairs that alone are too many need no distances.
    sizes = checkpointed(sizes.withColumn("least", least).withColumn("open", F.col("least") <= budget))
    graph = Edges(undirected(edges.join(sizes.where("open").select("repo_id").distinct(), "repo_id", "left_semi"), keys=("repo_id",)), ("repo_id",))
    # Where no repository's work can reach the budget, none is counted: a question costs at most the ends of all edges and itself.
    ways = graph.degrees().groupBy("repo_id").agg(F.sum("degree").alias("ways"))
    n0, n1, n2 = (F.col(f"n{i}").cast("double") for i in range(3))
    most = F.when(F.col("three"), n0 * n1 * n2).otherwise(n0 * n1) + (n0 + n1) * (1 + F.coalesce("ways", F.lit(0)))
    largest = sizes.join(ways, "repo_id", "left").groupBy("repo_id").agg(F.sum(most).alias("most")).agg(F.max("most")).first()[0]
    counted = largest is not None and largest > budget
    if counted:
        # Nor do those after first files that, with their neighbours alone, cost too much; the file that may be paid late counts as nothing.
        firsts = rows.where(has(0)).join(sizes.where("open").select(*_OF, "n1", "n2", "last1"), _OF).where((F.col("n1") > has(1).cast("int")) | (F.col("three") & (F.col("n2") > third.cast("int"))))
        firsts = firsts.join(sizes.select("repo_id", F.col("last1.path").alias("path")).distinct(), ["repo_id", "path"], "left_anti").groupBy("repo_id", "path").agg(F.min("ord").alias("ord"))
        around = graph.degrees().select("repo_id", F.col("src").alias("path"), F.col("degree").alias("around"))
        asking = firsts.join(around, ["repo_id", "path"], "left").groupBy(*_OF).agg(F.sum(F.coalesce("around", F.lit(0)) + 1).alias("asking"))
        asked_yet = F.sum(F.coalesce("asking", F.lit(0))).over(in_turn)
        sizes = checkpointed(sizes.join(asking, _OF, "left").withColumn("open", F.col("least") + asked_yet <= budget).drop("asking", "least"))
    rows = checkpointed(rows.join(sizes.where("open").drop("three", "open"), _OF).select(*_OF, "path", "three", has(0).alias("s0"), has(1).alias("s1"), third.alias("s2"), "n0", "n1", "n2"))
    starts = rows.where("s0 OR (s1 AND three)").select("repo_id", F.col("path").alias("start")).distinct()
    near = checkpointed(distances(graph, starts, MAX_HOPS, ("repo_id",)))

    def reaching(left: DataFrame, side: str, name: str, d: str, to: str) -> DataFrame:
        """left with the files of a side within MAX_HOPS of its column `name`."""
        step = left.join(near.select("repo_id", F.col("start").alias(name), F.col("node").alias(to), F.col("dist").alias(d)), ["repo_id", name])
        return step.join(rows.where(side).select(*_OF, F.col("path").alias(to)), [*_OF, to], "left_semi")

    pairs = checkpointed(reaching(rows.where("s0").select(*_OF, "three", F.col("path").alias("p0")), "s1", "p0", "d01", "p1"))

    def afforded() -> DataFrame:
        """repo_id, ord of the patterns before whose end the budget doesn't run out."""
        # Which files are asked about, and in which pattern first.
        flag = lambda c: F.col(c).cast("int")
        first = rows.where("s0").where((F.col("n1") > flag("s1")) | (F.col("three") & (F.col("n2") > flag("s2")))).select(*_OF, "path")
        second = rows.where("s1 AND three").where(F.col("n2") > flag("s2")).select(*_OF, "path").join(pairs.select(*_OF, F.col("p1").alias("path")), [*_OF, "path"], "left_semi")
        reach = near.groupBy("repo_id", F.col("start").alias("path")).agg(F.count(F.lit(1)).alias("found"))
        about = checkpointed(first.unionByName(second).groupBy("repo_id", "path").agg(F.min("ord").alias("ord")).join(reach, ["repo_id", "path"]))
        costs = about.groupBy(*_OF).agg(F.sum("found").alias("cost"))
        ends = sizes.where("open").select(*_OF, "n0", "n1", "n2", "last0", "last1", "last2")
        met = pairs.join(ends, _OF).groupBy(*_OF).agg(F.count(F.lit(1)).alias("met"), F.count_if(F.col("p1") == F.col("last1.path")).alias("met_last"), F.max((F.col("p1") == F.col("last1.path")) & (F.col("p0") == F.col("last0"))).alias("last_met"))
        paid = about.select("repo_id", F.col("ord").alias("paid_in"), F.col("path").alias("paid_for"), "found")
        work = sizes.where("open").join(costs, _OF, "left").join(met, _OF, "left").alias("w").join(paid.alias("p"), F.expr("w.repo_id = p.repo_id AND w.ord = paid_in AND w.last1.path = paid_for"), "left").select("w.*", "found")
        units = F.when(F.col("three"), F.coalesce("met", F.lit(0)) * F.col("n2")).otherwise(F.col("n0") * F.col("n1")) + F.coalesce("cost", F.lit(0))
        last, only = F.col("last1.path"), F.col("last2")
        late = F.col("three") & F.coalesce("last_met", F.lit(False)) & (F.col("met_last") == 1) & (only != last) & (F.col("n2") == 1 + F.col("last1.third").cast("int")) & ((last != F.col("last0")) | (F.col("n1") == 1))
        work = work.withColumn("units", units).withColumn("unpaid", F.when(late, F.coalesce("found", F.lit(0))).otherwise(0)).withColumn("spent", F.sum("units").over(in_turn))
        return work.where(F.col("spent") - F.col("unpaid") <= budget).select(*_OF)

    done = afforded() if counted else sizes.select(*_OF)
    two = pairs.join(done, _OF, "left_semi")
    three = reaching(reaching(two.where("three"), "s2", "p0", "d02", "p2"), "s2", "p1", "d12", "q2").where("p2 = q2")
    options = two.where("NOT three").select(*_OF, F.struct(F.col("d01").alias("reach"), "p0", "p1", F.lit(None).cast("string").alias("p2")).alias("x"))
    options = options.unionByName(three.select(*_OF, F.struct(F.greatest("d01", "d02", "d12").alias("reach"), "p0", "p1", "p2").alias("x")))
    best = options.groupBy(*_OF).agg(F.min("x").alias("near"))
    return asked.select(*_OF).join(done.withColumn("done", F.lit(True)), _OF, "left").join(best, _OF, "left").select(*_OF, F.col("done").isNull().alias("exhausted"), "near")


def findings(anchors: DataFrame, edges: DataFrame, external: DataFrame, touched: DataFrame, budget: int = WORK_BUDGET) -> DataFrame:
    """FINDINGS of anchors(ANCHORS), edges(repo_id, path, target), external(repo_id, specifier), touched(repo_id, path).

    All repositories at once, by joins on repository and pattern; none is one task's.
    """
    spark = anchors.sparkSession
    kinds, patterns = _pattern_rows(spark)
    members = checkpointed(_members(anchors.select("repo_id", *_ANCHOR, "provider", "library"), kinds, patterns))
    own = members.where(F.col("side") < BESIDE)
    split = own.select(*_OF, F.col("a.path").alias("path"), F.col("a.fn").alias("fn"), *[F.when(F.col("side") == i, F.col("a")).alias(f"f{i}") for i in range(3)])
    functions = checkpointed(_sides(split, ["path", "fn"]))
    files = checkpointed(_sides(functions, ["path"]))

    present = members.groupBy(*_OF).agg(F.collect_set("side").alias("present")).join(patterns, "ord")
    holds = lambda side: F.array_contains("present", side)
    state = present.select(*_OF, "present", (F.col("optional_side").isNotNull() & ~F.coalesce(holds(F.col("optional_side")), F.lit(False))).alias("lacking"), "optional_side")
    # Without an optional member of the three (it is the third), the other two are searched.
    state = state.withColumn("three", ~(F.col("lacking") & (F.col("optional_side") == 2)) | F.col("optional_side").isNull())
    state = checkpointed(state.withColumn("complete", holds(0) & holds(1) & (holds(2) | ~F.col("three"))).select(*_OF, holds(0).alias("begun"), "lacking", "three", "complete"))
    whole = state.where("complete").select(*_OF, "three")
    hits = checkpointed(_together(functions, whole, 0).unionByName(_together(files, whole, 1)).groupBy(*_OF).agg(F.min("hit").alias("hit")))
    asked = checkpointed(whole.join(hits, _OF, "left_anti"))
    searched = checkpointed(_searched(files, asked, edges.where("target IS NOT NULL").select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")), budget))
    # The first anchors of the files that are near each other.
    spots = searched.where("near IS NOT NULL").select(*_OF, F.posexplode(F.array("near.p0", "near.p1", "near.p2")).alias("side", "path")).where("path IS NOT NULL")
    spots = spots.join(files, [*_OF, "path"]).groupBy(*_OF).agg(F.collect_list(F.element_at(F.array("f0", "f1", "f2"), F.col("side") + 1)).alias("spots"))

    packages = spark.createDataFrame([(p, i) for i, pattern in enumerate(PATTERNS) for p in pattern.packages], "specifier string, ord int")
    imported = external.join(F.broadcast(packages), "specifier").select(*_OF)  # a fixed list
    about = state.where("begun").select(*_OF).unionByName(imported).distinct().join(state, _OF, "left").join(hits, _OF, "left").join(searched, _OF, "left").join(spots, _OF, "left")
    near = F.col("near").isNotNull()
    outcome = checkpointed(
        about.select(
            *_OF,
            F.when(F.col("hit").isNotNull() & ~F.col("lacking"), "direct").when(F.col("hit").isNotNull() | near, "inferred").otherwise("ambiguous").alias("confidence"),
            F.when(F.col("hit.turn") == 0, "same-function").when(F.col("hit.turn") == 1, "same-file").when(near, "cross-file").alias("connection"),
            F.when(F.col("hit").isNotNull(), 0).otherwise(F.col("near.reach")).alias("edge_distance"),
            F.when(F.col("exhausted"), True).alias("search_bounded"),
            F.when(F.col("hit").isNotNull(), F.array_compact(F.array("hit.f0", "hit.f1", "hit.f2"))).otherwise(F.col("spots")).alias("chosen"),
        )
    )
    chosen = outcome.where("chosen IS NOT NULL").select(*_OF, F.explode("chosen").alias("a")).unionByName(outcome.where("chosen IS NULL").select(*_OF).join(own, _OF).select(*_OF, "a"))
    mine = touched.select(F.col("repo_id").alias("touched_repo"), F.col("path").alias("touched_path")).distinct()
    told = chosen.join(mine, (F.col("repo_id") == F.col("touched_repo")) & (F.col("a.path") == F.col("touched_path")), "left")
    told = told.groupBy(*_OF).agg(F.sort_array(F.collect_list("a")).alias("told"), F.max(F.col("touched_path").isNotNull()).alias("attributed"))
    rows = outcome.drop("chosen").join(told, _OF, "left").join(patterns.select("ord", "slug"), "ord")
    attributed = F.coalesce("attributed", F.lit(False))
    listed = F.transform(F.coalesce("told", F.array().cast(rows.schema["told"].dataType)), lambda x: F.struct(x["kind"].alias("kind"), x["path"].alias("path"), x["fn"].alias("fn"), x["line"].alias("line"), x["reason"].alias("reason")))
    return rows.select("repo_id", "slug", "confidence", attributed.alias("attributed"), (attributed & (F.col("confidence") != "ambiguous")).alias("claimed"), listed.alias("anchors"), "connection", "edge_distance", "search_bounded")


def touch_log(commits: DataFrame, added_lines: DataFrame) -> DataFrame:
    """Which commit touched which file when: non-merge commits, files with added text."""
    own = commits.where(~F.col("is_merge")).select("repo_id", "sha", "author_ts")
    return added_lines.where(F.length("added_text") > 0).select("repo_id", "sha", "path").join(own, ["repo_id", "sha"])


def structural_skills(found: DataFrame, touches: DataFrame) -> DataFrame:
    """Claimed findings as skills: commits that touched their files, first and last time."""
    files = found.where("claimed").select("repo_id", "slug", "confidence", F.explode("anchors").alias("a")).select("repo_id", "slug", "confidence", "a.path").distinct()
    joined = files.join(touches, ["repo_id", "path"])
    return joined.groupBy("repo_id", "slug", "confidence").agg(F.count_distinct("sha").alias("commit_count"), F.min("author_ts").alias("first_seen"), F.max("author_ts").alias("last_seen")).withColumn("evidence", F.lit("structural"))


def explained(found: DataFrame, slug: str) -> DataFrame:
    """One finding a row for each anchor, with how it was classified."""
    return found.where(F.col("slug") == slug).select("repo_id", "slug", "confidence", "attributed", "connection", "edge_distance", F.explode_outer("anchors").alias("a")).select("repo_id", "slug", "confidence", "attributed", "connection", "edge_distance", "a.*")
