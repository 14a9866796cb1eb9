"""The profile of one author set in one history: relations in, one nested bundle row a repository out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, salted
from ..functions.paths import host_type, is_excluded
from ..functions.text import secret_family
from ..functions.times import days_between, iso
from ..operators import cadence, churn, forensics, imports, merkle, signatures, skills
from ..operators.ordered import numbered
from ..operators.sequence import manifest_additions
from ..shared import checkpointed


@dataclass(frozen=True)
class Attestation:
    """What the caller confirms; a profile is refused without it."""

    confirmed: bool
    confirmed_at: str


@dataclass(frozen=True)
class History:
    """Relations of schema.py; what is None is left out of the profile."""

    commits: DataFrame
    churn: DataFrame | None = None
    added_lines: DataFrame | None = None
    blobs: DataFrame | None = None
    repos: DataFrame | None = None


def require(commits: DataFrame, authors: DataFrame, attestation: Attestation, window: str | None = None) -> None:
    """Raises where a profile must not or can't be made."""
    if not attestation.confirmed:
        raise ValueError("the caller has not confirmed that it may profile these authors")
    if not authors.limit(1).count():
        raise ValueError("no author is selected")
    if not commits.limit(1).count():
        raise ValueError(f"there are no commits in {window}" if window else "there are no commits")
    if not commits.join(authors, "email", "left_semi").limit(1).count():
        raise ValueError("the selected authors have no commits")


def detected_skills(history: History, mine: DataFrame, package_map: DataFrame | None, rules: DataFrame | None) -> DataFrame:
    """repo_id, slug, commit_count, first_seen, last_seen of non-merge commits, from packages and signature patterns."""
    own = mine.where(~F.col("is_merge")).select("repo_id", "sha", "author_ts")
    generated = churn.generated_paths(history.churn.join(mine.select("repo_id", "sha"), ["repo_id", "sha"], "left_semi"), ["repo_id", "path"])
    files = history.added_lines.join(own, ["repo_id", "sha"]).where(~is_excluded(F.col("path")))
    files = churn.without(files, generated, ["repo_id", "path"])
    hits = None
    manifest_path = F.col("path").rlike(r"(?i)(package\.json|composer\.json|cargo\.toml)\z")
    if package_map is not None:
        packages = imports.file_packages(files.where(~manifest_path))
        if history.blobs is not None:
            parsed = imports.manifest("content", "path")
            packages = packages.unionByName(manifest_additions(files.where(manifest_path), history.commits, history.blobs, parsed["deps"], parsed["valid"]))
        hits = skills.package_slugs(packages, package_map).select("repo_id", "sha", "slug")
    if rules is not None:
        matched = signatures.matches(files, rules, ["repo_id", "sha"])
        hits = matched if hits is None else hits.unionByName(matched)
    return skills.rollup(hits.join(own, ["repo_id", "sha"]), ["repo_id", "slug"], "sha", "author_ts")


def profile(
    history: History, authors: DataFrame, salt: str, attestation: Attestation, *, created_at: str, tool_version: str = "0.1.0", runner: str = "local",
    package_map: DataFrame | None = None, rules: DataFrame | None = None, structural: DataFrame | None = None,
) -> DataFrame:
    """repo_id and bundle (the BUNDLE struct) for each repository in which authors(email) have commits.

    commits should be the window's; age and fingerprint come from repos(repo_id, remote_url, shallow, now_ts) and the
    root commit, which a window must not have cut off.
    """
    key = ["repo_id"]
    chosen = authors.select("email").distinct()
    # Read by several aggregates and joins below; written so that the history is read once.
    mine = checkpointed(history.commits.join(chosen, "email", "left_semi"))
    signed, ratio = cadence.signed_share(F.col("signed"))
    totals = history.commits.join(chosen.withColumn("__mine", F.lit(True)), "email", "left").groupBy("repo_id").agg(
        F.count_if(F.col("__mine")).alias("user_total"), F.count(F.lit(1)).alias("all_total"),
        F.count_distinct(F.when(F.col("__mine").isNull(), F.col("email"))).alias("others"),
        F.min_by("sha", F.when(F.col("parent_sha").isNull(), F.col("pos"))).alias("root_sha"), F.min_by("author_ts", F.when(F.col("parent_sha").isNull(), F.col("pos"))).alias("root_ts"),
    ).where("user_total > 0")
    scalars = mine.groupBy("repo_id").agg(
        F.min("author_ts").alias("first_ts"), F.max("author_ts").alias("last_ts"),
        cadence.hour_histogram("author_ts").alias("hours"), cadence.weekday_histogram("author_ts").alias("weekdays"),
        signed.alias("signed_count"), ratio.alias("signed_ratio"),
    )
    dates = forensics.date_forensics(mine, key)
    roots = merkle.merkle_root(numbered(mine.select("repo_id", "pos", "sha"), ["pos"], key, "at"), key, "at", "sha").drop("n")
    hashes = authors.select(salted(F.col("email"), salt).alias("h")).agg(F.array_sort(F.collect_list("h")).alias("author_hashes"))

    found = totals.join(scalars, key).join(dates, key).join(roots, key).crossJoin(F.broadcast(hashes))  # one row
    if history.repos is not None:
        found = found.join(history.repos, key, "left")
    else:
        found = found.withColumns({"remote_url": F.lit(None).cast("string"), "shallow": F.lit(False), "now_ts": F.lit(created_at).cast("timestamp")})
    for name, rows in _lists(history, mine, package_map, rules, structural).items():
        found = found.join(rows, key, "left")
    empty = {"languages": "array<struct<extension: string, share: double>>", "categories": "array<struct<name: string, commit_count: bigint, churn_share: double>>", "detected": "array<struct<slug: string, commit_count: bigint, first_seen: string, last_seen: string, evidence: string, confidence: string>>"}
    for name, kind in empty.items():
        found = found.withColumn(name, F.coalesce(F.col(name) if name in found.columns else F.lit(None).cast(kind), F.array().cast(kind)))

    text = lambda x: F.lit(x).cast("string")
    bundle = F.struct(
        text("1.4.0").alias("schema_version"), text(runner).alias("runner"), text(tool_version).alias("tool_version"), text(created_at).alias("created_at"),
        F.struct(host_type(F.col("remote_url")).alias("host_type"), days_between(F.col("root_ts"), F.col("now_ts")).alias("age_days"), salted(F.col("root_sha"), salt).alias("repo_fingerprint"), F.when(F.col("shallow"), True).alias("shallow")).alias("repo"),
        F.struct(F.col("author_hashes").alias("author_identity_hashes"), F.col("others").alias("other_contributors_count")).alias("identity"),
        F.struct("user_total", iso(F.col("first_ts")).alias("first_at"), iso(F.col("last_ts")).alias("last_at"), days_between(F.col("first_ts"), F.col("last_ts")).alias("span_days"), F.col("hours").alias("hour_histogram"), F.col("weekdays").alias("weekday_histogram")).alias("commits"),
        F.struct(F.col("signed_count").alias("count"), F.col("signed_ratio").alias("ratio")).alias("signed"),
        "languages", "categories", F.col("detected").alias("detected_skills"),
        F.struct((F.col("user_total").cast("double") / F.col("all_total")).alias("user_commit_ratio")).alias("ownership"),
        F.struct("merkle_root", text("rfc6962-sha256").alias("algorithm"), F.struct("author_span_days", "committer_span_days", "mismatch_ratio", "committer_burst_ratio").alias("date_forensics")).alias("integrity"),
        F.struct(F.lit(attestation.confirmed).alias("authorized_confirmation"), text(attestation.confirmed_at).alias("confirmed_at")).alias("attestation"),
    )
    return found.select("repo_id", bundle.alias("bundle"))


def _lists(history: History, mine: DataFrame, package_map: DataFrame | None, rules: DataFrame | None, structural: DataFrame | None) -> dict[str, DataFrame]:
    """Nested list columns by name, a row for each repository."""
    out: dict[str, DataFrame] = {}
    in_order = lambda item: F.transform(F.array_sort(F.collect_list(F.struct("first_seen", item.alias("item")))), lambda x: x["item"])
    if history.churn is not None:
        own = checkpointed(history.churn.join(mine.select("repo_id", "sha", "pos"), ["repo_id", "sha"]))
        kept = checkpointed(churn.kept_churn(own, churn.generated_paths(own, ["repo_id", "path"])))
        out["languages"] = churn.extension_shares(kept).groupBy("repo_id").agg(in_order(F.struct(F.col("label").alias("extension"), "share")).alias("languages"))
        out["categories"] = churn.category_shares(kept).groupBy("repo_id").agg(in_order(F.struct(F.col("label").alias("name"), F.col("commits").alias("commit_count"), F.col("share").alias("churn_share"))).alias("categories"))
    if history.added_lines is not None and (package_map is not None or rules is not None):
        found = detected_skills(history, mine, package_map, rules).withColumns({"evidence": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string")})
        if structural is not None:
            found = found.unionByName(structural.select(found.columns))
        item = F.struct("slug", "commit_count", iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"), "evidence", "confidence")
        out["detected"] = found.groupBy("repo_id").agg(F.array_sort(F.collect_list(item)).alias("detected"))
    return out


def as_json(bundles: DataFrame) -> DataFrame:
    """repo_id, json, content_hash; a bundle that carries a secret is an error, and absent fields are left out."""
    text = F.to_json("bundle")
    refused = F.raise_error(F.concat(F.lit("a secret is in the bundle: "), secret_family(text)))
    return bundles.select("repo_id", F.when(secret_family(text).isNotNull(), refused.cast("string")).otherwise(text).alias("json"), content_hash(F.col("bundle")).alias("content_hash"))


def already_submitted(current: DataFrame, stored: DataFrame) -> DataFrame:
    """current(site, repo_id, content_hash) with whether stored has the same site and hash."""
    marks = stored.select("site", "content_hash").distinct().withColumn("same", F.lit(True))
    return current.join(marks, ["site", "content_hash"], "left").withColumn("already_submitted", F.coalesce("same", F.lit(False))).drop("same")
