"""Explicit schemas of the relations; nothing is inferred."""

from __future__ import annotations

COMMITS = "repo_id string, pos long, sha string, parent_sha string, email string, author_ts timestamp, committer_ts timestamp, signed boolean, is_merge boolean"
CHURN = "repo_id string, sha string, file_pos int, path string, added long, deleted long"
ADDED_LINES = "repo_id string, sha string, path string, added_text string"
BLOBS = "repo_id string, revision string, path string, content string"
TREE = "repo_id string, path string, size long"
SNAPSHOT = "repo_id string, path string, content string"
REPOS = "repo_id string, remote_url string, shallow boolean, now_ts timestamp, user_email string"
COUNTS = "repo_id string, commits bigint"

# Syntax facts.
IMPORTS = "repo_id string, path string, specifier string, bindings array<struct<local: string, imported: string, kind: string>>"
FUNCTIONS = "repo_id string, path string, name string, start_line int, end_line int, exported boolean"
CALLS = "repo_id string, path string, pos int, chain array<string>, line int, fn string, string_args array<string>, arg_props array<string>, number_args array<double>"
BINDINGS = "repo_id string, path string, name string, kind string, chain array<string>"
ACCESSES = "repo_id string, path string, chain array<string>, line int, fn string"
LITERALS = "repo_id string, path string, value string, line int, fn string"
ANCHORS = "repo_id string, kind string, path string, fn string, line int, reason string, provider string, library string"

# Dictionaries.
PACKAGE_MAP = "package string, slug string"
TAXONOMY = "slug string, label string"
SIGNATURES = "slug string, importPatterns array<string>, apiPatterns array<string>, configFilePatterns array<string>, fixtures struct<positive: array<struct<path: string, diff: string>>, negative: array<struct<path: string, diff: string>>>"

# Tamper-evident chain of submissions (draft record).
CHAIN = "chain_id string, seq long, prev_hash string, head_hash string, claimed_ts timestamp, received_ts timestamp, count long"

BUNDLE = """schema_version string, runner string, tool_version string, created_at string,
repo struct<host_type: string, age_days: long, repo_fingerprint: string, shallow: boolean>,
identity struct<author_identity_hashes: array<string>, other_contributors_count: long>,
commits struct<user_total: long, first_at: string, last_at: string, span_days: long, hour_histogram: array<long>, weekday_histogram: array<long>>,
signed struct<count: long, ratio: double>,
languages array<struct<extension: string, share: double>>,
categories array<struct<name: string, commit_count: long, churn_share: double>>,
detected_skills array<struct<slug: string, commit_count: long, first_seen: string, last_seen: string, evidence: string, confidence: string>>,
ownership struct<user_commit_ratio: double>,
integrity struct<merkle_root: string, algorithm: string, date_forensics: struct<author_span_days: long, committer_span_days: long, mismatch_ratio: double, committer_burst_ratio: double>>,
attestation struct<authorized_confirmation: boolean, confirmed_at: string>"""
