"""Column functions of paths and URLs.  Everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lockfiles, and patterns of generated paths.
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb")
MINIFIED = r"(?i)\.min\.js\z"
GENERATED_DIRECTORY = r"(?i)(^|/)(dist|build|\.next|node_modules)/"
SNAPSHOT_DIRECTORY = r"(?i)(^|/)(out|coverage|\.vercel|storybook-static|generated)/"
SNAPSHOT_MINIFIED = r"(?i)\.min\.ts\z"
MANIFEST = r"(?i)(package\.json|composer\.json|cargo\.toml)\z"

# Categories in order of precedence (the patterns ignore case).
CATEGORIES = (
    ("testing", r"(^|/)(__tests__|tests?|specs?)(/|$)|[._](test|spec)\.[a-z0-9]+$|(^|/)test_[^/]+\.[a-z0-9]+$"),
    ("ai-workflow", r"(^|/)(claude\.md|agents\.md|\.cursor|\.aider|copilot)"),
    ("infra", r"(^|/)(\.github/workflows|dockerfile|docker-compose|terraform|k8s|kubernetes|infra)(/|$|\.)"),
    ("auth", r"(^|/)(auth|authn|authz|session|oauth|login)(/|$|[._-])"),
    ("payments", r"(^|/)(pay|payments?|billing|checkout|stripe)(/|$|[._-])"),
    ("data", r"(^|/)(migrations?|models?|schema)(/|$)"),
    ("docs", r"\.(md|mdx)$|(^|/)docs(/|$)"),
    ("frontend", r"(^|/)(components?|pages|views|public|styles)(/|$)|\.(tsx|jsx|css|scss|vue|svelte)$"),
    ("backend", r"(^|/)(server|api|controllers?|services)(/|$)|\.(go|rb|java|rs|py)$"),
)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; null for none, for dot files and for other characters."""
    found = F.regexp_extract(F.lower(basename(path)), r"^.+(\.[a-z0-9]+)\z", 1)
    return F.when(found != "", found)


def category(path: Column) -> Column:
    """The first category whose pattern matches, else `other`."""
    chain = None
    for name, pattern in CATEGORIES:
        # Java's $ also matches before a last line feed.
        hit = path.rlike("(?i)" + pattern.replace("$", r"\z"))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("other")


def is_excluded(path: Column) -> Column:
    """Lockfiles, minified bundles and build output."""
    return basename(path).isin(*LOCKFILES) | path.rlike(MINIFIED) | path.rlike(GENERATED_DIRECTORY)


def is_snapshot_source(path: Column) -> Column:
    """TypeScript source that a snapshot reads: no declarations, no generated or minified files."""
    typed = path.endswith(".ts") | path.endswith(".tsx")
    declared = path.endswith(".d.ts") | path.endswith(".d.tsx")
    return typed & ~declared & ~is_excluded(path) & ~path.rlike(SNAPSHOT_DIRECTORY) & ~path.rlike(SNAPSHOT_MINIFIED)


def is_manifest(path: Column) -> Column:
    return path.rlike(MANIFEST)


def is_relative(specifier: Column) -> Column:
    return specifier.startswith("./") | specifier.startswith("../") | specifier.isin(".", "..")


def normalised(path: Column) -> Column:
    """The path without `.` and `..` segments; what would leave the root is dropped."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.reduce(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def joined(directory: Column, specifier: Column) -> Column:
    return normalised(F.concat_ws("/", directory, specifier))


def resolution_candidates(base: Column) -> Column:
    """Files that a relative specifier may mean, best first: as written, typed suffixes, index files, then .js or .jsx as .ts or .tsx."""
    swapped = F.when(base.endswith(".js"), F.array(F.regexp_replace(base, r"\.js\z", ".ts"))).when(base.endswith(".jsx"), F.array(F.regexp_replace(base, r"\.jsx\z", ".tsx"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base, *[F.concat(base, F.lit(x)) for x in (".ts", ".tsx", "/index.ts", "/index.tsx")]), swapped)


def host_type(url: Column) -> Column:
    """github, gitlab, bitbucket, other; `none` without a URL."""
    return F.when(url.isNull(), "none").when(url.rlike(r"github\.com"), "github").when(url.rlike(r"gitlab\."), "gitlab").when(url.rlike(r"bitbucket\.org"), "bitbucket").otherwise("other")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def probe_url(remote: Column) -> Column:
    """An https URL of a scp-like, ssh or http remote, without .git; null for anything else."""
    scp = F.regexp_extract(remote, r"^(?:[\w.-]+@)?([\w.-]+):(?!//)(.+)\z", 1)
    scp_path = F.regexp_extract(remote, r"^(?:[\w.-]+@)?([\w.-]+):(?!//)(.+)\z", 2)
    host = F.regexp_extract(remote, r"^(?:ssh|git|https?)://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)\z", 1)
    path = F.regexp_extract(remote, r"^(?:ssh|git|https?)://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)\z", 2)
    tail = lambda p: F.regexp_replace(F.regexp_replace(p, r"/+\z", ""), r"\.git\z", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/"), tail(path))).when(scp != "", F.concat(F.lit("https://"), scp, F.lit("/"), tail(scp_path)))


def is_public_host(url: Column, hosts: tuple[str, ...] = ("github.com", "gitlab.com", "bitbucket.org")) -> Column:
    """Whether the host is one of these or below it, and the URL carries neither a login nor a token."""
    host = url_host(url)
    known = None
    for h in hosts:
        hit = (host == h) | host.endswith("." + h)
        known = hit if known is None else known | hit
    return known & ~url.rlike(r"://[^/?#]*:[^/?#]*@") & ~url.rlike(r"(?i)[?&](access_token|token|private_token|auth)=")


def slug_prefix(slug: Column) -> Column:
    return F.substring_index(slug, "/", 1)
