"""Ordered rule cascades: file kinds, resolution states, risk gates, repair verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import extension

#: Extensions and name patterns of each kind of file.
SOURCE = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".go", ".cs", ".java", ".kt", ".php", ".rb", ".swift", ".c", ".h", ".cpp", ".hpp", ".sol", ".lua"]
SCRIPT = [".ps1", ".psm1", ".sh", ".bash", ".zsh", ".fish", ".bat", ".cmd"]
DOCS = [".md", ".mdx", ".rst", ".txt", ".adoc"]
ASSET = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".mp3", ".wav", ".ogg", ".mp4", ".webm", ".mov", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".rbxlx", ".rbxl", ".rbxm", ".rbxmx", ".fbx", ".obj", ".glb", ".gltf", ".blend"]
BINARY = [".exe", ".dll", ".so", ".dylib", ".bin", ".wasm", ".o", ".a", ".class", ".pyc", ".node", ".zip", ".gz", ".tar", ".7z", ".pdf"]
SCHEMA = [".graphql", ".gql", ".prisma", ".proto"]
CONFIG = [".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".lock", ".xml"]
RESOLVED = [*SOURCE, ".cc", ".cxx", ".hh", ".hxx"]
SECRET_NAME = r"(^|/)(\.env(\.[\w-]+)?|.*\.pem|.*\.key|id_rsa|id_ed25519|.*\.p12|.*\.pfx|.*\.keystore|credentials(\.json)?|secrets?(\.[\w]+)?)$"
SECRET_HINT = r"(secret|credential|private[_-]?key|apikey|api[_-]?key)"
GENERATED = r"(^|/)(dist|build|out|\.next|_next|node_modules|vendor|generated|coverage|\.turbo|__pycache__|target)(/|$)|\.min\.(js|css)$|\.bundle\.js$|\.d\.ts$|\.generated\."
LOCK = r"(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|composer\.lock|gemfile\.lock)$"
ABI = r"\.abi\.json$|(^|/)(abi|artifacts?)(/|$)|hardhat\.config|truffle-config|foundry\.toml"
SCHEMA_NAME = r"(openapi|swagger)\.(ya?ml|json)$|schema\.(graphql|gql|prisma|json)$"
TEST = r"(\.|_|^)(test|spec)\.[\w]+$|(^|/)(tests?|__tests__|spec)(/|$)|_test\.go$"
ROUTE = r"(^|/)(app|pages|routes?|api)(/).*(/(page|route|layout|index)\.[jt]sx?$|\.[jt]sx?$)|(^|/)server/.*(route|handler)"
CONFIG_NAME = r"(^|/)(package\.json|tsconfig.*\.json|jsconfig\.json|pyproject\.toml|go\.mod|go\.sum|cargo\.toml|.*\.csproj|pom\.xml|build\.gradle.*|requirements\.txt|pipfile|.*\.config\.[jt]s|vite\.config\.|next\.config\.|webpack\.config\.)"
ENTRY = ["index", "main", "layout", "page", "route", "__init__", "__main__", "server", "cli", "backend", "bridge", "worker", "service", "coordinator", "orchestrator", "tower"]
TEST_OR_CONFIG = ["test", "spec", "conftest", "config", "setup", "webpack", "vite", "package.json"]
DYNAMIC_FOLDERS = ["skills", "plugins", "hooks", "bin", "scripts", "tools", "jobs"]
#: States that block destructive repair.
BLOCKING = ["resolver_missing", "requires_runtime", "failed_with_reason"]
SOURCE_KINDS = ["source", "route", "test"]


def file_kind(path: Column) -> Column:
    """The first kind that fits a path, secrets first."""
    p, ext = F.lower(path), extension(path)
    return (
        F.when(p.rlike(SECRET_NAME) | (p.rlike(SECRET_HINT) & ext.isin(".json", ".txt", "")), "secret_risk")
        .when(p.rlike(GENERATED) | p.rlike(LOCK), "generated")
        .when(p.rlike(ABI), "abi_runtime")
        .when(p.rlike(SCHEMA_NAME) | ext.isin(SCHEMA), "schema")
        .when(p.rlike(TEST), "test")
        .when(p.rlike(ROUTE) & ext.isin(SOURCE), "route")
        .when(p.rlike(CONFIG_NAME) | ext.isin(CONFIG + SCRIPT), "config")
        .when(ext.isin(DOCS), "docs")
        .when(ext.isin(ASSET), "asset")
        .when(ext.isin(BINARY), "binary")
        .when(ext.isin(SOURCE), "source")
        .otherwise("unknown")
    )


def entry_point(path: Column) -> Column:
    return F.lower(path).rlike("|".join(ENTRY))


def test_or_config(path: Column) -> Column:
    return F.lower(path).rlike("|".join(x.replace(".", r"\.") for x in TEST_OR_CONFIG))


def dynamic_folder(path: Column) -> Column:
    return F.lower(path).rlike(rf"(^|/)({'|'.join(DYNAMIC_FOLDERS)})/|/(assets|public)/")


#: What resolves the imports of files with an extension, and their languages' grammars.
RESOLVERS = {".py": "python resolver (pyproject.toml / import roots)", ".go": "go resolver (go.mod / package graph)", ".rs": "rust resolver (Cargo.toml / mod/use)", ".cs": "c# resolver (.csproj / namespaces)", ".java": "jvm resolver (Gradle/Maven / packages)", ".kt": "jvm resolver (Gradle/Maven / packages)", ".php": "php resolver (composer / namespaces)", ".rb": "ruby resolver (Gemfile / require paths)", ".swift": "swift resolver (Package.swift / modules)", ".c": "c/c++ resolver (include paths / build system)", ".cpp": "c/c++ resolver (include paths / build system)", ".h": "c/c++ resolver (include paths / build system)", ".hpp": "c/c++ resolver (include paths / build system)"}
GRAMMARS = {".swift": "swift", ".kt": "kotlin", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "c++", ".hpp": "c++"}


def _named(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def resolver_needed(ext: Column) -> Column:
    """What would resolve the imports of a file with this extension."""
    other = F.concat(F.lit("native grammar/resolver for "), F.when(ext == "", "this file type").otherwise(ext))
    return F.coalesce(_named(RESOLVERS, ext), other)


def grammar_needed(ext: Column) -> Column:
    """Which grammar would read a file with this extension deeply."""
    bare = F.regexp_replace(ext, r"^\.", "")
    return F.concat(F.lit("a native "), F.coalesce(_named(GRAMMARS, ext), F.when(bare == "", "language").otherwise(bare)), F.lit(" grammar"))


def gap_counts(ledger: DataFrame) -> DataFrame:
    """needed, n: how many files of a ledger wait for each named requirement, what stands after ``needs `` in their reason."""
    x = ledger.where(F.col("reason").contains("needs ")).select(F.regexp_extract("reason", "(?s)needs (.*)$", 1).alias("needed"))
    return x.groupBy("needed").agg(F.count("*").alias("n"))


def resolution(files: DataFrame) -> DataFrame:
    """file_id, kind, state, confidence, reason, resolver_used of files (file_id, path, parser_mode, parse_quality, symbols, imports, unresolved, unresolved_local, dynamic, parse_errors, hard_fails, skip_reason)."""
    kind, mode, skip = file_kind(F.col("path")), F.col("parser_mode"), F.lower(F.coalesce("skip_reason", F.lit("")))
    x = files.withColumn("kind", kind)
    kind = F.col("kind")
    known, source = extension(F.col("path")).isin(RESOLVED), kind.isin(SOURCE_KINDS)
    gaps = F.when(known, F.col("unresolved_local")).otherwise(F.col("unresolved"))
    quality = F.coalesce("parse_quality", F.lit(0.0))
    skipped, parsed = mode == "skipped", (F.col("symbols") > 0) | (F.col("imports") > 0) | mode.isin("tree-sitter", "fallback")
    caveat = (mode == "fallback") | (quality < 0.85) | (gaps > 0) | (F.col("parse_errors") > 0)
    ext, n, text = extension(F.col("path")), lambda c: F.col(c).cast("string"), F.lit
    resolver, grammar = resolver_needed(ext), grammar_needed(ext)
    why = F.array_join(F.filter(F.array(F.when(mode == "fallback", "fallback parser"), F.when(gaps > 0, F.concat(gaps.cast("string"), text(" unresolved local import(s)"))), F.when(F.col("parse_errors") > 0, "parse warnings"), F.when(quality < 0.85, F.concat(text("quality "), F.format_string("%.2f", quality)))), lambda x: x.isNotNull()), ", ")
    more_gaps = F.when(gaps > 0, F.concat(text(" + "), gaps.cast("string"), text(" unresolved import(s)"))).otherwise("")
    # Test, state, confidence, reason, what decided.
    rules = [
        (kind == "secret_risk", "unsafe_excluded", F.lit(1.0), text("secret/credential-risk file — content withheld and logged"), text("security_classifier")),
        (skipped & (skip.contains("minified") | (kind == "generated")), "generated_excluded", F.lit(0.9), F.concat(text("generated/minified artifact ("), F.coalesce(F.nullif(F.col("skip_reason"), text("")), kind), text(") — excluded with proof, not parsed")), text("generated_classifier")),
        (skipped & skip.contains("too_large"), "resolved_metadata", F.lit(0.7), text("oversized blob — classified by size/type, not parsed (would be noise)"), text("size_classifier")),
        (skipped & kind.isin("asset", "binary"), "resolved_metadata", F.lit(0.85), F.concat(kind, text(" file — classified, not source")), text("asset_classifier")),
        (skipped & (kind == "docs"), "resolved_metadata", F.lit(0.85), text("documentation — recorded as metadata"), text("doc_classifier")),
        (skipped & kind.isin("config", "schema", "abi_runtime"), "resolved_metadata", F.lit(0.75), F.concat(kind, text(" file — recorded; structured resolver can deepen this")), text("metadata_classifier")),
        (skipped & source, "resolver_missing", F.lit(0.3), F.concat(text("source-like but unparsed: needs "), resolver), text("none")),
        (skipped, "resolved_metadata", F.lit(0.6), text("non-source file — classified"), text("metadata_classifier")),
        ((F.col("hard_fails") > 0) & (F.col("symbols") == 0) & source, "resolver_missing", F.lit(0.25), F.concat(text("no working parser/grammar: needs "), resolver), text("none")),
        ((F.col("hard_fails") > 0) & (F.col("symbols") == 0), "failed_with_reason", F.lit(0.2), text("parse failed and produced no symbols — recorded for follow-up"), text("fallback")),
        (parsed & (F.col("dynamic") > 0), "requires_runtime", F.lit(0.6), F.concat(n("dynamic"), text(" dynamic/runtime reference(s)"), more_gaps, text(" — needs runtime/LSP/ABI to fully resolve")), mode),
        (parsed & source & ~known & (F.col("imports") > 0) & (F.col("unresolved") > 0), "resolver_missing", F.lit(0.45), F.concat(n("unresolved"), text(" import(s) and no resolver for this language: needs "), resolver), text("none")),
        (parsed & caveat, "resolved_partial", F.greatest(F.lit(0.5), quality), F.concat(text("parsed with caveats: "), F.when(why == "", "reduced confidence").otherwise(why)), mode),
        (parsed, "resolved_full", F.greatest(F.lit(0.85), quality), text("parsed, symbols + imports resolved"), mode),
        (source, "resolver_missing", F.lit(0.2), F.concat(text("fallback produced no symbols: needs "), grammar), text("none")),
        (F.lit(True), "resolved_metadata", F.lit(0.7), text("no extractable symbols (empty/comment-only) — recorded"), mode),
    ]
    found = F.coalesce(*(F.when(test, F.struct(F.lit(state).alias("state"), value.cast("double").alias("confidence"), reason.alias("reason"), used.alias("resolver_used"))) for test, state, value, reason, used in rules))
    large = skipped & skip.contains("too_large") & ~(skip.contains("minified") | (kind == "generated")) & (kind != "secret_risk")
    x = x.select("file_id", F.when(large, "binary").otherwise(kind).alias("kind"), found.alias("r"))
    return x.select("file_id", "kind", "r.state", F.round("r.confidence", 2).alias("confidence"), "r.reason", "r.resolver_used")


def coverage(ledger: DataFrame) -> DataFrame:
    """One row of totals over a ledger of kinds and states."""
    source, state = F.col("kind").isin(SOURCE_KINDS), F.col("state")
    solved = source & state.isin("resolved_full", "resolved_partial")
    odd = (F.col("kind") == "unknown") & ~state.isin("resolved_metadata", "unsafe_excluded", "generated_excluded")
    x = ledger.agg(F.count("*").alias("total"), F.count_if(source).alias("source_files"), F.count_if(solved).alias("source_resolved"), F.count_if(source & (state == "resolver_missing")).alias("unresolved_source"), F.count_if(state == "requires_runtime").alias("runtime_required"), F.count_if(~source & (state != "unsafe_excluded")).alias("artifacts"), F.count_if(state.isin(BLOCKING)).alias("blocking_gaps"), F.count_if(odd).alias("unknown"))
    return x.withColumn("source_coverage", F.when(F.col("source_files") == 0, F.lit(1.0)).otherwise(F.col("source_resolved") / F.col("source_files")))


def risk_gate(stats: DataFrame) -> DataFrame:
    """stats (one row: files, unparsed, parser_errors, avg_quality, blindspots, fallback, dynamic, aliases, relative) with the risk, three permissions and the reasons."""
    c, rate = F.col, F.when(F.col("files") == 0, F.lit(0.0)).otherwise(100.0 * F.col("blindspots") / F.col("files"))
    high = (c("files") == 0) | (c("unparsed") > 0) | (c("parser_errors") > 0) | (c("avg_quality") < 0.55) | (rate > 20)
    medium = (c("fallback") > 0) | (c("dynamic") > 0) | (c("aliases") > 0) | (c("relative") > 0) | (rate > 8)
    risk = F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
    named = [("files", c("files") == 0, "no indexed files"), *((k, c(k) > 0, text) for k, text in (("unparsed", "unparsed files"), ("parser_errors", "parser errors"), ("dynamic", "dynamic runtime warnings"), ("aliases", "unresolved aliases"), ("relative", "unresolved relative imports"), ("fallback", "fallback-parsed files")))]
    reasons = F.filter(F.array(*(F.when(test, F.lit(text) if k == "files" else F.concat_ws(" ", c(k).cast("string"), F.lit(text))) for k, test, text in named), F.when((c("avg_quality") > 0) & (c("avg_quality") < 0.55), "low average parse quality"), F.when(rate > 20, "high blindspot rate")), lambda x: x.isNotNull())
    x = stats.withColumns({"risk": risk, "reasons": F.array_join(reasons, "; ")})
    return x.withColumns({"suggestion_allowed": c("files") > 0, "repair_allowed": c("risk") != "HIGH", "destructive_allowed": c("risk") == "LOW"})


def repair_verdict(targets: DataFrame, gate: DataFrame) -> DataFrame:
    """id, verdict of targets (id, state, kind, protected, destructive, partial) under a gate of one row: the first refusal that applies."""
    x = targets.crossJoin(F.broadcast(gate.select("suggestion_allowed", "repair_allowed", "destructive_allowed")))
    d = F.col("destructive")
    verdict = (
        F.when(~F.col("suggestion_allowed"), "BLOCKED")
        .when(d & F.col("partial"), "REFUSE_PARTIAL_INDEX")
        .when(d & F.col("state").isin(BLOCKING), "REFUSE_UNRESOLVED_FILE")
        .when(d & (F.col("kind") == "generated"), "REFUSE_GENERATED_FILE")
        .when(d & F.col("protected"), "REFUSE_PROTECTED_FILE")
        .when(d & ~F.col("destructive_allowed"), "REFUSE_DESTRUCTIVE_REPAIR")
        .when(~F.col("repair_allowed"), "BLOCK_REPAIR_HANDOFF")
        .otherwise("ADVISORY_HANDOFF")
    )
    return x.select("id", verdict.alias("verdict"))


def report_risk(rate: Column, quality: Column, unresolved: Column) -> Column:
    return F.when((rate > 20) | (quality < 0.55), "HIGH").when((rate > 8) | (unresolved > 20), "MEDIUM").otherwise("LOW")


def churn_risk(commits: Column) -> Column:
    return F.when(commits > 20, "HIGH").when(commits > 5, "MODERATE").otherwise("LOW")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """category, location, evidence, severity: of equal findings the most severe one."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    x = findings.groupBy("category", "location", "evidence").agg(F.max(rank).alias("r"))
    return x.select("category", "location", "evidence", F.element_at(F.array(*map(F.lit, ("info", "low", "medium", "high"))), F.col("r") + 1).alias("severity"))


def permitted(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """The calls (role, tool, ...) that a grant (role, tool) allows; the tool ``*`` allows all."""
    wild = grants.where("tool = '*'").select("role").distinct()
    return calls.join(grants.select("role", "tool").distinct(), ["role", "tool"], "left_semi").unionByName(calls.join(grants.select("role", "tool").distinct(), ["role", "tool"], "left_anti").join(wild, "role", "left_semi"))


def protected(staged: Column, intent: Column) -> Column:
    """Whether a file must not be touched: it is staged, or someone means to work on it."""
    return staged | (intent > 0.2)
