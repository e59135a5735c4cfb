"""Queries of rule cascades, over documents as files with flags from labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import decisions as D
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read

EXT = ["py", "ts", "md", "json", "png", "min.js", "pem", "proto", "sh", "xyz"]
_PATH = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXT)) + " END"
FILES = f"SELECT d.doc_id AS file_id, d.source || '/' || CASE WHEN d.doc_id % 7 = 0 THEN 'tests/' WHEN d.doc_id % 11 = 0 THEN 'api/' ELSE '' END || 'f' || d.doc_id || '.' || {_PATH.replace('doc_id', 'd.doc_id')} AS path, CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'tree-sitter' ELSE 'fallback' END AS parser_mode, CASE WHEN quality = 1 THEN 0.95::DOUBLE ELSE 0.6::DOUBLE END AS parse_quality, coalesce(toxic, 0) AS dynamic, n_chars % 3 AS symbols, n_chars % 5 AS imports, n_chars % 2 AS unresolved, CASE WHEN quality IS NULL THEN CASE WHEN n_chars > 5000 THEN 'skipped:too_large' WHEN n_chars < 500 THEN 'skipped:minified' ELSE 'skipped:unsupported_ext' END END AS skip_reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def files(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    folder = F.when(F.col("doc_id") % 7 == 0, "tests/").when(F.col("doc_id") % 11 == 0, "api/").otherwise("")
    ext = F.element_at(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 10 + 1).cast("int"))
    skip = F.when(F.col("quality").isNull(), F.when(F.col("n_chars") > 5000, "skipped:too_large").when(F.col("n_chars") < 500, "skipped:minified").otherwise("skipped:unsupported_ext"))
    mode = F.when(F.col("quality").isNull(), "skipped").when(F.col("quality") == 1, "tree-sitter").otherwise("fallback")
    n = F.col("n_chars")
    return x.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), folder, F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), mode.alias("parser_mode"), F.when(F.col("quality") == 1, 0.95).otherwise(0.6).alias("parse_quality"), F.coalesce("toxic", F.lit(0)).alias("dynamic"), (n % 3).alias("symbols"), (n % 5).alias("imports"), (n % 2).alias("unresolved"), (n % 2).alias("unresolved_local"), F.lit(0).alias("parse_errors"), F.lit(0).alias("hard_fails"), skip.alias("skip_reason"))


def _in(c: str, values: list[str]) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in values)})"


_M = lambda p: "regexp_matches(p, '" + p + "')"
KIND = f"""CASE WHEN {_M(D.SECRET_NAME)} OR ({_M(D.SECRET_HINT)} AND {_in('ext', ['.json', '.txt', ''])}) THEN 'secret_risk' WHEN {_M(D.GENERATED)} OR {_M(D.LOCK)} THEN 'generated' WHEN {_M(D.ABI)} THEN 'abi_runtime'
WHEN {_M(D.SCHEMA_NAME)} OR {_in('ext', D.SCHEMA)} THEN 'schema' WHEN {_M(D.TEST)} THEN 'test' WHEN {_M(D.ROUTE)} AND {_in('ext', D.SOURCE)} THEN 'route' WHEN {_M(D.CONFIG_NAME)} OR {_in('ext', D.CONFIG + D.SCRIPT)} THEN 'config'
WHEN {_in('ext', D.DOCS)} THEN 'docs' WHEN {_in('ext', D.ASSET)} THEN 'asset' WHEN {_in('ext', D.BINARY)} THEN 'binary' WHEN {_in('ext', D.SOURCE)} THEN 'source' ELSE 'unknown' END"""
K = f"SELECT *, {KIND} AS kind FROM (SELECT *, lower(path) AS p, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext FROM ({FILES}))"
S = _in("kind", D.SOURCE_KINDS)
R = _in("ext", D.RESOLVED)
LEDGER = f"""SELECT file_id, CASE WHEN kind <> 'secret_risk' AND parser_mode = 'skipped' AND contains(skip, 'too_large') AND NOT (contains(skip, 'minified') OR kind = 'generated') THEN 'binary' ELSE kind END AS kind, state, round(confidence, 2) AS confidence FROM (
SELECT *, CASE WHEN kind = 'secret_risk' THEN 'unsafe_excluded'
 WHEN sk THEN CASE WHEN contains(skip, 'minified') OR kind = 'generated' THEN 'generated_excluded' WHEN contains(skip, 'too_large') THEN 'resolved_metadata' WHEN kind IN ('asset', 'binary', 'docs', 'config', 'schema', 'abi_runtime') THEN 'resolved_metadata' WHEN {S} THEN 'resolver_missing' ELSE 'resolved_metadata' END
 WHEN parsed AND dynamic > 0 THEN 'requires_runtime' WHEN parsed AND {S} AND NOT {R} AND imports > 0 AND unresolved > 0 THEN 'resolver_missing'
 WHEN parsed AND (parser_mode = 'fallback' OR parse_quality < 0.85 OR unresolved > 0) THEN 'resolved_partial' WHEN parsed THEN 'resolved_full' WHEN {S} THEN 'resolver_missing' ELSE 'resolved_metadata' END AS state,
CASE WHEN kind = 'secret_risk' THEN 1.0::DOUBLE
 WHEN sk THEN CASE WHEN contains(skip, 'minified') OR kind = 'generated' THEN 0.9::DOUBLE WHEN contains(skip, 'too_large') THEN 0.7::DOUBLE WHEN kind IN ('asset', 'binary', 'docs') THEN 0.85::DOUBLE WHEN kind IN ('config', 'schema', 'abi_runtime') THEN 0.75::DOUBLE WHEN {S} THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END
 WHEN parsed AND dynamic > 0 THEN 0.6::DOUBLE WHEN parsed AND {S} AND NOT {R} AND imports > 0 AND unresolved > 0 THEN 0.45::DOUBLE
 WHEN parsed AND (parser_mode = 'fallback' OR parse_quality < 0.85 OR unresolved > 0) THEN greatest(0.5::DOUBLE, parse_quality) WHEN parsed THEN greatest(0.85::DOUBLE, parse_quality) WHEN {S} THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM (SELECT *, parser_mode = 'skipped' AS sk, lower(coalesce(skip_reason, '')) AS skip, symbols > 0 OR imports > 0 OR parser_mode IN ('tree-sitter', 'fallback') AS parsed FROM ({K})))"""


@register("kind_cascade", f"SELECT file_id, kind FROM ({K})")
def kind_cascade(spark, d):
    return files(spark, d).select("file_id", D.file_kind(F.col("path")).alias("kind"))


@register("path_predicates", "SELECT count_if(regexp_matches(p, '" + "|".join(D.ENTRY) + "'))::BIGINT AS entry, count_if(regexp_matches(p, '" + "|".join(x.replace(".", r"\.") for x in D.TEST_OR_CONFIG) + "'))::BIGINT AS test_or_config, count_if(regexp_matches(p, '(^|/)(" + "|".join(D.DYNAMIC_FOLDERS) + f")/|/(assets|public)/'))::BIGINT AS dynamic FROM (SELECT lower(path) AS p FROM ({FILES}))")
def path_predicates(spark, d):
    p = F.col("path")
    return files(spark, d).agg(F.count_if(D.entry_point(p)).alias("entry"), F.count_if(D.test_or_config(p)).alias("test_or_config"), F.count_if(D.dynamic_folder(p)).alias("dynamic"))


@register("ledger", LEDGER)
def ledger(spark, d):
    return D.resolution(files(spark, d)).select("file_id", "kind", "state", "confidence")


#: Reasons written out for the cases that occur, in SQL of its own.
NEEDS = "CASE ext WHEN '.py' THEN 'python resolver (pyproject.toml / import roots)' ELSE 'native grammar/resolver for ' || ext END"
REASONS = f"""SELECT file_id, CASE state WHEN 'unsafe_excluded' THEN 'secret/credential-risk file — content withheld and logged' WHEN 'generated_excluded' THEN 'generated/minified artifact (' || skip_reason || ') — excluded with proof, not parsed'
 WHEN 'resolver_missing' THEN CASE WHEN sk THEN 'source-like but unparsed: needs ' || {NEEDS} ELSE unresolved || ' import(s) and no resolver for this language: needs ' || {NEEDS} END
 WHEN 'requires_runtime' THEN dynamic || ' dynamic/runtime reference(s)' || CASE WHEN unresolved > 0 THEN ' + ' || unresolved || ' unresolved import(s)' ELSE '' END || ' — needs runtime/LSP/ABI to fully resolve'
 WHEN 'resolved_partial' THEN 'parsed with caveats: ' || concat_ws(', ', CASE WHEN parser_mode = 'fallback' THEN 'fallback parser' END, CASE WHEN unresolved > 0 THEN unresolved || ' unresolved local import(s)' END, CASE WHEN parse_quality < 0.85 THEN 'quality ' || printf('%.2f', parse_quality) END)
 WHEN 'resolved_full' THEN 'parsed, symbols + imports resolved'
 ELSE CASE WHEN contains(skip, 'too_large') THEN 'oversized blob — classified by size/type, not parsed (would be noise)' WHEN k2 IN ('asset', 'binary') THEN k2 || ' file — classified, not source' WHEN k2 = 'docs' THEN 'documentation — recorded as metadata' WHEN k2 IN ('config', 'schema', 'abi_runtime') THEN k2 || ' file — recorded; structured resolver can deepen this' ELSE 'non-source file — classified' END END AS reason,
 CASE state WHEN 'unsafe_excluded' THEN 'security_classifier' WHEN 'generated_excluded' THEN 'generated_classifier' WHEN 'resolver_missing' THEN 'none' WHEN 'requires_runtime' THEN parser_mode WHEN 'resolved_partial' THEN parser_mode WHEN 'resolved_full' THEN parser_mode
 ELSE CASE WHEN contains(skip, 'too_large') THEN 'size_classifier' WHEN k2 IN ('asset', 'binary') THEN 'asset_classifier' WHEN k2 = 'docs' THEN 'doc_classifier' ELSE 'metadata_classifier' END END AS resolver_used
FROM (SELECT k.*, k.kind AS k2, l.state, parser_mode = 'skipped' AS sk, lower(coalesce(skip_reason, '')) AS skip FROM ({K}) k JOIN ({LEDGER}) l USING (file_id))"""


@register("ledger_reasons", REASONS)
def ledger_reasons(spark, d):
    return D.resolution(files(spark, d)).select("file_id", "reason", "resolver_used")


@register("gap_counts", f"SELECT regexp_extract(reason, 'needs (.*)$', 1) AS needed, count(*)::BIGINT AS n FROM ({REASONS}) WHERE contains(reason, 'needs ') GROUP BY 1")
def gap_counts(spark, d):
    return D.gap_counts(D.resolution(files(spark, d)))


@register("requirement_map", "SELECT * FROM (VALUES ('.py', 'python resolver (pyproject.toml / import roots)', 'a native py grammar'), ('.kt', 'jvm resolver (Gradle/Maven / packages)', 'a native kotlin grammar'), ('.hpp', 'c/c++ resolver (include paths / build system)', 'a native c++ grammar'), ('.xyz', 'native grammar/resolver for .xyz', 'a native xyz grammar'), ('', 'native grammar/resolver for this file type', 'a native language grammar')) t(ext, resolver, grammar)")
def requirement_map(spark, d):
    x = spark.createDataFrame([(e,) for e in (".py", ".kt", ".hpp", ".xyz", "")], "ext string")
    return x.select("ext", D.resolver_needed(F.col("ext")).alias("resolver"), D.grammar_needed(F.col("ext")).alias("grammar"))


@register("coverage", f"SELECT count(*)::BIGINT AS total, count_if({S})::BIGINT AS source_files, count_if({S} AND state IN ('resolved_full', 'resolved_partial'))::BIGINT AS source_resolved, count_if({S} AND state = 'resolver_missing')::BIGINT AS unresolved_source, count_if(state = 'requires_runtime')::BIGINT AS runtime_required, count_if(NOT {S} AND state <> 'unsafe_excluded')::BIGINT AS artifacts, count_if({_in('state', D.BLOCKING)})::BIGINT AS blocking_gaps, count_if(kind = 'unknown' AND state NOT IN ('resolved_metadata', 'unsafe_excluded', 'generated_excluded'))::BIGINT AS unknown, source_resolved / source_files AS source_coverage FROM ({LEDGER})")
def coverage(spark, d):
    return D.coverage(D.resolution(files(spark, d)))


@register("coverage_by_state", f"SELECT kind, state, count(*)::BIGINT AS n FROM ({LEDGER}) GROUP BY ALL")
def coverage_by_state(spark, d):
    return D.resolution(files(spark, d)).groupBy("kind", "state").agg(F.count("*").alias("n"))


def _gate(spark, d):
    f = files(spark, d)
    return D.risk_gate(f.agg(F.count("*").alias("files"), F.lit(0).cast("long").alias("unparsed"), F.lit(0).cast("long").alias("parser_errors"), (F.floor(F.avg("parse_quality") * 1000 + 0.5) / 1000).alias("avg_quality"), F.sum("dynamic").cast("long").alias("blindspots"), F.count_if(F.col("parser_mode") == "fallback").alias("fallback"), F.count_if(F.col("dynamic") > 0).alias("dynamic"), F.lit(0).cast("long").alias("aliases"), F.sum("unresolved_local").cast("long").alias("relative")))


GATE = f"""SELECT risk, reasons, risk <> 'HIGH' AS repair_allowed, risk = 'LOW' AS destructive_allowed, files > 0 AS suggestion_allowed FROM (SELECT files, CASE WHEN files = 0 OR q < 0.55 OR 100.0::DOUBLE * dyn / files > 20 THEN 'HIGH' WHEN fb > 0 OR dyn > 0 OR rel > 0 OR 100.0::DOUBLE * dyn / files > 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
concat_ws('; ', CASE WHEN dyn > 0 THEN dyn || ' dynamic runtime warnings' END, CASE WHEN rel > 0 THEN rel || ' unresolved relative imports' END, CASE WHEN fb > 0 THEN fb || ' fallback-parsed files' END, CASE WHEN q > 0 AND q < 0.55 THEN 'low average parse quality' END, CASE WHEN 100.0::DOUBLE * dyn / files > 20 THEN 'high blindspot rate' END) AS reasons
FROM (SELECT count(*) AS files, floor(avg(parse_quality) * 1000 + 0.5) / 1000 AS q, count_if(dynamic > 0) AS dyn, count_if(parser_mode = 'fallback') AS fb, sum(unresolved)::BIGINT AS rel FROM ({FILES})))"""


@register("risk_gate", GATE)
def risk_gate(spark, d):
    return _gate(spark, d).select("risk", "reasons", "repair_allowed", "destructive_allowed", "suggestion_allowed")


@register("repair_verdict", f"SELECT file_id AS id, CASE WHEN NOT suggestion_allowed THEN 'BLOCKED' WHEN {_in('state', D.BLOCKING)} THEN 'REFUSE_UNRESOLVED_FILE' WHEN kind = 'generated' THEN 'REFUSE_GENERATED_FILE' WHEN confidence > 0.9 THEN 'REFUSE_PROTECTED_FILE' WHEN NOT destructive_allowed THEN 'REFUSE_DESTRUCTIVE_REPAIR' WHEN NOT repair_allowed THEN 'BLOCK_REPAIR_HANDOFF' ELSE 'ADVISORY_HANDOFF' END AS verdict FROM ({LEDGER}), ({GATE})")
def repair_verdict(spark, d):
    t = D.resolution(files(spark, d)).select(F.col("file_id").alias("id"), "state", "kind", (F.col("confidence") > 0.9).alias("protected"), F.lit(True).alias("destructive"), F.lit(False).alias("partial"))
    return D.repair_verdict(t, _gate(spark, d))


@register("report_risk", "SELECT source, CASE WHEN 100.0::DOUBLE * sum(toxic) / count(*) > 20 OR avg(quality) < 0.55 THEN 'HIGH' WHEN 100.0::DOUBLE * sum(toxic) / count(*) > 8 OR count_if(quality = 0) > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def report_risk(spark, d):
    x = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id").groupBy("source")
    return x.agg(D.report_risk(100.0 * F.sum("toxic") / F.count("*"), F.avg("quality"), F.count_if(F.col("quality") == 0)).alias("risk"))


@register("churn_risk", "SELECT l_suppkey, count(*)::BIGINT AS commits, CASE WHEN count(*) > 20 THEN 'HIGH' WHEN count(*) > 5 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM lineitem GROUP BY 1")
def churn_risk(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("commits"), D.churn_risk(F.count("*")).alias("risk"))


@register("dedupe_findings", "SELECT category, location, evidence, ['info', 'low', 'medium', 'high'][max(r) + 1] AS severity FROM (SELECT event_type AS category, 'u' || user_id AS location, floor(value / 10)::BIGINT AS evidence, CASE WHEN value > 20 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS r FROM events) GROUP BY ALL")
def dedupe_findings(spark, d):
    v = F.col("value")
    return D.dedupe_findings(read(spark, d, "events").select(F.col("event_type").alias("category"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("location"), F.floor(v / 10).alias("evidence"), F.when(v > 20, "high").when(v > 10, "medium").otherwise("low").alias("severity")))


@register("permission_check", "SELECT role, tool, count(*)::BIGINT AS n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'admin' WHEN user_id % 3 = 1 THEN 'dev' ELSE 'viewer' END AS role, event_type AS tool FROM events) WHERE role = 'admin' OR (role = 'dev' AND tool IN ('view', 'click')) OR (role = 'viewer' AND tool = 'view') GROUP BY ALL")
def permission_check(spark, d):
    role = F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id") % 3 == 1, "dev").otherwise("viewer")
    calls = read(spark, d, "events").select(role.alias("role"), F.col("event_type").alias("tool"))
    grants = spark.createDataFrame([("admin", "*"), ("dev", "view"), ("dev", "click"), ("viewer", "view")], "role string, tool string")
    return D.permitted(calls, grants).groupBy("role", "tool").agg(F.count("*").alias("n"))
