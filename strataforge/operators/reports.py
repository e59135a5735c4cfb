"""Slices, summaries and reports over files, logs and diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.numbers import half_up
from strataforge.functions.text import MARK, SECRETS, estimate_tokens, extension

#: Languages by extension.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".rs": "rust", ".go": "go", ".cs": "csharp", ".java": "java", ".kt": "kotlin", ".php": "php", ".rb": "ruby", ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".sol": "solidity", ".lua": "lua"}
BLOCKING_CODES = ["PARSE_FAILURE", "UNSUPPORTED_EXTENSION", "DYNAMIC_IMPORT", "DYNAMIC_RUNTIME_REFERENCE", "PARSE_ERROR"]


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def line_slice(files: DataFrame, first: int, last: int, most: int = 4000) -> DataFrame:
    """path, text of the lines first to last (from 1, both inside) of files (path, text), cut to so many characters."""
    lines = F.slice(F.split("text", "\n", -1), max(1, first), max(0, last - max(1, first) + 1))
    return files.select("path", F.substr(F.array_join(lines, "\n"), F.lit(1), F.lit(most)).alias("text"))


def snippet(text: Column, line: Column, most: int = 1200) -> Column:
    return F.substr(F.coalesce(F.get(F.split(text, "\n", -1), line.cast("int") - 1), F.lit("")), F.lit(1), F.lit(most))


def stale(files: DataFrame, slack: float = 1.0) -> DataFrame:
    """path, stale of files (path, modified, indexed_at): changed after they were indexed by more than the slack, or gone (null)."""
    late = F.unix_micros(F.col("modified").cast("timestamp")) - F.unix_micros(F.col("indexed_at").cast("timestamp")) > slack * 1_000_000
    return files.select("path", F.coalesce(late, F.lit(True)).alias("stale"))


def blocking(diagnostics: DataFrame, limit: int = 15) -> DataFrame:
    """The first diagnostics (id, reason) with a blocking code or severity."""
    bad = F.split_part("reason", F.lit("|"), F.lit(1)).isin(BLOCKING_CODES) | F.col("reason").contains("|error|")
    return diagnostics.where(bad).orderBy("id").limit(limit)


def safe_files(files: DataFrame, limit: int = 10) -> DataFrame:
    """The newest files (path, parser_mode, parse_quality, indexed_at) that are fully parsed."""
    return files.where("parser_mode = 'tree-sitter' AND parse_quality >= 0.9").orderBy(F.desc("indexed_at"), "path").limit(limit)


def code_groups(diagnostics: DataFrame, examples: int = 3) -> DataFrame:
    """code, n, first (id), examples (the smallest ids, joined) of diagnostics (id, code).

    Few ids are kept for each code: they are ranked within the tasks first, so a common code's ids are not gathered.
    """
    counts = diagnostics.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    top = diagnostics.select("code", "id").withColumn("p", place).where(F.col("p") <= examples)
    top = top.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(top, "code")


def git_context(log: DataFrame, now: Column, days: int = 30, top: int = 5) -> DataFrame:
    """author, commits of the most active authors of the last days of a log (author, ts)."""
    recent = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= days * 86_400_000_000
    return log.where(recent).groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(top)


def output_budget(outputs: DataFrame, most: int, prefix: int = 200) -> DataFrame:
    """id, tokens, spilled, shown of outputs (id, text): too long ones show their beginning only."""
    tokens = estimate_tokens(F.col("text"))
    return outputs.select("id", tokens.alias("tokens"), (tokens > most).alias("spilled"), F.when(tokens > most, F.substr("text", F.lit(1), F.lit(prefix))).otherwise(F.col("text")).alias("shown"))


def redact_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strings, arrays of strings and maps to strings with secrets replaced."""
    clean = lambda c: reduce(lambda t, p: F.regexp_replace(t, p, MARK), SECRETS, c)
    out = {}
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        out[c] = F.transform(F.col(c), clean) if kind == "array" else F.transform_values(F.col(c), lambda k, v: clean(v)) if kind == "map" else clean(F.col(c))
    return df.withColumns(out)


def mentions(texts: DataFrame) -> DataFrame:
    """id, path of the relative paths that texts (id, text) mention."""
    found = F.regexp_extract_all("text", F.lit(r"(?:^|[\s(`'\"])((?:\.{0,2}/)?[\w.-]+(?:/[\w.-]+)+\.\w+)"), F.lit(1))
    return texts.select("id", F.explode(F.array_distinct(found)).alias("path"))


def is_json(text: Column) -> Column:
    """Whether a whole text is one JSON value, as JSON.parse takes it. Spark's parsers stop at the value's end whatever follows, so the text is read as one of two items: a mark that it can't hold must be the other."""
    mark = F.sha2(text, 256)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    items = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", strict)
    return F.coalesce((F.size(items) == 2) & (F.get(items, F.lit(1)) == mark), F.lit(False))


def audit_config(configs: DataFrame, tools: list[str]) -> DataFrame:
    """path, category, severity of findings in agent configurations (path, text): invalid JSON, no policy, waste of tokens, risky phrases, unknown tools."""
    tokens = estimate_tokens(F.col("text"))
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(r"tool:([a-z_]+)"), F.lit(1)))
    known = F.array(*map(F.lit, tools)) if tools else F.array().cast("array<string>")
    rules = [
        (F.endswith("path", F.lit(".json")) & ~is_json(F.col("text")), "invalid_json", F.lit("high")),
        (~F.lower("text").rlike("policy|must not|never"), "missing_policy", F.lit("medium")),
        (tokens > 4000, "token_waste", F.when(tokens > 8000, "high").otherwise("medium")),
        (F.lower("text").rlike(r"read (the )?(whole|entire) (repo|codebase)|disable (the )?sandbox"), "anti_pattern", F.lit("high")),
        (F.size(F.array_except(named, known)) > 0, "unknown_tool", F.lit("low")),
    ]
    each = F.filter(F.array(*(F.when(test, F.struct(F.lit(name).alias("category"), sev.alias("severity"))) for test, name, sev in rules)), lambda x: x.isNotNull())
    return configs.select("path", F.explode(each).alias("x")).select("path", "x.*")


def signal_share(flags: list[Column]) -> Column:
    """The percentage of signals that are set, to one digit."""
    total = reduce(lambda a, b: a + b, (F.coalesce(f, F.lit(False)).cast("int") for f in flags))
    return F.floor(1000.0 * total / len(flags) + 0.5).cast("double") / 10


def human(n: Column) -> Column:
    """A number in thousands or millions with one digit."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", half_up(n / 1_000_000.0, 1)), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", half_up(n / 1000.0, 1)), F.lit("k"))).otherwise(n.cast("long").cast("string"))


def safe_path(path: Column, roots: list[str]) -> Column:
    """Whether an absolute path is below an allowed root and not a whole drive, home or system folder."""
    below = reduce(lambda a, b: a | b, ((path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots)) if roots else F.lit(True)
    broad = path.rlike(r"^(/|/home|/home/[^/]+|/root|/usr|/etc|/var|/opt|/tmp|[A-Za-z]:[\\/]?)$")
    return below & ~broad & ~path.rlike(r"(^|/)\.\.(/|$)")


def compact_text(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """line: a header, then one tab-separated row for each row, for a compact text of a result (in the order of a column)."""
    return rows.orderBy(order).select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def newest(df: DataFrame, by: str, value: str, ts: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(value, F.struct(ts, value)).alias(value))


def memory_summary(events: DataFrame) -> DataFrame:
    """type, n, last (summary) of memory events (id, ts, type, summary)."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.max_by("summary", F.struct("ts", "id")).alias("last"))


#: How the paths of test files are told.
TEST_FILES = ["%/tests/%", "%.test.%", "%.spec.%", r"%\_test.%"]


def test_file(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.like(p) for p in TEST_FILES))


def without_names(df: DataFrame, name: str, excluded: list[str]) -> DataFrame:
    return df.where(~F.col(name).isin(excluded))


def glob(c: Column, pattern: str) -> Column:
    """Whether a value fits a pattern of ``*`` and ``?``, upper and lower case apart."""
    return c.rlike("^" + "".join({"*": ".*", "?": "."}.get(x, x if x.isalnum() else "\\" + x) for x in pattern) + "$")


def visible(tools: DataFrame, hidden: list[str], least: float, width: int = 80) -> DataFrame:
    """id, name, summary (cut to a width) of tools (id, name, summary, group, tier) outside hidden groups and of a tier at least."""
    shown = tools.where(~F.col("group").isin(hidden) & (F.col("tier") >= least))
    return shown.select("id", "name", F.substr("summary", F.lit(1), F.lit(width)).alias("summary"))


def completeness(stats: DataFrame) -> DataFrame:
    """The percentage of symbols (one row: symbols, blindspots) that no blind spot stands against, 0 at least; without symbols 0."""
    share = F.when(F.col("symbols") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 100 - 100.0 * F.col("blindspots") / F.col("symbols")))
    return stats.select(F.round(share, 3).alias("completeness"))


def token_savings(rows: DataFrame) -> DataFrame:
    """whole, snippets, reduction (percent): tokens, a quarter of the characters each, of rows (text, snippet)."""
    of = lambda c: F.coalesce(F.sum(F.floor(F.length(c) / 4)), F.lit(0))
    x = rows.agg(of("text").alias("whole"), of("snippet").alias("snippets"))
    return x.withColumn("reduction", F.when(F.col("whole") == 0, F.lit(0.0)).otherwise(F.round(100.0 * (1 - F.col("snippets") / F.col("whole")), 3)))


def run_totals(runs: DataFrame) -> DataFrame:
    """runs, baseline, payload, reduction (percent), factor over runs (baseline, payload)."""
    x = runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("baseline"), F.lit(0.0)).alias("baseline"), F.coalesce(F.sum("payload"), F.lit(0.0)).alias("payload"))
    share = F.when(F.col("baseline") == 0, F.lit(0.0)).otherwise(100 * (1 - F.col("payload") / F.col("baseline")))
    return x.withColumns({"reduction": share, "factor": F.when(F.col("payload") == 0, F.lit(0.0)).otherwise(F.col("baseline") / F.col("payload"))})


def run_anomalies(runs: DataFrame, slow: float) -> DataFrame:
    """run, anomalies of runs (run, baseline, payload, ms) that have any: no_baseline, payload_over_baseline, slow."""
    found = F.concat_ws(",", F.when(F.col("baseline") == 0, "no_baseline"), F.when(F.col("payload") > F.col("baseline"), "payload_over_baseline"), F.when(F.col("ms") > slow, "slow"))
    return runs.select("run", found.alias("anomalies")).where("anomalies <> ''")


def staged(rows: DataFrame, limit: int = 25) -> DataFrame:
    """The first rows (id, intent, exports) by intent and exports, highest first."""
    return rows.orderBy(F.desc("intent"), F.desc("exports"), "id").limit(limit)


def args_hash(**args: Column) -> Column:
    """16 hexadecimal digits that stand for named arguments, whatever their order."""
    return F.substr(F.sha2(F.to_json(F.struct(*(args[k].alias(k) for k in sorted(args)))), 256), F.lit(1), F.lit(16))


def uptime(seconds: Column) -> Column:
    """Seconds as hours and minutes, minutes and seconds, or seconds."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    part = lambda n, of: F.floor((seconds % n) / of).cast("long").cast("string")
    return F.when(seconds >= 3600, F.concat(whole(3600), F.lit("h "), part(3600, 60), F.lit("m"))).when(seconds >= 60, F.concat(whole(60), F.lit("m "), part(60, 1), F.lit("s"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def ordered_unique(rows: DataFrame) -> DataFrame:
    """key, values: the different values of each key in the order (at) in which they first came."""
    first = rows.groupBy("key", "value").agg(F.min("at").alias("at"))
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def pool(*channels: DataFrame) -> DataFrame:
    """id of everything that any channel (id) found, once."""
    return reduce(lambda a, b: a.unionByName(b), channels).distinct()


#: Types of events that the memory takes.
EVENT_TYPES = ["view", "click", "purchase", "signup", "error", "query", "edit", "decision", "handoff"]


def memory_events(events: DataFrame, most: int = 1000) -> DataFrame:
    """Events (type, summary, ...) as the memory keeps them: known types only, secrets replaced, summaries cut."""
    clean = reduce(lambda t, p: F.regexp_replace(t, p, MARK), SECRETS, F.col("summary"))
    return events.where(F.col("type").isin(EVENT_TYPES)).withColumn("summary", F.substr(clean, F.lit(1), F.lit(most)))


def memory_paths(events: DataFrame, last: int = 10) -> DataFrame:
    """type, n, last_paths: counts, and the paths of the ``last`` latest events (id, ts, type, path) of each type, newest first."""
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("ts"), F.desc("id")))
    counts = events.groupBy("type").agg(F.count("*").alias("n"))
    top = events.withColumn("p", place).where(F.col("p") <= last)
    paths = top.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "path"))), lambda x: x["path"]).alias("last_paths"))
    return counts.join(paths, "type", "left")


def ledger_artifacts(ledger: DataFrame, folder: str) -> list[str]:
    """Writes a ledger (file_id, kind, state, confidence, reason, resolver_used): all rows, the blocking ones and the named gaps as lines of JSON, totals by state and by kind, and a table in Markdown; the six folders."""
    from strataforge.operators.decisions import BLOCKING, gap_counts

    rows = ledger.persist()
    by = lambda c: rows.groupBy(c).agg(F.count("*").alias("n"))
    table = by("state").select(F.concat(F.lit("| "), "state", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("value"))
    out = {"ledger": rows, "blocking": rows.where(F.col("state").isin(BLOCKING)), "gaps": gap_counts(rows), "by_state": by("state"), "by_kind": by("kind")}
    for name, x in out.items():
        x.write.json(f"{folder}/{name}")
    table.write.text(f"{folder}/summary.md")
    rows.unpersist()
    return [f"{folder}/{x}" for x in (*out, "summary.md")]


def brief(gate: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row to resume a session with: risk, health (90 low risk, 65 medium, 35 high, 0 without files), what is forbidden, the next action.

    gate: a row of decisions.risk_gate(); coverage: a row of decisions.coverage().
    """
    x = gate.crossJoin(coverage.select("blocking_gaps", "unresolved_source"))
    health = F.when(~F.col("suggestion_allowed"), 0).when(F.col("risk") == "LOW", 90).when(F.col("risk") == "MEDIUM", 65).otherwise(35)
    rules = [(~F.col("destructive_allowed"), "delete"), (~F.col("destructive_allowed"), "rename"), (~F.col("repair_allowed"), "repair"), (~F.col("suggestion_allowed"), "suggest")]
    forbidden = F.concat_ws(",", *(F.when(test, name) for test, name in rules))
    action = F.when(~F.col("suggestion_allowed"), "index the project").when(F.col("blocking_gaps") > 0, "resolve blocking gaps").when(F.col("risk") != "LOW", "review warnings").otherwise("continue")
    return x.select("risk", health.alias("health"), forbidden.alias("forbidden"), action.alias("next_action"))


def recent_events(events: DataFrame, now: Column, hours: float = 6.0) -> DataFrame:
    """Events (ts, ...) that are not older than so many hours, nor in the future."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where((age >= 0) & (age <= int(hours * 3_600_000_000)))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows of both: those of the parents (key) that were read again from ``new`` alone, all others as they were."""
    return old.join(parents.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))
