"""Queries of file trees: tables written out as files, and read back by the sources."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from strataforge.operators import indexing, parsing
from strataforge.operators import tabular as T
from strataforge.plans.catalogue import register
from strataforge.plans.sources import _scratch
from strataforge.plans.tabular import _profile_sql, read
from strataforge.sources import files as S

#: Where a document stands in the tree, by its id modulo 8; every 97th is one long line of over 512 KB.
_WHERE = ["src/m{}/f{}.ts", "node_modules/p{}/f{}.ts", "docs/m{}/f{}.md", "src/m{}/f{}.min.js", "coverage/m{}/f{}.py", "lib/m{}/tmp_f{}.py", "app/m{}/out/f{}.go", "pkg/m{}/f{}.py"]
_STATUS = ["authored", "excluded_dir", "unsupported_ext", "generated", "excluded_dir", "ignored", "excluded_dir", "authored"]
_PATHS = " ".join(f"WHEN {k} THEN " + "'" + w.replace("{}", "' || doc_id % 5 || '", 1).replace("{}", "' || doc_id || '") + "'" for k, w in enumerate(_WHERE))
_STATES = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_STATUS))
_LONG = 600_000
TREE = f"SELECT doc_id, path, size, CASE WHEN status = 'authored' AND size = 0 THEN 'empty' WHEN status = 'authored' AND doc_id % 97 = 0 THEN 'minified' ELSE status END AS status FROM (SELECT doc_id, CASE doc_id % 8 {_PATHS} END AS path, CASE doc_id % 8 {_STATES} END AS status, CASE WHEN doc_id % 97 = 0 THEN {_LONG} ELSE octet_length(encode(coalesce(text, ''))) END::BIGINT AS size FROM documents)"


def tree(spark, d) -> str:
    """The documents as a tree of files; its root."""
    root, n = _scratch(spark, "tree"), F.col("doc_id").cast("string")
    path = None
    for k, w in enumerate(_WHERE):
        a, b, c = w.split("{}")
        own = F.concat(F.lit(a), (F.col("doc_id") % 5).cast("string"), F.lit(b), n, F.lit(c))
        path = F.when(F.col("doc_id") % 8 == k, own) if path is None else path.when(F.col("doc_id") % 8 == k, own)
    content = F.when(F.col("doc_id") % 97 == 0, F.repeat(F.lit("x"), F.lit(_LONG))).otherwise(F.coalesce("text", F.lit("")))
    S.write_tree(read(spark, d, "documents").select(path.alias("path"), content.alias("content")), root)
    return root


def _scan(spark, d):
    return S.scan(spark, tree(spark, d), patterns=["/tmp_*"])


@register("tree_scan", f"SELECT path, size, status FROM ({TREE})")
def tree_scan(spark, d):
    return _scan(spark, d).select("path", "size", "status")


@register("tree_stats", f"SELECT count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, ceil(sum(size) / 4)::BIGINT AS tokens FROM ({TREE}) WHERE status = 'authored'")
def tree_stats(spark, d):
    return S.source_stats(_scan(spark, d))


@register("tree_exclusions", f"SELECT CASE doc_id % 8 WHEN 1 THEN 'node_modules' WHEN 4 THEN 'coverage' ELSE 'app/m' || doc_id % 5 || '/out' END AS folder, 'excluded_dir' AS reason, count(*)::BIGINT AS files FROM ({TREE}) WHERE status = 'excluded_dir' GROUP BY 1")
def tree_exclusions(spark, d):
    return S.exclusions(_scan(spark, d))


@register("skipped_by_reason", f"SELECT status AS reason, count(*)::BIGINT AS n FROM ({TREE}) WHERE status <> 'authored' GROUP BY 1")
def skipped_by_reason(spark, d):
    return _scan(spark, d).where("status <> 'authored'").groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("n"))


ENTRY = "SELECT 'n' || s_nationkey || '.zip' AS archive, s_suppkey AS k, s_name AS name FROM supplier"


@register("archive_entries", f"SELECT archive, 'a/s' || k || '.txt' AS entry, length(name)::BIGINT AS size, NULL AS skipped, name AS text FROM ({ENTRY}) UNION ALL SELECT archive, '../s' || k || '.txt', length(name)::BIGINT, 'unsafe_path', NULL FROM ({ENTRY}) WHERE k % 3 = 0 UNION ALL SELECT archive, '__MACOSX/s' || k, length(name)::BIGINT, 'junk', NULL FROM ({ENTRY}) WHERE k % 4 = 0")
def archive_entries(spark, d):
    """An archive for each nation, an entry or more for each supplier, some of them unsafe or junk."""
    root = _scratch(spark, "archives")

    def pack(rows):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, name in sorted(zip(rows.s_suppkey, rows.s_name, strict=True)):
                z.writestr(f"a/s{k}.txt", name)
                if k % 3 == 0:
                    z.writestr(f"../s{k}.txt", name)
                if k % 4 == 0:
                    z.writestr(f"__MACOSX/s{k}", name)
        return pd.DataFrame({"path": [f"n{rows.s_nationkey.iloc[0]}.zip"], "content": [out.getvalue()]})

    S.write_tree(read(spark, d, "supplier").groupBy("s_nationkey").applyInPandas(pack, "path string, content binary"), root)
    x = S.read_archives(spark, root)
    return x.select(F.substring_index("archive", "/", -1).alias("archive"), "entry", "size", "skipped", F.col("content").cast("string").alias("text"))


@register("archive_safe_paths", f"SELECT archive, count(*)::BIGINT AS n FROM (SELECT archive FROM ({ENTRY}) UNION ALL SELECT archive FROM ({ENTRY}) WHERE k % 4 = 0) GROUP BY 1")
def archive_safe_paths(spark, d):
    return S.safe_entries(archive_entries(spark, d)).groupBy("archive").agg(F.count("*").alias("n"))


def _projects(spark, d) -> str:
    """A project folder for each supplier: a package, a Python project, a crate or a Go module, with a barrel and settings."""
    root, k = _scratch(spark, "projects"), F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 4
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    rows = [
        (kind == 0, "package.json", say('{ // the package\n "name": "pkg-', k, '", "dependencies": {"react": "1", "left-', k, '": "2"} }')),
        (kind == 0, "src/index.ts", say("export * from './a", k, "';\nexport { b } from './b';\nconst c = 1;\n")),
        (kind == 1, "pyproject.toml", say('[project]\nname = "py-', k, '"\n')),
        (kind == 1, "src/index.ts", say("const only = ", k, ";\n")),
        (kind == 2, "Cargo.toml", say('[package]\nname = "crate-', k, '"\n')),
        (kind == 3, "go.mod", say("module example.com/m", k, "\n\nrequire example.com/x/y v1.2.3\n")),
        (F.col("s_suppkey") % 5 == 0, "skills/s/SKILL.md", say("---\nname: skill-", k, "\ndescription: does ", k, "\n---\nbody\n")),
    ]
    each = F.filter(F.array(*(F.when(test, F.struct(say("p", k, "/", name).alias("path"), text.alias("content"))) for test, name, text in rows)), lambda x: x.isNotNull())
    S.write_tree(read(spark, d, "supplier").select(F.explode(each).alias("x")).select("x.*"), root)
    return root


def _files(spark, d):
    root = _projects(spark, d)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(S.below(root, F.col("path")).alias("path"), "content")


_P = "'p' || s_suppkey || '/"
MANIFEST = f"SELECT {_P}' || CASE s_suppkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pyproject.toml' WHEN 2 THEN 'Cargo.toml' ELSE 'go.mod' END AS path, CASE s_suppkey % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'pyproject' WHEN 2 THEN 'cargo' ELSE 'go' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'pkg-' WHEN 1 THEN 'py-' WHEN 2 THEN 'crate-' ELSE 'example.com/m' END || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN 'left-' || s_suppkey || ',react' WHEN 3 THEN 'example.com/x/y' ELSE '' END AS dependencies FROM supplier"


@register("manifest_scan", MANIFEST)
def manifest_scan(spark, d):
    return S.manifests(_files(spark, d)).withColumn("dependencies", F.array_join("dependencies", ","))


@register("stack_detection", f"SELECT path, CASE WHEN kind = 'package' THEN 'react' ELSE '' END AS frameworks FROM ({MANIFEST})")
def stack_detection(spark, d):
    return S.frameworks(S.manifests(_files(spark, d))).withColumn("frameworks", F.array_join("frameworks", ","))


@register("barrel_exports", f"SELECT {_P}src/index.ts' AS path, './a' || s_suppkey || ',./b' AS exports FROM supplier WHERE s_suppkey % 4 = 0")
def barrel_exports(spark, d):
    return S.barrels(_files(spark, d)).withColumn("exports", F.array_join("exports", ","))


@register("project_discovery", "SELECT 'p' || s_suppkey AS root, CASE s_suppkey % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' ELSE 'go' END AS kind FROM supplier")
def project_discovery(spark, d):
    return S.projects(_files(spark, d).select("path"))


CONFIGS = ["package.json", "pyproject.toml", "Cargo.toml", "go.mod", "tsconfig.json", "Dockerfile"]


@register("config_presence", "SELECT unnest(['package.json', 'pyproject.toml', 'Cargo.toml', 'go.mod', 'tsconfig.json', 'Dockerfile']) AS name, unnest([count_if(s_suppkey % 4 = 0) > 0, count_if(s_suppkey % 4 = 1) > 0, count_if(s_suppkey % 4 = 2) > 0, count_if(s_suppkey % 4 = 3) > 0, false, false]) AS present FROM supplier")
def config_presence(spark, d):
    return S.config_map(_files(spark, d).select("path"), CONFIGS)


@register("skill_folders", f"SELECT 'skill-' || s_suppkey AS name, 'does ' || s_suppkey AS description, {_P}skills/s/SKILL.md' AS path, (length('---name: skill-description: does ---body') + 2 * length(s_suppkey::VARCHAR) + 5)::INTEGER AS size FROM supplier WHERE s_suppkey % 5 = 0")
def skill_folders(spark, d):
    return S.skills(_files(spark, d))


HEADS = "SELECT p_partkey, 'h' || p_partkey % 7 AS title FROM part"


def _markdown(spark, d):
    root, k = _scratch(spark, "markdown"), F.col("p_partkey").cast("string")
    folder = F.when(F.col("p_partkey") % 6 == 0, "node_modules/").when(F.col("p_partkey") % 6 == 1, ".hidden/").otherwise("docs/")
    name = F.when(F.col("p_partkey") % 2 == 0, ".md").otherwise(".txt")
    title = F.concat(F.lit("h"), (F.col("p_partkey") % 7).cast("string"))
    text = F.concat(F.lit("# Part "), k, F.lit("\n\n```\n# no heading\n```\n## "), title, F.lit("\ntext\n### deep\n"))
    S.write_tree(read(spark, d, "part").select(F.concat(folder, F.lit("f"), k, name).alias("path"), text.alias("content")), root)
    return S.sections(S.markdown_tree(spark, root))


MD = "SELECT p_partkey AS k, 'docs/f' || p_partkey || '.md' AS file FROM part WHERE p_partkey % 6 IN (2, 4)"


@register("markdown_tree", f"SELECT file, title, level::INTEGER AS level, line::INTEGER AS line, last::INTEGER AS last, slug FROM (SELECT file, 'Part ' || k AS title, 1 AS level, 1 AS line, 9 AS last, 'part-' || k AS slug FROM ({MD}) UNION ALL SELECT file, 'h' || k % 7, 2, 6, 9, 'h' || k % 7 FROM ({MD}) UNION ALL SELECT file, 'deep', 3, 8, 9, 'deep' FROM ({MD}))")
def markdown_tree(spark, d):
    return _markdown(spark, d)


@register("table_of_contents", f"SELECT file, '- Part ' || k || chr(10) || '  - h' || k % 7 || chr(10) || '    - deep' AS toc FROM ({MD})")
def table_of_contents(spark, d):
    return S.table_of_contents(_markdown(spark, d))


@register("heading_search", f"SELECT file, 'h' || k % 7 AS title, 6::INTEGER AS line FROM ({MD}) WHERE k % 7 = 3 ORDER BY file LIMIT 50")
def heading_search(spark, d):
    return S.search_headings(_markdown(spark, d), "H3").select("file", "title", "line")


@register("section_by_id", f"SELECT file, 'deep' AS slug, 8::INTEGER AS line FROM ({MD}) WHERE k = (SELECT min(k) FROM ({MD}))")
def section_by_id(spark, d):
    first = read(spark, d, "part").where("p_partkey % 6 IN (2, 4)").agg(F.concat(F.lit("docs/f"), F.min("p_partkey").cast("string"), F.lit(".md")).alias("file"))
    return _markdown(spark, d).where("slug = 'deep'").join(F.broadcast(first), "file", "left_semi").select("file", "slug", "line")


CSV = {"c_custkey": "number", "c_name": "string", "c_acctbal": "number", "flag": "boolean"}
CSV_SQL = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, (c_custkey % 2 = 0)::VARCHAR AS flag FROM customer"


def _csv(spark, d):
    path = _scratch(spark, "csv")
    x = read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"), (F.col("c_custkey") % 2 == 0).cast("string").alias("flag"))
    x.write.option("header", True).csv(path)
    return S.load_csv(spark, path)


@register("csv_profile", _profile_sql(CSV_SQL, CSV))
def csv_profile(spark, d):
    """Cells of a CSV are strings, blank where a value is missing: types come from the cells."""
    return T.profile(_csv(spark, d))


@register("csv_types", "SELECT 'c_custkey' AS name, CASE WHEN count_if(TRY_CAST(c_custkey::VARCHAR AS DOUBLE) IS NULL) = 0 THEN 'number' ELSE 'string' END AS type FROM customer UNION ALL SELECT 'c_name', CASE WHEN count_if(TRY_CAST(c_name AS DOUBLE) IS NULL) = 0 THEN 'number' ELSE 'string' END FROM customer UNION ALL SELECT 'c_acctbal', CASE WHEN count_if(TRY_CAST(c_acctbal::VARCHAR AS DOUBLE) IS NULL) = 0 THEN 'number' ELSE 'string' END FROM customer UNION ALL SELECT 'flag', CASE WHEN count_if((c_custkey % 2 = 0)::VARCHAR NOT IN ('true', 'false')) = 0 THEN 'boolean' ELSE 'string' END FROM customer")
def csv_types(spark, d):
    return T.infer_types(_csv(spark, d))


@register("tail_log", "SELECT (row_number() OVER (ORDER BY event_id DESC) - 1)::INTEGER AS line, text FROM (SELECT event_id, text, sum(length(text) + 1) OVER (ORDER BY event_id DESC) AS upto, sum(length(text) + 1) OVER () AS whole FROM (SELECT event_id, event_id || ' ' || event_type || ' of user ' || user_id AS text FROM events)) WHERE whole <= 262144 OR upto < 262144")
def tail_log(spark, d):
    """The last whole lines in the last 256 KB of a log of all events, newest first."""
    root = _scratch(spark, "log")
    text = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", F.lit("of user"), F.col("user_id").cast("string"))
    read(spark, d, "events").select("event_id", text.alias("text")).orderBy("event_id").select("text").coalesce(1).write.text(root)
    part = spark.read.format("binaryFile").load(root).select("path").first()[0]
    return S.read_tail(spark, part.replace("file:/", "file:///", 1) if part.startswith("file:/") and not part.startswith("file:///") else part)


@register("merged_config", "SELECT coalesce(n.n_name, r.r_name) AS key, coalesce(CASE WHEN r_regionkey % 2 = 0 THEN 'env' || r_regionkey END, 'file' || n_nationkey) AS value, CASE WHEN r_regionkey % 2 = 0 THEN 'env' ELSE 'file' END AS origin FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation) n LEFT JOIN region r ON n.n_nationkey = r.r_regionkey")
def merged_config(spark, d):
    """Nations as options of a file; the environment has some of the first ones, blank where odd."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    env = n.join(r, n["n_nationkey"] == r["r_regionkey"]).select(F.col("n_name").alias("key"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("env"), F.col("r_regionkey").cast("string"))).otherwise(" ").alias("value"))
    return S.merged_config(n.select(F.col("n_name").alias("key"), F.concat(F.lit("file"), F.col("n_nationkey").cast("string")).alias("value")), env)


#: A file of each language: what it says of a name, and the symbol, import and call that are in it.
SAYS = {
    "ts": ("import { x } from './x%';\nexport function run_%(a) {\n  return help_%(a);\n}\n", "run_%", "function", "./x%"),
    "py": ("import base.m%\n\nclass C_%:\n    pass\n\ny = help_%(1)\n", "C_%", "class", "base.m%"),
    "rs": ("use std::m%;\npub fn run_%() {\n    help_%();\n}\n", "run_%", "function", "std::m%"),
    "go": ('import "m%"\nfunc Run_%() {\n\thelp_%()\n}\n', "Run_%", "function", "m%"),
    "java": ("import a.b%;\npublic class C_% {\n  int x = help_%();\n}\n", "C_%", "class", "a.b%"),
    "kt": ("import a.b%\nfun run_%() {\n  help_%()\n}\n", "run_%", "function", "a.b%"),
    "cs": ("using A.B%;\npublic class C_% {\n  int x = help_%();\n}\n", "C_%", "class", "A.B%"),
    "swift": ("import M%\nfunc run_%() {\n  help_%()\n}\n", "run_%", "function", "M%"),
    "php": ("require 'm%.php';\nfunction run_%() {\n  help_%();\n}\n", "run_%", "function", "m%.php"),
    "rb": ("require 'm%'\ndef run_%\n  help_%(1)\nend\n", "run_%", "function", "m%"),
    "c": ("#include <m%.h>\nint run_%(int a)\n{\n  help_%(a);\n}\n", "run_%", "function", "m%.h"),
    "sol": ("import './m%.sol';\ncontract C_% {\n  uint x = help_%();\n}\n", "C_%", "contract", "./m%.sol"),
    "lua": ("local m = require('m%')\nfunction run_%()\n  help_%()\nend\n", "run_%", "function", "m%"),
    "zzz": ("nothing that is known %", None, None, None),
}


def _sql(c: str) -> str:
    return "replace('" + c.replace("'", "''") + "', '%', k)"


_KEYS = "SELECT s_suppkey::VARCHAR AS k FROM supplier"
LANGUAGES_SQL = " UNION ALL ".join(
    f"SELECT 'f' || k || '.{e}' AS path, 'symbol' AS what, {_sql(name)} AS name, '{kind}' AS kind FROM ({_KEYS}) UNION ALL SELECT 'f' || k || '.{e}', 'import', {_sql(target)}, 'import' FROM ({_KEYS}) UNION ALL SELECT 'f' || k || '.{e}', 'call', 'help_' || k, 'call' FROM ({_KEYS})" if name else f"SELECT 'f' || k || '.{e}', 'diagnostic', 'UNSUPPORTED_EXTENSION', 'error' FROM ({_KEYS})"
    for e, (_, name, kind, target) in SAYS.items()
)


@register("parse_languages", LANGUAGES_SQL)
def parse_languages(spark, d):
    """A file of each language for each supplier."""
    k = F.col("s_suppkey").cast("string")
    each = F.array(*(F.struct(F.concat(F.lit("f"), k, F.lit(f".{e}")).alias("path"), F.replace(F.lit(text), F.lit("%"), k).alias("text")) for e, (text, *_) in SAYS.items()))
    rows = parsing.parse_files(read(spark, d, "supplier").select(F.explode(each).alias("x")).select("x.*"))
    return rows.where("NOT (what = 'call' AND name NOT LIKE 'help%')").select("path", "what", "name", "kind")


@register("parse_quality", "SELECT 'py' AS ext, 1.0::DOUBLE AS quality UNION ALL SELECT unnest(['ts', 'rs', 'go', 'java', 'kt', 'cs', 'swift', 'php', 'rb', 'c', 'sol', 'lua']), 0.68::DOUBLE UNION ALL SELECT 'zzz', 0.0::DOUBLE")
def parse_quality(spark, d):
    each = F.array(*(F.struct(F.lit(f"f.{e}").alias("path"), F.replace(F.lit(text), F.lit("%"), F.lit("1")).alias("text")) for e, (text, *_) in SAYS.items()))
    rows = parsing.parse_files(spark.range(1).select(F.explode(each).alias("x")).select("x.*"))
    return rows.groupBy(F.substring_index("path", ".", -1).alias("ext")).agg(F.max("quality").alias("quality"))


@register("language_registry", "SELECT * FROM (VALUES ('.ts', 'javascript'), ('.tsx', 'javascript'), ('.js', 'javascript'), ('.jsx', 'javascript'), ('.mjs', 'javascript'), ('.cjs', 'javascript'), ('.py', 'python'), ('.rs', 'rust'), ('.go', 'go'), ('.java', 'java'), ('.kt', 'kotlin'), ('.cs', 'csharp'), ('.swift', 'swift'), ('.php', 'php'), ('.rb', 'ruby'), ('.c', 'c'), ('.h', 'c'), ('.cpp', 'c'), ('.hpp', 'c'), ('.sol', 'solidity'), ('.lua', 'lua')) t(extension, language)")
def language_registry(spark, d):
    return parsing.registry(spark).select("extension", "language")


def _modules(spark, d, edited: bool) -> str:
    """A Python file for each part that imports the next one; edited: every fifth one changed, every seventh one gone."""
    root, k = _scratch(spark, "modules"), F.col("p_partkey")
    p = read(spark, d, "part").select("p_partkey").where(k % 7 != 0) if edited else read(spark, d, "part").select("p_partkey")
    name = F.concat(F.when((k % 5 == 0) & F.lit(edited), F.lit("new_")).otherwise("old_"), k.cast("string"))
    text = F.concat(F.lit("from ./f"), (k + 1).cast("string"), F.lit(" import x\nimport {y} from './f"), (k + 1).cast("string"), F.lit("'\nfunction "), name, F.lit("() { return 1 }\n"))
    p = p.repartition(2 * spark.sparkContext.defaultParallelism)  # ids are dealt out, so that all tasks write
    S.write_tree(p.select(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".ts")).alias("path"), text.alias("content")), root)
    return root


def _indexed(spark, d):
    first = indexing.index_tree(spark, _modules(spark, d, False), _scratch(spark, "index"))
    return first, indexing.index_tree(spark, _modules(spark, d, True), _scratch(spark, "index"), first)


@register("index_incremental", "SELECT 'src/f' || p_partkey || '.ts' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'new_' ELSE 'old_' END || p_partkey AS name, CASE WHEN (p_partkey + 1) % 7 <> 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part) THEN 'src/f' || (p_partkey + 1) || '.ts' END AS target FROM part WHERE p_partkey % 7 <> 0")
def index_incremental(spark, d):
    """A tree indexed, then changed and indexed again: symbols and resolved links as of the second run."""
    _, now = _indexed(spark, d)
    symbols = now.facts.where("what = 'symbol'").select("path", "name")
    return symbols.join(now.links.select("path", "target"), "path", "left")


@register("index_runs", "SELECT count(*)::BIGINT AS first, count_if(p_partkey % 5 = 0 AND p_partkey % 7 <> 0)::BIGINT AS second, count_if(p_partkey % 7 <> 0)::BIGINT AS files FROM part")
def index_runs(spark, d):
    """How many files each run had to parse."""
    first, now = _indexed(spark, d)
    return spark.createDataFrame([(first.parsed, now.parsed)], "first long, second long").crossJoin(now.files.agg(F.count("*").alias("files")))
