"""Source files to symbols, calls and imports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESERVED = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "class", "def", "import", "export", "await", "async", "super", "print"}
NAME = r"[A-Za-z_$][\w$]*"
#: For each language, patterns of symbols (kind, pattern with the name in group 1) and of imports (target in group 1).
LANGUAGES: dict[str, tuple[list[tuple[str, str]], list[str]]] = {
    "javascript": (
        [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({NAME})"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({NAME})"), ("interface", rf"^\s*(?:export\s+)?interface\s+({NAME})"), ("type", rf"^\s*(?:export\s+)?type\s+({NAME})\s*="), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*=>")],
        [r"""(?:import|export)\s[^'";]*?from\s*['"]([^'"]+)""", r"""import\s*['"]([^'"]+)""", r"""(?:require|import)\(\s*['"]([^'"]+)"""],
    ),
    "python": ([("function", rf"^\s*(?:async\s+)?def\s+({NAME})"), ("class", rf"^\s*class\s+({NAME})")], [r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+(\.*[\w.]*)\s+import"]),
    "rust": ([("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+({NAME})"), ("struct", rf"^\s*(?:pub\s+)?struct\s+({NAME})"), ("enum", rf"^\s*(?:pub\s+)?enum\s+({NAME})"), ("trait", rf"^\s*(?:pub\s+)?trait\s+({NAME})")], [r"(?m)^\s*(?:pub\s+)?use\s+([^;{]+)", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"]),
    "go": ([("function", rf"^func\s+(?:\([^)]*\)\s*)?({NAME})"), ("type", rf"^type\s+({NAME})")], [r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$']),
    "java": (
        [("class", rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+({NAME})"), ("method", rf"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+({NAME})\s*\(")],
        [r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)"],
    ),
    "kotlin": (
        [("class", rf"^\s*(?:(?:public|private|internal|open|abstract|sealed|data|enum|inner)\s+)*(?:class|interface|object)\s+({NAME})"), ("function", rf"^\s*(?:(?:public|private|internal|override|suspend|inline|open|operator)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?({NAME})")],
        [r"(?m)^\s*import\s+([\w.*]+)"],
    ),
    "csharp": (
        [("class", rf"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|enum|record)\s+({NAME})"), ("method", rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],.? ]+\s+({NAME})\s*\(")],
        [r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"],
    ),
    "swift": (
        [("class", rf"^\s*(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?:class|struct|enum|protocol|actor|extension)\s+({NAME})"), ("function", rf"^\s*(?:(?:public|private|internal|open|static|override|mutating|final)\s+)*func\s+({NAME})")],
        [r"(?m)^\s*(?:@testable\s+)?import\s+(?:(?:class|struct|func|enum)\s+)?([\w.]+)"],
    ),
    "php": ([("function", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+({NAME})"), ("class", rf"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+({NAME})")], [r"""(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)""", r"(?m)^\s*use\s+([\w\\]+)"]),
    "ruby": ([("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"), ("class", rf"^\s*(?:class|module)\s+({NAME})")], [r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)"""]),
    "c": ([("struct", rf"^\s*(?:typedef\s+)?(?:struct|class|enum)\s+({NAME})"), ("function", rf"^[A-Za-z_][\w\s*&:<>,]*?\b({NAME})\s*\([^;]*$")], [r'(?m)^\s*#\s*include\s+[<"]([^>"]+)']),
    "solidity": ([("contract", rf"^\s*(?:abstract\s+)?(?:contract|library|interface)\s+({NAME})"), ("function", rf"^\s*function\s+({NAME})")], [r"""import\s[^'"]*['"]([^'"]+)"""]),
    "lua": ([("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")], [r"""require\s*\(?\s*['"]([^'"]+)"""]),
}
#: The language of each extension.
BY_EXTENSION = {"ts": "javascript", "tsx": "javascript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "swift": "swift", "php": "php", "rb": "ruby", "c": "c", "h": "c", "cpp": "c", "hpp": "c", "sol": "solidity", "lua": "lua"}
DYNAMIC = re.compile(r"\beval\s*\(|\bgetattr\s*\(|\bReflect\.|\b__import__\s*\(|require\(\s*[^'\")]|import\(\s*[^'\")]")
CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(")


def registry(spark: SparkSession) -> DataFrame:
    """extension, language, kinds (of symbols, sorted), tree (whether it is read by a syntax tree) of all that can be parsed."""
    rows = [(f".{e}", lang, sorted({k for k, _ in LANGUAGES[lang][0]}), lang == "python") for e, lang in BY_EXTENSION.items()]
    return spark.createDataFrame(rows, "extension string, language string, kinds array<string>, tree boolean")


def parse(path: str, text: str) -> list[tuple]:
    """Rows (what, name, kind, line, owner, quality) of a file: symbols, calls (owner: the symbol that holds them), imports and diagnostics."""
    lang = BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower(), "")
    if lang == "python":
        try:
            return _python(ast.parse(text), text)
        except (SyntaxError, ValueError, RecursionError):
            pass
    if not lang:
        return [("diagnostic", "UNSUPPORTED_EXTENSION", "error", 0, None, 0.0)]
    symbols, imports = LANGUAGES[lang]
    compiled = [(k, re.compile(p)) for k, p in symbols]
    found: list[tuple[str, str, int]] = []
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        for kind, p in compiled:
            m = p.match(line)
            if m and m[1] not in RESERVED:
                found.append((m[1], kind, i))
                break
    dynamic = bool(DYNAMIC.search(text))
    quality = 0.15 if not found else 0.55 if dynamic else 0.68
    rows: list[tuple] = [("symbol", n, k, i, None, quality) for n, k, i in found]
    rows += [("import", m, "import", 0, None, quality) for m in dict.fromkeys(x.strip() for p in imports for x in re.findall(p, text))]
    starts, at = {i for _, _, i in found}, -1
    for i, line in enumerate(lines, 1):
        while at + 1 < len(found) and found[at + 1][2] <= i:
            at += 1
        for name in CALL.findall(line):
            if name not in RESERVED and not (i in starts and name == found[at][0]):
                rows.append(("call", name, "call", i, found[at][0] if at >= 0 else None, quality))
    if dynamic:
        rows.append(("diagnostic", "DYNAMIC_RUNTIME_REFERENCE", "warn", 0, None, quality))
    return rows


def _python(tree: ast.AST, text: str) -> list[tuple]:
    dynamic = bool(DYNAMIC.search(text))
    quality = max(0.35, min(1.0, 1.0 - 0.03 * dynamic))
    rows: list[tuple] = []

    def visit(node: ast.AST, owner: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            mine = owner
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                rows.append(("symbol", x.name, "class" if isinstance(x, ast.ClassDef) else "function", x.lineno, owner, quality))
                mine = x.name
            elif isinstance(x, ast.Import):
                rows.extend(("import", a.name, "import", x.lineno, None, quality) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                rows.append(("import", "." * x.level + (x.module or ""), "import", x.lineno, None, quality))
            elif isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else None
                if name and name not in RESERVED:
                    rows.append(("call", name, "call", x.lineno, owner, quality))
            visit(x, mine)

    visit(tree, None)
    if dynamic:
        rows.append(("diagnostic", "DYNAMIC_RUNTIME_REFERENCE", "warn", 0, None, quality))
    return rows


COLUMNS = ["path", "what", "name", "kind", "line", "owner", "quality"]


def parse_files(files: DataFrame) -> DataFrame:
    """The rows of parse() for files (path, text), file by file, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(path, *r) for path, text in zip(p.path, p.text, strict=True) for r in parse(path, text or "")]
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS).astype({"owner": object})

    return files.select("path", "text").mapInPandas(run, "path string, what string, name string, kind string, line int, owner string, quality double")


def resolve_specifiers(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """path, spec, target of imports (path, spec): relative ones and aliases, against files (path); null where nothing fits.

    Each import becomes its few possible files, which are matched by equality; the first that exists wins. They are never
    broadcast: Spark's estimate of their size, from compressed columns and without the explosion, is far too low for the driver.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    joined = F.when(F.startswith("spec", F.lit(".")), F.concat(folder, "spec"))
    for prefix, place in (aliases or {"@/": "src/"}).items():
        joined = F.when(F.startswith("spec", F.lit(prefix)), F.concat(F.lit(place), F.substr("spec", F.lit(len(prefix) + 1)))).otherwise(joined)
    parts = F.filter(F.split(joined, "/"), lambda x: (x != ".") & (x != ""))
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))), "/")
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
    tries = F.concat(F.array(*(F.concat("base", F.lit(e)) for e in ends)), F.array(F.regexp_replace("base", r"\.js$", ".ts"), F.regexp_replace("base", r"\.jsx$", ".tsx")))
    x = imports.select("path", "spec").distinct().withColumn("base", clean)
    each = x.where("base IS NOT NULL").select("path", "spec", F.posexplode(tries).alias("p", "target"))
    hit = each.hint("merge").join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("path", "spec").agg(F.min(F.struct("p", "target")).alias("t"))
    return x.join(hit, ["path", "spec"], "left").select("path", "spec", F.col("t.target").alias("target"))


def owners(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call (path, name, line) with the symbol (path, name, line) that starts last before it: an as-of join by a running last value."""
    both = calls.select("path", "line", F.lit(1).alias("side"), F.col("name").alias("call"), F.lit(None).cast("string").alias("sym")).unionByName(symbols.select("path", "line", F.lit(0).alias("side"), F.lit(None).cast("string").alias("call"), F.col("name").alias("sym")))
    w = Window.partitionBy("path").orderBy("line", "side")
    return both.withColumn("owner", F.last("sym", ignorenulls=True).over(w)).where("side = 1").select("path", "line", F.col("call").alias("name"), "owner")
