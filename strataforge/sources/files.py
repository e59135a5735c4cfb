"""File trees, archives, CSV, Markdown, JSON lines, manifests and skill folders as DataFrames."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from strataforge.functions.text import contained, extension
from strataforge.lineage import cut
from strataforge.operators.decisions import GENERATED, LOCK, SOURCE

IGNORED = ["node_modules", "dist", "build", ".git", ".next", "coverage", "vendor", "__pycache__", "target", "out"]
TEXTS = [".json", ".md", ".mdx", ".yaml", ".yml"]
#: Bytes looked at for the test of minified files, and the sizes beyond which files are tested or left out.
HEAD, TESTED, LARGEST = 128 << 10, 512 << 10, 8 << 20


def minified(content: Column) -> Column:
    """Whether the head of a file has no line end, a line of over 5,000 characters or over 2,000 bytes a line end."""
    head = F.substr(content.cast("binary"), F.lit(1), F.lit(HEAD)).cast("string")
    lines = F.split(head, "\n", -1)
    return (F.size(lines) == 1) | (F.array_max(F.transform(lines, F.length)) > 5000) | (F.octet_length(head) / F.greatest(F.lit(1), F.size(lines) - 1) > 2000)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path holds the core of an ignore pattern (without stars and outer slashes)."""
    out = F.lit(False)
    for p in patterns:
        core = p.replace("*", "").strip("/")
        if core:
            out = out | path.contains(core)
    return out


def below(root: str, path: Column) -> Column:
    """A file's path below a root, whatever scheme the reader writes before it."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/+", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")


def write_tree(files: DataFrame, root: str) -> int:
    """Writes files (path, content) below a root that all executors reach; how many. A task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root)
        made = None
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/{path}"
                if (folder := name.rsplit("/", 1)[0]) != made:
                    place.create_dir(folder, recursive=True)
                    made = folder
                with place.open_output_stream(name) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """file, text of the Markdown files of a tree (.md, .mdx, .markdown), but for those in hidden folders, node_modules, dist and build."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx,markdown,MD,MDX}").load(root)
    x = raw.select(below(root, F.col("path")).alias("file"), F.col("content").cast("string").alias("text"))
    return x.where(~F.col("file").rlike(r"(^|/)(\.[^/]*|node_modules|dist|build)/"))


def read_tail(spark: SparkSession, path: str, size: int = 256 << 10, limit: int | None = None) -> DataFrame:
    """line, text of the last whole lines in the last ``size`` bytes of a file, newest first, at most ``limit``. No more than that is read."""
    from pyarrow import fs

    place, name = fs.FileSystem.from_uri(path)
    with place.open_input_file(name) as f:
        start = max(0, f.size() - size)
        f.seek(start)
        data = f.read()
    lines = data.decode("utf-8", "replace").split("\n")[1 if start else 0 :]
    lines = [x for x in lines if x.strip()][::-1][:limit]
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def merged_config(file: DataFrame, env: DataFrame) -> DataFrame:
    """key, value, origin of options (key, value) of a file and of the environment, whose non-blank values win."""
    e = env.where("value IS NOT NULL AND trim(value) <> ''").select("key", F.col("value").alias("_env"))
    x = file.select("key", F.col("value").alias("_file")).join(e, "key", "full")
    return x.select("key", F.coalesce("_env", "_file").alias("value"), F.when(F.col("_env").isNotNull(), "env").otherwise("file").alias("origin"))


#: Rows of a batch of names; rows and bytes of a batch of contents.
NAMES, FILES, BYTES = 10_000, 1000, 4 << 20


def _opened(root: str) -> bool:
    """Whether Python workers can open a root: a folder of a local disk or another file system of pyarrow's."""
    from pyarrow import fs

    try:
        place, base = fs.FileSystem.from_uri(root)
        return place.get_file_info(base).type == fs.FileType.Directory
    except (OSError, ValueError):
        return False


def _width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _entries(place, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """name, whether a folder, size, modified (ms) of what is in a folder, one after another where the disk is a local one; not what Spark's readers hide."""
    from pyarrow import fs

    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    if isinstance(place, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if not hidden(x.name) and (x.is_dir() or x.is_file()):
                    at = x.stat()
                    yield x.name, x.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000
    else:
        for x in place.get_file_info(fs.FileSelector(folder)):
            if not hidden(x.base_name) and x.type in (fs.FileType.File, fs.FileType.Directory):
                yield x.base_name, x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), size, modified of all files of a tree that are not empty, but for hidden ones.

    Tasks list the folders, a level of the tree after another, so the driver holds no names, however many there are. One folder
    is one task's work. Where Python workers can't open the root, Spark's reader lists it, which does keep all names on the driver.
    """
    if not _opened(root):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return raw.select(below(root, F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "folder", "size", "ms"])
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, *rest in _entries(place, f"{base}/{folder}"):
                    rows.append((f"{folder}/{name}" if folder else name, *rest))
                    if len(rows) == NAMES:
                        yield pack(rows)
                        rows = []
        if rows:
            yield pack(rows)

    level, out = spark.createDataFrame([("",)], "path string"), None
    while out is None or not level.isEmpty():
        found = cut(level.mapInArrow(run, "path string, folder boolean, size long, ms long"))
        level = found.where("folder").select("path").repartition(_width(spark), "path")
        files = found.where("NOT folder AND size > 0")
        out = files if out is None else out.unionByName(files)
    return out.select("path", "size", F.timestamp_millis("ms").alias("modified"))


def contents(files: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """files (path below a root, ...) with content (or its first ``most`` bytes), read by tasks in batches of some MB. Only these files are opened."""
    spark = files.sparkSession
    if not _opened(root):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        content = F.col("content") if most is None else F.substr("content", F.lit(1), F.lit(most))
        return files.join(raw.select(below(root, F.col("path")).alias("path"), content.alias("content")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist(), 1):
                with place.open_input_stream(f"{base}/{path}") as f:
                    held.append(f.read(most))
                size += len(held[-1])
                if i == batch.num_rows or len(held) == FILES or size >= BYTES:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])
                    first, held, size = i, [], 0

    return files.repartition(_width(spark), "path").mapInArrow(run, StructType([*files.schema]).add("content", BinaryType()))


def scan(spark: SparkSession, root: str, *, patterns: list[str] | None = None, include_text: bool = False) -> DataFrame:
    """path (below the root), size, modified, status of all files of a tree: authored, or why not: excluded_dir, ignored, empty (where the reader lists those), unsupported_ext, generated, minified, too_large. Nothing stops a scan early; folders and files whose names begin with a dot or an underscore are not listed, as by Spark's readers. contents() reads the files."""
    x = listed(spark, root)
    # Only large files are opened, for their heads.
    heads = contents(x.where(F.col("size") > TESTED), root, HEAD).withColumn("_minified", minified(F.col("content"))).drop("content")
    x = x.where(F.col("size") <= TESTED).withColumn("_minified", F.lit(False)).unionByName(heads)
    folder = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED) + r"|\.[^/]+)/"
    known = extension(F.col("path")).isin(SOURCE + (TEXTS if include_text else []))
    status = (
        F.when(F.col("path").rlike(folder), "excluded_dir")
        .when(ignored(F.col("path"), patterns or []), "ignored")
        .when(F.col("size") == 0, "empty")
        .when(~known, "unsupported_ext")
        .when(F.lower("path").rlike(GENERATED) | F.lower("path").rlike(LOCK), "generated")
        .when(F.col("_minified"), "minified")
        .when(F.col("size") > LARGEST, "too_large")
        .otherwise("authored")
    )
    return x.withColumn("status", status).drop("_minified")


def exclusions(files: DataFrame) -> DataFrame:
    """folder, reason, files of the folders that a scan leaves out whole: the outermost one of each file."""
    folder = F.regexp_extract("path", "^((?:.*?/)??(?:" + "|".join(d.replace(".", r"\.") for d in IGNORED) + r"|\.[^/]+))/", 1)
    return files.where("status = 'excluded_dir'").groupBy(folder.alias("folder"), F.col("status").alias("reason")).agg(F.count("*").alias("files"))


def source_stats(files: DataFrame) -> DataFrame:
    """files, bytes, tokens of a scan's authored files."""
    x = files.where("status = 'authored'").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return x.withColumn("tokens", F.ceil(F.col("bytes") / 4).cast("long"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings: quotes may hold separators and line ends, rows of another length are dropped, blank cells are empty strings."""
    header = spark.read.text(path).first()
    names = next(iter(__import__("csv").reader([header[0]]))) if header else []
    schema = ", ".join(f"`{n}` string" for n in dict.fromkeys(names))
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED")
    return (raw.schema(schema) if len(set(names)) == len(names) else raw).csv(path).na.fill("")


ENTRIES = "archive string, entry string, size long, content binary, skipped string"


def read_archives(spark: SparkSession, path: str, *, most_file: int = 32 << 20, most_total: int = 512 << 20, most_files: int = 20_000) -> DataFrame:
    """One row for each entry of zip archives (.zip, .cbz, .epub, .jar): its content, or why it is skipped: unsafe_path, junk, too_large, over_limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for archive, content in zip(p.path, p.content, strict=True):
                rows, total, count = [], 0, 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = info.filename
                        if info.is_dir():
                            continue
                        parts = name.split("/")
                        why = None
                        if name.startswith(("/", "\\")) or ".." in parts or "\\" in name or name[1:2] == ":":
                            why = "unsafe_path"
                        elif parts[0] == "__MACOSX" or parts[-1] in (".DS_Store", "Thumbs.db"):
                            why = "junk"
                        elif info.file_size > most_file:
                            why = "too_large"
                        elif total + info.file_size > most_total or count >= most_files:
                            why = "over_limit"
                        body = None if why else z.read(info)
                        if not why:
                            total, count = total + len(body), count + 1
                        rows.append((archive, name, info.file_size, body, why))
                        if sum(len(r[3] or b"") for r in rows) > 16 << 20:
                            yield pd.DataFrame(rows, columns=["archive", "entry", "size", "content", "skipped"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "entry", "size", "content", "skipped"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(zip|cbz|epub|jar)$"))
    return raw.select("path", "content").mapInPandas(run, ENTRIES)


def safe_entries(entries: DataFrame) -> DataFrame:
    return entries.where(contained(F.col("entry")))


def sections(docs: DataFrame) -> DataFrame:
    """file, title, level, line, last, slug of Markdown (file, text): headings outside fenced blocks, and the last line before the next heading of the same or a higher level.

    A document's headings are found in its own array of lines; no line is shuffled.
    """
    from strataforge.functions.text import slug

    lines = docs.select("file", F.split("text", "\n", -1).alias("lines"))
    zero = F.struct(F.lit(False).alias("fence"), F.lit(0).alias("n"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("h"))

    def step(acc: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s*(```|~~~)")
        head = ~acc.fence & ~mark & line.rlike(r"^#{1,6}\s+\S")
        one = F.array(F.struct((acc.n + 1).alias("line"), F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(line, r"^#+\s+", ""), r"\s+#*\s*$", "")).alias("title")))
        return F.struct(F.when(mark, ~acc.fence).otherwise(acc.fence).alias("fence"), (acc.n + 1).alias("n"), F.when(head, F.concat(acc.h, one)).otherwise(acc.h).alias("h"))

    x = lines.select("file", F.size("lines").alias("n"), F.aggregate("lines", zero, step, lambda acc: acc.h).alias("h"))

    def until(own: Column) -> Column:
        later = F.filter("h", lambda o: (o.line > own.line) & (o.level <= own.level))
        return F.coalesce(F.array_min(F.transform(later, lambda o: o.line)) - 1, F.col("n"))

    x = x.select("file", F.explode(F.transform("h", lambda o: F.struct(o.title.alias("title"), o.level.alias("level"), o.line.alias("line"), until(o).alias("last")))).alias("s")).select("file", "s.*")
    return x.withColumn("slug", slug(F.col("title")))


def table_of_contents(heads: DataFrame) -> DataFrame:
    """file, toc: the headings in order, indented by level."""
    row = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"))
    return heads.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", row.alias("row")))), lambda x: x.row), "\n").alias("toc"))


def search_headings(heads: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return heads.where(F.lower("title").contains(query.lower())).orderBy("file", "line").limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse become rows of nulls with the line in _bad."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The latest events (ts, ...), newest first."""
    return events.where("_bad IS NULL").drop("_bad").orderBy(F.desc("ts")).limit(limit)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


MANIFESTS = r"(^|/)(package\.json|[jt]sconfig[^/]*\.json|pyproject\.toml|Cargo\.toml|go\.mod|[^/]*\.csproj)$"


def manifests(files: DataFrame) -> DataFrame:
    """path, kind, name, dependencies of the manifests among files (path, content)."""
    x = files.where(F.col("path").rlike(MANIFESTS)).select("path", F.col("content").cast("string").alias("text"))
    kind = F.when(F.col("path").rlike(r"package\.json$"), "package").when(F.col("path").rlike(r"config[^/]*\.json$"), "tsconfig").when(F.col("path").rlike(r"pyproject\.toml$"), "pyproject").when(F.col("path").rlike(r"Cargo\.toml$"), "cargo").when(F.col("path").rlike(r"go\.mod$"), "go").otherwise("csproj")
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"(?m)(^|\s)//.*$", "$1")
    name = F.coalesce(F.when(kind == "package", F.get_json_object(plain, "$.name")), F.when(kind.isin("pyproject", "cargo"), F.regexp_extract("text", r'(?m)^\s*name\s*=\s*"([^"]*)"', 1)), F.when(kind == "go", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)), F.lit(""))
    npm = F.map_keys(F.coalesce(F.from_json(F.get_json_object(plain, "$.dependencies"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    deps = F.when(kind == "package", npm).when(kind == "go", F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?(\S+\.\S+/\S+)\s+v"), F.lit(1))).when(kind == "csproj", F.regexp_extract_all("text", F.lit(r'PackageReference\s+Include="([^"]+)"'), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return x.select("path", kind.alias("kind"), name.alias("name"), F.array_sort(deps).alias("dependencies"))


#: Packages that tell a framework.
FRAMEWORKS = ["react", "next", "vue", "svelte", "express", "fastify", "django", "flask", "fastapi"]


def frameworks(found: DataFrame) -> DataFrame:
    return found.select("path", F.array_intersect("dependencies", F.array(*map(F.lit, FRAMEWORKS))).alias("frameworks"))


def barrels(files: DataFrame) -> DataFrame:
    """path, exports of index files that re-export."""
    found = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"(?m)^\s*export\s+(?:\*|\{[^}]*\})\s+from\s+['\"]([^'\"]+)"), F.lit(1))
    return files.where(F.col("path").rlike(r"(^|/)index\.[jt]sx?$")).select("path", found.alias("exports")).where("size(exports) > 0")


def skills(files: DataFrame) -> DataFrame:
    """name, description, path, size of skill folders: files (path, content) named SKILL.md with front matter."""
    x = files.where(F.endswith("path", F.lit("/SKILL.md"))).select("path", F.col("content").cast("string").alias("t"))
    front = F.regexp_extract("t", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(front, rf"(?m)^{k}:\s*[\"']?(.*?)[\"']?\s*$", 1))
    folder = F.element_at(F.split("path", "/"), -2)
    return x.select(F.when(field("name") != "", field("name")).otherwise(folder).alias("name"), field("description").alias("description"), "path", F.length("t").alias("size"))


def projects(files: DataFrame, depth: int = 4) -> DataFrame:
    """root, kind of project folders up to so deep: those that hold a manifest."""
    x = files.select("path", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("root")).where(F.size(F.split("root", "/")) <= depth)
    kind = F.when(F.col("path").rlike(r"package\.json$"), 0).when(F.col("path").rlike(r"(pyproject\.toml|requirements\.txt)$"), 1).when(F.col("path").rlike(r"Cargo\.toml$"), 2).when(F.col("path").rlike(r"go\.mod$"), 3)
    names = F.array(*map(F.lit, ("node", "python", "rust", "go")))
    return x.withColumn("k", kind).where("k IS NOT NULL").groupBy("root").agg(F.element_at(names, F.min("k") + 1).alias("kind"))


def config_map(files: DataFrame, names: list[str]) -> DataFrame:
    """name, present of fixed configuration files."""
    wanted = files.sparkSession.createDataFrame([(n,) for n in names], "name string")
    have = files.select(F.substring_index("path", "/", -1).alias("name")).distinct().withColumn("present", F.lit(True))
    return wanted.join(have, "name", "left").na.fill(False, ["present"])
