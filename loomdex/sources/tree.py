"""File trees as documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from .ignore import ignored

# Hidden folders and files at the top of a tree that are searched by default.
SEARCHABLE_HIDDEN_DIRS = (
    ".github", ".gitlab", ".circleci", ".buildkite", ".azuredevops", ".ci", ".devcontainer", ".vscode", ".idea", ".run", ".husky", ".changeset",
    ".storybook", ".cargo", ".mvn", ".claude", ".cursor", ".codex", ".well-known", ".platform", ".ebextensions", ".streamlit", ".dvc",
)
SEARCHABLE_HIDDEN_FILES = (
    ".gitignore", ".gitattributes", ".gitmodules", ".git-blame-ignore-revs", ".mailmap", ".editorconfig", ".gitlab-ci.yml", ".dockerignore", ".npmrc", ".nvmrc",
    ".node-version", ".python-version", ".ruby-version", ".tool-versions", ".terraform-version", ".terraform.lock.hcl", ".bazelrc", ".buckconfig",
    ".clang-format", ".clang-tidy", ".coveragerc", ".ruff.toml", ".yamllint", ".prettierignore", ".prettierrc", ".prettierrc.json", ".prettierrc.yml",
    ".prettierrc.yaml", ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.mjs", ".eslintignore", ".eslintrc", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml",
    ".eslintrc.js", ".eslintrc.cjs", ".stylelintignore", ".stylelintrc", ".stylelintrc.json", ".stylelintrc.yml", ".stylelintrc.yaml", ".stylelintrc.js",
    ".stylelintrc.cjs", ".markdownlint.json", ".markdownlint.jsonc", ".env.example", ".env.sample", ".env.template",
)


def searchable(path: Column, include_hidden: bool = False) -> Column:
    """No component is hidden, but for the listed folders and files at the top."""
    if include_hidden:
        return F.lit(True)
    parts = F.split(path, "/")
    hidden = lambda c: c.startswith(".") & ~c.isin(".", "..")
    first = F.element_at(parts, 1)
    rest = F.exists(F.slice(parts, 2, 1 << 20), hidden)
    top = ~hidden(first) | first.isin(*SEARCHABLE_HIDDEN_DIRS) | (first.isin(*SEARCHABLE_HIDDEN_FILES) & (F.size(parts) == 1))
    return top & ~rest


# From these shares of control and text bytes on a file counts as binary.
def _suspicious(contents: pd.Series) -> pd.Series:
    def one(raw: bytes) -> bool:
        b = np.frombuffer(raw[:4096], dtype=np.uint8)
        n = max(len(b), 1)
        text = int(((b >= 0x20) & (b <= 0x7E) | np.isin(b, (9, 10, 13))).sum())
        control = int(((b <= 8) | (b == 11) | (b == 12) | (b >= 14) & (b <= 31)).sum())
        return control * 200 >= n or control > 0 and text / n < 0.95 or text / n < 0.85

    return contents.map(lambda x: False if x is None else one(x))


def looks_binary(contents: Column) -> Column:
    """A zero byte among the first 4096, or no valid UTF-8 and too few printable bytes. Only
    the head of rows that are not valid UTF-8 reaches Python."""
    head = F.substring(contents, 1, 4096)
    zero = F.locate("\x00", F.decode(head, "ISO-8859-1")) > 0
    bad = ~F.is_valid_utf8(contents.cast("string"))
    suspicious = F.pandas_udf(_suspicious, "boolean")
    return F.when(zero, True).when(bad, suspicious(F.when(bad, head))).otherwise(False)


def describe(files: DataFrame) -> DataFrame:
    """relative_path, contents and modified_unix_secs with name, extension, size and hash."""
    name = F.element_at(F.split("relative_path", "/"), -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return files.withColumns(
        {
            "file_name": name,
            "extension": F.when(ext != "", ascii_lower(ext)),
            "size": F.octet_length("contents").cast("long"),
            "hash": F.sha2("contents", 256),
        }
    )


def _is_searchable(parts: list[str], include_hidden: bool) -> bool:
    hidden = [i for i, p in enumerate(parts) if p.startswith(".")]
    return include_hidden or not hidden or hidden == [0] and (parts[0] in SEARCHABLE_HIDDEN_DIRS or len(parts) == 1 and parts[0] in SEARCHABLE_HIDDEN_FILES)


def _unlisted(spark: SparkSession, root: str, include_hidden: bool) -> DataFrame:
    """Names of files that Spark's sources pass over because a name starts with . or _, from
    a listing on the driver; tasks read them."""
    rows = []
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    found = fs.listFiles(top, True)
    while found.hasNext():
        f = found.next()
        path = f.getPath().toUri().getPath()[len(base) :]
        parts = path.split("/")
        if parts[0] != ".git" and any(p[0] in "._" for p in parts) and _is_searchable(parts, include_hidden):
            rows.append((path, f.getModificationTime() // 1000, f.getLen(), f.getPath().toString()))
    return spark.createDataFrame(rows, "relative_path string, modified_unix_secs long, length long, uri string")


def _read(batches):
    from pyarrow.fs import FileSystem

    for batch in batches:
        contents = []
        for uri in batch.column("uri").to_pylist():
            fs, path = FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
            with fs.open_input_stream(path, compression=None) as stream:
                contents.append(stream.read())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(contents, pa.binary())], names=[*batch.schema.names[:-1], "contents"])


def _files(spark: SparkSession, root: str, include_hidden: bool, max_file_size: int | None) -> DataFrame:
    """relative_path, modified_unix_secs and contents, null for files over the size cap, which are never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    cap = (1 << 63) - 1 if max_file_size is None else max_file_size
    path = F.expr(f"substring(path, locate({_sql(base)}, path) + {len(base)})").alias("relative_path")
    seen = [path, F.unix_timestamp("modificationTime").alias("modified_unix_secs")]
    shape = "relative_path string, modified_unix_secs long, contents binary"
    none = F.lit(None).cast("binary").alias("contents")
    hidden = _unlisted(spark, root, include_hidden)
    read = hidden.where(F.col("length") <= cap).select("relative_path", "modified_unix_secs", "uri").mapInArrow(_read, shape)
    out = raw.where(F.col("length") <= cap).select(*seen, F.col("content").alias("contents")).union(read)
    if max_file_size is not None:
        out = out.union(raw.where(F.col("length") > cap).select(*seen, none)).union(hidden.where(F.col("length") > cap).select("relative_path", "modified_unix_secs", none))
    return out


def listing(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """relative_path, modified_unix_secs and length of a tree's files; no contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    path = F.expr(f"substring(path, locate({_sql(base)}, path) + {len(base)})").alias("relative_path")
    seen = raw.select(path, F.unix_timestamp("modificationTime").alias("modified_unix_secs"), "length")
    return seen.union(_unlisted(spark, root, include_hidden).drop("uri")).where(searchable(F.col("relative_path"), include_hidden))


def _excludes(spark: SparkSession, root: str, more: tuple[str, ...]) -> list[tuple[str, str]]:
    """Rules of a tree as a whole: .git/info/exclude and any files that the caller names."""
    out = []
    for name in (*more, f"{root.rstrip('/')}/.git/info/exclude"):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            stream = fs.open(path)
            out.append(("", bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))  # a file of rules
            stream.close()
    return out


def scan_tree(spark: SparkSession, root: str, include_hidden: bool = False, include_binary: bool = False, max_file_size: int | None = None, ignore_files: tuple[str, ...] = (".gitignore", ".ignore"), excludes: tuple[str, ...] = ()) -> DataFrame:
    """The documents of a tree: relative_path, file_name, extension, size, modified_unix_secs,
    hash, contents, skipped_binary (those rows have null contents and still count as tracked).
    ``excludes``: files of ignore rules for the whole tree, such as a user's global ones; those
    of .git/info/exclude come after them and before the tree's own. Files over
    ``max_file_size`` bytes are tracked and never read."""
    files = _files(spark, root, include_hidden, max_file_size)
    rules = files.where(F.element_at(F.split("relative_path", "/"), -1).isin(*ignore_files) & F.col("contents").isNotNull()).select("relative_path", F.decode("contents", "UTF-8").alias("text")).collect()  # ignore files only
    ordered = sorted(((r["relative_path"].rpartition("/")[0], r["text"]) for r in rules), key=lambda r: (r[0].count("/") + bool(r[0]), r[0]))
    ordered = _excludes(spark, root, excludes) + ordered
    kept = files.where(searchable(F.col("relative_path"), include_hidden) & ~ignored(F.col("relative_path"), ordered))
    binary = F.lit(False) if include_binary else F.coalesce(looks_binary(F.col("contents")), F.lit(False))
    return describe(kept.withColumn("skipped_binary", binary)).withColumn("contents", F.when(~F.col("skipped_binary"), F.col("contents")))


def _named(root: str):
    def run(batches):
        from pyarrow.fs import FileSystem, FileType

        for batch in batches:
            paths, seen, contents = [], [], []
            for path in batch.column("relative_path").to_pylist():
                uri = f"{root}/{path}"
                fs, place = FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
                info = fs.get_file_info(place)
                if info.type == FileType.File:
                    paths.append(path)
                    seen.append(info.mtime_ns // 1_000_000_000)
                    with fs.open_input_stream(place, compression=None) as stream:
                        contents.append(stream.read())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(seen, pa.int64()), pa.array(contents, pa.binary())], names=["relative_path", "modified_unix_secs", "contents"])

    return run


def scan_named(paths: DataFrame, root: str, include_binary: bool = False) -> DataFrame:
    """The documents of a tree that ``paths`` (relative_path) names, read by tasks; nothing is
    listed. A path that is no file has no row. Ignore and hidden rules are the caller's."""
    files = paths.select("relative_path").mapInArrow(_named(root.rstrip("/")), "relative_path string, modified_unix_secs long, contents binary")
    binary = F.lit(False) if include_binary else F.coalesce(looks_binary(F.col("contents")), F.lit(False))
    return describe(files.withColumn("skipped_binary", binary)).withColumn("contents", F.when(~F.col("skipped_binary"), F.col("contents")))


def scan_file(spark: SparkSession, path: str, include_binary: bool = False) -> DataFrame:
    """One file as a document, whatever ignore and hidden rules say."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = top.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(top)
    row = (top.getName(), status.getModificationTime() // 1000, status.getPath().toString())
    one = spark.createDataFrame([row], "relative_path string, modified_unix_secs long, uri string").mapInArrow(_read, "relative_path string, modified_unix_secs long, contents binary")
    binary = F.lit(False) if include_binary else F.coalesce(looks_binary(F.col("contents")), F.lit(False))
    return describe(one.withColumn("skipped_binary", binary)).withColumn("contents", F.when(~F.col("skipped_binary"), F.col("contents")))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def repo_stats(docs: DataFrame) -> DataFrame:
    """tracked_files, searchable_files, searchable_bytes, skipped_binary_files."""
    seen = F.col("contents").isNotNull()
    return docs.agg(
        F.count("*").alias("tracked_files"), F.count_if(seen).alias("searchable_files"),
        F.coalesce(F.sum(F.when(seen, F.col("size"))), F.lit(0)).alias("searchable_bytes"), F.count_if("skipped_binary").alias("skipped_binary_files"),
    )


def language_histogram(docs: DataFrame) -> DataFrame:
    """Files for each extension, most first, then by name."""
    return docs.groupBy(F.coalesce("extension", F.lit("<none>")).alias("language")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")
