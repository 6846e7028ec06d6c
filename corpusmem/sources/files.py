"""Listing and reading of file trees, and the rules on paths and contents."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmem.config import WS
from corpusmem.operators.symbols import LANGUAGES, OTHER_CODE, extension

# Names of directories that are not listed, and extensions of documents.
IGNORED = (".git", "node_modules", "dist", "build", ".next", "venv", ".venv", "__pycache__", ".idea", ".vscode", ".cache", "coverage", ".turbo", "target", "vendor", "third_party", "thirdparty", "obj")
DOCUMENTS = (".pdf", ".md", ".markdown", ".txt")
PAGED = (".pdf",)
CODE = tuple(x for group in LANGUAGES.values() for x in group) + OTHER_CODE


class TreeSource(DataSource):
    """`spark.read.format("filetree").load(root)`: all files below a root that every executor can see.

    Options: content ("true": with bytes), maxMb (larger files have no content, 0: any size), depth (levels of directories
    that become partitions, 2). Unlike Spark's own
    file source it returns names that start with an underscore. Unreadable directories are passed over; links to
    directories are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, mtime timestamp, size long, content binary"

    def reader(self, schema):
        return TreeReader(self.options)


class Part(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.content = options.get("content", "false").lower() == "true"
        self.depth = int(options.get("depth", "2"))
        self.most = float(options.get("maxMb", "50")) * 1024 * 1024

    def _list(self, path: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
        try:
            entries = sorted(os.scandir(path), key=lambda e: e.name)
        except OSError:
            return [], []
        entries = [e for e in entries if not e.name.startswith(".")]
        dirs = [e for e in entries if e.is_dir(follow_symlinks=False) and e.name not in IGNORED]
        return dirs, [e for e in entries if e.is_file()]

    def _content(self, path: str, size: int) -> bytes | None:
        """None for a file over the cap (a file that grew meanwhile, too)."""
        if self.most and size > self.most:
            return None
        with open(path, "rb") as f:
            found = f.read(int(self.most) + 1) if self.most else f.read()
        return None if self.most and len(found) > self.most else found

    def partitions(self) -> list[InputPartition]:
        out, level = [], [self.root]
        for _ in range(self.depth):
            out += [Part(p, False) for p in level]
            level = [d.path for p in level for d in self._list(p)[0]]
        return out + [Part(p, True) for p in level]

    def read(self, part: Part):
        stack = [part.path]
        while stack:
            dirs, files = self._list(stack.pop())
            if part.deep:
                stack += [d.path for d in dirs]
            for f in files:
                try:
                    s = f.stat()
                    content = self._content(f.path, s.st_size) if self.content else None
                except OSError:
                    continue
                yield os.path.relpath(f.path, self.root).replace(os.sep, "/"), datetime.fromtimestamp(s.st_mtime, timezone.utc), s.st_size, content


def read_tree(spark: SparkSession, root: str, content: bool = True, max_mb: float = 50) -> DataFrame:
    """Files below a root; those over max_mb are listed without content."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("content", str(content).lower()).option("maxMb", str(max_mb)).load(root)


def listed(path: Column) -> Column:
    """Whether a relative path belongs in a listing: no part starts with a dot, no directory is ignored."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.exists(parts, lambda p: p.startswith(".")) & ~F.exists(dirs, lambda p: p.isin(*IGNORED))


def kind(path: Column) -> Column:
    """doc, code or null, by extension."""
    ext = extension(path)
    return F.when(ext.isin(*DOCUMENTS), "doc").when(ext.isin(*CODE), "code")


def is_paged(path: Column) -> Column:
    """Whether a file comes as pages: its bytes aren't text."""
    return extension(path).isin(*PAGED)


def store_key(path: Column, root: str = "", case_insensitive: bool = False) -> Column:
    """A path relative to the root with forward slashes; lower-cased where file names ignore case."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    root = root.replace("\\", "/").rstrip("/")
    if root:
        path = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)
    return F.lower(path) if case_insensitive else path


def oversize(size: Column, max_mb: float) -> Column:
    """Whether a size is over the cap; a cap of 0 means none."""
    return size > int(max_mb * 1024 * 1024) if max_mb else F.lit(False)


def is_dump(text: Column) -> Column:
    """Whether a text's head is a banner with the marks of a type dump."""
    head = F.substring(text, 1, 4096)
    marks = r"(?:==\s*TYPE\s|\bVersion=\d+\.\d+\.\d+\.\d+|loaded:\s*\S+,\s*Version=)"
    return F.coalesce(head.rlike(rf"\A(?:\x{{FEFF}})?{WS}*={{3,}}") & head.rlike(marks), F.lit(False))


def rejected(listing: DataFrame, max_mb: float) -> DataFrame:
    """(path, reason) of rows that can't be read: empty path, no content, over the cap."""
    reason = F.when(F.coalesce("path", F.lit("")) == "", "file_path must be a non-empty string").when(F.col("size").isNull(), "not readable").when(oversize(F.col("size"), max_mb), "too large")
    return listing.select("path", reason.alias("reason")).where("reason is not null")


def read_texts(listing: DataFrame, max_mb: float = 50) -> DataFrame:
    """(path, size, sha256, text) of files within the cap; bytes that aren't UTF-8 become replacement characters. Files
    that come as pages have a hash but no text: see plans.index.with_pages."""
    rows = listing.where(F.col("content").isNotNull() & ~oversize(F.col("size"), max_mb))
    return rows.select("path", "size", F.sha2("content", 256).alias("sha256"), F.when(~is_paged(F.col("path")), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


# Marks of project roots.
STRONG = (".git", ".hg", ".svn")
WEAK = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "pom.xml")
SOURCE_DIRS = ("src", "app", "lib", "libs", "tools", "include", "core", "modules", "scripts", "components", "assets", "utils", "shared", "common", "server", "client")
ASCENT = 8


def project_roots(paths: DataFrame, listing: DataFrame, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """(path, root): the nearest directory above with a strong mark; else, of the eight nearest, the nearest with a weak
    mark; else the highest of them that looks like a root (two source directories, or one and a readme file); else the
    path's own directory. listing: (path, is_dir) of what lies in the directories.

    Marks are counted by directory, and ancestors meet them in an equi-join.
    """
    split = lambda c: F.regexp_extract(c, r"\A(.*)/[^/]*\z", 1)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    source = F.col("is_dir") & F.lower(name).isin(*SOURCE_DIRS)
    facts = listing.groupBy(split(F.col("path")).alias("dir")).agg(
        F.bool_or(name.isin(*STRONG)).alias("strong"), F.bool_or(name.isin(*weak)).alias("weak"),
        F.count_if(source).alias("sources"), F.bool_or(~F.col("is_dir") & F.lower(name).startswith("readme")).alias("readme"),
    )
    looks = (F.col("sources") >= 2) | (F.col("readme") & (F.col("sources") >= 1))
    parts = F.split(split(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - d), "/").alias("dir")))
    rows = paths.select("path", F.inline(above)).join(facts, "dir", "left")
    near = F.col("depth") < ASCENT
    pick = rows.groupBy("path").agg(
        F.min_by("dir", F.when(F.col("strong"), F.col("depth"))).alias("s"), F.min_by("dir", F.when(F.col("weak") & near, F.col("depth"))).alias("w"),
        F.max_by("dir", F.when(looks & near, F.col("depth"))).alias("l"), F.min_by("dir", "depth").alias("own"),
    )
    return pick.select("path", F.coalesce("s", "w", "l", "own").alias("root"))


def code_first(paths: DataFrame) -> DataFrame:
    """(rank, path): code before documents, otherwise by seq."""
    from pyspark.sql import Window as W

    code = F.when(kind(F.col("path")) == "code", 0).otherwise(1)
    return paths.select(F.row_number().over(W.partitionBy("project").orderBy(code, "seq")).alias("rank"), "project", "path")
