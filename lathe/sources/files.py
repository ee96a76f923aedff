"""File sources: recursive scans, path lists, git changes, alias removal, text decoding."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of short compressed rows that one task takes, and the most tasks that rows are spread over.
SPREAD_BYTES, SPREAD_TASKS = 128 << 10, 1 << 14
EXTENSIONS = ("rs", "md")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def has_extension(ext: Column, extensions=EXTENSIONS) -> Column:
    return F.lower(ext).isin(*extensions)


def read_folder(spark: SparkSession, root: str, extensions=EXTENSIONS, ignore: bool = True) -> DataFrame:
    """(path, ext, content): all files below a folder, hidden folders too, read by the executors; .gitignore rules apply."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    files = found.select(path.alias("path"), extension(F.col("path")).alias("ext"), "content").where(has_extension(F.col("ext"), extensions) & ~F.contains("path", F.lit("/.git/")))
    if ignore:
        keep = _ignored(root)
        for regex, negate in keep:
            hit = F.regexp_like("path", F.lit(regex))
            files = files.withColumn("__out", F.when(hit, F.lit(not negate)).otherwise(F.col("__out") if "__out" in files.columns else F.lit(False)))
        if keep:
            files = files.where(~F.col("__out")).drop("__out")
    return files


def _rules(file: Path) -> list[tuple[str, bool]]:
    """(regex over absolute paths, negated) of one .gitignore file. A hit is the path itself or a folder above it."""
    rules = []
    for line in file.read_text(encoding="utf-8", errors="replace").splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negate, rule = rule.startswith("!"), rule.removeprefix("!")
        folder_only, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.removeprefix("/")
        body = "/".join(".*" if part == "**" else fnmatch.translate(part)[4:-3].replace(".*", "[^/]*") for part in rule.split("/"))
        body = body.replace(".*/", "(?:.*/)?")
        base = "^" + re.escape(str(file.parent)).replace("\\-", "-") + "/"
        rules.append((base + ("" if anchored else "(?:.*/)?") + body + ("/.*$" if folder_only else "(?:/.*)?$"), negate))
    return rules


def _above(top: Path) -> list[Path]:
    """The .gitignore files from a repository's top down to a folder."""
    chain = []
    for at in (top, *top.parents):
        if (at / ".gitignore").is_file():
            chain.append(at / ".gitignore")
        if (at / ".git").exists():
            break
    return chain[::-1]


def _ignored(root: str) -> list[tuple[str, bool]]:
    """Rules of the .gitignore files from the repository's top down to the root and below."""
    top = Path(root).resolve()
    below = sorted(p for p in top.rglob(".gitignore") if p.parent != top) if top.is_dir() else []
    return [r for file in [*_above(top), *below] for r in _rules(file)]


def walk(root: str, extensions=EXTENSIONS) -> list[str]:
    """The files below a folder in order, hidden folders too; what a repository's .gitignore rules leave out isn't entered."""
    top = Path(root).resolve()
    kept_by_git = any((at / ".git").exists() for at in (top, *top.parents))
    out = []

    def visit(folder: Path, shown: str, rules: list[tuple[re.Pattern, bool]]) -> None:
        own = folder / ".gitignore"
        if kept_by_git and folder != top and own.is_file():
            rules = [*rules, *((re.compile(x), n) for x, n in _rules(own))]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            is_folder = entry.is_dir(follow_symlinks=False)
            tried = str(folder / entry.name) + ("/x" if is_folder else "")
            gone = False
            for rule, negate in rules:
                if rule.match(tried):
                    gone = not negate
            if gone or entry.name == ".git":
                continue
            if is_folder:
                visit(folder / entry.name, f"{shown}/{entry.name}", rules)
            elif entry.is_file() and entry.name.rsplit(".", 1)[-1].lower() in extensions and "." in entry.name[1:]:
                out.append(f"{shown}/{entry.name}")

    visit(top, root.rstrip("/") or "/", [(re.compile(x), n) for file in (_above(top) if kept_by_git else []) for x, n in _rules(file)])
    return sorted(out)


def resolve(path: str, extensions=EXTENSIONS) -> list[str]:
    """The files of one path: itself, whatever is ignored, or those below a folder. A missing path is an error."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if p.is_file():
        return [str(p)] if p.suffix[1:].lower() in extensions else []
    return walk(path, extensions)


def resolve_all(paths: list[str], extensions=EXTENSIONS) -> list[str]:
    return sorted({f for p in paths for f in resolve(p, extensions)})


def git_changes(root: str, extensions=EXTENSIONS) -> list[str]:
    """Files that are added, copied, modified or renamed, staged or not, and exist."""
    found: set[str] = set()
    for staged in ([], ["--cached"]):
        out = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", "--diff-filter=ACMR", *staged], capture_output=True, check=True).stdout
        found |= {os.path.join(root, p.decode()) for p in out.split(b"\0") if p}
    return sorted(f for f in found if os.path.isfile(f) and f.rsplit(".", 1)[-1].lower() in extensions)


def inputs(paths: list[str], root: str = ".", extensions=EXTENSIONS) -> list[str]:
    """Explicit paths, or what git says has changed."""
    return resolve_all(paths, extensions) if paths else git_changes(root, extensions)


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ext, content, pos, canonical, inode) of listed files; executors read them."""
    rows = []
    for i, p in enumerate(paths):
        stat = os.stat(p)
        rows.append((i, p, os.path.realpath(p), f"{stat.st_dev}:{stat.st_ino}"))
    listed = spark.createDataFrame(rows, "pos int, path string, canonical string, inode string")
    if not rows:
        return listed.select("path", F.lit("").alias("ext"), F.lit(b"").alias("content"), "pos", "canonical", "inode")
    read = spark.read.format("binaryFile").load([os.path.abspath(p) for p in sorted({r[2] for r in rows})])
    read = read.select(F.regexp_replace("path", "^file:/*", "/").alias("canonical"), "content")
    return listed.join(read, "canonical").select("path", extension(F.col("path")).alias("ext"), "content", "pos", "canonical", "inode")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows in tasks of about SPREAD_BYTES of the Parquet files that they are read from.

    A scan takes a row group whole, so that one task would get all of a table of short rows, and all the work on the
    texts that are made of them. Rows move as they are read: only columns that are used do.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = min(-(-size // SPREAD_BYTES), SPREAD_TASKS)
    return rows.repartition(tasks) if tasks > 1 else rows


def first_spelling(files: DataFrame, canonical: str = "canonical", inode: str = "inode", pos: str = "pos") -> DataFrame:
    """One row of each file: the first spelling of a canonical path, then the first of an inode."""
    for key in (canonical, inode):
        files = files.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("__r = 1").drop("__r")
    return files


def decoded(files: DataFrame) -> DataFrame:
    """content to text; bad_utf8 tells files that aren't UTF-8, whose text is null."""
    ok = F.expr("is_valid_utf8(content)")
    return files.withColumn("text", F.when(ok, F.col("content").cast("string"))).withColumn("bad_utf8", ~ok).drop("content")
