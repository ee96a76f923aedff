"""Sinks: changed texts, JSON and text reports, local in-place writes, post-processing."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile

from pyspark.sql import DataFrame

from lathe.operators import records as R


def write_changed(texts: DataFrame, path: str) -> None:
    """(path, text) of changed files to a new folder of Parquet; the committer makes it whole or nothing."""
    texts.where("new_text <> text").select("path", "new_text").withColumnRenamed("new_text", "text").write.mode("errorifexists").parquet(path)


def write_json(records: DataFrame, positions: DataFrame, path: str) -> None:
    """One JSON object a line, in report order, as many files as there are partitions."""
    R.json_objects(R.in_json_order(records, positions)).select("json").write.mode("errorifexists").text(path)


def json_array(records: DataFrame, positions: DataFrame) -> str:
    """The report as one JSON array, streamed to the driver; for reports that a driver should print."""
    rows = R.json_objects(R.in_json_order(records, positions)).select("json").toLocalIterator()
    return "[" + ",".join(r.json for r in rows) + "]"


def text_lines(records: DataFrame, positions: DataFrame):
    """The text report, streamed to the driver line by line."""
    return (r.report for r in R.as_text(R.in_text_order(records, positions)).select("report").toLocalIterator())


def write_in_place(texts: DataFrame, dry_run: bool = False) -> list[str]:
    """Writes changed local files, each by a temporary file of its permissions and a rename. Returns their paths."""
    done = []
    for r in texts.where("new_text <> text").select("path", "new_text").toLocalIterator():
        done.append(r.path)
        if dry_run:
            continue
        real = os.path.realpath(r.path)
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(real))
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            file.write(r.new_text)
        shutil.copymode(real, temporary)
        os.replace(temporary, real)
    return done


def post_process(steps: list[tuple[list[str], list[str]]], paths: list[str]) -> list[str]:
    """Runs each step over all paths of its extensions, without a shell; returns what failed."""
    failed = []
    for command, extensions in steps:
        for path in paths:
            if extensions and path.rsplit(".", 1)[-1].lower() not in extensions:
                continue
            try:
                code = subprocess.run([*command, path]).returncode
            except OSError as e:
                code = e
            if code:
                failed.append(f"{' '.join(command)} {path}: {code}")
    return failed
