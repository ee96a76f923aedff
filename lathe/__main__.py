"""Command line: tidies files or folders, or what git says has changed."""

from __future__ import annotations

import argparse
import os
import sys


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lathe", description=__doc__)
    p.add_argument("paths", nargs="*", help="files or folders; none: the changes that git knows")
    p.add_argument("--dry-run", action="store_true", help="report, and write nothing")
    p.add_argument("--validate", action="store_true", help="compile the configuration, and stop")
    p.add_argument("--include", action="append", default=[], metavar="RULE")
    p.add_argument("--exclude", action="append", default=[], metavar="RULE")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--config", metavar="FILE")
    where.add_argument("--no-config", action="store_true")
    out = p.add_mutually_exclusive_group()
    out.add_argument("--output-mode", choices=("text", "json"), default="text")
    out.add_argument("--json", action="store_const", const="json", dest="output_mode")
    return p.parse_args(argv)


def main(argv: list[str], spark=None) -> int:
    from lathe.operators import parse, policy, records, vis
    from lathe.plans.tidy import tidy
    from lathe.sources import config, files, sinks
    from pyspark.sql import functions as F

    args = arguments(argv)
    try:
        if args.validate:
            if args.no_config:
                raise ValueError("--no-config was passed; there is no configuration to validate")
            path = config.find(os.getcwd(), args.config)
            if path is None:
                raise ValueError(f"no configuration found; run from a folder with {config.NAME}")
            config.load(path)
            print(f"config valid: {path}")
            return 0
        settings = config.discover(os.getcwd(), args.config, args.no_config)
        policy.check_rules(args.include, "--include")
        policy.check_rules(args.exclude, "--exclude")
        found = files.inputs(args.paths)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if not found:
        if args.output_mode == "json":
            print("[]")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lathe").getOrCreate()
    rows = files.decoded(files.first_spelling(files.read_paths(spark, [os.path.abspath(p) for p in found])))
    rust = next((p for p in found if p.lower().endswith(".rs")), None)
    root = config.crate_root(rust) if rust else None
    crate = files.decoded(files.read_folder(spark, os.path.dirname(root), ("rs",))) if root else None
    if crate is not None:
        scanned = parse.scan(crate.select("path", "text")).withColumn("crate", F.lit(root))
        for r in vis.warnings(vis.module_edges(scanned)).orderBy("parent", "pos").toLocalIterator():
            print(f"warning: {r.warning}", file=sys.stderr)
    texts, report = tidy(rows, settings, "dry_run" if args.dry_run else "apply", args.include, args.exclude, root, crate)
    positions = rows.select("path", "pos")
    if args.output_mode == "json":
        print(sinks.json_array(report, positions))
    else:
        for line in sinks.text_lines(report, positions):
            print(line, file=sys.stderr)
    sinks.write_in_place(texts, args.dry_run)
    failed = [r.path for r in texts.where("failed").select("path").orderBy("path").toLocalIterator()]
    for path in failed:
        print(f"error: {path} was left as it is", file=sys.stderr)
    steps = []
    if settings and settings.post_process and not args.dry_run:
        steps = sinks.post_process(settings.post_process, [r.path for r in texts.where("processed").orderBy("pos").select("path").toLocalIterator()])
    for step in steps:
        print(f"error: {step}", file=sys.stderr)
    return records.exit_status(report, len(failed), len(steps))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
