"""DataFrame operators against the kernels and on small files."""

import inspect
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lathe.functions import text as K
from lathe.operators import graph, links, lints, parse, policy, records, reorder, tables, texts, vis
from lathe.plans import tidy
from lathe.sources import config, files, sinks
from lathe.streaming import tidy_stream
from tests.unit.test_rust import SOURCE
from tests.unit.test_text import FENCES, LINKS, TABLES


def frame(spark, rows):
    return spark.createDataFrame([(f"f{i}.{e}", e, t, i) for i, (e, t) in enumerate(rows)], "path string, ext string, text string, pos int").repartition(2)


def test_relational_tables_agree_with_the_kernel(spark):
    rows = [("md", t) for t, _ in TABLES] + [("md", None)]
    df = frame(spark, rows)
    built = {(r.path, r.line_no): r.new_body for r in tables.rebuilt(tables.tables(tables.lines(df))).collect()}
    for i, (_, text) in enumerate(rows):
        for n, (old, new) in enumerate(zip(K.segments(text or ""), K.segments(K.fix_tables(text or ""))), 1):
            got = built.get((f"f{i}.md", n))
            want = K.doc_split(K.terminated(new)[0])[1]
            assert got == want if got is not None else old == new
    assert {r.path: r.new_text for r in texts.fix_tables(df).collect()} == {f"f{i}.md": K.fix_tables(t) if t is not None else None for i, (_, t) in enumerate(rows)}


def test_relational_links_agree_with_the_kernel(spark):
    rows = [("md", t) for t, n, _ in LINKS if n == 1]
    df = frame(spark, rows)
    got = {}
    for r in links.hoisted(links.links_of(df)).collect():
        got.setdefault(r.path, set()).add((r.label, r.url))
    rust = {r.path for r in links.rust_context(tables.lines(df)).collect()}
    for i, (_, text) in enumerate(rows):
        if f"f{i}.md" not in rust:
            assert got.get(f"f{i}.md", set()) == set(K.fix_links(text)[1])
    assert rust == {f"f{i}.md" for i, (_, t) in enumerate(rows) if "//" in t}


def test_fence_fixes(spark):
    df = frame(spark, [("md", t) for t, _, _ in FENCES])
    got = {r.path: (r.new_text, [f.line for f in r.found]) for r in texts.fix_fences(df).collect()}
    assert got == {f"f{i}.md": (new, lines) for i, (_, new, lines) in enumerate(FENCES)}


def test_lints(spark):
    text = "pub struct S;\n/// Does. TODO-list\npub fn f(a: u8, b_c: u8) -> Result<u8, E> {}\n/// Ok.\n/// # ERRORS\n/// none\n/// # Params\n/// - `a`\n/// # Other\n/// b_c\npub fn g(a: u8, b_c: u8) -> Result<u8, E> {}\n#[test]\nfn test1() {}\nfn mytodo() {}\n"
    got = [(r.code, r.line, r.item_name) for r in lints.run_all(parse.items(parse.scan(frame(spark, [("rs", text)])))).orderBy("idx", "check").collect()]
    assert got == [("DOC001", 1, "S"), ("DOC002", 2, "f"), ("DOC004", 2, "f"), ("DOC006", 2, "f"), ("DOC003", 4, "g"), ("DOC005", 4, "g"), ("TEST001", 12, "test1")]
    assert lints.run_all(parse.items(parse.scan(frame(spark, [("rs", text)]))), ()).collect() == []


def test_reorder_guards_lines(spark):
    df = frame(spark, [("rs", SOURCE), ("rs", "// only a comment\n"), ("rs", " \n"), ("rs", "fn b() {}\nfn a() {}\n"), ("rs", None)])
    got = {r.path: r for r in reorder.reorder(df).collect()}
    assert [got[f"f{i}.rs"].broken for i in range(5)] == [False, True, False, False, False]
    assert got["f3.rs"].new_text == "fn a() {}\n\nfn b() {}\n" and got["f2.rs"].new_text == " \n"
    old, new = (spark.createDataFrame([("p", t)], "path string, text string") for t in ("a\nb\n\n", "b\r\na\n a\n"))
    assert {(r.line, r.n_old, r.n_new) for r in reorder.line_differences(old, new).collect()} == {(" a", 0, 1)}


def test_levels(spark):
    nodes = spark.createDataFrame([(1, i, n) for i, n in enumerate(["c", "b", "main", "a", "x", "y"])], "graph int, node int, name string")
    edges = spark.createDataFrame([(1, 0, 1), (1, 2, 0), (1, 4, 5), (1, 5, 4), (1, 0, 1), (1, 3, 3)], "graph int, src int, dst int")
    got = {r.name: (r.level, r.out_pos) for r in graph.toposorted(graph.levels(nodes, edges)).collect()}
    assert got == {"main": (None, 0), "a": (0, 1), "c": (0, 2), "b": (1, 3), "x": (None, 4), "y": (None, 5)}


def test_bounds_of_depth_are_errors(spark):
    nodes = spark.createDataFrame([(1, i, f"n{i}") for i in range(4)], "graph int, node int, name string")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(3)], "graph int, src int, dst int")
    assert sorted(r.level for r in graph.levels(nodes, edges, most=4).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        graph.levels(nodes, edges, most=3)
    modules = spark.createDataFrame([("k", f"f{i}", 0, f"f{i + 1}", None) for i in range(3)], "crate string, parent string, pos int, child string, vis string")
    roots = spark.createDataFrame([("k", "f0")], "crate string, root string")
    assert vis.floors_by_rounds(modules, roots, most=3).count() == 4
    with pytest.raises(ValueError):
        vis.floors_by_rounds(modules, roots, most=2)
    assert inspect.signature(graph.levels).parameters["most"].default is inspect.signature(vis.floors_by_rounds).parameters["most"].default is None


def test_permutations(spark):
    good = spark.createDataFrame([("p", 0, 1), ("p", 1, 0), ("q", 0, 0), ("q", 0, 1)], "path string, idx int, out_pos int")
    assert [r.path for r in reorder.permutation_faults(good).collect()] == ["q"]


def test_module_walk_takes_the_last_declaration_first(spark):
    edges = spark.createDataFrame([("k", "r", 0, "a", "pub(crate)"), ("k", "r", 1, "b", None), ("k", "b", 0, "a", "pub(super)")], "crate string, parent string, pos int, child string, vis string")
    roots = spark.createDataFrame([("k", "r")], "crate string, root string")
    assert {r.path: r.floor for r in vis.floors(edges, roots).collect()} == {"r": None, "b": None, "a": "pub(super)"}


@pytest.mark.parametrize("glob,yes,no", [("*.rs", "a.rs", "b/a.rs"), ("**/*.rs", "b/a.rs", "a.md"), ("src/**", "src/a/b", "lib/a"), ("{a,b}/?.md", "a/x.md", "a/xy.md"), ("[!a]x", "bx", "ax"), ("a.b", "a.b", "acb")])
def test_globs(glob, yes, no):
    import re

    assert re.search(policy.glob_regex(glob), yes) and not re.search(policy.glob_regex(glob), no)


def test_configuration(tmp_path):
    c = config.parse("include:\n  - files: ['src/**']\n    rules: [tables, DOC001]\nlinks:\n  min_occurrences: 2\n  by_extension: {rs: 3}\npost_process:\n  - command: [fmt, -x]\n    extensions: [rs]\n")
    assert c.include == [(["src/**"], ["tables", "DOC001"])] and c.least == 2 and c.post_process == [(["fmt", "-x"], ["rs"])]
    for bad in ("nope: 1", "include: [{files: [a], rules: [zzz]}]", "include: [{files: [a], rules: [vis]}]\nexclude: [{files: [a], rules: [vis]}]", "links: {min_occurrences: 0}", "exclude: [{files: ['[a'], rules: [vis]}]", "exclude: [{file: [a]}]"):
        with pytest.raises(ValueError):
            config.parse(bad)
    (tmp_path / config.NAME).write_text("{}")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.discover(str(tmp_path / "a" / "b")).base == str(tmp_path)
    (tmp_path / "a" / ".git").mkdir()
    assert config.discover(str(tmp_path / "a" / "b")) is None and config.discover(str(tmp_path), none=True) is None
    (tmp_path / "Cargo.toml").write_text("[package]\nname = 'x'\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "main.rs").write_text("")
    assert config.crate_root(str(tmp_path / "src" / "main.rs")).endswith("src/main.rs")


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.rs": b"fn a() {}", "sub/b.MD": b"x", "sub/c.txt": b"", "bad.md": b"\xff", "skip.md": b"s", ".gitignore": b"skip.md\n"}.items():
        (tmp_path / name).write_bytes(text)
    (tmp_path / "link.rs").symlink_to(tmp_path / "a.rs")
    found = files.resolve_all([str(tmp_path), str(tmp_path / "a.rs")])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.rs", "bad.md", "link.rs", "skip.md", "b.MD"]
    rows = files.decoded(files.first_spelling(files.read_paths(spark, found))).collect()
    assert {(r.path.rsplit("/", 1)[1], r.text, r.bad_utf8) for r in rows} == {("a.rs", "fn a() {}", False), ("bad.md", None, True), ("skip.md", "s", False), ("b.MD", "x", False)}
    assert {r.path.rsplit("/", 1)[1] for r in files.read_folder(spark, str(tmp_path)).collect()} >= {"a.rs", "b.MD", "bad.md"}
    assert "skip.md" not in {r.path.rsplit("/", 1)[1] for r in files.read_folder(spark, str(tmp_path)).collect()}
    with pytest.raises(FileNotFoundError):
        files.resolve(str(tmp_path / "none"))


def test_git_source(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init")
    for n in ("a.rs", "b.md", "c.txt"):
        (tmp_path / n).write_text("x")
    git("add", ".")
    git("commit", "-m", "x")
    (tmp_path / "a.rs").write_text("y")
    (tmp_path / "new.md").write_text("y")
    git("add", "new.md")
    assert [p.rsplit("/", 1)[1] for p in files.inputs([], str(tmp_path))] == ["a.rs", "new.md"]


RUN = [("rs", "fn b() {}\n/// [x](u)\npub fn a() { b() }\n"), ("md", "|a|\n|-|\n|bb|\n"), ("rs", "// nothing\n"), ("rs", "mod m { pub(super) mod n { pub fn q() {} } }\n"), ("txt", None)]


def test_dry_run_and_apply(spark, tmp_path):
    df = frame(spark, RUN)
    positions = df.select("path", "pos")
    out, found = tidy.tidy(df)
    assert all(r.text == r.new_text for r in out.collect())
    codes = [(r.path, r.code) for r in records.in_text_order(found, positions).collect()]
    # the narrowed line of f3.rs doesn't begin with its visibility, so it reads as no record
    assert codes == [("f0.rs", "FIX"), ("f0.rs", "REORDER"), ("f1.md", "FIX")]
    out, found = tidy.tidy(df, mode="apply")
    got = {r.path: r for r in out.collect()}
    assert got["f0.rs"].new_text == "/// [x]\n///\n/// [x]: u\npub fn a() { b() }\n\nfn b() {}\n"
    assert got["f1.md"].new_text == "| a  |\n| -- |\n| bb |\n" and got["f2.rs"].failed and got["f2.rs"].new_text == "// nothing\n" and got["f4.txt"].failed
    assert "pub(super) fn q" in got["f3.rs"].new_text
    report = json.loads(sinks.json_array(found, positions))
    assert report and set(report[0]) <= {"path", "line", "severity", "code", "message", "item_kind", "item_name"}
    assert json.loads(sinks.json_array(found.limit(0), positions)) == []
    assert any("REORDER" in line for line in sinks.text_lines(found, positions))
    assert records.exit_status(found, failed_files=1) == 1 and records.exit_status(found.where("severity = 'success'")) == 0
    sinks.write_changed(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_rules_gate_operators(spark):
    df = frame(spark, RUN)
    _, found = tidy.tidy(df, include=["tables"])
    assert {(r.path, r.code) for r in found.collect()} == {("f1.md", "FIX")}
    _, found = tidy.tidy(df, config.parse("exclude:\n  - files: ['*.md']\n    rules: [tables]\n"), exclude=["links", "reorder", "vis"])
    assert found.where("severity = 'success'").collect() == []
    with pytest.raises(ValueError):
        tidy.tidy(df, include=["unknown"])


def test_in_place(spark, tmp_path):
    p = tmp_path / "x.md"
    p.write_text("old")
    df = spark.createDataFrame([(str(p), "old", "new")], "path string, text string, new_text string")
    assert sinks.write_in_place(df, dry_run=True) == [str(p)] and p.read_text() == "old"
    sinks.write_in_place(df)
    assert p.read_text() == "new"
    assert sinks.post_process([(["true"], ["md"]), (["false"], ["rs"])], [str(p)]) == []
    assert len(sinks.post_process([(["false"], [])], [str(p)])) == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("|a|\n|-|\n|bb|\n")
    q = tidy_stream.start(tidy_stream.fixed(tidy_stream.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0].text == "| a  |\n| -- |\n| bb |\n"


def test_listed_files_are_looked_up(spark):
    df = spark.createDataFrame([("a.rs",), ("b.rs",), ("d/c.md",), ("a.rs",), ("axrs",), (None,)], "rel string")
    out = policy.policies(df, policy.groups_frame(spark, [(["b.rs", "*.md"], ["vis"]), (["d/*", "b.rs"], ["tables"])]), False, ["a.rs", "d/**", "none.rs"])
    assert sorted((r.rel or "", r.skip, r.disabled) for r in out.collect()) == [("", False, []), ("a.rs", True, []), ("a.rs", True, []), ("axrs", False, []), ("b.rs", False, ["tables", "vis"]), ("d/c.md", True, ["tables"])]
    listed = tidy.with_policy(spark.range(9).selectExpr("concat('f', id, '.rs') as path", "'rs' as ext"), config.Config(exclude_files=[f"f{i}.rs" for i in range(0, 9, 2)]))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "hashpartitioning" not in plan and listed.where("skip").count() == 5
    assert sorted(r.re for r in policy.dead_globs(policy.groups_frame(spark, [(["a.rs", "e/*", "e.rs", "*.rs"], [])]), df).collect()) == ["^e/[^/]*$", "^e\\.rs$"]


def test_short_rows_are_spread(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "uuid() as more").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = files.spread(spark.read.parquet(str(tmp_path / "t")))
    sizes = rows.selectExpr("id % 2 as x", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 30_000 and sum(r["count"] for r in sizes) == 200_000
    assert "more" not in rows.select("id")._jdf.queryExecution().executedPlan().toString()
    assert rows.select("id").distinct().count() == 200_000
    assert files.spread(spark.read.parquet("/root/testdata/sf0.001/part.parquet")).rdd.getNumPartitions() == 1


def test_suppression_moves_one_row_a_file(spark):
    found = spark.createDataFrame([("a", "DOC001"), ("a", "DOC002"), ("b", "DOC001"), ("c", "DOC003"), (None, "DOC001")], "path string, code string")
    rows = spark.createDataFrame([("a", None, ["DOC001"]), ("b", ["tables"], []), ("b", None, []), ("c", None, []), (None, ["tables"], [])], "path string, enabled array<string>, disabled array<string>")
    out = policy.suppress(found, rows)
    assert out.columns == ["path", "code"] and sorted(map(str, ((r.path, r.code) for r in out.collect()))) == ["('a', 'DOC002')", "('c', 'DOC003')", "(None, 'DOC001')"]
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
