"""Further driver queries: kinds of items, edges, documentation comments, policies, sources, sinks and the command line."""

from __future__ import annotations

import contextlib
import io
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe import __main__ as command
from lathe.operators import graph, lints, parse, policy, records, reorder, tables, texts, vis
from lathe.plans import tidy
from lathe.plans.catalog import GROUPS, KIND, LEAF, LINTS, MATCHED, NARROW, NL, PATHS, _crate, _files, _lines, _nation_links, _table, query, rust_files
from lathe.sources import config, files, scratch, sinks

K = "cast(p_partkey as string)"
#: (source of an item, kind, name, impl target, visibility, test module, inline, trait impl, returns Result, parameters)
ITEMS = [
    (f"concat('pub struct S', {K}, '(pub u8);')", "struct", "S", "", 0, 0, 0, 0, 0, 0),
    (f"concat('enum E', {K}, ' {{ A, B }}')", "enum", "E", "", 2, 0, 0, 0, 0, 0),
    (f"concat('pub(crate) union U', {K}, ' {{ a: u8 }}')", "union", "U", "", 1, 0, 0, 0, 0, 0),
    (f"concat('type T', {K}, ' = Vec<u8>;')", "type", "T", "", 2, 0, 0, 0, 0, 0),
    (f"concat('pub trait R', {K}, ' {{ fn go(&self); }}')", "trait", "R", "", 0, 0, 0, 0, 0, 0),
    (f"concat('impl S', {K}, ' {{ pub fn new() -> u8 {{ 0 }} }}')", "impl", "", "S", None, 0, 0, 0, 0, 0),
    (f"concat('impl Clone for S', {K}, ' {{}}')", "impl", "", "S", None, 0, 0, 1, 0, 0),
    (f"concat('pub const C', {K}, ': u8 = 1;')", "const", "C", "", 0, 0, 0, 0, 0, 0),
    (f"concat('static mut G', {K}, ': u8 = 2;')", "static", "G", "", 2, 0, 0, 0, 0, 0),
    (f"concat('extern crate x', {K}, ';')", "extern", "", "", 2, 0, 0, 0, 0, 0),
    (f"concat('macro_rules! m', {K}, ' {{ () => {{}}; }}')", "macro", "m", "", None, 0, 0, 0, 0, 0),
    (f"concat('m', {K}, '!();')", "macro-invocation", "m", "", None, 0, 0, 0, 0, 0),
    (f"concat('#[cfg(test)]', {NL}, 'mod tests', {K}, ' {{}}')", "mod", "tests", "", 2, 1, 1, 0, 0, 0),
    (f"concat('pub mod n', {K}, ';')", "mod", "n", "", 0, 0, 0, 0, 0, 0),
    (f"concat('use a::b', {K}, ';')", "use", "", "", 2, 0, 0, 0, 0, 0),
    (f"concat('pub async unsafe fn f', {K}, '<T: A>(mut a: u8, (b, c): (u8, u8), _: u8) -> io::Result<()> {{}}')", "fn", "f", "", 0, 0, 0, 0, 1, 1),
]


def _values(rows) -> str:
    one = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


@query(f"""with k(k, kind, name, target, vis, test, inl, tr, res, params) as (values {_values([(i, *x[1:]) for i, x in enumerate(ITEMS)])})
  select concat('i', p_partkey) as path, 2 as start_line, kind, case when name <> '' then concat(name, p_partkey) end as name, case when target <> '' then concat(target, p_partkey) end as impl_target, cast(vis as int) as vis,
  test = 1 as is_test_module, inl = 1 as is_inline, tr = 1 as is_trait_impl, res = 1 as returns_result, cast(params as int) as n_params from part join k on p_partkey % {len(ITEMS)} = k""")
def item_kinds(spark, sf):
    text = f"concat({NL}, case p_partkey % {len(ITEMS)} " + " ".join(f"when {i} then {x[0]}" for i, x in enumerate(ITEMS)) + f" end, {NL})"
    found = parse.items(parse.scan(_files(spark, sf, "part", "concat('i', p_partkey) as path", f"{text} as text")))
    return found.select("path", "start_line", "kind", "name", "impl_target", "vis", "is_test_module", "is_inline", "is_trait_impl", "returns_result", F.size("params").alias("n_params"))


I = ["p_partkey div 50 as path", "cast(p_partkey % 50 as int) as idx", f"{KIND} as kind", "p_brand as name", "p_size % 2 = 0 as is_test_module", "p_size % 3 = 0 as is_inline", "cast(p_size % 3 as int) as vis"]
CALLS = ["p_partkey div 50 as path", "cast(p_partkey % 50 as int) as src", "concat('Brand#', cast((p_size % 5 + 1) * 10 + p_partkey % 5 + 1 as string)) as name", "p_partkey % 2 = 0 as is_call"]
EDGES = f"""with i as (select p_partkey // 50 as path, cast(p_partkey % 50 as int) as idx, {KIND} as kind, p_brand as name, p_size from part), t as (select path, name, min(idx) as dst from i group by all), m as (select distinct path, name from i where kind = 'macro'),
  c as (select p_partkey // 50 as path, cast(p_partkey % 50 as int) as src, concat('Brand#', (p_size % 5 + 1) * 10 + p_partkey % 5 + 1) as name, p_partkey % 2 = 0 as is_call from part),
  e as (select c.path, case when is_call and m.name is not null then dst else src end as src, case when is_call and m.name is not null then src else dst end as dst from c join t on t.path = c.path and t.name = c.name left join m on m.path = c.path and m.name = c.name where src <> dst)"""


@query("select p_partkey // 50 as path, p_brand as name, cast(min(p_partkey % 50) as int) as idx from part group by all")
def item_name_index(spark, sf):
    return reorder.name_index(_table(spark, sf, "part", *I))


@query(EDGES + " select path, src, dst from e")
def reference_edges(spark, sf):
    return reorder.edges_of(_table(spark, sf, "part", *CALLS), _table(spark, sf, "part", *I))


@query(EDGES + """, g as (select i.path, idx, concat(case kind when 'mod' then (case when p_size % 2 = 0 and p_size % 3 = 0 then 10 else 3 end) when 'macro-invocation' then (case when m.name is not null then 4 else 1 end) when 'other' then 1 when 'use' then 2 when 'macro' then 4
  when 'const' then 5 when 'struct' then 6 when 'trait' then 7 when 'impl' then 8 else 9 end, '/', case when kind = 'fn' then p_size % 3 else -1 end) as g from i left join m on m.path = i.path and m.name = i.name)
  select e.path, src, dst from e join g a on a.path = e.path and a.idx = src join g b on b.path = e.path and b.idx = dst where a.g = b.g""")
def phase_edges(spark, sf):
    items = _table(spark, sf, "part", *I)
    return reorder.group_edges(reorder.edges_of(_table(spark, sf, "part", *CALLS), items), reorder.phases(items))


@query("""select concat('p', p_partkey, '.rs') as path, concat('use b::c;', chr(10), chr(10), 'macro_rules! m', p_partkey, ' { () => {}; }', chr(10), chr(10), 'm', p_partkey, '!();', chr(10), chr(10), 'struct S', p_partkey, ';', chr(10), chr(10), 'impl S', p_partkey, ' {}', chr(10), chr(10),
  'impl Clone for S', p_partkey, ' {}', chr(10), chr(10), 'pub fn b() { z() }', chr(10), chr(10), 'fn a() {}', chr(10), chr(10), 'fn z() {}', chr(10)) as new_text, false as broken from part""")
def reordered_macros_and_impls(spark, sf):
    text = f"concat('fn z() {{}}', {NL}, 'm', {K}, '!();', {NL}, 'macro_rules! m', {K}, ' {{ () => {{}}; }}', {NL}, 'fn a() {{}}', {NL}, 'pub fn b() {{ z() }}', {NL}, 'impl Clone for S', {K}, ' {{}}', {NL}, 'impl S', {K}, ' {{}}', {NL}, 'struct S', {K}, ';', {NL}, 'use b::c;', {NL})"
    return reorder.reorder(_files(spark, sf, "part", "concat('p', p_partkey, '.rs') as path", f"{text} as text")).select("path", "new_text", "broken")


@query("""select p_partkey // 50 as path from part group by p_partkey // 50 having (p_partkey // 50) % 3 <> 0 and count(*) > 1""")
def permutation_faults(spark, sf):
    """Every third file is in order; of the others, one repeats a place and one starts at 1."""
    place = "case p_partkey div 50 % 3 when 0 then p_partkey % 50 - least when 1 then greatest(p_partkey % 50 - least, 1) else p_partkey % 50 - least + 1 end as out_pos"
    rows = _table(spark, sf, "part", "p_partkey", "p_partkey div 50 as path")
    least = rows.groupBy("path").agg(F.min(F.col("p_partkey") % 50).alias("least"))
    return reorder.permutation_faults(rows.join(least, "path").selectExpr("path", "p_partkey % 50 - least as idx", place))


@query("""with recursive n as (select p_partkey // 60 as graph, p_partkey % 60 as node from part), l as (select graph, node, 0 as level from n where node = 0
  union all select n.graph, n.node, l.level + 1 from l join n on n.graph = l.graph and n.node in (2 * l.node + 1, 2 * l.node + 2))
  select graph, node, row_number() over (partition by graph order by level, node) - 1 as out_pos from l""")
def toposort_stable(spark, sf):
    nodes = _table(spark, sf, "part", "p_partkey div 60 as graph", "p_partkey % 60 as node", "p_name as name")
    ends = nodes.select("graph", F.col("node").alias("dst")).where("dst > 0")
    return graph.toposorted_whole(nodes, ends.select("graph", F.expr("(dst - 1) div 2").alias("src"), "dst"), alphabetical=False).join(nodes.where("node = 0").select("graph"), "graph").select("graph", "node", "out_pos")


END = "case when c_custkey % 2 = 0 then concat(chr(13), chr(10)) else chr(10) end"
PREFIX = "case c_custkey % 3 when 0 then '' when 1 then '/// ' else '//! ' end"


@query(f"""with w as (select *, cast(greatest(length(c_name), 4) as int) as a, {END} as e, {PREFIX} as p from customer)
  select concat('c', c_custkey) as path, concat(p, '| ', rpad('name', a, ' '), ' | k ', ' |', e, p, '| ', repeat('-', a), ' | --', ' |', e, p, '| ', rpad(c_name, a, ' '), ' | v', c_custkey % 3, ' |', e) as new_text,
  case when c_custkey % 5 = 0 then 0 else 1 end as n_records from w""")
def doc_comment_tables(spark, sf):
    """Tables in documentation comments and with either line ending; those of every fifth customer are aligned already."""
    width = "cast(greatest(length(c_name), 4) as int)"
    line = lambda a, b: f"{PREFIX}, case when c_custkey % 5 = 0 then concat('| ', {a}, ' | ', {b}, ' |') else concat('|', trim({a}), '|', trim({b}), '|') end, {END}"
    text = "concat(" + ", ".join([line(f"rpad('name', {width}, ' ')", "'k '"), line(f"repeat('-', {width})", "'--'"), line(f"rpad(c_name, {width}, ' ')", "concat('v', cast(c_custkey % 3 as string))")]) + ")"
    fixed = texts.fix_tables(_files(spark, sf, "customer", "concat('c', c_custkey) as path", "'md' as ext", f"{text} as text"))
    return fixed.join(records.fix_records(fixed, "tables").where("code = 'FIX' and message = 'tables were aligned'").groupBy("path").agg(F.count("*").cast("int").alias("n")), "path", "left").select("path", "new_text", F.coalesce("n", F.lit(0)).alias("n_records"))


@query(f"""with w as (select *, {END} as e from customer) select concat('c', c_custkey) as path, concat('//! See [', c_mktsegment, '] and [', c_mktsegment, '].', e, '//!', e, '//! [', c_mktsegment, ']: u', c_custkey, e, 'fn a() {{}}', e, '/// x [', c_mktsegment, ']', e, '/// y [o](p)', e, '///', e, '/// [', c_mktsegment, ']: u', c_custkey, e,
  'fn b() {{ "[', c_mktsegment, '](u', c_custkey, ')" }}', e) as new_text, concat('`', '[', c_mktsegment, '](u', c_custkey, ')') as old from w""")
def doc_comment_links(spark, sf):
    """Each block of documentation comments gets its definitions; code in between stays."""
    link = "concat('[', c_mktsegment, '](u', c_custkey, ')')"
    text = f"concat('//! See ', {link}, ' and ', {link}, '.', {END}, 'fn a() {{}}', {END}, '/// x ', {link}, {END}, '/// y [o](p)', {END}, 'fn b() {{ \"', {link}, '\" }}', {END})"
    fixed = texts.fix_links(_files(spark, sf, "customer", "concat('c', c_custkey) as path", "'rs' as ext", f"{text} as text"), 2)
    found = records.fix_records(fixed, "links").select("path", F.element_at(F.split("message", "` -> `"), 1).alias("old"))
    return fixed.join(found, "path").select("path", "new_text", "old")


@query("select concat('c', c_custkey) as path, c_custkey % 3 = 0 as rust from customer where c_custkey % 3 = 0")
def rust_link_context(spark, sf):
    from lathe.operators import links

    text = f"case c_custkey % 3 when 0 then concat('text', {NL}, '/// doc', {NL}) when 1 then concat('```', {NL}, '/// doc', {NL}, '```', {NL}) else concat('text', {NL}) end"
    return links.rust_context(links.lines(_table(spark, sf, "customer", "concat('c', c_custkey) as path", f"{text} as text"))).select("path", F.lit(True).alias("rust"))


@query("select concat('x', p_partkey) as path, cast(case p_partkey % 4 when 0 then 3 when 1 then 2 else 5 end as int) as least, case p_partkey % 4 when 0 then 3 when 1 then 2 else 1 end as alone from part")
def link_thresholds(spark, sf):
    ext = "case p_partkey % 4 when 0 then 'rs' when 1 then 'md' when 2 then 'MD' else '' end as ext"
    own = {"rs": 3, "md": 2}
    return _table(spark, sf, "part", "concat('x', p_partkey) as path", ext).select("path", policy.link_threshold(F.col("ext"), own, 5).alias("least"), policy.link_threshold(F.col("ext"), own, None).alias("alone"))


@query(LINTS + """select l.path, line, code, item_name from l join part on l.path = concat('src/p', p_partkey, '.rs') where case p_size % 4 when 0 then code not in ('DOC001', 'TEST001') when 1 then code in ('DOC001', 'DOC006') when 2 then false else true end""")
def lint_suppression(spark, sf):
    """Files turn codes off, keep some, keep none, or have no policy."""
    found = lints.run_all(parse.items(parse.scan(rust_files(spark, sf))))
    none, some = "cast(array() as array<string>)", lambda *x: f"array({', '.join(repr(v) for v in x)})"
    rows = _table(spark, sf, "part", "concat('src/p', p_partkey, '.rs') as path", f"case p_size % 4 when 1 then {some('DOC001', 'DOC006', 'tables')} when 2 then {some('tables')} end as enabled", f"case p_size % 4 when 0 then {some('DOC001', 'TEST001')} else {none} end as disabled")
    return policy.suppress(found, rows).select("path", "line", "code", "item_name")


@query(MATCHED + "select * from (select 'src/**/*.rs' as pattern where not exists (select 1 from g where a) union all select '**/*.{md,txt}' where not exists (select 1 from g where c) union all select 'vendor/**' union all select 'src/*.rs')")
def dead_globs(spark, sf):
    patterns = [g for globs, _ in GROUPS for g in globs if g not in ("src/ECONOMY/*", "src/*/cold*")] + ["vendor/**", "src/*.rs"]
    found = policy.dead_globs(policy.groups_frame(spark, [([p], ["tables"]) for p in patterns]), _table(spark, sf, "part", PATHS))
    return found.join(spark.createDataFrame(list(enumerate(patterns)), "grp int, pattern string"), "grp").select("pattern")


@query("""select concat('s', s_suppkey) as path, case when s_suppkey % 2 = 0 then concat('pub(crate) fn a', s_suppkey, '() {}', chr(10), 'pub(crate) mod inner {', chr(10), '    pub(crate) fn x() {}', chr(10), '}', chr(10))
  else concat('pub fn a', s_suppkey, '() {}', chr(10), 'pub(crate) mod inner {', chr(10), '    pub(crate) fn x() {}', chr(10), '}', chr(10)) end as new_text from supplier""")
def narrowed_inline_modules(spark, sf):
    """A restricted inline module sets a floor for what is in it; a file's own floor goes for the rest."""
    text = f"concat('pub fn a', s_suppkey, '() {{}}', {NL}, case when s_suppkey % 2 = 0 then 'pub' else 'pub(crate)' end, ' mod inner {{', {NL}, '    pub fn x() {{}}', {NL}, '}}', {NL})"
    rows = _files(spark, sf, "supplier", "concat('s', s_suppkey) as path", f"{text} as text", "case when s_suppkey % 2 = 0 then 'pub(crate)' end as floor", "cast(null as array<string>) as blocked")
    return vis.narrow_files(rows).select("path", "new_text")


@query(f"""select {LEAF} as path, true as processed from nation n where {NARROW} union all select 'other/x.rs', true""")
def crate_context_files(spark, sf):
    """A run over a crate and a file outside its tree: the tree's floors and re-exports for the one, its own for the other."""
    crate = _crate(spark, sf).select("path", "ext", "text")
    other = spark.createDataFrame([("other/x.rs", "rs", "pub(crate) mod inner {\n    pub fn x() {}\n}\n")], "path string, ext string, text string")
    rows = crate.unionByName(other).withColumn("pos", F.lit(0))
    out, _ = tidy.tidy(rows, mode="apply", include=["vis"], root="c/lib.rs", crate_files=crate)
    return out.where("new_text <> text").select("path", "processed")


@query("""select concat('s', s_suppkey) as path, s_suppkey % 4 <> 3 and s_suppkey % 4 <> 2 as processed, s_suppkey % 4 = 2 as failed, case s_suppkey % 4 when 0 then concat('fn a() {}', chr(10), chr(10), 'fn b() {}', chr(10)) else concat('fn b() {}', chr(10), 'fn a() {}', chr(10)) end as new_text from supplier where s_suppkey % 4 <> 2
  union all select concat('s', s_suppkey), false, true, null from supplier where s_suppkey % 4 = 2""")
def rust_gate(spark, sf):
    """Reordering is for Rust alone; a text that isn't UTF-8 fails; a file that its configuration skips isn't processed."""
    rows = _files(spark, sf, "supplier", "concat('s', s_suppkey) as path", "case s_suppkey % 4 when 1 then 'md' else 'rs' end as ext", f"case when s_suppkey % 4 <> 2 then concat('fn b() {{}}', {NL}, 'fn a() {{}}', {NL}) end as text", "cast(s_suppkey as int) as pos", "s_suppkey as k")
    skip = [f"s{r.k}" for r in rows.where("k % 4 = 3").select("k").collect()]
    out, _ = tidy.tidy(rows, config.Config(exclude_files=skip), mode="apply")
    return out.select("path", "processed", "failed", "new_text")


@query("""select concat('{"path":"c', c_custkey, '","line":null,"severity":"success","code":"FIX","message":"tables were aligned","item_kind":"table","item_name":null}') as json from customer where c_custkey % 5 <> 0
  union all select concat('{"path":"n', n_nationkey, '","line":2,"severity":"success","code":"FIX","message":"flip nested fence at line 2","item_kind":"fence","item_name":null}') from nation
  union all select concat('{"path":"n', n_nationkey, '","line":4,"severity":"success","code":"FIX","message":"flip nested fence at line 4","item_kind":"fence","item_name":null}') from nation""")
def records_json_nulls(spark, sf):
    table = "concat(case when c_custkey % 5 = 0 then concat('| ab |', chr(10), '| -- |', chr(10)) else concat('|ab|', chr(10), '|-|', chr(10)) end)"
    one = texts.fix_tables(_files(spark, sf, "customer", "concat('c', c_custkey) as path", "'md' as ext", f"{table} as text"))
    two = texts.fix_fences(_table(spark, sf, "nation", "concat('n', n_nationkey) as path", "'md' as ext", _lines("'```md'", "'```rust'", "'x'", "'```'", "'```'") + " as text"))
    return records.json_objects(records.fix_records(one, "tables").unionByName(records.fix_records(two, "fences"))).select("json")


@query("""select * from (values ('clean', 0), ('warnings', 0), ('errors', 1), ('failed_file', 1), ('failed_step', 1)) t(run, status)""")
def exit_statuses(spark, sf):
    found = lints.run_all(parse.items(parse.scan(rust_files(spark, sf))))
    fine, status = found.where("severity = 'warning'"), records.exit_status
    rows = [("clean", status(found.limit(0))), ("warnings", status(fine)), ("errors", status(found)), ("failed_file", status(fine, 1)), ("failed_step", status(fine, 0, 1))]
    return spark.createDataFrame(rows, "run string, status int")


SETTINGS = {
    "both": "include:\n- files: ['*']\n  rules: [tables]\nexclude:\n- files: ['*']\n  rules: [tables]\n",
    "unknown_rule": "include:\n- files: ['*']\n  rules: [nope]\n",
    "unknown_key": "nope: 1\n",
    "threshold": "links:\n  min_occurrences: 0\n",
    "bad_glob": "exclude_files: ['a{b']\n",
    "no_command": "post_process:\n- extensions: [rs]\n",
    "good": "exclude:\n- files: ['src/**/*.rs']\n  rules: [DOC001, links]\nexclude_files: ['vendor/**']\nlinks:\n  min_occurrences: 2\n  by_extension: {rs: 3}\npost_process:\n- command: rustfmt --check\n  extensions: [rs]\n",
    "empty": "",
}


@query("""select * from (values ('both', false, 0, 0), ('unknown_rule', false, 0, 0), ('unknown_key', false, 0, 0), ('threshold', false, 0, 0), ('bad_glob', false, 0, 0), ('no_command', false, 0, 0), ('good', true, 2, 1), ('empty', true, 0, 0)) t(name, valid, least, steps)""")
def configurations(spark, sf):
    rows = []
    for name, text in SETTINGS.items():
        try:
            found = config.parse(text)
            rows.append((name, True, found.least or 0, len(found.post_process)))
        except ValueError:
            rows.append((name, False, 0, 0))
    return spark.createDataFrame(rows, "name string, valid boolean, least int, steps int")


def _nation_folder(spark, sf) -> str:
    """A folder on the driver with a Git top, a file for each nation in its region's folder, and ignored ones."""
    root = scratch.local_folder(spark)
    os.makedirs(f"{root}/.git")
    with open(f"{root}/.gitignore", "w") as file:
        file.write("r2/\n*_9.md\n")
    for r in _table(spark, sf, "nation").collect():
        os.makedirs(f"{root}/r{r.n_regionkey}", exist_ok=True)
        with open(f"{root}/r{r.n_regionkey}/n_{r.n_nationkey}.{'md' if r.n_nationkey % 3 else 'txt'}", "w", newline="") as file:
            file.write(f"|{r.n_name}|k|\n|-|-|\n")
    return root


@query("select concat('r', n_regionkey, '/n_', n_nationkey, '.md') as path, 'md' as ext, length(n_name) + 11 as n_bytes from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2 and n_nationkey <> 9")
def source_folder(spark, sf):
    root = _nation_folder(spark, sf)
    found = files.decoded(files.read_folder(spark, root))
    return found.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "ext", F.octet_length("text").cast("long").alias("n_bytes"))


@query("select concat('r', n_regionkey, '/n_', n_nationkey, '.md') as path, length(n_name) + 11 as n_bytes from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2 and n_nationkey <> 9")
def source_paths(spark, sf):
    root = _nation_folder(spark, sf)
    found = files.resolve_all([root, f"{root}/r0"])
    rows = files.decoded(files.first_spelling(files.read_paths(spark, [*found, *(f"{root}/r0/../{p[len(root) + 1 :]}" for p in found)])))
    return rows.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), F.octet_length("text").cast("long").alias("n_bytes"))


def _said(argv: list[str], spark) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        status = command.main(argv, spark)
    return status, out.getvalue(), err.getvalue()


@query("""select concat('r', n_regionkey, '/n_', n_nationkey) as path, case when n_nationkey % 3 <> 0 and n_regionkey <> 2 and n_nationkey <> 9 then concat('| ', n_name, ' | k |', chr(10), '| ', repeat('-', length(n_name)), ' | - |', chr(10)) else concat('|', n_name, '|k|', chr(10), '|-|-|', chr(10)) end as content,
  (n_nationkey % 3 <> 0 and n_regionkey <> 2 and n_nationkey <> 9) as reported from nation""")
def command_apply(spark, sf):
    """The command line over a folder: a dry run that writes nothing, then a run that rewrites what isn't ignored."""
    root = _nation_folder(spark, sf)
    before, dry, _ = _said([root, "--no-config", "--dry-run", "--json"], spark)
    untouched = all(open(p, newline="").read().startswith("|" + open(p, newline="").read()[1]) for p in files.resolve_all([root]))
    status, said, _ = _said([root, "--no-config", "--json"], spark)
    told = {r["path"].rsplit(".", 1)[0][len(root) + 1 :] for r in json.loads(said)}
    assert untouched and before == status == 0 and len(json.loads(dry)) == len(told)
    rows = []
    for folder, _, names in os.walk(root):
        for name in names:
            if name.startswith("n_"):
                with open(f"{folder}/{name}", newline="") as file:
                    key = f"{folder}/{name}".rsplit(".", 1)[0][len(root) + 1 :]
                    rows.append((key, file.read(), key in told))
    return spark.createDataFrame(rows, "path string, content string, reported boolean")


@query("""select concat('r', n_regionkey, '/n_', n_nationkey, '.md:success[FIX]: tables were aligned (table)') as report from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2 and n_nationkey <> 9""")
def command_text_report(spark, sf):
    root = _nation_folder(spark, sf)
    _, _, said = _said([root, "--no-config", "--dry-run", "--include", "tables"], spark)
    return spark.createDataFrame([(line[len(root) + 1 :],) for line in said.splitlines() if line.startswith(root)], "report string")


@query("""select concat('r', n_regionkey, '/n_', n_nationkey, '.md') as path, case when n_nationkey % 2 = 0 then 1 else 0 end as failed from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2 and n_nationkey <> 9""")
def post_processed(spark, sf):
    """A step for each file that passes or fails by its name."""
    root = _nation_folder(spark, sf)
    paths = files.resolve_all([root])
    failed = sinks.post_process([(["sh", "-c", 'case "$0" in *[02468].md) exit 3;; esac'], ["md"]), (["false"], ["rs"])], paths)
    return spark.createDataFrame([(p[len(root) + 1 :], sum(p in f for f in failed)) for p in paths], "path string, failed int")
