"""Registry of the driver queries and of their SQL.

The tables hold no source text, so queries make files out of their columns with expressions
that either engine has; the SQL answers from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions import columns as C
from lathe.operators import graph, links, lints, parse, policy, records, reorder, tables, texts, vis
from lathe.plans import tidy
from lathe.sources.files import first_spelling, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str, *expressions: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.selectExpr(*expressions) if expressions else df


def _files(spark: SparkSession, sf: str, name: str, *expressions: str) -> DataFrame:
    """A table of files, spread over tasks before its texts are made."""
    return spread(_table(spark, sf, name)).selectExpr(*expressions)


NL = "chr(10)"


def _lines(*parts: str) -> str:
    """A concatenation of expressions, each followed by a line feed."""
    return "concat(" + ", ".join(f"{p}, {NL}" for p in parts) + ")"


DOCS = [
    "''",
    _lines("'/// Does it.'"),
    _lines("'/// TODO it.'", "'///'", "'/// # Errors'", "'///'", "'/// Some text.'"),
    _lines("'/// Does.'", "'///'", "'/// # Errors'", "'///'", "'/// - [`E::X`]'", "'///'", "'/// # Arguments'", "'///'", "'/// - `a` - x'"),
    _lines("'/// A tbd-list and mytodo.'", "'///'", "'/// # Params'", "'///'", "'/// - b'"),
]
RUST = (
    "concat(case p_size % 5 " + " ".join(f"when {i} then {d}" for i, d in enumerate(DOCS)) + " end, case p_partkey % 3 when 0 then 'pub ' when 1 then 'pub(crate) ' else '' end, "
    "case when p_size % 2 = 0 then concat('fn f', p_partkey, '(a: u32, b: u32) -> Result<u8, E> { Ok(0) }') else concat('fn f', p_partkey, '() -> u8 { 0 }') end, chr(10), "
    "case when p_partkey % 7 = 0 then concat('#[test]', chr(10), 'fn test_', p_partkey, '() {}', chr(10)) else '' end)"
)


def rust_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "part", "concat('src/p', p_partkey, '.rs') as path", "'rs' as ext", f"{RUST} as text", "cast(p_partkey as int) as pos")


LINTS = """with p as (select concat('src/p', p_partkey, '.rs') as path, concat('f', p_partkey) as f, concat('test_', p_partkey) as t, p_partkey % 3 as v, p_size % 5 as d, p_size % 2 = 0 as r,
  p_partkey % 7 = 0 as test, case p_size % 5 when 0 then 2 when 1 then 3 when 3 then 11 else 7 end as test_line from part),
l as (select path, 1 as line, 'error' as severity, 'DOC001' as code, 'non-private item is missing a doc comment' as message, f as item_name from p where v < 2 and d = 0
 union all select path, 1, 'error', 'DOC002', 'pub fn returning Result is missing a `# Errors` doc section', f from p where v = 0 and r and d in (0, 1, 4)
 union all select path, 1, 'warning', 'DOC003', '`# Errors` section does not name any concrete error variant', f from p where v = 0 and r and d = 2
 union all select path, 1, 'warning', 'DOC004', 'pub fn with parameters is missing a `# Arguments` doc section', f from p where v = 0 and r and d in (0, 1, 2)
 union all select path, 1, 'warning', 'DOC005', concat('parameter(s) not documented in the `# Arguments` section: `', case d when 3 then 'b' else 'a' end, '`'), f from p where v = 0 and r and d in (3, 4)
 union all select path, 1, 'warning', 'DOC006', 'doc comment contains placeholder text (TODO/FIXME/TBD)', f from p where d in (2, 4)
 union all select path, test_line, 'warning', 'TEST001', concat('test function `', t, '` should use a behavioral name', ' (subject_should_expectation_when_condition), ', 'not a `test_*` or ', '`case_*` prefix'), t from p where test)
"""


@query(LINTS + "select path, line, severity, code, message, 'fn' as item_kind, item_name from l")
def lint_all_codes(spark, sf):
    return lints.run_all(parse.items(parse.scan(rust_files(spark, sf)))).select(*records.FIELDS)


@query(LINTS + "select code, severity, count(*) as n from l group by code, severity")
def lint_counts(spark, sf):
    return lints.run_all(parse.items(parse.scan(rust_files(spark, sf)))).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("""select concat('src/p', p_partkey, '.rs') as path, 0 as idx, concat('f', p_partkey) as name, 'fn' as kind, cast(p_partkey % 3 as int) as vis, p_size % 2 = 0 as returns_result,
  case when p_size % 2 = 0 then 'a,b' else '' end as params, cast(case p_size % 5 when 0 then 0 when 1 then 1 when 3 then 9 else 5 end as int) as n_docs, false as is_test_fn from part
  union all select concat('src/p', p_partkey, '.rs'), 1, concat('test_', p_partkey), 'fn', 2, false, '', 0, true from part where p_partkey % 7 = 0""")
def parsed_items(spark, sf):
    items = parse.items(parse.scan(rust_files(spark, sf)))
    return items.select("path", "idx", "name", "kind", "vis", "returns_result", F.array_join("params", ",").alias("params"), F.size("doc_comments").alias("n_docs"), "is_test_fn")


@query(r"""select doc_id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') as has_the, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])der([^\p{L}\p{N}_]|$)') as has_der from documents""")
def placeholder_words(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", C.has_word(F.col("text"), "the").alias("has_the"), C.has_word(F.col("text"), "der").alias("has_der"))


ENDINGS = "case doc_id % 3 when 0 then replace(text, chr(10), concat(chr(13), chr(10))) when 1 then concat('a', chr(13), chr(10), 'b', chr(13), chr(10), text) else text end"


@query(f"""with d as (select doc_id as path, {ENDINGS} as t from documents), c as (select path, cast((length(t) - length(replace(t, concat(chr(13), chr(10)), ''))) / 2 as bigint) as crlf, length(t) - length(replace(t, chr(10), '')) as n from d)
  select path, crlf, n - crlf as lf, case when crlf > 0 and crlf >= n - crlf then 'crlf' else 'lf' end as ending from c""")
def line_ending_profile(spark, sf):
    return links.ending_profile(_table(spark, sf, "documents", "doc_id as path", f"{ENDINGS} as text"))


@query("""with o as (select doc_id as path, unnest(string_split(text, chr(10))) as line from documents), n as (select doc_id as path, unnest(string_split(case when doc_id % 2 = 0 then replace(text, ' the ', ' a ') else text end, chr(10))) as line from documents),
  a as (select path, line, count(*) as c from o where trim(line) <> '' group by all), b as (select path, line, count(*) as c from n where trim(line) <> '' group by all)
  select coalesce(a.path, b.path) as path, coalesce(a.line, b.line) as line, coalesce(a.c, 0) as n_old, coalesce(b.c, 0) as n_new from a full join b on a.path = b.path and a.line = b.line where coalesce(a.c, 0) <> coalesce(b.c, 0)""")
def line_multiset_diff(spark, sf):
    old = _table(spark, sf, "documents", "doc_id as path", "text")
    return reorder.line_differences(old, _table(spark, sf, "documents", "doc_id as path", "case when doc_id % 2 = 0 then replace(text, ' the ', ' a ') else text end as text"))


@query("""with a as (select doc_id, text, concat(lang, '/', n_chars % 40, '/', source) as inode, row_number() over (partition by text order by doc_id) as r from documents),
  b as (select doc_id, row_number() over (partition by inode order by doc_id) as r from a where r = 1) select doc_id from b where r = 1""")
def dedup_first_spelling(spark, sf):
    files = _table(spark, sf, "documents", "doc_id", "text as canonical", "concat(lang, '/', n_chars % 40, '/', source) as inode")
    return first_spelling(files, pos="doc_id").select("doc_id")


TABLE = _lines("'text before'", "'| name|seg |'", "'|:--|--:|'", "concat('| ', c_name, ' | ', c_mktsegment, ' | more |')", "concat('|x|', c_custkey, '|')") 


@query("""with w as (select *, cast(greatest(length(c_name), 4) as int) as a, cast(greatest(length(c_mktsegment), 3, length(cast(c_custkey as varchar))) as int) as b from customer)
  select concat('c', c_custkey, '.md') as path, concat('text before', chr(10), '| ', rpad('name', a, ' '), ' | ', lpad('seg', b, ' '), ' |', chr(10), '| :', repeat('-', a - 1), ' | ', repeat('-', b - 1), ': |', chr(10),
  '| ', rpad(c_name, a, ' '), ' | ', lpad(c_mktsegment, b, ' '), ' |', chr(10), '| ', rpad('x', a, ' '), ' | ', lpad(cast(c_custkey as varchar), b, ' '), ' |', chr(10)) as new_text from w""")
def table_realign(spark, sf):
    files = _files(spark, sf, "customer", "concat('c', c_custkey, '.md') as path", "'md' as ext", f"{TABLE} as text")
    return texts.fix_tables(files).select("path", "new_text")


@query("""with w as (select *, cast(greatest(length(c_name), 4) as int) as a, cast(greatest(length(c_mktsegment), 3, length(cast(c_custkey as varchar))) as int) as b from customer), r as (
  select c_custkey, 2 as line_no, concat('| ', rpad('name', a, ' '), ' | ', lpad('seg', b, ' '), ' |') as new_body from w
  union all select c_custkey, 3, concat('| :', repeat('-', a - 1), ' | ', repeat('-', b - 1), ': |') from w
  union all select c_custkey, 4, concat('| ', rpad(c_name, a, ' '), ' | ', lpad(c_mktsegment, b, ' '), ' |') from w
  union all select c_custkey, 5, concat('| ', rpad('x', a, ' '), ' | ', lpad(cast(c_custkey as varchar), b, ' '), ' |') from w)
  select concat('c', c_custkey, '.md') as path, line_no, new_body from r""")
def table_rows_rebuilt(spark, sf):
    files = _table(spark, sf, "customer", "concat('c', c_custkey, '.md') as path", f"{TABLE} as text")
    return tables.rebuilt(tables.tables(tables.lines(files))).select("path", "line_no", "new_body")


@query("""select concat('r', n_regionkey) as path, cast(c as int) as col, cast(case c when 0 then greatest(6, max(length(n_name))) else greatest(3, max(length(cast(n_nationkey as varchar)))) end as int) as width
  from nation, (select unnest([0, 1]) as c) group by n_regionkey, c""")
def table_widths(spark, sf):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("|"), x["n_name"], F.lit("|"), x["n_nationkey"].cast("string"), F.lit("|"))), "\n")
    files = _table(spark, sf, "nation").groupBy(F.concat(F.lit("r"), "n_regionkey").alias("path")).agg(F.concat(F.lit("| nation | key |\n| ------------------------ | --- |\n"), rows).alias("text"))
    return tables.widths(tables.tables(tables.lines(files))).select("path", "col", "width")


MARKS = "case p_size % 4 when 0 then '---' when 1 then ':-' when 2 then '-:' else ':-:' end"


@query("""select concat('p', p_partkey) as path, case p_size % 4 when 0 then 'n' when 1 then 'l' when 2 then 'r' else 'c' end as how,
  case p_size % 4 when 0 then concat('| ', repeat('-', length(p_name)), ' |') when 1 then concat('| :', repeat('-', length(p_name) - 1), ' |') when 2 then concat('| ', repeat('-', length(p_name) - 1), ': |') else concat('| :', repeat('-', length(p_name) - 2), ': |') end as delimiter,
  case p_size % 4 when 2 then concat('| ', lpad('h', cast(length(p_name) as int), ' '), ' |') when 3 then concat('| ', repeat(' ', cast(ceil((length(p_name) - 1) / 2.0) as int)), 'h', repeat(' ', cast(floor((length(p_name) - 1) / 2.0) as int)), ' |') else concat('| ', rpad('h', cast(length(p_name) as int), ' '), ' |') end as header from part""")
def table_alignment_parse(spark, sf):
    text = _lines("'| h |'", f"concat('| ', {MARKS}, ' |')", "concat('| ', p_name, ' |')")
    found = tables.tables(tables.lines(_table(spark, sf, "part", "concat('p', p_partkey) as path", f"{text} as text")))
    new = tables.rebuilt(found).groupBy("path").agg(F.max(F.when(F.col("line_no") == 2, F.col("new_body"))).alias("delimiter"), F.max(F.when(F.col("line_no") == 1, F.col("new_body"))).alias("header"))
    return found.where("place = 2").select("path", F.element_at("how", 1).alias("how")).join(new, "path").select("path", "how", "delimiter", "header")


def _nation_links(spark, sf) -> DataFrame:
    """A file for each nation, a line for each of its customers; even nations define FURNITURE."""
    line = lambda x: F.concat(F.lit("see ["), x["c_mktsegment"], F.lit("](u"), (x["c_custkey"] % 3).cast("string"), F.lit(") for more\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), line), "")
    known = F.when(F.col("c_nationkey") % 2 == 0, F.lit("[FURNITURE]: elsewhere\n")).otherwise(F.lit(""))
    return _table(spark, sf, "customer").groupBy("c_nationkey").agg(rows.alias("rows")).select(F.concat(F.lit("n"), "c_nationkey", F.lit(".md")).alias("path"), F.concat("rows", known).alias("text"))


@query("select concat('n', c_nationkey, '.md') as path, c_mktsegment as label, concat('u', c_custkey % 3) as url, count(*) as n from customer group by c_nationkey, c_mktsegment, c_custkey % 3")
def link_pair_counts(spark, sf):
    return links.pair_counts(links.links_of(_nation_links(spark, sf))).select("path", "label", "url", "n")


@query("""with p as (select c_nationkey, c_mktsegment, c_custkey % 3 as u, count(*) as n, min(c_custkey) as first from customer group by all having count(*) >= 3),
  q as (select *, row_number() over (partition by c_nationkey, c_mktsegment order by first) as r from p where not (c_nationkey % 2 = 0 and c_mktsegment = 'FURNITURE'))
  select concat('n', c_nationkey, '.md') as path, c_mktsegment as label, concat('u', u) as url, n from q where r = 1""")
def link_first_url_wins(spark, sf):
    return links.hoisted(links.links_of(_nation_links(spark, sf)), 3).select("path", "label", "url", "n")


@query("""select concat('c', c_custkey, '.md') as path, case when c_nationkey % 2 = 0 then concat('See [', c_mktsegment, '] and [', c_mktsegment, '].', chr(10), 'End [one](only)', chr(10), chr(10), '[', c_mktsegment, ']: https://x.y/', c_custkey, chr(10))
  else concat('See [', c_mktsegment, '](https://x.y/', c_custkey, ').', chr(10), '```', chr(10), '[', c_mktsegment, '](https://x.y/', c_custkey, ')', chr(10), '```', chr(10)) end as new_text from customer""")
def link_rewrite(spark, sf):
    link = "concat('[', c_mktsegment, '](https://x.y/', c_custkey, ')')"
    text = f"case when c_nationkey % 2 = 0 then concat('See ', {link}, ' and ', {link}, '.', {NL}, 'End [one](only)', {NL}) else concat('See ', {link}, '.', {NL}, '```', {NL}, {link}, {NL}, '```', {NL}) end"
    return texts.fix_links(_files(spark, sf, "customer", "concat('c', c_custkey, '.md') as path", "'md' as ext", f"{text} as text"), 2).select("path", "new_text")


@query("select concat('s', s_suppkey) as path, s_name as label from supplier where s_suppkey % 3 <> 0")
def link_definitions_missing(spark, sf):
    text = f"concat('[', s_name, '](u)', {NL}, case when s_suppkey % 3 = 0 then concat('[', s_name, ']: <a b> \"title\"', {NL}) when s_suppkey % 3 = 1 then concat('[', s_name, ']: u x', {NL}) else '' end)"
    return links.hoisted(links.links_of(_table(spark, sf, "supplier", "concat('s', s_suppkey) as path", f"{text} as text"))).select("path", "label")


@query("select concat('e', event_id) as path, cast(case event_id % 4 when 0 then 1 when 1 then 2 when 2 then 0 else 1 end as bigint) as n from events where event_id % 4 <> 2")
def fence_masked_links(spark, sf):
    text = (
        f"case event_id % 4 when 0 then concat('```', {NL}, '[a](x)', {NL}, '```', {NL}, '[b](y)', {NL}) when 1 then concat('[a](x)', {NL}, '~~~ md', {NL}, '```', {NL}, '~~~~', {NL}, '[b](y)', {NL}) "
        f"when 2 then concat('````', {NL}, '[a](x)', {NL}, '```', {NL}, '[b](y)', {NL}) else concat('[a](x)', {NL}, '```', {NL}, '``` x', {NL}, '[b](y)', {NL}) end"
    )
    found = links.links_of(_table(spark, sf, "events", "concat('e', event_id) as path", f"{text} as text"))
    return found.where("label is not null").groupBy("path").agg(F.count("*").alias("n"))


@query("""with m as (select * from (values (0, 2), (0, 4), (1, 3), (1, 4)) t(k, line)) select event_id as path, line, concat('flip nested fence at line ', line) as message from events join m on event_id % 3 = k""")
def fence_flips(spark, sf):
    text = (
        f"case event_id % 3 when 0 then concat('```md', {NL}, '```rust', {NL}, 'x', {NL}, '```', {NL}, '```', {NL}) "
        f"when 1 then concat('~~~a', {NL}, '```b', {NL}, '```c', {NL}, '```', {NL}, '```', {NL}, '~~~', {NL}) else concat('```', {NL}, 'x', {NL}, '```', {NL}) end"
    )
    fixed = texts.fix_fences(_files(spark, sf, "events", "event_id as path", "'md' as ext", f"{text} as text"))
    return records.fix_records(fixed, "fences").select("path", "line", "message")


GROUPS = [(["src/**/*.rs"], ["DOC001", "tables"]), (["src/ECONOMY/*", "src/*/cold*"], ["links", "DOC001"]), (["**/*.{md,txt}"], ["vis"])]
PATHS = "concat(case p_size % 2 when 0 then 'src/' else 'lib/' end, p_type, '/', replace(p_name, ' ', '_'), case p_size % 3 when 0 then '.md' else '.rs' end) as rel"
MATCHED = r"""with f as (select p_partkey as path, concat(case p_size % 2 when 0 then 'src/' else 'lib/' end, p_type, '/', replace(p_name, ' ', '_'), case p_size % 3 when 0 then '.md' else '.rs' end) as rel from part),
  g as (select path, rel, regexp_matches(rel, '^src/(.*/)?[^/]*\.rs$') as a, regexp_matches(rel, '^src/(ECONOMY/[^/]*|[^/]*/cold[^/]*)$') as b, regexp_matches(rel, '^(.*/)?[^/]*\.(md|txt)$') as c from f) """


def _policies(spark, sf, white: bool) -> DataFrame:
    files = _table(spark, sf, "part", "p_partkey as path", PATHS)
    return policy.policies(files, policy.groups_frame(spark, GROUPS), white)


@query(MATCHED + "select path, concat(case when a or b then 'DOC001,' else '' end, case when b then 'links,' else '' end, case when a then 'tables,' else '' end, case when c then 'vis,' else '' end) as enabled from g")
def policy_effective_rules(spark, sf):
    return _policies(spark, sf, True).select("path", F.concat_ws("", F.transform("enabled", lambda r: F.concat(r, F.lit(",")))).alias("enabled"))


@query(MATCHED + "select path, false as white_tables, b as white_links, false as white_fences, not a as black_tables, not b as black_links, false as black_fences, true as only_vis from g")
def policy_override(spark, sf):
    """Excluding tables leaves white lists without it; excluding fences adds to black lists; including vis replaces either."""
    white = policy.override(_policies(spark, sf, True), [], ["tables"])
    black = policy.override(_policies(spark, sf, False), [], ["fences"])
    only = policy.override(_policies(spark, sf, False), ["vis"], [])
    one = white.select("path", *(policy.runs(o).alias(f"white_{o}") for o in ("tables", "links", "fences")))
    two = black.select("path", *(policy.runs(o).alias(f"black_{o}") for o in ("tables", "links", "fences")))
    return one.join(two, "path").join(only.select("path", policy.runs("vis").alias("only_vis")), "path")


@query(MATCHED + "select path, a or b as white, not false as black, cast(case when a or b then 6 else 7 end as int) as silent_white, cast(case when a or b then 1 else 0 end as int) as silent_black from g")
def lint_gate(spark, sf):
    white = _policies(spark, sf, True).select("path", policy.lints_run().alias("white"), F.size(policy.silent_codes()).alias("silent_white"))
    black = _policies(spark, sf, False).select("path", policy.lints_run().alias("black"), F.size(policy.silent_codes()).alias("silent_black"))
    return white.join(black, "path").select("path", "white", "black", "silent_white", "silent_black")


@query("""with recursive n as (select p_partkey // 60 as graph, p_partkey % 60 as node, p_name as name from part), l as (select graph, node, 0 as level from n where node % 3 = 0 and node = 0
  union all select n.graph, n.node, l.level + 1 from l join n on n.graph = l.graph and n.node in (2 * l.node + 1, 2 * l.node + 2))
  select n.graph, n.node, l.level, row_number() over (partition by n.graph order by l.level, name, n.node) - 1 as out_pos from n join l on n.graph = l.graph and n.node = l.node""")
def toposort_levels(spark, sf):
    nodes = _table(spark, sf, "part", "p_partkey div 60 as graph", "p_partkey % 60 as node", "p_name as name")
    ends = nodes.select("graph", F.col("node").alias("dst")).where("dst > 0")
    edges = ends.select("graph", F.expr("(dst - 1) div 2").alias("src"), "dst")
    return graph.toposorted_whole(nodes, edges).where("level is not null").select("graph", "node", "level", "out_pos")


def _levels_by_waves(spark, sf) -> DataFrame:
    """The same for graphs of any size, wave by wave over the cluster."""
    nodes = _table(spark, sf, "part", "p_partkey div 60 as graph", "p_partkey % 60 as node", "p_name as name")
    ends = nodes.select("graph", F.col("node").alias("dst")).where("dst > 0")
    found = graph.toposorted(graph.levels(nodes, ends.select("graph", F.expr("(dst - 1) div 2").alias("src"), "dst")))
    return found.where("level is not null").select("graph", "node", "level", "out_pos")


QUERIES["toposort_levels_by_waves"] = _levels_by_waves
SQL["toposort_levels_by_waves"] = SQL["toposort_levels"]


KIND = "case p_partkey % 10 when 0 then 'fn' when 1 then 'struct' when 2 then 'use' when 3 then 'mod' when 4 then 'macro-invocation' when 5 then 'macro' when 6 then 'impl' when 7 then 'const' when 8 then 'trait' else 'other' end"
ITEM = ["p_partkey div 100 as path", "cast(p_partkey % 100 as int) as idx", f"{KIND} as kind", "p_name as name", "p_size % 2 = 0 as is_test_module", "p_size % 3 = 0 as is_inline", "p_size % 2 = 1 as is_trait_impl", "cast(p_size % 3 as int) as vis", "p_type as impl_target"]


@query(f"""with i as (select p_partkey // 100 as path, cast(p_partkey % 100 as int) as idx, {KIND} as kind, p_name as name, p_size from part), m as (select distinct path, name from i where kind = 'macro')
  select i.path, i.idx, cast(case kind when 'mod' then (case when p_size % 2 = 0 and p_size % 3 = 0 then 10 else 3 end) when 'macro-invocation' then (case when m.name is not null then 4 else 1 end) when 'other' then 1 when 'use' then 2 when 'macro' then 4
  when 'const' then 5 when 'struct' then 6 when 'trait' then 7 when 'impl' then 8 else 9 end as int) as phase, cast(case when kind = 'fn' then p_size % 3 else -1 end as int) as tier from i left join m on m.path = i.path and m.name = i.name""")
def phase_assignment(spark, sf):
    return reorder.phases(_table(spark, sf, "part", *ITEM)).select("path", "idx", "phase", F.coalesce("tier", F.lit(-1)).alias("tier"))


@query("""with i as (select p_partkey // 50 as path, p_partkey % 50 as idx, case when p_partkey % 3 = 0 then 'impl' else 'struct' end as kind, case when p_partkey % 3 <> 0 then p_name end as name, p_size % 2 = 1 as t, p_type as target from part),
  n as (select path, case when kind = 'struct' then case when idx % 2 = 0 then target else name end end as name, min(idx) as at from i where kind = 'struct' group by all)
  select i.path, i.idx, cast(row_number() over (partition by i.path order by (n.at is null)::int, t::int, n.at, i.idx) as int) as place from i left join n on n.path = i.path and n.name = i.target where i.kind = 'impl'""")
def impl_placement(spark, sf):
    items = _table(spark, sf, "part", "p_partkey div 50 as path", "p_partkey % 50 as idx", "case when p_partkey % 3 = 0 then 'impl' else 'struct' end as kind", "case when p_partkey % 3 <> 0 then case when p_partkey % 50 % 2 = 0 then p_type else p_name end end as name", "p_size % 2 = 1 as is_trait_impl", "p_type as impl_target", "p_partkey % 50 as out_pos")
    return reorder.impl_placement(items).select("path", "idx", "place")


MOVED = """select l_orderkey as path, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as idx,
  cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 as int) as out_pos, 'fn' as kind, case when l_partkey % 5 > 0 then concat('f', l_partkey) end as name, cast(l_linenumber as int) as start_line from {t}"""


@query(f"""with o as ({MOVED.format(t='lineitem')}), n as (select *, lead(coalesce(name, concat('fn at line ', start_line))) over (partition by path order by out_pos) as before from o)
  select path, out_pos + 1 as "to", idx + 1 as "from", before, name, concat('rearrange ', case when name is null then concat('fn at line ', start_line) else concat('fn ', name) end, ' from pos ', idx + 1, ' to pos ', out_pos + 1, case when before is null then '' else concat(' (before ', before, ')') end) as message
  from n where idx > out_pos""")
def reorder_moves(spark, sf):
    _table(spark, sf, "lineitem").createOrReplaceTempView("lathe_lineitem")
    return reorder.moves(spark.sql(MOVED.format(t="lathe_lineitem"))).select("path", "to", "from", "before", "name", "message")


@query("""with i as (select p_partkey // 40 as path, p_partkey % 40 as idx, case when p_partkey % 4 = 0 then 'macro' else 'macro-invocation' end as kind, p_brand as name, (p_partkey * 7) % 40 as def_pos from part),
  d as (select path, name, min(def_pos) as pos from i where kind = 'macro' group by all),
  u as (select path, idx, def_pos as pos, 0 as c from i where kind = 'macro' union all select i.path, i.idx, d.pos, 1 from i join d on d.path = i.path and d.name = i.name where i.kind <> 'macro')
  select path, idx, cast(row_number() over (partition by path order by pos, c, idx) as int) as place from u""")
def macro_layout(spark, sf):
    items = _table(spark, sf, "part", "p_partkey div 40 as path", "p_partkey % 40 as idx", "case when p_partkey % 4 = 0 then 'macro' else 'macro-invocation' end as kind", "p_brand as name", "(p_partkey * 7) % 40 as def_pos")
    return reorder.macro_layout(items)


def _crate(spark, sf) -> DataFrame:
    """A crate: lib.rs declares regions, each region its nations (every fifth has no file); regions' and nations' keys set what is restricted."""
    region, nation = _table(spark, sf, "region"), _table(spark, sf, "nation")
    lib = region.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list("r_regionkey")), lambda k: F.concat(F.when(k % 2 == 0, F.lit("pub(crate) mod r")).otherwise(F.lit("pub mod r")), k.cast("string"), F.lit(";\n"))), "").alias("text")).select(F.lit("c/lib.rs").alias("path"), "text")
    decl = lambda k: F.concat(F.when(k % 3 == 0, F.lit("pub(in crate::a) mod n")).otherwise(F.lit("mod n")), k.cast("string"), F.lit(";\n"))
    regions = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), decl), "").alias("text")).select(F.concat(F.lit("c/r"), "n_regionkey", F.lit(".rs")).alias("path"), "text")
    handed = F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("pub use x::nation_"), (F.col("n_nationkey") + 1).cast("string"), F.lit(";\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit("pub fn "), F.lower("n_name"), F.lit("() {}\n"), handed)
    leaf = nation.where("n_nationkey % 5 <> 0").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("c/n"), "n_nationkey", F.lit(".rs"))).otherwise(F.concat(F.lit("c/n"), "n_nationkey", F.lit("/mod.rs"))).alias("path"), body.alias("text"))
    return lib.unionByName(regions).unionByName(leaf).withColumn("crate", F.lit("k")).withColumn("ext", F.lit("rs"))


LEAF = "concat('c/n', n_nationkey, case when n_nationkey % 2 = 0 then '.rs' else '/mod.rs' end)"
FLOOR = "case when n_nationkey % 3 = 0 then 'pub(in crate::a)' when n_regionkey % 2 = 0 then 'pub(crate)' end"


@query(f"""select 'c/lib.rs' as path, cast(null as varchar) as floor union all select concat('c/r', r_regionkey, '.rs'), case when r_regionkey % 2 = 0 then 'pub(crate)' end from region
  union all select {LEAF}, {FLOOR} from nation where n_nationkey % 5 <> 0""")
def module_floors(spark, sf):
    scanned = parse.scan(_crate(spark, sf))
    return vis.floors(vis.module_edges(scanned), spark.createDataFrame([("k", "c/lib.rs")], "crate string, root string")).select("path", "floor")


QUERIES["module_floors_by_rounds"] = lambda spark, sf: vis.floors_by_rounds(vis.module_edges(parse.scan(_crate(spark, sf))), spark.createDataFrame([("k", "c/lib.rs")], "crate string, root string")).select("path", "floor")
SQL["module_floors_by_rounds"] = SQL["module_floors"]


@query("select concat('c/r', n_regionkey, '.rs') as parent, concat('c/r', n_regionkey, '.rs: `mod n', n_nationkey, ';` resolves to no `n', n_nationkey, '.rs` or `n', n_nationkey, '/mod.rs`') as warning from nation where n_nationkey % 5 = 0")
def unresolved_modules(spark, sf):
    return vis.warnings(vis.module_edges(parse.scan(_crate(spark, sf)))).select("parent", "warning")


@query("select lower(n_name) as name from nation n where n_nationkey % 5 <> 0 and not exists (select 1 from nation m where m.n_nationkey + 1 = n.n_nationkey and m.n_nationkey % 5 <> 0 and m.n_nationkey % 4 = 1)")
def reexport_guard(spark, sf):
    scanned = parse.scan(_crate(spark, sf))
    items = scanned.select("crate", "path", F.inline("items")).where("kind = 'fn' and vis = 0").select("crate", "name")
    return vis.unblocked(items, vis.crate_reexports(scanned)).select("name")


NARROW = f"n_nationkey % 5 <> 0 and {FLOOR} is not null and not exists (select 1 from nation m where m.n_nationkey + 1 = n.n_nationkey and m.n_nationkey % 5 <> 0 and m.n_nationkey % 4 = 1)"


@query(f"""select {LEAF} as path, concat({FLOOR}, ' fn ', lower(n_name), '() {{}}', chr(10), case when n_nationkey % 4 = 1 then concat('pub use x::nation_', n_nationkey + 1, ';', chr(10)) else '' end) as new_text from nation n where {NARROW}""")
def narrowed_files(spark, sf):
    files = _crate(spark, sf)
    scanned = parse.scan(files)
    floors = vis.floors(vis.module_edges(scanned), spark.createDataFrame([("k", "c/lib.rs")], "crate string, root string"))
    names = vis.crate_reexports(scanned).groupBy("crate").agg(F.collect_set("name").alias("blocked"))
    own = files.join(floors, ["crate", "path"]).join(names, "crate")
    return vis.narrow_files(own).where("new_text <> text").select("path", "new_text")


@query(f"""select {LEAF} as path, 1 as line, concat('narrow visibility of `', lower(n_name), '` at line 1') as message, 'fn' as item_kind, lower(n_name) as item_name from nation n where {NARROW} and n_nationkey % 3 <> 0""")
def vis_records(spark, sf):
    files = _crate(spark, sf)
    scanned = parse.scan(files)
    floors = vis.floors(vis.module_edges(scanned), spark.createDataFrame([("k", "c/lib.rs")], "crate string, root string"))
    names = vis.crate_reexports(scanned).groupBy("crate").agg(F.collect_set("name").alias("blocked"))
    found = vis.records(vis.narrow_files(files.join(floors, ["crate", "path"]).join(names, "crate")))
    return found.select("path", "line", "message", "item_kind", "item_name")


ORDERED = _lines("concat('fn b', s_suppkey, '() {}')", "''", "concat('pub fn a', s_suppkey, '() { helper(); }')", "'use x::y;'", "'fn helper() {}'", "'const Z: u8 = 1;'", "'struct S;'")


@query("""select concat('s', s_suppkey, '.rs') as path, concat('use x::y;', chr(10), chr(10), 'const Z: u8 = 1;', chr(10), chr(10), 'struct S;', chr(10), chr(10), 'pub fn a', s_suppkey, '() { helper(); }', chr(10), chr(10),
  'fn b', s_suppkey, '() {}', chr(10), chr(10), 'fn helper() {}', chr(10)) as new_text, false as failed from supplier""")
def reordered_files(spark, sf):
    return reorder.reorder(_files(spark, sf, "supplier", "concat('s', s_suppkey, '.rs') as path", "'rs' as ext", f"{ORDERED} as text")).select("path", "new_text", F.col("broken").alias("failed"))


@query(LINTS + """select path, to_json(struct_pack(path := path, line := line, severity := severity, code := code, message := message, item_kind := 'fn', item_name := item_name))::varchar as json from l""")
def records_json(spark, sf):
    found = lints.run_all(parse.items(parse.scan(rust_files(spark, sf))))
    return records.json_objects(found).select("path", "json")


@query(LINTS + "select concat(path, ':', line, ': ', severity, '[', code, ']: ', message, ' (fn `', item_name, '`)') as report from l")
def records_text(spark, sf):
    return records.as_text(lints.run_all(parse.items(parse.scan(rust_files(spark, sf))))).select("report")


@query(LINTS + """select code, severity, count(*) as n from l group by code, severity union all select 'REORDER', 'success', count(*) from part where p_partkey % 7 = 0 and p_partkey % 3 = 2 and concat('f', p_partkey) > concat('test_', p_partkey) having count(*) > 0""")
def tidy_dry_run(spark, sf):
    _, found = tidy.tidy(rust_files(spark, sf))
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("""select concat('c', c_custkey, '.md') as path, concat('```md', chr(10), '~~~rust', chr(10), c_name, chr(10), '~~~', chr(10), '```', chr(10), '[', c_mktsegment, '] here', chr(10), chr(10), '[', c_mktsegment, ']: u', c_custkey, chr(10)) as new_text, true as processed from customer""")
def tidy_apply_markdown(spark, sf):
    text = f"concat('```md', {NL}, '```rust', {NL}, c_name, {NL}, '```', {NL}, '```', {NL}, '[', c_mktsegment, '](u', c_custkey, ') here', {NL})"
    files = _files(spark, sf, "customer", "concat('c', c_custkey, '.md') as path", "'md' as ext", f"{text} as text", "cast(c_custkey as int) as pos")
    out, _ = tidy.tidy(files, mode="apply")
    return out.select("path", "new_text", "processed")
