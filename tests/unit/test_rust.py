"""The scanner, the order of items, narrowing."""

import time

import pytest

from lathe.functions import ordering
from lathe.functions.rustscan import Scan, narrow
from lathe.functions.text import SPACE

SOURCE = '''//! Crate docs.

#[derive(Debug)]
/// Doc of A.
pub(crate) struct A<T> where T: Clone { a: B, c: Vec<C> }
struct B;
enum C { A(B), X { y: i32 } }
impl<T> Foo for A<T> { fn helper(&self) -> Result<u8, E> { main(); } }
pub fn f(mut a: u8, &b: &u8, (c, d): (u8, u8), e: HashMap<A, B>) -> io::Result<()> { let x = helper(); x.main(); B::new(); mac!(A); a::B }
fn helper() {}
macro_rules! mac { ($x:expr) => { helper() }; }
mac! { q }
#[cfg(test)]
mod tests { use super::*; #[test] fn t() {} }
pub mod z { pub(super) mod k { pub fn q() {} } pub use a::{b as c, d, e::{self, *}}; }
'''


def names(text):
    scan = Scan(text)
    order = ordering.order_items(scan.rows(), scan.edges())
    return [scan.rows()[k]["name"] or scan.rows()[k]["kind"] for k in order]


def test_items():
    rows = Scan(SOURCE).rows()
    assert [(r["kind"], r["name"], r["vis"]) for r in rows] == [
        ("struct", "A", 1), ("struct", "B", 2), ("enum", "C", 2), ("impl", None, None), ("fn", "f", 0), ("fn", "helper", 2),
        ("macro", "mac", None), ("macro-invocation", "mac", None), ("mod", "tests", 2), ("mod", "z", 0),
    ]
    assert rows[0]["doc_comments"] == [" Doc of A."] and rows[0]["start_line"] == 3
    assert rows[3]["impl_target"] == "A" and rows[3]["is_trait_impl"]
    assert rows[4]["params"] == ["a", "e"] and rows[4]["returns_result"]
    assert rows[8]["is_test_module"] and rows[8]["is_inline"]
    assert rows[0]["start"] == SOURCE.index("#[derive") and all(a["end"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_references():
    scan = Scan(SOURCE)
    index = {}
    for r in scan.rows():
        index.setdefault(r["name"], r["idx"])
    edges = set(scan.edges())
    assert (index["A"], index["B"]) in edges and (index["A"], index["C"]) in edges and (index["C"], index["B"]) in edges
    assert (index["f"], index["helper"]) in edges and (index["mac"], index["f"]) in edges  # a local macro's edge is reversed
    assert all(a != b for a, b in edges)


@pytest.mark.parametrize(
    "text,kinds",
    [
        ('const A: &str = "fn x() {}"; fn b() {}', ["const", "fn"]),
        ("const C: char = '{'; fn b<'a>(x: &'a str) {}", ["const", "fn"]),
        ('fn a() { r#"}"#; } fn b() {}', ["fn", "fn"]),
        ("/* { /* nested */ } */ fn a() {}", ["fn"]),
        ('extern "C" { fn x(); } extern crate y; unsafe extern "C" fn z() {}', ["other", "extern", "fn"]),
        ("static mut S: u8 = 1; union U { a: u8 } type T = u8; trait R { fn x(); }", ["static", "union", "type", "trait"]),
        ("const fn a() {} async unsafe fn b() {} println!(\"x\"); a::b!{ fn x() {} }", ["fn", "fn", "macro-invocation", "macro-invocation"]),
        ("fn broken( { ", []),
        ("", []),
    ],
)
def test_tokens_don_t_mislead(text, kinds):
    assert [r["kind"] for r in Scan(text).rows()] == kinds


def test_attributes_and_docs():
    rows = Scan('/** Block\n doc */\n#[doc = "attr"]\n#[tokio::test(flavor = "x")]\n//// no doc\nasync fn case_x() {}\n').rows()
    assert rows[0]["doc_comments"] == [" Block\n doc ", "attr"] and rows[0]["is_test_fn"]
    assert not Scan("#[cfg(all(test, x))] mod m {}").rows()[0]["is_test_module"]


def test_phases():
    text = "fn b() {}\npub fn a() {}\nstruct S;\nuse x;\nimpl T for S {}\nimpl S {}\nconst C: u8 = 1;\ntrait T {}\nmod m;\nextern crate q;\n#[cfg(test)] mod t {}\nouter!();\n"
    assert names(text) == ["extern", "outer", "use", "m", "C", "S", "T", "impl", "impl", "a", "b", "t"]


def test_callers_come_first():
    assert names("fn a() {}\nfn b() { a() }\nfn main() { b() }\nfn z() { main() }\n") == ["main", "b", "z", "a"]
    assert ordering.waves(["a", "z", "m"], [(0, 1), (1, 0), (1, 2)]) == [0, 2, 1]
    assert ordering.waves(["x", "main", "b"], [(0, 1), (1, 2)]) == [1, 2, 0]
    assert ordering.waves(["b", "a"], [], alphabetical=False) == [0, 1]


def test_macros_precede_their_calls():
    assert names("mac!{a}\nmacro_rules! other { () => {} }\nmac!{b}\nmacro_rules! mac { () => {} }\n") == ["mac", "mac", "mac", "other"]


def test_emit_spacing_and_moves():
    text = "use b;\n\nuse a;\nfn x() {}\n\n\nstruct S;\n// tail\n"
    scan = Scan(text)
    order = ordering.order_items(scan.rows(), scan.edges())
    new = ordering.emit(text, scan.rows(), order, scan.preamble_end, scan.trailer_start, "\n", SPACE)
    assert new == "use b;\nuse a;\n\nstruct S;\n\nfn x() {}\n// tail\n"
    again = Scan(new)
    assert ordering.emit(new, again.rows(), ordering.order_items(again.rows(), again.edges()), again.preamble_end, again.trailer_start, "\n", SPACE) == new
    assert ordering.moves(scan.rows(), order) == [(3, "rearrange struct S from pos 4 to pos 3 (before x)")]


def test_reexports_and_narrowing():
    scan = Scan(SOURCE)
    assert scan.reexports() == {"c", "d", "e", "*"}
    text = "pub fn a() {}\npub(super) fn b() {}\npub use m::c;\npub fn c() {}\npub(super) mod i { pub fn d() {} mod j { pub struct E; } }\nmod k { pub fn f() {} }\n"
    got = narrow(text, Scan(text), "pub(crate)", Scan(text).reexports())
    assert got == "pub(crate) fn a() {}\npub(super) fn b() {}\npub use m::c;\npub fn c() {}\npub(super) mod i { pub(super) fn d() {} mod j { pub(super) struct E; } }\nmod k { pub(crate) fn f() {} }\n"
    assert narrow(text, Scan(text), None, {"c"}).count("pub(super) fn d") == 1
    assert narrow(text, Scan(text), "pub(crate)", {"*"}) == text


def test_long_chains_take_linear_time():
    n = 20_000
    began = time.process_time()
    assert ordering.waves([f"f{i}" for i in range(n)], [(i, i + 1) for i in range(n - 1)]) == list(range(n))
    assert time.process_time() - began < 5
