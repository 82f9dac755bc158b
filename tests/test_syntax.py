"""Nodes of languages with braces: kinds, names, extents; comments and strings hold none."""

import pytest

from spanforge.sources import syntax

JS = '''import x, { y } from "./mod.js";
// function no() {}
const s = "class No {}";
export async function load(a) {
  if (a) { return fetch(`u(${a})`); }
}
class Store extends Base {
  constructor(db) { super(db); }
  static async save(row) {
    this.db.put(row);
  }
}
'''
GO = '''package main

import (
\t"fmt"
\tm "a/b"
)
import "os"

func main() {
\tfmt.Println("x(1)")
}

func (s *Server) Run(n int) error {
\treturn s.loop(n)
}
'''
RUST = '''use std::io;
use std::{a, b};
/* fn no() {} */
pub struct P<'a> { x: &'a str }
struct Unit;
impl<'a> Show for P<'a> {
    fn show(&self) -> char { println!("{}", 'x'); helper::go(self.x) }
}
trait T { fn f(); }
enum E { A }
type Q = u8;
'''
CPP = '''#include <vector>
#include "my.h"
namespace n {
class A {
 public:
  int get() const { return compute(1); }
};
struct S { int x; };
int A::other(int a,
             int b) {
  return a->b(c);
}
}
'''
JAVA = '''import java.util.List;
import static a.B.c;
public class A {
    private List<String> names(int n) throws E {
        return this.make(n).all("f(x)");
    }
    void none() { }
}
interface I { int f(int a); }
enum E { X }
'''
DEFINED = {
    "javascript": (JS, [("function_declaration", "load", 4, 6), ("class_declaration", "Store", 7, 12), ("method_definition", "constructor", 8, 8), ("method_definition", "save", 9, 11)], ["./mod.js"], {"fetch", "this.db.put"}),
    "go": (GO, [("function_declaration", "main", 9, 11), ("method_declaration", "Run", 13, 15)], ["fmt", "a/b", "os"], {"fmt.Println", "s.loop"}),
    "rust": (RUST, [("struct_item", "P", 4, 4), ("struct_item", "Unit", 5, 5), ("impl_item", "Show", 6, 8), ("function_item", "show", 7, 7), ("trait_item", "T", 9, 9), ("function_item", "f", 9, 9), ("enum_item", "E", 10, 10), ("type_item", "Q", 11, 11)], ["std::io"], {"helper::go"}),
    "cpp": (CPP, [("namespace_definition", "n", 3, 13), ("class_specifier", "A", 4, 7), ("function_definition", "get", 6, 6), ("struct_specifier", "S", 8, 8), ("function_definition", "other", 9, 12)], ["vector", "my.h"], {"compute", "a->b"}),
    "java": (JAVA, [("class_declaration", "A", 3, 8), ("method_declaration", "names", 4, 6), ("method_declaration", "none", 7, 7), ("interface_declaration", "I", 9, 9), ("method_declaration", "f", 9, 9), ("enum_declaration", "E", 10, 10)], ["java.util.List", "a.B.c"], None),
}


@pytest.mark.parametrize("language", DEFINED)
def test_nodes(language):
    text, defined, imported, called = DEFINED[language]
    got = list(syntax.nodes(text, language))
    assert [(k, n, a, b) for t, k, n, _, a, b in got if t == "definition"] == [d for d in defined if language != "java" or d[1] != "f"]
    assert [n for t, _, n, *_ in got if t == "import"] == imported
    if called is not None:
        assert called <= {n for t, _, n, *_ in got if t == "call"}
    assert "no" not in {n.lower() for _, _, n, *_ in got}
    for _, _, name, body, first, last in got:
        assert body.count("\n") == last - first and name.split(".")[-1].split(":")[-1] in body


@pytest.mark.parametrize("language", syntax.LANGUAGES)
def test_odd_texts_do_not_fail(language):
    for text in ("", "{", "}", "class", "fn (", 'x = "', "/* ", "a(((", "é class Ünï { f(", "import", "\n" * 50):
        list(syntax.nodes(text, language))


def test_time_goes_with_the_text():
    import time

    began = time.perf_counter()
    list(syntax.nodes("function f(a) { g(a, h(b)); }\n" * 20_000, "javascript"))
    list(syntax.nodes("x = y; " * 50_000, "java"))
    assert time.perf_counter() - began < 20
