import random
import re

import pytest

from corpuslens.operators import extract as X
from corpuslens.operators import lookup as L
from corpuslens.operators import rules as R
from corpuslens.plans.index import extract_relations
from tests.conftest import rows

RUST = '''use std::path::Path;
use crate::util::{
    foo,
    bar,
};

pub const LIMIT: u32 = 3;

/// A struct named in a comment: struct Ghost
pub struct Foo {
    x: u8,
}

trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { String::new() }
}

impl Foo {
    pub fn one(&self) -> u8 {
        fn hidden() {}
        helper("fn fake() {", 1)
    }

    pub(crate) fn two(&self) {}
}

fn helper(s: &str, n: u8) -> u8 {
    println!("{}", s);
    let f: Foo = make();
    n
}
'''

PY = '''import os
from typing import (
    List,
    Dict,
)

MAX_SIZE = 10
lower = 3


@decorated
def top(a):
    """def not_me(): pass"""
    return helper(a)


class Thing(Base):
    def first(self):
        return os.path.join("a", "b")

    @property
    def second(self):
        def inner():
            return 1
        return inner()

def last():
    pass
'''

TS = '''import { a } from "./a";
import {
  b,
  c,
} from './b';

export function run(x: Foo): Bar {
  const y = new Widget(x);
  return y.render();
}

export class Panel extends Base {
  size = 3;
  draw({ a, b }) {
    if (a) {
      paint(b);
    }
  }
}

interface Shape { area(): number; }
type Alias = string;
'''

GO = '''package main

import (
	"fmt"
	u "github.com/x/y/util"
)

const Single = 1

const (
	First = iota
	Second
)

type Server struct {
	name string
}

func (s *Server) Run(addr string) error {
	fmt.Println(addr)
	return nil
}

func main() {
	s := Server{name: "x"}
	s.Run("a")
}
'''

C = '''#include <stdio.h>
#include "util.h"

struct point {
    int x;
};

static int add(int a, int b)
{
    return a + b;
}

int main(void) {
    struct point p;
    printf("%d", add(1, 2));
    return 0;
}
'''

CPP = '''namespace geo {
class Shape {
public:
    int area() { return side() * 2; }
};
enum class Color { Red };
}
'''


SAMPLES = {"a.rs": RUST, "a.py": PY, "a.ts": TS, "a.go": GO, "a.c": C, "a.cpp": CPP}


@pytest.fixture(scope="module")
def parsed(tree):
    """All samples through one pass: name -> (symbol rows, callsite rows)."""
    out = extract_relations(tree(SAMPLES))
    symbols, calls = out["symbols"].collect(), out["callsites"].collect()
    return {n: ([s for s in symbols if s.file_path == n], [c for c in calls if c.caller_file == n]) for n in SAMPLES}


def found(parsed, name):
    return {(s.name, s.kind, s.line, s.end_line, s.parent) for s in parsed[name][0]}


def test_rust_symbols(parsed):
    assert found(parsed, "a.rs") == {
        ("LIMIT", "const", 7, 7, None),
        ("Foo", "struct", 10, 12, None),
        ("Shape", "trait", 14, 17, None),
        ("name", "function", 16, 16, None),
        ("one", "method", 20, 23, "Foo"),
        ("two", "method", 25, 25, "Foo"),
        ("helper", "function", 28, 32, None),
    }
    vis = {s.name: s.visibility for s in parsed["a.rs"][0]}
    assert vis["Foo"] == "pub" and vis["two"] == "pub(crate)" and vis["helper"] is None


def test_python_symbols(parsed):
    assert found(parsed, "a.py") == {
        ("MAX_SIZE", "const", 7, 7, None),
        ("top", "function", 12, 14, None),
        ("Thing", "class", 17, 25, None),
        ("first", "method", 18, 19, "Thing"),
        ("second", "method", 22, 25, "Thing"),
        ("last", "function", 27, 28, None),
    }


def test_typescript_symbols(parsed):
    assert found(parsed, "a.ts") == {
        ("run", "function", 7, 10, None),
        ("y", "const", 8, 8, None),
        ("Panel", "class", 12, 19, None),
        ("draw", "method", 14, 18, "Panel"),
        ("Shape", "interface", 21, 21, None),
        ("Alias", "type", 22, 22, None),
    }


def test_go_symbols(parsed):
    assert found(parsed, "a.go") == {
        ("Single", "const", 8, 8, None),
        ("First", "const", 11, 11, None),
        ("Second", "const", 12, 12, None),
        ("Server", "type", 15, 17, None),
        ("Run", "method", 19, 22, "Server"),
        ("main", "function", 24, 27, None),
    }


def test_c_symbols(parsed):
    assert found(parsed, "a.c") == {
        ("point", "struct", 4, 6, None),
        ("add", "function", 8, 11, None),
        ("main", "function", 13, 17, None),
        ("point", "struct", 14, 14, None),
    }
    assert {t[:2] for t in found(parsed, "a.cpp")} == {
        ("geo", "module"), ("Shape", "class"), ("area", "function"), ("Color", "enum"),
    }


def test_callsites(parsed):
    def calls(name):
        return {(c.caller_line, c.caller_symbol, c.callee_name, c.callee_kind) for c in parsed[name][1]}

    rust = calls("a.rs")
    assert {(22, "one", "helper", "call"), (29, "helper", "println", "macro"), (30, "helper", "Foo", "type_ref"), (30, "helper", "make", "call")} <= rust
    assert not any(c[2] in ("fake", "Ghost") for c in rust)
    assert not any(c[0] == 10 for c in rust)  # the definition of Foo is no reference
    assert {(14, "top", "helper", "call"), (19, "first", "join", "call"), (25, "second", "inner", "call")} <= calls("a.py")
    ts = calls("a.ts")
    assert {(8, "run", "Widget", "call"), (9, "run", "render", "call"), (16, "draw", "paint", "call")} <= ts
    assert not any(c[2] in ("if", "draw", "run") for c in ts)
    assert {(20, "Run", "Println", "call"), (25, "main", "Server", "type_ref"), (26, "main", "Run", "call")} <= calls("a.go")
    assert {(15, "main", "printf", "call"), (15, "main", "add", "call")} <= calls("a.c")
    assert not any(c[0] == 8 and c[2] == "add" for c in calls("a.c"))


def test_imports(tree):
    def of(name, text, **kw):
        return rows(X.imports(tree({name: text}), **kw), "line", "target")

    assert of("a.rs", RUST) == [(1, "std::path::Path"), (2, "crate::util::{\n    foo,\n    bar,\n}")]
    assert of("a.py", PY) == [(1, "import os"), (2, "from typing import (\n    List,\n    Dict,\n)")]
    by_line = dict(of("a.ts", TS))
    assert by_line == {
        1: 'import { a } from "./a";', 2: "import { b, c, } from './b';",
        7: "export function run(x: Foo): Bar {", 12: "export class Panel extends Base {",
    }
    assert dict(of("a.ts", TS, first_line_only=True))[2] == "import {"
    assert of("a.go", GO) == [(3, "import ("), (4, "fmt"), (5, "github.com/x/y/util")]
    assert of("b.go", 'package a\nimport "fmt"\n') == [(2, "fmt"), (2, 'import "fmt"')]
    assert of("a.c", C) == [(1, "stdio.h"), (2, "util.h")]
    # Not inside comments or strings.
    assert of("c.rs", "/*\nuse a::b;\n*/\nuse c::d;\n") == [(4, "c::d")]
    assert of("c.py", '"""\nimport no\n"""\nimport yes\n') == [(4, "import yes")]


def test_identifiers_skip_short_and_masked(tree):
    lines = X.code_lines(tree({"a.rs": 'let x = foo + foo + "inside"; // remark\nlet bar12 = 9;\n'}))
    assert rows(X.code_identifiers(lines), "line", "token") == [
        (1, "foo"), (1, "let"), (2, "bar12"), (2, "let"),
    ]


def test_fallback_outline(tree):
    text = "  def one(x)\nfunc two()\nclass Three:\nfn (x)\nother\ntype été_9 = 1\nstruct " + "x" * 300 + "\n"
    out = X.fallback_outline(L.lines(tree({"notes": text})))
    assert [(r.line, r.name, r.kind) for r in out.where("line < 7").orderBy("line").collect()] == [
        (1, "one", "function"), (2, "two", "function"), (3, "Three", "class"), (6, "été_9", "type"),
    ]
    long = out.where("line = 7").first().signature
    assert len(long) == 200 and long.endswith("...")


@pytest.mark.parametrize("name, text", [
    ("a.py", "from a import " + ", ".join(f"n{i}" for i in range(5000)) + "\n"),
    ("b.c", "word " * 200_000 + "\nint f(int a) {\n}\n"), ("c.cpp", "a*" * 500_000 + "\n"),
    ("d.rs", "x " * 500_000 + "\n"), ("e.js", "x, " * 330_000 + "\n"), ("f.go", "x " * 500_000 + "\n"), ("g.py", "x " * 500_000 + "\n"),
])
def test_long_lines_are_safe(tree, name, text):
    files = tree({name: text})
    made = extract_relations(files)
    assert all(df.count() >= 0 for df in (made.values() if isinstance(made, dict) else made))


def test_every_match_holds_what_its_rule_needs():
    """Lines without it are not matched, so the texts in ``needs`` must be parts of the pattern that no match can lack."""
    code = {
        "rust": "pub struct A; enum B; trait C; mod d; type E = F; const G: static mut H: pub async fn i() impl<T> J for K { m!(x) L{",
        "javascript": "export default async function a class B interface C type D = const e let f var g static h(",
        "python": "def a(x) class B   class C   async def d A_B = 1", "go": "func a( func (r *R) B( type C struct const d var e F{", "cpp": "int a(int b) { struct C enum class D class E inline namespace f",
    }
    words = {w for text in code.values() for w in re.findall(r"\w+|[^\w\s]", text)}
    rng = random.Random(3)
    for rule in (*R.SYMBOLS, *R.CALLS):
        pattern = re.compile(rule.pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"))
        for _ in range(300):
            line = rng.choice(("", "  ")) + rng.choice((" ", "")).join(rng.choices(sorted(words), k=rng.randrange(1, 8)))
            if rule.needs and pattern.search(line):
                assert any(n in line for n in rule.needs), (rule, line)


def test_callsites_alone_bring_no_symbols_along(tree):
    files = tree({
        "a.js": "class A {\n  go(x) {\n    if (x) { // {{\n      pay(x);\n    }\n  }\n}\nconst f = g('}');\n", "b.c": "struct s {\n  int n;\n};\nstatic int item(int a)\n{\n  return pay(a);\n}\n",
        "c.py": "class B:\n    def m(self):\n        return n(1)\n\n\ndef k():\n    m()\n", "d.rs": "impl C {\n    fn a(&self) { b(); }\n}\n", "e.go": "var (\n\tx = y()\n)\n", "f.js": "",
    })
    alone = X.scan(files, ("callsites",))
    assert [r["what"] for r in alone.select("what").distinct().collect()] == ["call"]
    assert rows(X.callsites_of(alone)) == rows(X.callsites_of(X.scan(files))) != []
