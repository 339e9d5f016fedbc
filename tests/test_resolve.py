import pytest

from corpuslens.operators.resolve import resolve_imports
from tests.conftest import rows

# (name, files or contents, importer, language, target, expected)
CASES = [
    ("rust tail", ["Cargo.toml", "src/lib.rs", "src/foo/bar.rs"], "src/lib.rs", "rust", "crate::foo::bar::Baz", "src/foo/bar.rs"),
    ("rust self", ["Cargo.toml", "src/a/mod.rs", "src/a/sibling.rs", "src/top.rs"], "src/a/mod.rs", "rust", "self::sibling", "src/a/sibling.rs"),
    ("rust super", ["Cargo.toml", "src/a/mod.rs", "src/a/sibling.rs", "src/top.rs"], "src/a/mod.rs", "rust", "super::top", "src/top.rs"),
    ("rust super too far", ["Cargo.toml", "src/a.rs"], "src/a.rs", "rust", "super::super::a", None),
    ("rust mod.rs", ["Cargo.toml", "src/lib.rs", "src/foo/mod.rs"], "src/lib.rs", "rust", "crate::foo", "src/foo/mod.rs"),
    ("rust external", ["Cargo.toml", "src/lib.rs"], "src/lib.rs", "rust", "std::path::Path", None),
    ("rust group", ["Cargo.toml", "src/lib.rs", "src/util.rs"], "src/lib.rs", "rust", "crate::util::{foo, bar}", "src/util.rs"),
    ("rust multi-line group", ["Cargo.toml", "src/lib.rs", "src/util.rs"], "src/lib.rs", "rust", "crate::util::{\n  foo,\n}", "src/util.rs"),
    ("rust glob", ["Cargo.toml", "src/lib.rs", "src/util.rs"], "src/lib.rs", "rust", "crate::util::*", "src/util.rs"),
    ("rust alias", ["Cargo.toml", "src/lib.rs", "src/util.rs"], "src/lib.rs", "rust", "crate::util as u", "src/util.rs"),
    ("rust near", ["Cargo.toml", "src/a/b.rs", "src/a/c.rs"], "src/a/b.rs", "rust", "c::Thing", "src/a/c.rs"),
    ("rust no crate", ["lib.rs", "x.rs"], "lib.rs", "rust", "crate::x::Y", "x.rs"),
    ("ts suffix", ["src/a.ts", "src/b.ts"], "src/a.ts", "typescript", "import { x } from './b'", "src/b.ts"),
    ("ts up", ["src/sub/a.ts", "src/b.tsx"], "src/sub/a.ts", "typescript", 'import x from "../b"', "src/b.tsx"),
    ("ts index", ["src/a.ts", "src/sub/index.ts"], "src/a.ts", "typescript", "import './sub'", "src/sub/index.ts"),
    ("ts exact", ["src/a.ts", "src/b.json"], "src/a.ts", "tsx", "import d from './b.json'", "src/b.json"),
    ("ts bare", ["src/a.ts"], "src/a.ts", "typescript", "import React from 'react'", None),
    ("js no specifier", ["a.js"], "a.js", "javascript", "import {", None),
    ("py relative", ["pkg/__init__.py", "pkg/a.py", "pkg/b.py"], "pkg/a.py", "python", "from .b import thing", "pkg/b.py"),
    ("py two dots", ["pkg/__init__.py", "pkg/c.py", "pkg/s/a.py"], "pkg/s/a.py", "python", "from ..c import x", "pkg/c.py"),
    ("py dot only", ["pkg/__init__.py", "pkg/a.py"], "pkg/a.py", "python", "from . import a", "pkg/__init__.py"),
    ("py absolute", ["pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/util.py"], "pkg/a.py", "python", "from pkg.sub.util import thing", "pkg/sub/util.py"),
    ("py symbol tail", ["pkg/__init__.py", "pkg/a.py", "pkg/b.py"], "pkg/a.py", "python", "import pkg.b.Thing", "pkg/b.py"),
    ("py first of many", ["a.py", "b.py", "c.py"], "a.py", "python", "import b, c", "b.py"),
    ("py deep package root", ["lib/pkg/__init__.py", "lib/pkg/s/__init__.py", "lib/pkg/s/a.py", "lib/pkg/b.py"], "lib/pkg/s/a.py", "python", "from pkg.b import x", "lib/pkg/b.py"),
    ("py too many dots", ["a.py"], "a.py", "python", "from ..x import y", None),
    ("go local", {"go.mod": "module github.com/x/y\n\ngo 1.20\n", "pkg/util.go": "", "pkg/a_test.go": "", "main.go": ""}, "main.go", "go", "github.com/x/y/pkg", "pkg/util.go"),
    ("go root", {"go.mod": "module github.com/x/y\n", "b.go": "", "a_test.go": ""}, "b.go", "go", "github.com/x/y", "b.go"),
    ("go prefix as text", {"go.mod": "module x/y\n", "z/u.go": "", "main.go": ""}, "main.go", "go", "x/yz", "z/u.go"),
    ("go external", {"go.mod": "module github.com/x/y\n", "main.go": ""}, "main.go", "go", "fmt", None),
    ("go declaration row", {"go.mod": "module github.com/x/y\n", "main.go": ""}, "main.go", "go", "import (", None),
    ("c sibling", ["src/main.c", "src/util.h"], "src/main.c", "c", "util.h", "src/util.h"),
    ("c include dir", ["src/main.c", "include/api.h"], "src/main.c", "c", "api.h", "include/api.h"),
    ("c dots", ["src/x/main.c", "src/util.h"], "src/x/main.c", "cpp", "../util.h", "src/util.h"),
    ("c system", ["src/main.c"], "src/main.c", "c", "stdio.h", None),
]


@pytest.fixture(scope="module")
def resolved(spark):
    files, imports = [], []
    for name, contents, importer, language, target, _ in CASES:
        if isinstance(contents, list):
            contents = dict.fromkeys(contents, "")
        files += [(name, path, text) for path, text in contents.items()]
        imports.append((name, importer, language, target, 1))
    f = spark.createDataFrame(files, "root_path string, file_path string, content string")
    i = spark.createDataFrame(imports, "root_path string, file_path string, language string, target string, line int")
    deps = rows(resolve_imports(i, f), "root_path", "importer_file", "importee_file", "raw_target")
    return {r[0]: r for r in deps}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_resolve(resolved, case):
    name, _, importer, _, target, expected = case
    assert resolved[name] == (name, importer, expected, target)


def test_crate_root_flag(spark):
    f = spark.createDataFrame([("r", "Cargo.toml", ""), ("r", "src/lib.rs", ""), ("r", "src/a.rs", "")], "root_path string, file_path string, content string")
    i = spark.createDataFrame([("r", "src/a.rs", "rust", "crate::Foo", 1)], "root_path string, file_path string, language string, target string, line int")
    assert resolve_imports(i, f).first().importee_file is None
    assert resolve_imports(i, f, resolve_crate_root=True).first().importee_file == "src/lib.rs"
