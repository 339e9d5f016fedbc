"""Import resolution: each raw target becomes candidate paths, and the first that exists wins.

Existence is one equi-join for all languages and roots together. The candidate
side may be skewed (one header that every directory includes); its partner is unique
per key, so adaptive execution can split such a partition without changing results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.paths import file_name, join_path, normalize, parent_dir
from corpuslens.functions.text import split_lines, trim_space
from corpuslens.operators.rules import C, JS
from corpuslens.skew import salted_join

# Order in which file endings are tried.
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
JS_INDEX = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs")

_DIR = "dir:"  # marks lookup keys that stand for a directory rather than a file


def _paths(*columns: Column) -> Column:
    return F.array(*columns).cast("array<string>")


def _with_ext(path: Column, ext: str) -> Column:
    """Replace the extension of the last part, null for an empty path."""
    return F.when(path != "", F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{ext}")))


def _up(directory: Column, n: Column) -> Column:
    """``n`` directories up; null when there are not so many."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.when(n <= F.size(parts), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), "/"))


def _below(base: Column, segments: Column, n: Column) -> Column:
    return join_path(base, F.array_join(F.slice(segments, 1, n), "/"))


def _longest_first(base: Column, segments: Column, forms) -> Column:
    """Forms of base/s1/../sn, then base/s1/../s(n-1), and so on down to one segment."""
    n = F.size(segments)
    lengths = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(lengths, lambda k: forms(_below(base, segments, k))))


def _js_parts(ask: DataFrame) -> DataFrame:
    """Column for JavaScript and TypeScript asks: the path a relative specifier means."""
    quoted = F.regexp_extract("target", r"""^[^"'`]*(?:"([^"]*)"|'([^']*)'|`([^`]*)`)""", 0)
    spec = F.when(F.col("language").isin(*JS), F.regexp_extract(quoted, r"""["'`](.*)["'`]$""", 1))
    return ask.withColumn("_spec", spec).withColumn(
        "_js", F.when(F.col("_spec").rlike(r"^\.\.?/"), normalize(join_path(F.col("dir"), F.col("_spec"))))
    )


def js_candidates() -> Column:
    base = F.col("_js")
    tries = [F.concat(base, F.lit(s)) for s in JS_SUFFIXES]
    tries += [join_path(base, F.lit(s)) for s in JS_INDEX] + [base]
    return F.when(base.isNotNull(), _paths(*tries))


def c_candidates(directory: Column, target: Column) -> Column:
    homes = [directory, F.lit("include"), F.lit("src"), F.lit("")]
    return F.when(target != "", _paths(*(normalize(join_path(home, target)) for home in homes)))


def _python_parts(ask: DataFrame) -> DataFrame:
    """Columns for Python asks: base folder, module segments, and whether there is a module."""
    t = F.col("target")
    head = F.regexp_extract(t, r"^from \s*(\S+)", 1)
    module = F.when(F.startswith(t, F.lit("from ")), F.regexp_replace(head, r"^\.+", "")).when(
        F.startswith(t, F.lit("import ")), F.regexp_extract(t, r"^import ([^,\s]*)", 1)
    )
    dots = F.length(F.regexp_extract(head, r"^\.*", 0))
    ours = F.col("language") == "python"
    return ask.withColumns({"_dots": F.when(ours, dots), "_module": F.when(ours, module)}).withColumns({
        "_py_base": F.when(F.col("_dots") > 0, _up(F.col("dir"), F.col("_dots") - 1)).otherwise(
            F.coalesce("package_root", F.lit(""))
        ),
        "_py_segs": F.filter(F.split("_module", r"\."), lambda s: s != ""),
    })


def python_candidates() -> Column:
    base, segs, n = F.col("_py_base"), F.col("_py_segs"), F.size("_py_segs")
    whole = F.when(n == 0, base).otherwise(_below(base, segs, n))
    shorter = _below(base, segs, F.greatest(n - 1, F.lit(1)))
    pair = lambda p: [_with_ext(p, "py"), join_path(p, F.lit("__init__.py"))]
    tries = F.when(n > 1, _paths(*pair(whole), *pair(shorter))).otherwise(_paths(*pair(whole)))
    return F.when(F.col("_module").isNotNull() & ((n > 0) | (F.col("_dots") > 0)), tries)


def _rust_parts(ask: DataFrame) -> DataFrame:
    """Columns for Rust asks: path segments, base folder, and the segments below it."""
    body = F.regexp_replace("target", r"^(?:pub )*(?:pub\(crate\) )*(?:pub\(super\) )*(?:use )*", "")
    body = trim_space(F.regexp_replace(body, r";+\z", ""))
    # Only the path before a group counts, and the name before an alias.
    body = F.substring_index(F.regexp_replace(body, r"(?s)(?:::)*\{.*\z", ""), " as ", 1)
    parts = F.transform(F.split(body, "::"), trim_space)
    segs, first = F.col("_segs"), F.col("_first")
    crate_src = F.coalesce("crate_src", F.lit(""))
    # Leading ``super`` segments each go one directory up.
    ups = F.size(F.split(F.regexp_extract(F.array_join(segs, "/"), r"^(?:super(?:/|$))*", 0), "super")) - 1
    staged = ask.withColumn("_parts", F.when((F.col("language") == "rust") & (body != ""), parts)).withColumn(
        "_segs",
        F.when(F.element_at("_parts", -1) == "*", F.slice("_parts", 1, F.size("_parts") - 1)).otherwise(F.col("_parts")),
    )
    return staged.withColumns({"_first": F.try_element_at(segs, F.lit(1)), "_ups": ups}).withColumns({
        "_base": F.when(first == "self", F.col("dir")).when(first == "super", _up(F.col("dir"), F.col("_ups"))).otherwise(crate_src),
        "_taken": F.when(first.isin("crate", "self"), 1).when(first == "super", F.col("_ups")).otherwise(0),
    }).withColumn("_rest", F.slice(segs, F.col("_taken") + 1, F.greatest(F.size(segs) - F.col("_taken"), F.lit(0))))


def rust_candidates(crate_root: bool = False) -> Column:
    base, rest, first = F.col("_base"), F.col("_rest"), F.col("_first")
    crate_src = F.coalesce("crate_src", F.lit(""))
    forms = lambda p: _paths(_with_ext(p, "rs"), join_path(p, F.lit("mod.rs")))
    extra = F.when(
        (base == crate_src) & (F.size(rest) > 0),
        _paths(join_path(crate_src, F.lit("lib.rs")), join_path(crate_src, F.lit("main.rs"))),
    ).otherwise(_paths()) if crate_root else _paths()
    bare = ~first.isin("crate", "self", "super")
    near = F.when(bare, _longest_first(F.col("dir"), F.col("_segs"), forms)).otherwise(_paths())
    return F.when(
        first.isNotNull() & base.isNotNull(), F.concat(_longest_first(base, rest, forms), forms(base), extra, near)
    )


def go_candidates(module: Column, target: Column) -> Column:
    path = F.regexp_replace(target, r'^"+|"+\z', "")
    below = F.regexp_replace(F.substr(path, F.length(module) + 1), r"^/+", "")
    ok = (path != "") & ~F.startswith(path, F.lit("import")) & F.startswith(path, module)
    return F.when(ok, _paths(F.concat(F.lit(_DIR), F.regexp_replace(below, r"/+$", ""))))


def go_modules(files: DataFrame) -> DataFrame:
    """(root_path, go_module) from each root's go.mod."""
    line = F.filter(
        F.transform(split_lines(F.col("content")), trim_space), lambda x: F.startswith(x, F.lit("module "))
    )
    name = F.regexp_replace(trim_space(F.substr(F.try_element_at(line, F.lit(1)), F.lit(8))), r'^"+|"+\z', "")
    return files.where(F.col("file_path") == "go.mod").select("root_path", name.alias("go_module")).where(
        F.col("go_module").isNotNull()
    )


def crate_sources(files: DataFrame) -> DataFrame:
    """(root_path, crate_src) for roots with a Cargo.toml and a src directory."""
    return (
        files.groupBy("root_path")
        .agg(
            F.bool_or(F.col("file_path") == "Cargo.toml").alias("_cargo"),
            F.bool_or(F.startswith(F.col("file_path"), F.lit("src/"))).alias("_src"),
        )
        .where("_cargo and _src")
        .select("root_path", F.lit("src").alias("crate_src"))
    )


def package_roots(files: DataFrame, importers: DataFrame) -> DataFrame:
    """(root_path, dir, package_root): nearest proper ancestor directory without ``__init__.py``."""
    init = (
        files.where(file_name(F.col("file_path")) == "__init__.py")
        .select("root_path", parent_dir(F.col("file_path")).alias("above"), F.lit(True).alias("_init"))
        .distinct()
    )
    dirs = importers.select("root_path", parent_dir(F.col("file_path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(
        F.col("dir") != "",
        F.transform(
            F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)),
            lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/")),
        ),
    ).otherwise(F.array(F.lit("")))
    walked = salted_join(
        dirs.select("root_path", "dir", F.posexplode(above).alias("_far", "above")),
        init, ["root_path", "above"], "left", ["dir"],
    )
    plain = F.when(F.col("_init").isNull(), F.struct("_far", "above"))
    return walked.groupBy("root_path", "dir").agg(
        F.coalesce(F.min(plain)["above"], F.lit("")).alias("package_root")
    )


def lookup_keys(files: DataFrame) -> DataFrame:
    """(root_path, key, path): every file, and per directory its first Go file that is no test."""
    go = files.where(F.col("file_path").rlike(r"[^/]\.go$") & ~F.endswith(F.col("file_path"), F.lit("_test.go")))
    return files.select("root_path", F.col("file_path").alias("key"), F.col("file_path").alias("path")).unionByName(
        go.groupBy("root_path", F.concat(F.lit(_DIR), parent_dir(F.col("file_path"))).alias("key")).agg(
            F.min("file_path").alias("path")
        )
    )


def first_existing(asks: DataFrame, keys: list[str], candidates: str, lookup: DataFrame) -> DataFrame:
    """Per ask, the ``path`` of its first candidate key found in ``lookup(root_path, key, path)``.

    ``keys`` identify an ask and include ``root_path``; asks without a hit keep a null path.
    """
    tried = asks.select(*keys, F.posexplode_outer(candidates).alias("_pos", "key"))
    joined = tried.join(lookup, ["root_path", "key"], "left")
    hit = F.when(F.col("path").isNotNull(), F.struct("_pos", "path"))
    return joined.groupBy(*keys).agg(F.min(hit)["path"].alias("path"))


def resolve_imports(
    imports: DataFrame, files: DataFrame, modules: DataFrame | None = None, resolve_crate_root: bool = False
) -> DataFrame:
    """Dependency relation: every import with the file it means, null when there is none.

    ``imports`` needs ``language``; ``files`` names all files of the roots, Cargo.toml and
    go.mod included. ``modules`` is :func:`go_modules`; without it ``files`` needs ``content``
    for go.mod. Equal questions, the same target from the same directory, are answered once.
    """
    target = trim_space(F.col("target"))
    ask = imports.select(
        "root_path", parent_dir(F.col("file_path")).alias("dir"), "language", target.alias("target")
    ).distinct()
    names = files.select("root_path", "file_path")
    by_dir = ["root_path", "dir"]
    # Facts per root and per directory: few columns, one row per key.
    ask = salted_join(ask, crate_sources(names), ["root_path"], "left", ["dir", "target"])
    modules = go_modules(files) if modules is None else modules
    ask = salted_join(ask, modules, ["root_path"], "left", ["dir", "target"])
    roots = package_roots(names, imports.where(F.col("language") == "python"))
    ask = salted_join(ask, roots, by_dir, "left", ["target"])
    # One column per step and language: later steps name earlier ones instead of repeating them.
    ask = _js_parts(_python_parts(_rust_parts(ask)))
    language = F.col("language")
    candidates = (
        F.when(language == "rust", rust_candidates(resolve_crate_root))
        .when(language.isin(*JS), js_candidates())
        .when(language == "python", python_candidates())
        .when((language == "go") & F.col("go_module").isNotNull(), go_candidates(F.col("go_module"), F.col("target")))
        .when(language.isin(*C), c_candidates(F.col("dir"), F.col("target")))
    )
    found = first_existing(
        ask.select(*by_dir, "language", "target", candidates.alias("_c")),
        [*by_dir, "language", "target"], "_c", lookup_keys(names),
    )
    # The answers are unique per key; only the import side can be skewed here.
    return (
        imports.withColumn("dir", parent_dir(F.col("file_path")))
        .withColumn("_raw", F.col("target"))
        .withColumn("target", target)
        .join(found, [*by_dir, "language", "target"], "left")
        .select(
            "root_path", F.col("file_path").alias("importer_file"), F.col("path").alias("importee_file"),
            F.col("_raw").alias("raw_target"), "line",
        )
    )
