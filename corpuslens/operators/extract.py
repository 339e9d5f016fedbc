"""Files to symbols, imports, identifiers and callsites, with rule tables as expressions.

Everything that needs one file's text happens on the file row or on its lines, where
they were read, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import (
    is_identifier,
    line_tokens,
    signature,
    split_lines,
    trim_space,
    trim_space_start,
)
from corpuslens.operators import fold
from corpuslens.operators import rules as R

FILE = ["root_path", "file_path"]


def _by_language(cases: list[tuple[tuple[str, ...], Column]], otherwise: Column | None = None) -> Column:
    test = reduce(
        lambda done, case: done.when(F.col("language").isin(*case[0]), case[1]),
        cases[1:],
        F.when(F.col("language").isin(*cases[0][0]), cases[0][1]),
    )
    return test if otherwise is None else test.otherwise(otherwise)


def code_of(content: Column) -> Column:
    """The text with comments and strings blanked, line for line the same."""

    def blanked(mask: R.Mask) -> Column:
        parts = F.regexp_extract_all(content, F.lit(mask.pattern), F.lit(0))
        return F.array_join(
            F.transform(
                parts, lambda s: F.when(s.rlike(mask.blank), F.regexp_replace(s, r"[^\n]", " ")).otherwise(s)
            ),
            "",
        )

    return _by_language([(m.languages, blanked(m)) for m in R.MASKS], content)


def code_lines(files: DataFrame) -> DataFrame:
    """Lines with their masked form: (file, language, line, text, code)."""
    both = F.arrays_zip(
        split_lines(F.col("content")).alias("text"), split_lines(code_of(F.col("content"))).alias("code")
    )
    return files.select(*FILE, "language", F.posexplode_outer(both).alias("_pos", "_l")).where("_pos is not null").select(
        *FILE, "language", (F.col("_pos") + 1).alias("line"),
        F.col("_l.text").alias("text"), F.coalesce(F.col("_l.code"), F.lit("")).alias("code"),
    )


def fallback_outline(
    line_rows: DataFrame, rules: tuple[tuple[str, str], ...] = R.FALLBACK, text: str = "text"
) -> DataFrame:
    """Generic outline: lines that start, after their indent, with a known word and a name.

    The first rule with a non-empty name wins. Other symbol columns are null.
    """
    start = trim_space_start(F.col(text))

    def hit(prefix: str, kind: str) -> Column:
        rest = F.substr(start, F.lit(len(prefix) + 1))
        name = F.regexp_extract(rest, r"^[\p{IsAlphabetic}\p{N}_]+", 0)
        return F.when(
            F.startswith(start, F.lit(prefix)) & (name != ""),
            F.struct(name.alias("name"), F.lit(kind).alias("kind")),
        )

    found = line_rows.select(
        *FILE, "line", F.coalesce(*(hit(*rule) for rule in rules)).alias("_s"), signature(F.col(text)).alias("signature")
    ).where(F.col("_s").isNotNull())
    none = F.lit(None)
    return found.select(
        *FILE, F.col("_s.name").alias("name"), F.col("_s.kind").alias("kind"), "line",
        none.cast("int").alias("end_line"), none.cast("string").alias("parent"),
        none.cast("string").alias("visibility"), "signature",
    )


def _holds(code: Column, needs: Iterable[str]) -> Column:
    """Whether the text holds one of ``needs``; true for none. Far cheaper than a pattern, so it is asked first."""
    return reduce(lambda a, b: a | b, (F.contains(code, F.lit(n)) for n in needs)) if needs else F.lit(True)


def _hits() -> Column:
    """All symbol rules that match a line of code, as an array of structs."""

    def one(rule: R.SymbolRule) -> Column:
        def group(n: int) -> Column:
            value = F.regexp_extract(F.col("code"), rule.pattern, n) if n else F.lit("")
            return F.when(value != "", trim_space(value))

        return F.when(
            _holds(F.col("code"), rule.needs) & F.col("code").rlike(rule.pattern),
            F.struct(
                group(rule.name).alias("name"), F.lit(rule.kind).alias("kind"),
                group(rule.visibility).alias("visibility"), group(rule.parent).alias("receiver"),
            ),
        )

    made = [(r.languages, one(r)) for r in R.SYMBOLS]
    return _by_language([
        (langs, F.filter(F.array(*(c for of, c in made if langs[0] in of)), lambda x: x.isNotNull()))
        for langs in _alike(of for of, _ in made)
    ])


def _alike(sets: Iterable[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Languages grouped by the rules that they have, so that each group's expression is made once."""
    groups: dict[tuple[int, ...], list[str]] = {}
    sets = list(sets)
    for lang in sorted({lang for of in sets for lang in of}):
        groups.setdefault(tuple(i for i, of in enumerate(sets) if lang in of), []).append(lang)
    return [tuple(g) for g in groups.values()]


def _sites() -> Column:
    """Calls, macros and type references on a line of code, as an array of structs."""
    # The second half of the pattern begins with func.
    defines = _holds(F.col("code"), (*R.DEFINES, "func"))
    code = F.when(defines, F.regexp_replace("code", R.DEFINITION, " ")).otherwise(F.col("code"))

    def found(rule: R.CallRule) -> Column:
        names = F.regexp_extract_all(code, F.lit(rule.pattern), F.lit(1))
        names = F.array_distinct(names) if rule.kind == "type_ref" else names
        names = F.when(_holds(F.col("code"), rule.needs), names).otherwise(F.array().cast("array<string>")) if rule.needs else names
        return F.transform(names, lambda n: F.struct(n.alias("callee_name"), F.lit(rule.kind).alias("callee_kind")))

    made = [(r.languages, found(r)) for r in R.CALLS]
    cases = [(langs, F.concat(*(c for of, c in made if langs[0] in of))) for langs in _alike(of for of, _ in made)]
    importing = F.col("code").rlike(r"^\s*(?:(?:pub(?:\([^)]*\))?\s+)?use|import|from|#\s*include|package|extern crate)\b")
    every = F.when(F.col("code").rlike(r"[\p{L}_]") & ~importing, _by_language(cases))
    return F.filter(every, lambda s: ~s["callee_name"].isin(*R.NOT_CALLS) & is_identifier(s["callee_name"]))


PARTS = ("symbols", "callsites", "identifiers")


def scan(files: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Symbols, callsites and identifiers of text files in one pass, as rows of ``fold.ROW``; only ``parts`` is worked out.

    A file is masked, cut into lines and folded by the task that read it. Lines carry short columns only: brace counts,
    indent and rule hits. Use :func:`symbols_of`, :func:`callsites_of` and :func:`identifiers_of` on the result.
    """
    code = F.col("code")
    # Only symbols show the text itself, in their signatures; it has the same lines.
    masked = split_lines(code_of(F.col("content"))).alias("code")
    both = F.arrays_zip(split_lines(F.col("content")).alias("text"), masked) if "symbols" in parts else F.arrays_zip(masked)
    # The size is its own column before the explode, so that no line carries the whole array. An inner explode would
    # have Spark test the array for being empty first, by working it out once more.
    lines = files.select(*FILE, "language", both.alias("_both")).withColumn("_n", F.size("_both")).select(
        *FILE, "language", "_n", F.posexplode_outer("_both").alias("_pos", "_l")
    ).where("_pos is not null").select(
        *FILE, "language", (F.col("_pos") + 1).alias("line"), (F.col("_pos") + 1 == F.col("_n")).alias("last"),
        *([F.col("_l.text").alias("text")] if "symbols" in parts else []), F.coalesce(F.col("_l.code"), F.lit("")).alias("code"),
    )
    kept = [*FILE, "line"]
    if "identifiers" in parts:
        lines = lines.withColumn("tokens", line_tokens(code))
        kept.append("tokens")
    if "symbols" in parts or "callsites" in parts:
        lead = F.length(F.regexp_replace(F.regexp_extract(code, r"^[\s)\];,]*\}[\s}\)\];,]*", 0), r"[^}]", ""))
        count = lambda sign: F.length(code) - F.length(F.replace(code, F.lit(sign)))
        braced = F.col("language") != "python"
        indent = F.length(F.regexp_extract(code, r"^[ \t]*", 0))
        no_site = F.array().cast("array<struct<callee_name:string,callee_kind:string>>")
        lines = lines.withColumns({
            "hits": F.coalesce(F.when(F.trim("code") != "", _hits()), F.array()),
            "sites": F.coalesce(_sites(), no_site) if "callsites" in parts else no_site,
            "opens": F.when(braced, count("{")).otherwise(0), "closes": F.when(braced, count("}")).otherwise(0),
        }).withColumns({
            "lead": F.when(F.col("closes") > 0, lead).otherwise(0),
            "ends": braced & F.contains(code, F.lit(";")) & code.rlike(r";[\s})]*$"),
            # In Python the nesting of a line that has code is its indent.
            "indent": F.when(~braced & code.rlike(r"\S"), indent),
            "mark": F.when(
                F.col("language") == "go",
                F.when(code.rlike(r"^(?:const|var|type|import)\s*\("), F.regexp_extract(code, r"^([a-z]+)", 1)).when(
                    code.rlike(r"^\)"), ""
                ),
            ),
            "signature": F.when(F.size("hits") > 0, signature(F.col("text"))) if "symbols" in parts else F.lit(None).cast("string"),
        })
        kept += ["language", "last", "lead", "opens", "closes", "ends", "indent", "mark", "signature", "hits", "sites"]
    # No filter on what lines hold: Spark would put it below the columns and work them out twice.
    return lines.select(*kept).mapInArrow(partial(fold.fold, symbols="symbols" in parts), fold.ROW)


def symbols_of(scanned: DataFrame) -> DataFrame:
    """Symbol relation: (file, name, kind, line, end_line, parent, visibility, signature)."""
    return scanned.where(F.col("what") == fold.SYMBOL).select(
        *FILE, "name", "kind", "line", "end_line", "parent", "visibility", "signature"
    )


def callsites_of(scanned: DataFrame) -> DataFrame:
    """Callsite relation: calls, macros and type references with the function around them."""
    return scanned.where(F.col("what") == fold.CALL).select(
        "root_path", F.col("file_path").alias("caller_file"), F.col("line").alias("caller_line"),
        F.col("parent").alias("caller_symbol"), F.col("name").alias("callee_name"), F.col("kind").alias("callee_kind"),
    )


def identifiers_of(scanned: DataFrame) -> DataFrame:
    """Identifier relation of code: tokens outside comments and strings."""
    return scanned.where(F.col("what") == fold.TOKEN).select(*FILE, F.col("name").alias("token"), "line")


def imports(files: DataFrame, first_line_only: bool = False) -> DataFrame:
    """Import relation (file, target, line), from the file row without a shuffle.

    A statement that spans lines is first pulled onto its first line, with the
    removed breaks put after it so that line numbers stay. ``first_line_only``
    keeps just the first line of JavaScript and TypeScript statements.
    """
    br = "\u0001"

    def pulled(mask: str, statement: str) -> Column:
        parts = F.regexp_extract_all(F.col("content"), F.lit(f"(?m){statement}|{mask}"), F.lit(0))
        return F.array_join(
            F.transform(
                parts,
                lambda s: F.when(
                    s.rlike(f"(?m){statement}") & F.contains(s, F.lit("\n")),
                    F.concat(
                        F.translate(s, "\n", br),
                        F.repeat(F.lit("\n"), F.length(s) - F.length(F.replace(s, F.lit("\n")))),
                    ),
                ).otherwise(s),
            ),
            "",
        )

    # Comment and string segments first, so that an import inside one is not seen;
    # other text goes line by line because statements start lines.
    line = r"|[^\n]*\n?"
    comment = r"//[^\n]*+|/\*(?s:.*?)\*/"
    use = r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use\s[^;]*;"
    js = (
        r"""^[ \t]*import\b[^'"`;()]*?(?:['"][^'"\n]*['"]);?"""
        r"""|^[ \t]*export\s+(?:type\s+)?(?:\*|\{[^}]*\})[^'"`;\n]*?(?:from\s*['"][^'"\n]*['"])?;?"""
        r"""|^[ \t]*export\s[^\n]*"""
    )
    py = r"^[ \t]*from[ \t]+\S+[ \t]+import[ \t]*\([^)]*\)|^[ \t]*(?:from|import)[ \t][^\n\\]*+(?:\\(?s:.)[^\n\\]*+)*+"
    go = r"^import\s*\([^)]*\)|^import\s[^\n]*"
    inc = r'^[ \t]*#[ \t]*include[ \t]*[^\n]*'
    doc = r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''"
    cases = [
        (("rust",), use, comment + line), (R.JS, js, comment + line), (("python",), py, doc + line),
        (("go",), go, comment + line), (R.C, inc, comment + line),
    ]
    statement = {langs: s for langs, s, _ in cases}
    view = _by_language([(langs, pulled(mask, s)) for langs, s, mask in cases])
    rows = files.select(*FILE, "language", F.posexplode_outer(split_lines(view)).alias("_pos", "_t")).where("_pos is not null").select(
        *FILE, "language", (F.col("_pos") + 1).alias("line"), "_t"
    )
    hit = _by_language([(langs, F.col("_t").rlike(s)) for langs, s in statement.items()], F.lit(False))
    stmt = _by_language([(langs, F.regexp_extract("_t", s, 0)) for langs, s in statement.items()])
    rows = rows.where(hit).select(*FILE, "language", "line", trim_space(stmt).alias("_s"))

    head = F.split(F.col("_s"), br)
    one = lambda target, offset=0: F.struct(
        trim_space(target).alias("target"), (F.col("line") + offset).cast("int").alias("line")
    )
    whole = F.translate("_s", br, "\n")
    rust = F.regexp_replace(
        F.regexp_replace(whole, r"^(?:pub )?(?:pub\(crate\) )?(?:pub\(super\) )?(?:use )?", ""), r";+\z", ""
    )
    js_target = F.element_at(head, 1) if first_line_only else F.regexp_replace("_s", rf"[ \t]*{br}[ \t]*", " ")
    python_target = F.regexp_replace(whole, r"[ \t]+#[^\n]*\z", "")
    specs = F.filter(
        F.transform(
            head,
            lambda x, i: F.struct(
                F.regexp_extract(x, r'^(?:import)?[ \t(]*(?:[\p{L}_.][\p{L}\p{N}_]*[ \t]+)?"([^"]+)"', 1).alias("target"),
                (F.col("line") + i).cast("int").alias("line"),
            ),
        ),
        lambda x: x["target"] != "",
    )
    include = F.regexp_extract("_s", r'include[ \t]*(<[^>]*>|"[^"]*"|[\p{L}_][\p{L}\p{N}_]*)', 1)
    found = _by_language([
        (("rust",), F.array(one(rust))),
        (R.JS, F.array(one(js_target))),
        (("python",), F.array(one(python_target))),
        (("go",), F.concat(F.array(one(F.element_at(head, 1))), specs)),
        (R.C, F.array(one(F.regexp_replace(include, r'^[<>"]+|[<>"]+\z', "")))),
    ])
    return rows.select(*FILE, F.inline(found)).where(F.col("target") != "").select(*FILE, "target", "line")


def code_identifiers(line_rows: DataFrame) -> DataFrame:
    """Identifier relation of code: tokens outside comments and strings."""
    tokens = line_tokens(F.col("code"))
    return line_rows.select(*FILE, F.explode(tokens).alias("token"), "line")
