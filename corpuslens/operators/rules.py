"""Extraction rules as data: one row per pattern, applied to lines as Spark expressions.

The patterns are approximate where the meaning needs a full grammar (see README).
They are matched against ``code``: the line with comments and strings blanked.
"""

from __future__ import annotations

from typing import NamedTuple

JS = ("typescript", "tsx", "javascript")
C = ("c", "cpp")
BRACED = ("rust", *JS, "go", *C)
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"

# Beginnings of lines in the generic outline, first match wins.
FALLBACK = (
    ("fn ", "function"),
    ("func ", "function"),
    ("def ", "function"),
    ("class ", "class"),
    ("struct ", "struct"),
    ("type ", "type"),
)


class SymbolRule(NamedTuple):
    languages: tuple[str, ...]
    kind: str
    pattern: str
    name: int = 1
    visibility: int = 0  # group number, 0 for none
    parent: int = 0
    needs: tuple[str, ...] = ()  # every match holds one of these; lines without are not matched at all


_VIS = r"^\s*(?:(pub(?:\s*\([^)]*\))?)\s+)?"
_EXP = r"^\s*(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
_NOT_C_FN = r"^(?!\s*(?:if|for|while|switch|return|else|do|case|typedef|using|new|delete|throw|goto)\b)"

# Kinds with a leading '+' open blocks that give their members a parent and are
# not symbols themselves; 'member' rows count only directly inside such a block.
SYMBOLS = (
    SymbolRule(("rust",), "struct", _VIS + rf"struct\s+({NAME})", 2, 1, needs=("struct",)),
    SymbolRule(("rust",), "enum", _VIS + rf"enum\s+({NAME})", 2, 1, needs=("enum",)),
    SymbolRule(("rust",), "trait", _VIS + rf"(?:unsafe\s+)?trait\s+({NAME})", 2, 1, needs=("trait",)),
    SymbolRule(("rust",), "module", _VIS + rf"mod\s+({NAME})", 2, 1, needs=("mod",)),
    SymbolRule(("rust",), "type", _VIS + rf"type\s+({NAME})[^;]*=", 2, 1, needs=("type",)),
    SymbolRule(("rust",), "const", _VIS + rf"const\s+({NAME})\s*:", 2, 1, needs=("const",)),
    SymbolRule(("rust",), "static", _VIS + rf"static\s+(?:mut\s+)?({NAME})\s*:", 2, 1, needs=("static",)),
    SymbolRule(
        ("rust",), "function",
        _VIS + rf"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+({NAME})(?!.*;\s*$)",
        2, 1, needs=("fn",),
    ),
    SymbolRule(
        ("rust",), "+impl",
        r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>(?=\s+[^{]))?\s+(?:[^{]*?\sfor\s+)?([^{]+?)\s*(?:\bwhere\b.*)?(?:\{.*)?$",
        needs=("impl",),
    ),
    SymbolRule(JS, "function", _EXP + rf"(?:async\s+)?function\s+({NAME})", needs=("function",)),
    SymbolRule(JS, "class", _EXP + rf"class\s+({NAME})", needs=("class",)),
    SymbolRule(JS, "interface", _EXP + rf"interface\s+({NAME})", needs=("interface",)),
    SymbolRule(JS, "type", _EXP + rf"type\s+({NAME})\s*(?:<[^=]*>)?\s*=", needs=("type",)),
    SymbolRule(JS, "const", _EXP + rf"(?:const|let|var)\s+({NAME})", needs=("const", "let", "var")),
    SymbolRule(
        JS, "member",
        r"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?\s*"
        rf"(?!(?:if|for|while|switch|catch|return|function|new|super|with)\b)({NAME})\s*(?:<[^(]*>)?\([^;]*$",
        needs=("(",),
    ),
    SymbolRule(("python",), "function", rf"^(?:async\s+)?def\s+({NAME})", needs=("def",)),
    SymbolRule(("python",), "class", rf"^class\s+({NAME})", needs=("class",)),
    SymbolRule(("python",), "+class", rf"^\s+class\s+({NAME})", needs=("class",)),
    SymbolRule(("python",), "member", rf"^\s+(?:async\s+)?def\s+({NAME})", needs=("def",)),
    SymbolRule(("python",), "const", r"^([A-Z0-9_]+)\s*(?::[^=]+)?=(?!=)", needs=("=",)),
    SymbolRule(("go",), "function", rf"^func\s+({NAME})\s*[\[(]", needs=("func",)),
    SymbolRule(
        ("go",), "method",
        rf"^func\s*\(\s*(?:{NAME}\s+)?\*?\s*({NAME})\s*\)\s*({NAME})\s*[\[(]", 2, 0, 1, ("func",),
    ),
    SymbolRule(("go",), "type", rf"^\s*type\s+({NAME})\s+[^=\s]", needs=("type",)),
    SymbolRule(("go",), "const", rf"^\s*const\s+({NAME})", needs=("const",)),
    SymbolRule(("go",), "var", rf"^\s*var\s+({NAME})", needs=("var",)),
    SymbolRule(("go",), "grouped", rf"^\s+({NAME})\b"),
    SymbolRule(
        C, "function",
        _NOT_C_FN
        + r"\s*+[\p{L}_][\p{L}\p{N}_:<>,\s*&]*[\s*&]"
        + r"((?:[\p{L}_~][\p{L}\p{N}_]*+::)*+[\p{L}_~][\p{L}\p{N}_]*)\s*\((?:[^;]*$|[^;{]*\)[^;{]*\{)",
        needs=("(",),
    ),
    SymbolRule(C, "struct", rf"\bstruct\s+({NAME})", needs=("struct",)),
    SymbolRule(C, "enum", rf"\benum\s+(?:class\s+|struct\s+)?({NAME})", needs=("enum",)),
    SymbolRule(("cpp",), "class", rf"(?<!enum\s)\bclass\s+({NAME})", needs=("class",)),
    SymbolRule(("cpp",), "module", rf"^\s*(?:inline\s+)?namespace\s+({NAME})", needs=("namespace",)),
)

# Blocks whose direct members get a parent, and blocks that enclose callsites.
# Functions shield a Python class: what they define is not its member.
CONTAINERS = {
    "rust": ("+impl",),
    "python": ("class", "+class", "function", "member"),
    **{lang: ("class",) for lang in JS},
}
PARENTS = ("+impl", "class", "+class")
CALLABLE = ("function", "method")


class CallRule(NamedTuple):
    languages: tuple[str, ...]
    kind: str
    pattern: str  # group 1 is the leaf name
    needs: tuple[str, ...] = ()  # as for symbols


CALLS = (
    CallRule(BRACED, "call", rf"({NAME})\s*(?:::\s*<[^>()]*>\s*)?\(", needs=("(",)),
    CallRule(("python",), "call", rf"({NAME})\s*\(", needs=("(",)),
    CallRule(("rust",), "macro", rf"({NAME})!\s*[(\[{{]", needs=("!",)),
    CallRule(("go",), "type_ref", r"\b([A-Z][\p{L}\p{N}_]*)\{", needs=("{",)),
    CallRule(("rust",), "type_ref", r"(?<![\p{L}\p{N}_])([A-Z][\p{L}\p{N}_]*[a-z][\p{L}\p{N}_]*)(?![\p{L}\p{N}_])(?!\s*(?:\(|::|!))"),
    CallRule(
        ("typescript", "tsx"), "type_ref",
        r"(?:[:|&<,]\s*|\bimplements\s+|\bas\s+|\bextends\s+)([A-Z][\p{L}\p{N}_]+)(?![\p{L}\p{N}_(.])",
    ),
    CallRule(("go",), "type_ref", r"(?<=[\s*\])])([A-Z][\p{L}\p{N}_]+)(?![\p{L}\p{N}_])(?!\s*[(.{:=])"),
    CallRule(
        C, "type_ref",
        r"(?<![\p{L}\p{N}_.>])(?!(?:return|else|goto|case|struct|enum|class|union|new|delete|typedef|using|namespace|const|static|inline|extern|unsigned|signed|void|int|char|long|short|float|double|bool|auto)\b)"
        r"([\p{L}_][\p{L}\p{N}_]+)(?=(?:\s+[*&]*|\s*[*&]+\s*)[\p{L}_][\p{L}\p{N}_]*\s*[;=,()\[])",
    ),
)

# Words before '(' that are not calls, and reserved words that are not identifiers.
NOT_CALLS = (
    "if", "for", "while", "switch", "match", "catch", "return", "sizeof", "fn", "func", "function",
    "def", "class", "lambda", "and", "or", "not", "in", "is", "elif", "else", "await", "yield",
    "typeof", "new", "throw", "with", "as", "assert", "del", "except", "raise", "import", "where",
    "loop", "move", "pub", "impl", "go", "defer", "select", "case", "range", "var", "const", "type",
    "interface", "struct", "map", "chan", "decltype", "alignof",
)

# Definition heads: the name after these keywords is being defined, not called.
DEFINES = ("fn", "def", "class", "function", "struct", "enum", "trait", "interface", "type", "union")
DEFINITION = (
    rf"\b(?:{'|'.join(DEFINES)})\s+{NAME}"
    rf"|^\s*func\s*(?:\([^)]*\)\s*)?{NAME}"
)


class Mask(NamedTuple):
    languages: tuple[str, ...]
    pattern: str  # consecutive segments of the whole text
    blank: str  # segments to blank out


_DQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_LINE, _BLOCK = r"//[^\n]*+", r"/\*(?s:.*?)\*/"
_REST = r"|(?s:.)"

MASKS = (
    Mask(
        ("rust",),
        rf'{_LINE}|{_BLOCK}|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|' r"'(?:[^'\\\n]|\\[^\n']{1,8})'" r"""|[^/"']++""" + _REST,
        r"""^(?://|/\*|"|'.)""",
    ),
    Mask(JS, rf"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}|`[^`]*+`" r"""|[^/"'`]++""" + _REST, r"""^(?://|/\*|["'`](?s:.))"""),
    Mask(("go",), rf"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}|`[^`]*+`" r"""|[^/"'`]++""" + _REST, r"""^(?://|/\*|["'`](?s:.))"""),
    Mask(C, rf"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}" r"""|[^/"']++""" + _REST, r"""^(?://|/\*|["'].)"""),
    Mask(
        ("python",),
        r'#[^\n]*+|"""(?s:.*?)"""|' r"'''(?s:.*?)'''" rf"|{_DQ}|{_SQ}" r"""|[^#"']++""" + _REST,
        r"""^(?:#|["'](?s:.))""",
    ),
)
