"""Path columns: languages, normalising, scopes, globs, storage names, validity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language of the index.
INDEX_LANGUAGE = {
    "rs": "rust",
    "ts": "typescript",
    "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "py": "python", "pyi": "python",
    "go": "go",
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}

# File extension -> label in tree listings. Not the same map.
TREE_LANGUAGE = {
    "rs": "rust", "py": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "go": "go", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c-header",
    "hpp": "cpp-header", "hh": "cpp-header", "hxx": "cpp-header",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "scala": "scala", "sh": "shell", "bash": "shell", "zsh": "shell",
    "fish": "fish", "lua": "lua", "pl": "perl", "r": "r", "ex": "elixir", "exs": "elixir",
    "erl": "erlang", "hrl": "erlang", "hs": "haskell", "ml": "ocaml", "mli": "ocaml",
    "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "dart": "dart", "zig": "zig",
    "nim": "nim", "sql": "sql", "md": "markdown", "markdown": "markdown", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "htm": "html",
    "css": "css", "scss": "scss", "less": "less", "vue": "vue", "svelte": "svelte",
    "proto": "protobuf", "graphql": "graphql", "gql": "graphql", "dockerfile": "dockerfile",
    "tf": "terraform",
}

# Accepted beginnings of a repository address.
URL_STARTS = ("https://", "http://", "git://", "ssh://", "file://", "/")


def extension(path: Column) -> Column:
    """Lower-case extension, '' if the file name has none (a leading dot is not one)."""
    return F.translate(
        F.regexp_extract(path, r"[^/]\.([^./]+)$", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def index_language(path: Column) -> Column:
    return _lookup(INDEX_LANGUAGE, extension(path))


def tree_language(path: Column) -> Column:
    return _lookup(TREE_LANGUAGE, extension(path))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part, '' at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def join_path(directory: Column, rest: Column) -> Column:
    """``directory/rest``, or ``rest`` when the directory is empty."""
    return F.when(directory == "", rest).otherwise(F.concat(directory, F.lit("/"), rest))


def normalize(path: Column) -> Column:
    """Remove ``.`` and resolve ``..`` in a relative path; a leading ``..`` stays."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        pops = (part == "..") & (F.size(done) > 0) & (last != "..")
        return (
            F.when((part == ".") | (part == ""), done)
            .when(pops, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    walked = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    # Most paths have nothing to do; spare them the fold.
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), F.array_join(walked, "/")).otherwise(path)


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, deepest first; '/' or '' ends absolute/relative."""
    parts = F.split(path, "/")
    longest = F.size(parts)
    return F.when(
        path == "/", F.array(F.lit("/"))
    ).otherwise(
        F.transform(
            F.sequence(longest, F.lit(1), F.lit(-1)),
            lambda n: F.when((n == 1) & F.startswith(path, F.lit("/")), F.lit("/")).otherwise(
                F.array_join(F.slice(parts, 1, n), "/")
            ),
        )
    )


def parent_dirs(path: Column) -> Column:
    """Every proper directory above a relative path, without the root itself."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda n: F.array_join(F.slice(parts, 1, n), "/"),
        )
    )


def relative_to(root: Column, path: Column) -> Column:
    """Path below ``root``; unchanged when it is not below it."""
    prefix = F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def in_scope(path: Column, scope: Column) -> Column:
    """Whether ``path`` is ``scope`` or below it, by whole path parts."""
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob (``**``, ``*``, ``?``, ``[]``, ``{a,b}``).

    A glob without a slash matches the file name at any depth.
    """
    body = glob.removeprefix("/")
    lead = "" if "/" in glob.rstrip("/") else "(?:.*/)?"
    out, i, braces = "", 0, 0
    while i < len(body):
        ch = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        close = body.find("]", i + 2) if ch == "[" else -1
        if close > 0:
            inner = body[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            inner = "^" + inner[1:] if inner[0] == "!" else inner
            out, i = out + f"[{inner}]", close + 1
            continue
        if ch == "{":
            out, braces = out + "(?:", braces + 1
        elif ch == "}" and braces:
            out, braces = out + ")", braces - 1
        elif ch == "," and braces:
            out += "|"
        elif ch == "\\" and i + 1 < len(body):
            i += 1
            out += re.escape(body[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch))
        i += 1
    return f"^{lead}{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    """Path glob test; a leading ``!`` inverts it."""
    if glob.startswith("!"):
        return ~path.rlike(glob_regex(glob[1:]))
    return path.rlike(glob_regex(glob))


def storage_name(identifier: Column) -> Column:
    """Percent-encode every byte outside ``[A-Za-z0-9._-]``, for use as a folder name."""
    hexed = F.hex(identifier.cast("binary"))
    pairs = F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))
    encoded = F.array_join(
        F.transform(
            pairs,
            lambda h: F.when(
                F.unhex(h).cast("string").rlike("^[A-Za-z0-9._-]$"), F.unhex(h).cast("string")
            ).otherwise(F.concat(F.lit("%"), h)),
        ),
        "",
    )
    return F.when(identifier.rlike("^[A-Za-z0-9._-]*$"), identifier).otherwise(encoded)


def identifier_problem(identifier: Column) -> Column:
    """Why a package identifier is refused, null when it is fine."""
    return (
        F.when(identifier == "", "empty")
        .when(~identifier.rlike(r"^[A-Za-z0-9._/@-]+\z"), "invalid characters")
        .when(F.startswith(identifier, F.lit("/")), "leading slash")
        .when(F.endswith(identifier, F.lit("/")), "trailing slash")
        # In the order of the segments: the first bad one gives the reason.
        .when(
            F.regexp_extract(F.concat(identifier, F.lit("/")), r"^(?:[^/]*[^/.][^/]*/|\.{3,}/)*(\.{0,2}/)", 1)
            == "/",
            "empty segment",
        )
        .when(identifier.rlike(r"(^|/)\.{1,2}(/|\z)"), "dot segment")
    )


def url_valid(url: Column) -> Column:
    """Whether a string looks like a repository address."""
    start = F.lit(False)
    for prefix in URL_STARTS:
        start = start | F.startswith(url, F.lit(prefix))
    scp = F.contains(url, F.lit("@")) & F.contains(url, F.lit(":")) & ~F.contains(url, F.lit("://"))
    return start | scp


def url_insecure(url: Column) -> Column:
    return F.startswith(url, F.lit("http://"))
