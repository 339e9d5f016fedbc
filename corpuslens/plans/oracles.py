"""The same results in SQL over the same tables, for checking the queries."""

from __future__ import annotations

from corpuslens.functions.outcome import EMPTY_RESPONSE, FRESH, SLIGHTLY_STALE, UNKNOWN
from corpuslens.functions.paths import INDEX_LANGUAGE, TREE_LANGUAGE
from corpuslens.operators import registry as R
from corpuslens.plans.bindings import CLONES, ENDINGS
from corpuslens.plans.queries import PROSE_RULES, REMOVED

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lookup(key: str, table: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


ENDING = f"list_extract([{', '.join(map(q, ENDINGS))}], CAST(doc_id % {len(ENDINGS)} AS INT) + 1)"
EXT = r"lower(regexp_extract(file_path, '[^/]\.([^./]+)$', 1))"
FILES = f"""files0 AS (SELECT doc_id, source AS root_path, lang || '/' || doc_id || '.' || {ENDING} AS file_path,
    lang, n_chars * 1000 AS mtime_ns, CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content FROM documents),
  files AS (SELECT *, {lookup(EXT, INDEX_LANGUAGE)} AS language FROM files0)"""


def lines_of(name: str, source: str, keys: str = "root_path, file_path") -> str:
    return rf"""{name}0 AS (SELECT {keys}, string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS ls
      FROM {source} WHERE content <> ''),
  {name} AS (SELECT {keys}, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line FROM {name}0)"""


LINES = FILES + ",\n  " + lines_of("lines", "files")
TOKENS = LINES + r""",
  tokens0 AS (SELECT root_path, file_path, line,
      unnest(list_distinct(regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_]*'))) AS token FROM lines),
  tokens AS (SELECT * FROM tokens0 WHERE strlen(token) >= 2)"""


def outline_of(lines: str) -> str:
    start = r"regexp_replace(text, '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+', '')"
    name = lambda p: rf"regexp_extract(substr({start}, {len(p) + 1}), '^[\p{{L}}\p{{N}}_]+', 0)"
    test = lambda p: f"starts_with({start}, {q(p)}) AND {name(p)} <> ''"
    trimmed = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
    return f"""(SELECT root_path, file_path, line,
      CASE {" ".join(f"WHEN {test(p)} THEN {name(p)}" for p, _ in PROSE_RULES)} END AS name,
      CASE {" ".join(f"WHEN {test(p)} THEN {q(k)}" for p, k in PROSE_RULES)} END AS kind,
      CASE WHEN length({trimmed}) <= 200 THEN {trimmed} ELSE substr({trimmed}, 1, 197) || '...' END AS signature
      FROM {lines})"""


SYMBOLS = LINES + f",\n  symbols AS (SELECT * FROM {outline_of('lines')} WHERE name IS NOT NULL)"

ORACLES["word_hits"] = f"WITH {TOKENS} SELECT root_path, file_path, line, token FROM tokens WHERE token = 'The'"
ORACLES["word_hits_ignore_case"] = f"WITH {TOKENS} SELECT root_path, file_path, line, token FROM tokens WHERE regexp_matches(token, '^[Ll][Aa]$')"
ORACLES["word_hits_many"] = f"""WITH {TOKENS},
  words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*')) AS word FROM benchmark) WHERE strlen(word) >= 2)
SELECT word, count(*) AS hits FROM tokens JOIN words ON token = word GROUP BY word"""
ORACLES["word_counts"] = f"""WITH {TOKENS} SELECT token, count(*) AS hits, count(DISTINCT root_path || chr(0) || file_path) AS files FROM tokens GROUP BY token"""
ORACLES["identifier_index"] = f"""WITH {TOKENS} SELECT root_path, file_path, count(*) AS n, CAST(sum(line) AS BIGINT) AS line_sum,
  CAST(sum(strlen(token)) AS BIGINT) AS token_bytes FROM tokens GROUP BY root_path, file_path"""
ORACLES["file_stats"] = f"""WITH {SYMBOLS}, n AS (SELECT root_path, file_path, count(*) AS c FROM symbols GROUP BY ALL),
  l AS (SELECT root_path, file_path, count(*) AS c FROM lines GROUP BY ALL)
SELECT f.root_path, f.file_path, f.language, {lookup(EXT.replace('file_path', 'f.file_path'), TREE_LANGUAGE)} AS label,
  coalesce(l.c, 0) AS lines, f.size_bytes, sha256(f.content) AS content_hash,
  CASE WHEN f.language IS NOT NULL THEN coalesce(n.c, 0) END AS symbols
FROM files f LEFT JOIN l USING (root_path, file_path) LEFT JOIN n USING (root_path, file_path)"""
ORACLES["outline_fallback"] = f"WITH {SYMBOLS} SELECT root_path, file_path, name, kind, line, signature FROM symbols"
ORACLES["symbol_exact"] = f"WITH {SYMBOLS} SELECT root_path, file_path, name, kind, line FROM symbols WHERE name = 'the'"
ORACLES["symbol_prefix"] = f"""WITH {SYMBOLS} SELECT root_path, file_path, name, kind, line FROM symbols
WHERE regexp_matches(name, '^[Tt][Hh]') AND kind = 'of'"""
ORACLES["symbols_by_kind"] = f"""WITH {SYMBOLS} SELECT root_path, file_path, kind, count(*) AS n, string_agg(name, ',' ORDER BY line, name) AS names
FROM symbols GROUP BY root_path, file_path, kind"""
ORACLES["outline_mixed"] = f"""WITH {TOKENS},
  known AS (SELECT * FROM lines JOIN files USING (root_path, file_path) WHERE language IS NOT NULL)
SELECT root_path, file_path, line, 'symbol' AS entry, kind, name AS text FROM {outline_of('(SELECT root_path, file_path, line, text FROM known)')} WHERE name IS NOT NULL
UNION ALL SELECT t.root_path, t.file_path, t.line, 'import', NULL, t.token FROM tokens t JOIN files f USING (root_path, file_path)
  WHERE f.language IS NOT NULL AND lower(token) = 'license'
UNION ALL SELECT root_path, file_path, line, 'symbol', kind, name FROM (
  SELECT l.*, CASE WHEN regexp_matches(text, '^\\s*(fn|func|def) [\\p{{L}}\\p{{N}}_]') THEN 'function' ELSE regexp_extract(text, '^\\s*(class|struct|type) [\\p{{L}}\\p{{N}}_]', 1) END AS kind,
    regexp_extract(text, '^\\s*(?:fn|func|def|class|struct|type) ([\\p{{L}}\\p{{N}}_]+)', 1) AS name
  FROM lines l JOIN files f USING (root_path, file_path) WHERE f.language IS NULL) WHERE name <> ''"""
ORACLES["read_ranges"] = f"""WITH {LINES},
  r AS (SELECT root_path, file_path, mtime_ns // 1000 % 9 - 1 AS "start", mtime_ns // 1000 % 9 - 1 + size_bytes % 5 - 1 AS "end", sha256(content) AS content_hash FROM files),
  t AS (SELECT root_path, file_path, count(*) AS total_lines FROM lines GROUP BY ALL)
SELECT root_path, file_path, "start", "end", total_lines, line, content_hash, text FROM r JOIN t USING (root_path, file_path) JOIN lines USING (root_path, file_path)
WHERE greatest("start", 1) <= total_lines AND line BETWEEN greatest("start", 1) AND greatest(least("end", total_lines), greatest("start", 1))"""

ORACLES["search_lines"] = f"""WITH {LINES} SELECT root_path, file_path, line, CAST(strlen(regexp_extract(text, '(?i)^(.*?)license', 1)) + 1 AS BIGINT) AS "column", text
FROM lines WHERE regexp_matches(text, '(?i)license')"""
ORACLES["search_context"] = f"""WITH {LINES}, m AS (SELECT *, regexp_matches(text, '[Ll]icen[cs]e') AS hit FROM lines)
SELECT a.root_path, a.file_path, a.line AS match_line, b.line, b.line - a.line AS "offset", b.text
FROM m a JOIN m b ON a.root_path = b.root_path AND a.file_path = b.file_path AND b.line BETWEEN a.line - 2 AND a.line + 2
WHERE a.hit AND (NOT b.hit OR a.line = b.line)"""
ORACLES["search_narrowed"] = f"""WITH {LINES} SELECT l.root_path, l.file_path, line, CAST(strlen(regexp_extract(text, '^(.*?)The +[a-z]+', 1)) + 1 AS BIGINT) AS "column", text
FROM lines l JOIN files f USING (root_path, file_path)
WHERE regexp_matches(text, 'The +[a-z]+') AND language = 'c' AND regexp_matches(file_path, '^(en|de)/') AND NOT regexp_matches(file_path, '5\\.h$')"""

PAGES = r"""pages0 AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS clean, html AS content FROM pages),
  page_files AS (SELECT page_id, regexp_extract(clean, '^[^/]*', 0) AS root_path,
    regexp_replace(regexp_replace(clean, '^[^/]*/', ''), '/+$', '') AS file_path, CAST(strlen(content) AS BIGINT) AS size_bytes, content FROM pages0)"""


def dirs(source: str, path: str = "file_path") -> str:
    """Rows of every proper directory above a path."""
    return f"""(SELECT *, array_to_string(p[1:i], '/') AS dir FROM
      (SELECT *, unnest(range(1, len(p))) AS i FROM (SELECT *, string_split({path}, '/') AS p FROM {source})))"""


ORACLES["tree_listing"] = f"""WITH {PAGES}, {lines_of('pl', 'page_files', 'page_id')},
  n AS (SELECT page_id, count(*) AS lines FROM pl GROUP BY ALL),
  e AS (SELECT root_path, file_path AS path, {lookup(EXT, TREE_LANGUAGE)} AS language, coalesce(lines, 0) AS lines, size_bytes, false AS is_dir
        FROM page_files LEFT JOIN n USING (page_id)
        UNION ALL SELECT DISTINCT root_path, dir, NULL, NULL, NULL, true FROM {dirs('page_files')})
SELECT root_path, path, language, lines, size_bytes, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, is_dir FROM e WHERE len(string_split(path, '/')) <= 3"""
ORACLES["tree_counts"] = f"""WITH {SYMBOLS}, n AS (SELECT root_path, file_path, count(*) AS lines FROM lines GROUP BY ALL),
  c AS (SELECT root_path, file_path, count(*) AS symbols FROM symbols GROUP BY ALL),
  e AS (SELECT root_path, file_path AS path, {lookup(EXT, TREE_LANGUAGE)} AS language, coalesce(lines, 0) AS lines, size_bytes, coalesce(symbols, 0) AS symbols, false AS is_dir
        FROM files LEFT JOIN n USING (root_path, file_path) LEFT JOIN c USING (root_path, file_path)
        UNION ALL SELECT DISTINCT root_path, dir, NULL, NULL, NULL, NULL, true FROM {dirs('files')})
SELECT root_path, path, language, lines, size_bytes, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, symbols, is_dir FROM e"""
ORACLES["relative_paths"] = f"""WITH {FILES} SELECT root_path || '/' || file_path AS "full", file_path AS below, root_path || '/' || file_path AS other FROM files"""
ORACLES["tree_rollup"] = f"""WITH {LINES}, n AS (SELECT root_path, file_path, count(*) AS c FROM lines GROUP BY ALL),
  f AS (SELECT root_path, file_path, size_bytes, coalesce(c, 0) AS c FROM files LEFT JOIN n USING (root_path, file_path)),
  u AS (SELECT root_path, dir AS path, size_bytes, c FROM {dirs('f')} UNION ALL SELECT root_path, '', size_bytes, c FROM f)
SELECT root_path, path, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(c) AS BIGINT) AS lines FROM u GROUP BY root_path, path"""
HOT = "h AS (SELECT event_type AS root_path, 'u/' || user_id AS file_path, max(epoch_us(ts)) * 1000 AS mtime_ns FROM events GROUP BY ALL)"
ORACLES["hot_files"] = f"WITH {HOT} SELECT root_path, file_path, mtime_ns FROM h ORDER BY mtime_ns DESC, root_path, file_path LIMIT 20"
ORACLES["hot_files_per_root"] = f"""WITH {HOT} SELECT * FROM (SELECT root_path, file_path, mtime_ns,
  row_number() OVER (PARTITION BY root_path ORDER BY mtime_ns DESC, file_path) AS rank FROM h) WHERE rank <= 5"""

CODE = """code AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS n, o_orderstatus AS s,
    substr(o_orderpriority, 3, 20) AS root_path,
    'src/order_' || o_orderkey || '.' || CASE o_orderstatus WHEN 'F' THEN 'rs' WHEN 'O' THEN 'py' ELSE 'go' END AS file_path FROM orders)"""
ORACLES["code_symbols"] = f"""WITH {CODE}
SELECT root_path, file_path, 'Order' || k AS name, CASE s WHEN 'F' THEN 'struct' WHEN 'O' THEN 'class' ELSE 'type' END AS kind,
  n + CASE s WHEN 'P' THEN 3 ELSE 2 END AS line, n + CASE s WHEN 'P' THEN 5 ELSE 4 END AS end_line, NULL AS parent, CASE s WHEN 'F' THEN 'pub' END AS visibility,
  CASE s WHEN 'F' THEN 'pub struct Order' || k || ' {{' WHEN 'O' THEN 'class Order' || k || ':' ELSE 'type Order' || k || ' struct {{' END AS signature FROM code
UNION ALL
SELECT root_path, file_path, CASE s WHEN 'P' THEN 'Total' ELSE 'total' END, 'method', n + CASE s WHEN 'O' THEN 3 ELSE 7 END, n + CASE s WHEN 'O' THEN 4 ELSE 9 END,
  'Order' || k, CASE s WHEN 'F' THEN 'pub' END,
  CASE s WHEN 'F' THEN 'pub fn total(&self) -> u64 {{' WHEN 'O' THEN 'def total(self):' ELSE 'func (o *Order' || k || ') Total() int {{' END FROM code"""
ORACLES["code_imports"] = f"""WITH {CODE} SELECT root_path, file_path, CASE s WHEN 'F' THEN 'crate::customer_' || c ELSE 'from .customer_' || c || ' import load' END AS target,
  CAST(1 AS BIGINT) AS line FROM code WHERE s <> 'P'"""
ORACLES["code_callsites"] = f"""WITH {CODE}
SELECT root_path, file_path AS caller_file, n + CASE s WHEN 'O' THEN 4 ELSE 8 END AS caller_line, CASE s WHEN 'P' THEN 'Total' ELSE 'total' END AS caller_symbol,
  CASE s WHEN 'F' THEN 'customer_' || c WHEN 'O' THEN 'load' ELSE 'customer' || c END AS callee_name, 'call' AS callee_kind FROM code
UNION ALL SELECT root_path, file_path, n + 6, NULL, 'Order' || k, 'type_ref' FROM code WHERE s = 'F'"""
ORACLES["code_identifiers"] = f"""WITH {CODE}, t AS (
  SELECT root_path, unnest(['use', 'crate', 'customer_' || c, 'pub', 'struct', 'Order' || k, 'total', 'u64', 'impl', 'Order' || k, 'pub', 'fn', 'total', 'self', 'u64', 'customer_' || c, 'self', 'total']) AS token FROM code WHERE s = 'F'
  UNION ALL SELECT root_path, unnest(['from', 'customer_' || c, 'import', 'load', 'class', 'Order' || k, 'def', 'total', 'self', 'return', 'load']) FROM code WHERE s = 'O'
  UNION ALL SELECT root_path, unnest(['package', 'orders', 'type', 'Order' || k, 'struct', 'total', 'int', 'func', 'Order' || k, 'Total', 'int', 'return', 'customer' || c]) FROM code WHERE s = 'P')
SELECT root_path, token, count(*) AS hits FROM t GROUP BY root_path, token"""
ORACLES["file_outline"] = f"""WITH {CODE}
SELECT root_path, file_path, CASE s WHEN 'F' THEN 'rust' WHEN 'O' THEN 'python' ELSE 'go' END AS language,
  CASE s WHEN 'F' THEN (n + 2) || ':struct:Order' || k || ',' || (n + 7) || ':method:total'
         WHEN 'O' THEN (n + 2) || ':class:Order' || k || ',' || (n + 3) || ':method:total'
         ELSE (n + 3) || ':type:Order' || k || ',' || (n + 7) || ':method:Total' END AS symbols,
  CASE s WHEN 'F' THEN '1:crate::customer_' || c WHEN 'O' THEN '1:from .customer_' || c || ' import load' END AS imports FROM code"""

ORACLES["import_resolution"] = f"""WITH {FILES},
  fam AS (SELECT *, CASE WHEN language = 'rust' THEN 'rust' WHEN language IN ('typescript', 'tsx', 'javascript') THEN 'js'
    WHEN language = 'python' THEN 'python' ELSE 'other' END AS form, regexp_extract(file_path, '/[0-9]+\\.(.*)$', 1) AS ending,
    CASE WHEN language IN ('typescript', 'tsx', 'javascript') THEN 'js' WHEN language IN ('c', 'cpp') THEN 'c' ELSE language END AS family FROM files WHERE language IS NOT NULL),
  i AS (SELECT *, CASE WHEN doc_id % 3 = 0 OR following IS NULL THEN doc_id + 10000000000 ELSE following END AS other FROM (SELECT *, lead(doc_id) OVER w AS following, coalesce(lead(ending) OVER w, 'h') AS following_ending
    FROM fam WINDOW w AS (PARTITION BY root_path, lang, family ORDER BY doc_id))),
  f AS (SELECT root_path, lang, doc_id AS other, file_path AS found, regexp_extract(file_path, '/[0-9]+\\.(.*)$', 1) AS ext FROM files)
SELECT i.root_path, i.file_path AS importer_file, f.found AS importee_file,
  CASE form WHEN 'rust' THEN 'crate::' || i.lang || '::' || i.other || '::{{Item, Other}}' WHEN 'js' THEN 'import x from ''./' || i.other || ''''
    WHEN 'python' THEN 'from .' || i.other || ' import x' ELSE '../' || i.lang || '/' || i.other || '.' || i.following_ending END AS raw_target
FROM i LEFT JOIN f ON i.root_path = f.root_path AND i.lang = f.lang AND i.other = f.other AND i.language <> 'go' AND
  CASE form WHEN 'rust' THEN ext = 'rs' WHEN 'js' THEN ext IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs') WHEN 'python' THEN ext = 'py' ELSE ext = i.following_ending END"""
ORACLES["link_resolution"] = f"""WITH {PAGES},
  asks0 AS (SELECT root_path, page_id, unnest(regexp_extract_all(content, 'href=["'']([^"'']*)["'']', 1)) AS href FROM page_files),
  asks AS (SELECT DISTINCT root_path, page_id, regexp_replace(href, '[?#].*$', '') AS href FROM asks0),
  a AS (SELECT *, regexp_replace(href, '^/+|/+$', '', 'g') AS clean FROM asks)
SELECT a.root_path, a.page_id, a.href, min(coalesce(e.file_path, b.file_path)) AS path FROM a
LEFT JOIN page_files e ON starts_with(href, '/') AND a.root_path = e.root_path AND e.file_path = a.clean
LEFT JOIN page_files b ON starts_with(href, '/') AND a.root_path = b.root_path AND starts_with(b.file_path, a.clean || '/')
GROUP BY a.root_path, a.page_id, a.href"""

LINKS = """pairs AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, l_returnflag AS flag, l_partkey AS a,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
  links AS (SELECT pairs.*, x.p_brand AS ba, y.p_brand AS bb FROM pairs JOIN part x ON a = x.p_partkey JOIN part y ON b = y.p_partkey),
  deps AS (SELECT ba AS root_path, CAST(a AS VARCHAR) AS importer, CASE WHEN ba = bb THEN CAST(b AS VARCHAR) END AS importee, CAST(b AS VARCHAR) AS raw, ln FROM links),
  edges AS (SELECT DISTINCT root_path, importer AS src, importee AS dst FROM deps WHERE importee IS NOT NULL),
  starts AS (SELECT p_brand AS root_path, CAST(p_partkey AS VARCHAR) AS start FROM part)"""


def walk(name: str, edges: str, hops: int, starts: str = "starts") -> str:
    return f"""{name}0 AS (SELECT root_path, start, start AS node, CAST(0 AS BIGINT) AS hop FROM {starts}
      UNION SELECT w.root_path, w.start, e.dst, w.hop + 1 FROM {name}0 w JOIN {edges} e ON w.root_path = e.root_path AND w.node = e.src WHERE w.hop < {hops}),
  {name} AS (SELECT root_path, start, node, min(hop) AS hop FROM {name}0 WHERE node <> start GROUP BY ALL)"""


REV = "rev AS (SELECT root_path, dst AS src, src AS dst FROM edges)"
ORACLES["deps_forward"] = f"WITH RECURSIVE {LINKS}, {walk('w', 'edges', 3)} SELECT root_path, start, node, hop FROM w"
ORACLES["deps_reverse"] = f"WITH RECURSIVE {LINKS}, {REV}, {walk('w', 'rev', 2)} SELECT root_path, start, node, hop FROM w"
ORACLES["deps_both"] = f"""WITH RECURSIVE {LINKS}, ends AS (SELECT root_path, 'forward' AS direction, src, dst FROM edges UNION ALL SELECT root_path, 'reverse', dst, src FROM edges),
  w(root_path, direction, start, node, hop) USING KEY (root_path, direction, start, node) AS (
    SELECT root_path, direction, start, start, CAST(0 AS BIGINT) FROM starts CROSS JOIN (VALUES ('forward'), ('reverse')) AS s(direction)
    UNION SELECT DISTINCT w.root_path, w.direction, w.start, e.dst, w.hop + 1 FROM w
      JOIN ends e ON w.root_path = e.root_path AND w.direction = e.direction AND w.node = e.src
      LEFT JOIN recurring.w k ON k.root_path = w.root_path AND k.direction = w.direction AND k.start = w.start AND k.node = e.dst WHERE k.node IS NULL)
SELECT root_path, start, direction, hop, count(*) AS n FROM w WHERE hop > 0 GROUP BY root_path, start, direction, hop"""
ORACLES["deps_unresolved"] = f"WITH {LINKS} SELECT DISTINCT root_path, importer AS start, raw AS target FROM deps WHERE importee IS NULL"
ORACLES["reverse_importers"] = f"WITH {LINKS} SELECT root_path, dst AS file, src AS importer FROM edges"
FIRST = "one AS (SELECT root_path, importer FROM deps ORDER BY CAST(importer AS BIGINT), root_path LIMIT 1)"
ORACLES["edges_of_part"] = f"""WITH {LINKS}, {FIRST} SELECT root_path, importer AS importer_file, raw AS raw_target, importee AS importee_file, ln AS line,
  row_number() OVER (ORDER BY ln, raw, importee NULLS FIRST) AS place FROM deps JOIN one USING (root_path, importer)"""
CALLS = LINKS + """,
  calls0 AS (SELECT ba AS root_path, 'o/' || ln || '/' || l_orderkey AS caller_file, ln AS caller_line, CASE WHEN ba = bb THEN CAST(b AS VARCHAR) END AS caller_symbol,
    CAST(a AS VARCHAR) AS callee_name, CASE flag WHEN 'A' THEN 'call' WHEN 'N' THEN 'macro' ELSE 'type_ref' END AS callee_kind FROM links),
  calls AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY root_path, caller_file, caller_line, callee_name
    ORDER BY callee_kind, caller_symbol NULLS LAST) AS r FROM calls0) WHERE r = 1),
  up AS (SELECT DISTINCT root_path, callee_name AS src, caller_symbol AS dst FROM calls WHERE caller_symbol IS NOT NULL)"""
ORACLES["calls_of_part"] = f"""WITH {CALLS}, {FIRST} SELECT root_path, caller_file, caller_line, callee_kind, caller_symbol FROM calls0 JOIN one USING (root_path) WHERE callee_name = importer"""
ORACLES["impact_sites"] = f"""WITH RECURSIVE {CALLS}, {walk('w', 'up', 2)},
  t AS (SELECT root_path, start, start AS callee_name, CAST(1 AS BIGINT) AS hop FROM starts UNION ALL SELECT root_path, start, node, hop + 1 FROM w)
SELECT root_path, start, hop, caller_line, caller_file, caller_symbol, callee_name, callee_kind FROM t JOIN calls USING (root_path, callee_name)"""
ORACLES["impact_scoped"] = f"""WITH {CALLS},
  defs AS (SELECT root_path, importee AS start, count(DISTINCT ln) AS definitions FROM deps WHERE importee IS NOT NULL GROUP BY ALL),
  n AS (SELECT root_path, callee_name AS start, count(*) FILTER (starts_with(caller_file, 'o/3/')) AS kept, count(*) FILTER (NOT starts_with(caller_file, 'o/3/')) AS dropped FROM calls GROUP BY ALL)
SELECT root_path, start, coalesce(definitions, 0) AS definitions, coalesce(kept, 0) AS kept, coalesce(dropped, 0) AS dropped,
  nullif(concat_ws('; ', CASE WHEN definitions > 1 THEN definitions || ' definitions of this name exist; name-based callsite matching may include unrelated references' END,
    CASE WHEN dropped > 0 THEN dropped || ' references dropped by `--file` scope' END), '') AS note
FROM starts LEFT JOIN defs USING (root_path, start) LEFT JOIN n USING (root_path, start)"""
ORACLES["cycles"] = f"""WITH RECURSIVE {LINKS},
  reach AS (SELECT root_path, src, dst FROM edges UNION SELECT r.root_path, r.src, e.dst FROM reach r JOIN edges e ON r.root_path = e.root_path AND r.dst = e.src),
  mutual AS (SELECT a.root_path, a.src AS member, a.dst AS other FROM reach a JOIN reach b ON a.root_path = b.root_path AND a.src = b.dst AND a.dst = b.src)
SELECT root_path, min(other) AS component, count(DISTINCT other) AS size, member FROM mutual GROUP BY root_path, member"""
COMMITS = LINKS + """,
  dag AS (SELECT DISTINCT ba AS root_path, CAST(b AS VARCHAR) AS sha, CAST(a AS VARCHAR) AS parent FROM links WHERE ba = bb AND a < b),
  anc AS (SELECT root_path, start AS sha, start AS node FROM starts UNION SELECT a.root_path, a.sha, d.parent FROM anc a JOIN dag d ON a.root_path = d.root_path AND a.node = d.sha)"""
AHEAD = """ahead AS (SELECT p.root_path, p.base, p.head, count(*) AS ahead FROM ask p JOIN anc h ON p.root_path = h.root_path AND p.head = h.sha
    WHERE NOT EXISTS (SELECT 1 FROM anc b WHERE b.root_path = p.root_path AND b.sha = p.base AND b.node = h.node) GROUP BY ALL)"""
ORACLES["ahead_count"] = f"""WITH RECURSIVE {COMMITS}, ask AS (SELECT root_path, parent AS base, sha AS head FROM dag), {AHEAD}
SELECT root_path, base, head, ahead FROM ahead"""
ORACLES["map_freshness"] = f"""WITH RECURSIVE {COMMITS},
  least AS (SELECT s.root_path, s.start AS sha, min(d.parent) AS recorded FROM starts s LEFT JOIN dag d ON s.root_path = d.root_path AND s.start = d.sha GROUP BY ALL),
  ask AS (SELECT root_path, recorded AS base, sha AS head FROM least WHERE recorded IS NOT NULL), {AHEAD},
  every AS (SELECT l.root_path, l.recorded, l.sha AS "current", a.ahead AS behind FROM least l LEFT JOIN ahead a ON l.root_path = a.root_path AND l.recorded = a.base AND l.sha = a.head
    UNION ALL SELECT root_path, sha, sha, 0 FROM least)
SELECT root_path, recorded, "current", behind, CASE WHEN behind = 0 THEN {q(FRESH)} WHEN behind BETWEEN 1 AND 10 THEN {q(SLIGHTLY_STALE)} ELSE {q(UNKNOWN)} END AS freshness FROM every"""

SNAP = FILES + f""",
  idx AS (SELECT root_path, file_path, mtime_ns, size_bytes, content, sha256(content) AS h FROM files
    WHERE doc_id IN (SELECT doc_id FROM labels) OR size_bytes < 500 OR doc_id % {REMOVED[0]} = {REMOVED[1]}),
  disk0 AS (SELECT doc_id, root_path, file_path, mtime_ns, regexp_replace(content, '(?m)^.*License.*$', '', 'g') AS content FROM files),
  disk AS (SELECT root_path, file_path, mtime_ns + CASE WHEN strlen(content) % 2 = 0 THEN 1 ELSE 0 END AS mtime_ns, strlen(content) AS size_bytes, content, sha256(content) AS h
    FROM disk0 WHERE doc_id % {REMOVED[0]} <> {REMOVED[1]}),
  diff AS (SELECT coalesce(d.root_path, i.root_path) AS root_path, coalesce(d.file_path, i.file_path) AS file_path,
    CASE WHEN i.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'removed' WHEN d.mtime_ns = i.mtime_ns AND d.size_bytes = i.size_bytes THEN 'current'
      WHEN d.h = i.h THEN 'touched' ELSE 'changed' END AS status
    FROM disk d FULL JOIN idx i ON d.root_path = i.root_path AND d.file_path = i.file_path)"""
ORACLES["snapshot_diff"] = f"WITH {SNAP} SELECT root_path, file_path, status FROM diff"
ORACLES["index_upsert"] = f"""WITH {SNAP},
  kept AS (SELECT i.* FROM idx i JOIN diff USING (root_path, file_path) WHERE status NOT IN ('changed', 'removed')
    UNION ALL SELECT d.* FROM disk d JOIN diff USING (root_path, file_path) WHERE status IN ('missing', 'changed')),
  {lines_of('kl', 'kept')}
SELECT root_path, file_path, name, kind, line FROM {outline_of('kl')} WHERE name IS NOT NULL"""

PKG = f"""pkg AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS identifier, lower(c_name) AS display_name,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'git' ELSE 'local' END AS source_type,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'https://host.example/' || n_nationkey || '/' || lower(c_mktsegment) END AS source_url,
    CASE WHEN c_acctbal > 5000 THEN 'main' END AS source_branch,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '/home' ELSE '' END || '{CLONES}/' || lower(replace(n_name, ' ', '_')) || '/' || lower(c_mktsegment) AS path,
    c_acctbal >= 0 AS auto_pull, CASE WHEN c_acctbal < 1000 THEN 'alpha' WHEN c_acctbal > 9000 THEN 'gamma' END AS harness, c_acctbal < 0 AS shallow,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'branch' ELSE 'global' END AS prepare_scope,
    coalesce((SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1990-01-01') AS created_at
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
CONV = """conv AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS package_id,
    'What about order ' || o_orderkey || ' of priority ' || o_orderpriority || '?' AS question,
    CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS BIGINT) AS exit_code, o_orderdate AS created_at FROM orders)"""
MAPS = """maps AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS package_id, 'map ' || props || chr(10) AS content, ts AS created_at,
    CASE WHEN event_type <> 'view' THEN event_type END AS git_branch FROM events),
  latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY package_id, git_branch ORDER BY created_at DESC, id DESC) AS r FROM maps) WHERE r = 1)"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {1}"


def stamp(column: str, name: str | None = None) -> str:
    return STAMP.format(column, name or column)


def shown(text: str, limit: int = 80) -> str:
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE substr({text}, 1, {limit - 3}) || '...' END"


ORACLES["nearest_package"] = f"""WITH {PKG},
  homes AS (SELECT path, min(identifier) AS identifier FROM (SELECT path, identifier FROM pkg WHERE source_type = 'git'
    UNION ALL SELECT '{CLONES}/' || lower(replace(n_name, ' ', '_')), n_name FROM nation) GROUP BY path),
  work AS (SELECT id, path || '/src/' || id AS path FROM pkg)
SELECT id, path, package FROM (SELECT w.id, w.path, h.identifier AS package, row_number() OVER (PARTITION BY w.id ORDER BY length(h.path) DESC NULLS LAST) AS r
  FROM work w LEFT JOIN homes h ON w.path = h.path OR starts_with(w.path, h.path || '/')) WHERE r = 1"""
ORACLES["history_recent"] = f"""WITH {PKG}, {CONV} SELECT identifier, id, exit_code, {stamp('created_at')}, rank, {shown('question')} AS shown FROM (
  SELECT p.identifier, c.*, row_number() OVER (PARTITION BY p.identifier ORDER BY c.created_at DESC, c.id) AS rank
  FROM conv c JOIN pkg p ON c.package_id = p.id WHERE c.created_at >= TIMESTAMP '2000-01-01' - INTERVAL 1000 DAY) WHERE rank <= 5"""
ORACLES["recent_questions"] = f"""SELECT package_id, id, rank, {shown('text')} AS shown FROM (SELECT CAST(conv_id AS VARCHAR) AS package_id, CAST(turn AS VARCHAR) AS id, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role = 'user') WHERE rank <= 3"""
ORACLES["last_activity"] = f"SELECT CAST(o_custkey AS VARCHAR) AS package_id, {stamp('max(o_orderdate)', 'last_activity')} FROM orders GROUP BY o_custkey"
ORACLES["stream_last_activity"] = ORACLES["last_activity"]
ORACLES["latest_map"] = f"WITH {MAPS} SELECT package_id, git_branch, id, content, {stamp('created_at')} FROM latest"
ORACLES["latest_map_by_scope"] = f"""WITH {PKG}, {MAPS},
  wants AS (SELECT id AS package_id, prepare_scope, CASE WHEN auto_pull THEN 'click' END AS branch FROM pkg)
SELECT w.package_id, w.prepare_scope, w.branch, l.id AS map_id FROM wants w LEFT JOIN latest l
  ON w.package_id = l.package_id AND (CASE WHEN prepare_scope = 'branch' THEN branch END) IS NOT DISTINCT FROM l.git_branch"""
ORACLES["map_upsert"] = f"WITH {MAPS} SELECT package_id, git_branch, id, {stamp('created_at')} FROM latest"
ACTIVITY = """act AS (SELECT p.*, greatest(p.created_at, c.m, g.m) AS activity FROM pkg p
    LEFT JOIN (SELECT package_id, max(created_at) AS m FROM conv GROUP BY ALL) c ON p.id = c.package_id
    LEFT JOIN (SELECT package_id, max(created_at) AS m FROM maps WHERE git_branch IS NULL GROUP BY ALL) g ON p.id = g.package_id)"""
ORACLES["package_activity"] = f"WITH {PKG}, {CONV}, {MAPS}, {ACTIVITY} SELECT id, {stamp('activity')} FROM act"
ORACLES["retention"] = f"""WITH {PKG}, {CONV}, {MAPS}, {ACTIVITY}, m AS (SELECT * FROM act WHERE source_type = 'git' AND starts_with(path, '{CLONES}/'))
SELECT path, {stamp('g.activity', 'activity')}, identifier FROM m JOIN (SELECT path, max(activity) AS activity FROM m GROUP BY path) g USING (path)
WHERE g.activity < TIMESTAMP '2001-06-01'"""
ORACLES["registry_cascade"] = f"""WITH {PKG}, {CONV}, {MAPS}, gone AS (SELECT id FROM pkg WHERE shallow)
SELECT id, count(*) AS n, 'packages' AS relation FROM pkg WHERE id NOT IN (FROM gone) GROUP BY id
UNION ALL SELECT package_id, count(*), 'conversations' FROM conv WHERE package_id NOT IN (FROM gone) GROUP BY package_id
UNION ALL SELECT package_id, count(*), 'maps' FROM maps WHERE package_id NOT IN (FROM gone) GROUP BY package_id"""
ORACLES["registry_orphans"] = f"""WITH {PKG}, {MAPS} SELECT id, CASE WHEN package_id IN (SELECT id FROM pkg WHERE source_type = 'git') THEN 'kept' ELSE 'refused' END AS state FROM maps"""
ORACLES["registry_insert"] = f"""WITH {PKG}, n AS (SELECT 'n' || id AS id, path AS identifier, row_number() OVER (PARTITION BY path ORDER BY created_at, 'n' || id) AS r FROM pkg)
SELECT id, identifier, 'present' AS state FROM pkg UNION ALL SELECT id, identifier, CASE WHEN r = 1 THEN 'present' ELSE 'rejected' END FROM n"""
ORACLES["registry_settings"] = f"""WITH {PKG},
  s AS (SELECT *, CASE WHEN source_branch IS NOT NULL THEN 'true' WHEN shallow THEN 'maybe' ELSE 'false' END AS pull, coalesce(harness, 'beta') AS tool FROM pkg)
SELECT identifier, 'state' AS key, CAST(CASE WHEN pull = 'maybe' THEN auto_pull ELSE pull = 'true' END AS VARCHAR) || '|' ||
  CASE WHEN shallow THEN '-' WHEN tool IN ('alpha', 'beta') THEN tool ELSE coalesce(harness, '-') END || '|' || CASE WHEN auto_pull THEN 'branch' ELSE prepare_scope END AS value FROM s
UNION ALL SELECT identifier, 'auto-pull', 'invalid value' FROM s WHERE pull = 'maybe'
UNION ALL SELECT identifier, 'harness', 'harness not configured' FROM s WHERE NOT shallow AND tool NOT IN ('alpha', 'beta')
UNION ALL SELECT identifier, 'prepare-scope', 'missing value' FROM s WHERE NOT auto_pull"""
ORACLES["clone_reuse"] = f"""WITH {PKG} SELECT source_url, id, path FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY created_at, id) AS r FROM pkg
  WHERE source_url IS NOT NULL) WHERE r = 1"""
ORACLES["packages_per_path"] = f"WITH {PKG} SELECT path, count(*) AS n FROM pkg GROUP BY path"
ORACLES["removable_paths"] = f"""WITH {PKG}, g AS (SELECT *, NOT auto_pull OR length(path) > 26 AS gone FROM pkg)
SELECT DISTINCT path FROM g WHERE gone AND starts_with(path, '{CLONES}/') AND path NOT IN (SELECT path FROM g WHERE NOT gone)"""
ORACLES["run_outcome"] = f"""WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 7 END AS code, starts_with(o_orderpriority, '1') AS blank,
    CASE WHEN o_totalprice > 100000 THEN 'main' END AS pre, CASE WHEN o_custkey > 100 THEN CASE WHEN o_totalprice > 200000 THEN 'main' ELSE 'dev' END END AS post FROM orders)
SELECT o_orderkey, CAST(CASE WHEN code IS NULL THEN 2 WHEN code = 0 AND NOT blank THEN 0 ELSE 3 END AS BIGINT) AS outcome,
  CASE WHEN code = 0 AND blank THEN {q(EMPTY_RESPONSE)} WHEN blank THEN ' ' || chr(10) || chr(9) ELSE o_orderpriority END AS response,
  coalesce(post, pre) AS branch, pre IS DISTINCT FROM post AS moved FROM o"""
ORACLES["identifier_valid"] = rf"""WITH {PAGES}, p AS (SELECT concat_ws('/', root_path, file_path) AS i FROM page_files),
  e AS (SELECT c_name AS identifier FROM customer UNION SELECT i FROM p UNION SELECT url FROM pages
    UNION SELECT unnest(['/' || i, i || '/', 'a//../' || i, 'a/../b//' || i, '']) FROM p),
  s AS (SELECT identifier, list_filter(string_split(identifier, '/'), lambda x: x IN ('', '.', '..'))[1] AS bad FROM e)
SELECT identifier, CASE WHEN identifier = '' THEN 'empty' WHEN NOT regexp_full_match(identifier, '[A-Za-z0-9._/@-]+') THEN 'invalid characters'
  WHEN starts_with(identifier, '/') THEN 'leading slash' WHEN ends_with(identifier, '/') THEN 'trailing slash'
  WHEN bad = '' THEN 'empty segment' WHEN bad IS NOT NULL THEN 'dot segment' END AS problem FROM s"""
ORACLES["url_valid"] = r"""WITH u AS (SELECT DISTINCT unnest([url, regexp_replace(url, '^https?://', 'git@'), 'ftp' || url, regexp_replace(url, '^https?:/', ''),
    regexp_replace(url, '^https?://([^/]*)/', 'me@\1:')]) AS url FROM pages)
SELECT url, regexp_matches(url, '^(https://|http://|git://|ssh://|file://|/)') OR (contains(url, '@') AND contains(url, ':') AND NOT contains(url, '://')) AS valid,
  starts_with(url, 'http://') AS insecure FROM u"""
ORACLES["storage_names"] = r"""SELECT url, array_to_string(list_transform(regexp_extract_all(url, '(?s).'), lambda c:
  CASE WHEN regexp_full_match(c, '[A-Za-z0-9._-]') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') AS name FROM pages"""
ORACLES["manifest_roundtrip"] = f"""WITH {PKG} SELECT identifier, source_url AS git, source_branch AS branch, harness, auto_pull, shallow, prepare_scope FROM pkg WHERE source_type = 'git'"""
STATUS = "CASE WHEN auto_pull THEN 'skipped' WHEN harness IS NOT NULL AND harness NOT IN ({0}) THEN 'failed' ELSE 'added' END AS status"
ORACLES["manifest_import"] = f"WITH {PKG} SELECT identifier, {STATUS.format(chr(39) + 'alpha' + chr(39) + ', ' + chr(39) + 'beta' + chr(39))} FROM pkg WHERE source_type = 'git'"
ORACLES["manifest_tally"] = f"""WITH {PKG}, s AS (SELECT CASE WHEN source_type <> 'git' THEN 'local' ELSE status END AS status FROM
  (SELECT *, {STATUS.format(q('alpha'))} FROM pkg)) SELECT status, count(*) AS n FROM s GROUP BY status"""
ORACLES["log_roundtrip"] = """WITH t AS (SELECT *, role <> 'system' AS json, CASE WHEN role <> 'system' AND turn % 3 <> 1 THEN text END AS response FROM conversations),
  c AS (SELECT *, CASE WHEN json THEN CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 3 END END AS outcome FROM t)
SELECT CAST(outcome AS BIGINT) AS outcome, count(*) AS n, CAST(sum(strlen(response)) AS BIGINT) AS response_bytes, count(*) FILTER (json) AS parsed,
  CAST(sum(CASE WHEN response IS NOT NULL THEN strlen(response) WHEN NOT json THEN strlen(text) END) AS BIGINT) AS shown_bytes FROM c GROUP BY outcome"""
ORACLES["stream_outcomes"] = """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 3 ELSE 2 END AS BIGINT) AS outcome, o_orderpriority AS shown FROM orders"""


def by_freshness(texts: dict) -> str:
    return f"CASE WHEN behind = 0 THEN {q(texts[FRESH])} WHEN behind BETWEEN 1 AND 10 THEN {q(texts[SLIGHTLY_STALE])} ELSE {q(texts[UNKNOWN])} END"


RFC = """strftime(m.created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(m.created_at) % 1000000 = 0 THEN '' WHEN epoch_us(m.created_at) % 1000 = 0
  THEN '.' || strftime(m.created_at, '%g') ELSE '.' || strftime(m.created_at, '%f') END || '+00:00'"""
ORACLES["prompt_batch"] = f"""WITH {PKG}, {CONV}, {MAPS},
  recent AS (SELECT package_id, string_agg('- ' || question || chr(10), '' ORDER BY r) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY package_id
    ORDER BY created_at DESC, id) AS r FROM conv) WHERE r <= 3 GROUP BY package_id),
  asks AS (SELECT *, 'Where is ' || display_name || '?' AS question, CASE WHEN auto_pull THEN 'click' END AS branch,
    CASE WHEN source_branch IS NOT NULL THEN 'head' ELSE 'unknown' END AS cur, length(path) * 7 % 14 AS behind FROM pkg)
SELECT a.id AS ask_id, a.identifier, replace(replace({q(R.INTRO)}, '(%s)', '(' || a.identifier || ')'), '%s', a.display_name)
  || CASE WHEN shallow THEN {q(R.SHALLOW_NOTE)} ELSE '' END
  || CASE WHEN m.id IS NULL THEN '' ELSE {q(R.MAP_BEGIN)} || {by_freshness(R.DIRECTIVE)} || 'Prepared at ' || {RFC} || ' on commit `c' || m.id || '` (current HEAD `' || cur || '`'
    || CASE WHEN behind > 0 THEN ', ' || behind || ' commits behind' ELSE '' END || '). Scope: `' || CASE WHEN m.git_branch IS NULL THEN 'global' ELSE 'branch' END
    || '`' || chr(10) || m.content || {q(R.MAP_END)} END
  || CASE WHEN r.recent IS NULL THEN '' ELSE {q(R.QUESTIONS)} || r.recent || chr(10) END
  || chr(10) || 'Question: ' || a.question || chr(10) || chr(10)
  || CASE WHEN m.id IS NULL THEN {q(R.CLOSING[None])} ELSE {by_freshness(R.CLOSING)} END || chr(10) AS prompt
FROM asks a LEFT JOIN latest m ON a.id = m.package_id AND (CASE WHEN prepare_scope = 'branch' THEN branch END) IS NOT DISTINCT FROM m.git_branch
LEFT JOIN recent r ON a.id = r.package_id"""
ORACLES["byte_budget"] = f"""WITH {LINES}, s AS (SELECT root_path, file_path, line, sum(strlen(text) + 1) OVER (PARTITION BY root_path ORDER BY file_path, line) AS used_bytes,
    sum(strlen(text) + 1) OVER (PARTITION BY root_path) AS total FROM lines)
SELECT root_path, file_path, line, CAST(used_bytes AS BIGINT) AS used_bytes, total > 16384 AS truncated FROM s WHERE used_bytes <= 16384"""
ORACLES["stream_index"] = f"""WITH {lines_of('sl', "(SELECT source AS root_path, lang || '/' || doc_id AS file_path, text AS content FROM documents)")}
SELECT root_path, file_path, name, kind, line FROM {outline_of('sl')} WHERE name IS NOT NULL"""
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = rf"'^{WS}+|{WS}+$', '', 'g'"
ORACLES["sanitize_cap"] = rf"""WITH t AS (SELECT doc_id, replace(regexp_replace(text, {TRIM}), chr(13) || chr(10), chr(10)) AS b FROM (SELECT doc_id,
    CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '{WS}+$', '') ELSE text END AS text FROM documents)),
  c AS (SELECT doc_id, regexp_replace(regexp_replace(b, '\n{WS}*\n', chr(10) || chr(10), 'g'), {TRIM}) AS clean FROM t),
  k AS (SELECT *, chr(10) || chr(10) || '... [orientation map truncated at 3000 bytes]' AS marker FROM c),
  n AS (SELECT *, 3000 - strlen(marker) AS room, list_transform(string_split(clean, ''), lambda x: strlen(x)) AS sizes FROM k),
  p AS (SELECT *, CASE WHEN strlen(clean) <= 3000 THEN clean ELSE regexp_replace(substr(clean, 1, CAST((SELECT count(*) FROM (SELECT unnest(range(1, len(sizes) + 1)) AS i)
    WHERE i <= room AND strlen(substr(clean, 1, i)) <= room) AS INT)), '{WS}+$', '') || marker END AS capped FROM n)
SELECT doc_id, sha256(clean) AS clean_hash, sha256(capped) AS capped_hash, CAST(strlen(capped) AS BIGINT) AS capped_bytes FROM p"""
ORACLES["index_build"] = rf"""WITH {FILES}, state AS (
    SELECT f.*, l.doc_id IS NOT NULL AS again, CASE WHEN l.doc_id IS NULL THEN content
      ELSE regexp_replace(content, '(?m)^.*License.*$', '', 'g') END AS now
    FROM files f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE language IS NOT NULL)
  SELECT root_path, file_path, language, mtime_ns + CAST(again AND now <> content AS BIGINT) AS mtime_ns, CAST(strlen(now) AS BIGINT) AS size_bytes,
    sha256(now) AS content_hash, '2024-01-01 00:00:00.000000' AS indexed_at FROM state"""
NEST = """nest AS (SELECT l_orderkey AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS j,
      count(*) OVER (PARTITION BY l_orderkey) AS m, l_orderkey % 2 = 0 AS js, 'src/nest_' || l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN '.js' ELSE '.c' END AS path FROM lineitem),
  placed AS (SELECT *, CASE WHEN js THEN 2 + 5 * (j - 1) ELSE 4 + 7 * (j - 1) END AS top FROM nest)"""
ORACLES["nested_symbols"] = f"""WITH {NEST}
  SELECT 'nest' AS root_path, path AS file_path, 'item' || j AS name, CASE WHEN js THEN 'method' ELSE 'function' END AS kind, top AS line, top + CASE WHEN js THEN 4 ELSE 6 END AS end_line,
    CASE WHEN js THEN 'Order' || k END AS parent, CASE WHEN js THEN 'item' || j || '(a) {{' ELSE 'static int item' || j || '(int a)' END AS signature FROM placed
  UNION ALL SELECT DISTINCT 'nest', path, CASE WHEN js THEN 'Order' ELSE 'order' END || k, CASE WHEN js THEN 'class' ELSE 'struct' END, CAST(1 AS BIGINT),
    CASE WHEN js THEN 2 + 5 * m ELSE 3 END, NULL, CASE WHEN js THEN 'class Order' ELSE 'struct order' END || k || ' {{' FROM nest"""
ORACLES["nested_callsites"] = f"""WITH {NEST}
  SELECT 'nest' AS root_path, path AS caller_file, top + CASE WHEN js THEN 2 ELSE 3 END AS caller_line, 'item' || j AS caller_symbol, 'pay' || part AS callee_name, 'call' AS callee_kind FROM placed"""
ORACLES["search_indexed"] = ORACLES["search_lines"]
ORACLES["word_lookup"] = ORACLES["word_hits_ignore_case"]
ORACLES["impact_definitions"] = f"""WITH {LINKS}
  SELECT DISTINCT d.root_path, d.importee AS start, d.importer AS file_path, d.ln AS line FROM deps d JOIN starts s ON d.root_path = s.root_path AND d.importee = s.start"""
ORACLES["symbols_ranked"] = f"""WITH {SYMBOLS} SELECT root_path, file_path, name, kind, line, row_number() OVER (ORDER BY root_path, file_path, line, name, kind) AS rank FROM symbols"""
ORACLES["cycles_ranked"] = f"""SELECT *, row_number() OVER (ORDER BY root_path, size, component, member) AS rank FROM ({ORACLES["cycles"]})"""
