"""Licence scans: templates found by the relative places of their rarest words, then checked word for word."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after A-Z is lower-cased
RARE = 6  # words of the highest inverse document frequency that a template is looked up by
AGREE = 0.5  # share of a template's postings that have to agree on its place
ALIKE = 0.75  # share of its words that have to stand at their places
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ODD = {"\u212a": "\u0138", "\u0130": "\u0131"}  # the signs beyond A-Z whose lower case has a letter a-z, and what stands for them


class Template(NamedTuple):
    """Words of a licence notice, with the phrases of it that may not differ. A ``base`` phrase has to stand whole."""

    label: str
    words: str
    keys: tuple[str, ...] = ()
    base: bool = False


# The dealt phrases with their labels, and openings of public licences in lower-case words.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge", "without restriction")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)
_SHIFT, _ROOM = 34, 1 << 20  # a template's number and the place where it would begin, in one long


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased, with an empty one first or last where a break is; null has none but that.

    Lower-casing A-Z alone gives the same words, as far as words of a-z and digits are concerned, and costs four times as much."""
    plain = F.coalesce(text, F.lit(""))
    for sign, other in _ODD.items():
        plain = F.replace(plain, F.lit(sign), F.lit(other))
    return F.split(F.lower(plain), BREAK)


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Rows of ``words`` that hold each word of the templates; the templates bound what reaches the driver."""
    known = sorted({w for t in templates for w in t.words.split()})
    seen = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, known)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(known, 0) | {r.w: r.n for r in seen.collect()}


def rarest(template: Template, frequency: dict[str, int], count: int = RARE) -> list[str]:
    """The template's words of the highest inverse document frequency; of equals the first by letters. One serves a base phrase."""
    return sorted(set(template.words.split()), key=lambda w: (frequency[w], w))[: 1 if template.base else count]


def _strings(rows: list[list[str]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def scan(docs: DataFrame, templates: tuple[Template, ...] = (*BASE, *NOTICES), key: str = "doc_id", text: str = "text", rare: int = RARE, agree: float = AGREE, alike: float = ALIKE) -> DataFrame:
    """(doc_id, n_words, found) for each row of ``docs``; found has (label, base, start, share) per place, in order of template and place.

    Document frequencies of the templates' words are counted over all rows. A template is posted under its ``rare`` words of
    highest inverse document frequency, with their places in it. In each text the posted words are looked up, and each posting
    says where its template would begin; where ``agree`` of a template's postings say the same place, its words are compared
    there. It is found if ``alike`` of them stand at their places and its key phrases stand whole. A base template has
    one posted word and has to stand whole, so every place of it is found. ``share`` is the share of words that agree.

    All is done in the row by sorting and hashing, so a text costs its words, and a place at most a template. Nothing
    is shuffled but counts of template words. Null and empty texts have no words and nothing found. Rows are taken one by one:
    equal or null keys give a row each. Other columns are ignored; an empty table gives an empty result. Templates are of words
    of a-z and digits.
    """
    if any(not re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", t.words) for t in templates):
        raise ValueError("templates are words of a-z and digits with one blank between them")
    rows = docs.select(F.col(key).alias("doc_id"), words_of(F.col(text)).alias("words"))
    frequency = document_frequencies(rows, templates)
    rows = rows.withColumn("words", F.array_remove("words", ""))
    split = [t.words.split() for t in templates]
    posted: dict[str, list[int]] = {}
    need = []
    for t, template in enumerate(templates):
        chosen = set(rarest(template, frequency, rare))
        places = [p for p, w in enumerate(split[t]) if w in chosen]
        need.append(1 if template.base else max(1, -int(-agree * len(places) // 1)))
        for p in places:
            posted.setdefault(split[t][p], []).append((t << _SHIFT) + _ROOM - p)
    index = F.create_map(*(x for w, at in posted.items() for x in (F.lit(w), F.array(*map(F.lit, at)).cast("array<bigint>"))))
    some = F.array(*map(F.lit, posted))

    none = F.array().cast("array<bigint>")
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(*posted), i)))
    begins = F.flatten(F.transform("at", lambda i: F.transform(index[F.get("words", i)], lambda b: b + i)))
    needed = F.array(*map(F.lit, need))
    same = lambda k, i: F.get("begins", i + F.get(needed, F.shiftright(k, _SHIFT).cast("int")) - 1) == k
    rows = rows.withColumn("at", F.when(F.arrays_overlap("words", some), at).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("begins", F.sort_array(F.when(F.size("at") > 0, begins).otherwise(none)))
    rows = rows.withColumn("places", F.array_distinct(F.filter("begins", same)))

    text_of = _strings(split)
    keys = F.array(*(
        F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in _spans(template))).cast("array<struct<from:int,to:int>>")
        for template in templates))
    label, base = F.array(*(F.lit(t.label) for t in templates)), F.array(*(F.lit(t.base) for t in templates))

    def tried(k: Column) -> Column:
        t = F.shiftright(k, _SHIFT).cast("int")
        start = (F.shiftleft(t.cast("long"), _SHIFT) * -1 + k - _ROOM).cast("int")
        stands = F.transform(F.get(text_of, t), lambda w, j: F.coalesce(F.get("words", start + j) == w, F.lit(False)))
        return F.struct(t.alias("t"), start.alias("start"), stands.alias("stands"))

    def judged(x: Column) -> Column:
        share = F.size(F.filter(x["stands"], lambda s: s)) / F.size(x["stands"])
        whole = F.forall(F.get(keys, x["t"]), lambda s: F.forall(F.slice(x["stands"], s["from"] + 1, s["to"] - s["from"]), lambda y: y))
        return F.struct(F.get(label, x["t"]).alias("label"), F.get(base, x["t"]).alias("base"), x["start"].alias("start"), share.alias("share"), whole.alias("whole"))

    rows = rows.withColumn("tried", F.transform("places", tried)).withColumn("judged", F.transform("tried", judged))
    enough = F.filter("judged", lambda x: x["whole"] & (x["share"] >= F.when(x["base"], 1.0).otherwise(alike)))
    found = F.transform(enough, lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["start"].alias("start"), x["share"].alias("share")))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))


def _spans(template: Template) -> list[tuple[int, int]]:
    """First word and end of each key phrase in its template."""
    words, out = template.words.split(), []
    for phrase in template.keys:
        k = phrase.split()
        at = next((i for i in range(len(words) - len(k) + 1) if words[i: i + len(k)] == k), None)
        if at is None:
            raise ValueError(f"the template does not hold its key phrase {phrase!r}")
        out.append((at, at + len(k)))
    return out


def summary(found: DataFrame) -> DataFrame:
    """One row per document: places of base phrases, the first and last of them, labels, and the best share of a template found (else 0)."""
    base = F.filter("found", lambda x: x["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def sql(templates: tuple[Template, ...] = (*BASE, *NOTICES), rare: int = RARE, agree: float = AGREE, alike: float = ALIKE) -> str:
    """DuckDB SQL for :func:`summary` of :func:`scan`: words, postings and places as tables, joined and counted."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({t}, {p}, {q(w)}, {any(a <= p < b for a, b in _spans(x))})" for t, x in enumerate(templates) for p, w in enumerate(x.words.split())]
    kinds = [f"({t}, {q(x.label)}, {x.base}, {len(x.words.split())})" for t, x in enumerate(templates)]
    return rf"""
  WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
  tw(t, p, w, key) AS (VALUES {', '.join(rows)}),
  tk(t, label, base, size) AS (VALUES {', '.join(kinds)}),
  v AS (SELECT DISTINCT w FROM tw),
  k AS MATERIALIZED (SELECT rid, w, i FROM (SELECT rid, unnest(words) AS w, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS i FROM d) SEMI JOIN v USING (w)),
  df AS (SELECT w, count(DISTINCT rid) AS n FROM v LEFT JOIN k USING (w) GROUP BY w),
  ranked AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY n, w) AS r FROM (SELECT DISTINCT t, w FROM tw) JOIN df USING (w)),
  posted AS (SELECT tw.t, tw.p, tw.w FROM tw JOIN ranked USING (t, w) JOIN tk USING (t) WHERE r <= CASE WHEN base THEN 1 ELSE {rare} END),
  need AS (SELECT t, CASE WHEN base THEN 1 ELSE greatest(1, CAST(ceil({agree} * count(*)) AS BIGINT)) END AS m FROM posted JOIN tk USING (t) GROUP BY t, base),
  places AS (SELECT rid, t, i - p AS start FROM k JOIN posted USING (w) JOIN need USING (t) GROUP BY rid, t, i - p, m HAVING count(*) >= m),
  judged AS (SELECT a.rid, a.t, a.start, tk.label, tk.base, count(*) FILTER (k.w = tw.w) / tk.size AS share,
      bool_and(NOT tw.key OR coalesce(k.w = tw.w, false)) AS whole
    FROM places a JOIN tk ON tk.t = a.t JOIN tw ON tw.t = a.t LEFT JOIN k ON k.rid = a.rid AND k.i = a.start + tw.p
    GROUP BY a.rid, a.t, a.start, tk.label, tk.base, tk.size),
  found AS (SELECT rid, label, base, start, share FROM judged WHERE whole AND share >= CASE WHEN base THEN 1.0 ELSE {alike} END),
  f AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      max(share) AS score FROM found GROUP BY rid)
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
  FROM d LEFT JOIN f USING (rid)"""
