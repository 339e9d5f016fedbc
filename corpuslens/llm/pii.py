"""Personal data: patterns, and terms that give the found values away by their co-occurrence in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import cut

KINDS = ("email", "ip", "card", "phone")
WINDOW = 120  # code points on each side of a value that its terms are taken from
DISCLOSED = 0.9  # share of a value's information that a term may give away
SUPPORT = 3  # different surroundings that a term and a value must share to count

# An address starts at the first letter of its run, or where the match before it ended; that and
# possessive counts keep each search linear and change no match.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LIKELY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def found(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, value); places count code points, from 0.

    The pieces between the matches and the matches themselves have lengths that add up to the places.
    """
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        a = state["at"] + F.length(pair["piece"])
        b = a + F.length(pair["value"])
        one = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), pair["value"].alias("value"))
        return F.struct(b.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    both = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.aggregate(both, start, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds in order of kind, then start; matches that fail their test are left out."""
    none = F.array().cast(_SPAN)
    def of(kind: str) -> Column:
        real = F.filter(found(text, _PATTERNS[kind], kind), lambda s: _holds(kind, s["value"]))
        return F.when(text.rlike(_LIKELY[kind]), real).otherwise(none)

    return F.concat(*map(of, KINDS))


def _terms(rows: DataFrame) -> DataFrame:
    """(doc_id, value, term, start, end, around): the words around each base span, but not those that overlap any span."""
    near = rows.select("doc_id", "text", "base", F.explode("base").alias("s"))
    near = near.withColumn("from", F.greatest(F.lit(0), F.col("s.start") - WINDOW))
    around = F.substr(F.col("text"), F.col("from") + 1, F.col("s.end") + WINDOW - F.col("from"))
    near = near.withColumn("around", around).withColumn("last", F.col("from") + F.length("around")).withColumn("size", F.length("text"))
    words = found(F.col("around"), r"[^\x20\x09-\x0D]+", "term")
    near = near.select("doc_id", "base", "from", "last", "size", F.xxhash64(F.lower("s.value")).alias("value"), F.xxhash64("around").alias("around"), F.explode(words).alias("w"))
    start, end = F.col("from") + F.col("w.start"), F.col("from") + F.col("w.end")
    whole = ((F.col("from") == 0) | (F.col("w.start") > 0)) & ((end < F.col("last")) | (F.col("last") == F.col("size")))
    clear = ~F.exists("base", lambda b: (b["start"] < end) & (b["end"] > start))
    return near.where(whole & clear).select("doc_id", "value", F.xxhash64(F.lower("w.value")).alias("term"), start.alias("start"), end.alias("end"), "around")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and terms (arrays of kind, start, end, value) for each row of ``docs`` (doc_id, text).

    A base value e is protected. A term t near it discloses it when their pointwise mutual information
    log(n(e,t) N / (n(e) n(t))), over documents, reaches ``DISCLOSED`` of e's own information log(N / n(e)),
    and the two meet in ``SUPPORT`` different surroundings or more; such terms are spans wherever they stand near e. A text
    without a base value never gets a span. Frequencies of all words are summed over all documents.

    Null text counts as empty and has no spans. Rows with equal doc_id are one document; a null doc_id has base
    spans but no terms. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    based, total = cut(rows.select("doc_id", "base"), "base")
    holders = rows.where((F.size("base") > 0) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    terms, _ = cut(_terms(holders), "terms")
    met = terms.groupBy("value", "term").agg(F.countDistinct("around").alias("places"), F.countDistinct("doc_id").alias("n_both")).where(F.col("places") >= SUPPORT)
    met, some = cut(met, "met")
    if not some:
        return based.withColumn("terms", F.array().cast(_SPAN))
    held = based.where("doc_id is not null").select("doc_id", F.explode("base.value").alias("v")).select("doc_id", F.xxhash64(F.lower("v")).alias("value")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_value"))
    words = docs.where("doc_id is not null").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("w"))
    words = words.groupBy(F.xxhash64("w").alias("term")).agg(F.count(F.lit(1)).alias("n_term"))
    shared = met.join(held, "value").join(words, "term")
    n = F.lit(float(max(total, 1)))
    told = F.log(F.col("n_both") * n / (F.col("n_value") * F.col("n_term")))
    risky = shared.where((told > 0) & (told >= DISCLOSED * F.log(n / F.col("n_value")))).select("value", "term")
    more = terms.join(risky, ["value", "term"], "left_semi").select("doc_id", F.struct(F.lit("term").alias("kind"), "start", "end", F.lit(None).cast("string").alias("value")).alias("s")).distinct()
    more = more.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).cast(_SPAN).alias("terms"))
    return based.join(more, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast(_SPAN)))


def written(array: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` where each span is generalised to its kind, as ``[EMAIL]``, and disclosing terms are removed.

    Where spans overlap the one that begins first, and then the longest, counts. Null text stays null."""
    more = spans(docs).where(F.size("terms") > 0).dropDuplicates(["doc_id"]).select("doc_id", F.col("terms").alias("_terms"))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        name = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        next_ = F.struct(s["end"].alias("at"), F.concat(state["out"], before, name).alias("out"))
        return F.when(s["start"] >= state["at"], next_).otherwise(state)

    out = docs.join(more, "doc_id", "left")
    out = out.withColumn("_all", F.concat(base_spans(F.coalesce("text", F.lit(""))), F.coalesce("_terms", F.array().cast(_SPAN))))
    clean = F.aggregate(F.array_sort("_all", order), start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    return out.withColumn("text", F.when(F.size("_all") > 0, clean).otherwise(F.col("text"))).select(docs.columns)
