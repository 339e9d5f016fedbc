"""Mixing to target weights: soft domain membership, then document rates by projected gradient least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import cut

# Signs whose counts tell domains apart; counted in lower case by taking them out of the text.
SIGNS = "etaoinshrdlucmfwgpbvkyzqxéèêàçüöäßñíó"
FLATTEN = 0.7  # power of the natural shares that makes the default targets
FLOOR = 1.0  # least rate: at 1 no document is lost
PULL = 0.002  # of rates towards 1, so that one solution is best
STEPS = 60
LENGTH = 200.0  # signs that a long text's evidence counts as, at most


def _counts(text: Column) -> Column:
    low, whole = F.lower(text), F.length(text)
    return F.array(*((whole - F.length(F.replace(low, F.lit(c)))).cast("double") for c in SIGNS))


def posteriors(docs: DataFrame, labelled: DataFrame, domain: str) -> tuple[DataFrame, list[str]]:
    """``docs`` (doc_id, text) as (doc_id, n_tokens, p): p[k] is the chance that the text is of the k-th domain.

    ``labelled`` (doc_id, the column ``domain``) names the domain of some. Multinomial Bayes over sign counts. What reaches the
    driver is one row of sums per domain, and ``domain`` has to have few values.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    counted, _ = cut(docs.select("doc_id", words.cast("long").alias("n_tokens"), _counts(text).alias("c")), "signs")
    known = labelled.select("doc_id", F.col(domain).cast("string").alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("d")).where("domain = d")
    sums = counted.dropDuplicates(["doc_id"]).join(known, "doc_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("c", F.lit(i))).alias(f"s{i}") for i in range(len(SIGNS))))
    rows = sums.orderBy("domain").collect()
    if not rows:
        return counted.select("doc_id", "n_tokens", F.array(F.lit(1.0)).alias("p")), [""]
    total = sum(r["n"] for r in rows)
    evidence = []
    for r in rows:
        s = [r[f"s{i}"] + 1.0 for i in range(len(SIGNS))]
        dot = sum((F.get("c", F.lit(i)) * F.log(F.lit(v / sum(s))) for i, v in enumerate(s)), F.lit(0.0))
        evidence.append((dot, r["n"] / total))
    every = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    scale = F.least(F.lit(1.0), LENGTH / F.greatest(every, F.lit(1.0)))
    logs = F.array(*(e * F.col("scale") + F.log(F.lit(prior)) for e, prior in evidence))
    soft = counted.withColumn("scale", scale).select("doc_id", "n_tokens", logs.alias("l")).withColumn("m", F.array_max("l"))
    soft = soft.select("doc_id", "n_tokens", F.transform("l", lambda x: F.exp(x - F.col("m"))).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return soft.withColumn("w", whole).select("doc_id", "n_tokens", F.transform("e", lambda x: x / F.col("w")).alias("p")), [r["domain"] for r in rows]


def rates(soft: DataFrame, domains: Sequence[str], targets: dict[str, float] | None = None, floor: float = FLOOR) -> DataFrame:
    """``soft`` (doc_id, n_tokens, p) with ``rate`` of at least ``floor``, by projected gradient.

    Least squares over all documents' rates: the expected tokens of each domain, as a multiple of its natural tokens, shall be the
    multiple that the target weight asks for; ``PULL`` holds rates near 1. The multiples are scaled so that the domain furthest over its
    target keeps ``floor`` times its tokens. A step is one aggregation to as many sums as there are
    domains; a document's rate follows from these sums alone, so rates are never written in between.
    """
    k = len(domains)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    natural = [x or 0.0 for x in soft.agg(*(F.sum(n * x) for x in p)).first()]
    if not sum(natural):
        return soft.withColumn("rate", F.lit(max(1.0, floor)))
    share = [x / sum(natural) for x in natural]
    wanted = [targets.get(d, 0.0) for d in domains] if targets else [s**FLATTEN for s in share]
    wanted = [w / sum(wanted) for w in wanted]
    least = max(((s / w) for s, w in zip(share, wanted, strict=True) if w > 0), default=1.0) if floor >= 1 else 1.0
    aim = [least * max(floor, 0.0 if floor < 1 else 1.0) * w / s if s else 1.0 for s, w in zip(share, wanted, strict=True)] if floor >= 1 else [w / s if s else 1.0 for s, w in zip(share, wanted, strict=True)]
    pulls: list[list[float]] = []

    def rate() -> Column:
        steps = F.array(*(F.array(*map(F.lit, u)) for u in pulls)) if pulls else F.array().cast("array<array<double>>")
        move = lambda r, u: sum((x * F.get(u, F.lit(i)) for i, x in enumerate(p)), F.lit(0.0)) + PULL * (r - 1)
        return F.aggregate(steps, F.lit(max(1.0, floor)), lambda r, u: F.greatest(F.lit(float(floor)), r - move(r, u)))

    for _ in range(STEPS):
        got = soft.agg(*(F.sum(n * x * rate()) for x in p)).first()
        miss = [g / t - a if t else 0.0 for g, t, a in zip(got, natural, aim, strict=True)]
        if max(map(abs, miss)) < 0.003:
            break
        pulls.append(miss)
    return soft.withColumn("rate", rate())


def mix(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float] | None = None, floor: float = FLOOR) -> DataFrame:
    """doc_id, n_tokens, p (posterior per domain in order of name), rate and copies for each row of ``docs``.

    ``copies`` is the rate rounded up or down by a hash of doc_id, so that its mean is the rate. ``targets`` are weights per
    domain; by default natural token shares to the power ``FLATTEN``. Without labelled rows there is one domain and all rates are 1.
    Null or empty text has no tokens and follows the priors; a null doc_id rounds like any other value; repeated rows are
    treated alike. Domains that differ for one doc_id are not learned from. Other columns are ignored; an empty table gives an empty result.
    """
    soft, names = posteriors(docs, labelled, domain)
    soft, _ = cut(soft, "soft")
    whole = F.floor("rate")
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rates(soft, names, targets, floor).withColumn("copies", (whole + (share < F.col("rate") - whole).cast("int")).cast("int"))
