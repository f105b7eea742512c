"""URL filter: host and path rules, and a character language-model ratio for the rest. DataFrame functions only.

Two variable-order Markov models of characters (orders 0 to 2, Witten-Bell smoothed: a context gives to the shorter one as
much weight as it has distinct successors, and an unseen context all), one learned from accepted and one from rejected URLs:
those that a rule allows or blocks. A URL's score is the mean over its characters of ln P(accepted) - ln P(rejected). The
threshold is calibrated on a held-out fold of the rule-labelled URLs: of a fixed grid, the value with the smallest sum of
both error rates. From it on a URL is allowed, below it blocked.

The models are one array of 46^3 log ratios, whatever the number of URLs (alphabet: a-z, 0-9, the marks of ALPHABET and one
symbol for all else, which also pads both ends). A URL's characters are added up inside its row, so nothing is exploded or
moved and a long URL costs in proportion to its length.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; its text (null: empty) is
still judged by the method. Without labelled URLs of both kinds the threshold is 0 and all scores follow from smoothing alone.
Rules of equal length that fit: the one given first. Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-?=&_%:~"
A = len(ALPHABET)
#: Grid of thresholds: steps of 1/STEP from -BINS/STEP to BINS/STEP.
STEP, BINS = 50, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # (allow or block, host and path prefix)


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[Rule], h: Column, p: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, pattern in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = pattern.partition("/")
        fits = ((h == name) | F.endswith(h, F.lit("." + name))) & F.startswith(p, F.lit("/" + prefix) if "/" in pattern else F.lit(""))
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def trigrams(url: Column) -> Column:
    """Codes 0..A^3-1 of each character and the end with the two before."""
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), r"[^a-z0-9/.?=&_%:-]", "~")
    symbol = F.transform(F.split(F.concat(F.lit("~~"), plain, F.lit("~")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    shifted = lambda k: F.slice(symbol, k + 1, F.greatest(F.size(symbol) - 2, F.lit(0)))
    both = F.zip_with(shifted(0), shifted(1), lambda a, b: a * A + b)
    return F.zip_with(both, shifted(2), lambda ab, c: (ab * A + c).cast("int"))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """(code, v: ln P(accepted) - ln P(rejected)) of all A^3 trigram codes, from (accepted boolean, code int) rows."""
    counts = labelled.groupBy("code").agg(F.sum(F.col("accepted").cast("long")).alias("n1"), F.sum((~F.col("accepted")).cast("long")).alias("n0"))
    grid = labelled.sparkSession.range(A**3).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").na.fill(0, ["n1", "n0"])
    c = F.col("code")
    grid = grid.select("n1", "n0", c, (c % (A * A)).alias("pair"), (c % A).alias("one"), F.floor(c / A).cast("int").alias("ab"), F.floor(c / A % A).cast("int").alias("b"))
    pair = grid.groupBy("pair").agg(F.sum("n1").alias("p1"), F.sum("n0").alias("p0"), F.first("b").alias("b"), F.first("one").alias("one"))
    one = pair.groupBy("one").agg(F.sum("p1").alias("u1"), F.sum("p0").alias("u0"))
    context = grid.groupBy("ab").agg(*[F.sum(f"n{k}").alias(f"c{k}") for k in "10"], *[F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"t{k}") for k in "10"])
    shorter = pair.groupBy("b").agg(*[F.sum(f"p{k}").alias(f"d{k}") for k in "10"], *[F.sum((F.col(f"p{k}") > 0).cast("long")).alias(f"s{k}") for k in "10"])
    whole = one.agg(*[F.sum(f"u{k}").alias(f"a{k}") for k in "10"], *[F.sum((F.col(f"u{k}") > 0).cast("long")).alias(f"r{k}") for k in "10"]).withColumn("all", F.lit(1))
    one = one.withColumn("all", F.lit(1)).join(F.broadcast(whole), "all")  # a single row
    one = one.select("one", *[((F.col(f"u{k}") + F.greatest(F.col(f"r{k}"), F.lit(1)) / A) / (F.col(f"a{k}") + F.greatest(F.col(f"r{k}"), F.lit(1)))).alias(f"o{k}") for k in "10"])

    def blend(n: str, total: str, kinds: str, below: str) -> Column:
        return F.when(F.col(total) == 0, F.col(below)).otherwise((F.col(n) + F.col(kinds) * F.col(below)) / (F.col(total) + F.col(kinds)))

    pair = pair.join(one, "one").join(shorter, "b").select("pair", *[blend(f"p{k}", f"d{k}", f"s{k}", f"o{k}").alias(f"q{k}") for k in "10"])
    full = grid.join(pair, "pair").join(context, "ab").select("code", *[blend(f"n{k}", f"c{k}", f"t{k}", f"q{k}").alias(f"x{k}") for k in "10"])
    return full.select("code", (F.ln("x1") - F.ln("x0")).alias("v"))


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls with `score`, the mean log ratio of `codes`: each looked up in one array of the model's A^3 values."""
    values = model.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "v"))), lambda r: r["v"]).alias("values")).scalar()
    total = F.aggregate("codes", F.lit(0.0), lambda s, c: s + F.get("__values", c))
    return urls.withColumn("__values", values).withColumn("score", total / F.size("codes")).drop("codes", "__values")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: of the grid, the smallest threshold with the least sum of both error rates on (accepted, score) rows."""
    place = F.greatest(F.least(F.floor(F.col("score") * STEP), F.lit(BINS)), F.lit(-BINS)).cast("int")
    counts = scored.select(place.alias("bin"), "accepted").groupBy("bin").agg(F.sum(F.col("accepted").cast("long")).alias("y"), F.sum((~F.col("accepted")).cast("long")).alias("n"))
    # at most 401 bins: rejected at or above a threshold and accepted below it, from sorted arrays
    rows = counts.agg(F.array_sort(F.collect_list(F.struct("bin", "y", "n"))).alias("h"))
    of = lambda f, keep: F.aggregate(F.filter("h", keep), F.lit(0).cast("long"), lambda s, r: s + r[f])
    every = lambda r: F.lit(True)
    errors = F.transform(F.sequence(F.lit(-BINS), F.lit(BINS)), lambda t: F.struct((of("y", lambda r: r["bin"] < t) / of("y", every) + of("n", lambda r: r["bin"] >= t) / of("n", every)).alias("e"), F.abs(t).alias("size"), t.alias("t")))
    best = F.array_min(errors)["t"] / STEP
    return rows.select(F.when((F.size("h") > 0) & (of("y", every) > 0) & (of("n", every) > 0), best).otherwise(F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", folds: int = 4) -> DataFrame:
    """(key, host, path, rule, verdict, score, threshold) of every row."""
    base = pages.select(F.col(key), F.col(url).alias("__url"))
    base = base.select("*", host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    base = base.select(key, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), trigrams(F.col("__url")).alias("codes"))
    labelled = base.where(F.col("by_rule").isNotNull()).select((F.col("by_rule") == "allow").alias("accepted"), "codes", (F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0).alias("calibrates"))
    model = C.settle(log_ratios(labelled.where(~F.col("calibrates")).select("accepted", F.explode("codes").alias("code"))), "url-model")
    scored = scores(labelled.where("calibrates").select("accepted", "codes"), model)
    score = scores(base, model).withColumn("threshold", threshold(scored).scalar())
    return score.select(key, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"), "score", "threshold")
