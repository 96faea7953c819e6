"""URL judgement: allow and block rules, and beyond them a character language-model ratio.

URLs that a rule decides are the labelled corpus.  Counts of all their character n-grams give
smoothed variable-order Markov models of accepted and rejected URLs: the counts after each context
are smoothed toward the shorter context's estimate, down to equal chances of all known characters
and one for any other, so the chances of what may follow add up to one.  A URL's score is the mean log-likelihood
difference per character, calibrated on labelled URLs that were left out of the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.llm._io import Scratch


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Longest n-gram: a character and up to four before it.
ORDER = 5
#: Weight of the shorter context's estimate, in characters.
SMOOTHING = 2.0
#: One labelled URL in so many calibrates instead of being counted.
HELD_BACK = 5
#: n-grams that may be broadcast (about 40 MB); beyond, they are joined by a shuffle.
BROADCAST_GRAMS = 400_000
_A_TO_Z, _a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _A_TO_Z, _a_to_z)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits: host or a subdomain, and a path that starts so."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        at_host = (host == F.lit(rule.host)) | host.endswith(f".{rule.host}")
        fits = at_host & path.startswith(rule.path)
        name, action = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


def _characters(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``url``, with the n-gram that ends there (shorter at the start) and its length."""
    at = F.explode(F.sequence(F.lit(1), F.length("url"))).alias("at")
    rows = urls.where(F.length("url") > 0).select(*keep, "url", at)
    first = F.greatest(F.col("at") - (ORDER - 1), F.lit(1))
    size = F.col("at") - first + 1
    return rows.select(*keep, F.col("url").substr(first, size).alias("gram"), size.alias("size"))


def train_grams(labelled: DataFrame) -> DataFrame:
    """(gram, ratio, backoff) for every string of up to ORDER characters seen in either corpus.  ``ratio`` is the log
    ratio of both models' probabilities of its last character after the others; null for the empty string.  ``backoff``
    is that of the weights which the string, as a context, gives to the shorter one; 0 if nothing follows it.
    ``labelled`` has url and accepted (boolean)."""
    whole = _characters(labelled, "accepted")
    shorter = F.explode(F.sequence(F.lit(1), F.col("size"))).alias("n")
    whole = whole.groupBy("gram", "size").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    grams = whole.select(F.col("gram").alias("long"), shorter, "good", "bad")
    grams = grams.groupBy(F.expr("right(long, n)").alias("gram"), F.col("n")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    scratch = Scratch(labelled.sparkSession, "url-model")
    grams = scratch.save(grams.select("gram", "n", "good", "bad", F.expr("left(gram, n - 1)").alias("context"), F.expr("right(gram, n - 1)").alias("tail")), "grams")
    contexts = scratch.save(grams.groupBy("context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")), "contexts")
    grams = scratch.save(grams.join(contexts, "context"), "with-contexts")
    even = 1 / (grams.where("n = 1").count() + 1)
    known = None
    for n in range(1, ORDER + 1):
        level = grams.where(F.col("n") == n)
        if known is None:
            level = level.select("gram", "good", "bad", "all_good", "all_bad", F.lit(even).alias("q_good"), F.lit(even).alias("q_bad"))
        else:
            below = known.select(F.col("gram").alias("tail"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad"))
            level = level.join(below, "tail").select("gram", "good", "bad", "all_good", "all_bad", "q_good", "q_bad")
        smooth = lambda side: (F.col(side) + SMOOTHING * F.col(f"q_{side}")) / (F.col(f"all_{side}") + SMOOTHING)
        known = scratch.save(level.select("gram", smooth("good").alias("p_good"), smooth("bad").alias("p_bad")), f"order-{n}")
        part = known.select("gram", F.log(F.col("p_good") / F.col("p_bad")).alias("ratio"))
        model = part if n == 1 else model.unionByName(part)
    weight = F.log((F.col("all_bad") + SMOOTHING) / (F.col("all_good") + SMOOTHING))
    backoff = contexts.select(F.col("context").alias("gram"), weight.alias("backoff"))
    model = model.join(backoff, "gram", "full").select("gram", "ratio", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
    return scratch.save(model, "model")


def _judged(grams: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """``grams`` (gram, size) with value: the log ratio of its last character's probabilities, by the longest ending
    that was seen, times the weights of the longer contexts that were seen without that character."""
    none = model.where(F.length("gram") == 0).first()
    found, behind = F.lit(none.backoff if none else 0.0), F.lit(0.0)
    rows = grams
    for n in range(1, ORDER + 1):
        level = model.where(F.length("gram") == n)
        level = level.select(F.col("gram").alias(f"g{n}"), F.col("ratio").alias(f"r{n}"), F.col("backoff").alias(f"b{n}"))
        ends = level.select(f"g{n}", f"r{n}")
        rows = rows.withColumn(f"g{n}", F.when(F.col("size") >= n, F.expr(f"right(gram, {n})")))
        rows = rows.join(F.broadcast(ends) if small else ends, f"g{n}", "left")
        if n > 1:
            before = F.when(F.col("size") >= n, F.expr(f"substring(gram, size - {n - 1}, {n - 1})"))
            contexts = model.where(F.length("gram") == n - 1).select(F.col("gram").alias(f"c{n}"), F.col("backoff").alias(f"b{n}"))
            rows = rows.withColumn(f"c{n}", before).join(F.broadcast(contexts) if small else contexts, f"c{n}", "left")
            behind = F.coalesce(F.col(f"b{n}"), F.lit(0.0))
        found = F.coalesce(F.col(f"r{n}"), found + behind)
    return rows.select("gram", found.alias("value"))


def score(urls: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, llr): the mean log ratio over a URL's characters; 0 for URLs without characters.  ``key`` tells rows apart.

    Each distinct string of ORDER characters is judged once; the characters, one row each, carry the key alone."""
    scratch = Scratch(urls.sparkSession, "url-scores")
    rows = _characters(urls, key)
    values = scratch.save(_judged(rows.select("gram", "size").distinct(), model, model.count() <= BROADCAST_GRAMS), "values")
    values = F.broadcast(values) if values.count() <= BROADCAST_GRAMS else values
    means = rows.select(key, "gram").join(values, "gram").groupBy(key).agg(F.avg("value").alias("llr"))
    empty = urls.where(F.coalesce(F.length("url"), F.lit(0)) == 0).select(key, F.lit(0.0).alias("llr"))
    return means.unionByName(empty)


@dataclass(frozen=True)
class Calibration:
    """Log odds of acceptance as a line in the score, from the held-back classes' means and pooled variance."""

    slope: float
    offset: float

    def probability(self, llr: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * llr + F.lit(self.offset))))


def calibrate(scored: DataFrame) -> Calibration:
    """``scored`` has llr and accepted.  With one class alone or no spread the score's sign decides."""
    stats = {r.accepted: r for r in scored.groupBy("accepted").agg(F.avg("llr").alias("m"), F.var_pop("llr").alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    good, bad = stats.get(True), stats.get(False)
    if good is None or bad is None or good.m <= bad.m:
        return Calibration(1.0, 0.0)
    pooled = max((good.v * good.n + bad.v * bad.n) / (good.n + bad.n), 1e-6)
    slope = (good.m - bad.m) / pooled
    return Calibration(slope, -slope * (good.m + bad.m) / 2)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, host, path, rule, verdict, llr, p_accept) for each row of ``pages``.

    A rule's action is the verdict where one fits; else the language models' probability of acceptance, allow from
    one half on.  A null or empty URL has no characters and so score 0 before calibration.  Repeated rows and keys
    are judged row by row.  If no URL fits a rule, every score is 0 and all are allowed.  Only key and url are read.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    name, action = rule_for(F.col("host"), F.col("path"), rules)
    rows = scratch.save(rows.withColumn("rule", name).withColumn("action", action), "rows")
    labelled = rows.where("action is not null and url is not null").withColumn("accepted", F.col("action") == "allow")
    apart = F.pmod(F.xxhash64("url"), F.lit(HELD_BACK)) == 0
    model = train_grams(labelled.where(~apart).select("url", "accepted"))
    scores = score(rows.select("__row", "url"), model, "__row")
    scored = scratch.save(rows.join(scores, "__row"), "scored")
    line = calibrate(scored.where(F.col("action").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(HELD_BACK)) == 0)).withColumn("accepted", F.col("action") == "allow"))
    p = line.probability(F.col("llr"))
    verdict = F.coalesce("action", F.when(p >= 0.5, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(F.col("__key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "llr", p.alias("p_accept"))


def op6_url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Contract columns for ``pages``."""
    return judge(pages)
