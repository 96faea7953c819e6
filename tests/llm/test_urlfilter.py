import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoreel.llm import urlfilter as U


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "action"),
    [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://x.net/EN/", "x.net", "/EN/", "net/", "block"),
        ("https://x.net", "x.net", "", None, None),
        ("https://net/", "net", "/", "net/", "block"),
        ("http://anet/", "anet", "/", None, None),
        ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
        ("http://wexample.com/de/x", "wexample.com", "/de/x", None, None),
        ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("http://a.org#/fr/", "a.org", "", None, None),
        ("no scheme.net/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("a://b://c.net/d", "b:", "//c.net/d", None, None),
        ("x\ny://h.net/\n?q", "h.net", "/\n", "net/", "block"),
    ],
)
def test_rules(spark, url, host, path, rule, action):
    df = spark.createDataFrame([(url,)], "url string").select(U.host_of(F.col("url")).alias("h"), U.path_of(F.col("url")).alias("p"))
    name, verdict = U.rule_for(F.col("h"), F.col("p"))
    assert tuple(df.select("h", "p", name, verdict).first()) == (host, path, rule, action)


class Brute:
    """Both models by their definition: P(c | context) for every context and character."""

    def __init__(self, labelled):
        self.counts = ({}, {})
        for text, accepted in labelled:
            for i, c in enumerate(text):
                for n in range(min(U.ORDER, i + 1)):
                    after = self.counts[not accepted].setdefault(text[i - n : i], Counter())
                    after[c] += 1
        self.alphabet = sorted({c for side in self.counts for c in side.get("", ())})

    def p(self, side, context, c):
        shorter = self.p(side, context[1:], c) if context else 1 / (len(self.alphabet) + 1)
        after = self.counts[side].get(context, Counter())
        return (after[c] + U.SMOOTHING * shorter) / (sum(after.values()) + U.SMOOTHING)

    def ratio(self, url):
        logs = [math.log(self.p(0, url[max(0, i - U.ORDER + 1) : i], c) / self.p(1, url[max(0, i - U.ORDER + 1) : i], c)) for i, c in enumerate(url)]
        return sum(logs) / len(logs) if logs else 0.0


LABELLED = [("http://a.net/en/1", True), ("http://abc.net/en/22", True), ("http://spam.com/de", False), ("http://spam.net/xx", False), ("h", False), *[("http://b.org/q", False)] * 50]


@pytest.mark.parametrize("bound", [U.BROADCAST_GRAMS, 0])
def test_model_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "BROADCAST_GRAMS", bound)
    urls = ["http://a.net/en/9", "http://spam.org/", "http://b.org/z", "~~~", "a~h", "h", "", None, "http://a.net/en/9"]
    brute = Brute(LABELLED)
    model = U.train_grams(spark.createDataFrame(LABELLED, "url string, accepted boolean"))
    rows = spark.createDataFrame(list(enumerate(urls)), "n int, url string")
    got = {r.n: r.llr for r in U.score(rows, model, "n").collect()}
    assert got == pytest.approx({n: brute.ratio(u or "") for n, u in enumerate(urls)})


def test_brute_force_is_normalised():
    brute = Brute(LABELLED)
    for side in (0, 1):
        for context in ("", "h", "rg/q", "never"):
            assert sum(brute.p(side, context, c) for c in [*brute.alphabet, "\0"]) == pytest.approx(1)


def test_messy(spark):
    rows = [(1, "http://a.net/en/1"), (1, "http://a.net/en/1"), (None, None), (2, ""), (3, "x" * 5000), (4, "http://b.example.net/en/"), (5, "http://c.org/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("gram", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = U.judge(df).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert all(0 <= r.p_accept <= 1 for r in got)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://q.info/x")], "page_id long, url string")
    assert U.judge(df).first().verdict == "allow"
    assert U.judge(df.limit(0)).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    """URLs that rules decide, judged by the model alone."""
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    got = U.op6_url_filter(spark, pages).where(F.col("rule").isNotNull()).collect()
    assert sum((r.p_accept >= 0.5) == (r.verdict == "allow") for r in got) >= 0.9 * len(got)
