import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from chronoreel.llm import fingerprint as P


def canonical(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", (text or "").upper().lower())).strip()


def expected(rows):
    """(n, sha, near_edited, near_next) by key, for distinct non-null keys."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after)))
    return out


def test_messy(spark, messy, messy_rows):
    named = {r[0]: r[1] for r in messy_rows if r[0] is not None}
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"]).drop("fingerprint", "canon")
    got = {r.doc_id: r for r in P.compare_edits(docs).collect()}
    want = expected(list(named.items()))
    assert {k: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for k, r in got.items()} == want
    groups = {}
    for k, t in named.items():
        groups.setdefault(canonical(t), set()).add(k)
    for members in groups.values():
        assert {got[k].fingerprint for k in members} == {got[min(members)].fingerprint}
        assert {(got[k].group_id, got[k].copies) for k in members} == {(min(members), len(members))}
    assert len({r.fingerprint for r in got.values()}) == len(groups)


def test_repeated_and_null_keys(spark, messy, messy_rows):
    got = P.compare_edits(messy).collect()
    assert len(got) == len(messy_rows)
    assert all(re.fullmatch("[0-9a-f]{32}", r.fingerprint) and r.near_next in (0.0, 1.0) for r in got)
    twice = [r for r in got if r.doc_id == 200]
    assert len(twice) == 2 and 1.0 in {r.near_next for r in twice}


def test_normal_form(spark):
    rows = [(1, "E\u0301a  B"), (2, "\u00e9A\n\u00a0b "), (3, "a\u0323\u0301"), (4, "a\u0301\u0323"), (5, "stra\u00dfe"), (6, "STRASSE"), (7, "e"), (8, "\u00c5"), (9, "\u212b")]
    got = {r.k: r.fingerprint for r in P.fingerprints(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and got[8] == got[9] and len(set(got.values())) == 5


def test_collisions_are_told_apart(spark, monkeypatch):
    """With a digest that collides on purpose, bytes still decide."""
    monkeypatch.setattr(P, "digest", lambda canon: F.substring(canon, 1, 1))
    rows = [(1, "ax"), (2, "ay"), (3, "AX"), (4, "b")]
    got = {r.doc_id: r for r in P.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert [got[i].group_id for i in (1, 2, 3, 4)] == [1, 2, 1, 4]


def test_edited_text_in_a_mixed_bucket(spark, monkeypatch):
    """Where a text and its edit agree, so do their fingerprints, lengthened or not; where they don't, neither do these."""
    monkeypatch.setattr(P, "digest", lambda canon: F.substring(canon, 1, 1))
    rows = [(5, "aa"), (4, "aa"), (3, "ab"), (2, "ac"), (1, "ba"), (0, "bb")]
    got = P.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) for r in got) and {r.near_edited for r in got} == {0.0, 1.0}


def test_extreme_keys(spark):
    low, high = -(2**63), 2**63 - 1
    for keys in ([high], [low, high], [high - 1, high, 0, -1, low, low + 1, 7]):
        rows = [(k, f"text number {i} with words") for i, k in enumerate(keys)]
        got = P.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == expected(rows)
    # a null key comes after the smallest
    rows = [(low, "smallest of all"), (None, "without a key"), (high, "largest of all")]
    got = {r.doc_id: r.edited_sha256 for r in P.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edit = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    assert got == {high: edit("largest of all", "smallest of all"), low: edit("smallest of all", "without a key"), None: edit("without a key", "largest of all")}


def test_empty_and_single(spark, empty):
    assert P.compare_edits(empty).collect() == []
    one = P.compare_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in P.op8_fingerprint(spark, docs).collect()}
    assert got == expected(rows)
