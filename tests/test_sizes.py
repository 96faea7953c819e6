"""What grows with the tables: scores held at once, questions asked again, matches that move, passes over texts."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from chronoreel.functions import text as TX
from chronoreel.functions import tokens as K
from chronoreel.operators import encoders, extras, feedback, search


def test_scores_are_held_in_tiles():
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(2048, 8)), rng.normal(size=(10_000, 8))
    q, m = q / np.linalg.norm(q, axis=1)[:, None], np.round(m / np.linalg.norm(m, axis=1)[:, None], 2)
    tracemalloc.start()
    found = [(r, c, s) for part in search._best_pairs(q, m, np.arange(10_000)[::-1], 3, 0.0) for r, c, s in zip(*part, strict=True)]
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert len(found) == 3 * 2048
    for i in (0, 104, 105, 2047):
        s = np.round(q[i] @ m.T, 6)
        want = sorted(range(10_000), key=lambda j: (-s[j], -j))[:3]
        assert [int(c) for r, c, _ in found if r == i] == want


def test_few_chunks_ties_and_floor():
    q, m = np.eye(2), np.array([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])
    (found,) = search._best_pairs(q, m, np.array([1, 0, 2]), 5, 0.0)
    assert [x.tolist() for x in found] == [[0, 0, 1, 1, 1], [1, 0, 1, 0, 2], [1.0, 1.0, 0.0, 0.0, 0.0]]
    assert list(search._best_pairs(q, m[:0], np.zeros(0, int), 5, 0.0)) == []


TEXTS = ["The lathe, and mother WITH with the", "a I b2 x_y 3.14 ½ Ⅷ", "ÄÖ straße ÉCOLE", "", None, "İstanbul ΟΔΟΣ ΟΔΟΣ'Α", "汽车 the 的 ABC汽车2号线x", "𝐀the \U00020000\U00020001 the", "thethe withthe the2 andand", "é́the x​the"]


def test_plain_texts_have_the_same_keywords(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.coalesce("t", F.lit(""))
    rows = df.select("t", TX.keywords(F.col("t")).alias("a"), TX.mixed_keywords(t).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(bool(r.a) for r in rows) == 7


def test_equal_questions_are_asked_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox"), (2, "fox red red"), (3, "blue"), (4, "fox")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, ("red fox", "blue", None)[i % 3]) for i in range(30)], "query_id long, query string")
    asked = []
    plain = extras.bm25
    monkeypatch.setattr(extras, "bm25", lambda d, q, *a: asked.append(q.count()) or plain(d, q, *a))
    found = {(r.query_id, r.doc_id, r.score) for r in extras.bm25_topk(docs, queries, 2).collect()}
    assert asked == [2]
    every = {}
    for r in plain(docs, queries).collect():
        every.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
    assert found == {(q, d, -s) for q, hits in every.items() for s, d in sorted(hits)[:2]}


def test_matches_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(extras, "TASK_MATCHES", 20)
    words = spark.createDataFrame([(i, ["red", "fox", str(i)]) for i in range(9)], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(q, t) for q in range(5) for t in ("red", "fox")], "query_id long, term string")
    plan = extras.bm25_terms(words, asked)
    assert plan.count() == 45
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in text


def test_reranked_in_one_pass(spark, monkeypatch):
    words = spark.createDataFrame([(1, ["red", "fox"]), (2, ["fox", "sly"]), (3, ["sly"])], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(1, "red", 1.0, True), (1, "fox", 1.0, True), (1, "sly", 0.5, False)], "query_id long, term string, weight double, own boolean")
    calls = []
    plain = extras.bm25_terms
    monkeypatch.setattr(feedback, "bm25_terms", lambda *a: calls.append(1) or plain(*a))
    found = feedback.rerank(words, asked, 3).orderBy("rank").collect()
    assert calls == [1]
    assert [r.doc_id for r in found] == [1, 2, 3] and found[0].score == 1.0
    raw = {r.doc_id: (round(r.score, 9), r.n_terms) for r in plain(words, asked).collect()}
    assert [raw[i][1] for i in (1, 2, 3)] == [2, 1, 0]
    assert [r.score for r in found] == [round(0.8 * raw[r.doc_id][0] / raw[1][0] + 0.2 * raw[r.doc_id][1] / 2, 9) for r in found]


def long_texts(n):
    r = random.Random(3)
    ends = [" ", "\n", "  ", " \u0301", "\u3000", "\t", ", ", "'s ", "\0", "\ufffd ", " <|startoftext|> "]
    words = ["tower", "Inter-national", "东京", "İΣ", "e\u0301", "3.14", "x" * 700, "语" * 600, "\U0001f600", "<|endoftext|>", ""]
    return [None, "", " ", "\n\n", "a", "y" * 3000, " " * 1500, *("".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(400))) for _ in range(n))]


def test_texts_go_to_tasks_in_pieces(spark):
    """Pieces are all of a text, and an encoder of the text's pieces finds what one of the text finds."""
    texts = long_texts(40)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = [r.p for r in df.orderBy("doc_id").select(encoders.text_pieces(F.col("text"), 100).alias("p")).collect()]
    assert [None if p is None else "".join(p) for p in pieces] == texts
    assert all(len(x) <= 101 or not {" ", "\n"} & set(x[1:-1]) for p in pieces for x in p or ())
    assert max(len(p) for p in pieces if p) > 50
    vocabulary = {t: i for i, t in enumerate([K.PAD, K.UNKNOWN, K.CLS, K.SEP, "tow", "##er", "inter", "-", "x", "##xx", "i", "##σ", "e", "##\u0301", "3", ".", "'", "s", "语"])}
    letters = K.byte_letters()
    coders = [K.WordPieces(vocabulary), K.BytePairs({t: i for i, t in enumerate([K.START, K.END, *letters, *(c + K.WORD_END for c in letters), "to"])}, [("t", "o")])]
    for coder in coders:
        for text, cut in zip(texts, pieces, strict=True):
            assert coder.encode(text or "") == [i for p in cut or () for i in coder.encode(p)]


def test_no_task_holds_a_long_text(spark):
    class Lengths:
        """Stands for an encoder: how much it is given at once."""

        def encode(self, text):
            return [len(text)]

    rows = [(i % 7, t, None if i % 3 else i) for i, t in enumerate(["word " * 20_000, None, "", "word " * 700, "short"] * 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `other` int").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for batch in (before, "7"):
            spark.conf.set(size, batch)
            got = encoders._encoded(docs, "text", lambda _: Lengths(), None, 300, -1, -2, -3, None).collect()
            assert [(r.doc_id, r.text, r.other) for r in got] == rows
            given = [[i for i in r.ids if i >= 0] for r in got]
            assert max(map(max, given)) <= encoders.MOST_CHARS + 1
            assert all(r.n_tokens == len(g) == r.n_used - 2 and sum(g) == len(r.text or "") for r, g in zip(got, given, strict=True))
    finally:
        spark.conf.set(size, before)


def test_texts_are_not_sent_twice(spark):
    docs = spark.createDataFrame([(1, "a b", "c1")], "c1 long, text string, piece string")
    coded = encoders.word_piece_input(docs, encoders._table(spark, token=[K.PAD, K.UNKNOWN, K.CLS, K.SEP, "a"], id=range(5)), size=4, keep=["piece", "c1"])
    assert coded.columns == ["piece", "c1", "n_tokens", "ids", "n_used"]
    assert [tuple(r) for r in coded.collect()] == [("c1", 1, 2, [2, 4, 1, 3], 4)]
    assert coded.dtypes[2:] == [("n_tokens", "bigint"), ("ids", "array<int>"), ("n_used", "int")]


def test_an_encoder_stays_small():
    r = random.Random(1)
    coder = K.WordPieces({t: i for i, t in enumerate([K.PAD, K.UNKNOWN, K.CLS, K.SEP])})
    words = ["".join(r.choices("абвгдежзиклмнопр", k=60)) for _ in range(30_000)]
    short = [w[:32] for w in words]
    tracemalloc.start()
    for w in (*words, *short, *(w[::-1] for w in short)):
        assert len(coder.encode(w)) == 2 * len(w)
    assert tracemalloc.get_traced_memory()[0] < 48 << 20
    tracemalloc.stop()
    assert len(coder.known) <= K.REMEMBERED


def test_vocabularies_need_no_python_tasks(spark):
    """Rows by Python tasks come as an RDD; those of Arrow columns don't, whatever their number."""
    table = encoders._table(spark, left=["a", None], right=["b", ""], rank=range(2))
    assert table.dtypes == [("left", "string"), ("right", "string"), ("rank", "int")]
    assert [tuple(r) for r in table.orderBy("rank").collect()] == [("a", "b", 0), (None, "", 1)]
    assert encoders._table(spark, token=[], id=[]).collect() == []
    assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
