import pytest
from conftest_llm import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


GERMAN = "der ung sch keit zu ein be ü"


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows, no letters."""
    base = prose(1, 60)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    texts = [base, base, near, base.upper().replace(" ", "\n "), None, "", " \t\n", "12 34 !?", "word", "two words", prose(2, 30_000), prose(3, 80, GERMAN), prose(4, 70, GERMAN), "é" * 50, "x" * 100_000, "日本語 のテキスト です"]
    rows = [(i, t, ("de" if i in (11, 12) else "en") if t else None, f"src{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(100, base, None, None, None), (None, base, "en", "src0", 5), (None, None, None, None, None), (200, prose(9, 40), "en", "s", 3), (200, prose(9, 40), "en", "s", 3)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows, COLUMNS)
    # names that operators use inside or return
    for name in ("found", "score", "lang_pred", "toxic", "id", "sig", "bucket", "rank", "canon", "slot", "fingerprint", "size"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
