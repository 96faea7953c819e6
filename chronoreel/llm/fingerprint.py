"""Canonical exact digests of documents.

A text is case-folded, brought to Unicode normal form C and its runs of white space become
single spaces; two 64-bit xxhashes of the result make a 128-bit fingerprint.  Documents of
one fingerprint form a bucket, and inside buckets the canonical texts themselves are
compared, so unequal texts are told apart even if their hashes met.  Only built-in SQL
functions run on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoreel.llm._io import Scratch

#: Characters that fold to a space: Unicode's White_Space.
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SECOND = 20240607
#: Fingerprints of buckets that may be broadcast (48 MB); beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: Neighbours are looked up in ranges of about so many rows, and in MOST_RANGES ranges at most.
RANGE_ROWS = 20_000
MOST_RANGES = 1 << 16
_QUANTILES = 64


def canonical(text: Column) -> Column:
    """Case folded (by upper then lower case), normal form C, white space folded and trimmed; null is empty."""
    nfc = lambda t: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(False))
    # composed in between as well, where Spark would drop a bare upper case below a lower case
    composed = nfc(F.lower(nfc(F.upper(F.coalesce(text, F.lit(""))))))
    return F.trim(F.regexp_replace(composed, rf"{_SPACE}{{2,}}|(?! ){_SPACE}", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: two xxhash64 values with unlike seeds."""
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit(_SECOND), canon))))


def fingerprints(docs: DataFrame, text: str = "text", canon: str = "canon", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the canonical text and its fingerprint.  Equal texts have equal fingerprints."""
    return docs.withColumn(canon, canonical(F.col(text))).withColumn(name, digest(F.col(canon)))


def mixed_buckets(docs: DataFrame, made: DataFrame, buckets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Fingerprints in ``buckets`` under which unequal canonical texts met: bytes are compared by the least and
    the greatest text of a bucket, taken in every task before the shuffle, so copies never travel.  Only texts whose key
    has a fingerprint that repeats (``made`` has key and fingerprint) are folded for it."""
    small = buckets.select("fingerprint")
    small = F.broadcast(small) if small.count() <= BROADCAST_BUCKETS else small
    keys = made.join(small, "fingerprint", "left_semi").select(key).distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_BUCKETS else keys
    again = docs.where(F.col(key).isNotNull()).join(keys, key, "left_semi").unionByName(docs.where(F.col(key).isNull()))
    members = fingerprints(again.select(text), text).select("fingerprint", "canon").join(small, "fingerprint", "left_semi")
    ends = members.groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return ends.where("least <> most").select("fingerprint")


def _ranges(docs: DataFrame, key: str) -> tuple[Column, int]:
    """A range number that rises with the key and holds about RANGE_ROWS rows, from 64 quantiles of all keys.  Null keys
    have ranges below all others, by the hash ``__h``."""
    spark = docs.sparkSession
    at = [i / _QUANTILES for i in range(1, _QUANTILES)]
    r = docs.agg(F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.percentile_approx(key, at).alias("q")).first()
    unnamed = (F.lit(-513) - F.shiftright("__h", 54)).cast("int")
    if not r.n:
        return unnamed, 0
    ranges = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), r.n // RANGE_ROWS))
    within = -(-ranges // _QUANTILES)
    edges = sorted({r.low, *r.q, r.high})
    if len(edges) == 1:
        return F.when(F.col(key).isNotNull(), F.lit(0)).otherwise(unnamed), ranges
    e = F.array(*(F.lit(x) for x in edges))
    # the largest key counts into the last range; differences are of doubles, as those of longs may not fit
    i = F.least(F.size(F.filter(e, lambda x: x <= F.col(key))), F.lit(len(edges) - 1))
    place, low, high = (x.cast("double") for x in (F.col(key), F.get(e, i - 1), F.get(e, i)))
    inside = F.floor((place - low) / F.greatest(high - low, F.lit(1.0)) * within)
    number = (i - 1) * within + F.least(inside, F.lit(within - 1)).cast("int")
    return F.coalesce(number.cast("int"), unnamed), ranges


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs``' key, text and fingerprint, and next_text and next_fingerprint: those of the next row by falling
    key, after the last those of the first.  Rows of one key follow each other by their texts' hash; null keys come
    last.  ``key`` is an integer.

    Keys are dealt to ranges, each sorted by itself; only a range's last row looks at the first of the following
    range.  There is one such row a range, and the number of ranges is bounded, so their ids may be broadcast.
    """
    scratch = Scratch(docs.sparkSession, "next")
    number, _ = _ranges(docs.select(key), key)
    order = F.struct(F.col(key).isNotNull().alias("named"), F.coalesce(F.col(key), F.lit(0)).alias("k"), (-F.col("__h").cast("decimal(20,0)")).alias("h"))
    rows = docs.withColumn("__h", F.xxhash64(F.col(text))).withColumn("__range", number)
    heads = rows.groupBy("__range").agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("n"))
    up = Window.orderBy(F.col("__range"))
    last = F.max_by("first", "__range").over(Window.partitionBy())
    heads = scratch.save(heads.select("__range", "first", F.coalesce(F.lag("first").over(up), last).alias("next")), "heads")
    wanted = F.broadcast(heads.select(F.col("__range").alias("__to"), F.col("next").alias("__order")))
    # the few opening rows are found before they are folded
    opening = scratch.save(rows.withColumn("__order", order).join(wanted, "__order").select("__to", F.col(text).alias("__t")).dropDuplicates(["__to"]), "openings")
    opening = fingerprints(opening, "__t", "__c", "__f").drop("__c")
    down = Window.partitionBy("__range").orderBy(F.col(key).desc_nulls_last(), F.col("__h"))
    marked = fingerprints(rows, text).select(key, text, "fingerprint", "__range", "__h")
    seen = marked.select(key, text, "fingerprint", "__range", F.lead(F.lit(1)).over(down).isNull().alias("__end"), F.lead("fingerprint").over(down).alias("next_fingerprint"), F.lead(text).over(down).alias("next_text"))
    out = seen.join(opening, seen["__range"] == opening["__to"], "left")
    pick = lambda a, b: F.when(F.col("__end"), F.col(a)).otherwise(F.col(b)).alias(b)
    return out.select(key, text, "fingerprint", pick("__t", "next_text"), pick("__f", "next_fingerprint"))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id, copies).

    A document's edited text has its last floor(n_chars / 2) code points replaced by as many, or all, first ones of
    the next document by falling key.  Likeness is 1 where fingerprints and canonical bytes agree, else 0.
    ``group_id`` is the smallest key of the document's bucket and ``copies`` the bucket's rows.  If unequal texts met
    in a bucket, the fingerprints there carry the canonical text's SHA-256 as well.  Null texts are empty, a single
    document is its own neighbour, an empty table gives no rows.  Only key and text are read.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(texts, key, "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = fingerprints(rows, "edited", "edited_canon", "edited_fingerprint")
    same = lambda a, b, e: F.when(F.col(a) == F.col(b), e).otherwise(F.lit(False)).cast("int").cast("double")
    made = rows.select(
        key,
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        same("fingerprint", "edited_fingerprint", F.col("edited_canon") == canonical(F.col("text"))).alias("near_edited"),
        same("fingerprint", "next_fingerprint", canonical(F.col("next_text")) == canonical(F.col("text"))).alias("near_next"),
    )
    made = scratch.save(made, "edits")
    buckets = made.groupBy("fingerprint").agg(F.min(key).alias("group_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    buckets = scratch.save(buckets, "buckets")
    mixed = scratch.save(mixed_buckets(texts, made.select(key, "fingerprint"), buckets, key), "mixed")
    if not mixed.isEmpty():
        return _told_apart(texts, rows, made, mixed, key)
    out = made.join(buckets, "fingerprint", "left")
    return out.select(*made.columns, F.coalesce("group_id", key).alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _told_apart(texts: DataFrame, edits: DataFrame, made: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
    """The result where hashes of unequal texts met: fingerprints in those buckets, edited texts' too, are extended by
    SHA-256."""
    full = fingerprints(texts).join(mixed, "fingerprint", "left_semi")
    full = full.select(key, "fingerprint", F.concat_ws("-", "fingerprint", F.sha2("canon", 256)).alias("longer")).distinct()
    edited = edits.withColumnRenamed("fingerprint", "of").join(mixed, F.col("edited_fingerprint") == mixed["fingerprint"], "left_semi")
    edited = edited.select(F.col(key).alias("k"), F.sha2("edited", 256).alias("sha"), F.concat_ws("-", "edited_fingerprint", F.sha2("edited_canon", 256)).alias("edited_longer")).distinct()
    out = made.join(full, [key, "fingerprint"], "left").withColumn("fingerprint", F.coalesce("longer", "fingerprint"))
    out = out.join(edited, F.col(key).eqNullSafe(F.col("k")) & (F.col("edited_sha256") == F.col("sha")), "left")
    out = out.withColumn("edited_fingerprint", F.coalesce("edited_longer", "edited_fingerprint"))
    groups = out.groupBy("fingerprint").agg(F.min(key).alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return out.join(groups, "fingerprint").select(*made.columns, "group_id", "copies")


def op8_fingerprint(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract columns for ``documents``."""
    return compare_edits(documents)
