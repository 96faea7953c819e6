"""Pictures made of the bytes of pages: histograms, planes, batches of fixed shape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoreel.operators import pictures as P
from chronoreel.sources import fixtures as X

VIDEOS = 7
BOX, FIT = (0.1, 0.2, 0.5, 0.75), (20, 12)


def _frames(spark, sf_dir):
    """Every page as a frame: as many whole rows of its bytes as make it about square."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    n = F.floor(F.octet_length(raw) / 3)
    width = F.greatest(F.lit(1), F.floor(F.sqrt(n)))
    return X.table(spark, sf_dir, "pages").select((F.col("page_id") % VIDEOS).alias("video_id"), F.col("page_id").alias("frame_id"), raw.alias("pixels"), width.cast("int").alias("width"), F.floor(n / width).cast("int").alias("height"), F.lit("RGB").alias("format"))


def picture_histograms(spark, sf_dir):
    """Each page's 48 bins and its distance from the page before in its video; a video's first has none before."""
    h = P.histograms(_frames(spark, sf_dir))
    order = Window.partitionBy("video_id").orderBy("frame_id")
    before = h.withColumn("d", F.when(F.lag("frame_id").over(order).isNotNull(), P.difference(F.lag("histogram").over(order), F.col("histogram"))))
    counts = F.array_join(F.transform("histogram", lambda x: F.round(x * 4096).cast("int")), ",")
    return before.select("video_id", "frame_id", counts.alias("bins"), F.round("d", 6).alias("distance"))


HISTOGRAMS_SQL = f"""WITH p AS (SELECT page_id, regexp_extract_all(hex(encode(coalesce(html, ''))), '..') AS b, strlen(coalesce(html, '')) // 3 AS n FROM pages),
d AS (SELECT *, CAST(greatest(1, floor(sqrt(n))) AS BIGINT) AS w FROM p), e AS (SELECT *, n // w AS h FROM d),
s AS (SELECT page_id, c * 16 + CAST('0x' || b[3 * ((y * h // 64) * w + x * w // 64) + c + 1] AS INT) // 16 AS bin FROM e, range(64) t(x), range(64) u(y), range(3) v(c) WHERE n > 0),
k AS (SELECT page_id, bin, count(*) AS k FROM s GROUP BY ALL),
g AS (SELECT page_id, list(coalesce(k.k, 0) ORDER BY bin) AS h FROM (SELECT page_id, bin FROM e, range(48) r(bin) WHERE n > 0) LEFT JOIN k USING (page_id, bin) GROUP BY 1),
a AS (SELECT page_id % {VIDEOS} AS video_id, page_id AS frame_id, h FROM pages LEFT JOIN g USING (page_id)),
q AS (SELECT *, lag(h) OVER w AS o, lag(frame_id) OVER w AS f FROM a WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))
SELECT video_id, frame_id, array_to_string(h, ',') AS bins, round(CASE WHEN f IS NULL THEN NULL WHEN h IS NULL OR o IS NULL THEN 1
  ELSE least(1, greatest(0, 1 - list_sum(list_transform(range(1, 49), lambda i: sqrt((h[i] / 4096) * (o[i] / 4096)))))) END, 6) AS distance FROM q"""


def picture_regions(spark, sf_dir):
    """Parts of pages read as planes or pixels of four kinds, scaled to fit."""
    kind = F.get(F.array(*map(F.lit, ("YUV420P", "NV12", "BGRA", "RGB"))), (F.col("frame_id") % 4).cast("int"))
    raw = _frames(spark, sf_dir).withColumn("format", kind)
    # a picture of four bytes a pixel has a lower height
    sized = raw.withColumn("height", F.when(F.col("format") == "BGRA", F.floor(F.col("height") * 3 / 4).cast("int")).otherwise(F.col("height")))
    parts = P.regions(sized, BOX, FIT)
    return parts.select("video_id", "frame_id", "region.width", "region.height", F.md5("region.pixels").alias("pixels_md5"))


def frame_windows(spark, sf_dir):
    """Windows of a hundred frames, how many they hold and how many zeros fill them up."""
    found = P.batch_probabilities(_frames(spark, sf_dir))
    return found.groupBy("video_id", "window").agg(F.count(F.lit(1)).alias("n_frames"), F.max("n_padded").alias("n_padded"), F.min("frame_id").alias("first_frame"), F.max("place").alias("last_place"))


WINDOWS_SQL = f"""WITH p AS (SELECT page_id % {VIDEOS} AS video_id, page_id, row_number() OVER (PARTITION BY page_id % {VIDEOS} ORDER BY page_id) - 1 AS n FROM pages)
SELECT video_id, n // 100 AS "window", count(*) AS n_frames, CAST(100 - count(*) AS INT) AS n_padded, min(page_id) AS first_frame, CAST(max(n % 100) AS INT) AS last_place FROM p GROUP BY ALL"""


def frame_probabilities(spark, sf_dir):
    """Each frame's number from the model, through its window's tensor."""
    return P.batch_probabilities(_frames(spark, sf_dir)).withColumn("probability", F.round("probability", 6))


QUERIES = {
    "picture_histograms": (picture_histograms, HISTOGRAMS_SQL),
    "picture_regions": (picture_regions, None),
    "frame_windows": (frame_windows, WINDOWS_SQL),
    "frame_probabilities": (frame_probabilities, None),
}
