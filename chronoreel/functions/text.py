"""Text, label, hash and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as keywords.
STOP_WORDS = (
    "的 了 是 在 和 与 这 那 我 你 他 她 们 一个 正在 有 不 也 就 都 而 画面 场景 镜头 显示 可以 看到 the and that this with for"
).split()
#: Runs of CJK ideographs, or of other letters and digits.
RUNS = r"([\x{4E00}-\x{9FFF}]+|[[\p{L}\p{N}]&&[^\x{4E00}-\x{9FFF}]]+)"


#: Ideographs; letters whose lower case has another length or hangs on what stands around; beyond the basic plane.
MIXED = r"[\x{4E00}-\x{9FFF}\x{130}\x{3A3}\x{10000}-\x{10FFFF}]"
#: A word of two or more letters and digits of a text without those, in lower case, that is no stop word.
PLAIN = r"[\p{L}\p{N}]{2,}+(?<!(?<![\p{L}\p{N}])(?:" + "|".join(w for w in STOP_WORDS if w.isascii()) + "))"


def keywords(text: Column) -> Column:
    """Character pairs of CJK runs (a single character stands alone) and other words of two or more letters,
    lower-cased, without stop words; in text order, repeats kept.  A text without ideographs is one pass of a pattern, without
    a function a word."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.rlike(MIXED), mixed_keywords(whole)).otherwise(F.regexp_extract_all(F.lower(whole), F.lit(PLAIN), F.lit(0)))


def mixed_keywords(text: Column) -> Column:
    """Keywords of any text, run by run."""
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))

    def grams(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        word = F.when(F.length(run) >= 2, F.array(F.lower(run))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(r"^[\x{4E00}-\x{9FFF}]"), pairs).otherwise(word)

    stops = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.flatten(F.transform(runs, grams)), lambda w: ~F.array_contains(stops, w))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Shared distinct keywords over the smaller set; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def shared_keywords(a: Column, b: Column, limit: int = 12) -> Column:
    return F.slice(F.array_sort(F.array_intersect(F.array_distinct(a), F.array_distinct(b))), 1, limit)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _clock(ms: Column) -> tuple[Column, Column, Column]:
    s = F.floor(ms / 1000)
    return F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60


def time_label(ms: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    h, m, s = _clock(ms)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s))).otherwise(F.concat_ws(":", m.cast("string"), _two(s)))


def transcript_label(ms: Column) -> Column:
    """M:SS with minutes beyond 59."""
    s = F.floor(ms / 1000)
    return F.concat_ws(":", F.floor(s / 60).cast("string"), _two(s % 60))


def subtitle_label(ms: Column) -> Column:
    """HH:MM:SS, or MM:SS under an hour."""
    h, m, s = _clock(ms)
    return F.when(h > 0, F.concat_ws(":", _two(h), _two(m), _two(s))).otherwise(F.concat_ws(":", _two(m), _two(s)))


def position_label(ms: Column) -> Column:
    """H:MM:SS, or MM:SS under an hour; negative positions count as 0."""
    h, m, s = _clock(F.greatest(ms, F.lit(0)))
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s))).otherwise(F.concat_ws(":", _two(m), _two(s)))


#: [h:mm:ss] or [mm:ss]
TIMESTAMP = r"\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]"


def timestamps_ms(text: Column) -> Column:
    """Milliseconds of every bracketed time, in text order."""
    stamps = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\[(?:\d{1,2}:)?\d{1,2}:\d{2}\])"), F.lit(1))

    def ms(stamp: Column) -> Column:
        part = lambda i: F.coalesce(F.regexp_extract(stamp, TIMESTAMP, i).try_cast("int"), F.lit(0))
        return (part(1).cast("long") * 3600 + part(2) * 60 + part(3)) * 1000

    return F.transform(stamps, ms)


def json_object(text: Column) -> Column:
    """From the first { to the last }, if that parses as JSON; else null."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.when(body != "", body)).isNotNull(), body)


def summary_field(text: Column) -> Column:
    """The raw characters of the first "summary" string, without unescaping; empty if there is none."""
    return F.regexp_extract(text, r'"summary"\s*:\s*"([^"]*)"', 1)


def excerpt(text: Column, n: int, ellipsis: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(ellipsis))).otherwise(text)


def simplified(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fixed(value: Column, digits: int) -> Column:
    """The number with so many decimals, rounded by its exact value and halves to even, as C's printf does; Java's rounds the
    shortest decimal form, halves up."""
    return F.call_function("format_number", value.cast("double"), F.lit(f"{0:.{digits}f}"))


def human_size(size: Column) -> Column:
    """1024-based units up to TB, whole bytes, one decimal beyond."""
    v = size.cast("double")
    out = F.concat(fixed(v / 1024**4, 1), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(v < 1024 ** (power + 1), F.concat(fixed(v / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(v < 1024, F.concat(fixed(v, 0), F.lit(" B"))).otherwise(out)


def level_label(level: Column) -> Column:
    return F.when(level.between(0, 2), F.concat(F.lit("L"), level.cast("string"))).otherwise(F.lit("—"))


def vector_badge(text_vector: Column, frame_vector: Column) -> Column:
    held = lambda v: F.coalesce(F.size(v), F.lit(0)) > 0
    return F.concat(F.when(held(text_vector), "T").otherwise(""), F.when(held(frame_vector), "V").otherwise(""))


def chunk_id(video_id: Column, type_ordinal: Column, start: Column, end: Column, discriminator: Column, version: str = "v1") -> Column:
    """Deterministic id: equal content gets an equal id, so indexing again replaces rows."""
    return F.sha1(F.concat_ws("|", video_id.cast("string"), type_ordinal.cast("string"), start.cast("string"), end.cast("string"), discriminator.cast("string"), F.lit(version)))


def video_id(length: Column, content: Column, path: Column) -> Column:
    """16 digits of the SHA-1 of the size in decimal and the first MiB; of the path if the file can't be read."""
    head = F.concat(F.encode(length.cast("string"), "UTF-8"), F.substring(content, 1, 1 << 20))
    return F.coalesce(F.left(F.sha1(head), F.lit(16)), F.sha1(path))


def thumbnail_name(path: Column) -> Column:
    return F.concat(F.md5(path), F.lit(".jpg"))


def deep_link_ms(link: Column) -> Column:
    return F.regexp_extract(link, r"^ts://(\d+)$", 1).try_cast("long")


def media_kind(path: Column) -> Column:
    """RTSP, RTMP, AUDIO, FILE or UNKNOWN by scheme, else by extension."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    suffix = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    return (
        F.when(low.startswith("rtsp"), "RTSP")
        .when(low.startswith("rtmp"), "RTMP")
        .when(suffix.isin(*AUDIO_EXTENSIONS), "AUDIO")
        .when(suffix.isin(*VIDEO_EXTENSIONS), "FILE")
        .otherwise("UNKNOWN")
    )


# Extensions by media kind.
AUDIO_EXTENSIONS = ("mp3", "wav", "aac", "flac", "m4a", "ogg")
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "flv", "ts", "webm", "wmv", "m4v", "3gp")
