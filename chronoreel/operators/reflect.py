"""Checks of an answer against the video, and what else a question needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoreel.functions.text import timestamps_ms

# Patterns and limits of the checks.
NO_AUDIO = "(没有音频|无音频|静音视频)"
CLAIM_BREAK = "[。.!?？；;]"
TOKEN_BREAK = r"[，,。.；;、\s]"
LONG_ANSWER, LONG_CLAIM, LEAST_TOKEN, LEAST_TOKENS = 200, 15, 2, 3


def inconsistent(answer: Column, duration_ms: Column, has_audio: Column) -> Column:
    return F.coalesce((duration_ms > 0) & answer.rlike(NO_AUDIO) & has_audio, F.lit(False))


def unsupported_length(answer: Column, n_evidence: Column) -> Column:
    return F.coalesce((F.length(answer) > LONG_ANSWER) & (n_evidence == 0), F.lit(False))


def late_timestamp(answer: Column, duration_ms: Column) -> Column:
    """The first bracketed time beyond the video's end; null if there is none or no duration."""
    return F.when(duration_ms > 0, F.get(F.filter(timestamps_ms(answer), lambda t: (t < 0) | (t > duration_ms)), F.lit(0)))


def unsupported_claims(answer: Column, pool: Column) -> Column:
    """Claims of 15 characters or more with three or more tokens of which over two thirds (in whole numbers) are not in
    the pool of known texts; none if the pool is empty."""

    def doubtful(claim: Column) -> Column:
        tokens = F.filter(F.split(claim, TOKEN_BREAK), lambda t: F.length(t) >= LEAST_TOKEN)
        missing = F.size(F.filter(tokens, lambda t: ~F.contains(pool, t)))
        total = F.size(tokens)
        return (F.length(claim) >= LONG_CLAIM) & (total >= LEAST_TOKENS) & (missing > F.floor(total * 2 / 3))

    claims = F.filter(F.split(F.coalesce(answer, F.lit("")), CLAIM_BREAK), lambda c: c != "")
    return F.when(F.coalesce(F.length(pool), F.lit(0)) > 0, F.filter(claims, doubtful)).otherwise(F.array().cast("array<string>"))


def confidence(issues: Column) -> Column:
    return F.greatest(F.lit(0.3), F.lit(0.9) - F.lit(0.15) * issues)


def sufficiency(question_class: Column, level: Column, summary: Column, n_hits: Column) -> Column:
    """What is still to be done before answering; "ready" if nothing.  A null level: the video is not indexed."""
    by_search = F.when(n_hits > 0, "ready").otherwise("search_and_verify")
    return (
        F.when(level.isNull(), "wait_indexing")
        .when(question_class == "GlobalSummary", F.when(F.coalesce(summary, F.lit("")) != "", "ready").otherwise("build_summary"))
        .when(question_class == "CurrentFrame", "seek_and_analyze")
        .when(question_class.isin("TemporalLocalization", "EntityQuery", "ActionRecognition"), by_search)
        .otherwise(F.when(level >= 2, "ready").otherwise("build_summary"))
    )
