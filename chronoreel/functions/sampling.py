"""Frame budgets and sample times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_budget(duration_ms: Column, purpose: Column) -> Column:
    """Frames to look at for a purpose, at most 50."""
    minutes = duration_ms / 60000.0
    wanted = (
        F.when(purpose == "initial_overview", F.greatest(F.lit(8), (minutes * 3).cast("int")))
        .when(purpose == "question_targeted", F.lit(10))
        .when(purpose == "full_analysis", F.greatest(F.lit(20), (minutes * 8).cast("int")))
        .otherwise(F.lit(8))
    )
    return F.least(wanted, F.lit(50))


def sample_count(duration_ms: Column, dense: bool) -> Column:
    """One sample a second (20 to 600), or one in ten seconds (20 to 200) if sparse; 20 without a duration."""
    per, most = (1000, 600) if dense else (10000, 200)
    return F.when(duration_ms <= 0, F.lit(20)).otherwise(F.least(F.greatest(F.floor(duration_ms / per), F.lit(20)), F.lit(most))).cast("int")


def sample_times(duration_ms: Column, count: Column) -> Column:
    """Middles of ``count`` equal parts of the video."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor((i + 0.5) / count * duration_ms).cast("long"))


def range_times(start: Column, end: Column, count: Column) -> Column:
    """2 to 10 times from ``start`` on, a whole step apart; null unless the range has a length."""
    n = F.least(F.greatest(count, F.lit(2)), F.lit(10))
    step = F.floor((end - start) / (n - 1))
    return F.when(end > start, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (start + i * step).cast("long")))


def widened(start: Column, end: Column, before: int, after: int, duration: Column) -> tuple[Column, Column]:
    """A hit's interval with margins, clipped to the video."""
    return F.greatest(F.lit(0), start - before), F.least(duration, end + after)


# Margins around hits, in milliseconds.
TARGET_MARGIN, CAUSE_BEFORE, CAUSE_AFTER, CURRENT_MARGIN = 2000, 10_000, 5_000, 3_000


def sampling_plan(question_class: Column, duration: Column, hit_start: Column, hit_end: Column, position: Column) -> Column:
    """A struct (density, budget, start_ms, end_ms) for one hit of a question (null hit: none was found).

    Whole-video plans for summaries, counting and anything unclassified; margins around hits for questions about a
    moment, an entity or a cause; three seconds either side of the player's position for the current frame.
    """
    found = hit_start.isNotNull()
    near = widened(hit_start, hit_end, TARGET_MARGIN, TARGET_MARGIN, duration)
    cause = widened(hit_start, hit_end, CAUSE_BEFORE, CAUSE_AFTER, duration)

    def plan(density, budget, start, end) -> Column:
        d = density if isinstance(density, Column) else F.lit(density)
        b = budget if isinstance(budget, Column) else F.lit(budget)
        return F.struct(d.alias("density"), b.cast("int").alias("budget"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))

    zero = F.lit(0)
    at = lambda own, whole: F.when(found, own).otherwise(whole)
    near_s, near_e = at(near[0], zero), at(near[1], duration)
    overview = frame_budget(duration, F.lit("initial_overview"))
    return (
        F.when(question_class == "GlobalSummary", plan("sparse", overview, zero, duration))
        .when(question_class == "TemporalLocalization", plan(F.when(found, "dense").otherwise("sparse"), 10, near_s, near_e))
        .when(question_class.isin("EntityQuery", "ActionRecognition"), plan("dense", 12, near_s, near_e))
        .when(question_class == "CausalReasoning", plan("dense", 10, at(cause[0], zero), at(cause[1], duration)))
        .when(question_class == "CurrentFrame", plan("sparse", 3, F.when(position >= 0, F.greatest(zero, position - CURRENT_MARGIN)), F.when(position >= 0, position + CURRENT_MARGIN)))
        .when(question_class.isin("Counting", "Comparison"), plan("dense", frame_budget(duration, F.lit("full_analysis")), zero, duration))
        .otherwise(plan("medium", overview, zero, duration))
    )
