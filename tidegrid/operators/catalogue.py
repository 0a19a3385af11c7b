"""The audit of a corpus: sessions from file names, subjects, stories, the test story's coverage and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.config import TENSES
from tidegrid.functions import text as T
from tidegrid.operators import audit, joins


def sessions(recordings: DataFrame, stories: DataFrame, durations: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """subject_id, session_id, run_id, story, fmri_path, has_textgrid, duration_sec for each recording (path) whose
    name holds a subject and a story. stories: story; durations: path, seconds, the last of a story's files by path
    counts; a story without a sound file lasts 0.0 s."""
    known = stories.where(~F.col("story").isin(*excluded)) if excluded else stories
    p = F.col("path")
    found = recordings.select(T.subject_id(p).alias("subject_id"), T.session_id(p).alias("session_id"), T.run_id(p).alias("run_id"), p.alias("fmri_path"), T.stem_of(p).alias("_file")).where("subject_id IS NOT NULL")
    names = joins.name_in_name(found.select("_file").distinct(), known.select("story"), "_file", "story")
    last = durations.select(T.audio_story(p).alias("story"), "path", "seconds").groupBy("story").agg(F.max_by("seconds", "path").alias("duration_sec"))
    out = found.join(names, "_file").join(last, "story", "left")
    return out.select("subject_id", "session_id", "run_id", "story", "fmri_path", F.lit(True).alias("has_textgrid"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"))


def subjects(found: DataFrame) -> DataFrame:
    return audit.by_subject(found, "subject_id", "story", "duration_sec").withColumnsRenamed({"total_sessions": "total_sessions_listened", "unique_items": "unique_stories_listened", "total_sec": "total_listening_time_sec", "total_min": "total_listening_time_min"})


def stories(found: DataFrame, validity: DataFrame) -> DataFrame:
    """validity: story, valid; stories without an entry are not valid."""
    out = audit.by_item(found, "story", "subject_id", "duration_sec").join(validity.select("story", "valid"), "story", "left")
    return out.withColumn("has_valid_textgrid", F.coalesce("valid", F.lit(False))).drop("valid")


def coverage(found: DataFrame, story: str) -> DataFrame:
    """Every subject's presentations of one story: how many, distinct sessions in order, runs in order of the files."""
    own = found.where(F.col("story") == story).groupBy("subject_id").agg(F.count("run_id").cast("int").alias("presentations_count"), audit.joined_names("session_id").alias("sessions_list"), audit.joined_names("run_id", False, "fmri_path").alias("runs_list"))
    return joins.covered(found.select("subject_id").distinct(), own, "subject_id", "presentations_count").orderBy("subject_id")


def tense_profile(tokens: DataFrame) -> DataFrame:
    """One row over tokens with the tense columns: finite forms, past and other, counts and shares (two places)."""
    count = {c: F.sum(F.col(c).cast("long")) for c in TENSES}
    out = tokens.agg(*[F.coalesce(v, F.lit(0)).alias(c) for c, v in count.items()])
    out = out.withColumn("past_forms_count", F.col(TENSES[0]) + F.col(TENSES[1])).withColumn("non_past_forms_count", F.col(TENSES[2]) + F.col(TENSES[3]))
    out = out.withColumn("total_finite_forms", F.col("past_forms_count") + F.col("non_past_forms_count"))
    share = lambda c: F.when(F.col("total_finite_forms") > 0, F.round(F.col(c) * 100.0 / F.col("total_finite_forms"), 2))
    return out.select("total_finite_forms", "past_forms_count", share("past_forms_count").alias("past_forms_pct"), "non_past_forms_count", share("non_past_forms_count").alias("non_past_forms_pct"))
