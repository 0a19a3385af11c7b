"""Column functions over transcript text and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.config import NOISE, STOP_LEMMAS, SUBJECT


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_empty(c: Column) -> Column:
    return strip(c) == ""


def is_noise(c: Column) -> Column:
    return strip(c).rlike(NOISE)


def is_pause(c: Column) -> Column:
    return is_empty(c) | is_noise(c)


def clean_word(c: Column) -> Column:
    """Letters and apostrophes, lower-cased; may come out empty."""
    return F.lower(F.regexp_replace(c, r"[^a-zA-Z']", ""))


def relabel_silence(c: Column, label: str = "<EMPTY_SILENCE>") -> Column:
    return F.when(is_empty(c), F.lit(label)).otherwise(c)


def attach_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+([.,])", "$1")


def is_content_lemma(lemma: Column, is_stop: Column, is_punct: Column, like_num: Column, custom: tuple[str, ...] = STOP_LEMMAS) -> Column:
    return ~is_stop & ~is_punct & ~like_num & ~is_empty(lemma) & ~F.lower(strip(lemma)).isin(*custom)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def subject_id(path: Column) -> Column:
    """From anywhere in the path; null if there is none."""
    code = F.upper(F.regexp_extract(path, SUBJECT, 1))
    return F.when(code != "", F.concat(F.lit("sub-"), code))


def numbered(path: Column, name: str, default: str) -> Column:
    """ses-02 -> ses-2, from the file's stem; a default where it is absent."""
    digits = F.regexp_extract(stem_of(path), rf"(?i){name}-(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit(f"{name}-"), digits.cast("bigint").cast("string"))).otherwise(default)


def session_id(path: Column) -> Column:
    return numbered(path, "ses", "ses-unknown")


def run_id(path: Column) -> Column:
    return numbered(path, "run", "run-1")


def audio_story(path: Column) -> Column:
    return F.replace(F.replace(stem_of(path), F.lit("task-"), F.lit("")), F.lit("_audio"), F.lit(""))
