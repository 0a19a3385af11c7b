"""Interval annotation files: standard long form and chronological form, read through Spark's own readers.

Files are read whole, one row each, by any file system Spark knows, and parsed in Arrow batches; a file that
does not parse becomes a row with an error, so one bad file never ends a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.text import stem_of

PARSED = "story string, path string, tier string, ord long, t0 double, t1 double, text string, error string"
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def parse_long(raw: str) -> list[tuple[str, float, float, str]]:
    """(tier, start, end, text) of every interval, empty ones included."""
    parts = re.split(r"item\s*\[\d+\]\s*:", raw)[1:]
    if not parts or ("IntervalTier" not in raw and "TextTier" not in raw):
        raise ValueError("no tier")
    out = []
    for part in parts:
        name = re.search(r'name\s*=\s*"((?:[^"]|"")*)"', part)
        tier = name[1].replace('""', '"') if name else ""
        for m in re.finditer(rf'xmin\s*=\s*({_NUMBER})\s*xmax\s*=\s*({_NUMBER})\s*text\s*=\s*"((?:[^"]|"")*)"', part):
            out.append((tier, float(m[1]), float(m[2]), m[3].replace('""', '"')))
    return out


def parse_chronological(raw: str) -> list[tuple[str, float, float, str]]:
    """The form that lists intervals of all tiers by time: a line of tier number, start and end, and the text on the
    next. Any other line where times are due is passed over by itself, intervals of unknown tiers are dropped; a
    tier's intervals come out by start."""
    lines = [x.strip() for x in raw.splitlines() if x.strip() and not x.strip().startswith("!")]
    if not lines or "chronological" not in lines[0].lower():
        raise ValueError("not a chronological file")
    n = next((int(m[1]) for x in lines[2:4] if (m := re.match(r"(\d+)", x))), 0)
    names = {}
    for i, x in enumerate(lines[3 : 3 + n], 1):
        if m := re.match(rf'"[^"]+"\s+"((?:[^"]|"")*)"\s+{_NUMBER}\s+{_NUMBER}', x):
            names[i] = m[1].replace('""', '"')
    out, rest = [], iter(lines[3 + n :])
    for line in rest:
        times = re.fullmatch(rf"(\d+)\s+({_NUMBER})\s+({_NUMBER})", line)
        if times is None:
            continue
        text = next(rest, None)
        if text is None:
            break
        quoted = text.startswith('"') and text.endswith('"')
        if int(times[1]) in names:
            out.append((int(times[1]), float(times[2]), float(times[3]), text[1:-1].replace('""', '"') if quoted else text.replace('"', "")))
    return [(names[i], a, b, text) for i, a, b, text in sorted(out, key=lambda r: r[:2])]


def parse(raw: str) -> list[tuple[str, float, float, str]]:
    head = raw.lstrip("﻿").lstrip().splitlines()[:1]
    return parse_chronological(raw) if head and "chronological" in head[0].lower() else parse_long(raw)


def format_long(rows: list[tuple[str, float, float, str]]) -> str:
    """The standard long form of parsed intervals."""
    tiers = list(dict.fromkeys(r[0] for r in rows))
    lo, hi = min((r[1] for r in rows), default=0.0), max((r[2] for r in rows), default=0.0)
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", f"xmin = {lo}", f"xmax = {hi}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for i, tier in enumerate(tiers, 1):
        own = [r for r in rows if r[0] == tier]
        out += [f"    item [{i}]:", '        class = "IntervalTier"', f"        name = {quote(tier)}", f"        xmin = {lo}", f"        xmax = {hi}", f"        intervals: size = {len(own)}"]
        for j, (_, a, b, text) in enumerate(own, 1):
            out += [f"        intervals [{j}]:", f"            xmin = {a}", f"            xmax = {b}", f"            text = {quote(text)}"]
    return "\n".join(out) + "\n"


def files(spark: SparkSession, folders: list[str], pattern: str = "*.{TextGrid,bak}") -> DataFrame:
    """story, path, rank of the folder that has it (0 first), content."""
    out = None
    for rank, folder in enumerate(folders):
        got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        got = got.select(stem_of(F.regexp_replace("path", r"\.bak$", "")).alias("story"), "path", F.lit(rank).alias("rank"), "content")
        out = got if out is None else out.unionByName(got)
    return out


def discover(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Distinct stories of all folders, in order; contents are not read."""
    return files(spark, folders).select("story").distinct().orderBy("story")


def scan(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Intervals of every story, from the first folder that has it: story, path, tier, ord, t0, t1, text, error."""
    every = files(spark, folders)
    best = every.groupBy("story").agg(F.min(F.struct("rank", "path")).alias("b")).select("story", F.col("b.path").alias("path"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for story, path, content in frame[["story", "path", "content"]].itertuples(index=False):
                yield from _rows(story, path, content)

    return every.join(best, ["story", "path"]).select("story", "path", "content").mapInPandas(run, PARSED)


def tier(intervals: DataFrame, word: str) -> DataFrame:
    """Intervals of each story's first tier whose name contains the word, in either case."""
    fits = intervals.where(F.lower("tier").contains(word.lower()))
    first = fits.groupBy("story").agg(F.min_by("tier", "ord").alias("tier"))
    return fits.join(first, ["story", "tier"])


STAGES = ("read", "tiers", "text", "annotate", "extract")


def diagnosed(intervals: DataFrame, texts: DataFrame | None = None, tokens: DataFrame | None = None, extracted: DataFrame | None = None) -> DataFrame:
    """story, status, stage, error: what stops a story, at the first stage that fails. The later stages are looked at
    where their tables are given: texts (story, text) fail where the text is empty, tokens and extracted (story, ...)
    where a story has no row."""
    out = intervals.groupBy("story").agg(F.max("error").alias("error"), F.bool_or(F.lower("tier").contains("word")).alias("w"), F.bool_or(F.lower("tier").contains("phone")).alias("p"))
    stage = F.when(F.col("error").isNotNull(), "read").when(~F.coalesce("w", F.lit(False)) | ~F.coalesce("p", F.lit(False)), "tiers")
    later = {"text": None if texts is None else texts.where("trim(text) <> ''"), "annotate": tokens, "extract": extracted}
    for name, table in later.items():
        if table is not None:
            out = out.join(table.select("story", F.lit(True).alias(f"_{name}")).distinct(), "story", "left")
            stage = stage.when(F.col(f"_{name}").isNull(), name)
    return out.select("story", F.when(stage.isNull(), "ok").otherwise("failed").alias("status"), stage.alias("stage"), "error")


def diagnosis(found: DataFrame) -> DataFrame:
    """total, ok, and the failed stories in order."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("story"))))
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), failed.alias("failed"))


def repaired(intervals: DataFrame) -> DataFrame:
    """story, content: each readable story in the standard long form."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        return pd.DataFrame({"story": [frame["story"].iloc[0]], "content": [format_long(list(frame[["tier", "t0", "t1", "text"]].itertuples(index=False, name=None)))]})

    return intervals.where("error IS NULL").groupBy("story").applyInPandas(run, "story string, content string")


def _decoded(content: bytes) -> str:
    return bytes(content).decode("utf-16" if bytes(content)[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")


def repair(originals: DataFrame, done: DataFrame) -> DataFrame:
    """story, status, content, error. originals: as files() gives them, the backup of a story beside it; done: story,
    those repaired before. A story is `repaired` (with content if it was done now, from the backup where there is one),
    `valid` where the original reads in the long form, or `failed`. Originals are only read."""
    backup = F.col("path").rlike(r"\.bak$")
    pick = lambda own: F.max(F.when(own, F.col("content")))
    both = originals.groupBy("story").agg(pick(~backup).alias("original"), pick(backup).alias("backup")).join(done.select("story", F.lit(True).alias("done")).distinct(), "story", "full")

    def one(original, backup, was_done) -> tuple[str, str | None, str | None]:
        if was_done:
            return "repaired", None, None
        if original is not None:
            try:
                parse_long(_decoded(original))
                return "valid", None, None
            except ValueError:
                pass
        try:
            return "repaired", format_long(parse_chronological(_decoded(original if backup is None else backup))), None
        except (ValueError, IndexError) as e:
            return "failed", None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(s, *one(a, b, d is True)) for s, a, b, d in frame[["story", "original", "backup", "done"]].itertuples(index=False)]
            if made:
                yield pd.DataFrame(made, columns=["story", "status", "content", "error"], dtype=object)

    return both.select("story", "original", "backup", "done").mapInPandas(run, "story string, status string, content string, error string")


def repair_summary(found: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """valid, repaired, skipped, failed, total; skipped are wanted stories (story) of which there is no file."""
    out = found if wanted is None else found.select("story", "status").join(wanted.select("story").distinct(), "story", "full").withColumn("status", F.coalesce("status", F.lit("skipped")))
    return out.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("valid", "repaired", "skipped", "failed")], F.count("*").alias("total"))


def save_repaired(found: DataFrame, folder: str) -> None:
    """Writes what was repaired now, a folder for each story, beside what is there; originals are never touched."""
    found.where("content IS NOT NULL").select("story", "content").write.mode("append").partitionBy("story").text(folder)


def load_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """story, content of repaired files."""
    return spark.read.text(folder, wholetext=True).select(F.col("story").cast("string").alias("story"), F.col("value").alias("content"))


def parsed(contents: DataFrame) -> DataFrame:
    """story, path (null), tier, ord, t0, t1, text, error of files held as text (story, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for story, content in frame[["story", "content"]].itertuples(index=False):
                yield from _rows(story, None, content)

    return contents.select("story", "content").mapInPandas(run, PARSED)


def _rows(story: str, path: str | None, content: str | bytes) -> Iterator[pd.DataFrame]:
    """A file's intervals; one row with an error if it does not parse, none if it holds no interval."""
    try:
        rows = parse(content if isinstance(content, str) else _decoded(content))
        if rows:
            yield pd.DataFrame({"story": story, "path": path, "tier": [r[0] for r in rows], "ord": range(len(rows)), "t0": [r[1] for r in rows], "t1": [r[2] for r in rows], "text": [r[3] for r in rows], "error": None})
    except (ValueError, IndexError) as e:
        yield pd.DataFrame({"story": [story], "path": [path], "tier": [None], "ord": [None], "t0": [None], "t1": [None], "text": [None], "error": [str(e)]})


def head(spark: SparkSession, path: str, n: int = 25) -> DataFrame:
    return spark.read.text(path).limit(n)


def raw_head(originals: DataFrame, story: str, n: int = 25) -> DataFrame:
    """line (from 1) and value: the first lines of a story's backup, or of the original where there is none."""
    own = originals.where(F.col("story") == story).select("content", F.col("path").rlike(r"\.bak$").alias("backup"))
    best = own.agg(F.max_by("content", "backup").alias("content")).where("content IS NOT NULL")
    lines = F.slice(F.split(F.col("content").cast("string"), "\r?\n"), 1, n)
    return best.select(F.posexplode(lines).alias("line", "value")).withColumn("line", F.col("line") + 1)
