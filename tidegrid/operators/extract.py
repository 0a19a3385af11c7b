"""The six feature spaces of a set of stories on one grid, from intervals, annotated tokens and lookup tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid import config
from tidegrid.functions import text as T
from tidegrid.operators import features, grid, joins, lsa, segments

TOKENS = "story string, i int, idx int, text string, pos string, tag string, dep string, head_i int, lemma string, is_stop boolean, is_punct boolean, like_num boolean"


def annotated(texts: DataFrame, load: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Tokens of each text (story, text). `load` makes the annotator once in each worker; it gives a text's tokens as
    dictionaries of TOKENS without story. Texts meet it in batches; a text is annotated once for all spaces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotate = load()
        for frame in frames:
            for story, text in frame[["story", "text"]].itertuples(index=False):
                rows = annotate(text)
                if rows:
                    yield pd.DataFrame([{"story": story, **r} for r in rows])

    return texts.select("story", "text").mapInPandas(run, TOKENS)


def clause_vectors(words: DataFrame, tokens: DataFrame, vocab: DataFrame, axis: DataFrame) -> DataFrame:
    """story, ord, t0, t1, coordinates: a row for each clause with content lemmas; zeros where all are unknown."""
    clauses = segments.clauses_by_gap(words)
    content = joins.char_to_token(clauses, tokens).where(T.is_content_lemma(F.col("lemma"), F.col("is_stop"), F.col("is_punct"), F.col("like_num")))
    names = list(config.SEMANTIC)
    # terms as the vocabulary was cut: runs of two or more word characters
    terms = content.select("story", "clause", F.explode(F.regexp_extract_all(F.lower("lemma"), F.lit(r"(\w\w+)"))).alias("term"))
    doc = F.struct("story", "clause").alias("doc")
    near = lsa.projected(lsa.weighted(terms.select(doc, "term"), vocab), axis, len(names)).select("doc.story", "doc.clause", *names)
    spoken = content.select("story", "clause").distinct()
    spans = segments.spans(clauses).join(spoken, ["story", "clause"]).join(near, ["story", "clause"], "left").fillna(0.0, names)
    return spans.select("story", F.col("clause").alias("ord"), "t0", "t1", *names)


def spaces(intervals: DataFrame, phones: DataFrame, tokens: DataFrame, frequencies: DataFrame, vocab: DataFrame, axis: DataFrame, rate: float = config.SAMPLE_RATE) -> dict[str, DataFrame]:
    """The spaces by name, each story, k, columns. The grid ends with the word tier, for phones too."""
    sizes = grid.sizes_of(intervals, rate)
    words = segments.offsets(segments.punctuated(intervals))
    met = joins.char_to_token(words, tokens).withColumn("text", F.col("token"))
    deep = features.syntactic(tokens).select("story", "i", *config.SYNTAX)
    rows = {
        "phonological": features.phonological(phones),
        "lexical_stats": features.lexical(words, frequencies),
        "categorical": features.categorical(met),
        "syntactic": joins.char_to_token(words, tokens.select("story", "i", "idx", "text")).join(deep, ["story", "i"]),
        "semantic": clause_vectors(words, tokens, vocab, axis),
        "tense": features.tense(met),
    }
    return {name: grid.project(df.select("story", "ord", "t0", "t1", *config.SPACES[name]), sizes, list(config.SPACES[name]), rate, name not in features.ZERO_KEEPS) for name, df in rows.items()}


def matrix(found: dict[str, DataFrame]) -> DataFrame:
    """All spaces side by side, story, k and the 43 columns in their order; raises if one is missing."""
    out = grid.side_by_side([found[name] for name in config.SPACES])
    missing = [c for c in config.FEATURES if c not in out.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return out.select("story", "k", *config.FEATURES)
