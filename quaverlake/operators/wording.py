"""Putting measured word times onto lines whose text is trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lyrics import words_of


def graft_words(text: Column, heard: Column) -> Column:
    """The words of `text` with the times of `heard` (array of (word, start_ms, end_ms)), place by place.

    Null where nothing was heard, the text has no words, or the numbers of words differ.
    """
    words = words_of(text)
    zipped = F.zip_with(words, heard, lambda w, h: F.struct(w.alias("word"), h["start_ms"].alias("start_ms"), h["end_ms"].alias("end_ms")))
    return F.when((F.size(words) > 0) & (F.size(words) == F.size(heard)), zipped)


def attach_words(lines: DataFrame, heard: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """lines (key, line, text, words, ...) with new words where `heard` (key, line, heard) has a line's words; nothing else changes.

    One equi-join, which Catalyst broadcasts or shuffles by size. Lines without a match keep the words they had; of several
    hearings of a line the least counts.
    """
    found = heard.select(F.col(key).alias("__k"), F.col(line).alias("__l"), "heard").groupBy("__k", "__l").agg(F.min("heard").alias("__h"))
    joined = lines.join(found, (F.col(key) == F.col("__k")) & (F.col(line) == F.col("__l")), "left")
    return joined.withColumn("words", F.coalesce(graft_words(F.col("text"), F.col("__h")), F.col("words"))).select(*lines.columns)


#: Share of a plain text's lines that must be anchored before its words replace what was heard.
COVERAGE = 0.35


def outcome(synced: Column, worded: Column, grafted: Column, coverage: Column, changed: Column) -> Column:
    """What becomes of a track: real line times are never replaced, real words come before corrected ones.

    synced: it has line times that were not heard; worded: word times too; grafted: lines that get words;
    coverage: of its plain text (null: none); changed: lines that a correction changed. Null counts as no.
    """
    no = F.lit(False)
    real = F.coalesce(synced, no)
    return (
        F.when(real & F.coalesce(worded, no), "already synced").when(real & F.coalesce(grafted > 0, no), "words added").when(real, "no anchors")
        .when(F.coalesce(coverage >= COVERAGE, no), "aligned").when(F.coalesce(changed > 0, no), "corrected").otherwise("heard")
    )
