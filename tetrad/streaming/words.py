"""Word counts of a stream of lines.

Word lists are read whole elsewhere; this is the same scan on
``readStream``, for vocabularies that grow while documents arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.sources.text import word_list


def new_words(lines: DataFrame, column: str = "value", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """(word): each word when it first comes.  The state holds the vocabulary;
    with a ``time`` column, only the words of the last while, ``late``, so that it
    is bounded: (time, word) whenever a word comes that has not come for so long."""
    if time is None:
        return word_list(lines, column)
    words = lines.withWatermark(time, late).select(time, F.trim(F.col(column)).alias("word")).where("word <> ''")
    return words.dropDuplicatesWithinWatermark(["word"])


def windowed_words(lines: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour", column: str = "value") -> DataFrame:
    """(start, word, n) by tumbling windows; rows later than ``late`` are dropped
    by the watermark, which also ends the windows' state."""
    words = lines.withWatermark(time, late).select(time, F.explode(F.split(F.lower(column), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy(F.window(time, window), "word").agg(F.count(F.lit(1)).alias("n")).select("window.start", "word", "n")
