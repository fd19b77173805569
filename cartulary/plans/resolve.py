"""Which stored values a question means.

A value that the question mentions as whole words scores 1, one that an alias in it
stands for a little less; else its share of content words that the question has
counts, and its similarity with runs of the question's words.  The longest of the best wins, so "west virginia" isn't
"virginia".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

THRESHOLD = 0.7
# The score of a value that an alias of the question names, of one all of whose words it has, and the weight of a similarity.
ALIAS_SCORE, WORDS_SCORE, RATIO_WEIGHT = 0.97, 0.93, 0.9
#: Rows of a list of values for a caller outside Spark; the resolver itself looks at all values.
MOST_VALUES = 2000


def values_of(df: DataFrame, column: str) -> DataFrame:
    """value: all distinct values of the column as text."""
    return df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()


def distinct_values(df: DataFrame, column: str, most: int = MOST_VALUES) -> DataFrame:
    """The first values in order, as a list of choices shows them."""
    return values_of(df, column).orderBy("value").limit(most)


def scored(values: DataFrame, question: str) -> DataFrame:
    """value, score for every value (a table of distinct values).

    Whole mentions and shares of words are decided by Spark's functions.  What the
    question's aliases stand for counts a little less than what it says itself.
    Only values that these leave open meet the sequence similarity, in batches.
    """
    q = text.normalized(F.lit(question))
    wide = text.expanded(F.lit(question))
    words = text.content_words("value")
    alias = F.when(text.mentions(wide, "value"), ALIAS_SCORE).when((text.overlap(words, text.content_words(wide)) == 1.0) & (text.overlap(words, text.content_words(q)) < 1.0), ALIAS_SCORE)
    said = F.when(text.mentions(q, "value"), 1.0)
    share = text.overlap(words, text.content_words(q))
    sure = F.coalesce(said, alias, F.when(share == 1.0, WORDS_SCORE))
    told = values.select("value", sure.alias("sure"), share.alias("share"))
    open_ratio = F.when(F.col("sure").isNull(), text.best_window_ratio(F.when(F.col("sure").isNull(), text.normalized("value")), q))
    score = F.coalesce("sure", F.greatest(F.col("share") * WORDS_SCORE, open_ratio * RATIO_WEIGHT))
    return told.select("value", F.round(score, 6).alias("score"))


def resolved(values: DataFrame, question: str, threshold: float = THRESHOLD) -> DataFrame:
    """The one value the question means best, if its score reaches the threshold."""
    return scored(values, question).filter(F.col("score") >= threshold).orderBy(F.desc("score"), F.desc(F.length("value")), "value").limit(1)
