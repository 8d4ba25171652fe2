"""Texts that are like search words, for a table of words: an inverted index of trigrams with prefix filtering.

A text whose word similarity to a word of n trigrams is at least t holds ceil(t * n) of them, and so one of the word's
n - ceil(t * n) + 1 rarest. Only texts that share such a trigram meet a word, and only those that hold enough of all its
trigrams are scored. No pair is compared that shares nothing. The texts
and their index are never broadcast: what is known of their size before they are cut into trigrams is far too little.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.fields import _grams, _word_similarity
from plenum.operators.ordered import few
from plenum.sources.folders import kept


def similar_pairs(texts: DataFrame, key: str, text: str, words: DataFrame, word: str, threshold: float = 0.6) -> DataFrame:
    """(word, key, similarity) of the pairs whose similarity is at least `threshold`, above 0.

    Null and empty texts and words are like nothing; repeated words count once, repeated rows are rows of their own.
    """

    @F.pandas_udf("array<string>")
    def distinct_grams(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(set(_grams(t))) if t else [])

    @F.pandas_udf("double")
    def score(t: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([_word_similarity(a, set(_grams(b))) for a, b in zip(t, w, strict=True)], dtype=float)

    need = F.greatest(F.ceil(F.round(F.lit(threshold) * F.size("_asked"), 9)), F.lit(1)).cast("int")
    asked = kept(words.select(F.col(word).alias("_word")).where("_word IS NOT NULL").distinct().withColumn("_asked", distinct_grams("_word")).where(F.size("_asked") > 0).withColumn("_need", need))
    rows = kept(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL").withColumn("_id", F.monotonically_increasing_id()).withColumn("_held", distinct_grams("_text")))
    wanted = asked.select(F.explode("_asked").alias("_gram")).distinct()
    index = kept(rows.select("_id", F.explode("_held").alias("_gram")).join(few(wanted), "_gram", "left_semi"))
    often = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    rare = asked.select("_word", "_asked", "_need", F.explode("_asked").alias("_gram")).join(often, "_gram", "left")
    first = rare.groupBy("_word", "_need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram"))).alias("_by"))
    prefix = first.select("_word", F.explode(F.transform(F.slice("_by", F.lit(1), F.size("_by") - F.col("_need") + 1), lambda x: x["_gram"])).alias("_gram"))
    met = index.hint("merge").join(few(kept(prefix)), "_gram").select("_id", "_word").distinct()
    both = met.join(rows.hint("merge"), "_id").join(few(asked), "_word").where(F.size(F.array_intersect("_held", "_asked")) >= F.col("_need"))
    scored = both.select("_word", "_key", score("_text", "_word").alias("similarity")).where((F.col("similarity") >= threshold) & (F.col("similarity") > 0))
    return scored.select(F.col("_word").alias(word), F.col("_key").alias(key), "similarity")

