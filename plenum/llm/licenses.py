"""License scans by diagonal voting.

Every rolling k-gram of a text's words is hashed and joined to the positions that the same gram has in the license
templates. A hit votes for its diagonal, the text position less the template position. Votes are added up by
diagonal; the neighbouring diagonals of a template, which insertions and deletions of words make, are merged; a
merged span counts if it covers enough of its template. Short phrases have to match whole, on one diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.lineage import numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHORT, LONG = 2, 4
DRIFT = 2
COVER = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# Phrases that count by themselves, and openings of public license texts.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)


def words(text: Column) -> Column:
    """The words of a text with A-Z, and no other letters, lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def _pairs(hashes: Column, apart: int) -> Column:
    """Hashes of each element with the one `apart` places on."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def with_grams(df: DataFrame) -> DataFrame:
    """Adds `_short` and `_long`: the rolling hashes of SHORT and LONG words of `_words`."""
    one = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    two = one.withColumn("_short", _pairs(F.col("_hash"), 1))
    return two.withColumn("_long", _pairs(F.col("_short"), 2)).drop("_hash")


def positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(gram, k, tid, tpos, own): a row for each gram of each template, and one with tid -1 for the head row of a text."""
    rows = [(k, t.label, t.phrase, t.text) for k, t in enumerate(templates)]
    split = with_grams(spark.createDataFrame(rows, "tid int, label string, phrase boolean, text string").withColumn("_words", words(F.col("text"))))
    k = F.when(F.col("phrase"), SHORT).otherwise(LONG)
    grams = split.select("tid", "label", "phrase", "_words", k.alias("k"), F.posexplode(F.when(F.col("phrase"), F.col("_short")).otherwise(F.col("_long"))).alias("tpos", "gram"))
    real = grams.select("gram", "k", "tid", "label", "phrase", "tpos", F.expr("slice(_words, tpos + 1, k)").alias("own"), (F.size("_words") - F.col("k") + 1).alias("of"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("gram"), F.lit(0).alias("k"), F.lit(-1).alias("tid"), F.lit("").alias("label"), F.lit(False).alias("phrase"), F.lit(0).alias("tpos"), F.array().cast("array<string>").alias("own"), F.lit(1).alias("of"))
    return real.unionByName(head)


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of `df`: the columns `keep`, `n_words`, and `spans`: array<struct<label, phrase, start, votes, cover>>
    of the verified spans; `start` is a word's place, from 0.

    A null or empty text has no words and no spans. Repeated rows stay rows of their own. Kept columns may have any
    names but `n_words` and `spans` (two leading underscores are reserved). Rows are keyed by their place in the
    input. One shuffle, of hits only.
    """
    names = [f"__keep{k}" for k in range(len(keep))]
    rows = numbered(df, "__row").select(*[F.col(f"`{c}`").alias(name) for c, name in zip(keep, names, strict=True)], "__row", words(F.col(f"`{text}`")).alias("_words")).transform(with_grams)
    head = F.array(F.lit(0).cast("long"))
    each = rows.select(*names, "__row", "_words", F.size("_words").alias("_n"), F.posexplode(F.concat(head, F.col("_short"), F.col("_long"))).alias("_at", "gram"))
    long = F.col("_at") >= F.greatest(F.col("_n"), F.lit(1))  # after the head come n - 1 short grams
    pos = F.when(F.col("_at") == 0, 0).when(long, F.col("_at") - F.greatest(F.col("_n"), F.lit(1))).otherwise(F.col("_at") - 1)
    size = F.when(F.col("_at") == 0, 0).when(long, LONG).otherwise(SHORT)
    hits = each.join(F.broadcast(positions(df.sparkSession, templates)), "gram").withColumn("_pos", pos)
    hits = hits.where((F.col("k") == size) & ((F.col("k") == 0) | (F.expr("slice(_words, _pos + 1, k)") == F.col("own"))))
    key = [*names, "__row", "_n", "tid", "label", "phrase", "of"]
    votes = hits.select(*key, (F.col("_pos") - F.col("tpos")).alias("diag"), "_pos").repartition("__row").groupBy(*key, "diag").agg(F.count("*").alias("votes"), F.min("_pos").alias("start"))
    by = Window.partitionBy("__row", "tid").orderBy("diag")
    apart = F.coalesce((F.col("diag") - F.lag("diag").over(by) > DRIFT) | F.col("phrase"), F.lit(True))
    runs = votes.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(by))
    spans = runs.groupBy(*key, "_run").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("of"))
    good = (F.col("tid") >= 0) & F.when(F.col("phrase"), F.col("votes") == F.col("of")).otherwise(cover >= COVER)
    span = F.when(good, F.struct("label", "phrase", F.col("start").cast("long").alias("start"), "votes", cover.alias("cover")))
    found = spans.groupBy(*names, "__row", "_n").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return found.select(*[F.col(name).alias(c) for c, name in zip(keep, names, strict=True)], F.col("_n").cast("long").alias("n_words"), "spans")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"))


def _values() -> str:
    return ", ".join(f"({k}, '{t.label}', {SHORT if t.phrase else LONG}, {t.phrase}, '{t.text}')" for k, t in enumerate(TEMPLATES))


def _grams(k: int) -> str:
    return f"SELECT i, {k} AS k, p, array_to_string(w[p + 1:p + {k}], ' ') AS gram FROM (SELECT i, w, unnest(range(len(w) - {k} + 1)) AS p FROM d WHERE len(w) >= {k})"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
t AS (SELECT *, string_split(text, ' ') AS w FROM (VALUES {_values()}) v(tid, label, k, phrase, text)),
tg AS (SELECT tid, label, k, phrase, len(w) - k + 1 AS grams, tp, array_to_string(w[tp + 1:tp + k], ' ') AS gram
       FROM (SELECT *, unnest(range(len(w) - k + 1)) AS tp FROM t)),
dg AS ({_grams(SHORT)} UNION ALL {_grams(LONG)}),
votes AS (SELECT i, tid, label, phrase, grams, p - tp AS diag, count(*) AS votes, min(p) AS start
          FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN NOT phrase AND diag - lag(diag) OVER (PARTITION BY i, tid ORDER BY diag) <= {DRIFT} THEN 0 ELSE 1 END AS fresh FROM votes),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY i, tid ORDER BY diag) AS run FROM marked),
spans AS (SELECT i, tid, label, phrase, min(start) AS start, least(1.0::DOUBLE, sum(votes)::DOUBLE / grams) AS cover, sum(votes) AS votes, grams
          FROM runs GROUP BY i, tid, label, phrase, run, grams),
good AS (SELECT * FROM spans WHERE CASE WHEN phrase THEN votes = grams ELSE cover >= {COVER} END),
per AS (SELECT i, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM good GROUP BY i)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (i)
"""
