"""License statements in documents by diagonal voting, in DataFrame operations only.

Every window of three words of a text is hashed and joined with the places of the same window in the templates, a fixed list of license notices whose
table is broadcast. A match at word p of the text and place t of a template is a vote for the diagonal p - t, where a copy of the template would begin.
Votes are counted by diagonal; neighbouring diagonals of one template (a tenth of its length apart at most, so words may be put in, left out or
changed) make one span, and a span counts if its verified windows cover four fifths of the template's words and it isn't longer than one and a half times
the template. A window only votes if its words are the template's, so hashes that clash change nothing.

Three short phrases are templates as well; a place where one stands is a diagonal that all its windows vote for.

Defined cases: a null text is empty; a text of fewer than three words has no spans; rows with equal identifiers or texts are looked at one by one; a
null identifier stays null; a template that occurs several times gives a span for each place; an empty table gives an empty result; columns other than
the identifier and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a window; the shortest template has as many.
WINDOW = 3
#: Share of a template's words that a span has to cover, and how much longer than the template it may be.
COVERED, LONGER = 0.8, 1.5
#: What stands between words: all of ASCII but digits and letters. The only other character whose lower case is an ASCII letter, and what stands for it.
BETWEEN, KELVIN, OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "\u212a", "\ufffd"

#: Phrases that stand for a license wherever their words follow each other.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Public license notices.
NOTICES = [
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

#: (label, text, whether it is a phrase) by number.
TEMPLATES = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]


def words_of(text: Column) -> Column:
    """Words of a text in lower case. Letters beyond A-Z are lowered as well: that changes no boundary, and no word into one of a template."""
    parts = F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))), BETWEEN)
    return F.explode(F.array(parts))  # a row of its own, so that no later expression splits the text again


def trimmed(parts: str) -> Column:
    """parts without the empty words before a leading and after a trailing mark."""
    head, tail = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0), F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return F.slice(parts, 1 + head, F.size(parts) - head - tail)


def grams_of(words: str) -> Column:
    """Hashes of all windows, in order."""
    ends = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashed = F.transform(ends, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<long>"))


def template_places(spark: SparkSession, templates: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(template, label, phrase, length, place, gram, expected): one row a window of each template, some hundreds in all."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), F.lit(text).alias("text")) for i, (label, text, phrase) in enumerate(templates)]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.template", "t.label", "t.phrase", words_of(F.col("t.text")).alias("words")).withColumn("words", trimmed("words"))
    t = t.select("template", "label", "phrase", "words", F.size("words").alias("length"), F.posexplode(grams_of("words")).alias("place", "gram"))
    return t.select("template", "label", "phrase", "length", "place", "gram", F.slice("words", F.col("place") + 1, WINDOW).alias("expected"))


def votes(docs: DataFrame, templates: Sequence[tuple[str, str, bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, template, label, phrase, length, diagonal, place): one row a vote, and for each row of docs one with a null template.

    The null one comes from an entry in front of the row's windows, so that one scan gives votes and rows alike.
    """
    places = template_places(docs.sparkSession, templates).withColumn("first", F.lit(False))
    none = docs.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("gram", "first") else F.lit(0).cast("long").alias("gram") if f.name == "gram" else F.lit(True).alias("first") for f in places.schema])
    known = F.broadcast(places.unionByName(none))
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("parts")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.explode(F.array(trimmed("parts"))).alias("words"))
    rows = rows.select("row", "doc_id", "words", F.explode(F.array(F.concat(F.array(F.lit(0).cast("long")), grams_of("words")))).alias("grams"))
    every = rows.select("row", "doc_id", "words", F.posexplode("grams").alias("at", "found"))  # in generated code with the join, so words aren't copied
    same = (F.col("found") == F.col("gram")) & F.when(F.col("first"), F.col("at") == 0).otherwise((F.col("at") > 0) & (F.slice("words", F.greatest("at", F.lit(1)), WINDOW) == F.col("expected")))
    hits = every.join(known, same)
    return hits.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "label", "phrase", "length", (F.col("at") - 1 - F.col("place")).alias("diagonal"), "place")


def spans(found: DataFrame) -> DataFrame:
    """Of votes(): (row, doc_id, n_words, template, label, phrase, first_word, last_word, n_votes, share, holds); rows of docs keep one with a null template.

    All that is done here is within a row of docs, so votes are dealt by row once.
    """
    keys = ["row", "template"]
    kept = [F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "phrase", "length")]
    lines = found.repartition("row").groupBy(*keys, "diagonal").agg(*kept, F.collect_set("place").alias("places"))
    slack = F.when(F.col("phrase") | (F.col("length") < 6), 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("length") / 10)))
    near = Window.partitionBy(*keys).orderBy("diagonal")
    lines = lines.withColumn("opens", F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= slack, 0).otherwise(1)).withColumn("span", F.sum("opens").over(near))
    begin, end = F.col("diagonal") + F.array_min("places"), F.col("diagonal") + F.array_max("places") + (WINDOW - 1)
    merged = lines.groupBy(*keys, "span").agg(*kept, F.min(begin).alias("begin"), F.max(end).alias("end"), F.sum(F.size("places")).alias("n_votes"), F.flatten(F.collect_list("places")).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (WINDOW - 1))))))
    whole = F.when(F.col("phrase"), covered == F.col("length")).otherwise((covered >= COVERED * F.col("length")) & (F.col("end") - F.col("begin") + 1 <= LONGER * F.col("length")))
    return merged.select(*keys, "doc_id", "n_words", "label", "phrase", F.col("begin").cast("long").alias("first_word"), F.col("end").cast("long").alias("last_word"), "n_votes", (covered / F.col("length")).alias("share"), whole.alias("holds"))


def license_spans(docs: DataFrame, templates: Sequence[tuple[str, str, bool]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, phrase, first_word, last_word, n_votes, share) of the spans that hold; words are counted from 0 and the last one belongs to the span."""
    return spans(votes(docs, templates, id_col, text_col)).filter("holds").select("doc_id", "label", "phrase", "first_word", "last_word", "n_votes", "share")


def license_labels(docs: DataFrame, templates: Sequence[tuple[str, str, bool]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of any template that a span covers)."""
    here = F.col("holds") & F.col("phrase")
    joined = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    out = spans(votes(docs, templates, id_col, text_col)).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.when(here, 1)).alias("n_base"),
        F.min(F.when(here, F.col("first_word"))).alias("first_word"), F.max(F.when(here, F.col("first_word"))).alias("last_word"),
        joined(here).alias("base_labels"), joined(F.col("holds")).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` against all templates."""
    return license_labels(table(spark, sf_dir, "documents"))


def oracle(templates: Sequence[tuple[str, str, bool]] = TEMPLATES) -> str:
    """The same in SQL."""
    values = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}', {str(phrase).lower()})" for i, (label, text, phrase) in enumerate(templates))
    cut = lambda text: rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {cut("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT template, label, phrase, {cut("text")} AS w FROM (VALUES {values}) v(template, label, text, phrase)),
g AS (SELECT row, unnest(range(len(w) - {WINDOW - 1})) AS pos, unnest(list_transform(range(len(w) - {WINDOW - 1}), lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' '))) AS gram FROM d),
p AS (SELECT template, label, phrase, len(w) AS length, unnest(range(len(w) - {WINDOW - 1})) AS place, unnest(list_transform(range(len(w) - {WINDOW - 1}), lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' '))) AS gram FROM t),
l AS (SELECT row, template, label, phrase, length, pos - place AS diagonal, list(place) AS places, min(place) AS low, max(place) AS high FROM g JOIN p USING (gram) GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= CASE WHEN phrase OR length < 6 THEN 0 ELSE greatest(1, length // 10) END THEN 0 ELSE 1 END AS opens FROM l),
i AS (SELECT *, sum(opens) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM o),
m AS (SELECT row, template, label, phrase, length, min(diagonal + low) AS first_word, max(diagonal + high) + {WINDOW - 1} AS last_word, len(list_distinct(flatten(list_transform(flatten(list(places)), lambda q: range(q, q + {WINDOW}))))) AS covered FROM i GROUP BY row, template, label, phrase, length, span),
s AS (SELECT *, covered::DOUBLE / length AS share, CASE WHEN phrase THEN covered = length ELSE covered >= {COVERED}::DOUBLE * length AND last_word - first_word + 1 <= {LONGER}::DOUBLE * length END AS holds FROM m)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (holds AND phrase) AS n_base, CAST(min(first_word) FILTER (holds AND phrase) AS BIGINT) AS first_word,
CAST(max(first_word) FILTER (holds AND phrase) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds AND phrase), '') AS base_labels,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds), '') AS labels, coalesce(max(share), 0::DOUBLE) AS score
FROM d LEFT JOIN s USING (row) GROUP BY row, d.doc_id"""


ORACLE = {"op11_license_scan": oracle()}
