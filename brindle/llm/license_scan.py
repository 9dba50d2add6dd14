"""License scan with a positional rare-token index, in DataFrame functions only.

Licence words that are common everywhere say nothing, so inverse document frequencies are taken over all documents. All
licence words of each file are looked up in the templates' postings; matches that agree on the
relative position (place in the file minus place in the template) add up to a template's share of matched IDF. A
template counts if enough agrees and its mandatory key phrase stands in the file, word for word.

One scan computes per document what needs the text (word count, places of the base phrases, places of licence words,
key phrases found) and stores it; only documents with licence words go on. Templates are fixed and small, so the
postings are a broadcast of known size.

Defined cases: null text is empty; rows without an id are left out; rows that repeat an id are judged one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, id_text
from .line_dedup import LOWER, UPPER

#: fixed: base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: fixed: label, mandatory key phrase, notice text as words
TEMPLATES = [
    ("agpl", "affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "apache license", "licensed under the apache license version"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("artistic", "artistic license", "this library is free software you may distribute it under the artistic license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("cc0", "cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("eclipse", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved", "copyright c all rights reserved"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty"),
]
#: fixed: words of the notices that any text has; never looked up
COMMON = set("a and any are as be by can copy for form forms in into is it library may met no of on or or program provided source terms that the this to under use v version with without work you made c 0 1 2 3 4 at but do even other see so unless will".split())
SHARE = 0.5
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, " ", ""))


def _own(phrase: str) -> str:
    """A phrase in a text in which each word has a space on both sides of its own."""
    return " " + phrase.replace(" ", "  ") + " "


def _base_columns(spaced: Column) -> list[Column]:
    """n_base, first_word, last_word, base_labels of a text in that form. No base phrase can overlap itself."""
    backwards = F.reverse(spaced)
    count, first, last, label = [], [], [], []
    for phrase, name in BASE.items():
        own, k = _own(phrase), len(phrase.split())
        n = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(own), F.lit("")))) / len(own)).cast("long")
        count.append(n)
        at = F.instr(spaced, own)
        first.append(F.when(at > 0, (_spaces(F.left(spaced, at - 1)) / 2).cast("long")))
        end = F.instr(backwards, own[::-1])
        last.append(F.when(end > 0, (_spaces(spaced) / 2 - _spaces(F.left(backwards, end - 1)) / 2).cast("long") - k))
        label.append(F.when(n > 0, F.lit(name)))
    return [reduce(lambda a, b: a + b, count).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*label)).alias("base")]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    ws = Workspace(spark, "license")
    vocabulary = sorted({w for _, _, text in TEMPLATES for w in text.split()} - COMMON)
    phrases = sorted({p for _, p, _ in TEMPLATES})
    lower = F.translate("text", UPPER, LOWER)
    joined = F.btrim(F.regexp_replace(lower, WORD_BREAKS, " "))
    scan = id_text(docs, id_col, text_col).select("doc_id", joined.alias("joined"))
    scan = scan.withColumn("words", F.split("joined", " ", -1)).withColumn("found", F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
    spaced = F.concat(F.lit(" "), F.replace("joined", F.lit(" "), F.lit("  ")), F.lit(" "))
    # A base phrase needs one of these words; a text without any skips the rest.
    any_base = reduce(lambda a, b: a | b, (F.contains("joined", F.lit(p)) for p in BASE))
    spaced = F.when((F.size("found") > 0) | any_base, spaced).otherwise(F.lit(""))
    places = F.when(F.size("found") > 0, F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("found", x["word"])))
    n_words = F.when(F.col("joined") == "", 0).otherwise(F.size("words")).cast("long")
    scan = scan.select("doc_id", n_words.alias("n_words"), spaced.alias("spaced"), places.alias("places"))
    keys = F.array_compact(F.array(*(F.when(F.contains("spaced", F.lit(_own(p))), F.lit(p)) for p in phrases)))
    facts = scan.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", *_base_columns(F.col("spaced")), "places", keys.alias("phrases"))
    facts = ws.put(facts, "facts")
    # Inverse document frequency over all documents: one row a licence word.
    total = facts.count()
    placed = facts.where("places is not null").select("row", F.explode("places").alias("x")).select("row", "x.word", "x.at")
    df = placed.groupBy("word").agg(F.count_distinct("row").alias("df"))
    idf = df.select("word", F.log((F.lit(total) + 1) / F.col("df")).alias("idf"))
    # All licence words of each file, all their places: one notice can't crowd out another.
    looked = placed.join(F.broadcast(idf), "word")
    postings = spark.createDataFrame([(t, w, i) for t, (_, _, text) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in COMMON], "template int, word string, place int")
    names = spark.createDataFrame([(t, label, phrase) for t, (label, phrase, _) in enumerate(TEMPLATES)], "template int, label string, phrase string")
    weight = postings.select("template", "word").distinct().join(F.broadcast(idf), "word").groupBy("template").agg(F.sum("idf").alias("whole"))
    hits = looked.join(F.broadcast(postings), "word").groupBy("row", "template", (F.col("at") - F.col("place")).alias("offset")).agg(F.collect_set(F.struct("word", "idf")).alias("w"))
    matched = hits.select("row", "template", F.aggregate("w", F.lit(0.0), lambda a, x: a + x["idf"]).alias("got"))
    best = matched.groupBy("row", "template").agg(F.max("got").alias("got")).join(F.broadcast(weight), "template").join(F.broadcast(names), "template")
    best = best.select("row", "label", "phrase", (F.col("got") / F.col("whole")).alias("share")).where(F.col("share") >= SHARE)
    own = facts.where("places is not null").select("row", F.explode("phrases").alias("phrase"))
    kept = best.join(own, ["row", "phrase"]).groupBy("row").agg(F.collect_set("label").alias("method"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    out = facts.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(kept, "row", "left")
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(0.75)).otherwise(F.lit(0.0)), F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("method", none))).alias("labels"), F.round(score, 6).alias("score"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """For DuckDB: of each template, the best placed copy in a file, by the IDF of its words that stand where they should."""
    postings = ", ".join(f"({t}, '{label}', '{phrase}', '{w}', {i})" for t, (label, phrase, text) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in COMMON)
    places = {p: f"list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}')" for p in BASE}
    every = " || ".join(places.values())
    base = ", ".join(f"CASE WHEN len({x}) > 0 THEN '{BASE[p]}' END" for p, x in places.items())
    return rf"""
WITH post(template, label, phrase, word, place) AS (VALUES {postings}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT rid, doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s, {every} AS pos, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM d),
p AS (SELECT rid, word, pos FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM post)),
i AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / count(DISTINCT rid)) AS idf FROM p GROUP BY word),
h AS (SELECT rid, template, shift, sum(idf) AS got FROM (SELECT DISTINCT p.rid, post.template, p.pos - post.place AS shift, p.word, i.idf FROM p JOIN i USING (word) JOIN post USING (word)) GROUP BY ALL),
whole AS (SELECT template, sum(idf) AS whole FROM (SELECT DISTINCT template, word FROM post) JOIN i USING (word) GROUP BY template),
m AS (SELECT rid, template, max(got) AS got FROM h GROUP BY ALL),
k AS (SELECT m.rid, list(DISTINCT n.label) AS method, max(got / whole) AS share FROM m JOIN whole USING (template) JOIN (SELECT DISTINCT template, label, phrase FROM post) n USING (template) JOIN b ON b.rid = m.rid AND contains(b.s, ' ' || n.phrase || ' ') WHERE got / whole >= {SHARE} GROUP BY m.rid)
SELECT doc_id, n_words, len(pos) AS n_base, list_min(pos) - 1 AS first_word, list_max(pos) - 1 AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
array_to_string(list_sort(list_distinct(base || coalesce(method, []))), ',') AS labels, round(greatest(CASE WHEN len(pos) > 0 THEN 0.75 ELSE 0 END, least(1, coalesce(share, 0))), 6)::DOUBLE AS score
FROM b LEFT JOIN k USING (rid)
"""


OP8_SQL = _sql()
