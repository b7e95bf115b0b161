"""Operator 9: license scans by a positional rare-token index, in DataFrame functions alone.

Every template's highest-IDF words are postings (word, label, position, weight).  A file's words meet them
in a broadcast join (the postings are a constant of this module); hits of one label at one relative
position (place in the file minus place in the template) add up, so a template's words count only where
they stand as in the template.  A label holds if the best relative position has enough of the template's
weight and the template's mandatory key phrase stands in the file.  Labels by exact phrase are kept beside.

Weights are integers (thousandths of the logarithm), so sums don't depend on their order.

Defined results: a null text has no words, places or labels and score 0; repeated rows repeat with their
own results; very long texts are scanned whole; of alignments that score alike each gives its label, and the
score is the best one's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import table

#: label -> exact phrase
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: (label, template, mandatory key phrase)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", "this work is licensed under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "this work is licensed under the bsd 3 clause license", "bsd 3 clause license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
)
#: Postings of a template, and the thousandths of its weight that must meet at one relative position.
WORDS, ENOUGH = 8, 700

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word's characters and those between words, in texts that aren't lower-cased; Java's (?i) folds A-Z alone,
#: and it takes a class in this form ten times faster than the same one as a negation.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def postings() -> list[tuple[str, int, str, int, int]]:
    """(word, template number, label, position, weight) of each template's rarest words."""
    split = [t.split() for _, t, _ in TEMPLATES]
    seen = Counter(w for words in split for w in set(words))
    out = []
    for k, words in enumerate(split):
        idf = {w: round(1000 * math.log((1 + len(split)) / seen[w])) for w in words}
        # Of a word that stands several times the first place counts.
        for word in sorted(idf, key=lambda w: (-idf[w], words.index(w)))[:WORDS]:
            out.append((word, k, TEMPLATES[k][0], words.index(word), idf[word]))
    return out


def _phrase(words: str) -> str:
    return f"(?i)(?<!{WORD}){f'{GAP}+'.join(words.split())}(?!{WORD})"


def _has(text: Column, words: str) -> Column:
    """Whether the phrase stands in the text; most texts are passed by without looking behind at every place."""
    return text.rlike("(?i)" + f"{GAP}+".join(words.split())) & text.rlike(_phrase(words))


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("bigint")


def _base(text: Column) -> list[Column]:
    """n_words, n_base, first_word, last_word and base labels."""
    n, firsts, lasts, labels = F.lit(0).cast("bigint"), [], [], []
    for label, words in PHRASES.items():
        some, regex = _has(text, words), _phrase(words)
        parts = F.split(text, regex, -1)
        n += F.when(some, F.size(parts) - 1).otherwise(0)
        firsts.append(F.when(some, _count(parts[0])))
        lasts.append(F.when(some, _count(text) - _count(F.element_at(parts, -1)) - len(words.split())))
        labels.append(F.when(some, label))
    return [_count(text).alias("n_words"), n.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base")]


def scan(files: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): words, places of exact phrases, labels and a score."""
    spark = files.sparkSession
    rows = postings()
    whole = Counter()
    for _, k, _, _, weight in rows:
        whole[k] += weight
    index = F.broadcast(spark.createDataFrame(rows, "word string, template int, label string, place int, weight int"))
    total = F.broadcast(spark.createDataFrame(sorted(whole.items()), "template int, whole int"))
    said = files.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    text, rare = F.col("text"), sorted({r[0] for r in rows})
    words = F.regexp_extract_all("text", F.lit(f"({WORD}+)"), F.lit(1))
    keys = F.array_compact(F.array(*(F.when(_has(text, key), F.lit(k)) for k, (_, _, key) in enumerate(TEMPLATES))))
    # A key phrase is necessary, and rare: only files with one are taken apart.
    likely = "(?i)" + "|".join(sorted({max(key.split(), key=len) for _, _, key in TEMPLATES}))
    opened = said.where(text.rlike(likely)).withColumn("keys", keys).where("size(keys) > 0")
    low = F.translate("word", _UPPER, _LOWER)
    hits = (
        opened.select("doc_id", "row", "keys", F.posexplode(words).alias("at", "word"))
        .where(F.lower("word").isin(rare)).where(low.isin(rare)).withColumn("word", low)
        .join(index, "word").where("array_contains(keys, template)")
    )
    # Of repeated rows each place counts once.
    once = hits.select("doc_id", "row", "template", "label", F.expr("at - place").alias("shift"), "place", "weight").distinct()
    aligned = once.groupBy("doc_id", "row", "template", "label", "shift").agg(F.sum("weight").alias("met")).join(total, "template")
    held = aligned.where(f"1000 * met >= {ENOUGH} * whole").groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max(F.expr("round(met / whole, 6)")).alias("share"))
    return said.select("doc_id", "row", *_base(text)).join(held, ["doc_id", "row"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def oracle() -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    values = lambda rows: ", ".join(f"({', '.join(map(quote, r))})" for r in rows)
    phrases = [(label, words, len(words.split())) for label, words in PHRASES.items()]
    keys = [(k, key, len(key.split())) for k, (_, _, key) in enumerate(TEMPLATES)]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, doc_id, w, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
p(label, phrase, n) AS (VALUES {values(phrases)}),
k(template, phrase, n) AS (VALUES {values(keys)}),
i(word, template, label, place, weight) AS (VALUES {values(postings())}),
b AS (SELECT r, label, pos FROM t JOIN p ON t.word = split_part(phrase, ' ', 1) AND array_to_string(w[pos + 1:pos + n], ' ') = phrase),
bb AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM b GROUP BY r),
g AS (SELECT DISTINCT r, template FROM t JOIN k ON t.word = split_part(phrase, ' ', 1) AND array_to_string(w[pos + 1:pos + n], ' ') = phrase),
m AS (SELECT r, template, label, pos - place AS shift, sum(weight) AS met FROM t JOIN i USING (word) SEMI JOIN g ON g.r = t.r AND g.template = i.template GROUP BY ALL),
h AS (SELECT r, label, round(met / whole, 6) AS share FROM m JOIN (SELECT template, sum(weight) AS whole FROM i GROUP BY template) USING (template) WHERE 1000 * met >= {ENOUGH} * whole),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM h) GROUP BY r),
bl AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
s AS (SELECT r, max(share) AS share FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN l USING (r) LEFT JOIN bl USING (r) LEFT JOIN s USING (r)
"""
