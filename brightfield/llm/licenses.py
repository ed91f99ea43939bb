"""Operator 8: license scans by diagonal voting, in DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.llm.common import quoted

#: What separates words: every ASCII character that is no letter or digit, after lower-casing. A fixed value.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals up to this many words apart belong to one alignment: so many words may be missing or added in it.
NEIGHBOURS = 3
#: The share of a long template's word k-grams that a span must hold.
LEAST_SHARE = 0.7
#: The table of template grams is broadcast up to so many rows (some 20 MB); a larger one is joined by shuffling both sides.
BROADCAST_ROWS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: Phrases of the base, matched word for word. Fixed values.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Public notices, found with missing or changed words too. Fixed values.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def grams(word: Column) -> Column:
    """All rolling word k-grams of an array of words."""
    n = F.size(word)
    shifted = [F.slice(word, k + 1, n).alias(f"w{k}") for k in range(GRAM)]
    return F.slice(F.arrays_zip(*shifted), 1, F.greatest(n - (GRAM - 1), F.lit(0)))


def template_grams(spark: SparkSession, templates) -> DataFrame:
    """(gram, t0.., t_pos, template, label, exact, n_grams) of templates, a sequence or a table (label, text, exact): any number of them."""
    table = templates if isinstance(templates, DataFrame) else spark.createDataFrame([(t.label, t.text, t.exact) for t in templates], "label string, text string, exact boolean")
    made = table.select("label", "exact", F.xxhash64("label", "text", "exact").alias("template"), grams(words(F.col("text"))).alias("g")).dropDuplicates(["template"])
    each = made.select("label", "exact", "template", F.size("g").alias("n_grams"), F.posexplode("g").alias("t_pos", "g"))
    return each.select("label", "exact", "template", "n_grams", "t_pos", *(F.col(f"g.w{k}").alias(f"t{k}") for k in range(GRAM)), F.xxhash64(*(F.col(f"g.w{k}") for k in range(GRAM))).alias("gram"))


def longest_ascent(values: Column) -> Column:
    """Length of the longest strictly ascending subsequence of an array: the least last value by length is kept, which has one entry at most for each value of a template."""

    def step(ends, v):
        n = F.size(F.filter(ends, lambda e: e < v))
        return F.concat(F.slice(ends, 1, n), F.array(v), F.slice(ends, n + 2, F.size(ends)))

    return F.size(F.aggregate(values, F.array().cast("array<int>"), step))


def license_spans(df: DataFrame, key: str = "doc_id", text: str = "text", templates=PHRASES + NOTICES) -> DataFrame:
    """Verified spans: key, text_hash, label, exact, first_word, last_word (words from 0, inclusive) and share of the template found.

    All rolling word 3-grams are joined with the templates' (hash and words), votes are counted by offset
    diagonal, diagonals up to NEIGHBOURS apart are merged, and a span stands if it holds every gram of an
    exact phrase on one diagonal, or grams of LEAST_SHARE of a notice in the notice's order and no overlapping notice has
    a larger share. Repeated rows give one set of spans; null, empty and short texts give none.
    """
    base = df.select(quoted(key).alias("__k"), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("text_hash"), words(quoted(text)).alias("__w"))
    each = base.select("__k", "text_hash", F.posexplode(grams(F.col("__w"))).alias("pos", "g"))
    each = each.select("__k", "text_hash", "pos", *(F.col("g")[f"w{k}"].alias(f"w{k}") for k in range(GRAM)))
    each = each.withColumn("gram", F.xxhash64(*(f"w{k}" for k in range(GRAM))))
    known = template_grams(df.sparkSession, templates)
    hits = each.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "gram").where(" and ".join(f"w{k} = t{k}" for k in range(GRAM)))
    hits = hits.select("__k", "text_hash", "template", "label", "exact", "n_grams", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    whole = ["__k", "text_hash", "template", "label", "exact", "n_grams"]
    votes = hits.groupBy(*whole, "diagonal").agg(F.collect_set("t_pos").alias("found"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    phrases = votes.where("exact and size(found) = n_grams").select(*whole, "lo", "hi", F.lit(1.0).alias("share"))
    # a notice: a new group begins where the step to the diagonal before is too wide
    by = W.partitionBy("__k", "text_hash", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOURS
    grouped = votes.where("not exact").withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    # the grams of a group, dealt to text windows of three template lengths, one beginning at every length: what spans two lengths lies
    # within one of them whole, however long repeated phrases have made the group
    placed = grouped.select(*whole, "group", F.explode("found").alias("t"), (F.col("diagonal")).alias("d")).withColumn("pos", F.col("d") + F.col("t"))
    begins = F.expr("explode(sequence(pos div n_grams - 2, pos div n_grams))").alias("window")
    # by place; of several grams at one place the later in the template first, so that an ascent takes one of them
    by_place = F.sort_array(F.collect_list(F.struct("pos", (-F.col("t")).alias("minus")))).alias("s")
    merged = placed.select(*whole, "group", "t", "pos", begins).groupBy(*whole, "group", "window").agg(by_place, F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    enough = F.size(F.array_distinct(F.transform("s", lambda p: p["minus"]))) >= LEAST_SHARE * F.col("n_grams")
    notices = merged.where(enough).withColumn("share", longest_ascent(F.transform("s", lambda p: (-p["minus"]).cast("int"))) / F.col("n_grams")).where(F.col("share") >= LEAST_SHARE)
    notices = notices.select(*whole, "lo", "hi", "share").distinct()
    # notices that differ by a word lie over one another: of those that overlap, the best found stand
    text_ = W.partitionBy("__k", "text_hash")
    before = F.max("hi").over(text_.orderBy("lo", "hi", "template").rowsBetween(W.unboundedPreceding, -1))
    place = notices.withColumn("new", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int")).withColumn("place", F.sum("new").over(text_.orderBy("lo", "hi", "template").rowsBetween(W.unboundedPreceding, 0)))
    notices = place.withColumn("best", F.max("share").over(W.partitionBy("__k", "text_hash", "place"))).where("share = best").select(*whole, "lo", "hi", "share")
    spans = phrases.unionByName(notices)
    return spans.select(F.col("__k").alias(key), "text_hash", "label", "exact", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + GRAM - 1).cast("long").alias("last_word"), "share")


def license_labels(df: DataFrame, key: str = "doc_id", text: str = "text", templates=PHRASES + NOTICES) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base, first_word and last_word (smallest and largest start) and base_labels are of exact phrases;
    labels adds the notices'. score is the largest share of a template found, 0 without any. Null and
    empty texts have no words; a null key is joined like any other; repeated rows each get their row.
    """
    spans = license_spans(df, key, text, templates)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    exact = F.col("exact")
    found = spans.groupBy(F.col(key).alias("__k"), F.col("text_hash").alias("__h")).agg(
        F.count_if(exact).alias("n_base"), F.min(F.when(exact, F.col("first_word"))).alias("first_word"), F.max(F.when(exact, F.col("first_word"))).alias("last_word"),
        joined(F.when(exact, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"))
    rows = df.select(quoted(key).alias(key), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("text_hash"), F.size(words(quoted(text))).cast("long").alias("n_words"))
    out = rows.join(found, F.col(key).eqNullSafe(F.col("__k")) & (F.col("text_hash") == F.col("__h")), "left")
    return out.select(key, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
