"""License notices found by diagonal voting.

All rolling word k-grams of every text are hashed and joined with the places the grams have in the notice templates:
pairs for phrases and short notices, four words for whole ones, whose pairs of common words would hit everywhere.
A hit at word p of the text and place t of a template votes for the diagonal p - t; a notice that stands in the text
word for word puts all its votes on one diagonal. Notices with words added or left out spread over neighbouring
diagonals, which are merged before the share of the template that was matched is taken. Hits are verified by
comparing the words themselves.

DataFrame functions only. The templates are a fixed list, so their grams are broadcast; nothing else is. Only grams that
hit are shuffled. Templates may have any length: the places found on a diagonal are kept as bits, 64 to a row. Null counts
as empty; a text without words has n_words 0 and no labels; texts of any length are scanned whole; repeated rows are
scanned row by row; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that may be worded a little differently, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under cc by 4 0": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "mozilla public license version 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the software is provided as is without warranty of any kind express or implied": "no-warranty",
    "no part of this publication may be reproduced without permission": "reserved-publication",
}

#: Whole notices, as their owners publish them, lower case and without punctuation.
WHOLE_NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
    "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
    "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
    "from out of or in connection with the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
    "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
    "or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version 3 of the license or at your option any later version this program is "
    "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose see the gnu general public license for more details": "gpl-3.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
    "this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0",
}

COVERAGE = 0.75
SHORT_GRAM, LONG_GRAM = 2, 4
#: Bits of a long, one per place of a template.
WORD = 64
DIAGONAL_GAP = 2
_NO_WORD = "\x00"  # cannot be a word


def templates(phrases: Mapping[str, str], notices: Mapping[str, str], whole: Mapping[str, str]) -> list[tuple[int, bool, str, int, int, list[str]]]:
    """Rows of (template, exact, label, grams, place, words of the gram)."""
    rows = []
    kinds = [(t, l, True, SHORT_GRAM) for t, l in phrases.items()] + [(t, l, False, SHORT_GRAM) for t, l in notices.items()] + [(t, l, False, LONG_GRAM) for t, l in whole.items()]
    for n, (text, label, exact, k) in enumerate(kinds):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(n, exact, label, len(words) - k + 1, i, words[i : i + k]) for i in range(len(words) - k + 1)]
    return rows


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    whole: Mapping[str, str] = WHOLE_NOTICES,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: the largest share of a template's grams found on one group of neighbouring diagonals, over all
    templates. spans: label, first and last word and share of each group above COVERAGE.
    """
    spark = docs.sparkSession
    # each text starts with a gram that every text hits, so texts without notices stay in the result
    begin = (-1, False, "", 1, 0, [_NO_WORD] * SHORT_GRAM)
    grams = spark.createDataFrame([begin, *templates(phrases, notices, whole)], "template int, exact boolean, label string, grams int, place int, gram array<string>")
    grams = grams.withColumn("h", F.xxhash64("gram"))
    body = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    words = F.array_remove(F.split(body, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(F.array(*[F.lit(_NO_WORD)] * SHORT_GRAM), words).alias("words"))
    at = rows.select("doc_id", "row", "words", F.posexplode("words").alias("at", "word"))
    lengths = [SHORT_GRAM, LONG_GRAM] if whole else [SHORT_GRAM]
    ahead = [F.get("words", F.col("at") + i) if i else F.col("word") for i in range(max(lengths))]
    both = F.explode(F.array(*[F.xxhash64(F.array(*ahead[:k])) for k in lengths])).alias("h")
    found = at.select("doc_id", "row", "words", "at", both).alias("g").join(F.broadcast(grams).alias("t"), F.col("g.h") == F.col("t.h"))
    found = found.filter(F.slice("words", F.col("at") + 1, F.size("gram")) == F.col("gram"))
    hits = found.select("row", "doc_id", (F.size("words") - SHORT_GRAM).cast("bigint").alias("n_words"), "template", "exact", "label", "grams", "place", (F.size("gram") - 1).alias("reach"), (F.col("at") - SHORT_GRAM).cast("bigint").alias("at"))
    # all hits of a document meet in one task: at most its own words, times the template places a gram has
    one = ["row", "doc_id", "n_words", "template", "exact", "label", "grams"]
    diagonals = (
        hits.repartition("row")
        .groupBy(*one, (F.col("at") - F.col("place")).alias("diagonal"), F.floor(F.col("place") / WORD).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, place % {WORD})")).alias("places"), F.min("at").alias("first"), F.max(F.col("at") + F.col("reach")).alias("last"))
    )
    lane = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(lane)
    on_diagonal = F.sum(F.bit_count("places")).over(lane.rangeBetween(Window.currentRow, Window.currentRow))
    diagonals = diagonals.withColumns({"apart": F.when(gap <= DIAGONAL_GAP, 0).otherwise(1), "full": (on_diagonal == F.col("grams")) & (F.col("word") == 0)})
    diagonals = diagonals.withColumn("lane", F.sum("apart").over(lane))
    pieces = diagonals.groupBy(*one, "lane", "word").agg(
        F.count_if("full").alias("whole"),
        F.min(F.when(F.col("full"), F.col("diagonal"))).alias("whole_first"),
        F.max(F.when(F.col("full"), F.col("diagonal"))).alias("whole_last"),
        F.bit_or("places").alias("places"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    lanes = pieces.groupBy(*one, "lane").agg(
        F.sum("whole").alias("whole"),
        F.min("whole_first").alias("whole_first"),
        F.max("whole_last").alias("whole_last"),
        F.sum(F.bit_count("places")).alias("matched"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    share = F.when(F.col("template") < 0, 0.0).when(F.col("exact"), F.when(F.col("whole") > 0, 1.0).otherwise(0.0)).otherwise(F.col("matched") / F.col("grams"))
    lanes = lanes.withColumn("share", share).withColumn("found", F.col("share") >= COVERAGE)
    base = F.col("exact") & F.col("found")
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    span = F.struct("first", "last", "label", "share")
    return lanes.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("whole_first"))).alias("first_word"),
        F.max(F.when(base, F.col("whole_last"))).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), span))).alias("spans"),
    ).drop("row")
