"""License scans by diagonal voting, in DataFrame functions.

All runs of three words of every text are joined by hash, and then by the words themselves, with the places of
the same runs in templates. A hit votes for the diagonal place - place in the template. Votes are counted by
diagonal, each diagonal is merged with those at most ``APART`` words behind it (words put in or left out; a band never grows beyond that, so
words of a span stand in the template's order up to as many words), and a band counts if enough of its template's runs
are found in it at as many places of the text; the base phrases must be found whole on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phrases whose places are reported, with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Words of well-known licenses and notices, with their labels; opening words first, then whole notices and texts.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
]
K = 3
#: Words that the diagonals of a span may lie apart in all, and the share of a template's runs that it must hold.
APART = 3
COVERED = 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _templates(spark, base: list, templates: list) -> DataFrame:
    rows = []
    for number, (phrase, label) in enumerate([*base, *templates]):
        words = phrase.split()
        rows += [(*words[i : i + K], number, i, len(words) - K + 1, label, number < len(base)) for i in range(len(words) - K + 1)]
    made = spark.createDataFrame(rows, "t0 string, t1 string, t2 string, template int, at int, runs int, label string, base boolean")
    return made.withColumn("hash", F.xxhash64("t0", "t1", "t2"))


def scan(docs: DataFrame, base: list = BASE, templates: list = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    Words are runs of a-z (A-Z in lower case), 0-9 and characters beyond ASCII. ``n_base`` counts all places of the base
    phrases, first_word and last_word are the least and largest of their starts (null without any). ``labels`` has
    the base labels and those of the templates found; ``score`` is the best share of a template's runs among
    the spans that count, 0 without any. A null text counts as empty; repeated rows give equal rows; ids may be
    null; an empty table gives no rows; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "").alias("w"))
    words = words.withColumn("n", F.size("w"))
    shifted = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.col("n")).alias("b"), F.slice("w", F.lit(3), F.col("n")).alias("c"))
    runs = words.select("doc_id", "key", "n", F.posexplode_outer(shifted).alias("pos", "s")).select("doc_id", "key", "n", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("s.a").alias("w0"), F.col("s.b").alias("w1"), F.col("s.c").alias("w2"))
    # The first run of each row goes on whether it hits or not: it stands for the row.
    places = F.broadcast(_templates(docs.sparkSession, base, templates))  # a constant table of some 100 rows
    same = (F.xxhash64("w0", "w1", "w2") == F.col("hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    hits = runs.join(places, same, "left").where("pos = 0 OR template IS NOT NULL")
    own = ["doc_id", "key", "template"]
    # Where the first run hits several places, it stands for the row once.
    one = F.when((F.col("pos") == 0) & (F.col("template").isNull() | (F.col("first") == 1)), 1).otherwise(0)
    first_template = F.broadcast(_templates(docs.sparkSession, base, templates).groupBy("hash").agg(F.min(F.struct("template", "at")).alias("lead")).select(F.col("hash").alias("lead_hash"), "lead"))
    hits = hits.join(first_template, F.col("hash") == F.col("lead_hash"), "left").withColumn("first", (F.struct("template", "at") == F.col("lead")).cast("int"))
    votes = hits.groupBy(*own, (F.col("pos") - F.col("at")).alias("diagonal"), "runs", "label", "base").agg(F.collect_set("at").alias("at"), F.max("n").alias("n"), F.sum(one).alias("copies"))
    # A band begins at each diagonal, so which one comes first doesn't matter. A base phrase takes its own diagonal only.
    band = F.collect_list(F.struct("diagonal", "at")).over(Window.partitionBy(*own).orderBy("diagonal").rangeBetween(0, APART))
    spans = votes.withColumn("band", F.when(F.col("base"), F.array(F.struct("diagonal", "at"))).otherwise(band))
    runs_found = F.size(F.array_distinct(F.flatten(F.col("band.at"))))
    places_found = F.size(F.array_distinct(F.flatten(F.transform("band", lambda d: F.transform(d["at"], lambda at: at + d["diagonal"])))))
    spans = spans.select(*own, "label", "base", "n", "copies", F.col("diagonal").alias("start"), (F.least(runs_found, places_found) / F.col("runs")).alias("share"))
    share = F.col("share")
    counts = F.when(F.col("base"), share == 1).otherwise(share >= COVERED)
    place = F.when(F.col("base") & (share == 1), F.col("start"))
    listed = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "key").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        listed(F.col("base") & (share == 1)).alias("base_labels"),
        listed(counts).alias("labels"),
        F.coalesce(F.max(F.when(counts, share)), F.lit(0.0)).alias("score"),
        F.sum("copies").cast("int").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies", "key")
