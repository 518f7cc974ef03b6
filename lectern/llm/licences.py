"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the same
hashes in the templates. A hit votes for the diagonal (place in the document minus place in
the template); diagonals that lie close together, as insertions and deletions make them,
merge into one span, and a span is verified by the longest chain of its hits that goes forward
in the document and in the template: it counts if the chain covers enough of the template's words.
Base phrases are templates of two-word hashes that must be there whole.

Defined cases: null and empty texts have no words and no labels; repeated rows are told
apart by their place in the input; null ids are kept; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from lectern.llm.common import alnum_words, map_rows

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Words of published licenses and their usual notices, and the names these go by.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "licensed under the mit license", "released under the mit license"),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "licensed under the bsd license", "released under the bsd license"),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
        "licensed under the gnu lesser general public license", "see the gnu lesser general public license for more details"),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version",
        "licensed under the gnu affero general public license", "see the gnu affero general public license for more details"),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at",
        "licensed under the mozilla public license"),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "licensed under the eclipse public license"),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "licensed under the isc license"),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",),
    "bsl-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "distributed under the boost software license"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "cc0-1.0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "cc-by": (
        "licensed under a creative commons attribution 4 0 international license", "creative commons attribution license", "licensed under cc by 4 0", "licensed under cc by 3 0"),
    "cc-by-sa": (
        "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike license", "licensed under cc by sa 4 0", "licensed under cc by sa 3 0"),
    "cc-by-nc": (
        "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial license", "licensed under cc by nc 4 0", "licensed under cc by nc 3 0"),
    "cc-by-nd": (
        "licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives license", "licensed under cc by nd 4 0"),
    "cc-by-nc-sa": (
        "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "licensed under cc by nc sa 4 0"),
}
#: Words of a k-gram: of base phrases, and of licenses.
PHRASE_K, TEXT_K = 2, 4
#: Diagonals at most this far apart are one.
NEAR = 3
#: Share of a template's words that a span must hold in order; templates of fewer than SHORT words must be there whole.
LEAST, SHORT = 0.6, 12
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes], k: int) -> np.ndarray:
    """Rolling 64-bit hash of every k consecutive words."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _P + h[i : len(words) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def positions(spark: SparkSession) -> DataFrame:
    """Template positions: hash, template, tpos, k, size (words), label, base. About a thousand rows: as many as the templates have words."""
    rows, t = [], 0
    for base, named in ((True, [(label, [phrase]) for phrase, label in PHRASES.items()]), (False, list(TEMPLATES.items()))):
        for label, texts in named:
            for text in texts:
                words = alnum_words(text)
                k = PHRASE_K if base else TEXT_K
                rows += [(int(h), t, i, k, len(words), label, base) for i, h in enumerate(grams(words, k).tolist())]
                t += 1
    return spark.createDataFrame(rows, "hash long, template int, tpos int, k int, size int, label string, base boolean")


@F.pandas_udf(T.IntegerType())
def in_order(hits: pd.Series, k: pd.Series) -> pd.Series:
    """Words of the template that the longest chain of (pos, tpos) going forward in both covers; hits by pos."""
    out = []
    for pairs, width in zip(hits, k, strict=True):
        ends: list[int] = []  # the least end of a chain of each length
        at: list[int] = []
        came: list[int] = []
        tpos = [] if pairs is None else [p["tpos"] for p in sorted(pairs, key=lambda p: (p["pos"], -p["tpos"]))]
        for i, t in enumerate(tpos):
            place = bisect_left(ends, t)
            came.append(at[place - 1] if place else -1)
            ends[place : place + 1], at[place : place + 1] = [t], [i]
        words, i, after = 0, at[-1] if at else -1, None
        while i >= 0:
            words += width if after is None else min(width, after - tpos[i])
            after, i = tpos[i], came[i]
        out.append(words)
    return pd.Series(out, dtype="int32")


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans
    (label, first and last word, share of the template)."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))

    def make() -> Callable:
        def step(cols: dict) -> dict:
            words = [alnum_words(t) for t in cols["text"]]
            # element 0 stands for the document itself; then all hashes of 2 words, then all of 4
            each = [np.concatenate([[0], grams(w, PHRASE_K), grams(w, TEXT_K)]).astype(np.int64) for w in words]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
            return {"doc_id": cols["doc_id"], "row": cols["row"], "n_words": [len(w) for w in words], "hashes": lists}

        return step

    hashed = map_rows(rows, make, f"doc_id {kind}, row long, n_words long, hashes array<bigint>", rows=128)
    every = hashed.select("doc_id", "row", "n_words", F.posexplode("hashes").alias("at", "hash"))
    places = positions(spark).withColumnRenamed("hash", "thash")
    joined = every.join(F.broadcast(places), (F.col("hash") == F.col("thash")) & (F.col("at") > 0), "left").where("at = 0 or template is not null")
    twos = F.greatest(F.col("n_words") - PHRASE_K + 1, F.lit(0))
    place = F.when(F.col("base"), F.col("at") - 1).otherwise(F.col("at") - 1 - twos).cast("long")
    fits = F.when(F.col("base"), F.col("at") <= twos).otherwise(F.col("at") > twos)
    hits = joined.where((F.col("at") == 0) | fits).withColumn("pos", place).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "size", "k", "label", "base", "diagonal").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("votes"),
        F.collect_list(F.when(~F.col("base"), F.struct("pos", "tpos"))).alias("pairs"))
    # neighbouring diagonals of one template merge; of base phrases only whole diagonals count
    line = W.partitionBy("row", "template").orderBy("diagonal")
    far = F.when(F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("base"), F.lit(0)).otherwise(F.lit(NEAR)), 1).otherwise(0)
    merged = votes.withColumn("group", F.sum(far).over(line.rowsBetween(W.unboundedPreceding, 0))).groupBy("row", "doc_id", "n_words", "template", "size", "k", "label", "base", "group").agg(
        F.min("lo").alias("first"), (F.max(F.col("hi") + F.col("k")) - 1).alias("last"), F.sum("votes").alias("votes"), F.flatten(F.collect_list("pairs")).alias("pairs"))
    worth = F.coalesce(~F.col("base") & (F.col("votes") + F.col("k") - 1 >= LEAST * F.col("size")), F.lit(False))
    merged = merged.withColumn("words", F.when(F.col("base"), F.col("size")).otherwise(in_order(F.when(worth, F.col("pairs")), F.col("k"))))
    least = F.when(F.col("size") < SHORT, 1.0).otherwise(LEAST)
    checked = merged.withColumn("share", F.col("words") / F.col("size")).withColumn("ok", F.when(F.col("template").isNull(), False).when(F.col("base"), F.col("votes") == F.col("size") - F.col("k") + 1).otherwise(
        (F.col("share") >= least) & (F.col("last") - F.col("first") + 1 <= 2 * F.col("size"))))
    base = F.col("ok") & F.col("base")
    out = checked.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("first", "last", "label", "share")))).alias("spans"))
    return out.drop("row")
