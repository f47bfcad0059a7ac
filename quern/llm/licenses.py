"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. DataFrame operations only.

Words are runs of letters and digits (non-ASCII characters count as letters), in lower case, so comment marks and line
breaks inside a notice do not matter. A shingle is five words.

* Templates of ``LONG`` shingles and more are indexed by all their windows of ``WINDOW`` shingles, texts are cut into windows of
  that length at every ``STRIDE`` shingles. A window has ``BANDS`` bands of one MinHash value each, every band with a hash
  of its own, so a window that shares a part J of its shingles with a template's window meets it in some band with
  probability 1 - (1 - J)^4: 0.998 at 0.8, certain at 1. A verbatim run of LONG = WINDOW + STRIDE - 1 shingles always
  holds a window of the index.
* Shorter templates are windows of one shingle, where a band's value is the shingle itself: one intact shingle retrieves.

The index is made from the templates alone. Up to ``MOST_KEYS`` keys travel with the plan and each text is looked up in them
where it lies, without a join or a shuffle; larger indexes are joined, with the same matches. A retrieved template is verified
exactly: the part of its shingles that the text contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved

SHINGLE, WINDOW, STRIDE, BANDS = 5, 8, 4, 4
LONG = WINDOW + STRIDE - 1
CONTAINED = 0.8
#: Keys of an index that travels with the plan; one with more is joined.
MOST_KEYS = 50_000
BREAK = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# License notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def with_shingles(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add ``out``: hashes of the five-word shingles; fewer words are one shingle, no words none."""
    df = df.withColumn("_words", F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), ""), lambda w: F.xxhash64(w)))
    n, words = F.size("_words"), F.col("_words")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return df.withColumn(out, F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def with_bands(df: DataFrame, stride: int, out: str) -> DataFrame:
    """Add ``out``: the bands' values of the windows of ``h`` at every ``stride`` shingles, the last window included."""
    hashed = lambda band: lambda x: F.xxhash64(x, F.lit(band))
    df = df.withColumns({f"_o{t}": F.transform("h", hashed(t)) for t in range(BANDS)})
    last = F.greatest(F.lit(0), F.size("h") - WINDOW)
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))
    values = F.flatten(F.transform(starts, lambda s: F.array(*(F.least(*(F.get(f"_o{t}", s + k) for k in range(WINDOW))) for t in range(BANDS)))))
    return df.withColumn(out, values).drop(*(f"_o{t}" for t in range(BANDS)))


def index(spark, templates: dict[str, str]) -> list[tuple[str, list[int], list[int], list[int]]]:
    """(name, distinct shingles, short keys, long keys) of each template that has a word."""
    table = with_shingles(spark.createDataFrame(list(templates.items()), "name string, text string"), F.col("text"), "h")
    out = []
    for r in with_bands(table, 1, "bands").where(F.size("h") > 0).orderBy("name").collect():
        own = sorted(set(r["h"]))
        out.append((r["name"], own, *((own, []) if len(r["h"]) < LONG else ([], sorted(set(r["bands"]))))))
    return out


def verified(name: Column, own: Column, h: Column) -> Column:
    common = F.array_intersect(own, h)
    first = F.array_min(F.transform(common, lambda x: F.array_position(h, x))) - 1
    return F.struct(name.alias("license"), (F.size(common) / F.size(own)).alias("containment"), first.cast("long").alias("first_word"))


def looked_up(df: DataFrame, found: list) -> DataFrame:
    """(doc_id, m): the index in the plan; a null m for texts without a retrieved template."""
    short, long = (sorted({k for t in found for k in t[i]}) for i in (2, 3))
    h, none = F.col("h"), F.array().cast("array<bigint>")
    df = df.withColumn("_short", F.filter(h, lambda x: x.isin(short)) if short else none)
    df = with_bands(df, STRIDE, "_keys").withColumn("_long", F.filter("_keys", lambda x: x.isin(long))) if long else df.withColumn("_long", none)
    some = (F.size("_short") > 0) | (F.size("_long") > 0)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else none
    table = F.array(*(F.struct(F.lit(name).alias("name"), longs(own).alias("own"), longs(a).alias("short"), longs(b).alias("long")) for name, own, a, b in found)) if found else F.array().cast("array<struct<name:string,own:array<bigint>,short:array<bigint>,long:array<bigint>>>")
    retrieved = F.filter(table, lambda t: F.arrays_overlap(t["short"], F.col("_short")) | F.arrays_overlap(t["long"], F.col("_long")))
    # an outer explode and a filter above it: a filter below would be pushed to the scan with all these expressions inlined
    return df.select("doc_id", F.explode_outer(F.when(some, F.transform(retrieved, lambda t: verified(t["name"], t["own"], h)))).alias("m"))


def joined(df: DataFrame, found: list) -> DataFrame:
    """(doc_id, m): the index as a table that the texts' keys are joined with, whatever its size.

    Texts' shingles are written once under a number of their row. A row meets a template once, however many keys they share;
    keys that many texts have only repeat on the texts' side, where Spark splits large partitions.
    """
    spark = df.sparkSession
    rows = saved(df.withColumn("row", F.monotonically_increasing_id()), "license_shingles")
    keys = [(k, i) for i, t in enumerate(found) for k in (*t[2], *t[3])]
    small = (lambda d: F.broadcast(d)) if max(len(keys), sum(len(t[1]) for t in found)) <= BROADCAST_ROWS else (lambda d: d)
    own = small(spark.createDataFrame([(i, t[0], t[1]) for i, t in enumerate(found)], "template int, name string, own array<bigint>"))
    cut = with_bands(rows, STRIDE, "_keys").select("row", F.explode(F.array_distinct(F.concat("h", "_keys"))).alias("key"))
    met = cut.join(small(spark.createDataFrame(keys, "key long, template int")), "key").select("row", "template").distinct()
    return met.join(rows, "row").join(own, "template").select("doc_id", verified(F.col("name"), F.col("own"), F.col("h")).alias("m"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """(doc_id, license, containment, first_word): one row for each row of ``docs`` and template of which it contains ``contained`` or more.

    containment is the part of the template's distinct shingles that the text has, first_word the place of the first of them
    (0: the text's first word). Null, empty and unlicensed texts give no row, nor do templates without words; rows with null or
    repeated ids each give their own. Other columns of ``docs`` are left behind. An index of more than ``most_keys`` keys is
    joined; the matches are the same.
    """
    found = index(docs.sparkSession, TEMPLATES if templates is None else templates)
    df = with_shingles(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text")), F.col("_text"), "h").drop("_text")
    way = looked_up if sum(len(short) + len(long) for _, _, short, long in found) <= most_keys else joined
    return way(df, found).select("doc_id", "m.*").where(F.col("containment") >= contained)


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """The same matches by comparing every text with every template, for DuckDB."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    cut = "case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
    return f"""
    with t as (select name, list_distinct({cut}) as s from (select name, {words} as w from (values {rows}) v(name, text))),
    d as (select doc_id, {cut} as s from (select doc_id, {words} as w from documents)),
    m as (select doc_id, name, t.s as own, d.s as had, list_intersect(t.s, d.s) as common from d, t where list_has_any(d.s, t.s))
    select doc_id, name as license, len(common)::double / len(own) as containment,
           (list_min(list_transform(common, lambda x: list_position(had, x))) - 1)::bigint as first_word
    from m where len(common)::double / len(own) >= {CONTAINED}"""
