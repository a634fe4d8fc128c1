"""Licence scans (native): sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory by path joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

#: Titles, short statements and opening words of well-known licences.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License, either version 3 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License, either version 2 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-1.0": ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3, 3 November 2008",),
    "GFDL-1.2": ("GNU Free Documentation License Version 1.2, November 2002",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"),
    "MPL-1.1": ("MOZILLA PUBLIC LICENSE Version 1.1",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "Artistic-1.0": ("The \"Artistic License\"",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
HEADER = r"(?i)licen[cs]e|copyright|permission is hereby granted|public domain|redistribution and use"
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying)[^/]*$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
PARAGRAPH = r"\n[ \t\r]*\n"


def headers(text: Column) -> Column:
    """The lines of a text that can state a licence, joined by a space."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: line.rlike(HEADER)), " ")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that hold a term."""
    return F.filter(F.split(text, PARAGRAPH), lambda x: F.lower(x).rlike("[a-z0-9]"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def unit_key(unit: Column) -> Column:
    """128 bits that stand for a unit's text, so that texts are not carried beside their terms."""
    return F.unhex(F.md5(unit))


def match_templates(texts: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """(key, license, similarity): the template of highest TF-IDF cosine for each distinct unit
    text, from `least` up; the first name wins a tie. Weights are tf * (ln((1 + N) / (1 + df)) + 1)
    over the distinct units and the templates."""
    units = texts.groupBy(unit_key(F.col("unit")).alias("key")).agg(F.min("unit").alias("unit"))
    spread = save(units.select("key", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").cast("int").alias("tf")), "unit-terms")
    n = float(texts.select(F.count_distinct(unit_key(F.col("unit")))).first()[0] + templates.count())
    model = templates.select("license", "body", F.explode(terms(F.col("body"))).alias("term")).groupBy("license", "body", "term").agg(F.count("*").alias("tf"))
    df = spread.select("term").unionByName(model.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = save(df.select("term", (F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")), "idf")
    w_model = save(model.join(idf, "term").select("license", "body", "term", "idf", (F.col("tf") * F.col("idf")).alias("v")), "template-weights")
    norm_m = w_model.groupBy("license", "body").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nm"))
    dots = spread.join(w_model, "term").groupBy("key", "license", "body").agg(F.sum(F.col("tf") * F.col("idf") * F.col("v")).alias("dot"))
    dots = save(dots.join(norm_m, ["license", "body"]).select("key", "license", (F.col("dot") / F.col("nm")).alias("part")), "dots")
    # the norm of a unit is needed only where a term is shared
    near = spread.join(dots.select("key").distinct(), "key", "left_semi").join(idf, "term")
    norm_u = near.groupBy("key").agg(F.sqrt(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf"))).alias("nu"))
    cosine = F.round(F.col("part") / F.col("nu"), 6)
    scored = dots.join(norm_u, "key").select("key", "license", cosine.alias("similarity")).filter(F.col("similarity") >= least)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("x"))
    return best.select("key", "x.license", (-F.col("x.s")).alias("similarity"))


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, from_dir, inherited): each directory's nearest ancestor (itself included) in `licensed`."""
    parts = F.split("dir", "/")
    up = directories.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from_dir"))
    near = up.join(licensed, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "inherited")).alias("x"))
    return near.select("dir", "x.from_dir", "x.inherited")


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.5, file_share: float = 0.3) -> DataFrame:
    """license, similarity, origin and from_dir for each row of `files` (doc_id, path, text).

    A file states a licence where its header lines (or, where it is named like a licence file,
    any of its paragraphs) come within `least` of a template; of several the highest similarity,
    then the first name, wins. A file that is named like one, or whose header holds at least
    `file_share` of its words, licenses its directory. Files without a statement inherit from the
    nearest ancestor directory. origin is 'header', 'file', 'inherited' or 'none'. Null and empty
    texts and null paths state nothing; a null path inherits nothing. Repeated rows are each
    returned; columns beside doc_id, path and text are ignored. The texts are read once.
    """
    spark = files.sparkSession
    model = spark.createDataFrame([(k, body) for k, bodies in templates.items() for body in bodies], "license string, body string")
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    body = F.coalesce("text", F.lit(""))
    header = F.when(~named, headers(body))
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), named.alias("named"), header.alias("header"), F.when(named, paragraphs(body)).otherwise(F.filter(F.array(header), lambda x: x != "")).alias("units"), body.alias("body"))
    # counted only where a header was found
    whole = F.col("named") | F.coalesce(F.when(F.col("header") != "", F.size(terms(F.col("header"))) >= F.size(terms(F.col("body"))) * file_share), F.lit(False))
    rows = save(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "dir", whole.alias("whole"), "units"), "files")
    stated = rows.select("row", F.explode(F.array_distinct("units")).alias("unit"))
    found = save(match_templates(stated, model, least), "matches")
    hits = stated.select("row", unit_key(F.col("unit")).alias("key")).join(found, "key").groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("x"))
    own = rows.join(hits, "row", "left").select("doc_id", "path", "dir", F.col("x.license").alias("license"), (-F.col("x.s")).alias("similarity"), (F.col("x").isNotNull() & F.col("whole")).alias("is_file"))
    own = save(own, "own")
    source = own.filter("is_file AND path IS NOT NULL").groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license"))["license"].alias("inherited"))
    by_dir = save(inherited(own.filter("license IS NULL AND path IS NOT NULL").select("dir"), source), "inherited")
    columns = ["doc_id", "path", "license", "similarity", "origin", "from_dir"]
    has = own.filter("license IS NOT NULL").select("doc_id", "path", "license", "similarity", F.when(F.col("is_file"), "file").otherwise("header").alias("origin"), F.lit(None).cast("string").alias("from_dir"))
    rest = own.filter("license IS NULL").join(by_dir, "dir", "left")
    rest = rest.select("doc_id", "path", F.col("inherited").alias("license"), "similarity", F.when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"), "from_dir")
    return has.select(columns).unionByName(rest.select(columns))


def scan_documents(documents: DataFrame, per_dir: int = 100) -> DataFrame:
    """scan_licenses over documents laid out at four depths by their id: source, source/lang,
    source/lang/block (`per_dir` ids to a block) and source/lang/block/part; ids divisible by ten
    are named LICENSE-id."""
    levels = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / per_dir).cast("string"), F.concat(F.lit("part"), (F.col("doc_id") % 3).cast("string"))]
    folder = F.concat_ws("/", F.slice(F.array(*levels), F.lit(1), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, "LICENSE-").otherwise(""), F.col("doc_id").cast("string"))
    return scan_licenses(documents.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text").withColumn("path", F.when(F.col("doc_id").isNotNull(), F.col("path"))))
