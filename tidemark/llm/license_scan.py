"""License scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

A text is compared in units: its lines, its paragraphs of several lines, and the whole of it if it has
several paragraphs. A unit is lower-cased, everything but a-z and 0-9 becomes a space, and its distinct
pairs of neighbouring words are compared with each template's. With a least coefficient t, a unit of n
pairs can only match a template of m if t / (2 - t) <= n / m <= (2 - t) / t; so templates are listed under
every size they can match, and a unit meets them by an equality join on its size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import whole

MIN_DICE = 0.8

# The usual wording of licence notices, and the licence each stands for.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> list[str]:
    tokens = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(tokens, tokens[1:])))


def sizes_allowed(m: int, min_dice: float = MIN_DICE) -> range:
    """The numbers of pairs a unit can have to reach `min_dice` with a template of m."""
    share = min_dice / (2 - min_dice)
    return range(max(1, math.ceil(m * share - 1e-9)), math.floor(m / share + 1e-9) + 1)


def template_rows(templates=TEMPLATES, min_dice: float = MIN_DICE) -> list[tuple]:
    """(template, license, pairs, m, n) for every size n the template can match."""
    out = []
    for k, (name, text) in enumerate(templates):
        pairs = bigrams(text)
        out += [(k, name, pairs, len(pairs), n) for n in sizes_allowed(len(pairs), min_dice)]
    return out


def template_frame(spark: SparkSession, templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    return spark.createDataFrame(template_rows(templates, min_dice), "template INT, license STRING, pairs ARRAY<STRING>, m INT, n INT")


def license_scan(docs: DataFrame, doc_id="doc_id", text="text", templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, unit, place, license, template, n_pairs, dice): every unit and template that reach `min_dice`.

    unit is line, paragraph or text; place counts the units of that kind from 0. Ties are all returned.
    Null and empty texts have no units, repeated rows report each, an empty table reports nothing, and
    other columns are ignored. The templates (one row for each size a template can match) are broadcast:
    their number is that of the parameter, not of the data.
    """
    plain = F.regexp_replace(F.lower(whole(text)), "[^a-z0-9\n]+", " ")
    rows = docs.select(F.col(doc_id).alias("doc_id"), plain.alias("plain"))
    rows = rows.select("doc_id", F.split("plain", "\n").alias("lines"), F.split("plain", "\n[ \n]*\n").alias("paragraphs"), "plain")

    def unit(kind: str, texts) -> F.Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), t.alias("t")))

    many = F.filter(unit("paragraph", F.col("paragraphs")), lambda u: F.contains(u["t"], F.lit("\n")))
    whole_text = F.when(F.size("paragraphs") > 1, unit("text", F.array("plain"))).otherwise(F.filter(unit("text", F.array("plain")), lambda u: F.lit(False)))
    units = rows.select("doc_id", F.explode(F.concat(unit("line", F.col("lines")), many, whole_text)).alias("u")).select("doc_id", "u.*")
    tokens = units.select("doc_id", "unit", "place", F.split(F.trim(F.translate("t", "\n", " ")), " +").alias("w")).where("size(w) > 1")
    sized = tokens.withColumn("p", F.array_distinct(F.expr("transform(slice(w, 2, greatest(size(w) - 1, 1)), (x, i) -> concat(w[i], ' ', x))"))).withColumn("n", F.size("p"))
    found = sized.join(F.broadcast(template_frame(docs.sparkSession, templates, min_dice)), "n")
    found = found.withColumn("common", F.size(F.array_intersect("p", "pairs")))
    found = found.where(F.col("common") * 2 >= F.lit(min_dice) * (F.col("n") + F.col("m")))
    dice = F.round(F.col("common") * 2 / (F.col("n") + F.col("m")), 6)
    return found.select("doc_id", "unit", "place", "license", "template", F.col("n").cast("long").alias("n_pairs"), dice.alias("dice"))
