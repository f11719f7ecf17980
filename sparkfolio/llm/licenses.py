"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest
ancestor directory by path joins.  DataFrame functions only.

Terms are weighed by how many files of the whole scan hold them.  A line, a run of neighbouring lines, or a licence file as
a whole, is a unit; it is compared with the templates it can reach: a cosine of at least the threshold needs one of a
template's rarest terms, whose absence alone would keep the cosine below it, so only units with such a term are built up
into vectors, and equal units once.  Vectors are rows (unit, term, weight), joined with the templates' by term.  Licences of
a family differ in few terms ("3", "Affero", "ShareAlike"), which a cosine hardly feels: a template's own such terms must be
in the unit, and words that name a sibling, or say "not", must not.  A short notice inside a longer line is a unit too: the
longest runs of words known to the notices within a sentence.  Licences that share their first sentence are told apart by what
the file says further on.  Identifiers (``SPDX-License-Identifier:``, ``License:``) are no prose and are read as they stand.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.llm.shared import col, join_split, staged

_GNU = "This {thing} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version."


def _gnu(name: str, version: str, thing: str = "program") -> list[str]:
    """Notices of a GNU licence: the header of the licence's own appendix, and short forms."""
    a, b = (":", ",") if version == "3" else (";", ";")
    return [_GNU.format(thing=thing, a=a, b=b, name=name, version=version), f"This work is licensed under the GNU {name}, version {version}.", f"GNU {name}, version {version}.", f"Licensed under the GNU {name} v{version}."]


def _cc(parts: str, words: str) -> list[str]:
    return [f"Licensed under CC {parts} 4.0.", f"This work is licensed under the Creative Commons {words} 4.0 International License."]


# Notices by which public licences say that they be named, as their texts or stewards give them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD-2-Clause": [],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "LicenseRef-Proprietary": ["All rights reserved."],
}
for _name, _notices in TEMPLATES.items():
    if not _name.startswith("LicenseRef-"):
        _notices.append(f"SPDX-License-Identifier: {_name}")

#: Words, and their short forms, that name one licence of a family beside numbers.
TELLING = [{"affero", "agpl"}, {"lesser", "lgpl", "library"}, {"sharealike", "sa"}, {"noncommercial", "nc"}, {"noderivatives", "noderivs", "nd"}]

#: Names that a notice's unit must hold where the notice does: a licence isn't named by the words around its name.
NAMES = {"mit", "apache", "bsd", "boost", "isc", "mozilla", "cc", "cc0", "creative", "gnu"}

#: Words that make another statement of a notice, unless it holds them itself.
TURNING = {"not", "never", "nor", "organization"}

#: Licences that share a notice: the other one, a phrase that its files hold, and one that they don't.
SHARED = {"BSD-3-Clause": [("BSD-4-Clause", "all advertising materials mentioning", None), ("BSD-2-Clause", "redistributions in binary form must reproduce", "endorse or promote")]}

_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?\)*"
#: An SPDX identifier or expression after its tag.
SPDX = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:OR|AND|WITH)[ \t]+{_ID})*)"


def field_pattern(names: list[str]) -> str:
    """A line ``License: name`` of known names, also quoted or with ``=``, as headers and manifests have it."""
    name = "(?:" + "|".join(re.escape(n) for n in sorted(names, reverse=True)) + ")(?:-only|-or-later|[+])?"
    return rf"""(?m)^[^\p{{L}}\p{{N}}\n]*[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]["']?[ \t]*[:=][ \t]*["']?({name}(?:[ \t]+(?:OR|AND)[ \t]+{name})*)[^\p{{L}}\p{{N}}\n]*$"""


def _agpl(gpl: str) -> str:
    """The Affero licence as its changes to the GPL of the same version make it: name, and the section on networks."""
    section = (
        "13. Remote Network Interaction; Use with the GNU General Public License.\nNotwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer "
        "all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access "
        "to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding "
        "Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph.\n"
    )
    renamed = gpl.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    return renamed.replace("  13. Use with the GNU Affero General Public License.", section)


#: Full texts, without copyright lines, for licence files as a whole.
TEXTS: dict[str, list[str]] = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
TEXTS["AGPL-3.0"] = [_agpl(TEXTS["GPL-3.0"][0])]


def terms_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits of a template, with dots inside numbers."""
    return re.findall(r"\d+(?:\.\d+)*|[^\W_]+", text.lower())


def marks(text: str, notice: bool) -> tuple[list[str], list[str]]:
    """Terms that a unit must hold to be this template's (a notice's numbers and telling words), and those it must not."""
    own = set(terms_of(text))
    needed = {t for t in own if t[0].isdigit()} | (own & (NAMES | TURNING).union(*TELLING)) if notice else set()
    barred = set().union(*(words for words in TELLING if not words & own))
    return sorted(needed), sorted(barred | (TURNING - own) if notice else barred)


def clause_words(texts: list[str]) -> list[str]:
    """Words that a clause may be made of: those of the notices, and all that would turn them into something else."""
    return sorted({t for text in texts for t in terms_of(text)}.union(TURNING, *TELLING))


#: Lines of the longest run: the longest notice wrapped at 32 columns.
RUN = 8

#: Base names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def _terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, with dots inside numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\d+(?:\.\d+)*|[\p{L}\p{N}]+)"), F.lit(1))


def _literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table as small as the templates, as a literal of the plan: no Python worker takes part."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(','))}>>")).alias("r")).select("r.*")


def _first(pattern: str) -> Column:
    """What the pattern's first match in the text names, or null."""
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))


def _plain(expression: Column) -> Column:
    """An expression with single spaces, and without brackets that don't pair."""
    spaced = F.regexp_replace(expression, r"[ \t]+", " ")
    count = lambda sign: F.length(spaced) - F.length(F.replace(spaced, F.lit(sign), F.lit("")))
    return F.when(count("(") == count(")"), spaced).otherwise(F.translate(spaced, "()", ""))


def scan(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (id, path, license, score, declared, inherited_from), one per row of ``df``.

    ``license`` is the template's with the highest cosine among the file's lines, its runs of up to ``RUN`` lines (a header
    wrapped over lines; comment marks are no terms) and its clauses (the longest runs of known words of a line's sentences), or,
    for a licence file, also of its text as a whole, to notices and to full ``texts``, if that is at least ``threshold``; a full
    text goes before notices, which others quote, a file's first SPDX expression, or else its first field ``License:`` of known
    names, before other notices (as it stands, with score 1), a ``LicenseRef-`` after all others and only for whole lines, and
    the first name before equals; ``declared`` is then true. A file without one inherits from the nearest directory at or above its own that
    holds a licence file with one (the best there, in the same order), and ``inherited_from`` is that directory. The root
    directory is the empty string.

    A null or empty text declares nothing; a null path has no directory and inherits nothing; repeated rows are scanned each
    and agree; an empty table gives an empty table; further columns are ignored. Every line of a text is read, whole.
    """
    spark = df.sparkSession
    given = [(name, i, text, True) for name, found in sorted((TEMPLATES if templates is None else templates).items()) for i, text in enumerate(found)]
    given += [(name, i, text, False) for name, found in sorted((TEXTS if texts is None else texts).items()) for i, text in enumerate(found)]
    told = [(f"{n}#{i}{'' if notice else '#full'}", n, not notice, *marks(t, notice), terms_of(t)) for n, i, t, notice in given]
    template = _literal(spark, "template string, needed array<string>, barred array<string>", [(t, needed, barred) for t, _, _, needed, barred, _ in told])
    # Terms of the templates: tables as large as the templates are, whatever the scan.
    counts = _literal(spark, "template string, license string, full boolean, term string, tf bigint", [(t, n, full, term, k) for t, n, full, _, _, terms in told for term, k in sorted(Counter(terms).items())])
    vocabulary = sorted({t for row in told for t in row[-1]})
    known = F.split(F.lit(" ".join(vocabulary)), " ")

    files = df.select(col(id_col).alias("id"), col(path_col).alias("path"), col(text_col).alias("text"))
    held = files.select(F.explode(F.array_intersect(_terms(F.col("text")), known)).alias("term"))
    total = files.count()
    in_files = {r.term: r.n for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most a row per template term
    # A term that no template has weighs as one that a single file holds.
    rarest = F.log(F.lit(1.0 + total)) + 1.0
    idf = _literal(spark, "term string, files bigint", [(t, in_files.get(t, 0)) for t in vocabulary]).select("term", "files", (F.log((1.0 + total) / (1.0 + F.col("files"))) + 1.0).alias("idf"))
    vectors = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    vectors = vectors.withColumn("v", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))).select("template", "license", "full", "term", "files", "v")
    # Terms in fewest files first: a unit without all of those that weigh more than the rest may lack cannot reach the threshold.
    before = F.coalesce(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("template").orderBy("files", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    reaching = vectors.withColumn("before", before).where(F.col("before") <= 1.001 - threshold * threshold).select("term", "full").distinct().collect()
    keys, full_keys = (F.split(F.lit(" ".join(sorted({r.term for r in reaching if r.full <= full}))), " ") for full in (False, True))
    of_notices = F.split(F.lit(" ".join(sorted({t for row in told if not row[2] for t in row[-1]}))), " ")

    base = F.element_at(F.split(F.col("path"), "/"), -1)
    is_license = F.coalesce(base.rlike(LICENSE_FILE), F.lit(False))
    # Whole texts without any key term are left alone before their lines are told apart; each line's terms are found once.
    candidates = files.where(F.arrays_overlap(_terms(F.col("text")), F.when(is_license, full_keys).otherwise(keys)))
    lines = candidates.select("id", "path", is_license.alias("is_license"), F.transform(F.split("text", "\n"), _terms).alias("lines"))
    lines = lines.withColumn("hits", F.transform("lines", lambda t: F.arrays_overlap(t, keys)))
    # Slices of lines with a key term among them, and the whole of a licence file. Places are chosen before rows are made of them,
    # so that no row holds a text's lines for each of its lines.
    places = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.exists(F.slice("hits", i, F.lit(RUN)), lambda h: h))
    slices = F.transform(places, lambda i: F.struct(F.slice("lines", i, F.lit(RUN)).alias("lines"), F.slice("hits", i, F.lit(RUN)).alias("hits"), F.lit(False).alias("whole")))
    all_lines = F.array(F.struct("lines", "hits", F.lit(True).alias("whole")))
    spans = lines.select("id", "path", "is_license", F.explode(F.when(F.col("is_license"), F.concat(slices, all_lines)).otherwise(slices)).alias("s")).select("id", "path", "is_license", "s.*")
    # A unit is a line with a key term, a run of two and more around one, or the whole. A line without a term of the notices at
    # either end only lowers a run's cosines.
    size = F.size("lines")
    spans = spans.select("*", F.explode(F.when(F.col("whole"), F.array(size)).otherwise(F.sequence(F.lit(1), size))).alias("n"))
    ends = lambda at: F.arrays_overlap(F.element_at("lines", at), of_notices)
    around = F.exists(F.slice("hits", F.lit(1), F.col("n")), lambda h: h) & ends(F.lit(1)) & ends(F.col("n"))
    spans = spans.where(F.col("whole") | F.when(F.col("n") == 1, F.col("hits")[0]).otherwise(around))
    # Clauses: what is left of a line's sentences between words that no notice has.
    inside = F.split(F.lit(" ".join(clause_words([row[2] for row in given if row[3]]))), " ")
    clauses = candidates.select("id", "path", is_license.alias("is_license"), F.explode(F.split("text", "\n")).alias("line")).where(F.arrays_overlap(_terms(F.col("line")), keys))
    sentences = F.split(F.regexp_replace("line", r"([.;!?])[ \t]+(\p{Lu})", "$1\n$2"), "\n")
    clauses = clauses.select("id", "path", "is_license", F.explode(F.transform(sentences, _terms)).alias("t")).where(F.arrays_overlap("t", keys))
    pieces = F.split(F.array_join(F.transform("t", lambda t: F.when(F.array_contains(inside, t), t).otherwise("|")), " "), r"\|")
    clauses = clauses.select("id", "path", "is_license", F.explode(F.transform(pieces, lambda p: F.split(F.trim(p), " "))).alias("terms")).where(F.arrays_overlap("terms", keys))
    units = spans.select("id", "path", "is_license", F.flatten(F.slice("lines", F.lit(1), F.col("n"))).alias("terms"), F.lit(False).alias("clause")).unionByName(clauses.withColumn("clause", F.lit(True)))
    units = staged(units.withColumn("unit", F.sha2(F.array_join("terms", " "), 256)), "units")

    # Equal units are one: a header that a third of all files carry is weighed once.
    distinct = units.groupBy("unit").agg(F.first("terms").alias("terms"))
    weighed = distinct.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n"))
    weighed = weighed.join(F.broadcast(idf.select("term", "idf")), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", rarest))
    weighed = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("unit"))))
    products = weighed.join(F.broadcast(vectors.select("template", "license", "full", "term", "v")), "term").groupBy("unit", "norm", "template", "license", "full").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    scored = products.select("unit", "template", "license", "full", F.round(F.col("s") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    scored = scored.join(F.broadcast(template.select("template", "needed", "barred")), "template").join(distinct, "unit")
    scored = scored.where((F.size(F.array_except("needed", "terms")) == 0) & ~F.arrays_overlap("barred", "terms"))
    # A header that very many files carry is dealt to no single task.
    scored = staged(scored.select("unit", "full", "score", "license"), "scored")
    declared = join_split(units.select("id", "path", "is_license", "clause", "unit"), scored, "unit", units.count()).drop("unit")
    reference = F.startswith(F.col("license"), F.lit("LicenseRef-"))
    declared = declared.where(~(F.col("clause") & reference)).select("id", "path", "is_license", "full", "score", "license", F.lit(False).alias("tag"))
    # Identifiers as they stand.
    tag = F.coalesce(_first(SPDX), _first(field_pattern(sorted({row[0] for row in given}))))
    tags = files.select("id", "path", is_license.alias("is_license"), F.lit(False).alias("full"), F.lit(1.0).alias("score"), _plain(tag).alias("license"), F.lit(True).alias("tag")).where("license is not null")
    declared = declared.unionByName(tags)
    order = [F.col("full").desc(), F.col("tag").desc(), reference, F.col("score").desc(), F.col("license")]
    rank = Window.partitionBy("id", "path").orderBy(*order)
    declared = staged(declared.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank"), "best")
    # What a file says further on tells the licences of a shared notice apart: texts are read where they lie, names are joined.
    said = F.array_join(_terms(F.col("text")), " ")
    telling = sorted({max(held.split(" "), key=len) for ways in SHARED.values() for _, held, _ in ways})
    ways = [(name, F.coalesce(*[F.when(F.contains("said", F.lit(held)) & (~F.contains("said", F.lit(missing)) if missing else F.lit(True)), F.lit(other)) for other, held, missing in ways])) for name, ways in SHARED.items()]
    told = files.where(F.lower("text").rlike("|".join(telling))).select(F.col("id").alias("id_"), F.col("path").alias("path_"), said.alias("said"))
    told = told.select("id_", "path_", F.explode(F.array(*[F.struct(F.lit(name).alias("shared"), other.alias("other")) for name, other in ways])).alias("w")).select("id_", "path_", "w.*")
    told = told.where("other is not null").groupBy("id_", "path_", "shared").agg(F.max("other").alias("other"))
    same = F.col("id").eqNullSafe(F.col("id_")) & F.col("path").eqNullSafe(F.col("path_")) & (F.col("license") == F.col("shared")) & ~F.col("full") & ~F.col("tag")
    declared = staged(declared.join(told, same, "left").withColumn("license", F.coalesce("other", "license")).drop("id_", "path_", "shared", "other"), "declared")

    # Directories of licence files, one licence each; then, per directory that a file lies in, the nearest one above.
    folder = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    place = F.row_number().over(Window.partitionBy("dir").orderBy(*order))
    licensed = declared.where("is_license").select(folder.alias("dir"), "full", "tag", "license", "score").withColumn("place", place).where("place = 1").select("dir", "license")
    dirs = files.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    lead = F.when(F.startswith(F.col("dir"), F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(lead, F.array_join(F.slice(parts, 1, n), "/"))))
    climbed = dirs.select("dir", F.posexplode(above).alias("depth", "up"))
    nearest = climbed.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "license"), "depth").alias("n"))
    inherited = nearest.select(F.col("dir").alias("dir_"), F.col("n.up").alias("up"), F.col("n.license").alias("inherited"))

    own = declared.select(F.col("id").alias("id_"), F.col("path").alias("path_"), F.col("license").alias("own"), "score")
    out = files.select("id", "path", folder.alias("dir")).join(own, F.col("id").eqNullSafe(F.col("id_")) & F.col("path").eqNullSafe(F.col("path_")), "left")
    out = out.join(inherited, F.col("dir") == F.col("dir_"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        F.coalesce("own", "inherited").alias("license"),
        "score",
        F.col("own").isNotNull().alias("declared"),
        F.when(F.col("own").isNull(), F.col("up")).alias("inherited_from"),
    )
