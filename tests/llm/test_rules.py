import itertools
import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import boilerplate, licenses, mixing, quality
from sparkfolio.llm.oracles import ORACLES
from sparkfolio.llm.queries import QUERIES, op5_quality, piece_model

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir, same_rows):
    assert same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


# -- quality ----------------------------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = WORDS.findall(text)
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n


@pytest.mark.parametrize("text", [None, "", " \n", "a b a b a b", "a\na\n\n\n a", "x# y* | <>&%$", "é " * 70, "one two three " * 30 + "four", "   a\x1cb"])
def test_base_counts(text):
    got = quality.measure(text, "en", piece_model())
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["base_failed"]) == brute_base(text)


def test_quality_query(spark, sf_dir):
    got = {r.doc_id: r for r in op5_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute_base(r.text)
        assert not (g.kept and g.base_failed)
        if labels.get(r.doc_id) == 1 and not g.base_failed:
            clean.append(g.kept)
    assert clean and all(clean)


def test_fertility_bands():
    model = piece_model()
    prose = "The committee met again in the spring and agreed that the new bridge should be built of stone, since timber had failed twice within living memory; the cost would be shared among the villages on both banks, each according to its means. Work began after the harvest, when carts and hands were free, and went on until the first snow closed the road to the quarry."
    assert quality.measure(prose, "en", model)["kept"]
    assert not quality.measure("buy " * 60 + "now " * 60, "en", model)["kept"]
    noise = " ".join(chr(0x10300 + i % 30) * 3 for i in range(80))
    assert quality.measure(noise, "en", model)["byte_share"] > 0.5 and not quality.measure(noise, "en", model)["kept"]
    groups = {"Пример текста": "greek_cyrillic", "日本語": "cjk", "한국어": "cjk", "123 !?": "none", "": "none", "ḀṀẼ": "latin", "ἀρχή": "greek_cyrillic", "שלום": "semitic_indic", "हिन्दी": "semitic_indic", "ภาษา": "semitic_indic", "Ça été": "latin"}
    assert {t: quality.script_of(t) for t in groups} == groups


def test_joint_limits_on_labelled_rows(spark, sf_dir):
    """All labelled junk that passes the base rules is rejected in each language, and at most 1 % of the clean rows."""
    large = Path(sf_dir).parent / "sf0.1"
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs.join(labels, "doc_id").repartition(8), piece_model(), carry=["lang", "quality"], out="q")
    rows = scored.where("not q.base_failed").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if("q.kept").alias("kept")).collect()
    found = {(r.lang, r.quality): (r.n, r.kept) for r in rows}
    assert set(found) == {(x, q) for x in quality.LANGUAGES for q in (0, 1)}
    for (_, good), (n, kept) in found.items():
        assert n - kept <= 0.01 * n if good else kept == 0


def test_fitted_limits_hold_on_other_rows(spark, sf_dir):
    """Limits fitted to sf0.1's labelled rows reject junk and keep clean rows of sf0.01, which are others."""
    frames = {}
    for name in ("sf0.1", "sf0.01"):
        docs, labels = (spark.read.parquet(f"{Path(sf_dir).parent / name}/{t}.parquet") for t in ("documents", "labels"))
        scored = quality.score_quality(docs.join(labels, "doc_id").repartition(8), piece_model(), carry=["lang", "quality"], out="q")
        frames[name] = scored.where("not q.base_failed").select("lang", "quality", "q.chars_per_token", "q.token_entropy", "q.n_tokens")
    limits = quality.fit_joint(frames["sf0.1"], max_rows=1500)
    assert set(limits) == set(quality.LANGUAGES)
    rows = frames["sf0.01"].toPandas()
    kept = [r.chars_per_token + limits[r.lang][0] * r.token_entropy - limits[r.lang][1] * math.log2(r.n_tokens) >= limits[r.lang][2] for r in rows.itertuples()]
    clean = rows["quality"] == 1
    assert sum(k for k, c in zip(kept, clean) if c) >= 0.97 * clean.sum() and sum(k for k, c in zip(kept, clean) if not c) <= 0.1 * (~clean).sum()


@pytest.mark.parametrize(
    "text",
    [
        "The committee met again in the spring and agreed that the new bridge should be built of stone, since timber had failed twice within living memory; the cost would be shared among the villages on both banks, each according to its means.",
        "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble whst the by for and threea. Ores the oredat the, anntly re.\nErtion on the it is onenerth edonre ontiatth ederat as on oransh of shat erre rely thha eresinger. Attireheerstsh nd lytionat edhain of hetian a estiin ndeawhst. Theastou with erhesh. Oforlyhe the atedtion hablees.",
    ],
)
def test_symbol_noise_is_rejected(text):
    model, words = piece_model(), text.split() + "and so on until all of them had gone home".split()
    kept = [quality.measure(t, "en", model, min_words=20)["kept"] for t in (" ".join(words), " ".join(w + ("%%%", "***", "###", "&&&", "$$$")[i % 5] for i, w in enumerate(words)), " | ".join(words))]
    assert kept == [True, False, False]


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, None, "q"), (2, "x " * 60, "en", "q"), (None, "", "xx", None)], "doc_id long, text string, lang string, quality string")
    out = quality.score_quality(df, piece_model())
    assert out.count() == 3 and out.columns == ["doc_id", "text", "lang", "quality"] and out.where("quality.kept").count() == 0
    assert quality.score_quality(df.limit(0), piece_model()).count() == 0


def test_fertility_equals_the_library(spark, sf_dir):
    """Tokens, characters per token, share of byte pieces, entropy and verdict, from the library's ids."""
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    spoken = {i for i in range(library.get_piece_size()) if library.is_byte(i) and library.id_to_piece(i) not in ("<0x0A>", "<0x09>", "<0x0D>")}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op5_quality(spark, sf_dir).collect():
        text, lang = docs[r.doc_id].text or "", docs[r.doc_id].lang
        ids = library.encode(text)
        times = Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in times.values())
        per_token, share = len(text) / max(1, len(ids)), sum(times[i] for i in spoken) / max(1, len(ids))
        assert r.n_tokens == len(ids) and math.isclose(r.chars_per_token, per_token) and math.isclose(r.byte_share, share, abs_tol=1e-12) and math.isclose(r.token_entropy, entropy, abs_tol=1e-9)
        band = quality.LANGUAGES[lang]
        a, b, least = band.joint
        within = band.chars_per_token[0] <= per_token <= band.chars_per_token[1] and share <= band.byte_share and band.entropy[0] <= entropy <= band.entropy[1]
        assert r.kept == (not r.base_failed and within and per_token + a * entropy - b * math.log2(len(ids)) >= least)


CLASHES = ["1 as text_", "2 as lang_", "3 as host", "4 as keys", "5 as kept", "6 as row", "7 as times", "8 as size", "9 as h", "10 as `a.b`", "11 as `start`", "12 as id", "13 as fp", "14 as least", "15 as n_tokens", "16 as source_", "17 as _kept", "18 as _text"]


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *CLASHES)


def test_quality_names_and_long_texts(spark):
    words = " ".join(f"wordlike{i} and then some other ones" for i in range(40_000))
    df = clashing(spark, [(1, words, "en", "a"), (2, None, None, None)])
    out = quality.score_quality(df, piece_model())
    assert out.columns == [*df.columns, "quality"] and {r.doc_id: r.quality.n_words for r in out.collect()} == {1: 240_000, 2: 0}
    assert out.select("`a.b`", "text_", "lang_").distinct().collect() == [(10, 1, 2)]


# -- lines ------------------------------------------------------------------------------------------------------------


def test_boilerplate_names_and_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(50_000))
    df = clashing(spark, [(i, f"Footer\nown {i}", "en", "a") for i in range(6)] + [(9, long, "en", "b")])
    out = boilerplate.drop_boilerplate(df, max_ratio=0.5)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "own 0" and (rows[9].n_lines, rows[9].n_dropped, rows[9].text) == (50_000, 0, long) and (rows[0].host, rows[0]["a.b"]) == (3, 10)


def test_boilerplate(spark):
    rows = [(i, f"own {i}\n  Footer \nFooter\n\nmore {i}", "a") for i in range(8)] + [(20, "Footer", "b"), (21, None, None), (22, "", "a"), (23, "Footer\nx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("keys", F.lit(1)).withColumn("n_lines", F.lit("old"))
    out = {r.doc_id: r for r in boilerplate.drop_boilerplate(df, max_ratio=0.5, min_pages=5).collect()}
    assert out[3].text == "own 3\n\nmore 3" and (out[3].n_lines, out[3].n_dropped) == (5, 2)
    assert out[20].text == "Footer" and out[21].text is None and out[21].n_lines == 0 and out[22].text == "" and out[23].n_dropped == 0
    assert boilerplate.drop_boilerplate(df.limit(0)).count() == 0


# -- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "c", "é", None] if i % 3 else ["hot"])) for i in range(600)]
    rows += [(601, None, "empty"), (602, "", "empty"), (None, "x y", "a"), (7, rows[7][1], rows[7][2])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        s = source[r.doc_id, r.size]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    want = brute_targets(dict(sizes), (5.0, 2.0, 1.0), 3.0)
    for s, t in want.items():
        assert math.isclose(target[s], t, rel_tol=1e-9, abs_tol=1e-6) and abs(taken[s] - t) <= 300
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_documents(spark):
    rows = [(i, "w " * 10, "a" if i < 30 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.where("source = 'a'").count() == 43 and out.where("source = 'b'").count() == 17
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_follow_the_mix(spark):
    """Names that clash, rows without ids, repeated rows and a long text: each row as often as the mix takes it."""
    rows = [(i % 50, "w " * (i % 9), "en", ["a", "b", None][i % 3]) for i in range(120)] + [(None, "x y", "en", "a"), (200, "long " * 300_000, "en", "b"), (201, None, None, None)]
    df = clashing(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.select("`a.b`", "row", "times", "size", "h", "start").distinct().collect() == [(10, 6, 7, 8, 9, 11)]
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id, r.size] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id, len(r.text.split())] += len(r.text.split())
    assert got == Counter({k: n for k, n in taken.items() if n})
    assert mixing.mixed_documents(df.limit(0)).count() == 0


# -- licences ---------------------------------------------------------------------------------------------------------


def brute_cosine(line, template, idf, rarest):
    terms = lambda t: Counter(re.findall(r"\d+(?:\.\d+)*|\w+", t.lower()))
    a, b = terms(line), terms(template)
    w = lambda c: {t: n * idf.get(t, rarest) for t, n in c.items()}
    a, b = w(a), w(b)
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(a[t] * b.get(t, 0) for t in a) / (norm(a) * norm(b)) if a else 0.0


def brute_clauses(line):
    """The longest runs of words of notices in a line's sentences."""
    known = set(licenses.clause_words([t for ts in licenses.TEMPLATES.values() for t in ts]))
    found = set()
    for sentence in re.split(r"(?<=[.;!?])[ \t]+(?=[A-Z])", line):
        found |= {" ".join(run) for is_known, run in itertools.groupby(licenses.terms_of(sentence), known.__contains__) if is_known}
    return found


def brute_license(units, templates, idf, rarest, clauses=frozenset()):
    """The best of all templates by plain cosines over all units: (is a full text, is a reference, score, name)."""
    found = []
    for unit in units:
        held = set(licenses.terms_of(unit))
        for name, text, notice in templates:
            needed, barred = licenses.marks(text, notice)
            if (name, unit in clauses) != ("LicenseRef-Proprietary", True) and set(needed) <= held and not held & set(barred) and (score := round(brute_cosine(unit, text, idf, rarest), 9)) >= 0.8:
                found.append((notice, name.startswith("LicenseRef-"), -score, name))
    return min(found, default=None)


def test_scores_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = ["Licensed under the Apache License, Version 2.0!\nmore", "Permission is hereby granted, free of charge, to any person", "Released under MIT", "", None, "GNU General Public License, version 1.", "x\n" * 20_000 + "SPDX-License-Identifier: LGPL-2.1"]
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_001 + i: t for i, t in enumerate(extra)}
    df = spark.createDataFrame([(i, t, f"d/{i}") for i, t in texts.items()], "doc_id long, text string, path string").selectExpr("*", *CLASHES, "1 as unit", "2 as terms", "3 as license")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    templates = [(n, t, True) for n, ts in licenses.TEMPLATES.items() for t in ts] + [(n, t, False) for n, ts in licenses.TEXTS.items() for t in ts]
    known = {x for _, t, _ in templates for x in licenses.terms_of(t)}
    held = Counter(t for x in texts.values() for t in set(licenses.terms_of(x or "")) & known)
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + held[t])) + 1 for t in known}
    notices = [x for x in templates if x[2]]
    for i, text in texts.items():
        lines = {line for line in (text or "").split("\n") if re.search("licen|rights|granted|released|subject|redistribution|software|gnu|cc|spdx|domain", line, re.I)}
        clauses = set().union(*map(brute_clauses, lines)) - lines
        best = brute_license(lines | clauses, notices, idf, math.log(1 + n) + 1, clauses)
        assert (got[i].license, got[i].declared) == ((best[3], True) if best else (None, False)), (i, best)
        assert best is None or math.isclose(got[i].score, -best[2], abs_tol=1e-6)
    assert got[10_006].license is None and got[10_007].license == "LGPL-2.1"


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "LICENSE", mit), (2, "src/a.py", "code"), (3, "src/lib/LICENSE.txt", apache), (4, "src/lib/deep/x.py", "code"), (5, "src/lib/y.py", mit), (6, None, "code"), (7, "z.py", None), (8, None, mit), (9, "src/a.py", "code")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = {r.doc_id: (r.license, r.declared, r.inherited_from) for r in licenses.scan(df).collect()}
    assert out == {
        1: ("MIT", True, None), 2: ("MIT", False, ""), 3: ("Apache-2.0", True, None), 4: ("Apache-2.0", False, "src/lib"), 5: ("MIT", True, None),
        6: (None, False, None), 7: ("MIT", False, ""), 8: ("MIT", True, None), 9: ("MIT", False, ""),
    }
    assert licenses.scan(df.limit(0)).count() == 0


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
BSD_HEADER = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 */
"""


def test_full_texts_and_wrapped_headers(spark):
    rows = [(i, f"{name}/LICENSE", f"{name} licence\n\nCopyright (c) 2020 Jane Doe\n\n" + texts[0]) for i, (name, texts) in enumerate(sorted(licenses.TEXTS.items()))]
    names = [r[1].split("/")[0] for r in rows]
    assert names == ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
    rows += [(30 + i, f"{name}/src/x.py", "code") for i, name in enumerate(names)]
    rows += [(20, "a/gpl.py", "#!/bin/python\n# Copyright 2020 Jane Doe\n" + GPL_HEADER + "\nimport os\n"), (21, "a/bsd.c", BSD_HEADER + "int main() { return 0; }\n")]
    rows += [(100 + i, f"b/{i}.txt", f"some words of file {i} that say nothing of the terms on which the work is given to others") for i in range(200)]
    out = {r.doc_id: (r.license, r.declared, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(names):
        assert out[i] == (name, True, None) and out[30 + i] == (name, False, name)
    assert out[20] == ("GPL-3.0", True, None) and out[21] == ("BSD-3-Clause", True, None)
    assert all(out[100 + i][0] is None for i in range(200))


WRAPPED = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as\n// published by the Free Software Foundation, either version 3 of the\n// License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Lesser General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General Public\n License as published by the Free Software Foundation; either\n version 2.1 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.",
}


BSD_TWO = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
"""
BSD_THREE = BSD_TWO + """ * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
BSD_FOUR = BSD_TWO + " * 3. All advertising materials mentioning features or use of this software\n *    must display the following acknowledgement:\n"
BOOST = "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the Software) to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works"


@pytest.mark.parametrize(
    "text,name",
    [
        (f"/* Copyright 2001 Some One\n{BSD_TWO} */\nint x;", "BSD-2-Clause"),
        (f"/* Copyright 2001 Some One\n{BSD_THREE} */\nint x;", "BSD-3-Clause"),
        (f"/* Copyright 2001 Some One\n{BSD_FOUR} */\nint x;", "BSD-4-Clause"),
        (BOOST, "BSL-1.0"),
        ("//          Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0-or-later"),
        ("/* SPDX-License-Identifier: GPL-2.0-only WITH  Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSL-1.0.\n# SPDX-License-Identifier: ISC", "(MIT OR Apache-2.0) AND BSL-1.0"),
        ("(SPDX-License-Identifier: MIT)", "MIT"),
        ("All rights reserved.\nReleased under the MIT License.", "MIT"),
        ("All rights reserved.", "LicenseRef-Proprietary"),
        ("Copyright (c) 2020 Jane Doe. All rights reserved.", None),
        ("Copyright (c) Some Corporation. All rights reserved. Licensed under the MIT License. See License.txt in the project root.", "MIT"),
        ("Foo is released under the MIT License. See the LICENSE file for details.", "MIT"),
        ("Foo is licensed under the terms of the MIT license", "MIT"),
        ("Foo is not licensed under the MIT license.", None),
        ("Released under the License", None),
        ("# License: MIT", "MIT"),
        ('{"name": "foo",\n "license": "MIT OR Apache-2.0",\n "main": "x"}', "MIT OR Apache-2.0"),
        ('license = "GPL-3.0-or-later"', "GPL-3.0-or-later"),
        ("License: see the file MIT", None),
        ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "BSD-3-Clause"),
        ("GNU General Public License, version 2", "GPL-2.0"),
        ("GNU General Public License, version 3", "GPL-3.0"),
        ("GNU General Public License, version 1", None),
        ("GNU Affero General Public License, version 3", "AGPL-3.0"),
        ("Licensed under the GNU Lesser General Public License v3", "LGPL-3.0"),
        ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0"),
        ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        *[(f"/* Copyright 2001 Some One\n *\n{t}\n */\nint x;", n) for n, t in WRAPPED.items()],
    ],
)
def test_siblings_are_told_apart(spark, probes, text, name):
    assert probes[text] == name


@pytest.fixture(scope="module")
def probes(spark):
    """One scan of all probes among files that say nothing."""
    texts = [p.values[0] if hasattr(p, "values") else p[0] for p in test_siblings_are_told_apart.pytestmark[0].args[1]]
    rows = [(i, f"f/{i}.c", t) for i, t in enumerate(texts)] + [(1000 + i, f"b/{i}.txt", f"some words of file {i} that say nothing of the terms on which the work is given to others") for i in range(200)]
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    return {t: found[i] for i, t in enumerate(texts)}


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, rows = [], docs
    for name, stage in pipeline.STAGES:
        rows = pipeline.staged(stage(spark, rows, sf_dir), "test")
        if name != pipeline.STAGES[-1][0]:
            assert sorted(rows.columns) == sorted(docs.columns)
        names.append(rows.count())
    assert names[0] >= names[2] > 0 and names[3] == names[4]
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, rows.collect()))


def test_pipeline_edges(spark, sf_dir, tmp_path):
    """No rows at all, only rows that go, nulls in all columns, a very long text, and names that the operators use themselves."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = docs.where("lang = 'en' and length(text) > 2000").orderBy("doc_id").limit(3)
    long = good.limit(1).selectExpr("cast(9000001 as bigint) as doc_id", "repeat(concat(text, '\\n'), 400) as text", "lang", "source", "n_chars")
    nulls = spark.createDataFrame([(None, None, None, None, None), (9_000_002, "", None, None, 0)], docs.schema)
    for name, rows in {"empty": docs.limit(0), "gone": nulls, "all": good.unionByName(good).unionByName(long).unionByName(nulls)}.items():
        rows.selectExpr("*", *CLASHES, "0 as quality", "0 as n_lines").write.parquet(str(tmp_path / name / "documents.parquet"))
        out = pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) > 0) == (name == "all") and all(r.doc_id is not None for r in out)


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    """Each stage's rows from the rows before, by plain Python."""
    from test_dedup import brute_fingerprint, roots

    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.doc_id: r.kept for r in op5_quality(spark, sf_dir).collect()}
    rows = {r.doc_id: r for r in docs.collect()}

    kept = pipeline.staged(stages["quality rules"](spark, docs, sf_dir), "test")
    assert {r.doc_id: r for r in kept.collect()} == {i: r for i, r in rows.items() if scored[i]}

    before = kept.collect()
    bare = lambda x: x.strip(" \t\x0b\x0c\r")
    pages, totals = Counter(), Counter(r.source for r in before)
    for r in before:
        pages.update((r.source, x) for x in {bare(x) for x in r.text.split("\n")} if x)
    often = {k for k, n in pages.items() if n >= 5 and n > 0.05 * totals[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, bare(x)) not in often) for r in before}
    lines = pipeline.staged(stages["line dedup"](spark, kept, sf_dir), "test")
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in want.items()}

    prints = {i: brute_fingerprint(t) for i, t in want.items()}
    root = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    single = pipeline.staged(stages["near-dedup"](spark, lines, sf_dir), "test")
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, r in root.items() if i == r)

    sizes = Counter()
    for r in single.collect():
        sizes[r.source] += len(WORDS.findall(r.text))
    target = brute_targets(dict(sizes), (5.0, 2.0, 1.0), 3.0)
    mixed, taken, times = pipeline.staged(stages["mixing"](spark, single, sf_dir), "test"), Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(WORDS.findall(r.text))
        times[r.doc_id] += 1
    longest = Counter()
    for r in single.collect():
        longest[r.source] = max(longest[r.source], len(WORDS.findall(r.text)))
    assert max(times.values()) <= 3 and all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in target.items())
    assert stages["encoding"](spark, mixed, sf_dir).count() == mixed.count()


def test_time_of_line_dedup_grows_with_the_lines(spark):
    """Hosts with very many boilerplate lines: each line looks into one bucket, not at all of them."""
    import time

    def took(lines):
        rows = [(i, "h", "\n".join(f"line {k} of the host" for k in range(lines)) + f"\nown {i}") for i in range(6)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        start = time.perf_counter()
        kept = boilerplate.drop_boilerplate(df).collect()
        assert sorted((r.text, r.n_dropped) for r in kept) == [(f"own {i}", lines) for i in range(6)]
        return time.perf_counter() - start

    took(10)
    few, many = took(2_000), took(32_000)
    assert many < 16 * few + 5
