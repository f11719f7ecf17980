import random
import re
from collections import Counter

import pytest

from sparkfolio.llm import collocations as C

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_reading(rows, least=30, longest=4, subsumed_percent=80, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(SMALL)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            own.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= subsumed_percent * f[q := p[i : i + m]]}
        ranked = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["a", "B", "c", "é", "İ", "日", "d e", "f\tg", "x.y", "o,", "\n", "\xa0", "\x0b", "'", "A", "a", "a", "bb"]
    some = [(rng.choice(["x", None, "und", "y"]), None if rng.random() < 0.02 else " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 10, 200])))) for _ in range(250)]
    return some + some[:60] + [("x", "la " * 40_000)]  # repeated rows, and a very long text


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as f", "3 as word", "4 as n").repartition(5)


@pytest.mark.parametrize("rules", [{}, {"least": 5, "longest": 5, "subsumed_percent": 50, "top": 7}, {"least": 1, "longest": 3, "subsumed_percent": 100, "top": None}])
def test_against_plain_reading(frame, rows, rules):
    got = sorted(map(tuple, C.collocations(frame, **rules).collect()))
    assert got == plain_reading(rows, **(rules | ({"top": 10**9} if "top" in rules and rules["top"] is None else {})))


def test_full_filters_give_the_same(frame, rows):
    """Filters of one row let nearly all through."""
    old = C.LEAST_BITS
    C.LEAST_BITS = C.ROW_BITS
    try:
        got = sorted(map(tuple, C.collocations(frame, least=2, most_bits=C.ROW_BITS).collect()))
    finally:
        C.LEAST_BITS = old
    assert got == plain_reading(rows, least=2)


def test_shards(rows):
    """Many small automata, and one, count the same."""
    import numpy as np
    import pyarrow as pa

    everything = np.full(C.LEAST_BITS // 8, 255, np.uint8)
    batches = [pa.RecordBatch.from_arrays([pa.array([t for _, t in rows[i : i + 40]]), pa.array([lang or "und" for lang, _ in rows[i : i + 40]])], names=["text", "lang"]) for i in range(0, len(rows), 40)]

    def counted():
        found = Counter()
        for batch in C._phrase_rows(iter(batches), everything, everything, 4):
            for r in batch.to_pylist():
                found[r["lang"], r["phrase"]] += r["f"]
        return found

    one, old = counted(), (C.SHARD_WORDS, C.TASK_BYTES)
    C.SHARD_WORDS, C.TASK_BYTES = 1, 100
    try:
        assert counted() == one and len(one) > 1000
    finally:
        C.SHARD_WORDS, C.TASK_BYTES = old


def test_automaton_counts_end_positions():
    rng = random.Random(2)
    for _ in range(200):
        sequences = [([rng.randint(1, 3) for _ in range(rng.randint(1, 12))], rng.randint(1, 3)) for _ in range(rng.randint(1, 6))]
        automaton, want = C.Automaton(), Counter()
        for sequence, times in sequences:
            automaton.insert(sequence, times)
            for m in range(2, 5):
                for i in range(len(sequence) - m + 1):
                    want[tuple(sequence[i : i + m])] += times
        found = [(tuple(automaton.symbols[a:b]), n) for a, b, n in automaton.phrases(2, 4)]
        assert len(found) == len(want) and dict(found) == want  # each once


def test_products_beyond_64_bits(spark):
    big = 5 * 10**18
    phrases = spark.createDataFrame([("x", "a b", big), ("x", "a b c", big // 5 * 4), ("x", "b c", big // 5 * 4)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("x", w, big // 4) for w in "abc"], "lang string, word string, f long")
    scored = {r.phrase: (r.a, r.l, r.r, r.score) for r in C.score(phrases, words, 30, 101).collect()}
    assert scored["a b"] == (big, big // 4, big // 4, 4_000_000)
    assert scored["a b c"] == (big // 5 * 4, big, big // 4, 2000000 * (big // 5 * 4) // (big + big // 4))
    # Just 80 % of the occurrences are enough to leave the shorter phrases out.
    assert {r.phrase for r in C.score(phrases, words, 30, 80).collect()} == {"a b c"}


def test_empty_table(frame):
    assert C.collocations(frame.limit(0)).count() == 0


def test_query(spark, duck, sf_dir, same_rows):
    from sparkfolio.llm.oracles import ORACLES
    from sparkfolio.llm.queries import op13_collocations

    got = op13_collocations(spark, sf_dir)
    assert same_rows(got.toPandas(), duck.sql(ORACLES["op13_collocations"]).df())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    assert sorted(map(tuple, got.collect())) == plain_reading(docs)
