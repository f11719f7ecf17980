import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sparkfolio.llm import fm_index, shared, simhash, substring_dedup, vector_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- substrings -------------------------------------------------------------------------------------------------------


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 5, rng.integers(0, 12)) for _ in range(60)]
    text = np.concatenate([np.append(s, 0) for s in strings])
    index = fm_index.FMIndex(text)
    patterns = rng.integers(1, 5, (200, 3))
    low, high = index.search(patterns)
    for p, n in zip(patterns, high - low):
        assert n == sum(bool((s[i : i + 3] == p).all()) for s in strings for i in range(len(s) - 2))


def brute_substrings(rows, window=50):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORDS.findall(t or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if first.setdefault(tuple(words[s : s + window]), i) < i:
                gone.update(range(s, s + window))
        out.setdefault(i, []).append((len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return {i: sorted(v) for i, v in out.items()}


def copied_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.choice([49, 50, 51, 70, 130])) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(80)) + rng.choice(passages) + text(rng.randrange(30)) + (rng.choice(passages) if rng.random() < 0.5 else [])
        if rng.random() < 0.3 and rows:
            t = rng.choice(rows)[1].split()
            if rng.random() < 0.6 and t:
                t[rng.randrange(len(t))] = "changed"
        rows.append((i * 3 % 101, rng.choice([" ", "\n", "\t "]).join(t)))
    rows += [(500, "same " * 200), (501, "same " * 120), (502, None), (503, ""), (504, "  a b"), (505, "é " * 60), (506, "é " * 60)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed, hot):
    rows = copied_texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in substring_dedup.deduplicate(df, hot_segments=hot).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept))
    assert {i: sorted(v) for i, v in got.items()} == brute_substrings(rows)


def test_substring_edges(spark):
    df = spark.createDataFrame([(None, "x " * 60), (1, "x " * 60), (1, "x " * 60)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.deduplicate(df).collect()} == {(None, 0), (1, 0)}
    assert substring_dedup.deduplicate(df.limit(0)).count() == 0


def test_substring_ids_of_any_type_clashing_columns_and_long_texts(spark):
    passage, long = " ".join(f"p{i}" for i in range(60)), " ".join(f"w{i}" for i in range(120_000))
    rows = [("b", passage), ("a", "x y " + passage), ("c", passage + " z"), (None, passage), ("d", long), ("e", long + " end")]
    df = spark.createDataFrame(rows, "name string, body string").selectExpr("*", "1 as doc", "2 as text", "3 as seg", "4 as kept", "5 as id", "6 as n_words", "7 as `a.b`")
    got = {r.name: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(df, id_col="name", text_col="body").collect()}
    assert got == {"a": (62, 0, "x y " + passage), "b": (60, 60, ""), "c": (61, 60, "z"), None: (60, 0, passage), "d": (120_000, 0, long), "e": (120_001, 120_000, "end")}


def test_substring_query(spark, sf_dir):
    from sparkfolio.llm.queries import op2_substring_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (v[0][0], v[0][1], hashlib.sha256(v[0][2].encode()).hexdigest()) for i, v in brute_substrings(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substring_dedup(spark, sf_dir).collect()} == want


# -- fingerprints -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_position_sets_cover_any_four():
    sets = simhash.triples()
    assert len(sets) == 20 and all(any(set(s) <= set(f) for s in sets) for f in combinations(range(8), 4))


@pytest.mark.parametrize("block", [8192, 3])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    prints = set(base)
    for _ in range(120):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), block).collect()]
    want = roots(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert all(((a ^ b) & (1 << 64) - 1) for a, b in links)
    assert roots(signed, links) == want


def test_fingerprint_query(spark, sf_dir):
    from sparkfolio.llm.queries import op10_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = roots(docs, [(a, b) for a, b in combinations(docs, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_fingerprint_edges(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (7, "One two"), (8, "one TWO"), (None, "one two"), (9, "ÀB c d e"), (7, "One two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (7, 7), (8, 7), (None, 7), (9, 9), (7, 7)], key=str)
    assert simhash.fingerprint("ÀB c d e") == brute_fingerprint("ÀB c d e")
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [3, 7, 9]
    lonely = spark.createDataFrame([(None, "p q r s t u"), (None, "p q r s t u"), (None, "quite another text here"), (1, "x")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_first(lonely).collect()) == ["p q r s t u", "quite another text here", "x"]


def test_fingerprints_names_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(3, long), (2, long), (5, "another text altogether here"), (2, long)], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as kept", "4 as least", "5 as `a.b`", "6 as root")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(2, 2), (2, 2), (3, 2), (5, 5)]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.kept, r["a.b"]) for r in kept.collect()) == [(2, 3, 5), (5, 3, 5)]


# -- embeddings -------------------------------------------------------------------------------------------------------


def brute_vectors(rows, threshold):
    unit = {}
    for k, (_, v) in enumerate(rows):
        x = np.array([np.nan if a is None else a for a in v or []], float)
        if len(x) and np.isfinite(x).all() and x.any():
            unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    root = roots(range(len(rows)), links)
    members = {}
    for k, r in root.items():
        members.setdefault(r, []).append(rows[k][0])
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((rows[k][0], count[k], min(members[root[k]])) for k in range(len(rows)))


@pytest.mark.parametrize("seed,spread", [(1, 0.15), (2, 0.3)])
def test_vectors_equal_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 300)] + spread * rng.normal(size=(300, 24)) * np.linalg.norm(centres, axis=1).mean() / 5
    x[20:40] = x[19]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df, 0.9, block=64).collect())
    assert got == brute_vectors(rows, 0.9) and any(g[1] for g in got)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [1.0, 0.1]), (8, [0.0, 1.0]), (9, [0.0, 1.0]), (10, []), (11, [-inf, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect())
    assert got == brute_vectors(rows, 0.9)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
    assert vector_dedup.near_duplicates(df.where("vec_id in (3, 4)")).count() == 2


def test_tiles_equal_full_products():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 32)) * np.linspace(3, 0.2, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    found = list(vector_dedup.tile(vector_dedup.Block(x[:200], turn), vector_dedup.Block(x[200:], turn), 0.6))
    assert sorted((a, b) for p, q in found for a, b in zip(p.tolist(), q.tolist())) == sorted(map(tuple, np.argwhere(x[:200] @ x[200:].T >= 0.6).tolist()))


@pytest.mark.parametrize("seed", range(3))
def test_a_pair_at_the_threshold_is_linked_whatever_the_other_rows(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0])] + [(i, (rng.normal(size=4) * [1, -5, -5, 1]).tolist()) for i in range(2, 40)]
    out = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out[1].component_id == out[0].component_id == 0 and out[0].n_links >= 1


def test_one_dense_group_and_squares_of_tiles(spark, monkeypatch):
    """All vectors linked with all, most of them at one place of the first axis, in squares of several blocks."""
    monkeypatch.setattr(vector_dedup, "CHUNK", 1000)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(2500, 6)) * 0.01 + np.eye(6)[0], np.eye(6)[1:] * 2])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", before):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df, 0.9).collect()}
            assert all(out[i] == (2499, 0) for i in range(2500)) and all(out[i] == (0, i) for i in range(2500, 2505))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vectors_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1])], "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as node", "'x' as root", "4 as copies", "5 as n_links")
    assert sorted(map(tuple, vector_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_hot_nodes_are_split(spark):
    """A star of many leaves, stars joined by their centres, and a chain: keys above and below the limit."""
    edges = [(0, i) for i in range(1, 1500)] + [(5000, i) for i in range(2000, 2800)] + [(5000, 1499)] + [(i, i + 1) for i in range(6000, 6040)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == want


def test_split_join_equals_join(spark):
    rows = spark.range(4000).selectExpr("case when id % 3 = 0 then null when id % 2 = 0 then 7 else id % 50 end as k", "id")
    table = spark.range(0, 60).selectExpr("id as k", "id * 2 as w")
    assert sorted(map(tuple, shared.join_split(rows, table, "k", 4000).collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
