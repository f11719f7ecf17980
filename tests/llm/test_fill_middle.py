import hashlib
import random
from collections import Counter

import pytest

from sparkfolio.llm import fill_middle as M


def plain_reading(doc_id, text, rules=M.Rules()):
    text = text or ""
    digest = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    g = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    i, j = sorted((g[0] % (n + 1), g[1] % (n + 1)))
    p, s, m = rules.prefix_mark, rules.suffix_mark, rules.middle_mark
    if not text or any(mark in text for mark in (p, s, m)) or g[2] % 100 >= rules.plain_from:
        return n, "plain", None, None, text
    if g[3] % 100 < rules.suffix_first:
        return n, "spm", i, j - i, s + text[j:] + p + text[:i] + m + text[i:j]
    return n, "psm", i, j - i, p + text[:i] + s + text[j:] + m + text[i:j]


def rows_for(seed):
    rng = random.Random(seed)
    signs = ["a", "é", "日", "😀", "\n", "<", "<P", "S>", "M>", " ", "́", "\x00", "\r\n", "<S>", "🤦🏼‍♂️", " "]
    rows = [(k, "".join(rng.choices(signs[: rng.randint(1, 16)], k=rng.choice([0, 1, 2, 5, 255, 256, 257, 512, 700])))) for k in range(1500)]
    return [*rows, (None, "abc def"), (7, None), (7, None), (8, "x" * 3_000_000), (9, "<P>")]


@pytest.mark.parametrize("rules", [M.Rules(), M.Rules(seed="again", prefix_mark="<a>", suffix_mark="<bb>", middle_mark="<c", plain_from=50, suffix_first=60)])
def test_against_plain_reading(spark, rules):
    rows = rows_for(5)
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "doc.id").selectExpr("*", "1 as n", "'z' as form", "'o' as output")
    turned = M.fill_middle(df, rules, id_col="doc.id")
    assert Counter(map(tuple, turned.collect())) == Counter((d, *plain_reading(d, t, rules)) for d, t in rows)
    assert Counter(map(tuple, M.restore(turned, rules, id_col="doc.id").collect())) == Counter((d, t or "") for d, t in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_middle(df).count() == 0 and M.digests(df).count() == 0


def test_marks_that_could_arise_elsewhere_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("aXa", "aY", "aZ"), ("<P>", "[S]", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.Rules(prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


def test_query(spark, duck, sf_dir, same_rows):
    from sparkfolio.llm.oracles import ORACLES
    from sparkfolio.llm.queries import op12_fill_middle

    got = op12_fill_middle(spark, sf_dir)
    assert same_rows(got.toPandas(), duck.sql(ORACLES["op12_fill_middle"]).df())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got.collect():
        n, form, prefix, middle, output = plain_reading(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, digest(output), digest(texts[r.doc_id]))
