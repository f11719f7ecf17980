"""Pages and texts that Python workers take in slices: results don't depend on where one ends."""

import random

from pyspark.sql import functions as F

from sparkfolio.operators import documents, layout


def slow_lines(items):
    """Each item joins the first line it fits, all lines looked at."""
    lines = []
    for i in sorted(items, key=lambda i: i["item_no"]):
        fit = next((x for x in lines if abs(x[0] - i["baseline"]) <= i["height_pt"] * layout.LINE_TOLERANCE), None)
        fit[1].append(i["item_no"]) if fit else lines.append((i["baseline"], [i["item_no"]]))
    return sorted((b, sorted(n)) for b, n in lines)


def test_items_join_the_first_line_they_fit():
    rng = random.Random(3)
    for _ in range(200):
        items = [{"item_no": n, "baseline": rng.choice([n * 4.0, rng.random() * 90, 12.0]), "height_pt": rng.choice([5.0, 10.0, 20.0]), "height": 0.01, "left_pt": 1.0, "x": 0.1, "width": 0.1, "text": "a"} for n in range(rng.randrange(1, 40))]
        assert sorted((x["baseline"], sorted(i["item_no"] for i in x["items"])) for x in layout.lines_of(items)) == slow_lines(items)


def test_pages_go_on_over_slices(spark):
    rows = spark.range(0, 9000, 1, 1).select((F.col("id") % 3).alias("paper_id"), F.lit(1).alias("page_number"), F.col("id").alias("item_no"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    got = layout._per_page(rows, layout.PAGE, lambda r: [{"paper_id": r[0]["paper_id"], "n": len(r)}], "paper_id long, n long").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted((r.paper_id, r.n) for r in got) == [(0, 3000), (1, 3000), (2, 3000)]
    assert layout.SLICE < 3000


def test_sentences_of_more_texts_than_a_slice(spark):
    docs = spark.range(0, 3 * documents.SENTENCE_ROWS + 5, 1, 1).select(F.col("id").alias("paper_id"), F.concat(F.lit("First "), "id", F.lit(" one. Second one."))).toDF("paper_id", "text")
    got = documents.sentence_table(docs).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert len(got) == 3 * documents.SENTENCE_ROWS + 5 and {r.n for r in got} == {2}
