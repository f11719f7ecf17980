"""Search as a table function: the words asked are sent to the postings, whatever size Spark guesses for them."""

from sparkfolio.operators import keyword_index
from sparkfolio.sources import catalog


def test_words_asked_are_broadcast(spark, tmp_path):
    index = keyword_index.build(spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "id long, text string"), f"file://{tmp_path}/index")
    catalog.keyword_search(spark, index, "planned_search")
    spark.createDataFrame([(7, "b c")], "q long, question string").createOrReplaceTempView("planned_questions")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spark.sql("SELECT q.q, f.id FROM planned_questions q, LATERAL planned_search(q.question) f")
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2
        assert {r.id for r in out.collect()} == {1, 2, 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
