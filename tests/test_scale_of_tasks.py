"""Shares of a task that stay the same as tables grow, and ties that don't depend on how rows were dealt."""

from pyspark.sql import functions as F

from sparkfolio.operators import graphs
from sparkfolio.plans import parts


def test_cooccurrence_deals_more_rows_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "TASK_ROWS", 50)
    rows = spark.range(1000).select((F.col("id") % 7).alias("tag_id"), (F.col("id") % 90).alias("paper_id"))
    out = graphs.cooccurrence(rows)
    assert "hashpartitioning(paper_id" in out._jdf.queryExecution().toString() and ", 20)" in out._jdf.queryExecution().toString()
    baskets = {}
    for r in rows.distinct().collect():
        baskets.setdefault(r.paper_id, set()).add(r.tag_id)
    want = {(a, b): sum(a in s and b in s for s in baskets.values()) for a in range(7) for b in range(a + 1, 7)}
    assert {(r.a, r.b): r.weight for r in out.collect()} == want


def test_of_tied_lines_the_first_of_the_file_counts(spark, tmp_path):
    import duckdb

    # Line 1 twice with one part: only its first row ends a sentence on a short line, in each of 300 orders.
    line = "SELECT k AS l_orderkey, 7 AS l_partkey, {s} AS l_suppkey, {n}::INT AS l_linenumber, {q}::DOUBLE AS l_quantity, {o} + k * 10 AS o FROM range(300) t(k)"
    rows = " UNION ALL ".join([line.format(s=1, n=1, q=40, o=0), line.format(s=9, n=1, q=1, o=5000), line.format(s=9, n=2, q=1, o=1)])
    duckdb.sql(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber, l_quantity FROM ({rows}) ORDER BY o % 2, hash(o)) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    at = duckdb.sql(f"SELECT l_orderkey, min_by(l_quantity, file_row_number) FROM read_parquet('{tmp_path}/lineitem.parquet', file_row_number=true) WHERE l_linenumber = 1 GROUP BY 1").fetchall()
    want = {k: int(q > 25) for k, q in at}
    assert 0 < sum(want.values()) < 300
    for n in ("3", "7"):
        held = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{n}k")
        got = {r.paper_id: r.paragraph for r in parts.paragraph_breaks(spark, str(tmp_path)).where("line_no = 2").collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        assert got == want
