"""SQL access: a library's tables and its keyword index as views, and ranked search as a table function, or for a view of questions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkfolio.functions.text import ACCENTED, PLAIN
from sparkfolio.operators.keyword_index import Stored
from sparkfolio.operators.search import K1, PER_SOURCE, B
from sparkfolio.sources.versions import Snapshot


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tables(snapshot: Snapshot, prefix: str = "") -> list[str]:
    """A view for each table of a version, and ``<prefix>_tables`` with names, versions, rows and files; the names of all."""
    names = []
    for name in snapshot.names():
        snapshot.table(name).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    known = snapshot.files().selectExpr("name", f"{snapshot.version} as version", "rows", "path").groupBy("name", "version")
    known.agg({"rows": "sum", "path": "count"}).toDF("name", "version", "n_rows", "n_files").createOrReplaceTempView(f"{prefix}_tables")
    return [*names, f"{prefix}_tables"]


def _views(spark: SparkSession, index: Stored, name: str) -> None:
    index.terms.createOrReplaceTempView(f"{name}_terms")
    spark.range(1).selectExpr(f"{index.n} as n", f"cast({index.total} as double) / greatest({index.n}, 1) as average").createOrReplaceTempView(f"{name}_totals")


def _tokens(question: str) -> str:
    plain = f"translate(regexp_replace(lower({question}), '[\\\\u0300-\\\\u036F]', ''), {_text(ACCENTED + 'ſς')}, {_text(PLAIN + 'sσ')})"
    return f"filter(split({plain}, '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> '')"


_IDF = "greatest(1e-6D, ln((t.n - d.df + 0.5D) / (d.df + 0.5D)))"
_SCORE = f"round(-sum(w.idf * p.tf * {K1 + 1}D / (p.tf + {K1}D * ({1 - B}D + {B}D * p.length / w.average))), 6)"


def keyword_search(spark: SparkSession, index: Stored, name: str = "keyword_search", most: int = PER_SOURCE) -> None:
    """Makes ``SELECT * FROM <name>(question)`` callable from SQL: rows (id, score, rank) of the ``most`` best rows of the index, lower
    scores first; and views ``<name>_terms``, ``<name>_postings`` and ``<name>_totals`` of what it reads.

    Words of the question are single tokens here, each as often as it stands; the index stays as it was when it was opened.
    The words asked are few and are sent to all tasks, so that postings and terms are filtered where they are read.
    """
    _views(spark, index, name)
    index.postings.select("token", "id", "tf", "length").createOrReplaceTempView(f"{name}_postings")
    id_type = index.postings.schema["id"].dataType.simpleString()
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(question STRING) RETURNS TABLE (id {id_type}, score DOUBLE, rank INT) RETURN
        WITH words AS (SELECT token, count(*) AS times FROM (SELECT explode({_tokens(f'{name}.question')}) AS token) GROUP BY token),
        weighed AS (SELECT /*+ BROADCAST(w) */ w.token, w.times * {_IDF} AS idf, t.average FROM words w JOIN {name}_terms d ON d.token = w.token CROSS JOIN {name}_totals t),
        scored AS (SELECT /*+ BROADCAST(w) */ p.id, {_SCORE} AS score FROM weighed w JOIN {name}_postings p ON p.token = w.token GROUP BY p.id),
        ranked AS (SELECT id, score, row_number() OVER (ORDER BY score, id) AS rank FROM scored)
        SELECT id, score, rank FROM ranked WHERE rank <= {most}""")


#: Rows whose scores one task sums up.
TASK_ROWS = 2048


def keyword_searches(spark: SparkSession, index: Stored, questions: str, name: str = "keyword_searches", most: int = PER_SOURCE) -> None:
    """Makes a view ``<name>``: rows (query_id, id, score, rank) of what ``keyword_search`` finds for each row (query_id, question) of the view
    ``questions``; and views ``<name>_terms``, ``<name>_blocks``, ``<name>_totals`` and, if later segments replace rows, ``<name>_gone``.

    Postings are dealt once, packed as they are stored, by the blocks of rows that they belong to.  So a row's scores are summed up in the task
    that its block is dealt to, and only each question's best of a task are dealt by question.
    """
    _views(spark, index, name)
    index.blocks.select("token", "segment", "block", "ids", "tfs", "lengths").createOrReplaceTempView(f"{name}_blocks")
    if (gone := index.gone()) is not None:
        gone.createOrReplaceTempView(f"{name}_gone")
    left = f"LEFT ANTI JOIN {name}_gone g ON g.segment = p.segment AND g.block = p.block AND g.id = p.id" if gone is not None else ""
    blocks = sum(s.blocks for s in index.segments)
    tasks = max(-(-index.n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, blocks))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {name} AS
        WITH words AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, explode({_tokens('question')}) AS token FROM {questions}) GROUP BY query_id, token),
        weighed AS (SELECT /*+ BROADCAST(w) */ w.query_id, w.token, w.times * {_IDF} AS idf, t.average FROM words w JOIN {name}_terms d ON d.token = w.token CROSS JOIN {name}_totals t),
        asked AS (SELECT DISTINCT token FROM weighed),
        dealt AS (SELECT /*+ REPARTITION({tasks}, block) */ * FROM (SELECT /*+ BROADCAST(a) */ b.* FROM {name}_blocks b LEFT SEMI JOIN asked a ON a.token = b.token)),
        single AS (SELECT token, segment, block, inline(arrays_zip(ids, tfs, lengths)) AS (id, tf, length) FROM dealt),
        scored AS (SELECT /*+ BROADCAST(w) */ w.query_id, p.segment, p.block, p.id, {_SCORE} AS score FROM single p JOIN weighed w ON p.token = w.token GROUP BY w.query_id, p.segment, p.block, p.id),
        ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM scored p {left})
        SELECT query_id, id, score, rank FROM ranked WHERE rank <= {most}""")
