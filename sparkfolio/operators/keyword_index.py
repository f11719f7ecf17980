"""A stored keyword index: tokens with the rows that hold them, written once, refreshed by segments, read by searches.

A segment is written once and holds

* ``postings``: a token's postings in blocks (token, block, ids, tfs, lengths, positions, max_tf, min_length).  A block has the rows
  whose ids' hashes fall together, about BLOCK_ROWS, the same for all tokens: what one token's block can add to a score is bounded by its
  largest tf and least length, what a row can reach by the sum of the bounds of its block, and a row's other postings are met by an
  equi-join on (token, segment, block).  Files are dealt by ranges of tokens.
* ``rows``: (id, length, words), the distinct tokens of each row;
* ``replaced``: ids whose rows in earlier segments no longer count;
* ``terms``: (token, df, max_tf, min_length), where df is a difference: rows that the segment adds less rows that it takes away.

``state`` has one version per commit: the segments that count, in order, and the totals.  It is written last, so a reader sees a
commit whole or not at all.  Segments are merged as they come, so that each is at least MERGE times as large as all later ones
together: their number grows with the logarithm of the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import strip_accents

#: Postings that a file holds, about, and rows of a block.
FILE_ROWS, BLOCK_ROWS = 5_000_000, 128
#: Times as many rows as all later segments together have.
MERGE = 2


def tokens(c: Column) -> Column:
    """Maximal runs of letters, digits and their marks, in lower case, without accents."""
    return F.filter(F.split(strip_accents(F.lower(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    split = docs.select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))
    return split.withColumn("length", F.size("tokens"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (token, id, tf, length, positions) of all rows: a token's positions in a text of ``length`` tokens, ascending."""
    each = _tokenized(docs, id_col, text_col).select("id", "length", F.posexplode("tokens").alias("pos", "token"))
    return each.groupBy("token", "id", "length").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("token", "id", F.size("positions").alias("tf"), "length", "positions")


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, length) of all rows, those without a token included."""
    return _tokenized(docs, id_col, text_col).select("id", "length")


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, words) of all rows: the distinct tokens of each."""
    return _tokenized(docs, id_col, text_col).select("id", F.array_distinct("tokens").alias("words"))


@dataclass(frozen=True)
class Keywords:
    """What a search reads: postings, and one row (N, total) with the number of rows and of all their tokens."""

    postings: DataFrame
    totals: DataFrame


def of_rows(docs: DataFrame, id_col: str, text_col: str) -> Keywords:
    """Keywords of rows that no index holds: each search reads all texts."""
    rows = lengths(docs, id_col, text_col)
    return Keywords(postings(docs, id_col, text_col), rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")))


@dataclass(frozen=True)
class Segment:
    """number: its folder; place: its order; rows: what it adds or replaces; blocks: of its postings."""

    number: int
    place: int
    rows: int
    blocks: int


@dataclass(frozen=True)
class Stored(Keywords):
    """An index as one commit left it; later commits don't touch what it reads."""

    folder: str
    version: int
    segments: tuple[Segment, ...]
    n: int
    total: int

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def _read(self, name: str) -> DataFrame:
        return _read(self.spark, self.folder, name, self.segments)

    @property
    def terms(self) -> DataFrame:
        """Rows (token, df, max_tf, min_length) of tokens that some row holds; the bounds may be those of rows that are gone."""
        rows = self._read("terms")
        if len(self.segments) > 1:
            rows = rows.groupBy("token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
        return rows.where(F.col("df") > 0).select("token", "df", "max_tf", "min_length")

    @property
    def blocks(self) -> DataFrame:
        """Postings in blocks, with those of rows that no longer count."""
        return self._read("postings")

    @property
    def rows(self) -> DataFrame:
        """Rows (id, length, words, segment) that count."""
        return self.live(self._read("rows"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, segment, ...) without those that a later segment replaces."""
        return _live(self.spark, self.folder, rows, self.segments)

    def gone(self) -> DataFrame | None:
        """Rows (segment, block, id) of ids that later segments replace; None if there is but one segment."""
        if len(self.segments) < 2:
            return None
        later = _read(self.spark, self.folder, "replaced", self.segments[1:]).groupBy("id").agg(F.max(_by_segment(self.segments, "place")).alias("by"))
        earlier = [later.where(F.col("by") > s.place).select(F.lit(s.number).alias("segment"), F.pmod(F.xxhash64("id"), F.lit(s.blocks)).alias("block"), "id") for s in self.segments[:-1]]
        return together(earlier)

    def block(self, id_col: str = "id", segment: str = "segment") -> Column:
        """The block that holds an id, by its segment."""
        return F.pmod(F.xxhash64(id_col), _by_segment(self.segments, "blocks", segment))


def together(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _by_segment(segments: Iterable[Segment], what: str, segment: str = "segment") -> Column:
    pairs = [F.lit(x) for s in segments for x in (s.number, getattr(s, what))]
    return F.element_at(F.create_map(*pairs), F.col(segment))


def _read(spark: SparkSession, folder: str, name: str, segments: Iterable[Segment]) -> DataFrame:
    """A table of several segments, with their numbers."""
    return together([spark.read.parquet(f"{folder}/{name}/{s.number}").withColumn("segment", F.lit(s.number)) for s in segments])


def _live(spark: SparkSession, folder: str, rows: DataFrame, segments: tuple[Segment, ...]) -> DataFrame:
    if len(segments) < 2:
        return rows
    later = _read(spark, folder, "replaced", segments[1:]).groupBy(F.col("id").alias("id_")).agg(F.max(_by_segment(segments, "place")).alias("by"))
    return rows.join(later, (F.col("id") == F.col("id_")) & (_by_segment(segments, "place") < F.col("by")), "left_anti")


def _blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def _write_blocks(packed: DataFrame, path: str, total: int) -> None:
    parts = max(1, min(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 100_000)), -(-total // FILE_ROWS))
    packed.repartitionByRange(parts, "token", "block").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(path)


def _write_texts(docs: DataFrame, path: str, blocks: int, total: int, id_col: str, text_col: str) -> None:
    """Writes the postings of texts in blocks: a block's texts meet in one group, so single postings aren't shuffled."""
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).alias("block")).repartition("block").sortWithinPartitions("block")
    split = dealt.select("block", "id", tokens(F.col("text")).alias("tokens"))
    kind = split.schema["id"].dataType.simpleString()
    schema = f"token string, block long, ids array<{kind}>, tfs array<int>, lengths array<int>, positions array<array<int>>, max_tf int, min_length int"
    _write_blocks(split.groupBy("block").applyInArrow(_pack_block, schema), path, total)


def _pack_block(rows: pa.Table) -> pa.Table:
    """Postings of one block of rows (block, id, tokens), ids and positions ascending."""
    rows = rows.filter(pc.is_valid(rows.column("tokens"))).sort_by("id").combine_chunks()
    lists = rows.column("tokens").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(code, kind="stable")  # by token, then by id and position
    code, row, place = code[order], row[order], place[order]
    new_token = np.diff(code, prepend=-1) != 0
    first = np.flatnonzero(new_token | (np.diff(row, prepend=-1) != 0))  # of each posting
    ends = np.append(first, len(code))
    tf, held, length = np.diff(ends).astype(np.int32), row[first], lengths[row[first]]
    start = np.flatnonzero(new_token[first])  # of each token, in postings
    offsets = pa.array(np.append(start, len(first)), pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
    ids = rows.column("id").take(pa.array(held, pa.int64())).combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    columns = {
        "token": words.dictionary.take(pa.array(code[first][start], pa.int64())), "block": pa.array(np.full(len(start), rows.column("block")[0].as_py() if len(start) else 0), pa.int64()),
        "ids": listed(ids), "tfs": listed(pa.array(tf, pa.int32())), "lengths": listed(pa.array(length, pa.int32())), "positions": listed(positions),
        "max_tf": pa.array(np.maximum.reduceat(tf, start) if len(start) else [], pa.int32()), "min_length": pa.array(np.minimum.reduceat(length, start) if len(start) else [], pa.int32()),
    }
    return pa.table(columns)


def _write_postings(each: DataFrame, path: str, blocks: int, total: int) -> None:
    """Writes postings (token, id, length, positions) in blocks."""
    hashed = each.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    sorted_ = F.sort_array(F.collect_list(F.struct("id", F.size("positions").alias("tf"), "length", "positions"))).alias("p")
    packed = hashed.groupBy("token", "block").agg(sorted_).select(
        "token", "block", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"), F.col("p.positions").alias("positions"),
        F.array_max("p.tf").alias("max_tf"), F.array_min("p.length").alias("min_length"),
    )
    _write_blocks(packed, path, total)


def _term_rows(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Rows (token, df, max_tf, min_length) of a segment's own postings."""
    rows = spark.read.parquet(f"{folder}/postings/{number}")
    return rows.groupBy("token").agg(F.sum(F.size("ids")).cast("long").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))


def _write_terms(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def _commit(spark: SparkSession, folder: str, version: int, segments: list[Segment], n: int, total: int) -> None:
    """Writes the state that a reader of this version sees."""
    rows = [(s.number, i, s.rows, s.blocks, n, total) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, "number int, place int, rows long, blocks long, n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/version={version}")


def _state(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[Segment], int, int]:
    rows = spark.read.parquet(f"{folder}/state")
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    found = sorted(rows.where(F.col("version") == version).collect(), key=lambda r: r.place)
    return version, [Segment(r.number, r.place, r.rows, r.blocks) for r in found], found[0].n, found[0].total


def _write_segment(docs: DataFrame, folder: str, number: int, id_col: str, text_col: str) -> tuple[int, int]:
    """Writes rows and postings of a segment: the numbers of its rows and of all their tokens."""
    spark = docs.sparkSession
    split = _tokenized(docs, id_col, text_col)
    split.select("id", "length", F.array_distinct("tokens").alias("words")).write.mode("overwrite").parquet(f"{folder}/rows/{number}")
    n, total = spark.read.parquet(f"{folder}/rows/{number}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    _write_texts(docs, f"{folder}/postings/{number}", _blocks_for(n), total, id_col, text_col)
    return n, total


def build(docs: DataFrame, folder: str, id_col: str = "id", text_col: str = "text") -> Stored:
    """Writes the index of all rows to a new folder and opens it. Null and empty texts count as rows without tokens."""
    spark = docs.sparkSession
    n, total = _write_segment(docs, folder, 0, id_col, text_col)
    docs.select(F.col(id_col).alias("id")).limit(0).write.mode("overwrite").parquet(f"{folder}/replaced/0")
    _write_terms(_term_rows(spark, folder, 0), f"{folder}/terms/0")
    _commit(spark, folder, 0, [Segment(0, 0, n, _blocks_for(n))], n, total)
    return opened(spark, folder)


def refresh(docs: DataFrame, folder: str, id_col: str = "id", text_col: str = "text", gone: DataFrame | None = None, merge: bool = True) -> Stored:
    """Puts rows in place of those with the same ids, or adds them, takes the rows of the ids in ``gone`` away, and opens the index as it
    is then.  A row with a null text stays counted as a row without tokens.

    Totals and the terms' df change by the difference between new rows and those that they replace; what else the index holds is not
    read.  Afterwards segments are merged, unless ``merge`` is off.
    """
    spark = docs.sparkSession
    version, segments, n, total = _state(spark, folder)
    before = opened(spark, folder, version)
    number = 1 + max(s.number for s in segments)
    added, added_total = _write_segment(docs, folder, number, id_col, text_col)
    ids = docs.select(F.col(id_col).alias("id"))
    if gone is not None:
        ids = ids.unionByName(gone.select(F.col(id_col if id_col in gone.columns else "id").alias("id")))
    ids.distinct().write.mode("overwrite").parquet(f"{folder}/replaced/{number}")
    old = before.rows.join(spark.read.parquet(f"{folder}/replaced/{number}"), "id", "left_semi")
    taken = old.select(F.explode("words").alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
    differences = _term_rows(spark, folder, number).unionByName(taken.selectExpr("token", "df", "0 as max_tf", "cast(null as int) as min_length"))
    summed = differences.groupBy("token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    _write_terms(summed, f"{folder}/terms/{number}")
    lost, lost_total = old.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    changed = spark.read.parquet(f"{folder}/replaced/{number}").count()
    segments.append(Segment(number, len(segments), changed, _blocks_for(added)))
    _commit(spark, folder, version + 1, segments, n + added - lost, total + added_total - lost_total)
    return merged(spark, folder) if merge else opened(spark, folder)


def merged(spark: SparkSession, folder: str) -> Stored:
    """Merges the last segments as long as one has fewer than MERGE times the rows of all later ones, and opens the index.

    Each row is thus written again as often as the logarithm of their number; older segments aren't read.
    """
    version, segments, n, total = _state(spark, folder)
    first = len(segments) - 1
    later = segments[-1].rows
    for i in range(len(segments) - 2, -1, -1):
        if segments[i].rows < MERGE * later:
            first = i
        later += segments[i].rows
    if first == len(segments) - 1:
        return opened(spark, folder)
    all_, some = tuple(segments), segments[first:]
    number = 1 + max(s.number for s in segments)
    rows = _live(spark, folder, _read(spark, folder, "rows", some), all_).drop("segment")
    rows.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
    count, size = spark.read.parquet(f"{folder}/rows/{number}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    each = _live(spark, folder, _postings_of(_read(spark, folder, "postings", some), ["positions"]), all_)
    _write_postings(each.select("token", "id", "length", "positions"), f"{folder}/postings/{number}", _blocks_for(count), size)
    # What the merged segments replace matters to the segments before them only.
    replaced = _read(spark, folder, "replaced", some).select("id").distinct()
    (replaced if first else replaced.limit(0)).write.mode("overwrite").parquet(f"{folder}/replaced/{number}")
    terms = _read(spark, folder, "terms", some).groupBy("token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    _write_terms(terms.where(F.col("df") != 0), f"{folder}/terms/{number}")
    held = max(count, spark.read.parquet(f"{folder}/replaced/{number}").count())
    _commit(spark, folder, version + 1, [*segments[:first], Segment(number, first, held, _blocks_for(count))], n, total)
    return opened(spark, folder)


def _postings_of(blocks: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Single postings (token, segment, block, id, tf, length) of blocks."""
    each = F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"), *[F.col(c) for c in more])
    return blocks.select("token", "segment", "block", F.inline(each))


def opened(spark: SparkSession, folder: str, version: int | None = None) -> Stored:
    """The index in a folder, as the last commit left it, or an earlier one."""
    version, segments, n, total = _state(spark, folder, version)
    segments = tuple(segments)
    each = _live(spark, folder, _postings_of(_read(spark, folder, "postings", segments), ["positions"]), segments)
    return Stored(each.select("token", "id", "tf", "length", "positions"), spark.createDataFrame([(n, total)], "N long, total long"), folder, version, segments, n, total)


#: Distinct tokens of all searches up to which they are sent to the scan as values.
PUSHED = 1000


def holding(keywords: Keywords, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Postings of the tokens in ``wanted`` (column token): few tokens are a filter of the scan, many a semi-join."""
    return having(keywords.postings.select(*columns), wanted)


def having(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (token, ...) of the tokens in ``wanted``: few tokens are a filter of the scan, many a semi-join."""
    few = [r.token for r in wanted.select("token").distinct().limit(PUSHED + 1).collect()]
    return rows.where(F.col("token").isin(few)) if len(few) <= PUSHED else rows.join(wanted.select("token").distinct(), "token", "left_semi")


def term_tokens(queries: DataFrame, query_col: str, terms: Column) -> DataFrame:
    """Rows (query, n_terms, term_no, phrase): each query's terms as lists of tokens; a term that splits into none is left out."""
    split = queries.select(F.col(query_col).alias("query"), F.filter(F.transform(terms, tokens), lambda t: F.size(t) > 0).alias("phrases"))
    # Outer, as else the terms would be worked out once more for a filter of empty lists.
    return split.select("query", F.size("phrases").alias("n_terms"), F.posexplode_outer("phrases").alias("term_no", "phrase")).where(F.col("phrase").isNotNull())


def matches(asked: DataFrame, keywords: Keywords) -> DataFrame:
    """Rows (query, term_no, n_terms, id, tf, length, df): occurrences of terms (``term_tokens``); df, rows that hold the term.

    A term of several tokens matches where they stand side by side.
    """
    wanted = asked.select("query", "term_no", "n_terms", F.size("phrase").alias("size"), F.posexplode("phrase").alias("at", "token"))
    single = wanted.where("size = 1").drop("size", "at")
    counts = holding(keywords, single, ["token"]).groupBy("token").agg(F.count("*").alias("df"))
    found = holding(keywords, single, ["token", "id", "tf", "length"]).join(single.join(counts, "token"), "token").select("query", "term_no", "n_terms", "id", "tf", "length", "df")
    several = wanted.where("size > 1")
    if several.head(1):
        hits = holding(keywords, several, ["token", "id", "length", "positions"]).join(several, "token")
        starts = hits.select("query", "term_no", "n_terms", "size", "id", "length", "at", F.explode("positions").alias("pos")).groupBy("query", "term_no", "n_terms", "size", "id", "length", (F.col("pos") - F.col("at")).alias("start"))
        phrases = starts.agg(F.count_distinct("at").alias("n")).where("n = size").groupBy("query", "term_no", "n_terms", "id", "length").agg(F.count("*").cast("int").alias("tf"))
        together = F.count("*").over(Window.partitionBy("query", "term_no"))
        found = found.unionByName(phrases.withColumn("df", together))
    return found


