"""Fill-in-middle transformation: DuckDB inside the tasks cuts texts in three and puts their middles last.

Each batch is registered as a table of an in-memory DuckDB and turned by one SQL statement, Arrow in and Arrow out; no Python
value is made of a row.  A text is cut into blocks of code points by ``regexp_extract_all``; a cut falls inside one block,
which alone is cut into its code points, and ``list_slice`` and ``array_to_string`` put the parts together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkfolio.llm.shared import col

#: Bytes of text that are turned at once, unless one text has more.
BATCH_BYTES = 4_000_000
#: Code points in a block.
BLOCK = 256


@dataclass(frozen=True)
class Rules:
    """seed: what is hashed before an id and a colon. Of 100 texts, those from ``plain_from`` on stay plain, and of the others those
    below ``suffix_first`` put the suffix first."""

    seed: str = "1"
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    plain_from: int = 90
    suffix_first: int = 20

    def __post_init__(self):
        marks = self.prefix_mark, self.suffix_mark, self.middle_mark
        if len(set(marks)) != 3 or any(not m or m[0] in m[1:] or m[0] != marks[0][0] for m in marks):
            raise ValueError("marks must differ, and start with one sign that they hold only there")


# Code points i+1 to j of a text given in blocks: the end of i's block, the blocks between, the start of j's block.
MACROS = f"""
create macro points(block) as regexp_extract_all(block, '(?s).');
create macro joined(parts) as coalesce(array_to_string(parts, ''), '');
create macro span(blocks, i, j) as case
    when i >= j then ''
    when i // {BLOCK} = j // {BLOCK} then joined(list_slice(points(blocks[i // {BLOCK} + 1]), i % {BLOCK} + 1, j % {BLOCK}))
    else joined(list_slice(points(blocks[i // {BLOCK} + 1]), i % {BLOCK} + 1, {BLOCK}))
        || joined(list_slice(blocks, i // {BLOCK} + 2, j // {BLOCK}))
        || joined(list_slice(points(blocks[j // {BLOCK} + 1]), 1, j % {BLOCK})) end;
create macro group_of(digest, k) as ('0x' || substr(digest, 8 * k - 7, 8))::ubigint;
"""

TRANSFORM = f"""
with hashed as (
    select id, coalesce(text, '') as text, sha256($seed || ':' || coalesce(id::varchar, '')) as digest from batch
), blocked as (
    select *, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') as blocks from hashed
), counted as (
    select *, case when len(blocks) = 0 then 0 else (len(blocks) - 1) * {BLOCK} + len(points(blocks[len(blocks)])) end as n from blocked
), placed as (
    select *, least(group_of(digest, 1) % (n + 1), group_of(digest, 2) % (n + 1))::bigint as i, greatest(group_of(digest, 1) % (n + 1), group_of(digest, 2) % (n + 1))::bigint as j,
        case when n = 0 or contains(text, $prefix_mark) or contains(text, $suffix_mark) or contains(text, $middle_mark) or group_of(digest, 3) % 100 >= $plain_from then 'plain'
            when group_of(digest, 4) % 100 < $suffix_first then 'spm' else 'psm' end as form
    from counted
), turned as (
    select id, n::bigint as n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
        case form when 'plain' then text
            when 'psm' then $prefix_mark || span(blocks, 0, i) || $suffix_mark || span(blocks, j, n) || $middle_mark || span(blocks, i, j)
            else $suffix_mark || span(blocks, j, n) || $prefix_mark || span(blocks, 0, i) || $middle_mark || span(blocks, i, j) end as output
    from placed
)"""  # fmt: skip

# Each mark stands in an output just once: a form other than plain is given to texts without marks, and marks that start with
# the same sign and hold it only there arise nowhere else.
RESTORE = """split as (
    select *, string_split(substr(output, length(case form when 'psm' then $prefix_mark else $suffix_mark end) + 1), case form when 'psm' then $suffix_mark else $prefix_mark end) as two from turned
), parted as (
    select *, two[1] as first_part, string_split(two[2], $middle_mark) as rest from split
), restored as (
    select * exclude (two, first_part, rest), case form when 'plain' then output when 'psm' then first_part || rest[2] || rest[1] else rest[1] || rest[2] || first_part end as restored from parted
)"""


def _run(df: DataFrame, statement: str, params: dict, schema: T.StructType, measured: int) -> DataFrame:
    """Runs a statement over ``df`` batch by batch, as table ``batch``; measured: the column whose bytes bound a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, kinds = df.columns, to_arrow_schema(schema)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True}) as con:
            con.execute(MACROS)
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(measured)), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes, dtype=np.int64)
                start = 0
                while start < batch.num_rows:
                    before = ends[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
                    part = pa.Table.from_batches([batch.slice(start, end - start)]).rename_columns(names)
                    con.register("batch", part)
                    out = con.sql(statement, params=params).to_arrow_table()
                    con.unregister("batch")
                    yield from out.rename_columns(kinds.names).cast(kinds).to_batches()
                    start = end

    return df.mapInArrow(turn, schema)


def _params(rules: Rules, statement: str) -> dict:
    return {k: v for k, v in vars(rules).items() if f"${k}" in statement}


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(col(id_col).alias("id"), col(text_col).alias("text"))


def _schema(df: DataFrame, id_col: str, columns: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, t) for n, t in columns]])


CUTS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]


def fill_middle(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output): n code points, where the text is cut, and what it is turned into.

    form: ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``, the text as it is, with null lengths: an empty
    text, one that holds a mark, and the share that the rules leave so.  Cuts and form depend on the id alone, so reruns agree
    and rows with one id are cut by the same numbers; a null id hashes like an empty one and is kept.  A null text counts as
    empty.  Repeated rows stay, an empty table gives an empty table, further columns are ignored.  No shuffle; a task holds a
    few times BATCH_BYTES, or a few times its longest text.
    """
    statement = f"{TRANSFORM} select id, n, form, prefix_chars, middle_chars, output from turned"
    return _run(_input(df, id_col, text_col), statement, _params(rules, statement), _schema(df, id_col, [*CUTS, ("output", T.StringType())]), 1)


def restore(turned: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id") -> DataFrame:
    """Rows (id, restored) of what ``fill_middle`` returns: the texts, from output and form alone."""
    statement = f"with turned as (select * from batch), {RESTORE} select id, restored from restored"
    rows = turned.select(col(id_col).alias("id"), "output", "form")
    return _run(rows, statement, _params(rules, statement), _schema(turned, id_col, [("restored", T.StringType())]), 1)


def digests(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fill_middle`` with SHA-256 digests of the output, and of the text restored from it, in place of the texts; in one pass."""
    statement = f"{TRANSFORM}, {RESTORE} select id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(restored) as restored_sha256 from restored"
    return _run(_input(df, id_col, text_col), statement, _params(rules, statement), _schema(df, id_col, [*CUTS, ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]), 1)
