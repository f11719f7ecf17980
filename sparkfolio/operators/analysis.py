"""Structured analyses: validation and cleaning of JSON answers, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import ascii_lower, hashtag, page_links, strip_code_fence, tag_is_reasonable

SCHEMA_VERSION = "1"
SCHEMA = (
    "schemaVersion string, shortSummary string, detailedSummary string, researchProblem string, contributions array<struct<claim:string,evidencePages:array<bigint>>>, "
    "methodology string, results array<struct<finding:string,evidencePages:array<bigint>>>, limitations array<string>, keywords array<string>, suggestedTags array<string>, "
    "tagInsights array<struct<tag:string,insight:string,evidencePages:array<bigint>>>, followUpQuestions array<string>"
)
REQUIRED = ["schemaVersion", "shortSummary", "detailedSummary", "researchProblem", "contributions", "methodology", "results", "limitations", "keywords", "suggestedTags", "followUpQuestions"]


def clean_pages(pages: Column, page_count: Column) -> Column:
    """Pages of the paper, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(pages, F.array().cast("array<bigint>")), lambda p: p.isNotNull() & (p >= 1) & (p <= page_count))))


def validate(answers: DataFrame, json_col: str = "json", page_count: str = "page_count", version: str = SCHEMA_VERSION) -> DataFrame:
    """Answers with a struct ``analysis`` and a string ``error`` (null: valid).

    Evidence pages outside the paper go; blank keywords and tags that are no short labels go; explained tags join the suggested
    ones unless they are there in any ASCII case.
    """
    a = F.from_json(strip_code_fence(F.col(json_col)), SCHEMA)
    rows = answers.withColumn("_a", a)
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.col(f"_a.{name}").isNull()
    error = F.when(F.col("_a").isNull() | missing, "schema").when(F.col("_a.schemaVersion") != version, "version").when(F.trim("_a.shortSummary") == "", "empty summary")
    n = F.col(page_count)
    pages = lambda x, text: F.struct(x[text].alias(text), clean_pages(x["evidencePages"], n).alias("evidencePages"))
    insights = F.filter(F.coalesce("_a.tagInsights", F.expr("cast(array() as array<struct<tag:string,insight:string,evidencePages:array<bigint>>>)")), lambda i: tag_is_reasonable(i["tag"]) & (F.trim(i["insight"]) != ""))
    insights = F.transform(insights, lambda i: F.struct(i["tag"].alias("tag"), i["insight"].alias("insight"), clean_pages(i["evidencePages"], n).alias("evidencePages")))
    tags = F.filter("_a.suggestedTags", lambda t: tag_is_reasonable(t))
    # Explained tags in order, each added if no earlier one equals it without regard to ASCII case.
    all_tags = F.aggregate(F.transform(insights, lambda i: i["tag"]), tags, lambda have, t: F.when(F.exists(have, lambda h: ascii_lower(h) == ascii_lower(t)), have).otherwise(F.concat(have, F.array(t))))
    fields = {
        "contributions": F.transform("_a.contributions", lambda x: pages(x, "claim")),
        "results": F.transform("_a.results", lambda x: pages(x, "finding")),
        "keywords": F.filter("_a.keywords", lambda k: F.trim(k) != ""),
        "suggestedTags": all_tags,
        "tagInsights": insights,
    }
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]
    struct = F.struct(*[fields.get(x, F.col(f"_a.{x}")).alias(x) for x in names])
    return rows.withColumn("error", error).withColumn("analysis", F.when(F.col("error").isNull(), struct)).drop("_a")


def repeated_errors(answers: DataFrame) -> DataFrame:
    """Papers whose answer and repaired answer (attempt 1 and 2) are both invalid."""
    return answers.groupBy("paper_id").agg(F.min(F.col("error").isNotNull().cast("int")).alias("bad")).where("bad = 1").select("paper_id")


#: Titles of the ten sections; a caller passes those of its language.
SECTIONS = ["Summary", "Research problem", "Contributions", "Methodology", "Results", "Limitations", "Keywords and tags", "Follow-up questions", "Related papers"]


def render(rows: DataFrame, sections: list[str] | None = None, none: str = "None.", page_suffix: str = "p") -> DataFrame:
    """Rows with a column ``markdown``: bibliography and nine sections, from title, authors, year, venue, doi, analysis and
    ``related`` titles."""
    names = sections or SECTIONS
    a = F.col("analysis")
    facts = F.array_compact(F.array(F.nullif(F.array_join("authors", ", "), F.lit("")), F.col("year").cast("string"), F.col("venue"), F.concat(F.lit("DOI: "), F.col("doi"))))
    bullets = lambda items, show: F.when(F.size(items) > 0, F.array_join(F.transform(items, show), "\n")).otherwise(F.lit(none))
    point = lambda text: lambda x: F.concat(F.lit("- "), F.trim(x[text]), page_links(x["evidencePages"], page_suffix))
    plain = lambda x: F.concat(F.lit("- "), F.trim(x))
    lines = F.array_compact(
        F.array(
            F.when(F.size(a["keywords"]) > 0, F.array_join(a["keywords"], ", ")),
            F.when(F.size(a["suggestedTags"]) > 0, F.array_join(F.transform(a["suggestedTags"], hashtag), " ")),
        )
    )
    bodies = [
        F.array_join(F.filter(F.array(F.trim(a["shortSummary"]), F.trim(a["detailedSummary"])), lambda t: t != ""), "\n\n"),
        F.trim(a["researchProblem"]),
        bullets(a["contributions"], point("claim")),
        F.trim(a["methodology"]),
        bullets(a["results"], point("finding")),
        bullets(a["limitations"], plain),
        F.array_join(lines, "\n\n"),
        bullets(a["followUpQuestions"], plain),
        bullets(F.col("related"), lambda t: F.concat(F.lit("- [["), t, F.lit("]]"))),
    ]
    head = F.concat(F.lit("# "), F.col("title"))
    parts = [head, F.when(F.size(facts) > 0, F.array_join(facts, " · "))]
    for name, body in zip(names, bodies):
        parts += [F.lit(f"## {name}"), F.nullif(body, F.lit(""))]
    return rows.withColumn("markdown", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")))
