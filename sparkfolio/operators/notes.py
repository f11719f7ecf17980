"""Notes in Markdown with frontmatter: parsing, merging with what a user wrote, naming and linking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import percent_encode, safe_file_name, sanitize_link


@dataclass(frozen=True)
class Markers:
    """Comments that enclose the generated and the user's block, and the names of the generated keys."""

    managed: tuple[str, str] = ("<!-- managed:start -->", "<!-- managed:end -->")
    user: tuple[str, str] = ("<!-- user:start -->", "<!-- user:end -->")
    id_key: str = "paper_id"
    file_key: str = "paper_pdf"
    clock_key: str = "paper_updated_at"
    related: str = "## Related papers"
    empty_user: str = "## My Notes"


@dataclass
class Note:
    lines: list[str] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    managed: str = ""
    user: str = ""
    before: str = ""
    after: str = ""
    error: str | None = None


def _block(body: str, marks: tuple[str, str]) -> tuple[int, int, str] | None:
    """Start, end and text between two marks; None without marks; ValueError if one lacks or they are reversed."""
    start, end = body.find(marks[0]), body.find(marks[1])
    if start < 0 and end < 0:
        return None
    if start < 0 or end <= start:
        raise ValueError
    return start, end + len(marks[1]), body[start + len(marks[0]) : end].strip("\n")


def parse_note(content: str, marks: Markers = Markers()) -> Note:
    text, note = content.removeprefix("﻿"), Note()
    if text.startswith("---\n") and (end := text.find("\n---\n", 4)) >= 0:
        note.lines, text = text[4:end].split("\n"), text[end + 5 :]
    elif text.startswith("---\n---\n"):
        text = text[8:]
    for line in note.lines:
        key, colon, value = line.partition(":")
        if colon and line[0] not in " -" and value.strip():
            note.fields[key.strip()] = value.strip().strip('"')
    found = []
    for name in ("managed", "user"):
        try:
            block = _block(text, getattr(marks, name))
        except ValueError:
            note.error = f"unbalanced {name} markers"
            return note
        if block:
            found.append(block)
            setattr(note, name, block[2])
    note.before = text[: min((b[0] for b in found), default=len(text))]
    note.after = text[max((b[1] for b in found), default=len(text)) :]
    return note


def list_field(lines: list[str], key: str) -> list[str]:
    """Items of a list in frontmatter."""
    values, rest = [], iter(lines)
    for line in rest:
        if line.rstrip() == f"{key}:":
            break
    for line in rest:
        item = line.lstrip()
        if item.startswith("- "):
            values.append(item[2:].strip().strip('"'))
        elif not line.startswith(" "):
            break
    return values


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _apart(text: str) -> str:
    return f"\n{text.strip()}\n\n" if text.strip() else "\n"


def merge_note(existing: str, paper: dict, markdown: str, related: list[str], now: str, marks: Markers = Markers()) -> str | None:
    """The note with its generated keys and block made anew; groups and tags that the note has, unknown keys, the user's block
    and what stands around the blocks stay. None where the marks are damaged. Merging twice changes nothing."""
    note = parse_note(existing, marks)
    if note.error:
        return None
    front = [f"{marks.id_key}: {_quoted(paper['id'])}", f"title: {_quoted(paper['title'])}"]
    if paper.get("authors"):
        front += ["authors:", *(f"  - {_quoted(a)}" for a in paper["authors"])]
    front += [f"{k}: {v}" for k, v in (("year", paper.get("year")), ("doi", paper.get("doi") and _quoted(paper["doi"]))) if v is not None]
    if groups := list_field(note.lines, "groups"):
        front += ["groups:", *(f"  - {_quoted(g)}" for g in groups)]
    if tags := list_field(note.lines, "tags") or list(paper.get("tags") or []):
        front += ["tags:", *(f"  - {t}" for t in tags)]
    front += [f'{marks.file_key}: "../Attachments/{paper["id"]}.pdf"', f'{marks.clock_key}: "{now}"']
    known = {marks.id_key, marks.file_key, marks.clock_key, "title", "authors", "year", "doi", "groups", "tags"}
    front += [x for x in note.lines if ":" in x and x[0] not in " -" and x.partition(":")[0].strip() not in known]
    body = markdown.strip()
    if related:
        links = "\n".join(f"- [[{' '.join(''.join(' ' if c in '[]|#^' else c for c in t).split())}]]" for t in related)
        body = f"{body.partition(marks.related)[0]}{marks.related}\n\n{links}" if marks.related in body else f"{body}\n\n{marks.related}\n\n{links}"
    user = note.user or marks.empty_user
    return "---\n" + "\n".join(front) + "\n---\n" + _apart(note.before) + f"{marks.managed[0]}\n{body}\n{marks.managed[1]}\n\n{marks.user[0]}\n{user}\n{marks.user[1]}\n" + _apart(note.after)


NOTE = "id string, title string, groups array<string>, tags array<string>, user string, error string"


def parsed_notes(notes: DataFrame, path_col: str = "path", content_col: str = "content", marks: Markers = Markers()) -> DataFrame:
    """Rows (path, id, title, groups, tags, user, error) of notes; a damaged note has only an error."""
    names = ["id", "title", "groups", "tags", "user", "error"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n in (parse_note(c or "", marks) for c in batch.column(1).to_pylist()):
                rows.append((n.fields.get(marks.id_key), n.fields.get("title"), list_field(n.lines, "groups"), list_field(n.lines, "tags"), n.user, n.error))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", *names])

    return notes.select(F.col(path_col).alias("path"), content_col).mapInArrow(run, f"path string, {NOTE}")


def pulled(notes: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """What edited notes change: groups to make, memberships and tags that replace the papers' own, papers in sync and in
    conflict."""
    good = notes.where("error is null and id is not null")
    named = good.select(F.col("id").alias("paper_id"), F.explode("groups").alias("name"))
    return {
        "new_groups": named.select("name").distinct().join(groups.select("name"), "name", "left_anti"),
        "paper_groups": named.distinct(),
        "paper_tags": good.select(F.col("id").alias("paper_id"), F.explode("tags").alias("tag")).distinct(),
        "synced": good.select(F.col("id").alias("paper_id")).distinct(),
        "conflicts": notes.where("error is not null").select("path", "error"),
    }


def note_path(title: Column, paper_id: Column) -> Column:
    return F.concat(safe_file_name(title), F.lit("-"), F.substring(paper_id.cast("string"), 1, 8), F.lit(".md"))


def paper_link(title: Column, paper_id: Column, vault: str, folder: str = "Papers") -> Column:
    """A Markdown link that opens a paper's note in a vault."""
    file = F.concat(F.lit(f"{folder}/"), safe_file_name(title), F.lit("-"), F.substring(paper_id.cast("string"), 1, 8))
    return F.concat(F.lit("["), sanitize_link(title), F.lit("](obsidian://open?vault="), percent_encode(F.lit(vault)), F.lit("&file="), percent_encode(file), F.lit(")"))


def topic_notes(topics: DataFrame, neighbours: DataFrame, papers: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """Rows (id, content): a note per topic (id, label) with links to neighbouring topics and to its papers (id, title), and
    what papers say about it."""
    links = neighbours.select("id", F.array_join(F.transform("neighbours", lambda n: F.concat(F.lit("- [["), n, F.lit("]]"))), "\n").alias("near"))
    titled = papers.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("title")), lambda t: F.concat(F.lit("- [["), sanitize_link(t), F.lit("]]"))), "\n").alias("papers"))
    out = topics.join(links, "id", "left").join(titled, "id", "left")
    parts = [F.concat(F.lit("# "), F.col("label")), F.concat(F.lit("## Topics\n\n"), F.col("near")), F.concat(F.lit("## Papers\n\n"), F.col("papers"))]
    if insights is not None:
        said = insights.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("updated_at", "insight")), False), lambda x: x["insight"]), "\n\n").alias("said"))
        out = out.join(said, "id", "left")
        parts.insert(1, F.concat(F.lit("## Concept\n\n"), F.col("said")))
    return out.select("id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("content"))
