"""Relations between papers: similarity, citation, neighbourhoods; and tags as topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.functions.text import aggressive_key, lineage, normalize_title
from sparkfolio.operators import blocks, cells
from sparkfolio.session import stage_path
from sparkfolio.sources import versions

RELATION_SIMILARITY, RELATION_NEIGHBOURS = 0.75, 5
FOCUS_SIZE, FOCUS_SIMILARITY, PEER_SIMILARITY, PEER_EDGES = 16, 0.70, 0.78, 3
TAG_MERGE, TOPIC_SIMILARITY, TOPIC_NEIGHBOURS = 0.88, 0.80, 4


def semantic_neighbours(centres: DataFrame, vectors: DataFrame, papers: DataFrame | None = None, threshold: float = RELATION_SIMILARITY, keep: int = RELATION_NEIGHBOURS) -> DataFrame:
    """Directed edges (source, target, score, rank) from each centre to its nearest existing papers above the threshold.

    One more than ``keep`` is looked up, itself included, before papers that are gone are left out.
    """
    found = blocks.top_k(centres, vectors, keep + 1, "id", "embedding", include_self=True).where("query_id <> id")
    if papers is not None:
        found = found.join(papers.select("id").distinct(), "id", "left_semi")
    found = found.where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).select(F.col("query_id").alias("source"), F.col("id").alias("target"), "score", "rank")


def replace_semantic(relations: DataFrame, fresh: DataFrame, centres: DataFrame) -> DataFrame:
    """Relations with the semantic edges out of ``centres`` replaced; all others, manual ones included, stay."""
    old = relations.where("relation_type = 'semantic'").join(centres.select(F.col("id").alias("source")), "source", "left_anti")
    new = fresh.select("source", "target", F.lit("semantic").alias("relation_type"), "score")
    return relations.where("relation_type <> 'semantic'").select(*new.columns).unionByName(old.select(*new.columns)).unionByName(new)


def undirected_top(pairs: DataFrame, keep: int) -> DataFrame:
    """Pairs (a, b, score) among the ``keep`` best of either end, each once."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "score"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.round("score", 12).desc(), "y"))
    best = both.withColumn("rank", rank).where(F.col("rank") <= keep)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score").dropDuplicates(["a", "b"])


def peer_edges(vectors: DataFrame, threshold: float = PEER_SIMILARITY, keep: int = PEER_EDGES) -> DataFrame:
    return undirected_top(cells.similar_pairs(vectors, threshold, "id", "embedding"), keep)


#: Bytes of DOIs and titles up to which one automaton of all of them is sent to every task.
AUTOMATON_BYTES = 32 << 20
#: Bytes of the texts' words by which titles are sought, with these titles, up to which they are sent to every task.
HITS_BYTES = 32 << 20


def citations(texts: DataFrame, targets: DataFrame, least_title_bytes: int = 20, least_doi_bytes: int = 7, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Edges (source, target, provenance): a text (id, text) holds a target's DOI as it is, or its title, both without signs and
    case, as a substring; provenance doi goes before title.

    One pass over the texts finds all DOIs and titles by an automaton of them, if these have at most ``automaton_bytes``.
    More of them are sought by keys: titles by their words, DOIs that begin with ``10.`` by what follows each ``10.`` in a text,
    up to the longest DOI; other DOIs by as many automata as they fill, a pass each.  No text is compared with each title.
    """
    dois = targets.where(F.octet_length("doi") >= least_doi_bytes).select(F.col("id").alias("target"), F.col("doi").alias("sought"))
    titles = targets.select(F.col("id").alias("target"), normalize_title(F.col("title")).alias("sought")).where(F.octet_length("sought") >= least_title_bytes)
    size = dois.unionByName(titles).agg(F.coalesce(F.sum(F.octet_length("sought")), F.lit(0))).first()[0]
    if size <= automaton_bytes:
        found = _by_automaton(texts, dois, titles)
    else:
        found = _titles_by_keys(texts, titles, least_title_bytes).unionByName(_dois_by_starts(texts, dois.where(F.startswith("sought", F.lit("10.")))))
        odd = dois.where(~F.startswith("sought", F.lit("10.")))
        passes = -(-odd.agg(F.coalesce(F.sum(F.octet_length("sought")), F.lit(0))).first()[0] // automaton_bytes)
        for n in range(passes):
            found = found.unionByName(_by_automaton(texts, odd.where(F.pmod(F.xxhash64("sought"), F.lit(passes)) == n), titles.limit(0)))
    best = found.where("source <> target").groupBy("source", "target").agg(F.min("kind").alias("kind"))
    return best.select("source", "target", F.when(F.col("kind") == 0, "doi").otherwise("title").alias("provenance"))


_automata: dict[int, tuple] = {}


def _by_automaton(texts: DataFrame, dois: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows (source, target, kind) of all DOIs (0) and titles (1), few enough to be sent to every task, that texts hold."""
    import ahocorasick
    from pyspark.sql.pandas.types import to_arrow_type

    spark = texts.sparkSession
    source_type, target_type = texts.schema["id"].dataType, dois.schema["target"].dataType
    sought = [[(r.sought, r.target) for r in rows.collect()] for rows in (dois, titles)]
    sent = spark.sparkContext.broadcast(sought)
    key = sent._jbroadcast.id() if hasattr(sent, "_jbroadcast") else id(sent)

    def automata() -> tuple:
        """The worker's automata of these DOIs and titles: a sought text's value is the list of its targets."""
        if key not in _automata:
            built = []
            for pairs in sent.value:
                of: dict[str, list] = {}
                for text, target in pairs:
                    of.setdefault(text, []).append(target)
                automaton = ahocorasick.Automaton()
                for text, owners in of.items():
                    automaton.add_word(text, owners)
                if of:
                    automaton.make_automaton()
                built.append(automaton if of else None)
            _automata.clear()
            _automata[key] = tuple(built)
        return _automata[key]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list = []
            kinds: list[int] = []
            for kind, automaton in enumerate(automata()):
                if automaton is None:
                    continue
                for i, text in enumerate(batch.column(1 + kind).to_pylist()):
                    if text:
                        owners = {id(o): o for _, o in automaton.iter(text)}
                        here = [t for o in owners.values() for t in o]
                        rows += [i] * len(here)
                        found += here
                        kinds += [kind] * len(here)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, to_arrow_type(target_type)), pa.array(kinds, pa.int32())], names=["source", "target", "kind"])

    both = texts.select(F.col("id").alias("source"), F.col("text") if sought[0] else F.lit(None).cast("string").alias("text"), (normalize_title(F.col("text")) if sought[1] else F.lit(None).cast("string")).alias("plain"))
    return both.mapInArrow(find, T.StructType([T.StructField("source", source_type), T.StructField("target", target_type), T.StructField("kind", T.IntegerType())]))


def _dois_by_starts(texts: DataFrame, dois: DataFrame) -> DataFrame:
    """Rows (source, target, kind): what stands from each ``10.`` on, up to the longest DOI, is joined by each length that DOIs have."""
    lengths = dois.select(F.length("sought").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))  # one row, of the lengths that occur
    longest = dois.agg(F.coalesce(F.max(F.length("sought")), F.lit(3))).first()[0]
    starts = texts.select(F.col("id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?s)(?=(10\..{{0,{longest - 3}}}))"), F.lit(1)))).alias("s")).crossJoin(F.broadcast(lengths))
    offered = starts.select("source", "s", F.explode("lengths").alias("n")).where(F.length("s") >= F.col("n")).select("source", F.expr("left(s, n)").alias("sought")).distinct()
    return offered.join(dois, "sought").select("source", "target", F.lit(0).alias("kind"))


def _titles_by_keys(texts: DataFrame, titles: DataFrame, least_title_bytes: int) -> DataFrame:
    """Rows (source, target, kind) of normalised titles in normalised texts.

    Between its first and last word a title's words stand in the text as whole words, so a title of three or more words is
    sought by the rarest of those; a title of two by the start of its second word or the end of its first; and one word,
    which must be long, among texts' long words.
    """
    spark = texts.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = stage_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    titles = titles.select("target", F.col("sought").alias("title"), F.split("sought", " ").alias("words"))
    plain = written(texts.select(F.col("id").alias("source"), normalize_title(F.col("text")).alias("plain")), "plain")
    word = F.explode(F.array_distinct(F.split("plain", " "))).alias("word")
    vocabulary = written(plain.select(word).groupBy("word").agg(F.count("*").alias("df")), "words")
    inner_words = titles.where(F.size("words") > 2).select("target", F.explode(F.array_distinct(F.slice("words", F.lit(2), F.size("words") - 2))).alias("word"))
    rarest = inner_words.join(vocabulary, "word").groupBy("target").agg(F.min_by("word", F.struct("df", "word")).alias("key"))
    keyed = titles.join(rarest, "target").select("target", "title", F.concat(F.lit("w:"), F.col("key")).alias("key"))
    two = titles.where(F.size("words") == 2)
    first, second = F.col("words")[0], F.col("words")[1]
    keyed = keyed.unionByName(two.select("target", "title", F.when(F.length(second) >= 6, F.concat(F.lit("p:"), F.substring(second, 1, 6))).otherwise(F.concat(F.lit("s:"), F.expr("right(words[0], 6)"))).alias("key")))
    keyed = keyed.unionByName(titles.where(F.size("words") == 1).select("target", "title", F.concat(F.lit("p:"), F.substring("title", 1, 6)).alias("key")))
    # A word of the texts offers itself, its start and its end; a long word also each place where a one-word title may begin.
    w = F.col("word")
    offers = F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("w:"), w), F.concat(F.lit("p:"), F.substring(w, 1, 6)), F.concat(F.lit("s:"), F.expr("right(word, 6)"))),
            F.when(F.octet_length(w) >= least_title_bytes, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("p:"), F.substring(w, i, F.lit(6))))).otherwise(F.array().cast("array<string>")),
        )
    )
    # Each word offers once, however many texts hold it; the texts' words then meet the few that a title is sought by.
    hits = written(vocabulary.select("word", F.explode(offers).alias("key")).join(keyed, "key").select("word", "target", "title").distinct(), "title-words")
    size = hits.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("title")), F.lit(0))).first()[0]
    if size <= HITS_BYTES:
        found = plain.select("source", "plain", word).join(F.broadcast(hits), "word")
    else:
        found = plain.select("source", word).join(hits, "word").select("source", "target", "title").distinct().join(plain, "source")
    return found.where(F.contains("plain", "title")).select("source", "target", F.lit(1).alias("kind"))


def citation_neighbours(relations: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows (centre, id) of papers that a centre cites or that cite it."""
    cited = relations.where("relation_type = 'citation'")
    out = centres.select(F.col("id").alias("centre")).join(cited, F.col("centre") == F.col("source")).select("centre", F.col("target").alias("id"))
    into = centres.select(F.col("id").alias("centre")).join(cited, F.col("centre") == F.col("target")).select("centre", F.col("source").alias("id"))
    return out.union(into).distinct()


def neighbourhood(centres: DataFrame, vectors: DataFrame, papers: DataFrame, relations: DataFrame, size: int = FOCUS_SIZE, threshold: float = FOCUS_SIMILARITY) -> DataFrame:
    """Nodes (centre, id, similarity, cited, lineage) around each centre: nearest papers above the threshold, and citation
    neighbours at any distance, whose similarity is null unless they are near too."""
    near = semantic_neighbours(centres.join(vectors, "id"), vectors, papers, threshold, size).select(F.col("source").alias("centre"), F.col("target").alias("id"), F.col("score").alias("similarity"))
    cited = citation_neighbours(relations, centres).join(papers.select("id"), "id", "left_semi").select("centre", "id", F.lit(True).alias("cited"))
    nodes = near.join(cited, ["centre", "id"], "full").withColumn("cited", F.coalesce("cited", F.lit(False)))
    years = papers.select(F.col("id").alias("_id"), F.col("year").alias("_year"))
    nodes = nodes.join(years, F.col("id") == F.col("_id"), "left").withColumnRenamed("_year", "year").drop("_id")
    nodes = nodes.join(years.withColumnRenamed("_year", "centre_year"), F.col("centre") == F.col("_id"), "left").drop("_id")
    return nodes.select("centre", "id", "similarity", "cited", lineage(F.col("year"), F.col("centre_year")).alias("lineage"))


def library_graph(papers: DataFrame, paper_groups: DataFrame, paper_tags: DataFrame, relations: DataFrame, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with their groups and tags, and the edges of the given kinds between them; dangling edges are dropped."""
    groups = paper_groups.groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set("group_id")).alias("groups"))
    tags = paper_tags.groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    empty = F.array().cast("array<string>")
    nodes = papers.join(groups, "id", "left").join(tags, "id", "left").withColumns({c: F.coalesce(c, empty) for c in ("groups", "tags")})
    edges = relations.where(F.col("relation_type").isin(kinds)) if kinds else relations
    for end in ("source", "target"):
        edges = edges.join(papers.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges


# -- topics -----------------------------------------------------------------------------------------------------------


def tag_units(paper_tags: DataFrame) -> DataFrame:
    """Tags (tag_id, label, source) with their number of papers and place, representatives first: users' before others,
    more papers, shorter labels, label. The places are those of a vocabulary, counted per tag first: one task ranks them."""
    units = paper_tags.groupBy("tag_id", "label", "source").agg(F.countDistinct("paper_id").alias("n_papers"))
    order = [F.when(F.col("source") == "user", 0).otherwise(1), F.col("n_papers").desc(), F.length("label"), F.col("label"), F.col("tag_id")]
    return units.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def leader_groups(keys: list[str], vectors: np.ndarray | None, threshold: float = TAG_MERGE) -> list[int]:
    """For each item in order, the number of its leader: the first leader with an equal key or a similar vector. What
    ``duplicate_tags`` computes in rounds, for a list of items one after the other."""
    leaders: list[int] = []
    by_key: dict[str, int] = {}
    out = []
    for i, key in enumerate(keys):
        chosen = by_key.get(key)
        if vectors is not None and leaders:
            near = np.flatnonzero(vectors[leaders] @ vectors[i] >= threshold)
            if len(near) and (chosen is None or leaders[near[0]] < chosen):
                chosen = leaders[near[0]]
        if chosen is None:
            chosen = i
            leaders.append(i)
            by_key.setdefault(key, i)
        out.append(chosen)
    return out


def duplicate_tags(units: DataFrame, threshold: float = TAG_MERGE, vector_col: str | None = None) -> DataFrame:
    """Rows (tag_id, keep_id): each tag and the one it merges into, by greedy grouping in ``place`` order: a tag joins the first
    leader with its key, or a vector whose product with its own reaches the threshold, and leads a new group if there is none.

    The sequential result, in rounds over all tags: who has a leader before it, by key or vector, is a member; who has neither a
    leader nor an undecided tag before it is a leader.  Each round decides the first undecided tag of each neighbourhood at
    least; rounds are written to the shared folder.
    """
    spark = units.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = stage_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    tags = written(units.select("tag_id", F.col("place").cast("long").alias("place"), aggressive_key(F.col("label")).alias("key")), "tags")
    edges = spark.createDataFrame([], "before long, place long")
    if vector_col:
        near = cells.similar_pairs(units.select(F.col("place").cast("long").alias("place"), vector_col), threshold, "place", vector_col)
        edges = written(near.select(F.col("a").alias("before"), F.col("b").alias("place")), "likenesses")

    def first_before(some: DataFrame, name: str) -> DataFrame:
        """Rows (place, name): the first of some tags that stands before a tag and is alike or has its key."""
        by_key = tags.join(some.groupBy("key").agg(F.min("place").alias(name)), "key").where(F.col(name) < F.col("place")).select("place", name)
        by_edge = edges.join(some.select(F.col("place").alias("before")), "before").select("place", F.col("before").alias(name))
        return by_key.unionByName(by_edge).groupBy("place").agg(F.min(name).alias(name))

    state = written(tags.select("place", "key", F.lit("undecided").alias("status")), "states")
    while (undecided := state.where("status = 'undecided'")).head(1):
        led = first_before(state.where("status = 'leader'"), "leader")
        waits = first_before(undecided, "waits_for")
        status = F.when(F.col("status") != "undecided", F.col("status")).when(F.col("leader").isNotNull(), "member").when(F.col("waits_for").isNull(), "leader").otherwise("undecided")
        state = written(state.join(led, "place", "left").join(waits, "place", "left").select("place", "key", status.alias("status")), "states")
    leaders = state.where("status = 'leader'")
    joined = tags.join(first_before(leaders, "leader"), "place", "left").select("tag_id", F.coalesce("leader", "place").alias("leader"))
    return joined.join(tags.select(F.col("place").alias("leader"), F.col("tag_id").alias("keep_id")), "leader").select("tag_id", "keep_id")


def merge_tags(paper_tags: DataFrame, merged: DataFrame) -> DataFrame:
    """Memberships moved to the tags that are kept, each once."""
    return paper_tags.join(merged, "tag_id").select(F.col("keep_id").alias("tag_id"), "paper_id").distinct()


#: Memberships that a task pairs.
TASK_ROWS = 500_000


def cooccurrence(memberships: DataFrame, item: str = "tag_id", basket: str = "paper_id") -> DataFrame:
    """Rows (a, b, weight), a < b: baskets that hold both items. A basket is a paper with its few tags.

    Memberships are dealt by basket once, to as many tasks as they need, so that a task's share stays the same as they grow."""
    parts = max(int(memberships.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-memberships.count() // TASK_ROWS))
    m = memberships.select(item, basket).repartition(parts, basket).distinct()
    one, two = m.select(F.col(item).alias("a"), basket), m.select(F.col(item).alias("b"), basket)
    return one.join(two, basket).where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def topic_edges(memberships: DataFrame, vectors: DataFrame, threshold: float = TOPIC_SIMILARITY, keep: int = TOPIC_NEIGHBOURS) -> DataFrame:
    """Edges (a, b, kind, weight): co-occurrence, and similarity of topics that don't co-occur, the best of either end."""
    together = cooccurrence(memberships)
    apart = cells.similar_pairs(vectors, threshold, "id", "embedding").join(together.select("a", "b"), ["a", "b"], "left_anti")
    semantic = undirected_top(apart, keep).select("a", "b", F.lit("semantic").alias("kind"), F.col("score").alias("weight"))
    return together.select("a", "b", F.lit("cooccurrence").alias("kind"), "weight").unionByName(semantic)


def topic_signature(memberships: DataFrame, prefix: str = "tags-v2;") -> DataFrame:
    """A hash of all (tag, label, paper) rows in order: equal if and only if nothing changed since a build.

    Each tag's rows are hashed first, so that what meets in one place is a hash per tag.
    """
    line = F.concat_ws("|", F.col("tag_id").cast("string"), "label", F.col("paper_id").cast("string"))
    per_tag = memberships.groupBy("tag_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";").cast("binary"), 256).alias("h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tag_id", "h"))), lambda x: x["h"]), ";")
    return per_tag.agg(F.sha2(F.concat(F.lit(prefix), F.coalesce(joined, F.lit(""))).cast("binary"), 256).alias("signature"))


def rebuilt_topics(memberships: DataFrame, vectors: DataFrame, folder: str, threshold: float = TOPIC_SIMILARITY, keep: int = TOPIC_NEIGHBOURS) -> bool:
    """Writes topics (tag_id, label, n_papers), links, edges and the signature of the memberships (tag_id, label, source, paper_id) to a
    folder's tables, in one commit, unless the signature stored there is theirs already. Whether anything was written."""
    spark = memberships.sparkSession
    own = topic_signature(memberships.select("tag_id", "label", "paper_id")).first().signature
    base = versions.opened(spark, folder)
    if base.version >= 0 and base.table("signature").first().signature == own:
        return False
    tables = {
        "topics": ("tag_id", tag_units(memberships)),
        "links": ("topic_id", memberships.select(F.col("tag_id").alias("topic_id"), "paper_id").distinct()),
        "edges": ("a", topic_edges(memberships.select("tag_id", "paper_id"), vectors, threshold, keep)),
        "signature": ("signature", spark.createDataFrame([(own,)], "signature string")),
    }
    versions.commit(base, {name: versions.Change(key, rows, everything=True) for name, (key, rows) in tables.items()})
    return True


def tag_marks(memberships: DataFrame) -> DataFrame:
    """Rows (tag_id, mark): a hash of each tag's labels and papers, repeats and order aside."""
    line = F.xxhash64("label", "paper_id").cast("decimal(38,0)")
    rows = memberships.select("tag_id", "label", "paper_id").distinct()
    return rows.groupBy("tag_id").agg(F.concat_ws("|", F.count("*").cast("string"), F.sum(line).cast("string"), F.sum(F.xxhash64("paper_id", "label").cast("decimal(38,0)")).cast("string")).alias("mark"))


def cooccurrence_of(changed: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows (a, b, weight), a < b, of the pairs with a tag of ``changed`` (tag_id, once each): only papers of these are joined."""
    m = memberships.select("tag_id", "paper_id").distinct()
    m = m.join(changed.select("tag_id", F.lit(True).alias("new")), "tag_id", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    near = m.join(m.where("new").select("paper_id").distinct(), "paper_id", "left_semi")
    one, two = m.where("new").select(F.col("tag_id").alias("x"), "paper_id"), near.select(F.col("tag_id").alias("y"), "paper_id", "new")
    # A pair of two changed tags is counted from its lesser one.
    pairs = one.join(two, "paper_id").where("(not new and x <> y) or x < y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").cast("double").alias("weight"))


def refreshed_topics(memberships: DataFrame, vectors: DataFrame, folder: str, threshold: float = TOPIC_SIMILARITY, keep: int = TOPIC_NEIGHBOURS) -> int:
    """Brings a folder's tables links (topic_id, paper_id), together and semantic (a, b, weight) up to the memberships (tag_id, label,
    paper_id) in one commit; the number of tags that changed since the last one.

    A mark per tag tells which changed, came or went; only pairs with one of these are counted anew, and only rows of a lesser tag
    with such a pair are replaced.  Similar pairs are compared again if a vector changed, else the stored ones are read.  Nothing is
    written if neither changed.  Null tags or papers form no pair; ``topic_table`` reads the edges.
    """
    spark, base = memberships.sparkSession, versions.opened(memberships.sparkSession, folder)
    stage = lambda df, label: (lambda path: (df.write.parquet(path), spark.read.parquet(path))[1])(stage_path(spark, label))
    rows = memberships.where("tag_id is not null and paper_id is not null")
    marks, first = stage(tag_marks(rows), "marks"), base.version < 0
    old = marks.limit(0) if first else base.table("marks")
    both = marks.select("tag_id", F.col("mark").alias("now")).join(old.select("tag_id", F.col("mark").alias("then")), "tag_id", "full")
    changed = stage(both.where("not (now <=> then)").select("tag_id"), "changed")
    n = changed.count()
    seen = vectors.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "embedding").cast("decimal(38,0)")).alias("h"), F.lit(float(threshold)).alias("threshold"), F.lit(keep).alias("keep"))
    seen = stage(seen.select(F.concat_ws("|", *[F.col(c).cast("string") for c in seen.columns]).alias("mark")), "seen")
    same = not first and base.table("vectors").first().mark == seen.first().mark
    if same and n == 0:
        return 0
    fresh = stage(cooccurrence_of(changed, rows), "fresh")
    before = fresh.limit(0) if first else base.table("together")
    ends = changed.select(F.col("tag_id").alias("b"))
    # Lesser ends of all pairs that came, went or changed; their other pairs stay as they are.
    lesser = changed.select(F.col("tag_id").alias("a")).union(before.join(ends, "b", "left_semi").select("a")).union(fresh.select("a")).distinct()
    untouched = before.join(ends, "b", "left_anti").join(ends.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b", "weight")
    replaced = stage(untouched.join(lesser, "a", "left_semi").select("a", "b", "weight").unionByName(fresh.select("a", "b", "weight")), "together")
    together = untouched.unionByName(fresh.select("a", "b", "weight"))
    alike = base.table("alike") if same else stage(cells.similar_pairs(vectors, threshold, "id", "embedding").select("a", "b", "score"), "alike")
    apart = alike.join(together.select("a", "b"), ["a", "b"], "left_anti")
    semantic = undirected_top(apart, keep).select("a", "b", F.col("score").alias("weight"))
    links = rows.join(changed, "tag_id", "left_semi").select(F.col("tag_id").alias("topic_id"), "paper_id").distinct()
    changes = {
        "links": versions.Change("topic_id", links, changed.select(F.col("tag_id").alias("topic_id"))),
        "together": versions.Change("a", replaced, lesser),
        "semantic": versions.Change("a", stage(semantic, "semantic"), everything=True),
        "marks": versions.Change("tag_id", marks.join(changed, "tag_id", "left_semi").select("tag_id", "mark"), changed),
    }
    if not same:
        changes |= {"alike": versions.Change("a", alike, everything=True), "vectors": versions.Change("mark", seen, everything=True)}
    versions.commit(base, changes)
    return n


def topic_table(spark, folder: str) -> DataFrame:
    """Edges (a, b, kind, weight) as the last refresh left them, like those of ``topic_edges``."""
    now = versions.opened(spark, folder)
    kinds = [now.table(name).select("a", "b", F.lit(kind).alias("kind"), "weight") for name, kind in (("together", "cooccurrence"), ("semantic", "semantic"))]
    return kinds[0].unionByName(kinds[1])


def adjacency(edges: DataFrame) -> DataFrame:
    """Rows (id, neighbours): sorted names on the other ends of undirected edges (a, b)."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
    return both.groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def layout(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of nodes by papers, widths of edges by weight, and a spiral to start a drawing from."""
    most = nodes.agg(F.greatest(F.lit(1), F.max("n_papers")).alias("_most"))
    place = F.row_number().over(Window.orderBy("id")) - 1
    angle, radius = place * 2.399963229728653, F.sqrt(place.cast("double")) * 40
    sized = nodes.crossJoin(F.broadcast(most)).withColumns({"size": 16 + 30 * F.col("n_papers") / F.col("_most"), "x": radius * F.cos(angle), "y": radius * F.sin(angle)}).drop("_most")
    widest = edges.agg(F.greatest(F.lit(1.0), F.max("weight")).alias("_most"))
    return sized, edges.crossJoin(F.broadcast(widest)).withColumn("width", 1 + 3 * F.col("weight") / F.col("_most")).drop("_most")
