"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

A corpus-wide index against which all documents are streamed would compare each document with each shard.  Here windows
choose their shard themselves: each window of 50 words has an anchor, the least hash among its runs of 10 words, and equal
windows have equal anchors.  Neighbouring windows with the same anchor form a segment.  Anchors met in one document only
are dropped; the distinct segments of the others go, as text, to the shard of their anchor.  A shard builds an FM-index of
its segments and streams the same segments' windows through it: backward search over the wavelet matrix gives the suffix
interval of each window, and the least document in it.  The index compares real words; hashes route windows, and copies of
a whole segment are told by 64 bits among those of the same anchor and indexed once, with the least document that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.fm_index import FMIndex
from sparkfolio.llm.shared import col, staged

#: Words of an anchor, and of a symbol of the index: windows are whole numbers of symbols.
ANCHOR, SYMBOL = 10, 10

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES, _BYTES2 = (np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[at : at + 8] for i in range(256)), "<u8") for at in (0, 8))
#: Numbers of a second hash that has nothing in common with the first.
_BASE2, _STEP2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x27D4EB2F165667C5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(int(base), -1, 1 << 64)
        both = []
        for b in (int(base), inverse):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors))
        have = _powers[int(base)] = (both[0], both[1])
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of any range of a sequence of hashes, from running sums."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        up, self.down = _power(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Segments:
    """Segments of a batch of texts: for each, its text, first and last window (in words of its text), anchor and hash.

    second: with ``ranges2``, hashes of ranges of words by other numbers from the bytes on.
    """

    def __init__(self, texts: list[bytes], window: int, second: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends_of_text = np.cumsum([len(t) + 1 for t in texts])
        space = _SPACE[raw]
        edges = np.diff(space.astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        words = Ranges(_BYTES[raw], _BASE).hash(starts, ends)
        text_of = np.searchsorted(ends_of_text, starts, side="right")
        self.first_word = np.searchsorted(text_of, np.arange(len(texts)))
        self.ranges = Ranges(words, _STEP)
        self.ranges2 = Ranges(Ranges(_BYTES2[raw], _BASE2).hash(starts, ends), _STEP2) if second else None
        n = len(words)
        if n < window:
            self.text = self.low = self.high = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.int64)
            return
        at = np.arange(n - ANCHOR + 1)
        runs = self.ranges.hash(at, at + ANCHOR)
        # Leftmost place of the least hash among the runs of each window, by doubling.
        least, width, wanted = at, 1, window - ANCHOR + 1
        while width < wanted:
            step = min(width, wanted - width)
            a, b = least[:-step], least[step:]
            least = np.where(runs[a] <= runs[b], a, b)
            width += step
        whole = np.flatnonzero(text_of[: n - window + 1] == text_of[window - 1 :])
        place = least[whole]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1))) if len(whole) else np.zeros(0, np.int64)
        low, high = whole[new], whole[np.append(new[1:], len(whole)) - 1] if len(whole) else np.zeros(0, np.int64)
        self.text = text_of[low]
        base = self.first_word[self.text]
        self.low, self.high = low - base, high - base
        self.anchor = runs[least[low]].view(np.int64)
        self.hash = self.ranges.hash(low, high + window).view(np.int64)


#: Bytes of texts that are hashed at once; a longer text is hashed alone.
CHUNK = 2 << 20


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a batch in runs of about ``CHUNK`` bytes: first row, row after the last, texts."""
    texts = [t or b"" for t in batch.column(column).to_pylist()]
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield at, i + 1, texts[at : i + 1]
            at, size = i + 1, 0


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Lengths and values of runs."""
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return np.diff(np.append(new, len(values))).tolist(), values[new].tolist()


def match_segments(texts: list[bytes], docs: np.ndarray, window: int) -> list[np.ndarray | None]:
    """For each segment, the least document that holds each of its windows; None where no window has two occurrences."""
    split = [t.split(b" ") for t in texts]
    sizes = np.array([len(s) for s in split])
    codes: dict[bytes, int] = {}
    words = np.fromiter((codes.setdefault(w, len(codes)) for s in split for w in s), np.int64, int(sizes.sum()))
    n = len(words)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - first[owner]
    # Symbols stand for runs of SYMBOL words: exact codes of pairs, of pairs of pairs, and so on.
    code, width, total = words, 1, words
    need, parts = SYMBOL, []
    while True:
        if need & 1:
            parts.append((code, width))
        need >>= 1
        if not need:
            break
        code = np.unique(code[:-width] * (int(code.max()) + 1) + code[width:], return_inverse=True)[1]
        width *= 2
    total, covered = parts[0]
    for code, width in parts[1:]:
        m = len(code) - covered
        total = np.unique(total[:m] * (int(code.max()) + 1) + code[covered : covered + m], return_inverse=True)[1]
        covered += width
    # A segment is read as SYMBOL strings, one for each offset, and each string as every SYMBOL-th symbol.
    usable = np.flatnonzero((place + SYMBOL <= sizes[owner])[: len(total)])
    order = np.lexsort((place[usable], place[usable] % SYMBOL, owner[usable]))
    usable = usable[order]
    string = owner[usable] * SYMBOL + place[usable] % SYMBOL
    shift = np.cumsum(np.append(0, string[1:] != string[:-1]))
    text = np.zeros(len(usable) + int(shift[-1]) + 1, np.int64)
    at = np.arange(len(usable)) + shift
    text[at] = total[usable] + 1
    _, text = np.unique(text, return_inverse=True)  # 0 stays the least, symbols become dense
    spot = np.zeros(n, np.int64)
    spot[usable] = at
    index = FMIndex(text)
    doc_of = np.zeros(len(text), np.int64)
    doc_of[at] = docs[owner[usable]]
    starts = np.flatnonzero(place + window <= sizes[owner])
    patterns = text[spot[starts][:, None] + np.arange(window // SYMBOL)[None, :]]
    low, high = index.search(patterns, least=2)
    least = docs[owner[starts]].copy()
    found = np.flatnonzero(high > low)
    if len(found):
        sorted_docs = np.append(doc_of[index.suffixes], np.iinfo(np.int64).max)
        left, inverse = np.unique(low[found], return_inverse=True)
        right = np.zeros(len(left), np.int64)
        right[inverse] = high[found]
        bounds = np.stack([left, right], axis=1).ravel()
        least[found] = np.minimum.reduceat(sorted_docs, bounds)[::2][inverse]
    hit = np.zeros(len(sizes), bool)
    hit[owner[starts[found]]] = True
    cut = np.searchsorted(owner[starts], np.arange(len(sizes) + 1))
    return [least[cut[i] : cut[i + 1]] if hit[i] else None for i in range(len(sizes))]


#: Words of an index; a shard with more builds one after the other. An anchor's segments are never parted.
INDEX_WORDS = 700_000


def deduplicate(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_segments: int = 20_000) -> DataFrame:
    """Rows (id, n_words, n_removed, kept): kept has the words that are left, joined by one space.

    Windows are judged on the input. Null, empty and short texts lose nothing; a row with a null id takes no part and keeps
    its words; rows that share an id are one document to each other and lose nothing to one another; an empty table gives an
    empty table; further columns are ignored. ``window`` is a multiple of 10 of at least 20 words. Ids of any type that sorts
    are compared in its order: ids that are no whole numbers are numbered in a table of their own first.

    An anchor with more than ``hot_segments`` distinct segments would need one large index, in one task, as its segments may
    share all but a few words of a window and no second anchor parts them: the windows of these segments are told apart by
    two unrelated 64-bit hashes of their words instead, with least documents taken before the shuffle.
    """
    if window % SYMBOL or window < 2 * ANCHOR:
        raise ValueError("the window must be a multiple of 10 words, at least 20")
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        # Numbers that grow with the ids: sorted by ranges, numbered within them.
        ids = df.select(col(id_col).alias("id")).where("id is not null").distinct().orderBy("id")
        ids = staged(ids.withColumn("doc", F.monotonically_increasing_id()), "ids")
        numbered = df.select(col(id_col).alias("id"), col(text_col).alias("text")).join(ids, "id", "left").select("doc", "text")
        found = deduplicate(numbered, window, "doc", "text", hot_segments)
        return found.join(ids, "doc", "left").select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")
    spark = df.sparkSession
    docs = df.select(col(id_col).cast("long").alias("doc"), col(text_col).cast("binary").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, texts in _chunks(batch, 1):
                s = Segments(texts, window)
                # A text that repeats itself has equal segments: one of them stands for all.
                order = np.lexsort((s.hash, s.text))
                text, seg = s.text[order], s.hash[order]
                order = order[np.append(True, (text[1:] != text[:-1]) | (seg[1:] != seg[:-1]))[: len(order)]]
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor[order]), pa.array(s.hash[order]), pa.array(ids[a:b][s.text[order]])], names=["anchor", "seg", "doc"])

    every = staged(docs.where("doc is not null").mapInArrow(anchors, "anchor long, seg long, doc long"), "anchors")
    shared = staged(every.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(F.col("anchor").alias("anchor_")), "shared")
    used = staged(every.join(shared, F.col("anchor") == F.col("anchor_"), "left_semi"), "used")
    distinct = staged(used.groupBy("anchor", "seg").agg(F.min("doc").alias("lo")), "segments")
    hot = staged(distinct.groupBy("anchor").count().where(F.col("count") > hot_segments).select(F.col("anchor").alias("anchor_")), "hot")
    any_hot = bool(hot.head(1))
    normal = distinct.join(hot, F.col("anchor") == F.col("anchor_"), "left_anti") if any_hot else distinct

    # The documents are dealt by id once: to cut out the segments, and again to remove words.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(parts, "doc")

    def of_docs(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy(F.col("lo").alias("doc_")).agg(F.collect_list("seg").alias("segs"))
        # A left join leaves the documents' exchange as the removal needs it, so that both read one; rows without segments are
        # passed over where segments are cut.
        return dealt.join(wanted, F.col("doc") == F.col("doc_"), "left").select("doc", "text", "segs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            for a, b, texts in _chunks(batch, 1):
                s = Segments(texts, window)
                bounds = np.searchsorted(s.text, np.arange(len(texts) + 1))
                anchor, seg, doc, cuts = [], [], [], []
                for i, t in enumerate(texts):
                    lo, hi = bounds[i], bounds[i + 1]
                    take = lo + np.flatnonzero(np.isin(s.hash[lo:hi], wanted[a + i].values.to_numpy()))
                    take = take[np.unique(s.hash[take], return_index=True)[1]]
                    words = t.split()
                    for k in take.tolist():
                        anchor.append(s.anchor[k])
                        seg.append(s.hash[k])
                        doc.append(ids[a + i])
                        cuts.append(b" ".join(words[s.low[k] : s.high[k] + window]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(doc, pa.int64()), pa.array(cuts, pa.binary())], names=["anchor", "seg", "doc", "words"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            full = pa.Table.from_batches(rows)
            found = match_segments(full.column("words").to_pylist(), full.column("doc").to_numpy(), window)
            keep = [i for i, f in enumerate(found) if f is not None]
            # What a segment's other documents need: its windows' least documents. A segment of one document whose windows
            # occur twice in that document alone says nothing and is dropped where it is used.
            pairs = [_runs(found[i]) for i in keep]
            return pa.RecordBatch.from_arrays(
                [full.column("anchor").take(pa.array(keep, pa.int64())).combine_chunks(), full.column("seg").take(pa.array(keep, pa.int64())).combine_chunks(), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.int64()))],
                names=["anchor", "seg", "sizes", "least"],
            )

        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 2048)
                at += part.num_rows
                held.append(part)
                size += part.num_rows * (window + window // 2)
                if size >= INDEX_WORDS:
                    key = part.column(0).to_numpy()
                    other = np.flatnonzero(key != key[-1])
                    if len(other):
                        cut_at = int(other[-1]) + 1
                        held[-1] = part.slice(0, cut_at)
                        yield flush(held)
                        held = [part.slice(cut_at)]
                        size = held[0].num_rows * (window + window // 2)
        if held and sum(h.num_rows for h in held):
            yield flush(held)

    cuts = of_docs(normal).mapInArrow(cut, "anchor long, seg long, doc long, words binary")
    matched = cuts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(match, "anchor long, seg long, sizes array<int>, least array<long>")
    # A segment that only its own document holds, found twice in it, isn't in the index twice; one that several documents
    # hold is in the index once: its windows' least document is its own least.
    alone = distinct.join(hot, F.col("anchor") == F.col("anchor_"), "left_anti") if any_hot else distinct
    answers = alone.join(matched.withColumnsRenamed({"anchor": "anchor_", "seg": "seg_"}), (F.col("anchor") == F.col("anchor_")) & (F.col("seg") == F.col("seg_")), "left").select("anchor", "seg", "lo", "sizes", "least")
    if any_hot:
        answers = answers.unionByName(_hot_answers(of_docs(distinct.join(hot, F.col("anchor") == F.col("anchor_"), "left_semi")), distinct, window))

    hits = used.join(answers.withColumnsRenamed({"anchor": "anchor_", "seg": "seg_"}), (F.col("anchor") == F.col("anchor_")) & (F.col("seg") == F.col("seg_")))
    hits = hits.where((F.col("lo") < F.col("doc")) | F.exists("least", lambda x: x < F.col("doc")))
    hits = hits.select("doc", F.struct("seg", "lo", "sizes", "least").alias("hit")).distinct().groupBy(F.col("doc").alias("doc_")).agg(F.collect_list("hit").alias("hits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hits = batch.column(0).to_pylist(), batch.column(2)
            for a, b, texts in _chunks(batch, 1):
                some = [i for i in range(b - a) if hits[a + i].is_valid]
                s = Segments([texts[i] for i in some], window) if some else None
                bounds = np.searchsorted(s.text, np.arange(len(some) + 1)) if some else None
                where = {i: k for k, i in enumerate(some)}
                n_words, n_removed, kept = [], [], []
                for i, t in enumerate(texts):
                    words = t.split()
                    removed = 0
                    if i in where:
                        doc = ids[a + i]
                        said = {h["seg"]: h for h in hits[a + i].as_py()}
                        cover = np.zeros(len(words) + 1, np.int64)
                        for k in range(bounds[where[i]], bounds[where[i] + 1]):
                            if (h := said.get(int(s.hash[k]))) is None:
                                continue
                            lo, hi = int(s.low[k]), int(s.high[k])
                            if h["lo"] < doc:
                                gone = np.arange(lo, hi + 1)
                            else:
                                gone = lo + np.flatnonzero(np.repeat(np.array(h["least"], np.int64), h["sizes"]) < doc)
                            np.add.at(cover, gone, 1)
                            np.subtract.at(cover, gone + window, 1)
                        stay = np.cumsum(cover)[:-1] == 0
                        removed = int(len(words) - stay.sum())
                        kept.append(b" ".join([w for w, x in zip(words, stay.tolist()) if x]))
                    else:
                        kept.append(b" ".join(words))
                    n_words.append(len(words))
                    n_removed.append(removed)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    out = dealt.join(hits, F.col("doc") == F.col("doc_"), "left").select("doc", "text", "hits").mapInArrow(remove, schema)
    return out.withColumn(id_col, col(id_col).cast(df.schema[id_col].dataType))


def _hot_answers(docs: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """Answers for segments of hot anchors: each window by two unrelated hashes, its least document summed before the shuffle."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids = batch.column(0).to_numpy()
            for a, b, texts in _chunks(batch, 1):
                s = Segments(texts, window, second=True)
                wanted = set(pa.concat_arrays([x.values for x in batch.column(2).slice(a, b - a)]).to_pylist())
                take = np.flatnonzero([h in wanted for h in s.hash.tolist()])
                n = s.high[take] - s.low[take] + 1
                which = np.repeat(take, n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = s.first_word[s.text[which]] + s.low[which] + step
                one, two = s.ranges.hash(at, at + window), s.ranges2.hash(at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor[which]), pa.array(s.hash[which]), pa.array(step), pa.array(ids[a:b][s.text[which]]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["anchor", "seg", "step", "doc", "h1", "h2"])

    spread_rows = staged(docs.mapInArrow(spread, "anchor long, seg long, step long, doc long, h1 long, h2 long"), "windows")
    least = spread_rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    per = spread_rows.join(least, ["h1", "h2"]).groupBy("anchor", "seg").agg(F.min("doc").alias("lo"), F.sort_array(F.collect_set(F.struct("step", "first"))).alias("w"))
    return per.select("anchor", "seg", "lo", F.transform("w", lambda x: F.lit(1)).alias("sizes"), F.col("w.first").alias("least"))
