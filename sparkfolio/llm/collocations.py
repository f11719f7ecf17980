"""Phrase collocation mining: generalised suffix automata per shard, counts reduced over all shards.

A phrase of several words that occurs often enough consists of words and of pairs of words that do.  So words are counted
first, then pairs of frequent words, and both leave a filter of bounded size which lets through all that are frequent (and,
of the others, a share that falls with its size).  What remains of a shard's texts are runs of words whose neighbouring
pairs all pass; a generalised suffix automaton of the runs, each inserted once with its number of occurrences, counts end
positions, and its states yield each distinct phrase of bounded length once.  Sums over the shards are exact counts.

Among phrases of bounded length the suffix link of a phrase leads to the phrase without its first word, and its stem is the
phrase without its last one.  Counts never grow along either, so a phrase lies in a longer one that is nearly as frequent if
and only if it does in one of one word more: one step along links and stems, followed backward, decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.shared import col, staged

#: Stands for the end of a piece: a byte that no text in UTF-8 holds.
END = b"\xff"
#: Capital letters to small ones, ends of pieces to END, tabs to spaces.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
#: Bits of a filter: the least, and the most (32 MB) unless the caller allows more.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bits in one row of Spark's bitmaps.
ROW_BITS = 32_768
#: Distinct words that a task keeps, and words of distinct runs in one automaton.
TASK_WORDS, SHARD_WORDS = 400_000, 150_000
#: Bytes of text that a task turns at once.
TASK_BYTES = 1_000_000
#: Pairs that a task gathers before it counts them.
TASK_PAIRS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, with END between pieces."""
    return text.translate(TABLE).replace(END, b" " + END + b" ").split()


# -- filters of bounded size ------------------------------------------------------------------------------------------


def bits_for(members: int, most: int = MOST_BITS) -> int:
    """A power of two, at least 64 times the members within the bounds."""
    return min(max(LEAST_BITS, 1 << (64 * members).bit_length()), most)


def bitmap(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """Bytes of a filter that holds all keys (64-bit hashes): at most ``bits`` / 8 bytes reach the driver."""
    place = F.shiftrightunsigned(key, 64 - (bits.bit_length() - 1)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r.row - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def passes(filtered: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    place = hashes >> np.uint64(64 - (8 * len(filtered)).bit_length() + 1)
    return (filtered[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits that stand for two words in this order."""
    h = (a * MIX) ^ (b + MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


# -- what tasks do ----------------------------------------------------------------------------------------------------


class Frequent(dict):
    """Numbers of a language's words that a filter lets through, from 1; 0 for others.  Hashes are Spark's (language, word)."""

    def __init__(self, lang: str, filtered: np.ndarray):
        import xxhash

        super().__init__({END: 0})
        self.hash_of = xxhash.xxh64_intdigest
        self.seed = self.hash_of(lang.encode(), 42)
        self.filtered, self.shift = filtered, 64 - (8 * len(filtered)).bit_length() + 1
        self.words: list[bytes] = [END]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        h = self.hash_of(word, self.seed)
        place, number = h >> self.shift, 0
        if self.filtered[place >> 3] >> (place & 7) & 1:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = number
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        """Words of a text by number, with a 0 at its end."""
        words = words_of(text)
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out


class Automaton:
    """A generalised suffix automaton of sequences of numbers, each inserted with its number of occurrences."""

    def __init__(self) -> None:
        self.symbols: list[int] = []  # all sequences, one after the other
        self.length, self.link, self.count, self.end = [0], [-1], [0], [-1]
        self.next: list[dict[int, int]] = [{}]

    def insert(self, sequence: list[int], times: int) -> None:
        last, count, length = 0, self.count, self.length
        for symbol in sequence:
            state = self.next[last].get(symbol)
            if state is None:
                state = self._extended(last, symbol)
            elif length[state] != length[last] + 1:
                state = self._split(last, symbol, state)
            count[state] += times
            self.symbols.append(symbol)
            last = state

    def _state(self, length: int, link: int, follows: dict[int, int], end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        self.end.append(end)
        self.next.append(follows)
        return len(self.length) - 1

    def _extended(self, last: int, symbol: int) -> int:
        state = self._state(self.length[last] + 1, 0, {}, len(self.symbols))
        follows, at = self.next, last
        while at >= 0 and symbol not in follows[at]:
            follows[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            other = follows[at][symbol]
            self.link[state] = other if self.length[other] == self.length[at] + 1 else self._split(at, symbol, other)
        return state

    def _split(self, last: int, symbol: int, state: int) -> int:
        """The state of the sequences up to ``last``'s longest one and a symbol, taken out of the state that also has longer ones."""
        own = self._state(self.length[last] + 1, self.link[state], dict(self.next[state]), self.end[state])
        self.link[state] = own
        follows, at = self.next, last
        while at >= 0 and follows[at].get(symbol) == state:
            follows[at][symbol] = own
            at = self.link[at]
        return own

    def phrases(self, least: int, most: int) -> Iterator[tuple[int, int, int]]:
        """Distinct sequences of ``least`` to ``most`` symbols as (start, end, occurrences): where one stands in ``symbols``.

        A state's sequences end at the same places; their number is its own and that of all whose suffix links lead to it.
        """
        count = list(self.count)
        order = np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist()
        for state in order:
            count[self.link[state]] += count[state]
        for state in order:
            for size in range(max(least, self.length[self.link[state]] + 1), min(most, self.length[state]) + 1):
                yield self.end[state] - size + 1, self.end[state] + 1, count[state]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, those of a batch in parts of about TASK_BYTES; empty ones are left out."""
    for batch in batches:
        parts: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            parts.setdefault(lang, []).append(text)
            size += len(text)
            if size > TASK_BYTES:
                yield from parts.items()
                parts, size = {}, 0
        yield from parts.items()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "f"])
        counts.clear()

    for lang, texts in _by_lang(batches):
        count = counts.setdefault(lang, Counter())
        for text in texts:
            count.update(words_of(text))
        if sum(map(len, counts.values())) > TASK_WORDS:
            yield from out()
    yield from out()


def _pair_rows(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    known: dict[str, Frequent] = {}
    held: list[np.ndarray] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], names=["pair", "f"])
            held.clear()

    for lang, texts in _by_lang(batches):
        words = known.get(lang) or known.setdefault(lang, Frequent(lang, frequent))
        found = np.concatenate([words.numbers(t) for t in texts])
        at = np.flatnonzero((found[:-1] > 0) & (found[1:] > 0))
        hashes = np.array(words.hashes, np.uint64)
        held.append(pair_hashes(hashes[found[at]], hashes[found[at + 1]]))
        size += len(at)
        if size > TASK_PAIRS:
            yield from out()
            size = 0
        if sum(map(len, known.values())) > TASK_WORDS:
            known.clear()
    yield from out()


def _phrase_rows(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, pairs: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    known: dict[str, Frequent] = {}
    runs: dict[str, Counter] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in runs.items():
            automaton, words = Automaton(), known[lang].words
            for run, times in found.items():
                automaton.insert(np.frombuffer(run, np.int32).tolist(), times)
            spelt = [words[i] for i in automaton.symbols]
            phrases, counts = [], []
            for start, end, count in automaton.phrases(2, longest):
                phrases.append(b" ".join(spelt[start:end]))
                counts.append(count)
                if len(phrases) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])
                    phrases, counts = [], []
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])
        runs.clear()
        known.clear()

    for lang, texts in _by_lang(batches):
        words = known.get(lang) or known.setdefault(lang, Frequent(lang, frequent))
        own = runs.setdefault(lang, Counter())
        found = np.concatenate([words.numbers(t) for t in texts])
        at = np.flatnonzero((found[:-1] > 0) & (found[1:] > 0))
        hashes = np.array(words.hashes, np.uint64)
        at = at[passes(pairs, pair_hashes(hashes[found[at]], hashes[found[at + 1]]))]
        ok = np.zeros(len(found) + 1, np.int8)
        ok[at + 1] = 1
        edges = np.diff(ok)  # 1: a run's first pair starts here; -1: its last pair started at the place before
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            run = found[a : b + 1].tobytes()
            if run not in own:
                size += b + 1 - a
            own[run] += 1
        if size > SHARD_WORDS or sum(map(len, known.values())) > TASK_WORDS:
            yield from out()
            size = 0
    yield from out()


# -- what Spark does --------------------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (lang, word, f) of texts (text, lang)."""
    return texts.mapInArrow(_word_rows, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def count_phrases(texts: DataFrame, words: DataFrame, least: int, longest: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows (lang, phrase, f) of phrases of 2 to ``longest`` words with at least ``least`` occurrences; words: what ``count_words`` finds."""
    context = texts.sparkSession.sparkContext
    often = words.where(F.col("f") >= least)
    frequent = context.broadcast(bitmap(often, F.xxhash64("lang", "word"), bits_for(often.count(), most_bits)))
    counted = texts.mapInArrow(lambda batches: _pair_rows(batches, frequent.value), "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f"))
    pairs = staged(counted.where(F.col("f") >= least).select("pair"), "pairs")
    passing = context.broadcast(bitmap(pairs, F.col("pair"), bits_for(pairs.count(), most_bits)))
    rows = texts.mapInArrow(lambda batches: _phrase_rows(batches, frequent.value, passing.value, longest), "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(
    df: DataFrame, least: int = 30, longest: int = 4, subsumed_percent: int = 80, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's phrases that occur more together than their parts do.

    Words are told apart after A-Z became small letters; phrases don't cross ``. , ; : ! ?`` and line ends, and lie within one
    row.  a, l, r: occurrences, overlapping ones included, of the phrase (at least ``least``), of its first words and of the rest
    at the cut with the lowest score floor(2000000 a / (l + r)), the earliest of equals; n: all words of the language.  A phrase
    that lies in a longer one with at least ``subsumed_percent`` of its occurrences is left out.  Ranked by score and a,
    descending, and phrase in the order of its bytes; ``top`` first of each language (None: all).

    A null text is empty, a null language ``und``; repeated rows count each time; an empty table gives an empty table; further
    columns are ignored.  All texts are read three times, and nothing is sampled.  Two filters of at most ``most_bits`` bits reach the driver and
    each worker; with fuller ones more words go through the automata, and results stay the same.  Phrases, not their occurrences,
    are shuffled, summed before.  A pair's frequency is judged by 64 bits that stand for it, which can only let more through.
    """
    texts = df.select(col(text_col).alias("text"), F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = staged(count_words(texts), "words")
    phrases = staged(count_phrases(texts, words, least, longest, most_bits), "phrases")
    return rank(score(phrases, words, least, subsumed_percent), top)


def score(phrases: DataFrame, words: DataFrame, least: int, subsumed_percent: int) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of the phrases that no longer one subsumes, from counts of all (f)."""
    split = F.split("phrase", " ")
    size = F.size("parts")
    rows = phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("parts"))
    part = lambda start, count: F.array_join(F.slice("parts", start, count), " ")
    # Both sides of each cut look up their counts; a phrase's few cuts meet again.
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(True).alias("left"), part(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(False).alias("left"), part(k + 1, size - k).alias("part")))))
    asked = rows.select("lang", "phrase", "a", F.inline(cuts))
    known = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "f"))
    sides = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # `div` of decimals gives a long: no product is rounded.
    each = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = sides.withColumn("score", each).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # One step along suffix links (the first word goes) and stems (the last one goes).
    longer = rows.where(size > 2).select("lang", F.col("a").alias("f"), F.explode(F.array(part(F.lit(2), size - 1), part(F.lit(1), size - 1))).alias("phrase"))
    above = longer.groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    free = best.join(above, ["lang", "phrase"], "left").where(F.col("above").isNull() | (_big("above") * 100 < _big("a") * subsumed_percent))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return free.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def rank(scored: DataFrame, top: int | None) -> DataFrame:
    """Each language's phrases ranked, the first ``top`` of them: those of parts of a language first, so that no task gets all."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    if top is not None:
        parts = max(8, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        some = Window.partitionBy("lang", "part").orderBy(*order)
        scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("place", F.row_number().over(some)).where(F.col("place") <= top).drop("part", "place")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
