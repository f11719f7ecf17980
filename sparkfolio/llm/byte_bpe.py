"""Byte-level BPE encoding and decoding by a walk over a trie of words.

Merging a text's bytes in the order of their ranks leaves tokens of which any two neighbours, merged alone, stay these two; and
no other sequence has that.  So the encoding of a prefix is told by its last token: the token ends at the prefix's end, starts
where a shorter prefix ends, and goes together with that one's last token.  The distinct words of a batch are put into a
trie; walked depth first, each node takes the last token of its prefix from the nodes above it.  What words have in common at
their start is thus computed once, and a word's ids are read off the path that leads to it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.shared import col

#: Letters and numbers of Unicode versions after the one that the library knows; to it they are other signs.
LATER_SIGNS = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)

#: What a text is cut into before merging: contractions, letters, numbers, other signs, white space.
CUT = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
WORDS = CUT.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")
WORDS_WITH_LATER = CUT.format(letter=rf"[\p{{L}}--[{LATER_SIGNS}]]", number=rf"[\p{{N}}--[{LATER_SIGNS}]]", other=rf"[[^\s\p{{L}}\p{{N}}]||[{LATER_SIGNS}]]")

#: Pieces of texts, between spaces and line ends, whose ids a Python worker keeps.
CACHE_PIECES = 1_000_000
#: Characters of text that are turned at once.
CHARACTERS = 1_000_000


def _alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a vocabulary file: printable ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file.  Each Python worker makes its own; ``cache_pieces`` bounds what it keeps."""

    def __init__(self, vocabulary: bytes, cache_pieces: int = CACHE_PIECES):
        import regex

        file = json.loads(vocabulary)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or model.get("byte_fallback") or model.get("ignore_merges") or file.get("normalizer"):
            raise ValueError("only plain merge vocabularies over bytes, without normalisation, are supported")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only texts cut by the byte level's own pattern, without a space before them, are supported")
        added = file.get("added_tokens", [])
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added):
            raise ValueError("only added tokens that stand for themselves are supported")
        signs = _alphabet()
        plain = lambda s: bytes(map(signs.__getitem__, s))
        self.ids = {plain(t): i for t, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(plain(a), plain(b)): rank for rank, (a, b) in enumerate(pairs)}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("each byte must be a token")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self._words, self._words_with_later = regex.compile(WORDS).findall, regex.compile(WORDS_WITH_LATER).findall
        self.tokens: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for t, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.tokens[i] = t
        # Starts of tokens; where a path ends, its longest end among them tells all tokens that end there.
        self.starts: list[bytes] = [b""]
        self.start_of: dict[bytes, int] = {b"": 0}
        for token in self.ids:
            for size in range(len(token), 0, -1):
                if token[:size] in self.start_of:
                    break
                self.start_of[token[:size]] = len(self.starts)
                self.starts.append(token[:size])
        self._steps: dict[int, int] = {}
        self._ends: dict[int, list[tuple[int, int]]] = {}
        self.le = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self._fits: dict[int, bool] = {}
        self.cache_pieces = cache_pieces
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- pairs of tokens --------------------------------------------------------------------------------------------

    def merge(self, text: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals; for single tokens and pairs of them."""
        parts: list[bytes | None] = [text[i : i + 1] for i in range(len(text))]
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(parts):
                pair = parts[left], parts[after[left]]
                if (rank := self.ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, left, *pair))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if parts[left] != a or right >= len(parts) or parts[right] != b:
                continue
            parts[left], parts[right] = a + b, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [p for p in parts if p is not None]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens yields these two; with -1 on the left, the token alone."""
        key = (left << 20) + right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            both = [self.tokens[i] for i in (left, right) if i >= 0]
            known = self._fits[key] = self.merge(b"".join(both)) == both
        return known

    # -- the trie ---------------------------------------------------------------------------------------------------

    def step(self, start: int, byte: int) -> int:
        """The longest end of a path that starts a token, by that of the path without its last byte."""
        end = self.starts[start] + bytes([byte])
        while end not in self.start_of:
            end = end[1:]
        if len(self._steps) > 1_000_000:
            self._steps.clear()
        known = self._steps[(start << 8) + byte] = self.start_of[end]
        return known

    def ends(self, start: int) -> list[tuple[int, int]]:
        """Tokens, with their sizes, that a path ends with, longest first."""
        text = self.starts[start]
        known = self._ends[start] = [(self.ids[text[i:]], len(text) - i) for i in range(len(text)) if text[i:] in self.ids]
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers: a depth-first walk over their trie."""
        trie = Trie(words)
        steps, ends, fits, le = self._steps.get, self._ends.get, self._fits.get, self.le
        found: dict[bytes, bytes] = {}
        # Of the path's first d bytes: the end that starts a token, the last token and its size.
        deepest = max(map(len, trie.words), default=0) + 1
        starts, last, sizes = [0] * deepest, [-1] * deepest, [0] * deepest
        for byte, depth, word in trie.preorder():
            start = starts[depth - 1]
            if (at := steps((start << 8) + byte)) is None:
                at = self.step(start, byte)
            starts[depth] = at
            for token, size in ends(at) or self.ends(at):
                before = last[depth - size]
                fit = fits((before << 20) + token)
                if self.fits(before, token) if fit is None else fit:
                    last[depth], sizes[depth] = token, size
                    break
            else:
                raise AssertionError("a prefix without a last token")
            if word is not None:
                code = le[token]
                while depth := depth - sizes[depth]:
                    code = le[last[depth]] + code
                found[word] = code
        return found

    # -- texts ------------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """What is merged by itself, in order."""
        return self._words(text) if text.isascii() or max(text) < LATER_SIGNS[0] else self._words_with_later(text)

    def _pieces(self, text: str) -> list[str]:
        """What a text's ids can be put together from, each piece coded alone: lines' words with the space before them.

        A word's first sign is told from what stands before it by the space or the line end, as long as no further white space
        meets these; a text where it does is cut by the whole pattern instead.
        """
        if "  " not in text:
            pieces: list[str] = []
            for line in text.split("\n"):
                first, *later = line.split(" ")
                pieces += ("\n", first, *map(" ".__add__, later))
            del pieces[0]
            if "" not in pieces and " " not in pieces:
                return pieces
        return self.words(text)

    def _regular(self, piece: str) -> bool:
        """Whether a piece ends and, but for one space, starts with no white space, so that none meets a neighbour's."""
        inner = piece[1:] if piece[0] == " " else piece
        return piece == "\n" or not (inner[:1].isspace() or inner[-1:].isspace() or not inner)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, as little-endian unsigned 32-bit integers.  Added tokens are found in texts as they stand."""
        parts: list[list[str | int]] = []  # of each text: stretches of text, and ids of added tokens
        for text in texts:
            if self.cut_added is not None and any(t in text for t in self.added):
                parts.append([self.added.get(p, p) for p in self.cut_added.split(text) if p])
            else:
                parts.append([text] if text else [])
        cut = {t: self._pieces(t) for stretches in parts for t in stretches if isinstance(t, str)}
        new = set().union(*cut.values()) - self.kept.keys()
        if len(self.kept) + len(new) > self.cache_pieces // 2:
            self.older, self.kept = self.kept, {}
            new = set().union(*cut.values())
        for piece in new & self.older.keys():
            self.kept[piece] = self.older[piece]
        new -= self.kept.keys()
        odd = {p for p in new if not self._regular(p)}
        if odd:  # their texts are cut by the whole pattern: its words meet no neighbour's
            for text, pieces in cut.items():
                if not odd.isdisjoint(pieces):
                    cut[text] = self.words(text)
                    new.update(cut[text])
            new -= self.kept.keys()
            odd |= {p for p in new if not self._regular(p)}
        words = {p: self.words(p) for p in new}  # a word of the whole pattern is one by itself, too
        known = self.kept
        codes = self.encode_words({w.encode() for found in words.values() for w in found if w not in known})
        fresh = {p: b"".join([known[w] if w in known else codes[w.encode()] for w in found]) for p, found in words.items()}
        known.update((p, c) for p, c in fresh.items() if len(p) <= 64 and p not in odd)
        get = lambda p: code if (code := known.get(p)) is not None else fresh[p]
        out = []
        for stretches in parts:
            codes_of = []
            for part in stretches:
                if isinstance(part, int):
                    codes_of.append(self.le[part])
                    continue
                try:
                    codes_of.append(b"".join(map(known.__getitem__, cut[part])))
                except KeyError:
                    codes_of.append(b"".join(map(get, cut[part])))
            out.append(b"".join(codes_of))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of ids, added tokens included. Bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.tokens.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


class Trie:
    """Distinct words as a trie whose nodes stand in arrays, in depth-first order: the byte that leads to a node, and its depth.

    Sorted words meet their nodes in this order: each adds those below what it has in common with the word before it.
    """

    #: Bytes that are compared for all words at once; what neighbours have in common beyond is found byte by byte.
    WIDE = 32

    def __init__(self, words: Iterable[bytes]):
        self.words = sorted(w for w in words if w)
        n, wide = len(self.words), self.WIDE
        self.sizes = np.fromiter(map(len, self.words), np.int64, n)
        heads = np.frombuffer(b"".join([w[:wide].ljust(wide, b"\0") for w in self.words]), np.uint8).reshape(n, wide)
        self.shared = np.zeros(n, np.int64)
        if n > 1:
            differ = np.concatenate([heads[1:] != heads[:-1], np.ones((n - 1, 1), bool)], axis=1)
            self.shared[1:] = np.minimum(differ.argmax(axis=1), np.minimum(self.sizes[1:], self.sizes[:-1]))
            for i in np.flatnonzero(self.shared == wide).tolist():
                a, b = self.words[i - 1], self.words[i]
                at, most = wide, min(len(a), len(b))
                while at < most and a[at] == b[at]:
                    at += 1
                self.shared[i] = at

    def preorder(self) -> Iterator[tuple[int, int, bytes | None]]:
        """Nodes as (byte, depth, word that ends there)."""
        shared = self.shared.tolist()
        tails = b"".join([w[k:] for w, k in zip(self.words, shared)])
        counts = self.sizes - self.shared
        ends = np.cumsum(counts)
        depths = np.arange(1, len(tails) + 1) - np.repeat(ends - counts, counts) + np.repeat(self.shared, counts)
        closing: list[bytes | None] = [None] * len(tails)
        for at, word in zip((ends - 1).tolist(), self.words):
            closing[at] = word
        return zip(tails, depths.tolist(), closing)


_codecs: dict[tuple[bytes, int], ByteBpe] = {}


def codec_of(vocabulary: bytes, cache_pieces: int = CACHE_PIECES) -> ByteBpe:
    """The worker's codec of a vocabulary: tasks that follow each other in a Python worker share what it keeps."""
    key = vocabulary, cache_pieces
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteBpe(vocabulary, cache_pieces)
    return _codecs[key]


def _parts(batch: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most CHARACTERS of text, or of one row."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > CHARACTERS:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def encode_documents(df: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Rows (id, ids, decoded): ``ids`` is an array of integers, ``decoded`` their decoded text (null unless ``decode``).

    Each row is coded whole and alone: no shuffle; tasks keep nothing of other rows but a bounded cache.  Null and empty texts
    give no ids and an empty decoded text; null ids of rows are kept; repeated rows are coded as often as they occur; an empty
    table gives an empty table; further columns of ``df``, whatever their names, are ignored.  No begin, end, cut or padding.
    ``vocabulary`` is the vocabulary file's content, two megabytes, sent with the task.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, cache_pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _parts(batch, texts):
                raw = codec.encode_all([t or "" for t in texts[start:end]])
                values = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
                decoded = [None] * len(raw)
                if decode:
                    flat = values.tolist()
                    decoded = [codec.decode(flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids, pa.array(decoded, pa.binary()).cast(pa.string())], names=[id_col, "ids", "decoded"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return df.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(code, schema)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: number of ids, and digests of the ids, in decimal joined by commas, and of the decoded text."""
    return coded.select(
        col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
