"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by backtracking.

Instead of replaying merges over a whole text, a piece sequence is built from left to right: longest matches come from an
Aho-Corasick automaton, a piece may follow another only if merging both pieces' characters anew yields just these two,
and positions from which no sequence leads on are held in a bit field, so each is tried once.  For merge-type
vocabularies with distinct scores this is the merge result, because a sequence whose neighbours are all compatible is
the only one that merging can end in.

Pieces of white space only share one score, the lowest of all; they are merged last and from the left, so their runs are
merged directly, after the words beside them have taken what they take.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at, end = 0, len(message)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


#: Words whose ids a Python worker keeps; half as many take a tenth less memory of an executor and up to half more time.
CACHE_WORDS = 1_000_000


class Codec:
    """Encoder and decoder of one model.  Not shared between processes: each Python worker makes its own.

    Supported models: merge type, identity normalisation, dummy prefix, no removal of extra white space, byte fallback.
    ``cache_words`` bounds the words whose ids are kept.
    """

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS):
        import struct

        import ahocorasick

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        kind_of_model = 1
        rules = {"name": b"identity", "prefix": 1, "trim": 1, "escape": 1}
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                found = dict(_fields(value))
                rules = {"name": found.get(1, b""), "map": found.get(2, b""), "prefix": found.get(3, 1), "trim": found.get(4, 1), "escape": found.get(5, 1)}
        if kind_of_model != 2 or rules.get("map") or (rules["prefix"], rules["trim"], rules["escape"]) != (1, 0, 1):
            raise ValueError("only merge-type models with identity normalisation, dummy prefix and kept white space are supported")
        # Kinds of pieces in the format: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
        self.unknown = self.kinds.index(2)
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1}
        if any(k in (4, 5) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        named = {p: i for i, p in enumerate(self.pieces)}
        self.bos, self.eos = named.get("<s>", -1), named.get("</s>", -1)
        self.byte_ids = [named[f"<0x{b:02X}>"] for b in range(256)]
        self.ids, self.scores = ids, scores
        blank = [i for p, i in ids.items() if len(p) > 1 and not p.strip(SPACE)]
        lowest = min((scores[i] for p, i in ids.items() if len(p) > 1 and i not in set(blank)), default=0.0)
        multi = [scores[i] for p, i in ids.items() if len(p) > 1 and p.strip(SPACE)]
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in ids):
            raise ValueError("pieces that cross a word's start are not supported")
        if any(scores[i] >= lowest for i in blank) or len(multi) != len(set(multi)):
            raise ValueError("scores of words' pieces must differ and lie above those of white space")
        if any(c not in ids for p in ids for c in p):
            raise ValueError("each character of a piece must be a piece")
        self.automaton = ahocorasick.Automaton()
        for p, i in ids.items():
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.lines = "\n" not in ids
        self.cache_words = cache_words
        self.le = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.raw = [b"" if k in (2, 3) else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self._shorter: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._runs: dict[int, bytes] = {}
        self._first, self._later = _Words(self, ""), _Words(self, SPACE)

    # -- merging --------------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Plain merging, highest score first and leftmost among equals; for pairs of pieces and runs of white space."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(parts):
                both = parts[left] + parts[after[left]]
                if both in self.ids:
                    heapq.heappush(heap, (-self.scores[self.ids[both]], left, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, left, both = heapq.heappop(heap)
            if parts[left] is None or (right := after[left]) >= len(parts) or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [p for p in parts if p is not None]

    def alone(self, piece: int) -> bool:
        """Whether merging a piece's own characters yields it."""
        if (known := self._alone.get(piece)) is None:
            known = self._alone[piece] = self.merge(self.pieces[piece]) == [self.pieces[piece]]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces yields these two; with -1 on the left, the piece alone."""
        if left < 0:
            return self.alone(right)
        if self.kinds[left] == 6 or self.kinds[right] == 6:
            return True  # a byte is no piece that merges
        if (known := self._fits.get((left << 20) + right)) is None:
            if len(self._fits) > 600_000:
                self._fits.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._fits[(left << 20) + right] = self.merge(a + b) == [a, b]
        return known

    def shorter(self, piece: int) -> int:
        """The longest piece that a piece begins with, itself excluded; -1 if none."""
        if (known := self._shorter.get(piece)) is None:
            text, known = self.pieces[piece], -1
            for size in range(len(text) - 1, 0, -1):
                if (known := self.ids.get(text[:size], -1)) >= 0:
                    break
            self._shorter[piece] = known
        return known

    # -- encoding -------------------------------------------------------------------------------------------------

    def _known(self, text: str, longest: list[int]) -> list[int]:
        """Ids of characters that all are pieces. longest: at each position, the longest piece that starts there."""
        n, sizes, fits, tried = len(text), self.sizes, self._fits.get, self.fits
        closed = bytearray(n + 1)  # set: no sequence leads on from this position
        found: list[int] = []
        at, piece, last = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + sizes[piece]
                if not closed[end]:
                    fit = fits((last << 20) + piece)
                    if tried(last, piece) if fit is None else fit:
                        break
                piece = self.shorter(piece)
            if piece >= 0:
                found.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else -1
            else:
                closed[at] = 1
                piece = found.pop()
                last = found[-1] if found else -1
                at -= sizes[piece]
        return found

    def word_ids(self, text: str) -> list[int]:
        """Ids of a text without runs of white space: characters outside the vocabulary become bytes."""
        longest = [-1] * len(text)
        for end, (less, piece) in self.automaton.iter(text):
            longest[end - less] = piece  # later ends are longer pieces
        if -1 not in longest:
            return self._known(text, longest) if text else []
        found: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:
                found += [self.byte_ids[b] for b in text[at].encode("utf-8", "replace")]
                at += 1
                continue
            end = at
            while end < len(text) and longest[end] >= 0:
                end += 1
            found += self._known(text[at:end], longest[at:end])
            at = end
        return found

    def word(self, text: str, prefix: str) -> bytes:
        """Ids of a word as bytes. A word's last signs are often told apart from its letters: both parts are looked up
        alone, and put together if the pieces that meet are compatible, which makes the whole sequence the word's."""
        stem = text.rstrip(".,;:!?#$%&*|)]\"'")
        if stem and len(stem) < len(text):
            left, right = (self._later if prefix else self._first)[stem], self._first[text[len(stem) :]]
            if self.fits(int.from_bytes(left[-4:], "little"), int.from_bytes(right[:4], "little")):
                return left + right
        le = self.le
        return b"".join([le[i] for i in self.word_ids(prefix + text)])

    def run(self, length: int) -> bytes:
        """Ids of so many spaces, as bytes."""
        if (known := self._runs.get(length)) is None:
            known = b"".join(self.le[self.ids[p]] for p in self.merge(SPACE * length))
            if length <= 1000:
                self._runs[length] = known
        return known

    def _line(self, line: str, prefix: bool) -> bytes:
        """A line with runs of spaces."""
        out, spaces, first = [], int(prefix), True
        lone = self.le[self.ids[SPACE]]
        for word in line.replace(SPACE, " ").split(" "):
            spaces += not first
            first = False
            if not word:
                continue
            if not spaces:
                out.append(self._first[word])
            else:
                code = self._later[word]
                if code[:4] == lone:
                    out += [self.run(spaces), code[4:]]
                else:
                    out += [self.run(spaces - 1), code]
            spaces = 0
        if spaces:
            out.append(self.run(spaces))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        out, prefix = [], True
        first, later, newline = self._first, self._later, self.le[self.byte_ids[10]]
        for line in text.split("\n") if self.lines else [text]:
            if not prefix:
                out.append(newline)
            if "  " in line or line[-1:] == " " or (line[:1] == " " and prefix) or (prefix and not line):
                out.append(self._line(line, prefix))
            else:
                words = line.split(" ")
                out.append((later if prefix else first)[words[0]])
                out += map(later.__getitem__, words[1:])
            prefix = False
        return b"".join(out)

    def encode_ids(self, text: str | None, bos: bool = True, eos: bool = True) -> bytes:
        return (self.le[self.bos] if bos else b"") + self.encode(text or "") + (self.le[self.eos] if eos else b"")

    # -- decoding -------------------------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of ids given as little-endian unsigned 32-bit integers. Bytes that form no character become U+FFFD."""
        import numpy as np

        codes = np.frombuffer(ids, "<u4").tolist()
        start = 0
        while start < len(codes) and self.kinds[codes[start]] == 3:
            start += 1
        raw = self.raw
        head = b""
        if start < len(codes):
            head = raw[codes[start]]
            if self.kinds[codes[start]] == 1 and self.pieces[codes[start]].startswith(SPACE):
                head = head[1:]
        out = head + b"".join(map(raw.__getitem__, codes[start + 1 :]))
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return _repaired(out)


def _repaired(raw: bytes) -> bytes:
    """Each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + size])
            at += size
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


class _Words(dict):
    """Ids of words as bytes. Two generations of at most half ``cache_words`` each: what is used again outlives the rest."""

    def __init__(self, codec: Codec, prefix: str):
        super().__init__()
        self.codec, self.prefix = codec, prefix
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (code := self.older.get(word)) is None:
            code = self.codec.word(word, self.prefix)
        if len(word) <= 64:
            if len(self) >= self.codec.cache_words // 2:
                self.older = dict(self)
                self.clear()
            self[word] = code
        return code


_codecs: dict[tuple[bytes, int], Codec] = {}


def codec_of(model: bytes, cache_words: int = CACHE_WORDS) -> Codec:
    """The worker's codec of a model: tasks that follow each other in a Python worker share its word cache."""
    key = model, cache_words
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, cache_words)
    return _codecs[key]


#: Rows that are turned at once: bounds what a Python worker holds.
ROWS = 256


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, decode: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Rows (id, ids, decoded): ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` is their decoded text.

    Each row is coded alone: no shuffle, no state between rows but a bounded word cache.  Null and empty texts give only
    begin and end ids and an empty decoded text; null ids of rows are kept; repeated rows are coded as often as they occur;
    an empty table gives an empty table; further columns of ``df`` are ignored.  ``model`` is the model file's content,
    half a megabyte, sent with the task.
    """
    kind = df.schema[id_col].dataType

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, cache_words)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [codec.encode_ids(t, bos, eos) for t in part.column(1).to_pylist()]
                texts = [codec.decode(i) for i in ids] if decode else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], names=[id_col, "ids", "decoded"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return df.select(id_col, text_col).mapInArrow(code, schema)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the decoded text."""
    return coded.selectExpr(id_col, "cast(length(ids) div 4 as bigint) as n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(cast(decoded as binary), 256) as decoded_sha256")
