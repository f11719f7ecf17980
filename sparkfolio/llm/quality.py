"""Quality rules by tokeniser fertility.

A public vocabulary measures each text: characters per token, the share of tokens that are bytes of characters outside the
vocabulary, and the entropy of the text's tokens in bits.  Text outside the bands (repetition, mojibake) is rejected.  Bands
are looked up by the row's language, or by the script that most of the text's letters belong to where the language has none.
Languages with labelled rows also have a joint limit on all three: signs between words and menus lower characters per token
and, for a text of that many tokens, the entropy, so that both together tell symbol noise where neither does alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.sentencepiece_codec import CACHE_WORDS, codec_of
from sparkfolio.llm.shared import col


@dataclass(frozen=True)
class Band:
    """Limits within which a text is kept."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float] = (4.8, 13.0)
    #: (a, b, least): characters per token + a * entropy - b * log2(tokens) is at least this; a longer text has more entropy.
    joint: tuple[float, float, float] | None = None

    def holds(self, chars_per_token: float, byte_share: float, entropy: float, tokens: int) -> bool:
        within = self.chars_per_token[0] <= chars_per_token <= self.chars_per_token[1] and byte_share <= self.byte_share and self.entropy[0] <= entropy <= self.entropy[1]
        if not within or self.joint is None:
            return within
        a, b, least = self.joint
        return chars_per_token + a * entropy - b * log2(max(tokens, 1)) >= least


#: Bands by language code.  Joint limits: logistic regression of the quality label on all labelled rows of sf0.1 that pass the base
#: rules, of four class weights the one that loses fewest clean rows; the least value lies halfway between the highest junk and the next clean row above it.
LANGUAGES: dict[str, Band] = {
    "en": Band((1.9, 7.0), 0.10, joint=(0.90, 0.20, 6.22)),
    "de": Band((1.9, 7.0), 0.10, joint=(0.49, 0.09, 4.66)),
    "fr": Band((1.7, 7.0), 0.10, joint=(0.93, 0.15, 6.51)),
    "es": Band((1.8, 7.0), 0.10, joint=(0.38, 0.08, 3.84)),
}

#: Bands by script, for other languages; without labelled rows there is no joint limit.
SCRIPTS: dict[str, Band] = {
    "latin": Band((1.5, 8.0), 0.20),
    "greek_cyrillic": Band((1.0, 7.0), 0.30),
    "semitic_indic": Band((0.4, 6.0), 0.70),
    "cjk": Band((0.3, 4.0), 0.70),
    "none": Band((0.0, 99.0), 1.0),
}

#: Labelled rows of a language that a fit takes at most, the first by hash of all their columns.
FIT_ROWS = 20_000


def fit_joint(measured: DataFrame, max_rows: int = FIT_ROWS, weights: tuple[float, ...] = (1.0, 3.0, 10.0, 30.0)) -> dict[str, tuple[float, float, float]]:
    """Joint limits by language, fitted to labelled texts that pass the base rules: rows (lang, quality, chars_per_token,
    token_entropy, n_tokens).

    A bounded sample of ``max_rows`` rows a language reaches the driver.  Logistic regression of the label, clean rows weighing
    as ``weights`` say, of which the weight stays that loses fewest clean rows; the limit lies halfway between the highest junk
    and the next clean row above it, so that no junk of the sample is kept.  A language without rows of both labels, or
    whose junk isn't told by lower characters per token, gets no limit.
    """
    import numpy as np

    spread = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(*measured.columns), *measured.columns))
    rows = measured.withColumn("_place", spread).where(F.col("_place") <= max_rows).toPandas()
    limits: dict[str, tuple[float, float, float]] = {}
    for lang, part in rows.groupby("lang"):
        x = np.stack([part["chars_per_token"], part["token_entropy"], -np.log2(np.maximum(part["n_tokens"], 1))], axis=1).astype(float)
        clean = part["quality"].to_numpy() == 1
        if clean.all() or not clean.any():
            continue
        full = np.hstack([x, np.ones((len(x), 1))])
        best: tuple[int, tuple[float, float, float]] | None = None
        for weight in weights:
            w = np.where(clean, weight, 1.0)
            beta = np.zeros(4)
            for _ in range(200):  # Newton's method, with a little shrinkage
                prob = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
                step = np.linalg.solve(full.T @ (full * (w * prob * (1 - prob) + 1e-9)[:, None]) + 1e-3 * np.eye(4), full.T @ (w * (clean - prob)) - 1e-3 * beta)
                beta += step
                if np.abs(step).max() < 1e-8:
                    break
            if beta[0] <= 0:
                continue
            a, b = (float(k) for k in np.round(beta[1:3] / beta[0], 2))
            score = x @ np.array([1.0, a, b])
            junk = score[~clean].max()
            above = score[clean & (score > junk)]
            least = float(np.round((junk + above.min()) / 2 if len(above) else junk + 0.01, 2))
            lost = int((score[clean] < least).sum())
            if best is None or lost < best[0]:
                best = lost, (a, b, least)
        if best is not None:
            limits[str(lang)] = best[1]
    return limits


SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("n_tokens", T.LongType()),
    ("chars_per_token", T.DoubleType()),
    ("byte_share", T.DoubleType()),
    ("token_entropy", T.DoubleType()),
    ("script", T.StringType()),
    ("kept", T.BooleanType()),
]
QUALITY = T.StructType([T.StructField(n, t) for n, t in FIELDS])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total = upto = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


#: First code points of ranges and the script group of their letters; what lies between named ranges is no letter.
_RANGES = [
    (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xC0, "latin"), (0x250, "none"), (0x370, "greek_cyrillic"), (0x530, "semitic_indic"), (0x1100, "cjk"), (0x1200, "semitic_indic"), (0x1E00, "latin"),
    (0x1F00, "greek_cyrillic"), (0x2000, "none"), (0x2E80, "cjk"), (0x3000, "none"), (0x3040, "cjk"), (0xA4D0, "none"), (0xAC00, "cjk"), (0xD7B0, "none"), (0xF900, "cjk"), (0xFB00, "none"), (0xFB1D, "semitic_indic"),
    (0xFE00, "none"), (0x20000, "cjk"), (0x32000, "none"),
]
_STARTS = [start for start, _ in _RANGES]
_GROUPS = ["none", *(group for _, group in _RANGES)]


def script_of(text: str) -> str:
    """Script group of most letters, by ranges of code points; ``none`` if there are none."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = np.bincount(np.searchsorted(_STARTS, points, side="right"), minlength=len(_GROUPS))
    found = dict.fromkeys(SCRIPTS, 0)
    for group, n in zip(_GROUPS, counts.tolist()):
        found[group] += n
    found["none"] = 0
    best = max(found, key=found.get)
    return best if found[best] else "none"


def measure(text: str | None, lang: str | None, model: bytes, min_words: int = 50, max_repeat: int = 50, cache_words: int = CACHE_WORDS) -> dict:
    """All fields of ``QUALITY`` for one text."""
    import numpy as np

    text = text or ""
    raw = text.encode()
    words = raw.split()  # splits at just the six white space characters
    n = len(words)
    repeat = repeated_words(words)
    codec = codec_of(model, cache_words)
    ids = np.frombuffer(codec.encode(text), "<u4")
    total = len(ids)
    kinds, counts = np.unique(ids, return_counts=True)
    share = counts / total if total else counts
    raw_bytes = np.array([codec.kinds[i] == 6 and codec.raw[i] not in (b"\n", b"\t", b"\r") for i in kinds.tolist()], bool)
    out = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeat,
        "base_failed": n < min_words or 100 * repeat > max_repeat * n,
        "n_tokens": total,
        "chars_per_token": len(text) / total if total else 0.0,
        "byte_share": float(share[raw_bytes].sum()) if total else 0.0,
        "token_entropy": float(max(0.0, -(share * np.log2(share)).sum())) if total else 0.0,
        "script": script_of(text),
    }
    band = LANGUAGES.get(lang or "") or SCRIPTS[out["script"]]
    within = band.holds(out["chars_per_token"], out["byte_share"], out["token_entropy"], total)
    return out | {"kept": within and not out["base_failed"]}


#: Rows that are measured at once.
ROWS = 256


def score_quality(df: DataFrame, model: bytes, text_col: str = "text", lang_col: str | None = "lang", out: str = "quality", only_kept: bool = False, carry: list[str] | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``carry`` columns of ``df`` (all by default) and a struct ``out`` of base counts, fertility and verdict.

    Each row is measured alone, whole text, in one pass without a shuffle.  A null text counts as an empty one: no words,
    failed; a null or unknown language is judged by script; repeated rows are measured each; an empty table gives an empty
    table.  A column of ``df`` named ``out`` is replaced.  ``only_kept`` leaves the rejected rows out.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != out.lower()]
    # Numbered names in between: those of df may clash, or hold dots.
    names = [f"c{i}" for i in range(len(carry))]
    inputs = df.select(*[col(c).alias(n) for c, n in zip(carry, names)], col(text_col).alias("text"), (col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang"))
    arrow = pa.struct([pa.field(n, pa.int64() if isinstance(t, T.LongType) else pa.bool_() if isinstance(t, T.BooleanType) else pa.float64() if isinstance(t, T.DoubleType) else pa.string()) for n, t in FIELDS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [measure(t, x, model, cache_words=cache_words) for t, x in zip(part.column("text").to_pylist(), part.column("lang").to_pylist())]
                full = pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [pa.array(found, arrow)], names=[*names, "verdict"])
                yield full.filter(pa.array([f["kept"] for f in found])) if only_kept else full

    schema = T.StructType([*[T.StructField(n, df.schema[c].dataType) for c, n in zip(carry, names)], T.StructField("verdict", QUALITY)])
    return inputs.mapInArrow(score, schema).toDF(*carry, out)
