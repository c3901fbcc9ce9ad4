"""Tokeniser fertility: how well public vocabularies fit a text.

Each white-space separated word is cut by the vocabulary as a word after a blank. Over a
text's words this gives: characters per token, the share of byte-fallback
tokens, and the entropy of the token distribution in bits. A text is rejected when a
measure leaves the band of its language; languages without bands take those of the text's
main script.

Words repeat, so every task keeps a bounded memo of word to tokens. The work is one pass
over the rows without a shuffle. Null text counts as empty (no words, fails the base rule);
a text without words has null measures; repeated rows keep their own result rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracehound.llm.common import query, table

TOKENIZERS = "/opt/tokenizers"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MEMO_WORDS = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """Accepted range of each measure; the byte share only has an upper end."""

    chars_per_token: tuple[float, float] = (1.0, 8.0)
    byte_share: float = 0.2
    entropy: tuple[float, float] = (3.0, 12.0)


@dataclass(frozen=True)
class Bands:
    languages: dict[str, Band] = field(default_factory=dict)
    scripts: dict[str, Band] = field(default_factory=dict)
    other: Band = field(default_factory=Band)

    def of(self, lang: str | None, text: str) -> Band:
        return self.languages.get(lang) or self.scripts.get(main_script(text)) or self.other


# Languages written in ASCII letters are cut into longer pieces than those with accents;
# other scripts fall back to single characters or bytes far more often.
BANDS = Bands(
    languages={
        "en": Band((2.0, 6.5), 0.06, (4.0, 11.0)),
        "de": Band((2.03, 6.5), 0.06, (4.0, 11.0)),
        "fr": Band((1.75, 6.5), 0.06, (4.0, 11.0)),
        "es": Band((1.79, 6.5), 0.06, (4.0, 11.0)),
    },
    scripts={
        "LATIN": Band((1.4, 6.5), 0.1, (3.0, 12.0)),
        "CYRILLIC": Band((1.0, 6.0), 0.1, (3.0, 12.0)),
        "GREEK": Band((0.7, 4.0), 0.2, (3.0, 12.0)),
        "ARABIC": Band((0.7, 4.0), 0.3, (3.0, 12.0)),
        "HEBREW": Band((0.7, 4.0), 0.3, (3.0, 12.0)),
        "CJK": Band((0.3, 3.0), 0.9, (3.0, 12.0)),
        "HIRAGANA": Band((0.3, 3.0), 0.9, (3.0, 12.0)),
        "HANGUL": Band((0.3, 3.0), 0.9, (3.0, 12.0)),
        "DEVANAGARI": Band((0.3, 3.0), 0.9, (3.0, 12.0)),
    },
    other=Band((0.2, 8.0), 1.0, (3.0, 12.0)),
)


def main_script(text: str) -> str:
    """The script of most letters, as Unicode names it; empty without letters."""
    counts: Counter[str] = Counter()
    for letter, n in Counter(text).items():
        if letter.isalpha():
            counts[unicodedata.name(letter, "?").split(" ")[0]] += n
    return min(counts, key=lambda s: (-counts[s], s)) if counts else ""


class Pieces:
    """A vocabulary of the sentencepiece kind, from the bytes of its file."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.memo: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        """Make sure that all these words are in the memo."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        self.memo.update(zip(new, self.model.encode(new, num_threads=1), strict=True))

    def measures(self, words: list[str], chars: int) -> tuple[float | None, float | None, float | None]:
        ids = np.fromiter(chain.from_iterable(map(self.memo.__getitem__, words)), np.int32)
        if not len(ids):
            return None, None, None
        counts = np.unique(ids, return_counts=True)[1]
        share = counts / len(ids)
        return chars / len(ids), float(self.is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def _fits(value: float | None, low: float, high: float) -> bool:
    return value is None or low <= value <= high


def fertility(
    docs: DataFrame,
    vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model",
    bands: Bands = BANDS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Base counts, the vocabulary's measures and the verdict for every row.

    The vocabulary's file is read by the driver (about 0.5 MB, a constant) and broadcast.
    """
    data = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    schema = (
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(data.value)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 200):  # words of few texts at a time
                part = batch.iloc[at : at + 200]
                texts = ["" if t is None else t for t in part["text"]]
                cut = [_WORD.findall(t) for t in texts]
                pieces.learn(set().union(*cut))
                for key, language, t, words in zip(part["doc_id"], part["lang"], texts, cut, strict=True):
                    chars, repeats = sum(map(len, words)), repeated_words(words)
                    measures = pieces.measures(words, chars)
                    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
                    kept = not failed
                    if kept:
                        band = bands.of(language, t)
                        kept = _fits(measures[0], *band.chars_per_token) and _fits(measures[1], 0, band.byte_share) and _fits(measures[2], *band.entropy)
                    out.append((key, len(words), chars, len(_SYMBOL.findall(t)), repeated_lines(t), repeats, failed, kept, *measures))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"doc_id": batch["doc_id"].dtype, **dict.fromkeys(names[-3:], "float64")})

    names = [f.split(" ")[0] for f in schema.split(", ")]
    return docs.selectExpr(f"`{doc_id}` as doc_id", f"`{lang}` as lang", f"`{text}` as text").mapInPandas(run, schema)


@query("op1_fertility")
def op1_fertility(spark, sf_dir: str) -> DataFrame:
    return fertility(table(spark, sf_dir, "documents"))
