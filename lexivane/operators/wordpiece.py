"""WordPiece: texts as token ids, padded with a mask for an encoder."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Han characters that are words of their own.
_HAN = re.compile("([一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f])")
_SPACE = re.compile("[ \t\n\x0b\f\r]+")
#: The id that ends a text that was cut, whatever the vocabulary.
CUT_END = 102


def punctuation(c: str) -> bool:
    n = ord(c)
    return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c)[0] == "P"


@dataclass
class WordPiece:
    """``vocabulary``: token -> id. No case is folded and no accent taken off; a word of more than ``longest`` bytes is unknown."""

    vocabulary: dict[str, int]
    unknown: str = "[UNK]"
    longest: int = 100
    special: tuple[str, ...] = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
    _starts: frozenset = field(init=False, repr=False)

    def __post_init__(self):
        self.special = tuple(sorted(self.special, key=len, reverse=True))
        self._starts = frozenset(s[0] for s in self.special if s)

    def split_special(self, word: str) -> list[str]:
        """A word cut around special tokens, the longest first; what is none of them is cut before each character that one could start with."""
        out, at = [], 0
        while at < len(word):
            found = next((s for s in self.special if s and word.startswith(s, at)), None)
            if found is None:
                end = at + 1
                while end < len(word) and word[end] not in self._starts:
                    end += 1
                found = word[at:end]
            out.append(found)
            at += len(found)
        return out

    def split_punctuation(self, word: str) -> list[str]:
        """Each punctuation mark by itself; special tokens stay whole."""
        if word in self.special:
            return [word]
        out, now = [], ""
        for c in word:
            if punctuation(c):
                if now:
                    out.append(now)
                out.append(c)
                now = ""
            else:
                now += c
        return [*out, now] if now else out

    def pieces(self, word: str) -> list[str]:
        """The longest known pieces from the left, those after the first with ##; unknown if one is missing."""
        if len(word.encode()) > self.longest:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocabulary:
                    out.append(piece)
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def tokens(self, text: str | None) -> list[str]:
        words = [w for w in _SPACE.split(_HAN.sub(r" \1 ", text or "")) if w]
        return [p for w in words for s in self.split_special(w) for b in self.split_punctuation(s) for p in self.pieces(b)]

    def ids(self, text: str | None, most: int | None = None) -> list[int]:
        """With [CLS] and [SEP]; cut to ``most`` ids, the last of which is then 102. A token without an id has the unknown token's."""
        other = self.vocabulary.get(self.unknown, 0)
        get = self.vocabulary.get
        out = [get("[CLS]", other), *(get(t, other) for t in self.tokens(text)), get("[SEP]", other)]
        return out if most is None or len(out) <= most else [*out[: most - 1], CUT_END]


def padded(ids: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Ids, attention mask and token types, all of the same length."""
    n = min(len(ids), length)
    return [*ids[:n], *[0] * (length - n)], [1] * n + [0] * (length - n), [0] * length


def token_ids(text: Column, tokenizer: WordPiece, most: int | None = 512) -> Column:
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else shared.value.ids(t, most))

    return run(text)
