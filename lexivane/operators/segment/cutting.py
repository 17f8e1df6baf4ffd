"""The cuts: by lexicon and largest probability, by hidden Markov model, mixed, full, for queries; and tags."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np

from lexivane.operators.segment.lexicon import NEVER, Chain, Lexicon

# Characters at which a text is cut before anything else.
SEPARATORS = frozenset(" \t\n，。")
# Tags of words that the lexicon has none for.
TAG_OTHER, TAG_NUMBER, TAG_LATIN = "x", "m", "eng"


def ranges(text: str, separators: frozenset[str] = SEPARATORS) -> list[str]:
    """The text between separators, each separator a range of its own."""
    out, start = [], 0
    for k, c in enumerate(text):
        if c in separators:
            if start < k:
                out.append(text[start:k])
            out.append(c)
            start = k + 1
    if start < len(text):
        out.append(text[start:])
    return out


def _known(lexicon: Lexicon, text: str, at: int, most: int) -> list[int]:
    """The ends of the lexicon's words that begin at a place, shortest first."""
    longest = min(lexicon.longest.get(text[at], 0), most, len(text) - at)
    return [at + n for n in range(1, longest + 1) if text[at : at + n] in lexicon.words]


def cut_by_lexicon(lexicon: Lexicon, text: str, most: int = 1 << 30) -> list[str]:
    """The cut of the largest sum of log weights; a single unknown character has the least weight. Of equal sums the shorter word wins."""
    n = len(text)
    best, end = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        top, to = None, i + 1
        ends = _known(lexicon, text, i, most)
        for e in ends if ends and ends[0] == i + 1 else [i + 1, *ends]:
            weight = lexicon.words[text[i:e]][0] if text[i:e] in lexicon.words else lexicon.least
            value = weight + best[e]
            if top is None or value > top:
                top, to = value, e
        best[i], end[i] = top, to
    out, i = [], 0
    while i < n:
        out.append(text[i : end[i]])
        i = end[i]
    return out


#: Runs beyond ASCII; a letter with the letters and digits after it; a digit with the digits and dots after it; any other sign by itself.
_RUN = re.compile(r"[^\x00-\x7f]+|[A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*|[\x00-\x7f]")


def _likeliest(chain: Chain, text: str) -> np.ndarray:
    """The states of the likeliest path that ends a word, by the largest sums up to each character; what never happens comes from the end state."""
    emitted = np.array([[e.get(c, NEVER) for e in chain.emit] for c in text])
    sums, came = np.asarray(chain.start) + emitted[0], np.ones((len(text), 4), np.int64)
    for k in range(1, len(text)):
        paths = sums[:, None] + np.asarray(chain.trans) + emitted[k]
        possible = paths.max(0) > NEVER
        came[k][possible] = paths.argmax(0)[possible]
        sums = np.where(possible, paths.max(0), NEVER)
    out = np.empty(len(text), np.int64)
    out[-1] = 1 if sums[1] >= sums[3] else 3
    for k in range(len(text) - 1, 0, -1):
        out[k - 1] = came[k][out[k]]
    return out


def cut_by_chain(chain: Chain, text: str) -> list[str]:
    """Runs beyond ASCII by the likeliest states; a run of letters and digits that starts with a letter, and one of digits and dots, are words."""
    out = []
    for run in _RUN.findall(text):
        if run.isascii():
            out.append(run)
        else:  # a word ends in the states end and single
            ends = np.flatnonzero(_likeliest(chain, run) % 2 == 1) + 1
            out += [run[x:y] for x, y in pairwise([0, *ends.tolist()])]
    return out


def cut_mixed(lexicon: Lexicon, chain: Chain | None, text: str) -> list[str]:
    """By lexicon; runs of single characters that are not the user's words are cut again by the chain, if there is one."""
    words = cut_by_lexicon(lexicon, text)
    if chain is None:
        return words
    out, run = [], ""
    for w in words:
        if len(w) == 1 and w not in lexicon.user_singles:
            run += w
            continue
        if run:
            out += cut_by_chain(chain, run)
            run = ""
        out.append(w)
    return out + (cut_by_chain(chain, run) if run else [])


def cut_full(lexicon: Lexicon, text: str) -> list[str]:
    """Every word of the lexicon of two characters or more, and single characters that none covers."""
    out, covered = [], 0
    for i in range(len(text)):
        ends = _known(lexicon, text, i, 1 << 30)
        longer = [e for e in ends if e > i + 1]
        out += [text[i:e] for e in longer] if longer else [text[i]] if covered <= i else []
        covered = max([covered, *ends])
    return out


def cut_for_queries(lexicon: Lexicon, chain: Chain | None, text: str) -> list[str]:
    """The mixed cut, before each word its parts of two, then of three characters that are in the lexicon."""
    out = []
    for w in cut_mixed(lexicon, chain, text):
        for n in (2, 3):
            if len(w) > n:
                out += [p for p in (w[i : i + n] for i in range(len(w) - n + 1)) if p in lexicon.words]
        out.append(w)
    return out


def tag(lexicon: Lexicon, word: str) -> str:
    """The lexicon's tag; else by the ASCII characters seen until they are half of the word: none x, all digits m, others eng."""
    known = lexicon.words.get(word)
    if known and known[1]:
        return known[1]
    ascii_ = [c for c in word if c.isascii()][: len(word) // 2]
    if not ascii_:
        return TAG_OTHER
    return TAG_NUMBER if all(c.isdigit() for c in ascii_) else TAG_LATIN


@dataclass
class Segmenter:
    """One lexicon and chain, with the kinds of cut; texts are cut at the separators first."""

    lexicon: Lexicon
    chain: Chain | None = None
    separators: frozenset[str] = SEPARATORS

    def cut(self, text: str | None, kind: str = "mix", most: int = 1 << 30) -> list[str]:
        """``kind``: mp, hmm, mix, full, query or small (words of at most ``most`` characters); a null text has no words."""
        out = []
        for part in ranges(text or "", self.separators):
            if kind in ("mp", "small"):
                out += cut_by_lexicon(self.lexicon, part, most)
            elif kind == "hmm":
                out += cut_by_chain(self.chain, part)
            elif kind == "mix":
                out += cut_mixed(self.lexicon, self.chain, part)
            elif kind == "full":
                out += cut_full(self.lexicon, part)
            elif kind == "query":
                out += cut_for_queries(self.lexicon, self.chain, part)
            else:
                raise ValueError(f"no such cut: {kind}")
        return out

    def tagged(self, text: str | None) -> list[tuple[str, str]]:
        return [(w, tag(self.lexicon, w)) for w in self.cut(text)]


def with_offsets(words: list[str]) -> list[tuple[str, int, int, int]]:
    """word, byte offset, character offset, length in characters of words that follow each other."""
    out, b, c = [], 0, 0
    for w in words:
        out.append((w, b, c, len(w)))
        b += len(w.encode())
        c += len(w)
    return out
