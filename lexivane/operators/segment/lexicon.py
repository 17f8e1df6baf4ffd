"""Lexicon, hidden Markov model, idf and stop words: loaded from lines, shared with the tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Log-probability of what never happens.
NEVER = -3.14e100


@dataclass
class Lexicon:
    """word -> (log weight, tag), the user's words, and the longest word by first character."""

    words: dict[str, tuple[float, str]] = field(default_factory=dict)
    user_singles: set[str] = field(default_factory=set)
    least: float = 0.0
    middle: float = 0.0
    most: float = 0.0
    total: float = 1.0
    longest: dict[str, int] = field(default_factory=dict)

    def add(self, word: str, weight: float, tag: str, user: bool = False) -> None:
        if not word:
            return
        self.words[word] = (weight, tag)
        self.longest[word[0]] = max(self.longest.get(word[0], 0), len(word))
        if user and len(word) == 1:
            self.user_singles.add(word)

    def remove(self, word: str) -> bool:
        """Only this word; others that begin alike stay."""
        self.user_singles.discard(word)
        return self.words.pop(word, None) is not None


def load_lexicon(lines: list[str], user_lines: list[str] = (), user_weight: str = "median") -> Lexicon:
    """``word freq tag`` lines, each of three columns or a ValueError; weights are ln(freq / sum of freqs).

    User lines have ``word``, ``word tag`` or ``word freq tag``; without a frequency they get the least, median or greatest weight.
    """
    rows = []
    for line in lines:
        if not line.strip():
            continue
        parts = line.split()
        if len(parts) != 3:
            raise ValueError(f"a lexicon line must have three columns: {line!r}")
        rows.append((parts[0], float(parts[1]), parts[2]))
    total = sum(f for _, f, _ in rows) or 1.0
    out = Lexicon(total=total)
    weights = []
    for word, freq, tag in rows:
        weight = math.log(freq / total) if freq > 0 else NEVER
        weights.append(weight)
        out.add(word, weight, tag)
    if weights:
        out.least, out.most = min(weights), max(weights)
        out.middle = sorted(weights)[len(weights) // 2]
    default = {"min": out.least, "median": out.middle, "max": out.most}[user_weight]
    for line in user_lines:
        parts = line.split()
        if len(parts) == 1:
            out.add(parts[0], default, "", True)
        elif len(parts) == 2:
            out.add(parts[0], default, parts[1], True)
        elif len(parts) == 3:
            out.add(parts[0], math.log(max(float(parts[1]), 1e-300) / total), parts[2], True)
    return out


@dataclass
class Chain:
    """Start, transition and emission log-probabilities of the states begin, end, middle, single."""

    start: list[float]
    trans: list[list[float]]
    emit: list[dict[str, float]]


def load_chain(lines: list[str]) -> Chain:
    """One row of starts, four of transitions, four of emissions ``character:value,...``; lines that start with # are comments."""
    rows = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
    if len(rows) < 9:
        raise ValueError("the model must have one row of starts, four of transitions and four of emissions")
    start = [float(x) for x in rows[0].split()]
    trans = [[float(x) for x in r.split()] for r in rows[1:5]]
    if len(start) != 4 or any(len(r) != 4 for r in trans):
        raise ValueError("starts and transitions must have four values")
    emit = []
    for r in rows[5:9]:
        pairs = (p.rpartition(":") for p in r.split(",") if p)
        emit.append({c: float(v) for c, _, v in pairs})
    return Chain(start, trans, emit)


def load_idf(lines: list[str]) -> tuple[dict[str, float], float]:
    """``word idf`` lines and the average idf: the sum over well-formed lines by the number of all lines."""
    out, total, n = {}, 0.0, 0
    for line in lines:
        n += 1
        parts = line.split()
        if len(parts) == 2:
            out[parts[0]] = float(parts[1])
            total += float(parts[1])
    return out, total / n if n else 0.0


def load_stop_words(lines: list[str]) -> set[str]:
    return {x.rstrip("\r\n") for x in lines if x.rstrip("\r\n")}


__all__ = ["NEVER", "Chain", "Lexicon", "load_chain", "load_idf", "load_lexicon", "load_stop_words"]
