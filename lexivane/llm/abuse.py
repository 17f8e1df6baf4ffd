"""Problem 9: abusive, hateful or sexual content, by class-conditional Kneser-Ney models.

Texts are cut into sentences and normalised (case, spelling with digits or inserted signs, stretched letters, numbers, names).
Two four-gram models with interpolated Kneser-Ney smoothing, one of abusive and one of ordinary sentences, share the
counts to which rare expressions back off: the lowest order is the distribution of words over both classes, so that a
word seen in neither speaks for neither. A sentence's score is the difference of its two log-likelihoods over its length;
a document's is that of its worst sentence, so that one insult in a long text counts.

Labels are of documents, and in an abusive one most sentences are ordinary. So the abusive model is refined in
rounds: each keeps, of the abusive documents, the sentences that models fitted on other documents find more abusive than held-out
ordinary ones, and fits again. A document with verdicts of both kinds counts by the majority, and not at all if they are even. The
threshold is the one with the best F1 on held-out labels, each fold scored by models fitted without it, counted for less as its precision there
is below ``least_precision``; with less than a hundred abusive documents it is raised by degrees. It is not below 0, where both models are as likely.

Bound: the models are fitted on at most ``most_labels`` labelled documents, those with the least hash of the id; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.neardup import holding
from lexivane.llm.words import HAN, mix
from lexivane.sampling import least_hashed
from lexivane.session import written

_TAG = re.compile(r"<[A-Za-z/!][^<>]{0,200}>")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
#: Signs put between Han characters, or between the letters of one word.
_INSERTED = re.compile(rf"(?<=[{HAN}])[ .*·_~\-+|/\\#]{{1,2}}(?=[{HAN}])")
_SPACED = re.compile(r"(?<![A-Za-z'’])(?:[A-Za-z][ .*_\-]){2,}[A-Za-z](?![A-Za-z])")
_STARRED = re.compile(r"(?<=[A-Za-z])[*.·_\-](?=[A-Za-z])")
#: The writer's name before a comment.
_WRITER = re.compile(r"(?m)^[ \t]*[^\s:：]{1,20}\d{2,}[ \t]*[:：]")
#: Words, and signs that end a sentence.
_TOKEN = re.compile(rf"[{HAN}]|[A-Za-z\d@$]+(?:'[A-Za-z]+)?|[!?！？。;；\n]|\.(?=\s|\Z)")
_ENDS = frozenset("!?！？。;；\n.")
_STRETCHED = re.compile(r"(.)\1{2,}")
# Digits and signs written for letters.
LEET = str.maketrans("0134578@$", "oieastbas")
NUMBER, NAME, NAMES, USER = "<n>", "<name>", "<names>", "<user>"


def normal(w: str, first: bool = False) -> str:
    """A word without case, disguise and stretching; numbers, users and names stand for all of their kind."""
    if w.isdigit():
        return NUMBER
    if any(c.isdigit() or c in "@$" for c in w):
        if not any(c.isalpha() for c in w) or re.fullmatch(r"\$?\d+[A-Za-z]{0,3}", w):
            return NUMBER
        if re.fullmatch(r"[A-Za-z]+\d{2,}", w):
            return USER
        w = w.translate(LEET)
    if w[0].isupper() and not first and len(w) > 1:
        return NAMES if w.endswith("s") and len(w) > 3 else NAME
    return _STRETCHED.sub(r"\1", w.lower())


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence as written, but for what was put between letters; Han characters are words of their own."""
    if not text:
        return []
    text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    text = _INSERTED.sub("", _WRITER.sub("", text))
    if _SPACED.search(text):
        text = _SPACED.sub(lambda x: re.sub(r"[ .*_\-]", "", x[0]), text)
    text = _STARRED.sub("", text)
    out, now = [], []
    for w in _TOKEN.findall(text):
        if w in _ENDS:
            if now:
                out.append(now)
                now = []
        else:
            now.append(w)
    if now:
        out.append(now)
    for k, s in enumerate(out):  # a sentence in capitals has no names
        if len(s) > 2 and s[1][:2].isupper() and sum(w.isupper() for w in s) > 0.7 * len(s):
            out[k] = [w.lower() for w in s]
    return out


class Numbers:
    """Words as numbers: 0 stands before a sentence, 1 is any unknown word. Spellings met are kept, up to ``limit`` of them."""

    def __init__(self, words: list[str], limit: int = 200_000):
        self.known = {w: k + 2 for k, w in enumerate(words)}
        self.size, self.limit = len(words) + 2, limit
        self.seen: tuple[dict, dict] = ({}, {})

    def __getstate__(self) -> dict:
        return {"known": self.known, "size": self.size, "limit": self.limit, "seen": ({}, {})}

    def _of(self, w: str, first: bool) -> int:
        cache = self.seen[first]
        if len(cache) > self.limit:
            cache.clear()
        n = cache[w] = self.known.get(normal(w, first), 1)
        return n

    def flat(self, docs: list[list[list[str]]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words in a row with order - 1 starts before each sentence; the sentences' lengths; the document of each sentence."""
        row: list[int] = []
        lengths, of = [], []
        pad = [0] * (order - 1)
        inner, head = self.seen
        for d, doc in enumerate(docs):
            for s in doc:
                row += pad
                w = s[0]
                row.append(head[w] if w in head else self._of(w, True))
                row += [inner[w] if w in inner else self._of(w, False) for w in s[1:]]
                lengths.append(len(s))
                of.append(d)
        return np.array(row, np.int64), np.array(lengths, np.int64), np.array(of, np.int64)


class Grams:
    """Keys of the n-grams of every order that end at each word of a row of sentences."""

    def __init__(self, row: np.ndarray, lengths: np.ndarray, order: int):
        self.lengths = lengths
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(row > 0)
        self.keys, self.contexts = [], []  # by order, from 1
        key = row[at].astype(np.uint64)
        context = np.zeros(len(at), np.uint64)
        for n in range(1, order + 1):
            if n > 1:
                before = row[at - n + 1].astype(np.uint64) + np.uint64(1)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + before)
                context = mix(context * np.uint64(0x9E3779B97F4A7C15) + before)
            self.keys.append(key)
            self.contexts.append(context)
        self.words = row[at]

    def __len__(self) -> int:
        return len(self.lengths)


class Indexed(Grams):
    """Grams of the labelled documents, numbered, so that many models can be fitted on parts of them."""

    def __init__(self, row: np.ndarray, lengths: np.ndarray, order: int):
        super().__init__(row, lengths, order)
        self.known, self.number, self.known_context, self.context_number = [None], [self.words], [None], [None]
        self.context_of, self.lower = [None], [None]
        for n in range(1, order):
            key, first, number = np.unique(self.keys[n], return_index=True, return_inverse=True)
            context, where = np.unique(self.contexts[n], return_inverse=True)
            self.known.append(key)
            self.number.append(number)
            self.known_context.append(context)
            self.context_number.append(where)
            self.context_of.append(where[first])
            self.lower.append(self.number[n - 1][first])  # the gram of the order below, without the first word


class Models:
    """Interpolated Kneser-Ney models of abusive (first) and ordinary sentences (second) over the same numbered words."""

    def __init__(self, ix: Indexed, chosen: np.ndarray, ordinary: np.ndarray, size: int, discount: float = 0.75):
        order = len(ix.keys)
        self.shares = [None] + [np.zeros((len(ix.known[n]) + 1, 2)) for n in range(1, order)]
        self.back = [None] + [np.ones((len(ix.known_context[n]) + 1, 2)) for n in range(1, order)]
        cont = []
        for side, sentences_ in enumerate((chosen, ordinary)):
            cont.append(self._fit(ix, sentences_[ix.sentence], side, size, discount))
        # The shared lowest order: in how many contexts a word continues, of both classes with the same weight.
        shared = sum(c / max(c.sum(), 1.0) for c in cont) / 2 + 1e-7
        shared /= shared.sum()
        one = []
        for c in cont:
            total, kinds = max(c.sum(), 1.0), (c > 0).sum()
            p = np.maximum(c - discount, 0) / total + (discount * kinds / total if kinds else 1.0) * shared
            one.append(p / p.sum())
        self.one = np.stack(one, 1)

    def _fit(self, ix: Indexed, picked: np.ndarray, side: int, size: int, d: float) -> np.ndarray:
        """Sets each order's discounted shares and the weights of the order below; below the highest, a count is of the contexts a gram continues."""
        order = len(ix.keys)
        count = np.bincount(ix.number[order - 1][picked], minlength=len(ix.known[order - 1]) if order > 1 else size).astype(float)
        for n in range(order - 1, 0, -1):
            have = np.flatnonzero(count)
            context = ix.context_of[n][have]
            total = np.bincount(context, weights=count[have], minlength=len(ix.known_context[n]))
            kinds = np.bincount(context, minlength=len(ix.known_context[n]))
            self.shares[n][have, side] = np.maximum(count[have] - d, 0) / total[context]
            met = np.flatnonzero(kinds)
            self.back[n][met, side] = d * kinds[met] / total[met]
            count = np.bincount(ix.lower[n][have], minlength=len(ix.known[n - 1]) if n > 1 else size).astype(float)
        return count

    def inside(self, ix: Indexed, extra: float) -> np.ndarray:
        """``scores`` of the grams the models were fitted on."""
        p = self.one[ix.words]
        for n in range(1, len(self.shares)):
            p = self.back[n][ix.context_number[n]] * p + self.shares[n][ix.number[n]]
        return self._mean(p, ix, extra)

    def exported(self, ix: Indexed) -> Models:
        """With the keys of what either class has, for scoring other texts; the last row of a table is for a key that neither has."""
        self.higher = []
        for n in range(1, len(self.shares)):
            tables = []
            for known, values, absent in ((ix.known[n], self.shares[n], 0.0), (ix.known_context[n], self.back[n], 1.0)):
                have = np.flatnonzero((values[:-1] != absent).any(1))
                tables.append((known[have], np.vstack([values[have], [[absent, absent]]])))
            self.higher.append((tables[0], tables[1]))
        self.shares = self.back = None
        return self

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, values = table
        if not len(known):
            return values[np.zeros(len(keys), np.int64)]
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return values[np.where(known[at] == keys, at, len(known))]

    @staticmethod
    def _mean(p: np.ndarray, grams: Grams, extra: float) -> np.ndarray:
        if not len(grams):
            return np.zeros(0)
        starts = np.cumsum(grams.lengths) - grams.lengths
        return np.add.reduceat(np.log(p[:, 0] / p[:, 1]), starts) / (grams.lengths + extra)

    def scores(self, grams: Grams, extra: float) -> np.ndarray:
        """Of each sentence the difference of the log-likelihoods over its length and ``extra`` words more."""
        p = self.one[grams.words]
        for n, (shares, back) in enumerate(self.higher, 1):
            p = self._look(back, grams.contexts[n]) * p + self._look(shares, grams.keys[n])
        return self._mean(p, grams, extra)


def _refined(grams: Indexed, of: np.ndarray, abusive: np.ndarray, ordinary: np.ndarray, size: int, rounds: int, extra: float, share: float) -> Models:
    """Models of which the abusive one holds those sentences of the abusive documents that stand out.

    ``abusive`` and ``ordinary`` tell the sentences of the documents of either verdict. Each document's are judged by models that
    have not seen it: an abusive expression recurs in other abusive documents, while an ordinary sentence, as all of a wrongly
    marked document's, is told from the others by nothing. Sentences of ordinary documents that stand out in the last round are left out.
    Where none stands out, as too few abusive documents have nothing in common, those of the round before stay.
    """
    half = of % 2 == 0
    chosen, usual = abusive.copy(), ordinary.copy()
    for _ in range(rounds):
        new, odd = np.zeros_like(chosen), np.zeros_like(chosen)
        for h in (half, ~half):
            x = Models(grams, chosen & h, usual & h, size).inside(grams, extra)
            held = ordinary & ~h
            cut = max(0.0, float(np.quantile(x[held], 1 - share))) if held.any() else 0.0
            new |= abusive & ~h & (x > cut)
            odd |= held & (x > cut)
        if not new.any():
            break
        chosen, usual = new, ordinary & ~odd
    return Models(grams, chosen, usual, size)


def _verdicts(labels: list[tuple[int, int]]) -> dict[int, int]:
    votes: dict[int, list[int]] = defaultdict(list)
    for doc, verdict in labels:
        votes[doc].append(verdict)
    return {d: int(2 * sum(v) > len(v)) for d, v in votes.items() if 2 * sum(v) != len(v)}


def _worst(scores: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -math.inf)
    np.maximum.at(out, of, scores)
    return out


def train(texts: dict[int, str], labels: list[tuple[int, int]], order: int = 4, rounds: int = 3, folds: int = 3, extra: float = 4.0, share: float = 0.001, least: int = 2, least_precision: float = 0.5) -> tuple[Numbers, Models, float]:
    """The models, and the threshold with the best F1 over held-out folds; if there is no abusive label, an infinite one."""
    verdict = {d: v for d, v in _verdicts(labels).items() if texts.get(d)}
    ids = sorted(verdict, key=lambda d: (xxhash.xxh3_64_intdigest(str(d)), d))
    docs = [sentences(texts[d]) for d in ids]
    counts = Counter(normal(w, k == 0) for d in docs for s in d for k, w in enumerate(s))
    numbers = Numbers(sorted(w for w, n in counts.items() if n >= least))
    row, lengths, of = numbers.flat(docs, order)
    grams = Indexed(row, lengths, order)
    truth = np.array([verdict[d] for d in ids], bool)
    bad = truth[of] if len(of) else np.zeros(0, bool)
    if not bad.any():
        return numbers, Models(grams, bad, ~bad, numbers.size).exported(grams), math.inf
    fold = np.arange(len(ids)) // 2 % folds  # pairs stay together, so that each fold has documents of both halves
    worst = np.full(len(ids), -math.inf)
    for f in range(folds):
        seen = (fold != f)[of]
        m = _refined(grams, of, bad & seen, ~bad & seen, numbers.size, rounds, extra, share)
        worst = np.where(fold == f, _worst(m.inside(grams, extra), of, len(ids)), worst)
    order_ = np.argsort(-worst, kind="stable")
    hits = np.cumsum(truth[order_])
    f1 = 2 * hits / (np.arange(1, len(ids) + 1) + truth.sum())
    precision = hits / np.arange(1, len(ids) + 1)
    # Below the least precision a threshold counts for less, in proportion.
    best = int((f1 * np.minimum(1.0, precision / least_precision)).argmax())
    here = worst[order_[best]]
    after = worst[order_[best + 1]] if best + 1 < len(ids) else here - 1
    models = _refined(grams, of, bad, ~bad, numbers.size, rounds, extra, share)
    # Of few abusive documents the fit and the threshold are unsure, and what is found should be the surest: a margin that falls to nothing at a hundred.
    unsure = max(0.0, 4 / math.sqrt(truth.sum()) - 0.4)
    return numbers, models.exported(grams), max(0.0, float((here + max(after, here - 1)) / 2)) + unsure


def abuse_scores(documents: DataFrame, labels: DataFrame, most_labels: int = 20_000, extra: float = 4.0) -> DataFrame:
    """doc_id, score, abusive: of every row of ``documents`` (doc_id, text); score is the margin over the threshold.

    ``labels`` has doc_id and abusive (0, 1 or null, which is no verdict). A null, empty or wordless text has a null score and isn't abusive.
    A doc_id is taken to be one row.
    """
    spark = documents.sparkSession
    given = labels.where("doc_id is not null and abusive in (0, 1)")
    some = written(least_hashed(given.select("doc_id").distinct(), "doc_id", most_labels), "labelled")
    given = given.join(some, "doc_id", "left_semi").select("doc_id", "abusive").toPandas()
    # Texts that certainly have no label are dropped before anything is shuffled.
    read = holding(documents.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("id"), "text"), some.select(F.col("doc_id").cast("long").alias("id")))
    texts = read.withColumnRenamed("id", "doc_id").join(some, "doc_id").dropDuplicates(["doc_id"]).toPandas()
    fitted = train(dict(zip(texts["doc_id"].tolist(), texts["text"], strict=True)), list(zip(given["doc_id"].tolist(), given["abusive"].astype(int).tolist(), strict=True)), extra=extra)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, model, threshold = shared.value
        order = len(model.higher) + 1
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                row, lengths, of = numbers.flat([sentences(t) for t in part["text"]], order)
                worst = _worst(model.scores(Grams(row, lengths, order), extra), of, len(part))
                known = np.isfinite(worst)
                score = worst - (threshold if math.isfinite(threshold) else 0.0)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": np.where(known, score, np.nan), "abusive": known & (worst >= threshold)})

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInPandas(run, "doc_id long, score double, abusive boolean")
    return out.select("doc_id", F.when(F.isnan("score"), None).otherwise(F.col("score")).alias("score"), "abusive")


def source_rates(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """source, documents, abusive, rate: a null source is one of its own; texts without words count in the documents."""
    both = documents.select("doc_id", "source").join(scores.select("doc_id", F.col("abusive").cast("long").alias("a")), "doc_id")
    out = both.groupBy("source").agg(F.count("*").alias("documents"), F.sum("a").alias("abusive"))
    return out.withColumn("rate", F.col("abusive") / F.col("documents"))
