"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Examples: at most `max_examples` labelled documents, chosen by a seeded hash of their id; equal texts are one example
with their mean label. Only they are learnt from. Every term of theirs counts; its weight is (1 + log tf) * idf, and the idf
carries a factor that grows with the deviation of the term's toxic share: terms within some three standard errors hardly
count, because with plain idf rare words without any meaning decide who is near. Everything that is not an example, and
every example too, is scored from its text alone.

Index: postings by term, examples in blocks of 16, similar ones together, and the highest weight of every term in every
block that holds it. A query reads the postings of its heaviest terms, which gives a floor for the k-th similarity; of its
other terms it reads the blocks' maxima only. Examples whose sum and block bound stay below the floor are never scored.
The k nearest are exact; ties go to the example that comes first.

Votes are weighted by distance, and the share of toxic examples is one small vote more. Leave-one-out votes of the
examples give a monotone map from votes to the share of toxic examples, so a score is a probability. Without any term in common the score is the share among examples without terms.

Defined results: null and empty texts have no terms; ids without a label, and null labels, teach nothing; a document
labelled more than once has its mean label; without examples every score is 0; the held-out fifth is never an example;
other columns pass through.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fareloom.llm.common import opened, per_text

MAX_EXAMPLES = 4096
K, BLOCK = 15, 16
# Least factor of a term's idf, so that no term is lost, and the deviation in standard errors from which terms count fully.
LEAST_FACTOR, FULL_Z = 0.01, 3.0
# Votes that the share of toxic examples has, so that neighbours with hardly anything in common decide little.
PRIOR_WEIGHT = 0.1
# Share of a text's score bound that the terms left to the block maxima may have together.
REST = 0.05
_WORD = re.compile(r"[^\W_]+")


def terms(raw: bytes | None) -> Counter:
    return Counter(_WORD.findall(raw.decode("utf-8", "replace").lower())) if raw else Counter()


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fifth that is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Vocabulary:
    """Numbers of words, in the order they come."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def numbered(self, words: Iterable[str], counts: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        number = self.number
        return (np.array([number.setdefault(w, len(number)) for w in words], np.int32), np.array(list(counts), np.int32))

    def in_order(self) -> tuple[dict[str, int], np.ndarray]:
        """Numbers in alphabetical order, and the new number of every old one: the same whatever order words came in."""
        place = {w: k for k, w in enumerate(sorted(self.number))}
        new = np.zeros(len(place), np.int32)
        for word, old in self.number.items():
            new[old] = place[word]
        return place, new


class Model:
    """Vocabulary, block-max index, neighbours and calibration, made from (name, label, term counts)."""

    def __init__(self, examples: Iterable[tuple[str, float, dict[str, int]]], k: int = K):
        words = Vocabulary()
        self._learn([(name, label, *words.numbered(own.keys(), own.values())) for name, label, own in examples], words, k)

    @classmethod
    def of_numbered(cls, examples: list[tuple[str, float, np.ndarray, np.ndarray]], words: "Vocabulary", k: int = K) -> "Model":
        """From examples whose terms are numbers in a vocabulary, with their counts."""
        model = cls.__new__(cls)
        model._learn(examples, words, k)
        return model

    def _learn(self, examples: list[tuple[str, float, np.ndarray, np.ndarray]], words: "Vocabulary", k: int) -> None:
        self.k, (self.place, renumbered) = k, words.in_order()
        examples = sorted(examples, key=lambda e: e[0])
        found, at, counts = [e[:2] for e in examples], [renumbered[e[2]] for e in examples], [e[3] for e in examples]
        labels = np.array([y for _, y in found], float)
        self.prior = float(labels.mean()) if len(found) else 0.0
        self.factor = self._factors(at, labels)
        vectors = [self._unit(a, c) for a, c in zip(at, counts)]
        lead = [int(a[np.argmax(v)]) if len(a) else -1 for a, v in vectors]
        second = [int(a[np.argsort(v)[-2]]) if len(a) > 1 else -1 for a, v in vectors]
        used = sorted((i for i in range(len(found)) if lead[i] >= 0), key=lambda i: (lead[i], second[i], labels[i], found[i][0]))
        empty = [labels[i] for i in range(len(found)) if lead[i] < 0]
        self.base = float((sum(empty) + self.prior) / (len(empty) + 1))
        self.names, self.labels = [found[i][0] for i in used], labels[used]
        self._index([vectors[i] for i in used])
        self.steps = self._calibrated([self._vote(*self.nearest(*vectors[i], skip=n))[0] for n, i in enumerate(used)])

    def _factors(self, at: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """Per term its idf times a factor that grows with the deviation of its toxic share, in standard errors."""
        size, share = len(self.place), float(labels.mean()) if len(labels) else 0.0
        every, toxic = np.zeros(size), np.zeros(size)
        for terms, label in zip(at, labels.tolist()):
            every[terms] += 1
            toxic[terms] += label
        z = np.abs(toxic - every * share) / np.sqrt(every * share * (1 - share) + 1)
        return np.log(1 + len(labels) / np.maximum(every, 1)) * np.maximum(z ** 5 / (z ** 4 + FULL_Z ** 4), LEAST_FACTOR)

    def _unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at)
        at = at[order].astype(np.int64)
        value = (1 + np.log(counts[order])) * self.factor[at]
        return at, value / np.sqrt((value ** 2).sum()) if len(at) else value

    def _vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and the unit vector's values."""
        place = self.place
        own = [(at, c) for at, c in zip(map(place.get, counts), counts.values()) if at is not None]
        both = np.fromiter(chain.from_iterable(own), np.int64, 2 * len(own))
        return self._unit(both[::2], both[1::2])

    def _index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings by term and by example; by term the blocks that hold it with its highest weight there, and overall."""
        sizes = [len(at) for at, _ in vectors]
        self.ends, self.size = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), len(vectors)
        self.blocks = -(-self.size // BLOCK)
        self.terms = np.concatenate([np.zeros(0, np.int64), *[at for at, _ in vectors]]).astype(np.int32)
        self.values = np.concatenate([np.zeros(0), *[v for _, v in vectors]])
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), sizes)
        order = np.lexsort((example, self.terms))
        term, self.posted, self.weights = self.terms[order], example[order].astype(np.int64), self.values[order]
        numbers = np.arange(len(self.place) + 1)
        self.posts = np.searchsorted(term, numbers).astype(np.int32)
        block = self.posted // BLOCK
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[:len(term)])
        self.held, self.maxima = block[first].astype(np.int64), np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.block_posts = np.searchsorted(term[first], numbers).astype(np.int32)
        self.peak = np.zeros(len(self.place))
        np.maximum.at(self.peak, term[first], self.maxima)
        self.query = np.zeros(len(self.place))  # of all terms; zero between texts
        self.scored = [0, 0]  # examples scored in full, and all there were

    @staticmethod
    def _sums(lists: tuple, at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Sums of value times weight over the lists (begin per term, number, weight) of the terms `at`."""
        begins, number, weight = lists
        low = begins[at]
        size = begins[at + 1] - low
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(low - ends + size, size)
        return np.bincount(number[place], weight[place] * np.repeat(value, size), n)

    def _similar(self, ids: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact similarities of the given examples."""
        low, size = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(low - begin, size)
        self.query[at] = value
        found = np.add.reduceat(self.values[place] * self.query[self.terms[place]], begin)
        self.query[at] = 0.0
        return found

    def nearest(self, at: np.ndarray, value: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples with a positive similarity and their similarity, the k nearest, nearest first.

        Terms go in descending order of what they can add. Postings are read until all terms left could add only a small
        share; the k-th best sum so far is then a floor. Of the terms left only the blocks' maxima are read, and only
        examples that reach the floor with their block's bound are scored in full.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(at) or not self.size:
            return none
        reach = value * self.peak[at]
        order = np.argsort(-reach, kind="stable")
        left = reach.sum() - np.cumsum(reach[order])
        cut = int(np.searchsorted(-left, -REST * reach.sum())) + 1
        first, rest = order[:cut], order[cut:]
        sums = self._sums((self.posts, self.posted, self.weights), at[first], value[first], self.size)
        if skip is not None:
            sums[skip] = -2.0
        floor = np.partition(sums, -self.k)[-self.k] if self.size > self.k else 0.0
        bound = self._sums((self.block_posts, self.held, self.maxima), at[rest], value[rest], self.blocks)
        most = sums + np.repeat(bound, BLOCK)[:self.size]
        ids = np.flatnonzero(most >= floor - 1e-9) if floor > 1e-9 else np.flatnonzero(most > 0)
        self.scored[0] += len(ids)
        self.scored[1] += self.size
        if not len(ids):
            return none
        found = self._similar(ids, at, value)
        ids, found = ids[found > 0], found[found > 0]
        if len(ids) > self.k:  # ties of the k-th stay
            near = found >= np.partition(found, -self.k)[-self.k] - 1e-9
            ids, found = ids[near], found[near]
        best = np.lexsort((ids, -np.round(found, 12)))[:self.k]
        return ids[best], found[best]

    def _vote(self, best: np.ndarray, score: np.ndarray) -> tuple[float, float]:
        """Share of the votes for toxic (nan without neighbours), and their number."""
        if not len(best):
            return float("nan"), 0.0
        weight = score / (1.05 - np.minimum(score, 1.0))
        toxic = (weight * self.labels[best]).sum() + PRIOR_WEIGHT * self.prior
        return float(toxic / (weight.sum() + PRIOR_WEIGHT)), float(len(best))

    def _calibrated(self, votes: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Ascending votes and the pooled shares of toxic examples at them."""
        pools: list[list[float]] = []  # sum of votes, of labels, number
        for vote, label in sorted((v, y) for v, y in zip(votes, self.labels.tolist()) if v == v):
            pools.append([vote, label, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        at = np.array([p[0] / p[2] for p in pools])
        return at, np.array([(p[1] + self.prior) / (p[2] + 1) for p in pools])

    def score(self, counts: dict[str, int]) -> tuple[float, list[tuple[str, float, float]]]:
        """Probability of the label 1, and the neighbours it rests on (name, similarity, label)."""
        best, near = self.nearest(*self._vector(counts))
        vote, n = self._vote(best, near)
        if not n:
            return min(1.0, max(0.0, self.base)), []
        score = float(np.interp(vote, *self.steps)) if len(self.steps[0]) else vote
        return min(1.0, max(0.0, score)), [
            (self.names[b], float(s), float(self.labels[b])) for b, s in zip(best.tolist(), near)]


def learn(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    max_examples: int = MAX_EXAMPLES, seed: int = 11, k: int = K,
) -> Model:
    """A model from at most `max_examples` labelled documents; only their ids and term counts reach the driver."""
    given = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_id")))
    chosen = given.groupBy("_id").agg(F.avg("_label").alias("_label")).orderBy(
        F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_examples)
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = own.join(F.broadcast(chosen), "_id").withColumn("_key", F.xxhash64("_text")).dropDuplicates(["_id", "_key"])

    def make():
        return lambda texts: [{"terms": list(c), "counts": list(c.values())} for c in map(terms, texts)]

    found = opened(per_text(rows, "_text", ["_id", "_key", "_label"], "terms array<string>, counts array<int>", make),
                   ["_id", "_key", "_label"], ["terms", "counts"])
    same: dict[int, list] = {}
    words = Vocabulary()
    for r in found.toLocalIterator():  # as numbers at once: dicts of words would take many times the memory
        kept = same.get(r._key)
        if kept is None:
            same[r._key] = [str(r._id), [r._label], *words.numbered(r.terms, r.counts)]
        else:
            kept[0] = min(kept[0], str(r._id))
            kept[1].append(r._label)
    return Model.of_numbered([(name, float(np.mean(sorted(given))), at, n) for name, given, at, n in same.values()], words, k)


FIELDS = "score double, evidence array<struct<example:string,similarity:double,label:double>>"


def score(docs: DataFrame, model: Model, *, text: str | Sequence[str] = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with score, predicted (1 from 0.5 up) and evidence (the nearest examples); `text` as in `per_text`."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def one(raw: bytes | None) -> dict:
            value, near = own.score(terms(raw))
            return {"score": value, "evidence": [{"example": a, "similarity": s, "label": y} for a, s, y in near]}

        return lambda texts: map(one, texts)

    made = opened(per_text(docs, text, keep, FIELDS, make), keep, ["score", "evidence"])
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
