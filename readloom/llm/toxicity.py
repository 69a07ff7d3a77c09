"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes.

Who votes is told by plain TF-IDF. How much a vote weighs is told by the same cosine in which each term counts by its
relevance, how far its shares in the two classes of examples lie apart: neighbours that share rare words which say nothing
of the label vote with little weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common

#: Bound of the fitted part: labelled examples of each class. All their terms are indexed.
EXAMPLES = 1500
#: Examples in a block of the index; neighbours that vote; texts that are searched together.
BLOCK = 64
NEIGHBOURS = 201
TOGETHER = 64
#: Cosines are compared as integers of this scale.
SCALE = 10**9
#: The postings of terms in more than this share of the examples are dense: a weight for every example, 0 where a term is not.
FREQUENT = 1 / 32
WORD = regex.compile(r"\p{L}+")
COUNTED = "id bigint, label int, terms array<string>, counts array<bigint>"


def terms_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


@dataclass
class Sparse:
    """Rows of terms and weights: row i has the entries from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def unit(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Sparse:
    """Unit rows of (1 + log count) x weight; a text without known terms is zero."""
    out = Sparse(starts, terms, (1 + np.log(counts.astype("f8"))) * weight[terms])
    owner = out.owners()
    norm = np.sqrt(np.bincount(owner, out.weights**2, len(starts) - 1))
    out.weights /= np.maximum(norm, 1e-300)[owner]
    return out


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = ends - starts
    return np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())


@dataclass
class Model:
    """At most 2 x EXAMPLES examples with all their terms; those with equal vectors are one, with their mean label.

    Terms are numbered by how many examples have them, most first. The first ``frequent`` terms have dense postings, in
    blocks of BLOCK examples with the largest weight of each term in each block; the postings of the others follow each
    other, from ``starts[t]`` on for term t, and what a text's give a block is added to its bound as it is.
    """

    terms: list[str]
    weight: np.ndarray  # of each term in any text: inverse document frequency
    relevance: np.ndarray
    frequent: int
    blocks: np.ndarray  # examples x frequent terms; examples that are alike share a block
    maxima: np.ndarray  # frequent terms x blocks
    starts: np.ndarray
    holders: np.ndarray
    held: np.ndarray
    lengths: np.ndarray  # of the examples' vectors times relevance
    labels: np.ndarray
    ids: np.ndarray  # smallest id among the merged examples
    slope: float
    shift: float

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}

    @cached_property
    def telling(self) -> np.ndarray:
        """The blocks times squared relevance; votes need no double precision."""
        return np.ascontiguousarray((self.blocks * self.relevance[: self.frequent] ** 2).T.astype("f4"))

    def votes(self, rows: Sparse, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted vote of each row's neighbours, their cosines and numbers; exact, ties to the smaller number.

        ``alone`` leaves out examples with the same vector (for calibration).
        """
        n, k = len(rows.starts) - 1, min(NEIGHBOURS, len(self.labels))
        best, which, weight = np.full((n, k), -1.0), np.full((n, k), -1), np.zeros((n, k))
        for s in range(0, n if k else 0, TOGETHER):
            e = min(s + TOGETHER, n)
            inside = slice(rows.starts[s], rows.starts[e])
            owner = np.repeat(np.arange(e - s), np.diff(rows.starts[s : e + 1]))
            best[s:e], which[s:e], weight[s:e] = self.nearest(owner, rows.terms[inside], rows.weights[inside], e - s, k, alone)
        vote = (weight * np.where(which >= 0, self.labels[which], 0)).sum(1) / np.maximum(weight.sum(1), 1e-12) if k else np.zeros(n)
        return vote, best, which

    def nearest(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosines, numbers and vote weights of the k nearest examples of n rows.

        A block's bound is what rare terms give there at most, and its maxima. The blocks with the highest bounds are
        searched first, and all that no row can find its k-th neighbour in are skipped.
        """
        count = len(self.labels)
        length = np.sqrt(np.bincount(owner, (weights * self.relevance[terms]) ** 2, n))
        often = terms < self.frequent
        dense = np.zeros((n, self.frequent))
        dense[owner[often], terms[often]] = weights[often]
        owner, terms, weights = owner[~often], terms[~often], weights[~often]
        starts, ends = self.starts[terms - self.frequent], self.starts[terms - self.frequent + 1]
        at, size = runs(starts, ends), ends - starts
        cells, gain = np.repeat(owner * count, size) + self.holders[at], np.repeat(weights, size) * self.held[at]
        rare = np.bincount(cells, gain, n * count).reshape(n, count)
        blocks = np.arange(0, count, BLOCK)
        bound = dense @ self.maxima + np.maximum.reduceat(rare, blocks, axis=1) + 1e-8
        done = np.zeros(len(blocks), bool)
        done[np.argsort(-bound.max(axis=0), kind="stable")[: -(-k // BLOCK) + 1]] = True  # enough for k neighbours
        key = np.full((n, count), -1, "i8")
        self.compare(key, np.flatnonzero(done), dense, rare, alone)
        least = np.partition(key, count - k, axis=1)[:, count - k] // count  # present k-th cosine of each row
        live = (bound * SCALE >= least[:, None]).any(axis=0) & ~done
        self.compare(key, np.flatnonzero(live), dense, rare, alone)
        top = np.argpartition(key, count - k, axis=1)[:, count - k :]
        order = np.argsort(-np.take_along_axis(key, top, 1), axis=1)
        top = np.take_along_axis(top, order, 1)
        best = np.take_along_axis(key, top, 1)
        shared = dense.astype("f4") @ self.telling
        shared += np.bincount(cells, gain * np.repeat(self.relevance[terms] ** 2, size), n * count).reshape(n, count).astype("f4")
        weight = np.take_along_axis(shared, top, 1) / np.maximum(length[:, None] * self.lengths[top], 1e-12)
        none = best < 0
        return np.where(none, -1.0, best // count / SCALE), np.where(none, -1, top), np.where(none, 0, weight)

    def compare(self, key: np.ndarray, blocks: np.ndarray, dense: np.ndarray, rare: np.ndarray, alone: bool) -> None:
        """Puts cosine and number of these blocks' examples, as one integer that orders them, ties to the smaller number."""
        count = key.shape[1]
        if len(blocks) * BLOCK >= count:
            own = slice(None)
            numbers = np.arange(count)
        else:
            own = numbers = np.concatenate([np.arange(b * BLOCK, min((b + 1) * BLOCK, count)) for b in blocks]) if len(blocks) else np.zeros(0, "i8")
        cosine = dense @ self.blocks[own].T + rare[:, own]
        found = np.rint(cosine * SCALE).astype("i8") * count + (count - 1 - numbers)
        key[:, own] = np.where(cosine > 1 - 1e-6, -1, found) if alone else found

    def scores(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30)))


def calibrated(vote: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (vote, label), by a few weighted Newton steps with a slight ridge."""
    x = np.stack([vote, np.ones_like(vote)], axis=1)
    w = np.array([4.0, -2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -5, 5)
    return float(max(w[0], 1e-6)), float(w[1])


def relevance(terms: np.ndarray, label: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """How far each term's shares in the two classes of examples lie apart, in standard errors; 1 where a class is missing.

    ``terms`` and ``label`` are the terms of all examples and the label of the example that has each.
    """
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    if not n1 or not n0:
        return np.ones(size)
    a, b = np.bincount(terms[label == 1], minlength=size), np.bincount(terms[label == 0], minlength=size)
    p = (a + b + 1) / (n1 + n0 + 2)
    return np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [terms_of(v.as_py()) for v in batch.column(2)]
        kinds = (pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([[*c] for c in own], kinds[0]), pa.array([[*c.values()] for c in own], kinds[1])], names=["id", "label", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from ``labels`` (``key``, ``label`` 0/1) and the texts of ``docs``.

    The examples are at most EXAMPLES of each class, those whose key has the smallest hash; only they reach the driver.
    Every term of theirs is indexed. A term weighs by its inverse document frequency, counted over all of ``docs``. Class
    weights follow all of ``labels``. Rows with a null key, label or text count as absent, and of several texts of one key
    the first in order is the example; with one class or none every score is the share of class 1 (0.5 if unknown).
    """
    common.bounded_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    every = {c: known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES) for c in (0, 1)}
    chosen = every[0].unionByName(every[1])
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # 2 x EXAMPLES short rows at most are broadcast
    gathered = sample.mapInArrow(counted, COUNTED).toArrow().combine_chunks()
    ids, y = gathered.column("id").to_numpy(), gathered.column("label").to_numpy().astype("i8")
    spelled, flat, starts, often, held = encoded(gathered)
    del gathered
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(spelled)})

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, n = shared.value, Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                n += 1
                found.update(set(WORD.findall(value.as_py().lower())))
            if len(found) > 4 * len(known) + (1 << 16):  # words that no example has
                found = Counter({t: found[t] for t in found.keys() & known.keys()})
        rows = [(known[t], found[t]) for t in found.keys() & known.keys()] + [(-1, n)]
        yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    seen = docs.select(common.text_of(text).alias("text")).mapInArrow(frequency, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    df = np.zeros(len(spelled) + 1)
    df[seen.column("term").to_numpy()] = seen.column("n").to_numpy()
    owner = np.repeat(np.arange(len(y)), np.diff(starts))
    weight = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1e-3
    size = {c: int((y == c).sum()) for c in (0, 1)}
    mass = {c: share.get(c, 0) / max(1, size[c]) for c in (0, 1)}
    merged: dict[bytes, list] = {}
    for row in np.lexsort((ids,)).tolist():
        inside = slice(starts[row], starts[row + 1])
        one = merged.setdefault(flat[inside].tobytes() + often[inside].tobytes(), [0.0, 0.0, row])
        one[y[row]] += mass[int(y[row])]
    masses, chosen_rows = np.array([m[:2] for m in merged.values()]).reshape(-1, 2), np.array([m[2] for m in merged.values()], "i8")
    every_row = unit(starts, flat, often, weight)
    lead = np.array([every_row.terms[s : e][every_row.weights[s:e].argmax()] if e > s else -1 for s, e in zip(starts[chosen_rows], starts[chosen_rows + 1])], "i8")
    order = np.lexsort((ids[chosen_rows], lead))
    masses, chosen_rows = masses[order], chosen_rows[order]
    at = runs(starts[chosen_rows], starts[chosen_rows + 1])
    rows = Sparse(np.concatenate([[0], np.cumsum(np.diff(starts)[chosen_rows])]), every_row.terms[at], every_row.weights[at])
    prior = share.get(1, 0) / max(1, sum(share.values())) if share else 0.5
    telling = relevance(flat, y[owner], y, len(spelled)) + 1e-3
    model = indexed(spelled, weight, telling, int((held > FREQUENT * len(y)).sum()), rows, masses[:, 1] / np.maximum(masses.sum(1), 1e-12), ids[chosen_rows])
    model.slope, model.shift = 0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    if size[0] and size[1]:
        vote, _, _ = model.votes(rows, alone=True)
        model.slope, model.shift = calibrated(np.concatenate([vote, vote]), np.repeat([0.0, 1.0], len(rows.starts) - 1), np.concatenate([masses[:, 0], masses[:, 1]]))
    return model


def encoded(gathered: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, number of each entry's term, start of each text's entries, counts, how many texts have each term): terms are
    numbered by that, most first, then as spelled; a text's entries follow their numbers."""
    lists = gathered.column("terms").combine_chunks()
    lengths = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), "i8")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    code = lists.flatten().dictionary_encode()
    counts = gathered.column("counts").combine_chunks().flatten().to_numpy()
    numbers, spelled = code.indices.to_numpy().astype("i8"), code.dictionary.to_pylist()
    held = np.bincount(numbers, minlength=len(spelled))
    order = sorted(range(len(spelled)), key=lambda i: (-held[i], spelled[i]))
    place = np.empty(len(spelled), "i8")
    place[order] = np.arange(len(spelled))
    numbers = place[numbers]
    sort = np.lexsort((numbers, np.repeat(np.arange(len(lengths)), lengths)))
    return [spelled[i] for i in order], numbers[sort], starts, counts[sort], held[order]


def indexed(terms: list[str], weight: np.ndarray, telling: np.ndarray, frequent: int, rows: Sparse, labels: np.ndarray, ids: np.ndarray) -> Model:
    count, owner = len(ids), rows.owners()
    often = rows.terms < frequent
    blocks = np.zeros((count, frequent))
    blocks[owner[often], rows.terms[often]] = rows.weights[often]
    maxima = np.stack([blocks[s : s + BLOCK].max(axis=0, initial=0) for s in range(0, max(1, count), BLOCK)], axis=1)
    order = np.lexsort((owner[~often], rows.terms[~often]))
    starts = np.searchsorted(rows.terms[~often][order], np.arange(frequent, len(terms) + 1))
    lengths = np.sqrt(np.bincount(owner, (rows.weights * telling[rows.terms]) ** 2, count))
    return Model(terms, weight, telling, frequent, blocks, maxima, starts, owner[~often][order].astype("i4"), rows.weights[~often][order], lengths, labels, ids, 0.0, 0.0)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``name``: score (0 to 1, calibrated) and evidence, the three nearest examples.

    Evidence holds each example's id, cosine and mean label. Null and empty texts are scored like any other; all rows
    and columns stay, and a clash of names appends underscores.
    """
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms of 2 x EXAMPLES texts
    kind = "struct<score:double,evidence:array<struct<id:bigint,cosine:double,label:double>>>"

    @arrow_udf(kind)
    def judged(texts: pa.Array) -> pa.Array:
        model = shared.value
        vote, best, which = model.votes(vectors([t.as_py() for t in texts], model.numbers, model.weight))
        top = min(3, best.shape[1])
        flat = which[:, :top].ravel()
        seen = pa.StructArray.from_arrays([pa.array(model.ids[flat]), pa.array(best[:, :top].ravel()), pa.array(model.labels[flat])], ["id", "cosine", "label"])
        offsets = pa.array(np.arange(len(texts) + 1) * top, pa.int32())
        return pa.StructArray.from_arrays([pa.array(model.scores(vote)), pa.ListArray.from_arrays(offsets, seen)], ["score", "evidence"])

    return docs.withColumn(common.fresh(docs, name)[0], judged(common.text_of(text)))


def vectors(texts: list[str], number: dict[str, int], weight: np.ndarray) -> Sparse:
    starts, terms, counts = [0], [], []
    for text in texts:
        found = terms_of(text)
        known = found.keys() & number.keys()
        terms += [number[t] for t in known]
        counts += [found[t] for t in known]
        starts.append(len(terms))
    return unit(np.array(starts), np.array(terms, "i8"), np.array(counts, "i8"), weight)


def held_out(key: str = "doc_id"):
    """Whether a document's label is kept for measuring; those without a key are not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whether its label is held out, the score of its text, and whether that is 0.5 or more; see fit and score."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(~held_out())
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))
