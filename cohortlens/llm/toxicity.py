"""Toxicity: a convolutional text classifier trained in numpy.

A word is a run of letters or digits, lower-cased. Its vector is the sum of
hashed embeddings of the word and of its first 4 and 5 letters, so inflected
forms share most of it. Filters of several widths slide over the word vectors
of a whole text; each keeps its largest value over the text, and a logistic
layer scores these maxima. Long texts are read in blocks that overlap by the
widest filter, so the maxima are those of the whole text.

Training reads every labelled row that may be learnt from, each text whole, in
the same blocks (only the words at the maxima have gradients). The rows are
dealt by a hash to parts of about ``PART_ROWS``, written once as word buckets.
Rows that fit one part are trained in one task. Otherwise every pass trains
each part from the same weights in its own turn, and the weights then move by
the parts' mean move (an embedding: that of the parts that hold it). Weights
and moves are of a fixed size, and a pass has ``LANES`` tasks at most.

Each language has a threshold: the one with the best F1 score over all its
labelled rows, where it has enough rows of both classes, else ``threshold``.
A row's score for it comes from a model of the half of the parts that the row
is not in. The language chooses only the threshold, never the score. Equal
rows are one row with their number as weight, in the fit and in the F1 score.
``sample`` bounds the rows of each class (chosen by a hash of the id; a row
then counts as the 1 / fraction rows it stands for); no query asks for it.

Nulls and edges: a null or empty text is scored as a text without words;
labels that are null are not used; with labels of one class only, or none, the
score is the smoothed share of label 1 (0 without labels). Of repeated label
rows of one id, the largest label counts. Repeated documents are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import parts_for, written

TOKEN = re.compile(r"[^\W_]+")
BUCKETS, DIMENSION, FILTERS, WIDTHS = 1 << 16, 16, 12, (1, 2, 3)
#: Rows and characters of a part (about); most tasks of a pass.
PART_ROWS, PART_CHARS, LANES = 4000, 16_000_000, 12
#: Most labelled ids that are broadcast to the texts (about 40 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Characters of each class's texts in a sample, in all (about).
CLASS_CHARS = 40_000_000
#: Words of a text that are scored at once, and words whose buckets a worker remembers.
BLOCK, REMEMBERED = 16_384, 250_000
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


class _Words(dict):
    """Word to its row of ``table``: three buckets (of the word, its first 4 and its first 5 letters)."""

    def __init__(self):
        self.table = np.zeros((1024, 3), dtype=np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = [zlib.crc32(p.encode("utf-8", "surrogatepass")) & BUCKETS - 1 for p in (word, "4" + word[:4], "5" + word[:5])]
        self[word] = at
        return at


_WORDS = _Words()


def word_buckets(text: str | None) -> np.ndarray:
    """(words, 3) bucket numbers of a whole text."""
    global _WORDS
    if len(_WORDS) > REMEMBERED:
        _WORDS = _Words()
    found = list(map(_WORDS.__getitem__, TOKEN.findall((text or "").lower())))
    return _WORDS.table[np.array(found, dtype=np.int64)]


@dataclass
class Model:
    """The weights: embeddings, for each width filters and bias, and the logistic layer; language thresholds."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    top: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def maxima(self, buckets: np.ndarray, where: bool = False):
        """Largest value of each filter over the words (0 at least), and the word where it begins (-1: none)."""
        best = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        at = np.full(len(best), -1)
        n = len(buckets)
        if n < max(WIDTHS):
            buckets = np.concatenate([buckets, np.full((max(WIDTHS) - n, 3), -1, dtype=np.int32)])
            n = len(buckets)
        # one row for each (place in a filter, filter), of all widths
        filters = np.concatenate([f.reshape(w, DIMENSION, FILTERS).transpose(0, 2, 1).reshape(-1, DIMENSION) for w, f in zip(WIDTHS, self.filters, strict=True)])
        for start in range(0, n, BLOCK):
            part = buckets[start: start + BLOCK + max(WIDTHS) - 1]
            vectors = self.embedding.take(part[:, 0], axis=0)
            vectors += self.embedding.take(part[:, 1], axis=0)
            vectors += self.embedding.take(part[:, 2], axis=0)
            products, first = filters @ vectors.T, 0
            for i, w in enumerate(WIDTHS):
                spans, rows = len(part) - w + 1, products[first: first + w * FILTERS]
                first += w * FILTERS
                if spans <= 0:
                    continue
                values = rows[:FILTERS, :spans]
                for k in range(1, w):
                    values = values + rows[k * FILTERS: (k + 1) * FILTERS, k: k + spans]
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                if where:
                    top = values.argmax(axis=1)
                    value = values[np.arange(FILTERS), top] + self.bias[i]
                    at[own] = np.where(value > best[own], top + start, at[own])
                else:
                    value = values.max(axis=1) + self.bias[i]
                best[own] = np.maximum(best[own], value)
        return (best, at, buckets) if where else best

    def score_words(self, buckets: np.ndarray) -> float:
        z = float(self.maxima(buckets) @ self.top + self.base)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: str | None) -> float:
        return self.score_words(word_buckets(text)) if self.constant is None else self.constant


def _blank(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSION)).astype(np.float32)
    embedding[-1] = 0  # the place of a missing word
    filters = [rng.normal(0, 0.5 / np.sqrt(w * DIMENSION), (w * DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS]
    top = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    return Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], top, 0.0)


class _Learner:
    """A model in training: its weights by name and Adagrad's sums, so steps shrink where a weight has moved much."""

    def __init__(self, model: Model, rate: float, sums: dict[str, np.ndarray] | None = None):
        self.model, self.rate = model, rate
        self.weights = {"embedding": model.embedding, "top": model.top, "base": np.array([model.base], dtype=np.float32)}
        self.weights |= {f"f{i}": f for i, f in enumerate(model.filters)} | {f"b{i}": b for i, b in enumerate(model.bias)}
        self.sums = sums or {name: np.full(w.shape, 1e-6, dtype=np.float32) for name, w in self.weights.items()}

    def step(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        weights, s = self.weights[name], self.sums[name]
        if rows is None:
            s += grad * grad
            weights -= self.rate * grad / np.sqrt(s)
        else:
            s[rows] += grad * grad
            weights[rows] -= self.rate * grad / np.sqrt(s[rows])

    def learn(self, words: list[np.ndarray], labels: np.ndarray, pulls: np.ndarray, order: np.ndarray, batch: int) -> None:
        """One pass over the texts in this order."""
        model, base = self.model, self.weights["base"]
        for start in range(0, len(order), batch):
            chosen = order[start: start + batch]
            best, at, buckets = zip(*[model.maxima(words[d], where=True) for d in chosen], strict=True)  # of whole texts
            best, at, size = np.stack(best), np.stack(at), np.float32(len(chosen))
            offset = np.cumsum([0, *map(len, buckets)])[:-1, None]
            buckets = np.concatenate(buckets)
            z = best @ model.top + base
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) * pulls[chosen]).astype(np.float32)
            pull = np.where(at >= 0, slope[:, None] * model.top, np.float32(0))
            spots = np.maximum(at, 0) + offset
            rows, moves, grads = [], [], {"top": slope @ best, "base": slope.sum(keepdims=True)}
            for i, w in enumerate(WIDTHS):
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                ids = buckets[spots[:, own, None] + np.arange(w)]  # (texts, filters, width, 3)
                vectors = model.embedding[ids].sum(axis=3).reshape(len(chosen), FILTERS, -1)
                grads[f"f{i}"] = np.einsum("dfv,df->vf", vectors, pull[:, own])
                grads[f"b{i}"] = pull[:, own].sum(axis=0)
                back = (model.filters[i].T * pull[:, own, None]).reshape(*ids.shape[:3], 1, DIMENSION)
                rows.append(ids.reshape(-1))
                moves.append(np.broadcast_to(back, (*ids.shape, DIMENSION)).reshape(-1, DIMENSION))
            rows = np.concatenate(rows)
            by_row = np.argsort(rows, kind="stable")
            ids, first = np.unique(rows[by_row], return_index=True)
            self.step("embedding", np.add.reduceat(np.concatenate(moves)[by_row], first, axis=0) / size, ids)
            model.embedding[-1] = 0
            for name, grad in grads.items():
                self.step(name, grad / size)
        model.base = float(base[0])


def _start(share: float, seed: int) -> Model:
    model = _blank(seed)
    model.base = math.log(share / (1 - share))
    return model


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 4, steps: int = 400, batch: int = 32, rate: float = 0.05, seed: int = 0,
        weights: np.ndarray | None = None) -> Model:
    """Train on these texts, for ``epochs`` rounds and ``steps`` batches at least; classes weigh as they occur.

    ``weights``: how many rows each text stands for (1 each by default).
    """
    return fit_words([word_buckets(t) for t in texts], labels, epochs, steps, batch, rate, seed, weights)


def fit_words(words: list[np.ndarray], labels: np.ndarray, epochs: int = 4, steps: int = 400, batch: int = 32, rate: float = 0.05, seed: int = 0,
              weights: np.ndarray | None = None) -> Model:
    """``fit`` for texts given as word buckets."""
    labels = np.asarray(labels, dtype=np.float32)
    weights = np.ones(len(labels)) if weights is None else np.asarray(weights, dtype=np.float64)
    share = ((weights * labels).sum() + 0.5) / (weights.sum() + 1)
    if not len(labels) or labels.min() == labels.max():
        model = _blank(seed)
        model.constant = float(share) if len(labels) else 0.0
        return model
    learner, rng = _Learner(_start(float(share), seed), rate), np.random.default_rng(seed)
    pulls = (weights / weights.mean()).astype(np.float32)
    for _ in range(max(epochs, -(-steps * batch // len(words)))):
        learner.learn(words, labels, pulls, rng.permutation(len(words)), batch)
    return learner.model


def pack(rows: DataFrame, parts: int) -> DataFrame:
    """The labelled rows (_id, text, lang, _hash, y, weight) with their part and, for the text, its word buckets, each part in one run."""
    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([word_buckets(t).astype(np.uint16).tobytes() for t in texts.fillna("")], dtype="object")

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("_id", "_hash", F.lit("part")), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "_id", "_hash", "lang")
    return dealt.select("part", "lang", "y", "weight", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), buckets("text").alias("words"))


def _runs(rows: Iterable) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Each part's number, word buckets, labels and weights."""
    for part, own in groupby(rows, key=lambda r: r["part"]):
        told = [(_words(r), r["y"], r["weight"]) for r in own]
        yield part, [t[0] for t in told], np.array([t[1] for t in told], dtype=np.float32), np.array([t[2] for t in told])


def _words(row) -> np.ndarray:
    return np.frombuffer(row["words"], dtype=np.uint16).reshape(-1, 3).astype(np.int32)


def fit_parts(parts: DataFrame, epochs: int = 4, steps: int = 400, batch: int = 32, rate: float = 0.05, seed: int = 0) -> Model:
    """``fit`` over all rows of the parts: in one task where they are no more than a part's, else by averaged passes."""
    sums = {"chars": F.col("chars"), "n_toxic": F.col("y"), "weights": F.col("weight"), "toxic_weights": F.col("weight") * F.col("y")}
    told = parts.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()]).first()
    n, share, mean = told["n"], (told["toxic_weights"] + 0.5) / (told["weights"] + 1), told["weights"] / max(1, told["n"])
    if told["n_toxic"] in (0, n):
        model = _blank(seed)
        model.constant = float(share) if n else 0.0
        return model
    rows = parts.select("part", "y", "weight", "words").rdd
    if n <= PART_ROWS and told["chars"] <= PART_CHARS:
        def whole(own: Iterable) -> Iterator[Model]:
            _, words, labels, weights = zip(*sorted(_runs(own), key=lambda run: run[0]), strict=True)
            yield fit_words(sum(words, []), np.concatenate(labels), epochs, steps, batch, rate, seed, np.concatenate(weights))

        return rows.coalesce(1).mapPartitions(whole).collect()[0]
    passes = max(epochs, -(-steps * batch // n))
    rounds = min(passes, epochs)
    learner, spark = _Learner(_start(share, seed), rate), parts.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((learner.model, learner.sums))
        moved = rows.coalesce(LANES).mapPartitions(_moves(shared, mean, -(-passes // rounds), turn, batch, rate, seed)).collect()
        _move(learner, moved)
        shared.destroy()
    return learner.model


def _moves(shared, mean: float, passes: int, turn: int, batch: int, rate: float, seed: int):
    """What a task yields in a round: its parts' moves, each from the shared weights and times its rows, summed."""
    def run(own: Iterable) -> Iterator[tuple]:
        model, sums = shared.value
        begin, total, n, touched = _Learner(model, rate, sums), {}, 0, np.zeros(len(model.embedding))
        for part, words, labels, weights in _runs(own):
            copy = Model(model.embedding.copy(), [f.copy() for f in model.filters], [b.copy() for b in model.bias], model.top.copy(), model.base)
            learner = _Learner(copy, rate, {name: s.copy() for name, s in sums.items()})
            pulls, rng = (weights / mean).astype(np.float32), np.random.default_rng([seed, turn, part])
            for _ in range(passes):
                learner.learn(words, labels, pulls, rng.permutation(len(words)), batch)
            n += len(words)
            rows = np.nonzero((learner.sums["embedding"] != sums["embedding"]).any(axis=1))[0]
            touched[rows] += len(words)
            for name, w in learner.weights.items():
                pair, own = total.setdefault(name, (np.zeros(w.shape), np.zeros(w.shape))), rows if name == "embedding" else ...
                pair[0][own] += len(words) * (w[own] - begin.weights[name][own])
                pair[1][own] += len(words) * (learner.sums[name][own] - sums[name][own])
        if n:
            rows = np.nonzero(touched)[0]  # only the embeddings that moved are sent
            total["embedding"] = tuple(x[rows].astype(np.float32) for x in total["embedding"])
            yield n, rows, touched[rows], total

    return run


def _move(learner: _Learner, moved: list[tuple]) -> None:
    """Moves the weights and Adagrad's sums by the parts' mean move; a part counts as its rows."""
    shape, n = learner.weights["embedding"].shape, sum(m[0] for m in moved)
    touched, embedding = np.zeros(shape[0]), (np.zeros(shape), np.zeros(shape))
    for _, rows, times, total in moved:
        touched[rows] += times
        for x, move in zip(embedding, total["embedding"], strict=True):
            x[rows] += move
    for name, w in learner.weights.items():
        pair = embedding if name == "embedding" else [sum(total[name][k] for *_, total in moved) for k in (0, 1)]
        share = np.maximum(touched, 1)[:, None] if name == "embedding" else n
        w += (pair[0] / share).astype(np.float32)
        learner.sums[name] += (pair[1] / share).astype(np.float32)
    learner.model.base = float(learner.weights["base"][0])


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list, threshold: float, least: int = 20,
              weights: np.ndarray | None = None) -> dict[str, float]:
    """The threshold of best F1 for each language with ``least`` rows of both classes; between two neighbouring scores.

    ``weights``: how many rows each score stands for (1 each by default).
    """
    out, weights = {}, np.ones(len(scores)) if weights is None else np.asarray(weights, dtype=np.float64)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, y, w = scores[own], labels[own], weights[own]
        if min((y == 1).sum(), (y == 0).sum()) < least:
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum((w * y)[order])
        f1 = 2 * hits / (np.cumsum(w[order]) + (w * y).sum())
        f1[:-1][s[order][:-1] == s[order][1:]] = -1  # a cut only where scores differ
        best = int(f1.argmax())
        upper, lower = s[order][best], s[order][best + 1] if best + 1 < len(s) else 0.0
        # the given threshold, where it parts the classes as well
        out[lang] = threshold if lower < threshold <= upper else float((upper + lower) / 2)
    return out


def best_thresholds(scored: DataFrame, threshold: float, least: int = 20) -> dict[str, float]:
    """``calibrate`` for a table of any size (lang, y, weight, score): running sums by runs of descending scores."""
    cuts = written(scored.where("lang is not null").groupBy("lang", "score").agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("hits"), F.sum("y").alias("n1"),
        F.sum(1 - F.col("y")).alias("n0")), "cuts")
    totals = cuts.groupBy("lang").agg(F.sum("hits").alias("total"), F.least(F.sum("n1"), F.sum("n0")).alias("fewer")).where(F.col("fewer") >= least)
    runs = written(cuts.join(F.broadcast(totals), "lang").repartitionByRange(parts_for(cuts.count()), F.col("lang"), F.desc("score"))
                   .withColumn("run", F.spark_partition_id()), "cut-runs")
    before = Window.partitionBy("lang").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("run", "lang").agg(F.sum("w").alias("own_w"), F.sum("hits").alias("own_hits")).select(
        "run", "lang", *[F.coalesce(F.sum(f"own_{c}").over(before), F.lit(0.0)).alias(f"{c}_before") for c in ("w", "hits")])
    inside = Window.partitionBy("run", "lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("hits_before") + F.sum("hits").over(inside)) / (F.col("w_before") + F.sum("w").over(inside) + F.col("total"))
    best = (runs.join(F.broadcast(starts), ["run", "lang"]).select("lang", F.struct(f1.alias("f1"), "score").alias("cut"))
            .groupBy("lang").agg(F.max("cut").getField("score").alias("upper")))
    lower = F.max(F.when(F.col("score") < F.col("upper"), F.col("score")))
    found = runs.join(F.broadcast(best), "lang").groupBy("lang", "upper").agg(F.coalesce(lower, F.lit(0.0)).alias("lower")).orderBy("lang").collect()
    # the given threshold, where it parts the classes as well
    return {r["lang"]: threshold if r["lower"] < threshold <= r["upper"] else (r["upper"] + r["lower"]) / 2 for r in found}


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Every document with a label that may be learnt from: _id, y, text, lang, _hash and _length (of the text)."""
    marks = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
             .where(~held_out(F.col("_id"))))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # the hash and the length before the join, so that counts needn't move the texts
    own = own.where(~held_out(F.col("_id"))).withColumns({"_hash": F.xxhash64("text"), "_length": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    return own.join(F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks, "_id")


def distinct_rows(told: DataFrame) -> DataFrame:
    """Equal rows of an id are one row with their number as weight."""
    return told.groupBy("_id", "y", "text", "lang", "_hash", "_length").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def sampled(told: DataFrame, sample: int, chars: int = CLASS_CHARS) -> DataFrame:
    """About ``sample`` rows and ``chars`` characters of each class of ``labelled``, at most, each weighing the rows it stands for."""
    counts = {r["y"]: r["count"] for r in told.select("_id", "y").distinct().groupBy("y").count().collect()}
    # a hash of the id keeps the same share of each class at every size of the table
    shares = {y: min(1.0, sample / max(1, counts.get(y, 0))) for y in (0, 1)}
    by_class = lambda values: F.element_at(F.create_map(*[x for y, v in values.items() for x in (F.lit(y), F.lit(v))]), F.col("y"))
    drawn = lambda share, *of: F.pmod(F.xxhash64(*of, F.lit("toxicity")), F.lit(1_000_000)) < by_class({y: 1_000_000.0 * v for y, v in share.items()})
    rows = written(distinct_rows(told.where(drawn(shares, "_id"))), "labelled")
    sizes = {r["y"]: r for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    # different texts of one id: a share of them by a second hash, where they are more than the bounds
    second = {y: min(1.0, 2 * sample / r["n"], chars / max(1, r["chars"] or 0)) for y, r in sizes.items()} or {0: 1.0}
    stands = {y: 1 / (shares[y] * v) for y, v in second.items()}
    return rows.where(drawn(second, "_id", "_hash")).withColumn("weight", F.col("weight") * by_class(stands))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, lang_col: str, sample: int,
                    chars: int = CLASS_CHARS) -> pd.DataFrame:
    """The rows of a bounded sample (``sampled``): text, lang, y, and the rows of the table each stands for (weight)."""
    kept = sampled(labelled(docs, labels, label, id_col, text_col, lang_col), sample, chars)
    return kept.orderBy("_id", "_hash", "lang").select("text", "lang", "y", "weight").toPandas()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int | None = None, threshold: float = 0.3, seed: int = 0) -> Model:
    """Fit on all labelled rows that may be learnt from; language thresholds from all of them, scored by models that haven't seen them."""
    told = labelled(docs, labels, label, id_col, text_col, lang_col)
    if sample is not None:
        told = sampled(told, sample)
    size = (told.select("_id", "lang", "_hash", "_length").distinct()
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_length"), F.lit(0)).alias("chars")).first())
    # an even number, since halves of the parts are fitted too
    count = 2 * max(1, math.ceil(max(size["n"] / PART_ROWS, size["chars"] / PART_CHARS) / 2))
    parts = written(pack(distinct_rows(told) if sample is None else told, count), "parts")
    half = F.col("part") % 2
    with ThreadPoolExecutor(3 if count == 2 else 1) as pool:  # fits of more than a task go one after the other
        model, *halves = pool.map(lambda own: fit_parts(own, seed=seed), [parts, parts.where(half == 0), parts.where(half == 1)])
    if model.constant is None:
        model.thresholds = best_thresholds(score_parts(parts, halves), threshold)
    return model


def score_parts(parts: DataFrame, halves: list[Model]) -> DataFrame:
    """lang, y, weight, score of all rows of the parts, by the model of the parts of the other half (even, odd)."""
    shared = parts.sparkSession.sparkContext.broadcast(halves)

    def run(own: Iterable) -> Iterator[tuple]:
        for r in own:
            model = shared.value[1 - r["part"] % 2]
            yield r["lang"], r["y"], r["weight"], model.score_words(_words(r)) if model.constant is None else model.constant

    rows = parts.select("part", "lang", "y", "weight", "words").rdd.mapPartitions(run)
    return parts.sparkSession.createDataFrame(rows, "lang string, y int, weight double, score double")


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts.fillna("")], dtype="float64")

    return docs.withColumn(out, scores(F.col(text_col).cast("string")))


def language_threshold(model: Model, lang_col: str = "lang", threshold: float = 0.3) -> Column:
    found = [x for lang, cut in sorted(model.thresholds.items()) for x in (F.lit(lang), F.lit(float(cut)))]
    return F.coalesce(F.element_at(F.create_map(*found), F.col(lang_col)), F.lit(threshold)) if found else F.lit(threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **options) -> DataFrame:
    """Per row: id, held_out, score, predicted (score >= threshold), lang_threshold, toxic (score >= its language's threshold)."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, threshold=threshold, **options)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    scored = score(own, model, "_text").drop("_text").withColumn("lang_threshold", language_threshold(model, "_lang", threshold))
    return scored.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "lang_threshold", (F.col("score") >= F.col("lang_threshold")).cast("int").alias("toxic"))
