"""Language ID by prediction by partial matching: variable-order byte contexts, frozen after training.

For each language a byte context tree of orders 0 to ``ORDER`` counts which
bytes followed which contexts in a sample of its texts. The counts are then
frozen. A byte's code length in a language is that of PPM with escape method C,
without exclusions: in the longest context that the language has seen, a byte
with count n of T (D different ones) costs ``-log2(n / (T + D))``; a byte that
never followed costs the escape ``-log2(D / (T + D))`` and is coded in the next
shorter context, at last as one of 256. The language whose tree codes the
*whole* text (in UTF-8) shortest, with ``-log2`` of its share of the documents
added once, is the prediction; ``score`` is its posterior, 2^-bits over the sum
of all languages' 2^-bits.

The trees are kept as sorted arrays of packed grams, one for each order, with
the finished code lengths of every language beside them (whole multiples of
2^-16 bit, so sums don't depend on blocks). Texts are scored in blocks of bytes
that overlap by a context, so memory doesn't follow the text's length.

Bounds (parameters): the trees are learnt from about ``CHARS`` characters in
all, in equal parts for at most ``LANGUAGES`` languages (those with most rows,
ties to the smaller name); texts of over ``TRAIN_CHARS`` characters are scored
but not learnt from, and equal texts of a language are learnt once. The rows
are chosen by a hash of the text, at the same share at every size of the table.

Nulls and edges: a null text, or one without a letter (Unicode categories L*),
gets ``und`` and score 0; so does every text when nothing can be learnt (an
empty table, no language given). Rows with a null language or null text aren't
learnt from; a null id isn't held out. Repeated rows are scored each. Ties go
to the smaller language name. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest context, in bytes.
ORDER = 4
#: Characters to learn from in all, languages at most, and characters of the longest text learnt from.
CHARS, LANGUAGES, TRAIN_CHARS = 8_000_000, 32, 100_000
#: Bytes scored at once; parts of a bit that code lengths are counted in.
BLOCK, UNIT = 1 << 19, 1 << 16
FOLDS = 5
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each after ORDER zero bytes (its first contexts), and where each starts and ends."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size + ORDER)
    pad = bytes(ORDER)
    return np.frombuffer(b"".join([x for t in texts for x in (pad, t)]), dtype=np.uint8), ends - size, ends


def grams(buffer: np.ndarray, first: int, stop: int) -> np.ndarray:
    """The packed gram of ORDER + 1 bytes that ends at each position of [first, stop)."""
    out = np.zeros(stop - first, dtype=np.uint64)
    for k in range(ORDER, -1, -1):
        out = (out << np.uint64(8)) | buffer[first - k: stop - k]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


@dataclass
class Model:
    """For each order: sorted grams with a row of code lengths by language, sorted contexts with a row of escape lengths."""

    langs: list[str]
    prior: np.ndarray
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def costs_at(self, found: np.ndarray) -> np.ndarray:
        """(positions, languages): the code length of the last byte of each gram."""
        out = np.zeros((len(found), len(self.langs)), dtype=np.int64)
        todo = np.arange(len(found))
        for k in range(ORDER, -1, -1):
            own = found if k == ORDER else found & np.uint64((1 << 8 * (k + 1)) - 1)
            at, hit = _find(self.keys[k], own)
            out[todo[hit]] += self.costs[k][at[hit]]
            todo, found = todo[~hit], own[~hit]
            if not len(todo):
                return out
            at, hit = _find(self.contexts[k], found >> np.uint64(8))
            out[todo[hit]] += self.escapes[k][at[hit]]
        out[todo] += 8 * UNIT
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the code length of each whole text in 1 / UNIT bits, without the prior."""
        buffer, starts, ends = padded(texts)
        total = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        for first in range(ORDER, len(buffer), BLOCK):
            stop = min(first + BLOCK, len(buffer))
            runs = np.zeros((stop - first + 1, len(self.langs)), dtype=np.int64)
            np.cumsum(self.costs_at(grams(buffer, first, stop)), axis=0, out=runs[1:])
            a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(starts, stop)
            lo, hi = np.maximum(starts[a:b], first), np.minimum(ends[a:b], stop)
            total[a:b] += runs[hi - first] - runs[lo - first]
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if self.langs else []
        if use:
            bits = (self.lengths([texts[i].encode("utf-8", "surrogatepass") for i in use]) + self.prior) / UNIT
            best = bits.argmin(axis=1)
            more = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0))
            scores[use] = 1 / more.sum(axis=1)
            for i, b in zip(use, best.tolist(), strict=True):
                names[i] = self.langs[b]
        return names, scores


def fit(texts: dict[str, list[str]], shares: dict[str, float] | None = None) -> Model:
    """The frozen trees of each language's texts; ``shares``: of the documents (equal by default)."""
    langs = sorted(texts)
    shares = shares or {x: 1.0 for x in langs}
    total = sum(shares[x] for x in langs)
    prior = np.array([round(-np.log2(shares[x] / total) * UNIT) for x in langs], dtype=np.int64)
    full = []  # the grams of the highest order, by language
    for lang in langs:
        buffer, starts, ends = padded([t.encode("utf-8", "surrogatepass") for t in texts[lang]])
        inside = np.zeros(len(buffer) + 1, dtype=np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        real = np.cumsum(inside[:-1])[ORDER:] > 0
        full.append(np.unique(grams(buffer, ORDER, len(buffer))[real], return_counts=True) if len(buffer) else
                    (np.array([], np.uint64), np.array([], np.int64)))
    keys, costs, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        counted = []
        for g, n in full:
            own, at = np.unique(g & mask, return_inverse=True)
            counted.append((own, np.bincount(at, weights=n, minlength=len(own))))
        union = np.unique(np.concatenate([own for own, _ in counted])) if counted else np.array([], np.uint64)
        above, parent = np.unique(union >> np.uint64(8), return_inverse=True)
        cost, escape = np.zeros((len(union), len(langs))), np.zeros((len(above), len(langs)))
        if k:
            at, _ = _find(keys[k - 1], union & np.uint64((1 << 8 * k) - 1))
            shorter = costs[k - 1][at]
        else:
            shorter = np.full((len(union), len(langs)), 8 * UNIT)
        for i, (own, n) in enumerate(counted):
            count = np.zeros(len(union))
            count[np.searchsorted(union, own)] = n
            all_n = np.bincount(parent, weights=count, minlength=len(above))
            kinds = np.bincount(parent, weights=count > 0, minlength=len(above))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:, i] = np.where(all_n > 0, np.rint(-np.log2(kinds / (all_n + kinds)) * UNIT), 0)
                coded = np.rint(-np.log2(count / (all_n + kinds)[parent]) * UNIT)
            cost[:, i] = np.where(count > 0, coded, escape[parent, i] + shorter[:, i])
        keys.append(union)
        costs.append(cost.astype(np.int32))
        contexts.append(above)
        escapes.append(escape.astype(np.int32))
    return Model(langs, prior, keys, costs, contexts, escapes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = CHARS) -> Model:
    """Fit on a bounded sample of the rows that aren't held out."""
    own = (docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       held_out(F.col(id_col)).alias("out"))
           .where("not out and text is not null and lang is not null").withColumn("size", F.length("text")))
    counts = (own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("double").alias("size"))
              .orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not counts:
        return fit({})
    share = {r["lang"]: min(1.0, chars / len(counts) / max(1.0, r["size"])) for r in counts}
    keep = F.element_at(F.create_map(*[x for lang, s in sorted(share.items()) for x in (F.lit(lang), F.lit(s))]), F.col("lang"))
    drawn = own.withColumn("hash", F.xxhash64("text", F.lit("ppm"))).where(
        (F.pmod("hash", F.lit(1 << 30)) < keep * (1 << 30)) & (F.col("size") <= TRAIN_CHARS))
    texts: dict[str, list[str]] = {lang: [] for lang in share}
    for r in drawn.dropDuplicates(["lang", "hash"]).select("lang", "text").orderBy("lang", "hash").toLocalIterator():
        texts[r["lang"]].append(r["text"])
    learnt = {lang: t for lang, t in texts.items() if t}
    return fit(learnt, {r["lang"]: float(r["n"]) for r in counts})


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out`` (lang_pred, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            some, names, scores, held = [], [], [], 0
            values = [t if isinstance(t, str) else None for t in texts]
            for k, t in enumerate(values):  # about a block of bytes at a time
                some.append(t)
                held += len(t or "")
                if held >= BLOCK or k + 1 == len(values):
                    a, b = own.predict(some)
                    names += a
                    scores.append(b)
                    some, held = [], 0
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = CHARS) -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col, chars)
    own = predict(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text", "_found")
    return own.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "_found.lang_pred", "_found.score")
