"""Phrase collocations by top-order marginalisation.

Every word position starts one window: the word and the next ``LONGEST - 1``
words of its piece, padded with the empty string at the piece's end (lead
columns over the piece). Only these longest windows are counted. A phrase's
occurrences are then the sum of the windows that begin with it, so Spark's
ROLLUP over (w1, w2, w3, w4) gives the counts of all shorter phrases, and its
subtotal for a language gives all words; no n-gram length is exploded by itself.

Phrases with fewer than ``least`` occurrences are neither candidates nor parts
of one, so a window may end before a word that would make it too rare. Two
sieves find where that surely is: the first counts words and pairs, the second
runs of three and four words whose pairs pass the first. Tasks send 32-bit
entries of hashed runs with a saturated count; a reducer adds them up hash
block by hash block, and ``SIEVE`` bits (a fixed size) say which hashes may be
frequent. Equal hashes only make a run look more frequent, so a sieve loses
nothing: it keeps rare windows out of the shuffle, and every count still comes
from the windows and ROLLUP. (With far more frequent runs than bits it would
keep less out.) Tasks count the windows of about ``RUN`` bytes before they are
shuffled.

Score: a candidate of f = a occurrences cut into two parts with l and r
occurrences has floor(2000000 a / (l + r)); its lowest cut counts, ties to the
smallest first part. All arithmetic is in 38-digit decimals.

Nulls and edges: a null text is empty; a null language is ``und``; repeated
rows count each; an empty table gives no rows; ties in the ranking go by score,
count, then phrase in UTF-8 byte order. Very long texts and words are read
whole. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import written

LONGEST, LEAST, KEEP = 4, 30, 2000
#: Bits of a sieve, fewest hash blocks (both as powers of two), bytes of text counted together and entries held in a task.
SIEVE, BLOCKS, RUN, HELD = 27, 12, 4_000_000, 8_000_000
#: Bits of an entry's hash within its block, and its largest count.
INSIDE, TOP = 27, 31
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of the texts, the text each is in, and whether the next one is in the same piece."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])  # offsets from 0
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]: bounds[-1]]
    bounds = bounds - bounds[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] = inside[first]  # a text's first byte begins a word, whatever stands before it
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(0, np.int64), np.zeros(0, bool)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(kind == _BREAK)])[starts]
    follows = np.zeros(len(starts), dtype=bool)
    follows[:-1] = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
    body = _LOWER[data[inside]]
    offsets = np.append((np.cumsum(inside) - 1)[starts], len(body)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body))
    return words.dictionary_encode(), owner, follows


def _runs(batch: pa.RecordBatch, run: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, langs) of about ``run`` bytes each."""
    texts, langs = batch.column("_text"), batch.column("_lang")
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)) // run
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a), langs.slice(a, b - a)


def _hashes(words: pa.DictionaryArray, langs: pa.Array, owner: np.ndarray) -> Iterator[np.ndarray]:
    """The 64-bit hash of the 1, 2, 3, ... words from each position on (past the end: of whatever comes there)."""
    own = lambda values: pd.util.hash_array(np.asarray(values.to_pandas(), dtype=object), categorize=False)
    h, out = own(words.dictionary)[np.asarray(words.indices)], own(langs)[owner]
    for k in range(LONGEST):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ np.roll(h, -k)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        yield out


def _allowed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _reach(words: pa.DictionaryArray, langs: pa.Array, owner: np.ndarray, follows: np.ndarray,
           sieves: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1 to LONGEST words: whether they stand in one piece and the sieves so far let all their runs pass, and their hashes.

    The first sieve tells of one and two words, the second of more.
    """
    hashes, passes = list(_hashes(words, langs, owner)), []
    on = np.ones(len(owner), dtype=bool)
    for k in range(1, LONGEST + 1):
        if k > 1:
            # the run without its last word, and the one without its first word
            on = on & np.append(passes[k - 2][1:], False) & follows
        if len(sieves) > (k > 2):
            on = on.copy()
            on[on] = _allowed(sieves[int(k > 2)], hashes[k - 1][on])
        passes.append(on)
    return passes, hashes


def sieve(texts: DataFrame, lengths: tuple[int, ...], least: int, before: list[np.ndarray], bits: int = SIEVE, size: int = RUN) -> np.ndarray:
    """2^bits packed bits by hash: whether runs of ``lengths`` words may occur ``least`` times, among those that earlier sieves let pass."""
    blocks = max(BLOCKS, (texts.rdd.getNumPartitions() // 16).bit_length())  # a block's entries fit in a task
    blocks, shared = min(blocks, bits - 3), texts.sparkSession.sparkContext.broadcast(before)
    shift = np.uint64(64 - blocks - INSIDE)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held) >> shift, return_counts=True)
        entries = ((at & np.uint64((1 << INSIDE) - 1)) << np.uint64(5) | np.minimum(n, TOP).astype(np.uint64)).astype("<u4")
        block = (at >> np.uint64(INSIDE)).astype(np.int64)
        own, first = np.unique(block, return_index=True)
        stops = np.append(first[1:], len(block))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([entries[a:b].tobytes() for a, b in zip(first, stops, strict=True)], pa.binary())],
                                          names=["block", "entries"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for some, langs in _runs(batch, size):
                words, owner, follows = words_of(some)
                if not len(words):
                    continue
                passes, hashes = _reach(words, langs, owner, follows, shared.value)
                for k in lengths:
                    held.append(hashes[k - 1][passes[k - 1]])
                    n += len(held[-1])
                if n >= HELD:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def full(chunks: list[np.ndarray]) -> bytes:
        entries = np.sort(np.concatenate(chunks))
        at = entries >> 5
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        n = entries & TOP
        n = np.where(n == TOP, least, n)  # a full count stands for any number
        frequent = at[first][np.add.reduceat(n.astype(np.int64), first) >= least]
        marks = np.zeros(1 << (bits - blocks), dtype=bool)
        marks[frequent >> np.uint32(INSIDE - (bits - blocks))] = True
        return np.packbits(marks).tobytes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chunks = None, []
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("entries"), strict=True):
                if b != block and chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([full(chunks)], pa.binary())], names=["block", "marks"])
                    chunks = []
                block = b
                chunks.append(np.frombuffer(raw.as_buffer(), dtype="<u4"))
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([full(chunks)], pa.binary())], names=["block", "marks"])

    out = np.zeros((1 << blocks, 1 << (bits - blocks - 3)), dtype=np.uint8)
    dealt = texts.mapInArrow(count, "block long, entries binary").repartition("block").sortWithinPartitions("block")
    for r in dealt.mapInArrow(add, "block long, marks binary").toLocalIterator():  # 2^bits bits in all
        out[r["block"]] = np.frombuffer(r["marks"], dtype=np.uint8)
    return out.reshape(-1)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination of the columns' whole numbers (-1 or more), and how often it occurs."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * (int(c.max()) + 2) + (c + 1)
    return np.unique(key, return_index=True, return_counts=True)[1:]


def windows(texts: DataFrame, least: int, bits: int = SIEVE, size: int = RUN) -> DataFrame:
    """(_lang, w1..w4, n): the windows of all word positions, counted within tasks.

    A window is padded from where its piece ends or the sieves say that the run is too rare (a rare first word: all padding).
    """
    sieves = [sieve(texts, (1, 2), least, [], bits, size)]
    sieves.append(sieve(texts, tuple(range(3, LONGEST + 1)), least, sieves, bits, size))
    shared = texts.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, langs in _runs(batch, size):
                words, owner, follows = words_of(some)
                if not len(words):
                    continue
                passes, _ = _reach(words, langs, owner, follows, shared.value)
                ids, lang = np.asarray(words.indices).astype(np.int64), langs.dictionary_encode()
                columns = [np.asarray(lang.indices)[owner].astype(np.int64)]
                columns += [np.where(on, np.roll(ids, -k), -1) for k, on in enumerate(passes)]
                at, n = _distinct(columns)
                spelt = pa.concat_arrays([words.dictionary, pa.array([""], pa.large_string())])  # -1: padding
                last = len(spelt) - 1
                rows = [lang.dictionary.take(pa.array(columns[0][at]))]
                rows += [spelt.take(pa.array(np.where(c[at] < 0, last, c[at]))).cast(pa.string()) for c in columns[1:]]
                for a in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([*[r.slice(a, 100_000) for r in rows], pa.array(n[a: a + 100_000], pa.int64())],
                                                     names=["_lang", *WORDS, "n"])

    return texts.mapInArrow(run, "_lang string, " + ", ".join(f"{w} string" for w in WORDS) + ", n long")


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    """(_lang, words, phrase, f): every phrase of 1 to LONGEST words with ``least`` occurrences, and (0, '') for all words of a language."""
    texts = docs.select(F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))
    counted = windows(texts, least, **sizes).groupBy("_lang", *WORDS).agg(F.sum("n").alias("n"))
    level = F.bit_count(F.grouping_id()).cast("int")  # 0: all of lang and words kept
    rolled = (counted.rollup("_lang", *WORDS).agg(F.sum("n").alias("f"), level.alias("_cut"))
              .withColumn("words", F.lit(LONGEST) - F.col("_cut")).where("words >= 0"))
    # a prefix that ends in padding is the same phrase as the shorter one
    whole = F.when(F.col("words") == 0, True).otherwise(F.element_at(F.array(*WORDS), F.greatest("words", F.lit(1))) != "")
    kept = rolled.where(whole & ((F.col("f") >= least) | (F.col("words") == 0)))
    return kept.select("_lang", "words", F.array_join(F.slice(F.array(*WORDS), 1, F.col("words")), " ").alias("phrase"), "f")


def part(phrase: str, first: int | F.Column, length: int | F.Column) -> F.Column:
    """The words [first, first + length) of a phrase, space-joined."""
    return F.array_join(F.slice(F.split(F.col(phrase), " "), first, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, keep: int = KEEP, text_col: str = "text", lang_col: str = "lang",
                 **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``keep`` phrases of each language; ``sizes``: bits of the sieves and size (bytes of a run)."""
    counts = written(phrase_counts(docs, least, text_col, lang_col, **sizes), "phrases")
    phrases = counts.where("words >= 2").select("_lang", "words", "phrase", F.col("f").alias("a"))
    parts = counts.where(f"words between 1 and {LONGEST - 1}").select("_lang", F.col("phrase").alias("_part"), "f")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.select("*", cut).select("_lang", "phrase", "words", "a", "k", part("phrase", F.lit(1), F.col("k")).alias("_left"),
                                           part("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"))
    sized = (cuts.join(parts.withColumnsRenamed({"_part": "_left", "f": "l"}), ["_lang", "_left"])
             .join(parts.withColumnsRenamed({"_part": "_right", "f": "r"}), ["_lang", "_right"]))
    exact = F.expr("2000000BD * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = sized.withColumn("score", exact).groupBy("_lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_low"))
    # the commonest longer candidate around each phrase
    spans = [(i, n) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    within = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in spans])).alias("_s")
    longer = (phrases.where("words > 2").select("_lang", "phrase", "words", "a", within)
              .where("_s.n < words and _s.i + _s.n <= words + 1")
              .select("_lang", part("phrase", F.col("_s.i"), F.col("_s.n")).alias("phrase"), F.col("a").alias("_a"))
              .groupBy("_lang", "phrase").agg(F.max("_a").alias("_around")))
    kept = scored.join(longer, ["_lang", "phrase"], "left").where(
        F.expr("_around is null or 100BD * cast(_around as decimal(19, 0)) < 80BD * cast(a as decimal(19, 0))"))
    ranked = kept.select("_lang", "phrase", "a", "_low.l", "_low.r", "_low.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= keep)
    totals = counts.where("words = 0").select("_lang", F.col("f").alias("n"))
    return ranked.join(totals, "_lang").select(F.col("_lang").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
