"""SimHash near-duplicates by anchor-point covering.

A fingerprint's low 46 bits are two words of 23 bits. The anchors are the pairs
of Golay code words: each 23-bit word lies within 3 bits of one code word, its
home. Two fingerprints that differ in at most 2 bits differ in s bits of the
first word and t of the second with s + t <= 2, so each lies within 3 + s and
3 + t bits of the other's home. Every fingerprint is sent to all those anchors
(61 on average out of 16 million) and compared, on all 64 bits, with the
fingerprints whose home is there. No link is missed and no others come back.

Equal fingerprints are one row here. Anchors that are home to more than
``CELL`` fingerprints are cut into cells of homes x visitors. A task keeps, of
the links it finds, one for each fingerprint to the smallest of its component
there, so a cluster never comes back as all its pairs.

Nulls and edges: a null text counts as empty; a text without words has
fingerprint 0, linked like any other; null ids keep their fingerprint and
component (the smallest id that is not null, else null); repeated rows stay.
``keep_one`` goes by the components themselves, not by ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import golay
from cohortlens.llm.common import own_names, parts_for, written
from cohortlens.llm.graph import components, forest

SEED = 42
#: Fingerprints of one home or of one anchor's visitors that are compared in one cell.
CELL = 8192
#: Rows that a task compares; pairs that it holds at once; shingles that it hashes at once.
TASK_ROWS, PAIRS, SHINGLES = 1_500_000, 2_000_000, 65_536
MASK = (1 << golay.LENGTH) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a whole text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, ones = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SHINGLES):
        run = words[at: at + SHINGLES + shingle - 1]
        grams = zip(*(run[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [run]
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carried: Sequence[str] = ()) -> DataFrame:
    """(id, fingerprint as long, the ``carried`` columns) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), *b.columns[2:]], names=["_id", "_print", *carried])

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *carried)
    kinds = [("_id", narrow.schema["_id"]), ("_print", None), *((c, narrow.schema[c]) for c in carried)]
    return narrow.mapInArrow(run, ", ".join(f"{c} {f.dataType.simpleString() if f else 'long'}" for c, f in kinds))


def _visits(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home) for every anchor that a fingerprint has to visit."""
    low, high = prints & MASK, prints >> golay.LENGTH & MASK
    out = []
    for s in range(threshold + 1):
        rows, first = golay.anchors(low, s)
        for t in range(threshold + 1 - s):
            again, second = golay.anchors(high[rows], t)
            out.append((first[again] | second << golay.LENGTH, prints[rows[again]], np.full(len(again), s + t == 0)))
    return tuple(np.concatenate(x) for x in zip(*out))


def visits(prints: DataFrame, threshold: int) -> DataFrame:
    """The visits of the distinct fingerprints in column _print."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_prints = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(all_prints), 4096):
                anchor, own, home = _visits(all_prints[at: at + 4096], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own), pa.array(home)], names=["anchor", "_print", "home"])

    return prints.select("_print").mapInArrow(run, "anchor long, _print long, home boolean")


def _links(anchor: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between the fingerprints at home at an anchor and its visitors."""
    by = np.argsort(anchor[home], kind="stable")
    at, host = anchor[home][by], prints[home][by]
    lo = np.searchsorted(at, anchor)
    counts = np.searchsorted(at, anchor, side="right") - lo
    busy = counts > 0
    lo, counts, guest = lo[busy], counts[busy], prints[busy]
    ends = np.cumsum(counts)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        hosts = host[golay.ragged(lo[start:stop], counts[start:stop])]
        guests = np.repeat(guest[start:stop], counts[start:stop])
        near = (hosts < guests) & (np.bitwise_count((hosts ^ guests).view(np.uint64)) <= threshold)
        if near.any():
            a, b = forest(np.concatenate([a, hosts[near]]), np.concatenate([b, guests[near]]))
        start = stop
    return a, b


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if held:
            a, b = _links(*(np.concatenate(x) for x in zip(*held)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(prints: DataFrame, threshold: int = 2, cell: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``threshold`` bits, not each pair of them.

    ``prints`` is a written table of distinct fingerprints in column _print.
    """
    cell, task_rows = cell or CELL, task_rows or TASK_ROWS
    homes = prints.mapInArrow(_homes, "anchor long")
    full = written(homes.groupBy("anchor").count().where(F.col("count") > cell), "full-anchors")
    sent = visits(prints, threshold)
    crowded = full.count()
    if not crowded:
        dealt = sent.withColumn("_cell", F.lit(0))
    else:
        few = F.broadcast(full) if crowded <= 100_000 else full
        guests = sent.join(few.select("anchor"), "anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("_guests"))
        grid = written(full.join(guests, "anchor").select(
            "anchor", F.ceil(F.col("count") / cell).cast("int").alias("_rows"), F.ceil(F.col("_guests") / cell).cast("int").alias("_cols")), "anchor-cells")
        sent = sent.join(F.broadcast(grid) if crowded <= 100_000 else grid, "anchor", "left").na.fill(1, ["_rows", "_cols"])
        row, col = F.pmod(F.xxhash64("_print"), F.col("_rows")), F.pmod(F.xxhash64("_print", F.lit(1)), F.col("_cols"))
        across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # a home stands in one row of cells and a visitor in one column; a home is a visitor too
        stays = sent.where("home").withColumn("_col", across("_cols")).withColumn("_cell", row * F.col("_cols") + F.col("_col"))
        comes = sent.withColumn("_row", across("_rows")).withColumn("_cell", F.col("_row") * F.col("_cols") + col).withColumn("home", F.lit(False))
        columns = ["anchor", "_print", "home", "_cell"]
        dealt = stays.select(*columns).union(comes.select(*columns))
    n = parts_for(61 * prints.count(), task_rows)
    return (dealt.repartition(n, "anchor", "_cell").select("anchor", "_print", "home")
            .mapInArrow(_compare(threshold), "a long, b long"))


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        (_, first), (_, second) = golay.anchors(prints & MASK, 0), golay.anchors(prints >> golay.LENGTH & MASK, 0)
        yield pa.RecordBatch.from_arrays([pa.array(first | second << golay.LENGTH)], names=["anchor"])


def rooted(prints: DataFrame, threshold: int) -> DataFrame:
    """``prints``, a written table of distinct fingerprints in column _print, with the root of each one's component."""
    roots = components(links(prints.select("_print"), threshold)).select(F.col("node").alias("_print"), "root")
    return prints.join(roots, "_print", "left").withColumn("root", F.coalesce("root", "_print"))


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id that links reach."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    firsts = written(marked.groupBy("_print").agg(F.min("_id").alias("_first")), "prints")
    grouped = rooted(firsts, threshold)
    smallest = grouped.groupBy("root").agg(F.min("_first").alias("component_id"))
    classes = grouped.join(smallest, "root").select("_print", "component_id")
    return marked.join(classes, "_print").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), "component_id")


@own_names
def keep_one(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null ids last).

    An id may be null or repeated, so rows of one id are told apart by digests
    of the text and of the row; rows alike in all columns are one.
    """
    body, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), ["_body", "_row"]
    told = docs.withColumns({"_body": F.sha2(body, 256), "_row": F.xxhash64(*docs.columns)})
    marked = written(fingerprints(told, id_col, text_col, shingle, own), "fingerprints")
    # of a fingerprint's rows the first, and how many are just like it
    alike = marked.groupBy("_print", "_id", *own).agg(F.count(F.lit(1)).alias("_n"))
    first = F.struct(F.col("_id").isNull().alias("_none"), "_id", *own, "_n")
    firsts = written(alike.groupBy("_print").agg(F.min(first).alias("_first")), "prints")
    chosen = written(rooted(firsts, threshold).groupBy("root").agg(F.min("_first").alias("_first")).select("_first.*"), "components")
    match = F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_body") == F.col("_kept_body")) & (F.col("_row") == F.col("_kept_row"))
    kept = told.join(chosen.select(F.col("_id").alias("_kept"), *[F.col(c).alias("_kept" + c) for c in own]), match, "left_semi")
    if chosen.where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, *own])
    return kept.drop(*own)
