import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing
from tests.llm.conftest import DOCS


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """sizes: list of (source or None, words) by document; targets by source, sharing out again until none is above its cap."""
    total = {}
    for s, n in sizes:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, budget * sum(total.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap * total[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = cap * total[s]
            left -= target[s]
        open_ -= full
    return target, total


def test_targets_and_copies(make):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", [None, "a", "b", "c", "big"][min(4, i % 9)], 0) for i in range(2000)]
    got = mixing.mix(make(rows, DOCS)).collect()
    sizes = [(r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))) for r in rows]
    target, total = brute_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * 41


def test_runs_do_not_matter(make, monkeypatch):
    docs = make([(i, "w " * (i % 13), "en", "s" if i % 3 else "t", 0) for i in range(500)], DOCS)
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr("cohortlens.llm.common.ROWS_PER_RANGE", 20)
    from cohortlens.llm import common
    monkeypatch.setattr(common.positions, "__defaults__", (*common.positions.__defaults__[:-1], 20))
    assert one == sorted(map(tuple, mixing.mix(docs).collect()))


def test_odd_rows(odd_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == 9 and sorted(odd_docs.columns) != sorted(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert by[2]["size"] == by[3]["size"] == by[4]["size"] == 0 and by[3].target == 0 == by[3].copies
    assert by[7]["size"] == 30_000
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    planned = {(r.doc_id, r["size"]): 0 for r in got}
    for r in got:
        planned[(r.doc_id, r["size"])] += r.copies
    counted = {(r.doc_id, r.n): r.c for r in mixed.groupBy("doc_id", F.coalesce(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).alias("n")).agg(F.count("*").alias("c")).collect()}
    counted = {(k[0], max(0, k[1])): v for k, v in counted.items()}
    assert counted == {k: v for k, v in planned.items() if v}


def test_empty(make):
    assert mixing.mix(make([], DOCS)).count() == 0 and mixing.mixed(make([], DOCS)).count() == 0
