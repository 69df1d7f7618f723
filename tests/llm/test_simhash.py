import random
import re

import numpy as np
import xxhash

from cohortlens.llm import golay, graph, simhash
from tests.llm.conftest import DOCS


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    if not words:
        return 0
    grams = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, threshold=2):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in root]


def near_texts(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
            out.append(" ".join(words))
        else:
            out.append(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 20, 300]))))
    return out


def test_golay_covers_and_rings_are_whole():
    words = np.random.default_rng(0).integers(0, 1 << 23, 300)
    rows, home = golay.anchors(words, 0)
    assert np.array_equal(rows, np.arange(300)) and not golay.syndromes(home).any()
    code = np.unique(golay.anchors(np.arange(1 << 23), 0)[1])
    assert len(code) == 4096
    for ring in (1, 2):
        rows, found = golay.anchors(words, ring)
        for i in (0, 7, 299):
            exact = code[np.bitwise_count(code ^ words[i]) == 3 + ring]
            assert sorted(found[rows == i]) == sorted(exact)


def test_fingerprint_matches_brute_force():
    for text in [None, "", " \t\n", "One", "Two WORDS", "a b c", "É À b c d", "x " * 1000, *near_texts(20, 1)]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_print(text)
    many = " ".join(str(i) for i in range(simhash.SHINGLES + 500))
    assert simhash.fingerprint(many) & (1 << 64) - 1 == brute_print(many)


def test_components_match_brute_force(make, monkeypatch):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(near_texts(300, 5))]
    prints = [brute_print(r[1]) for r in rows]
    want = {i: (format(p, "016x"), c) for i, p, c in zip(range(300), prints, brute_components(list(range(300)), prints))}
    docs = make(rows, DOCS)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want
    monkeypatch.setattr(simhash, "CELL", 2)  # crowded anchors are cut into cells
    monkeypatch.setattr(simhash, "TASK_ROWS", 2000)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_links_of_crowded_anchors(make, monkeypatch):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 60, 3) for b in range(1, 60, 7)})
    table = make([(p,) for p in prints], "_print long")
    monkeypatch.setattr(simhash, "CELL", 5)
    roots = {r.node: r.root for r in graph.components(simhash.links(table, 2)).collect()}
    comp = brute_components(prints, prints)
    assert [roots.get(p, p) for p in prints] == comp


def test_stars_find_long_chains(make):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    random.Random(3).shuffle(links)
    got = {r.node: r.root for r in graph.components(make(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_odd_rows_and_keep_one(odd_docs, make):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16 and by[4].component_id == 2
    assert by[5].component_id == 1 and by[None].component_id is None
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 7, 8]
    twice = make([(1, "a b c d", "en", "s", 0), (1, "a b c d", "en", "s", 0), (2, "a b c d", "en", "s", 0)], DOCS)
    assert [r.doc_id for r in simhash.keep_one(twice).collect()] == [1]
    assert simhash.keep_one(make([], DOCS)).count() == 0


def test_keep_one_goes_by_components_not_by_ids(make):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a, "en", "s", 0), (None, b, "en", "s", 0), (None, b, "de", "t", 1), (None, c, "en", "s", 0), (None, c, "en", "s", 0),
            (7, d, "en", "s", 0), (None, d, "en", "s", 0), (8, a, "en", "s", 0), (3, "x y z", "en", "s", 0), (3, "u v w", "en", "s", 0), (9, "u v w", "en", "s", 0),
            (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    kept = simhash.keep_one(make(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(8, a), (None, b), (None, c), (7, d), (3, "x y z"), (3, "u v w"), (None, "")], key=str)
