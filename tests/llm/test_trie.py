import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortlens.llm import trie
from cohortlens.llm.common import table

TURNS = "conv_id long, turn long, role string, text string, _record string, n long"


def brute(convs):
    """Nodes of {id: [(role, text), ...]} as a sorted list of rows."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, own in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                   r.ends_sha256) for r in df.collect())


def listed(rows):
    out = defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            out[c].append(((turn is not None, turn or 0), digest(r, t), (r, t)))
    return {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]  # the remainder has the sign of c, as in SQL
    return out


def made(n, seed, hot=0.3):
    """Conversations with common starts; a share of them all alike."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(1, 5000), n):
        turns = ["hi", "yes", "go"] if rng.random() < hot else [rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 9))]
        rows += [(c, t, "user" if t % 2 == 0 else "bot", x, "x", 1) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few,per", [(10**9, 50_000), (20, 50_000), (5, 9), (1, 40)])
def test_trie_matches_brute_force(make, monkeypatch, few, per):
    monkeypatch.setattr(trie, "FEW", few)
    monkeypatch.setattr(trie, "ROWS", per)  # with 9 rows a partition the paths take several rounds
    monkeypatch.setattr(trie, "IDS", 3)
    rows = made(150, 4)
    assert got(trie.conversation_trie(make(rows, TURNS))) == brute(listed(rows))


def test_rebuilt_conversations_match_brute_force(make, monkeypatch):
    monkeypatch.setattr(trie, "FEW", 10)
    rows = made(120, 9) + [(200, 0, "user", "base", "x", 1), (200, 1, "bot", "next", "x", 1), (250, 0, "user", "only", "x", 1)]
    want = brute(rebuild(listed(rows)))
    assert got(trie.trie(trie.rebuilt(trie.sequences(make(rows, TURNS))))) == want


def test_given_table_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "FEW", 10)
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    own = listed([tuple(r) for r in turns.collect()])
    assert got(trie.trie(trie.rebuilt(trie.sequences(turns)))) == brute(rebuild(own))


def test_odd_rows(make):
    rows = [(1, None, None, None, "x", 1), (1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1), (2, 0, "user", "b", "x", 1), (2, 0, "bot", "b", "x", 1),
            (None, 0, "user", "lost", "x", 1), (3, 5, "", "", "x", 1), (4, 0, "user", "é" * 100_000, "x", 1), (-7, 0, "user", "é" * 100_000, "x", 1)]
    assert got(trie.conversation_trie(make(rows, TURNS))) == brute(listed(rows))
    assert got(trie.trie(trie.rebuilt(trie.sequences(make(rows, TURNS))))) == brute(rebuild(listed(rows)))
    assert trie.conversation_trie(make([], TURNS)).count() == 0


def test_very_long_conversation(make, monkeypatch):
    monkeypatch.setattr(trie, "FEW", 1)
    rows = [(c, t, "user", f"t{t}" if t < 90 + c else "end", "x", 1) for c in range(4) for t in range(120)]
    assert got(trie.conversation_trie(make(rows, TURNS))) == brute(listed(rows))


def test_union_find_on_equal_sequences():
    alive, at, lo, hi, kids = trie.compressed(np.array([2, 2, 0, 1]), np.array([2, 2, 3, 1, 2]))
    nodes = sorted((at[v], lo[v], hi[v], len(kids[v])) for v in range(len(at)) if alive[v])
    assert nodes == [(0, 0, 4, 2), (1, 3, 4, 1), (2, 0, 2, 1), (2, 4, 4, 0), (3, 2, 2, 0)]
