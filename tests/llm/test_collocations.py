import random
import re
from collections import Counter

import pytest

from cohortlens.llm import collocations
from tests.llm.conftest import DOCS


def brute(rows, least, keep):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(4, len(words) - i) + 1):
                    f[lang, tuple(words[i: i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        around = [b for (x, q), b in cand.items() if x == lang and len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 80 * a for b in around):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:keep]))


def got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(n, seed):
    rng, words = random.Random(seed), ["new", "York", "is", "big", "Ünder", "the", "sun", "a\x0bb", "x\u00a0y", "of"]
    out = []
    for i in range(n):
        parts = [rng.choice([" ".join(rng.choices(words, k=rng.randrange(1, 9))), "New York city is", "under the big sun"]) for _ in range(rng.randrange(1, 6))]
        out.append((i, rng.choice([" ", ".\n", ", ", "\t\t", "!?"]).join(parts), rng.choice(["en", "en", "fr", None]), "s", 0))
    return out


@pytest.mark.parametrize("bits,run", [(27, 4_000_000), (13, 200), (4, 4_000_000)])
def test_matches_brute_force(make, bits, run):
    rows = texts(400, 3)  # few bits let rare windows through; the result stays
    assert got(collocations.collocations(make(rows, DOCS), least=12, keep=15, bits=bits, size=run)) == brute(rows, 12, 15)


def test_odd_rows(make, odd_docs):
    rows = [(1, None, None, "s", 0), (2, "", "en", "s", 0), (3, " \t.. ,", "en", "s", 0), (None, "a b " * 40, None, "s", 0), (5, "A b. " * 40, "en", "s", 0),
            (5, "A b. " * 40, "en", "s", 0), (6, "w" * 300_000 + " " + "w" * 300_000, "en", "s", 0), (7, "c d " * 50_000, "fr", "s", 0)]
    assert got(collocations.collocations(make(rows, DOCS))) == brute(rows, 30, 2000)
    clash = [tuple(r)[:5] for r in odd_docs.collect()]
    assert got(collocations.collocations(odd_docs, least=2)) == brute(clash, 2, 2000)
    assert collocations.collocations(make([], DOCS)).count() == 0
    assert collocations.collocations(make([(1, "x", "en", "s", 0)], DOCS)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_only_longest_windows_are_counted(make):
    docs = make([(1, "a b c d e. f", "en", "s", 0)], DOCS).selectExpr("text as _text", "lang as _lang")
    found = sorted((r.w1, r.w2, r.w3, r.w4) for r in collocations.windows(docs, 1).collect())
    assert found == [("a", "b", "c", "d"), ("b", "c", "d", "e"), ("c", "d", "e", ""), ("d", "e", "", ""), ("e", "", "", ""), ("f", "", "", "")]
