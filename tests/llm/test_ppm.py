import math
import zlib

import numpy as np
import pytest

from cohortlens.llm import ppm
from cohortlens.llm.common import table

SF = "/root/testdata/sf0.1"


def brute_bits(text, learnt):
    """Code length of a text under the contexts of ``learnt``, byte by byte with dictionaries."""
    counts = {}
    for t in learnt:
        raw = bytes(ppm.ORDER) + t.encode()
        for i in range(ppm.ORDER, len(raw)):
            for k in range(ppm.ORDER + 1):
                follow = counts.setdefault((k, raw[i - k: i]), {})
                follow[raw[i]] = follow.get(raw[i], 0) + 1
    raw, total = bytes(ppm.ORDER) + text.encode(), 0.0
    for i in range(ppm.ORDER, len(raw)):
        for k in range(ppm.ORDER, -1, -1):
            follow = counts.get((k, raw[i - k: i]))
            if not follow:
                continue
            size = sum(follow.values()) + len(follow)
            if raw[i] in follow:
                total -= math.log2(follow[raw[i]] / size)
                break
            total -= math.log2(len(follow) / size)
        else:
            total += 8
    return total


def test_code_lengths_match_brute_force(monkeypatch):
    learnt = {"aa": ["the cat sat on the mat. the hat", "then that"], "bb": ["le chat é là", "la çà"], "cc": [""]}
    texts = ["the chat", "", "éé zz", "x", "that the là \x00 mat " * 40]
    model = ppm.fit(learnt)
    want = np.array([[brute_bits(t, learnt[x]) for x in model.langs] for t in texts])
    for block in (1 << 19, 7):
        monkeypatch.setattr(ppm, "BLOCK", block)
        assert np.allclose(model.lengths([t.encode() for t in texts]) / ppm.UNIT, want, atol=0.01)


def test_code_is_a_code():
    """The probabilities of the next byte sum to at most 1 in every context."""
    model = ppm.fit({"aa": ["abracadabra banana"], "bb": ["xyz"]})
    for context in (b"abra", b"bana", b"\0\0\0\0", b"qqqq"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert (np.exp2(-model.costs_at(keys) / ppm.UNIT).sum(axis=0) <= 1.001).all()


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in ppm.identify(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(odd_docs, make):
    rows = ppm.identify(odd_docs).collect()
    assert len(rows) == 9 and set(rows[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r.doc_id: r for r in rows}
    for k in (2, 3, 4):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[None].held_out is False and by[7].lang_pred in {"en", "de", "fr"}
    schema = "doc_id long, text string, lang string"
    assert ppm.identify(make([], schema)).count() == 0
    alone = ppm.identify(make([(1, "abc", None), (2, "123 !", "en")], schema)).collect()
    assert {r.lang_pred for r in alone} <= {"und", "en"} and {r.doc_id: r.lang_pred for r in alone}[2] == "und"


@pytest.mark.parametrize("hot", [200])
def test_hot_text_is_learnt_once(make, hot):
    rows = [(i, "the same text again", "en") for i in range(hot)] + [(1000 + i, f"das ist ein satz {i}", "de") for i in range(20)]
    model = ppm.train(make(rows, "doc_id long, text string, lang string"))
    once = ppm.fit({"en": ["the same text again"], "de": []})
    i, j = model.langs.index("en"), once.langs.index("en")
    assert model.lengths([b"the same"])[0, i] == once.lengths([b"the same"])[0, j]
