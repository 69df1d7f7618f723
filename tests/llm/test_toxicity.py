import zlib

import numpy as np
import pytest

from cohortlens.llm import toxicity
from tests.llm.conftest import DOCS

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    out, marks = [], []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            stem = ["grobian", "malvado", "villain"][i % 3]
            for _ in range(3):
                words.insert(rng.integers(len(words)), stem + "".join(rng.choice(list("aeiou"), rng.integers(0, 3))))
        out.append((i, " ".join(words), ["de", "es", "en"][i % 3], f"s{i % 4}", 0))
        marks.append((i, 1, int(bad)))
    return out, marks


@pytest.fixture(scope="module")
def scored(make):
    rows, marks = corpus(900)
    got = toxicity.classify(make(rows, DOCS), make(marks, LABELS)).collect()
    return {r.doc_id: r for r in got}, dict((m[0], m[2]) for m in marks)


def test_held_out_accuracy(scored):
    got, truth = scored
    assert len(got) == 900
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.toxic == int(r.score >= r.lang_threshold)
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 150
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    assert np.mean([got[i].toxic == truth[i] for i in held]) > 0.93


def test_held_out_labels_and_fields_are_no_inputs(make):
    rows, marks = corpus(200)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    flipped = [(i, q, 1 - t if i in held else t) for i, q, t in marks]
    # another language and source; the ids stay, since they choose the rows that are learnt from
    other = [(i, t, "xx", "other", 5) for i, t, *_ in rows]
    a = {r.doc_id: r.score for r in toxicity.classify(make(rows, DOCS), make(marks, LABELS)).collect()}
    b = {r.doc_id: r.score for r in toxicity.classify(make(other, DOCS), make(flipped, LABELS)).collect()}
    assert a == b


def test_maxima_of_long_texts_are_those_of_the_whole(monkeypatch):
    model = toxicity._blank(1)
    buckets = toxicity.word_buckets(" ".join(f"word{i}" for i in range(1000)))
    whole = model.maxima(buckets)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert np.allclose(whole, model.maxima(buckets), atol=1e-6)
    best, at, _ = model.maxima(buckets, where=True)
    assert np.allclose(best, whole, atol=1e-6) and (at < 1000).all()


def test_slopes_match_differences():
    texts, labels = ["good day sir", "vile rogue you are"], np.array([0, 1])
    before = toxicity.fit(texts, labels, epochs=1, steps=1, rate=0.0)
    after = toxicity.fit(texts, labels, epochs=30, steps=60)
    loss = lambda m: -sum(np.log(m.score(t) if y else 1 - m.score(t)) for t, y in zip(texts, labels))
    assert loss(after) < 0.2 * loss(before)


def test_calibration():
    scores = np.array([0.9, 0.8, 0.6, 0.5, 0.1] * 10)
    labels = np.array([1, 1, 1, 0, 0] * 10)
    got = toxicity.calibrate(scores, labels, ["en"] * 25 + ["de"] * 25, 0.3, least=5)
    assert got == {"de": pytest.approx(0.55), "en": pytest.approx(0.55)}
    assert toxicity.calibrate(scores, labels, ["en"] * 50, 0.55, least=5) == {"en": 0.55}
    assert toxicity.calibrate(scores, labels, [None] * 50, 0.3) == {} == toxicity.calibrate(scores, labels, ["en"] * 50, 0.3, least=40)


def test_odd_rows(make, odd_docs):
    marks = [(1, 1, 1), (2, None, None), (3, 0, 0), (5, 0, 1), (5, 0, 0), (7, 0, 0), (8, 0, 1), (None, 0, 1), (99, 0, 1)]
    got = toxicity.classify(odd_docs, make(marks, LABELS)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1  # texts without words
    none = toxicity.classify(odd_docs, make([], LABELS)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.classify(make([], DOCS), make(marks, LABELS)).count() == 0


def test_weights_stand_for_repeated_rows():
    scores, labels = np.array([0.9, 0.7, 0.6, 0.4, 0.2]), np.array([1, 0, 1, 1, 0])
    times = np.array([1, 6, 1, 1, 9])
    want = toxicity.calibrate(np.repeat(scores, times), np.repeat(labels, times), ["en"] * times.sum(), 0.3, least=1)
    assert toxicity.calibrate(scores, labels, ["en"] * 5, 0.3, least=1, weights=times) == want
    assert toxicity.calibrate(scores, labels, ["en"] * 5, 0.3, least=1) != want


def test_scores_and_thresholds_stay_when_the_clean_class_outgrows_the_sample(make):
    # one text of six that hold the word is toxic, at every size of the sample
    texts = [("a villain here", 1)] * 300 + [("a villain here", 0)] * 1500 + [("nothing but words", 0)] * 1800
    docs = make([(i, t, "en", "s", 0) for i, (t, _) in enumerate(texts)], DOCS)
    marks = make([(i, 1, y) for i, (_, y) in enumerate(texts)], LABELS)
    whole, capped = (toxicity.train(docs, marks, sample=n) for n in (4000, 300))
    for text in ("a villain here", "nothing but words"):
        assert capped.score(text) < 0.3 and abs(whole.score(text) - capped.score(text)) < 0.1
    assert abs(whole.thresholds["en"] - capped.thresholds["en"]) < 0.05


def test_long_clean_texts_are_learnt_from_as_a_whole(monkeypatch):
    long, seen = " ".join(f"w{i}" for i in range(6000)), []
    maxima = toxicity.Model.maxima
    monkeypatch.setattr(toxicity.Model, "maxima", lambda self, buckets, where=False: (seen.append(len(buckets)), maxima(self, buckets, where))[1])
    toxicity.fit([long, "a vile rogue"], np.array([0, 1]), epochs=2, steps=1, batch=2)
    assert seen.count(6000) == seen.count(3) > 0


def test_a_repeated_id_is_collected_once(make):
    rows = [(i, f"clean words number {i}", "en", "s", 0) for i in range(200)] + [(7, "the very same text", "en", "s", 0)] * 500
    rows += [(9, f"another text {i} " * 50, "en", "s", 0) for i in range(300)]
    docs, labels = make(rows, DOCS), make([(i, 1, int(i % 9 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", "lang", 4000)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(got) == len(set(learnt)) and got["weight"].sum() == len(learnt)
    small = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", "lang", 4000, chars=60_000)
    assert small["text"].str.len().sum() < 150_000


def test_texts_over_400_000_characters_are_learnt_from(make):
    rows = [(i, "x" * 400_001 + " grobian", "en", "s", 0) if i % 20 == 0 else (i, f"good day number {i}", "en", "s", 0) for i in range(80)]
    model = toxicity.train(make(rows, DOCS), make([(i, 1, int(i % 20 == 0)) for i in range(80)], LABELS))
    assert model.score(rows[0][1]) > 0.5 > model.score(rows[1][1])


def test_thresholds_come_from_all_labelled_rows(make):
    rows, marks = corpus(900)
    learnt = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 != 2]
    swedish = {y: [i for i in learnt if marks[i][2] == y][:25] for y in (0, 1)}  # a fifth of them is too few for a threshold
    rows = [(i, t, "sv" if i in swedish[0] + swedish[1] else None, s, n) for i, t, _, s, n in rows]
    assert list(toxicity.train(make(rows, DOCS), make(marks, LABELS)).thresholds) == ["sv"]


def test_averaged_passes_over_parts_learn_as_well(make, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 120)
    rows, marks = corpus(900)
    docs, labels = make(rows, DOCS), make(marks, LABELS)
    model, again = toxicity.train(docs, labels), toxicity.train(docs, labels)
    assert np.array_equal(model.embedding, again.embedding) and model.thresholds == again.thresholds
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(model.score(rows[i][1]) >= 0.3) == marks[i][2] for i in held]) > 0.93


def test_parts_hold_every_labelled_row_once(make):
    rows, marks = corpus(300)
    docs, labels = make(rows + rows[:50] + [(301, None, None, None, 0)], DOCS), make([*marks, (301, 1, 0), (None, 1, 1)], LABELS)
    parts = toxicity.pack(toxicity.distinct_rows(toxicity.labelled(docs, labels, "toxic", "doc_id", "text", "lang")), 4).collect()
    learnt = [i for i in [*range(300), 301] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert {r.part for r in parts} == {0, 1, 2, 3} and len(parts) == len(learnt)
    assert sum(r.weight for r in parts) == len(learnt) + sum(i < 50 for i in learnt)
    words = sorted(toxicity._words(r).tolist() for r in parts)
    assert words == sorted(toxicity.word_buckets(rows[i][1] if i < 300 else None).tolist() for i in learnt)


def test_thresholds_by_runs_are_those_of_one_sort(make, monkeypatch):
    rng = np.random.default_rng(0)
    scores, labels, times = rng.integers(0, 50, 600) / 50, rng.integers(0, 2, 600), rng.integers(1, 5, 600)
    langs = rng.choice(["en", "de", "fr", None, "sv"], 600, p=[0.4, 0.3, 0.17, 0.1, 0.03]).tolist()
    monkeypatch.setattr(toxicity, "parts_for", lambda rows: 5)
    scored = make(list(zip(langs, labels.tolist(), times.astype(float).tolist(), scores.tolist(), strict=True)), "lang string, y int, weight double, score double")
    want = toxicity.calibrate(scores, labels, langs, 0.3, weights=times)
    assert toxicity.best_thresholds(scored, 0.3) == pytest.approx(want) and set(want) == {"en", "de", "fr"}
