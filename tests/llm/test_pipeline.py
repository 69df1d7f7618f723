import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm import packing, toxicity
from cohortlens.llm.common import table, written
from tests.llm.test_packing import check_sequences
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs, model_seen = table(spark, SF, "documents"), None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        if name == "toxicity":
            model_seen = toxicity.train(docs, table(spark, SF, "labels"))
        docs = written(stage(spark, docs, SF), "test-stage")
        after = docs.toPandas()
        if name == "packing":
            check_sequences(list(after.itertuples()))
            ids = {d: n for d, n in after.groupby("doc_id")["length"].sum().items()}
            assert set(ids) == set(before.doc_id) and after.length.max() <= packing.CAPACITY
            continue
        assert list(after.columns) == list(before.columns)
        if name == "toxicity":
            scores = np.array([model_seen.score(t) for t in before.text])
            cuts = np.array([model_seen.thresholds.get(x, 0.3) for x in before.lang])
            assert set(after.doc_id) == set(before.doc_id[scores < cuts])
        elif name.startswith("simhash"):
            least = brute_components(list(before.doc_id), [brute_print(t) for t in before.text])
            assert sorted(after.doc_id) == sorted(set(least))
        elif name.startswith("secret"):
            assert sorted(after.doc_id) == sorted(before.doc_id)
            was, now = dict(zip(before.doc_id, before.text)), dict(zip(after.doc_id, after.text))
            for d, text in was.items():
                if secret_spans(text):
                    assert "[SECRET]" in now[d] and not secret_spans(now[d])
                else:
                    assert now[d] == text
        elif name == "mixing":
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
            assert after.text.isin(before.text).all()


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    named = {q.split("_")[0] for q in entry.queries()}
    assert {f"op{n}" for n in range(1, 11)} <= named
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_rows_and_clashing_columns_go_through_all_stages(spark, odd_docs, make):
    names = ["_score", "score", "_body", "_row", "_length", "_own", "_size", "spans", "_at", "_copies", "row", "size"]
    extra = ", ".join(f"{n} string" for n in names)
    rows = [(*tuple(r)[:5], *[f"{n}-{i}" for n in names]) for i, r in enumerate(odd_docs.collect())] + [
        (20, "password = hunter2hunter2 here", "en", "b", 30, *[f"{n}-20" for n in names])]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    for start in (make(rows, schema), make([], schema)):
        docs = written(start, "test-odd")
        want = {tuple(r[5:]) for r in rows}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = written(stage(spark, docs, SF), "test-odd")
            assert docs.columns == start.columns, name
            got = [tuple(r)[5:] for r in docs.collect()]
            assert set(got) <= want and (before == 0) == (len(got) == 0), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        check_sequences(pieces)
        if before:
            assert "[SECRET]" in {r.doc_id: r.text for r in docs.collect()}.get(20, "[SECRET]")
