import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import lengths, packing
from cohortlens.llm.encode import Encoder
from tests.llm.conftest import DOCS

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path(VOCABULARY)


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_library(vocabulary, plain, spark):
    rng = random.Random(1)
    texts = ["", " ", "a  b", "a\n b", "a \nb", "\n\na", "<|endoftext|> a", "b\t", "b\n", " b\t\t", "\x1c\x1d x", "it's  'll", "12 34\n5 ½²", "a\r\nb c", "　x y"]
    texts += ["".join(rng.choice(" \n\tab1'\x1c　é.½") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder = Encoder(vocabulary)
    for _ in range(2):  # anew, and from memory
        assert all(list(a) == plain(t) for a, t in zip(encoder.ids(texts), texts))


def test_cuts():
    assert packing.cuts(1, 8) == [(0, 1)] and packing.cuts(8, 8) == [(0, 8)]
    assert packing.cuts(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cuts(16, 8) == [(0, 8), (8, 8)]


def test_knapsack_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        values, room = rng.random(12), 12
        best = np.zeros(room + 1)
        for u in range(1, room + 1):
            best[u] = max(best[u - 1], *(best[u - k] + values[k - 1] for k in range(1, u + 1)))
        counts = packing.fill(values, np.full(12, 99), room)
        assert counts @ np.arange(1, 13) <= room and counts @ values == pytest.approx(best[room])


def test_program_covers_all_and_bounds():
    need = np.array([0, 0, 0, 40, 60, 0, 90, 0, 0, 30, 0, 0, 20, 0, 0, 5])
    uses, bound = packing.solve(need, 16)
    assert all((sum(u * c[k] for c, u in uses.items()) >= need[k] - 1e-6) for k in range(16))
    total = sum(uses.values())
    assert bound <= total + 1e-6 and total <= 1.35 * bound


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once_and_is_tight(seed):
    rng = random.Random(seed)
    capacity = 512
    hist = Counter(min(capacity, 1 + int(rng.expovariate(1 / 120))) for _ in range(4000))
    hist[capacity] += 500
    runs = packing.arrange(dict(hist), capacity, grid=16, small=64)
    held = Counter()
    for count, items in runs:
        assert sum(n * length for n, length in items) <= capacity
        for n, length in items:
            held[length] += count * n
    assert held == hist
    used, least = sum(c for c, _ in runs), -(-sum(length * n for length, n in hist.items()) // capacity)
    assert used <= 1.01 * least + 1
    assert packing.places([]).shape == (0, 5)


def test_pack_odd_rows(odd_docs, vocabulary, plain):
    got = packing.pack(odd_docs, vocabulary, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert by[2][0].length == by[3][0].length == 1 and len(by[5]) == 2 and len(by[None]) == 1
    for i, rows in by.items():
        want = plain(texts[i]) + [0]
        rows = rows[:1] if i == 5 else sorted(rows, key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in rows) == np.array(want, "<u4").tobytes()
        for r in rows:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(r.ids) // 4 and r.start == sum(x.length for x in rows[: r.piece])
    check_sequences(got)


def check_sequences(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_pack_documents_in_many_tasks(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    rows = packing.pack(docs, vocabulary).collect()
    check_sequences(rows)
    least = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) <= 1.01 * least + 1


def test_length_sums(odd_docs, vocabulary, plain, make, monkeypatch):
    monkeypatch.setattr(lengths, "BLOCK", 3)
    table = lengths.length_sums(odd_docs, vocabulary)
    want = Counter(len(plain(r.text)) for r in odd_docs.collect())
    rows = {r.length: r for r in table.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == want
    for limit, r in rows.items():
        over = {k: n for k, n in want.items() if k > limit}
        assert (r.docs_over, r.tokens_over) == (sum(over.values()), sum(k * n for k, n in over.items()))
        assert r.truncated_total == sum(min(k, limit) * n for k, n in want.items())
        assert r.docs_up_to + r.docs_over == 9 and r.tokens_up_to + r.tokens_over == sum(k * n for k, n in want.items())
    assert {r.limit: r.tokens for r in lengths.truncated(table, [0, 4, 10**9]).collect()} == {
        x: sum(min(k, x) * n for k, n in want.items()) for x in (0, 4, 10**9)}
    ordered = sorted(want.elements())
    assert {r.share: r.length for r in lengths.quantiles(table, [0.0001, 0.5, 1.0]).collect()} == {0.0001: ordered[0], 0.5: ordered[4], 1.0: ordered[-1]}


def test_empty(make, vocabulary):
    assert packing.pack(make([], DOCS), vocabulary).count() == 0
    assert lengths.length_sums(make([], DOCS), vocabulary).count() == 0


@pytest.fixture(scope="module")
def as_loaded(vocabulary):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_in_a_text_are_those_of_the_tokenizer_as_loaded(vocabulary, as_loaded, make):
    end = "<|endoftext|>"
    assert as_loaded(f"x{end}y") == [87, 50256, 88]
    rng = random.Random(4)
    texts = ["", end, f"x{end}y", f"{end} a", f"a {end}", f"a  {end}  b", f"{end}{end}", f"a\n{end}\n\nb", "<|endoftext|", f"<|endof{end}text|>", "<|EndOfText|>", f"é{end}\u3000{end}  "]
    texts += ["".join(rng.choice([end, "<|", "endoftext", "|>", " ", "\n", "\t", "a", "b1", "'", "é"]) for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    encoder = Encoder.shared(vocabulary)
    for _ in range(2):  # anew, and from memory
        assert all(list(a) == as_loaded(t) for a, t in zip(encoder.ids(texts), texts, strict=True))
    docs = make([(i, t, "en", "s", 0) for i, t in enumerate(texts[:40])], DOCS)
    got = {r.doc_id: r for r in packing.pack(docs, vocabulary, with_ids=True).collect()}
    assert all(bytes(got[i].ids) == np.array(as_loaded(t) + [0], "<u4").tobytes() for i, t in enumerate(texts[:40]))
    hist = lengths.length_sums(docs, vocabulary).collect()
    assert {r.length: r.n_docs for r in hist} == Counter(len(as_loaded(t)) for t in texts[:40])


def test_remembered_chunks_are_dropped_but_not_added_tokens(vocabulary, as_loaded, monkeypatch):
    monkeypatch.setattr("cohortlens.llm.encode.REMEMBERED", 2)
    encoder = Encoder(vocabulary, encode_special_tokens=False)
    for text in ("a b c d <|endoftext|>", "e f<|endoftext|>g h", "i<|endoftext|>"):
        assert list(encoder.ids([text])[0]) == as_loaded(text)


@pytest.mark.parametrize("n", [1, 2, 9_998, 9_999, 10_000, 10_001, 60_000, 2_000_000])
def test_white_space_runs_of_any_length(vocabulary, as_loaded, n):
    """Blanks, tabs, line ends and mixes, alone, at both ends and inside, as the tokenizers library encodes them."""
    encoder = Encoder(vocabulary, encode_special_tokens=False)
    runs = [" " * n, "\n" * n] if n > 100_000 else [" " * n, "\t" * n, "\n" * n, ("\n  \t\u00a0" * n)[:n]]
    texts = [t for r in runs for t in ([r, f"a{r}b", f"{r}b c"] if n > 100_000 else [r, f"a{r}b", f"a{r}", f"{r}b c", f"x<|endoftext|>{r}<|endoftext|>{r}!", f"!{r}\x1c{r}1"])]
    for t, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == as_loaded(t)


def test_control_characters_are_no_white_space(vocabulary, as_loaded):
    encoder, texts = Encoder(vocabulary, encode_special_tokens=False), ["!\x1c \n!\x1c", "a\x1c  b\x1d\x1e!", "!\x1f", "\x1cfoo", "\x85 \x85x"]
    for t, ids in zip(texts + texts, encoder.ids(texts) + encoder.ids(texts), strict=True):
        assert ids.tolist() == as_loaded(t)


def test_pack_a_document_of_white_space(make, vocabulary):
    rows = [(1, " " * 1_000_000, "en", "s", 0), (2, "word" + "\t" * 1_000_000 + "word", "en", "s", 0), (3, "few words", "en", "s", 0)]
    got = packing.pack(make(rows, DOCS), vocabulary).collect()
    check_sequences(got)
    assert {r.doc_id for r in got} == {1, 2, 3}
