"""Encoding, packing and splitting against plain code on small texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm.packing import pack, plan
from weftline.llm.splitting import likeness, split_texts
from weftline.llm.tokens import decode, encode_corpus, encoder, vocabulary

TEXTS = [
    None, "", " ", "word", "<|endoftext|>", "it's  they'll\r\n\r\n  x", "a" * 900, " " * 700, "日本語のテキスト。" * 40, "👩‍👩‍👧 é" * 60,
    "The step failed.\n\n" * 60, "x1y2 " * 300, "--\t==" * 200, "no​break\x00\x07 " * 50,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, "word", 7), (None, "word", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int")


@pytest.mark.parametrize("chunk, overlap", [(32_768, 2_048), (50, 20), (16, 5)])
def test_every_text_is_encoded_whole(docs, chunk, overlap):
    encode = encoder(vocabulary())[0]
    rows = encode_corpus(docs, chunk=chunk, overlap=overlap).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "word" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == encode(text)
        assert decode(r.ids, vocabulary()) == text.encode()
    for r in encode_corpus(docs.repartition(5), chunk=chunk, overlap=overlap, with_text=True).collect():
        assert r.ids == encode(r.text or "") and (r.doc_id is None or r.text == TEXTS[r.doc_id])
    counts = {r.doc_id: r.ids for r in encode_corpus(docs, counted=True, chunk=chunk, overlap=overlap).collect()}
    assert all(counts[i] == len(encode(t or "")) for i, t in enumerate(TEXTS))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert encode_corpus(none).collect() == []
    assert pack(encode_corpus(none, counted=True), "doc_id", "ids", 10).collect() == []
    assert split_texts(none, [(8, 2)]).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_within_capacity(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    histogram = {s: rng.randint(0, 40) for s in range(1, capacity + 1)}
    rows, bins = plan(capacity, histogram)
    fill, seen = [0] * bins, dict.fromkeys(histogram, 0)
    for size, first, items, bin0, a_bin in rows:
        assert first == seen[size]
        seen[size] += items
        for i in range(items):
            fill[bin0 + i // a_bin] += size
    assert seen == histogram
    assert max(fill) <= capacity
    lower = max(-(-sum(fill) // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))
    assert bins <= 1.25 * lower + 1


def test_pack_keeps_every_item(spark):
    rows = [("a", 25), ("b", 10), ("c", 0), ("d", None), ("e", 4), ("e", 4), ("f", 6), (None, 3)] + [("hot", 5)] * 40
    out = pack(spark.createDataFrame(rows, "item string, size int"), "item", "size", 10).collect()
    fill = {}
    for r in out:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.tokens
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 10
    assert sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert sorted(r.first for r in out if r.item == "a") == [0, 10, 20]
    assert {r.item for r in out} == {i for i, _ in rows}
    assert len(fill) <= 27


@pytest.mark.parametrize("limit, overlap", [(24, 5), (10, 0), (3, 1)])
def test_pieces_cover_the_text(docs, limit, overlap):
    encode, words = encoder(vocabulary())
    rows = split_texts(docs.where("doc_id is not null"), [(limit, overlap)]).orderBy("doc_id", "piece").collect()
    assert {r.doc_id for r in rows} == {i for i, t in enumerate(TEXTS) if len(encode(t or "")) > limit}
    for i, text in enumerate(TEXTS):
        own = [r for r in rows if r.doc_id == i]
        if not own:
            continue
        ids = encode(text)
        assert own[0].first_token == 0 and own[-1].end_token == len(ids) and own[-1]["cut"] == "end"
        assert all(r.tokens == r.end_token - r.first_token <= limit for r in own)
        assert all(b.first_token == a.end_token - overlap for a, b in zip(own, own[1:]))
        assert all(r.tokens >= 2 * overlap for r in own[:-1])
        whole = b"".join(words[x] for r in own for x in ids[r.first_token + (overlap if r.piece else 0) : r.end_token])
        assert whole == text.encode()
        assert all(r.text == b"".join(words[x] for x in ids[r.first_token : r.end_token]).decode(errors="ignore") for r in own)


def test_cuts_lie_at_the_change_of_subject(spark):
    a, b = "The cat sat near the warm cat bed.\n" * 12, "Stock prices fell on market fears today.\n" * 12
    rows = split_texts(spark.createDataFrame([(1, a + b)], "doc_id int, text string"), [(150, 0)]).orderBy("piece").collect()
    assert rows[0].text.strip() == a.strip()


@pytest.mark.parametrize("span", [1, 3, 8])
def test_likeness(span):
    rng = np.random.default_rng(span)
    terms = rng.integers(-1, 5, 60)
    found = likeness(terms, span)
    assert len(found) == 61 and len(likeness(terms[:0], span)) == 1
    for p in range(61):
        a, b = (Counter(x for x in part.tolist() if x >= 0) for part in (terms[max(0, p - span) : p], terms[p : p + span]))
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        assert found[p] == pytest.approx(sum(a[x] * b[x] for x in a) / norm if norm else 0.0)
    assert likeness(np.zeros(3000, np.int64), 64)[1500] == pytest.approx(1)


def test_cohesion_without_line_ends(spark):
    """The cut lies where the subject changes, also in texts of one line, in the first half of a window, and for a text among others."""
    a, b = "The cat sat near the warm cat bed with another cat. ", "Stock prices fell because markets fear rising bond prices. "
    for n in (3, 6, 9, 12):
        text = a * n + b * 30
        rows = split_texts(spark.createDataFrame([(1, text), (2, b * 40)], "doc_id int, text string"), [(170, 0)]).where("doc_id = 1").orderBy("piece").collect()
        assert rows[0].text.strip() == (a * n).strip() and rows[0]["cut"] == "sentence"
    words = "cat bed warm cat purr " * 20 + "stock bond price fell stock " * 40
    first = split_texts(spark.createDataFrame([(1, words)], "doc_id int, text string"), [(150, 0)]).orderBy("piece").first()
    assert first.text.strip() == ("cat bed warm cat purr " * 20).strip() and first["cut"] == "word"
