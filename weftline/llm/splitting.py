"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.tokens import encode_corpus, encoder, vocabulary
from weftline.session import spread
from weftline.sources.tables import table

#: Kinds of places between two tokens, from least to most natural.
KINDS = ("inside", "character", "word", "sentence", "line", "paragraph")
#: Tokens compared on either side of a place.
SPAN = 64

#: What a byte tells about the place next to it.
_INSIDE, _BLANK, _STOP, _WIDE, _FEED = 1, 2, 4, 8, 16
_TRAITS = np.zeros(256, np.uint8)
_TRAITS[0x80:0xC0] |= _INSIDE
_TRAITS[[9, 10, 13, 32]] |= _BLANK
_TRAITS[[10, 13]] |= _FEED
_TRAITS[[33, 46, 63]] |= _STOP
_TRAITS[[0x81, 0x82, 0x9F]] |= _WIDE
_EDGE = b"   "
#: Bytes of texts whose places are classified at a time.
TOGETHER = 1_000_000


@lru_cache(4)
def _words(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every id: its number of bytes, and whether it holds a letter or digit."""
    words = encoder(path)[1]
    lengths = np.array([len(w) for w in words], np.int64)
    return lengths, np.array([any(c > 127 or chr(c).isalnum() for c in w) for w in words])


def kinds(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind of the place behind each token; data: bytes with three blanks before and behind them, ends: the tokens' ends, without those blanks."""
    b1, n1 = data[ends + 2], data[ends + 3]
    before, after = _TRAITS[b1], _TRAITS[n1]
    out = np.ones(len(ends), np.int8)
    out[after & _INSIDE > 0] = 0
    out[(before | after) & _BLANK > 0] = 2
    out[(before & _STOP > 0) & (after & _BLANK > 0)] = 3
    wide = np.flatnonzero((before & _WIDE > 0) & (out == 1))
    if len(wide):
        at = ends[wide]
        b3, b2, b = data[at], data[at + 1], b1[wide]
        out[wide[((b3 == 0xE3) & (b2 == 0x80) & (b == 0x82)) | ((b3 == 0xEF) & (b2 == 0xBC) & (b != 0x82))]] = 3
    line = np.flatnonzero((before | after) & _FEED > 0)
    at = ends[line]
    b2, b, n, n2 = data[at + 1], b1[line], n1[line], data[at + 4]
    out[line[(n == 10) | (before[line] & _FEED > 0) | ((n == 13) & (n2 == 10))]] = 4
    fed = (b2 == 10) | (b2 == 13)
    out[line[((n == 10) & (n2 == 10)) | ((b == 10) & fed & (n != 10) & (n != 13)) | ((b == 10) & (n == 10))]] = 5
    return out


def _climb(like: np.ndarray) -> np.ndarray:
    """The value reached from each place by going left as long as the values do not fall."""
    stops = np.empty(len(like), bool)  # no step to the left of here
    stops[0] = True
    np.less(like[:-1], like[1:], out=stops[1:])
    return like[np.maximum.accumulate(np.where(stops, np.arange(len(like)), 0))]


def likeness(terms: np.ndarray, span: int = SPAN) -> np.ndarray:
    """At each place p (before token p; the last one is the end): the cosine of the term counts of up to `span` tokens before and after it.

    terms: a number per token; tokens of different texts need different numbers, and negative ones do
    not count. What two blocks have in common are pairs of equal tokens, so every pair of equal tokens
    less than 2 * span apart adds to the stretch of places whose blocks hold both: no vectors are built,
    and all terms count as themselves.
    """
    n = len(terms)
    sums = {k: np.zeros(n + 2, np.int64) for k in ("left", "right", "both", "left pairs", "right pairs")}
    waiting: list[tuple[str, np.ndarray, np.ndarray]] = []

    def cover(of: str, first: np.ndarray, last: np.ndarray) -> None:
        waiting.append((of, first, last + 1))
        if sum(len(f) for _, f, _ in waiting) > 4 * n + 100_000:
            settle()

    def settle() -> None:
        for of, total in sums.items():
            for k, sign in ((1, 1), (2, -1)):
                if some := [w[k] for w in waiting if w[0] == of]:
                    total += sign * np.bincount(np.concatenate(some), minlength=n + 2)
        waiting.clear()

    at = np.flatnonzero(terms >= 0)
    cover("left", at + 1, np.minimum(at + span, n))
    cover("right", np.maximum(at - span + 1, 0), at)
    order = at[np.argsort(terms[at], kind="stable")]
    own = terms[order]
    later = np.arange(1, len(order))
    step = 1
    while len(later):
        i, j = order[later - step], order[later]
        near = (own[later - step] == own[later]) & (j - i < 2 * span)
        later, i, j = later[near], i[near], j[near]
        cover("both", np.maximum(i + 1, j - span + 1), np.minimum(j, i + span))
        together = j - i < span
        i, j = i[together], j[together]
        cover("left pairs", j + 1, np.minimum(i + span, n))
        cover("right pairs", np.maximum(j - span + 1, 0), i)
        step += 1
        later = later[later >= step]
    settle()
    left, right, both = (np.cumsum(x)[: n + 1] for x in (sums["left"] + 2 * sums["left pairs"], sums["right"] + 2 * sums["right pairs"], sums["both"]))
    norm = np.sqrt(left.astype(np.float64) * right)
    return np.divide(both, norm, out=np.zeros(n + 1), where=norm > 0)


def valleys(places: np.ndarray, like: np.ndarray) -> np.ndarray:
    """How far the likeness at each place lies below the nearest peaks among the places on both sides."""
    if not len(places):
        return np.zeros(0)
    own = like[places]
    return _climb(own) + _climb(own[::-1])[::-1] - 2 * own


def cuts(kind: np.ndarray, like: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first token, end token, kind of the end) of the pieces of a text; like: the likeness at every place.

    A piece holds at most `limit` tokens, of which at least as many are new as it repeats. It ends at
    the deepest valley among the ends of lines and sentences in this whole window, of equally deep
    ones at the more natural, then the later; without any at the deepest valley among its word ends,
    and without one between characters. Where possible the next piece, which repeats the last
    `overlap` tokens, does not begin inside a character.
    """
    n, start, out = len(kind), 0, []
    at = np.arange(1, n)
    ranks = kind[:-1] if n else kind  # of the place behind token p, that is before token p + 1
    starts_whole = np.ones(n, bool)
    if overlap:
        starts_whole[overlap + 1 :] = kind[: n - overlap - 1] > 0
    levels = []

    def level(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order and their depths: ends of sentences and lines, or of words."""
        while len(levels) <= i:
            places = at[ranks >= 3] if not levels else at[ranks >= 2]
            levels.append((places, valleys(places, like) + 1e-9 * kind[places - 1]))
        return levels[i]

    while n - start > limit:
        low, high, end = start + overlap + max(overlap, 1), start + limit, 0
        for i in (0, 1):
            places, depth = level(i)
            a, b = np.searchsorted(places, (low, high + 1))
            fits = starts_whole[places[a:b]]
            if fits.any():
                deep = np.where(fits, depth[a:b], -1.0)
                end = int(places[b - 1 - int(deep[::-1].argmax())])
                break
        if not end:
            spots = np.arange(low, high + 1)
            rank = np.where(kind[spots - 1] > 0, 1 + starts_whole[spots], 0)
            end = int(spots[len(rank) - 1 - int(np.argmax(rank[::-1]))])
        out.append((start, end, KINDS[int(kind[end - 1])]))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def _split(path: str, limits: list[tuple[int, int]]):
    names = ["max_tokens", "doc", "piece", "pieces", "first_token", "end_token", "tokens", "cut", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, content = _words(path)
        encode = encoder(path)[0]
        for batch in batches:
            docs = list(zip(batch.column("doc"), (t.as_py().encode() for t in batch.column("text")), batch.column("ids")))
            while docs:
                some, held = [], 0
                while docs and held < TOGETHER:
                    some.append(docs.pop())
                    held += len(some[-1][1]) + len(_EDGE)
                rows: dict[str, list] = {n: [] for n in names}
                data = np.frombuffer(_EDGE + _EDGE.join(raw for _, raw, _ in some) + _EDGE, np.uint8)
                all_ids = [x.values.to_numpy(zero_copy_only=False) for *_, x in some]
                flat = np.concatenate(all_ids)
                sizes = lengths[flat]
                # the same word of two texts is two terms, and no block reaches into another text
                terms = [np.where(content[x], x + k * len(content), -1) for k, x in enumerate(all_ids)]
                gap = np.full(SPAN, -1, np.int64)
                like_of_all = likeness(np.concatenate([y for x in terms for y in (x, gap)]))
                first = place = 0
                for (_, raw, _), ids in zip(some, all_ids):
                    last = first + len(ids)
                    ends = np.cumsum(sizes[first:last])
                    sizes[first:last] = ends + place
                    place += len(raw) + len(_EDGE)
                    first = last
                kind_of_all = kinds(data, sizes)
                first = 0
                for k, ((doc, raw, _), ids) in enumerate(zip(some, all_ids)):
                    last = first + len(ids)
                    kind = kind_of_all[first:last]
                    like = like_of_all[first + k * SPAN : last + k * SPAN + 1]
                    ends = sizes[first:last] - (sizes[last - 1] - len(raw))
                    first = last
                    for limit, overlap in limits:
                        if len(ids) <= limit:
                            continue
                        found = cuts(kind, like, limit, overlap)
                        for i, (a, b, at) in enumerate(found):
                            piece = raw[ends[a - 1] if a else 0 : ends[b - 1]].decode(errors="ignore")
                            for n, v in zip(names, (limit, doc, i, len(found), a, b, b - a, at, piece)):
                                rows[n].append(v)
                yield _batch(rows, batch)

    def _batch(rows: dict[str, list], batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = {"doc": batch.schema.field("doc").type, "cut": pa.string(), "text": pa.string()}
        plain = {n: [x.as_py() for x in v] if n == "doc" else v for n, v in rows.items()}
        return pa.RecordBatch.from_arrays([pa.array(plain[n], kind.get(n, pa.int32())) for n in names], names)

    return run


def split_texts(documents: DataFrame, limits: list[tuple[int, int]], id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Pieces of the texts of more than `limit` tokens, for each (limit, overlap).

    Result: max_tokens, id_column, piece (from 0), pieces, first_token, end_token, tokens, cut, text.
    Every piece has at most `limit` tokens; two neighbours share exactly `overlap` tokens, and the
    texts of the pieces without the repeated tokens, one after the other, are the whole text; of a
    character that an overlap begins inside, the piece before has the whole. cut names the place where
    a piece ends: a paragraph, line, sentence, word, character, or the text's end. Texts within the
    limit, null and empty ones give no rows; repeated rows give repeated pieces.
    """
    path = path or vocabulary()
    wrong = [x for x in limits if not 0 <= 2 * x[1] < x[0]]
    if wrong:
        raise ValueError(f"the overlap must be less than half of the limit: {wrong}")
    kind = documents.schema[id_column].dataType.simpleString()
    shape = f"max_tokens int, doc {kind}, piece int, pieces int, first_token int, end_token int, tokens int, cut string, text string"
    if not limits:
        return documents.sparkSession.createDataFrame([], shape).withColumnRenamed("doc", id_column)
    least = min(x for x, _ in limits)
    # a token has at least one byte, so a text of no more bytes than the limit is within it
    long = documents.where(F.octet_length(text_column) > least)
    coded = encode_corpus(long, id_column, text_column, path, with_text=True).withColumnRenamed(id_column, "doc")
    return coded.where(F.size("ids") > least).mapInArrow(_split(path, limits), shape).withColumnRenamed("doc", id_column)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """max_tokens, doc_id, piece, pieces, first_token, end_token, tokens, cut, text, for each limit of size_limits."""
    rows = table(spark, folder, "size_limits").where("purpose = 'split'").select("tokenizer", "max_tokens", "overlap_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("size_limits has more than 1000 limits")
    documents, done = spread(table(spark, folder, "documents").select("doc_id", "text")), None
    for name in sorted({r["tokenizer"] for r in rows}):
        limits = sorted((r["max_tokens"], r["overlap_tokens"]) for r in rows if r["tokenizer"] == name)
        found = split_texts(documents, limits, path=vocabulary(name))
        done = found if done is None else done.unionByName(found)
    return split_texts(documents, []) if done is None else done
