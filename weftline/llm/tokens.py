"""Encoding of a corpus with a public tokenizer."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import cut, spread
from weftline.sources.tables import table

#: How byte_bpe_50k splits a text before it merges bytes. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the rank files lie, and which of them is the default.
FOLDER = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Characters of a chunk of a long text, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 2_048

_loaded: dict = {}


def vocabulary(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The path of a rank file."""
    return os.path.join(folder or FOLDER, f"{name}.tiktoken")


def encoder(path: str):
    """(encode_ordinary of the rank file at `path`, the bytes of every id); read once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        words: list = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = encoding.encode_ordinary, words
    return _loaded[path]


def decode(ids, path: str) -> bytes:
    """The bytes of a list of ids: those of the tokens, one after the other."""
    words = encoder(path)[1]
    return b"".join(words[i] for i in ids)


def _encoded(path: str, keep: list[str], counted: bool):
    """For mapInArrow: `text` becomes ids (or their number); the columns `keep` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)[0]
        for batch in batches:
            values, ends, lengths = array("i"), array("i", [0]), array("i")
            for text in batch.column("text"):
                ids = encode(text.as_py() or "")
                if counted:
                    lengths.append(len(ids))
                else:
                    values.extend(ids)
                    ends.append(len(values))
            if counted:
                out = pa.array(np.frombuffer(lengths, np.int32) if lengths else [], pa.int32())
            else:
                out = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "ids"])

    return run


def _chunked(size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                for k, start in enumerate(range(0, len(text), size)):
                    yield pd.DataFrame({"row": [row], "k": [k], "at": [start], "text": [text[start : start + size + overlap]]})

    return run


def _boundaries(size: int, overlap: int):
    """Adds the pre-token boundaries of a chunk, as places in the whole text, in its first `overlap`
    characters and in those it shares with the next chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        words = regex.compile(PATTERN)
        for batch in batches:
            if batch.empty:
                continue
            heads, tails = [], []
            for at, text in zip(batch["at"], batch["text"]):
                found = [m.start() for m in words.finditer(text)]
                # the last pre-token may go on behind the chunk, and what precedes it may look ahead
                limit = found[-3] if len(found) > 2 else -1
                # blanks look at what follows them, so a piece must not end in one
                cuts = np.array([c for c in found if c and not text[c - 1].isspace()], np.int64)
                sure = cuts[cuts <= limit]
                heads.append((at + cuts[cuts < overlap]).tolist())
                tails.append((at + sure[sure >= size]).tolist())
            yield batch.assign(head=heads, tail=tails)

    return run


def encode_corpus(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
    counted: bool = False,
    with_text: bool = False,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The ids of every text: id_column, [text,] ids (array<int>), or with `counted` their number.

    One row comes out for each row that goes in, repeated rows and null ids of documents included;
    null and empty texts give an empty array. No special tokens are added or recognised. Other
    columns are not read.

    A text of up to two chunks is encoded where it is read. A longer one is cut into overlapping
    chunks that go to many tasks; each finds its pre-token boundaries. From the first boundary that
    a chunk and its predecessor have in common the two agree, since a pre-token depends only on what
    follows; there the pieces are stitched and then encoded in parallel. Where a chunk finds no
    common boundary (one pre-token longer than the overlap), its text joins the piece before it, so
    the result is always that of encoding the whole text.
    """
    path = path or vocabulary()
    docs = documents.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    kind = documents.schema[id_column].dataType.simpleString()
    result = "int" if counted else "array<int>"
    kept = [("doc", kind), *([("text", "string")] if with_text else [])]
    columns = ", ".join(f"{n} {t}" for n, t in kept)
    names = [n for n, _ in kept]
    short = docs.where(f"text is null or length(text) <= {2 * chunk}").mapInArrow(_encoded(path, names, counted), f"{columns}, ids {result}")

    # written once: the rows are read again below, and their numbers must be the same then
    long = cut(docs.where(f"length(text) > {2 * chunk}").withColumn("row", F.monotonically_increasing_id()))
    chunks = long.select("row", "text").mapInPandas(_chunked(chunk, overlap), "row bigint, k int, at bigint, text string")
    cuts = chunks.repartition(F.xxhash64("row", "k")).mapInPandas(
        _boundaries(chunk, overlap), "row bigint, k int, at bigint, text string, head array<bigint>, tail array<bigint>"
    )
    along = Window.partitionBy("row").orderBy("k")
    joined = cuts.withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(along)))))
    spans = (
        joined.withColumn("piece", F.count("start").over(along))
        .withColumn("until", F.coalesce(F.lead(F.coalesce("start", "at")).over(along), F.expr("at + length(text)")))
        .withColumn("from", F.coalesce("start", "at"))
        .select("row", "piece", "k", F.expr("substring(text, cast(from - at + 1 as int), cast(until - from as int))").alias("text"))
    )
    pieces = spans.groupBy("row", "piece").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(k, text))), x -> x.text)"), "").alias("text"))
    coded = pieces.repartition(F.xxhash64("row", "piece")).mapInArrow(_encoded(path, ["row", "piece"], counted), f"row bigint, piece bigint, ids {result}")
    whole = F.sum("ids").cast("int") if counted else F.flatten(F.expr("transform(array_sort(collect_list(struct(piece, ids))), x -> x.ids)"))
    together = coded.groupBy("row").agg(whole.alias("ids")).join(long, "row").select(*names, "ids")
    return short.unionByName(together).withColumnRenamed("doc", id_column)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encode_corpus(spread(table(spark, folder, "documents").select("doc_id", "text")))
