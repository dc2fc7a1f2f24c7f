"""Token counts by distinct pre-token.

White space never joins two tokens of a tokenizer that drops it (which is checked), so a text's tokens are those of
its white-space-delimited pre-tokens.  A first pass makes a table of the distinct pre-tokens of all documents with
their frequencies; the pieces of each are counted once.  A second pass makes each document's pre-token frequencies and
joins them to that table: the most frequent pre-tokens, a list of bounded size, in the worker that reads the document,
so that no hot pre-token is shuffled; all others by a shuffled join and a sum for each document.  No ids are kept.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id is passed through; repeated rows get
equal counts; very long texts are counted whole, a slice of their own; extra columns, whatever their names, are
ignored; an empty table gives an empty result; a tokenizer for which white space matters is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import discard, materialize, small_batches

#: Pre-tokens that are counted where documents are read, at most, and the bytes of the longest of these.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
#: Rows handled at a time, and bytes after which a slice ends.
SLICE_ROWS, SLICE_BYTES = 1024, 8_000_000


def slices(texts: pa.Array, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of bounded rows and bytes (a single longer text is a slice of its own)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(total, before + most, "right"))))
        yield texts.slice(at, to - at)
        at = to


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts, the code of each place, and where each text's places begin and end."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    at = words.offsets.to_numpy()
    coded = words.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    codes = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
    return coded.dictionary, codes, (at - at[0]).astype(np.int64)


def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def check_white_space(path: str) -> None:
    """Refuse a tokenizer that has tokens for white space, or whose tokens depend on it."""
    t = tokenizer_of(path)
    n = lambda x: len(t.encode(x, add_special_tokens=False))
    words = ["a", "Hello", "don't", "12.5", "x_y", "été", "日本語", "!?", "<b>"]
    words += [str(x.content) for x in t.get_added_tokens_decoder().values()]
    for space in (" ", "\n", "\t", "\r\n", "\x0b\x0c", "  \n "):
        if n(space) or any(n(a + space + b) != n(a) + n(b) for a in words for b in words):
            raise ValueError("the tokens of this tokenizer depend on white space")


def words_of(docs: DataFrame, path: str) -> DataFrame:
    """word, freq, pieces: every distinct pre-token of all documents, its pieces counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(0).cast(pa.large_string())):
                words, codes, _ = pre_tokens(part)
                some = pc.not_equal(words, "")
                n = pa.array(np.bincount(codes, minlength=len(words)), pa.int64())
                yield pa.RecordBatch.from_arrays([words.filter(some).cast(pa.string()), n.filter(some)], names=["word", "freq"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = tokenizer_of(path)
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                part = b.slice(i, 20_000)
                n = [len(x) for x in t.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=["word", "freq", "pieces"])

    found = docs.where("text is not null").select("text").mapInArrow(count, "word string, freq bigint").groupBy("word").agg(F.sum("freq").alias("freq"))
    return materialize(found.mapInArrow(pieces, "word string, freq bigint, pieces bigint"), "words")


def _head(words: DataFrame) -> DataFrame:
    """The most frequent short pre-tokens: all from the power of two on that leaves HEAD_WORDS at most."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES).withColumn("level", F.floor(F.log2("freq")).cast("int"))
    level, n = 64, 0
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        n += r["count"]
        if n > HEAD_WORDS:
            break
        level = r["level"]
    return short.where(F.col("level") >= level).select("word", "pieces")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    check_white_space(path)
    small_batches(docs.sparkSession)
    words = words_of(docs, path)
    head = materialize(_head(words), "head")
    known = head.toArrow()
    names, pieces = known.column("word").combine_chunks().cast(pa.large_string()), np.append(known.column("pieces").to_numpy().astype(np.int64), 0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            done = 0
            for part in slices(b.column(1).cast(pa.large_string())):
                own, codes, at = pre_tokens(part)
                place = pc.fill_null(pc.index_in(own, value_set=names), len(names)).to_numpy()
                total = np.concatenate([[0], np.cumsum(pieces[place][codes])])
                # Frequencies of the pre-tokens that aren't in the list, by document.
                rare = np.flatnonzero((place == len(names))[codes] & pc.not_equal(own, "").to_numpy(zero_copy_only=False)[codes])
                doc = np.searchsorted(at, rare, "right") - 1
                key, n = np.unique(doc * max(len(own), 1) + codes[rare], return_counts=True)
                doc, code = key // max(len(own), 1), key % max(len(own), 1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([own.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"]),
                )
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(part))), b.column(0).slice(done, len(part)), size, pa.array(total[at[1:]] - total[at[:-1]]), lists], names=["row", "doc_id", "n_bytes", "frequent", "others"])
                done += len(part)
                row += len(part)

    schema = "row bigint, doc_id bigint, n_bytes bigint, frequent bigint, others array<struct<word:string,n:bigint>>"
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frequencies, schema), "frequencies")
    others = rows.where(F.size("others") > 0).select("row", F.explode("others").alias("o")).select("row", "o.word", "o.n")
    sums = others.join(words.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    out = rows.select("row", "doc_id", "n_bytes", "frequent").join(sums, "row", "left")
    n = F.col("frequent") + F.coalesce("rest", F.lit(0))
    out = materialize(out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")), "tokens")
    for old in (words, head, rows):
        discard(old)
    return out
