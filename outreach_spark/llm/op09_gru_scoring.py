"""Operator 9: document log-likelihood under a gated recurrent language model.

Tokens are words (A-Z lower-cased) and one end per document. Words outside a held-out fold are counted over
the whole corpus. Those that occur at least ``rare`` times the square root of the corpus's words often are
symbols of the recurrent model (``gru``), in classes by rank, small ones of frequent words; so the vocabulary
grows with the corpus, at most by that root. Weights are handed out as a file. The model is
trained by truncated backpropagation on every document outside the fold, to its last token, in ``rounds``
passes (``train_share`` 1; a larger one reads one document in so many, by a hash); in a round every task trains
a copy on its own documents and the copies are averaged, weighted by their tokens. All other words are the
model's class of other words, in which a word has its add-one relative frequency, ``(c + 1) / (N' + V' + 1)`` over the other words. Every text is scored whole: its windows carry the
state on. Its score is the sum of log10 probabilities, its base score that of the add-one unigram model.

Documents are gathered in chunks of about ``chunk_bytes`` and similar length. A chunk's words are numbered
once (frequent first), so words are counted and joined per chunk, not per token: no row is made per token,
and a common word has one row per chunk. What does not depend on the model (counts, base score, words
of the class of other words) is found once per chunk and written with the document's symbols; training and
scoring read that table. Ids are kept as two planes of 16 bits, whose upper one is mostly zero.

Defined cases: null text counts as empty (one token, the end); a null id is in the training part; repeated
rows are scored one by one; without training documents all counts are zero; very long texts run through
their windows one after the other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .common import cut, fold, local_file, ship_package, slices

#: Symbols that are cut into lanes together, and bytes of symbols scored together: they bound a task's memory.
STREAM, SCORED = 1 << 20, 4 << 20
#: Weights that are averaged together.
WEIGHTS = 1 << 14


def pack_ids(ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint32)
    return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("<u2").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.int64)
    return planes[0] | planes[1] << 16


def _chunk(text: Column, key: Column, chunk_bytes: int, sizes: dict[int, int]) -> Column:
    """A chunk number: documents of one power of two in length share chunks, dealt by a hash."""
    size = F.octet_length(text)
    out = F.lit(0).cast("long")
    for b, total in sorted(sizes.items()):
        n = max(1, -(-total // chunk_bytes))
        own = F.lit(b).cast("long") * F.lit(1 << 40) + F.pmod(key, F.lit(n))
        out = F.when(_bucket(size) == b, own).otherwise(out)
    return out


def _bucket(size: Column) -> Column:
    return F.floor(F.log2(size + 1)).cast("int")


def _tokenize(table: pa.Table) -> pa.Table:
    """One chunk's documents as local ids, and its dictionary with training counts, in one table."""
    names: dict[bytes, int] = {}
    ids = []
    for text in table.column("text").cast(pa.binary()).to_pylist():
        words = (text or b"").lower().split()  # bytes know ASCII letters and blanks only
        ids.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
    held = table.column("held_out").to_numpy()
    uses, trained = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for row, h in zip(ids, held):
        n = np.bincount(row, minlength=len(names)) if len(row) > len(names) // 8 else None
        for total in (uses,) if h else (uses, trained):
            if n is not None:
                total += n
            else:
                np.add.at(total, row, 1)
    rank = np.empty(len(names), np.int64)
    order = np.argsort(-uses, kind="stable")
    rank[order] = np.arange(len(names))
    d, w = table.num_rows, len(names)
    words = list(names)
    chunk = table.column("chunk")[0].as_py()
    nothing = pa.nulls
    return pa.table(
        {
            "chunk": pa.array([chunk] * (d + w), pa.int64()),
            "doc_id": pa.concat_arrays([table.column("doc_id").combine_chunks(), nothing(w, table.schema.field("doc_id").type)]),
            "held_out": pa.concat_arrays([table.column("held_out").combine_chunks(), nothing(w, pa.bool_())]),
            "draw": pa.concat_arrays([table.column("draw").combine_chunks(), nothing(w, pa.int64())]),
            "ids": pa.concat_arrays([pa.array([pack_ids(rank[r]) for r in ids], pa.binary()), nothing(w, pa.binary())]),
            "local": pa.concat_arrays([nothing(d, pa.int64()), pa.array(np.arange(w))]),
            "word": pa.concat_arrays([nothing(d, pa.binary()), pa.array([words[i] for i in order], pa.binary())]),
            "n": pa.concat_arrays([nothing(d, pa.int64()), pa.array(trained[order])]),
        }
    )


def _symbols(docs: pa.Table, words: pa.Table, n_words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Local ids of each document, and per local id its training count and its symbol. ``words`` may leave out
    what is never counted (count 0) or, for symbols alone, other words."""
    ids = [unpack_ids(x) for x in docs.column("ids").to_pylist()]
    n = 1 + max((int(x.max()) for x in ids if len(x)), default=-1)
    local = words.column("local").to_numpy()
    own = local < n
    count, symbol = np.zeros(n, np.int64), np.full(n, n_words)
    count[local[own]] = words.column("c").to_numpy()[own]
    given = words.column("symbol").to_numpy()[own]
    symbol[local[own]] = np.where(given == 0, n_words, given)
    return ids, count, symbol


def _streams(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[np.ndarray]:
    """The documents' symbols, joined to streams of about ``limit``."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(unpack_ids(x))
            size += len(held[-1])
            if size >= limit:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def train_rounds(samples: DataFrame, shape: gru.Shape, flat: np.ndarray, rounds: int, trainer_tokens: int) -> np.ndarray:
    """Average of the copies that the tasks train, ``rounds`` times. ``samples``: ``symbols`` (binary), ``n_tokens``."""
    total = samples.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return flat
    dealt = samples.select("symbols").coalesce(max(1, -(-total // max(trainer_tokens, 4 * shape.size))))  # weights sent stay below symbols read

    def average(table: pa.Table) -> pa.Table:
        w = table.column("w").to_pylist()
        summed = sum(np.frombuffer(x, "<f4").astype(np.float64) * n for x, n in zip(table.column("v").to_pylist(), w))
        return pa.table({"at": table.column("at").slice(0, 1), "v": pa.array([(summed / sum(w)).astype("<f4").tobytes()], pa.binary())})

    for _ in range(rounds):
        name = _weights_file(samples.sparkSession, flat)

        def learn(batches, name=name):
            new, n = gru.train(shape, _weights(name), _streams(batches, STREAM))
            for at in range(0, len(new) if n else 0, WEIGHTS):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([new[at : at + WEIGHTS].astype("<f4").tobytes()], pa.binary()), pa.array([n])], names=["at", "v", "w"])

        parts = dealt.mapInArrow(learn, "at long, v binary, w long").groupBy("at").applyInArrow(average, "at long, v binary").collect()  # the weights once
        flat = np.concatenate([np.frombuffer(v, "<f4") for _, v in sorted(parts)])
    return flat


def _weights_file(spark: SparkSession, flat: np.ndarray) -> str:
    return local_file(spark, "lm-weights", lambda to: flat.astype("<f4").tofile(to))


def _weights(name: str) -> np.ndarray:
    return np.asarray(np.memmap(SparkFiles.get(name), "<f4", mode="r"))


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_fold: tuple[int, int] = (7, 2),
    rare: float = 1 / 32,
    hidden: int = 16,
    rounds: int = 2,
    train_share: int = 1,
    chunk_bytes: int = 4 << 20,
    trainer_tokens: int = 1 << 20,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = {r.b: r.s for r in source.groupBy(_bucket(F.octet_length("text")).alias("b")).agg(F.sum(F.octet_length("text")).alias("s")).collect()}  # one row per power of two
    key = F.xxhash64("doc_id", "text")
    placed = source.select(
        _chunk(F.col("text"), key, chunk_bytes, sizes).alias("chunk"),
        "doc_id",
        (fold("doc_id", held_fold[0]) == held_fold[1]).alias("held_out"),
        F.xxhash64(F.lit("draw"), "doc_id", "text").alias("draw"),
        "text",
    )
    fields = [
        T.StructField("chunk", T.LongType()), source.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("draw", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("local", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()),
    ]
    both = cut(placed.groupBy("chunk").applyInArrow(_tokenize, T.StructType(fields)), "lm-chunks")
    texts = both.where("ids is not null").select("chunk", "doc_id", "held_out", "draw", "ids")

    by_word = Window.partitionBy("word")
    words = both.where("word is not null").select("chunk", "local", "word", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first"))
    words = cut(words, "lm-words")
    distinct = words.where("first and c > 0")
    n_words, n_distinct = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = texts.where("not held_out").count()
    tokens, distinct_tokens = n_words + n_ends, n_distinct + (n_ends > 0)
    least = max(1, math.ceil(rare * math.sqrt(n_words)))
    top = distinct.where(F.col("c") >= least).orderBy(F.desc("c"), "word").select("word", "c").toArrow()  # at most n_words / least rows
    spark = docs.sparkSession
    symbols = spark.createDataFrame(pa.table({"word": top.column("word").cast(pa.binary()), "symbol": pa.array(np.arange(1, top.num_rows + 1))}), "word binary, symbol long")
    numbered = words.join(F.broadcast(symbols), "word", "left").select("chunk", "local", "c", F.coalesce("symbol", F.lit(0)).alias("symbol"))

    top_counts = top.column("c").to_pylist()
    others = n_words - sum(top_counts)
    symbol_counts = np.array([n_ends, *top_counts, others], float)
    shape = gru.Shape(words=top.num_rows + 1, hidden=hidden, sizes=gru.class_sizes(symbol_counts[:-1]))
    flat = shape.start(symbol_counts)
    other_total = math.log10(others + n_distinct - top.num_rows + 1)
    base_total = math.log10(tokens + distinct_tokens + 1)
    n_own = shape.words

    def code(texts_of: pa.Table, words_of: pa.Table) -> pa.Table:
        ids, count, symbol = _symbols(texts_of, words_of, n_own)
        inner = np.where(symbol == n_own, np.log10(count + 1.0) - other_total, 0.0)
        unigram = np.log10(count + 1.0) - base_total
        end = math.log10(n_ends + 1.0) - base_total
        made = pa.table(
            {
                "doc_id": texts_of.column("doc_id"),
                "held_out": texts_of.column("held_out"),
                "draw": texts_of.column("draw"),
                "n_tokens": pa.array([len(x) + 1 for x in ids], pa.int64()),
                "n_known": pa.array([int(np.count_nonzero(count[x])) + (n_ends > 0) for x in ids], pa.int64()),
                "base_score": pa.array([float(unigram[x].sum()) + end for x in ids], pa.float64()),
                "inner_score": pa.array([float(inner[x].sum()) for x in ids], pa.float64()),
                "symbols": pa.array([pack_ids(np.append(symbol[x], 0)) for x in ids], pa.binary()),
            }
        )
        return made.sort_by([("draw", "ascending"), ("n_tokens", "ascending"), ("symbols", "ascending")])

    kept = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType())]
    counts = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")]
    fields = [*kept, T.StructField("draw", T.LongType()), *counts, T.StructField("base_score", T.DoubleType()), T.StructField("inner_score", T.DoubleType()), T.StructField("symbols", T.BinaryType())]
    both_sides = texts.groupBy("chunk").cogroup(numbered.where("c > 0").groupBy("chunk"))
    coded = cut(both_sides.applyInArrow(lambda a, b: code(a, b) if a.num_rows else _nothing(fields), T.StructType(fields)), "lm-coded")
    drawn = coded.where(~F.col("held_out") & (F.pmod("draw", F.lit(train_share)) == 0))
    weights = _weights_file(spark, train_rounds(drawn, shape, flat, rounds, trainer_tokens))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _weights(weights)
        for batch in batches:
            sizes = batch.column("symbols").to_pylist()
            for lo, hi in slices(sizes, SCORED):
                part = batch.slice(lo, hi - lo)
                got = gru.document_log_probs(shape, flat, [unpack_ids(x) for x in sizes[lo:hi]])
                model = np.array([float(g.sum()) / math.log(10) for g in got]) + part.column("inner_score").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([tokens] * len(got), pa.int64()), part.column("base_score"), pa.array(model)], names=[f.name for f in out])

    out = [*kept, *counts, T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return coded.drop("draw").mapInArrow(score, T.StructType(out))


def _nothing(fields: list[T.StructField]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in fields})
