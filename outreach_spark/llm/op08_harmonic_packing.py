"""Operator 8: harmonic packing of documents into sequences.

A document is its token ids and a closing id. It is cut into pieces of at most ``capacity`` ids; a piece
of length n belongs to class ``k = capacity // n`` (length in (capacity/(k+1), capacity/k]), and a
sequence of class k holds exactly k pieces, whatever their lengths. So a sequence is known from a piece's
ordinal in its class alone: ordinal // k. Workers fill independently: pieces are dealt into buckets, a
bucket numbers its own pieces per class, and the starting ordinals come from the small table of counts
per class and bucket. A number written beside each piece deals equal rows as well.

Plain harmonic classes waste up to half of a sequence, so the rest of a document behind its full pieces is
cut harmonically as well: a rest that would leave more than ``slack`` of its class's sequences empty
gives a piece of exactly ``capacity // (k + 1)`` and goes on with what remains, which is far shorter.
Classes from ``fine`` on are never cut: they leave at most 1 / (fine + 1) empty.

The pieces of the last, incomplete sequence of every class (fewer than the sum of k over the classes, at
any input size) are packed together by first fit, longest first, in one task.

Defined cases: null text counts as empty (one piece: the closing id); null ids and repeated rows are
packed like any others, each row once; very long texts give many pieces; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteWords, Merger
from .common import cut, ship_package, slices

#: Fixed value: the vocabulary's cut of a lower-cased run, with white space spelled out.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
#: Marks that end most words; none of them begins a part with letters.
CLOSING = ".,;:!?)"
#: Words kept per worker with their ids; the cache starts anew beyond it.
CACHE_WORDS = 1_000_000


def cut_lengths(n: int, capacity: int, slack: float = 0.02, fine: int = 24) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= fine or capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit integers, equal to the tokenizers library's.

    The vocabulary's tokenizer lower-cases, drops white space and cuts the rest into letters, single
    digits and marks; no part crosses a blank. A text of Latin letters is split at blanks, each distinct run is cut into
    parts once, and each distinct part is merged once.
    A text with other letters (which may need normalising), with a special token or with one of the four control characters
    that Python alone takes for blanks is cut at spaces and newlines, where its encoding falls apart anyway, and each
    distinct run goes through the library once. The bounded tables of a Python worker serve all its tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, merger = Tokenizer.from_file(path), Merger(path)
    merged = ByteWords(merger)
    parts = regex.compile(PARTS).findall
    beyond = re.compile("[\u0300-\U0010ffff]").search
    marks = [*merger.special, *"\x1c\x1d\x1e\x1f"]
    known: dict[str, bytes] = {}
    known_strange: dict[str, bytes] = {}

    def learn(new: list[str]) -> None:
        """Ids of runs not met before; their parts are kept in the same table. Letters alone, and letters before plain
        marks, need no pattern."""
        words = [run.rstrip(CLOSING) for run in new]
        ended = [run for run, word in zip(new, words) if len(word) < len(run) and word.isalpha()]
        other = [run for run, word in zip(new, words) if not word.isalpha()]
        heads = [word for run, word in zip(new, words) if len(word) < len(run) and word.isalpha()]
        tails = [run[len(word) :] for run, word in zip(ended, heads)]
        cuts = list(map(parts, other))
        fresh = {word for run, word in zip(new, words) if len(word) == len(run) and word.isalpha()}.union(heads, tails, *cuts)
        fresh = [p for p in fresh if p not in known]
        known.update(zip(fresh, merged.encode([p.encode() for p in fresh])))
        known.update(zip(ended, [known[head] + known[tail] for head, tail in zip(heads, tails)]))
        known.update(zip(other, [b"".join([known[p] for p in c]) for c in cuts]))

    def learn_strange(new: list[str]) -> None:
        got = tokenizer.encode_batch_fast(new, add_special_tokens=False)
        known_strange.update(zip(new, (np.array(g.ids, "<u4").tobytes() for g in got)))

    def look_up(table: dict[str, bytes], cuts: list[list[str]], learn_new: Callable[[list[str]], None]) -> list[bytes]:
        if len(table) > CACHE_WORDS:
            table.clear()
        found = [list(map(table.get, c)) for c in cuts]
        texts, places, runs = [], [], []  # what the table did not hold
        for t, got in enumerate(found):
            i = -1
            for _ in range(got.count(None)):
                i = got.index(None, i + 1)
                texts.append(t)
                places.append(i)
                runs.append(cuts[t][i])
        learn_new(list(set(runs)))
        for t, i, run in zip(texts, places, runs):
            found[t][i] = table[run]
        return list(map(b"".join, found))

    def is_strange(text: str) -> bool:
        return any(m in text for m in marks) or not text.isascii() and beyond(text) is not None

    def encode(texts: list[str]) -> list[bytes]:
        strange = list(map(is_strange, texts))
        plain = iter(look_up(known, [t.lower().split() for t, s in zip(texts, strange) if not s], learn))
        other = iter(look_up(known_strange, [t.replace("\n", " ").split(" ") for t, s in zip(texts, strange) if s], learn_strange))
        return [next(other if s else plain) for s in strange]

    return encode


def piece_table(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``, its number in its task as ``salt`` (and ``ids``)."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [source.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "salt"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, numbers = word_encoder(path), count()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, 2 << 20):
                part, rows, at = batch.slice(lo, hi - lo), [], []
                for i, ids in enumerate(encode(texts[lo:hi])):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in cut_lengths(n, capacity):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((start, length, zlib.crc32(piece), n, next(numbers), *([np.frombuffer(piece, "<i4")] if with_ids else [])))
                        at.append(i)
                        start += length
                columns = [pa.array(x, type=pa.list_(pa.int32()) if j == 5 else pa.int64()) for j, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def _first_fit(pieces: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    """Sequences of the leftover pieces, longest first."""
    pieces = pieces.sort_values(["length", "k", "ordinal"], ascending=[False, True, True], kind="stable")
    filled: list[int] = []
    seq, off = [], []
    for n in pieces["length"]:
        at = next((i for i, f in enumerate(filled) if f + n <= capacity), len(filled))
        if at == len(filled):
            filled.append(0)
        seq.append(base + at)
        off.append(filled[at])
        filled[at] += n
    return pieces.assign(sequence_id=seq, offset=off)


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    bucket_rows: int = 65536,
) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` (and its ``ids``). See the module text."""
    pieces = cut(piece_table(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    classed = pieces.withColumn("k", (F.lit(capacity) / F.col("length")).cast("long"))
    total = {k: n for k, n in classed.groupBy("k").count().collect()}  # at most ``capacity`` rows
    buckets = max(1, -(-sum(total.values()) // bucket_rows))
    dealt = classed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)))
    starts = (
        dealt.groupBy("k", "bucket").agg(F.count("*").alias("n"))
        .withColumn("from", F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("k", "bucket", F.coalesce("from", F.lit(0)).alias("from"))
    )
    own = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens", "salt")
    numbered = dealt.withColumn("nth", F.row_number().over(own)).join(starts, ["k", "bucket"]).withColumn("ordinal", F.col("from") + F.col("nth") - 1)
    numbered = cut(numbered.drop("nth", "from", "bucket"), "numbered-pieces")

    base, bases = 0, []
    for k, n in sorted(total.items()):
        bases.append((k, base, n // k * k))
        base += n // k
    spark = docs.sparkSession
    known = spark.createDataFrame(bases, "k long, base long, whole long")
    placed = numbered.join(F.broadcast(known), "k")  # at most ``capacity`` rows
    full = placed.where("ordinal < whole").withColumn("sequence_id", F.col("base") + F.floor(F.col("ordinal") / F.col("k")))
    before = Window.partitionBy("sequence_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*(c for c in pieces.columns if c != "salt"), "sequence_id", "offset"]
    filled = full.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*columns)
    rest = placed.where("ordinal >= whole").select(*pieces.columns, "k", "ordinal")
    out = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    last = rest.groupBy((F.col("k") * 0).alias("one")).applyInPandas(lambda p: _first_fit(p, capacity, base), out).select(*columns)
    return filled.unionByName(last)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: whole sequences from ``pack(..., with_ids=True)``, padded to the
    capacity unless their length is a power of two. A group holds at most ``capacity`` ids."""
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))
    return joined.select("sequence_id", n.alias("n_tokens"), F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(padded).alias("ids"))
