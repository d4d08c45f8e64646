"""Operator 7: exact token counts at every prefix of a text, by dynamic programming.

The tokenizer is a sentencepiece BPE model: blanks become a mark, one is put in front, and characters merge
by the score of the merged piece, best first, leftmost on ties. Its merges never cross from a character
to a following mark, so a text falls apart into units (marks and what follows them up to the next mark).

In a unit the last piece of the encoding of prefix ``i`` is the piece ``p`` ending at ``i`` that is stable
by itself and behind the last piece ``q`` of prefix ``i - len(p)``: merging ``q + p`` must give ``q, p``
again. Exactly one piece passes, and ``count[i] = count[i - len(p)] + 1``. Whether a pair is stable follows
from the right edge of ``q`` and the left edge of ``p`` while each is merged alone: the pair breaks when
an edge pair makes a piece before either edge moves on. A character without a piece counts as its UTF-8
bytes and takes part in no merge.

The table of a text, one count per prefix, answers its length, whether any budget is exceeded and where to
truncate for it, without encoding again.

Defined cases: null text counts as empty, with no tokens; null ids and repeated rows are counted like any
others; an empty table gives an empty result; units of any length need linear memory; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, slices

MARK = "▁"
#: Units kept per task with their tables; the cache starts anew beyond it.
CACHE_UNITS = 400_000
#: Characters cut into units together; in sorted order they share prefixes.
SLICE = 8 << 20
_UNITS = re.compile(" *[^ ]+| +")


class PrefixCounter:
    """Prefix tables of texts under one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)}
        self.longest = max(map(len, self.score))
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, bytes] = {}

    def merge(self, text: str) -> tuple[list[str], list[tuple[str, float]], list[tuple[str, float]]]:
        """The pieces of ``text``, and the histories of its first and last symbol: (symbol, least score so far
        when it came)."""
        score = self.score
        sym = list(text)
        least = float("inf")
        left, right = [(sym[0], least)], [(sym[-1], least)]
        while True:
            best, at = None, -1
            for i in range(len(sym) - 1):
                s = score.get(sym[i] + sym[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return sym, left, right
            least = min(least, best)
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
            if at == 0:
                left.append((sym[0], least))
            if at == len(sym) - 1:
                right.append((sym[-1], least))

    def edge(self, piece: str) -> tuple[list, list] | None:
        """Histories of a piece's edges (left, right); None when the piece is no stable outcome of its own text."""
        got = self.edges.get(piece, 0)
        if got == 0:
            sym, left, right = self.merge(piece)
            got = self.edges[piece] = (left, right) if len(sym) == 1 else None
        return got

    def is_stable(self, q: str, p: str) -> bool:
        """Whether merging ``q + p`` gives ``q, p``."""
        known = self.stable.get((q, p))
        if known is not None:
            return known
        a, b = self.edge(q)[1], self.edge(p)[0]
        i = j = 0
        result = True
        while True:
            made = self.score.get(a[i][0] + b[j][0])
            go_a = a[i + 1][1] if i + 1 < len(a) else float("-inf")
            go_b = b[j + 1][1] if j + 1 < len(b) else float("-inf")
            if made is not None and made > go_a and made >= go_b:  # ties: the left merge goes first
                result = False
                break
            if i + 1 == len(a) and j + 1 == len(b):
                break
            if go_a >= go_b and i + 1 < len(a):
                i += 1
            else:
                j += 1
        if len(self.stable) > 500_000:
            self.stable.clear()
        self.stable[q, p] = result
        return result

    def learn(self, units: list[str]) -> None:
        """Tables of new units: the counts of the prefixes of length 1, 2, ... of each.

        In sorted order a unit goes on from the prefix that it shares with the one before, whose entries
        hold for it as they are.
        """
        score, stable, longest, edge = self.score, self.stable, self.longest, self.edge
        last: list[str] = [""]
        count = [0]
        before = ""
        for raw in sorted(units):
            unit = raw.replace(" ", MARK)
            n, same = len(unit), 0
            for a, b in zip(unit, before):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for i in range(same + 1, n + 1):
                for j in range(i - 1, max(-1, i - 1 - longest), -1):  # short pieces first: most prefixes end in one
                    piece = unit[j:i]
                    if piece not in score:
                        continue
                    q = last[j]
                    if not q:  # the unit's start, or behind a character without a piece
                        ok = edge(piece) is not None
                    else:
                        ok = stable.get((q, piece))
                        if ok is None:
                            ok = edge(piece) is not None and self.is_stable(q, piece)
                    if ok:
                        last.append(piece)
                        count.append(count[j] + 1)
                        break
                else:
                    last.append("")
                    count.append(count[i - 1] + len(unit[i - 1].encode()))
            before = unit
            self.tables[raw] = array("i", count[1:]).tobytes()

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The units of each text, all of them known afterwards."""
        cuts = [_UNITS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        units = set().union(*cuts)
        if len(units) + len(self.tables) > CACHE_UNITS:
            self.tables.clear()
        self.learn([u for u in units if u not in self.tables])
        return cuts

    def table(self, units: list[str]) -> np.ndarray:
        """Token counts of the prefixes of length 0, 1, ... of a text, from its units."""
        if not units:
            return np.zeros(1, np.int32)
        flat = np.frombuffer(b"".join(map(self.tables.__getitem__, units)), np.int32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        totals = flat[np.cumsum(lengths) - 1]
        out = flat + np.repeat(np.cumsum(totals) - totals, lengths).astype(np.int32)
        out[0] = 0  # the mark put in front alone is no text
        return out

    def tables_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        for units in self.cut(texts):
            yield self.table(units)


@lru_cache(maxsize=1)
def prefix_counter(path: str) -> PrefixCounter:
    """One per Python worker: its bounded tables serve all tasks of the worker."""
    return PrefixCounter(path)


def truncation(table: np.ndarray, budget: int) -> int:
    """The length of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_table: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fits`` per document: ``fits`` is the number of characters that
    stay within ``limit`` tokens. With ``with_table``, also ``counts``: the whole prefix table."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fits", T.LongType())]
    fields += [T.StructField("counts", T.ArrayType(T.IntegerType()))] * with_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            for lo, hi in slices(all_texts, SLICE):
                part, texts, rows = batch.slice(lo, hi - lo), all_texts[lo:hi], []
                for text, table in zip(texts, counter.tables_of(texts)):
                    n = int(table[-1])
                    rows.append((len(text.encode()), n, n > limit, len(text) if n <= limit else truncation(table, limit), *([table] if with_table else [])))
                columns = [pa.array(x, type=pa.list_(pa.int32()) if j == 4 else None) for j, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))
