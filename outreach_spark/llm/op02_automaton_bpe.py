"""Operator 2: byte-level BPE encoding with a minimal acyclic transducer as lexicon, and decoding.

The words of a text are the vocabulary's cuts (letters, digits, marks, white space, with a leading blank).
Spark counts all words of the corpus; the ``lexicon_words`` most frequent, with the ids that the merges
give them, are compiled into a minimal acyclic automaton: words share prefixes and suffixes, every arc
carries the number of lexicon words that sort before it, and their sum along a word is its place in a
table of ids. The automaton is one flat file, handed to every executor and memory-mapped there. A word
that it doesn't accept is merged exactly (``bpe.Merger``), so the lexicon's size has no effect on results.

``encode`` gives ids as little-endian unsigned 32-bit integers in a binary column, ``decode`` turns such a
column into text again; special tokens inside a text are matched first, as the library does by default.

Defined cases: null text counts as empty and has no ids; words beyond 256 bytes are never in the lexicon, and very long
ones are merged in n log n;
repeated rows are encoded alike; an empty table gives an empty result and an empty lexicon; ids outside the
vocabulary are skipped when decoding, null ids decode to the empty text; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteWords, Merger, byte_letters
from .common import cut, local_file, map_texts, ship_package, slices

_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the vocabulary's cut of a text into words, with white space spelled out.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: The same cut of an ASCII text (white space is the six ASCII blanks in both).
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words counted per task before they are sent on.
CACHE_WORDS = 300_000
#: Words kept per worker with their ids; the table starts anew beyond it.
KNOWN_WORDS = 400_000
#: Bytes of text encoded together: their words bound a task's memory.
SLICE = 1 << 20


# ---------------------------------------------------------------- automaton


def compile_automaton(words: list[bytes], ids: list[bytes]) -> np.ndarray:
    """One flat int64 array: header, arcs sorted by (state, byte), final marks, and the ids of each word.

    ``words`` are distinct and sorted. States are registered from the last word's unshared end, so equal
    endings become one state and the automaton is minimal.
    """
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    reach: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(key)
            reach.append(node[0] + sum(reach[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[0, []]]  # open states of the last word: [final, [(byte, state), ...]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    for w in words:
        same = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))
        close(same)
        path.extend([0, []] for _ in w[same:])
        path[-1][0] = 1
        last = w
    close(0)
    root = settle(path[0])

    keys, targets, before = [], [], []
    for state, (final, arcs) in enumerate(arcs_of):
        n = final
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            before.append(n)
            n += reach[target]
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    header = np.array([root, len(keys), len(arcs_of), len(words)], np.int64)
    return np.concatenate([header, *(np.array(x, np.int64) for x in (keys, targets, before, [a[0] for a in arcs_of])), ends, flat])


class Automaton:
    """Views into the flat array (memory-mapped when read from a file)."""

    def __init__(self, flat: np.ndarray) -> None:
        self.root, arcs, states, words = (int(x) for x in flat[:4])
        at = np.cumsum([4, arcs, arcs, arcs, states, words + 1])
        self.keys, self.targets, self.before, self.final, self.ends = (flat[a:b] for a, b in zip(at, at[1:]))
        self.ids = flat[at[-1] :]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the lexicon's sorted words, or -1; all words step through it together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        on, state, place = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64)
        step = 0
        while len(on):
            ended = lengths[on] == step
            done = on[ended]
            out[done] = np.where(self.final[state[ended]] == 1, place[ended], -1)
            on, state, place = on[~ended], state[~ended], place[~ended]
            key = state << 8 | raw[starts[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            on, arc = on[ok], arc[ok]
            place = place[ok] + self.before[arc]
            state = self.targets[arc]
            step += 1
        return out

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, None where the lexicon lacks it."""
        if not len(self.keys):
            return [None] * len(words)
        places = self.places(words)
        a, b = self.ends[np.maximum(places, 0)].tolist(), self.ends[np.maximum(places, 0) + 1].tolist()
        return [self.ids[x:y].astype("<u4").tobytes() if p >= 0 else None for p, x, y in zip(places.tolist(), a, b)]


# ---------------------------------------------------------------- encoding


def word_cutter(specials: list[str]) -> Callable[[str], list[str]]:
    """A text's words in order; a special token is a word of its own. ASCII texts are cut by the same pattern in ASCII classes."""
    wide, narrow = regex.compile(WORDS).findall, re.compile(ASCII_WORDS, re.ASCII).findall

    def find(text: str) -> list[str]:
        return narrow(text) if text.isascii() else wide(text)

    special = re.compile("|".join(f"({re.escape(s)})" for s in specials)) if specials else None

    def words_of(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(special.split(text)):
            if part:
                out += [part] if i % (len(specials) + 1) else find(part)
        return out

    return words_of


def count_words(docs: DataFrame, specials: list[str], text_col: str = "text") -> DataFrame:
    """(``word``, ``n``) over all texts; each task adds up its words before the shuffle."""
    ship_package(docs.sparkSession)

    def run(batches):
        words_of, held = word_cutter(specials), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > CACHE_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Longer words stay out of the lexicon and are merged, so its size is bounded by words times bytes.
LEXICON_WORD_BYTES = 256


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", lexicon_words: int = 65_536) -> str:
    """Compile the corpus's most frequent words and hand the file to the executors; returns its name.

    The words are those above a count: the lowest step of a fixed scale (eight to a doubling) above which
    there are at most ``lexicon_words``. So a histogram of the scale and at most that many words of up to
    ``LEXICON_WORD_BYTES`` come to the driver, at any corpus size and number of partitions.
    """
    merger = Merger(path)
    step = F.floor(8 * F.log2("n")).cast("int")
    usable = ~F.col("word").isin(list(merger.special)) & (F.octet_length("word") <= LEXICON_WORD_BYTES)
    counts = cut(count_words(docs, list(merger.special), text_col).where(usable).select("word", step.alias("step")), "word-counts")
    least, room = 0, lexicon_words
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 x 63 rows
        room -= r["count"]
        if room < 0:
            least = r.step + 1
            break
    words = sorted(r.word.encode() for r in counts.where(F.col("step") >= least).select("word").collect())
    flat = compile_automaton(words, ByteWords(merger).encode(words))

    def write(to: str) -> None:
        with open(to, "wb") as f:
            np.save(f, flat)

    return local_file(docs.sparkSession, "lexicon", write)


class Encoder:
    """Encodes texts in a task: cache, then automaton, then exact merges."""

    def __init__(self, path: str, automaton: Automaton) -> None:
        merger = Merger(path)
        self.special = {s: i.to_bytes(4, "little") for s, i in merger.special.items()}
        self.words_of = word_cutter(list(merger.special))
        self.merged = ByteWords(merger)
        self.automaton = automaton
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        found = self.automaton.look_up(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.merged.encode([raw[i] for i in unseen])):
            found[i] = ids
        self.known.update(zip(new, found))
        self.known.update(self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        cuts = [self.words_of(t) for t in texts]
        found = [list(map(self.known.get, c)) for c in cuts]
        rows, places, words = [], [], []  # what the table did not hold
        for t, got in enumerate(found):
            i = -1
            for _ in range(got.count(None)):
                i = got.index(None, i + 1)
                rows.append(t)
                places.append(i)
                words.append(cuts[t][i])
        if words:
            self._learn(list(set(words)))
        for t, i, word in zip(rows, places, words):
            found[t][i] = self.known[word]
        return list(map(b"".join, found))


@lru_cache(maxsize=1)
def _encoder(path: str, lexicon_file: str) -> Encoder:
    """One per Python worker: its bounded tables serve all tasks of the worker."""
    return Encoder(path, Automaton(np.load(lexicon_file, mmap_mode="r")))


def encode(docs: DataFrame, path: str, lexicon: str, out: str = "encoded", text_col: str = "text") -> DataFrame:
    """``docs`` plus the struct ``out``: ``ids`` (binary) and ``n_tokens``. ``lexicon``: from ``build_lexicon``."""

    def make():
        run = _encoder(path, SparkFiles.get(lexicon))

        def work(texts: list[bytes]) -> list:
            ids = [x for lo, hi in slices(texts, SLICE) for x in run([t.decode() for t in texts[lo:hi]])]
            return [ids, [len(x) // 4 for x in ids]]

        return work

    return map_texts(docs, text_col, out, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]), make)


def token_bytes(merger: Merger) -> list[bytes]:
    """The bytes of every id; specials give their text."""
    value = {c: b for b, c in enumerate(byte_letters())}
    out = [b""] * (1 + max([*merger.ids.values(), *merger.special.values()]))
    for token, i in merger.ids.items():
        out[i] = bytes(value[c] for c in token)
    for token, i in merger.special.items():
        out[i] = token.encode()
    return out


@lru_cache(maxsize=1)
def _decoder(path: str) -> Callable[[list[bytes]], list[str]]:
    """Ids of each row to its text; one table per Python worker."""
    table = token_bytes(Merger(path))
    size = len(table)

    def texts(rows: list[bytes]) -> list[str]:
        out = []
        for row in rows:
            ids = np.frombuffer(row, "<u4")
            if len(ids) and ids.max() >= size:
                ids = ids[ids < size]
            out.append(b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace"))
        return out

    return texts


def decode(df: DataFrame, path: str, ids_col: str, out: str = "decoded") -> DataFrame:
    """``df`` plus the struct ``out`` with ``text``, from ids as ``encode`` writes them."""

    def make():
        texts = _decoder(path)
        return lambda rows: [texts(rows)]

    return map_texts(df, ids_col, out, T.StructType([T.StructField("text", T.StringType())]), make)


def round_trip(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65_536) -> DataFrame:
    """(``doc_id, n_tokens, ids, text``): ids by the automaton and the text decoded from them, in one pass."""
    lexicon = build_lexicon(docs, path, text_col, lexicon_words)

    def make():
        run, back = _encoder(path, SparkFiles.get(lexicon)), _decoder(path)

        def work(texts: list[bytes]) -> list:
            ids = [x for lo, hi in slices(texts, SLICE) for x in run([t.decode() for t in texts[lo:hi]])]
            return [ids, [len(x) // 4 for x in ids], back(ids)]

        return work

    fields = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("text", T.StringType())])
    coded = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), "__text", "__e", fields, make)
    return coded.select("doc_id", "__e.n_tokens", "__e.ids", "__e.text")
