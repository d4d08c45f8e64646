"""A small gated recurrent language model in numpy with a class-factored output.

Symbols: 0 ends (and starts) a document, 1..n-1 are frequent words, n is any other word. Words lie in
classes by rank, small ones of frequent words and large ones of rare words; other words are a class of their own,
whose inner distribution is not this model's matter. p(word) = p(class | state) p(word | class, state).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

F4 = np.float32
#: Targets whose class distributions are held at a time.
BLOCK = 1 << 11
#: Gates that are gathered together, so that they stay in a core's cache.
GATES = 1 << 18


def _lowered(weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """``weights`` (biases last) of classes that start at ``edges``, the end last, with biases by which no state's logit is
    above 0: states are within 1, so one shift bounds all logits of a class."""
    reach = np.abs(weights[:, :-1]).sum(axis=1) + weights[:, -1]
    lowered = weights.copy()
    lowered[:, -1] -= np.repeat(np.maximum.reduceat(reach, edges[:-1]), np.diff(edges))
    return lowered


def _softmax(states: np.ndarray, lowered: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators and sums of the distributions over the rows of ``lowered`` (biases last; ``states`` end with 1), and the
    log-probability of entry ``at[i]`` in row i. Rows that would vanish are shifted by their own largest."""
    x = states @ lowered.T
    own = x[np.arange(len(at)), at]
    ones = np.ones(len(lowered), x.dtype)
    e = np.exp(x, out=x)
    total = e @ ones
    if total.min(initial=1) < 1e-30:
        x = states @ lowered.T
        top = x.max(axis=1)
        own = own - top
        e = np.exp(np.subtract(x, top[:, None], out=x), out=x)
        total = e @ ones
    return e, total, own - np.log(total)


@dataclass(frozen=True)
class Shape:
    words: int  # symbols with an own output: the end and the frequent words
    hidden: int = 16
    per_class: int = 32
    sizes: tuple[int, ...] = ()  # words of each class; equal ones of ``per_class`` if not given

    @cached_property
    def edges(self) -> np.ndarray:
        """First word of each class, and the number of words."""
        sizes = self.sizes or [min(self.per_class, self.words - lo) for lo in range(0, self.words, self.per_class)]
        return np.concatenate([[0], np.cumsum(sizes)])

    @property
    def classes(self) -> int:
        """Word classes; the class of other words comes after them."""
        return len(self.edges) - 1

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, symbols, "right") - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"inp": (self.words + 1, 3 * h), "rec": (h, 3 * h), "cls": (self.classes + 1, h + 1), "word": (self.words, h + 1)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of one flat parameter vector; ``out`` has those of ``word`` by class. Biases are the last column."""
        views, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            views[name] = flat[at : at + n].reshape(shape)
            at += n
        return views | {"out": [views["word"][lo:hi] for lo, hi in zip(self.edges, self.edges[1:])]}

    def start(self, counts: np.ndarray, seed: int = 9) -> np.ndarray:
        """Random weights, and output biases that give the frequencies ``counts`` (of symbols 0..words)."""
        flat = np.random.default_rng(seed).normal(0, 0.1, self.size).astype(F4)
        p = self.split(flat)
        weights = np.asarray(counts, float) + 1.0
        p["word"][:, -1] = np.log(weights[: self.words])
        p["cls"][:, -1] = np.log(np.add.reduceat(weights, self.edges))
        p["cls"][:, -1] -= p["cls"][:, -1].max()
        return flat


def class_sizes(counts: np.ndarray, call: float = 5.0) -> tuple[int, ...]:
    """Sizes of classes by rank for little work: a class costs ``call`` entries per token however small it is, and
    its own size for each of its tokens, so its share of the tokens times its size is kept at about ``call``."""
    share = np.append(0.0, np.cumsum(counts / max(counts.sum(), 1)))
    edges = [0]
    for hi in range(1, len(counts) + 1):
        if hi == len(counts) or (share[hi + 1] - share[edges[-1]]) * (hi + 1 - edges[-1]) > call:
            edges.append(hi)
    return tuple(int(n) for n in np.diff(edges))


def steps(p: dict[str, np.ndarray], hidden: int, inputs: np.ndarray, state: np.ndarray, active: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """States after each input (rows x time x hidden); ``state`` is carried on in place.

    With ``active[t]``, only the first so many rows have an input at time t. ``keep`` collects what the
    backward pass needs; there an input 0 resets the state first.
    """
    rows, time = inputs.shape
    run = max(1, GATES // max(1, 3 * hidden * rows))  # times whose gates are gathered together
    rec, half, carried = np.ascontiguousarray(p["rec"].T), F4(0.5), np.ascontiguousarray(state.T)
    live = (inputs.T != 0).astype(F4)
    out = np.zeros((time, hidden, rows), F4)
    for t in range(time):
        n = rows if active is None else int(active[t])
        if not n:
            break
        if t % run == 0:
            x = np.ascontiguousarray(p["inp"][inputs[:n, t : t + run].T].transpose(0, 2, 1))  # gates x rows at each time, overwritten by their values
        h = carried[:, :n]
        if keep is not None:
            h = h * live[t]
        g = rec @ h
        zr, c = x[t % run, : 2 * hidden, :n], x[t % run, 2 * hidden :, :n]
        zr += g[: 2 * hidden]
        zr *= half
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        z, r = zr[:hidden], zr[hidden:]
        c += r * g[2 * hidden :]
        np.tanh(c, out=c)
        new = out[t, :, :n]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if keep is not None:
            keep.append((h, g[2 * hidden :], z, r, c))
        carried[:, :n] = new
    state[:] = carried.T
    return out.transpose(2, 0, 1)


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order; symbols that fit 16 bits are sorted by radix."""
    return np.argsort(symbols.astype(np.uint16) if symbols.max(initial=0) < 1 << 16 else symbols, kind="stable")


def _sum_by(columns: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups that occur, and the sums of each column by them (groups x columns)."""
    used = np.flatnonzero(np.bincount(groups))
    place = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
    place[used] = np.arange(len(used))
    place = place[groups]
    return used, np.stack([np.bincount(place, column, len(used)) for column in columns], axis=1).astype(F4)


def _biased(states: np.ndarray) -> np.ndarray:
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)


def lower(shape: Shape, p: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lowered weights of the classes, and of their words by class."""
    words = _lowered(p["word"], shape.edges)
    return _lowered(p["cls"], np.array([0, len(p["cls"])])), [words[lo:hi] for lo, hi in zip(shape.edges, shape.edges[1:])]


def log_probs(shape: Shape, p: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray, lowered: tuple[np.ndarray, list[np.ndarray]] | None = None) -> np.ndarray:
    """Natural log-probability of each target symbol; for other words, of their class. ``lowered``: what ``lower`` gives for ``p``."""
    of_classes, of_words = lowered or lower(shape, p)
    out = np.zeros(len(targets))
    order = _order(targets)
    s, at = _biased(states[order]), targets[order]
    cls, ends = shape.class_of(at), np.searchsorted(at, shape.edges)
    for lo in range(0, len(at), BLOCK):
        out[lo : lo + BLOCK] = _softmax(s[lo : lo + BLOCK], of_classes, cls[lo : lo + BLOCK])[2]
    for k in np.flatnonzero(np.diff(ends)):
        for lo in range(ends[k], ends[k + 1], BLOCK):
            hi = min(lo + BLOCK, ends[k + 1])
            out[lo:hi] += _softmax(s[lo:hi], of_words[k], at[lo:hi] - shape.edges[k])[2]
    result = np.empty_like(out)
    result[order] = out
    return result


def document_log_probs(shape: Shape, flat: np.ndarray, docs: list[np.ndarray], window: int = 64) -> list[np.ndarray]:
    """Log-probability of every symbol of each document (each ends with 0), state carried across windows."""
    p = shape.split(flat)
    lowered = lower(shape, p)
    given = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-given, kind="stable")
    lengths = given[order]
    symbols = np.concatenate([*docs, np.zeros(0, np.int64)])
    result = np.zeros(len(symbols))
    starts = (np.cumsum(given) - given)[order]
    state = np.zeros((len(docs), shape.hidden), F4)
    for lo in range(0, int(lengths[0]) if len(lengths) else 0, window):
        rows = int(np.searchsorted(-lengths, -lo, "left"))  # documents longer than lo
        width = min(window, int(lengths[0]) - lo)
        has = np.arange(lo, lo + width)[None, :] < lengths[:rows, None]
        place = (starts[:rows, None] + np.arange(lo, lo + width))[has]
        before = np.where(place > np.repeat(starts[:rows], has.sum(axis=1)), symbols[place - 1], 0)  # 0 starts a document
        inputs = np.zeros((rows, width), np.int64)
        inputs[has] = before
        states = steps(p, shape.hidden, inputs, state, has.sum(axis=0))
        result[place] = log_probs(shape, p, states[has], symbols[place], lowered)
    return np.split(result, np.cumsum(given))[:-1]


def gradient(shape: Shape, p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, grad: np.ndarray | None = None, touched: dict | None = None) -> tuple[np.ndarray, float]:
    """Gradient of the mean negative log-probability over one window (truncated there), and that mean.

    ``grad`` is a buffer of zeros to write to. ``touched`` receives, for each part, the rows that aren't zero.
    """
    hidden, (rows, time) = shape.hidden, inputs.shape
    keep: list = []
    states = steps(p, hidden, inputs, state, keep=keep)
    n = rows * time
    grad = np.zeros(shape.size, F4) if grad is None else grad
    g = shape.split(grad)
    by_time = targets.T.reshape(-1)
    order = _order(by_time)
    s, at = _biased(states.transpose(1, 0, 2).reshape(-1, hidden)[order]), by_time[order]
    cls, ends = shape.class_of(at), np.searchsorted(at, shape.edges)
    d, loss = np.empty((n, hidden), F4), 0.0

    of_classes, of_words = lower(shape, p)

    def distribution(lo: int, hi: int, weights: np.ndarray, lowered: np.ndarray, own: np.ndarray, to: np.ndarray) -> np.ndarray:
        nonlocal loss
        e, total, logp = _softmax(s[lo:hi], lowered, own)
        loss -= logp.sum(dtype=np.float64)
        to += e.T @ (s[lo:hi] / (total * F4(n))[:, None])
        return (e @ weights[:, :-1]) / total[:, None] - weights[own, :-1]

    for lo in range(0, n, BLOCK):
        d[lo : lo + BLOCK] = distribution(lo, min(lo + BLOCK, n), p["cls"], of_classes, cls[lo : lo + BLOCK], g["cls"])
    has = np.flatnonzero(np.diff(ends))
    for k in has:
        lo, hi = ends[k], ends[k + 1]
        d[lo:hi] += distribution(lo, hi, p["out"][k], of_words[k], at[lo:hi] - shape.edges[k], g["out"][k])
    columns = np.ascontiguousarray(s.T)
    for part, own in (("cls", cls), ("word", at[: ends[-1]])):
        used, sums = _sum_by(columns[:, : len(own)], own)
        g[part][used] -= sums / F4(n)
    d /= F4(n)
    d_states = np.empty_like(d)
    d_states[order] = d
    d_states = np.ascontiguousarray(d_states.reshape(time, rows, hidden).transpose(0, 2, 1))
    carry, live = np.zeros((hidden, rows), F4), (inputs.T != 0).astype(F4)
    d_inp = np.empty((time, 3 * hidden, rows), F4)
    for t in range(time - 1, -1, -1):
        h, gn, z, r, c = keep[t]
        dh = d_states[t]
        dh += carry
        dz, dr, dc = d_inp[t, :hidden], d_inp[t, hidden : 2 * hidden], d_inp[t, 2 * hidden :]
        np.multiply(dh, 1 - z, out=dc)
        np.multiply(dc * z, h - c, out=dz)
        dc *= 1 - c * c
        np.multiply(dc * gn, r - r * r, out=dr)
        d_rec = d_inp[t].copy()
        d_rec[2 * hidden :] *= r
        g["rec"] += h @ d_rec.T
        carry = p["rec"] @ d_rec
        carry += dh * z
        carry *= live[t]
    used, sums = _sum_by(d_inp.transpose(1, 0, 2).reshape(3 * hidden, -1), inputs.T.reshape(-1))
    g["inp"][used] = sums
    words = slice(None) if len(has) == shape.classes else np.flatnonzero(np.repeat(np.diff(ends) > 0, np.diff(shape.edges)))
    if touched is not None:
        touched.update({"inp": used, "rec": slice(None), "cls": slice(None), "word": words})
    return grad, loss / n


def train(shape: Shape, flat: np.ndarray, streams: Iterable[np.ndarray], rows: int = 256, time: int = 24, rate: float = 0.01, clip: float = 1.0) -> tuple[np.ndarray, int]:
    """One pass of truncated backpropagation (Adam) over streams of documents (each ended by 0), one stream
    after the other; the weights and the number of symbols read. A stream is cut into lanes of equal width, of
    which the last may be shorter. A step moves only the inputs
    and classes of words that its window has."""
    flat = flat.copy()
    grad, touched = np.zeros_like(flat), {}
    p, g, first, second = (shape.split(x) for x in (flat, grad, np.zeros_like(flat), np.zeros_like(flat)))
    step = read = 0
    for stream in streams:
        if not len(stream):
            continue
        width = -(-len(stream) // max(1, min(rows, len(stream) // (2 * time))))
        n = -(-len(stream) // width)
        last = len(stream) - (n - 1) * width
        lanes = np.zeros((n, width), np.int64)
        lanes.reshape(-1)[: len(stream)] = stream
        inputs = np.concatenate([np.zeros((n, 1), lanes.dtype), lanes[:, :-1]], axis=1)
        state = np.zeros((n, shape.hidden), F4)
        edges = [*range(0, last, time), *range(last, width, time), width]
        for lo, hi in zip(edges, edges[1:]):
            own = n if hi <= last else n - 1
            gradient(shape, p, inputs[:own, lo:hi], lanes[:own, lo:hi], state[:own], grad, touched)
            step, read = step + 1, read + own * (hi - lo)
            norm = sum(float(np.vdot(d, d)) for d in (g[k][at] for k, at in touched.items())) ** 0.5
            scale, unbiased, move = F4(min(1.0, clip / max(norm, 1e-30))), F4(1 / (1 - 0.99**step)), F4(rate / (1 - 0.9**step))
            for k, at in touched.items():
                d, m, v = g[k][at], first[k][at], second[k][at]  # views of a whole part, copies of some of its rows
                d *= scale
                m += F4(0.1) * (d - m)
                d *= d
                d -= v
                d *= F4(0.01)
                v += d
                np.sqrt(np.multiply(v, unbiased, out=d), out=d)
                d += F4(1e-6)
                np.divide(m, d, out=d)
                d *= move
                p[k][at] -= d
                g[k][at] = 0
                if not isinstance(at, slice):
                    first[k][at], second[k][at] = m, v
    return flat, read
