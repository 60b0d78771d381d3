"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A text is cut into all its overlapping windows of words; the network scores each and the largest score is the text's.
A word's input is a hashed word vector beside the mean of its hashed byte-gram vectors, so that words never seen are
judged by their parts. Labels are of whole texts, so training picks the windows: of a toxic text those that hold the
most telling words at first, then those that the network itself scores highest; of other texts random ones and, later,
its worst mistakes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold, labelled_sample
from .textops import ALNUM, CHUNK, LOWER, Words, blocks, mix, pieces, powers, release, text_of, thrifty

#: The network is trained on at most so many labelled documents of each class and so many bytes of their texts.
PER_CLASS = 1500
SAMPLE_BYTES = 16 << 20
WINDOW, STRIDE = 32, 16
WORDS, GRAMS, DIM, HIDDEN = 1 << 18, 1 << 16, 8, 8
#: Windows that are scored at once.
BATCH = 2048
#: Bytes of a word beyond which its grams are counted by bucket rather than listed.
LONG = 1 << 12
#: Text bytes that are cut into words and grams at once; a longer text is taken in pieces.
BLOCK = CHUNK - LONG


class Tokens:
    """Words of a block as numbers: a word bucket each, and byte-gram buckets with the word that each belongs to.

    ``weight`` is None, or how often each listed gram occurs: a very long word's grams are listed once a bucket.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, ALNUM)
        self.first, self.count, self.begins = w.first, w.count, w.starts
        self.word = (w.hashes() % np.uint64(WORDS)).astype(np.int64)
        self.weight = None
        if len(data) <= CHUNK:
            up, down = powers()
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((LOWER[data] + np.uint64(1)) * up[: len(data)], out=sums[1:])
            spans = lambda start, end: (sums[end] - sums[start]) * down[start]
            self.gram, self.owner = _grams(w.starts, w.ends, spans)
        else:
            spans = lambda start, end: _short_spans(data, start, end)
            usual = w.ends - w.starts <= LONG
            gram, owner = _grams(w.starts[usual], w.ends[usual], spans)
            grams, owners, weights = [gram], [np.flatnonzero(usual).astype(np.int32)[owner]], [np.ones(len(gram), np.float32)]
            for k in np.flatnonzero(~usual).tolist():
                held = np.zeros(GRAMS, np.int64)
                for a in range(int(w.starts[k]), int(w.ends[k]), LONG):
                    held += _long_grams(a, min(a + LONG, int(w.ends[k])), int(w.starts[k]), int(w.ends[k]), spans)
                grams.append(np.flatnonzero(held).astype(np.int32))
                owners.append(np.full(len(grams[-1]), k, np.int32))
                weights.append(held[grams[-1]].astype(np.float32))
            self.gram, self.owner, self.weight = (np.concatenate(x) for x in (grams, owners, weights))
        self.grams = np.maximum(np.bincount(self.owner, self.weight, len(self.word)), 1).astype(np.float32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, words) of all overlapping windows; the last of a row ends with it."""
        many = np.where(self.count > 0, 1 + np.maximum(0, -(-(self.count - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(many)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        inner = np.minimum(k * STRIDE, np.maximum(self.count[row] - WINDOW, 0))
        return row, self.first[row] + inner, np.minimum(self.count[row], WINDOW)


#: Sizes of byte grams, each with a salt of its own; how a word begins (its first four bytes) counts as a gram too.
SIZES, HEAD = ((3, 1), (4, 2), (5, 3)), (4, 9)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ np.uint64(salt)) % np.uint64(GRAMS)).astype(np.int32)


def _grams(starts: np.ndarray, ends: np.ndarray, spans) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of the grams of words; a word shorter than a gram is one."""
    n = ends - starts
    grams, owners = [], []
    for size, salt in SIZES:
        have = np.maximum(n - size + 1, 1)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), have)
        start = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(have) - have, have)
        grams.append(_bucket(spans(start, np.minimum(start + size, ends[owner])), salt))
        owners.append(owner)
    grams.append(_bucket(spans(starts, np.minimum(starts + HEAD[0], ends)), HEAD[1]))
    return np.concatenate(grams), np.concatenate([*owners, np.arange(len(n), dtype=np.int32)])


def _long_grams(low: int, high: int, first: int, last: int, spans) -> np.ndarray:
    """How many grams of the word [first, last) that start in [low, high) each bucket holds."""
    out = np.zeros(GRAMS, np.int64)
    for size, salt in SIZES:
        start = np.arange(low, min(high, last - size + 1))
        out += np.bincount(_bucket(spans(start, start + size), salt), minlength=GRAMS)
    if low == first:
        out[_bucket(spans(np.array([first]), np.array([first + HEAD[0]])), HEAD[1])] += 1
    return out


def _short_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of spans of a few bytes, byte by byte."""
    up, out = powers()[0], np.zeros(len(start), np.uint64)
    for k in range(int((end - start).max(initial=0))):
        inside = start + k < end
        out += np.where(inside, (LOWER[data[np.where(inside, start + k, 0)]] + np.uint64(1)) * up[k], np.uint64(0))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Word and byte-gram vectors, a gated recurrent unit each way, attention pooling, a logistic output."""

    def __init__(self, seed: int = 3, dtype=np.float32):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(size=shape) * (0.6 / np.sqrt(shape[0]))).astype(dtype)
        self.p = {"word": (rng.normal(size=(WORDS, DIM)) * 0.05).astype(dtype), "gram": (rng.normal(size=(GRAMS, DIM)) * 0.3).astype(dtype)}
        for d in "fb":
            self.p |= {f"w{d}": init(2 * DIM, 3 * HIDDEN), f"u{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, dtype)}
        self.p |= {"a": init(2 * HIDDEN, HIDDEN), "v": init(HIDDEN, 1)[:, 0], "o": init(2 * HIDDEN, 1)[:, 0], "k": np.zeros(1, dtype)}

    def inputs(self, t: Tokens) -> np.ndarray:
        vectors = self.p["gram"][t.gram]
        if t.weight is not None:
            vectors *= t.weight[:, None]
        chars = np.stack([np.bincount(t.owner, vectors[:, k], len(t.word)) for k in range(DIM)], 1) / t.grams[:, None] if len(t.word) else np.zeros((0, DIM))
        return np.concatenate([self.p["word"][t.word], chars.astype(vectors.dtype)], 1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores before the logistic of windows; x: steps x windows x gate inputs of both ways, mask: steps x windows."""
        steps, n = mask.shape
        h = HIDDEN
        states = np.zeros((steps, n, 2 * h), x.dtype)
        cache = {"x": x, "mask": mask, "f": [None] * steps, "b": [None] * steps}
        for d, at, order in (("f", 0, range(steps)), ("b", 3 * h, range(steps - 1, -1, -1))):
            u, state = self.p[f"u{d}"], np.zeros((n, h), x.dtype)
            for t in order:
                g, r = x[t, :, at : at + 3 * h], state @ u
                gates = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, reset = gates[:, :h], gates[:, h:]
                new = np.tanh(g[:, 2 * h :] + reset * r[:, 2 * h :])
                m = mask[t][:, None]
                if keep:
                    cache[d][t] = (state, z, reset, new, r[:, 2 * h :])
                state = state + m * (1 - z) * (new - state)
                states[t, :, (0 if d == "f" else h) : (h if d == "f" else 2 * h)] = state
        look = np.tanh(states @ self.p["a"])
        e = np.where(mask > 0, look @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        out = pooled @ self.p["o"] + self.p["k"]
        cache |= {"states": states, "look": look, "share": share, "pooled": pooled}
        return out, cache

    def backward(self, out_grad: np.ndarray, c: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the inputs, and of the gate inputs."""
        g = {"o": c["pooled"].T @ out_grad, "k": out_grad.sum(keepdims=True)}
        pooled = out_grad[:, None] * self.p["o"]
        states = c["share"][..., None] * pooled
        share = np.einsum("tnh,nh->tn", c["states"], pooled)
        e = c["share"] * (share - (c["share"] * share).sum(0))
        g["v"] = np.einsum("tnh,tn->h", c["look"], e)
        look = e[..., None] * self.p["v"] * (1 - c["look"] ** 2)
        g["a"] = np.einsum("tnh,tnk->hk", c["states"], look)
        states = states + look @ self.p["a"].T
        steps, h = c["mask"].shape[0], HIDDEN
        x = np.zeros_like(c["x"])
        for d, at, order in (("f", 0, range(steps - 1, -1, -1)), ("b", 3 * h, range(steps))):
            u = self.p[f"u{d}"]
            gu, back = np.zeros_like(u), np.zeros((c["mask"].shape[1], h), u.dtype)
            for t in order:
                state, z, reset, new, rn = c[d][t]
                back = back + states[t, :, (0 if d == "f" else h) : (h if d == "f" else 2 * h)]
                m = c["mask"][t][:, None]
                dn = back * m * (1 - z) * (1 - new**2)
                dz = back * m * (state - new) * z * (1 - z)
                dr = dn * rn * reset * (1 - reset)
                x[t, :, at : at + 3 * h] = np.concatenate([dz, dr, dn], 1)
                through = np.concatenate([dz, dr, dn * reset], 1)
                gu += state.T @ through
                back = back * (1 - m * (1 - z)) + through @ u.T
            g[f"u{d}"] = gu
        return g, x

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ np.concatenate([self.p["wf"], self.p["wb"]], 1) + np.concatenate([self.p["cf"], self.p["cb"]])

    def score_windows(self, t: Tokens, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        gates = self.gates(self.inputs(t))
        out = np.zeros(len(first), np.float64)
        step = np.arange(WINDOW)[:, None]
        for a in range(0, len(first), BATCH):
            f, m = first[a : a + BATCH], step < n[a : a + BATCH]
            out[a : a + BATCH] = self.forward(gates[np.where(m, f + step, f)], m.astype(gates.dtype))[0]
        return out

    def step(self, t: Tokens, first: np.ndarray, n: np.ndarray, label: np.ndarray, rng: np.random.Generator, rate: float, drop: float = 0.4) -> float:
        """One batch of windows: gradients through time, then an update with running moments."""
        step = np.arange(WINDOW)[:, None]
        m = step < n
        place = np.where(m, first + step, first)
        used, back = np.unique(place, return_inverse=True)
        sub = _subset(t, used)
        inputs = self.inputs(sub)
        dropped = (rng.random(len(used)) >= drop).astype(inputs.dtype)[:, None]
        inputs = np.concatenate([inputs[:, :DIM] * dropped, inputs[:, DIM:]], 1)
        x = self.gates(inputs)[back.reshape(place.shape)]
        out, cache = self.forward(x, m.astype(x.dtype), keep=True)
        p = _sigmoid(out)
        g, gx = self.backward(((p - label) / len(label)).astype(x.dtype), cache)
        flat = np.zeros((len(used), 6 * HIDDEN), x.dtype)
        np.add.at(flat, back.ravel(), gx.reshape(-1, 6 * HIDDEN))
        for d, at in (("f", 0), ("b", 3 * HIDDEN)):
            part = flat[:, at : at + 3 * HIDDEN]
            g[f"w{d}"], g[f"c{d}"] = inputs.T @ part, part.sum(0)
        gi = flat @ np.concatenate([self.p["wf"], self.p["wb"]], 1).T
        g["word"] = (sub.word, gi[:, :DIM] * dropped)
        g["gram"] = (sub.gram, (gi[:, DIM:] / sub.grams[:, None])[sub.owner] * (1 if sub.weight is None else sub.weight[:, None]))
        self._update(g, rate)
        return float(-np.log(np.where(label > 0, p, 1 - p) + 1e-9).mean())

    def _update(self, g: dict, rate: float, decay: float = 1e-4) -> None:
        if not hasattr(self, "moments"):
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
            self.turn = 0
        self.turn += 1
        for k, v in g.items():
            m1, m2 = self.moments[k]
            at: slice | np.ndarray = slice(None)
            if isinstance(v, tuple):  # only the vectors that the batch holds
                at, inverse = np.unique(v[0], return_inverse=True)
                v = np.stack([np.bincount(inverse, v[1][:, j], len(at)) for j in range(v[1].shape[1])], 1)
            m1[at] = 0.9 * m1[at] + 0.1 * v
            m2[at] = 0.99 * m2[at] + 0.01 * v**2
            self.p[k][at] -= (rate * (m1[at] / (np.sqrt(m2[at]) + 1e-6)) + rate * decay * self.p[k][at]).astype(self.p[k].dtype)


def _subset(t: Tokens, used: np.ndarray) -> Tokens:
    """The tokens at ``used``, with their grams, which are in order of their words."""
    many = t.starts[used + 1] - t.starts[used]
    sub = Tokens.__new__(Tokens)
    sub.owner = np.repeat(np.arange(len(used)), many)
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place = t.starts[used][sub.owner] + inner
    sub.word, sub.gram, sub.grams, sub.weight = t.word[used], t.gram[place], t.grams[used], None if t.weight is None else t.weight[place]
    return sub


def _slice(t: Tokens, a: int, b: int) -> Tokens:
    """The words from a to before b of joined tokens, as a view but for the grams' owners."""
    sub = Tokens.__new__(Tokens)
    low, high = t.starts[a], t.starts[b]
    sub.word, sub.gram, sub.grams, sub.weight = t.word[a:b], t.gram[low:high], t.grams[a:b], None if t.weight is None else t.weight[low:high]
    sub.owner = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(t.starts[a : b + 1]))
    return sub


def _joined(texts: list[str]) -> tuple[Tokens, list[tuple[int, int]]]:
    """The tokens of many texts, with the grams in order of their words, held once; and ranges of texts that are small together."""
    held: dict[str, list] = {k: [] for k in ("count", "word", "gram", "grams", "many", "weight")}
    ranges, at = [], 0
    for block in blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])], limit=BLOCK):
        t = Tokens(*text_of(block.column("text")))
        order = np.argsort(t.owner, kind="stable")
        held["gram"].append(t.gram[order])
        held["weight"].append(None if t.weight is None else t.weight[order])
        held["many"].append(np.bincount(t.owner, minlength=len(t.word)).astype(np.int32))
        for k in ("count", "word", "grams"):
            held[k].append(getattr(t, k))
        ranges.append((at, at + block.num_rows))
        at += block.num_rows
    long = any(w is not None for w in held["weight"])
    held["weight"] = [np.ones(len(g), np.float32) if w is None else w for w, g in zip(held["weight"], held["gram"])] if long else []
    t = Tokens.__new__(Tokens)
    for k in ("count", "word", "gram", "grams", "weight"):
        parts = held.pop(k)
        setattr(t, k, np.concatenate(parts) if parts else None)
        del parts
    t.starts = np.concatenate([[0], np.cumsum(np.concatenate(held["many"]), dtype=np.int64)])
    t.first = np.cumsum(t.count) - t.count
    return t, ranges


def _telling(t: Tokens, ranges: list[tuple[int, int]], label: np.ndarray) -> np.ndarray:
    """A first guess of each word's weight: the largest log-odds, over its buckets, of lying in toxic documents."""
    held = [np.zeros((2, n)) for n in (WORDS, GRAMS)]
    words = np.append(t.first, len(t.word))

    def slices():
        for a, b in ranges:
            sub = _slice(t, words[a], words[b])
            yield a, b, len(sub.word), ((sub.word, np.arange(len(sub.word))), (sub.gram, sub.owner))

    for a, b, _, buckets in slices():
        doc = np.repeat(np.arange(b - a), t.count[a:b])
        for (bucket, owner), counts in zip(buckets, held):
            pair = np.unique(bucket.astype(np.int64) * (b - a) + doc[owner])
            for k in (0, 1):
                counts[k] += np.bincount(pair[label[a + pair % (b - a)] == k] // (b - a), minlength=counts.shape[1])
    many = [max(1, int((label == k).sum())) for k in (0, 1)]
    odds = [np.log((c[1] / many[1] + 1e-3) / (c[0] / many[0] + 1e-3)) for c in held]
    out = []
    for _, _, n, buckets in slices():
        guess = np.full(n, -9.0)
        for (bucket, owner), o in zip(buckets, odds):
            np.maximum.at(guess, owner, o[bucket])
        out.append(guess)
    return np.concatenate(out)


def _places(t: Tokens, ranges: list[tuple[int, int]], row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first word, word after the last, first window, window after the last) of each range of texts."""
    words = np.append(t.first, len(t.word))
    for a, b in ranges:
        yield int(words[a]), int(words[b]), *np.searchsorted(row, (a, b)).tolist()


def train(sample: list[tuple[str, int]], rounds: int = 3, epochs: int = 4, least_steps: int = 150, seed: int = 3) -> Network:
    """The network learned from (text, label) in the given order; a small sample is gone over more often, for ``least_steps`` a round."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not sample or len({y for _, y in sample}) < 2:
        net.p["k"][:] = -4.0 if all(y == 0 for _, y in sample) else 4.0
        net.p["o"][:] = 0
        return net
    label = np.array([y for _, y in sample])
    t, ranges = _joined([x for x, _ in sample])
    del sample  # its texts go too, if no one else holds them
    row, first, n = t.windows()
    guess = _telling(t, ranges, label)
    score = np.array([guess[a : a + m].max() for a, m in zip(first, n)])
    del guess
    for turn in range(rounds):
        order = np.lexsort((-score, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        positive = order[(rank < 1 + turn) & (label[row[order]] == 1) & ((score[order] > 0) | (rank == 0))]
        clean = np.flatnonzero(label[row] == 0)
        worst = clean[np.argsort(-score[clean], kind="stable")[: len(positive)]]
        negative = np.concatenate([worst, rng.choice(clean, min(len(clean), 4 * max(len(positive), 200)), replace=False)]) if len(clean) else clean
        picked, y = np.concatenate([positive, negative]), np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
        turns = max(epochs, -(-least_steps // -(-len(picked) // 128)))
        for epoch in range(turns):
            mixed = rng.permutation(len(picked))
            for a in range(0, len(mixed), 128):
                k = mixed[a : a + 128]
                net.step(t, first[picked[k]], n[picked[k]], y[k], rng, 0.01 if turn + 1 < rounds or 2 * epoch < turns else 0.003)
        if turn + 1 < rounds:
            score = np.concatenate([net.score_windows(_slice(t, low, high), first[x:y] - low, n[x:y]) for low, high, x, y in _places(t, ranges, row)])
    del net.moments
    return net


def _best(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Tokens]:
    """The largest score of each row's windows, before the logistic, and the block's tokens."""
    t = Tokens(data, offsets)
    row, first, n = t.windows()
    out = np.full(len(offsets) - 1, -np.inf)
    np.maximum.at(out, row, net.score_windows(t, first, n))
    return out, t


def _long_best(net: Network, data: np.ndarray, piece: int) -> tuple[np.ndarray, int]:
    """The same of one long text, and its words. Each piece begins a number of strides after the one before, far enough back to
    hold every window that was not whole, so the pieces' windows are those of the text."""
    best, words, begin = np.full(1, -np.inf), 0, 0
    for _, end in pieces(data, ALNUM, piece):
        part = data[begin:end]
        t = Tokens(part, np.array([0, len(part)]))
        had = int(t.count[0])
        if end < len(data) and had < 2 * WINDOW:
            continue  # too few words as yet: the next piece begins here again
        _, first, n = t.windows()
        if end < len(data):
            whole = (had - WINDOW) // STRIDE * STRIDE  # where the last whole window of the text begins
            aligned = first % STRIDE == 0
            first, n, begin = first[aligned], n[aligned], begin + int(t.begins[whole])
            words += whole
        else:
            words += had
        best = np.maximum(best, net.score_windows(t, first, n).max(initial=-np.inf))
    return best, words


def scores(net: Network, data: np.ndarray, offsets: np.ndarray, piece: int = BLOCK) -> np.ndarray:
    """Probabilities of label 1 of the rows of a block: the largest of their windows'; 0 for rows without words. One long row is
    taken in pieces, with the windows of the whole."""
    if len(offsets) == 2 and len(data) > piece:
        out, words = _long_best(net, data, piece)
        count = np.array([words])
    else:
        out, t = _best(net, data, offsets)
        count = t.count
    return 1 / (1 + np.exp(-np.clip(out, -35, 35))) * (count > 0)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """The documents with a column ``__score``; every other column is carried along, so nothing is joined or shuffled."""
    # nothing here holds the sample while it is learned from
    net = train(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held, per_class, SAMPLE_BYTES))
    sent = docs.sparkSession.sparkContext.broadcast(net.p)  # of a fixed size, about 10 MB
    release()
    names = [c for c in docs.columns if c not in ("__score", "__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.p = sent.value
        for block in blocks(batches, "__text", limit=BLOCK):
            p = scores(net, *text_of(block.column("__text")))
            yield pa.RecordBatch.from_arrays([block.column(c) for c in names] + [pa.array(p)], names=[*names, "__score"])

    source = docs.select(*names, F.col("text").cast("string").alias("__text"))
    return source.mapInArrow(thrifty(run), docs.select(*names).schema.add("__score", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 where score >= threshold).

    Labels are learned only where crc32(doc_id as text) modulo ``folds`` is not ``held``. Null and empty texts, and those
    without a letter or digit, score 0; a long text is scored piece by piece, in all its windows; a null doc_id is never held
    out; with labels of one class only, or none, every text with words has one constant score: 0.018 if the class is 0 or
    there is none, else 0.982; an empty table gives an empty one. Rows of one id each give a row. Extra columns are ignored.
    """
    found = scored(docs.select("doc_id", "text"), labels, folds, held, per_class)
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
