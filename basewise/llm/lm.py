"""Language-model scoring: a gated recurrent network over word units, and each word's share of its unit.

Words are lower-cased runs of non-space characters; one end follows each text. A word belongs to a unit: frequent words
have units of their own, others share one by their ending, endings being clustered by the documents that they occur in.
The probability of a word is that of its unit, by a gated recurrent network with class-factored softmax (class, then unit
in the class) reading the units before it, times the word's smoothed share of its unit's training tokens. All words that
training lacks count as one further word of their unit.

Counts cover every training document. They never meet in one place: a chunk of documents sends each distinct word
once with its count, groups of words by hash add up what the chunks sent, and each chunk is answered for its words only.
Units come from the counts of all training documents, and the network is fitted by truncated backpropagation through
time on all of them: each document is in one shard of about ``SHARD_TOKENS`` tokens, shards are trained side by side from
the same weights, and the weights are averaged by tokens (``rounds``: 1, 3, 12, ... shards, then ``ROUND_SHARDS`` each).
The first shard is passed three times and each later one once, whatever their number.
Scoring runs over whole texts in windows and carries the state across them.

Defined cases: null text is empty and scores its end alone; a row with null doc_id is scored, but neither learnt from nor
held out; repeated rows each count; without training documents N and V are 0 and units are equally likely.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, crc_mod, durable, even_labels, give_back, hold_memory, label_table, shuffle_partitions, text_bytes, words_of

END = np.uint64(1)
CHUNK_TEXT = 24 << 20
WINDOW = 32
#: Tokens of a shard of training documents, and the most shards that are trained from the same weights.
SHARD_TOKENS = 2_000_000
ROUND_SHARDS = 256
#: Tokens of a word that has a unit of its own, and of an ending that counts for the number of clusters.
LEAST_TOKENS = 200
#: Distinct words, or bytes of units, that a task holds before it sends them on.
HELD_WORDS, HELD_BYTES = 1 << 20, 32 << 20
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Units:
    """Unit 0 is the end; then frequent words, then clusters of endings."""

    frequent: np.ndarray
    of_frequent: np.ndarray
    of_ending: np.ndarray
    size: int

    def __call__(self, words: np.ndarray, ends: np.ndarray, starts: np.ndarray, joined: np.ndarray) -> np.ndarray:
        out = self.of_ending[endings(ends, starts, joined)]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
            hit = self.frequent[at] == words
            out[hit] = self.of_frequent[at[hit]]
        return out


def endings(ends: np.ndarray, starts: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The last two bytes of each word."""
    before = np.where(ends - starts > 1, joined[ends - 2], 0).astype(np.int64)
    return before << 8 | joined[ends - 1]


def count_words(docs: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The most frequent words of ``docs``, their endings and counts, the tokens of every ending, and the number of texts."""

    def count(batches):
        hold_memory()
        held, size = [], 0

        def merged():
            word, at, inverse = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            ending, n = np.concatenate([x[1] for x in held])[at], np.bincount(inverse, np.concatenate([x[2] for x in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending.astype(np.int32)), pa.array(n)], names=["w", "e", "n"])

        for _, texts in byte_batches(batches, "text"):
            words, _, starts, ends, joined = words_of(texts, lower=True)
            word, at, n = np.unique(words, return_index=True, return_counts=True)
            held.append((np.append(word, END), np.append(endings(ends[at], starts[at], joined), -1), np.append(n, len(texts))))
            size += len(word) + 1
            if size > HELD_WORDS:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()
        give_back()

    def narrow(batches):
        top, total = [np.empty(0, np.int64)] * 3, np.zeros((1 << 16) + 1, np.int64)
        for batch in batches:
            w, e, n = (batch.column(k).to_numpy() for k in range(3))
            total += np.bincount(e + 1, n, len(total)).astype(np.int64)
            own = e >= 0
            top = [np.concatenate([x, y[own]]) for x, y in zip(top, (w, e, n), strict=True)]
            by = np.lexsort((top[0].view(np.uint64), -top[2]))[:frequent]
            top = [x[by] for x in top]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.append(top[0], np.zeros(len(at), np.int64)), np.append(top[1], at - 1), np.append(top[2], total[at]), np.repeat([True, False], [len(top[0]), len(at)]))], names=["w", "e", "n", "word"])

    words = docs.mapInArrow(count, "w long, e int, n long").groupBy("w").agg(F.min("e").alias("e"), F.sum("n").alias("n")).select("w", "e", "n")
    rows = words.mapInArrow(narrow, "w long, e long, n long, word boolean").groupBy("w", "e", "word").agg(F.sum("n").alias("n")).collect()
    found = sorted(((-r["n"], np.int64(r["w"]).view(np.uint64), r["e"]) for r in rows if r["word"]))[:frequent]
    total = np.zeros((1 << 16) + 1, np.int64)
    for r in rows:
        if not r["word"]:
            total[r["e"] + 1] = r["n"]
    return np.array([x[1] for x in found], np.uint64), np.array([x[2] for x in found], np.int64), np.array([-x[0] for x in found], np.int64), total[1:], int(total[0])


def shared_documents(docs: DataFrame, top: np.ndarray, common: np.ndarray, block: int = 10) -> np.ndarray:
    """For each two of the endings ``common``: sum over all documents of the root of the product of their counts, without the words ``top``."""
    m = len(common)
    spot = np.full(1 << 16, -1)
    spot[common] = np.arange(m)

    def meet(batches):
        hold_memory()
        total = np.zeros((m, m))
        for _, texts in byte_batches(batches, "text"):
            words, first, starts, ends, joined = words_of(texts, lower=True)
            key = spot[endings(ends, starts, joined)]
            ok = np.flatnonzero((key >= 0) & ~np.isin(words, top))
            owner = np.repeat(np.arange(len(texts)), np.diff(first))[ok]
            x = np.sqrt(np.bincount(owner * m + key[ok], minlength=len(texts) * m).astype(np.float32)).reshape(-1, m)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(0, m, block), pa.int32()), pa.array([total[k : k + block].astype(np.float32).tobytes() for k in range(0, m, block)], pa.binary())], names=["b", "x"])
        give_back()

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in t.column("x"))
        return pa.table({"b": pa.array(t.column("b")[:1].to_pylist(), pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((m, m))
    for r in docs.mapInArrow(meet, "b int, x binary").groupBy("b").applyInArrow(add, "b int, x binary").collect():
        out[r["b"] : r["b"] + block] = np.frombuffer(r["x"]).reshape(-1, m)
    return out


def learn_units(docs: DataFrame, frequent: int = 150, clusters: int = 100) -> tuple[Units, np.ndarray]:
    """Units by the counts of all of ``docs``, and the tokens of each."""
    top, top_ending, top_count, total, texts = count_words(docs, frequent)
    # A unit needs LEAST_TOKENS to be learnt.
    enough = top_count >= LEAST_TOKENS
    top, top_ending, top_count = top[enough], top_ending[enough], top_count[enough]
    np.subtract.at(total, top_ending, top_count)
    clusters = min(clusters, max(2, int((total >= LEAST_TOKENS).sum())))
    of_ending = np.full(1 << 16, 1 + len(top), dtype=np.uint8)
    common = np.lexsort((np.arange(len(total)), -total))[: min(600, int((total > 0).sum()))]
    if len(common):
        x = shared_documents(docs, top, common)
        x /= np.sqrt(np.outer(x.diagonal(), x.diagonal())) + 1e-9
        s, u = np.linalg.eigh(x)
        u = u[:, ::-1][:, :8]
        at = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) * np.sqrt(np.maximum(s[::-1][:8], 0))
        centres = at[np.unique(np.linspace(0, len(at) - 1, min(clusters - 1, len(at))).astype(int))]
        for _ in range(20):
            label = ((at[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(len(centres)):
                if (label == k).any():
                    centres[k] = at[label == k].mean(axis=0)
        of_ending[common] = 2 + len(top) + label
    size = 2 + len(top) + clusters
    by = np.argsort(top)
    counts = np.bincount(of_ending, total, size)
    counts[0] = texts
    counts[1 : 1 + len(top)] = top_count[by]
    return Units(top[by], np.arange(1, 1 + len(top), dtype=np.uint8), of_ending, size), counts


class Network:
    """A gated recurrent network with a softmax factored into classes of units."""

    def __init__(self, counts: np.ndarray, hidden: int = 24, embed: int = 16, classes: int = 10, seed: int = 5) -> None:
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        # Classes take frequent units first, about the same number of tokens each, 1 to 16 units.
        mass, limit = 0.0, counts.sum() / classes
        self.of_class, self.in_class, c, k = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0, 0
        for u in order:
            if k and (mass + counts[u] > limit * 1.2 or k >= 16):
                c, k, mass = c + 1, 0, 0.0
            self.of_class[u], self.in_class[u] = c, k
            k, mass = k + 1, mass + counts[u]
        self.classes, self.width = c + 1, int(self.in_class.max()) + 1
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {"E": r(n, embed), "W": r(embed, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "U": r(hidden, 3 * hidden), "C": r(hidden, self.classes) * 0.1, "c": np.zeros(self.classes, np.float32), "V": r(self.classes, hidden, self.width) * 0.1, "v": np.zeros((self.classes, self.width), np.float32)}
        self.p["v"][:] = -30
        self.p["v"][self.of_class, self.in_class] = np.log(counts + 1.0)
        self.p["c"][:] = np.log(np.bincount(self.of_class, counts, self.classes) + 1.0)
        self.hidden, self.trained = hidden, 0

    def copy(self) -> Network:
        out = copy.copy(self)
        out.p = {k: x.copy() for k, x in self.p.items()}
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, weights: np.ndarray) -> None:
        for k, part in zip(self.p, np.split(weights, np.cumsum([x.size for x in self.p.values()])[:-1]), strict=True):
            self.p[k] = part.reshape(self.p[k].shape).astype(np.float32)

    def start(self, n: int) -> np.ndarray:
        """The state at the start of ``n`` texts: like all states and gates a row per dimension, a column per text."""
        return np.zeros((self.hidden, n), np.float32)

    def run(self, inputs: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """States (steps, dimensions, texts) before each target, for inputs (steps, texts); -1 is the start of a text.

        Gates are (1 + s(x)) / 2 and the new part of the state is s(x), with s(x) = x / (1 + |x|), which needs no exponential.
        ``keep``: 0 where the state restarts; the second value then holds the states before, gates, new parts and their
        recurrent inputs of all steps.
        """
        p, n = self.p, self.hidden
        table, turn = np.vstack([p["E"] @ p["W"] + p["b"], p["b"]]), np.ascontiguousarray(p["U"].T)
        states = np.empty((len(inputs), *h.shape), h.dtype)
        tape = tuple(np.empty((len(inputs), k, h.shape[1]), h.dtype) for k in (n, 2 * n, n, n)) if keep is not None else ()
        gi, gh, scale = (np.empty((3 * n, h.shape[1]), h.dtype) for _ in range(3))
        zr, new = gi[: 2 * n], gh[2 * n :]
        for t, x in enumerate(inputs):
            if tape:
                h = np.multiply(h, keep[t], out=tape[0][t])
                zr, new = tape[1][t], tape[2][t]
            gi[:] = table[x].T
            np.matmul(turn, h, out=gh)
            np.add(gi[: 2 * n], gh[: 2 * n], out=zr)
            s = np.abs(zr, out=scale[: 2 * n])
            s += 1
            zr /= s
            zr *= 0.5
            zr += 0.5
            if tape:
                tape[3][t] = gh[2 * n :]
            np.multiply(zr[n:], gh[2 * n :], out=new)
            new += gi[2 * n :]
            s = np.abs(new, out=scale[2 * n :])
            s += 1
            new /= s
            h = np.subtract(h, new, out=states[t])
            h *= zr[:n]
            h += new
        return states, tape

    def flat(self, states: np.ndarray) -> np.ndarray:
        """(dimensions, steps * texts)."""
        return states.transpose(1, 0, 2).reshape(self.hidden, -1)

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target unit, given a column of state each."""
        cls, inside = self.of_class[targets], self.in_class[targets]
        a = self.p["C"].T @ states
        a += self.p["c"][:, None]
        a -= a.max(axis=0)
        out = a[cls, np.arange(len(cls))] - np.log(np.exp(a, out=a).sum(axis=0))
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cut, states, inside = np.searchsorted(cls[order], np.arange(self.classes + 1)), states[:, order], inside[order]
        rest = np.empty(len(order), out.dtype)
        for c in range(self.classes):
            at = slice(cut[c], cut[c + 1])
            b = self.p["V"][c].T @ states[:, at]
            b += self.p["v"][c][:, None]
            b -= b.max(axis=0)
            own = b[inside[at], np.arange(b.shape[1])]
            rest[at] = own - np.log(np.exp(b, out=b).sum(axis=0))
        out[order] += rest
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean loss of a window, cut off at its start."""
        p, n = self.p, self.hidden
        states, (old, gates, new, inner) = self.run(inputs, h, keep)
        flat, goal = self.flat(states), targets.ravel()
        cls, size = self.of_class[goal], len(goal)
        g = {k: np.zeros_like(v) for k, v in p.items()}

        def soft(a: np.ndarray, own: np.ndarray) -> np.ndarray:
            """Softmax of the columns, less 1 at each column's own row, over all targets."""
            a -= a.max(axis=0)
            np.exp(a, out=a)
            a /= a.sum(axis=0)
            a[own, np.arange(a.shape[1])] -= 1
            a /= size
            return a

        a = soft(p["C"].T @ flat + p["c"][:, None], cls)
        g["C"], g["c"] = flat @ a.T, a.sum(axis=1)
        d_flat = p["C"] @ a
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cut, inside, sorted_states = np.searchsorted(cls[order], np.arange(self.classes + 1)), self.in_class[goal][order], flat[:, order]
        d_sorted = np.empty_like(sorted_states)
        for c in range(self.classes):
            at = slice(cut[c], cut[c + 1])
            if cut[c + 1] > cut[c]:
                b = soft(p["V"][c].T @ sorted_states[:, at] + p["v"][c][:, None], inside[at])
                g["V"][c], g["v"][c] = sorted_states[:, at] @ b.T, b.sum(axis=1)
                d_sorted[:, at] = p["V"][c] @ b
        d_flat[:, order] += d_sorted
        d_states, dh = np.ascontiguousarray(d_flat.reshape(n, *inputs.shape).transpose(1, 0, 2)), np.zeros_like(h)
        # What of the chain doesn't depend on later steps: s' = (1 - |s|)^2, half of that for a gate.
        slope = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
        to_z, to_m = (old - new) * slope[:, :n], (1 - gates[:, :n]) * (1 - np.abs(new)) ** 2
        to_r = inner * slope[:, n:]
        d_in, d_gh = (np.empty((len(inputs), 3 * n, h.shape[1]), d_flat.dtype) for _ in range(2))
        for t in range(len(inputs) - 1, -1, -1):
            d = d_states[t]
            d += dh
            np.multiply(d, to_z[t], out=d_in[t, :n])
            dm = np.multiply(d, to_m[t], out=d_in[t, 2 * n :])
            np.multiply(dm, to_r[t], out=d_in[t, n : 2 * n])
            d_gh[t, : 2 * n] = d_in[t, : 2 * n]
            np.multiply(dm, gates[t, n:], out=d_gh[t, 2 * n :])
            dh = p["U"] @ d_gh[t]
            d *= gates[t, :n]
            dh += d
            dh *= keep[t]
        g["U"] = np.tensordot(old, d_gh, axes=([0, 2], [0, 2]))
        # Input columns are summed by unit; -1, the start, is the table's last row.
        read = np.where(inputs.ravel() < 0, len(p["E"]), inputs.ravel())
        by = np.argsort(read.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.append(True, read[by][1:] != read[by][:-1]))
        d_table = np.zeros((len(p["E"]) + 1, 3 * n), d_in.dtype)
        d_table[read[by][heads]] = np.add.reduceat(d_in.transpose(0, 2, 1).reshape(-1, 3 * n)[by], heads, axis=0)
        g["b"] = d_table.sum(axis=0)
        g["E"], g["W"] = d_table[:-1] @ p["W"].T, p["E"].T @ d_table[:-1]
        return g, states[-1]

    def train(self, units: np.ndarray, starts: np.ndarray, streams: int = 48, rate: float = 4e-3, epochs: int = 3) -> None:
        """``units``: texts one after another, each with its end; ``starts``: True where a text begins."""
        length = -(-len(units) // streams)
        if not length:
            return
        # The last stream is filled up from the first, so that no token is left out.
        y = np.resize(units, length * streams).reshape(streams, length).T.astype(np.int64)
        first = np.resize(starts, length * streams).reshape(streams, length).T.copy()
        first[0] = True
        x = np.vstack([np.full((1, streams), -1), y[:-1]])
        x[first] = -1
        keep = 1 - first.astype(np.float32)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        total = epochs * -(-length // WINDOW)
        for _ in range(epochs):
            h = self.start(streams)
            for t in range(0, length, WINDOW):
                g, h = self.gradients(x[t : t + WINDOW], y[t : t + WINDOW], keep[t : t + WINDOW], h)
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k, a in g.items():
                    a *= min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.01 * (a * a - v[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def score(self, sequences: list[np.ndarray], batch: int = 1024) -> np.ndarray:
        """Natural log probability of each whole sequence of units."""
        out = np.zeros(len(sequences))
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            sizes = np.array([len(sequences[i]) for i in own])
            h, last = self.start(len(own)), np.full(len(own), -1)
            for t in range(0, int(sizes[0]), WINDOW):
                n = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t come first
                y = np.zeros((n, WINDOW), dtype=np.int64)
                for k in range(n):
                    part = sequences[own[k]][t : t + WINDOW]
                    y[k, : len(part)] = part
                x = np.concatenate([last[:n, None], y[:, :-1]], axis=1).T
                states, _ = self.run(x, np.ascontiguousarray(h[:, :n]))
                h, last = states[-1], y[:, -1]
                steps, rows = np.nonzero(np.arange(t, t + WINDOW)[:, None] < sizes[None, :n])
                flat = self.flat(states)
                got = self.log_probs(flat if len(rows) == flat.shape[1] else flat[:, steps * n + rows], y[rows, steps])
                out[own[:n]] += np.bincount(rows, got, n)
        return out


def encoded(docs: DataFrame, units: Units, shards: int) -> DataFrame:
    """The units of all texts of ``docs``, each with its end: a row per shard and task (shard, order and length of each text, units)."""

    def encode(batches):
        hold_memory()
        held, size = [], 0

        def rows():
            shard, order, length = (np.concatenate([x[k] for x in held]) for k in range(3))
            flat = np.concatenate([x[3] for x in held])
            cut = np.append(0, np.cumsum(length))
            out = [(k, np.flatnonzero(shard == k)) for k in np.unique(shard).tolist()]
            columns = [[k for k, _ in out], [order[at].tobytes() for _, at in out], [length[at].tobytes() for _, at in out], [b"".join(flat[cut[i] : cut[i + 1]].tobytes() for i in at.tolist()) for _, at in out]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "orders", "lengths", "units"])

        for batch, texts in byte_batches(batches, "text"):
            words, first, starts, ends, joined = words_of(texts, lower=True)
            length = np.diff(first) + 1
            flat = np.zeros(int(length.sum()), np.uint8)
            inside = np.ones(len(flat), bool)
            inside[np.cumsum(length) - 1] = False
            flat[inside] = units(words, ends, starts, joined)
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), length, flat))
            size += len(flat) + 20 * len(texts)
            if size > HELD_BYTES:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()
        give_back()

    order = F.xxhash64("doc_id", "text")
    own = docs.select("text", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("o"))
    return durable(own.mapInArrow(encode, "shard int, orders binary, lengths binary, units binary"))


def rounds(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards that are trained side by side: every shard once, first 1, then three times what came before."""
    out, at = [], 0
    while at < shards:
        end = min(shards, at + min(ROUND_SHARDS, max(1, 3 * at)))
        out.append((at, end))
        at = end
    return out


def learn(docs: DataFrame) -> tuple[Units, Network]:
    """Units and network from all of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("binary").alias("text"), "doc_id")
    units, counts = learn_units(docs)
    network, tokens = Network(counts), int(counts.sum())
    if not tokens:
        return units, network
    shards = max(1, round(tokens / SHARD_TOKENS))
    partitions, rows = shuffle_partitions(spark), encoded(docs, units, shards)
    for lo, hi in rounds(shards):
        # The first shard, alone in its round, starts from random weights: it is passed more often, in fewer streams.
        epochs, streams = (1, 256) if lo else (3, 48)
        shared = spark.sparkContext.broadcast(network)

        def fit(t: pa.Table) -> pa.Table:
            hold_memory()
            own = shared.value.copy()
            order, length = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column(k)]) for k in ("orders", "lengths"))
            flat = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("units")])
            cut = np.append(0, np.cumsum(length))
            by = np.lexsort((length, order))  # whatever the tasks that sent them
            begins = np.zeros(len(flat), bool)
            begins[np.append(0, np.cumsum(length[by])[:-1])] = True
            own.train(np.concatenate([flat[cut[i] : cut[i + 1]] for i in by.tolist()]), begins, streams, epochs=epochs)
            give_back()
            return pa.table({"tokens": pa.array([len(flat)], pa.int64()), "weights": pa.array([own.weights().tobytes()], pa.binary()), "shard": pa.array(t.column("shard")[:1].to_pylist(), pa.int32())})

        labels = F.array(*[F.lit(x) for x in even_labels(spark, hi - lo, partitions)])
        own = rows.where(F.col("shard").between(lo, hi - 1)).withColumn("label", F.element_at(labels, F.col("shard") - lo + 1)).repartition(partitions, "label")
        found = sorted(own.groupBy("label").applyInArrow(fit, "tokens long, weights binary, shard int").collect(), key=lambda r: r["shard"])
        if found:
            network = network.copy()
            network.load(sum(r["tokens"] * np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in found) / sum(r["tokens"] for r in found))
        network.trained += sum(r["tokens"] for r in found)
        shared.unpersist()
    return units, network


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    spark = docs.sparkSession
    remainder = crc_mod(F.col("doc_id"), 5)
    units, network = learn(docs.where(remainder != 1))
    partitions = shuffle_partitions(spark)
    chunks = max(partitions, -(-text_bytes(docs) // CHUNK_TEXT))
    names = np.array(even_labels(spark, partitions, partitions), dtype=np.int32)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        F.coalesce(remainder != 1, F.lit(False)).alias("learnt"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("slot"),
    )
    # A row per CHUNK_TEXT bytes of text.
    labels = label_table(spark, chunks, partitions).select("slot", F.col("label").alias("c"))
    own = own.join(F.broadcast(labels), "slot").select("doc_id", "text", "held_out", "learnt", "c").repartition(partitions, "c")
    shared = spark.sparkContext.broadcast((units, network, names))

    def send(batches):
        units, _, names = shared.value
        hold_memory()
        held: dict[int, list] = {}
        for batch, texts in byte_batches(batches, "text"):
            words, first, starts, ends, joined = words_of(texts, lower=True)
            unit = units(words, ends, starts, joined)
            chunk, learnt = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("c", "learnt"))
            n = np.diff(first)
            for c in np.unique(chunk):
                mine = np.repeat(chunk == c, n)
                word, at, inverse = np.unique(words[mine], return_index=True, return_inverse=True)
                count = np.bincount(inverse, np.repeat(learnt, n)[mine], len(word)).astype(np.int64)
                held.setdefault(int(c), []).append((np.append(word, END), np.append(count, int((learnt & (chunk == c)).sum())), np.append(unit[mine][at], 0).astype(np.uint8)))
        for c, found in held.items():
            word, at, inverse = np.unique(np.concatenate([x[0] for x in found]), return_index=True, return_inverse=True)
            count = np.bincount(inverse, np.concatenate([x[1] for x in found])).astype(np.int64)
            unit = np.concatenate([x[2] for x in found])[at]
            to = (word % np.uint64(len(names))).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(len(names) + 1))
            parts = [by[cut[k] : cut[k + 1]] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(np.full(len(names), c, np.int32)), *(pa.array([x[i].tobytes() for i in parts], pa.binary()) for x in (word, count.astype(np.uint32), unit))], names=["g", "c", "words", "counts", "units"]
            )

    def add(t: pa.Table) -> pa.Table:
        units = shared.value[0]
        own = t.column("c").to_pylist()
        arrays = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("words")]
        word, at, inverse = np.unique(np.concatenate(arrays), return_index=True, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("counts")]), len(word)).astype(np.int64)
        unit = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("units")])[at]
        sums = np.concatenate([np.bincount(unit, count, units.size), np.bincount(unit, count > 0, units.size)]).astype(np.int64)
        cut = np.append(0, np.cumsum([len(x) for x in arrays]))
        found = [count[inverse[cut[k] : cut[k + 1]]].tobytes() for k in range(len(own))]
        # The chunks that asked are answered; one row more has the group's sums by unit.
        columns = [pa.array([*own, None], pa.int32()), pa.array([*(x.tobytes() for x in arrays), None], pa.binary()), pa.array([*found, None], pa.binary()), pa.array([*[None] * len(own), sums.tolist()], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["c", "words", "counts", "sums"])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        units, network, _ = shared.value
        hold_memory()
        word = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in right.column("words")]) if right.num_rows else np.empty(0, np.uint64)
        count = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in right.column("counts")]) if right.num_rows else np.empty(0, np.int64)
        by = np.argsort(word)
        word, count = word[by], count[by]
        sums = totals.value
        tokens, types = sums[: units.size], sums[units.size :]
        n, v = int(tokens.sum()), int(types.sum())
        share = np.log10(tokens + 0.5 * (types + 1))
        share[0] = np.log10(tokens[0] + 0.5 * max(types[0], 1))  # nothing else can be in the end's unit
        rows: list[list] = [[] for _ in range(7)]
        for batch, texts in byte_batches(iter(left.combine_chunks().to_batches()), "text", 8 << 20):
            size = len(texts)
            n_tokens, n_known, base, within, sequences = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), []
            lo = 0
            for _, some in byte_batches(iter([batch]), "text"):
                words, first, starts, ends, joined = words_of(some, lower=True)
                unit = units(words, ends, starts, joined)
                heads = first[1:] + np.arange(len(some))  # where the ends go
                flat_unit, flat_count = np.zeros(len(words) + len(some), np.uint8), np.zeros(len(words) + len(some), np.int64)
                rest = np.ones(len(flat_unit), bool)
                rest[heads] = False
                flat_unit[rest] = unit
                own_words, at = np.unique(words, return_inverse=True)
                flat_count[rest] = count[np.searchsorted(word, own_words)][at]
                flat_count[heads] = count[np.searchsorted(word, END)]
                owner = np.repeat(np.arange(lo, lo + len(some)), np.diff(first) + 1)
                logs = np.log10(flat_count + 0.5)
                n_tokens += np.bincount(owner, minlength=size)
                n_known += np.bincount(owner, flat_count > 0, size).astype(np.int64)
                base += np.bincount(owner, logs, size)
                within += np.bincount(owner, logs - share[flat_unit], size)
                sequences += np.split(flat_unit, heads[:-1] + 1)
                lo += len(some)
            base -= n_tokens * np.log10(n + 0.5 * (v + 1))
            total = within + network.score(sequences) / np.log(10)
            for column, values in zip(rows, (batch.column(0).to_pylist(), batch.column(2).to_pylist(), n_tokens, n_known, np.full(size, n), base, total), strict=True):
                column.extend(values)
        give_back()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    answers = own.mapInArrow(send, "g int, c int, words binary, counts binary, units binary").groupBy("g").applyInArrow(add, "c int, words binary, counts binary, sums array<long>")
    answers = durable(answers)
    sums = np.zeros(2 * units.size, np.int64)
    for r in answers.where("c IS NULL").select(F.posexplode("sums").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        sums[r["k"]] = r["n"]
    totals = spark.sparkContext.broadcast(sums)
    return own.groupBy("c").cogroup(answers.where("c IS NOT NULL").select("c", "words", "counts").groupBy("c")).applyInArrow(judge, OUT)
