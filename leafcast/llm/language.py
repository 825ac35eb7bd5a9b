"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads a text's bytes from either end and labels every position; a document's probabilities are the mean of its positions'. A long text is read in windows of
WIDTH bytes that run side by side; each begins CONTEXT bytes before its own part and ends as many after it, so that states have read into the text before a position
counts. Marks stand before the first byte and after the last. How a text is cut depends on the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, map_batches

#: Positions of a window that count, and those before and after that only prepare the states; the last window of a text is a multiple of STEP long.
WIDTH, CONTEXT, STEP = 448, 32, 64
#: Windows that run side by side.
LANES = 1024
MARK = 256
LETTER = re.compile(r"[^\W\d_]")


def windows(raw: bytes) -> list[tuple[np.ndarray, int]]:
    """Symbols of each window of a text, and how many of its positions count (those after the first CONTEXT)."""
    n = len(raw)
    room = np.full(n + 2 * CONTEXT + WIDTH, MARK, np.int16)
    room[CONTEXT : CONTEXT + n] = np.frombuffer(raw, np.uint8)
    out = []
    for at in range(0, n, WIDTH):
        own = min(WIDTH, n - at)
        out.append((room[at : at + 2 * CONTEXT + -(-own // STEP) * STEP], own))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Two gated recurrent layers (forward, backward) of `hidden` units and a linear layer over both. Arrays have units by sequences, so that a gate's values lie together.
    `pairs` marks the byte pairs that the fit has met, as 65,536 bits."""

    labels: list[str]
    hidden: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: np.ndarray | None = None

    @classmethod
    def new(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, MARK + 1))
            w[f"u{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
            w[f"c{d}"] = np.zeros(3 * hidden)
        w["o"] = rng.normal(0, 0.3, (len(labels), 2 * hidden))
        w["p"] = np.zeros(len(labels))
        return cls(labels, hidden, {k: v.astype(np.float32) for k, v in w.items()})

    def _order(self, d: str, n: int) -> range:
        return range(n) if d == "f" else range(n - 1, -1, -1)

    def _run(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step (steps, units, sequences), and what the way back needs."""
        x_in, u, c, h = self.weights[f"x{d}"], self.weights[f"u{d}"], self.weights[f"c{d}"][:, None], self.hidden
        state = np.zeros((h, x.shape[1]), u.dtype)
        states, kept = np.empty((len(x), *state.shape), u.dtype), []
        for t in self._order(d, len(x)):
            a, b = x_in[:, x[t]], u @ state + c
            zr = sigmoid(a[: 2 * h] + b[: 2 * h])
            z, r = zr[:h], zr[h:]
            n = np.tanh(a[2 * h :] + r * b[2 * h :])
            kept.append((t, state, z, r, n, b[2 * h :]))
            states[t] = state = n + z * (state - n)
        return states, kept

    def positions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Label probabilities of every position (steps, labels, sequences)."""
        f, kf = self._run("f", x)
        b, kb = self._run("b", x)
        both = np.concatenate([f, b], axis=1)
        out = self.weights["o"] @ both + self.weights["p"][:, None]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), both, (kf, kb)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean cross entropy of positions, by the weight (steps, sequences) of each."""
        w, h = self.weights, self.hidden
        p, both, kept = self.positions(x)
        share = weight / weight.sum()
        lanes = np.arange(x.shape[1])
        loss = float(-(share * np.log(p[:, y, lanes] + 1e-9)).sum())
        dout = p.copy()
        dout[:, y, lanes] -= 1
        dout *= share[:, None, :]
        g = {"o": np.einsum("tlb,thb->lh", dout, both, optimize=True), "p": dout.sum(axis=(0, 2))}
        dboth = w["o"].T @ dout
        for d, steps, part in (("f", kept[0], dboth[:, :h]), ("b", kept[1], dboth[:, h:])):
            gu, gc, into = np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"c{d}"]), np.empty((len(x), 3 * h, x.shape[1]), w["o"].dtype)
            carry = np.zeros((h, x.shape[1]), w["o"].dtype)
            for t, before, z, r, n, bn in reversed(steps):
                carry = carry + part[t]
                dn = carry * (1 - z) * (1 - n * n)
                dz = carry * (before - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                into[t, :h], into[t, h : 2 * h], into[t, 2 * h :] = dz, dr, dn
                db = np.concatenate([dz, dr, dn * r])
                gu += db @ before.T
                gc += db.sum(axis=1)
                carry = carry * z + w[f"u{d}"].T @ db
            g[f"u{d}"], g[f"c{d}"] = gu, gc
            g[f"x{d}"] = np.stack([np.bincount(x.ravel(), into[:, k].ravel(), MARK + 1) for k in range(3 * h)]).astype(w["o"].dtype)
        return g, loss

    def _logits(self, d: str, x: np.ndarray, out: np.ndarray) -> None:
        """Adds one direction's share of the outputs to `out` (steps, labels, sequences), without keeping states. Halves of the gates' sigmoid are in the weights."""
        h, o = self.hidden, self.weights["o"][:, : self.hidden] if d == "f" else self.weights["o"][:, self.hidden :]
        half = np.repeat(np.float32([0.5, 0.5, 0.5]), h)[:, None]
        u = np.ascontiguousarray(self.weights[f"u{d}"] * half)
        c = self.weights[f"c{d}"][:, None] * half
        table = self.weights[f"x{d}"].copy()
        table[: 2 * h] = table[: 2 * h] * half[: 2 * h] + c[: 2 * h]
        inner = np.ascontiguousarray(c[2 * h :])
        o = np.ascontiguousarray(o)
        lanes = x.shape[1]
        state, less = np.zeros((h, lanes), np.float32), np.empty((h, lanes), np.float32)
        a, b, y = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32), np.empty((len(o), lanes), np.float32)
        gates, n, v = a[: 2 * h], a[2 * h :], b[2 * h :]
        tz, tr = a[:h], a[h : 2 * h]
        for t in self._order(d, len(x)):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=b)
            gates += b[: 2 * h]
            np.tanh(gates, out=gates)
            tr += 1
            v += inner
            v *= tr
            n += v
            np.tanh(n, out=n)
            # the new state: n + (tz + 1) / 2 * (state - n)
            np.subtract(state, n, out=less)
            tz += 1
            less *= tz
            less *= 0.5
            np.add(n, less, out=state)
            out[t] += np.matmul(o, state, out=y)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: label probabilities summed over its positions, and the number of positions."""
        out = np.zeros((len(texts), len(self.labels) + 1), np.float64)
        by: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for i, raw in enumerate(texts):
            out[i, -1] = len(raw)
            for symbols, own in windows(raw):
                by.setdefault(len(symbols), []).append((i, symbols, own))
        lanes = max(16, min(LANES, 4 * LANES // len(self.labels)))
        for steps, found in sorted(by.items()):
            for at in range(0, len(found), lanes):
                some = found[at : at + lanes]
                x = np.ascontiguousarray(np.stack([s for _, s, _ in some], axis=1)).astype(np.intp)
                p = np.empty((steps, len(self.labels), len(some)), np.float32)
                p[:] = self.weights["p"][:, None]
                for d in "fb":
                    self._logits(d, x, p)
                p = p[CONTEXT : steps - CONTEXT]
                p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                p /= p.sum(axis=1, keepdims=True)
                p *= (np.arange(len(p))[:, None] < np.array([own for _, _, own in some]))[:, None, :]
                np.add.at(out, np.array([i for i, _, _ in some]), np.concatenate([p.sum(axis=0, dtype=np.float64).T, np.zeros((len(some), 1))], axis=1))
        return out

    def met(self, texts: list[bytes]) -> np.ndarray:
        """Share of each text's byte pairs that the fit has met; 1 for texts of under two bytes."""
        flat = np.frombuffer(b"".join(texts), np.uint8)
        if len(flat) < 2 or self.pairs is None:
            return np.ones(len(texts))
        known = np.concatenate([[0], np.cumsum(self.pairs[flat[:-1].astype(np.int32) << 8 | flat[1:]])])
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        n = np.maximum(ends - starts - 1, 0)
        return np.where(n > 0, (known[np.maximum(ends - 1, 0)] - known[np.minimum(starts, len(known) - 1)]) / np.maximum(n, 1), 1.0)


def pairs_of(texts: list[bytes]) -> np.ndarray:
    """The byte pairs inside the texts, and with a space at either end."""
    seen = np.zeros(1 << 16, bool)
    for raw in texts:
        b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int32)
        seen[b[:-1] << 8 | b[1:]] = True
    return seen


def train(rows: list[tuple[str, str]], hidden: int = 8, steps: int = 500, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """A network from (text, label) rows, a window of some hundred bytes each at most. Rows are drawn evenly over labels, so that a frequent label has no head start."""
    labels = sorted({y for _, y in rows})
    net = Network.new(labels, hidden, seed)
    if not labels:
        return net
    texts = [t.encode() for t, _ in rows]
    net.pairs = pairs_of(texts)
    if len(labels) < 2:
        return net
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(label) for _, label in rows])
    of = [np.flatnonzero(y == k) for k in range(len(labels))]
    longest = max(map(len, texts)) + 2
    table = np.full((len(texts), longest), MARK, np.int16)
    for i, raw in enumerate(texts):
        table[i, 1 : len(raw) + 1] = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) for t in texts])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        some = np.array([rng.choice(of[k]) for k in rng.permutation(np.arange(batch) % len(labels))])
        most = int(sizes[some].max()) + 2
        x = table[some, :most].T.astype(np.intp)
        weight = ((np.arange(most)[:, None] >= 1) & (np.arange(most)[:, None] <= sizes[some])).astype(np.float32)
        g, _ = net.gradients(x, y[some], weight)
        now = rate * (1 - step / (steps + 1))
        for k, d in g.items():
            m, v = moments[k]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            net.weights[k] = (net.weights[k] - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, rows: int = 2000, least: int = 4, pieces: int = 4, chars: int = 96) -> list[tuple[str, str]]:
    """A bounded sample for the fit: `rows` labelled documents that aren't held out, spread evenly over all labels (`least` of each at least), first in the order of a seeded
    hash; of each, `pieces` pieces of `chars` code points from seeded places all over its text.

    Only these bounded pieces come to the driver. No label is left out. Rows of the most frequent labels are thinned by a hash before any is ranked, so that what meets in
    one task doesn't grow with the table; texts are read again for the chosen rows.
    """
    rank = F.xxhash64(F.lit(11), "doc_id")
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"))).withColumn("rank", rank)
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    labels = counts.count()
    if not labels:
        return []
    share = max(least, -(-rows // labels))
    frequent = counts.filter(F.col("n") > 4 * share + 64).orderBy(F.desc("n")).limit(200).collect()
    below = F.lit(1 << 20)
    for r in frequent:
        below = F.when(F.col("lang") == r["lang"], int((4 * share + 64) / r["n"] * (1 << 20)) + 1).otherwise(below)
    order = Window.partitionBy("lang").orderBy("rank")
    thinned = usable.filter(F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 20)) < below).select("lang", "rank")
    chosen = thinned.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= share).select("lang", "rank").distinct()
    # `share` rows a label at most: few unless there are many labels
    chosen = F.broadcast(chosen) if share * labels <= 100_000 else chosen
    n = F.length("text")
    place = lambda k: F.pmod(F.xxhash64("rank", F.lit(k)), F.greatest(n - chars + 1, F.lit(1))).cast("int") + 1
    cut = F.array_distinct(F.array(*(F.substring(F.col("text"), place(k), F.lit(chars)) for k in range(pieces))))
    # `chosen` is `share` rows a label at most
    found = usable.join(chosen, ["lang", "rank"], "left_semi").select("lang", "rank", F.xxhash64("text").alias("h"), cut.alias("cut"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "h"))).filter(F.col("n") <= share).collect()
    ordered = sorted(found, key=lambda r: (r["lang"], r["rank"], r["h"]))
    return [(t, r["lang"]) for r in ordered for t in r["cut"] if t]


def identify(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score (the mean probability of that label over all positions) and met (share of the byte pairs that the fit has met) of every whole text; columns `keep` stay.

    Inputs of a prediction are the text's bytes alone. Null texts, texts without a letter and networks that learned no label give `und` with score 0.
    Repeated rows give repeated results; an empty table gives no rows. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    keep = list(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches(parts, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            raw = [(t or "").encode() for t in texts]
            lettered = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
            label, score = ["und"] * len(texts), np.zeros(len(texts))
            if net.labels:
                found = net.documents(raw)
                p = found[:, :-1] / np.maximum(found[:, -1:], 1)
                best = p.argmax(axis=1)
                score = np.where(lettered, p[np.arange(len(p)), best], 0.0).clip(0, 1)
                label = [net.labels[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            met = net.met(raw)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(met, pa.float64())], names=[*keep, "lang_pred", "score", "met"])

    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    kept = "".join(f"`{c}` {picked.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(picked, run, f"{kept}lang_pred string, score double, met double")


def language_id(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **fit) -> DataFrame:
    """Train on the labelled rows of docs that aren't held out, then identify every row."""
    return identify(docs, train(training_rows(docs), **fit), keep)
