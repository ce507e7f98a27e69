"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .columns import Given

#: Bytes in a piece that the network reads at once, and of context on either side of it.
PIECE, CONTEXT = 448, 32
#: Pieces in a batch.
BATCH = 512
#: Bytes that count when probabilities are pooled: letters of ASCII and all bytes of other characters.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    """Weights of both directions: input tables (2, 256, 2h), recurrent weights (2, h, h) of gate and state, output (2, h, k), bias (k)."""

    labels: list[str]
    table: np.ndarray
    gate: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _read(m: Model, data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """States (2, T, B, h) of both directions for byte columns data (T, B); the second direction reads from the end.

    Where ``inside`` (T, B) is false a column has ended already: the second direction starts only after that.

    A minimal gated unit: f = sigmoid(a + U s), c = tanh(b + V (f s)), s = s + f (c - s).
    """
    steps, batch = data.shape
    h = m.gate.shape[1]
    both = np.stack([data, data[::-1]])
    states = np.empty((2, steps, batch, h), dtype=np.float32)
    s = np.zeros((2, batch, h), dtype=np.float32)
    seen = np.empty((2, batch, 2 * h), dtype=np.float32)
    ended = None if inside is None or inside.all() else inside[::-1].astype(np.float32)
    for t in range(steps):
        for d in range(2):
            np.take(m.table[d], both[d, t], axis=0, out=seen[d], mode="clip")
        f = np.matmul(s, m.gate)
        f += seen[:, :, :h]
        np.tanh(f, out=f)
        f += 1.0
        f *= 0.5
        if ended is not None:
            f[1] *= ended[t][:, None]
        c = np.matmul(f * s, m.state)
        c += seen[:, :, h:]
        np.tanh(c, out=c)
        c -= s
        c *= f
        s = s + c
        states[:, t] = s
    return states


def probabilities(m: Model, data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities (T, B, k) at every position of byte columns (T, B)."""
    states = _read(m, data, inside)
    logits = states[0] @ m.out[0] + states[1][::-1] @ m.out[1] + m.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(w: dict[str, np.ndarray], data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The loss on byte columns data (T, B) with labels target (B), and its gradient, by backpropagation through time.

    Weights: table (2, 256, 2h), gate and state (2, h, h), out (2, h, k), bias (k). The loss is the mean over letters of
    minus the log probability of the label.
    """
    length, batch = data.shape
    h, columns = w["gate"].shape[1], np.arange(batch)
    weight = LETTER[data].astype(w["bias"].dtype)
    weight /= max(1.0, float(weight.sum()))
    g = {n: np.zeros_like(x) for n, x in w.items()}
    both = np.stack([data, data[::-1]])
    trace, s = [], np.zeros((2, batch, h), dtype=w["bias"].dtype)
    for t in range(length):
        x = np.stack([w["table"][d][both[d, t]] for d in range(2)])
        f = 0.5 * np.tanh(0.5 * (x[:, :, :h] + s @ w["gate"])) + 0.5
        c = np.tanh(x[:, :, h:] + (f * s) @ w["state"])
        trace.append((s, f, c))
        s = s + f * (c - s)
    after = np.stack([*(x[0] for x in trace[1:]), s], axis=1)
    forward, backward = after[0], after[1][::-1]
    logits = forward @ w["out"][0] + backward @ w["out"][1] + w["bias"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    loss = float(-(np.log(p[:, columns, target]) * weight).sum())
    p[:, columns, target] -= 1.0
    p *= weight[:, :, None]
    g["bias"] += p.sum(axis=(0, 1))
    g["out"][0] += np.einsum("tbh,tbk->hk", forward, p, optimize=True)
    g["out"][1] += np.einsum("tbh,tbk->hk", backward, p, optimize=True)
    down = np.stack([p @ w["out"][0].T, (p @ w["out"][1].T)[::-1]])
    ds = np.zeros_like(s)
    for t in reversed(range(length)):
        s, f, c = trace[t]
        ds = ds + down[:, t]
        dc = ds * f * (1 - c * c)
        through = dc @ w["state"].transpose(0, 2, 1)
        df = (ds * (c - s) + through * s) * f * (1 - f)
        g["state"] += (f * s).transpose(0, 2, 1) @ dc
        g["gate"] += s.transpose(0, 2, 1) @ df
        for d in range(2):
            np.add.at(g["table"][d], both[d, t], np.concatenate([df[d], dc[d]], axis=1))
        ds = ds * (1 - f) + through * f + df @ w["gate"].transpose(0, 2, 1)
    return loss, g


def train(texts: list[bytes], labels: list[str], hidden: int = 10, length: int = 64, batch: int = 160, rounds: int | None = None, rate: float = 0.02, seed: int = 5) -> Model:
    """Fits the network on random stretches of the texts, with Adam. Every position is to name its text's label. 400 rounds, or 40 a label if that is more."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(set(labels))
    k, h = len(names), hidden
    rounds = max(400, 40 * k) if rounds is None else rounds
    number = {x: i for i, x in enumerate(names)}
    which = np.array([number[x] for x in labels])
    by_label = [np.flatnonzero(which == i) for i in range(k)]
    padded = [np.frombuffer(x.ljust(length, b" "), dtype=np.uint8) for x in texts]
    f32 = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
    w = {"table": f32(2, 256, 2 * h, by=0.5), "gate": f32(2, h, h, by=0.3), "state": f32(2, h, h, by=0.3), "out": f32(2, h, k, by=0.3), "bias": np.zeros(k, dtype=np.float32)}
    first, second = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        target = rng.integers(0, k, batch)
        rows = [padded[by_label[y][rng.integers(len(by_label[y]))]] for y in target]
        cuts = [int(rng.integers(0, len(x) - length + 1)) for x in rows]
        _, g = gradients(w, np.stack([x[c : c + length] for x, c in zip(rows, cuts, strict=True)], axis=1), target)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1.0, 3.0 * (1 - step / (rounds + 1)))
        for n, x in g.items():
            x *= min(1.0, 1.0 / (norm + 1e-9))
            first[n] = 0.9 * first[n] + 0.1 * x
            second[n] = 0.99 * second[n] + 0.01 * x * x
            w[n] -= (now * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    gate = w["table"].copy()
    gate[:, :, :h] *= 0.5  # sigmoid(x) = (tanh(x / 2) + 1) / 2
    return Model(names, gate, w["gate"] * np.float32(0.5), w["state"], w["out"], w["bias"])


def pooled(m: Model, texts: pa.Array) -> np.ndarray:
    """Mean label probabilities (n, k) of each text of an Arrow column over the letters of the whole text; zeros where it has none.

    A text is cut into pieces of PIECE bytes, read with CONTEXT bytes on either side, so cost and memory don't depend on
    its length, and a text's result not on its neighbours.
    """
    data, offsets = textops.buffers(texts)
    k = len(m.labels)
    size = np.diff(offsets)
    n_pieces = -(-size // PIECE)
    owner = np.repeat(np.arange(len(size)), n_pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    low = offsets[owner] + inner * PIECE
    high = np.minimum(low + PIECE, offsets[1:][owner])
    start, end = np.maximum(low - CONTEXT, offsets[owner]), np.minimum(high + CONTEXT, offsets[1:][owner])
    total = np.zeros((len(size), k))
    order = np.argsort(end - start, kind="stable")
    for at in range(0, len(order), BATCH):
        mine = order[at : at + BATCH]
        steps = int((end[mine] - start[mine]).max())
        place = start[mine][None, :] + np.arange(steps)[:, None]
        inside = place < end[mine]
        block = np.where(inside, data[np.minimum(place, len(data) - 1)], 32).astype(np.uint8)
        counted = inside & (place >= low[mine]) & (place < high[mine]) & LETTER[block]
        p = probabilities(m, block, inside)
        np.add.at(total, owner[mine], np.einsum("tbk,tb->bk", p, counted.astype(np.float32)).astype(np.float64))
    count = textops.counts(LETTER[data], offsets)
    return total / np.maximum(count, 1)[:, None]


def sample(docs: DataFrame, a_label: int = 300, most_rows: int = 19_200, width: int = 1200) -> DataFrame:
    """(lang, text) to learn from: about a_label documents of each label, by a hash of doc_id, and of each text a stretch of ``width`` characters from a place chosen by hash.

    The bound is most_rows. With so many labels that a_label documents of each would exceed it, each has less, but one at least of any label
    up to most_rows labels.
    """
    known = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    labels = max(1, counts.count())
    share = max(1, min(a_label, most_rows // labels))
    counts = F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(most_rows))  # so many rows at most
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40))
    room = F.greatest(F.lit(1), F.char_length("text") - width + 1)
    stretch = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit("stretch")), room) + 1).cast("int"), F.lit(width))
    # twice the share, so that hashing leaves each label enough; exactly the share is taken of these few
    near = known.select("doc_id", "lang", "text", place.alias("place")).join(counts, "lang").where(F.col("place") < F.least(F.lit(1.0), (2 * share + 40) / F.col("n")) * float(1 << 40))
    ranked = near.select("lang", "place", "doc_id", stretch.alias("text")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text")))
    return ranked.where(F.col("rank") <= share).orderBy("place", "doc_id", "text", "lang").limit(most_rows).select("lang", "text")


def fit(docs: DataFrame, **options) -> Model | None:
    """Learns from the columns text and lang of a bounded sample of docs; None if no row has both."""
    rows = sample(docs).toArrow()
    if not rows.num_rows:
        return None
    texts = [x.encode() for x in rows["text"].to_pylist()]
    return train(texts, rows["lang"].to_pylist(), **options)


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs that don't clash, with lang_pred and score (0 to 1; or so named), from the whole text alone.

    Every byte of a text gets label probabilities from both directions; over letters they are averaged, the label with
    the largest mean is lang_pred (of equal ones the first by code point), and this mean is score. A null text or one
    without a letter has ``und`` and score 0, and so has every text if there is no model; repeated rows are judged alike;
    a text of any length is read whole, in pieces; an empty table gives an empty result. Columns with the names of the
    added ones are replaced, further ones of any name are kept.
    """
    given = Given(docs)
    kept = given.kept(*names)
    text = F.when(given["text"].rlike(r"\p{L}"), given["text"])
    schema = given.table.select(*kept).schema.add("label", "string").add("mean", "double")

    def run(batches):
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in textops.groups(texts, 1 << 21):
                part = texts.slice(a, b - a)
                labels, scores = ["und"] * (b - a), [0.0] * (b - a)
                if model is not None:
                    p = pooled(model, part)
                    best = p.argmax(axis=1)
                    for i, missing in enumerate(part.is_null().to_pylist()):
                        if not missing:
                            labels[i], scores[i] = model.labels[best[i]], min(1.0, round(float(p[i, best[i]]), 4))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return given.back(given.table.select(*kept, text.alias("whole")).mapInArrow(run, schema), **{names[0]: "label", names[1]: "mean"})
