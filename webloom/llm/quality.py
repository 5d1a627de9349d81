"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, id_column, scan, slices, small_side, trim

BUCKETS = 256
FEATURES = BUCKETS + 3
RESULT = pa.struct([("score", pa.float64()), ("keep", pa.bool_()), ("passages", pa.int64()), ("top_passage", pa.int64()), ("top_weight", pa.float64())])
RESULT_DDL = "struct<score:double,keep:boolean,passages:bigint,top_passage:bigint,top_weight:double>"


def encode(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each row). A passage is a run of size bytes of the row, the last with the
    rest; its features are the square roots of its shares of hashed byte pairs, and how concentrated these are (sum of squares, greatest share, entropy)."""
    raw, at = scan(column)
    lengths = np.diff(at)
    count = -(-lengths // size)
    total = int(count.sum())
    if not total:
        return np.zeros((0, FEATURES), np.float32), count
    b = np.frombuffer(raw, np.uint8)
    first = np.repeat(at[:-1], count) + size * (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
    ends = np.minimum(first + size, np.repeat(at[1:], count))
    passage = np.repeat(np.arange(total, dtype=np.int32), ends - first)
    pair = b.astype(np.uint32) * np.uint32(257)
    pair[:-1] += b[1:]
    pair[ends - 1] -= np.where(ends < len(b), b[np.minimum(ends, len(b) - 1)], 0).astype(np.uint32)  # no pair goes over the end of a passage
    bucket = (pair * np.uint32(2654435761)) >> np.uint32(24)
    counts = np.bincount(passage * BUCKETS + bucket.astype(np.int32), minlength=total * BUCKETS).reshape(total, BUCKETS)
    share = (counts / (ends - first)[:, None]).astype(np.float32)
    entropy = -(share * np.log(np.maximum(share, 1e-9))).sum(axis=1)
    spread = np.column_stack([20 * (share * share).sum(axis=1), 10 * share.max(axis=1), entropy])
    return np.concatenate([8 * np.sqrt(share), spread.astype(np.float32)], axis=1), count


@dataclass
class Network:
    w1: np.ndarray  # encoder [FEATURES, hidden]
    b1: np.ndarray
    v: np.ndarray  # attention [hidden, gates]
    u: np.ndarray  # its gate
    w: np.ndarray
    c: np.ndarray  # output [hidden]
    d: np.ndarray
    threshold: float = 0.5

    NAMES = ("w1", "b1", "v", "u", "w", "c", "d")

    @staticmethod
    def start(hidden: int, gates: int, rng: np.random.Generator) -> Network:
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return Network(draw(FEATURES, hidden), np.zeros(hidden, np.float32), draw(hidden, gates), draw(hidden, gates), draw(gates), draw(hidden), np.zeros(1, np.float32))

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        """count: passages of each document, all at least 1."""
        start = np.cumsum(count) - count
        h = np.tanh(x @ self.w1 + self.b1)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), count))
        alpha = e / np.repeat(np.add.reduceat(e, start), count)
        z = np.add.reduceat(alpha[:, None] * h, start, axis=0)
        return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": 1 / (1 + np.exp(-(z @ self.c + self.d))), "start": start}

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        f = self.forward(x, count)
        h, t, g, alpha = f["h"], f["t"], f["g"], f["alpha"]
        ds = (f["p"] - y) * weight / len(y)
        dz = np.repeat(ds[:, None] * self.c, count, axis=0)
        da = (h * dz).sum(axis=1)
        de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, f["start"]), count))
        dt, dg = de[:, None] * self.w * g * (1 - t * t), de[:, None] * self.w * t * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        return {"w1": x.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def train(texts: list[str], labels: list[int], size: int = 400, hidden: int = 32, gates: int = 16, epochs: int = 12, rate: float = 3e-3, decay: float = 1e-4, kept: float = 0.99, seed: int = 5) -> Network:
    """Fit by Adam on four fifths; the threshold is the highest, up to 0.5, at which the share kept of the good texts of the last fifth passes."""
    rng = np.random.default_rng(seed)
    net = Network.start(hidden, gates, rng)
    coded = [encode(part, size) for part in slices(pa.array(texts, pa.large_string()))]
    x, count = (np.concatenate([c[i] for c in coded]) for i in (0, 1))
    at = np.cumsum(count) - count
    usable = np.flatnonzero(count > 0)
    y = np.array(labels, np.float32)
    usable = rng.permutation(usable)
    hold, fit = usable[: len(usable) // 5], usable[len(usable) // 5 :]
    if not len(fit):
        return net
    share = y[fit].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    rows_of = lambda docs: np.concatenate([np.arange(at[i], at[i] + count[i]) for i in docs])
    m, s, n = {k: 0.0 for k in Network.NAMES}, {k: 0.0 for k in Network.NAMES}, 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), 64):
            docs = order[i : i + 64]
            grads = net.gradients(x[rows_of(docs)], count[docs], y[docs], weight[docs])
            n += 1
            for k, grad in grads.items():
                value = getattr(net, k)
                grad = grad + decay * value
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                value -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    good = hold[y[hold] == 1]
    if len(good):
        net.threshold = float(min(0.5, np.quantile(net.forward(x[rows_of(good)], count[good])["p"], 1 - kept)))
    return net


def score(column: pa.Array, net: Network, size: int) -> list[dict]:
    x, count = encode(column, size)
    some = np.flatnonzero(count > 0)
    out: list[dict] = [{"score": None, "keep": False, "passages": 0, "top_passage": None, "top_weight": None} for _ in range(len(column))]
    if len(some):
        f = net.forward(x, count[some])
        for i, p, start, n in zip(some.tolist(), f["p"].tolist(), f["start"].tolist(), count[some].tolist()):
            alpha = f["alpha"][start : start + n]
            top = int(np.argmax(alpha))
            out[i] = {"score": p, "keep": p >= net.threshold, "passages": n, "top_passage": top, "top_weight": float(alpha[top])}
    return out


def score_udf(net: Network, size: int):
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out = []
            for part in slices(batch, 1 << 19):
                out += score(part, net, size)
            yield pa.array(out, RESULT)

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT_DDL)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 3000, size: int = 400, train_bytes: int = 16_000_000, broadcast_bytes: int = BROADCAST_BYTES, **options) -> Network:
    """Train on about train_docs labelled documents, or as many whole ones as hold about train_bytes if those are fewer, picked by the hash of
    doc_id (these are all that is bounded; scoring covers every row). Labels other than 0 and 1 are left out, of several the least counts."""
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null and text <> ''")
    total, mean = marks.count(), src.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    spread = 1 << 30
    rows = min(train_docs, train_bytes / mean)
    picked = marks.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(spread)) < int(min(1, rows / max(1, total)) * spread)).limit(2 * train_docs)
    found = src.join(small_side(picked, 2 * train_docs, 32, broadcast_bytes), "doc_id").orderBy("doc_id", "text").limit(4 * train_docs).collect()
    net = train([r["text"] for r in found], [r["y"] for r in found], size, **options)
    del found
    trim()
    return net


def quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """One row for each row of docs: (doc_id, score, keep, passages, top_passage, top_weight).

    Every passage of size bytes is encoded; gated attention weighs the encodings and the weighted mean is scored. top_passage is
    the passage (from 0) with the greatest weight, the first of equal ones. The network travels with the task (about 10 000
    numbers) and texts are read once, in place: no shuffle. A document's passages are scored together, however many.

    Null and empty texts: score, top_passage and top_weight null, keep false, passages 0. Repeated rows and null ids are scored
    like others, ids of any type; an empty table gives no rows; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(id_column(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.select("doc_id", score_udf(net, size)("text").alias("r")).select("doc_id", "r.*")
