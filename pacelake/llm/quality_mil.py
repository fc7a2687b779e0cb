"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `span` words. Each passage is encoded from its format (frequencies of pairs
of character classes, word length, repeated words), a tanh layer learns the encoding, gated attention weights
passages, and the weighted representation is scored. Only document labels are needed; encoder, attention and
scorer are trained together, by Adam over mini-batches of documents.

The model is fitted on at most `max_rows` labelled documents, chosen by hash of the id, one row of an id (the one
whose text comes first), and of each on at most `max_passages` passages, evenly spread; so what reaches the driver is
bounded. All passages of all rows are scored. No word is looked at as such, only its form. A text without words (null, empty, blank) is one passage of zeros. Without labels of both
kinds everything scores the share of label 1 (0.5 without labels). Labels that are null are ignored; where an
id has several labels the greatest counts. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

SPAN, MAX_ROWS, MAX_PASSAGES, WIDTH, THRESHOLD = 50, 4000, 100, 24, 0.7

#: Classes of bytes. Letters small, capital, digits, space, newline, sentence marks, other marks, symbols, beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[list(b".,;:?'\"!()-")] = 5
_CLASS[list(b"#*$%&|<>@^~_=+/\\{}[]`")] = 7
_N = 9
FEATURES = _N * _N + 4


def passages(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and its row; each text has one passage at least."""
    ws, we, row = tx.words(data, at)
    n = len(at) - 1
    counts = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(row)) - first[row]
    per = np.maximum(1, -(-counts // span))
    base = np.concatenate([[0], np.cumsum(per)])
    bag = base[row] + place // span
    total = int(base[-1])
    x = np.zeros((total, FEATURES), np.float32)
    bag_row = np.repeat(np.arange(n), per)
    if not len(ws):
        return x, bag_row
    heads = place % span == 0
    owner = np.zeros(len(data), np.int64)
    owner[ws[heads]] = 1
    owner = np.cumsum(owner) - 1  # passages with words, in turn
    ids = bag[heads]
    c = _CLASS[data].astype(np.int64)
    ok = (owner[1:] == owner[:-1]) & (owner[1:] >= 0)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    ok &= ~edge[1 : len(data)]
    pair = (owner[:-1] * (_N * _N) + c[:-1] * _N + c[1:])[ok]
    table = np.bincount(pair, minlength=len(ids) * _N * _N).reshape(-1, _N * _N)
    x[ids, : _N * _N] = table / np.maximum(table.sum(1, keepdims=True), 1)
    size = np.bincount(bag, minlength=total).clip(1)
    x[:, -4] = np.bincount(bag, we - ws, total) / size / 10
    h = tx.Hashes(data).of(ws, we)
    order = np.lexsort((h, bag))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (bag[order][1:] != bag[order][:-1])
    x[:, -3] = np.bincount(bag[order][new], minlength=total) / size
    x[:, -2] = size / span
    x[ids, -1] = 1
    return x, bag_row


@dataclass
class Model:
    """Gated attention over encoded passages. `p` holds the parameters by name."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    flat: float | None = None

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        start = np.searchsorted(bag, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        doc = np.add.reduceat(a[:, None] * h, start)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "doc": doc, "y": 1 / (1 + np.exp(-np.clip(doc @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.flat) if self.flat is not None else self.forward(x, bag, n)["y"]

    def gradients(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(label)
        f = self.forward(x, bag, n)
        err = (f["y"] - label) / n
        d_doc = np.outer(err, p["c"])
        d_h = f["a"][:, None] * d_doc[bag]
        d_a = (d_doc[bag] * f["h"]).sum(1)
        start = np.searchsorted(bag, np.arange(n))
        d_e = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, start)[bag])
        d_tg = np.outer(d_e, p["w"])
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = d_h + d_t @ p["V"].T + d_g @ p["U"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ d_in, "b": d_in.sum(0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_e, "c": f["doc"].T @ err, "d": np.array(err.sum())}


def fit(bags: list[np.ndarray], labels: np.ndarray, width: int = WIDTH, epochs: int = 25, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Model:
    """A model from the passages and the label of each document."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        return Model({}, np.zeros(FEATURES), np.ones(FEATURES), share)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shape = {"W": (FEATURES, width), "b": (width,), "V": (width, width), "U": (width, width), "w": (width,), "c": (width,), "d": ()}
    p = {k: np.asarray(rng.normal(0, (s[0] if s else 1) ** -0.5, s) if k not in "bd" else np.zeros(s)) for k, s in shape.items()}
    model = Model(p, every.mean(0), every.std(0) + 1e-2)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            grad = model.gradients(np.concatenate([bags[i] for i in pick]), bag, labels[pick])
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in grad.items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES, span: int = SPAN) -> Model:
    """Fit on the documents of `docs` that `labels` marks, the `max_rows` with the smallest hash of the id at most."""
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("i")).agg(F.max(label).cast("int").alias("y"))
    marked = marked.join(docs.select(F.col(doc_id).cast("long").alias("i")), "i", "left_semi").orderBy(F.xxhash64(F.col("i").cast("string"))).limit(max_rows)

    def run(batches):
        for batch in batches:
            for i, j, data, at in tx.blocks(batch.column(1)):
                x, row = passages(data, at, span)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                some = [np.unique(np.linspace(a, b - 1, min(b - a, max_passages)).astype(np.int64)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"y": batch.column(0).slice(i, j - i), "x": pa.array([x[k].astype(np.float16).tobytes() for k in some], pa.binary())})

    one = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).join(F.broadcast(marked), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    rows = one.orderBy(F.xxhash64(F.col("i").cast("string"))).select("y", "t").mapInArrow(run, "y int, x binary").collect()
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return fit(bags, np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, score) for each row."""

    def run(batches):
        for batch in batches:
            for i, j, data, at in tx.blocks(batch.column(1)):
                x, row = passages(data, at, span)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "score": pa.array(model.score(x, row, j - i), pa.float64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs.where(~tx.held_out("doc_id")), labels.where(~tx.held_out("doc_id")))
    return score(docs, model).select("doc_id", tx.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
