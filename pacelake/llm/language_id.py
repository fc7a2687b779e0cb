"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

A text is the frequencies of its hashed byte 2-, 3- and 4-grams (case of Latin letters folded, everything in
ASCII but letters taken as a space). A linear softmax model predicts the family; within it, one linear support
vector machine for each pair of languages votes. All models are linear in the frequencies, so a text of any
length is scored in one pass over its bytes.

Models are fitted on at most `max_rows` rows with an id, text and language, each (id, text, language) once: languages
take turns, each with its rows in order of a hash of id and text, so a frequent language leaves room for the others and
reruns choose the same rows. Everything else covers whole texts of all rows. Null texts and texts without a letter are `und` with score 0,
as is everything where there is nothing to learn from. Repeated rows get the same answer; rows with a null id
may be predicted but are not learned from; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

BITS, MAX_ROWS = 13, 3000
#: Language families.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and its row. Grams do not cross texts."""
    x = _FOLD[data]
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    x = np.where(accent, x + np.uint8(32), x)
    blank = np.zeros(len(x), bool)
    if len(x):
        start = np.zeros(len(x) + 1, bool)
        start[at] = True
        blank[1:] = (x[1:] == 32) & (x[:-1] == 32) & ~start[1:-1]
    x = x[~blank].astype(np.uint32)
    kept = np.concatenate([[0], np.cumsum(~blank)])[at]
    row = np.repeat(np.arange(len(at) - 1), np.diff(kept))
    out, rows, key = [], [], x
    for n in (2, 3, 4):
        if len(x) < n:
            break
        key = key[: len(x) - n + 1] | (x[n - 1 :] << np.uint32(8 * (n - 1)))
        inside = row[n - 1 :] == row[: len(x) - n + 1]
        out.append(((key[inside] + np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
        rows.append(row[: len(x) - n + 1][inside])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # a column for each family, then for each pair
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score in [0, 1] for rows of margins."""
        nf = len(self.families)
        e = np.exp(margins[:, :nf] - margins[:, :nf].max(1, keepdims=True))
        p_family = e / e.sum(1, keepdims=True)
        best = p_family.argmax(1)
        votes = np.zeros((len(margins), len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(2 * margins[:, nf + k], -50, 50)))
            votes[:, i] += (p >= 0.5) + 1e-3 * p
            votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
        of = np.array([self.families.index(_family(x)) for x in self.langs])
        votes = np.where(of == best[:, None], votes, -1)
        lang = votes.argmax(1)
        size = np.bincount(of, minlength=nf)[best]
        share = np.where(size > 1, np.clip(votes[np.arange(len(votes)), lang] / np.maximum(size - 1, 1), 0, 1), 1)
        return lang, np.clip(p_family[np.arange(len(best)), best] * share, 0, 1)


def _family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def _hinge(x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with class-balanced hinge loss by averaged subgradient steps over all rows."""
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) / len(y)
    w, b, mean_w, mean_b = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for t in range(1, steps + 1):
        miss = np.where(y * (x @ w + b) < 1, y * share, 0).astype(np.float32)
        rate = 1 / (penalty * (t + 100))
        w = (1 - rate * penalty) * w + rate * (miss @ x)
        b += 0.01 * rate * penalty * float(miss.sum()) * 100
        if t > steps // 2:
            mean_w += w / (steps - steps // 2)
            mean_b += b / (steps - steps // 2)
    return mean_w, mean_b


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """A model from rows of gram frequencies and their languages."""
    names = sorted(set(langs))
    if not names:
        return None
    lang = np.array([names.index(v) for v in langs])
    families = sorted({_family(v) for v in names})
    of = np.array([families.index(_family(v)) for v in names])
    mean = x.mean(0)
    scale = 1 / np.sqrt(mean + 1e-5)  # common grams weigh less
    z = x * scale
    y = of[lang]
    w, b = np.zeros((z.shape[1], len(families)), np.float32), np.zeros(len(families))
    weight = (1 / np.bincount(y, minlength=len(families)).clip(1)[y]) / len(families)
    for _ in range(300 if len(families) > 1 else 0):
        e = np.exp((m := z @ w + b) - m.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = (p * weight[:, None]).astype(np.float32)
        w -= 20 * (z.T @ g + 1e-6 * w)
        b -= 0.2 * g.sum(0)
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if of[i] == of[j]]
    columns, biases = [w], list(b)
    for i, j in pairs:
        rows = (lang == i) | (lang == j)
        v, c = _hinge(z[rows], np.where(lang[rows] == i, 1.0, -1.0))
        columns.append(v[:, None])
        biases.append(c)
    return Model(names, families, pairs, (np.concatenate(columns, 1) * scale[:, None]).astype(np.float32), np.array(biases))


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """Sparse gram counts of each text: (label, buckets as 16-bit, counts as 32-bit values)."""

    def run(batches):
        for batch in batches:
            for i, j, data, at in tx.blocks(batch.column(1)):
                k, row = grams(data, at, bits)
                cell, n = np.unique(row.astype(np.int64) << bits | k, return_counts=True)
                ends = np.searchsorted(cell >> bits, np.arange(j - i + 1))
                parts = [(cell[a:b] & ((1 << bits) - 1), n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"label": batch.column(0).slice(i, j - i), "k": pa.array([p[0].astype(np.uint16).tobytes() for p in parts], pa.binary()), "n": pa.array([p[1].astype(np.uint32).tobytes() for p in parts], pa.binary())})

    return docs.mapInArrow(run, "label string, k binary, n binary")


def train(labelled: DataFrame, doc_id: str, text: str, lang: str, max_rows: int = MAX_ROWS, bits: int = BITS) -> Model | None:
    """Fit on at most `max_rows` rows of `labelled`."""
    rows = labelled.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"))
    # Names of rows only: a label and a hash. Each label keeps its first ones, and labels take turns.
    turn = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    named = rows.select("label", "h").distinct().withColumn("turn", turn).where(F.col("turn") <= max_rows)
    chosen = named.orderBy("turn", "label").limit(max_rows).select(F.col("label").alias("l"), F.col("h").alias("g"))
    held = rows.join(F.broadcast(chosen), (F.col("label") == F.col("l")) & (F.col("h") == F.col("g")), "left_semi").dropDuplicates(["label", "h"])
    sample = sorted(_counted(held.select("label", "text"), bits).collect())
    if not sample:
        return None
    x = np.zeros((len(sample), 1 << bits), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r.k, np.uint16)] = np.frombuffer(r.n, np.uint32)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    return fit(x, [r.label for r in sample])


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches):
        for batch in batches:
            for i, j, data, at in tx.blocks(batch.column(1)):
                n = j - i
                names, score = np.full(n, "und", object), np.zeros(n)
                if model is not None:
                    k, row = grams(data, at, bits)
                    margins = np.stack([np.bincount(row, model.weights[k, c], n) for c in range(model.weights.shape[1])], 1)
                    margins = margins / np.maximum(np.bincount(row, minlength=n), 1)[:, None] + model.bias
                    best, score = model.predict(margins)
                    names = np.array(model.langs, object)[best]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, n), "letters": batch.column(2).slice(i, n), "lang": pa.array(names, pa.string()), "p": pa.array(score, pa.float64())})

    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), has.alias("letters")).mapInArrow(run, "doc_id long, letters boolean, lang string, p double")
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letters") & (F.col("lang") != "und"), F.col("p")).otherwise(0.0).alias("score"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~tx.held_out("doc_id")), "doc_id", "text", "lang")
    out = identify(docs, model)
    return out.select("doc_id", tx.held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
