"""Quality by attention over passages.

A document is a bag of passages. Every passage is encoded (features, then a small tanh layer); a gated attention
network gives each passage a weight, the weighted mean represents the document, and a logistic unit scores it. All
weights are learned together from document labels, on a bounded sample of labelled rows; scoring reads whole texts,
passage by passage, wherever the documents lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramma.llm.bytekit import buffers, frugal, pieces
from engramma.llm.learn import FEATURES, held_out, labelled_sample, passages

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 3000
THRESHOLD = 0.3
HIDDEN, GATE, STEPS, RATE, SEED = 16, 8, 150, 0.03, 5


@dataclass
class Attention:
    """Encoder e, gates v and u with weights w, output c; inputs are standardised by mean and scale."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of the bags whose passages are rows ``at[i]`` to ``at[i+1]`` of ``x``; no bag is empty."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        e = np.tanh(x @ p["e"] + p["eb"])
        tv, su = np.tanh(e @ p["v"]), 1 / (1 + np.exp(-(e @ p["u"])))
        s = (tv * su) @ p["w"]
        n = np.diff(at)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at[:-1]), n))
        a = s / np.repeat(np.add.reduceat(s, at[:-1]), n)
        z = np.add.reduceat(a[:, None] * e, at[:-1], axis=0)
        return z @ p["c"] + p["cb"][0], {"x": x, "e": e, "tv": tv, "su": su, "a": a, "z": z, "n": n}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of all rows; one without passages is a single passage of zeros."""
        n = np.diff(at)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            x = np.insert(x, at[empty], 0, axis=0)
            at = np.concatenate([[0], np.cumsum(np.maximum(n, 1))])
        logit, _ = self.bags(x, at)
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        """Scores of a text column; null and empty texts are one empty passage."""
        return self.score(*features(texts))


def gradients(m: Attention, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the mean log loss by each parameter."""
    p = m.p
    logit, k = m.bags(x, at)
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    rows = np.repeat(np.arange(len(y)), k["n"])
    dz = d[:, None] * p["c"]
    de = k["a"][:, None] * dz[rows]
    da = (dz[rows] * k["e"]).sum(1)
    ds = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, at[:-1]), k["n"]))
    gate = ds[:, None] * p["w"]
    dtv = gate * k["su"] * (1 - k["tv"] ** 2)
    dsu = gate * k["tv"] * k["su"] * (1 - k["su"])
    de += dtv @ p["v"].T + dsu @ p["u"].T
    dh = de * (1 - k["e"] ** 2)
    return {
        "c": k["z"].T @ d,
        "cb": np.array([d.sum()]),
        "w": (k["tv"] * k["su"]).T @ ds,
        "v": k["e"].T @ dtv,
        "u": k["e"].T @ dsu,
        "e": k["x"].T @ dh,
        "eb": dh.sum(0),
    }


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Attention:
    """Full-batch Adam on the log loss with a small weight decay. Bags must not be empty."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    r = np.random.RandomState(seed)
    m = Attention(x.mean(0), x.std(0) + 1e-3, {
        "e": r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "eb": np.zeros(HIDDEN),
        "v": r.normal(0, 0.3, (HIDDEN, GATE)), "u": r.normal(0, 0.3, (HIDDEN, GATE)), "w": r.normal(0, 0.3, GATE),
        "c": r.normal(0, 0.3, HIDDEN), "cb": np.zeros(1),
    })
    m.mean, m.scale = m.mean.astype(np.float32), m.scale.astype(np.float32)
    m.p = {name: v.astype(np.float32) for name, v in m.p.items()}
    p, mo, ve = m.p, {}, {}
    for t in range(1, steps + 1):
        for name, grad in gradients(m, x, at, y).items():
            grad = grad + 1e-4 * p[name]
            mo[name] = 0.9 * mo.get(name, 0) + 0.1 * grad
            ve[name] = 0.999 * ve.get(name, 0) + 0.001 * grad * grad
            p[name] = (p[name] - RATE * (mo[name] / (1 - 0.9**t)) / (np.sqrt(ve[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = buffers(texts)
    xs, ats, base = [np.zeros((0, FEATURES), np.float32)], [np.zeros(1, np.int64)], 0
    for a, b in pieces(offs):
        x, at = passages(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        xs.append(x)
        ats.append(at[1:] + base)
        base += len(x)
    return np.concatenate(xs), np.concatenate(ats)


def _in_fixed_order(t: pa.Table) -> pa.Table:
    """The sampled rows by length, label and features, so that the order in which they arrive doesn't matter."""
    if not t.num_rows:
        return t
    first = [sum(v[:FEATURES]) for v in t["x"].to_pylist()]
    keys = pa.table({"n": pa.compute.list_value_length(t["x"]), "y": t["y"], "s": pa.array(first, pa.float64())})
    return t.take(pa.compute.sort_indices(keys, [(k, "ascending") for k in ("n", "y", "s")]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, residue: int = 0, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Attention:
    """The model of a bounded sample of labelled rows; the features of those rows, about 100 kB a thousand passages, come to the driver.

    Without labelled rows every score is one half.
    """
    sample = labelled_sample(docs, labels, label, modulus, residue, bound, id_col, text_col)

    @frugal
    def run(batches):
        for b in batches:
            x, at = features(b.column(0))
            bags = [x[at[i] : at[i + 1]].ravel() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.float32())), b.column(1)], ["x", "y"])

    t = _in_fixed_order(sample.mapInArrow(run, "x array<float>, y int").toArrow())
    n = t["x"].combine_chunks()
    lens = pa.compute.list_value_length(n).to_numpy(zero_copy_only=False) // FEATURES if t.num_rows else np.zeros(0, int)
    keep = lens > 0
    if not keep.any():
        p = {"e": np.zeros((FEATURES, HIDDEN)), "eb": np.zeros(HIDDEN), "v": np.zeros((HIDDEN, GATE)), "u": np.zeros((HIDDEN, GATE)), "w": np.zeros(GATE), "c": np.zeros(HIDDEN), "cb": np.zeros(1)}
        return Attention(np.zeros(FEATURES), np.ones(FEATURES), p)
    x = n.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return fit(x, np.concatenate([[0], np.cumsum(lens[keep])]), t["y"].to_numpy()[keep].astype(float))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, modulus: int = 5, residue: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in columns of these names only.

    Nothing but the text enters a score: null and empty texts score as one empty passage, rows that repeat score alike,
    a score of exactly ``threshold`` is predicted 1; texts of any length are read whole. An id with several labels
    counts with the least, null labels and ids not at all. Extra columns are not read, whatever their names; an empty
    table gives no rows.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, modulus=modulus, residue=residue)
    return digest(docs, model, held_out(F.col(id_col), modulus, residue), threshold, id_col, text_col)


def digest(docs: DataFrame, model, out_of_fold: Column, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The scores of ``docs`` in the contract's columns; the text goes in and only the score comes back."""
    slim = docs.select(F.col(id_col).alias("doc_id"), out_of_fold.alias("held_out"), F.col(text_col).cast("string").alias("text"))

    @frugal
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score_texts(b.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    kind = slim.schema["doc_id"].dataType
    out = slim.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows that the classifier does not reject, in the input's columns.

    Null and empty texts are judged as one empty passage; null ids and repeated rows are judged by their texts like any
    other; a score of exactly ``threshold`` stays. Without labelled rows every score is one half. Empty stays empty.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **kw)
    at = docs.columns.index(text_col)

    @frugal
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score_texts(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
