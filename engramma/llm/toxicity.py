"""Toxicity by weak supervision.

Many voters look at a document: lexicons of whole words (surest and other), of word beginnings of three lengths and of
word pairs, each mined from labelled rows by a significance test; a fixed list of insults; and patterns (several hits,
dense hits, hits near each other, hits beside words of address, shouting, many hits). A generative label model of the
votes given the hidden class is fitted by expectation maximisation. It estimates every voter's accuracy and the
correlations: once the class is known a voter may still depend on one other, and the tree of such dependences with the
largest conditional mutual information (those beyond chance only) is part of the model, P(votes | class) being the
product of P(vote | its parent's vote, class). The posteriors are the labels of a linear classifier over the votes and
hit counts, and that classifier scores every whole text.

Everything is fitted on a bounded sample of labelled rows; the lexicons are counted by Spark over that sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, U, buffers, frugal, mix, pieces, shingles, span_hashes, spans
from engramma.llm.learn import held_out, labelled_sample
from engramma.llm.quality import digest
from engramma.storage import written

#: Labelled rows used, at most.
TRAIN_ROWS = 12_000
THRESHOLD = 0.7
#: Share of toxic documents, of those that hold it, above which a word may enter a lexicon.
PURITY = 0.97
PREFIX_BYTES = (4, 5, 6)
#: Kinds of lexicons, by number: whole words, their beginnings, pairs of neighbours.
KINDS = ("words", *(f"beginnings {n}" for n in PREFIX_BYTES), "pairs")
#: Common insults, and words of address.
INSULTS = "idiot moron stupid pathetic trash loser scum clown worthless disgusting garbage dumb fool jerk".split()
ADDRESS = "you your are is this that they these those he she".split()

#: Word bytes: digits, letters and everything outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _hash_list(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(span_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Hashes by kind: of whole words, of their beginnings (0 where a word is not longer), of each word with the one before (0 for a row's first)."""
    out = [span_hashes(data, starts, ends)]
    for n in PREFIX_BYTES:
        h = mix(span_hashes(data, starts, np.minimum(starts + n, ends)) + U(n))
        out.append(np.where(ends - starts > n, h, U(0)))
    pair = np.zeros(len(starts), U)
    pair[1:] = np.where(row[1:] == row[:-1], mix(out[0][:-1] * U(0x9E3779B97F4A7C15) + out[0][1:]), U(0))
    return [*out, pair]


def _member(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    i = np.searchsorted(sorted_set, h)
    return sorted_set[np.minimum(i, len(sorted_set) - 1)] == h


def without_copies(sample: DataFrame, rounds: int = 3) -> DataFrame:
    """One row of each group that agrees in a min-hash of five-word shingles, ``rounds`` times over.

    Copies of one document are no independent evidence for its words.
    """

    @frugal
    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(0))
            found = []
            for a, z in pieces(offs):
                d = ASCII_LOWER[data[offs[a] : offs[z]]]
                starts, ends, first = spans(d, offs[a : z + 1] - offs[a], _WORD)
                h, at = shingles(span_hashes(d, starts, ends), first, 5)
                for i in range(z - a):
                    s = h[at[i] : at[i + 1]]
                    found.append([int(mix(s ^ U(7919 * (k + 1))).min()) >> 1 if len(s) else 0 for k in range(rounds)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k] for f in found], pa.int64()) for k in range(rounds))], ["text", "y", *(f"m{k}" for k in range(rounds))])

    marks = [f"m{k}" for k in range(rounds)]
    out = sample.mapInArrow(run, "text string, y int, " + ", ".join(f"{m} bigint" for m in marks))
    for m in marks:
        out = out.groupBy(m).agg(F.min(F.struct("text", "y", *(x for x in marks if x != m))).alias("r")).select(m, "r.*")
    return out.select("text", "y")


@dataclass
class Lexicon:
    """Sorted hashes of each kind's entries; ``sure`` are the whole words whose evidence is twice what the test asks for."""

    kinds: list[np.ndarray]
    sure: np.ndarray


def mine(sample: DataFrame) -> Lexicon:
    """Words, beginnings and pairs that toxic documents hold too often for chance: all that pass the test.

    The test is binomial against the sample's toxic share, with the number of candidates as correction. The sample is
    bounded, and so is what comes to the driver: 16 bytes an entry.
    """

    @frugal
    def run(batches):
        for b in batches:
            y = b.column(1).to_numpy()
            data, offs = buffers(b.column(0))
            for a, z in pieces(offs):
                d = ASCII_LOWER[data[offs[a] : offs[z]]]
                starts, ends, first = spans(d, offs[a : z + 1] - offs[a], _WORD)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(z - a), np.diff(first))
                for kind, k in enumerate(_keys(d, starts, ends, row)):
                    held = np.unique(np.stack([row[k != 0].astype(U), k[k != 0]], 1), axis=0)
                    t = y[a:z][held[:, 0].astype(np.int64)]
                    h, inv = np.unique(held[:, 1], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(np.bincount(inv, weights=t, minlength=len(h)).astype(np.int64)), pa.array(np.bincount(inv, minlength=len(h)).astype(np.int64))], ["kind", "h", "tox", "n"])

    nothing = np.zeros(0, U)
    base = sample.agg(F.avg("y").alias("p"), F.count("*").alias("docs")).first()
    if not base["docs"] or not 0 < base["p"] < 1:
        return Lexicon([nothing] * len(KINDS), nothing)
    p = base["p"]
    counts = sample.mapInArrow(run, "kind int, h bigint, tox bigint, n bigint").groupBy("kind", "h").agg(F.sum("tox").alias("tox"), F.sum("n").alias("n"))
    counts = written(counts.where("n >= 2 and tox >= 2"), "toxicity-counts")
    asked = math.log(2 * max(1, counts.count()))
    # log of the Chernoff bound on the tail at tox of n
    rate = F.col("tox") / F.col("n")
    kl = F.col("n") * (rate * F.log(rate / p) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - p))).otherwise(0))
    found = counts.where((rate > PURITY) & (kl > asked)).select("kind", "h", (kl > 2 * asked).alias("sure")).collect()
    entries = lambda keep: np.sort(np.array([r["h"] for r in found if keep(r)], np.int64).view(U))
    return Lexicon([entries(lambda r, k=k: r["kind"] == k) for k in range(len(KINDS))], entries(lambda r: r["kind"] == 0 and r["sure"]))


VOTERS = ["surest words", "other words", *KINDS[1:], "insults", "several", "dense", "near", "address", "shouted", "repeated"]
COUNTS = 5


def votes(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Votes (1 toxic, -1 clean, 0 abstains) of every voter and the hit counts of every text."""
    data, offs = buffers(texts)
    insults, address = _hash_list(INSULTS), _hash_list(ADDRESS)
    out_v, out_c = [np.zeros((0, len(VOTERS)), np.int8)], [np.zeros((0, COUNTS))]
    for a, z in pieces(offs):
        n, raw = z - a, data[offs[a] : offs[z]]
        d = ASCII_LOWER[raw]
        starts, ends, first = spans(d, offs[a : z + 1] - offs[a], _WORD)
        words = np.diff(first)
        row = np.repeat(np.arange(n), words)
        v = np.zeros((n, len(VOTERS)), np.int8)
        if not len(starts):
            out_v.append(np.full_like(v, -1))
            out_c.append(np.zeros((n, COUNTS)))
            continue
        keys = _keys(d, starts, ends, row)
        of_kind = [_member(k, known) & (k != 0) for k, known in zip(keys, lexicon.kinds, strict=True)]
        sure, listed = _member(keys[0], lexicon.sure), _member(keys[0], insults)
        whole, begun, pairs = of_kind[0], np.logical_or.reduce(of_kind[1:-1]), of_kind[-1]
        hit = np.flatnonzero(whole | begun | listed)
        total, paired = np.bincount(row[hit], minlength=n), np.bincount(row[pairs], minlength=n)
        pos = hit - first[row[hit]]
        near = hit[np.flatnonzero((np.diff(pos) <= 25) & (np.diff(row[hit]) == 0))] if len(hit) > 1 else hit[:0]
        beside = hit[hit > 0]
        beside = beside[_member(keys[0][beside - 1], address) & (row[beside] == row[beside - 1])]
        upper = lambda at: (raw[at] >= 65) & (raw[at] <= 90)
        shouted = hit[upper(starts[hit]) & upper(ends[hit] - 1)]
        at_words = {"surest words": sure, "other words": whole & ~sure, "insults": listed, "near": near, "address": beside, "shouted": shouted} | dict(zip(KINDS[1:], of_kind[1:], strict=True))
        for name, at in at_words.items():
            v[row[at], VOTERS.index(name)] = 1
        for name, yes in (("several", total >= 2), ("dense", total * 100 >= np.maximum(words, 1)), ("repeated", total >= 4)):
            v[yes, VOTERS.index(name)] = 1
        quiet = total == 0
        for name in ("several", "dense", "repeated", "insults", "surest words"):
            v[quiet, VOTERS.index(name)] = -1
        v[paired == 0, VOTERS.index("pairs")] = -1
        out_v.append(v)
        begun_only = np.bincount(row[begun & ~whole], minlength=n)
        out_c.append(np.stack([np.log1p(total), np.log1p(begun_only), np.log1p(paired), np.minimum(1, 20 * total / np.maximum(words, 1)), np.log1p(words) / 10], 1))
    return np.concatenate(out_v), np.concatenate(out_c)


@dataclass
class LabelModel:
    """P(toxic), the voter that each voter depends on (-1: none), P(vote | parent's vote, class), and the conditional mutual information of pairs that the tree was chosen by."""

    prior: float
    parent: np.ndarray
    table: np.ndarray  # class, voter, the parent's vote + 1, vote + 1
    mutual: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        j = np.arange(v.shape[1])
        llr = np.log(self.table[1] / self.table[0])[j, _parent_votes(v, self.parent) + 1, v + 1]
        z = math.log(self.prior / (1 - self.prior)) + llr.sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parent_votes(v: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Each voter's parent's vote; a voter without one has a parent that always abstains."""
    return np.where(parent >= 0, v[:, np.maximum(parent, 0)], 0)


def _estimate(v: np.ndarray, p: np.ndarray, parent: np.ndarray, mutual: np.ndarray) -> LabelModel:
    """The parameters that fit the votes best if row i is toxic with probability ``p[i]``; sparse cells lean on the voter's own shares."""
    up = _parent_votes(v, parent)
    table = np.empty((2, v.shape[1], 3, 3))
    for c, w in ((0, 1 - p), (1, p)):
        own = np.stack([(w @ (v == k - 1) + 0.5) / (w.sum() + 1.5) for k in range(3)], 1)
        for a in range(3):
            seen = w[:, None] * (up == a - 1)
            n = seen.sum(0)
            for k in range(3):
                table[c, :, a, k] = ((seen * (v == k - 1)).sum(0) + 2 * own[:, k]) / (n + 2)
    return LabelModel(float(np.clip((p.sum() + 1) / (len(p) + 2), 0.01, 0.5)), parent, table, mutual)


def _mutual_information(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters once the class is known, in nats."""
    m = v.shape[1]
    out = np.zeros((m, m))
    onehot = np.stack([v == k - 1 for k in range(3)], 2).astype(float).reshape(len(v), 3 * m)
    for w in (1 - p, p):
        if w.sum() > 1e-9:
            joint = ((onehot * w[:, None]).T @ onehot / w.sum()).reshape(m, 3, m, 3)
            own = np.einsum("jaja->ja", joint)
            free = own[:, :, None, None] * own[None, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(joint > 0, joint * np.log(joint / free), 0)
            out += w.mean() * part.sum((1, 3))
    np.fill_diagonal(out, 0)
    return out


def dependence_tree(mutual: np.ndarray, rows: int) -> np.ndarray:
    """Parents in the spanning forest of largest mutual information; a pair counts if 2 * rows * information is beyond chance (0.999 of chi-square with eight degrees)."""
    m = len(mutual)
    parent = np.full(m, -1)
    best, inside = np.full(m, -1.0), np.zeros(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(inside, -2.0, best)))
        inside[j] = True
        if 2 * rows * best[j] < 26.12:
            parent[j] = -1
        closer = ~inside & (mutual[j] > best)
        best[closer], parent[closer] = mutual[j][closer], j
    return parent


def fit_label_model(v: np.ndarray, rounds: int = 30) -> LabelModel:
    """EM from the majority vote: with voters independent given the class, then twice with the tree of dependences that the posteriors show."""
    m = v.shape[1]
    p = np.where(v.astype(int).sum(1) > 0, 0.95, 0.05)
    parent, mutual = np.full(m, -1), np.zeros((m, m))
    for phase in range(3):
        if phase:
            mutual = _mutual_information(v, p)
            parent = dependence_tree(mutual, len(v))
        for _ in range(rounds):
            model = _estimate(v, p, parent, mutual)
            new = model.posterior(v)
            done = np.abs(new - p).max(initial=0) < 1e-4
            p = new
            if done:
                break
    return model


@dataclass
class Linear:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        x = design(*votes(texts, self.lexicon))
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w + self.b, -30, 30)))


def design(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([v == 1, v == -1, c], 1).astype(float)


def fit_linear(x: np.ndarray, p: np.ndarray, steps: int = 400, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum."""
    mean, scale = x.mean(0), x.std(0) + 0.05
    z = (x - mean) / scale
    w, b, mw, mb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - p) / len(p)
        mw, mb = 0.9 * mw + z.T @ d + decay * w, 0.9 * mb + d.sum()
        w, b = w - rate * mw, b - rate * mb
    return mean, scale, w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, residue: int = 1, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """The classifier of a bounded sample of labelled rows; votes and counts of those rows (about 100 bytes each) come to the driver.

    Without labelled rows there is no mined lexicon and no classifier: scores are 0.
    """
    sample = labelled_sample(docs, labels, label, modulus, residue, bound, id_col, text_col)
    lexicon = mine(written(without_copies(sample), "toxicity-sample"))

    @frugal
    def run(batches):
        for b in batches:
            v, c = votes(b.column(0), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.int8())), pa.array(list(c), pa.list_(pa.float64()))], ["v", "c"])

    t = sample.mapInArrow(run, "v array<tinyint>, c array<double>").toArrow()
    width = 2 * len(VOTERS) + COUNTS
    if not t.num_rows:
        return Linear(lexicon, np.zeros(width), np.ones(width), np.zeros(width), -30.0)
    v = np.array(t["v"].to_pylist(), np.int8)
    c = np.array(t["c"].to_pylist())
    order = np.lexsort((*c.T, *v.T))  # the order of the rows must not matter
    v, c = v[order], c[order]
    posterior = fit_label_model(v).posterior(v)
    return Linear(lexicon, *fit_linear(design(v, c), posterior))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, modulus: int = 3, residue: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in columns of these names only.

    Nothing but the text enters a score: null is an empty text, rows that repeat score alike, a score of exactly
    ``threshold`` is predicted 1. An id with several labels counts with the least, null labels and ids not at all.
    Extra columns are not read, whatever their names; an empty table gives no rows.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, modulus=modulus, residue=residue)
    return digest(docs, model, held_out(F.col(id_col), modulus, residue), threshold, id_col, text_col)
