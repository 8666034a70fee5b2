"""What the text classifiers share: the held-out rule, bounded labelled samples and passages of whole texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, NOT_SPACE, U, span_hashes, spans


def held_out(id_col: Column, modulus: int, residue: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is not held out (and never labelled)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == residue, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, residue: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``bound`` labelled ids outside the held-out remainder, chosen by a hash of the id.

    Null labels and ids are left out; an id with several labels counts with the least.
    """
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), modulus, residue))
    y = y.groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(bound)
    return docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(y), F.col("__doc") == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), "y")


CLASSES = 12
_CLASS = np.full(256, 0, np.int64)  # other ASCII
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[list(b" \t")] = 5
_CLASS[list(b"\n\r\x0b\x0c")] = 6
_CLASS[list(b".,;:?'\"()-")] = 7
_CLASS[list(b"!")] = 8
_CLASS[list(b"|")] = 9
_CLASS[list(b"#$%&*+/<=>@^_~\\[]{}`")] = 10
_CLASS[list(range(32)) ] = np.where(np.isin(np.arange(32), [9, 10, 11, 12, 13]), _CLASS[:32], 11)
FEATURES = 24


def passages(data: np.ndarray, offs: np.ndarray, words: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A feature row for each passage of ``words`` white-space words (the last is shorter), and each row's first passage.

    A text without words has no passage. The features are shares of byte classes, lengths and repetitions of words.
    """
    starts, ends, first = spans(data, offs, NOT_SPACE)
    count = np.diff(first)
    per = -(-count // words)
    at = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    n = int(at[-1])
    if not n:
        return np.zeros((0, FEATURES), np.float32), at
    pos = np.arange(len(starts)) - np.repeat(first[:-1], count)
    pid = np.repeat(at[:-1], count) + pos // words
    k = np.bincount(pid, minlength=n).astype(float)
    head = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
    begin, stop = starts[head], np.concatenate([starts[head][1:], [0]])
    stop = np.where(np.isin(np.arange(n), at[1:] - 1), 0, stop)
    last = at[1:][per > 0] - 1
    stop[last] = offs[1:][per > 0]
    lens = stop - begin
    cls = _CLASS[data]
    owner = np.zeros(len(data) + 1, np.int64)
    owner[begin] = 1
    owner = np.cumsum(owner)[:-1] - 1  # bytes before a row's first word count with the passage before
    by = np.bincount(np.maximum(owner, 0) * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
    size = np.maximum(by.sum(1), 1).astype(float)
    wl = (ends - starts).astype(float)
    h = span_hashes(ASCII_LOWER[data], starts, ends)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (pid[1:] == pid[:-1])])
    key = np.sort((pid.astype(U) << U(40)) | (h >> U(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    runs = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
    run_pid = (key[new] >> U(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, run_pid, runs)
    share = lambda m: np.bincount(pid, weights=m, minlength=n) / k
    mean = share(wl)
    first_cls, last_cls = cls[starts], cls[ends - 1]
    f = [
        *(by[:, c] / size for c in range(1, 12)),
        mean / 10,
        np.sqrt(np.maximum(share(wl * wl) - mean * mean, 0)) / 10,
        np.bincount(run_pid, minlength=n) / k,
        share(same),
        top / k,
        share(wl <= 3),
        share(wl >= 12),
        share(first_cls == 2),
        share((first_cls == 2) & (last_cls != 1)),
        share(last_cls == 7),
        share(last_cls >= 8),
        k / words,
        np.log1p(lens) / 10,
    ]
    return np.stack(f, 1).astype(np.float32), at
