"""Token-id output: a content-addressed store of id chunks, with document recipes and a Merkle manifest.

Each document's ids (its tokens and an end id) are cut into chunks where a rolling hash of the last few ids meets a
mask, so equal passages give equal chunks wherever they stand. A chunk is kept once, under its address (160 bits of SHA-256); a
document is a recipe, the list of its chunks' addresses; and the manifest holds a Merkle root for every document, every
recipe file (documents in ascending id order) and the whole store. Reading recomputes every address from the bytes and
every root from the addresses.

Layout of a store folder: ``chunks`` (Parquet: address, ids - little-endian 16-bit words while the vocabulary fits,
else 32-bit), ``recipes`` (Parquet, range-partitioned, at most about ``FILE_ROWS`` documents a file: file, place in it,
ids before it in the file, doc_id, key, n_tokens, addresses, root), ``manifest`` (Parquet: file, first id position,
documents, tokens, root), ``store`` (the root over the files' roots), ``format`` (the vocabulary size, which sets the
width).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramma.llm.bytekit import frugal
from engramma.storage import new_path, remove, written

END_ID = 2
#: A cut falls where the rolling hash has this many zero bits: 256 ids a chunk on average beyond the least.
CUT_BITS, MIN_CHUNK, MAX_CHUNK, ROLL = 8, 64, 2048, 8
#: Documents in a recipe file, and in a subtree of its Merkle tree (a power of two).
FILE_ROWS, SUBTREE = 200_000, 4096
#: Words kept in a worker's cache, about 150 bytes each; it is emptied when full.
CACHE_WORDS = 300_000


#: Words of these letters, lower-cased one by one and stable under NFC, are single pieces for a tokenizer that cuts at non-letters.
_SIMPLE = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Numbers words in the order in which they are first asked for, and remembers the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


#: The normaliser and the pre-tokenizer under which words can be encoded one by one: canonical composition, white space to
#: blanks, lower case; then pieces of letters, single digits and other marks, none with white space, in the byte alphabet.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def encodes_by_word(spec: dict) -> bool:
    """Whether a tokenizer's own description says that the ids of a text are those of its words, split at ASCII white space, in a row.

    It must have the normaliser and pre-tokenizer above, a merge model without dropout, and only special tokens that
    hold ``<|`` and no white space and take none with them.
    """
    marks = all("<|" in t["content"] and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    model = spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback") and model.get("unk_token") is None and model.get("continuing_subword_prefix") is None
    return marks and plain and all(spec.get(k) == v for k, v in _BY_WORD.items())


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never cross ASCII white space, one word at a time through a cache.

    Words are lower-cased A-Z first, as the tokenizer does; those that may hold a special token's string (``<|``) are
    left as they are. Plain letter words go straight to the tokenizer's merge model, everything else through the whole
    tokenizer. A tokenizer whose description is not one that allows this encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        self._reset()
        with open(path, encoding="utf-8") as f:
            self.by_word = encodes_by_word(json.load(f))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.index = _Words()
        self.flat = array("I")
        self.at = array("q", [0])

    def _piece(self, word: str) -> list[int]:
        """The ids of a word for which ``_SIMPLE`` holds."""
        if not word.isascii():
            word = word.lower().encode().decode("latin-1").translate(self.letters)
        return [x.id for x in self.model.tokenize(word)]

    def _learn(self, new: list[bytes]) -> None:
        known, rest = {}, []
        simple, marks = _SIMPLE.fullmatch, {m: self._whole(m.decode()) for m in (b".", b",")}
        for w in new:
            t = w.decode()
            if simple(t):
                known[w] = self._piece(t)
            elif w[-1:] in marks and simple(t[:-1]):
                known[w] = self._piece(t[:-1]) + marks[w[-1:]]
            else:
                rest.append(w)
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                known[w] = e.ids
        for w in new:
            self.flat.extend(known[w])
            self.at.append(len(self.flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the offsets of each text."""
        if not self.by_word:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(each)), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        if len(self.index) > CACHE_WORDS:
            self._reset()
        lists = []
        for t in texts:
            b = t.encode()
            lists.append([w if b"<|" in w else w.lower() for w in b.split()] if b"<|" in b else b.lower().split())
        n_words = np.array([len(ws) for ws in lists], np.int64)
        words = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, int(n_words.sum()))
        new, self.index.new = self.index.new, []
        self._learn(new)
        flat, at = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32), np.frombuffer(self.at, np.int64)
        lens = at[words + 1] - at[words]
        ends = np.cumsum(lens)
        ids = flat[np.repeat(at[words] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        return ids, np.concatenate([[0], ends])[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    return WordEncoder(path)


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last ``ROLL`` ids asks for a cut."""
    n = len(ids)
    if n <= ROLL:  # no hash is full yet
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    for j in range(ROLL):
        h[ROLL:] += g[ROLL - j : n - j] * np.uint64(pow(0xBF58476D1CE4E5B9, j + 1, 2**64))
    return np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1


def cut_points(marks: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the document that takes ``start`` to ``stop`` of a stream.

    No cut comes in a document's first ``MIN_CHUNK`` ids, so the hash never looks back across a document's start.
    """
    ends, last = [], start
    for m in [*marks, stop]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK or m == stop:
            last = m
            ends.append(m)
    return ends


def address_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:20]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 Merkle root; an odd node goes up unpaired, no leaves give the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _dtype(vocab: int) -> str:
    return "<u2" if vocab <= 65536 else "<u4"


_STAGED = "doc_id bigint, key bigint, n_tokens bigint, addresses array<binary>, chunks array<binary>, root binary"


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """A row per document: ids cut into chunks (only those new to the task's batch carry bytes), addresses and root. Null text is empty."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = _dtype(max(enc.vocab_size, end_id + 1))
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = [t or "" for t in part.column(2).to_pylist()]
                ids, offs = enc.encode(texts)
                ids = np.insert(ids, offs[1:], end_id)
                offs = offs + np.arange(len(offs))
                raw, marks = ids.astype(kind), cut_marks(ids)
                upto = np.searchsorted(marks, offs, "right")
                marks = marks.tolist()
                addresses, chunks, roots, seen = [], [], [], set()
                for i in range(len(texts)):
                    at, own, body = int(offs[i]), [], []
                    for end in cut_points([m for m in marks[upto[i] : upto[i + 1]] if m < offs[i + 1]], at, int(offs[i + 1])):
                        piece = raw[at:end].tobytes()
                        address = address_of(piece)
                        own.append(address)
                        body.append(None if address in seen else piece)
                        seen.add(address)
                        at = end
                    addresses.append(own)
                    chunks.append(body)
                    roots.append(merkle_root(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(offs), pa.int64()), pa.array(addresses, pa.list_(pa.binary())), pa.array(chunks, pa.list_(pa.binary())), pa.array(roots, pa.binary())],
                    ["doc_id", "key", "n_tokens", "addresses", "chunks", "root"],
                )

    # rows that repeat an id keep apart by their texts' hash
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _STAGED)


def write_store(docs: DataFrame, tokenizer: str, folder: str | None = None, **kw) -> str:
    """Writes the store and returns its folder.

    Null texts are empty documents (an end id only), null ids come first; rows that repeat an id stay apart, in the
    order of their texts' hash; an empty table gives a store without files. Other columns are not read, whatever their
    names. A document beyond ``MAX_CHUNK`` ids without a mark is cut there.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-store")
    staged_at = f"{folder}/staged"
    vocab = max(encoder(tokenizer).vocab_size, kw.get("end_id", END_ID) + 1)
    spark.createDataFrame([(vocab,)], "vocab int").coalesce(1).write.parquet(f"{folder}/format")
    encode_documents(docs, tokenizer, **kw).write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema(T._parse_datatype_string(_STAGED)).parquet(staged_at)
    pairs = staged.select(F.explode(F.arrays_zip("addresses", "chunks")).alias("c")).select(F.col("c.addresses").alias("address"), F.col("c.chunks").alias("ids")).where("ids is not null")
    pairs.dropDuplicates(["address"]).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    rows = staged.count()
    files = max(1, -(-rows // FILE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1000)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    recipes = staged.select("doc_id", "key", "n_tokens", "addresses", "root").repartitionByRange(files, *order).sortWithinPartitions(*order)
    recipes.mapInArrow(_placed, "file int, place bigint, before bigint, doc_id bigint, key bigint, n_tokens bigint, addresses array<binary>, root binary").write.parquet(f"{folder}/recipes")
    remove(spark, staged_at)
    manifest = file_roots(spark.read.parquet(f"{folder}/recipes"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{folder}/manifest")
    spark.createDataFrame([(bytearray(store_root(spark, folder)),)], "root binary").coalesce(1).write.parquet(f"{folder}/store")
    return folder


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes with their file (the partition), their place in it and the ids before them there."""
    file, place, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        upto = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), file, np.int32)), pa.array(np.arange(place, place + len(n))), pa.array(upto - n), *b.columns], ["file", "place", "before", *b.schema.names])
        place, total = place + len(n), int(upto[-1]) if len(n) else total


def _rooted(leaf_rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, documents, tokens, root) of groups of rows (keys, ``order``, documents, tokens, root), of bounded size: a group's root is over its rows' roots in order."""
    g = leaf_rows.groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct(order, "root"))).alias("leaves"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [merkle_root([x["root"] for x in leaves]) for leaves in b.column("leaves").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(roots, pa.binary())], [*b.schema.names[:-1], "root"])

    kinds = dict(leaf_rows.dtypes)
    return g.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", documents bigint, tokens bigint, root binary")


def file_roots(recipes: DataFrame) -> DataFrame:
    """(file, documents, tokens, root) of recipe files; a file's root is over its documents' roots in order, a subtree to a row first."""
    leaves = recipes.select("file", F.floor(F.col("place") / SUBTREE).cast("int").alias("part"), "place", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), "root")
    return _rooted(_rooted(leaves, ["file", "part"], "place"), ["file"], "part")


def store_root(spark: SparkSession, folder: str) -> bytes:
    """The root over the files' roots; 32 bytes a file come to the driver."""
    return merkle_root([bytes(r["root"]) for r in spark.read.parquet(f"{folder}/manifest").select("file", "root").orderBy("file").collect()])


@lru_cache(maxsize=4096)
def _crc_shift(n: int) -> tuple[list[int], ...]:
    """Tables that move a CRC-32 past ``n`` zero bytes, a table for each of its four bytes."""
    base = zlib.crc32(bytes(n))
    columns = [zlib.crc32(bytes(n), 1 << k) ^ base for k in range(32)]
    tables = []
    for k in range(4):
        t = [0] * 256
        for v in range(1, 256):
            low = v & -v
            t[v] = t[v ^ low] ^ columns[8 * k + low.bit_length() - 1]
        tables.append(t)
    return tuple(tables)


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings in a row from their own CRCs and the length of the second."""
    a, b, c, d = _crc_shift(second_bytes)
    return a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24] ^ second


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files alone.

    Each chunk is read and verified once, where it lies; a document's CRC is joined from those of its chunks, so only
    a few bytes a chunk are shuffled. A chunk that does not hash to its address, a missing chunk, or a root that does
    not match fails the job.
    """
    chunks, recipes, manifest = (spark.read.parquet(f"{folder}/{x}") for x in ("chunks", "recipes", "manifest"))
    kind = _dtype(max(vocab_of(spark, folder), 1))

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for address, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if address_of(ids) != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                x = np.frombuffer(ids, kind)
                n.append(len(x))
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "n", "crc"])

    facts = chunks.select("address", "ids").mapInArrow(verify, "address binary, n bigint, crc bigint")
    uses = recipes.select("file", "place", F.posexplode("addresses").alias("seq", "address"))
    parts = uses.join(facts, "address", "left").groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "n", "crc"))).alias("parts"))
    rows = recipes.select("file", "place", "before", "doc_id", "n_tokens", "root", F.size("addresses").alias("k")).join(parts, ["file", "place"])

    @frugal
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for doc, n, root, k, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "k", "parts")), strict=True):
                if len(parts) != k or any(p["n"] is None for p in parts) or sum(p["n"] for p in parts) != n or merkle_root([p["address"] for p in parts]) != root:
                    raise ValueError(f"the recipe of document {doc} does not match its chunks")
                crc = 0
                for p in parts:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("before"), b.column("doc_id"), b.column("n_tokens"), pa.array(crcs, pa.int64())], ["file", "before", "doc_id", "n_tokens", "ids_crc32"])

    out = rows.mapInArrow(join, "file int, before bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    out = out.join(F.broadcast(manifest.select("file", F.col("start").alias("base"))), "file")  # a row a file
    return out.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def vocab_of(spark: SparkSession, folder: str) -> int:
    """The vocabulary size that sets the width of ids, from the store's own note."""
    return spark.read.parquet(f"{folder}/format").first()["vocab"]


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) with every document rebuilt from its recipe."""
    chunks, recipes = (spark.read.parquet(f"{folder}/{x}") for x in ("chunks", "recipes"))
    kind = _dtype(vocab_of(spark, folder))
    uses = recipes.select("file", "place", "doc_id", F.posexplode("addresses").alias("seq", "address"))
    rows = uses.join(chunks, "address").groupBy("file", "place", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), kind).astype(np.int32) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.select("doc_id", "parts").mapInArrow(run, "doc_id bigint, ids array<int>")


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Recipe files whose documents, tokens or root differ from the manifest: none in a sound store. A manifest that does not match the store's root is an error."""
    if store_root(spark, folder) != bytes(spark.read.parquet(f"{folder}/store").first()["root"]):
        raise ValueError("the manifest does not match the store's root")
    now = file_roots(spark.read.parquet(f"{folder}/recipes")).select("file", F.struct("documents", "tokens", "root").alias("now"))
    then = spark.read.parquet(f"{folder}/manifest").select("file", F.struct("documents", "tokens", "root").alias("then"))
    return now.join(then, "file", "full").where(~F.col("now").eqNullSafe(F.col("then"))).select("file")
