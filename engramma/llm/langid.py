"""Language identification by fusing evidence.

For every page the log posterior of a language is the sum of: the text's log likelihood under byte-trigram models
trained on the labelled documents (tempered, since neighbouring trigrams are no independent evidence: every trigram of
the text enters, but together they never weigh more than ``ENOUGH`` of them would); how likely the
page's declared markup language is for pages of that language; how likely its address suffix is; and a prior of its
host, smoothed towards its domain's, which is smoothed towards all pages'. The last three are counted by grouped
aggregation of the text posteriors over all pages; a page's own share is taken out of its host's and domain's counts.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.llm.bytekit import ASCII_LOWER, buffers, pieces
from engramma.storage import written

#: Labelled documents that the trigram models are counted on, at most.
TRAIN_ROWS = 4000
BINS = 1 << 14
#: Weight of a trigram's log likelihood, and the number of trigrams whose weight a longer text's mean has.
TEMPER, ENOUGH = 0.15, 400
SMOOTH, HOST_PULL, DOMAIN_PULL = 0.5, 5.0, 5.0
#: Rows of a grouped table (hosts, domains: about 150 bytes each) that may be broadcast.
BROADCAST_GROUPS = 100_000

_MARK = re.compile(r"<!--|<(?:script|style)\b|<", re.I)
_CLOSE = {"<!--": re.compile("-->"), "<script": re.compile(r"</script\s*>", re.I), "<style": re.compile(r"</style\s*>", re.I)}
_HEAD = re.compile(r"<(html|meta)\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
_CONTENT = re.compile(r"content\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)


def visible_text(page: str) -> str:
    """What is left without comments, scripts, styles and tags; one that is never closed is text. Linear in the page."""
    out, at, never = [], 0, set()
    for m in iter(lambda: _MARK.search(page, at), None):
        kind, end = m[0].lower(), None
        if kind in _CLOSE and kind not in never:
            end = _CLOSE[kind].search(page, m.end())
            if not end:
                never.add(kind)
        stop = end.end() if end else page.find(">", m.end()) + 1 if ">" not in never else 0
        if not stop:
            never.add(">")
            if never.issuperset([*_CLOSE, ">"]):
                break
        out.append(page[at : m.start()] if stop else page[at : m.end()])
        if stop:
            out.append(" ")
        at = stop or m.end()
    out.append(page[at:])
    return htmllib.unescape("".join(out))


def declared_language(page: str) -> str | None:
    """The language of the first html tag that has one, else of the first content-language meta tag."""
    meta, at = None, 0
    for m in iter(lambda: _HEAD.search(page, at), None):
        at = page.find(">", m.end())
        at = len(page) if at < 0 else at
        tag = page[m.end() : at]
        if m[1].lower() == "html":
            if found := _LANG.search(tag):
                return found[1].lower()
        elif meta is None and (start := tag.lower().find("content-language")) >= 0 and (found := _CONTENT.search(tag, start + 16)):
            meta = found[1].lower()
    return meta


def trigram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, counts of hashed byte trigrams) of every text, letters and other bytes outside ASCII punctuation only."""
    data, offs = buffers(texts)
    keep = np.zeros(256, bool)
    keep[97:123] = keep[128:] = keep[32] = True
    for a, b in pieces(offs):
        d = ASCII_LOWER[data[offs[a] : offs[b]]].astype(np.int64)
        d[~keep[d]] = 32
        code = (d[:-2] * 65536 + d[1:-1] * 256 + d[2:]) * 2654435761 % 2**32 >> 18 if len(d) > 2 else np.zeros(0, np.int64)
        blank = (d[:-2] == 32) & (d[1:-1] == 32) if len(d) > 2 else np.zeros(0, bool)
        for i in range(a, b):
            s, e = offs[i] - offs[a], max(offs[i] - offs[a], offs[i + 1] - offs[a] - 2)
            yield i, np.bincount(code[s:e][~blank[s:e]], minlength=BINS)


def train_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigrams, from at most ``bound`` labelled rows chosen by a hash of their ids.

    What comes to the driver is one row a language and hashed trigram.
    """
    chosen = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(bound)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("i"), "left_semi").where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches):
        for b in batches:
            langs, total = b.column(1).to_pylist(), {}
            for i, c in trigram_counts(b.column(0)):
                total[langs[i]] = total.get(langs[i], 0) + c
            for lang, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bin", "n"])

    found = rows.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.full((max(1, len(langs)), BINS), SMOOTH)
    index = {x: k for k, x in enumerate(langs)}
    np.add.at(counts, (np.array([index[x] for x in found["lang"].to_pylist()], int), found["bin"].to_numpy()), found["n"].to_numpy())
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def page_evidence(pages: DataFrame, langs: list[str], logp: np.ndarray, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, declared, host, domain, suffix, and a text log likelihood t0, t1, … for each language."""
    names = [f"t{k}" for k in range(len(langs))]

    def run(batches):
        for b in batches:
            raw = [h or "" for h in b.column(2).to_pylist()]
            ll = np.zeros((b.num_rows, len(langs)))
            for i, c in trigram_counts(pa.array([visible_text(h) for h in raw], pa.string())):
                ll[i] = logp @ c * (TEMPER * min(1.0, ENOUGH / max(1, c.sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([declared_language(h) for h in raw], pa.string()), *(pa.array(x) for x in (ll - ll.max(1, keepdims=True)).T)], ["page_id", "url", "declared", *names])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    out = rows.mapInArrow(run, "page_id bigint, url string, declared string, " + ", ".join(f"{n} double" for n in names))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    out = out.withColumn("host", host).withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.lit(1), F.size(F.split("host", r"\.")) - 1), F.lit(2)), "."))
    return out.select("page_id", "declared", "host", "domain", "suffix", *names)


def _joined(rows: DataFrame, key: str, qs: list[str], prefix: str) -> DataFrame:
    """Sums of the text posteriors by ``key``, joined to the rows; broadcast only while the groups are few."""
    groups = written(rows.groupBy(F.col(key).alias(f"__{key}")).agg(*(F.sum(q).alias(f"{prefix}{k}") for k, q in enumerate(qs))), f"lang-{key}")
    small = groups.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if small else groups, F.col(key).eqNullSafe(F.col(f"__{key}")), "left").drop(f"__{key}")


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **train_kw) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host of every page.

    Null html is an empty text (its language is then decided by what was declared, by suffix and host); null or odd
    urls have the host ''; pages that declare nothing form a group of their own. Ties go to the first language in
    alphabetical order; rows that repeat a page are judged one by one, and each counts; columns besides the named three
    are not read; an empty table stays empty. Without labelled documents the language is null and the confidence 0.
    """
    langs, logp = train_text(docs, **train_kw)
    if not langs:
        return pages.select(F.col(page_id).cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit("").alias("host"))
    n = len(langs)
    rows = written(page_evidence(pages, langs, logp, page_id, url, html), "lang-evidence")
    ts, qs = [f"t{k}" for k in range(n)], [f"q{k}" for k in range(n)]
    total = sum((F.exp(t) for t in ts[1:]), F.exp(ts[0]))
    rows = rows.withColumns({q: F.exp(t) / total for q, t in zip(qs, ts, strict=True)})
    every = rows.agg(*(F.coalesce(F.sum(q), F.lit(0.0)).alias(q) for q in qs), F.count("*").alias("n"), F.countDistinct("declared").alias("d"), F.countDistinct("suffix").alias("s")).first()
    for key, prefix in (("declared", "d"), ("suffix", "s"), ("domain", "m"), ("host", "h")):
        rows = _joined(rows, key, qs, f"c_{prefix}")

    def minus(c: str, k: int) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{c}{k}") - F.col(qs[k]))

    def size(c: str) -> Column:
        return sum((minus(c, k) for k in range(1, n)), minus(c, 0))

    score = []
    for k in range(n):
        world = F.lit((every[qs[k]] + SMOOTH) / (every["n"] + SMOOTH * n))
        domain = (minus("c_m", k) + DOMAIN_PULL * world) / (size("c_m") + DOMAIN_PULL)
        host = (minus("c_h", k) + HOST_PULL * domain) / (size("c_h") + HOST_PULL)
        declared = (minus("c_d", k) + SMOOTH) / F.lit(every[qs[k]] + SMOOTH * (every["d"] + 1))
        suffix = (minus("c_s", k) + SMOOTH) / F.lit(every[qs[k]] + SMOOTH * max(1, every["s"]))
        score.append((F.col(ts[k]) + F.log(declared) + F.log(suffix) + F.log(host)).alias(f"z{k}"))
    rows = rows.select("page_id", "declared", "host", *ts, *score)
    best = F.greatest(*(f"z{k}" for k in range(n))) if n > 1 else F.col("z0")
    top_text = F.greatest(*ts) if n > 1 else F.col("t0")

    def first(cols: list[str], top: Column) -> Column:
        return F.coalesce(*(F.when(F.col(c) >= top, F.lit(x)) for c, x in zip(cols, langs, strict=True)))

    zs = [f"z{k}" for k in range(n)]
    confidence = 1 / sum((F.exp(F.col(z) - best) for z in zs[1:]), F.exp(F.col(zs[0]) - best))
    return rows.select("page_id", first(zs, best).alias("lang"), confidence.alias("confidence"), first(ts, top_text).alias("text_lang"), "declared", "host")
