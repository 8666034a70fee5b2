"""The learned operators on tiny inputs against plain Python."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from engramma.llm import langid, learn, quality, toxicity


# --- quality


def passage_features(words, text_bytes, n_words=64):
    """The features of one passage from its words and its bytes, as learn.passages defines them."""
    cls = [int(learn._CLASS[b]) for b in text_bytes]
    size, k = max(1, len(cls)), len(words)
    lens = [len(w) for w in words]
    mean = sum(lens) / k
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    counts = {w: low.count(w) for w in low}
    first, last = [int(learn._CLASS[w[0]]) for w in words], [int(learn._CLASS[w[-1]]) for w in words]
    share = lambda xs: sum(map(float, xs)) / k
    return [
        *(cls.count(c) / size for c in range(1, 12)),
        mean / 10,
        math.sqrt(max(0.0, sum(x * x for x in lens) / k - mean * mean)) / 10,
        len(counts) / k,
        share(a == b for a, b in zip(low[1:], low)),
        max(counts.values()) / k,
        share(x <= 3 for x in lens),
        share(x >= 12 for x in lens),
        share(f == 2 for f in first),
        share(f == 2 and z != 1 for f, z in zip(first, last)),
        share(z == 7 for z in last),
        share(z >= 8 for z in last),
        k / n_words,
        math.log1p(len(text_bytes)) / 10,
    ]


def test_passages_against_plain_python():
    r = np.random.RandomState(0)
    word = lambda: "".join(r.choice(list("abCD.,!1|é")) for _ in range(r.randint(1, 15)))
    texts = ["", "one", *(" ".join(word() for _ in range(n)) for n in (5, 63, 64, 65, 200))]
    x, at = quality.features(pa.array(texts))
    assert at.tolist() == np.cumsum([0, *(-(-len(t.split(" ")) // 64) if t else 0 for t in texts)]).tolist()
    for i, t in enumerate(texts):
        words = [w.encode() for w in t.split(" ")] if t else []
        for j in range(0, len(words), 64):
            mine = words[j : j + 64]
            body = b" ".join(mine) + (b" " if j + 64 < len(words) else b"")
            assert np.allclose(x[at[i] + j // 64], passage_features(mine, body), atol=1e-6)


def tiny_model(r):
    d, h, g = learn.FEATURES, quality.HIDDEN, quality.GATE
    p = {"e": r.normal(0, 0.3, (d, h)), "eb": r.normal(0, 0.3, h), "v": r.normal(0, 0.5, (h, g)), "u": r.normal(0, 0.5, (h, g)), "w": r.normal(0, 0.5, g), "c": r.normal(0, 0.5, h), "cb": r.normal(0, 0.5, 1)}
    return quality.Attention(np.zeros(d), np.ones(d), p)


def bag_score(m, rows):
    e = [[math.tanh(sum(x[i] * m.p["e"][i, k] for i in range(len(x))) + m.p["eb"][k]) for k in range(quality.HIDDEN)] for x in rows]
    gate = lambda v: sum(math.tanh(sum(v[k] * m.p["v"][k, j] for k in range(len(v)))) / (1 + math.exp(-sum(v[k] * m.p["u"][k, j] for k in range(len(v))))) * m.p["w"][j] for j in range(quality.GATE))
    a = [math.exp(gate(v)) for v in e]
    z = [sum(w * v[k] for w, v in zip(a, e)) / sum(a) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(z[k] * m.p["c"][k] for k in range(len(z))) + m.p["cb"][0])))


def test_attention_scores_and_gradients():
    r = np.random.RandomState(1)
    m, x, at = tiny_model(r), r.normal(0, 1, (9, learn.FEATURES)), np.array([0, 2, 3, 9])
    want = [bag_score(m, x[a:b]) for a, b in zip(at, at[1:])]
    assert np.allclose(m.score(x, at), want, atol=1e-9)
    assert np.allclose(m.score(x, np.array([0, 2, 2, 3, 9])), [want[0], bag_score(m, [np.zeros(learn.FEATURES)]), *want[1:]], atol=1e-9)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        s = m.score(x, at)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in quality.gradients(m, x, at, y).items():
        flat = m.p[name].reshape(-1)
        for i in r.choice(len(flat), min(6, len(flat)), replace=False):
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 1e-6


# --- toxicity


def joint(model, votes, c):
    p = model.prior if c else 1 - model.prior
    for j, v in enumerate(votes):
        up = votes[model.parent[j]] if model.parent[j] >= 0 else 0
        p *= model.table[c, j, up + 1, v + 1]
    return p


def test_label_model_posterior_and_estimates_by_enumeration():
    r = np.random.RandomState(2)
    v, p, parent = r.randint(-1, 2, (40, 4)).astype(np.int8), r.uniform(0, 1, 40), np.array([-1, 0, 0, 2])
    m = toxicity._estimate(v, p, parent, np.zeros((4, 4)))
    for c, j, a, k in itertools.product(range(2), range(4), range(3), range(3)):
        w = p if c else 1 - p
        own = (sum(w[i] for i in range(40) if v[i, j] == k - 1) + 0.5) / (w.sum() + 1.5)
        seen = [i for i in range(40) if (v[i, parent[j]] if parent[j] >= 0 else 0) == a - 1]
        want = (sum(w[i] for i in seen if v[i, j] == k - 1) + 2 * own) / (sum(w[i] for i in seen) + 2)
        assert abs(m.table[c, j, a, k] - want) < 1e-12
    every = list(itertools.product((-1, 0, 1), repeat=4))
    for c in range(2):  # the model is a distribution over all votes
        assert abs(sum(joint(m, x, c) for x in every) - (m.prior if c else 1 - m.prior)) < 1e-9
    got = m.posterior(np.array(every, np.int8))
    assert np.allclose(got, [joint(m, x, 1) / (joint(m, x, 0) + joint(m, x, 1)) for x in every])


def test_mutual_information_and_tree():
    r = np.random.RandomState(3)
    y = r.uniform(size=3000) < 0.3
    vote = lambda hit: np.where(r.uniform(size=3000) < np.where(y, hit, 0.1), 1, -1)
    v = np.stack([vote(x) for x in (0.9, 0.8, 0.85, 0.7, 0.9, 0.8, 0.85)], 1)
    v[:, 3] = np.where(r.uniform(size=3000) < 0.8, v[:, 1], v[:, 3])  # the fourth copies the second
    p = y.astype(float)
    info = toxicity._mutual_information(v.astype(np.int8), p)
    for a, b in itertools.combinations(range(7), 2):
        want = 0.0
        for c in (0, 1):
            rows = [tuple(x) for x in v[y == c][:, [a, b]]]
            n = len(rows)
            for pair in set(rows):
                f = rows.count(pair) / n
                fa, fb = sum(x[0] == pair[0] for x in rows) / n, sum(x[1] == pair[1] for x in rows) / n
                want += (y == c).mean() * f * math.log(f / (fa * fb))
        assert abs(info[a, b] - want) < 1e-9 and info[a, b] == pytest.approx(info[b, a])
    parent = toxicity.dependence_tree(info, len(v))
    assert [{j, int(q)} for j, q in enumerate(parent) if q >= 0] == [{1, 3}]
    m = toxicity.fit_label_model(v.astype(np.int8))
    assert [{j, int(q)} for j, q in enumerate(m.parent) if q >= 0] == [{1, 3}]
    assert abs(m.prior - 0.3) < 0.05 and ((m.posterior(v.astype(np.int8)) > 0.5) == y).mean() > 0.93


def test_mined_lexicon_by_counting(spark):
    rows = [(f"clean words number {i} stay quiet", 0) for i in range(60)] + [(f"grumble words number {i} badword shouting", 1) for i in range(20)]
    lex = toxicity.mine(spark.createDataFrame(rows, "text string, y int"))
    h = toxicity._hash_list(["grumble", "badword", "shouting", "words", "clean"])
    named = {w: bool(np.isin(toxicity._hash_list([w]), lex.kinds[0])[0]) for w in ("grumble", "badword", "shouting", "words", "clean", "number")}
    assert named == {"grumble": True, "badword": True, "shouting": True, "words": False, "clean": False, "number": False} and len(h) == 5
    v, _ = toxicity.votes(pa.array(["a badword here", None, "quiet words", "BADWORD grumble shouting badword"]), lex)
    col = {n: i for i, n in enumerate(toxicity.VOTERS)}
    assert v[:, col["several"]].tolist() == [-1 if False else 0, -1, -1, 1] and v[3, col["shouted"]] == 1 and v[3, col["repeated"]] == 1


# --- language


def test_language_posterior_by_hand(spark):
    docs = spark.createDataFrame([(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "der mann und das kind", "de"), (4, None, "en"), (5, "x", None)], "doc_id long, text string, lang string")
    pages = [(1, "http://a.x.de/1", "<html lang='de'><p>das haus</p></html>"), (2, "http://a.x.de/2", "<p>der garten</p>"), (3, "http://b.y.com/3", "<html lang=en>the house"), (4, "http://b.y.com/4", None), (5, None, "the garden"), (5, None, "the garden")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    langs, logp = langid.train_text(docs)
    assert langs == ["de", "en"]
    counts = {}
    for text, lang in (("the house and the garden", "en"), ("das haus und der garten", "de"), ("der mann und das kind", "de"), ("", "en")):
        b = text.encode()
        for i in range(len(b) - 2):
            if not (b[i] == 32 and b[i + 1] == 32):
                k = ((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2654435761 % 2**32) >> 18
                counts[lang, k] = counts.get((lang, k), 0) + 1
    for j, lang in enumerate(langs):
        total = sum(n for (x, _), n in counts.items() if x == lang) + langid.SMOOTH * langid.BINS
        for (x, k), n in counts.items():
            if x == lang:
                assert abs(logp[j, k] - math.log((n + langid.SMOOTH) / total)) < 1e-9
    rows = []
    for pid, url, html in pages:
        text = langid.visible_text(html or "")
        c = np.zeros(langid.BINS)
        for _, c in langid.trigram_counts(pa.array([text])):
            pass
        t = logp @ c * langid.TEMPER * min(1.0, langid.ENOUGH / max(1, c.sum()))
        t = t - t.max()
        host = (url or "").split("/")[2] if url else ""
        rows.append({"id": pid, "t": t, "q": np.exp(t) / np.exp(t).sum(), "declared": langid.declared_language(html or ""), "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1]})
    n, every = len(langs), sum(r["q"] for r in rows)
    kinds = lambda key: len({r[key] for r in rows if r[key] is not None})
    want = []
    for r in rows:
        own = lambda key: np.maximum(0, sum(x["q"] for x in rows if x[key] == r[key]) - r["q"])  # noqa: E731, B023
        world = (every + langid.SMOOTH) / (len(rows) + langid.SMOOTH * n)
        domain = (own("domain") + langid.DOMAIN_PULL * world) / (own("domain").sum() + langid.DOMAIN_PULL)
        host = (own("host") + langid.HOST_PULL * domain) / (own("host").sum() + langid.HOST_PULL)
        declared = (own("declared") + langid.SMOOTH) / (every + langid.SMOOTH * (kinds("declared") + 1))
        suffix = (own("suffix") + langid.SMOOTH) / (every + langid.SMOOTH * max(1, kinds("suffix")))
        z = r["t"] + np.log(declared) + np.log(suffix) + np.log(host)
        want.append((r["id"], langs[int(np.argmax(z))], 1 / np.exp(z - z.max()).sum(), r["declared"], r["host"]))
    got = sorted(((x["page_id"], x["lang"], x["confidence"], x["declared"], x["host"]) for x in langid.identify(df, docs).collect()), key=str)
    want = sorted(want, key=str)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_hostile_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ("<!--" * 200_000, "<" * 400_000, "<script" * 200_000, "<html " * 100_000, "<meta content-language " * 60_000, "<style></style" * 100_000):
        langid.visible_text(page)
        langid.declared_language(page)
    assert time.time() - began < 20
    assert langid.visible_text("a<!-- x -->b<script>y</script >c<p d>e &amp; f < g") == "a b c e & f < g"
    assert langid.visible_text("a<!-- b <p>c") == "a c" and langid.visible_text("a<!-- b") == "a<!-- b"
    assert langid.declared_language("<html class=x LANG = 'De-at'>") == "de" and langid.declared_language("<meta http-equiv=content-language content='fr'>") == "fr" and langid.declared_language("<p>") is None
