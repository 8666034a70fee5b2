"""Motifs in texts: only patterns that may stand in a text are looked for, and none is missed."""

from pyspark.sql import functions as F

from engramma.operators import motifs

MOTIFS = motifs.Dictionary([
    motifs.Motif("M.A", "slow", ("soil", "god=math", "phi/2", "0.809", "it works"), ("forced",)),
    motifs.Motif("M.B", "mid", ("that's not right", "I am", "kernel", "café life", "_x_"), ("Live wire", "none")),
    motifs.Motif("M.C", "fast", ("é", "für", "soil")),
])
TEXTS = [
    "soil", "topsoil ſoil", "Soil,soil;SOIL", "ésoil soilé", "—soil—", "soil_ _soil", "god = math god=math GOD=MATH", "phi/2 phi/21 0.809 10.809 0.8090",
    "it  works it\nworks it works itworks", "THAT'S not right", "that s not right", "i am", "İ am, I am", "ı am i am", "kernel Kernel", "Kernel", "café life CAFÉ LIFE cafe life",
    "_x_ x _X_", "É é", "für FÜR fur", "live wire forced soil i am", "é soiĺ soil", "word", "", None,
]


def test_patterns_are_looked_for_where_their_words_are(spark):
    phrases = [(m.motif_id, e, p) for m in MOTIFS.motifs for e, p in zip(m.examples, m.patterns(), strict=True)]
    docs = spark.createDataFrame([*enumerate(TEXTS)], "k int, text string")
    got = {(r["k"], r["motif_id"]): r["hits"] for r in motifs.assign(docs, MOTIFS, "k").collect()}
    low = F.lower("text")
    every = docs.where("text <> ''").select("k", *(F.when(low.contains(e.split()[0].lower()), F.regexp_count("text", F.lit(p))).otherwise(0).alias(str(i)) for i, (_, e, p) in enumerate(phrases)))
    want = {}
    for r in every.collect():
        for i, (m, _, _) in enumerate(phrases):
            if r[str(i)]:
                want[r["k"], m] = want.get((r["k"], m), 0) + r[str(i)]
    assert got == want and len(want) > 15
    possible = docs.where("text = 'word' or text = 'i am'").select("text", motifs._possible(F.col("text"), [e for _, e, _ in phrases]).alias("p")).collect()
    assert {r["text"]: [phrases[i][1] for i in r["p"]] for r in possible} == {"word": ["é"], "i am": ["é", "I am"]}
