"""Answers as text, normalised transcripts, text rules, search variants and further metrics over the input tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.functions import timefn
from engramma.operators import dictionary as dc
from engramma.operators import evaluate as ev
from engramma.operators import exchanges as ex
from engramma.operators import motifs as mo
from engramma.operators import parsing as pa
from engramma.operators import search as se
from engramma.plans import adaptive, classify
from engramma.queries.memory import ASSIGNED, RANKED, _assigned, _ranked
from engramma.queries.passages import _COS, LEX, VEC, _anchors, _docs, _lane_queries
from engramma.session import table
from engramma.sources import exports


def _answers(spark, d):
    """(doc_id, text): every labelled document's label as a model would answer, in five forms by number: plain, fenced, within prose, cut short, wrapped."""
    y = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang", "source"), "doc_id")
    motif = F.struct(F.concat(F.lit("HMM.M"), F.col("quality").cast("string")).alias("motif_id"), (F.col("toxic") / 2).alias("amp"))
    item = F.struct(F.concat(F.lit("h"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("hash"), F.concat(F.lit("a summary of the "), F.col("source")).alias("rosetta_summary"))
    full = F.to_json(F.struct(F.array(F.struct(item["hash"].alias("hash"), item["rosetta_summary"].alias("rosetta_summary"), F.array(motif).alias("motifs"))).alias("items")))
    form = F.col("doc_id") % 5
    cut = F.concat(F.substring(full, F.lit(1), F.length(full) - 2), F.lit(', {"hash": "lost'))
    wrapped = F.to_json(F.struct(item["hash"].alias("content_hash"), F.to_json(F.struct(item["rosetta_summary"].alias("rosetta_summary"))).alias("response")))
    text = F.when(form == 0, full).when(form == 1, F.concat(F.lit("Here it is:\n```json\n"), full, F.lit("\n```\nDone."))).when(form == 2, F.concat(F.lit("Sure. "), full, F.lit(" I hope this helps."))).when(form == 3, cut).otherwise(wrapped)
    return y.select("doc_id", text.alias("text"))


def response_items(spark, d):
    x = _answers(spark, d).select("doc_id", pa.parse_items(F.col("text")).alias("p"))
    item = F.get("p.items", F.lit(0))
    return x.select("doc_id", "p.how", F.size("p.items").alias("n"), item["hash"].alias("hash"), item["rosetta_summary"].alias("summary"), F.get(item["motifs"], F.lit(0))["motif_id"].alias("motif_id"))


def response_issues(spark, d):
    known = F.array(F.lit("HMM.M1"))
    x = _answers(spark, d).select("doc_id", F.get(pa.item_issues(pa.parse_items(F.col("text"))["items"], known), F.lit(0)).alias("i"))
    return x.select("doc_id", F.array_join("i", "; ").alias("issues"))


def batch_rows(spark, d):
    """Each source's documents as one array answer, plain, fenced or cut short by number of documents."""
    one = F.struct(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("hash"), F.array("lang").alias("motifs"), F.lit("r").alias("rosetta"))
    g = _docs(spark, d).groupBy("source").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("j"), F.count("*").alias("n"))
    text = F.when(F.col("n") % 3 == 0, F.col("j")).when(F.col("n") % 3 == 1, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).otherwise(F.concat(F.substring("j", F.lit(1), F.length("j") - 1), F.lit(', {"hash": "los')))
    rows = pa.parse_batch(text)
    return g.select("source", F.size(rows).alias("n"), F.array_min(F.transform(rows, lambda r: r["hash"])).alias("first"), F.array_max(F.transform(rows, lambda r: r["hash"])).alias("last"))


def motif_annotations(spark, d):
    a = _assigned(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("motif_id", F.round(F.col("amp") + 1e-7, 2).alias("amp"), F.col("band").alias("description")))).alias("m"))
    as_map = F.to_json(F.map_from_entries(F.transform("m", lambda x: F.struct(x["motif_id"], F.struct(x["amp"].alias("amp"), x["description"].alias("description"))))))
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json("m")).otherwise(as_map)
    return a.select("doc_id", pa.annotations(text).alias("annotations"))


def _transcripts(spark, d):
    """(path, text): conversations as parsed transcripts of the three shapes by number, every fourth twice, the copy with its first exchange only, or whole where it is a list of messages."""
    c = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    flat = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    roles = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    e = ex.exchanges(table(spark, d, "conversations"), "conv_id", "turn").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("exchange_index", "prompt", "response"))).alias("e"))
    paired = F.transform("e", lambda x: F.struct(x["prompt"].alias("prompt"), x["response"].alias("response")))
    listed = F.transform("e", lambda x: F.struct(x["prompt"].alias("user_prompt"), F.array(F.struct(x["response"].alias("text"), F.lit("m1").alias("model"))).alias("responses")))
    j = flat.join(e, "conv_id")
    named = lambda rows: F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"), rows.alias("exchanges")))
    form = F.col("conv_id") % 3
    whole = lambda cut: F.when(form == 0, named(cut(listed))).when(form == 1, named(cut(paired))).otherwise(named(roles))
    path = F.concat(F.lit("/t/"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    first = j.select(F.concat(path, F.lit(".json")).alias("path"), whole(lambda x: x).alias("text"))
    part = j.where("conv_id % 4 = 0").select(F.concat(path, F.lit("-part.json")).alias("path"), whole(lambda x: F.slice(x, 1, 1)).alias("text"))
    return first.unionByName(part)


def exchange_normalise(spark, d):
    n = pa.normalised_exchanges(_transcripts(spark, d))
    return n.where("not path like '%-part.json'").select("conversation_id", "exchange_index", F.md5(F.encode("user_text", "utf-8")).alias("user_md5"), F.md5(F.encode("assistant_text", "utf-8")).alias("assistant_md5"), "model")


def exchange_format(spark, d):
    e = ex.exchanges(table(spark, d, "conversations"), "conv_id", "turn")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    x = {"model": F.lit("m1"), "user_text": F.col("prompt"), "assistant_text": F.col("response"), "thinking": F.lit(""), "artifacts": none("struct<type: string, language: string, content: string>"), "tools": none("struct<type: string, output: string, result: string>")}
    t = pa.exchange_text(x, F.lit("p"), F.concat(F.lit("conversation-"), F.col("conv_id").cast("string")))
    return e.select("conv_id", "exchange_index", F.md5(F.encode(t, "utf-8")).alias("text_md5"))


def transcript_files(spark, d):
    return pa.transcript_manifest(pa.normalised_exchanges(_transcripts(spark, d)))[0].select("conversation_id", "path", "n_files")


def exchange_owners(spark, d):
    owners = pa.transcript_manifest(pa.normalised_exchanges(_transcripts(spark, d)))[1]
    return owners.select("hash", "n")


def source_dedup_hash(spark, d):
    """Exchanges of two sources, the second a copy with longer ends: each once, from the first."""
    e = ex.exchanges(table(spark, d, "conversations"), "conv_id", "turn").select(F.col("prompt").alias("user_text"), F.col("response").alias("response_text"), F.lit("").alias("created_at"), F.col("conv_id").cast("string").alias("path"), "exchange_index")
    longer = e.withColumn("response_text", F.when(F.length("response_text") >= 500, F.concat("response_text", F.lit(" more"))).otherwise(F.col("response_text")))
    return exports.first_source([e, longer]).groupBy("source_order").agg(F.count("*").alias("n"), F.min("hash").alias("first"))


def deterministic_ids(spark, d):
    return _docs(spark, d).select("doc_id", tx.joined_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


# Fixed words for the rules below, of the invented languages of the tables.
LANES = {"north": ["the", "and"], "south": ["der", "und"], "west": ["les", "des"]}
LANE_PATHS = {"north": ["src1"], "south": ["src2"], "west": ["src3"]}
LAYERS = [(("/en/", "/us/"), "first"), (("/de/",), "second"), (("blog", "news"), "third")]


def lane_route(spark, d):
    return _docs(spark, d).select("doc_id", tx.route(F.col("text"), F.col("source"), LANES, LANE_PATHS).alias("lane"))


def source_layer(spark, d):
    return table(spark, d, "pages").select("page_id", tx.first_path_rule(F.col("url"), LAYERS).alias("layer"))


def subset_match(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return c.where(tx.matches_any(text, ["the .*and", "[0-9]{3}"])).select("conv_id")


def payload_summary(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.encode(tx.payload_summary(F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), "utf-8")).alias("summary_md5"))


def entity_names(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(tx.canonical_name(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")), {"machinery": "equipment", "furniture": "equipment"}).alias("name")).agg(F.count("*").alias("n"))


def code_blocks(spark, d):
    """Fences put around each message's text, with a language for half of them."""
    c = table(spark, d, "conversations").where("text is not null")
    text = F.concat(F.lit("see\n```"), F.when(F.col("turn") % 2 == 0, "py").otherwise(""), F.lit("\n  "), F.replace("text", F.lit("`"), F.lit("'")), F.lit(" \n```\nend"))
    return c.select("conv_id", "turn", F.explode(tx.code_fences(text)).alias("b")).select("conv_id", "turn", "b.lang", "b.fingerprint")


def file_names(spark, d):
    """A path, a verb's file and a name in backticks put into each item's text."""
    b = table(spark, d, "benchmark")
    text = F.concat(F.col("text"), F.lit(" /srv/a_"), F.col("item_id").cast("string"), F.lit(".py and reading notes/b.md or `c-"), F.col("item_id").cast("string"), F.lit(".json` but not d.exe"))
    return b.select("item_id", F.array_join(tx.file_references(text), " ").alias("files"))


def activity_dates(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    form = F.col("event_id") % 4
    clock = F.date_format("ts", "h:mm a")
    text = F.when(form == 0, F.concat(F.date_format("ts", "MMM d, yyyy"), F.lit(" at "), clock)).when(form == 1, F.concat(F.date_format("ts", "MMMM d"), F.lit(" at "), clock)).when(form == 2, F.concat(F.lit("Yesterday at "), clock)).otherwise(F.lit("no date"))
    return e.select("event_id", timefn.activity_date(text, F.lit("2024-02-17").cast("date")).alias("at"))


def band_filter(spark, d):
    """Each document's motifs cut to the band of its strongest; the whole band where none is left."""
    a = _assigned(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_set("motif_id")).alias("m"), F.max_by("band", F.struct("amp", "motif_id")).alias("band"))
    from engramma.queries.memory import DICTIONARY

    return a.select("doc_id", "band", F.array_join(dc.band_motifs(F.col("m"), F.col("band"), DICTIONARY), ",").alias("motifs"))


def theme_filter(spark, d):
    """Sources as themes: their documents' frequent motifs are required, the rest support; documents filter by theme and their own."""
    a = _assigned(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    t = a.groupBy("source", "motif_id").agg(F.count("*").alias("n"))
    themes = t.groupBy(F.col("source").alias("theme_id")).agg(F.collect_list(F.when(F.col("n") >= 10, F.col("motif_id"))).alias("required"), F.collect_list(F.when(F.col("n") < 10, F.col("motif_id"))).alias("supporting"))
    own = a.groupBy("doc_id", "source").agg(F.collect_set("motif_id").alias("motifs"))
    f = own.select(F.col("doc_id").alias("filter_id"), F.col("source").alias("theme_id"), "motifs")
    return dc.expand_theme(themes, f).select("filter_id", F.array_join("motifs", ",").alias("motifs"))


def motif_edge_search(spark, d):
    return se.motif_edges(_assigned(spark, d), "M.THE", "doc_id", 0.5, 20).select("doc_id", "amp")


def motif_cooccurrence(spark, d):
    return se.motifs_together(_assigned(spark, d), ["M.THE", "M.AND"], "doc_id", 0.3).select("doc_id", F.round("total", 6).alias("total"))


def evolution_search(spark, d):
    """The longest documents of each language, those of small numbers first."""
    r = _ranked(spark, d).join(_docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    return se.oldest_first(r, "doc_id", "doc_id", 15).select("query_id", "doc_id", "place")


def tile_resonance(spark, d):
    return _docs(spark, d).select("doc_id", F.round(se.tile_resonance(tx.token_estimate(F.col("text"))), 6).alias("resonance"))


def theme_routing(spark, d):
    """Vectors of every twentieth number go to their nearest label's anchor."""
    e = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    themes = _anchors(spark, d).select(F.col("label").alias("theme_id"), F.col("av").alias("tv"), F.array(F.col("label").cast("string")).alias("motifs"))
    return se.theme_of(e, themes, 0.6).select("query_id", "theme_id")


def theme_index(spark, d):
    e = table(spark, d, "embeddings").withColumn("content_hash", (F.col("vec_id") % 50).cast("string"))
    themes = _anchors(spark, d).select(F.col("label").alias("theme_id"), F.col("av").alias("tv"))
    return se.theme_index(e, themes, "vec_id", "content_hash").select("theme_id", "content_hash", F.round("score", 6).alias("score"))


def cosine_judge(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    # what rounds to six places at the judge's bounds begins half a millionth below them
    s = se.cosine_counts(table(spark, d, "embeddings"), e, [0.3499995, 0.5499995])
    return s.select("query_id", F.col("bin").alias("relevance"), "n")


def eval_rerank(spark, d):
    dm = mo.dominant(_assigned(spark, d), "doc_id").join(_docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    j = se.jaccard(F.col("dominant_motifs"), F.array(F.lit("M.THE"), F.lit("M.WITH")))
    return dm.select("doc_id", F.round(ev.eval_rank_score(1 / (1 + F.col("n_chars") / 1000), j, F.col("doc_id") % 2 == 0, F.lit(0.9), F.when(F.col("doc_id") % 3 == 0, F.lit(0.8))), 6).alias("score"))


def strategy_means(spark, d):
    r = _ranked(spark, d).where("rank <= 50").select(F.when(F.col("rank") <= 10, "short").otherwise("long").alias("strategy"), F.col("query_id").alias("category"), F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value")), F.struct(F.lit("toxic").alias("metric"), (F.col("toxic") * 2 - 1).cast("double").alias("value")))).alias("x")).select("strategy", "category", "x.*")
    return ev.strategy_means(r).withColumn("mean", F.round("mean", 6))


def ablation(spark, d):
    r = _ranked(spark, d).select((F.col("doc_id") % 3 == 0).alias("enriched"), F.col("quality").alias("relevance"))
    return ev.ablation(r).withColumn("mean", F.round("mean", 6))


def gold_metrics(spark, d):
    r = _ranked(spark, d)
    wanted = r.where("rank = 12").select("query_id", F.col("content_hash").alias("gold_hash")).where("query_id <> 'es'")
    return ev.gold(r, wanted, 10).select("query_id", "gold_recall", F.round("gold_mrr", 6).alias("gold_mrr"))


def motif_metrics(spark, d):
    dm = mo.dominant(_assigned(spark, d), "doc_id")
    r = _ranked(spark, d).join(dm.withColumnRenamed("dominant_motifs", "motifs"), "doc_id", "left")
    expected = r.select("query_id").distinct().select("query_id", F.when(F.col("query_id") != "fr", F.array(F.lit("M.THE"), F.lit("M.ARE"))).otherwise(F.array().cast("array<string>")).alias("motifs"))
    return ev.motif_precision(r, expected, 50).join(ev.motif_overlap(r, expected, 50), "query_id").select("query_id", F.round("precision", 6).alias("precision"), F.round("overlap", 6).alias("overlap"))


def term_recall(spark, d):
    """Whether the longest documents of a language hold the words of the benchmark's items."""
    r = _ranked(spark, d).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    words = table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("term")).distinct()
    t = r.select("query_id").distinct().where("query_id <> 'es'").crossJoin(F.broadcast(words)).where("length(term) >= 3")
    return ev.term_recall(r, t, "text", (5, 20)).select("query_id", "cutoff", F.round("recall", 6).alias("recall"))


def _files(spark, d):
    return _docs(spark, d).select(F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), (F.col("doc_id") % 97).cast("string"), F.lit(".md"))).alias("path"), F.md5(F.encode("text", "utf-8")).alias("content_hash"))


def duplicate_copies(spark, d):
    return ev.duplicate_report(_files(spark, d))[0].select("content_hash", "n", "canonical", F.array_join("paths", ",").alias("paths"))


def duplicate_names(spark, d):
    return ev.duplicate_report(_files(spark, d))[1]


def best_files(spark, d):
    f = table(spark, d, "conversations").groupBy("conv_id", (F.col("turn") % 3).alias("part")).agg(F.count("*").alias("n")).select("conv_id", "n", F.concat(F.lit("/p"), F.repeat(F.lit("x"), F.col("part").cast("int")), F.lit("/"), F.col("conv_id").cast("string")).alias("path"))
    return ex.best_file(f, "conv_id", "n", "path")


def interleave(spark, d):
    a = _docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("corpus").alias("kind"))
    b = table(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.lit("exchange").alias("kind"))
    return ex.interleaved(a, b, "id").select("id", "kind", "position")


def as_of_tolerance(spark, d):
    """Each purchase with the user's last click in the hour before it."""
    e = table(spark, d, "events")
    clicked = F.last(F.when(F.col("event_type") == "click", F.struct("ts", "event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    p = e.withColumn("c", clicked).where("event_type = 'purchase'")
    return p.select("event_id", F.when(F.col("ts") - F.col("c.ts") <= F.expr("INTERVAL 1 HOUR"), F.col("c.event_id")).alias("click_id"))


def ranked_lists_cli(spark, d):
    """Fusion by place from 0 that keeps each result's longest content and the lanes that found it."""
    from engramma.queries.passages import _lanes

    lex, vec = _lanes(spark, d)
    both = lex.withColumn("lane", F.lit("words")).unionByName(vec.withColumn("lane", F.lit("vectors")))
    j = both.join(_docs(spark, d).select("doc_id", F.length("text").alias("len")), "doc_id")
    g = j.groupBy("query_id", "doc_id").agg(F.sum(1 / (60 + F.col("rank") - 1)).alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"), F.max("len").alias("len"))
    return g.withColumn("score", F.round("score", 9))


# --- without SQL: held against brute force in the tests


def query_plans(spark, d):
    """Kind, confidence, platform, motifs and parts of every user message."""
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return classify.plans(c).select("conv_id", "turn", "strategy", "confidence", "platform", F.array_join("motifs", ",").alias("motifs"), F.col("after").cast("string").alias("after"), "semantic_query", F.array_join("sub_queries", "|").alias("parts"))


def adaptive_search(spark, d):
    """Every benchmark item as a query over all documents, by words and vectors, with motifs and labels as metadata."""
    docs = _docs(spark, d).select("doc_id", F.md5(F.encode("text", "utf-8")).alias("content_hash"), F.col("text").alias("content"), F.col("source").alias("platform"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    a = _assigned(spark, d)
    p = docs.join(v, "doc_id", "left").join(mo.dominant(a, "doc_id").withColumnRenamed("dominant_motifs", "motifs"), "doc_id", "left")
    return adaptive.search_with_retry(p, _lane_queries(spark, d), "doc_id", now=F.lit("2024-02-01").cast("timestamp"), postings=a.select("doc_id", "motif_id", "amp"))


def long_parts(spark, d):
    return tx.split_content(_docs(spark, d), "doc_id", most=10_000, overlap=500, back=2000).select("doc_id", "part_index", "n_parts", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


QUERIES = {f.__name__: f for f in (response_items, response_issues, batch_rows, motif_annotations, exchange_normalise, exchange_format, transcript_files, exchange_owners, source_dedup_hash, deterministic_ids, lane_route, source_layer, subset_match, payload_summary, entity_names, code_blocks, file_names, activity_dates, band_filter, theme_filter, motif_edge_search, motif_cooccurrence, evolution_search, tile_resonance, theme_routing, theme_index, cosine_judge, eval_rerank, strategy_means, ablation, gold_metrics, motif_metrics, term_recall, duplicate_copies, duplicate_names, best_files, interleave, as_of_tolerance, ranked_lists_cli, query_plans, adaptive_search, long_parts)}

_XCH = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY x) - 1 AS i, prompt, response FROM (SELECT conv_id, x, coalesce(max(text) FILTER (role = 'user'), '') AS prompt, coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS response FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY conv_id, x)"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_NORM = f"""SELECT conv_id, i, {_STRIP.format(x='p')} AS p, {_STRIP.format(x='r')} AS r, model FROM (
  SELECT conv_id, i, prompt AS p, response AS r, CASE conv_id % 3 WHEN 0 THEN 'm1' ELSE 'perplexity' END AS model FROM ({_XCH}) WHERE conv_id % 3 <> 2
  UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, coalesce(text, ''), CASE WHEN nr = 'assistant' THEN coalesce(nt, '') ELSE '' END, 'claude_code' FROM (
    SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 3 = 2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""
_SQUEEZE = r"trim(regexp_replace(lower({x}), '[ \t\n\x0b\f\r]+', ' ', 'g'))"
_OWN = f"SELECT substring(sha256({_SQUEEZE.format(x='p')} || chr(10) || {_SQUEEZE.format(x='r')}), 1, 16) AS hash FROM ({_NORM})"
_DOMS = "SELECT doc_id, list_sort(list(motif_id)) AS ms FROM (SELECT doc_id, motif_id FROM (" + ASSIGNED + ") WHERE amp >= 0.1 AND confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY amp DESC, motif_id) <= 5) GROUP BY doc_id"
_ANCHOR = "(SELECT label, list(m ORDER BY pos) AS av FROM (SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 9) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"
_CERT = f"(1 + {_COS.format(a='embedding', b='av')}) / 2"
_FILES = "SELECT source || '/' || lang || '/f' || (doc_id % 97) || '.md' AS path, md5(text) AS content_hash FROM documents"
_WANT_HASH = "'h' || lpad(CAST(doc_id AS VARCHAR), 9, '0')"
SQL = {
    "response_items": f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'braces' WHEN 3 THEN 'repaired' ELSE 'wrapper' END AS how, 1 AS n, CASE WHEN doc_id % 5 = 4 THEN substring({_WANT_HASH}, 1, 12) ELSE {_WANT_HASH} END AS hash, 'a summary of the ' || source AS summary, CASE WHEN doc_id % 5 <> 4 THEN 'HMM.M' || quality END AS motif_id FROM labels JOIN documents USING (doc_id)",
    "response_issues": "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'no motifs assigned' WHEN quality <> 1 THEN 'invalid motif: HMM.M' || quality ELSE '' END AS issues FROM (SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id))",
    "batch_rows": "SELECT source, count(*) AS n, min(lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS first, max(lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS last FROM documents GROUP BY source",
    "motif_annotations": f"SELECT doc_id, string_agg(motif_id || format(' ({{:.2f}}): ', round(amp + CAST(1e-7 AS DOUBLE), 2)) || band, chr(10) ORDER BY motif_id) AS annotations FROM ({ASSIGNED}) GROUP BY doc_id",
    "exchange_normalise": f"SELECT 'c' || conv_id AS conversation_id, i AS exchange_index, md5(p) AS user_md5, md5(r) AS assistant_md5, model FROM ({_NORM})",
    "exchange_format": f"SELECT conv_id, i AS exchange_index, md5('[Platform: p] [Session: conversation]' || chr(10) || '[Model: m1]' || CASE WHEN prompt <> '' THEN chr(10) || chr(10) || '[User]: ' || prompt ELSE '' END || CASE WHEN response <> '' THEN chr(10) || chr(10) || '[Assistant]: ' || response ELSE '' END) AS text_md5 FROM ({_XCH})",
    "exchange_owners": f"SELECT hash, count(*) AS n FROM ({_OWN}) GROUP BY hash",
    "source_dedup_hash": f"SELECT 0 AS source_order, count(DISTINCT h) AS n, min(h) AS first FROM (SELECT substring(sha256(substring(prompt, 1, 500) || '|||' || substring(response, 1, 500)), 1, 24) AS h FROM ({_XCH}))",
    "deterministic_ids": "SELECT doc_id, substring(sha256(source || '|' || lang || '|' || doc_id), 1, 24) AS id FROM documents",
    "lane_route": "SELECT doc_id, CASE WHEN greatest(n, s, w) = 0 THEN '' WHEN n = greatest(n, s, w) THEN 'north' WHEN s = greatest(n, s, w) THEN 'south' ELSE 'west' END AS lane FROM (SELECT doc_id, " + ", ".join("(" + " + ".join(f"contains(lower(substring(text, 1, 2000)), '{x}')::INT" for x in words) + f" + 2 * contains(lower(source), '{LANE_PATHS[k][0]}')::INT) AS {k[0]}" for k, words in LANES.items()) + " FROM documents)",
    "source_layer": "SELECT page_id, CASE WHEN contains(lower(url), '/en/') OR contains(lower(url), '/us/') THEN 'first' WHEN contains(lower(url), '/de/') THEN 'second' WHEN contains(lower(url), 'blog') OR contains(lower(url), 'news') THEN 'third' ELSE 'unknown' END AS layer FROM pages",
    "subset_match": "SELECT conv_id FROM (SELECT conv_id, substring(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), 1, 50000) AS t FROM conversations GROUP BY conv_id) WHERE regexp_matches(t, '(?i)the .*and|[0-9]{3}')",
    "payload_summary": "SELECT doc_id, md5(concat_ws(' ', CASE WHEN text <> '' THEN substring(text, 1, 100) END, source, CASE WHEN doc_id % 2 = 0 THEN lang END)) AS summary_md5 FROM documents",
    "entity_names": "SELECT CASE lower(c_mktsegment) WHEN 'machinery' THEN 'equipment' WHEN 'furniture' THEN 'equipment' ELSE lower(c_mktsegment) END AS name, count(*) AS n FROM customer GROUP BY 1",
    "code_blocks": f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'py' ELSE 'unknown' END AS lang, substring(md5(b), 1, 16) AS fingerprint FROM (SELECT conv_id, turn, {_STRIP.format(x=chr(114) + 'eplace(text, chr(96), chr(39))')} AS b FROM conversations WHERE text IS NOT NULL) WHERE length(b) > 20",
    "file_names": "SELECT item_id, array_to_string(list_sort(['/srv/a_' || item_id || '.py', 'notes/b.md', 'c-' || item_id || '.json']), ' ') AS files FROM benchmark",
    "activity_dates": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') WHEN 2 THEN '2024-02-16T' || strftime(ts, '%H:%M:00Z') ELSE '' END AS at FROM events",
    "band_filter": f"WITH a AS ({ASSIGNED}), b AS (SELECT doc_id, max_by(band, {{'a': amp, 'm': motif_id}}) AS band FROM a GROUP BY doc_id) SELECT doc_id, b.band, string_agg(motif_id, ',' ORDER BY motif_id) AS motifs FROM b JOIN a USING (doc_id) WHERE a.band = b.band GROUP BY ALL",
    "theme_filter": f"WITH a AS (SELECT * FROM ({ASSIGNED}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)) SELECT doc_id AS filter_id, string_agg(DISTINCT t.motif_id, ',' ORDER BY t.motif_id) AS motifs FROM (SELECT DISTINCT doc_id, source FROM a) x JOIN (SELECT DISTINCT source, motif_id FROM a) t USING (source) GROUP BY doc_id",
    "motif_edge_search": f"SELECT doc_id, amp FROM ({ASSIGNED}) WHERE motif_id = 'M.THE' AND amp >= 0.5 ORDER BY amp DESC, doc_id LIMIT 20",
    "motif_cooccurrence": f"SELECT doc_id, round(sum(amp), 6) AS total FROM ({ASSIGNED}) WHERE motif_id IN ('M.THE', 'M.AND') AND amp >= 0.3 GROUP BY doc_id HAVING count(*) = 2",
    "evolution_search": f"SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM ({RANKED}) WHERE rank <= 30 QUALIFY place <= 15",
    "tile_resonance": "SELECT doc_id, round(CAST(least(length(text) // 4, 4096) AS DOUBLE) / greatest(length(text) // 4, 4096) * 0.809, 6) AS resonance FROM documents",
    "theme_routing": f"SELECT vec_id AS query_id, label AS theme_id FROM (SELECT vec_id, a.label, {_CERT} AS s FROM embeddings, {_ANCHOR} a WHERE vec_id % 20 = 0) WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1",
    "theme_index": f"SELECT label AS theme_id, CAST(vec_id % 50 AS VARCHAR) AS content_hash, round(max(s), 6) AS score FROM (SELECT vec_id, a.label, {_CERT} AS s FROM embeddings, {_ANCHOR} a) WHERE s >= 0.55 GROUP BY 1, 2",
    "cosine_judge": f"SELECT query_id, CASE WHEN s >= 0.55 THEN 2 WHEN s >= 0.35 THEN 1 ELSE 0 END AS relevance, count(*) AS n FROM (SELECT q.vec_id AS query_id, round({_COS.format(a='e.embedding', b='CAST(q.embedding AS DOUBLE[])')}, 6) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) GROUP BY 1, 2",
    "eval_rerank": f"SELECT doc_id, round(CAST(0.5 AS DOUBLE) / (1 + CAST(n_chars AS DOUBLE) / 1000) + CAST(0.35 AS DOUBLE) * len(list_intersect(ms, ['M.THE', 'M.WITH'])) / len(list_distinct(list_concat(ms, ['M.THE', 'M.WITH']))) + CAST(0.15 AS DOUBLE) * CASE WHEN doc_id % 2 = 0 THEN 0.05 + 0.05 * (0.9 + CASE WHEN doc_id % 3 = 0 THEN 0.8 ELSE 0 END) ELSE 0 END, 6) AS score FROM ({_DOMS}) JOIN documents USING (doc_id)",
    "strategy_means": f"WITH r AS (SELECT CASE WHEN rank <= 10 THEN 'short' ELSE 'long' END AS strategy, query_id AS category, quality, toxic FROM ({RANKED}) WHERE rank <= 50), m AS (SELECT strategy, category, 'quality' AS metric, CAST(quality AS DOUBLE) AS v FROM r UNION ALL SELECT strategy, category, 'toxic', CAST(toxic * 2 - 1 AS DOUBLE) FROM r) SELECT strategy, category, metric, round(avg(v) FILTER (v >= 0), 6) AS mean, count(*) AS n FROM m GROUP BY GROUPING SETS ((strategy, category, metric), (strategy, metric))",
    "ablation": f"SELECT doc_id % 3 = 0 AS enriched, round(avg(quality), 6) AS mean, count(*) AS n FROM ({RANKED}) GROUP BY 1",
    "gold_metrics": f"WITH r AS ({RANKED}), w AS (SELECT query_id, content_hash AS g FROM r WHERE rank = 12 AND query_id <> 'es'), b AS (SELECT query_id, min(rank) FILTER (content_hash = g) AS p, max(g) AS g FROM r LEFT JOIN w USING (query_id) GROUP BY query_id) SELECT query_id, CASE WHEN g IS NULL THEN -1 WHEN p <= 10 THEN 1 ELSE 0 END AS gold_recall, round(CASE WHEN g IS NULL THEN -1 ELSE coalesce(CAST(1 AS DOUBLE) / p, 0) END, 6) AS gold_mrr FROM b",
    "motif_metrics": f"SELECT query_id, round(avg(CASE WHEN query_id = 'fr' THEN NULL WHEN list_has_any(coalesce(ms, []), ['M.THE', 'M.ARE']) THEN 1 ELSE 0 END), 6) AS p, round(avg(CASE WHEN query_id = 'fr' THEN 0 ELSE CAST(len(list_intersect(coalesce(ms, []), ['M.THE', 'M.ARE'])) AS DOUBLE) / 2 END), 6) AS overlap FROM ({RANKED}) LEFT JOIN ({_DOMS}) USING (doc_id) WHERE rank <= 50 GROUP BY query_id",
    "term_recall": f"WITH t AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark), r AS (SELECT query_id, rank, lower(substring(text, 1, 2000)) AS h FROM ({RANKED}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id) WHERE rank <= 20), b AS (SELECT query_id, term, min(rank) FILTER (contains(h, term)) AS p FROM r, t WHERE length(term) >= 3 AND query_id <> 'es' GROUP BY query_id, term) SELECT q.query_id, c AS cutoff, round(CASE WHEN count(term) = 0 THEN -1 ELSE avg(CAST(coalesce(p, 99) <= c AS INT)) END, 6) AS recall FROM (SELECT DISTINCT query_id FROM r) q LEFT JOIN b USING (query_id), (VALUES (5), (20)) k(c) GROUP BY q.query_id, c",
    "duplicate_copies": f"SELECT content_hash, count(*) AS n, min_by(path, {{'l': length(path), 'p': path}}) AS canonical, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM ({_FILES}) GROUP BY content_hash HAVING count(*) > 1",
    "duplicate_names": f"SELECT regexp_extract(path, '[^/]+$') AS name, count(DISTINCT content_hash) AS n_contents, count(*) AS n FROM ({_FILES}) GROUP BY 1 HAVING count(DISTINCT content_hash) > 1",
    "best_files": "SELECT conv_id, n, '/p' || repeat('x', CAST(part AS INTEGER)) || '/' || conv_id AS path FROM (SELECT conv_id, turn % 3 AS part, count(*) AS n FROM conversations GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, part DESC) = 1",
    "interleave": "WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE lang = 'en'), b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT conv_id AS id FROM conversations)) SELECT id, 'corpus' AS kind, n + n // 2 AS position FROM a UNION ALL SELECT id, 'exchange', n * 3 + 2 FROM b",
    "as_of_tolerance": "SELECT event_id, CASE WHEN ts - c.ts <= INTERVAL 1 HOUR THEN c.id END AS click_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN {'ts': ts, 'id': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events) WHERE event_type = 'purchase'",
}
SQL["motif_metrics"] = f"SELECT query_id, coalesce(p, -1) AS precision, overlap FROM ({SQL['motif_metrics']})"
SQL["transcript_files"] = "SELECT 'c' || conv_id AS conversation_id, '/t/' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || CASE WHEN conv_id % 4 = 0 AND n = p THEN '-part' ELSE '' END || '.json' AS path, CASE WHEN conv_id % 4 = 0 THEN 1 + (p > 0)::INT ELSE 1 END AS n_files FROM (SELECT conv_id, CASE conv_id % 3 WHEN 2 THEN count(*) FILTER (role = 'user') ELSE count(DISTINCT x) END AS n, CASE conv_id % 3 WHEN 2 THEN count(*) FILTER (role = 'user') ELSE 1 END AS p FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY conv_id) WHERE n > 0"

SQL["ranked_lists_cli"] = f"SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (59 + rank)), 9) AS score, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes, any_value(length(text)) AS len FROM (SELECT query_id, doc_id, rank, 'words' AS lane FROM ({LEX}) UNION ALL SELECT query_id, doc_id, rank, 'vectors' FROM ({VEC})) JOIN documents USING (doc_id) GROUP BY query_id, doc_id"
