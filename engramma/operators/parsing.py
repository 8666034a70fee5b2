"""Answers of models and transcripts as text: found JSON, normalised exchanges, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<hash: string, content_hash: string, rosetta_summary: string, motifs: array<struct<motif_id: string, amp: double, confidence: double, description: string>>>"
ITEMS = f"struct<items: array<{ITEM}>>"
BATCH = "array<struct<hash: string, motifs: array<string>, rosetta: string>>"


def repaired_object(text: Column) -> Column:
    """What begins at the first brace, cut after its last comma or closing mark and closed by as many brackets and braces as are open; null without a brace."""
    body = F.when(F.locate("{", text) > 0, F.substring(text, F.locate("{", text), F.length(text)))
    many = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    braces, brackets = many("{") - many("}"), many("[") - many("]")
    cut = F.regexp_replace(F.regexp_extract(body, r"(?s)^(.*[,}\]])", 1), r",\s*$", "")
    closed = F.concat(F.when(cut == "", body).otherwise(cut), F.repeat(F.lit("]"), F.greatest(brackets, F.lit(0))), F.repeat(F.lit("}"), F.greatest(braces, F.lit(0))))
    return F.when((braces > 0) | (brackets > 0), closed).otherwise(body)


def repaired_array(text: Column) -> Column:
    """What begins at the first bracket, cut after its last closing brace and closed; null without both."""
    body = F.when(F.locate("[", text) > 0, F.substring(text, F.locate("[", text), F.length(text)))
    cut = F.nullif(F.regexp_extract(body, r"(?s)^(.*\})", 1), F.lit(""))
    many = lambda c: F.length(cut) - F.length(F.replace(cut, F.lit(c), F.lit("")))
    return F.concat(cut, F.repeat(F.lit("}"), F.greatest(many("{") - many("}"), F.lit(0))), F.lit("]"))


def _json(text: Column, schema: str) -> Column:
    """The parsed text, null if it is no JSON of the wanted outer form."""
    whole = F.try_parse_json(text)  # refuses what follows the value, and values cut short
    return F.when(whole.isNotNull(), F.from_json(text, schema))


def parse_items(text: Column) -> Column:
    """struct<items, how> of a model's answer, null if nothing in it can be read.

    Tried in turn: the answer as JSON with items; each fenced block; what lies between the outermost braces; that with
    open ends closed; single flat objects with a hash and a summary; a wrapper {content_hash, response: one item}.
    """
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract_all(t, F.lit(r"(?s)```(?:json)?\s*\n(.*?)\n```"), F.lit(1))
    outer = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    singles = F.array_compact(F.transform(F.regexp_extract_all(t, F.lit(r'(\{[^{}]*"hash"[^{}]*"rosetta_summary"[^{}]*\})'), F.lit(1)), lambda x: _json(x, ITEM)))
    inner = F.get_json_object(t, "$.response")
    one = _json(inner, ITEM)
    wrapped = F.array(F.struct(F.coalesce(one["hash"], F.substring(F.get_json_object(t, "$.content_hash"), 1, 12)).alias("hash"), one["content_hash"].alias("content_hash"), one["rosetta_summary"].alias("rosetta_summary"), one["motifs"].alias("motifs")))
    have = lambda items, how: F.when(items.isNotNull(), F.struct(items.alias("items"), F.lit(how).alias("how")))
    items = lambda x: _json(x, ITEMS)["items"]
    return F.coalesce(
        have(items(t), "direct"),
        have(F.get(F.array_compact(F.transform(fenced, lambda x: items(F.trim(x)))), F.lit(0)), "fenced"),
        have(items(outer), "braces"),
        have(items(repaired_object(t)), "repaired"),
        F.when(F.size(singles) > 0, F.struct(singles.alias("items"), F.lit("singles").alias("how"))),
        F.when(one["rosetta_summary"].isNotNull(), F.struct(wrapped.alias("items"), F.lit("wrapper").alias("how"))),
    )


def parse_batch(text: Column) -> Column:
    """The rows of an answer that is a JSON array, null if none can be read: a fenced array, any fence, the outermost brackets, the whole, one cut short."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    named, plain = (F.regexp_extract(t, p, 1) for p in (r"(?s)```json\s*\n(\[.*?\])\s*\n```", r"(?s)```\s*\n(\[.*?\])\s*\n```"))
    return F.coalesce(*(_json(x, BATCH) for x in (named, plain, F.regexp_extract(t, r"(?s)(\[.*\])", 1), t, repaired_array(t))))


def item_issues(items: Column, known: Column) -> Column:
    """For each item what is wrong with it: hash, summary, motifs that are not among ``known`` (an array)."""

    def issues(x: Column) -> Column:
        strange = F.filter(F.transform(F.coalesce(x["motifs"], F.array()), lambda m: F.coalesce(m["motif_id"], F.lit(""))), lambda m: ~F.array_contains(known, m))
        found = F.array(
            F.when(F.coalesce(x["hash"], F.lit("")) == "", "missing hash").when(F.length(x["hash"]) < 8, F.concat(F.lit("hash too short: "), x["hash"])),
            F.when(F.coalesce(x["rosetta_summary"], F.lit("")) == "", "missing rosetta_summary").when(F.length(x["rosetta_summary"]) < 20, "rosetta_summary too short"),
            F.when(F.coalesce(F.size(x["motifs"]), F.lit(0)) <= 0, "no motifs assigned"),
        )
        return F.array_compact(F.concat(found, F.transform(strange, lambda m: F.concat(F.lit("invalid motif: "), m))))

    return F.transform(items, issues)


def annotations(motif_json: Column) -> Column:
    """Lines ``id (0.00): description`` of motif data, a list of objects or an object by id; null for what is neither."""
    one = "struct<motif_id: string, amp: double, description: string>"
    listed = F.when(motif_json.startswith("["), F.from_json(motif_json, f"array<{one}>"))
    named = F.when(motif_json.startswith("{"), F.from_json(motif_json, f"map<string, {one}>"))
    by_name = F.transform(F.array_sort(F.map_entries(named)), lambda e: F.struct(e["key"].alias("motif_id"), e["value"]["amp"].alias("amp"), e["value"]["description"].alias("description")))
    line = lambda m: F.concat(m["motif_id"], F.format_string(" (%.2f): ", F.coalesce(m["amp"], F.lit(0.0))), F.coalesce(m["description"], F.lit("")))
    return F.array_join(F.transform(F.coalesce(listed, by_name), line), "\n")


_RESPONSE = "struct<text: string, model: string, artifacts: array<struct<type: string, language: string, content: string>>, tools: array<struct<type: string, output: string, result: string>>, metadata: struct<thinking_trace: string, model: string>>"
_EXCHANGE = "struct<user_prompt: string, prompt: string, response: string, role: string, content: string, timestamp: string, responses: array<string>>"
_CONVERSATION = f"struct<conversation_id: string, sessionId: string, session_id: string, title: string, platform: string, model: string, created_at: string, exchanges: array<{_EXCHANGE}>>"


def conversation_id(data: Column, otherwise: Column) -> Column:
    """The first of three id fields that is not empty, else another value (a file's stem)."""
    return F.coalesce(*(F.nullif(data[k], F.lit("")) for k in ("conversation_id", "sessionId", "session_id")), otherwise)


def normalised_exchanges(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(path, conversation_id, exchange_index, user_text, assistant_text, thinking, model, timestamp, artifacts, tools) of parsed transcripts.

    Three shapes are told apart by the first exchange: messages with a role (a user's and the assistant's that follows
    at once are one exchange); prompt and response (text, or an object with text); user_prompt with responses (texts or
    objects: texts joined by line ends, artifacts and tools gathered, the first thinking and model taken, else the
    file's model). Files that are no such JSON have no rows.
    """
    c = files.select(path, F.from_json(text, _CONVERSATION).alias("c")).where("c.exchanges is not null and size(c.exchanges) > 0")
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    c = c.select(path, conversation_id(F.col("c"), stem).alias("conversation_id"), F.col("c.model").alias("top_model"), F.col("c.exchanges").alias("e"))
    clean = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    artifact, tool = "struct<type: string, language: string, content: string>", "struct<type: string, output: string, result: string>"
    shape = F.when(F.get("e", F.lit(0))["role"].isNotNull(), "C").when(F.get("e", F.lit(0))["prompt"].isNotNull(), "B").otherwise("A")

    def made(user, answer, at, model, thinking=None, artifacts=None, tools=None) -> Column:
        return F.struct(clean(user).alias("user_text"), clean(answer).alias("assistant_text"), (F.lit("") if thinking is None else thinking).alias("thinking"), F.coalesce(model, F.lit("")).alias("model"), F.coalesce(at, F.lit("")).alias("timestamp"), (none(artifact) if artifacts is None else artifacts).alias("artifacts"), (none(tool) if tools is None else tools).alias("tools"))

    following = lambda i: F.get("e", i + 1)
    flat = F.filter(F.transform("e", lambda x, i: F.when(x["role"] == "user", made(x["content"], F.when(following(i)["role"] == "assistant", following(i)["content"]), x["timestamp"], F.lit("claude_code")))), lambda x: x.isNotNull())
    plain = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)
    paired = F.transform("e", lambda x: made(x["prompt"], plain(x["response"]), x["timestamp"], F.lit("perplexity")))

    def gathered(x: Column) -> Column:
        parts = F.transform(F.coalesce(x["responses"], none("string")), lambda r: F.when(r.startswith("{"), F.from_json(r, _RESPONSE)).otherwise(F.from_json(F.to_json(F.struct(r.alias("text"))), _RESPONSE)))
        first = lambda get: F.get(F.filter(F.transform(parts, get), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
        every = lambda get, kind: F.flatten(F.transform(parts, lambda r: F.coalesce(get(r), none(kind))))
        answer = F.array_join(F.filter(F.transform(parts, lambda r: r["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
        model = F.coalesce(first(lambda r: F.coalesce(F.nullif(r["metadata"]["model"], F.lit("")), r["model"])), F.col("top_model"))
        return made(x["user_prompt"], answer, x["timestamp"], model, F.coalesce(first(lambda r: r["metadata"]["thinking_trace"]), F.lit("")), every(lambda r: r["artifacts"], artifact), every(lambda r: r["tools"], tool))

    rows = F.when(shape == "C", flat).when(shape == "B", paired).otherwise(F.transform("e", gathered))
    return c.select(path, "conversation_id", F.posexplode(rows).alias("exchange_index", "x")).select(path, "conversation_id", "exchange_index", "x.*")


def exchange_text(exchange: dict[str, Column], platform: Column, conversation: Column) -> Column:
    """One exchange as text: platform and session, model, both sides, thinking (2000 characters), artifacts, and tool outputs of more than 50 characters."""
    x = exchange
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    thinking = F.when(F.length(x["thinking"]) > 2000, F.concat(F.substring(x["thinking"], 1, 2000), F.lit("... (truncated)"))).otherwise(x["thinking"])
    artifact = lambda a: F.when(F.coalesce(a["content"], F.lit("")) != "", F.concat(F.lit("\n[Artifact "), F.coalesce(a["type"], F.lit("unknown")), F.when(F.coalesce(a["language"], F.lit("")) != "", F.concat(F.lit("/"), a["language"])).otherwise(""), F.lit("]:\n"), a["content"]))
    output = lambda t: F.coalesce(F.nullif(t["output"], F.lit("")), t["result"], F.lit(""))
    tool = lambda t: F.when(F.length(output(t)) > 50, F.concat(F.lit("\n[Tool "), F.coalesce(t["type"], F.lit("unknown")), F.lit("]: "), output(t)))
    head = F.concat(F.lit("[Platform: "), platform, F.lit("] [Session: "), F.substring(conversation, 1, 12), F.lit("]"))
    model = F.when(F.coalesce(x["model"], F.lit("")) != "", F.concat(F.lit("[Model: "), x["model"], F.lit("]")))
    parts = F.concat(F.array(head, model, line("\n[User]: ", x["user_text"]), line("\n[Assistant]: ", x["assistant_text"]), line("\n[Thinking]: ", thinking)), F.transform(x["artifacts"], artifact), F.transform(x["tools"], tool))
    return F.array_join(F.array_compact(parts), "\n")


def transcript_manifest(exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept files, owners of exchanges) of exchanges (path, conversation_id, exchange_index, user_text, assistant_text).

    Of the files of one conversation that with the most exchanges stays, then that with the longest path. Of equal
    exchanges in kept files the first in path order owns the hash.
    """
    from engramma.functions.text import exchange_hash

    n = exchanges.groupBy("conversation_id", "path").agg(F.count("*").alias("n"))
    kept = n.groupBy("conversation_id").agg(F.max_by(F.struct("path", "n"), F.struct("n", F.length("path"), "path")).alias("k"), F.count("*").alias("n_files")).select("conversation_id", "k.path", F.col("k.n").alias("n_exchanges"), "n_files")
    e = exchanges.join(kept.select("conversation_id", "path"), ["conversation_id", "path"], "left_semi")
    e = e.withColumn("hash", exchange_hash(F.col("user_text"), F.col("assistant_text")))
    owner = e.groupBy("hash").agg(F.min(F.struct("path", "exchange_index", "conversation_id")).alias("o"), F.count("*").alias("n")).select("hash", "o.*", "n")
    return kept, owner


def owned_exchanges(exchanges: DataFrame, owners: DataFrame) -> DataFrame:
    """The exchanges that own their hash, by file and place."""
    return exchanges.join(owners.select("path", "exchange_index"), ["path", "exchange_index"], "left_semi")
