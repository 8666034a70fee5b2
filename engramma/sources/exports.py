"""Chat exports to messages: (conversation_id, title, platform, position, role, text, created_at).

Files are read whole and parsed as schema-on-read JSON; every format is an expression or an explode. A conversation's
tree is ordered inside its own row, by a helper that walks its ids; so no job depends on how deep a tree is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions import timefn

TREE = "array<struct<title: string, conversation_id: string, id: string, default_model_slug: string, create_time: double, mapping: map<string, struct<id: string, parent: string, children: array<string>, message: struct<author: struct<role: string>, content: struct<content_type: string, parts: array<string>>, recipient: string, create_time: double>>>>>"
BLOCKS = "array<struct<uuid: string, name: string, created_at: string, chat_messages: array<struct<uuid: string, sender: string, created_at: string, text: string, content: array<struct<type: string, text: string, thinking: string, name: string, input: string, tool_use_id: string, id: string, content: string>>>>>>"
RESPONSES = "struct<conversation: struct<id: string, title: string, create_time: string>, responses: array<struct<_id: string, message: string, sender: string, create_time: string, parent_response_id: string, model: string>>>"
INDIVIDUAL = "struct<title: string, url: string, timestamp: string, messages: array<struct<role: string, content: string, timestamp: string>>>"


def detect_format(text: Column) -> Column:
    """tree, blocks, conversations, responses, individual, agent_lines, activity or text.

    The keys of the file's object, or of the first object of its array, decide; a file that is no JSON is agent lines
    if its first line is an object with a session, an activity log if it has the log's marker line, else text.
    """
    j = F.try_parse_json(text)
    has = lambda k: F.coalesce(F.try_variant_get(j, f"$.{k}", "variant"), F.try_variant_get(j, f"$[0].{k}", "variant")).isNotNull()
    line = F.try_parse_json(F.element_at(F.split(F.trim(text), "\n"), 1))
    session = F.coalesce(F.try_variant_get(line, "$.sessionId", "variant"), F.try_variant_get(line, "$.isMeta", "variant")).isNotNull()
    return (
        F.when(has("mapping"), "tree")
        .when(has("chat_messages"), "blocks")
        .when(has("conversations"), "conversations")
        .when(has("responses"), "responses")
        .when(has("messages") & has("title"), "individual")
        .when(session, "agent_lines")
        .when(text.rlike(rf"(?m)^\s*{ACTIVITY_MARK}\s*$"), "activity")
        .otherwise("text")
    )


def platform_of(path: Column) -> Column:
    """The folder above a file, in lower case, else unknown."""
    p = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return F.when(p == "", "unknown").otherwise(p)


def _messages(df: DataFrame, platform: str) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy("sort_key")
    return df.withColumn("position", F.row_number().over(w) - 1).withColumn("platform", F.lit(platform)).select("conversation_id", "title", "platform", "position", "role", "text", "created_at")


def walk_order(nodes: list[tuple[str, str | None, list[str] | None]]) -> list[str]:
    """Ids breadth first from the nodes whose parent is not there; each id once, so cycles end.

    Children are taken in their listed order, or where none are listed in the order of the nodes that name the parent.
    """
    known = {n for n, _, _ in nodes}
    children: dict[str, list[str]] = {n: list(c or []) for n, _, c in nodes}
    listed = {(n, c) for n, cs in children.items() for c in cs}
    for n, parent, _ in nodes:
        if parent in known and (parent, n) not in listed:
            children[parent].append(n)
    order = [n for n, parent, _ in nodes if parent is None or parent not in known]
    seen = set(order)
    for n in order:  # the list grows while it is read
        for c in children[n]:
            if c in known and c not in seen:
                seen.add(c)
                order.append(c)
    return order


def _walk(nodes: Column) -> Column:
    return F.udf(lambda rows: walk_order([tuple(n) for n in rows]), "array<string>")(nodes)


def tree_messages(files: DataFrame, text: str = "text", platform: str = "tree") -> DataFrame:
    """Messages of mapping trees, breadth first from the roots; children in their listed order, however deep. A node is taken once, so cycles end.

    Nodes that no root reaches, and messages without text or author, are left out.
    """
    c = files.select(F.explode(F.from_json(text, TREE)).alias("c")).select(F.coalesce("c.conversation_id", "c.id").alias("conversation_id"), "c.title", "c.mapping")
    nodes = F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.struct(e["key"].alias("n"), e["value"]["parent"].alias("p"), e["value"]["children"].alias("c")))
    n = c.withColumn("order", _walk(nodes)).select("conversation_id", "title", F.posexplode(F.transform("order", lambda node: F.try_element_at(F.col("mapping"), node)["message"])).alias("place", "message")).where("message is not null")
    body = F.array_join(F.filter("message.content.parts", lambda p: p.isNotNull() & (p != "")), "\n")
    m = n.select("conversation_id", "title", F.col("message.author.role").alias("role"), body.alias("text"), timefn.unix_iso(F.col("message.create_time")).alias("created_at"), F.col("place").alias("sort_key"))
    return _messages(m.where("text <> '' and role is not null"), platform)


def block_messages(files: DataFrame, text: str = "text", platform: str = "blocks") -> DataFrame:
    """Messages of content blocks: text blocks joined; each tool call's result stands after it; thinking is left out."""
    c = files.select(F.explode(F.from_json(text, BLOCKS)).alias("c")).select(F.col("c.uuid").alias("conversation_id"), F.col("c.name").alias("title"), F.posexplode("c.chat_messages").alias("i", "m"))
    results = F.map_from_entries(F.transform(F.filter("m.content", lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull()), lambda b: F.struct(b["tool_use_id"], F.coalesce(b["content"], F.lit("")))))
    shown = F.transform("m.content", lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat_ws("\n", F.concat(F.lit("[tool: "), b["name"], F.lit("]")), F.element_at(results, b["id"]))))
    body = F.coalesce(F.nullif(F.array_join(F.array_compact(shown), "\n"), F.lit("")), F.col("m.text"), F.lit(""))
    role = F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender"))
    return _messages(c.select("conversation_id", "title", role.alias("role"), body.alias("text"), F.col("m.created_at").alias("created_at"), F.col("i").alias("sort_key")).where("text <> ''"), platform)


BLOCK_DETAILS = "array<struct<uuid: string, chat_messages: array<struct<sender: string, content: array<string>, attachments: array<struct<file_name: string, extracted_content: string>>, files: array<struct<file_name: string>>>>>>"
_BLOCK = "struct<type: string, text: string, thinking: string, summaries: array<string>, name: string, id: string, tool_use_id: string, input: string, content: string, citations: array<struct<url: string, title: string>>>"


def block_details(files: DataFrame, text: str = "text") -> DataFrame:
    """(conversation_id, place, thinking, artifacts, tools, citations, attachments) of each message of content blocks, by its place in the file.

    Thinking blocks are joined, their summaries marked; uses of the tool ``artifacts`` are artifacts (id, type, title,
    command, content), other uses are tools with the output of their result, which is text or a list of text blocks.
    """
    m = files.select(F.explode(F.from_json(text, BLOCK_DETAILS)).alias("c")).select(F.col("c.uuid").alias("conversation_id"), F.posexplode("c.chat_messages").alias("place", "m"))
    b = F.transform(F.coalesce("m.content", F.array().cast("array<string>")), lambda x: F.from_json(x, _BLOCK))
    m = m.select("conversation_id", "place", F.filter(b, lambda x: x.isNotNull()).alias("b"), "m.attachments", "m.files")
    of = lambda kind: F.filter("b", lambda x: x["type"] == kind)
    marked = lambda x: F.transform(F.coalesce(x["summaries"], F.array().cast("array<string>")), lambda t: F.concat(F.lit("[Summary] "), t))
    thinking = F.array_join(F.flatten(F.transform(of("thinking"), lambda x: F.concat(F.array_compact(F.array(F.nullif(x["thinking"], F.lit("")))), marked(x)))), "\n")
    made = F.filter(of("tool_use"), lambda x: x["name"] == "artifacts")
    field = lambda x, k: F.coalesce(F.get_json_object(x["input"], f"$.{k}"), F.lit(""))
    artifacts = F.transform(made, lambda x: F.struct(*(field(x, k).alias(k) for k in ("id", "type", "title", "command", "content"))))
    listed = lambda c: F.array_join(F.filter(F.transform(F.from_json(c, "array<struct<type: string, text: string>>"), lambda t: F.when(t["type"] == "text", t["text"])), lambda t: t.isNotNull()), "\n")
    output = lambda x: F.when(x["content"].startswith("["), listed(x["content"])).otherwise(x["content"])
    results = F.map_from_entries(F.transform(F.array_distinct(F.transform(of("tool_result"), lambda x: x["tool_use_id"])), lambda i: F.struct(F.coalesce(i, F.lit("")), output(F.get(F.filter(of("tool_result"), lambda x: x["tool_use_id"].eqNullSafe(i)), F.lit(0))))))
    used = F.filter(of("tool_use"), lambda x: ~x["name"].eqNullSafe(F.lit("artifacts")))
    tools = F.transform(used, lambda x: F.struct(x["name"].alias("name"), x["input"].alias("input"), F.try_element_at(results, F.coalesce(x["id"], F.lit("?"))).alias("output")))
    citations = F.flatten(F.transform(of("text"), lambda x: F.coalesce(x["citations"], F.array().cast("array<struct<url: string, title: string>>"))))
    held = F.transform(F.coalesce("attachments", F.array().cast("array<struct<file_name: string, extracted_content: string>>")), lambda a: F.struct(a["file_name"].alias("name"), a["extracted_content"].alias("content")))
    named = F.transform(F.coalesce("files", F.array().cast("array<struct<file_name: string>>")), lambda f: F.struct(f["file_name"].alias("name"), F.lit(None).cast("string").alias("content")))
    return m.select("conversation_id", "place", thinking.alias("thinking"), artifacts.alias("artifacts"), tools.alias("tools"), citations.alias("citations"), F.concat(held, named).alias("attachments"))


def tree_artifacts(files: DataFrame, text: str = "text") -> DataFrame:
    """(conversation_id, node, kind, name, content) of mapping trees' messages: documents made or changed on the canvas, pictures, outputs of tools.

    A canvas message goes to a recipient ``canmore.…`` and holds {name, type, content}; what can't be read so is no
    artifact. A tool's message is a picture if a part of it points at one, else its text is its output.
    """
    c = files.select(F.explode(F.from_json(text, TREE)).alias("c")).select(F.coalesce("c.conversation_id", "c.id").alias("conversation_id"), F.explode("c.mapping").alias("node", "v")).where("v.message is not null")
    parts = F.coalesce("v.message.content.parts", F.array().cast("array<string>"))
    c = c.select("conversation_id", "node", F.col("v.message.author.role").alias("role"), F.coalesce("v.message.recipient", F.lit("all")).alias("recipient"), parts.alias("parts"))
    first = F.get("parts", F.lit(0))
    picture = F.get(F.filter(F.transform("parts", lambda p: F.get_json_object(p, "$.asset_pointer")), lambda p: p.isNotNull()), F.lit(0))
    said = F.array_join(F.filter("parts", lambda p: p.isNotNull() & (p != "") & ~p.startswith('{"content_type"')), "\n")
    canvas = F.col("recipient").startswith("canmore.") & F.get_json_object(first, "$.content").isNotNull()
    kind = F.when(canvas, "canvas").when((F.col("role") == "tool") & picture.isNotNull(), "picture").when((F.col("role") == "tool") & (said != ""), "output")
    name = F.when(canvas, F.coalesce(F.get_json_object(first, "$.name"), F.lit("untitled"))).otherwise("")
    content = F.when(canvas, F.get_json_object(first, "$.content")).when(kind == "picture", picture).otherwise(said)
    return c.select("conversation_id", "node", kind.alias("kind"), name.alias("name"), content.alias("content")).where("kind is not null")


#: A line that cuts a long answer into several messages.
DIVIDER = r"\n---+\n"


def response_messages(files: DataFrame, text: str = "text", platform: str = "responses") -> DataFrame:
    """Messages of response lists in their order, one message for each part that a divider line cuts; extended-JSON dates become ISO text."""
    c = files.select(F.from_json(text, RESPONSES).alias("c")).where("c.responses is not null").select(F.col("c.conversation.id").alias("conversation_id"), F.col("c.conversation.title").alias("title"), F.posexplode("c.responses").alias("i", "r"))
    at = timefn.store_date_iso(F.col("r.create_time"))
    role = F.when(F.lower("r.sender") == "human", "user").otherwise("assistant")
    parts = c.select("conversation_id", "title", role.alias("role"), at.alias("created_at"), "i", F.posexplode(F.split("r.message", DIVIDER)).alias("j", "part"))
    return _messages(parts.select("conversation_id", "title", "role", F.trim("part").alias("text"), "created_at", F.struct("created_at", "i", "j").alias("sort_key")).where("text <> ''"), platform)


CONVERSATIONS = "struct<conversations: array<struct<conversation: struct<id: string, conversation_id: string, title: string, user_id: string, system_prompt_id: string, leaf_response_id: string>, responses: array<struct<response: struct<_id: string, response_id: string, message: string, sender: string, create_time: string, parent_response_id: string, model: string, file_attachments: array<string>, thinking_trace: string, thinking_start_time: string, thinking_end_time: string>>>>>>"


def conversation_tree_messages(files: DataFrame, text: str = "text", assets: DataFrame | None = None) -> DataFrame:
    """Messages of bulk exports whose responses name their parent, breadth first from all roots; roots and children go by creation time.

    The platform is told by the keys of the conversation. Beside the common columns: model, thinking, thinking_ms,
    attachments (uuid, content) with the contents of ``assets`` (uuid, content) where they are given.
    """
    c = files.select(F.explode(F.from_json(text, CONVERSATIONS)["conversations"]).alias("c"))
    c = c.select(F.coalesce("c.conversation.id", "c.conversation.conversation_id").alias("conversation_id"), F.coalesce("c.conversation.title", F.lit("Untitled")).alias("title"), F.coalesce("c.conversation.user_id", "c.conversation.system_prompt_id", "c.conversation.leaf_response_id").isNotNull().alias("other"), F.transform("c.responses", lambda r: r["response"]).alias("rs"))
    ident = lambda r: F.coalesce(r["_id"], r["response_id"])
    rs = F.filter("rs", lambda r: ident(r).isNotNull())
    dated = F.array_sort(F.transform(rs, lambda r: F.struct(timefn.store_date_iso(r["create_time"]).alias("at"), ident(r).alias("id"), r["parent_response_id"].alias("up"), r.alias("r"))))
    nodes = F.transform(F.col("d"), lambda x: F.struct(x["id"].alias("n"), x["up"].alias("p"), F.lit(None).cast("array<string>").alias("c")))
    c = c.withColumn("d", dated).withColumn("order", _walk(nodes))
    m = c.select("conversation_id", "title", "other", F.explode("d").alias("x"), "order").select("conversation_id", "title", "other", "x.r", F.col("x.at").alias("created_at"), F.array_position("order", F.col("x.id")).alias("sort_key")).where("sort_key > 0")
    ms = lambda c: F.get_json_object(c, "$['$date']['$numberLong']").try_cast("long")
    role = F.when(F.lower("r.sender") == "human", "user").otherwise("assistant")
    m = m.select("conversation_id", "title", F.when(F.col("other"), "claude_chat").otherwise("grok").alias("platform"), role.alias("role"), F.coalesce("r.message", F.lit("")).alias("text"), "created_at", "sort_key", F.coalesce("r.model", F.lit("")).alias("model"), F.coalesce("r.thinking_trace", F.lit("")).alias("thinking"), (ms(F.col("r.thinking_end_time")) - ms(F.col("r.thinking_start_time"))).alias("thinking_ms"), F.coalesce("r.file_attachments", F.array().cast("array<string>")).alias("uuids"))
    w = Window.partitionBy("conversation_id").orderBy("sort_key")
    m = m.where((F.col("text") != "") | (F.size("uuids") > 0)).withColumn("position", F.row_number().over(w) - 1)
    held = m.select("conversation_id", "position", F.explode("uuids").alias("uuid"))
    held = held.join(assets.select("uuid", "content"), "uuid", "left") if assets is not None else held.withColumn("content", F.lit(None).cast("string"))
    held = held.groupBy("conversation_id", "position").agg(F.array_sort(F.collect_list(F.struct("uuid", "content"))).alias("attachments"))
    m = m.join(held, ["conversation_id", "position"], "left").withColumn("attachments", F.coalesce("attachments", F.array().cast("array<struct<uuid: string, content: string>>")))
    return m.select("conversation_id", "title", "platform", "position", "role", "text", "created_at", "model", "thinking", "thinking_ms", "attachments")


def individual_messages(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Messages of single-conversation files {title, url, timestamp, messages}; the platform is the file name's first word."""
    c = files.select(F.col(path).alias("p"), F.from_json(text, INDIVIDUAL).alias("c")).where("c.messages is not null")
    m = c.select(F.sha2(F.encode(F.coalesce("c.url", "p"), "utf-8"), 256).alias("conversation_id"), F.col("c.title").alias("title"), F.lower(F.regexp_extract("p", r"([A-Za-z]+)[^/]*$", 1)).alias("pl"), F.posexplode("c.messages").alias("sort_key", "m"))
    out = m.select("conversation_id", "title", "pl", "sort_key", F.col("m.role").alias("role"), F.col("m.content").alias("text"), F.coalesce("m.timestamp", F.lit(None).cast("string")).alias("created_at"))
    w = Window.partitionBy("conversation_id").orderBy("sort_key")
    return out.withColumn("position", F.row_number().over(w) - 1).select("conversation_id", "title", F.col("pl").alias("platform"), "position", "role", "text", "created_at")


# Lines that a chat page's controls leave in copied text.
PAGE_LINES = r"(?i)^(?:To view keyboard shortcuts|View keyboard shortcuts|See new posts|Grok \d|DeepSearch$|Think$|Edit Image$|Expand for details|\d+ web pages?$|\d+ sources?$|Tap to read|Show thinking|Completed DeepSearch|Thought for|Searching for|Browsing|\d+\+$|File$)"
_OPENERS = r"^(?:Hello|Alright|Given|Below)"


def without_page_lines(text: Column) -> Column:
    """A text's lines without those of a page's controls."""
    return F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(PAGE_LINES))


def labelled_text(files: DataFrame, text: str = "text", path: str = "path", user: str = "you|user|human", other: str = "assistant|ai|grok|gemini|claude|chatgpt", least: int = 1) -> DataFrame:
    """Messages of plain text in which a line names the speaker, alone or before a colon and the message; lines before the first label are left out.

    Files of fewer than ``least`` labels have no rows, nor have blank lines a place in a message.
    """
    lines = files.select(F.col(path).alias("conversation_id"), F.posexplode(without_page_lines(F.col(text))).alias("i", "line"))
    label = lambda who: rf"(?i)^\s*(?:{who})\s*(?::\s*(.*))?$"
    role = F.when(F.col("line").rlike(label(user)), "user").when(F.col("line").rlike(label(other)), "assistant")
    rest = F.when(F.col("r") == "user", F.regexp_extract("line", label(user), 1)).when(F.col("r") == "assistant", F.regexp_extract("line", label(other), 1)).otherwise(F.col("line"))
    file = Window.partitionBy("conversation_id")
    l = lines.withColumn("r", role).withColumn("said", rest).withColumn("g", F.sum(F.col("r").isNotNull().cast("int")).over(file.orderBy("i")))
    l = l.withColumn("labels", F.count("r").over(file)).where((F.col("g") > 0) & (F.col("labels") >= least) & (F.trim("said") != ""))
    roles = lines.withColumn("r", role).withColumn("g", F.sum(F.col("r").isNotNull().cast("int")).over(file.orderBy("i"))).where("r is not null").select("conversation_id", "g", F.col("r").alias("role"))
    rows = F.array_sort(F.collect_list(F.struct("i", "said")))
    g = l.groupBy("conversation_id", "g").agg(F.trim(F.array_join(F.transform(rows, lambda x: x["said"]), "\n")).alias("text")).join(roles, ["conversation_id", "g"])
    return _messages(g.select("conversation_id", F.lit(None).cast("string").alias("title"), "role", "text", F.lit(None).cast("string").alias("created_at"), F.col("g").alias("sort_key")).where("text <> ''"), "text")


def alternating_blocks(files: DataFrame, text: str = "text", path: str = "path", openers: str = _OPENERS) -> DataFrame:
    """Messages of plain text without labels: blocks between blank lines, a short question (under 300 characters) being the user's.

    The user's turn ends at a block that opens like an answer or, once it has text, is no short question; an answer
    ends at a short question that does not begin with yes, no or however. Who speaks depends on all blocks before, and
    is folded over a file's blocks.
    """
    kept = F.array_join(without_page_lines(F.col(text)), "\n")
    blocks = F.filter(F.split(kept, r"\n\s*\n"), lambda b: F.trim(b) != "")
    state = "struct<role: string, any: boolean, turn: int, out: array<struct<turn: int, role: string, block: string>>>"
    start = F.from_json(F.lit('{"role": "user", "any": false, "turn": 0, "out": []}'), state)

    def step(s: Column, b: Column) -> Column:
        question = (F.length(b) < 300) & b.contains("?")
        to_answer = (s["role"] == "user") & (b.rlike(openers) | (s["any"] & ~question))
        to_user = (s["role"] == "assistant") & question & ~b.rlike(r"^(?:Yes|No|However)")
        turn = s["turn"] + F.when((to_answer & s["any"]) | to_user, 1).otherwise(0)
        role = F.when(to_answer, "assistant").when(to_user, "user").otherwise(s["role"])
        return F.struct(role.alias("role"), F.lit(True).alias("any"), turn.cast("int").alias("turn"), F.concat(s["out"], F.array(F.struct(turn.cast("int").alias("turn"), role.alias("role"), b.alias("block")))).alias("out"))

    f = files.select(F.col(path).alias("conversation_id"), F.posexplode(F.aggregate(blocks, start, step)["out"]).alias("i", "x"))
    rows = F.array_sort(F.collect_list(F.struct("i", F.col("x.block").alias("b"))))
    g = f.groupBy("conversation_id", F.col("x.turn").alias("g"), F.col("x.role").alias("role")).agg(F.trim(F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n")).alias("text"))
    return _messages(g.select("conversation_id", F.lit(None).cast("string").alias("title"), "role", "text", F.lit(None).cast("string").alias("created_at"), F.col("g").alias("sort_key")), "text")


ACTIVITY_MARK = "Logo for Gemini Apps"


def activity_log(files: DataFrame, text: str = "text", path: str = "path", otherwise: str = "2026-02-17") -> DataFrame:
    """(path, exchange_index, user_text, response_text, created_at) of an activity log.

    A block begins with the log's marker line; its third line is the prompt, its sixth the date, and its answer stands
    after the line ``chat``. Days without a year are read against the date in the file's name, else ``otherwise``.
    """
    named = F.regexp_extract(path, r"(\d{4}_\d{2}_\d{2})(?:_\d{2}_\d{2})?(?:\.[^./]*)?$", 1)
    day = F.coalesce(F.try_to_date(F.nullif(named, F.lit("")), "yyyy_MM_dd"), F.lit(otherwise).cast("date"))
    b = files.select(F.col(path).alias("path"), day.alias("day"), F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text), F.lit("\n")), rf"\n[ \t]*{ACTIVITY_MARK}[ \t]*(?=\n)")).alias("i", "block")).where("i > 0")
    line = lambda k: F.coalesce(F.get("l", F.lit(k)), F.lit(""))
    b = b.withColumn("l", F.split("block", "\n"))  # the first is what follows the marker on its line: nothing
    at = F.array_position(F.transform(F.slice("l", 4, 9), F.trim), "chat")
    start = F.when(at > 0, at + 4).otherwise(F.lit(11))
    start = F.when((at > 0) & (F.trim(F.coalesce(F.get("l", (start - 1).cast("int")), F.lit("x"))) == ""), start + 1).otherwise(start)
    answer = F.array_join(F.slice("l", start.cast("int"), F.greatest(F.lit(0), F.size("l"))), "\n")
    out = b.where(F.size("l") > 5).select("path", "i", F.trim(F.regexp_replace(line(2), r"^Prompted ", "")).alias("user_text"), F.regexp_replace(answer, r"^\s+|\s+$", "").alias("response_text"), timefn.activity_date(line(5), F.col("day")).alias("created_at")).where("user_text <> ''")
    return out.withColumn("exchange_index", F.row_number().over(Window.partitionBy("path").orderBy("i")) - 1).drop("i")


def first_source(sources: list[DataFrame]) -> DataFrame:
    """Exchanges (user_text, response_text, created_at, …) of several sources, in order of trust: each once, from the first source and the first row there that has it."""
    from engramma.functions.text import source_hash

    every = None
    for i, s in enumerate(sources):
        s = s.select("user_text", "response_text", "created_at", "path", "exchange_index").withColumn("source_order", F.lit(i))
        every = s if every is None else every.unionByName(s)
    every = every.withColumn("hash", source_hash(F.col("user_text"), F.col("response_text")))
    firsts = every.groupBy("hash").agg(F.min(F.struct("source_order", "path", "exchange_index", "user_text", "response_text", "created_at")).alias("r"))
    return firsts.select("hash", "r.*")


def with_artifacts(exchanges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Exchanges (hash, response_text) with the artifacts (name, content) whose name stands in the first 500 characters of the answer.

    Names and answers meet by the words of the name: a pair must share its first, and is then looked for whole.
    """
    first = lambda c: F.get(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lit(0))
    a = artifacts.select("name", "content", first(F.col("name")).alias("w"))
    head = F.lower(F.substring("response_text", 1, 500))
    e = exchanges.select("hash", head.alias("h"), F.explode(F.array_distinct(F.split(head, r"[^\p{L}\p{N}]+"))).alias("w")).where("w <> ''")
    met = e.join(a, "w").where(F.col("h").contains(F.lower("name"))).groupBy("hash").agg(F.array_sort(F.collect_set(F.struct("name", "content"))).alias("artifacts"))
    return exchanges.join(met, "hash", "left").withColumn("artifacts", F.coalesce("artifacts", F.array().cast("array<struct<name: string, content: string>>")))


def divider_markdown(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Messages of markdown cut by ``---`` lines: a block's ``# `` line is the prompt, the rest its answer; a block without one goes on the answer before."""
    b = files.select(F.col(path).alias("conversation_id"), F.posexplode(F.split(text, r"\n---\n")).alias("i", "block"))
    b = b.withColumn("prompt", F.nullif(F.regexp_extract("block", r"(?m)^#\s+(.+)$", 1), F.lit(""))).withColumn("answer", F.trim(F.regexp_replace("block", r"(?m)^#\s+.+\n?", "")))
    w = Window.partitionBy("conversation_id").orderBy("i")
    b = b.withColumn("g", F.sum(F.col("prompt").isNotNull().cast("int")).over(w)).where("g > 0")
    rows = F.array_sort(F.collect_list(F.struct("i", "answer")))
    g = b.groupBy("conversation_id", "g").agg(F.max("prompt").alias("prompt"), F.trim(F.array_join(F.transform(rows, lambda x: x["answer"]), "\n\n")).alias("answer"))
    both = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text"), (F.col("g") * 2).alias("k")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), (F.col("g") * 2 + 1).alias("k"))))
    m = g.select("conversation_id", both.alias("x")).select("conversation_id", F.lit(None).cast("string").alias("title"), "x.role", "x.text", F.lit(None).cast("string").alias("created_at"), F.col("x.k").alias("sort_key"))
    return _messages(m.where("text <> ''"), "markdown")


def agent_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Messages of agent transcripts, a JSON object a line: user and assistant lines with text, without meta and tool-result-only lines."""
    j = lines.select(F.from_json(value, "type string, isMeta boolean, timestamp string, sessionId string, message string").alias("j")).select("j.*").where("type in ('user', 'assistant') and not coalesce(isMeta, false)")
    content = F.get_json_object("message", "$.content")
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    body = F.when(content.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(content)
    m = j.select(F.col("sessionId").alias("conversation_id"), F.lit(None).cast("string").alias("title"), F.col("type").alias("role"), body.alias("text"), F.col("timestamp").alias("created_at"), F.col("timestamp").alias("sort_key"))
    return _messages(m.where("text is not null and text <> ''"), "agent")
