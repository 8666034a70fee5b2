"""Sinks: appended event lines, conversations as JSON, packages and reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_events(events: DataFrame, folder: str) -> None:
    """Adds events as JSON lines to a folder; what is there stays."""
    events.write.mode("append").json(folder)


def write_conversations(messages: DataFrame, folder: str) -> None:
    """A JSON line a conversation, in a folder a platform: id, title, counts and its messages in order."""
    conversations(messages).write.mode("overwrite").partitionBy("platform").json(folder)


def conversations(messages: DataFrame) -> DataFrame:
    """(platform, conversation_id, title, created_at, updated_at, n_messages, n_prompts, messages) of messages in the readers' columns."""
    row = F.struct("position", "role", "text", "created_at")
    at = F.nullif(F.col("created_at"), F.lit(""))
    return messages.groupBy("platform", "conversation_id").agg(F.max("title").alias("title"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_prompts"), F.array_sort(F.collect_list(row)).alias("messages"))


def short_source(path: Column) -> Column:
    """What stands after the corpus or parsed folder in a path, else the file's name."""
    after = lambda mark: F.substring_index(path, mark, -1)
    return F.when(path.contains("/corpus/"), after("/corpus/")).when(path.contains("/parsed/"), after("/parsed/")).otherwise(after("/"))


def packages(items: DataFrame, anchors: DataFrame, most_anchors: int = 10) -> DataFrame:
    """(package_id, text): each package as markdown, with its theme, at most ``most_anchors`` anchors and its items in order.

    Items are (package_id, theme, platform, place, type, source_file, session_id, exchange_index, content_hash,
    content), anchors (package_id, place, source_file, summary, motifs). A package is of bounded size by its budget.
    """
    i = items.withColumn("h", F.substring("content_hash", 1, 12)).withColumn("src", short_source(F.col("source_file")))
    number = F.lpad((F.col("place") + 1).cast("string"), 3, "0")
    corpus = F.concat(F.lit("### ITEM-"), number, F.lit(" [CORPUS] "), F.col("src"), F.lit(" ["), F.col("h"), F.lit("]"))
    spoken = F.concat(F.lit("### ITEM-"), number, F.lit(" [TRANSCRIPT] "), F.col("platform"), F.lit("/"), F.col("src"), F.lit(" ["), F.col("h"), F.lit("]"), F.when(F.coalesce("session_id", F.lit("")) != "", F.concat(F.lit("\n*Session: "), F.substring("session_id", 1, 12), F.lit(", Exchange: "), F.coalesce(F.col("exchange_index").cast("string"), F.lit("")), F.lit("*"))).otherwise(""))
    entry = F.concat(F.when(F.col("type") == "CORPUS", corpus).otherwise(spoken), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---\n"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["text"]), "\n")
    body = i.select("package_id", "theme", "platform", F.struct("place", entry.alias("text")).alias("e")).groupBy("package_id").agg(F.max("theme").alias("theme"), F.max("platform").alias("platform"), F.count("*").alias("n"), joined(F.collect_list("e")).alias("items"))
    a = anchors.where(F.col("place") < most_anchors)
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    anchor = F.concat_ws("\n", F.concat(F.lit("### ANCHOR-"), (F.col("place") + 1).cast("string"), F.lit(" ["), short_source(F.col("source_file")), F.lit("]")), line("**Rosetta**: ", F.col("summary")), line("**Motifs**: ", F.array_join("motifs", ", ")))
    heads = a.select("package_id", F.struct("place", anchor.alias("text")).alias("e")).groupBy("package_id").agg(joined(F.collect_list("e")).alias("anchors"))
    text = F.concat_ws("\n", F.concat(F.lit("# Theme: "), "theme", F.lit(" \u2014 Analysis Package")), F.concat(F.lit("**Package ID**: "), "package_id"), F.concat(F.lit("**Items**: "), F.col("n").cast("string"), F.lit(" | **Platform**: "), "platform"), F.when(F.col("anchors").isNotNull(), F.concat(F.lit("---\n## Context Anchors\n"), "anchors")), F.lit("---\n## Items for Analysis"), F.col("items"))
    return body.join(heads, "package_id", "left").select("package_id", text.alias("text"))


def metric_report(compared: DataFrame, title: str) -> str:
    """A markdown table of two runs' metrics (metric, old, new, delta, regressed), a row a metric, for reading."""
    head = [f"# {title}", "", "| Metric | Old | New | Change | |", "| --- | --- | --- | --- | --- |"]
    rows = compared.select("metric", "old", "new", "delta", "regressed").orderBy("metric").collect()  # as many as there are metrics
    return "\n".join(head + [f"| {r['metric']} | {r['old']:.4f} | {r['new']:.4f} | {r['delta']:+.4f} | {'regressed' if r['regressed'] else ''} |" for r in rows])
