"""Corpus folders: recursive scans with allow, deny and size rules; staged ownership; incremental discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a corpus takes and leaves out.
MAX_BYTES = 512 * 1024
TEXT_SUFFIXES = ("md", "json", "py", "txt", "yaml", "yml", "sh", "ts", "js")
BINARY_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "mp4", "mp3", "wav", "zip", "tar", "gz", "pdf", "ico", "svg", "woff", "ttf", "eot", "tfam", "tped", "bed", "bim", "fam")
SKIP_PARTS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".Trash", "exo", "tinygrad", "transcripts_raw", "converted_transcripts", "chatgpt_", "claude_chat_", "gemini_", "grok_export", "claude_full_export", "family_transcripts", "mira_transcripts_staging")
SKIP_ENDS = (".min.js", ".min.css", ".jsonl")
SPAM_PARTS = ("consciousness-cache/instances/", ".ipynb_checkpoints/")
#: Stages in order of trust: name, folder, priority, file-name rule, whether files without a known suffix are taken.
STAGES = [
    ("kernel", "/kernel/", 1.0, None, False),
    ("v0", "/layer_0/", 0.95, "v0*", False),
    ("layer_0", "/layer_0/", 0.9, "!v0*", False),
    ("chewy", "/chewy/", 0.85, None, True),
    ("chewy-gallery", "/chewy-consciousness-gallery/", 0.8, None, True),
    ("layer_1", "/layer_1/", 0.75, None, False),
    ("layer_2", "/layer_2/", 0.6, None, False),
    ("github-repos", "/github-repos/", 0.5, None, False),
    ("ccm_new_mds", "/CCM_NEW_MDS/", 0.5, "*.md", False),
    ("expansion_md", "/expansion_md/", 0.4, None, False),
    ("mira_md", "/mira_md_files/", 0.3, None, False),
    ("mac_all_md", "/mac_all_md/", 0.2, None, False),
]


def stage_table(spark: SparkSession, stages: list[tuple] = STAGES) -> DataFrame:
    """The stages as a small table (stage, stage_order, prefix, priority, name_rule, any_suffix)."""
    rows = [(name, i, prefix, float(priority), rule, loose) for i, (name, prefix, priority, rule, loose) in enumerate(stages)]
    return spark.createDataFrame(rows, "stage string, stage_order int, prefix string, priority double, name_rule string, any_suffix boolean")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def skipped(path: Column, parts: tuple[str, ...] = SKIP_PARTS, ends: tuple[str, ...] = SKIP_ENDS) -> Column:
    """Whether a path holds a part or has an end that a corpus leaves out."""
    out = F.lit(False)
    for p in parts:
        out = out | path.contains(p)
    for e in ends:
        out = out | path.endswith(e)
    return out


def wanted(path: Column, length: Column, any_suffix: Column | None = None, suffixes: tuple[str, ...] = TEXT_SUFFIXES, parts: tuple[str, ...] = SKIP_PARTS, max_bytes: int = MAX_BYTES) -> Column:
    """Whether a file is text by suffix (any that isn't known as binary where ``any_suffix`` holds), not left out by its path, not empty and not too large."""
    text = _suffix(path).isin(*suffixes) | (F.lit(False) if any_suffix is None else any_suffix)
    return text & ~_suffix(path).isin(*BINARY_SUFFIXES) & (length > 0) & (length <= max_bytes) & ~skipped(path, parts)


def name_fits(path: Column, rule: Column) -> Column:
    """Whether a file's name meets its stage's rule: names that begin with v0, that don't, or end with .md; no rule lets all pass."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(rule == "v0*", name.startswith("v0")).when(rule == "!v0*", ~name.startswith("v0")).when(rule == "*.md", F.lower(name).endswith(".md")).otherwise(F.lit(True))


def scan(spark: SparkSession, folder: str, glob: str = "*", **rules) -> DataFrame:
    """path, length, modified, text of the wanted files under ``folder``; contents are read for those only."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    f = f.where(wanted(F.col("path"), F.col("length"), **rules))
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.decode("content", "utf-8").alias("text"))


def as_document(text: Column, path: Column) -> Column:
    """A file's text as one document: JSON files laid out with an indent of two, others, and JSON that can't be read, as they are."""
    from engramma.functions.text import stripped

    parsed = F.try_parse_json(text)
    return F.when((_suffix(path) == "json") & parsed.isNotNull(), F.to_json(parsed)).otherwise(stripped(text))


def modified_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are new or have changed since the last run (a table of path and modified)."""
    s = state.groupBy(F.col("path").alias("__p")).agg(F.max("modified").alias("__m"))
    return files.join(s, F.col("path") == F.col("__p"), "left").where(F.col("__m").isNull() | (F.col("modified") > F.col("__m"))).select(*files.columns)


def response_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(content_hash, platform, response) of files {hash}_{platform}.json with a response in them; others are left out."""
    name = r"([0-9a-f]{8,64})_([A-Za-z_]+)\.json$"
    r = files.select(F.regexp_extract(path, name, 1).alias("content_hash"), F.regexp_extract(path, name, 2).alias("platform"), F.get_json_object(text, "$.response").alias("response"))
    return r.where("content_hash <> '' and response is not null")


def adapted_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of typed messages {type: message, message: {role, …}, id, timestamp} as agent lines, typed by role; other lines are left out."""
    role = F.coalesce(F.get_json_object(value, "$.message.role"), F.lit("user"))
    j = lines.where(F.get_json_object(value, "$.type") == "message")
    return j.select(F.to_json(F.struct(role.alias("type"), F.get_json_object(value, "$.timestamp").alias("timestamp"), F.try_parse_json(F.get_json_object(value, "$.message")).alias("message"), F.get_json_object(value, "$.id").alias("sessionId"))).alias("value"))


def newest_dated_folder(files: DataFrame, path: str = "path") -> DataFrame:
    """Files under the latest YYYYMMDD or YYYY-MM-DD folder; files in no dated folder stay."""
    day = F.regexp_replace(F.regexp_extract(F.col(path), r"/(\d{4}-?\d{2}-?\d{2})(?:/|_)", 1), "-", "")
    f = files.withColumn("__day", day)
    last = f.agg(F.max("__day").alias("__last"))
    return f.crossJoin(F.broadcast(last)).where((F.col("__day") == "") | (F.col("__day") == F.col("__last"))).drop("__day", "__last")


def staged(files: DataFrame, stages: DataFrame, path: str = "path") -> DataFrame:
    """Adds stage, stage_order, priority (and what else the stages have) to each file: the first stage whose prefix and file-name rule fit.

    ``stages`` is a small table (stage, stage_order, prefix, priority), and optionally name_rule.
    """
    j = files.join(F.broadcast(stages), F.col(path).contains(F.col("prefix")))
    if "name_rule" in stages.columns:
        j = j.where(name_fits(F.col(path), F.col("name_rule")) & ((F.col("stage") != "expansion_md") | ~skipped(F.col(path), SPAM_PARTS, ()))).drop("name_rule")
    row = F.struct(*(F.col(f"`{c}`") for c in j.columns if c != "prefix"))
    return j.groupBy(F.col(path).alias("__path")).agg(F.min_by(row, "stage_order").alias("__r")).select("__r.*")


def manifest(files: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """One row per content: the owner (earliest stage, then path), all paths, and how many."""
    key = F.struct("stage_order", "path")
    return files.groupBy(content_hash).agg(F.min_by("path", key).alias("owner"), F.array_sort(F.collect_set("path")).alias("all_paths"), F.count("*").alias("n_files"))


def unseen(files: DataFrame, seen: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """Rows whose content no earlier run has recorded."""
    return files.join(seen.select(content_hash).distinct(), content_hash, "left_anti")


def owned(files: DataFrame, owners: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """The files that own their content, once for each content."""
    return files.join(owners.select(F.col("owner").alias("path"), content_hash), ["path", content_hash], "left_semi")
