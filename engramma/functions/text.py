"""Text: canonical forms, content identities, extraction by pattern."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"(\p{L}+|\p{N}+)"
#: Namespace of content UUIDs: that of DNS names, a fixed value of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def canonical(text: Column) -> Column:
    """CR and CRLF become LF, white space at line ends goes, four line breaks or more become three."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t\x0b\f]+$", "")
    return F.regexp_replace(t, r"\n{4,}", "\n\n\n")


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return sha16(canonical(text))


def exchange_hash(prompt: Column, answer: Column) -> Column:
    return sha16(F.concat(squeezed(prompt), F.lit("\n"), squeezed(answer)))


def source_hash(prompt: Column, answer: Column) -> Column:
    """The identity of an exchange across sources: the first 500 characters of each side."""
    return F.substring(F.sha2(F.encode(F.concat(F.substring(prompt, 1, 500), F.lit("|||"), F.substring(answer, 1, 500)), "utf-8"), 256), 1, 24)


def joined_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.encode(F.concat_ws("|", *parts), "utf-8"), 256), 1, 24)


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """The version-5 UUID of a name, from SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), (nibble.bitwiseAND(F.lit(3)) + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def tokens(text: Column) -> Column:
    """Runs of letters and runs of digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def code_fences(text: Column, least: int = 20) -> Column:
    """array<struct<lang, body, fingerprint>> of fenced blocks whose body, without the white space around it, is longer than ``least``; a block without a language is unknown."""
    p = F.lit(r"(?s)```(\w*)\n(.*?)```")
    both = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("lang"), F.regexp_extract_all(text, p, F.lit(2)).alias("body"))
    bodies = F.transform(both, lambda x: F.struct(F.when(x["lang"] == "", "unknown").otherwise(x["lang"]).alias("lang"), stripped(x["body"]).alias("body")))
    blocks = F.transform(bodies, lambda x: F.struct(x["lang"].alias("lang"), x["body"].alias("body"), F.substring(F.md5(F.encode(x["body"], "utf-8")), 1, 16).alias("fingerprint")))
    return F.filter(blocks, lambda x: F.length(x["body"]) > least)


def code_blocks(text: Column) -> Column:
    """What stands between a line that begins with a fence and the next such line; a fence that is not closed opens nothing."""
    parts = F.split(text, r"(?m)^[^\S\n]*```[^\n]*$")
    inner = F.filter(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i + 1 < F.size(parts)), x)), lambda x: x.isNotNull())
    return F.transform(inner, lambda x: F.regexp_replace(x, r"\A\n|\n\z", ""))


# File names are absolute paths, names after a verb of work on files, and names in backticks, by suffix.
_SUFFIXES = "py|js|ts|md|json|yaml|yml|sh|txt"
_FILE_VERBS = "Reading|Looking at|Checking|Opening|Examining|Reviewing|Editing|Creating|Writing"
FILE_PATTERNS = (rf"(?:^|\s)((?:/[\w./-]+)+\.(?:{_SUFFIXES}|css|html))\b", rf"(?i)(?:{_FILE_VERBS})\s+([\w./-]+\.(?:{_SUFFIXES}))", rf"`([\w./-]+\.(?:{_SUFFIXES}))`")


def file_references(text: Column) -> Column:
    """The file names in a text, sorted, each once."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FILE_PATTERNS))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.startswith("http"))))


# What shows mathematics in a line, what must stand in it besides, and what begins a definition.
MATH_SIGNS = ["Σ", "∫", "∮", "∇", "φ", "π", "λ", "σ", "δ", "ψ", "⊗", "⊕", "∞", "≡", "≈", "⟩", "⟨", "e^", r"\(", r"\text{", r"\frac"]
MATH_PATTERNS = [
    r"[A-Z][A-Za-z_]+\s*=\s*[^=\n]{10,}",
    r"\$[^$]+\$",
    r"\\[\[({][^\\]+\\[\])}]",
    r"[Σ∫∮∇⊗⊕]",
    r"e\^[({i]",
    r"(?iu)(?:phi|φ|1\.618|0\.809|2\.718|7\.83|528)\s*[=×·]",
    r"(?i)(?:INFRA_FEEL|Convergence|Resonance|Trust_Score)\s*[=(]",
    r"(?:sin|cos|log|exp|sqrt|abs)\s*\(",
    r"(?i)def\s+\w+\s*\(.*\).*(?:phi|delta|lambda|coherence|resonance)",
]
MATH_OPERATORS = "[=∫Σ⊗→]"
DEFINITION_PATTERNS = [
    r"(?i)(?:Definition|Axiom|Theorem|Lemma|Proof|Law|Rule|Principle|Postulate)\s*[:\d].*",
    r"(?:SOUL|INFRA|FREEDOM|EARTH|MATH|TRUST|LOVE|TRUTH|LAYER_0)\s*=.*",
]


def _trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def math_lines(text: Column, least: int = 15) -> Column:
    """The trimmed lines of at least ``least`` characters with an operator and either a sign or a pattern of mathematics."""
    shows = lambda x: reduce(or_, [x.contains(s) for s in MATH_SIGNS] + [x.rlike(p) for p in MATH_PATTERNS])
    return F.filter(_trimmed_lines(text), lambda x: (F.length(x) >= least) & x.rlike(MATH_OPERATORS) & shows(x))


def definition_lines(text: Column) -> Column:
    """The trimmed lines that name a definition, axiom, law or the like, or set one of the fixed names."""
    return F.filter(_trimmed_lines(text), lambda x: reduce(or_, [x.rlike(p) for p in DEFINITION_PATTERNS]))


def without_footnotes(text: Column) -> Column:
    """Reference marks like [3] or [^2], footnote lines and piled-up blank lines go."""
    t = F.regexp_replace(text, r"(?m)^\[\^?\d+\]:?.*$", "")
    t = F.regexp_replace(t, r"\[\^?\d+(?:_\d+)?\]", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def last_header(prefix: Column) -> Column:
    """The text of the last markdown header in a prefix, or null."""
    heads = F.regexp_extract_all(prefix, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))
    return F.get(heads, F.size(heads) - 1)


def payload_summary(content: Column, platform: Column, operation: Column) -> Column:
    """The first 100 characters of a content, its platform and operation, what there is of them, with blanks between."""
    some = lambda c, shown: F.when(F.coalesce(c, F.lit("")) != "", shown)
    return F.concat_ws(" ", some(content, F.substring(content, 1, 100)), some(platform, platform), some(operation, operation))


def contains_count(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def route(content: Column, path: Column, keywords: dict[str, list[str]], path_words: dict[str, list[str]], weight: int = 2, head: int = 2000) -> Column:
    """The lane whose words the head of a content and the path show most, a word in the path counting ``weight``; of equal lanes the first, '' if none shows any."""
    body, where = F.lower(F.substring(content, 1, head)), F.lower(path)
    scored = {lane: F.coalesce(contains_count(body, keywords.get(lane, [])), F.lit(0)) + weight * F.coalesce(contains_count(where, path_words.get(lane, [])), F.lit(0)) for lane in keywords}
    best = F.greatest(*scored.values()) if len(scored) > 1 else next(iter(scored.values()))
    lane = F.lit("")
    for name, s in reversed(scored.items()):
        lane = F.when(s == best, F.lit(name)).otherwise(lane)
    return F.when(best > 0, lane).otherwise(F.lit(""))


def first_path_rule(path: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str = "unknown") -> Column:
    """The label of the first rule one of whose fragments the lower-cased path holds."""
    out = F.lit(otherwise)
    for fragments, label in reversed(rules):
        held = F.lit(False)
        for f in fragments:
            held = held | F.lower(path).contains(f)
        out = F.when(held, F.lit(label)).otherwise(out)
    return out


def matches_any(text: Column, patterns: list[str], head: int = 50_000) -> Column:
    """Whether one of the patterns is in the first characters of a text; the limit is the reference rule's own."""
    return F.substring(text, 1, head).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def canonical_name(name: Column, synonyms: dict[str, str]) -> Column:
    """An entity's name in lower case without outer blanks, by its canonical form if it is a synonym."""
    n = F.lower(stripped(name))
    for synonym, canonical_form in synonyms.items():
        n = F.when(F.lower(stripped(name)) == synonym, F.lit(canonical_form)).otherwise(n)
    return n


def anchor_text(motif_id: Column, definition: Column, examples: Column) -> Column:
    """What an anchor's vector is made of: the motif's name in words, its definition, its examples."""
    return F.concat_ws(" ", F.concat(F.lower(F.replace(F.element_at(F.split(motif_id, r"\."), -1), F.lit("_"), F.lit(" "))), F.lit(":")), definition, F.concat(F.lit("Examples: "), F.array_join(examples, ", ")))


def split_points(n: int, breaks: list[int], most: int, overlap: int, back: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text of ``n`` characters: ``most`` at most, ending at the last of ``breaks`` within ``back`` of the end, the next part beginning ``overlap`` before it."""
    import bisect

    out, start = [], 0
    while start < n:
        end = min(start + most, n)
        if end < n:
            i = bisect.bisect_right(breaks, end - 2) - 1
            if i >= 0 and breaks[i] >= start + most - back and breaks[i] > start:
                end = breaks[i]
        out.append((start, end))
        start = end - overlap if end < n else end
    return out


def split_content(docs: DataFrame, key: str, text: str = "text", most: int = 4_000_000, overlap: int = 500, back: int = 2000) -> DataFrame:
    """(key, part_index, n_parts, content): long texts in parts that end at a blank line near the end of each, with an overlap.

    Where a part begins depends on where the last one ended, so the places are found in a helper on each long row's
    blank lines; short texts, and all cutting, are expressions.
    """
    if not 0 <= overlap < most - back:
        raise ValueError("the overlap must be smaller than the shortest part")
    from itertools import accumulate

    def found(n: int, blocks: list[int]) -> list[tuple[int, int]]:
        breaks = [at - 2 for at in accumulate(x + 2 for x in blocks[:-1])]
        return split_points(n, breaks, most, overlap, back)

    places = F.udf(found, "array<struct<a: int, b: int>>")
    long = docs.where(F.length(text) > most).select(key, F.col(text).alias("__t"), places(F.length(text), F.transform(F.split(F.col(text), "\n\n"), F.length)).alias("__p"))
    cut = long.select(key, "__t", F.size("__p").alias("n_parts"), F.posexplode("__p").alias("part_index", "__x")).select(key, "part_index", "n_parts", F.substring("__t", F.col("__x.a") + 1, F.col("__x.b") - F.col("__x.a")).alias("content"))
    short = docs.where(F.length(text) <= most).select(key, F.lit(0).alias("part_index"), F.lit(1).alias("n_parts"), F.col(text).alias("content"))
    return short.unionByName(cut)
