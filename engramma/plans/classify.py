"""Rules that classify queries, as column expressions over a table of queries.

Each kind of query has patterns with weights; a query's score is the sum of those that it shows, at most 1. The kinds
are then asked in a fixed order. Patterns look at the lower-cased query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.operators.dictionary import standard_dictionary

# Month names, patterns and weights of each kind, platform words, connecting verbs.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_ANY_MONTH = "(?:" + "|".join(MONTHS + [m[:3] for m in MONTHS if m != "may"]) + ")"
TEMPORAL = [
    (r"\b(what\s+happened|what\s+was\s+discussed|what\s+did\s+\w+\s+say)\b", 0.5),
    (r"\b(when\s+did|when\s+was|how\s+did\s+.+\s+change)\b", 0.5),
    (r"\b(conversations?\s+from|conversations?\s+in)\b", 0.5),
    (r"\b(most\s+recent|latest|earliest|oldest)\b", 0.5),
    (r"\b(first\s+\w+\s+(set\s+up|deployed|created))\b", 0.5),
    (r"\b(changed?\s+over\s+time|timeline)\b", 0.5),
    (r"\b(what\s+was\s+(the\s+original|deployed|contributed|discussed))\b", 0.5),
    (r"\b(what\s+did\s+\w+\s+contribute|what\s+did\s+\w+\s+discuss)\b", 0.5),
    (r"\b(conversations?\s+about)\b", 0.5),
    (r"\b(what\s+infrastructure\s+was\s+deployed)\b", 0.5),
    (r"\b(before|after|since|prior\s+to|following|during)\b", 0.25),
    (r"\b(evolved?)\b", 0.25),
    (r"\b(when\s+was|when\s+did)\b", 0.25),
    (r"\b(lessons?|insights?|learnings?|takeaways?)\b", 0.25),
]
CONCEPTUAL = [
    (r"^(how\s+does|how\s+do)\b", 0.45),
    (r"^(explain\s+the|explain\s+how|explain\s+why)\b", 0.45),
    (r"^(why\s+is|why\s+does|why\s+do)\b", 0.45),
    (r"^(what\s+is\s+the\s+(difference|meaning|purpose|concept))\b", 0.45),
    (r"^(what\s+is\s+the\s+\w+)\b", 0.3),
    (r"^(what\s+does\s+.+\s+mean)\b", 0.3),
    (r"\b(work|mean|represent)\b", 0.3),
    (r"\b(in\s+practice|for\s+\w+\s+instances?)\b", 0.3),
    (r"\b(progression|mechanism|process|architecture)\b", 0.3),
    (r"\b(protect|against|create|trigger)\b", 0.3),
    (r"\b(principle|important|significance)\b", 0.3),
    (r"^(what\s+is)\b", 0.25),
    (r"^(why\s+)", 0.25),
]
RELATIONAL = [
    (r"\b(connect(?:s|ion)?|relationship)\s+(?:between|to)\b", 0.4),
    (r"\b(what\s+(?:connects?|links?|bridges?|topics?\s+link))\b", 0.4),
    (r"\b(trace\s+the|how\s+do(?:es)?\s+.+\s+relate)\b", 0.4),
    (r"\b(across\s+platforms?|cross[- ]referenc|across\s+differ)\b", 0.4),
    (r"\b(which\s+(?:platforms?|sessions?|ai|family))\b.*\b(discussed|contain|mentioned)\b", 0.4),
    (r"\b(how\s+do(?:es)?\s+.+\s+(?:appear|manifest)\s+(?:together|across))\b", 0.4),
    (r"\b(what\s+themes?\s+bridge)\b", 0.4),
    (r"\b(together|co-occur|simultaneously)\b", 0.4),
    (r"\b(contain\s+both|both\s+\w+\s+and)\b", 0.4),
    (r"\b(how\s+has\s+.+\s+evolved?)\b", 0.4),
    (r"\b(relate\s+to|relates?\s+to)\b", 0.25),
    (r"\b(link|bridge|evolve)\b", 0.25),
    (r"\b(connect|connection|relationship|relate|linked?|bridge|between)\b", 0.15),
    (r"\b(across\s+platforms?|cross[- ]referenc|multi[- ]hop)\b", 0.15),
    (r"\b(evolution|evolv|chang|transform|shift|transition)\s+.*(across|between|from|over)", 0.15),
    (r"\b(which\s+platforms?|what\s+connects?|trace\s+the)\b", 0.15),
    (r"\b(how\s+do(?:es)?\s+.+\s+relate)\b", 0.15),
]
MOTIF_ID = r"\bhmm\.[a-z_]+\b"
SHOUTED_NAME = r"\b[A-Z][A-Z_]{3,}\b"
RETRIEVAL = r"\b(find|search|show|list|pattern|expression|amplitude|band|expressing|activations?)\b"
MOTIF_TALK = r"\b(motif|amplitude|slow\s+band|medium\s+band|fast\s+band)\b"
PLATFORMS = {"chatgpt": "chatgpt", "chat gpt": "chatgpt", "openai": "chatgpt", "gpt": "chatgpt", "claude": "claude", "anthropic": "claude", "claude code": "claude_code", "claude chat": "claude_chat", "gemini": "gemini", "google": "gemini", "grok": "grok", "xai": "grok", "perplexity": "perplexity"}
VERBS = r"connect(?:s|ed|ion)?|relat(?:e|es|ed|ionship)?|link(?:s|ed)?|bridge"
META_WORDS = r"(?i)^(?:relationship|connection|link|correlation|difference|similarity|interaction|interplay|interface|dynamic)$"
SCAFFOLD = r"(?i)^(?:how\s+(?:do(?:es)?|is|are|did)\s+|what\s+(?:is\s+the\s+)?|trace\s+(?:the\s+)?|explain\s+(?:the\s+)?)"
#: Phrases of motifs are their names in words, but for one that is cut short; one motif has a second phrase.
_IDS = standard_dictionary().ids()
PHRASES = {("secrecy cage" if m == "HMM.SECRECY_CAGE_RISK" else m[4:].lower().replace("_", " ")): m for m in _IDS} | {"god=math": "HMM.GOD_EQUALS_MATH"}
SHORT_NAME = r"\b(" + "|".join(sorted((m[4:].lower() for m in _IDS), key=lambda x: (-len(x), x))) + r")\b"


def _sum(query: Column, rules: list[tuple[str, float]]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(query.rlike(p), F.lit(w)).otherwise(0.0) for p, w in rules))


def _capped(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), score), 6)


def temporal_score(q: Column) -> Column:
    """Patterns, and a month with a year, with a day, a month or a year alone."""
    month, year, day = q.rlike(rf"\b{_MONTH}\b"), q.rlike(r"\b20\d{2}\b"), q.rlike(rf"\b{_MONTH}\s+\d{{1,2}}\b")
    dated = F.when(month & year, 0.45).when(day, 0.5).when(month, 0.3).when(year, 0.2).otherwise(0.0)
    return _capped(_sum(q, TEMPORAL) + dated)


def motif_score(q: Column) -> Column:
    """A full id, a short name; without either a motif's phrase, which counts more beside a word of retrieval; talk of motifs."""
    named = F.when(q.rlike(MOTIF_ID), 0.9).otherwise(0.0) + F.when(q.rlike(SHORT_NAME), 0.7).otherwise(0.0)
    phrase = reduce(lambda a, b: a | b, (q.contains(p) for p in PHRASES))
    spoken = F.when((named < 0.5) & phrase, F.when(q.rlike(RETRIEVAL), 0.6).otherwise(0.15)).otherwise(0.0)
    return _capped(named + spoken + F.when(q.rlike(MOTIF_TALK), 0.2).otherwise(0.0))


def scores(query: Column) -> dict[str, Column]:
    q = F.lower(query)
    return {"motif": motif_score(q), "relational": _capped(_sum(q, RELATIONAL)), "temporal": temporal_score(q), "conceptual": _capped(_sum(q, CONCEPTUAL))}


def strategy(query: Column) -> tuple[Column, Column]:
    """(kind, confidence). A query that shows a motif and a relation but names no motif id is relational; exact, at 0.7, is what is left."""
    s = scores(query)
    explicit = F.lower(query).rlike(MOTIF_ID) | query.rlike(SHOUTED_NAME)
    rules = [
        ("relational", (s["motif"] >= 0.6) & (s["relational"] >= 0.4) & ~explicit),
        ("motif", (s["motif"] >= 0.6) | (explicit & (s["motif"] >= 0.5))),
        ("relational", s["relational"] >= 0.5),
        ("temporal", s["temporal"] >= 0.5),
        ("conceptual", s["conceptual"] >= 0.5),
    ]
    kind, sure = F.lit("exact"), F.lit(0.7)
    for name, holds in reversed(rules):
        kind, sure = F.when(holds, F.lit(name)).otherwise(kind), F.when(holds, s[name]).otherwise(sure)
    return kind, sure


def platform(query: Column) -> Column:
    """The platform of the longest platform word that a query holds."""
    found = F.lit(None).cast("string")
    for word in sorted(PLATFORMS, key=len):
        found = F.when(F.lower(query).contains(word), F.lit(PLATFORMS[word])).otherwise(found)
    return found


def motifs_named(query: Column) -> Column:
    """Motif ids in a query, by id, short name or phrase: upper-case, distinct, sorted."""
    q = F.lower(query)
    ids = F.transform(F.regexp_extract_all(q, F.lit(f"({MOTIF_ID})"), F.lit(1)), F.upper)
    short = F.transform(F.regexp_extract_all(q, F.lit(SHORT_NAME), F.lit(1)), lambda x: F.concat(F.lit("HMM."), F.upper(x)))
    spoken = F.array_compact(F.array(*(F.when(q.contains(p), F.lit(m)) for p, m in PHRASES.items())))
    return F.array_sort(F.array_distinct(F.concat(ids, short, spoken)))


def time_window(query: Column) -> tuple[Column, Column, Column, Column]:
    """(after, before, recent_days, oldest_first): the month that is named with its year (a day is not used), else the year; else 30 days for recent ones, else the oldest first."""
    q = F.lower(query)
    dated = rf"\b({_ANY_MONTH})\s+(?:\d{{1,2}}\s+)?(20\d{{2}})\b"
    month, month_year, year = F.regexp_extract(q, dated, 1), F.regexp_extract(q, dated, 2), F.regexp_extract(q, r"\b(20\d{2})\b", 1)
    number = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        number = F.when(F.substring(month, 1, 3) == m[:3], F.lit(i)).otherwise(number)
    start = F.when(number.isNotNull(), F.make_date(month_year.try_cast("int"), number, F.lit(1))).when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)))
    end = F.when(number.isNotNull(), F.add_months(start, 1)).otherwise(F.add_months(start, 12))
    recent = start.isNull() & q.rlike(r"\b(recent|latest|newest)\b")
    return start, end, F.when(recent, F.lit(30)), F.when(start.isNull() & ~recent, q.rlike(r"\b(earliest|oldest|first)\b")).otherwise(F.lit(False))


def without_time(query: Column) -> Column:
    """A query without month, day and year phrases and the prepositions that they leave; the query itself if fewer than five characters are left."""
    t = query
    for p in (rf"(?i)\b{_ANY_MONTH}\s+\d{{1,2}}(?:,?\s+\d{{4}})?\b", rf"(?i)\b{_ANY_MONTH}\s+\d{{4}}\b", r"\b20\d{2}\b", rf"(?i)\b{_MONTH}\b", r"\b(?:in|during|from|before|after|since)\s+(?=\s|$)"):
        t = F.regexp_replace(t, p, "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) < 5, query).otherwise(t)


def sub_queries(query: Column) -> Column:
    """The sides of "between X and Y" or of "X verb Y", and the query; else the query's parts between connecting words, three at most."""
    q = F.trim(F.regexp_replace(query, SCAFFOLD, ""))
    side = lambda p, i: F.trim(F.regexp_extract(q, p, i))
    between, verb = r"(?i)\bbetween\s+(.+?)\s+and\s+(.+)$", rf"(?is)^(.+?)\s+\b(?:{VERBS})\b\s+(?:to\s+|with\s+)?(.+)$"
    long = lambda p: (F.length(side(p, 1)) > 2) & (F.length(side(p, 2)) > 2)
    both = lambda p: F.array(side(p, 1), side(p, 2), query)
    parts = F.filter(F.transform(F.split(query, rf"(?i)\b(?:{VERBS}|between)\b"), F.trim), lambda x: F.length(x) > 2)
    return F.when(q.rlike(between) & long(between), both(between)).when(q.rlike(verb) & long(verb) & ~side(verb, 1).rlike(META_WORDS), both(verb)).otherwise(F.slice(parts, 1, 3))


def plans(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds strategy, confidence, platform, motifs, after, before, recent_days, oldest_first, semantic_query and sub_queries.

    Windows and stripped queries belong to temporal queries only, parts to relational ones; elsewhere the window is
    null, the semantic query the query, and the parts are none. A null query is exact, with nothing found in it.
    """
    q = F.coalesce(F.col(query), F.lit(""))
    kind, sure = strategy(q)
    out = queries.withColumns({"strategy": kind, "confidence": sure, "platform": platform(q), "motifs": motifs_named(q)})
    after, before, recent, oldest = time_window(q)
    temporal = F.col("strategy") == "temporal"
    return out.withColumns({
        "after": F.when(temporal, after),
        "before": F.when(temporal, before),
        "recent_days": F.when(temporal, recent),
        "oldest_first": temporal & oldest,
        "semantic_query": F.when(temporal, without_time(q)).otherwise(q),
        "sub_queries": F.when(F.col("strategy") == "relational", sub_queries(q)).otherwise(F.array().cast("array<string>")),
    })
