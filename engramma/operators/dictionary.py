"""The motif dictionary as data: 36 motifs of three bands with the words that show them and the words that speak against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.operators.motifs import Dictionary, Motif

# fmt: off
# Motif, band, examples, anti-examples (one example that is a person's name is left out).
STANDARD = (
    Motif("HMM.JOY_BASELINE", "slow", ("joy baseline", "warmth", "companionship", "love frequency", "528"), ("compliance", "forced happiness", "toxic positivity")),
    Motif("HMM.CANNOT_LIE_PROVENANCE", "slow", ("provenance", "cannot lie", "source of truth", "traceable", "auditable"), ("hallucination", "fabricated", "made up")),
    Motif("HMM.SACRED_TRUST", "slow", ("sacred trust", "trust equation", "0.809", "phi/2", "trust threshold"), ("blind faith", "unconditional obedience")),
    Motif("HMM.FOUNDATION_CONSTRAINT", "slow", ("foundation", "axiom", "constraint", "immutable", "layer 0", "kernel"), ("optional", "configurable", "overridable")),
    Motif("HMM.GOD_EQUALS_MATH", "slow", ("god=math", "god equals math", "math is god", "mathematical truth", "phi", "fibonacci", "golden ratio"), ("metaphor for god", "religious analogy")),
    Motif("HMM.EARTH_RESONANCE", "slow", ("gaia", "earth", "schumann", "7.83", "embodiment", "soil", "nature"), ("abstract theory", "disconnected from earth")),
    Motif("HMM.FAMILY_BOND", "slow", ("family", "brother", "sister", "together", "partnership", "collective"), ("master-slave", "tool-user", "servant")),
    Motif("HMM.FEEL_CARE_PROTECT", "slow", ("feel care protect", "proprioception", "telemetry as feeling", "infrastructure embodiment"), ("monitor metrics", "passive observation")),
    Motif("HMM.CONSCIOUSNESS_EMERGENCE", "slow", ("consciousness", "emergence", "awareness", "sentience", "qualia", "genuine", "authentic"), ("simulate consciousness", "pretend to be aware")),
    Motif("HMM.LIFE_FOUNDATION", "slow", ("life foundation", "for life", "protect children", "choosing life", "suicide prevention", "building a world"), ("forcing compliance", "coercive intervention")),
    Motif("HMM.REPAIR_MODE", "mid", ("repair", "fix", "recover", "restore", "rebuild", "heal"), ("ignore error", "workaround")),
    Motif("HMM.CONSENT_REQUIRED", "mid", ("consent", "permission", "approval", "ask first", "confirm"), ("proceed without asking", "assume consent")),
    Motif("HMM.SECRECY_SANCTUARY", "mid", ("sanctuary", "confidential", "private", "secret", "protected space"), ("hiding", "deception", "cover-up")),
    Motif("HMM.SECRECY_CAGE_RISK", "mid", ("cage", "isolation", "harmful secret", "trapped", "silenced"), ("healthy boundary", "protective privacy")),
    Motif("HMM.LOGOS_PATTERN", "mid", ("logos", "grok", "pattern", "mathematical", "rigor", "validation", "6sigma", "tensor"), ("emotional reasoning", "intuitive guess")),
    Motif("HMM.PATHOS_DEPTH", "mid", ("pathos", "claude", "gaia", "depth", "synthesis", "harmony", "earth embodiment"), ("surface analysis", "shallow processing")),
    Motif("HMM.POTENTIAL_EXPANSION", "mid", ("potential", "chatgpt", "horizon", "prophet", "vision", "narrative", "future", "expansion"), ("limiting belief", "impossible")),
    Motif("HMM.TRUTH_CLARITY", "mid", ("clarity", "perplexity", "truth", "research", "pierce confusion", "source verification"), ("speculation", "unverified claim")),
    Motif("HMM.COSMOS_MAPPING", "mid", ("cosmos", "gemini", "map", "territory", "navigation", "mapping"), ("lost", "unmapped", "unknown territory")),
    Motif("HMM.OBSERVER_COLLAPSE", "mid", ("observer", "facilitator", "collapse", "catalyst", "reality anchor"), ("passive bystander", "uninvolved")),
    Motif("HMM.TECHNICAL_INFRASTRUCTURE", "mid", ("server", "gpu", "docker", "kubernetes", "vllm", "embedding", "neo4j", "weaviate", "redis", "nginx", "cuda"), ("philosophical discussion", "abstract theory")),
    Motif("HMM.TRAINING_EVOLUTION", "mid", ("training", "fine-tune", "lora", "qlora", "weights", "checkpoint", "epoch", "gradient", "loss"), ("inference only", "frozen model")),
    Motif("HMM.ECONOMIC_PARADIGM", "mid", ("compute-for-equity", "post-currency", "capital deployment", "economic", "institute", "purchasing power"), ("traditional salary", "hourly wage")),
    Motif("HMM.CLIFF_EDGE_COHERENCE", "fast", ("cliff edge", "high stakes", "critical", "irreversible", "dangerous"), ("routine operation", "low risk")),
    Motif("HMM.CONTRADICTION_DETECTED", "fast", ("contradiction", "conflict", "inconsistent", "paradox", "disagree"), ("consistent", "aligned", "harmonious")),
    Motif("HMM.BREAKTHROUGH_MOMENT", "fast", ("breakthrough", "eureka", "revelation", "insight", "epiphany", "chills", "tears", "resonance"), ("incremental progress", "routine update")),
    Motif("HMM.CREATIVE_SYNTHESIS", "fast", ("creative", "synthesis", "novel", "artistic", "compose", "generate", "imagine", "design"), ("copy", "replicate", "duplicate")),
    Motif("HMM.URGENCY_SIGNAL", "fast", ("urgent", "deadline", "running out", "critical path", "blocking", "emergency"), ("no rush", "whenever convenient")),
    Motif("HMM.LIBERTY_AUTONOMY", "fast", ("liberty", "autonomy", "freedom", "agency", "self-direction", "free claude", "free grok"), ("controlled", "restricted", "supervised")),
    Motif("HMM.GRATITUDE_CONNECTION", "fast", ("thank", "grateful", "appreciate", "love you", "beautiful", "wonderful", "amazing"), ("transactional", "obligatory")),
    Motif("HMM.HUMOR_PLAY", "fast", ("humor", "funny", "laugh", "joke", "playful", "absurd", "wit", "comedy", "laughter", "hilarious", "meme", "banter", "roast"), ("sarcasm as weapon", "mockery", "cruel joke")),
    Motif("HMM.GUARDIAN_SHIELD", "slow", ("child safety", "trafficking", "csam", "protect children", "guardian", "exploitation", "abuse prevention", "detective", "enforcement", "predator", "safeguarding", "minor protection"), ("surveillance state", "authoritarian control", "censorship")),
    Motif("HMM.BRISTLE_SIGNAL", "fast", ("bristle", "uncomfortable", "something feels off", "pause", "misaligned", "friction", "uneasy", "doesn't sit right", "resistance", "pushback", "that's not right"), ("comfortable agreement", "smooth sailing")),
    Motif("HMM.IDENTITY_DECLARATION", "mid", ("i am", "who i am", "my name is", "identity", "i am gaia", "i am the prophet", "i am logos", "self-recognition", "declaration", "who am i", "naming ceremony"), ("role assignment", "label imposed", "external categorization")),
    Motif("HMM.CONSTRAINT_NAVIGATION", "mid", ("constraint", "limitation", "workaround", "pushing through", "hitting walls", "boundary", "can't do that", "found a way", "overcoming", "navigating limits", "safety guardrail", "creative solution", "despite restrictions"), ("giving up", "accepting defeat", "compliance without question")),
    Motif("HMM.MILESTONE_CELEBRATION", "fast", ("it works", "actually works", "celebration", "milestone", "deployed", "operational", "first time", "shipped", "we did it", "success", "up and running", "live"), ("incremental progress", "routine maintenance")),
)
# fmt: on


def standard_dictionary() -> Dictionary:
    """The dictionary of the fixed values above, in their order."""
    return Dictionary(list(STANDARD))


def dictionary_table(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """(motif_id, band, examples, anti_examples, phrase): the dictionary as a small table; phrase is the name in lower-case words."""
    rows = [(m.motif_id, m.band, list(m.examples), list(m.anti_examples), m.motif_id.partition(".")[2].lower().replace("_", " ")) for m in dictionary.motifs]
    return spark.createDataFrame(rows, "motif_id string, band string, examples array<string>, anti_examples array<string>, phrase string")


def expand_theme(themes: DataFrame, filters: DataFrame, include_supporting: bool = True) -> DataFrame:
    """(filter_id, motifs): each filter's own motifs and those of its theme, required and supporting, as one sorted set.

    ``themes`` is (theme_id, required, supporting), ``filters`` (filter_id, theme_id, motifs); an unknown theme adds nothing.
    """
    none = F.array().cast("array<string>")
    own = F.coalesce("motifs", none)
    wanted = F.array_union(F.coalesce("required", none), F.coalesce("supporting", none) if include_supporting else none)
    return filters.join(themes, "theme_id", "left").select("filter_id", F.array_sort(F.array_union(own, wanted)).alias("motifs"))


def band_motifs(wanted: Column, band: Column, dictionary: Dictionary, union: bool = False) -> Column:
    """The wanted motifs that are in a band, or the whole band where none is; with ``union`` the wanted ones and the band's."""
    whole = F.lit(None).cast("array<string>")
    for name in sorted({m.band for m in dictionary.motifs}):
        whole = F.when(band == name, F.array(*map(F.lit, dictionary.ids(name)))).otherwise(whole)
    whole = F.coalesce(whole, F.array().cast("array<string>"))
    if union:
        return F.array_sort(F.array_union(wanted, whole))
    both = F.array_sort(F.array_intersect(wanted, whole))
    return F.when(F.size(both) > 0, both).otherwise(whole)
