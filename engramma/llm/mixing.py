"""Mixing sources to target weights.

Token budgets go down a domain - language - source tree. At every node the children share the node's budget by weight;
a child whose supply (its tokens times the epochs allowed) falls short gets its supply, and what it leaves goes to its
siblings. Only what a whole subtree cannot use reaches the siblings of its ancestors. Every leaf then takes a prefix of
its seeded epochs: all documents for each full epoch, and of the last epoch those before the budget is reached, in the
order of md5(seed:epoch:id).

A leaf may hold a third of all rows. Its order is therefore cut into 4096 bins by the first three hex digits: running
totals are taken over bins, and only the one bin in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.storage import written

#: Weights of the query and the pipeline; a name that is missing weighs ``OTHER_WEIGHT``.
LANG_WEIGHTS = {"en": 50, "fr": 20, "de": 20, "es": 10}
DOMAIN_WEIGHTS = {"d0": 40, "d1": 30, "d2": 20, "d3": 10}
OTHER_WEIGHT = 10
#: Leaves (sources) whose plan may be broadcast: 10 MB at most.
BROADCAST_LEAVES = 100_000
SEED = 17


def default_domain(source: Column) -> Column:
    """d0 to d3 by the source's number; a source without one is d0."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def token_count(text: Column) -> Column:
    """White-space words, the unit of the budgets; null has none."""
    t = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(t, " "), "")).cast("long")


def _weight(c: Column, weights: dict[str, int]) -> Column:
    w = F.lit(OTHER_WEIGHT)
    for k, v in weights.items():
        w = F.when(c == k, F.lit(v)).otherwise(w)
    return w.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str, budget: Column) -> DataFrame:
    """Water-filling among the children of each parent: adds ``got`` to rows with ``w`` and ``cap``.

    Children go by cap / w. Those whose cap is below their share of what is left get it in full, the rest share by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.withColumn("__b", budget).withColumn("__left", F.greatest(F.lit(0), F.col("__b") - F.coalesce(F.sum("cap").over(before), F.lit(0)))).withColumn("__w", F.sum("w").over(rest))
    n = n.withColumn("__full", F.col("cap") * F.col("__w") <= F.col("__left") * F.col("w"))
    # the first child that isn't filled sets the level for all after it
    level = Window.partitionBy(*parent)
    n = n.withColumn("__l", F.min(F.when(~F.col("__full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col(name).alias("k"), F.col("__left").alias("left"), F.col("__w").alias("w")))).over(level))
    got = F.when(F.col("__l").isNull() | F.col("__full"), F.col("cap")).otherwise(F.floor(F.col("__l.left") * F.col("w") / F.col("__l.w")))
    return n.withColumn("got", F.least("cap", got.cast("long"))).drop("__b", "__left", "__w", "__full", "__l")


def leaf_budgets(leaves: DataFrame, budget_share: float | None = None, budget_tokens: int | None = None, max_epochs: int = 2, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with each leaf's ``budget``. Leaves are as many as there are sources.

    ``budget_share`` is a part of all tokens, in thousandths; ``budget_tokens`` an absolute number.
    """
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    want = F.lit(budget_tokens).cast("long") if budget_tokens is not None else F.floor(F.col("all") * F.lit(round(1000 * (1.0 if budget_share is None else budget_share))) / F.lit(1000)).cast("long")
    domains = leaf.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("domain"), domain_weights)).crossJoin(F.broadcast(total.select(want.alias("want")))).withColumn("root", F.lit(0))
    domains = _share(domains, ["root"], "domain", F.col("want")).select("domain", F.col("got").alias("b1"))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("lang"), lang_weights)).join(domains, "domain")
    langs = _share(langs, ["domain"], "lang", F.col("b1")).select("domain", "lang", F.col("got").alias("b2"))
    leaf = leaf.withColumn("w", F.lit(1).cast("long")).join(langs, ["domain", "lang"])
    return _share(leaf, ["domain", "lang"], "source", F.col("b2")).select("domain", "lang", "source", "tokens", F.col("got").alias("budget"))


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, its text form, leaf and tokens of each row: all that budgets and orders need, without the texts."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), default_domain(source).alias("domain"), lang.alias("lang"), source.alias("source"), token_count(F.col(text_col)).alias("tokens"))
    return written(slim, "mix-tokens")


def _order(seed: int) -> Column:
    """The place of a row in the epoch that is cut, number ``full``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("key")).cast("binary"))


def plan(slim: DataFrame, budget_share: float | None, max_epochs: int, seed: int, **weights) -> DataFrame:
    """domain, lang, source, full (whole epochs), part (tokens of the epoch that is cut), last (the last order key taken of it)."""
    leaf = ["domain", "lang", "source"]
    leaves = slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    budgets = leaf_budgets(leaves, budget_share=budget_share, max_epochs=max_epochs, **weights)
    budgets = budgets.withColumn("full", F.expr("budget div tokens")).withColumn("part", F.col("budget") - F.col("full") * F.col("tokens")).select(*leaf, "full", "part")
    budgets = _small(written(budgets, "mix-budgets"))
    rows = slim.join(budgets, leaf).withColumn("k", _order(seed)).withColumn("bin", F.substring("k", 1, 3))
    bins = rows.groupBy(*leaf, "bin").agg(F.sum("tokens").alias("t"), F.first("part").alias("part"))
    run = Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0)))
    cut = bins.where((F.col("before") < F.col("part")) & (F.col("before") + F.col("t") >= F.col("part"))).select(*leaf, "bin", "before")
    edge = rows.join(_small(written(cut, "mix-bins")), [*leaf, "bin"])
    w = Window.partitionBy(*leaf).orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("sum", F.col("before") + F.sum("tokens").over(w))
    last = edge.where(F.col("sum") >= F.col("part")).groupBy(*leaf).agg(F.min("k").alias("last"))
    return _small(written(budgets.join(last, leaf, "left"), "mix-plan"))


def _small(leaf_rows: DataFrame) -> DataFrame:
    """Broadcast while the leaves are few enough (about 100 bytes each), else joined by shuffle."""
    return F.broadcast(leaf_rows) if leaf_rows.count() <= BROADCAST_LEAVES else leaf_rows


def _copies(seed: int) -> Column:
    return (F.col("full") + F.when((F.col("part") > 0) & (_order(seed) <= F.col("last")), 1).otherwise(0)).cast("int")


def selected(docs: DataFrame, budget_share: float | None = 0.6, max_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **weights) -> DataFrame:
    """id, domain, lang, source, tokens and copies (1 or more) of each selected row."""
    slim = _slim(docs, id_col, text_col, lang_col, source_col)
    out = slim.join(plan(slim, budget_share, max_epochs, seed, **weights), ["domain", "lang", "source"])
    return out.withColumn("copies", _copies(seed)).where("copies > 0").select("id", "domain", "lang", "source", "tokens", "copies")


def mix(docs: DataFrame, budget_share: float | None = 0.6, max_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **weights) -> DataFrame:
    """``docs`` with each selected row as often as it was selected, in the input's columns.

    Null languages and sources are the leaf ''; leaves without tokens get nothing. Null ids and repeated rows are
    ordered like any other id; rows of equal id and leaf go together. Rows without tokens cost nothing and follow
    their place in the order. An empty table stays empty.
    """
    slim = _slim(docs, id_col, text_col, lang_col, source_col)
    p = plan(slim, budget_share, max_epochs, seed, **weights)
    p = p.select(*(F.col(c).alias(f"__{c}") for c in p.columns))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    out = docs.join(p, (default_domain(source) == F.col("__domain")) & (lang == F.col("__lang")) & (source == F.col("__source")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    copies = F.col("__full") + F.when((F.col("__part") > 0) & (order <= F.col("__last")), 1).otherwise(0)
    return out.where(copies > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)
