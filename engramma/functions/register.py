"""The library by name for SQL: scalar and table functions of the session, which are expressions and not Python UDFs, and sessions as a table function over a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

# name, parameters, body in SQL
_FUNCTIONS = {
    "em_token_estimate": ("t STRING", "BIGINT", "CAST(floor(length(t) / 4) AS BIGINT)"),
    "em_canonical": ("t STRING", "STRING", r"regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', '\n'), '(?m)[ \\t\\x0b\\f]+$', ''), '\\n{4,}', '\n\n\n')"),
    "em_sha16": ("t STRING", "STRING", "substring(sha2(encode(t, 'utf-8'), 256), 1, 16)"),
    "em_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "em_decay": ("age_days DOUBLE, half_life DOUBLE", "DOUBLE", "CASE WHEN age_days IS NULL OR age_days < 0 THEN 1D ELSE power(2D, -age_days / half_life) END"),
    "em_entropy": ("counts ARRAY<BIGINT>", "DOUBLE", "aggregate(counts, 0D, (s, n) -> s + CASE WHEN n > 0 THEN -(n / aggregate(counts, 0L, (a, b) -> a + b)) * log2(n / aggregate(counts, 0L, (a, b) -> a + b)) ELSE 0D END)"),
    "em_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
}

# name, parameters, columns, body in SQL
_TABLES = {
    "em_tiles": (
        "t STRING, chunk INT, step INT",
        "tile_index INT, start_char INT, end_char INT, content STRING",
        # the text is cut once into cells of a step, a tile is made of the few cells that begin with its own
        r"""SELECT x.i, x.start, x.e, substring(x.raw, 1, x.e - x.start) FROM (SELECT inline(flatten(transform(
              array(named_struct('cells', regexp_extract_all(t, concat('(?s).{1,', step, '}'), 0), 'n', length(t))), d -> transform(transform(transform(
                sequence(0, CASE WHEN d.n <= chunk THEN 0 ELSE CAST(floor((d.n - step div 2) / step) AS INT) END),
                i -> named_struct('i', i, 'n', d.n, 'start', CASE WHEN d.n <= chunk THEN 0 ELSE i * step END, 'raw', array_join(slice(d.cells, i + 1, CAST(ceil(chunk / step) AS INT)), ''),
                                  'stop', CASE WHEN d.n <= chunk OR (i + 1) * step >= d.n - step div 2 THEN d.n ELSE least(i * step + chunk, d.n) END)),
                g -> named_struct('g', g, 'back', reverse(substring(g.raw, CAST(floor(chunk * 8 / 10) AS INT) + 1, g.stop - g.start - CAST(floor(chunk * 8 / 10) AS INT))))),
                b -> named_struct('i', b.g.i, 'start', b.g.start, 'raw', b.g.raw, 'e', CASE WHEN b.g.stop >= b.g.n THEN b.g.stop WHEN locate('\\n\\n', b.back) > 0 THEN b.g.stop - locate('\\n\\n', b.back) + 1 WHEN locate(' .', b.back) > 0 THEN b.g.stop - locate(' .', b.back) + 1 ELSE b.g.stop END))))) AS (i, start, raw, e)) x""",
    ),
}


@udtf(returnType="key string, at timestamp, tie bigint, session_index int")
class Sessions:
    """Rows (key, at, tie) with the number of their session: ``em_sessions(TABLE(...) PARTITION BY key ORDER BY (at, tie), gap_seconds)``. Rows come one after the other; nothing of a group is held."""

    def __init__(self) -> None:
        self.last, self.index = None, 0

    def eval(self, row: Row, gap_seconds: int) -> Iterator[tuple]:
        at = row["at"]
        if self.last is None or (at is not None and (at - self.last).total_seconds() > gap_seconds):
            self.index += self.index == 0 or self.last is not None
        self.last = at if at is not None else self.last
        yield row["key"], at, row["tie"], self.index


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary SQL functions of the session; returns their names."""
    for name, (parameters, result, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, columns, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("em_sessions", Sessions)
    return [*_FUNCTIONS, *_TABLES, "em_sessions"]
