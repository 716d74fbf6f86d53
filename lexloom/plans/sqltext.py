"""Pieces of DuckDB SQL shared by the oracles, and literal tables for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import dims


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(lit, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {name}({columns})"


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({x}), '–—', '--'), '[^a-z0-9\-\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def toks(x: str) -> str:
    stop = lit(dims.STOP_WORDS)
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({norm(x)}, '[a-z0-9]+(?:-[a-z0-9]+)?'), lambda t: length(t) > 1 AND NOT list_contains({stop}, t))))"


def phrase(text: str, marker: str) -> str:
    """Both normalized; the marker at no letter or digit."""
    return f"regexp_matches({text}, '(^|[^a-z0-9])' || {marker} || '($|[^a-z0-9])')"


def canon(x: str) -> str:
    p = rf"(?i)^\s*(?:(?:{dims.SECTION_PREFIX}|{dims.ARTICLE_PREFIX})\s*)?(\d+)(?:\s*-\s*([a-z]{{1,3}})|([a-z]{{1,3}}))?(?:\s*\(\s*[a-z0-9]+\s*\))*\s*[.,;:]*\s*$"
    e = lambda i: f"regexp_extract({x}, '{p}', {i})"
    return f"CASE WHEN {e(1)} <> '' THEN {e(1)} || upper({e(2)} || {e(3)}) END"


def cited(x: str, prefix: str) -> str:
    n = dims.PROVISION_NUMBER.replace("(?:\\s*\\(\\s*[A-Za-z0-9]+\\s*\\))*", r"(?:\s*\(\s*[A-Za-z0-9]+\s*\))*")
    groups = rf"regexp_extract_all({x}, '(?i)\b{prefix}\s*({n}(?:\s*(?:,|and|or)\s*{n})*)', 1)"
    return f"list_filter(list_transform(flatten(list_transform({groups}, lambda g: regexp_extract_all(g, '(?i){n}'))), lambda v: {canon('v')}), lambda v: v IS NOT NULL)"


def sql_replace(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"
    return x
