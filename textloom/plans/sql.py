"""Pieces of DuckDB SQL that the comparison queries share."""

from __future__ import annotations


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rr(x: str, *pairs: tuple[str, str]) -> str:
    """Global regular-expression replacements in order."""
    for pattern, new in pairs:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(new)}, 'g')"
    return x


def swap(x: str, *pairs: tuple[str, str]) -> str:
    """Plain replacements in order."""
    for old, new in pairs:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return x


def trim(x: str) -> str:
    return rr(x, (" +", " "), ("(?m) $", ""), ("(?m)^ ", ""))


def by_line(x: str, line: str) -> str:
    """A text with each line l turned into ``line``."""
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {line}), chr(10))"


def documents(x: str) -> str:
    return f"SELECT doc_id, {x} AS text FROM documents"


#: Words and neighbouring words of the documents, marks set apart, with counts.
SPACED = rr("text", (r'([.,;:?!()"])', r" \1 "))
COUNTS = rf"""
spaced AS MATERIALIZED (SELECT {SPACED} AS text FROM documents),
uni AS MATERIALIZED (SELECT w AS ngram, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM spaced) WHERE w <> '' GROUP BY w),
line AS (SELECT list_filter(string_split(l, ' '), lambda w: w <> '') AS ws FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM spaced)),
bi AS MATERIALIZED (SELECT ws[i] || ' ' || ws[i + 1] AS ngram, count(*) AS c FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM line WHERE len(ws) > 1) GROUP BY 1),
counts AS (SELECT * FROM uni UNION ALL SELECT * FROM bi)
"""
