"""Pieces of SQL shared by the oracle statements."""

from __future__ import annotations

GAP = r"[ ,/\\|&\x07\x08\t\n\x0B\f\r]+"
END = "[.:;!?]"
#: Documents as articles, dated by their number.
ARTICLES = """art AS (SELECT CAST(doc_id AS VARCHAR) AS article_id,
  strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS date, text
  FROM documents WHERE length(text) > 0)"""


def sentences(src: str = "art", name: str = "sents") -> str:
    return f"""{name} AS (SELECT article_id, date, generate_subscripts(l, 1) AS s, unnest(l) AS sent
  FROM (SELECT article_id, date, regexp_split_to_array(text, '{END}') AS l FROM {src}))"""


def tokens(src: str = "sents", name: str = "toks") -> str:
    """Tokens with their sentence, and their place in the article from 0."""
    return f"""raw_{name} AS (SELECT article_id, date, s, generate_subscripts(l, 1) AS p, unnest(l) AS token
  FROM (SELECT article_id, date, s, regexp_split_to_array(sent, '{GAP}') AS l FROM {src})),
{name} AS (SELECT article_id, date, s, token, row_number() OVER (PARTITION BY article_id, date ORDER BY s, p) - 1 AS pos
  FROM raw_{name} WHERE token <> '')"""


TOKENS = f"WITH {ARTICLES},\n{sentences()},\n{tokens()}"


def group(resolution: str, date: str = "date") -> str:
    return {
        "weeks": f"strftime(CAST({date} AS DATE), '%G-#%V')",
        "days": date,
        "months": f"substr({date}, 1, 7)",
        "years": f"substr({date}, 1, 4)",
    }[resolution]


def every_group(resolution: str, source: str, name: str = "allg") -> str:
    """All groups between the first and last date of a relation with a date column."""
    return f"""{name} AS (SELECT DISTINCT {group(resolution, "d")} AS date FROM (
  SELECT strftime(CAST(unnest(generate_series(min(CAST(date AS DATE)), max(CAST(date AS DATE)), INTERVAL 1 DAY)) AS DATE), '%Y-%m-%d') AS d FROM {source}))"""
