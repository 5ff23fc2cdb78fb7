"""SQL fragments that the DuckDB oracles share."""

from __future__ import annotations

from tessera.functions.text import STOPWORDS, SUFFIXES

STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)
STEM_SQL = "regexp_replace({0}, '^(.{{3,}}?)(?:" + "|".join(SUFFIXES) + ")$', '\\1')"


def terms_sql(column: str = "text", w: str = "w") -> str:
    """The analyzed terms of a text column, as a list; ``w`` names the lambdas' variable."""
    words = f"list_transform(regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}]+'), lambda {w}: lower({w}))"
    return f"list_transform(list_filter({words}, lambda {w}: {w} NOT IN ({STOP_LIST})), lambda {w}: {STEM_SQL.format(w)})"


#: docs(doc_id, lang, source, n_chars, terms), post(doc_id, term, tf), stats(n, avgdl)
INDEX = f"""docs AS (SELECT doc_id, lang, source, n_chars, {terms_sql()} AS terms FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs)"""


def bm25(*terms: str, where: str = "TRUE", name: str = "scored") -> str:
    """A CTE of doc_id and score over the terms, for documents (alias d) that meet ``where``.

    has('t') in ``where`` becomes a test for the term, near('a b') one for neighbours.
    """
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""qdf AS (SELECT term, count(*) AS df FROM post WHERE term IN ({listed}) GROUP BY term),
{name} AS (SELECT d.doc_id, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars,
  round_even(coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.terms) / avgdl))), 0), 4) AS score
  FROM docs d CROSS JOIN stats LEFT JOIN (SELECT * FROM post JOIN qdf USING (term)) p ON p.doc_id = d.doc_id WHERE {where} GROUP BY d.doc_id)"""


def has(term: str) -> str:
    return f"list_contains(d.terms, '{term}')"


def phrase(*terms: str) -> str:
    spaced = " ".join(terms)
    return f"contains(' ' || array_to_string(d.terms, ' ') || ' ', ' {spaced} ')"
