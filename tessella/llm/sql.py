"""The queries of this subpackage that SQL can express, for DuckDB."""

from __future__ import annotations

from tessella.llm.collocations import INSIDE_OF_100, LEAST, ORDERS, SCALE, TOP
from tessella.llm.quality import ERROR, LEVELS, RISK, RULES, WINDOW

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT = f"""WITH n AS (SELECT doc_id, translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size, doc_id = MAX(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)"""


def _without(text: str, characters: str) -> str:
    return f"translate({text}, {characters}, '')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def quality() -> str:
    """Figures, levels by exact binomial tails, and the verdict."""
    figure = {rule: sql.replace(" div ", " // ") for rule, (sql, _) in RULES.items()}
    count = lambda chars: f"length(t) - length({_without('t', chars)})"
    over = lambda level: " OR ".join(f"{figure[rule]} > {cuts[level - 1]}" for rule, (_, cuts) in RULES.items())
    unions = " UNION ALL ".join(f"SELECT stratum, COUNT(*) AS n, {level} AS level, COUNT(*) FILTER (WHERE {over(level)}) AS k FROM good GROUP BY stratum" for level in range(1, LEVELS + 1))
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r}))"
    reject = " ".join(f"WHEN {level} THEN {over(level)}" for level in range(1, LEVELS + 1))
    return f"""WITH base AS (SELECT doc_id, COALESCE(lang, '') AS stratum, COALESCE(text, '') AS t FROM documents),
parts AS (SELECT doc_id, stratum, t, {_words('t')} AS words, list_filter(string_split(t, chr(10)), lambda x: length({_without('x', _BLANKS)}) > 0) AS lines FROM base),
spans AS (SELECT doc_id, unnest(range(0, len(words) - {WINDOW - 1})) AS i, words FROM parts WHERE len(words) >= {WINDOW}),
windows AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') AS w FROM spans),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT i + d) AS n FROM again, (SELECT range AS d FROM range({WINDOW})) GROUP BY doc_id),
figures AS (SELECT p.doc_id, stratum, len(words) AS n_words, length({_without('t', _BLANKS)}) AS word_chars, {count("'#*$%&|<>'")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  COALESCE(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, {count("'|'")} AS n_bars, {count("'!'")} AS n_marks, {count(f"'{_UPPER}'")} AS n_upper FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures),
good AS (SELECT j.* FROM judged j JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING MIN(quality) = 1) USING (doc_id) WHERE NOT base_failed),
tests AS ({unions}),
tails AS (SELECT stratum, level, CASE WHEN k <= n * {RISK!r} THEN (SELECT SUM({term}) FROM (SELECT unnest(range(0, k + 1)) AS i)) ELSE 1 END AS tail FROM tests),
chosen AS (SELECT stratum, COALESCE(MIN(level) FILTER (WHERE tail > {ERROR} / (SELECT COUNT(DISTINCT stratum) FROM tests)), {LEVELS + 1}) - 1 AS level FROM tails GROUP BY stratum)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT (CASE WHEN n_words > 0 THEN CASE level {reject} ELSE false END ELSE false END) AS kept FROM judged f LEFT JOIN chosen USING (stratum)"""


def collocations() -> str:
    """N-grams of pieces, the worst cut of each candidate, and the best of each language."""
    orders = (1, *ORDERS)
    ahead = ", ".join(f"lead(w, {k}) OVER p AS w{k}" for k in range(1, max(orders)))
    gram = lambda k: " || ' ' || ".join(["w", *(f"w{i}" for i in range(1, k))])
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, {gram(k)} AS phrase FROM places WHERE w{k - 1 or ''} IS NOT NULL" for k in orders)
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i + 1 : i + {m}], ' ') AS phrase, a FROM (SELECT lang, w, a, unnest(range(0, len(w) - {m - 1})) AS i FROM candidates WHERE len(w) > {m})" for m in ORDERS[:-1])
    return f"""WITH base AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
cut AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM base),
pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w, row_number() OVER () AS piece FROM cut),
each AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS i FROM pieces),
places AS (SELECT lang, w, {ahead} FROM each WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, k, phrase, COUNT(*) AS a FROM ({grams}) GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(SUM(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= {LEAST}),
cuts AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM candidates),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(CAST(c.a AS HUGEINT) * {SCALE} // (x.a + y.a) AS BIGINT) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1 :], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (SELECT lang, phrase, MAX(a) AS longer FROM ({inner}) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM worst s LEFT JOIN within i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < {INSIDE_OF_100} * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op13_collocations": collocations(), "op8_exact_dedup": EXACT, "op10_quality_rules": quality()}
