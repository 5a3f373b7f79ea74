"""SQL of the queries, written for DuckDB and independent of the column functions."""

from __future__ import annotations

from citeforge.functions import fixed
from citeforge.functions.text import LIGATURES, fold_table
from citeforge.plans.views import REFS_CTE, WORKS_CTE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A pattern in RE2's dialect, as a literal: it folds all letters under (?i)."""
    return q(pattern.replace("(?iu)", "(?i)").replace("(?su)", "(?s)"))


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {q(to)}, 'g')"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {rx(pattern)}, {group})"


def every(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({x}, {rx(pattern)}, {group})"


DOI_CHARS = "chr(32)||chr(9)||chr(13)||chr(10)||chr(34)||chr(39)||'<>[]{}'"
DOI_TAIL = r"[.,;:]+$"


def unquote(x: str) -> str:
    return f"trim(url_decode(coalesce({x}, '')))"


def doi_simple(x: str, prefix: str) -> str:
    return f"lower({sub('string_split_regex(trim(' + sub(unquote(x), prefix, '') + ', ' + DOI_CHARS + '), ' + q('[#?]') + ')[1]', DOI_TAIL, '')})"


def doi_full(x: str) -> str:
    """The steps before bracket balancing."""
    a = f"trim({sub('replace(' + unescape(unquote(x)) + ', chr(160), chr(32))', fixed.DOI_PREFIX, '')}, {DOI_CHARS})"
    return sub(sub(f"string_split_regex({a}, '[#?]')[1]", fixed.DOI_ENDPOINT, ""), DOI_TAIL, "")


def balanced(x: str, left: str, right: str) -> str:
    n = lambda c: f"(length({x}) - length(replace({x}, '{c}', '')))"
    return f"substr({x}, 1, length({x}) - greatest(0, least(length(regexp_extract({x}, '\\{right}+$')), {n(right)} - {n(left)})))"


def unescape(x: str) -> str:
    for name, char in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {char})"
    return x


def fold(x: str) -> str:
    a, b = fold_table()
    for c, plain in LIGATURES.items():
        x = f"replace({x}, {q(c)}, {q(plain)})"
    return f"trim(regexp_replace(lower(translate({x}, {q(a)}, {q(b)})), '[^a-z0-9]+', ' ', 'g'))"


def tokens(normal: str, stop: tuple[str, ...] = fixed.STOP_BASE) -> str:
    words = ", ".join(q(w) for w in stop)
    return f"list_filter(string_split({normal}, ' '), lambda t: length(t) > 2 AND t NOT IN ({words}))"


def clean_query(x: str) -> str:
    for pattern in (fixed.DOI_OR_URL, fixed.URL, fixed.SOURCE_TAG):
        x = sub(x, pattern, " ")
    return f"trim({sub(x, r'\s+', ' ')}, ' .;,')"


def limit(x: str, most: int) -> str:
    head = f"substr({x}, 1, {most})"
    return f"CASE WHEN length({x}) <= {most} THEN {x} WHEN instr({head}, ' ') > 0 THEN trim(regexp_extract({head}, '^(.*) ', 1), ' .;,') ELSE trim({head}, ' .;,') END"


def normalized_reference(x: str) -> str:
    x = sub(f"replace({x}, chr(173), '')", fixed.LEADING_NUMBER, "")
    x = sub(x, fixed.BROKEN_WORD, "\\1\\2")
    return f"trim({sub(sub(x, fixed.NOISE, ' '), r'\s+', ' ')}, ' .;,')"


def percent(part: str, whole: str) -> str:
    return f"CAST((({part}) * 20000 + ({whole})) // nullif(({whole}) * 2, 0) AS DOUBLE) / 100.0"


WITH_REFS = f"WITH refs AS ({REFS_CTE})"
WITH_BOTH = f"WITH refs AS ({REFS_CTE}), works AS ({WORKS_CTE})"

#: What the identifier stage gives: every reference with the first successful of its DOIs.
DOI_CANDIDATES = f"""
cand0 AS (
  SELECT sample_index, replace(context, chr(160), ' ') AS t,
         len({every("context", fixed.DOI_PREFIXED)}) > 0 AS prefixed FROM refs
), raw AS (
  SELECT sample_index,
         CASE WHEN prefixed THEN {every("t", fixed.DOI_PREFIXED)} ELSE {every("t", fixed.DOI)} END AS a,
         CASE WHEN prefixed THEN {every("t", fixed.DOI_PREFIXED + f"(?:{fixed.DOI_CONTINUATION})?", 2)}
              ELSE {every("t", fixed.DOI + f"(?:{fixed.DOI_CONTINUATION})?", 2)} END AS b FROM cand0
), doi_pairs AS (
  SELECT sample_index, unnest(a) AS r, unnest(b) AS m, generate_subscripts(a, 1) AS i FROM raw
), each AS (
  SELECT sample_index, i * 2 AS pos, r AS x FROM doi_pairs
  UNION ALL SELECT sample_index, i * 2 + 1, r || {sub("m", DOI_TAIL, "")} FROM doi_pairs WHERE m <> ''
), step AS (
  SELECT sample_index, pos, {doi_full("x")} AS y FROM each
), done AS (
  SELECT sample_index, pos, lower({balanced("y", "(", ")")}) AS doi FROM step
), doi_cand AS (
  SELECT sample_index, doi, min(pos) AS pos FROM done WHERE regexp_matches(doi, '^10\\.[0-9]{{4,9}}/.+') GROUP BY sample_index, doi
)
"""

DOI_STAGE = f"""
{DOI_CANDIDATES}, tried AS (
  SELECT c.sample_index, c.doi, c.pos, coalesce(w.status, 'not_found') AS status,
         row_number() OVER (PARTITION BY c.sample_index ORDER BY CASE coalesce(w.status, 'not_found') WHEN 'found' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, c.pos) AS rn
  FROM doi_cand c LEFT JOIN works w ON w.doi = c.doi AND w.status <> 'not_found'
), doi_stage AS (
  SELECT r.sample_index, t.doi, coalesce(t.status, 'no_doi') AS status
  FROM refs r LEFT JOIN tried t ON t.sample_index = r.sample_index AND t.rn = 1
)
"""

#: Over columns context and no_space.
CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches({'no_space' if n == 'dergipark_file' else 'context'}, {rx(p)}) THEN '{n}'"
    for n, p in fixed.CATEGORIES.items()
) + " ELSE 'other' END"
