"""DuckDB statements for the queries of this package, written independently of the column expressions."""

from __future__ import annotations

from collections.abc import Sequence

# Literals of its own, so that a slip in the code under test shows.

# Rule packs of the obligation register.
ACTION_WORDS = ("must", "shall", "required", "require", "ensure", "direct", "comply", "submit", "maintain", "establish", "monitor", "assess")
CATEGORY_RULES = (
    ("Risk Management", ("risk", "mitigate", "exposure", "control", "impact")),
    ("Governance", ("board", "committee", "governance", "approval", "management")),
    ("Reporting / Notification", ("notify", "report", "submit", "inform", "disclose")),
    ("Outsourcing / Third Party", ("outsourc", "service provider", "third party", "agreement")),
    ("Legal & Compliance", ("comply", "regulation", "act", "directive", "legislative")),
)
CATEGORY_DEFAULT = "Informational / Context"
DEPARTMENT_RULES = (
    ("Risk Management", "Enterprise Risk Management", ("risk", "mitigate", "exposure")),
    ("Legal & Compliance", "Regulatory Compliance", ("comply", "regulation", "act", "directive", "legal")),
    ("Operations", "Business Operations", ("process", "service", "outsourc", "operations")),
    ("Board / Senior Management", "Governance Office", ("board", "senior management", "committee")),
    ("Finance", "Finance Control", ("financial", "capital", "amount", "fee")),
)
DEPARTMENT_DEFAULT = ("Legal & Compliance", "Regulatory Compliance")
HIGH_TOKENS = ("must", "shall", "prohibit", "breach", "non-compliance", "effective date")
LOW_TOKENS = ("should", "may", "consider")
NOT_ACTIONABLE = "This section provides contextual or background information and does not create a direct compliance obligation."

# Rule packs of the gap review.
NEGATIVE_PHRASES = ("does not currently require", "does not yet require", "not defined", "not mandatory", "not required", "no requirement", "not documented")
STOPWORDS = (
    "this", "that", "with", "from", "shall", "must", "have", "will", "they", "their", "there",
    "under", "section", "directive", "institution", "regulatory", "obligation", "material", "outsourcing",
    "outsourced", "arrangement", "arrangements", "policy", "business", "function", "functions",
)
INFORMATIONAL_PHRASES = ("contextual background", "background context", "does not create", "no direct implementation obligation", "not applicable", "informational")
ESCALATION_TOKENS = ("notify", "notification", "annual independent", "tested exit", "exit plan")

# Sections of the catalogue.
KNOWN_CATEGORIES = ("Insurer / Micro Insurer", "Joint FSCA / PA Directives", "Retirement Fund")

# Words that tell the section of a catalogue entry, in this order; a blank stands before and after the text.
SECTION_RULES = (
    ("Retirement Fund", ("retirement", "pension")),
    ("Joint FSCA / PA Directives", ("joint", "prudential authority", " pa ")),
    ("Insurer / Micro Insurer", ("long-term", "short-term", "insur", "ltst")),
)
SECTION_DEFAULT = "Directives"
COVERED, PARTIAL, MISSING, NOT_APPLICABLE = "Completely Covered", "Partially Covered", "Completely Missing", "Not Applicable / Informational"
# Texts of the review.
NO_EVIDENCE_NEEDED = "No policy evidence required because the directive item is informational/background only."
ADVICE = {
    "covered": "No gap identified. No policy update is required based on the matched policy evidence.",
    "partial": (
        "Policy partially addresses the topic but does not fully evidence the regulatory requirement. "
        "Update the policy to explicitly cover the missing obligation elements, owner, control evidence, and review frequency."
    ),
    "negative": (
        "Policy evidence indicates this requirement is not currently defined or mandatory. "
        "Add a specific policy clause to address the obligation and assign ownership for implementation and evidence retention."
    ),
    "missing": (
        "No directly supporting policy text was identified. Add a new policy clause addressing this obligation, including ownership, controls, monitoring, and evidence requirements."
    ),
    "informational": (
        "This directive section is background or contextual and does not create a direct policy action; "
        "no policy amendment is required unless management wants to reference it for completeness."
    ),
}
NO_MATCH = "No directly matching policy text was identified in the uploaded policy."

# Tokens of an uploaded register that stand for a missing value.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: One character of white space, as Unicode and Python see it.
_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_WORD = r"[^\pL\pN_]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(low: str, tokens: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {_quoted(t)})" for t in tokens) + ")"


def _first_best(low: str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> str:
    scores = ", ".join("(" + " + ".join(f"CAST(contains({low}, {_quoted(t)}) AS INT)" for t in tokens) + ")" for _, tokens in rules)
    names = ", ".join(_quoted(n) for n, _ in rules)
    return f"CASE WHEN list_max([{scores}]) = 0 THEN {_quoted(default)} ELSE [{names}][list_position([{scores}], list_max([{scores}]))] END"


def _text(c: str) -> str:
    return f"coalesce({c}, '')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _one_line(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_W}+', ' ', 'g'))"


# --- parsing -----------------------------------------------------------------------------------------------------------

_PARSED = r"""
fields AS (
  SELECT u.upload_id, u.delimiter AS d,
         [trim(h) FOR h IN regexp_extract_all(u.delimiter || u.header_line, '\Q' || u.delimiter || '\E([^' || u.delimiter || ']*)', 1)] AS names
  FROM register_uploads u),
split AS (
  SELECT r.raw_id, r.raw_text, f.names,
         '("([^"]|"")*"|[^"\r\n' || f.d || ']*)' AS one, f.d
  FROM register_raw r LEFT JOIN fields f USING (upload_id)),
shaped AS (
  SELECT raw_id, names, regexp_full_match(raw_text, one || '(\Q' || d || '\E' || one || ')*') AS sound,
         regexp_extract_all(d || raw_text, '\Q' || d || '\E("(?:[^"]|"")*"|[^"\r\n' || d || ']*)', 1) AS raw
  FROM split),
valued AS (
  SELECT raw_id, names, sound, len(raw) AS width,
         [regexp_replace(CASE WHEN v LIKE '"%' THEN replace(substring(v, 2, length(v) - 2), '""', '"') ELSE v END, '^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$', '', 'g') FOR v IN raw] AS vals
  FROM shaped),
named AS (
  SELECT raw_id, sound, width, len(names) AS wanted,
         vals[list_position(names, 'Section')] AS v_section, vals[list_position(names, 'Language from Directive')] AS v_language,
         vals[list_position(names, 'Obligation')] AS v_obligation, vals[list_position(names, 'Obligation Category')] AS v_category,
         vals[list_position(names, 'Primary Responsible Department')] AS v_department, vals[list_position(names, 'Support Function')] AS v_support,
         names
  FROM valued),
reasoned AS (
  SELECT *, CASE WHEN names IS NULL THEN 'no header' WHEN sound IS NULL THEN 'no record' WHEN NOT sound THEN 'quoting'
    WHEN width <> wanted THEN 'column count'
    ELSE (list_sort([x FOR x IN [
      CASE WHEN NOT regexp_full_match(v_section, '[0-9]+(\.[0-9]+)*|Introduction') THEN [list_position(names, 'Section')::VARCHAR, 'Section'] END,
      CASE WHEN lower(v_language) IN ('', 'na', 'n/a', 'none', 'null', 'nan') OR regexp_matches(v_language, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]')
        THEN [list_position(names, 'Language from Directive')::VARCHAR, 'Language from Directive'] END,
      CASE WHEN lower(v_obligation) IN ('', 'na', 'n/a', 'none', 'null', 'nan') OR regexp_matches(v_obligation, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]')
        THEN [list_position(names, 'Obligation')::VARCHAR, 'Obligation'] END] IF x IS NOT NULL]))[1][2] END AS why
  FROM named)
"""
_REASON = "CASE WHEN why IN ('Section', 'Language from Directive', 'Obligation') THEN 'invalid ' || why ELSE why END"
_NA = ", ".join(_quoted(x) for x in NA_VALUES)

# --- documents ---------------------------------------------------------------------------------------------------------

_WORDING = f"(SELECT clause_id, doc, section, {_text('language_from_directive')} AS w FROM directive_clauses)"
_LOW = "lower(w)"
_SHORT = _one_line("w")
_ACTIONABLE = _any(_LOW, ACTION_WORDS)
_CATEGORY = _first_best(_LOW, CATEGORY_RULES, CATEGORY_DEFAULT)
_DEPARTMENT = _first_best(_LOW, [(d, t) for d, _, t in DEPARTMENT_RULES], DEPARTMENT_DEFAULT[0])
_SUPPORT = _first_best(_LOW, [(s, t) for _, s, t in DEPARTMENT_RULES], DEPARTMENT_DEFAULT[1])
_PRIORITY = f"CASE WHEN {_any(_LOW, HIGH_TOKENS)} THEN 'High' WHEN {_any(_LOW, LOW_TOKENS)} THEN 'Low' ELSE 'Medium' END"
_OBLIGATION = (
    f"CASE WHEN NOT {_any('lower(s)', ACTION_WORDS)} THEN {_quoted(NOT_ACTIONABLE)} ELSE "
    "(CASE WHEN contains(lower(s), 'bank') THEN 'The institution' ELSE 'Insurers' END) || ' must address the requirement described in section ' || section || ': ' || "
    "(CASE WHEN length(s) > 240 THEN rtrim(substring(s, 1, 237)) || '...' ELSE s END) END"
)
_REGISTER = f"""(SELECT clause_id, doc, section, {_OBLIGATION} AS obligation, {_CATEGORY} AS obligation_category, {_DEPARTMENT} AS primary_responsible_department,
  {_SUPPORT} AS support_function, {_PRIORITY} AS priority, CASE WHEN {_ACTIONABLE} THEN 'Yes' ELSE 'No' END AS actionable
  FROM (SELECT *, {_SHORT} AS s FROM {_WORDING}))"""

_PAGES = rf"""(SELECT doc, try_cast(page AS INT) AS page, min(sequence_no) AS s, arg_min(clause_id, (sequence_no, clause_id)) AS c,
    string_agg({_text('language_from_directive')}, chr(10) ORDER BY sequence_no, clause_id) AS text
  FROM directive_clauses GROUP BY doc, try_cast(page AS INT), CASE WHEN try_cast(page AS INT) IS NULL THEN clause_id END)"""

_BREAKDOWN = rf"""
WITH docs AS (
  SELECT doc, replace(string_agg(section || ' ' || {_text('language_from_directive')}, chr(10) ORDER BY sequence_no, clause_id), chr(13), chr(10)) AS t FROM directive_clauses GROUP BY doc),
lines AS (SELECT doc, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM docs),
clean AS (SELECT doc, n, {_one_line('line')} AS line FROM lines),
flagged AS (
  SELECT *, regexp_full_match(line, '((\p{{Nd}}+\.)+\p{{Nd}}*) .*') OR
    (regexp_full_match(line, '(\p{{Nd}}+\.)+\p{{Nd}}*') AND coalesce(max(CASE WHEN line <> '' THEN 1 END) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1) AS starts,
    list_last(regexp_extract_all(line, '--- Page (\p{{Nd}}+) ---', 1)) AS mark
  FROM clean),
islands AS (
  SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc ORDER BY n) AS island,
    last_value(mark IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM flagged),
pieces AS (
  SELECT doc, island,
    min_by(CASE WHEN island = 0 THEN 'Introduction' ELSE rtrim(regexp_extract(line, '^((\p{{Nd}}+\.)+\p{{Nd}}*)', 1), '.') END, n) AS section,
    trim(string_agg(CASE WHEN starts THEN regexp_replace(line, '^((\p{{Nd}}+\.)+\p{{Nd}}*) ?', '') ELSE line END, chr(10) ORDER BY n), ' ' || chr(10)) AS wording,
    coalesce(min_by(CASE WHEN island > 0 THEN coalesce(before, 'Unknown') END, n), 'Unknown') AS page,
    count(*) OVER (PARTITION BY doc) AS pieces
  FROM islands GROUP BY doc, island)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY island) AS INT) AS seq, section, wording, page
FROM pieces WHERE wording <> '' OR pieces = 1
"""

# --- policies ----------------------------------------------------------------------------------------------------------

_CHUNKS = rf"""
policies AS (
  SELECT doc AS policy, string_agg('--- Page ' || sequence_no || ' ---' || chr(10) || {_text('corresponding_policy_text')}, chr(10) ORDER BY sequence_no, gap_id) AS raw
  FROM gap_assessment WHERE {_strip(_text('corresponding_policy_text'))} <> '' GROUP BY doc),
paged AS (SELECT policy, string_split(regexp_replace({_strip('raw')}, '(?:^|\n+)--- Page (\p{{Nd}}+) ---\n', chr(2) || '\1' || chr(3), 'g'), chr(2)) AS parts, raw FROM policies),
pages AS (
  SELECT policy, 0 AS k, 'Unknown' AS page, raw AS text FROM paged WHERE len(parts) = 1
  UNION ALL
  SELECT policy, k, split_part(part, chr(3), 1), split_part(part, chr(3), 2) FROM
    (SELECT policy, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM paged WHERE len(parts) > 1) WHERE k > 1),
heads AS (SELECT policy, k, page, regexp_replace(replace(text, chr(13), chr(10)), '[ \t]+', ' ', 'g') AS clean FROM pages),
cut AS (SELECT *, string_split(regexp_replace(clean, '(?m)^{_W}*(\p{{Nd}}+)\.{_W}+', chr(1) || '\0', 'g'), chr(1)) AS parts FROM heads),
sliced AS (
  SELECT policy, k, page, CASE
    WHEN len(parts) = 1 THEN [{_strip('substring(clean, CAST(i AS INT) + 1, 1800)')} FOR i IN range(0, length(clean), 1800)]
    ELSE flatten([[p] FOR p IN [{_strip('parts[1]')}]] || [CASE WHEN length(p) > 1800 THEN [{_strip('substring(p, CAST(i AS INT) + 1, 1800)')} FOR i IN range(0, length(p), 1800)] ELSE [p] END
      FOR p IN [{_strip('q')} FOR q IN parts[2:]]]) END AS texts
  FROM cut),
rows AS (SELECT policy, k, page, unnest(texts) AS text, generate_subscripts(texts, 1) AS j FROM sliced),
filled AS (SELECT policy, page, text, row_number() OVER (PARTITION BY policy ORDER BY k, j) AS chunk_seq FROM rows WHERE text <> ''),
chunks AS (
  SELECT policy, CAST(chunk_seq AS INT) AS chunk_seq, page, text FROM filled
  UNION ALL
  SELECT policy, 1, 'Unknown', substring({_strip('raw')}, 1, 1800) FROM policies
  WHERE policy NOT IN (SELECT policy FROM filled) AND {_strip('raw')} <> '')
"""
_STOP = "[" + ", ".join(_quoted(w) for w in STOPWORDS) + "]"
_TERMS = "[w FOR w IN regexp_extract_all(lower({0}), '[A-Za-z][A-Za-z-]{{3,}}') IF NOT list_contains({1}, w)][1:35]"
_MATCHED = rf"""
asked AS (SELECT gap_id, doc AS policy, {_text('obligation')} AS obligation, {_text('language_from_directive')} AS wording FROM gap_assessment),
termed AS (SELECT *, {_TERMS.format("obligation || ' ' || wording", _STOP)} AS terms FROM asked),
scored AS (
  SELECT t.gap_id, c.chunk_seq, c.page, c.text, len([x FOR x IN t.terms IF contains(lower(c.text), x)])::DOUBLE / greatest(len(t.terms), 1) AS score
  FROM termed t JOIN chunks c USING (policy)),
best AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, chunk_seq) = 1),
matched AS (
  SELECT a.*, coalesce(b.score, 0.0) AS keyword_score, coalesce(b.page, 'Not located') AS match_page, coalesce(b.text, {_quoted(NO_MATCH)}) AS match_text
  FROM asked a LEFT JOIN best b USING (gap_id))
"""
# Token-set similarity with the longest common subsequence as a table filled row by row.
_TITLES = rf"""titles AS (SELECT seq, coalesce(title, '') AS a, lead(coalesce(title, '')) OVER (PARTITION BY section ORDER BY seq) AS b FROM directives),
sets AS (SELECT seq, a, b, list_filter(list_distinct(string_split_regex(a, '{_W}+')), lambda w: w <> '') AS x, list_filter(list_distinct(string_split_regex(b, '{_W}+')), lambda w: w <> '') AS y
  FROM titles WHERE b IS NOT NULL),
parts AS (SELECT *, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS s, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS ox,
  array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS oy FROM sets),
coded AS (SELECT *, [[unicode(c)] FOR c IN string_split(ox, '')] AS cx, [unicode(c) FOR c IN string_split(oy, '')] AS cy, CASE WHEN s <> '' THEN 1 ELSE 0 END AS gap FROM parts),
common AS (SELECT *, length(s) + gap + length(ox) AS nx, length(s) + gap + length(oy) AS ny, CASE WHEN ox = '' OR oy = '' THEN 0 ELSE list_last(list_reduce(cx,
    lambda above, c: list_reduce([[j] FOR j IN range(1, length(oy) + 1)], lambda acc, j: list_append(acc, CASE WHEN c[1] = cy[j[1]] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], acc[j[1]]) END), [0]),
    [0 FOR j IN range(0, length(oy) + 1)])) END AS lcs FROM coded),
rated AS (SELECT seq, {_TERMS.format("a", _STOP)} AS terms, lower(b) AS low, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN gap = 1 AND (ox = '' OR oy = '') THEN 1.0
    ELSE greatest(1 - (length(ox) + length(oy) - 2 * lcs) / (nx + ny), CASE WHEN gap = 1 THEN greatest(1 - (gap + length(ox)) / (length(s) + nx), 1 - (gap + length(oy)) / (length(s) + ny)) ELSE 0 END) END AS similarity
  FROM common),
scores AS (SELECT seq, similarity, len([t FOR t IN terms IF contains(low, t)])::DOUBLE / greatest(len(terms), 1) AS share FROM rated)"""
_COMBINED = "lower(obligation || ' ' || wording)"
_NEGATIVE = _any("lower(match_text)", NEGATIVE_PHRASES)
_STATUS = (
    f"CASE WHEN {_any(_COMBINED, INFORMATIONAL_PHRASES)} THEN {_quoted(NOT_APPLICABLE)} "
    f"WHEN {_NEGATIVE} THEN CASE WHEN {_any(_COMBINED, ESCALATION_TOKENS)} THEN {_quoted(MISSING)} ELSE {_quoted(PARTIAL)} END "
    f"WHEN keyword_score >= 0.56 THEN {_quoted(COVERED)} WHEN keyword_score >= 0.18 THEN {_quoted(PARTIAL)} ELSE {_quoted(MISSING)} END"
)
_ASSESSED = f"""
SELECT gap_id, status AS coverage_status,
  CASE status WHEN {_quoted(COVERED)} THEN {_quoted(ADVICE['covered'])} WHEN {_quoted(PARTIAL)} THEN {_quoted(ADVICE['partial'])}
    WHEN {_quoted(MISSING)} THEN CASE WHEN negative THEN {_quoted(ADVICE['negative'])} ELSE {_quoted(ADVICE['missing'])} END
    ELSE {_quoted(ADVICE['informational'])} END AS policy_gap_and_recommendations,
  CASE WHEN status = {_quoted(MISSING)} AND NOT negative THEN 'Not located' WHEN status = {_quoted(NOT_APPLICABLE)} THEN 'Not applicable' ELSE match_page END AS policy_page,
  CASE WHEN status = {_quoted(MISSING)} AND NOT negative THEN {_quoted(NO_MATCH)} WHEN status = {_quoted(NOT_APPLICABLE)} THEN {_quoted(NO_EVIDENCE_NEEDED)} ELSE match_text END AS corresponding_policy_text,
  CASE status WHEN {_quoted(MISSING)} THEN 'High' WHEN {_quoted(PARTIAL)} THEN 'Medium' ELSE 'Low' END AS priority
FROM (SELECT *, {_STATUS} AS status, {_NEGATIVE} AS negative FROM matched)"""

# --- catalogue ---------------------------------------------------------------------------------------------------------


def _safe(c: str) -> str:
    return rf"coalesce(nullif(regexp_replace(trim(regexp_replace({c}, '[^A-Za-z0-9._() -]+', '_', 'g')), '\s+', ' ', 'g'), ''), 'file')"


def _section(c: str) -> str:
    low = f"lower({c})"
    return (
        f"CASE WHEN contains({low}, 'retirement') OR contains({low}, 'pension') THEN 'Retirement Fund' "
        f"WHEN contains({low}, 'joint') OR contains({low}, 'prudential authority') OR contains(' ' || {low} || ' ', ' pa ') THEN 'Joint FSCA / PA Directives' "
        f"WHEN {_any(low, ('long-term', 'short-term', 'insur', 'ltst'))} THEN 'Insurer / Micro Insurer' ELSE 'Directives' END"
    )


def _year(c: str) -> str:
    return rf"coalesce(nullif(regexp_extract({c}, '(?:^|{_NO_WORD})(20\p{{Nd}}{{2}}|19\p{{Nd}}{{2}})(?:$|{_NO_WORD})', 1), ''), 'Unknown')"


def _number(c: str) -> str:
    named = rf"replace(regexp_extract({c}, '(?i)Directive{_W}+([0-9A-Za-z.]+(?:{_W}*\([^)]+\))?)', 1), ' ', '')"
    return rf"coalesce(nullif({named}, ''), regexp_extract({c}, '(?:^|{_NO_WORD})(\p{{Nd}}{{2,3}}\.[A-Z]\.[A-Za-z])(?:$|{_NO_WORD})', 1))"


_KNOWN = ", ".join(_quoted(c) for c in KNOWN_CATEGORIES)
_REST = f"""
WITH items AS (SELECT seq, {_strip(_text('title'))} AS t, source_link AS ref, filename AS leaf, CASE WHEN seq % 3 <> 0 THEN category END AS given,
    nullif(year, 'Unknown') AS y, {_strip(_text('description'))} AS no FROM directives),
hay AS (SELECT *, t || ' ' || ref || ' ' || leaf || ' ' || coalesce(given, '') || ' ' || no || ' ' AS hay FROM items),
kept AS (SELECT *, CASE WHEN given IN ({_KNOWN}) THEN given ELSE {_section('hay')} END AS section FROM hay WHERE contains(lower(hay), 'directive') OR given IN ({_KNOWN})),
made AS (SELECT seq, substring(sha1(ref), 1, 12) AS id, coalesce(nullif(t, ''), {_safe('leaf')}) AS title, section, coalesce(given, section) AS category,
    coalesce(y, {_year('hay')}) AS year, ref AS source_link, {_safe('leaf')} AS filename, no AS description FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_link ORDER BY seq DESC) AS back, min(seq) OVER (PARTITION BY source_link) AS first FROM made)
SELECT first AS seq, id, title, section, category, year, source_link, filename, description FROM ranked WHERE back = 1"""
_ANCHORS = rf"""
WITH links AS (SELECT seq, {_one_line(_text('title'))} AS label, source_link AS href FROM directives),
kept AS (SELECT *, label || ' ' || href AS hay, {_safe("regexp_extract(href, '[^/]+$')")} AS filename FROM links WHERE regexp_matches(label || ' ' || href, '(?i)directive|\.pdf|LTST|FSCA|FSB')),
made AS (SELECT seq, substring(sha1(href), 1, 12) AS id, CASE WHEN length(label) > 5 THEN label ELSE filename END AS title, {_section('hay')} AS section,
    {_year('hay')} AS year, href AS source_link, filename FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_link ORDER BY seq DESC) AS back, min(seq) OVER (PARTITION BY source_link) AS first FROM made)
SELECT first AS seq, id, title, section, year, source_link, filename FROM ranked WHERE back = 1"""
_FILES = rf"""
WITH named AS (SELECT seq, filename, local_path, CASE WHEN contains(filename, '101') THEN 'Directive 101.A.i (LT&ST) - Directors and Managing Executive'
    WHEN contains(filename, '159') THEN 'Directive 159.A.i (LT&ST) - Outsourcing' ELSE regexp_replace(filename, '(.)\.[^.]*$', '\1') END AS title
  FROM directives WHERE local_path IS NOT NULL),
worded AS (SELECT *, title || ' ' || filename || ' ' || {_number('filename')} AS words FROM named)
SELECT seq, substring(sha1(local_path), 1, 12) AS id, title, {_section('words')} AS section, {_year('words')} AS year, {_safe('filename')} AS filename, local_path FROM worded"""
_DOWNLOADS = f"""
asked AS (SELECT seq AS pos, CASE WHEN seq % 11 = 0 THEN reverse(id) ELSE id END AS id FROM directives),
known AS (SELECT id, source_link, local_path, {_safe('filename')} AS filename FROM directives QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
planned AS (
  SELECT a.pos, a.id, CASE WHEN k.id IS NULL THEN 'unknown' WHEN k.filename IN (SELECT filename FROM directives WHERE downloaded) THEN 'cached'
      WHEN k.local_path IN (SELECT local_path FROM directives WHERE local_path IS NOT NULL AND NOT downloaded) THEN 'copy' ELSE 'download' END AS action,
    k.filename, k.local_path, k.source_link
  FROM asked a LEFT JOIN known k USING (id))
"""


def _counts(source: str, column: str, name: str) -> str:
    return f"SELECT {column} AS {name}, count(*) AS count FROM {source} GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_PARSED} SELECT raw_id FROM reasoned WHERE why IS NOT NULL",
        "p1_reasons": f"WITH {_PARSED} SELECT {_REASON} AS reason, count(*) AS records FROM reasoned GROUP BY 1",
        "p1_rows": f"WITH {_PARSED} SELECT raw_id, "
        + ", ".join(
            f"CASE WHEN {v} IN ({_NA}) THEN '' ELSE {v} END AS {c}"
            for v, c in (
                ("v_section", "section"), ("v_language", "language_from_directive"), ("v_obligation", "obligation"), ("v_category", "obligation_category"),
                ("v_department", "primary_responsible_department"), ("v_support", "support_function"),
            )
        )
        + " FROM reasoned WHERE why IS NULL",
        "page_render": rf"""WITH p AS (SELECT *, row_number() OVER w - 1 AS "at", count(*) OVER (PARTITION BY doc) AS n, page IS NOT NULL OR {_strip('text')} <> '' AS filled FROM {_PAGES} WINDOW w AS (PARTITION BY doc ORDER BY page NULLS FIRST, s, c)),
            e AS (SELECT *, min(CASE WHEN filled THEN "at" END) OVER (PARTITION BY doc) AS lo, max(CASE WHEN filled THEN "at" END) OVER (PARTITION BY doc) AS hi,
              CASE WHEN page IS NULL THEN '' ELSE '--- Page ' || page || ' ---' || chr(10) END || text AS body FROM p)
            SELECT doc, "at", CASE WHEN lo IS NULL OR "at" < lo OR "at" > hi THEN '' WHEN "at" = lo AND "at" = hi THEN {_strip('body')} WHEN "at" = lo THEN regexp_replace(body, '^{_W}+', '')
              WHEN "at" = hi THEN regexp_replace(chr(10) || chr(10) || body, '{_W}+$', '') ELSE chr(10) || chr(10) || body END AS text FROM e""",
        "clause_breakdown": _BREAKDOWN,
        "obligation_register": f"SELECT clause_id, section, obligation, obligation_category, primary_responsible_department, support_function, priority, actionable FROM {_REGISTER}",
        "category_counts": _counts(_REGISTER, "obligation_category", "category"),
        "department_counts": _counts(_REGISTER, "primary_responsible_department", "department"),
        "priority_counts": _counts(_REGISTER, "priority", "priority"),
        "actionable_counts": _counts(_REGISTER, "actionable", "actionable"),
        "register_kpis": f"""WITH x AS (SELECT count(*) AS a, count(*) FILTER (actionable = 'Yes') AS b, count(DISTINCT obligation_category) AS c, count(DISTINCT primary_responsible_department) AS d FROM {_REGISTER})
            SELECT 1 AS ord, 'Total Sections' AS label, a AS value FROM x UNION ALL SELECT 2, 'Actionable Obligations', b FROM x UNION ALL SELECT 3, 'Categories', c FROM x UNION ALL SELECT 4, 'Departments', d FROM x""",
        "register_filter": f"SELECT clause_id, priority, actionable FROM {_REGISTER} WHERE obligation_category = 'Governance' AND primary_responsible_department = 'Board / Senior Management'",
        "register_options": "SELECT 'All' AS value, CAST(-1 AS BIGINT) AS ord UNION ALL SELECT obligation_category, min(gap_id) FROM gap_assessment WHERE obligation_category <> '' GROUP BY 1",
        "ocr_candidates": f"SELECT doc, sum(length({_strip(_text('language_from_directive'))}) + 1) - 1 < 80 AS needs_ocr FROM directive_clauses GROUP BY 1",
        "page_lookups": rf"""WITH q AS (SELECT gap_id, doc, [lower(w) FOR w IN [w FOR w IN string_split({_one_line(_text('obligation'))}, ' ') IF length(w) > 4][1:12]] AS terms FROM gap_assessment),
            s AS (SELECT q.gap_id, p.doc AS held, p.page, len([t FOR t IN q.terms IF contains(lower(p.text), t)]) AS score FROM q LEFT JOIN {_PAGES} p USING (doc))
            SELECT gap_id AS query_id, CASE WHEN max(score) > 0 THEN min_by(coalesce(CAST(page AS VARCHAR), 'Unknown'), (-score, page IS NULL, page)) ELSE 'Not located' END AS page FROM s GROUP BY gap_id""",
        "policy_chunks": f"WITH {_CHUNKS} SELECT policy, chunk_seq, page, text FROM chunks",
        "keyword_terms": f"SELECT clause_id, array_to_string({_TERMS.format('w', _STOP)}, ' ') AS terms FROM {_WORDING}",
        "keyword_best_match": f"WITH {_CHUNKS}, {_MATCHED} SELECT gap_id, round(keyword_score, 9) AS keyword_score, match_page, match_text FROM matched",
        "gap_assessment_keyword": f"WITH {_CHUNKS}, {_MATCHED} {_ASSESSED}",
        "gap_status_counts": _counts("gap_assessment", "coverage_status", "coverage_status"),
        "gap_priority_counts": _counts("gap_assessment", "priority", "priority"),
        "gap_category_status": "SELECT obligation_category, coverage_status, count(*) AS count FROM gap_assessment GROUP BY 1, 2",
        "gap_department_status": "SELECT primary_responsible_department, coverage_status, count(*) AS count FROM gap_assessment GROUP BY 1, 2",
        "gap_kpis": "SELECT 1 AS ord, 'Total Obligations' AS label, count(*) AS value FROM gap_assessment "
        + " ".join(f"UNION ALL SELECT {i}, {_quoted(s)}, count(*) FROM gap_assessment WHERE coverage_status = {_quoted(s)}" for i, s in ((2, COVERED), (3, PARTIAL), (4, MISSING))),
        "catalogue_normalise": _REST,
        "anchor_extract": _ANCHORS,
        "category_scrape": "SELECT trim(category) AS category, CAST(max_by(seq % 1000, seq) AS INT) AS n FROM directives GROUP BY 1",
        "reference_files": _FILES,
        "catalogue_dedupe": """SELECT min(seq) OVER (PARTITION BY source_link) AS seq, id, title, section, category, year, source_link, filename, cached, downloaded, description, local_path, source_type
            FROM directives QUALIFY row_number() OVER (PARTITION BY source_link ORDER BY seq DESC) = 1""",
        "layered_catalogue": "SELECT seq, id, source_type FROM directives WHERE source_type = 'Public HTML'",
        "catalogue_filter": "SELECT seq, id, section, category, year FROM directives WHERE (section = 'Retirement Fund' OR category = 'Retirement Fund') AND year = 'Unknown'",
        "catalogue_metadata": """SELECT 'section' AS kind, 0 AS ord, 'All' AS value UNION ALL SELECT 'year', 0, 'All'
            UNION ALL SELECT 'section', CAST(row_number() OVER (ORDER BY section) AS INT), section FROM (SELECT DISTINCT section FROM directives WHERE section <> '')
            UNION ALL SELECT 'year', CAST(row_number() OVER (ORDER BY year DESC) AS INT), year FROM (SELECT DISTINCT year FROM directives WHERE year <> '')""",
        "catalogue_kpis": "SELECT count(*) AS total, count(DISTINCT section) AS sections, count(*) FILTER (downloaded) AS downloaded, count(*) FILTER (cached) AS cached FROM directives",
        "catalogue_table": """SELECT CAST(row_number() OVER (ORDER BY seq) AS INT) AS doc_no, title, section, year, CASE WHEN downloaded AND filename <> '' THEN filename ELSE 'Not downloaded' END AS file,
            coalesce(nullif(source_type, ''), 'FSCA') AS source FROM directives ORDER BY seq LIMIT 25""",
        "download_plan": f"""WITH {_DOWNLOADS} SELECT pos, id, action, filename, CASE action WHEN 'copy' THEN local_path WHEN 'download' THEN source_link END AS source FROM planned""",
        "download_messages": f"""WITH {_DOWNLOADS} SELECT CAST(pos AS INT) AS seq, 'Download' AS stage,
            CASE action WHEN 'unknown' THEN 'Failed' WHEN 'cached' THEN 'Cached' WHEN 'copy' THEN 'Completed' ELSE 'Pending' END AS status,
            CASE action WHEN 'unknown' THEN 'Unknown directive id: ' || id WHEN 'cached' THEN 'Already available: ' || filename
              WHEN 'copy' THEN 'Copied reference directive into crawler library: ' || filename ELSE 'To be downloaded: ' || filename END AS message,
            CAST(action IN ('cached', 'copy') AS BIGINT) AS row_count FROM planned""",
        "download_accept": """SELECT seq, length(source_link) + seq % 60 >= 100 AND (seq % 2 = 0 OR (seq % 3 <> 0 AND lower(filename) LIKE '%.pdf')) AS accepted FROM directives""",
        "mark_downloaded": """WITH done AS (SELECT DISTINCT id FROM directives WHERE source_type = 'Public HTML')
            SELECT seq, id, cached OR id IN (SELECT id FROM done) AS cached, downloaded OR id IN (SELECT id FROM done) AS downloaded FROM directives""",
        "process_log_union": """SELECT 1 AS seq, 'Results' AS stage, 'Completed' AS status, 'Catalogue rows' AS message, count(*) AS row_count FROM directives
            UNION ALL SELECT 2, 'Filter', 'Completed', 'Applied filters: section=Retirement Fund, year=All', count(*) FROM directives WHERE section = 'Retirement Fund' OR category = 'Retirement Fund'""",
        "unique_names": f"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY seq) AS k, seq, {_safe("section || CASE WHEN seq % 7 = 0 THEN '_2' WHEN seq % 11 = 0 THEN '_3' ELSE '' END || CASE WHEN year = 'Unknown' THEN '' ELSE '.pdf' END")} AS filename FROM directives),
            split AS (SELECT *, CASE WHEN filename LIKE '%.pdf' THEN '.pdf' ELSE '' END AS suffix, regexp_replace(filename, '\\.pdf$', '') AS stem FROM n),
            steps AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT coalesce(list(DISTINCT {_safe("category || '_4.pdf'")}), []) FROM directives WHERE downloaded AND seq % 2 = 0) AS taken, CAST(NULL AS VARCHAR) AS pick
              UNION ALL SELECT k, list_append(taken, pick), pick FROM (SELECT s.k, t.taken,
                CASE WHEN NOT list_contains(t.taken, s.filename) THEN s.filename ELSE [x FOR x IN [s.stem || '_' || i || s.suffix FOR i IN range(2, len(t.taken) + 3)] IF NOT list_contains(t.taken, x)][1] END AS pick
              FROM steps t JOIN split s ON s.k = t.k + 1))
            SELECT CAST(seq AS BIGINT) AS seq, filename, pick AS unique_name FROM steps JOIN split USING (k)""",
        "title_match_score": f"WITH {_TITLES} SELECT seq, round(similarity, 9) AS similarity, round(share, 9) AS keyword_score, round(share * 0.68 + similarity * 0.32, 9) AS score FROM scores",
        "category_total": "SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT max_by(seq % 1000, seq) AS n FROM directives GROUP BY trim(category))",
        "library_flags": f"""WITH held AS (SELECT DISTINCT filename FROM directives WHERE downloaded)
            SELECT seq, {_safe('filename')} AS filename, {_safe('filename')} IN (SELECT filename FROM held) AS cached, {_safe('filename')} IN (SELECT filename FROM held) AS downloaded FROM directives WHERE local_path IS NOT NULL""",
        "relative_links": """SELECT seq, CASE seq % 3 WHEN 0 THEN 'https://notices.regulator.example/files/' WHEN 1 THEN 'https://notices.regulator.example/lists/' ELSE 'https://other.example/' END || id || '_' || seq || '.pdf' AS source_link,
            id || '_' || seq || '.pdf' AS filename FROM directives""",
        "export_names": "SELECT seq, replace(regexp_replace(filename, '(.)\\.[^.]*$', '\\1'), ' ', '_') || '_obligation_extraction.csv' AS name FROM directives",
        "gap_status_filter": "SELECT gap_id, coverage_status, priority FROM gap_assessment WHERE coverage_status = 'Partially Covered'",
        "gap_display": " UNION ALL ".join(f"SELECT gap_id, '{n.replace('_', ' ')}' AS label, coalesce({n}, '') AS value FROM gap_assessment" for n in ("support_function", "policy_page", "corresponding_policy_text", "priority")),
        "safe_names": f"SELECT seq, {_safe(_text('title'))} AS name, {_year(_text('title'))} AS year, {_number(_text('title'))} AS number FROM directives",
        "document_numbers": "SELECT seq, section, CAST(row_number() OVER (PARTITION BY section ORDER BY seq) AS INT) AS doc_no, CASE WHEN downloaded AND filename <> '' THEN filename ELSE 'Not downloaded' END AS file FROM directives",
    }
