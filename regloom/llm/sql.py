"""DuckDB statements for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

# Literals of its own, so that a slip in the code under test shows.
_CYRILLIC, _CYRILLIC_LATIN = "АВЕКМНОРСТУХаеорсухѕіјһԁԛԝЅІЈԌԚԜӏ", "ABEKMHOPCTYXaeopcyxsijhdqwSIJGQWl"
_GREEK, _GREEK_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν", "ABEZHIKMNOPTYXocjv"
_OTHERS, _OTHERS_LATIN = "օⅰⅴⅹⅼⅽⅾⅿ", "oivxlcdm"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_SPACES = "\u00a0\u2007\u202f\u3000"
_FROM = _CYRILLIC + _GREEK + _OTHERS + _WIDE + _SPACES + "‐‑"
_TO = _CYRILLIC_LATIN + _GREEK_LATIN + _OTHERS_LATIN + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "    --"


def _looks(c: str) -> str:
    """Canonical look of a text by plain replacement."""
    bare = rf"regexp_replace({c}, '[\x{{ad}}\x{{34f}}\x{{180e}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{2069}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}]', '', 'g')"
    to = _TO.replace("'", "''")
    single = f"translate(nfc_normalize({bare}), '{_FROM}', '{to}')"
    for lig, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        single = f"replace({single}, '{lig}', '{plain}')"
    return f"nfc_normalize({single})"


_ITEMS = """(SELECT 'directive_clauses' AS item_table, clause_id AS item_id, language_from_directive AS text FROM directive_clauses
  UNION ALL SELECT 'gap_assessment', gap_id, corresponding_policy_text FROM gap_assessment)"""


# All pairs by the words they share; the window of sizes leaves out only what cannot be similar.
_SIMILAR = rf"""items AS (SELECT 'directives' AS item_table, seq AS id, title AS x FROM directives
    UNION ALL SELECT 'directive_clauses', clause_id, language_from_directive FROM directive_clauses WHERE lang = 'en'),
  words AS (SELECT item_table, id, unnest(regexp_extract_all(lower({_looks('x')}), '[\pL\pN]+')) AS w FROM items WHERE x IS NOT NULL),
  counts AS (SELECT *, sum(n) OVER (PARTITION BY item_table, id) AS total FROM (SELECT item_table, id, w, count(*) AS n FROM words GROUP BY ALL)),
  pairs AS (SELECT a.item_table, a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) = a.total AND a.total = b.total AS equal
    FROM counts a JOIN counts b ON a.item_table = b.item_table AND a.w = b.w AND a.id < b.id AND 2 * least(a.total, b.total) >= 0.8 * (a.total + b.total)
    GROUP BY a.item_table, a.id, b.id, a.total, b.total HAVING 2 * sum(least(a.n, b.n)) >= 0.8 * (a.total + b.total) - 1e-9),
  edges AS (SELECT item_table, id_a AS u, id_b AS v, equal FROM pairs UNION ALL SELECT item_table, id_b, id_a, equal FROM pairs)"""


def oracle_sql() -> dict[str, str]:
    words = rf"regexp_extract_all(lower({_looks('text')}), '[\pL\pN]+')"
    return {
        "p2_found": f"SELECT item_table, item_id FROM {_ITEMS} WHERE length(text) > 1800",
        "p3_found": f"""WITH looks AS (SELECT item_table, item_id, text, {_looks('text')} AS look FROM {_ITEMS} WHERE text IS NOT NULL)
            SELECT a.item_table, a.item_id AS id_a, b.item_id AS id_b FROM looks a JOIN looks b
            ON a.item_table = b.item_table AND a.look = b.look AND a.item_id < b.item_id AND a.text <> b.text""",
        "p3_groups": f"""SELECT item_table, min(item_id) AS group_id, count(DISTINCT text) AS forms, count(*) AS items FROM (SELECT item_table, item_id, text, {_looks('text')} AS look FROM {_ITEMS} WHERE text IS NOT NULL)
            GROUP BY item_table, look HAVING count(DISTINCT text) > 1""",
        # in these tables the Latin, plain and composed members of a class are its most frequent ones
        "p3_canonical": f"SELECT item_table, item_id, {_looks('text')} AS canonical FROM {_ITEMS}",
        "p4_found": f"WITH {_SIMILAR} SELECT item_table, id_a, id_b FROM pairs",
        "p4_groups": f"""WITH RECURSIVE {_SIMILAR}, nodes AS (SELECT DISTINCT item_table, id FROM counts),
            reach AS (SELECT item_table, id, id AS low FROM nodes UNION SELECT r.item_table, e.v, r.low FROM reach r JOIN edges e ON e.item_table = r.item_table AND e.u = r.id),
            groups AS (SELECT item_table, id, min(low) AS group_id FROM reach GROUP BY ALL),
            same AS (SELECT item_table, u AS id, min(v) AS low FROM edges WHERE equal GROUP BY ALL)
            SELECT g.item_table, g.id AS item_id, least(g.id, coalesce(s.low, g.id)) AS class_id, g.group_id FROM groups g LEFT JOIN same s USING (item_table, id)""",
        "p7_found": f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_no, {words} AS w FROM eval_items WHERE text IS NOT NULL),
            dg AS (SELECT doc_id, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM d),
            eg AS (SELECT item_no, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM e)
            SELECT DISTINCT doc_id, item_no FROM dg JOIN eg USING (g)""",
        "p7_leaks": f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_no, {words} AS w FROM eval_items WHERE text IS NOT NULL),
            dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM d)),
            eg AS (SELECT item_no, unnest(range(1, len(w) - 10)) AS pos, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM e),
            hits AS (SELECT doc_id, item_no, pos - row_number() OVER (PARTITION BY doc_id, item_no ORDER BY pos) AS island FROM dg JOIN eg USING (g)),
            runs AS (SELECT doc_id, item_no, count(*) AS n FROM hits GROUP BY doc_id, item_no, island),
            sizes AS (SELECT item_no, count(*) AS passages FROM eg GROUP BY item_no)
            SELECT doc_id, item_no, CAST(sum(n) AS BIGINT) AS shared, sum(n) / any_value(passages) AS containment, max(n) + 11 AS longest_run FROM runs JOIN sizes USING (item_no) GROUP BY doc_id, item_no""",
    }
