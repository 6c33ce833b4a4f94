"""Rows that fail to parse: one anchored pattern per schema, and prefix patterns that name the first broken field.

A schema is a (delimiter, header) pair. From it one anchored regular expression is generated for a whole
row: every field is either quoted (doubled quotes inside, line breaks allowed) or bare (no quote, no line
break, no delimiter), and constrained fields carry their own sub-pattern. A record that matches is valid and its
fields are read off. Only a record that fails goes through the prefix patterns ``^f1``, ``^f1,f2`` ... (each
ending at a delimiter or the end of the record); the first that does not match names the broken field. All
quantifiers over quoted text are possessive, so matching is linear and needs no stack, however long the field.

Defined results:

* a null record, or one whose upload is unknown, is set aside as ``no record`` / ``no header``;
* an empty record has one empty field, so its column count is wrong unless the schema has one column;
* repeated records are judged one by one and all come out;
* an empty table gives empty results; extra input columns are passed through, and header names never become
  columns of the result (fields come as a map), so they cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regloom.joins import lookup_join

SECTION = "Section"
TEXT_FIELDS = ("Language from Directive", "Obligation")

# Tokens that stand for a missing value (any case), and white space that trimming removes.
NA_TOKENS = ("NA", "N/A", "None", "null", "nan")
TRIMMED = r"[\s\x1c-\x1f\x85\p{Z}]"

_REASONS = {"section": "invalid Section", "language": "invalid Language from Directive", "obligation": "invalid Obligation"}


def trimmed(c: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(c, rf"^{TRIMMED}++|{TRIMMED}++\z", "")


def _escaped(delimiter: Column) -> Column:
    return F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E"))


def header_fields(header_line: Column, delimiter: Column) -> Column:
    """Trimmed header names, read by the rules of a record."""
    return F.transform(_tokens(header_line, delimiter), lambda t: trimmed(_unquoted(t)))


def _tokens(record: Column, delimiter: Column) -> Column:
    """Raw fields of a well-formed record, quotes included. A delimiter is put in front so that no match is empty."""
    d = _escaped(delimiter)
    pattern = F.concat(d, F.lit('("(?:[^"]++|"")*+"(?='), d, F.lit("|\\z)|(?:(?!"), d, F.lit(')[^"\\r\\n])*+)'))
    return F.regexp_extract_all(F.concat(delimiter, record), pattern, F.lit(1))


def _unquoted(token: Column) -> Column:
    inner = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(token, F.lit('"')), inner).otherwise(token)


# Sub-patterns of constrained values. The look-aheads stand before a bare or a quoted field and see its value
# with the white space around it; a doubled quote inside counts as content.
_BAD_CHAR = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{FFFD}"
_NA = "|".join(NA_TOKENS)


def _field_pattern(name: Column, d: Column, typed: bool) -> Column:
    """Pattern of one field; ``d`` is the escaped delimiter."""
    bare = F.concat(F.lit("(?:(?!"), d, F.lit(')[^"\\r\\n])*+'))
    quoted = '"(?:[^"]++|"")*+"'
    any_field = F.concat(F.lit(f"(?:{quoted}|"), bare, F.lit(")"))
    if not typed:
        return any_field
    ws = f"{TRIMMED}*+"
    section_value = r"(?:[0-9]++(?:\.[0-9]++)*+|Introduction)"
    end = F.concat(F.lit("(?="), d, F.lit("|\\z)"))
    section = F.concat(F.lit(f'(?:"{ws}{section_value}{ws}"|{ws}{section_value}'), F.lit("(?:(?!"), d, F.lit(f"){TRIMMED})*+)"))
    # not blank, not an NA token, no forbidden character
    bare_text = F.concat(
        F.lit("(?!(?:(?!"), d, F.lit(f"){TRIMMED})*+(?i:{_NA})?(?:(?!"), d, F.lit(f"){TRIMMED})*+"), end, F.lit(")(?:(?!"), d, F.lit(f')[^"\\r\\n{_BAD_CHAR}])*+')
    )
    quoted_text = f'(?!"{ws}(?i:{_NA})?{ws}"(?!"))"(?:[^"{_BAD_CHAR}]++|"")*+"'
    text = F.concat(F.lit(f"(?:{quoted_text}|"), bare_text, F.lit(")"))
    return F.when(name == SECTION, section).when(name.isin(*TEXT_FIELDS), text).otherwise(any_field)


def with_schema(rows: DataFrame) -> DataFrame:
    """Replaces the column ``__upload`` (delimiter, header_line) by ``__schema``: delimiter, header names and patterns; null without an upload.

    ``row_pattern``: the anchored pattern of a valid row; ``shape_pattern``: the same without value
    constraints for any number of fields; ``field_patterns``: the patterns of the fields, from which ``prefix_patterns`` are made.
    """
    delimiter = F.col("__upload.delimiter")
    d = _escaped(delimiter)
    loose = _field_pattern(F.lit(""), d, False)
    named = rows.withColumn("__names", header_fields(F.col("__upload.header_line"), delimiter))
    patterned = named.withColumn("__fields", F.transform("__names", lambda n: _field_pattern(n, d, True)))
    schema = F.struct(
        delimiter.alias("delimiter"),
        F.col("__names").alias("header_names"),
        F.concat(F.lit(r"\A"), F.call_function("array_join", F.col("__fields"), d), F.lit(r"\z")).alias("row_pattern"),
        F.concat(F.lit(r"\A"), loose, F.lit("(?:"), d, loose, F.lit(r")*+\z")).alias("shape_pattern"),
        F.col("__fields").alias("field_patterns"),
    )
    return patterned.withColumn("__schema", F.when(F.col("__upload").isNotNull(), schema)).drop("__upload", "__names", "__fields")


def prefix_patterns(field_patterns: Column, delimiter: Column) -> Column:
    """Entry k matches a row whose first k fields are sound."""
    d = _escaped(delimiter)
    end = F.concat(F.lit("(?:"), d, F.lit("|\\z)"))
    prefix = lambda k: F.concat(F.lit(r"\A"), F.call_function("array_join", F.slice(field_patterns, F.lit(1), k), d), end)
    return F.transform(F.sequence(F.lit(1), F.size(field_patterns)), prefix)


_MARK = "\u0001"


def _matches(text: Column, pattern: Column) -> Column:
    """Whether an anchored pattern matches.

    Unlike ``rlike``, ``regexp_extract`` keeps the compiled pattern from one row to the next. A mark before text and pattern keeps the match
    of an empty record from being empty itself.
    """
    marked = F.concat(F.lit(rf"\A{_MARK}"), F.substring(pattern, F.lit(3), F.length(pattern)))
    return F.call_function("regexp_extract", F.concat(F.lit(_MARK), text), marked, F.lit(0)) != ""


def parse_rows(raw: DataFrame, uploads: DataFrame) -> DataFrame:
    """Judge every record.

    Adds ``reason`` (null: valid), ``broken_field`` (1-based position and name as ``k:name``) and ``fields``
    (map of header name to trimmed value, null for failures) to the columns of ``raw``.
    """
    text = F.col("raw_text")
    keys = ["upload_id"]
    meta = uploads.select("upload_id", F.struct("delimiter", "header_line").alias("__upload")).dropDuplicates(keys)
    # rows of one schema together, so that its patterns are compiled once; patterns are many times as long as the header
    # they come from, so they are made beside the rows and never shipped
    joined = with_schema(lookup_join(raw.drop("reason", "broken_field", "fields").sortWithinPartitions(*keys), meta, keys))
    s = F.col("__schema")
    n = F.size(s["header_names"])
    valid = _matches(text, s["row_pattern"])
    # the row number keeps a filter over the reasons from being pushed below this step, which would match every row once for each reason
    judged = joined.select("*", F.when(s.isNull() | text.isNull(), F.lit(None).cast("boolean")).otherwise(valid).alias("__valid"), F.monotonically_increasing_id().alias("__row"))
    # everything below is evaluated for failures only
    shaped = _matches(text, s["shape_pattern"])
    width = F.size(_tokens(text, s["delimiter"]))
    first_broken = F.array_position(F.transform(prefix_patterns(s["field_patterns"], s["delimiter"]), lambda p: F.rlike(text, p)), F.lit(False)).cast("int")
    bad_name = F.element_at(s["header_names"], first_broken)
    value_reason = F.concat(F.lit("invalid "), bad_name)
    failed = (F.col("__valid") == F.lit(False)) & (F.col("__row") >= 0)
    reason = (
        F.when(F.col("__schema").isNull(), "no header")
        .when(text.isNull(), "no record")
        .when(failed & ~shaped, "quoting")
        .when(failed & (width != n), "column count")
        .when(failed, value_reason)
    )
    broken = F.when(
        failed,
        F.when(first_broken > 0, F.concat_ws(":", first_broken.cast("string"), bad_name)).otherwise(F.concat((n + 1).cast("string"), F.lit(":"))),
    )
    values = F.transform(_tokens(text, s["delimiter"]), lambda t: trimmed(_unquoted(t)))
    fields = F.when(F.col("__valid"), F.map_from_entries(F.arrays_zip(s["header_names"], values)))
    return judged.select(*[c for c in raw.columns if c not in ("reason", "broken_field", "fields")], reason.alias("reason"), broken.alias("broken_field"), fields.alias("fields"))


def split_rows(raw: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with ``fields``, failed rows with ``reason`` and ``broken_field``)."""
    judged = parse_rows(raw, uploads)
    return judged.filter(F.col("reason").isNull()).drop("reason", "broken_field"), judged.filter(F.col("reason").isNotNull()).drop("fields")
