"""Stored records: which checkpoints can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 2


def _kind(record: Column, path: str, kind: str) -> Column:
    """Whether the value at a path of a variant has the given type."""
    found = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    good = found.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)") if kind == "NUMBER" else found.startswith(kind)
    return F.coalesce(good, F.lit(False))


def _each(record: Column, path: str, test) -> Column:
    items = F.try_variant_get(record, path, "array<variant>")
    return F.coalesce(F.forall(items, test), F.lit(False))


def valid_checkpoints(records: DataFrame, raw: str = "record") -> DataFrame:
    """records with is_valid: version 2, all fields that a restore needs, of their types.

    Bytes are base64 text. Other fields may be there; what isn't JSON is invalid, not an error.
    """
    r = F.try_parse_json(raw)
    tests = [F.coalesce(F.try_variant_get(r, "$.version", "double") == VERSION, F.lit(False)) & _kind(r, "$.version", "NUMBER")]
    tests += [_kind(r, f"$.{c}", "STRING") for c in ("fileName", "fileBytes", "title", "styleGuide")]
    tests.append(F.coalesce(F.try_variant_get(r, "$.format", "string").isin("epub", "fb2"), F.lit(False)) & _kind(r, "$.format", "STRING"))
    tests.append(_kind(r, "$.index", "NUMBER"))
    seam = lambda x: F.schema_of_variant(F.try_variant_get(x, "$.joinWith", "variant"))
    join_ok = lambda x: seam(x).isNull() | F.coalesce(F.try_variant_get(x, "$.joinWith", "string").isin("space", "line"), F.lit(False))
    fields = lambda x, names: [_kind(x, f"$.{c}", "STRING") for c in names]
    all_of = lambda parts: F.expr("true") if not parts else parts[0] if len(parts) == 1 else parts[0] & all_of(parts[1:])
    tests.append(_kind(r, "$.chunks", "ARRAY") & _each(r, "$.chunks", lambda x: all_of([_kind(x, "$.index", "NUMBER"), *fields(x, ("documentPath", "chapterTitle", "markdown")), join_ok(x)])))
    tests.append(_kind(r, "$.translated", "ARRAY") & _each(r, "$.translated", lambda x: all_of([_kind(x, "$.index", "NUMBER"), *fields(x, ("original", "translation"))])))
    return records.withColumn("is_valid", F.coalesce(all_of(tests), F.lit(False)))
