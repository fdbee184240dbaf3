"""Formula text: delimiter counts, audits and repairs as built-in string functions; one helper where Spark has none."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from topicloom.functions.repair import repair
from topicloom.functions.text import first_non_empty
from topicloom.session import cut

# The fields that hold formulas, marks of generated text, what makes a text a formula or shows that it is delimited, and one macro with its replacement.
FORMULA_FIELDS = ("statement_latex", "assumptions_latex", "conclusion_latex", "equivalent_formulations_latex", "nonasymptotic_bound_latex", "epsilon_complexity_latex", "symbol_latex")
ARTEFACT = r"(?i)Need (?:final|regenerate)|END ANALYSIS|channel (?:final|switch)"
FORMULA_SIGNS = r"\\[A-Za-z]+|[_^][{A-Za-z0-9\\]|[{}]|[=<>≤≥∈∉⊂⊆⊃⊇±∞∑∏]"
DELIMITED = r"(?<!\\)\\\(|(?<!\\)\\\[|\\begin\s*\{"
RESTRICTION = (r"\mathbin{\vrule height 1.4ex depth -0.3ex width 0.07ex\vrule height 0.07ex depth -0.02ex width 0.8ex}", r"\mathbin{\restriction}")


def _fields(value: Column, kind: DataType, name: str = "") -> list[Column]:
    """Arrays of (field, value) structs for what a value of some type holds under the formula keys, at any nesting."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _fields(value.getField(f.name), f.dataType, f.name)]
    if isinstance(kind, MapType):
        return [*_fields(F.map_values(value), ArrayType(kind.valueType), name)]
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, StringType):
        inner = lambda x: F.concat(*_fields(x, kind.elementType, name)) if _fields(x, kind.elementType, name) else F.array().cast(_PAIR)
        return [F.flatten(F.transform(F.coalesce(value, F.array()), inner))] if _holds(kind) else []
    if name not in FORMULA_FIELDS or not (isinstance(kind, StringType) or isinstance(kind, ArrayType)):
        return []
    return [F.transform(value if isinstance(kind, ArrayType) else F.array(value), lambda x: F.struct(F.lit(name).alias("field"), x.alias("value")))]


def _holds(kind: DataType, name: str = "") -> bool:
    if isinstance(kind, StructType):
        return any(_holds(f.dataType, f.name) for f in kind.fields)
    if isinstance(kind, (ArrayType, MapType)):
        return _holds(kind.elementType if isinstance(kind, ArrayType) else kind.valueType, name)
    return isinstance(kind, StringType) and name in FORMULA_FIELDS


def formula_fields(statements: DataFrame, *keys: str) -> DataFrame:
    """(keys..., field, value): every text under a formula key, in columns, structs, lists and maps at any nesting; nulls and blanks are dropped."""
    found = [x for f in statements.schema.fields if f.name not in keys for x in _fields(F.col(f.name), f.dataType, f.name)]
    parts = [F.coalesce(x.cast(_PAIR), F.array().cast(_PAIR)) for x in found] or [F.array().cast(_PAIR)]
    return statements.select(*keys, F.explode(F.concat(*parts)).alias("x")).select(*keys, "x.field", "x.value").where(F.trim("value") != "")


_PAIR = "array<struct<field:string,value:string>>"


def formula_values(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys..., statement_id, topic_id, field, value): every text under a formula key of JSON documents, in objects and lists at any depth; blanks are dropped. The ids are those of the innermost object around it that has one (`id`,
    `topic_id`); elements of a list stand under the list's key. Documents are walked as variants, a level a pass, and the loop ends at the deepest; those that can't be parsed have no rows."""
    level = documents.select(*keys, F.lit("").alias("field"), F.lit(None).cast("string").alias("statement_id"), F.lit(None).cast("string").alias("topic_id"), F.try_parse_json(column).alias("v"))
    own = lambda path, above: F.coalesce(first_non_empty(F.try_variant_get("v", path, "string")), above)
    out = []
    while not level.isEmpty():
        level = cut(level)
        kind = F.schema_of_variant("v")
        out.append(level.where(F.col("field").isin(*FORMULA_FIELDS) & (kind == "STRING")).select(*keys, "statement_id", "topic_id", "field", F.try_variant_get("v", "$", "string").alias("value")).where(F.trim("value") != ""))
        inside = level.where(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))).withColumns({"statement_id": own("$.id", F.col("statement_id")), "topic_id": own("$.topic_id", F.col("topic_id"))})
        parts = inside.sparkSession.sql(f"SELECT {''.join(f'`{k}`, ' for k in keys)}coalesce(x.key, field) AS field, statement_id, topic_id, x.value AS v FROM {{inside}}, LATERAL variant_explode(v) AS x", inside=inside)
        level = parts
    return reduce(DataFrame.union, out) if out else documents.select(*keys, *[F.lit("").alias(c) for c in ("statement_id", "topic_id", "field", "value")]).limit(0)


def _counts(text: Column, bracket: str) -> dict[str, Column]:
    named = {"open_inline": "(", "close_inline": ")", "open_display": "[", "close_display": "]"}
    out = {k: F.regexp_count(text, F.lit(bracket + re.escape(v))) for k, v in named.items()}
    out["display_dollars"] = F.regexp_count(text, F.lit(r"(?<!\\)\$\$"))
    return out


def delimiters(text: Column) -> dict[str, Column]:
    """Counts of the four bracket delimiters after odd backslash runs, of $$ pairs and of single $, both after no backslash."""
    out = _counts(text, r"(?<!\\)(?:\\\\)*\\")
    return out | {"inline_dollars": F.regexp_count(text, F.lit(r"(?<!\\)\${1,2}")) - out["display_dollars"]}


#: All delimiters in one scan: brackets after an odd run of backslashes, and dollars after none.
DELIMITERS = r"(?<!\\)(?:\\\\)*\\[()\[\]]|(?<!\\)\${1,2}"


def audit(text: Column) -> Column:
    """Reasons why a field is malformed, in a fixed order; an empty array if it isn't. A text is scanned once for its delimiters."""

    def reasons(found: Column) -> Column:
        n = lambda end: F.size(F.filter(found, lambda x: F.endswith(x, F.lit(end))))
        dollars = lambda both: F.size(F.filter(found, lambda x: x == both))
        named = {
            "unbalanced_inline_delimiters": n("(") != n(")"),
            "unbalanced_display_delimiters": n("[") != n("]"),
            "unbalanced_inline_dollars": dollars("$") % 2 != 0,
            "unbalanced_display_dollars": dollars("$$") % 2 != 0,
            "control_character_in_formula": text.rlike(r"[\t\x00]"),
            "generation_artifact_in_formula": text.rlike(ARTEFACT),
        }
        return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]), lambda x: x.isNotNull())

    scanned = F.when(F.contains(text, F.lit("\\")) | F.contains(text, F.lit("$")), F.regexp_extract_all(text, F.lit(DELIMITERS), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(scanned), reasons)[0]


def balance(text: Column) -> dict[str, Column]:
    """The display rule: a look behind of one character, so runs of three or more backslashes count otherwise than in delimiters(); single $ are counted without the $$."""
    out = _counts(text, r"(?<!\\)\\")
    out["inline_dollars"] = F.regexp_count(F.regexp_replace(text, r"(?<!\\)\$\$", ""), F.lit(r"(?<!\\)\$"))
    even = (out["display_dollars"] % 2 == 0) & (out["inline_dollars"] % 2 == 0)
    return out | {"balanced": (out["open_inline"] == out["close_inline"]) & (out["open_display"] == out["close_display"]) & even}


def dollars_to_tex(text: Column) -> Column:
    """$$...$$ and, within a line, $...$ to bracket delimiters; and the one macro."""
    text = F.replace(text, F.lit(RESTRICTION[0]), F.lit(RESTRICTION[1]))
    text = F.regexp_replace(text, r"(?s)(?<!\\)\$\$(.*?)(?<!\\)\$\$", r"\\[$1\\]")
    return F.regexp_replace(text, r"(?<!\\)\$([^$\n]+?)(?<!\\)\$", r"\\($1\\)")


def trim_orphan(text: Column) -> Column:
    """A field that closes once more than it opens loses the closing delimiter at its end: inline first, then display."""
    for kind, close in (("inline", r"\)"), ("display", r"\]")):
        counts = balance(text)
        one_more = counts[f"close_{kind}"] == counts[f"open_{kind}"] + 1
        text = F.when(one_more & text.rlike(rf"\\{close}\s*\z"), F.regexp_replace(text, rf"\s*\\{close}\s*\z", "")).otherwise(text)
    return text


@F.pandas_udf(StringType())
def formula_normalize(texts: pd.Series) -> pd.Series:
    """repair() by batches: Spark has no NFC, and the scan carries state."""
    return texts.map(repair, na_action="ignore")


def latex_class(text: Column, display: bool = False) -> Column:
    """What becomes of a normalised field: empty, source_error (unbalanced), has_delimiters, plain, or wrapped in inline or display delimiters."""
    raw = trim_orphan(text)
    tex = dollars_to_tex(raw)
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty")
        .when(~balance(raw)["balanced"], "source_error")
        .when(tex.rlike(DELIMITED), "has_delimiters")
        .when(~tex.rlike(FORMULA_SIGNS), "plain")
        .otherwise("wrapped_display" if display else "wrapped_inline")
    )
