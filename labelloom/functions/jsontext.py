"""Strict checks of JSON text held in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
_OBJECT_START = r"^[ \t\n\r]*\{"


def ends_after_value(text: Column) -> Column:
    """True when nothing follows the first JSON value of the text.

    Spark's JSON functions stop after one value. Text that is both the only element
    of an array and the only field of an object has nothing left over. The two
    functions walk the tokens without copying; they are lenient about quotes.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    keys = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(alone & keys.isNotNull(), F.lit(False))


def _strict_value(text: Column) -> Column:
    """True when the text starts with one strict JSON value of any kind."""
    parsed = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, _bad string", _STRICT)
    return parsed["_bad"].isNull()


def parse_objects(df: DataFrame, text: Column, fields: list[str], prefix: str) -> DataFrame:
    """Parse JSON objects once and say whether the whole text is strict JSON.

    Adds <prefix>_json, <prefix>_object and <prefix>_fields: a struct with a variant
    per field, null unless the text is an object.
    """
    p = prefix
    schema = ", ".join(f"`{n}` variant" for n in fields) + ", _bad string"
    staged = df.withColumn(f"{p}_open", F.coalesce(text.rlike(_OBJECT_START), F.lit(False)))
    staged = staged.withColumn(
        f"{p}_fields", F.when(F.col(f"{p}_open"), F.from_json(text, schema, _STRICT))
    )
    strict = F.when(F.col(f"{p}_open"), F.col(f"{p}_fields._bad").isNull()).otherwise(_strict_value(text))
    staged = staged.withColumn(f"{p}_json", F.coalesce(strict & ends_after_value(text), F.lit(False)))
    return staged.withColumn(f"{p}_object", F.col(f"{p}_json") & F.col(f"{p}_open")).drop(f"{p}_open")


def text_field(fields: str, name: str) -> Column:
    """Value of a parsed field, only when it is a JSON string."""
    field = F.col(f"{fields}.{name}")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))
