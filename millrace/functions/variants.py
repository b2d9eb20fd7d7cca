"""JSON documents of no fixed schema, as VARIANT: values by path and kind, and what kinds stand at which paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

#: The kinds of values, by how the names of their types begin.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number"}


def parsed(text: Column) -> Column:
    """A JSON text as VARIANT; null where it is null or malformed."""
    return F.try_parse_json(text)


def at(value: Column, path: str) -> Column:
    """What stands at a path such as `$.a.b[0]`, as VARIANT; null where nothing does."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """One of the KINDS; null for no value, `null` for JSON's null, `other` for types that JSON has not."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(known, name), F.lit("other")))


def of_kind(value: Column, path: str, kinds: tuple[str, ...], type_name: str) -> Column:
    """The value at a path as an SQL type if it is of one of the kinds, else null: a text of digits is no integer."""
    return F.when(kind(at(value, path)).isin(*kinds), F.try_variant_get(value, path, type_name))


def merged_schema(value: Column) -> Column:
    """An aggregate: the least schema that all values of a group have; VARIANT stands where their types differ."""
    return F.schema_of_variant_agg(value)


def nodes(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Every value in the VARIANT column of df, containers too: the columns `by`, its path, kind and value.

    A path begins with `$`; `.name` leads into an object and `[*]` into an array. Null variants have no rows, and empty
    containers but their own. One level of nesting is unfolded at a time, where the rows are; only containers are
    looked into again, and each level is written once. `by` may hold any columns but path, kind and value.
    """
    names = [f"`{c}`" for c in by]
    level = df.select(*names, F.lit("$").alias("path"), kind(F.col(value)).alias("kind"), F.col(value).alias("value")).where("kind is not null")
    levels = []
    while True:
        level = materialize(level, "level")
        levels.append(level)
        if level.where("kind in ('object', 'array')").isEmpty():
            return reduce(DataFrame.unionByName, levels)
        outer = [f"c.{n}" for n in names]
        step = "case when c.kind = 'array' then '[*]' else '.' || e.key end"
        inner = df.sparkSession.sql(
            f"select {', '.join([*outer, f'c.path || {step} as path', 'e.value as value'])} from {{level}} as c, lateral variant_explode(c.value) as e where c.kind in ('object', 'array')",
            level=level,
        )
        level = inner.select(*names, "path", kind(F.col("value")).alias("kind"), "value")


def path_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """How many values of each kind (n) stand at each path, by the columns `by`."""
    return nodes(df, value, by).groupBy(*[f"`{c}`" for c in by], "path", "kind").agg(F.count("*").alias("n"))
