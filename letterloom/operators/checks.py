"""Invariants of catalogs and of nested documents as rows of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.functions.text import once


def catalog_facts(catalog: DataFrame) -> DataFrame:
    """id, well_named, n_parameters, increasing scores, top_is_max of each indicator."""
    scores = F.transform("parameters", lambda p: p["score"])
    steps = F.zip_with(F.slice(scores, 1, F.size(scores) - 1), F.slice(scores, F.lit(2), F.size(scores)), lambda a, b: a < b)
    named = F.col("id").rlike(r"^IND-\d{2}$") & F.forall("parameters", lambda p: p["id"].rlike(r"^IND-\d{2}-P[1-3]$"))
    return catalog.select("id", named.alias("well_named"), F.size("parameters").alias("n_parameters"), F.forall(steps, lambda x: x).alias("increasing"), (F.array_max(scores) == F.col("max_score")).alias("top_is_max"))


def null_paths(schema: T.StructType) -> Column:
    """Paths of all nulls in a row of ``schema``, such as ``a.b[3].c`` or ``reasons.agency`` (a map's key), as an array of strings.

    The schema is walked once, when the expression is built: a struct adds its fields, an array its indices, a map
    its keys. A null container is one path; what it would hold is not looked for.
    """
    return F.concat(*(_nulls(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in schema.fields), _no_paths())


def _no_paths() -> Column:
    return F.array().cast("array<string>")


def _nulls(value: Column, kind: T.DataType, path: Column) -> Column:
    own = F.when(value.isNull(), F.array(path))
    if isinstance(kind, T.StructType) and kind.fields:
        leaves = [f for f in kind.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        below = [_nulls(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if f not in leaves]
        missing = F.array_compact(F.array(*(F.when(value[f.name].isNull(), F.concat(path, F.lit(f".{f.name}"))) for f in leaves))) if leaves else _no_paths()
        return own.otherwise(F.concat(missing, *below))
    if isinstance(kind, T.ArrayType):
        place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return own.otherwise(F.flatten(F.transform(value, lambda x, i: _nulls(x, kind.elementType, place(i)))))
    if isinstance(kind, T.MapType):
        key = lambda e: F.concat(path, F.lit("."), e["key"].cast("string"))
        return own.otherwise(F.flatten(F.transform(F.map_entries(value), lambda e: _nulls(e["value"], kind.valueType, key(e)))))
    return own.otherwise(_no_paths())


def unexplained_blanks(schema: T.StructType, values: str = "metadata", reasons: str = "missing_reasons") -> Column:
    """Names of the text fields of struct ``values`` that are blank without a reason in map ``reasons``."""
    names = [f.name for f in schema[values].dataType.fields if isinstance(f.dataType, T.StringType)]
    why = F.coalesce(F.col(reasons), F.create_map().cast("map<string,string>"))
    bad = [F.when((F.col(values)[n] == "") & ~F.map_contains_key(why, F.lit(n)), n) for n in names]
    return F.array_compact(F.array(*bad)) if bad else _no_paths()


def nulls_and_blanks(records: DataFrame, key: str = "filename") -> DataFrame:
    """key, nulls, unexplained (arrays) of the nested records that have any null, anywhere, or a blank field without a reason."""
    both = F.struct(null_paths(records.schema).alias("nulls"), unexplained_blanks(records.schema).alias("unexplained"))
    found = records.select(key, once(both, lambda b: b).alias("_f")).select(key, "_f.*")
    return found.where((F.size("nulls") > 0) | (F.size("unexplained") > 0))
