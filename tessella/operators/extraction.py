"""Structured records from papers: triage, repair, checks, flattening, enrichment, resuming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.json_repair import try_json
from tessella.functions.shipping import ship
from tessella.functions.text import or_blank
from tessella.operators.variants import Schema, as_variant
from tessella.sources.lookups import Lookups


def triage_status(title: Column, abstract: Column) -> Column:
    return F.when((or_blank(F.trim(title)) == "") | (or_blank(F.trim(abstract)) == ""), "skipped").otherwise("pending")


def rate(part: Column, whole: Column) -> Column:
    """A percentage with one decimal; null where there is nothing to divide by."""
    return F.round(F.try_divide(part * 100, whole), 1)


def pending_rows(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no result exists for."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def relevant_rows(rows: DataFrame, triaged: DataFrame, key: str, flag: Column) -> DataFrame:
    return rows.join(triaged.where((F.col("status") == "success") & flag).select(key).distinct(), key, "left_semi")


def merged_results(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both, the new one where both have a key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def size_gate(path: Column, length: Column, limit: int = 32 << 20) -> Column:
    return F.when(path.isNull() | (F.trim(path) == "") | length.isNull(), "skip").when(length > limit, "error").otherwise("ready")


def prompt(sections: list[tuple[str, Column | None]]) -> Column:
    """Sections that have text, each under its heading."""
    parts = [F.when(or_blank(body) != "", F.concat(F.lit(f"{head}\n" if head else ""), body)) for head, body in sections if body is not None]
    return F.concat_ws("\n\n", *parts)


@F.pandas_udf(T.StructType([T.StructField("data", T.StringType()), T.StructField("repaired", T.BooleanType())]))
def _repaired(texts: pd.Series) -> pd.DataFrame:
    rows = [try_json(t) for t in texts]
    return pd.DataFrame({"data": [None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False) for v, _ in rows], "repaired": [r for _, r in rows]})


def repaired_json(text: Column) -> Column:
    """Canonical JSON (data) of a text that may be slightly broken, and whether it was mended; null data if it can't be."""
    ship()
    return _repaired(text)


def schema_type(spec: dict) -> T.DataType:
    """The Spark type of a JSON schema; a union of types is kept as text."""
    kind = spec.get("type", "string")
    if kind == "object" and spec.get("properties"):
        return T.StructType([T.StructField(n, schema_type(s)) for n, s in spec["properties"].items() if isinstance(s, dict)])
    if kind == "array":
        return T.ArrayType(schema_type(spec.get("items", {})))
    return {"boolean": T.BooleanType(), "number": T.DoubleType(), "integer": T.LongType()}.get(kind if isinstance(kind, str) else "", T.StringType())


def schema_error(data: Column, spec: dict) -> Column:
    """The first fault of a JSON text under a schema (variants.Schema), or null; null for a null text."""
    return F.when(data.isNotNull(), F.get(Schema(spec).faults(as_variant(data)), F.lit(0)))


def cleaned_status(status: Column, valid: Column, mended: Column, error: Column, strict: bool = False) -> Column:
    """valid, repaired, invalid, failed_validation (strict only) or the status of what did not succeed; repaired wins over invalid."""
    bad = F.lit("failed_validation" if strict else "invalid")
    return F.when(status != "success", status).when(~valid, bad).when(mended, "repaired").when(error.isNotNull(), bad).otherwise("valid")


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as columns joined by separator; arrays of scalars as text joined by commas, an empty one as ''."""

    def walk(c: Column, name: str, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(c.getField(f.name), f"{name}{separator}{f.name}", f.dataType)]
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return [F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ", ").alias(name)]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return [F.to_json(c).alias(name)]
        return [c.alias(name)]

    return df.select(*(x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.name, f.dataType)))


def numbered(df: DataFrame, column: str, most: int, separator: str = "_") -> DataFrame:
    """An array of structs as columns column_0_field, column_1_field ...; most is the longest array."""
    kind = df.schema[column].dataType.elementType
    item = lambda i, f: F.get(F.col(column), F.lit(i))[f].alias(f"{column}{separator}{i}{separator}{f}")
    return df.select(*(F.col(c) for c in df.columns if c != column), *(item(i, f.name) for i in range(most) for f in kind.fields))


def exploded(df: DataFrame, records: str, paper: list[str]) -> DataFrame:
    """One row for each record, with the paper's fields behind a prefix; a paper without records keeps one row."""
    return df.select(*(F.col(c).alias(f"paper_{c}") for c in paper), F.explode_outer(records).alias("_r")).select(*(f"paper_{c}" for c in paper), "_r.*")


Lookup = Callable[[str, dict], dict | None]


def enriched(df: DataFrame, field: str, output: str, lookup: Lookup, schema: str, parameters: dict | None = None, tries: int = 3, wait: float = 0.0, rate: float | None = None, tasks: int = 4, cache: str | None = None) -> DataFrame:
    """df with what an external service says of a field's values; each distinct value is asked for once.

    Blank values and 'none' are not asked for. A call that fails is tried again after wait, twice
    wait and so on; then, as for a service that knows nothing, the result is null. rate bounds the
    calls a second of the whole job, which `tasks` tasks make then. cache: a folder with the answers of
    earlier runs (lookups.Lookups), one for each service and set of parameters; only what it lacks is
    asked for, while the plan is made, and what is answered is added.
    """
    ask = (or_blank(F.trim(F.col(field))) != "") & (F.lower(F.trim(F.col(field))) != "none")
    keys = df.where(ask).select(F.col(field).alias("_key")).distinct()
    names = T.StructType.fromDDL(schema).fieldNames()
    ship(df.sparkSession)
    held = Lookups(df.sparkSession, cache, schema) if cache else None
    if held:
        keys = keys.join(held.known().select(F.col("key").alias("_key")), "_key", "left_anti")
    pause = tasks / rate if rate else 0.0
    if rate:
        keys = keys.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b["_key"]:
                for attempt in range(tries):
                    try:
                        found = lookup(key, parameters or {})
                        break
                    except OSError:
                        found = None
                        time.sleep(wait * 2**attempt)
                    finally:
                        time.sleep(pause)
                if found is not None:
                    rows.append([key, *(found.get(n) for n in names)])
            yield pd.DataFrame(rows, columns=["_key", *names], dtype=object)

    answers = keys.mapInPandas(run, f"_key string, {schema}")
    if held:
        held.add(answers.withColumnRenamed("_key", "key"))
        answers = held.known().withColumnRenamed("key", "_key")
    known = answers.select("_key", F.struct(*names).alias(output))
    return df.drop(output).join(known, F.col(field) == F.col("_key"), "left").drop("_key")


def enriched_nested(df: DataFrame, array: str, field: str, output: str, known: DataFrame) -> DataFrame:
    """Records in an array of structs with a looked-up value each; known has (key, value)."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    out = rows.select("_row", F.posexplode_outer(array).alias("_i", "_r")).join(known, F.col(f"_r.{field}") == F.col("key"), "left")
    made = out.groupBy("_row").agg(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", F.struct("_r.*", F.col("value").alias(output)).alias("r"))))).alias("_a"))
    return rows.join(made, "_row").withColumn(array, F.transform("_a", lambda x: x["r"])).drop("_row", "_a")
