"""External services as named, pluggable calls; which one a run uses and what it lacks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.shipping import ship
from tessella.functions.text import or_blank
from tessella.operators.extraction import Lookup, enriched
from tessella.operators.nodes import lookup
from tessella.sources.scratch import stored

# How a backend reads a page, whose service it calls, and what that needs.
BACKENDS = {
    "full_page": ("full_page", "local", "host"),
    "regions": ("region", "local", "host"),
    "grounded": ("grounding", "local", "host"),
    "hosted": ("full_page", "hosted", "api_key"),
}
REGISTRY: dict[str, Lookup] = {}


def register(name: str) -> Callable[[Lookup], Lookup]:
    """Makes a lookup (value, parameters) -> dict or None known by a name."""

    def keep(f: Lookup) -> Lookup:
        REGISTRY[name] = f
        return f

    return keep


def enriched_by(df: DataFrame, config: list[dict], schemas: dict[str, str]) -> DataFrame:
    """df after each mapping of a configuration: field, api, output_field and extra_params; an unknown api gives nulls."""
    for m in config:
        schema = schemas[m["api"]] if m["api"] in schemas else "found string"
        call = REGISTRY.get(m["api"], lambda value, parameters: None)
        df = enriched(df, m["field"], m["output_field"], call, schema, m.get("extra_params"))
    return df


def asking(calls: dict[str, Lookup], tries: int = 3, wait: float = 0.0):
    """A table function: rows (api, parameters, value) and a configuration (JSON: api to schema, as Spark writes it) to the same with one struct column for each api.

    Its columns follow from the configuration. A call that fails is tried again after growing waits; an api without a call gives nulls.
    """
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    class Ask:
        @staticmethod
        def analyze(rows: AnalyzeArgument, config: AnalyzeArgument) -> AnalyzeResult:
            import json

            from pyspark.sql.types import StringType, StructType

            out = StructType()
            for name in ("api", "parameters", "value"):
                out = out.add(name, StringType())
            for api, schema in sorted(json.loads(config.value).items()):
                out = out.add(api, StructType.fromJson(schema))
            return AnalyzeResult(out)

        def eval(self, rows, config):
            import json
            import time

            schemas = sorted(json.loads(config).items())
            call, found = calls.get(rows["api"]), None
            for attempt in range(tries if call else 0):
                try:
                    found = call(rows["value"], json.loads(rows["parameters"]))
                    break
                except OSError:
                    time.sleep(wait * 2**attempt)
            told = [None if api != rows["api"] or found is None else tuple(found.get(f["name"]) for f in schema["fields"]) for api, schema in schemas]
            yield (rows["api"], rows["parameters"], rows["value"], *told)

    return F.udtf(Ask)


def enriched_all(df: DataFrame, config: list[dict], schemas: dict[str, str], calls: dict[str, Lookup] | None = None, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """What enriched_by gives, with one table function over the distinct (api, parameters, value) of all mappings.

    field "array.name" looks each element's name up and puts the answer into the element. Only row
    numbers and values travel to the answers and back. df is written once, so that its rows keep their numbers.
    """
    ship(df.sparkSession)
    calls = REGISTRY if calls is None else calls
    known = {m["api"]: schemas.get(m["api"], "found string") for m in config}
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def asked(m: dict, value: Column, place: Column) -> Column:
        told = [F.lit(m["api"]).alias("api"), F.lit(json.dumps(m.get("extra_params") or {}, sort_keys=True)).alias("parameters"), value.cast("string").alias("value")]
        return F.struct(F.lit(config.index(m)).alias("m"), place.cast("int").alias("i"), *told)

    wanted = []
    for m in config:
        array, _, name = m["field"].partition(".")
        if name:
            wanted.append(_each(asked, m, array, name))
        else:
            wanted.append(F.array(asked(m, F.col(m["field"]), F.lit(-1))))
    keys = rows.select("_row", F.explode(F.concat(*wanted)).alias("k")).select("_row", "k.*")
    keys = stored(keys.where((or_blank(F.trim("value")) != "") & (F.lower(F.trim("value")) != "none")), "asked")
    ask = asking({api: calls[api] for api in known if api in calls}, tries, wait)
    answers = ask(keys.select("api", "parameters", "value").distinct().asTable(), F.lit(json.dumps({api: T.StructType.fromDDL(schema).jsonValue() for api, schema in known.items()})))
    met = keys.join(stored(answers, "answers"), ["api", "parameters", "value"])
    answer = lambda n: F.col(f"`{config[n]['api']}`")
    made = []
    for n, m in enumerate(config):
        if "." in m["field"]:
            found = F.collect_list(F.when((F.col("m") == n) & answer(n).isNotNull(), F.struct(F.col("i").alias("key"), answer(n).alias("value"))))
            made.append(F.map_from_entries(found).alias(f"_m{n}"))
        else:
            made.append(F.first(F.when(F.col("m") == n, answer(n)), ignorenulls=True).alias(f"_m{n}"))
    out = rows.join(met.groupBy("_row").agg(*made), "_row", "left")
    for n, m in enumerate(config):
        array, _, name = m["field"].partition(".")
        if name:
            fields = [f for f in df.schema[array].dataType.elementType.fieldNames() if f != m["output_field"]]
            out = out.withColumn(array, _with_answers(array, fields, m["output_field"], f"_m{n}"))
        else:
            out = out.withColumn(m["output_field"], F.col(f"_m{n}"))
    return out.drop("_row", *(f"_m{n}" for n in range(len(config))))


def _each(asked, m: dict, array: str, name: str) -> Column:
    return F.coalesce(F.transform(F.col(array), lambda x, i: asked(m, x[name], i)), F.array().cast("array<struct<m:int,i:int,api:string,parameters:string,value:string>>"))


def _with_answers(array: str, fields: list[str], output: str, answers: str) -> Column:
    return F.transform(F.col(array), lambda x, i: F.struct(*(x[f].alias(f) for f in fields), F.try_element_at(F.col(answers), i).alias(output)))


def model_of(provider: Column, model: Column, defaults: dict[str, str]) -> Column:
    """The model named, or else the provider's default."""
    return F.coalesce(F.nullif(F.trim(model), F.lit("")), lookup(defaults, provider))


def plan_of(backend: Column) -> Column:
    """Strategy, provider and requirement of a backend; null for an unknown one."""
    part = lambda i: lookup({k: v[i] for k, v in BACKENDS.items()}, backend)
    return F.when(part(0).isNotNull(), F.struct(part(0).alias("strategy"), part(1).alias("provider"), part(2).alias("needs")))


def preflight(backend: Column, host: Column, key: Column, needs_calls: Column) -> Column:
    """What stops a run, or null: only runs that call a service need one."""
    needs = plan_of(backend)["needs"]
    return (
        F.when(~needs_calls, None)
        .when(needs.isNull(), F.concat(F.lit("unknown backend "), F.coalesce(backend, F.lit(""))))
        .when((needs == "host") & (F.coalesce(host, F.lit("")) == ""), "no host")
        .when((needs == "api_key") & (F.coalesce(key, F.lit("")) == ""), "no api key")
    )


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """A trial run's rows: the first n in a fixed order."""
    return df.orderBy(*order).limit(n)


def fits_machine(threads: Column, jobs: Column, total: Column) -> Column:
    return threads * jobs <= total


def jobs_for(total: Column, threads: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(total / threads)).cast("int")
