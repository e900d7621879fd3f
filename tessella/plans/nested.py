"""Queries over nested JSON: checks inside arrays, columns found in the data, records read by a declared schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import extraction, variants
from tessella.plans.registry import T, query

RECORD = {
    "type": "object",
    "required": ["kind", "k"],
    "properties": {
        "kind": {"type": "string", "enum": ["click", "view", "purchase", "signup"]},
        "k": {"type": "integer", "maximum": 60},
        "value": {"type": ["number", "null"], "minimum": 1},
        "tags": {"type": "array", "items": {"type": ["string", "integer"]}},
    },
}
PAPER = {"type": "object", "required": ["has_data", "records"], "properties": {"has_data": {"type": "boolean"}, "records": {"type": "array", "items": RECORD}}}


def papers(s, d):
    """Twenty events each as one JSON text; every seventh says has_data as a text."""
    record = F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", F.array("event_type").alias("tags"))
    rows = T(s, d, "events").withColumn("paper", F.floor(F.col("event_id") / 20))
    rows = rows.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))).alias("a"))  # at most 20 of a paper
    body = F.to_json(F.transform("a", lambda x: x["r"]))
    has = F.when(F.col("paper") % 7 == 0, '"yes"').otherwise("true")
    return rows.select("paper", F.concat(F.lit('{"has_data":'), has, F.lit(',"records":'), body, F.lit("}")).alias("data"))


NESTED_SQL = """
WITH e AS (SELECT event_id // 20 AS paper, event_id % 20 AS i, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
f AS (SELECT paper, -1 AS i, 0 AS o, '$.has_data: is not of type boolean' AS fault FROM (SELECT DISTINCT paper FROM e) WHERE paper % 7 = 0
  UNION ALL SELECT paper, i, 1, '$.records[' || i || '].kind: is not one of the allowed values' FROM e WHERE event_type = 'error'
  UNION ALL SELECT paper, i, 2, '$.records[' || i || '].k: is more than 60' FROM e WHERE k > 60
  UNION ALL SELECT paper, i, 3, '$.records[' || i || '].value: is less than 1' FROM e WHERE value < 1)
SELECT p.paper, count(f.fault) AS faults, arg_min(f.fault, f.i * 10 + f.o) AS first_fault FROM (SELECT DISTINCT paper FROM e) p LEFT JOIN f USING (paper) GROUP BY p.paper
"""


@query(NESTED_SQL)
def nested_faults(s, d):
    faults = variants.Schema(PAPER).faults(variants.as_variant(F.col("data")))
    return papers(s, d).select("paper", faults.alias("f")).select("paper", F.size("f").cast("long").alias("faults"), F.get("f", F.lit(0)).alias("first_fault"))


@query("""SELECT event_id // 20 AS paper, event_id // 20 % 7 > 0 AS has_data, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k, value, event_type AS tags FROM events""")
def declared_records(s, d):
    """Papers read by the type that their schema declares, one row a record."""
    read = papers(s, d).select("paper", F.from_json("data", extraction.schema_type(PAPER)).alias("p"))
    # The union of types is text in the declared type.
    rows = read.select("paper", F.coalesce("p.has_data", F.lit(False)).alias("has_data"), F.explode("p.records").alias("r"))
    return rows.select("paper", "has_data", "r.kind", "r.k", F.col("r.value").cast("double").alias("value"), F.array_join("r.tags", ",").alias("tags"))


KINDS = ("click", "error", "purchase", "signup", "view")


def records(s, d):
    """An event as JSON whose keys depend on its type and number: an object under the type's name, a list of none to two objects."""
    k = F.get_json_object("props", "$.k").cast("long")
    own = lambda t: F.when(F.col("event_type") == t, F.struct("value", F.array((k > 50).cast("string"), F.lit(t)).alias("flags"), F.struct((k % 2 == 0).alias("even")).alias("more"))).alias(t)
    part = lambda i: F.struct((k + i).alias("n"), F.when(k % 2 == i, F.lit(f"p{i}")).alias("name"))
    parts = F.when(k % 3 == 0, F.array().cast("array<struct<n:bigint,name:string>>")).when(k % 3 == 1, F.array(part(0))).otherwise(F.array(part(0), part(1)))
    return T(s, d, "events").select("event_id", variants.as_variant(F.to_json(F.struct(k.alias("k"), *map(own, KINDS), parts.alias("parts")))).alias("data"))


WIDE_SQL = f"""SELECT event_id, k, CASE WHEN k % 3 = 0 THEN '' END AS parts, CASE WHEN k % 3 > 0 THEN k END AS parts_0_n, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 'p0' END AS parts_0_name,
  CASE WHEN k % 3 = 2 THEN k + 1 END AS parts_1_n, CASE WHEN k % 3 = 2 AND k % 2 = 1 THEN 'p1' END AS parts_1_name,
  {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}_value, CASE WHEN event_type = '{t}' THEN (k > 50)::VARCHAR || ', {t}' END AS {t}_flags, CASE WHEN event_type = '{t}' THEN k % 2 = 0 END AS {t}_more_even" for t in KINDS)}
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


@query(WIDE_SQL)
def wide_export(s, d):
    return variants.wide(records(s, d), "data")


@query(f"""SELECT field, count(*) AS n FROM (UNPIVOT (SELECT COLUMNS(* EXCLUDE event_id)::VARCHAR FROM ({WIDE_SQL})) ON COLUMNS(*) INTO NAME field VALUE v) GROUP BY field""")
def field_counts(s, d):
    """How many records have each field of the union of all keys."""
    leaf = records(s, d).select(F.explode(variants.leaves_of(F.col("data"), 3)).alias("x"))
    return leaf.groupBy(F.col("x.name").alias("field")).agg(F.count("*").alias("n"))
