"""JSON values of any structure as variants: checks under a JSON schema, and wide tables without a known structure.

Both are expressions of the plan. A schema compiles into one column of faults that goes into arrays
and objects as deep as the schema does, with the place of each fault ($.records[3].latitude).
Flattening finds its columns in one pass over the data and makes them in a second one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"
#: Columns that a wide table may have.
MOST_COLUMNS = 20_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def as_variant(text: Column) -> Column:
    """A JSON text as a variant; null if it can't be read."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def fields(value: Column) -> Column:
    """An object's fields as map<string, variant>; null for anything else."""
    return at(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """A list's items; null for anything else."""
    return at(value, "$", "array<variant>")


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, integer, number or null; null where there is no value."""
    told = F.schema_of_variant(value)
    number = told.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(value.isNull(), F.lit(None))
        .when(told.startswith("OBJECT"), "object")
        .when(told.startswith("ARRAY"), "array")
        .when(told == "VOID", "null")
        .when(told == "BOOLEAN", "boolean")
        .when(told.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), "integer")
        .when(number, F.when(at(value, "$", "double") == F.floor(at(value, "$", "double")), "integer").otherwise("number"))
        .otherwise("string")
    )


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def equals(value: Column, kind: Column, constant: object) -> Column:
    """Whether a value is this constant; numbers are equal by value."""
    if isinstance(constant, bool) or not isinstance(constant, int | float):
        return F.to_json(value) == canonical(constant)
    return kind.isin("integer", "number") & (at(value, "$", "double") == F.lit(float(constant)))


def step(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def field_path(name: str) -> str:
    return '$["' + name + '"]' if '"' not in name else "$['" + name + "']"


class Schema:
    """A JSON schema as a column of faults.

    Known: type (also a list of types), enum, const, bounds of numbers, lengths and pattern of
    strings, numbers and uniqueness of items, prefixItems, items, required, properties, their number,
    patternProperties, additionalProperties, allOf, anyOf, oneOf, not, and $ref into the schema (not to itself).
    What is neither a schema nor true or false among the properties (a comment) is passed over.
    Integers are numbers without a fraction, whatever they are written like.
    """

    def __init__(self, spec: dict):
        self.root = spec

    def faults(self, value: Column) -> Column:
        """array<string> of all faults of a variant, in the order of the schema; a null variant is no JSON."""
        return F.when(value.isNull(), F.array(F.lit("$: is not JSON"))).otherwise(self.of(value, self.root, F.lit("$"), ()))

    def of(self, value: Column, spec: dict | bool, path: Column, seen: tuple[str, ...]) -> Column:
        """Faults of a value that may be missing: a missing one has none."""
        if spec is True or spec == {}:
            return F.array().cast(NONE)
        if spec is False:
            return F.when(value.isNotNull(), F.array(F.concat(path, F.lit(": is not allowed")))).otherwise(F.array().cast(NONE))
        if "$ref" in spec:
            if spec["$ref"] in seen:
                raise ValueError(f"{spec['$ref']} holds itself")
            spec, seen = self.named(spec["$ref"]) | {k: v for k, v in spec.items() if k != "$ref"}, (*seen, spec["$ref"])
        found = let(value, lambda v: let(kind_of(v), lambda k: self.tests(v, k, spec, path, seen)))
        return F.when(value.isNull(), F.array().cast(NONE)).otherwise(found)

    def named(self, name: str) -> dict:
        out = self.root
        for part in name.removeprefix("#").strip("/").split("/") if name != "#" else []:
            out = out[part.replace("~1", "/").replace("~0", "~")]
        return out

    def tests(self, v: Column, k: Column, spec: dict, path: Column, seen: tuple[str, ...]) -> Column:
        one: list[Column] = []
        more: list[Column] = []

        def fault(bad: Column, text: str) -> None:
            one.append(F.when(bad, F.concat(path, F.lit(f": {text}"))))

        kinds = spec.get("type")
        if kinds is not None:
            kinds = [kinds] if isinstance(kinds, str) else list(kinds)
            wide = [*kinds, "integer"] if "number" in kinds else kinds
            fault(~k.isin(*wide), f"is not of type {' or '.join(kinds)}")
        if "enum" in spec:
            fault(~anyone([equals(v, k, c) for c in spec["enum"]]), "is not one of the allowed values")
        if "const" in spec:
            fault(~equals(v, k, spec["const"]), f"is not {canonical(spec['const'])}")
        number, is_number = at(v, "$", "double"), k.isin("integer", "number")
        for name, bad, text in (
            ("minimum", lambda n: number < n, "is less than"),
            ("maximum", lambda n: number > n, "is more than"),
            ("exclusiveMinimum", lambda n: number <= n, "is not more than"),
            ("exclusiveMaximum", lambda n: number >= n, "is not less than"),
            ("multipleOf", lambda n: number / n != F.floor(number / n), "is no multiple of"),
        ):
            if name in spec:
                fault(is_number & bad(F.lit(float(spec[name]))), f"{text} {spec[name]}")
        text, is_text = at(v, "$", "string"), k == "string"
        if "minLength" in spec:
            fault(is_text & (F.length(text) < spec["minLength"]), f"is shorter than {spec['minLength']}")
        if "maxLength" in spec:
            fault(is_text & (F.length(text) > spec["maxLength"]), f"is longer than {spec['maxLength']}")
        if "pattern" in spec:
            fault(is_text & ~text.rlike(spec["pattern"]), f"does not match {spec['pattern']}")
        if "minItems" in spec:
            fault((k == "array") & (F.size(items(v)) < spec["minItems"]), f"has fewer than {spec['minItems']} items")
        if "maxItems" in spec:
            fault((k == "array") & (F.size(items(v)) > spec["maxItems"]), f"has more than {spec['maxItems']} items")
        if spec.get("uniqueItems"):
            fault((k == "array") & let(F.transform(items(v), lambda x: F.to_json(x)), lambda x: F.size(F.array_distinct(x)) < F.size(x)), "has equal items")
        if "minProperties" in spec:
            fault((k == "object") & (F.size(fields(v)) < spec["minProperties"]), f"has fewer than {spec['minProperties']} properties")
        if "maxProperties" in spec:
            fault((k == "object") & (F.size(fields(v)) > spec["maxProperties"]), f"has more than {spec['maxProperties']} properties")
        for name in spec.get("required", ()):
            fault((k == "object") & at(v, field_path(name)).isNull(), f"'{name}' is required")
        for name, inner in spec.get("properties", {}).items():
            if isinstance(inner, dict | bool):
                more.append(F.when(k == "object", self.of(at(v, field_path(name)), inner, step(path, name), seen)))
        self.other_fields(v, k, spec, path, seen, more)
        first = spec.get("prefixItems", [])
        for i, inner in enumerate(first):
            more.append(F.when(k == "array", self.of(at(v, f"$[{i}]"), inner, F.concat(path, F.lit(f"[{i}]")), seen)))
        if isinstance(spec.get("items"), dict | bool):
            each = lambda x, i: F.when(i >= len(first), self.of(x, spec["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen)).otherwise(F.array().cast(NONE))
            more.append(F.when(k == "array", F.flatten(F.transform(items(v), each))))
        for inner in spec.get("allOf", ()):
            more.append(self.of(v, inner, path, seen))
        fits = lambda inner: F.size(self.of(v, inner, path, seen)) == 0
        if "anyOf" in spec:
            fault(~anyone([fits(x) for x in spec["anyOf"]]), "fits none of the allowed schemas")
        if "oneOf" in spec:
            many = sum((fits(x).cast("int") for x in spec["oneOf"]), F.lit(0))
            fault(many != 1, "does not fit exactly one of the allowed schemas")
        if "not" in spec:
            fault(fits(spec["not"]), "fits a forbidden schema")
        own = F.array_compact(F.array(*one)) if one else F.array().cast(NONE)
        return F.concat(own, *(F.coalesce(m, F.array().cast(NONE)) for m in more))

    def other_fields(self, v: Column, k: Column, spec: dict, path: Column, seen: tuple[str, ...], more: list[Column]) -> None:
        patterns, known = spec.get("patternProperties", {}), list(spec.get("properties", {}))
        extra = spec.get("additionalProperties", True)
        entries = F.map_entries(fields(v))

        def add(which: Callable[[Column], Column], inner: dict | bool) -> None:
            told = lambda e: self.of(e["value"], inner, F.concat(path, F.lit("."), e["key"]), seen)
            more.append(F.when(k == "object", F.flatten(F.transform(F.filter(entries, which), told))))

        def matches(pattern: str) -> Callable[[Column], Column]:
            return lambda e: e["key"].rlike(pattern)

        for pattern, inner in patterns.items():
            add(matches(pattern), inner)
        if extra is not True:
            add(lambda e: ~anyone([e["key"].isin(*known) if known else F.lit(False), *(e["key"].rlike(p) for p in patterns)]), extra)


def anyone(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


# ---- flattening


LEAF = "array<struct<name:string,path:string,value:variant>>"


def leaf_text(value: Column) -> Column:
    """A value as a table shows it: true and false with a capital, text as it is, null as null, all else as JSON."""
    kind = kind_of(value)
    return F.when(kind == "null", F.lit(None)).when(kind == "string", at(value, "$", "string")).when(kind == "boolean", F.initcap(F.to_json(value))).otherwise(F.to_json(value))


def list_text(value: Column) -> Column:
    """A list of plain values as one text, joined by comma and blank."""
    return F.array_join(F.transform(items(value), lambda x: F.coalesce(leaf_text(x), F.lit("None"))), ", ")


def expanded(leaves: Column, separator: str) -> Column:
    """leaves with each object replaced by its fields and each list of objects by its items; other leaves stay."""
    leaf = lambda name, path, value: F.struct(name.alias("name"), path.alias("path"), value.alias("value"))

    def one(x: Column) -> Column:
        under = lambda name: F.when(x["name"] == "", name).otherwise(F.concat(x["name"], F.lit(separator), name))
        quote = lambda key: F.when(F.contains(key, F.lit('"')), F.concat(F.lit("['"), key, F.lit("']"))).otherwise(F.concat(F.lit('["'), key, F.lit('"]')))
        of_object = F.transform(F.map_entries(fields(x["value"])), lambda e: leaf(under(e["key"]), F.concat(x["path"], quote(e["key"])), e["value"]))
        of_list = F.transform(items(x["value"]), lambda v, i: leaf(under(i.cast("string")), F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v))
        return F.when(fields(x["value"]).isNotNull(), of_object).when(fields(F.get(items(x["value"]), F.lit(0))).isNotNull(), of_list).otherwise(F.array(x))

    return F.flatten(F.transform(leaves, one))


def leaves_of(value: Column, depth: int, separator: str = "_") -> Column:
    """The leaves (name, path, value) of a variant that nests no deeper than depth."""
    top = F.array(F.struct(F.lit("").alias("name"), F.lit("$").alias("path"), value.alias("value"))).cast(LEAF)
    for _ in range(depth):
        top = expanded(top, separator)
    return top


def unfinished(leaf: Column) -> Column:
    return fields(leaf["value"]).isNotNull() & (F.size(fields(leaf["value"])) > 0) | fields(F.get(items(leaf["value"]), F.lit(0))).isNotNull()


def found_columns(df: DataFrame, column: str, separator: str = "_", depth: int = 4) -> list[tuple[str, list[str], str]]:
    """Each column (name, paths, kind) that flattening the variants of a column gives, by name.

    One pass for structures up to depth, another one with twice the depth where something nests
    deeper. Only distinct (name, path, kind) are moved; they are as many as the result has columns.
    """
    while True:
        leaf = df.where(F.col(column).isNotNull()).select(F.explode(leaves_of(F.col(column), depth, separator)).alias("x"))
        list_ = items(F.col("x.value")).isNotNull()
        kind = F.when(list_, "string").otherwise(kind_of(F.col("x.value")))
        deeper = F.when(unfinished(F.col("x")), True).otherwise(False)
        rows = leaf.select("x.name", "x.path", kind.alias("kind"), deeper.alias("deeper"), (F.size(F.coalesce(fields(F.col("x.value")), F.create_map().cast("map<string,variant>"))) == 0).alias("shown")).where("shown OR deeper").distinct().limit(2 * MOST_COLUMNS + 1).collect()
        if len(rows) > 2 * MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        if not any(r.deeper for r in rows):
            break
        depth *= 2
    out: dict[str, tuple[set[str], set[str]]] = {}
    for r in rows:
        if r.kind != "object":
            paths, kinds = out.setdefault(r.name, (set(), set()))
            paths.add(r.path)
            kinds.add(r.kind)
    return [(name, sorted(paths), common_kind(kinds - {"null"})) for name, (paths, kinds) in sorted(out.items())]


def common_kind(kinds: set[str]) -> str:
    """The type of a column whose values have these kinds."""
    if kinds == {"boolean"}:
        return "boolean"
    if kinds == {"integer"}:
        return "bigint"
    return "double" if kinds and kinds <= {"integer", "number"} else "string"


def wide(df: DataFrame, column: str, keep: list[str] | None = None, separator: str = "_", depth: int = 4) -> DataFrame:
    """The columns of keep (default: all others), and one for each leaf that any of column's variants has, by name.

    Objects give name_field, lists of objects name_0_field, name_1_field as far as the longest list
    goes, other lists one text joined by comma and blank. A column is boolean, bigint or double if all
    of its values are, else text. A leaf named like a kept column gets the column's name in front, and
    of names that differ in case only the later ones get a number. A job over df runs while the plan is made. Rows with a null variant keep their row. Where two leaves of a row have one name, the first path in order wins.
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    made, v = [], F.col(column)
    used = {c.lower() for c in keep}
    for name, paths, kind in found_columns(df, column, separator, depth):
        each = [shown(at(v, p), kind) for p in paths]
        title, n = name or column, 1
        if title.lower() in used:
            title = f"{column}{separator}{name}"
        while title.lower() in used:
            title, n = f"{title.removesuffix(f'{separator}{n}')}{separator}{n + 1}", n + 1
        used.add(title.lower())
        made.append((each[0] if len(each) == 1 else F.coalesce(*each)).alias(title))
    return df.select(*(F.col(c) for c in keep), *made)


def shown(value: Column, kind: str) -> Column:
    """A leaf in a column of this kind; null for what is no leaf (it has columns of its own)."""
    if kind != "string":
        return at(value, "$", kind)
    nested = fields(value).isNotNull() | fields(F.get(items(value), F.lit(0))).isNotNull()
    return F.when(nested, F.lit(None)).when(items(value).isNotNull(), list_text(value)).otherwise(leaf_text(value))
