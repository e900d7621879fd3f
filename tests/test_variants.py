import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions.json_repair import try_json
from tessella.operators import extraction, variants

PAPER = {
    "type": "object",
    "required": ["has_data", "records"],
    "properties": {
        "has_data": {"type": "boolean"},
        "_comment": "passed over",
        "records": {
            "type": "array",
            "maxItems": 4,
            "items": {
                "type": "object",
                "required": ["subject"],
                "properties": {
                    "subject": {"type": "string", "minLength": 2, "maxLength": 6, "pattern": "^[a-z]"},
                    "value": {"type": ["number", "string"]},
                    "size": {"type": "integer", "minimum": 1, "exclusiveMaximum": 50, "multipleOf": 2},
                    "unit": {"enum": ["mg", 1, None]},
                    "tags": {"type": "array", "uniqueItems": True, "minItems": 1, "items": {"$ref": "#/$defs/tag"}},
                },
                "additionalProperties": {"type": "null"},
            },
        },
    },
    "$defs": {"tag": {"anyOf": [{"type": "string"}, {"type": "array", "prefixItems": [{"const": "k"}], "items": {"type": "integer"}}]}},
}


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "integer" if float(v).is_integer() else "number"
    return {dict: "object", list: "array", str: "string", type(None): "null"}[type(v)]


def same(a, b):
    return kind(a) in ("integer", "number") and kind(b) in ("integer", "number") and a == b or (type(a) is type(b) and a == b)


def slow(v, spec, path="$", root=PAPER):
    """All faults, straight from the schema."""
    if spec is True or spec == {}:
        return []
    if spec is False:
        return [f"{path}: is not allowed"]
    if "$ref" in spec:
        return slow(v, root["$defs"]["tag"], path)
    out, more, k = [], [], kind(v)
    kinds = [spec["type"]] if isinstance(spec.get("type"), str) else spec.get("type")
    if kinds and not (k in kinds or (k == "integer" and "number" in kinds)):
        out.append(f"{path}: is not of type {' or '.join(kinds)}")
    if "enum" in spec and not any(same(v, c) for c in spec["enum"]):
        out.append(f"{path}: is not one of the allowed values")
    if "const" in spec and not same(v, spec["const"]):
        out.append(f'{path}: is not "{spec["const"]}"')
    if k in ("integer", "number"):
        if "minimum" in spec and v < spec["minimum"]:
            out.append(f"{path}: is less than {spec['minimum']}")
        if "exclusiveMaximum" in spec and v >= spec["exclusiveMaximum"]:
            out.append(f"{path}: is not less than {spec['exclusiveMaximum']}")
        if "multipleOf" in spec and v / spec["multipleOf"] != math.floor(v / spec["multipleOf"]):
            out.append(f"{path}: is no multiple of {spec['multipleOf']}")
    if k == "string":
        if len(v) < spec.get("minLength", 0):
            out.append(f"{path}: is shorter than {spec['minLength']}")
        if len(v) > spec.get("maxLength", 99):
            out.append(f"{path}: is longer than {spec['maxLength']}")
        if "pattern" in spec and not re.search(spec["pattern"], v):
            out.append(f"{path}: does not match {spec['pattern']}")
    if k == "array":
        if len(v) < spec.get("minItems", 0):
            out.append(f"{path}: has fewer than {spec['minItems']} items")
        if len(v) > spec.get("maxItems", 99):
            out.append(f"{path}: has more than {spec['maxItems']} items")
        if spec.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            out.append(f"{path}: has equal items")
        first = spec.get("prefixItems", [])
        for i, x in enumerate(v):
            inner = first[i] if i < len(first) else spec.get("items", True)
            more += slow(x, inner, f"{path}[{i}]")
    if k == "object":
        out += [f"{path}: '{n}' is required" for n in spec.get("required", ()) if n not in v]
        for n, inner in spec.get("properties", {}).items():
            if isinstance(inner, dict) and n in v:
                more += slow(v[n], inner, f"{path}.{n}")
        for n in sorted(v):
            if n not in spec.get("properties", {}):
                more += slow(v[n], spec.get("additionalProperties", True), f"{path}.{n}")
    if "anyOf" in spec and all(slow(v, s, path) for s in spec["anyOf"]):
        out.append(f"{path}: fits none of the allowed schemas")
    return out + more


def some_value(r, depth=3):
    k = r.randrange(9 if depth else 6)
    if k < 6:
        return [None, True, r.randint(-2, 60), r.choice([1.0, 2.5, 4.0, -0.5]), r.choice(["mg", "a", "abc", "Abcdefgh", "é\"'\\x", "k"]), False][k]
    if k == 6:
        return [some_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {n: some_value(r, depth - 1) for n in r.sample(["subject", "value", "size", "unit", "tags", "x.y", "z"], r.randint(0, 4))}


def some_paper(r):
    record = lambda: {n: v for n, v in {"subject": r.choice(["abc", "x", "Abc", 5, "abcdefgh"]), "value": r.choice([1, "a", None, 2.5]), "size": r.choice([2, 3, 0, 50, 4.0, 1.5]), "unit": r.choice(["mg", "g", 1.0, None]), "tags": r.choice([[], ["a", "a"], ["k", ["k", 1]], [["k", "x"]], [["q"]], "t"]), "more": r.choice([None, 1])}.items() if r.random() < 0.8}
    return {n: v for n, v in {"has_data": r.choice([True, False, "yes"]), "records": r.choice([[record() for _ in range(r.randint(0, 5))], some_value(r)])}.items() if r.random() < 0.9}


def test_faults_equal_a_direct_version(spark):
    r = random.Random(2)
    papers = [some_paper(r) if r.random() < 0.8 else some_value(r) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(papers)], "i int, t string")
    got = dict(df.select("i", variants.Schema(PAPER).faults(variants.as_variant(F.col("t")))).collect())
    # Faults of one value come in the order of the keywords; compared as sets of texts with their number.
    assert {i: sorted(f) for i, f in got.items()} == {i: sorted(slow(p, PAPER)) for i, p in enumerate(papers)}
    assert sum(1 for f in got.values() if f) > 100 and sum(1 for f in got.values() if any("records[" in x for x in f)) > 50


def test_first_fault_and_what_is_no_json(spark):
    rows = [('{"has_data": true, "records": [{"subject": "abc"}, {"subject": "abc", "size": 3}]}', "$.records[1].size: is no multiple of 2"), ("{", "$: is not JSON"), (None, None), ('{"has_data": true, "records": []}', None)]
    df = spark.createDataFrame(rows, "t string, e string")
    assert all(a == b for a, b in df.select(extraction.schema_error(F.col("t"), PAPER), "e").collect())


def test_other_keywords(spark):
    def valid(spec, *values):
        df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
        return [x[0] == [] for x in df.coalesce(1).select(variants.Schema(spec).faults(variants.as_variant(F.col("t")))).collect()]

    assert valid({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, 1, 5, 3.5, 2.5) == [True, False, True, False]
    assert valid({"not": {"type": "string"}, "allOf": [{"minProperties": 1}, {"maxProperties": 2}]}, "a", {}, {"a": 1}, {"a": 1, "b": 1, "c": 1}) == [False, False, True, False]
    assert valid({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, {"n_a": 1}, {"n_a": "x"}, {"m": 1}, {}) == [True, False, False, True]
    assert valid({"properties": {'a"b': {"type": "null"}, "c d": False}, "exclusiveMinimum": 0, "maximum": 2}, {'a"b': 1}, {"c d": 1}, {"x": 1}, 0, 2) == [False, False, True, False, True]
    with pytest.raises(ValueError, match="holds itself"):
        variants.Schema({"items": {"$ref": "#"}}).faults(F.lit(None))


def flat(d, name=""):
    out = {}
    for k, v in d.items():
        new = f"{name}_{k}" if name else k
        if isinstance(v, dict):
            out.update(flat(v, new))
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            for i, x in enumerate(v):
                out.update(flat(x, f"{new}_{i}"))
        elif isinstance(v, list):
            out[new] = ", ".join(str(x) for x in v)
        else:
            out[new] = v
    return out


def test_wide_tables_have_the_keys_of_all_rows(spark):
    r = random.Random(4)
    def record(depth):
        out = {}
        for n in r.sample("pqrstuv", r.randint(0, 5)):
            k = r.randrange(6 if depth else 4)
            out[f"{n}{k}"] = [r.randint(0, 9), r.choice([True, False]), r.choice(["x", "y z", "", None]), r.choice([[], [1, 2], ["a", None], [True, 2]]), record(depth - 1) if depth else 0, [record(depth - 1) for _ in range(r.randint(0, 3))] if depth else 0][k]
        return out

    rows = [record(3) for _ in range(60)] + [{"deep": {"a": {"b": {"c": {"d": {"e": {"f": 1.5}}}}}}, "mix": 1}, {"mix": "x"}, {"mix": {"in": 2}}, {"mix": [{"in": 3}]}, {"Mix": 2}, {}, {"i": 7}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)] + [(len(rows), None)], "i int, t string").withColumn("v", variants.as_variant(F.col("t"))).drop("t")
    out = variants.wide(df, "v")
    expected = [flat(x) for x in rows]
    names = {k for x in expected for k in x} - {"i", "Mix", "mix"}
    assert set(out.columns) - {"i", "v_i"} - {c for c in out.columns if c.lower().endswith("mix") or c.lower().startswith(("mix_", "v_mix"))} == names - {"mix_in", "mix_0_in"}
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    for got in out.collect():
        want = expected[got.i] if got.i < len(expected) else {}
        for n in names:
            v = want.get(n)
            assert got[n] == (v if v is None or kinds[n] != "string" else str(v)), (got.i, n)
    first = {r.i: r for r in out.where("i >= 60").collect()}
    assert first[60].deep_a_b_c_d_e_f == 1.5 and first[62].mix_in == 2 and first[63].mix_0_in == 3 and first[66].v_i == 7
    assert "mix" in [c.lower() for c in out.columns] and len({c.lower() for c in out.columns}) == len(out.columns)


def test_wide_of_no_rows_and_of_too_many_columns(spark, monkeypatch):
    df = spark.createDataFrame([], "i int, t string").select("i", variants.as_variant(F.col("t")).alias("v"))
    assert variants.wide(df, "v").columns == ["i"]
    monkeypatch.setattr(variants, "MOST_COLUMNS", 5)
    many = spark.createDataFrame([(json.dumps({f"k{i}": 1 for i in range(20)}),)], "t string").select(variants.as_variant(F.col("t")).alias("v"))
    with pytest.raises(ValueError, match="more than 5 columns"):
        variants.wide(many, "v")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": 1}', {"a": 1}),
        ("```json\n{'a': 'x', 'b': [1, 2,],}\n```", {"a": "x", "b": [1, 2]}),
        ('{a: True, b_c: None, "d": "None, True,]"', {"a": True, "b_c": None, "d": "None, True,]"}),
        ('{"a": "he said "no", then left", "b": 2}', {"a": 'he said "no", then left', "b": 2}),
        ('{"a": "cut off here', {"a": "cut off here"}),
        ('{"a": {"b": [1, {"c": "d"', {"a": {"b": [1, {"c": "d"}]}}),
        ('{"a": "1" \n "b": 2}', {"a": "1", "b": 2}),
        ('{"a": 1,, "b": }', {"a": 1, "b": None}),
        ('Here it is: [1, "x\\u00e9\\n", \'it\'s\'] - done', [1, "xé\n", "it's"]),
        ('{"a": "tab\there\nline"}', {"a": "tab\there\nline"}),
        ("{“a”: “b”}", {"a": "b"}),
        ('{"a": 1, "b"', {"a": 1}),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_repair_keeps_what_is_inside_values(text, value):
    assert try_json(text)[0] == value


def test_repair_ends_on_any_cut_of_a_text():
    r = random.Random(1)
    for _ in range(20):
        whole = json.dumps(some_paper(r), ensure_ascii=r.random() < 0.5)
        for cut in range(len(whole)):
            json.dumps(try_json(whole[:cut])[0])
        assert try_json(whole) == (json.loads(whole), False)
    assert try_json("[" * 100_000)[1] is False
