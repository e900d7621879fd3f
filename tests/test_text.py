from pyspark.sql import functions as F

from tessella.functions import bands, similarity, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_normalising_and_numbers(spark):
    assert one(spark, text.normalized(F.lit("  A b "))) == "a b" and one(spark, text.normalized(F.lit(None).cast("string"))) == ""
    assert one(spark, text.collapsed(F.lit(" A \n B"))) == "a b"
    assert one(spark, text.number(F.lit(" 12.5 "))) == 12.5 and one(spark, text.number(F.lit("n/a"))) is None
    assert one(spark, text.plain_field_name(F.lit("x_tab_nesttab"))) == "x"
    assert one(spark, text.sample_name(F.lit("Ápis (x) y-1"))) == "Ápis_x_y-1"
    assert one(spark, text.identifier(F.lit("10.1/a b"))) == "10_1_a_b"
    assert one(spark, text.doi(F.lit("see 10.1234/ab.c x"))) == "10.1234/ab.c" and one(spark, text.doi(F.lit("no"))) is None


def test_tags_and_front_matter(spark):
    t = F.lit("a <analysis> x\ny </analysis> <output>\n{\"a\": {\"b\": 1}}\n</output>")
    assert one(spark, text.tagged_json(t)) == '{"a": {"b": 1}}' and one(spark, text.tagged_text(t)) == "x\ny"
    assert one(spark, text.tagged_json(F.lit("<output>no</output>"))) is None
    f = one(spark, text.front_matter(F.lit("---\na: 1\nurl: http://x\na: 2\n---\nbody")))
    assert f.fields == {"a": "2", "url": "http://x"} and f.body == "body"
    assert one(spark, text.front_matter(F.lit("no block"))).body == "no block"


def test_regions(spark):
    t = F.lit("<|ref|>Figure<|/ref|><|det|>[[0, 0, 999, 500]]<|/det|>\nx<|ref|>image<|/ref|><|det|>[[5,5,5,9]]<|/det|><|ref|>figure<|/ref|><|det|>[[1,2]]<|/det|>\n\n\n\nz\nsub_title[[1,2,3,4]]\nend")
    found = one(spark, text.regions(t, F.lit(100), F.lit(200)))
    assert [(r.label, r.l, r.t, r.r, r.b, r.figure) for r in found] == [("figure", 0, 0, 100, 100, True), ("image", 1, 1, 1, 2, False)]
    assert one(spark, text.figure_links(t, F.lit(7), F.lit(100), F.lit(200))) == ["![figure](figures/fig_p0007_01.png)"]
    assert one(spark, text.without_grounding(t)) == "\nx\n\nz\nend"
    assert one(spark, text.point_pixels(F.lit(700.0), F.lit(2.0), F.lit(1000), F.lit(792.0))) == 184


def test_captions_garbage_languages(spark):
    assert one(spark, text.is_caption(F.lit("**Fig. 3** x"))) and not one(spark, text.is_caption(F.lit("see Fig. 3")))
    assert one(spark, text.is_garbled(F.lit("�" * 6))) and not one(spark, text.is_garbled(F.lit("fine words")))
    assert one(spark, text.is_garbled(F.lit("a b c " * 50)))
    assert one(spark, text.language(F.lit("Der Hund und die Katze sind nicht mit dem Auto von hier"))) == "de"
    assert one(spark, text.language(F.lit("short"))) is None


def test_money_dates_names(spark):
    assert str(one(spark, text.money(F.lit("-$1,234.50")))) == "-1234.50" and one(spark, text.money(F.lit("n/a"))) is None
    assert str(one(spark, text.ledger_date(F.lit("5-Mar-2026")))) == "2026-03-05" and one(spark, text.ledger_date(F.lit("x"))) is None
    assert one(spark, text.receipt_name(F.lit(2026), F.lit(25), F.lit("Amazon: lab supplies!"), F.lit("pdf"))) == "26025_amazon_lab_supplies.pdf"
    assert one(spark, text.name_faults(F.lit("1 bad(name)"))) == ["characters", "leading digit", "shape"]
    assert one(spark, text.name_faults(F.lit("GCA000001735_Arabidopsis_thaliana"))) == []
    assert one(spark, text.thousands(F.lit(1234567))) == "1,234,567" and one(spark, text.shortened(F.lit("x" * 40))) == "x" * 28 + ".."


def test_bands(spark):
    assert [one(spark, bands.completeness(F.lit(x))) for x in (96.0, 95.0, 85.0, 70.0, 69.9)] == ["excellent", "good", "acceptable", "questionable", "poor"]
    assert [one(spark, bands.trimming(F.lit(x))) for x in (9.0, 10.0, 20.0, 50.0, 50.1)] == ["excellent", "good", "moderate", "poor", "exclude"]
    assert [one(spark, bands.contiguity(F.lit(x))) for x in (2e7, 2e6, 5e5, 5e4)] == ["excellent", "good", "fair", "poor"]
    assert [one(spark, bands.support(F.lit(x))) for x in (1.0, 5.0, 9.0, 11.0)] == ["equivalent", "considerably less", "little", "none"]


def test_ratio_is_bounded_and_aliases_help(spark):
    import difflib
    import random

    r = random.Random(3)
    names = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 9))).strip() or "a" for _ in range(60)]
    a = spark.createDataFrame([(x,) for x in names[:30]], ["name"])
    b = spark.createDataFrame([(x,) for x in names[30:]], ["name"])
    got = {(x.left_name, x.right_name) for x in similarity.similar_names(a, b, 0.6).collect()}
    assert got == {(x, y) for x in set(names[:30]) for y in set(names[30:]) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.6}
    u = spark.createDataFrame([("United States",)], ["name"])
    v = spark.createDataFrame([("United States of America",)], ["name"])
    assert similarity.similar_names(u, v, 0.75).count() == 1
