"""Column functions on text: normalising, extracting, naming, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of page regions that are figures, and fonts that only text recognition leaves.
FIGURE_LABELS = ("figure", "image", "table", "plate", "picture")
OCR_FONTS = ("GlyphLessFont", "Tesseract", "OCR")
CAPTION = r"(?i)^[\s>*_-]*(?:figs?|figure|plate|pl)\.?\s*[\dIVXLCM]+"
GROUNDING = r"<\|ref\|>([^<]+?)<\|/ref\|>\s*<\|det\|>\[\[([^\]]+)\]\]<\|/det\|>"
PLAIN_REFERENCE = r"<\|ref\|>[^<]*?<\|/ref\|>\s*<\|det\|>\[\[[^\]]+\]\]<\|/det\|>"
LINE_GROUNDING = r"(?m)^[a-z_]+\[\[[\d,\s\[\]]+\]\]\n?"
DOI = r"(10\.\d{4,}/[^\s]+)"
FRONT_MATTER = r"\A\s*---\s*\n(.*?)\n---\s*\n"
#: A garbled text has more replacement characters than this, or is longer than this and has a larger share of single letters among its words.
MOST_REPLACED, LONGER_THAN, SINGLE_LETTERS = 5, 200, 0.4


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalized(c: Column) -> Column:
    """Trimmed and in lower case; null is blank."""
    return F.lower(F.trim(or_blank(c)))


def collapsed(c: Column) -> Column:
    """As normalized, with each run of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(or_blank(c), r"\s+", " ")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    """A number, or null where the text isn't one."""
    return F.trim(c).try_cast("double")


def plain_field_name(c: Column) -> Column:
    """A column's name without the suffixes of nested tables."""
    return F.regexp_replace(F.regexp_replace(c, "_nesttab$", ""), "_tab$", "")


def sample_name(c: Column) -> Column:
    """Spaces as underscores, and only letters, digits, underscores and hyphens."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", "")


def identifier(c: Column) -> Column:
    """Everything that isn't a letter, digit, underscore or hyphen as an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def doi(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, DOI, 1), F.lit(""))


def tagged_json(c: Column, tag: str = "output") -> Column:
    """The JSON object between a pair of tags, as text; null if there is none."""
    return F.nullif(F.regexp_extract(c, rf"(?s)<{tag}>\s*(\{{.*\}})\s*</{tag}>", 1), F.lit(""))


def tagged_text(c: Column, tag: str = "analysis") -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def front_matter(c: Column) -> Column:
    """Struct of the fields in a leading block between lines of three hyphens, and the body behind it."""
    block = F.regexp_extract(or_blank(c), f"(?s){FRONT_MATTER}", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"])))
    return F.struct(last.alias("fields"), F.regexp_replace(or_blank(c), f"(?s){FRONT_MATTER}", "").alias("body"))


def without_grounding(c: Column) -> Column:
    """Text without region tokens, with at most one empty line in a row."""
    plain = F.regexp_replace(F.regexp_replace(or_blank(c), PLAIN_REFERENCE, ""), LINE_GROUNDING, "")
    return F.regexp_replace(plain, r"\n{3,}", "\n\n")


def pixels(value: Column, size: Column) -> Column:
    """A coordinate in 0..999 as a pixel of an axis."""
    return F.greatest(F.lit(0), F.least(size.cast("int"), F.round(value / 999 * size).cast("int")))


def point_pixels(value: Column, scale: Column, size: Column, flip_from: Column | None = None) -> Column:
    """A coordinate in points as a pixel; flip_from: the page's height where the axis points upwards."""
    points = value if flip_from is None else flip_from - value
    return F.greatest(F.lit(0), F.least(size.cast("int"), F.round(points * scale).cast("int")))


def regions(c: Column, width: Column, height: Column) -> Column:
    """Region tokens as structs (label, l, t, r, b, figure) in pixels; malformed boxes are left out."""
    labels = F.regexp_extract_all(or_blank(c), F.lit(GROUNDING), F.lit(1))
    boxes = F.regexp_extract_all(or_blank(c), F.lit(GROUNDING), F.lit(2))

    def region(label: Column, box: Column) -> Column:
        v = F.transform(F.split(box, ","), lambda x: F.trim(x).try_cast("int"))
        at = [pixels(F.get(v, F.lit(i)), width if i % 2 == 0 else height) for i in range(4)]
        name = F.lower(F.trim(label))
        figure = name.isin(*FIGURE_LABELS) & (at[2] > at[0]) & (at[3] > at[1])
        whole = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull())
        return F.when(whole, F.struct(name.alias("label"), *(x.alias(n) for x, n in zip(at, "ltrb", strict=True)), figure.alias("figure")))

    return F.filter(F.zip_with(labels, boxes, region), lambda x: x.isNotNull())


def figure_links(c: Column, page: Column, width: Column, height: Column) -> Column:
    """Markdown links of the figures that a page's region tokens name, numbered in order."""
    figures = F.filter(regions(c, width, height), lambda x: x["figure"])
    return F.transform(figures, lambda x, i: F.concat(F.lit("!["), x["label"], F.format_string("](figures/fig_p%04d_%02d.png)", page, i + 1)))


def is_caption(line: Column) -> Column:
    return or_blank(line).rlike(CAPTION)


def is_garbled(text: Column) -> Column:
    """More than five replacement characters, or a longer text of which over 40 % of the words are single letters."""
    t = or_blank(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
    bad = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return (bad > MOST_REPLACED) | ((F.length(t) > LONGER_THAN) & (single / F.greatest(F.lit(1), F.size(words)) > SINGLE_LETTERS))


def thousands(c: Column) -> Column:
    return F.coalesce(F.format_number(c, 0), F.lit("N/A"))


def shortened(c: Column, width: int = 30) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 2), F.lit(".."))).otherwise(c)


def money(c: Column) -> Column:
    """A decimal from texts like $1,234.50 or -$3.00; null where there is none."""
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(12,2)")


def ledger_date(c: Column) -> Column:
    return F.try_to_date(F.trim(c), "d-MMM-yyyy")


def receipt_name(year: Column, seq: Column, description: Column, extension: Column) -> Column:
    """Two digits of the year, three of the number, and a description of lower-case words."""
    words = F.regexp_replace(F.trim(F.regexp_replace(F.lower(description), "[^a-z0-9]+", " ")), " ", "_")
    return F.concat(F.format_string("%02d%03d", year.cast("int") % 100, seq.cast("int")), F.lit("_"), words, F.lit("."), extension)


def partition_line(locus: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("AA, "), locus, F.lit(" = "), start.cast("string"), F.lit("-"), end.cast("string"))


def name_faults(c: Column) -> Column:
    """Which rules for sample names a name breaks."""
    rules = [
        (~c.rlike(r"^[A-Za-z0-9_-]*$"), "characters"),
        (F.length(c) >= 50, "length"),
        (c.rlike(r"^\d"), "leading digit"),
        (~c.rlike(r"^[A-Za-z]+\d+_[A-Za-z]+_"), "shape"),
    ]
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)), lambda x: x.isNotNull())


def words_in(c: Column) -> Column:
    return F.filter(F.split(F.lower(or_blank(c)), r"[^\p{L}]+"), lambda w: w != "")


# Frequent words by which a text's language is told.
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "nicht", "mit", "von", "den", "ist", "im", "zu", "sich"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "with", "for", "was", "by", "are"),
    "es": ("el", "la", "de", "que", "los", "del", "una", "por", "con", "para", "se", "las"),
    "fr": ("le", "la", "les", "des", "et", "une", "est", "dans", "pour", "que", "du", "qui"),
    "it": ("il", "di", "che", "la", "per", "una", "sono", "della", "con", "non", "gli", "nel"),
    "la": ("et", "in", "est", "non", "ad", "cum", "sed", "quae", "ut", "qui", "ex", "ab"),
    "pt": ("o", "de", "que", "os", "uma", "para", "com", "do", "da", "em", "as", "um"),
}


def language(c: Column, least: int = 40) -> Column:
    """The language most of whose frequent words occur; null for texts under least characters or without any."""
    words = words_in(c)

    def hits(own: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    votes = F.array(*(F.struct(hits(own).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, own) in enumerate(sorted(LANGUAGE_WORDS.items()))))
    best = F.array_max(votes)
    return F.when((F.length(F.trim(or_blank(c))) >= least) & (best["n"] > 0), best["code"])
