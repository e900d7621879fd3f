"""Pages of documents: signals and verdict, languages, captions, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import CAPTION, OCR_FONTS, is_caption, is_garbled, or_blank

FULL_IMAGE, LITTLE_TEXT = 0.85, 100


def page_signals(df: DataFrame, doc: str, text: str, fonts: str | None = None, image_share: str | None = None) -> DataFrame:
    """Counters of each document's sampled pages."""
    names = F.col(fonts) if fonts else F.array(F.lit("Body"))
    marked = F.exists(names, lambda f: F.coalesce(f.rlike("|".join(OCR_FONTS)), F.lit(False)))
    share = F.coalesce(F.col(image_share), F.lit(0.0)) if image_share else F.lit(0.0)
    return df.groupBy(doc).agg(
        F.count("*").alias("sampled_pages"),
        F.count_if(marked).alias("ocr_font_pages"),
        F.count_if(F.size(names) == 0).alias("empty_font_pages"),
        F.count_if(share >= FULL_IMAGE).alias("full_image_pages"),
        F.count_if(is_garbled(F.col(text))).alias("suspicious_text_pages"),
        F.round(F.avg(F.length(F.trim(or_blank(F.col(text))))), 1).alias("avg_text_chars"),
    )


def verdict(n: Column, ocr: Column, empty: Column, image: Column, garbled: Column, chars: Column) -> Column:
    """Why a document needs text recognition, or that it is born digital; the first rule that holds."""
    return (
        F.when(ocr >= F.greatest(F.lit(1), F.floor(n / 3)), "OCR-marker fonts present")
        .when(empty == n, "no embedded fonts on any sampled page")
        .when(image >= F.greatest(F.lit(2.0), 0.4 * n), "body pages contain page-sized images (scanned)")
        .when(chars < LITTLE_TEXT, "very little extractable text")
        .when(garbled >= F.greatest(F.lit(1), F.floor(n / 2)), "extracted text looks garbled")
        .otherwise("born-digital text layer")
    )


def classified(signals: DataFrame) -> DataFrame:
    reason = verdict(*(F.col(c) for c in ("sampled_pages", "ocr_font_pages", "empty_font_pages", "full_image_pages", "suspicious_text_pages", "avg_text_chars")))
    return signals.withColumn("reason", reason).withColumn("is_digital", F.col("reason") == "born-digital text layer")


def language_sampled(page: Column, pages: Column, first: int = 10, total: int = 20) -> Column:
    """Whether a page's language is looked at: the first ones, then evenly spaced ones."""
    step = F.greatest(F.lit(1), F.floor((pages - first) / (total - first)))
    return (page < first) | (((page - first) % step) == 0)


def filled(df: DataFrame, doc: str, page: str, value: str, name: str = "filled") -> DataFrame:
    """The last known value up to each page; pages before the first known one take that."""
    w = Window.partitionBy(doc).orderBy(page)
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Only pages before the first known one need it, and theirs is the document's first; a frame from each page on would be read again for each.
    backward = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(forward, backward))


def ranges(df: DataFrame, doc: str, page: str, value: str) -> DataFrame:
    """Neighbouring pages of one value as (doc, value, first_page, last_page, pages)."""
    w = Window.partitionBy(doc).orderBy(page)
    change = (~F.equal_null(F.col(value), F.lag(value).over(w))).cast("int")
    rows = df.withColumn("_change", F.when(F.row_number().over(w) == 1, 1).otherwise(change))
    rows = rows.withColumn("_island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(doc, "_island", value).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page")).select(
        doc, value, "first_page", "last_page", F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string"))).alias("pages")
    )


def primary(df: DataFrame, doc: str, page: str, value: str) -> DataFrame:
    """The most frequent known value of each document; of several, the one met first."""
    votes = df.where(F.col(value).isNotNull()).groupBy(doc, value).agg(F.count("*").alias("n"), F.min(page).alias("first"))
    return votes.groupBy(doc).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(f"primary_{value}"))


def paired(left: DataFrame, right: DataFrame, by: str, order: str, left_value: str, right_value: str) -> DataFrame:
    """The k-th of one side with the k-th of the other; what is left over stands alone."""
    w = Window.partitionBy(by).orderBy(order)
    a = left.select(by, F.row_number().over(w).alias("k"), F.col(left_value).alias("left_value"))
    b = right.select(by, F.row_number().over(w).alias("k"), F.col(right_value).alias("right_value"))
    return a.join(b, [by, "k"], "full")


def with_figures(text: Column, figures: Column) -> Column:
    """Each figure above a caption line, in order; those left over at the end."""
    lines = F.split(or_blank(text), "\n", -1)
    captions = F.filter(F.transform(lines, lambda x, i: F.when(is_caption(x), i)), lambda i: i.isNotNull())
    used = F.least(F.size(captions), F.size(figures))

    def line(x: Column, i: Column) -> Column:
        k = F.array_position(captions, i)
        return F.when((k > 0) & (k <= used), F.concat(F.get(figures, k.cast("int") - 1), F.lit("\n\n"), x)).otherwise(x)

    body = F.trim(F.array_join(F.transform(lines, line), "\n"), F.lit(" \n\t\r"))
    rest = F.slice(figures, used + 1, F.greatest(F.lit(0), F.size(figures) - used))
    joined = F.array_join(figures, "\n\n")
    return F.when(F.size(figures) == 0, F.trim(or_blank(text), F.lit(" \n\t\r"))).when(or_blank(text) == "", joined).when(F.size(rest) > 0, F.concat(body, F.lit("\n\n"), F.array_join(rest, "\n\n"))).otherwise(body)


def large_enough(width: Column, height: Column, least: int = 32) -> Column:
    return (width >= least) & (height >= least)


def proper_box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return (right > left) & (bottom > top)


def page_sized(areas: Column, page: Column, share: float = 0.7) -> Column:
    """Whether any image covers more than this share of its page."""
    return F.exists(areas, lambda a: a > share * page)


def stitched(df: DataFrame, doc: str, page: str, text: str, head: Column | None = None) -> DataFrame:
    """One text of each document: pages in order, each under its number, between rules."""
    w = Window.partitionBy(doc).orderBy(page)
    rows = df.withColumn("_n", F.row_number().over(w))
    block = F.concat(F.lit("<!-- page "), F.col("_n").cast("string"), F.lit(" -->\n\n"), F.trim(or_blank(F.col(text))))
    parts = F.sort_array(F.collect_list(F.struct("_n", block.alias("b"))))
    made = rows.groupBy(doc).agg(parts.alias("_parts"), F.count("*").alias("pages"))
    body = F.array_join(F.transform("_parts", lambda x: x["b"]), "\n\n---\n\n")
    front = F.concat(F.lit("---\nsource: "), F.col(doc).cast("string"), F.lit("\npages: "), F.col("pages").cast("string"), F.lit("\n---\n\n"))
    return made.select(doc, "pages", F.concat(front if head is None else head, body).alias("markdown"))


__all__ = ["CAPTION", "classified", "filled", "language_sampled", "large_enough", "page_signals", "page_sized", "paired", "primary", "proper_box", "ranges", "stitched", "verdict", "with_figures"]
