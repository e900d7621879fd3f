"""Tables of records: CSV exports, sheets, JSON results, JSON lines, mappings, listings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.shipping import ship
from tessella.functions.text import blank_to_null, doi, identifier, number
from tessella.sources.split import numbered_records, records, with_heads

# An export's columns, what they are called here, and which are numbers.
EXPORT_COLUMNS = {
    "irn": "irn",
    "LocContinent": "continent",
    "LocCountry": "country",
    "LocProvinceStateTerritory": "province",
    "LocDistrictCountyShire": "district",
    "LocTownship": "township",
    "LocPreciseLocation": "locality",
    "LocElevationASLFromMt": "elevation_from_m",
    "LocElevationASLToMt": "elevation_to_m",
    "LocElevationASLFromFt": "elevation_from_ft",
    "LocElevationASLToFt": "elevation_to_ft",
    "LatLatitude": "lat",
    "LatLongitude": "lon",
    "LatLatitudeText": "lat_text",
    "LatLongitudeText": "lon_text",
    "SitSiteNumber": "site_number",
}
EXPORT_NUMBERS = ("elevation_from_m", "elevation_to_m", "elevation_from_ft", "elevation_to_ft", "lat", "lon")
PAPER = "id string, type string, title string, year string, doi string, abstract string, journal string, authors string, keywords string, pdf_path string"


def read_export(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A CSV export: known columns under their names here, blanks as null, numbers parsed; short rows get nulls."""
    columns = columns or EXPORT_COLUMNS
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}
    cell = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")
    made = [(number(cell(c)) if n in EXPORT_NUMBERS else blank_to_null(cell(c))).alias(n) for c, n in columns.items()]
    return raw.select(*made)


def read_sheet_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_sheets(spark: SparkSession, *paths: str) -> DataFrame:
    """The first sheet of XLSX files as rows (path, row_no, cells, fills): texts and fill colours by column number."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.map_(pa.int32(), pa.string()), pa.map_(pa.int32(), pa.string())]
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(path, row, [*cells.items()], [*fills.items()]) for row, cells, fills in sheet_rows(io.BytesIO(content))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "row_no", "cells", "fills"])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "path string, row_no int, cells map<int,string>, fills map<int,string>")


def sheet_rows(file) -> Iterator[tuple[int, dict[int, str], dict[int, str]]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns):
                strings.append("".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")))
        colours = []
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            fills = []
            for f in root.findall("m:fills/m:fill", ns):
                fg = f.find("m:patternFill/m:fgColor", ns)
                fills.append(fg.get("rgb") if fg is not None else None)
            colours = [fills[int(x.get("fillId", 0))] if int(x.get("fillId", 0)) < len(fills) else None for x in root.findall("m:cellXfs/m:xf", ns)]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ElementTree.fromstring(z.read(sheet)).findall("m:sheetData/m:row", ns):
            cells, fills = {}, {}
            for c in row.findall("m:c", ns):
                column = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A1"))[0]:
                    column = column * 26 + ord(letter) - 64
                style = int(c.get("s", 0))
                if style < len(colours) and colours[style]:
                    fills[column] = colours[style]
                value, inline = c.find("m:v", ns), c.find("m:is", ns)
                if inline is not None:
                    text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = strings[int(value.text)] if c.get("t") == "s" else value.text
                cells[column] = text
            yield int(row.get("r")), cells, fills


def is_green(rgb: str) -> bool:
    """Whether an ARGB colour's green outweighs the others."""
    if not re.fullmatch(r"[0-9A-Fa-f]{8}", rgb or ""):
        return False
    r, g, b = (int(rgb[i : i + 2], 16) for i in (2, 4, 6))
    return g > r and g > b


def site_columns(rows: DataFrame, known: list[str]) -> dict[int, str]:
    """Columns of a sheet that hold site fields: green in the first two rows, or with a known name in the second."""
    head = {r.row_no: r for r in rows.where("row_no <= 2").collect()}
    names = {c: re.sub("_tab$", "", re.sub("_nesttab$", "", v.strip())) for c, v in (head[2].cells if 2 in head else {}).items() if v}
    green = {c for r in head.values() for c, rgb in (r.fills or {}).items() if is_green(rgb)}
    return {c: n for c, n in names.items() if c in green or n in known}


def sheet_records(rows: DataFrame, columns: dict[int, str], first_row: int = 4, coordinates: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Rows with any site value: row_no and the columns as text; whole numbers lose '.0' except in coordinates."""
    plain = lambda c: F.regexp_replace(c, r"^(-?\d+)\.0+$", "$1")
    cell = lambda k, n: blank_to_null(F.try_element_at("cells", F.lit(k)) if n in coordinates else plain(F.try_element_at("cells", F.lit(k)))).alias(n)
    made = rows.where(F.col("row_no") >= first_row).select("row_no", *(cell(k, n) for k, n in columns.items()))
    return made.where(F.coalesce(*columns.values()).isNotNull()) if columns else made.limit(0)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of results by id as rows (id, result as JSON text)."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    return whole.select(F.explode(entries).alias("id", "result"))


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that can't be read."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*full.fields]).add("_corrupt", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    names = [f"r.`{n}`" for n in full.names if n != "_corrupt"]
    return parsed.where(~bad).select(*names), parsed.where(bad).select("value")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Two tab-separated columns; comments, blanks and other arities are left out, of repeated keys the last line wins."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    parts = F.split(F.trim("line"), "\t", -1)
    pairs = lines.where(F.size(parts) == 2).select("n", F.trim(parts[0]).alias("old_name"), F.trim(parts[1]).alias("new_name"))
    return pairs.groupBy("old_name").agg(F.max_by("new_name", "n").alias("new_name"))


def rename_plan(files: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """What a renaming would do: rename, unmapped, same or collision (two sources or an existing file under one target)."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    rows = files.select(F.col(name).alias("source"), stem.alias("old_name"), ext.alias("_ext")).join(mapping, "old_name", "left")
    rows = rows.withColumn("target", F.concat("new_name", "_ext"))
    times = rows.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("_times"))
    there = files.select(F.col(name).alias("target"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(times, "target", "left").join(there, "target", "left")
    clash = (F.col("_times") > 1) | (F.col("_there") & (F.col("target") != F.col("source")))
    status = F.when(F.col("target").isNull(), "unmapped").when(F.col("target") == F.col("source"), "same").when(clash, "collision").otherwise("rename")
    return rows.select("source", "target", status.alias("status"))


def read_files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """Paths and sizes of files with one of the suffixes, in any case, at any depth."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return listed.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*(s.lower() for s in suffixes)))


def file_kinds(files: DataFrame) -> DataFrame:
    """pdf, image or other by suffix."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kind = F.when(suffix == ".pdf", "pdf").when(suffix.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"), "image").otherwise("other")
    return files.withColumn("kind", kind)


def receipt_files(files: DataFrame) -> DataFrame:
    """Receipt number (five digits before an underscore) of each file, null for those without."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.nullif(F.regexp_extract(name, r"^(\d{5})_", 1), F.lit("")).alias("receipt_number"))


def papers_from_files(files: DataFrame) -> DataFrame:
    """Paper metadata from the names of PDF files."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.pdf$", "")
    blank = F.lit("")
    return files.select(
        stem.alias("id"), F.lit("article").alias("type"), F.replace(stem, F.lit("_"), F.lit(" ")).alias("title"), blank.alias("year"), F.coalesce(doi(stem), blank).alias("doi"),
        blank.alias("abstract"), blank.alias("journal"), blank.alias("authors"), blank.alias("keywords"), F.col("path").alias("pdf_path"),
    )


def papers_from_dois(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("d")).where("d <> ''")
    blank = F.lit("")
    return lines.select(
        identifier(F.col("d")).alias("id"), F.lit("article").alias("type"), blank.alias("title"), blank.alias("year"), F.col("d").alias("doi"), blank.alias("abstract"),
        blank.alias("journal"), blank.alias("authors"), blank.alias("keywords"), F.lit(None).cast("string").alias("pdf_path"),
    )


def read_bibtex(spark: SparkSession, path: str, pdf_folder: str | None = None) -> DataFrame:
    """One paper for each BibTeX entry; authors as 'Last First', the PDF from the file field's first PDF part.

    A file is read in splits, an entry ends before a line that begins with an at sign. What stands before a file's first entry is left out.
    """
    # A record lacks the at sign that began it, other than a file's first one; entries whose at sign is indented are cut here.
    rows = with_heads(records(spark, path, "\n@"))
    body = F.concat(F.when(F.col("at") == F.col("head"), F.lit("\n")).otherwise(F.lit("\n@")), "value")
    entries = rows.select(F.posexplode(F.split(body, r"\n\s*@")).alias("n", "entry")).where("n > 0")
    name = lambda f: F.regexp_replace(F.trim(F.regexp_extract("entry", rf"(?is)[,\n]\s*{f}\s*=\s*[{{\"](.*?)[}}\"]\s*(?:,\s*\n|\n\s*\}}|\}}\s*$)", 1)), r"[{}]", "")
    people = F.filter(F.split(F.regexp_replace(name("author"), r"\s+", " "), " and "), lambda x: F.trim(x) != "")

    def person(x):
        cut = F.split(F.trim(x), r",\s*")
        words = F.split(F.trim(x), " ")
        turned = F.concat_ws(" ", F.element_at(words, -1), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        return F.trim(F.when(F.size(cut) > 1, F.concat_ws(" ", cut[0], cut[1])).otherwise(turned))

    parts = F.transform(F.split(name("file"), ";"), lambda x: F.split(F.trim(x), ":"))
    pdf = F.get(F.filter(parts, lambda p: (F.size(p) >= 3) & (F.lower(F.get(p, F.lit(2))) == "application/pdf")), F.lit(0))[1]
    at = F.trim(pdf) if pdf_folder is None else F.concat(F.lit(pdf_folder.rstrip("/") + "/"), F.trim(pdf))
    return entries.select(
        F.trim(F.regexp_extract("entry", r"^\w+\s*\{\s*([^,\s]+)", 1)).alias("id"), F.lower(F.regexp_extract("entry", r"^(\w+)", 1)).alias("type"),
        *(name(f).alias(f) for f in ("title", "year", "doi", "abstract", "journal")), F.array_join(F.transform(people, person), ", ").alias("authors"), name("keywords").alias("keywords"), at.alias("pdf_path"),
    ).where("id <> ''")


def read_ris(spark: SparkSession, path: str, pdfs: DataFrame | None = None) -> DataFrame:
    """One paper for each RIS entry; id from the first author's last word, the year and the entry's number.

    pdfs has (path): a paper's file is looked for as id, author_year, then its DOI.
    """
    # A record begins with the rest of the line that ended the one before it.
    rows = numbered_records(spark, path, "\nER  -")
    entries = rows.select("n", F.when(F.col("n") > 0, F.regexp_replace("value", r"^[^\n]*", "")).otherwise(F.col("value")).alias("entry")).where(F.col("entry").rlike(r"(?m)^TY  -"))
    every = lambda *tags: F.regexp_extract_all("entry", F.lit(rf"(?m)^(?:{'|'.join(tags)})  - *(.*?)\s*$"), F.lit(1))
    one = lambda *tags: F.coalesce(F.get(every(*tags), F.lit(0)), F.lit(""))
    year = F.regexp_extract(one("PY", "Y1"), r"(\d{4})", 1)
    last = F.element_at(F.split(F.when(one("AU", "A1") == "", "Unknown").otherwise(one("AU", "A1")), r"\s+"), -1)
    key = F.concat(last, F.when(year == "", "NoYear").otherwise(year))
    rows = entries.select(
        F.concat(key, F.lit("_"), F.col("n").cast("string")).alias("id"), one("TY").alias("type"), one("TI", "T1").alias("title"), year.alias("year"), one("DO").alias("doi"),
        one("AB", "N2").alias("abstract"), one("JO", "T2", "JF").alias("journal"), F.array_join(every("AU", "A1"), "; ").alias("authors"), F.array_join(every("KW"), "; ").alias("keywords"),
        F.concat(last, F.lit("_"), F.when(year == "", "NoYear").otherwise(year)).alias("_second"),
    )
    if pdfs is None:
        return rows.drop("_second").withColumn("pdf_path", F.lit(None).cast("string"))
    named = pdfs.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.pdf$", "").alias("_stem"))
    tries = F.array(F.struct(F.lit(0).alias("k"), F.col("id").alias("_stem")), F.struct(F.lit(1).alias("k"), F.col("_second").alias("_stem")), F.struct(F.lit(2).alias("k"), identifier(F.col("doi")).alias("_stem")))
    found = rows.select("id", F.explode(tries).alias("t")).select("id", "t.*").where("_stem <> ''").join(named, "_stem").groupBy("id").agg(F.min_by("path", "k").alias("pdf_path"))
    return rows.drop("_second").join(found, "id", "left")


def read_yaml(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A list of maps under a key of a small YAML file."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(yaml.safe_load(text)[key], schema)
