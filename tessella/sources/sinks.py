"""Writing results: one function for each kind of file."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.nodes import filled_columns

# The parts of the smallest workbook.
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_ROWS = 1 << 20


def united(frames: list[DataFrame]) -> DataFrame:
    """All rows under the sorted union of all columns; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("sep", separator).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """The form in which other languages read frames."""
    df.write.mode("overwrite").parquet(path)


def bounded(df: DataFrame, most_rows: int) -> None:
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")


def write_pickle(df: DataFrame, path: str, most_rows: int) -> None:
    """A pandas pickle of a table that is known to be small."""
    bounded(df, most_rows)
    df.toPandas().to_pickle(path)


def write_sqlite(df: DataFrame, path: str, table: str = "extracted_data", at_once: int = 10_000, most_rows: int = 50_000_000) -> None:
    """Replaces a table of a SQLite file, which one process writes: rows pass through the driver one partition at a time, most_rows of them at most."""
    bounded(df, most_rows)
    names = df.columns
    text = df.select(*(F.col(f"`{c}`") if dict(df.dtypes)[c] in ("bigint", "int", "double", "string", "boolean", "float") else F.col(f"`{c}`").cast("string").alias(c) for c in names))
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in names)
    db = sqlite3.connect(path)
    with db:
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" ({quoted})')
        held = []
        for row in text.toLocalIterator():
            held.append(tuple(row))
            if len(held) >= at_once:
                db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', held)
                held = []
        db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', held)
    db.close()


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def upload_batch(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns in the upload's order, without those that are blank in every row."""
    filled = set(filled_columns(df))
    return df.select(*(c for c in order if c in filled))


def batch_metadata(batches: DataFrame, depth: str = "depth", ref: str = "parent_ref") -> DataFrame:
    """One JSON text: rows and pending references of each batch."""
    rows = batches.groupBy(depth).agg(F.count("*").alias("rows"), F.count_if(F.startswith(F.coalesce(ref, F.lit("")), F.lit("__PENDING_"))).alias("pending"))
    return rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(depth, "rows", "pending"))).alias("batches"), F.sum("pending").alias("pending"))).alias("metadata"))


def annotation_template(df: DataFrame, key: str, data: str) -> DataFrame:
    """Per paper what was extracted beside an empty truth."""
    empty = F.lit(None).cast("string")
    return df.select(key, F.to_json(F.struct(F.col(data).alias("automated_extraction"), empty.alias("ground_truth"), F.lit("").alias("notes"), F.lit("").alias("annotator"), F.lit("").alias("annotation_date")), {"ignoreNullFields": "false"}).alias("template"))


def mapping_template(files: DataFrame, name: str = "name") -> DataFrame:
    """Lines of a renaming table to fill in."""
    return files.select(F.concat_ws("\t", F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_replace(name, r"\.[^.]*$", "")).alias("line"))


def profile_lists(scores: DataFrame, by: list[str], pos: str, score: str) -> DataFrame:
    """Positions (from 1) whose score is below 0, as one line for each locus."""
    low = scores.where(F.col(score) < 0).groupBy(*by).agg(F.sort_array(F.collect_list(F.col(pos) + 1)).alias("_p"))
    return low.select(*by, F.array_join("_p", " ").alias("positions"))




def column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_sheet(rows: DataFrame, path: str, most_rows: int = SHEET_ROWS) -> str:
    """An XLSX file of (row_no, cells: texts by column number); a sheet holds no more than SHEET_ROWS rows. Returns the path."""
    bounded(rows, most_rows)
    held = io.BytesIO()
    relation = lambda n, kind, target: f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId{n}" Type="{OFFICE}/{kind}" Target="{target}"/></Relationships>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        types = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/>'
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types">{types}</Types>')
        z.writestr("_rels/.rels", relation(1, "officeDocument", "xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", relation(1, "worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET_NS}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{SHEET_NS}"><sheetData>'.encode())
            for r in rows.select("row_no", "cells").orderBy("row_no").toLocalIterator():
                cells = "".join(f'<c r="{column_letters(c)}{r.row_no}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in sorted((r.cells or {}).items()) if v is not None)
                out.write(f'<row r="{r.row_no}">{cells}</row>'.encode())
            out.write(b"</sheetData></worksheet>")
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    return path


def insert_column(sheet: DataFrame, values: DataFrame, row: str, value: str, after: int, heading: str, heading_row: int) -> DataFrame:
    """A sheet's rows (row_no, cells) with a column behind column after: its heading, and values by row number; cells to the right move on."""
    given = values.select(F.col(row).cast("int").alias("row_no"), F.col(value).cast("string").alias("_value"))
    moved = F.transform_keys("cells", lambda k, _: F.when(k > after, k + 1).otherwise(k))
    new = F.when(F.col("row_no") == heading_row, F.lit(heading)).otherwise(F.col("_value"))
    added = F.when(new.isNotNull(), F.create_map(F.lit(after + 1), new)).otherwise(F.create_map().cast("map<int,string>"))
    return sheet.join(given, "row_no", "left").select("row_no", F.map_concat(moved, added).alias("cells"))


def carry_out(plan: DataFrame, folder: str) -> int:
    """Renames files in a folder as rename_plan says (rows of status rename); returns how many. Files are as many as a person names."""
    spark = plan.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for r in plan.where("status = 'rename'").toLocalIterator():
        if not fs.rename(path(f"{folder}/{r.source}"), path(f"{folder}/{r.target}")):
            raise OSError(f"{r.source} can't be renamed to {r.target}")
        n += 1
    return n


def copied(spark, sources: list[str], folder: str) -> list[str]:
    """Copies of files in a folder, under their own names."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    made = []
    for at in sources:
        target = f"{folder}/{at.rsplit('/', 1)[-1]}"
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(path(at).getFileSystem(conf), path(at), path(target).getFileSystem(conf), path(target), False, True, conf)
        made.append(target)
    return made


def profile_svg(scores: DataFrame, by: list[str], pos: str, score: str, height: int = 100, step: int = 2) -> DataFrame:
    """A drawing of each locus: a line through its positions' scores (from 0 below to 1 above)."""
    point = F.concat((F.col(pos) * step).cast("string"), F.lit(","), F.round(height - F.col(score) * height).cast("int").cast("string"))
    rows = scores.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), point.alias("p")))).alias("_p"), F.max(F.col(pos)).alias("_last"))
    path = F.concat(F.lit("M"), F.array_join(F.transform("_p", lambda x: x["p"]), " L"))
    width = ((F.col("_last") + 1) * step).cast("string")
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), width, F.lit(f'" height="{height}"><path fill="none" stroke="black" d="'))
    return rows.select(*by, F.concat(head, path, F.lit('"/></svg>')).alias("svg"))
