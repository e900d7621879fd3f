"""Queries that write a table in the form a reader expects and read it back, and sinks that are read again."""

from __future__ import annotations

import os
import sqlite3
import tempfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import models, scoring, sequences
from tessella.plans.registry import T, query
from tessella.sources import records, sinks
from tessella.sources import sequences as files
from tessella.sources.scratch import stored, work_folder, write_text


def lines(df, column: str, name: str, one_file: bool = False) -> str:
    """Rows of text in a fresh folder; one_file: for forms whose meaning lies in the order of lines."""
    at = work_folder(df.sparkSession, name)
    sinks.write_lines(df.coalesce(1) if one_file else df, at, column)
    return at


# ---- sources


@query("""SELECT c_custkey::VARCHAR AS irn, CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment END AS continent, c_name AS country, CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal / 1000, 3) END AS lat,
                 c_nationkey::DOUBLE AS lon, c_custkey % 2 AS blank_row FROM customer""")
def export_read(s, d):
    lat = F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit(" "), F.round(F.col("c_acctbal") / 1000, 3).cast("string"))).otherwise("n/a")
    rows = T(s, d, "customer").select(
        F.col("c_custkey").cast("string").alias("irn"), F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("  ").alias("LocContinent"), F.col("c_name").alias("LocCountry"),
        lat.alias("LatLatitude"), F.col("c_nationkey").cast("string").alias("LatLongitude"), F.lit("not known here").alias("Other"),
    )
    at = work_folder(s, "export")
    sinks.write_csv(rows, at)
    made = records.read_export(s, at)
    return made.select("irn", "continent", "country", "lat", "lon", (F.col("irn").cast("long") % 2).alias("blank_row"))


@query("""SELECT s_suppkey + 4 AS row_no, s_suppkey::VARCHAR AS key, CASE WHEN s_nationkey % 4 > 0 THEN s_name END AS site, s_nationkey::VARCHAR AS country FROM supplier""")
def sheet_read(s, d):
    head = s.createDataFrame([(1, {1: "export", 2: "", 3: ""}), (2, {1: "key", 2: "Site_tab", 3: "country", 4: "notes"})], "row_no long, cells map<int,string>")
    key, site, nation = F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") % 4 > 0, F.col("s_name")).otherwise(" "), F.concat(F.col("s_nationkey").cast("string"), F.lit(".0"))
    body = T(s, d, "supplier").select((F.col("s_suppkey") + 4).alias("row_no"), F.create_map(F.lit(1), key, F.lit(2), site, F.lit(3), nation, F.lit(4), F.lit("x")).alias("cells"))
    at = sinks.write_sheet(head.unionByName(body), f"{work_folder(s, 'sheet')}/given.xlsx")
    rows = records.read_sheets(s, at)
    return records.sheet_records(rows, records.site_columns(rows, ["key", "Site", "country"])).select(F.col("row_no").cast("long").alias("row_no"), "key", F.col("Site").alias("site"), "country")


@query("""SELECT s_suppkey + 4 AS row_no, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'irn-' || s_suppkey END AS irn FROM supplier""")
def sheet_backfill(s, d):
    supplier = T(s, d, "supplier")
    rows = supplier.select((F.col("s_suppkey") + 4).alias("row_no"), F.create_map(F.lit(1), F.col("s_name"), F.lit(2), F.lit("note")).alias("cells"))
    head = s.createDataFrame([(1, {1: "names"}), (3, {1: "name", 2: "notes"})], "row_no long, cells map<int,string>")
    given = sinks.write_sheet(head.unionByName(rows), f"{work_folder(s, 'sheet')}/given.xlsx")
    ids = supplier.where("s_nationkey % 2 = 0").select((F.col("s_suppkey") + 4).alias("row_no"), F.concat(F.lit("irn-"), "s_suppkey").alias("irn"))
    made = sinks.insert_column(records.read_sheets(s, given), ids, "row_no", "irn", after=1, heading="irn", heading_row=3)
    back = records.read_sheets(s, sinks.write_sheet(made, f"{work_folder(s, 'sheet')}/filled.xlsx")).where("row_no >= 4")
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return back.select(F.col("row_no").cast("long").alias("row_no"), cell(1).alias("name"), text.blank_to_null(cell(2)).alias("irn"))


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer")
def sheet_csv(s, d):
    at = work_folder(s, "sheet-csv")
    sinks.write_csv(T(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return records.read_sheet_csv(s, at, "key long, name string, balance double")


@query("""SELECT 'key' || s_suppkey AS id, 'article' AS type, 'On ' || s_name AS title, (1900 + s_suppkey % 120)::VARCHAR AS year, '10.1234/s' || s_suppkey AS doi, 'Last' || s_suppkey || ' First, Van Other Person' AS authors,
                 CASE WHEN s_suppkey % 2 = 0 THEN '/pdfs/a' || s_suppkey || '.pdf' ELSE '/pdfs/' END AS pdf_path FROM supplier""")
def bibtex_read(s, d):
    n = F.col("s_suppkey").cast("string")
    file = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(",\n  file = {Full Text:a"), n, F.lit(".pdf:application/pdf}"))).otherwise("")
    entry = F.concat(F.lit("@Article{key"), n, F.lit(",\n  title = {On {"), "s_name", F.lit("}},\n  year = {"), (1900 + F.col("s_suppkey") % 120).cast("string"), F.lit("},\n  doi = {10.1234/s"), n, F.lit("},\n  author = {Last"), n, F.lit(", First and Other Person Van}"), file, F.lit("\n}\n"))
    made = records.read_bibtex(s, lines(T(s, d, "supplier").select(entry.alias("line")), "line", "bibtex"), "/pdfs")
    return made.select("id", "type", "title", "year", "doi", "authors", F.coalesce("pdf_path", F.lit("/pdfs/")).alias("pdf_path"))


@query("""SELECT 'JOUR' AS type, 'On ' || s_name AS title, (1900 + s_suppkey % 120)::VARCHAR AS year, CASE WHEN s_suppkey % 3 > 0 THEN '10.1234/s' || s_suppkey ELSE '' END AS doi, 'Ann Person' || s_suppkey || '; Bo Second' AS authors,
                 'one; two' AS keywords, 'Person' || s_suppkey || (1900 + s_suppkey % 120) AS id_stem, CASE WHEN s_suppkey % 4 = 0 THEN '/pdfs/Person' || s_suppkey || '_' || (1900 + s_suppkey % 120) || '.pdf' END AS pdf_path FROM supplier""")
def ris_read(s, d):
    n, year = F.col("s_suppkey").cast("string"), (1900 + F.col("s_suppkey") % 120).cast("string")
    do = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("\nDO  - 10.1234/s"), n)).otherwise("")
    entry = F.concat(F.lit("TY  - JOUR\nAU  - Ann Person"), n, F.lit("\nAU  - Bo Second\nTI  - On "), "s_name", F.lit("\nPY  - "), year, F.lit("/05/01"), do, F.lit("\nKW  - one\nKW  - two\nER  - \n"))
    pdfs = T(s, d, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("/pdfs/Person"), n, F.lit("_"), year, F.lit(".pdf")).alias("path"))
    made = records.read_ris(s, lines(T(s, d, "supplier").select(entry.alias("line")), "line", "ris"), pdfs)
    return made.select("type", "title", "year", "doi", "authors", "keywords", F.regexp_replace("id", r"_\d+$", "").alias("id_stem"), "pdf_path")


def small_files(s, d, suffixes: tuple[str, ...]) -> str:
    """One file for each nation, its suffix by turns."""
    at = work_folder(s, "files")
    for r in T(s, d, "nation").collect():
        write_text(s, f"{at}/more/{10000 + r.n_nationkey}_{r.n_name}_10.1234%{r.n_nationkey}{suffixes[r.n_nationkey % len(suffixes)]}", r.n_name * (r.n_nationkey + 1))
    return at


@query("SELECT 10000 + n_nationkey || '_' || n_name || '_10.1234%' || n_nationkey AS id, 'article' AS type, replace(10000 + n_nationkey || '_' || n_name || '_10.1234%' || n_nationkey, '_', ' ') AS title, '' AS doi FROM nation WHERE n_nationkey % 3 < 2")
def folder_papers(s, d):
    found = records.read_files(s, small_files(s, d, (".pdf", ".PDF", ".txt")), [".pdf"])
    return records.papers_from_files(found).select("id", "type", "title", "doi")


@query("""SELECT 10000 + n_nationkey || '_' || n_name || '_10.1234%' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.Jpeg' ELSE '.txt' END AS name, length(n_name) * (n_nationkey + 1) AS length,
                 CASE n_nationkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' ELSE 'other' END AS kind, (10000 + n_nationkey)::VARCHAR AS receipt_number FROM nation""")
def file_scan(s, d):
    found = records.file_kinds(records.read_files(s, small_files(s, d, (".pdf", ".Jpeg", ".txt")), [".pdf", ".jpeg", ".txt"]))
    made = found.join(records.receipt_files(found), "path")
    return made.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "kind", "receipt_number")


@query("SELECT '10_1234_p' || p_partkey AS id, '10.1234/p' || p_partkey AS doi, 'article' AS type FROM part")
def doi_list(s, d):
    at = lines(T(s, d, "part").select(F.concat(F.lit("  10.1234/p"), "p_partkey", F.lit("\n\n")).alias("line")), "line", "dois")
    return records.papers_from_dois(s, at).select("id", "doi", "type")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def results_map(s, d):
    entry = F.struct(F.col("s_suppkey").cast("string").alias("key"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("value"))
    # One object of all results is what this form is; the rows of a small table.
    whole = T(s, d, "supplier").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("line"))
    made = records.read_results(s, lines(whole, "line", "results", True))
    return made.select("id", F.get_json_object("result", "$.name").alias("name"), F.get_json_object("result", "$.nation").cast("int").alias("nation"))


@query("""SELECT CASE WHEN event_id % 10 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::INT END AS k, CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def json_lines(s, d):
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{\"k\": "), "event_type")).otherwise(F.col("props"))
    good, bad = records.read_json_lines(s, lines(T(s, d, "events").select(line.alias("line")), "line", "lines"), "k int")
    both = good.select("k", F.lit("good").alias("kind")).unionByName(bad.select(F.lit(None).cast("int").alias("k"), F.lit("bad").alias("kind")))
    return both.groupBy("k", "kind").agg(F.count("*").alias("n"))


def renaming(s, d):
    n, key = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    line = F.when(key % 5 == 0, F.concat(F.lit("# "), n, F.lit("\tnothing"))).when(key % 5 == 1, F.concat(F.lit("f"), n)).when(key % 5 == 2, F.concat(F.lit("f"), n, F.lit("\tshared"))).when(key % 5 == 3, F.concat(F.lit("f"), n, F.lit("\tf"), n)).otherwise(F.concat(F.lit(" f"), n, F.lit("\tnew"), n))
    return records.read_mapping(s, lines(T(s, d, "supplier").select(line.alias("line")), "line", "mapping", True))


@query("""SELECT 'f' || s_suppkey || '.txt' AS source, CASE s_suppkey % 5 WHEN 2 THEN 'shared.txt' WHEN 3 THEN 'f' || s_suppkey || '.txt' WHEN 4 THEN 'new' || s_suppkey || '.txt' END AS target,
                 CASE s_suppkey % 5 WHEN 2 THEN CASE WHEN (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 2) > 1 THEN 'collision' ELSE 'rename' END WHEN 3 THEN 'same' WHEN 4 THEN 'rename' ELSE 'unmapped' END AS status FROM supplier""")
def mapping_join(s, d):
    return records.rename_plan(T(s, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit(".txt")).alias("name")), renaming(s, d))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'to' || n_nationkey ELSE 'from' || n_nationkey END || '.txt' AS name, n_name AS content FROM nation")
def files_renamed(s, d):
    at, nation = work_folder(s, "renaming"), T(s, d, "nation")
    for r in nation.collect():
        write_text(s, f"{at}/from{r.n_nationkey}.txt", r.n_name)
    mapping = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("from"), "n_nationkey").alias("old_name"), F.concat(F.lit("to"), "n_nationkey").alias("new_name"))
    there = records.read_files(s, at, [".txt"]).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    plan = stored(records.rename_plan(there, mapping), "renames")
    sinks.carry_out(plan, at)
    return s.read.text(at, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content"))


@query("SELECT p_brand AS locus, min(p_partkey)::INT AS start, max(p_partkey)::INT AS \"end\" FROM part GROUP BY p_brand")
def partition_info(s, d):
    spans = T(s, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    line = spans.select(F.lit(2).alias("n"), F.concat_ws("\t", F.concat(F.lit(" "), "p_brand"), "a", "b", F.lit("x")).alias("line"))
    head = s.createDataFrame([(0, "info\t1\t2"), (1, "name\tfrom\tto"), (3, "a\tshort line")], "n int, line string")
    return files.read_partition_info(s, lines(head.unionByName(line).orderBy("n"), "line", "partitions", True))


@query("SELECT n_name AS genome, 100 + n_nationkey AS s, n_regionkey AS d, 0::BIGINT AS f, n_nationkey AS m, round(100.0 * (100 + n_nationkey + n_regionkey) / (100 + 2 * n_nationkey + n_regionkey), 2) AS completeness FROM nation")
def quality_summaries(s, d):
    at = work_folder(s, "summaries")
    for r in T(s, d, "nation").collect():
        write_text(s, f"{at}/{r.n_name}/summary.txt", f"## lineage: x\nS:90.1%, {100 + r.n_nationkey}\nD:1.0%, {r.n_regionkey}\nM:2%,{r.n_nationkey}\nN:999\n")
    made = files.read_quality_summaries(s, at)
    return made.withColumn("completeness", sequences.completeness(*(F.col(c) for c in "sdfm")))


@query("SELECT r_name AS name, 'detail ' || r_regionkey AS detail FROM region")
def yaml_config(s, d):
    body = "".join(f"  - name: {r.r_name}\n    detail: 'detail {r.r_regionkey}'\n" for r in T(s, d, "region").collect())
    at = write_text(s, f"{work_folder(s, 'config')}/config.yaml", f"# settings\nother: 1\nfunding_sources:\n{body}")
    return records.read_yaml(s, at, "funding_sources", "name string, detail string")


@query("SELECT lang || '_' || doc_id AS header, upper(replace(regexp_replace(text, '\\s', '', 'g'), 'ß', 's')) AS seq FROM documents WHERE NOT contains(text, '>') AND regexp_replace(text, '\\s', '', 'g') <> ''")
def fasta_read(s, d):
    rows = T(s, d, "documents").where(~F.contains("text", F.lit(">")) & (F.regexp_replace("text", r"\s", "") != ""))
    at = lines(rows.select(files.fasta_text(F.concat("lang", F.lit("_"), "doc_id"), F.regexp_replace(F.replace("text", F.lit("ß"), F.lit("s")), r"\s+", "\n")).alias("line")), "line", "fasta")
    return files.read_fasta(s, at).select("header", "seq")


@query("""SELECT s_nationkey, s_suppkey AS taxon, f AS fault FROM (SELECT *, unnest(['forbidden character', 'length', 'empty']) AS f FROM supplier)
          WHERE (f = 'forbidden character' AND s_suppkey % 3 = 0) OR (f = 'empty' AND s_suppkey % 3 = 1) OR (f = 'length' AND s_suppkey % 3 = 1 AND s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 <> 1))
          UNION ALL SELECT s_nationkey, s_suppkey, 'duplicate taxon' FROM supplier WHERE s_suppkey % 4 = 0""")
def fasta_checks(s, d):
    key = F.col("s_suppkey")
    seq = F.when(key % 3 == 0, "AC1T").when(key % 3 == 1, "").otherwise("ACGT")
    rows = T(s, d, "supplier").select("s_nationkey", key.alias("taxon"), seq.alias("seq"))
    rows = rows.unionByName(rows.where("taxon % 4 = 0"))
    return files.fasta_faults(rows, ["s_nationkey"], "taxon").distinct()


@query("""SELECT s_nationkey, count(*) AS tips, 2 * count(*) - CASE WHEN count(*) > 1 THEN 1 ELSE 1 END AS nodes FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""")
def newick_tree_nodes(s, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = T(s, d, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(w).alias("n"))
    names = rows.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("t"), "s_suppkey"))).alias("t")).where(F.size("t") > 1)
    tree = F.aggregate(F.slice("t", F.lit(2), F.size("t") - 1), F.get("t", F.lit(0)), lambda a, x: F.concat(F.lit("("), a, F.lit(":1,"), x, F.lit(":2)")))
    made = files.newick_nodes(names.select("s_nationkey", F.concat(tree, F.lit(";")).alias("tree")), "s_nationkey", "tree")
    return made.groupBy("s_nationkey").agg(F.count_if(F.startswith("label", F.lit("t"))).alias("tips"), F.count("*").alias("nodes"))


# ---- sinks


@query("SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def csv_roundtrip(s, d):
    at = work_folder(s, "csv")
    sinks.write_csv(T(s, d, "part").select("p_partkey", F.concat(F.lit('a "quoted", '), "p_name").alias("p_name"), "p_type", "p_retailprice"), at)
    back = s.read.schema("p_partkey long, p_name string, p_type string, p_retailprice double").option("header", True).option("escape", '"').csv(at)
    return back.withColumn("p_name", F.replace("p_name", F.lit('a "quoted", '), F.lit("")))


@query("SELECT n_nationkey AS key, n_name AS name, NULL::VARCHAR AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def key_union(s, d):
    a = T(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    b = T(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))
    at = work_folder(s, "json")
    sinks.write_json(sinks.united([a, b]), at)
    return s.read.schema("key int, name string, region string").json(at)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def pickle_roundtrip(s, d):
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file, which is what a pickle is
        sinks.write_pickle(T(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{folder}/x.pkl", 1 << 20)
        return s.createDataFrame(pd.read_pickle(f"{folder}/x.pkl"))


@query("SELECT s_nationkey, s_suppkey, s_name FROM supplier")
def frame_roundtrip(s, d):
    at = work_folder(s, "frame")
    sinks.write_parquet(T(s, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), at)
    return s.read.parquet(at)


@query("SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_nationkey > 3 THEN s_nationkey END::INT AS s_nationkey FROM supplier")
def sqlite_roundtrip(s, d):
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file, which is what SQLite has
        path = os.path.join(folder, "x.db")
        sinks.write_sqlite(T(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey")).alias("s_nationkey")), path, most_rows=1 << 20)
        with sqlite3.connect(path) as db:
            rows = db.execute("SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM extracted_data").fetchall()
        db.close()
        return s.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double, s_nationkey int")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def upload_csv(s, d):
    rows = T(s, d, "customer").select("c_name", "c_custkey", F.lit("  ").alias("blank"), F.lit(None).cast("string").alias("nothing"), "c_nationkey")
    at = work_folder(s, "upload")
    sinks.write_csv(sinks.upload_batch(rows, ["c_custkey", "blank", "c_name", "nothing", "c_nationkey"]), at)
    return s.read.schema("c_custkey long, c_name string, c_nationkey int").option("header", True).csv(at)


@query("""SELECT '{"batches":[' || string_agg('{"depth":' || r || ',"rows":' || n || ',"pending":' || p || '}', ',' ORDER BY r) || '],"pending":' || sum(p)::BIGINT || '}' AS metadata
          FROM (SELECT n_regionkey AS r, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS p FROM nation GROUP BY ALL)""")
def upload_metadata(s, d):
    ref = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("__PENDING_B1_R"), "n_nationkey", F.lit("__"))).otherwise("17")
    return sinks.batch_metadata(T(s, d, "nation").select(F.col("n_regionkey").alias("depth"), ref.alias("parent_ref")))


@query("""SELECT s_name AS species, s_name || chr(9) || (s_nationkey % 2)::VARCHAR || (s_nationkey % 3 = 0)::INT::VARCHAR AS line FROM supplier
          UNION ALL SELECT '', (SELECT count(*) FROM supplier)::VARCHAR || chr(9) || '2' || chr(9) || '(A B)'""")
def geography_file(s, d):
    rows = T(s, d, "supplier").select("s_name", (F.col("s_nationkey") % 2).alias("x"), F.when(F.col("s_nationkey") % 3 == 0, "present").otherwise("absent").alias("y"))
    return models.geography_text(models.presence_rows(rows, "s_name", ["x", "y"]), models.area_names(2))


@query("SELECT o_custkey, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def profile_lists(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = T(s, d, "orders").select("o_custkey", (F.row_number().over(w) - 1).alias("pos"), F.when(F.col("o_orderstatus") == "O", -0.5).otherwise(0.5).alias("score"))
    return sinks.profile_lists(rows, ["o_custkey"], "pos", "score")


@query("""SELECT s_nationkey, 'M0,' || string_agg((50 - s_suppkey % 50)::VARCHAR, ' L' ORDER BY s_suppkey) AS path FROM (SELECT s_nationkey, s_suppkey FROM supplier) GROUP BY s_nationkey""")
def profile_drawing(s, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = T(s, d, "supplier").select("s_nationkey", (F.row_number().over(w) - 1).alias("pos"), ((F.col("s_suppkey") % 50) / 50.0).alias("score"))
    drawn = sinks.profile_svg(rows, ["s_nationkey"], "pos", "score", height=50, step=1)
    path = F.regexp_extract("svg", r' d="([^"]*)"', 1)
    # A point is x,y: positions follow one another, so the heights tell the drawing.
    return drawn.select("s_nationkey", F.regexp_replace(path, r" L\d+,", " L").alias("path"))


@query("""SELECT rpad(r_name, 30, ' ') || lpad(n::VARCHAR, 7, ' ') || lpad('1', 7, ' ') || lpad('0', 7, ' ') || lpad(printf('%.1f%%', 100.0 * n / (n + 1)), 9, ' ') || lpad('100.0%', 9, ' ') || lpad(printf('%.1f%%', 200.0 * n / (2 * n + 1)), 9, ' ') AS line
          FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""")
def validation_report(s, d):
    n = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").cast("int").alias("tp"))
    m = scoring.with_metrics(n.withColumns({"fp": F.lit(1), "fn": F.lit(0)}))
    return m.select(scoring.report_line(*(F.col(c) for c in ("r_name", "tp", "fp", "fn", "precision", "recall", "f1"))).alias("line"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::INT AS k, true AS truth_is_null, '' AS notes FROM events""")
def annotation_templates(s, d):
    made = sinks.annotation_template(T(s, d, "events").select("event_id", F.from_json("props", "k int").alias("data")), "event_id", "data")
    at = F.get_json_object("template", "$.notes")
    return made.select("event_id", F.get_json_object("template", "$.automated_extraction.k").cast("int").alias("k"), (F.contains("template", F.lit('"ground_truth":null'))).alias("truth_is_null"), at.alias("notes"))


@query("SELECT 'f' || s_suppkey || chr(9) || 'f' || s_suppkey AS line FROM supplier")
def mapping_lines(s, d):
    return sinks.mapping_template(T(s, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit(".tar")).alias("name")))
