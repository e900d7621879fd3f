import json
import os
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.functions.shipping import ship
from tessella.operators import extraction, ledger, models, pages, requests, sampling, scoring, sequences
from tessella.sources import records, sequences as files, sinks
from tessella.streaming import resume


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_export(spark, tmp_path):
    p = write(tmp_path / "e.csv", "irn,LocCountry,LatLatitude,LocElevationASLFromMt\n1, Peru ,-0.001,high\n2,,\n")
    rows = records.read_export(spark, p).collect()
    assert [(r.irn, r.country, r.lat, r.elevation_from_m, r.continent) for r in rows] == [("1", "Peru", -0.001, None, None), ("2", None, None, None, None)]


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v, s=0: f'<c r="{r}" t="inlineStr" s="{s}"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {ns}><sheetData><row r="1">{cell("B1", "", 1)}</row><row r="2">{cell("A2", "id")}{cell("B2", "Site_tab", 0)}{cell("C2", "country")}</row><row r="4">{cell("A4", "1")}{cell("B4", "12.0")}{cell("C4", "Peru")}</row><row r="5">{cell("A5", "2")}{cell("B5", " ")}</row></sheetData></worksheet>'
    styles = f'<styleSheet {ns}><fills><fill><patternFill/></fill><fill><patternFill><fgColor rgb="FF00FF00"/></patternFill></fill></fills><cellXfs><xf fillId="0"/><xf fillId="1"/></cellXfs></styleSheet>'
    path = tmp_path / "s.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/styles.xml", styles)
    rows = records.read_sheets(spark, str(path))
    columns = records.site_columns(rows, ["country"])
    assert columns == {2: "Site", 3: "country"}
    assert [(r.row_no, r.Site, r.country) for r in records.sheet_records(rows, columns).collect()] == [(4, "12", "Peru")]


def test_bibliographies(spark, tmp_path):
    bib = write(tmp_path / "b.bib", "@article{key1,\n  title = {A {Great} Title},\n  author = {Doe, Jane and John Smith},\n  year = {2020},\n  file = {x:a/b.txt:text/plain;:a/b.pdf:application/pdf},\n}\n@book{k2,\n  title = \"Two\",\n  year = \"1999\"\n}\n")
    rows = {r.id: r for r in records.read_bibtex(spark, bib, "/pdf").collect()}
    assert (rows["key1"].type, rows["key1"].title, rows["key1"].authors, rows["key1"].year, rows["key1"].pdf_path) == ("article", "A Great Title", "Doe Jane, Smith John", "2020", "/pdf/a/b.pdf")
    assert (rows["k2"].title, rows["k2"].year, rows["k2"].authors, rows["k2"].pdf_path) == ("Two", "1999", "", None)
    ris = write(tmp_path / "r.ris", "TY  - JOUR\nAU  - Doe, Jane\nAU  - Roe, R\nPY  - 2020/01\nTI  - T\nDO  - 10.1/x\nKW  - a\nKW  - b\nER  - \nTY  - BOOK\nER  - \n")
    pdfs = spark.createDataFrame([("/p/10_1_x.pdf",), ("/p/Jane_2020.pdf",)], "path string")
    got = sorted((r.id, r.authors, r.keywords, r.pdf_path) for r in records.read_ris(spark, ris, pdfs).collect())
    assert got == [("Jane2020_0", "Doe, Jane; Roe, R", "a; b", "/p/Jane_2020.pdf"), ("UnknownNoYear_1", "", "", None)]
    dois = write(tmp_path / "d.txt", "10.1234/a b\n\n 10.5/x \n")
    assert sorted(r.id for r in records.papers_from_dois(spark, dois).collect()) == ["10_1234_a_b", "10_5_x"]
    one = records.papers_from_files(spark.createDataFrame([("/q/My_paper.pdf",)], "path string")).first()
    assert (one.id, one.title) == ("My_paper", "My paper")


def test_results_lines_mappings(spark, tmp_path):
    p = write(tmp_path / "r.json", json.dumps({"a": {"status": "success"}, "b": {"status": "error"}}))
    assert {r.id: json.loads(r.result)["status"] for r in records.read_results(spark, p).collect()} == {"a": "success", "b": "error"}
    good, bad = records.read_json_lines(spark, write(tmp_path / "l.jsonl", '{"accession": "x", "n": 1}\nnot json\n\n{"accession": "y"}\n'), "accession string, n long")
    assert sorted((r.accession, r.n) for r in good.collect()) == [("x", 1), ("y", None)] and bad.count() == 1
    m = records.read_mapping(spark, write(tmp_path / "m.tsv", "# c\na\tX\n\na\tY\nb\tY\tz\nc\tc\nd\tZ\n"))
    assert {r.old_name: r.new_name for r in m.collect()} == {"a": "Y", "c": "c", "d": "Z"}
    names = spark.createDataFrame([("a.fa",), ("c.fa",), ("d.fa",), ("Z.fa",), ("e.fa",)], "name string")
    assert {r.source: r.status for r in records.rename_plan(names, m).collect()} == {"a.fa": "rename", "c.fa": "same", "d.fa": "collision", "Z.fa": "unmapped", "e.fa": "unmapped"}
    y = write(tmp_path / "c.yaml", "funding_sources:\n  - {name: A, detail: '1'}\n")
    assert records.read_yaml(spark, y, "funding_sources", "name string, detail string").first().name == "A"


def test_file_listings(spark, tmp_path):
    for n in ("x/26001_a.PDF", "x/b.tiff", "26002_c.pdf", "d.txt"):
        write(tmp_path / "f" / n, "x")
    found = records.read_files(spark, str(tmp_path / "f"), [".pdf", ".tiff"])
    assert sorted(r.kind for r in records.file_kinds(found).collect()) == ["image", "pdf", "pdf"]
    assert sorted((r.receipt_number or "") for r in records.receipt_files(found).collect()) == ["", "26001", "26002"]


def test_fasta_and_trees(spark, tmp_path):
    write(tmp_path / "fa" / "apis.fasta", ">L1_x\nacg\nT?\n>L2_y\nAC\n")
    write(tmp_path / "fa" / "bombus.fasta", ">L1_z\nACGTT\n>L1_z\n\n")
    rows = files.read_fasta(spark, str(tmp_path / "fa"))
    assert sorted((r.locus, r.species, r.seq) for r in files.regrouped(rows).collect()) == [("L1", "apis", "ACGT?"), ("L1", "bombus", ""), ("L1", "bombus", "ACGTT"), ("L2", "apis", "AC")]
    assert {r.fault for r in files.fasta_faults(rows, ["path"]).collect()} == {"duplicate taxon", "empty", "length"}
    t = spark.createDataFrame([(1, "((A:1,B:2)ab:1,C:3)root;"), (2, "(X,Y);")], "id int, tree string")
    assert [r.v for r in t.select(files.newick_tips(F.col("tree")).alias("v")).collect()] == [["A", "B", "ab", "C"], ["X", "Y"]]
    nodes = {(r.id, r.label): (r.parent, r.depth) for r in files.newick_nodes(t, "id", "tree").collect()}
    assert nodes[1, "A"] == (2, 2) and nodes[1, "ab"] == (1, 1) and nodes[1, "root"] == (None, 0) and nodes[2, "Y"][1] == 1
    write(tmp_path / "qc" / "g1" / "summary.txt", "S:90.0%, 900\nD:1.0%, 10\nF:2%, 20\nM:7%, 70\n")
    write(tmp_path / "qc" / "g2" / "summary.txt", "S:1%, 5\n")
    assert sorted(map(tuple, files.read_quality_summaries(spark, str(tmp_path / "qc")).collect())) == [("g1", 900, 10, 20, 70), ("g2", 5, 0, 0, 0)]
    info = files.read_partition_info(spark, write(tmp_path / "p.txt", "h\nh\nL1\t1\t10\nbad\t1\nL2\t11\t20\tx\n"))
    assert sorted(map(tuple, info.collect())) == [("L1", 1, 10), ("L2", 11, 20)]


def test_sinks(spark, tmp_path):
    import sqlite3

    a, b = spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2, 3.0)], "b int, c double")
    both = sinks.united([a, b])
    assert both.columns == ["a", "b", "c"]
    sinks.write_sqlite(both, str(tmp_path / "x.db"))
    sinks.write_sqlite(both, str(tmp_path / "x.db"))
    assert sorted(sqlite3.connect(tmp_path / "x.db").execute("SELECT b FROM extracted_data").fetchall()) == [(1,), (2,)]
    sinks.write_csv(both, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_pickle(both, str(tmp_path / "p.pkl"), 10)
    assert len(pd.read_pickle(tmp_path / "p.pkl")) == 2
    sinks.write_json(both, str(tmp_path / "json"))
    sinks.write_lines(both, str(tmp_path / "lines"), "b")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1", "2"]
    assert sinks.upload_batch(spark.createDataFrame([("", "x", "1")], "c string, b string, a string"), ["a", "b", "c"]).columns == ["a", "b"]
    meta = sinks.batch_metadata(spark.createDataFrame([(1, "8"), (2, "__PENDING_B1_R1__")], "depth int, parent_ref string")).first().metadata
    assert json.loads(meta) == {"batches": [{"depth": 1, "rows": 1, "pending": 0}, {"depth": 2, "rows": 1, "pending": 1}], "pending": 1}


def test_json_repair_and_schema(spark):
    assert extraction.try_json('{"a": [1, 2,], "b": True') == ({"a": [1, 2], "b": True}, True)
    assert extraction.try_json("{'a': 'x'}") == ({"a": "x"}, True) and extraction.try_json("nothing") == (None, False)
    ship(spark)
    spec = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "k": {"enum": ["a", "b"]}, "r": {"type": "array"}, "v": {"type": ["number", "string"]}}}
    rows = spark.createDataFrame([('{"n": 1, "k": "a", "r": []}',), ('{"k": "a"}',), ('{"n": "x"}',), ('{"n": 1, "k": "c"}',), ('{"n": 2, "r": 5,}',)], "t string")
    made = rows.select("t", extraction.repaired_json(F.col("t")).alias("j")).select("j.*").select("data", "repaired", extraction.schema_error(F.col("data"), spec).alias("e"))
    assert [r.e for r in made.collect()] == [None, "$: 'n' is required", "$.n: is not of type integer", "$.k: is not one of the allowed values", "$.r: is not of type array"]
    status = made.select(extraction.cleaned_status(F.lit("success"), F.col("data").isNotNull(), F.col("repaired"), F.col("e"), strict=True).alias("s"))
    assert [r.s for r in status.collect()] == ["valid", *["failed_validation"] * 3, "repaired"]
    assert extraction.schema_type(spec).simpleString() == "struct<n:bigint,k:string,r:array<string>,v:string>"


def test_flatten_and_enrich(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, ("x", ["p", "q"]), [("Apis", 2), ("Bombus", 3)]), (2, (None, []), []), (3, None, None)], "id int, m struct<a:string,tags:array<string>>, records array<struct<name:string,n:int>>")
    flat = {r.id: r for r in extraction.flattened(rows).collect()}
    assert flat[1].m_a == "x" and flat[1].m_tags == "p, q" and flat[2].m_tags == "" and flat[3].m_a is None
    assert extraction.numbered(rows, "records", 2).first().records_1_name == "Bombus"
    assert sorted((r.paper_id, r.name or "") for r in extraction.exploded(rows, "records", ["id"]).collect()) == [(1, "Apis"), (1, "Bombus"), (2, ""), (3, "")]
    calls = {"a": {"rank": "genus"}}
    values = spark.createDataFrame([("a",), ("a",), ("none",), ("",), (None,), ("zz",)], "name string")
    made = extraction.enriched(values, "name", "known", lambda v, p: calls.get(v), "rank string").collect()
    assert [(r.name, r.known.rank if r.known else None) for r in made if r.known] == [("a", "genus")] * 2 and len(made) == 6
    nested = extraction.enriched_nested(rows, "records", "name", "rank", spark.createDataFrame([("Apis", "genus")], "key string, value string"))
    assert {r.id: [(x.name, x.rank) for x in r.records] for r in nested.collect()} == {1: [("Apis", "genus"), ("Bombus", None)], 2: [], 3: []}


def test_comparisons(spark):
    at = lambda c: tuple(spark.range(1).select(c.alias("v")).first().v)
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert [at(scoring.boolean_counts(*x)) for x in ((t, t), (f, f), (t, f), (f, t), (t, n), (n, t))] == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 0), (0, 0, 1)]
    a, b = F.array(F.lit("X "), F.lit("y"), F.lit("y")), F.array(F.lit("x"), F.lit("z"))
    assert at(scoring.list_counts(a, b)) == (1, 1, 1) and at(scoring.ordered_counts(a, b)) == (1, 1, 0)
    assert at(scoring.empty_counts(F.lit(""))) == (1, 0, 0) and at(scoring.match_counts(F.lit(False))) == (0, 1, 1)


def test_samples(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 3, 0).when(F.col("id") < 50, 1).otherwise(9).alias("records"))
    got = sampling.stratified(rows, "id", "records", 10).collect()
    assert len(got) == 10 and {r.stratum for r in got} == {"zero", "few", "many"}
    assert {r.id for r in got} == {r.id for r in sampling.stratified(rows.repartition(7), "id", "records", 10).collect()}
    assert sampling.stratified(rows, "id", "records", 1000).count() == 100 and sampling.sample(rows, "id", 5).count() == 5
    show = lambda n: spark.range(1).select(sampling.spaced(F.lit(n)).alias("v")).first().v
    assert show(3) == [0, 1, 2] and show(5) == [2, 3, 4] and len(show(50)) == 10 and show(0) == []


def test_pages(spark):
    rows = [("d", 1, None), ("d", 2, "en"), ("d", 3, None), ("d", 4, "fr"), ("e", 1, None)]
    df = spark.createDataFrame(rows, "doc string, page int, lang string")
    filled = pages.filled(df, "doc", "page", "lang")
    assert [r.filled for r in filled.orderBy("doc", "page").collect()] == ["en", "en", "en", "fr", None]
    assert sorted((r.doc, r.pages) for r in pages.ranges(filled, "doc", "page", "filled").collect()) == [("d", "1-3"), ("d", "4"), ("e", "1")]
    assert [(r.doc, r.primary_lang) for r in pages.primary(df, "doc", "page", "lang").collect()] == [("d", "en")]
    merge = lambda t, f: spark.range(1).select(pages.with_figures(F.lit(t), F.array(*map(F.lit, f)) if f else F.array().cast("array<string>")).alias("v")).first().v
    assert merge("a\nFig. 1 x\nb\nPlate II", ["F1", "F2", "F3"]) == "a\nF1\n\nFig. 1 x\nb\nF2\n\nPlate II\n\nF3"
    assert merge(" t ", []) == "t" and merge("", ["F1", "F2"]) == "F1\n\nF2"
    signals = pages.page_signals(spark.createDataFrame([("a", "text", ["GlyphLessFont"], 0.0), ("b", "x" * 200, ["Body"], 0.9), ("b", "x" * 200, ["Body"], 0.9), ("c", "word " * 60, ["Body"], 0.1), ("e", "", [], 0.0)], "doc string, t string, fonts array<string>, share double"), "doc", "t", "fonts", "share")
    assert {r.doc: r.reason.split()[0] for r in pages.classified(signals).collect()} == {"a": "OCR-marker", "b": "body", "c": "born-digital", "e": "no"}


def test_sequence_types_and_trees(spark):
    kind = lambda s: spark.range(1).select(sequences.sequence_type(F.lit(s)).alias("v")).first().v
    assert [kind(s) for s in ("ACGT-N", "RYRYRY", "MKVLA")] == ["nt", "RY", "aa"] and sequences.even_window(5) == 6 and sequences.even_window(None) == 6
    assert spark.range(1).select(sequences.consensus(F.lit("ACR-"), F.lit("GCY-")).alias("v")).first().v == "RCN-"
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], dtype=float)
    assert sequences.joined_tree(list("abcde"), d).count("(") == 4
    pairs = spark.createDataFrame([("L", "x", "y", "ACGTACGTACGTACGT", "ACGTACGTTGCATGCA"), ("L", "x", "z", "ACGTACGTACGTACGT", "ACGTACGTACGTACGT")], "locus string, a string, b string, seq_a string, seq_b string")
    ship(spark)
    one = sorted(map(tuple, sequences.resampled_scores(pairs, "locus").collect()))
    assert one == sorted(map(tuple, sequences.resampled_scores(pairs.repartition(5), "locus").collect()))
    assert all(v > 0 for v in one[1][3]) and min(one[0][3]) < 0
    limit = sequences.residue_threshold(spark.createDataFrame([("L", "MKVLAMKV"), ("L", "MKVLA")], "locus string, seq string"), "locus", "seq").first()
    assert -6 <= limit.threshold <= 6
    made, spans = sequences.supermatrix(spark.createDataFrame([("L1", "x", "AC"), ("L2", "x", "GGG"), ("L2", "y", "TTT")], "locus string, taxon string, seq string"), "locus", "taxon", "seq")
    assert {r.taxon: r.sequence for r in made.collect()} == {"x": "ACGGG", "y": "--TTT"} and sorted(map(tuple, spans.collect())) == [("L1", 1, 2), ("L2", 3, 5)]


def test_models(spark):
    assert models.state_count(4, 4) == 16 and models.model_options("BAYAREALIKE+J")["founder"]
    p = spark.createDataFrame([(3.841459,), (-1.0,)], "x double").select(models.chi2_tail("x").alias("p")).collect()
    assert abs(p[0].p - 0.05) < 1e-6 and p[1].p == 1.0
    s, t = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("b",), ("c",)], "name string")
    assert sorted(map(tuple, models.name_differences(s, t, "name").collect())) == [("a", "tree"), ("c", "matrix")]
    assert models.name_differences(s, t.limit(0), "name").count() == 0
    assert len(models.geography_text(spark.createDataFrame([("x", "10")], "species string, bits string"), ["A", "B"]).collect()) == 2


def test_ledger_and_requests(spark):
    a, b = spark.createDataFrame([("1",), ("2",), (None,)], "n string"), spark.createDataFrame([("2",), ("2",), ("3",)], "n string")
    assert sorted(map(tuple, ledger.reconciled(a, b, "n").collect())) == [("1", "orphaned_receipt"), ("3", "missing_file")]
    sources = spark.createDataFrame([("Bass postdoc fund",), ("Beetle grant",)], "name string")
    asked = spark.createDataFrame([("bass postdoc",), ("",), ("zzzz",)], "account string")
    ship(spark)
    assert {r.account: r.source for r in requests.funding(asked, sources, "account").collect()} == {"bass postdoc": "bass postdoc fund", "": None, "zzzz": None}
    assert spark.range(1).select(requests.needs_funding(F.lit("To be determined by X")).alias("v")).first().v


def test_resume_skips_successes_and_retries_failures(spark, tmp_path):
    ship(spark)
    out, flag = str(tmp_path / "results"), str(tmp_path / "works")
    todo = spark.createDataFrame([(i,) for i in range(5)], "id long")

    def call(row):
        if row["id"] == 3 and not os.path.exists(flag):
            raise OSError("busy")
        return {"answer": f"a{row['id']}"}

    first = resume.resume(todo, out, "id", call, "answer string", tries=2, wait=0)
    assert sorted(r.id for r in first.collect()) == [0, 1, 2, 4]
    open(flag, "w").close()
    again = resume.resume(todo, out, "id", call, "answer string", tries=1, wait=0)
    assert sorted(r.id for r in again.collect()) == [0, 1, 2, 3, 4]


def test_stream_of_work(spark, tmp_path):
    from tessella.streaming import calls

    calls.store_settings(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in part], "id long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        calls.follow(stream, out, str(tmp_path / "at"), "id", lambda r: {"answer": str(r["id"])}, "answer string").awaitTermination()
        assert spark.read.parquet(out).groupBy("id").count().where("count > 1").count() == 0
    assert spark.read.parquet(out).count() == 3


def test_services(spark):
    from tessella.operators import services

    ship(spark)

    @services.register("taxa")
    def taxa(value, parameters):
        return {"rank": parameters["rank"]} if value == "Apis" else None

    rows = spark.createDataFrame([("Apis",), ("x",)], "name string")
    config = [{"field": "name", "api": "taxa", "output_field": "t", "extra_params": {"rank": "genus"}}, {"field": "name", "api": "unknown", "output_field": "u"}]
    made = {r.name: (r.t.rank if r.t else None, r.u) for r in services.enriched_by(rows, config, {"taxa": "rank string"}).collect()}
    assert made == {"Apis": ("genus", None), "x": (None, None)}
    say = lambda *a: spark.range(1).select(services.preflight(*map(F.lit, a)).alias("v")).first().v
    assert [say("regions", "", "", True), say("hosted", "", "k", True), say("x", "", "", True), say("regions", "", "", False)] == ["no host", None, "unknown backend x", None]
    one = spark.range(1).select(services.model_of(F.lit("p"), F.lit(" "), {"p": "m"}).alias("m"), services.jobs_for(F.lit(64), F.lit(16)).alias("j"), services.fits_machine(F.lit(16), F.lit(4), F.lit(64)).alias("f")).first()
    assert (one.m, one.j, one.f) == ("m", 4, True)
    assert [r.id for r in services.first_rows(spark.range(9), ["id"], 3).collect()] == [0, 1, 2]


def test_pair_scores():
    assert sequences.pair_scores("ARN-", "AAAA").tolist() == [1, 0.5, 0, 0]
    assert sequences.pair_scores("AG", "CA", "RY").tolist() == [-1, 1]
    assert sequences.pair_scores("KA", "RA", "aa", {"KR": 2.0, "AA": 4.0}).tolist() == [2.0, 4.0]
