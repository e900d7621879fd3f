import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import url_rules, warc
from tessella.llm.runtime import work_folder

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("EXAMPLE.net", "/en/x/", "block"), ("example.net", "", "allow")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), v != "block", h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[2], min(fits)[3]) if fits else (host, path, None, "allow")


def test_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "http://net/", "https://a.NET/x?y", "http://a.b.example.net/en/1", "http://example.net/en/x/1", "http://example.net", "http://example.net?q=/en/", "http://example.com/de/", "http://xexample.com/de/", "http://a.org/fr/#t", "http://a.org/f", "x://y://net/", "http://net-x/", "http://a..net/", "http://例.net/é", "http://a.net\n/b"] * 3
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0
    assert url_rules.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0


def test_one_hot_url_is_spread(spark):
    df = spark.range(400).selectExpr("id AS page_id", "if(id % 3 > 0, 'http://a.example.net/en/1', concat('http://h', id, '.com/')) AS url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(df, rules).groupBy("verdict", "rule").count().collect()
    assert {(r.verdict, r.rule): r["count"] for r in got} == {("allow", "example.net/en/"): 266, ("allow", None): 134}


def page_rows():
    big, other = "<p>é</p>" * 300, "x" * 999
    return [(1, "http://a/é \n", big, 0), (2, None, big, 0), (3, "u", big, 0), (4, "u", other, 0), (5, "u", other, 0), (6, "u", None, 0), (7, "u", "", 0), (3, "u", big, 0), (None, "u", big, 0), (8, "u", "y" * 1000, 0)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, part int")
    folder = warc.write_archives(pages, work_folder(spark, "test-warc"), roll_bytes=300)
    got = warc.read_archives(spark, folder).collect()
    top = 3
    expected = []
    for i, _, html, _ in page_rows():
        body = (html or "").encode()
        same = len(body) >= 1000 and html == page_rows()[0][2]
        visit = same and i != top
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if visit else "response", top if visit else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(expected, key=str)
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for _, _, h, _ in page_rows()}


def test_files_are_gzip_and_deterministic(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, part int")
    listed = []
    for n in (1, 3):
        folder = warc.write_archives(pages.repartition(n), work_folder(spark, "test-warc"), roll_bytes=300)
        listed.append({})
        for m in warc.read_manifest(spark, folder).collect():
            content = bytes(spark.read.format("binaryFile").load(f"{folder}/{m.file}").first().content)
            assert m.bytes == len(content) and m.sha256 == hashlib.sha256(content[:-1]).hexdigest()
            assert gzip.decompress(content).count(b"WARC/1.1\r\n") == m.records
            listed[-1][m.name] = content
    assert len(listed[0]) > 2 and listed[0] == listed[1]


def test_no_pages_and_no_manifest(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(none, work_folder(spark, "test-warc"))).count() == 0
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, work_folder(spark, "test-warc"))


def test_a_stopped_run_leaves_nothing_that_is_read(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, part int")
    folder = work_folder(spark, "test-warc")
    broken = pages.withColumn("html", F.when(F.col("page_id") == 5, F.raise_error(F.lit("stopped"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="stopped"):
        warc.write_archives(broken, folder)
    spark.range(3).selectExpr("string(id)").write.text(f"{folder}/data-run-old")  # what a run left that was stopped later on
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, folder)
    assert warc.read_archives(spark, warc.write_archives(pages, folder)).count() == len(page_rows())
    with pytest.raises(FileExistsError):
        warc.write_archives(pages, folder)


def test_missing_foreign_and_damaged_files_raise(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, part int")

    def written():
        folder = warc.write_archives(pages, work_folder(spark, "test-warc"), roll_bytes=300)
        return folder, sorted(m.file for m in warc.read_manifest(spark, folder).collect())

    fs, path = warc.file_system(spark, written()[0])
    folder, files = written()
    fs.delete(path(f"{folder}/{files[1]}"), False)
    with pytest.raises(ValueError, match="None"):
        warc.read_archives(spark, folder)
    folder, files = written()
    spark.range(1).selectExpr("'x'").write.text(f"{folder}/{files[0].split('/')[0]}/name=9/records=1/sha256=0")
    with pytest.raises(ValueError, match="the manifest has None bytes"):
        warc.read_archives(spark, folder)
    folder, files = written()
    whole = bytes(spark.read.format("binaryFile").load(f"{folder}/{files[0]}").first().content)
    out = fs.create(path(f"{folder}/{files[0]}"), True)
    out.write(bytearray(whole[:30] + bytes([whole[30] ^ 1]) + whole[31:]))
    out.close()
    with pytest.raises(Exception, match="damaged archive"):
        warc.read_archives(spark, folder).count()


def test_many_path_rules_of_one_host(spark):
    rules = spark.range(20_000).selectExpr("'example.net' AS host", "concat('/', repeat('d/', int(id % 40)), id) AS path", "'block' AS verdict")
    urls = spark.range(4000).selectExpr("id AS page_id", "concat('http://w', id % 7, '.example.net/', repeat('d/', int(id % 40)), id, '/x') AS url")
    got = url_rules.judge_urls(urls, rules).selectExpr("verdict", "rule = concat('example.net/', repeat('d/', int(page_id % 40)), page_id) AS same").groupBy("verdict", "same").count().collect()
    assert [tuple(r) for r in got] == [("block", True, 4000)]


def test_one_page_id_and_null_ids_are_split(spark):
    rows = spark.range(600).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS page_id", "'u' AS url", "repeat(string(id), 300) AS html")
    folder = warc.write_archives(rows, work_folder(spark, "test-warc"), part_bytes=20_000)
    got = warc.read_archives(spark, folder)
    assert got.count() == 600 and got.where("page_id IS NULL").count() == 200 and got.where("record_type = 'revisit'").count() == 0
    assert max(m.records for m in warc.read_manifest(spark, folder).collect()) < 200


def test_a_large_payload_is_one_file(spark):
    body = "é" * 200_000
    pages = spark.createDataFrame([(1, "u", body), (2, "u", "small"), (3, "u", body)], "page_id long, url string, html string")
    folder = warc.write_archives(pages, work_folder(spark, "test-warc"), roll_bytes=10)
    assert [m.records for m in warc.read_manifest(spark, folder).collect()] == [1, 1, 1]
    got = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: (400_000, 3), 2: (5, None), 3: (400_000, None)}


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "y", 5)], "page_id long, url string, `a.b` string, `_row` long")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    made = url_rules.judge_urls(df, rules)
    assert made.columns == ["page_id", "url", "a.b", "_row", "host", "path", "rule", "verdict"]
    assert tuple(made.first()) == (1, "http://a.net/x", "y", 5, "a.net", "/x", "net/", "block")
    long = "http://" + "a." * 50_000 + "net/" + "p" * 100_000
    named = spark.createDataFrame([(long,)], "`u.r.l` string")
    assert url_rules.judge_urls(named, rules, url="u.r.l").first().verdict == "block"
