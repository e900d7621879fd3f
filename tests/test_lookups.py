from pyspark.sql import functions as F

from tessella.operators import extraction
from tessella.sources import clients, lookups


def test_a_second_run_makes_no_call(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("none",), (None,), ("fails",)], "k string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def asked(value, _):
        (calls / f"{value}-{len(list(calls.iterdir()))}").touch()
        if value == "fails" and len([x for x in calls.iterdir() if x.name.startswith("fails")]) <= 2:
            raise OSError("busy")
        return {"n": f"<{value}>"}

    at = str(tmp_path / "cache")
    told = lambda: sorted(((r.k, r.x and r.x.n) for r in extraction.enriched(df, "k", "x", asked, "n string", tries=2, cache=at).collect()), key=str)
    first = told()
    assert ("fails", None) in first and ("a", "<a>") in first and ("none", None) in first
    made = len(list(calls.iterdir()))
    second = told()  # only what failed is asked for again
    assert ("fails", "<fails>") in second and len(list(calls.iterdir())) == made + 1
    assert told() == second and len(list(calls.iterdir())) == made + 1


def test_runs_side_by_side_and_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "MOST_FOLDERS", 4)
    held = lookups.Lookups(spark, str(tmp_path / "c"), "n int")
    assert held.known().count() == 0
    for i in range(18):
        held.add(spark.createDataFrame([("same", i), (f"k{i}", i)], "key string, n int"))
    got = {r.key: r.n for r in held.known().collect()}
    assert got == {"same": 17, **{f"k{i}": i for i in range(18)}} and held.known().count() == 19
    assert len(held.folders()) <= 5 and len(held.listed("run-*")) < 18
    spark.range(1).selectExpr("'half' AS key", "1 AS n", "current_timestamp() AS answered").write.parquet(f"{held.at}/run-stopped")
    held.fs.delete(held.path(f"{held.at}/run-stopped/_SUCCESS"), False)  # a run that stopped while it wrote
    assert held.known().where(F.col("key") == "half").count() == 0


def test_fields_of_services():
    answers = {"gene": {"esearchresult": {"idlist": ["7"]}}, "compound": {"PC_Compounds": [{"id": {"id": {"cid": 5}}, "props": [{"value": {"sval": "C"}}]}]}}
    assert clients.lookup_of("gene", lambda *_: answers["gene"])("x", {}) == {"gene_id": "7", "ncbi_url": "https://www.ncbi.nlm.nih.gov/gene/7"}
    assert clients.lookup_of("compound", lambda *_: answers["compound"])("x", {})["pubchem_url"] == "https://pubchem.ncbi.nlm.nih.gov/compound/5"
    assert "gbif_id" in clients.schema_of("taxon") and "wfo_id" in clients.schema_of("plant") and "geonames_id" in clients.schema_of("place") and "pubchem_url" in clients.schema_of("compound")
