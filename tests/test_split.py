import pytest

from tessella.sources import records, sequences


@pytest.fixture
def small_splits(spark):
    """Splits of a kilobyte."""
    keys = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_large_bibliography_is_read_by_several_tasks(spark, tmp_path, small_splits):
    entry = lambda i: f"@article{{key{i},\n  title = {{A {'long ' * (i % 7)}title @ {i}}},\n  author = {{Doe, Jane and Max Roe}},\n  year = {{{1900 + i % 100}}}\n}}\n"
    text = "% before the first entry\n\n" + "".join(("  " if i % 11 == 5 else "") + entry(i) for i in range(300))
    (tmp_path / "a.bib").write_text(text)
    (tmp_path / "b.bib").write_text("".join(entry(1000 + i) for i in range(3)).replace("\n", "\r\n"))
    got = records.read_bibtex(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 10
    assert sorted(r.id for r in got.collect()) == sorted([f"key{i}" for i in range(300)] + [f"key{1000 + i}" for i in range(3)])
    told = {r.id: r for r in got.collect()}
    assert told["key3"].title == f"A {'long ' * 3}title @ 3" and told["key16"].authors == "Doe Jane, Roe Max" and told["key1001"].year == "1901"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert rows_of(records.read_bibtex(spark, str(tmp_path))) == rows_of(got)


def test_numbers_of_entries_do_not_depend_on_the_splits(spark, tmp_path, small_splits):
    entry = lambda i: f"TY  - JOUR\nAU  - Roe, Max{i % 3}\nPY  - 2001\nTI  - {'word ' * (i % 9)}{i}\nER  - \n\n"
    for name, n in (("a.ris", 200), ("b.ris", 150)):
        (tmp_path / name).write_text("".join(entry(i) for i in range(n)))
    got = records.read_ris(spark, str(tmp_path))
    # The k-th entry of its file, whatever split it was in.
    assert sorted(int(r.id.rsplit("_", 1)[1]) - int(r.title.split()[-1]) for r in got.collect()) == [0] * 350
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert rows_of(records.read_ris(spark, str(tmp_path))) == rows_of(got)


def test_partition_lines_in_splits(spark, tmp_path, small_splits):
    lines = [f"locus{i}\t{i + 1}\t{i + 9}" for i in range(500)]
    (tmp_path / "info").write_text("header\tof\tthree\nanother\tof\tthree\n" + "\n".join(lines) + "\nshort\tline\n")
    got = sequences.read_partition_info(spark, str(tmp_path / "info"))
    assert sorted((r.start, r.locus, r.end) for r in got.collect()) == [(i + 1, f"locus{i}", i + 9) for i in range(500)]
