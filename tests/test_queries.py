import datetime
import hashlib
import os

import pytest

import __spark_entry__ as entry
from oracle_check import connect, difference
from treeledger.functions import formats

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, entry.queries()[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_sha512_of_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r.page_id: r.sha512 for r in entry.queries()["digest_pages_sha512"](spark, FOLDER).collect()}
    assert got == {i: hashlib.sha512(t.encode()).hexdigest().upper() for i, t in pages.items()}


def test_sha512_of_the_table_files(spark):
    def rows(name):
        return entry.queries()[name](spark, FOLDER).collect()

    got = {r.relative_path: (r["size"], r.sha512) for r in rows("tree_sha512")}
    chunked = {r.relative_path: r.tree_sha512 for r in rows("tree_chunk_sha512")}
    listed = {r.relative_path: (r.kind, r["size"], r.depth) for r in rows("tree_listing")}
    assert set(got) == set(chunked) == set(listed) == set(os.listdir(FOLDER))
    for name, (size, digest) in got.items():
        with open(f"{FOLDER}/{name}", "rb") as f:
            data = f.read()
        assert (size, digest) == (len(data), hashlib.sha512(data).hexdigest().upper())
        assert listed[name] == ("file", size, 0)
        parts = [hashlib.sha512(data[i : i + (1 << 20)]).digest() for i in range(0, len(data), 1 << 20)]
        assert chunked[name] == hashlib.sha512(b"".join(parts)).hexdigest().upper()


def test_format_values_of_large_keys(spark, tmp_path):
    """Products beyond BIGINT, against Python's integers."""
    keys = [None, 0, -3, 3_037_001, 8_999_999, 96_038_389, 20_000_000_000]
    orders = spark.createDataFrame([(key, 10.5) for key in keys], "o_orderkey long, o_totalprice double")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    rows = {row.o_orderkey: row for row in entry.queries()["format_values"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(keys) and rows[None][1:] == (None, None, None, "10,500")
    byte_units = [("EB", 1 << 60), ("PB", 1 << 50), ("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("kB", 1 << 10), ("B", 1)]
    for key in keys[1:]:
        shown = []
        for number, units in ((key * key * 1000, byte_units), (key * key * 1_000_003, formats.TIME_UNITS.items())):
            parts, rest = [], number
            for unit, length in units:
                count, rest = divmod(rest, length)
                parts += [f"{count}{unit}"] if count else []
            shown.append(" ".join(parts) or f"0{unit}")
        seconds, fraction = divmod(1_700_000_000 * 10**9 - key * 1_000_000_007, 10**9)
        moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)
        time = f"{moment:%Y-%m-%d %H:%M:%S}.{fraction:09d}"
        assert tuple(rows[key]) == (key, *shown, time, "10,500")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["status", "files"]
