"""Fill-in-the-middle against a plain version, its SQL and the exact way back."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from mossgraph.llm import fill_middle, queries

pytest.importorskip("tokenizers")
FOLDER = "/root/testdata/sf0.001"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_version(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", "a", "é", "ab cd", "a" * 5000, " " * 300, "x<P>y", "<S", "< P>", "<M>", "<", ">P><", "漢字🙂\r\n\x00 ab\tc1d", "A-b_c<P", "S><S><M", "line\nline\n" * 40]


@pytest.mark.parametrize("stretch", [1, 2, 7, 1 << 16])
def test_rearranged_as_a_plain_version_does(stretch):
    for key in [None, *range(40), -7, 2**40]:
        for text in TEXTS:
            assert fill_middle.rearranged(key, text, stretch=stretch) == plain_version(key, text), (key, text)


def test_memory_holds_one_stretch_of_offsets():
    units = fill_middle.Units("ab " * 100_000, 1000)
    assert len(units) == 200_000 and units.end(200_000) == 300_000 and len(units.last[1]) < 1000


def test_every_form_comes_back(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 20)] + [(None, None), (None, "null id"), (5, "again"), (5, "again")]
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((k or -1, t or "") for k, t in rows)
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(str((k, *plain_version(k, t))) for k, t in rows)


def test_rows_of_all_kinds(docs, rows, empty):
    got = fill_middle.fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r[0], *plain_version(r[0], r[1]))) for r in rows)
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_fill_in_middle"])
    got = queries.op13_fill_in_middle(spark, FOLDER)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
