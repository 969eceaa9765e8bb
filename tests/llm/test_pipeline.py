"""The pipeline against its stages done by brute force, and the SQL of the similarity join."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from mossgraph.llm import pii, queries, quality_rules
from test_corpus import WORD, brute_groups

P = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality rules"](spark, docs, FOLDER).cache()
    rules = quality_rules.learn_rules(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in quality_rules.judged(docs, rules).where("_q_kept").collect()}
    assert {r.doc_id for r in one.collect()} == want and 0 < len(want) < docs.count()
    two = stage["line dedup"](spark, one, FOLDER).cache()
    assert two.columns == corpus_pipeline.COLUMNS and two.count() == one.count()
    three = stage["near duplicates"](spark, two, FOLDER).cache()
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {k for k, _, root in brute_groups(rows, 5, 80, 100) if k == root}
    four = stage["personal data"](spark, three, FOLDER).cache()
    finder = pii.Finder()
    assert {r.doc_id: r.text for r in four.collect()} == {r.doc_id: pii.masked(r.text, finder(r.text)) for r in three.collect()}
    assert all(r.n_chars == len(r.text) for r in four.collect())
    packed = stage["packing"](spark, four, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in four.collect()}
    sizes = collections.Counter()
    for r in packed:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)


def test_similarity_join_and_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op10_jaccard_join"]).fetchall())
    assert sorted(tuple(r) for r in queries.op10_jaccard_join(spark, FOLDER).collect()) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_every_row(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name.startswith("op8"):
        n = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1
    if name.startswith(("op7", "op12")):
        assert got.select("doc_id").distinct().count() == n
    elif name.startswith("op11"):  # the root has all conversations as members
        assert got.where("depth = 0").first().n_convs == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert got.count() == n
    assert re.match(r"op\d+_", name) and WORD


def test_nulls_long_texts_clashing_columns_and_empty_tables(spark, docs, rows, empty, tmp_path):
    words = " ".join(f"word{k}" for k in range(40))
    repeated = "\n".join(f"line {k} of many words here" for k in range(4000))  # nearly all of its words are in windows found twice
    other = "\n".join(f"line{k} w{k} of x{k} words{k} y{k} here{k}" for k in range(4000))
    more = [(100, f"{words} {'0' * 5000}.1.1.1 and a@b.co", "en", "s", 0, "own", 1, "k"), (101, other, "en", "s", 0, "own", 1, "k"), (102, repeated, "en", "s", 0, "own", 1, "k")]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in packed}
    assert {100, 101} <= kept and not kept & {14, 15, 16, 17, 18, 102}  # null, empty, very short and repetitive texts go
    masked = corpus_pipeline.personal_data(spark, both, str(tmp_path))
    assert masked.columns == corpus_pipeline.COLUMNS
    assert [r.text for r in masked.where("doc_id = 100").collect()] == [f"{words} [IP] and [EMAIL]"]
    for name in ("documents", "labels"):
        frame = empty if name == "documents" else spark.createDataFrame([], "doc_id long, quality int, toxic int")
        frame.write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
