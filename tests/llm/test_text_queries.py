"""Registered text queries beside their SQL, and the pipeline beside its stages."""

from collections import Counter

import brute
import corpus_pipeline
import duckdb
import pytest

from gridpanel.llm import jaccard, language, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        made.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, connection, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = connection.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = Counter(tuple(row[names.index(c)] for c in df.columns) for row in cursor.fetchall())
    assert Counter(tuple(r) for r in df.collect()) == expected


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_jaccard_query_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = brute.components({r.doc_id: r.text for r in rows})
    got = queries.QUERIES["op10_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.QUERIES["op6_language_id"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(got)


def test_pipeline_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "source_mixing", "sharding"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    first = stage["language_id"](spark, docs, SF)
    rejected = {r.doc_id for r in language.identify(docs).where("rejected").collect()}
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert kept == set(texts) - rejected and len(kept) > 0.95 * len(texts)

    second = stage["near_duplicates"](spark, first, SF)
    groups = brute.components({i: texts[i] for i in kept})
    kept = {r.doc_id for r in second.collect()}
    assert kept == {i for i, v in groups.items() if v[1] == i}

    third = stage["decontamination"](spark, second, SF)
    kept = {r.doc_id for r in third.collect() if True}
    assert kept == {i for i, v in groups.items() if v[1] == i and not brute.contamination(texts[i], benchmark)[-1]}

    fourth = stage["source_mixing"](spark, third, SF)
    assert fourth.columns == docs.columns
    copies = Counter(r.doc_id for r in fourth.collect())
    assert set(copies) <= kept and max(copies.values()) <= 3

    last = stage["sharding"](spark, fourth, SF)
    assert last.columns == [*docs.columns, "size", "text_crc32", "shard", "slot", "law"]
    last = last.collect()
    assert all(r.text == texts[r.doc_id] for r in last)
    assert Counter(r.doc_id for r in last) == copies
    sizes = Counter(r.shard for r in last)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == copies


def test_jaccard_links_survive_a_lost_filter(spark):
    """Components do not depend on how documents are dealt over partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {(r.doc_id, r.component_id) for r in jaccard.classes(docs.coalesce(1)).collect()}
    many = {(r.doc_id, r.component_id) for r in jaccard.classes(docs.repartition(7)).collect()}
    assert one == many
