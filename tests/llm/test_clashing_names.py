"""Extra columns named like the operators' own: every query gives the rows it gives without them, every stage keeps them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from helpers import words
from panelspark.llm.queries import QUERIES
from panelspark.llm.toxicity import labelled_rows

CLASHING = ["kept", "removed_starts", "removed_ends", "rest", "doc", "g", "out", "_out", "id", "hash", "twice", "n", "row", "rows", "mix_shard", "_order", "draw", "size", "twin",
            "pass", "shards", "taken", "source_size", "target", "block", "body", "toxicity", "_toxicity", "score", "node", "near", "key", "low", "bands", "component", "u", "v",
            "sequence_id", "start", "length", "offset", "ids", "bytes", "y", "label", "shard", "slot", "group", "term", "count", "set_a", "n_shingles", "value", "rank", "p", "q", "at", "place",
            "query_id", "anchor_id", "spans", "kind", "fingerprint", "text_crc32", "law", "held_out", "predicted", "position", "part", "item", "pos", "words", "dim", "norm"]


def _tables(spark, path, extra):
    rnd = random.Random(3)
    texts = ["the of and " + words(rnd, rnd.randrange(20, 50), most=400) for _ in range(30)] + [None, "", "token = abcdefgh12345"]
    texts += [texts[0] + " end", texts[1]]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    add = [F.lit(f"x-{c}").alias(c) for c in extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *add).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(8)], i % 10) for i in range(120)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int") \
        .select("*", *[F.lit(f"x-{c}").alias(c) for c in extra if c != "label"]).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return [_tables(spark, tmp_path_factory.mktemp(n), extra) for n, extra in (("plain", []), ("clashing", CLASHING))]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op")))
def test_queries_ignore_columns_named_like_their_own(spark, tables, name):
    plain, clashing = (sorted(map(repr, QUERIES[name](spark, t).collect())) for t in tables)
    assert plain == clashing


def test_stages_carry_columns_named_like_their_own(spark, tables):
    docs = spark.read.parquet(f"{tables[1]}/documents.parquet")
    names = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, tables[1])
        assert docs.columns == names, name
        got = docs.collect()
        assert got and all(r[c] == f"x-{c}" for r in got for c in CLASHING), name
    assert C.run(spark, tables[1]).count() > 0


def test_the_sample_bound_holds_for_repeated_ids_and_long_texts(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(400)] + [(9, "long " * 100), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    got = labelled_rows(docs, labels, "toxic", {0: 50, 1: 2}, F.lit(True))
    assert len(got) == len({r[0] for r in got}) == 3 + len([r for r in got if r[2]]) and sum(r[2] for r in got) <= 2
    short = labelled_rows(docs, labels, "toxic", {0: 50, 1: 50}, F.lit(True), max_bytes=32 * 20)
    assert {r[0] for r in short} == {0, 1, 2, 3, 8}
    assert len(labelled_rows(docs, labels, "toxic", {0: 50, 1: 50}, F.lit(True), max_bytes=8)) < 5
