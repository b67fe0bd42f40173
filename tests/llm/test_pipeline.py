import re

import corpus_pipeline as C
from helpers import words

import random


def test_stages_keep_columns_and_clean_documents(spark, make_docs, tmp_path):
    rnd = random.Random(1)
    clean = ["the of and " + words(rnd, rnd.randrange(40, 90), most=10 ** 6) for _ in range(120)]
    toxic = [words(rnd, 40, most=10 ** 6) + " grotbag snivelworm " + words(rnd, 10, most=10 ** 6) for _ in range(40)]
    copies = [clean[i] + " end" for i in range(10)]
    texts = clean + toxic + copies + [None, "", clean[0]]
    docs = make_docs(texts, list(range(len(texts) - 1)) + [0])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(120 <= i < 160)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [name for name, _ in C.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "mixing", "packing"]
    kept = C.toxic_out(spark, docs, str(tmp_path)).persist()
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert len([i for i in ids if i < 120 or i >= 160]) >= 0.95 * (len(texts) - 40) and sum(120 <= i < 160 for i in ids) <= 4
    single = C.near_duplicates_out(spark, kept, str(tmp_path)).persist()
    left = [r["doc_id"] for r in single.collect()]
    assert single.columns == docs.columns and len(left) == len(set(left))
    assert not set(left) & {160 + i for i in range(10) if i in left}
    stripped = C.repeated_strings_out(spark, single, str(tmp_path))
    assert stripped.columns == docs.columns and stripped.count() == len(left)
    assert all(r["n_chars"] == len(r["text"]) for r in stripped.collect())
    drawn = C.mixed(spark, stripped, str(tmp_path))
    assert drawn.columns == docs.columns
    before = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in stripped.collect())
    after = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in drawn.collect())
    assert after == round(1.5 * before) or abs(after - 1.5 * before) <= 1
    final = C.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(final.columns) and final.count() > 0


def test_stages_of_an_empty_table(spark, make_docs, tmp_path):
    docs = make_docs([])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == [], name
