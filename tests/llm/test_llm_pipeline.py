"""The pipeline on a small corpus, stage by stage against brute force."""

import random

import corpus_pipeline
import __spark_entry__ as entry
from cueglass.llm.queries import QUERIES

BAD = ["vermin", "filth", "scum"]


def words(rng, n):
    return ["".join(rng.choice(["ba", "ko", "ri", "ten", "lu", "shi"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    item = " ".join(words(rng, 40))
    rows, toxic, leaked, copies = [], set(), set(), {}
    for i in range(300):
        own = words(rng, 80)
        if i % 10 == 3:
            toxic.add(i)
            for _ in range(6):
                own[rng.randrange(80)] = rng.choice(BAD)
        elif i % 25 == 4:
            leaked.add(i)
            own[20:20] = item.split()
        elif i % 10 == 5:
            own = rows[i - 5][1].split()
            own[-1] = "end"
            copies[i] = i - 5
        rows.append((i, " ".join(own), "en", "src", 1))
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(i, 1, int(i in toxic)) for i in range(0, 300, 1) if i % 4], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, item)], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = set(range(300))
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:-1], (toxic, set(copies), leaked), strict=True):
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        expected -= gone
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.collect()} == expected, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == expected
    assert sum(r.n_tokens for r in got) == sum(len(rows[i][1]) for i in expected)


def test_registered():
    names = entry.queries()
    assert set(QUERIES) <= names.keys()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert names["pipeline"] is corpus_pipeline.run
