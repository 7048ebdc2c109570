"""The corpus pipeline, stage by stage, against plain Python on what each stage was given."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from leafmill.llm import line_dedup, packing
from leafmill.llm.common import Scratch

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(scratch.save(stage(spark, seen[-1], SF), name))
    start, good, lines, single, clean, packed = seen
    assert all(s.columns == columns for s in seen[:-1])

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    agree = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(agree) >= 0.9 * len(agree)  # some fifty labelled rows to learn from; test_text_operators asks for more on more

    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (good, lines))
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup(good).collect()}
    assert set(before) - set(after) == {i for i, t in cut.items() if t is not None and not t.strip() and before[i]["text"].strip()}
    assert all(r["text"] == cut[i] for i, r in after.items()) and all(len(r["text"]) == r["n_chars"] for r in after.values())
    every = [x for r in after.values() for x in r["text"].split("\n") if len(x) >= 20]
    assert len(every) == len(set(every))

    sets = {i: brute.shingles(r["text"]) for i, r in after.items()}
    roots = brute.components(sets)
    assert {r["doc_id"] for r in single.collect()} == {i for i, root in roots.items() if i == root}

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(left) <= {r["doc_id"] for r in single.collect()}
    assert not any(x in t for t in left.values() for x in items)

    assert {r["doc_id"] for r in packed.collect()} == set(left)
    assert packed.columns == packing.pack(clean).columns


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_without_labels_and_without_documents(spark, tmp_path):
    """Without labels every document is kept by the classifier; without documents no stage fails and nothing comes out."""
    for t in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        rows.where(F.lit(t != "labels")).write.parquet(f"{tmp_path}/a/{t}.parquet")
        rows.where(F.lit(t != "documents")).write.parquet(f"{tmp_path}/b/{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert P.good_quality(spark, docs, f"{tmp_path}/a").count() == docs.count()
    assert P.run(spark, f"{tmp_path}/b").count() == 0


def test_odd_rows_pass_every_stage(spark):
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, "en", "s", None), (None, "free text", None, None, 9), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30000, "en", "s", 150000)]
    docs = spark.createDataFrame(rows, kind)
    left = docs
    for _, stage in P.STAGES[1:]:
        left = stage(spark, left, SF)
    assert sorted({str(r["doc_id"]) for r in left.collect()}) == ["1", "2", "3", "None"]
    # The first stage learns from the labelled rows that it is given; rows of one text have one outcome, and columns stay as they are.
    every = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 0))
    kept = P.good_quality(spark, every, SF)
    assert kept.schema == every.schema and kept.where("doc_id = 2 and text = ''").count() in (0, 2) and kept.count() < every.count()
