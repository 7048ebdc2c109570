"""The library as a data source: versions that are whole or not there."""

import pytest
from pyspark.sql import functions as F

from leafmill.sources import library


def documents(spark, n, text, tag="B"):
    return spark.range(n).select(F.lit(tag).alias("tag_id"), F.lit("pages").alias("kind"), F.col("id").cast("string").alias("key"), F.concat(F.lit(text), "id").alias("document"))


def texts(spark, path, version=None):
    return {r["key"]: (r["version"], r["document"]) for r in library.load(spark, path, version).collect()}


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    assert library.load(spark, path).count() == 0
    library.save(documents(spark, 20, "a"), path)
    library.save(documents(spark, 5, "b"), path)
    library.save(documents(spark, 0, "c"), path)
    got = texts(spark, path)
    assert len(got) == 20 and {k for k, v in got.items() if v[0] == 2} == set("01234") and got["4"] == (2, "b4") and got["5"] == (1, "a5")
    assert set(texts(spark, path, 1).values()) == {(1, f"a{i}") for i in range(20)}
    assert sorted(library.versions(path)) == [1, 2, 3]


def test_killed_task_leaves_readers_on_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    library.save(documents(spark, 20, "a"), path)
    bad = documents(spark, 20, "b").withColumn("document", F.when(F.col("key") == "19", F.raise_error(F.lit("killed"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="killed"):
        library.save(bad, path)
    assert set(texts(spark, path).values()) == {(1, f"a{i}") for i in range(20)} and len(library.versions(path)) == 1
    left = library.vacuum(spark, path)
    assert left > 0 and library.vacuum(spark, path) == 0 and len(texts(spark, path)) == 20


def test_odd_keys_and_texts(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    given = [("..", "a/b", "x.y", "one"), ("..", "a/b", "x%2Ey", "two"), (None, "", "ü", None), ("T", "k", "", "long " * 200_000)]
    library.save(spark.createDataFrame(given, library.ROWS).withColumn("version", F.lit("clash")), path)
    got = {(r["tag_id"], r["kind"], r["key"]): r["document"] for r in library.load(spark, path).collect()}
    assert got == {g[:3]: g[3] or "" for g in given}
    assert not (tmp_path / "x.y").exists()


def test_missing_document_raises(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    library.save(documents(spark, 3, "a"), path)
    next((tmp_path / "l/B/pages").iterdir()).unlink()
    with pytest.raises(Exception, match=r"pages"):
        library.load(spark, path).count()
    with pytest.raises(Exception, match="append"):
        documents(spark, 1, "a").write.format(library.FORMAT).option("path", path).mode("overwrite").save()
