"""Callbacks of streams and recognisers by name."""

import pytest
from pyspark.sql import functions as F

from leafmill.sources import recognisers
from leafmill.streaming import status, tables
from leafmill.streaming.replay import feed, folder_of, to_end


def test_callbacks_tell_of_done_and_failed_batches(spark):
    folder, said, results, failures = folder_of(spark), [], [], []
    given = spark.createDataFrame([(1, k) for k in range(8)], tables.MAIL)

    def work(part, number):
        if number == 2:
            raise RuntimeError("no space left")
        return tables.handle_mail(folder)(part, number)

    sink = status.observed(work, folder, said.append, lambda k, made: results.append((k, made.count())), lambda k, e: failures.append((k, str(e))))
    log = status.ProgressLog(f"{folder}/progress")
    spark.streams.addListener(log)
    try:
        with pytest.raises(Exception, match="no space left"):
            to_end(feed(given, "uid", folder), folder, sink)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    told = {r["batch"]: (r["status"], r["n_rows"], r["error"]) for r in status.events(spark, folder).collect()}
    assert set(told) == {0, 1, 2} and told[0][0] == told[1][0] == "done" and told[2] == ("failed", 0, "RuntimeError: no space left")
    assert [k for k, _ in results] == [0, 1] and failures == [(2, "no space left")] and len(said) == 3 and said[2].startswith("batch 2: failed")
    ends = status.progress(spark, f"{folder}/progress").where("status = 'failed'").collect()
    assert len(ends) == 1 and "no space left" in ends[0]["error"]
    # Run again with the fault gone, the stream goes on and replaces the row of the batch that failed.
    to_end(feed_again(spark, folder, given), folder, status.observed(tables.handle_mail(folder), folder))
    assert {r["status"] for r in status.events(spark, folder).collect()} == {"done"}
    assert tables.stored(spark, f"{folder}/handled", tables.MAIL).count() == 8


def feed_again(spark, folder, given):
    return spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_recogniser_by_name(spark):
    rows = spark.createDataFrame([("p", "one\n\n  two "), ("q", None), ("r", "")], "page_id string, result string")
    got = {(r["page_id"], r["line_index"], r["text"], r["confidence"]) for r in recognisers.recognise(rows, "LINES ").collect()}
    assert got == {("p", 0, "one", 0.0), ("p", 2, "two", 0.0)}
    native = recognisers.recognise(spark.createDataFrame([("p", '{"txts": ["a"], "scores": [0.5]}')], "page_id string, result string"), " Paddle")
    assert [tuple(r) for r in native.collect()] == [("p", 0, "a", 0.5)]
    with pytest.raises(ValueError, match="unknown recogniser"):
        recognisers.recognise(rows, "abacus")
    with pytest.raises(ValueError, match="natively"):
        recognisers.register("Paddle")(type("X", (), {}))


def test_own_recogniser(spark):
    class Shout:
        def eval(self, value: str):
            for i, word in enumerate(value.split()):
                yield i, word.upper(), 0.5

    recognisers.register("shout")(Shout)
    rows = spark.createDataFrame([("p", "a b", 7)], "page_id string, result string, line_index int")
    got = recognisers.recognise(rows, "shout")
    assert sorted(tuple(r) for r in got.collect()) == [("p", 0, "A", 0.5), ("p", 1, "B", 0.5)] and got.where(F.col("confidence") > 1).count() == 0
