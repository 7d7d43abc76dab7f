import time

import pytest
from pyspark.sql import functions as F

from orderlens.operators import routing as RT
from orderlens.plans.data_queries import PHRASES, turns_of
from orderlens.schemas import CONVERSATIONS, EVENTS
from orderlens.streaming import (carry_available, read_stream, run_available, run_updates, stream_carry_context,
                                 stream_rates, stream_screen)


def write_parts(df, folder, name, order, parts):
    """The rows as several files that arrive one after the other."""
    n = df.count()
    indexed = df.orderBy(order).toPandas()
    for i in range(parts):
        piece = indexed.iloc[i * n // parts:(i + 1) * n // parts]
        df.sparkSession.createDataFrame(piece, df.schema).coalesce(1).write.mode(
            "overwrite").parquet(str(folder / "raw"))
        part = next((folder / "raw").glob("part-*.parquet"))
        (folder / f"{name}.parquet").mkdir(exist_ok=True)
        (folder / f"{name}.parquet" / f"part{i}.parquet").write_bytes(part.read_bytes())
        time.sleep(0.02)


@pytest.fixture(scope="module")
def turn_files(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("turns")
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    write_parts(df, folder, "conversations", "turn", 4)
    return folder


def test_screening_a_stream_equals_batch(spark, sf, turn_files):
    stream = turns_of(read_stream(spark, str(turn_files), "conversations", CONVERSATIONS, 1))
    got = run_available(stream_screen(stream, **PHRASES), "screen").drop("order_ref")
    want = RT.screen_turns(turns_of(spark.read.parquet(f"{sf}/conversations.parquet")),
                           **PHRASES).drop("order_ref")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


CONTEXT = ["conv_id", "turn", "session_order", "session_image", "missing_context"]


def batch_context(spark, sf):
    screened = RT.screen_turns(turns_of(spark.read.parquet(f"{sf}/conversations.parquet")), **PHRASES)
    return RT.resolve_context(screened, order="order_ref").withColumn("session_order", F.col("session_order").cast("string"))


@pytest.mark.parametrize("order", ["turn", "shuffled"])
def test_context_does_not_depend_on_micro_batches(spark, sf, tmp_path, turn_files, order):
    folder = turn_files
    if order == "shuffled":  # turns come in any order, a file at a time
        folder = tmp_path
        write_parts(spark.read.parquet(f"{sf}/conversations.parquet"), folder, "conversations",
                    F.xxhash64("conv_id", "turn"), 5)
    stream = turns_of(read_stream(spark, str(folder), "conversations", CONVERSATIONS, 1))
    got = carry_available(stream_carry_context(stream_screen(stream, **PHRASES)), "carry")
    assert got.filter("late").count() == 0
    assert sorted(got.select(*CONTEXT).collect(), key=str) == \
        sorted(batch_context(spark, sf).select(*CONTEXT).collect(), key=str)


def arriving(spark, folder, batches):
    schema = "conv_id bigint, turn bigint, intent string, order_ref string, image_path string"
    (folder / "turns.parquet").mkdir(exist_ok=True)
    at = len(list((folder / "turns.parquet").iterdir()))
    for i, rows in enumerate(batches, at):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        part = next((folder / f"b{i}").glob("part-*.parquet"))
        (folder / "turns.parquet" / f"part{i}.parquet").write_bytes(part.read_bytes())
        time.sleep(1.1)
    return read_stream(spark, str(folder), "turns", spark.createDataFrame([], schema).schema, 1)


def test_turns_behind_a_gap_wait_and_are_answered_at_the_end(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[(1, 2, "return_risk", None, None), (2, 0, "policy", None, None)],
                                        [(1, 0, "return_risk", "A", None), (2, 9, "return_risk", None, None)],
                                        [(2, 7, "return_risk", "Z", None)]])
    path = str(tmp_path / "out")
    first = {(r["conv_id"], r["turn"]): r for r in carry_available(stream_carry_context(stream), "wait", path).collect()}
    assert len(first) == 5 and first[1, 2]["resolved_order"] == "A"  # turn 1 never came: answered at the end
    assert first[2, 9]["resolved_order"] == "Z" and not any(r["late"] for r in first.values())
    # the missing turn comes in a later run
    stream = arriving(spark, tmp_path, [[(1, 1, "return_risk", "B", None)], [(1, 0, "return_risk", "OLD", None)]])
    again = run_available(stream_carry_context(stream), "wait", path, idle_batches=False)
    rows = {(r["conv_id"], r["turn"], r["late"]): r for r in again.filter("conv_id = 1").collect()}
    assert rows[1, 1, False]["resolved_order"] == "B" and rows[1, 2, False]["resolved_order"] == "B"
    assert rows[1, 0, True]["resolved_order"] == "B"


def test_a_gap_is_passed_over_when_patience_ends(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[(1, 0, "return_risk", "A", None), (1, 3, "return_risk", None, None)],
                                        [(5, 0, "policy", None, None)], [(6, 0, "policy", None, None)],
                                        [(1, 4, "return_risk", None, None), (1, 1, "return_risk", "LATE", None)]])
    got = run_available(stream_carry_context(stream, patience_ms=1), "gap", idle_batches=False).collect()
    rows = {(r["conv_id"], r["turn"]): r for r in got}
    assert rows[1, 3]["resolved_order"] == "A" and not rows[1, 3]["late"]
    assert rows[1, 1]["late"] and rows[1, 4]["resolved_order"] == "A"


def test_rates_emit_closed_windows_only(spark, sf):
    got = run_available(stream_rates(read_stream(spark, sf, "events", EVENTS)), "rates")
    last = spark.read.parquet(f"{sf}/events.parquet").agg(
        (F.max("ts").cast("timestamp") - F.expr("interval 1 day")).alias("m")).first()["m"]
    starts = [r["window_start"] for r in got.collect()]
    assert starts and all((last - s).total_seconds() >= 86_400 for s in starts)
    assert got.agg(F.max("null_share")).first()[0] == 0.0


def test_rates_of_all_windows_do_not_depend_on_micro_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    write_parts(events, tmp_path, "events", F.xxhash64("event_id"), 4)
    write_parts(events.limit(7), tmp_path, "events2", "event_id", 1)  # another table, not to be read
    keys = ["window_start", "event_type"]
    results = []
    for folder, files in ((sf, None), (str(tmp_path), None), (str(tmp_path), 1)):
        rates = stream_rates(read_stream(spark, folder, "events", EVENTS, files), delay=None)
        results.append(sorted(run_updates(rates, keys, "rates").collect()))
    assert results[0] == results[1] == results[2]
    assert sum(r["n"] for r in results[0]) == events.count()
