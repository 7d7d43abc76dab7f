"""Structured Streaming forms of screening, context carry, scoring and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.models import score_return_risk
from ..operators.routing import context_writes, screen_turns, with_resolution
from ..operators.running import carry_forward
from ..session import ROCKSDB, work_dir


# A conversation's rows of one micro-batch are ordered in one task, so the size of a micro-batch
# bounds what that task holds even when one conversation sends a third of all rows.
BATCH_BYTES = 4 << 30


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType,
                max_files: int | None = None, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """A table, one parquet file or a folder of part files, as a stream; each micro-batch takes
    `max_files` files when given, else about `max_bytes`."""
    limit = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", max_bytes)
    # matches the file itself and the files in a folder of that name, and no other table's
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
            .option(*limit).parquet(f"{folder}/{name}.parquet"))


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(stream: DataFrame, name: str, path: str | None = None, idle_batches: bool = True) -> DataFrame:
    """Runs a stream over everything that has arrived into a parquet sink and reads it back.

    Sink and checkpoint live side by side, so a lost executor or a restart replays from there. A stream
    with processing-time timers asks for another batch without end; for it `idle_batches` must be off.
    """
    spark = stream.sparkSession
    path = path or work_dir(spark, name)
    before = spark.conf.get(IDLE)
    spark.conf.set(IDLE, str(idle_batches).lower())
    try:  # the query takes the setting over when it starts
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{path}/checkpoint")
                 .trigger(availableNow=True).start(f"{path}/rows"))
    finally:
        spark.conf.set(IDLE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, keys: list[str], name: str, path: str | None = None) -> DataFrame:
    """Runs an updating aggregation over everything that has arrived; the last state of every key.

    Each micro-batch writes what it changed to a folder of its own, so a replayed batch replaces
    what it wrote before, and windows that are still open at the end are part of the result.
    """
    spark = stream.sparkSession
    path = path or work_dir(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, *[F.col("v")[c].alias(c) for c in values])


def stream_screen(turns: DataFrame, text: str = "user_input", **phrases) -> DataFrame:
    """Injection flag, intent and route per arriving turn; no state."""
    return screen_turns(turns, text, **phrases)


CARRY_OUTPUT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("intent", T.StringType()), T.StructField("late", T.BooleanType()),
    T.StructField("session_order", T.StringType()),
    T.StructField("session_image", T.StringType())])


SESSION = T.StructType([T.StructField("order", T.StringType()), T.StructField("image", T.StringType()),
                        T.StructField("next", T.LongType())])
WAITING = T.StructType([T.StructField("intent", T.StringType()), T.StructField("order", T.StringType()),
                        T.StructField("image", T.StringType())])


class _Carry(StatefulProcessor):
    """Answers the turns of a conversation in order, whatever batches they come in.

    State: one small row (last order, last image, the turn expected next) and a map of turns that came
    before their predecessors. A turn is answered when all turns before it were; a gap that is not
    filled for `patience_ms` is passed over by a timer. State that nobody touched for `ttl_ms` goes.
    """

    def __init__(self, first: int, patience_ms: int, ttl_ms: int):
        self.first, self.patience_ms, self.ttl_ms = first, patience_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION, self.ttl_ms)
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("turn", T.LongType())]), WAITING, self.ttl_ms)

    def _held(self) -> tuple:
        return self.session.get() if self.session.exists() else (None, None, self.first)

    def _answer(self, conv, turn, intent, late, order, image) -> Row:
        return Row(conv_id=conv, turn=turn, intent=intent, late=late, session_order=order, session_image=image)

    def handleInputRows(self, key, rows, timerValues):
        order, image, expected = self._held()
        came = {}
        for row in rows:
            if row.turn < expected:  # its successors were answered without it
                yield self._answer(key[0], row.turn, row.intent, True, order, image)
            else:
                came[row.turn] = (row.intent, row.order_write, row.image_write)
        while True:
            if expected in came:
                intent, new_order, new_image = came.pop(expected)
            elif self.waiting.containsKey((expected,)):
                intent, new_order, new_image = self.waiting.getValue((expected,))
                self.waiting.removeKey((expected,))
            else:
                break
            order, image = order if new_order is None else new_order, image if new_image is None else new_image
            yield self._answer(key[0], expected, intent, False, order, image)
            expected += 1
        self.session.update((order, image, expected))
        if came:
            for turn, writes in came.items():
                self.waiting.updateValue((turn,), writes)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Passes over the gap before the earliest turns that wait, up to the next gap."""
        order, image, expected = self._held()
        turns = sorted(t[0] for t in self.waiting.keys())
        if not turns or turns[0] == expected:
            return
        expected = turns[0]
        for turn in turns:
            if turn != expected:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
                break
            intent, new_order, new_image = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            order, image = order if new_order is None else new_order, image if new_image is None else new_image
            yield self._answer(key[0], turn, intent, False, order, image)
            expected = turn + 1
        self.session.update((order, image, expected))

    def close(self) -> None:
        pass


HOUR_MS = 3_600_000


def stream_carry_context(screened: DataFrame, order: str = "order_ref", image: str = "image_path", first: int = 0,
                         patience_ms: int = HOUR_MS, ttl_ms: int = 30 * 24 * HOUR_MS) -> DataFrame:
    """Context per conversation on a screened stream (conv_id, turn, intent, inputs).

    The order input is carried as text: a key, or a struct of features turned into JSON first. Turns
    are numbered from `first` and answered in that order: one that comes early waits for those before
    it, `patience_ms` at most (see `_Carry`), so answers do not depend on micro-batches. A turn that
    comes after its successors were answered reads the state, writes nothing and is marked late. At the
    end of a bounded input `carry_available` answers what still waits behind a gap.
    """
    spark = screened.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    order_write, image_write = context_writes(order, image, screened.schema[order].dataType)
    written = screened.select("conv_id", "turn", "intent",
                              order_write.cast("string").alias("order_write"),
                              image_write.alias("image_write"))
    carried = written.groupBy("conv_id").transformWithState(
        statefulProcessor=_Carry(first, patience_ms, ttl_ms), outputStructType=CARRY_OUTPUT, outputMode="Append",
        timeMode="ProcessingTime")
    return with_resolution(carried, order, image)


def carry_available(carried: DataFrame, name: str, path: str | None = None, order: str = "order_ref",
                    image: str = "image_path") -> DataFrame:
    """Runs a `stream_carry_context` stream over everything that has arrived; every turn's answer.

    Turns that wait behind a missing one when the input ends are answered here, from the stored state and
    in order. The state is only read: if the missing turn arrives in a later run, the stream answers
    them again with it.
    """
    path = path or work_dir(carried.sparkSession, name)
    done = run_available(carried, name, path, idle_batches=False)
    spark = carried.sparkSession

    def state(variable: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", variable).load(f"{path}/checkpoint")
    sessions = state("session").select(F.col("key.conv_id").alias("c"), F.col("value.value.order").alias("kept_order"),
                                       F.col("value.value.image").alias("kept_image"))
    waiting = state("waiting").select(F.col("key.conv_id").alias("conv_id"), F.col("user_map_key.turn").alias("turn"),
                                      "user_map_value.value.*")
    # a handful of turns per conversation wait; a conversation whose first turn is missing may be long
    carry = carry_forward(waiting, "conv_id", "turn", {"new_order": F.col("order"), "new_image": F.col("image")})
    rest = carry.join(sessions, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", "turn", "intent", F.lit(False).alias("late"),
        F.coalesce("new_order", "kept_order").alias("session_order"),
        F.coalesce("new_image", "kept_image").alias("session_image"))
    return done.unionByName(with_resolution(rest, order, image).select(*done.columns))


def stream_score(orders: DataFrame, model, t_star: float) -> DataFrame:
    """Return risk and bucket of arriving orders."""
    return score_return_risk(orders, model, t_star)


def stream_rates(events: DataFrame, window: str = "1 day",
                 delay: str | None = "1 day") -> DataFrame:
    """Rows, null share and mean value per tumbling window and event type.

    With a `delay`, windows are emitted once the watermark has passed their end, and events behind
    it are discarded. Without one (for `run_updates`) every event counts whatever the micro-batches
    are, and the state holds one row per window and type. Means are formed from integer hundredths,
    so the order of arrival does not change them.
    """
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    hundredths = F.round(F.col("value") * 100).cast("bigint")
    grouped = ((stamped.withWatermark("at", delay) if delay else stamped)
               .groupBy(F.window("at", window), "event_type")
               .agg(F.count(F.lit(1)).alias("n"),
                    F.avg(F.col("value").isNull().cast("double")).alias("null_share"),
                    F.sum(hundredths).alias("total"), F.count("value").alias("n_values")))
    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
        "null_share", F.try_divide(F.col("total") / F.lit(100.0), F.col("n_values"))
        .alias("mean_value"))
