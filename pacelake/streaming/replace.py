"""Late and changed input as a stream: files arrive, and each batch replaces by key what came before."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import Registry
from ..session import shared_folder

R = Registry()
C = F.col


def _newest(rows: DataFrame) -> DataFrame:
    """Of each key the row with the highest version, with both kept beside it."""
    return rows.groupBy("_key").agg(F.max_by("_row", "_version").alias("_row"), F.max("_version").alias("_version"))


def _numbers(spark, place: str, begins: str, holds: str = "") -> list[int]:
    """Numbers of the folders `begins`N of a place, in order, whose write (of `holds` within them) was finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path(place))] if files.exists(path(place)) else []
    return sorted(int(n[len(begins) :]) for n in names if n.startswith(begins) and files.exists(path(f"{place}/{n}{holds}/_SUCCESS")))


def _layers(spark, target: str, generation: int) -> tuple[str, list[str]]:
    """Folder of a generation's whole rows, and those of the changes that came after it."""
    place = f"{target}/generation={generation}"
    return f"{place}/whole", [f"{place}/change-{n}" for n in _numbers(spark, place, "change-")]


def stream_replace(source: DataFrame, target: str, checkpoint: str, keys: list[str], version: str) -> None:
    """Apply all that `source` (a stream) has: of each key the row with the highest `version` stays, whether it came in this batch or an
    earlier one (of equal versions the one that comes later).

    A batch writes its own rows only, as a change beside the whole rows of the last generation. Once the changes have as many bytes as
    those, they are merged into a new generation, so the bytes written stay in proportion to the bytes that came, however large the
    target is. The last two generations are kept. A batch that runs again starts from the generation it started from before and
    writes the same folders, and folders whose write wasn't finished are not read, so a lost executor or a restarted query
    changes nothing. Returns when the input is used up.
    """
    spark = source.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path

    def apply(batch: DataFrame, number: int) -> None:
        order = F.struct(C(version).alias("version"), F.lit(number).alias("batch"))
        rows = _newest(batch.select(F.struct(*keys).alias("_key"), order.alias("_version"), F.struct(*batch.columns).alias("_row")))
        earlier = [g for g in _numbers(spark, target, "generation=", "/whole") if g < number]
        if not earlier:
            rows.write.mode("overwrite").parquet(f"{target}/generation={number}/whole")
            return
        rows.write.mode("overwrite").parquet(f"{target}/generation={earlier[-1]}/change-{number}")
        whole, changes = _layers(spark, target, earlier[-1])
        files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        size = lambda place: files.getContentSummary(path(place)).getLength()
        if sum(map(size, changes)) >= size(whole):
            _newest(spark.read.parquet(whole, *changes)).write.mode("overwrite").parquet(f"{target}/generation={number}/whole")
            for old in earlier[:-1]:
                files.delete(path(f"{target}/generation={old}"), True)

    query = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def latest_generation(spark, target: str) -> DataFrame:
    """What the batches so far left: the last generation, with the changes after it."""
    whole, changes = _layers(spark, target, _numbers(spark, target, "generation=", "/whole")[-1])
    rows = spark.read.parquet(whole, *changes)
    return (_newest(rows) if changes else rows).select("_row.*")


def _replayed(t):
    """Records that arrive in many files, a few a batch, some of them late with an older version, give the same as one batch would."""
    base = shared_folder(t.spark)
    rows = t.events.select("event_id", "user_id", "value", F.lit(0).alias("version"))
    parts = [rows.where("event_id % 3 = 0").withColumns({"value": C("value") * 2, "version": F.lit(1)}), rows, rows.where("event_id % 5 = 0").withColumns({"value": C("value") * 3, "version": F.lit(2)})]
    for p in parts:
        p.repartition(4, "event_id").write.mode("append").parquet(f"{base}/in")
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    stream_replace(source, f"{base}/out", f"{base}/state", ["event_id"], "version")
    return latest_generation(t.spark, f"{base}/out").select("event_id", F.round("value", 6).alias("value"))


R.query("STR01_stream_replace", "select event_id, round(case when event_id % 5 = 0 then value * 3 when event_id % 3 = 0 then value * 2 else value end, 6) as value from events")(_replayed)


def dedup_stream(source: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key of a stream; state is dropped once the watermark has passed."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _deduped(t):
    base = shared_folder(t.spark)
    rows = t.events.select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"))
    rows.unionByName(rows.where("event_id % 4 = 0")).write.parquet(f"{base}/in")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    query = dedup_stream(source, ["event_id"], "ts", "60 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count("*").alias("n"))


R.query("STR01_stream_dedup", "select user_id, count(*) as n from events group by user_id")(_deduped)


class LatestRow(StatefulProcessor):
    """Of each key the row with the greatest (time, order), kept as state; a row is passed on only where it beats what was known.

    A timer at the row's time plus the delay drops the key's state once the watermark is there: no row that is still
    admitted can be older than that, so a key that comes again starts anew. State thus holds the keys of one delay only.
    """

    def __init__(self, time: str, order: str, delay_ms: int):
        self.time, self.order, self.delay_ms = time, order, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at long, ord long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(rows, key=self._version)
        found, known = self._version(newest), self.best.get()
        if known is None or found > (known[0], known[1]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.best.update(found)
            self.handle.registerTimer(found[0] // 1000 + self.delay_ms)
            yield newest

    def _version(self, row) -> tuple[int, int]:
        at = row[self.time].astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
        return at // timedelta(microseconds=1), row[self.order]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_latest(source: DataFrame, keys: list[str], time: str, order: str, delay: str, target: str, checkpoint: str) -> None:
    """Keep the newest row of each key of a stream in `target`: by `time`, of equal times by `order` (a whole number).

    Rows later than `delay` behind the newest time of earlier batches are left out. A batch writes only the rows that
    are newer than what the key's state knows, into a folder of its own number, which a repeated batch writes again. Returns when the
    input is used up. The session's state store is set to the one that this operator needs.
    """
    spark = source.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    delay_ms = spark.sql(f"select cast(unix_millis(timestamp_seconds(0) + interval {delay}) as long)").first()[0]
    latest = source.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(*keys).transformWithState(LatestRow(time, order, delay_ms), source.schema, "Update", "EventTime")
    query = latest.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def latest_rows(spark, target: str, schema, keys: list[str], time: str, order: str) -> DataFrame:
    """What the batches of `stream_latest` left: of each key the newest row."""
    rows = spark.read.schema(schema).parquet(*[f"{target}/batch={n}" for n in _numbers(spark, target, "batch=")])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(time, order)).alias("_b"))
    return best.select("_b.*")


def _latest_streamed(t):
    """Events in many files, in batches by week of arrival; what comes up to two weeks late still counts."""
    base = shared_folder(t.spark)
    rows = t.events.select("event_id", "user_id", "value", C("ts").cast("timestamp").alias("ts"))
    parts = max(4, min(16, rows.count() // 2000))
    rows.repartitionByRange(parts, "ts", "event_id").write.parquet(f"{base}/in")
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    stream_latest(source, ["user_id"], "ts", "event_id", "400 days", f"{base}/out", f"{base}/state")
    return latest_rows(t.spark, f"{base}/out", rows.schema, ["user_id"], "ts", "event_id").select("user_id", "event_id", F.round("value", 6).alias("value"))


R.query("STR01_stream_latest", "select user_id, event_id, round(value, 6) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")(_latest_streamed)
