"""Scores over streams: complete groups batch by batch, and running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Score each micro-batch of complete prompt groups, and hand the result and the batch's number to sink, which must take a batch twice alike. The batch
    is kept while it is scored, as scoring reads it more than once and state must not be moved on again."""

    def scored(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            sink(score(df), n)
        finally:
            df.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(scored).trigger(**(trigger or {"availableNow": True})).start()


def closed_groups(stream: DataFrame, prompt: str, run: str, raw: str, at: str, gap: int = 600, delay: str = "0 seconds") -> DataFrame:
    """Runs that arrive one at a time, handed on when their prompt is complete: prompt_id, run_id, raw, all rows of a prompt in one micro-batch.

    A prompt's runs are kept in its own state until no run has come for `gap` seconds of event time (column `at`), as seen from a watermark `delay` behind the
    latest event; a timer then hands them on and forgets them. Runs that come after that begin a new group. State and timers are in the checkpoint, so a
    stopped query goes on where it was. State is as large as the prompts still open; a prompt's runs must fit in a worker.
    """
    ship(stream.sparkSession)
    from pyspark.sql.streaming import StatefulProcessor

    milliseconds = 1000 * gap
    own = stream.select(F.col(prompt).alias("prompt_id"), F.col(run).alias("run_id"), F.col(raw).alias("raw"), F.col(at).alias("at")).withWatermark("at", delay)
    kept = "run_id {}, raw string".format(own.schema["run_id"].dataType.simpleString())
    kind = own.schema["prompt_id"].dataType.simpleString()

    class Open(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.runs, self.until = handle, handle.getListState("runs", kept), handle.getValueState("until", "until bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            latest = self.until.get()[0] if self.until.exists() else None
            new = latest
            for part in rows:
                part = part[part["at"].notna()]
                if len(part):
                    self.runs.appendList([(*r,) for r in part[["run_id", "raw"]].itertuples(index=False)])
                    last = int(part["at"].max().timestamp() * 1000) + milliseconds
                    new = last if new is None else max(new, last)
            if new is not None and new != latest:
                if latest is not None:
                    self.handle.deleteTimer(latest)
                self.handle.registerTimer(new)
                self.until.update((new,))
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            rows = [(*r,) for r in self.runs.get()] if self.runs.exists() else []
            self.runs.clear()
            self.until.clear()
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["prompt_id", "run_id", "raw"])

        def close(self) -> None:
            pass

    return own.groupBy("prompt_id").transformWithStateInPandas(Open(), f"prompt_id {kind}, {kept}", "append", "EventTime")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; one of our own where that is unset, in local mode only."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{there.rstrip('/')}/stream-{uuid.uuid4().hex}" if there else tempfile.mkdtemp(prefix="leafspan-stream-")


def file_totals(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Counts and means by key of a Parquet stream, once all that is there has been read. Every batch replaces a Parquet table of the totals, so the
    driver holds none of them and a batch that runs twice does no harm."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", path.rsplit("/", 1)[1]).load(path.rsplit("/", 1)[0])
    totals = source.groupBy(key).agg(F.count("*").alias("n_events"), F.avg(value).alias("mean_value"))
    folder = shared_folder(spark)
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/totals")
    q = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{folder}/totals")
