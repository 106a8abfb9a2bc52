"""Streams of sections and answers: the batch operators on data that arrives in pieces."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.checking import parse_answer, problem
from ..operators.answers import ATTEMPTS
from ..operators.chunking import chunk_documents
from ..operators.commits import KEYS
from ..operators.sequences import BOOK

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_chunks(sections: DataFrame, max_chars: int = 5000, text: str = "markdown") -> DataFrame:
    """Sections as they arrive, cut into chunks; stateless, so equal to the batch result."""
    return chunk_documents(sections, max_chars, text)


class _Accept(StatefulProcessor):
    """State of a chunk: the attempts seen so far in any order, and, for a time, that it is done.

    What is done leaves the store when the horizon has passed, the attempts at once.
    """

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "attempt int", "response string, ms long")
        self.done = handle.getValueState("done", "done boolean", self.horizon)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = pd.DataFrame({c: pd.Series(dtype=object) for c in OUT})
        if self.done.exists():  # delivered again
            for _ in rows:
                pass
            yield out
            return
        original = None
        answers = {int(k[0]): (v[0], v[1]) for k, v in self.seen.iterator()}
        before = set(answers)
        for df in rows:
            original = df["original"].iloc[-1]
            fresh = df[df["attempt"].between(1, ATTEMPTS)].drop_duplicates("attempt")
            for n, response, ms in zip(fresh["attempt"].tolist(), fresh["response"].tolist(), fresh["ms"].tolist(), strict=True):
                answers.setdefault(int(n), (response, ms))
        pair = None
        for n in takewhile(answers.__contains__, range(1, ATTEMPTS + 1)):  # an attempt counts once all before it are known
            response, ms = answers[n]
            text = parse_answer(response or "")
            reason = problem(original or "", text)
            if reason is None or n == ATTEMPTS:
                pair = (text, False, None, ms) if reason is None else (original, True, reason, ms)
                break
        if pair is None:
            for n in answers.keys() - before:
                self.seen.updateValue((n,), answers[n])
        else:
            self.seen.clear()
            self.done.update((True,))
            out = pd.DataFrame([(*key, original, *pair)], columns=OUT)
        yield out

    def close(self) -> None:
        pass


OUT = [*KEYS, "original", "translation", "used_original", "reason", "ms"]
#: How long after a chunk is done its attempts may come again without being taken for new ones.
HORIZON_MS = 7 * 24 * 3600 * 1000


def stream_commit(attempts: DataFrame, horizon_ms: int = HORIZON_MS) -> DataFrame:
    """attempts (book, chunk, attempt, response, original, and ms if there is one) -> one pair for each chunk.

    The first valid attempt by number wins whatever the order of arrival, the source is kept
    after three that aren't; attempts delivered again within the horizon change nothing. The store holds the
    attempts of chunks that aren't decided, and of those that are a mark that goes horizon_ms of
    processing time later; what comes again after that is taken as new. Needs the state store STORE.
    """
    schema = ", ".join(f"{c} {attempts.schema[c].dataType.simpleString()}" for c in KEYS) + ", original string, translation string, used_original boolean, reason string, ms long"
    rows = attempts if "ms" in attempts.columns else attempts.withColumn("ms", F.lit(None).cast("long"))
    rows = rows.select(*KEYS, F.col("attempt").cast("int").alias("attempt"), "response", "original", F.col("ms").cast("long").alias("ms"))
    return rows.groupBy(*KEYS).transformWithStateInPandas(_Accept(horizon_ms), schema, "Append", "ProcessingTime")


def stream_progress(pairs: DataFrame) -> DataFrame:
    """Running counts of done and kept chunks per book, for output mode update or complete."""
    return pairs.groupBy(BOOK).agg(F.count("*").alias("done"), F.sum(F.col("used_original").cast("int")).alias("kept"))


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder that Spark reaches; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The batches of finished parts of a kind."""
    own = [n for n in _names(spark, path) if n.startswith(f"{kind}=")]
    return sorted(int(n.partition("=")[2]) for n in own if "_SUCCESS" in _names(spark, f"{path}/{n}"))


COUNTS = "done long, kept long"


def _counted(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """Counts per book of the last sum and the changes after it."""
    sums = [n for n in _numbers(spark, path, "sum") if upto is None or n <= upto]
    parts = [f"{path}/sum={sums[-1]}"] if sums else []
    parts += [f"{path}/change={n}" for n in _numbers(spark, path, "change") if (not sums or n > sums[-1]) and (upto is None or n <= upto)]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return rows.groupBy(BOOK).agg(F.sum("done").alias("done"), F.sum("kept").alias("kept"))


def merge_progress(pairs: DataFrame, path: str, sum_every: int = 100) -> StreamingQuery:
    """Count the pairs that have arrived into a table of changes under path, and stop; a restart goes on.

    A pair counts when its (book, chunk) is met for the first time, however often it is delivered. Each batch writes
    how the counts of its books change, as a part named by the batch: a batch that is run again after a
    crash writes the same part again, and what others wrote is never touched. Every sum_every batches the
    parts so far are summed into one, which read_progress() starts from.
    """
    spark, schema = pairs.sparkSession, f"{BOOK} {pairs.schema[BOOK].dataType.simpleString()}, {COUNTS}"

    def put(df: DataFrame, batch: int) -> None:
        own = df.sparkSession
        change = stream_progress(df).select(BOOK, F.col("done").cast("long"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
        change.write.mode("overwrite").parquet(f"{path}/rows/change={batch}")
        if batch % sum_every == sum_every - 1 and batch not in _numbers(own, f"{path}/rows", "sum"):
            _counted(own, f"{path}/rows", schema, batch).write.mode("overwrite").parquet(f"{path}/rows/sum={batch}")

    first = pairs.select(*KEYS, "used_original").dropDuplicates(KEYS)
    query = first.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_progress(spark: SparkSession, path: str, book_type: str = "string") -> DataFrame:
    """Counts per book of what merge_progress() has finished."""
    return _counted(spark, f"{path}/rows", f"{BOOK} {book_type}, {COUNTS}")


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there into Parquet files, and stop; a restart goes on where it ended.

    Batches without data are left out: a store whose marks expire by the clock would ask for them for ever.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)  # a query keeps what it was started with
    query.awaitTermination()
    return query


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a local master may leave it unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def work_off(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder."""
    path = shared_path(stream.sparkSession, name)
    run_available(stream, f"{path}/rows", f"{path}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def table_of(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
