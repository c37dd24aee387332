"""Structured Streaming jobs: windowed counts, sessions and running averages over an event stream.

Sources are directories of Parquet files.  ``finished`` drives a query over what is there now and
returns its last result as a table, which is also how tests compare it with the batch form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import quadratic_rates
from ..functions.storage import scratch
from ..operators import mixture, unaligned

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, *, per_trigger: int = 4) -> DataFrame:
    """The events table as a stream, ``per_trigger`` files to a micro-batch; the table is a directory of part files or a single file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)  # fails where there is none
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger)
    raw = raw.parquet(f"{folder}/events.parquet") if status.isDirectory() else raw.option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Runs ``stream`` over all input that is available and returns its result.

    Each micro-batch is written under its own number, so a batch that is repeated after a failure
    replaces itself; in complete mode the last one is the result.  Run again with the same ``folder`` it goes on
    where it stopped, and returns the result over all input so far.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    numbers = batches(spark, f"{folder}/batches")
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    wanted = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/batches/batch={n}" for n in wanted))


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches written to ``folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def stepped(stream: DataFrame, folder: str, schema: str, start: dict, step: Callable[[DataFrame, int, dict], dict]) -> DataFrame:
    """batch and the state after it, one row a micro-batch: ``step`` makes each from the batch's rows, its number and the state before.

    States are a few numbers.  They are stored beside the stream's checkpoint, each under its batch's number,
    so a repeated batch replaces its state and a stopped run goes on from the last one.
    """
    spark = stream.sparkSession
    at = lambda n: f"{folder}/states/batch={n}"

    def keep(batch: DataFrame, number: int) -> None:
        before = start if number == 0 else spark.read.schema(schema).parquet(at(number - 1)).first().asDict()
        after = step(batch, number, before)
        names = spark.createDataFrame([], schema).columns
        spark.createDataFrame([tuple(after[c] for c in names)], schema).coalesce(1).write.mode("overwrite").parquet(at(number))

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if not batches(spark, f"{folder}/states"):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{folder}/states").parquet(f"{folder}/states")


def windowed_counts(stream: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of each event-time window; state older than ``lateness`` is dropped in append mode."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_totals(stream: DataFrame) -> DataFrame:
    """user_id, n, total, greatest: additive statistics that any number of micro-batches build up."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("greatest"))


def sessions(stream: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """user_id, start, finish, n of each run of events without a pause of ``gap``."""
    return stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("finish"), "n")


def minibatch_average(stream: DataFrame, kappa: float = 0.6, delay: float = 1.0, folder: str | None = None) -> list[tuple[int, float]]:
    """(batch, estimate): the stochastic average of ``value`` with steps (k + delay) ** -kappa.

    One number of each micro-batch reaches the driver; the step sizes go by the batch number, so a
    repeated batch repeats its step, and a run that is given the ``folder`` of a stopped one goes on with it.
    """

    def step(batch: DataFrame, number: int, before: dict) -> dict:
        mean = batch.agg(F.avg("value")).first()[0]
        eta = (number + 1 + delay) ** -kappa
        return before if mean is None else {"estimate": (1 - eta) * before["estimate"] + eta * mean}

    states = stepped(stream, folder or scratch(stream.sparkSession, "average"), "estimate double", {"estimate": 0.0}, step)
    return sorted((r.batch, r.estimate) for r in states.collect())


def link_rates(stream: DataFrame, pairs: int, folder: str, *, start: tuple[float, float] = (0.03, 0.05), kappa: float = 0.6, delay: float = 1.0) -> DataFrame:
    """batch, lam, mu and the running statistics of the link model's rates, fitted a micro-batch at a time.

    ``stream`` has a row for each pair (tau, n_alpha ... n_1mkappa).  A batch's expected statistics at the rates
    so far are scaled up to all ``pairs`` pairs and averaged into the running ones with step (batch + 1 + delay)
    ** -kappa; the first batch's are taken whole.  The rates that the running statistics give are next.
    """
    def step(batch: DataFrame, number: int, before: dict) -> dict:
        made = mixture.link_statistics(batch.withColumns({"lam": F.lit(before["lam"]), "mu": F.lit(before["mu"])}))
        sums = made.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in mixture.STATISTICS)).first()
        if not sums.n:
            return before
        eta = 1.0 if before["T"] == 0 else (number + 1 + delay) ** -kappa
        running = {k: (1 - eta) * before[k] + eta * sums[k] * pairs / sums.n for k in mixture.STATISTICS}
        new = batch.sparkSession.range(1).select(*quadratic_rates(*(F.lit(float(running[c])) for c in mixture.STATISTICS))).first()
        return {"lam": float(new[0]), "mu": float(new[1]), **running}

    schema = "lam double, mu double, " + ", ".join(f"{c} double" for c in mixture.STATISTICS)
    return stepped(stream, folder, schema, {"lam": start[0], "mu": start[1], **dict.fromkeys(mixture.STATISTICS, 0.0)}, step)


def unaligned_rates(stream: DataFrame, pairs: int, folder: str, t: float, size: int, *, start: tuple[float, float, float] = (0.03, 0.05, 0.3), kappa: float = 0.6, delay: float = 1.0) -> DataFrame:
    """batch, lam, mu, ext, seen and the running statistics of the fragment model, from pairs whose alignments aren't known.

    ``stream`` has pairs (pair_id, x, y) at time ``t``.  A batch's statistics are expected over all of its pairs' alignments at the rates so far,
    scaled up to all ``pairs`` pairs and averaged into the running ones as in ``link_rates``; ``seen`` counts the pairs of all batches.
    """
    names = [*mixture.STATISTICS, "extended", "ended"]

    def step(batch: DataFrame, number: int, before: dict) -> dict:
        rates = before["lam"], before["mu"], before["ext"]
        _, steps, n = unaligned.expected(batch, rates, t, size)
        if not n:
            return before
        found = unaligned.statistics(batch.sparkSession, steps, rates, t, size)
        eta = 1.0 if before["seen"] == 0 else (number + 1 + delay) ** -kappa
        running = {k: (1 - eta) * before[k] + eta * found[k] * pairs / n for k in names}
        lam, mu, ext = unaligned.maximised(batch.sparkSession, running)
        return {"lam": lam, "mu": mu, "ext": ext, "seen": before["seen"] + n, **running}

    schema = "lam double, mu double, ext double, seen long, " + ", ".join(f"{c} double" for c in names)
    return stepped(stream, folder, schema, {"lam": start[0], "mu": start[1], "ext": start[2], "seen": 0, **dict.fromkeys(names, 0.0)}, step)
