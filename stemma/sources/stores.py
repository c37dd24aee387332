"""Long-form stores for what runs leave behind: count tables, parameters, posteriors, and the stages of a study."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_counts(counts: DataFrame, path: str, kind: str) -> None:
    """Writes nonzero counts as a part (kind) of the table at ``path``, in place of that part."""
    counts.where("n <> 0").write.mode("overwrite").parquet(f"{path}/kind={kind}")


def load_counts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/kind={kind}")


def save_parameters(values: DataFrame, path: str, run: str, iteration: int) -> None:
    """Writes parameters (name, idx array<int>, value) as one iteration of a run; a repeated one replaces itself."""
    values.select("name", F.col("idx").cast("array<int>").alias("idx"), F.col("value").cast("double").alias("value")).write.mode("overwrite").parquet(f"{path}/run={run}/iter={iteration}")


def load_parameters(spark: SparkSession, path: str, run: str, iteration: int | None = None) -> DataFrame:
    """iter, name, idx, value of an iteration of a run, or of its last one."""
    rows = spark.read.schema("name string, idx array<int>, value double, run string, iter int").option("basePath", path).parquet(path).where(F.col("run") == run)
    if iteration is not None:
        rows = rows.where(F.col("iter") == iteration)
    last = F.max("iter").over(Window.partitionBy("run"))  # a run's parameters are few
    return rows.withColumn("_last", last).where("iter = _last").select("iter", "name", "idx", "value")


def parameters_key(values: DataFrame) -> str:
    """A hash of parameters (name, idx, value) by their contents alone."""
    line = F.concat_ws("|", "name", F.to_json("idx"), F.format_string("%.17g", "value"))
    return values.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256)).first()[0]


def save_posteriors(cells: DataFrame, path: str, method: str, key: str) -> None:
    """Writes posteriors (fam, ...) under the method and the hash of its parameters; a family's replace what was there."""
    cells.withColumns({"method": F.lit(method), "params_key": F.lit(key)}).write.partitionBy("method", "params_key", "fam").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_posteriors(spark: SparkSession, path: str, method: str, key: str) -> DataFrame:
    """The posteriors of exactly these parameters; others' aren't read."""
    return spark.read.parquet(path).where((F.col("method") == method) & (F.col("params_key") == key)).drop("method", "params_key")


def save_stage(rows: DataFrame, path: str, stage: str) -> DataFrame:
    """Stores the rows of a study's stage (simulation, observation, reconstruction, scores) and returns them as read back."""
    rows.write.mode("overwrite").parquet(f"{path}/{stage}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{stage}")


def machine_json(transitions: list[tuple[str, str, str | None, str | None, float]]) -> str:
    """A state machine as JSON, from (state, next state, input, output, weight): the first state begins, the last one ends."""
    names = list(dict.fromkeys(x for a, b, *_ in transitions for x in (a, b)))
    number = {n: k for k, n in enumerate(names)}
    states = [{"n": k, "id": n, "trans": [{"to": number[b], **({"in": i} if i else {}), **({"out": o} if o else {}), "weight": w} for a, b, i, o, w in transitions if a == n]} for k, n in enumerate(names)]
    return json.dumps({"state": states})


def write_machine(spark: SparkSession, transitions: list[tuple[str, str, str | None, str | None, float]], path: str) -> None:
    """Writes a machine's JSON as one text file; a machine has a few states."""
    spark.createDataFrame([(machine_json(transitions),)], "value string").coalesce(1).write.mode("overwrite").text(path)
