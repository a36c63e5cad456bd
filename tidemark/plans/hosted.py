"""Stages that ask a hosted model (EXT-2, EXT-3): question by question with the rules as fallback, and batch jobs that resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle

#: Inputs of one request, and requests of a task before its answers are stored.
BATCH, REQUESTS = 128, 1


def ask(rows: DataFrame, call: Callable[[dict], list[dict]], result: str, key: str = "qid") -> DataFrame:
    """(key, result, error): ``call`` of each row as a dict gives the structs of ``result`` (a DDL text). Where it raises, or gives something else than those, result is null and error says why; other rows are not touched by that."""
    fields = T.ArrayType(T.StructType.fromDDL(result))
    kind = to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for row in batch.to_pylist():
                try:
                    answers.append(pa.array([call(row)], kind)[0])
                    errors.append(None if answers[-1].is_valid else "no answer")
                except Exception as error:  # noqa: BLE001  whatever the model's client raises
                    answers.append(pa.scalar(None, kind))
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.record_batch([batch.column(batch.schema.get_field_index(key)), pa.array([a.as_py() for a in answers], kind), pa.array(errors, pa.string())], [key, "result", "error"])

    schema = T.StructType([rows.schema[key], T.StructField("result", fields), T.StructField("error", T.StringType())])
    return rows.mapInArrow(run, schema)


def or_rules(asked: DataFrame, answered: DataFrame, rules: Callable[[DataFrame], DataFrame], complete: Callable[[DataFrame], DataFrame], key: str = "qid") -> DataFrame:
    """The hosted answers, and the rules' for the questions without one.

    ``answered`` has (key, result, error), as ``ask`` gives it; ``complete`` makes rows of
    the stage of its exploded results, and ``rules`` makes them of the questions
    that failed or are missing, found by an anti join. An answer without rows is one. An
    error in planning, or of the cluster, is raised: it says nothing about the model.
    """
    answered = settle(answered.dropDuplicates([key]))
    good = answered.where("error is null and result is not null")
    rows = complete(good.select(key, F.inline("result")))
    other = rules(asked.join(good.select(key), key, "left_anti"))
    return settle(other.unionByName(rows))


def stored_answers(rows: DataFrame, inputs: Sequence[str], model: Callable, kind: str, path: str, batch: int = BATCH, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``answer`` (of SQL type ``kind``): what ``model`` gives for their ``inputs``.

    ``model`` takes a list of texts, or of tuples where there are several inputs, and
    gives an answer for each. Answers are kept in the table at ``path`` under the
    SHA-256 of their inputs, so equal inputs are asked once, now and in later runs. What
    is missing is asked in waves of ``tasks`` requests of ``batch`` inputs (``tasks``:
    the session's cores), and each wave is stored before the next one begins: a run that
    is killed loses the answers of one wave, and a rerun asks only for what is not there.
    A null input is the empty text. Other columns stay, but for ``answer``.
    """
    spark = rows.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.sha2(F.concat_ws("", *[x for c in inputs for x in (F.length(text(c)).cast("string"), F.lit(":"), text(c))]), 256)
    keyed = rows.drop("answer").withColumn("_key", key)
    schema = f"_key string, answer {kind}"
    known = lambda: spark.read.schema(schema).parquet(path)
    missing = keyed.groupBy("_key").agg(*[F.first(text(c)).alias(f"_{i}") for i, c in enumerate(inputs)])
    if there(spark, path):
        missing = missing.join(known().select("_key"), "_key", "left_anti")
    missing = settle(missing)
    tasks = tasks or spark.sparkContext.defaultParallelism
    waves = -(-missing.count() // (batch * tasks * REQUESTS))
    arrow = to_arrow_type(T.StructType.fromDDL(f"answer {kind}")["answer"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for at in range(0, some.num_rows, batch):
                part = some.slice(at, batch)
                columns = [c.to_pylist() for c in part.columns[1:]]
                answers = model(columns[0] if len(columns) == 1 else list(zip(*columns, strict=True)))
                if len(answers) != part.num_rows:
                    raise ValueError(f"{part.num_rows} inputs, {len(answers)} answers")
                yield pa.record_batch([part.column(0), pa.array([a.tolist() if hasattr(a, "tolist") else a for a in answers], arrow)], ["_key", "answer"])

    turn = F.pmod(F.xxhash64("_key"), F.lit(max(1, waves)))
    for wave in range(waves):
        missing.where(turn == wave).repartition(tasks).mapInArrow(run, schema).write.mode("append").parquet(path)
    if not there(spark, path):
        return keyed.withColumn("answer", F.lit(None).cast(kind)).drop("_key")
    # Two runs at once may have stored an answer twice.
    return keyed.join(known().groupBy("_key").agg(F.first("answer").alias("answer")), "_key", "left").drop("_key")


def there(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def encoded(chunks: DataFrame, model: Callable, path: str, batch: int = BATCH) -> DataFrame:
    """IDX-10: vectors (source, kind, key, vector, idf) of a hosted or sentence encoder, each text asked once and kept at ``path``; unit length."""
    rows = stored_answers(chunks.select("source", "chunk_id", "text"), ["text"], model, "array<double>", path, batch)
    length = F.sqrt(F.aggregate("answer", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("source", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.transform("answer", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("vector"), F.lit(None).cast("double").alias("idf"))


def cross_encoder(model: Callable, path: str, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """RRK-9: a scorer for ``rerank`` and ``Engine``: ce_score of (question, text) pairs, each pair asked once and kept at ``path``."""
    return lambda candidates: stored_answers(candidates, ["query", "text"], model, "double", path, batch).withColumnRenamed("answer", "ce_score")
