"""Batch inference with a user's callable, memoised in a table."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from propflow.functions.responses import parse_response
from propflow.operators.memo import DIGITS, Memo
from propflow.session import materialize, scratch_path


class Patience(NamedTuple):
    """How often a failed call is made again, after how many seconds (doubled each time), and how long one may take."""

    retries: int = 0
    delay: float = 5.0
    timeout: float | None = None


ONE_TRY = Patience()

FEW_WAVES = 4

MEMO_SCHEMA = "memo_key string, result string"


def safe_codec(codec: Callable[[str], object], returns: str | DataType) -> Callable[[Column], Column]:
    """A vectorised column function that gives null for null, '' and values the codec rejects."""

    def attempt(value: str | None) -> object:
        if not value:
            return None
        try:
            return codec(value)
        except Exception:
            return None

    @F.pandas_udf(returns)
    def convert(values: pd.Series) -> pd.Series:
        answers = {value: attempt(value) for value in values.unique()}
        return values.map(answers.get)

    return convert


def accepts(check: Callable[[str], bool], column: Column) -> Column:
    """True where the check holds; false for null, '' and values it fails on."""
    return F.coalesce(safe_codec(check, "boolean")(column), F.lit(False))


def apply_codec(
    df: DataFrame, column: str, codec: Callable[[str], object], out: str, returns: str
) -> DataFrame:
    """Adds the codec's result and `<out>_failed`, true where a value was given but none came back."""
    done = df.withColumn(out, safe_codec(codec, returns)(F.col(column)))
    given = F.coalesce(F.length(column) > 0, F.lit(False))
    return done.withColumn(f"{out}_failed", given & F.col(out).isNull())


def apply_codec_once(
    df: DataFrame, column: str, codec: Callable[[str], object], out: str, returns: str
) -> DataFrame:
    """As `apply_codec`, with the codec asked once per distinct value of the whole table."""
    values = df.select(F.col(column).alias("_value")).where(F.length("_value") > 0).distinct()
    coded = materialize(values.withColumn(out, safe_codec(codec, returns)(F.col("_value"))))
    done = df.join(coded, F.col(column) == F.col("_value"), "left").drop("_value")
    given = F.coalesce(F.length(column) > 0, F.lit(False))
    return done.withColumn(f"{out}_failed", given & F.col(out).isNull())


def _within(timeout: float, model: Callable[..., str], values: tuple) -> str:
    """The model's answer; a call that takes longer is left behind in its thread."""
    outcome: list[tuple[bool, object]] = []

    def run() -> None:
        try:
            outcome.append((True, model(*values)))
        except Exception as error:
            outcome.append((False, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(timeout)
    if not outcome:
        raise TimeoutError(f"no answer within {timeout:g} s")
    answered, value = outcome[0]
    if not answered:
        raise value
    return value


def attempt_call(model: Callable[..., str], values: tuple, patience: Patience) -> tuple[str | None, str | None]:
    """(answer, None) or, after the last try, (None, error)."""
    for attempt in range(patience.retries + 1):
        if attempt:
            time.sleep(patience.delay * 2 ** (attempt - 1))
        try:
            return (_within(patience.timeout, model, values) if patience.timeout else model(*values)), None
        except Exception as error:
            last = f"{type(error).__name__}: {error}"
    return None, last


def infer(
    requests: DataFrame,
    key: str,
    arguments: list[str],
    model: Callable[..., str],
    in_flight: int = 40,
    tasks: int | None = None,
    patience: Patience = ONE_TRY,
) -> DataFrame:
    """(key, result, error): `model(*arguments)` per row, `in_flight` at a time in each task.

    A failing call keeps its row, with the error of its last try in place of the result. `tasks`
    spreads the requests: small texts that wait long are worth more tasks than
    their bytes suggest.
    """

    def call(values: tuple) -> tuple[str | None, str | None]:
        return attempt_call(model, values, patience)

    names = [key, *arguments]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, in_flight):
                piece = batch.slice(at, in_flight)
                yield from zip(*(piece.column(name).to_pylist() for name in names), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple] = deque()  # the calls in flight: no other rows are Python objects
        done: list[tuple] = []

        def answers() -> pa.RecordBatch:
            arrays = [pa.array(list(values), kind) for values, kind in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, [key, "result", "error"])

        def settle() -> None:
            own, answer = waiting.popleft()
            done.append((own, *answer.result()))

        with ThreadPoolExecutor(in_flight) as pool:
            for own, *values in rows(batches):
                waiting.append((own, pool.submit(call, tuple(values))))
                if len(waiting) == in_flight:
                    settle()
                    if len(done) == in_flight:
                        yield answers()
            while waiting:
                settle()
            if done:
                yield answers()

    asked = requests.select(key, *(name for name in arguments if name != key))
    asked = asked.repartition(tasks) if tasks else asked
    key_type = asked.schema[key].dataType.simpleString()
    kinds = [to_arrow_type(asked.schema[key].dataType), pa.string(), pa.string()]
    return asked.mapInArrow(run, f"`{key}` {key_type}, result string, error string")


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    """The memo table at `path`, empty when nothing was stored yet."""
    try:
        return spark.read.schema(MEMO_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MEMO_SCHEMA)


def memo_misses(requests: DataFrame, memo: DataFrame, arguments: list[str]) -> DataFrame:
    """(memo_key, arguments) of the distinct requests the memo does not answer.

    Equal requests collapse before they move, whatever number of rows asks them.
    """
    asked = requests.groupBy("memo_key").agg(F.min(F.struct(*arguments)).alias("_call"))
    unknown = asked.join(memo.select("memo_key").distinct(), "memo_key", "left_anti")
    return unknown.select("memo_key", "_call.*")


def merge_memo(requests: DataFrame, memo: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each request with its stored or fresh result and the error of a failed call."""
    stored = memo.groupBy("memo_key").agg(F.min("result").alias("result")).select(
        "memo_key", "result", F.lit(None).cast("string").alias("error"), F.lit(True).alias("memo_hit")
    )
    new = fresh.select("memo_key", "result", "error", F.lit(False).alias("memo_hit"))
    return requests.join(stored.unionByName(new), "memo_key", "left")


def memoised_infer(
    requests: DataFrame,
    arguments: list[str],
    model: Callable[..., str],
    memo_path: str,
    in_flight: int = 40,
    tasks: int | None = None,
) -> DataFrame:
    """Answers `requests` (with `memo_key`), calling the model once per unknown key.

    The answers are written down before they are used, so no later job asks again;
    failures are not stored, so a later run retries them. Turn speculation off for
    such jobs: a second attempt of a task asks its rows again.
    """
    memo = read_memo(requests.sparkSession, memo_path)  # its file list is fixed here
    unknown = memo_misses(requests, memo, arguments)
    fresh = materialize(infer(unknown, "memo_key", arguments, model, in_flight, tasks))
    fresh.where("error is null").select("memo_key", "result").write.mode("append").parquet(memo_path)
    return merge_memo(requests, memo, fresh)


def ask_in_waves(
    requests: DataFrame,
    arguments: list[str],
    model: Callable[..., str],
    memo_path: str,
    in_flight: int = 40,
    tasks: int | None = None,
    waves: int = 4,
    patience: Patience = ONE_TRY,
    digits: int = DIGITS,
) -> DataFrame:
    """Answers `requests` (with `memo_key`) from the `Memo` at the path, calling the model once per unknown key.

    The keys are asked in `waves` by prefix; each wave's answers and errors are committed to the memo
    before the next begins, so a job that is lost asks again only what its last wave asked. Only the
    asked prefixes of the memo are read; `digits` of a key make one, the same in all runs over a memo. A
    stored error is asked again by a later run. Turn speculation off for such jobs: a second attempt of
    a task asks its rows again.
    """
    memo = Memo(requests.sparkSession, memo_path, digits)
    before = max(memo.generations(), default=0)
    slim = requests.where("memo_key is not null").select("memo_key", *arguments).withColumn("_prefix", memo.prefix())
    asked = sorted(r._prefix for r in slim.select("_prefix").distinct().collect())  # at most 16 ** digits
    groups = {i: own for i in range(waves) if (own := [p for p in asked if int(p, 16) % waves == i])}
    apart = len(groups) > FEW_WAVES  # many waves read their own requests only, few read all of them again
    if apart:
        wave = F.pmod(F.conv("_prefix", 16, 10).cast("int"), F.lit(waves))
        path = scratch_path(requests.sparkSession, "requests")
        slim.withColumn("_wave", wave).write.partitionBy("_wave").parquet(path)
        slim = requests.sparkSession.read.schema(f"{_ddl(slim)}, _wave int").parquet(path)
    for i, prefixes in groups.items():
        mine = slim.where(F.col("_wave") == i) if apart else slim.where(F.col("_prefix").isin(prefixes))
        known = memo.latest(prefixes).where("error is null")
        if mine.select("memo_key").join(known.select("memo_key"), "memo_key", "left_anti").isEmpty():  # moves keys only
            continue
        unknown, home = memo_misses(mine, known, arguments), F.substring("memo_key", 1, memo.digits + 1)
        if tasks:
            memo.commit(infer(unknown.repartition(tasks, home), "memo_key", arguments, model, in_flight, patience=patience))
        else:  # the answers move to their folders, not the longer requests
            memo.commit(infer(unknown, "memo_key", arguments, model, in_flight, patience=patience).repartition(home))
    last = memo.latest(asked).withColumn("memo_hit", F.col("error").isNull() & (F.col("generation") <= before))
    return requests.join(last.drop("generation"), "memo_key", "left")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def refined_prompt(refined: Column, prompt: Column) -> Column:
    """The trimmed refined prompt, or the original one where refining failed."""
    return F.coalesce(F.trim(refined), prompt)


def explode_endpoints(entities: DataFrame, endpoints: list[str], out: str = "endpoint") -> DataFrame:
    """One request per entity and endpoint."""
    return entities.withColumn(out, F.explode(F.array(*(F.lit(e) for e in endpoints))))


def gather_endpoints(answers: DataFrame, entity: list[str], endpoints: list[str]) -> DataFrame:
    """One row per entity: `lc50_<endpoint>`, `confidence_<endpoint>` and the error of a failed call."""
    parsed = answers.withColumn("_answer", parse_response(F.col("result")))

    def of(endpoint: str, field: str) -> Column:
        return F.max(F.when(F.col("endpoint") == endpoint, F.col(f"_answer.{field}")))

    return parsed.groupBy(*entity).agg(
        *(of(e, field).alias(f"{field}_{e}") for e in endpoints for field in ("lc50", "confidence")),
        F.max("error").alias("error"),
    )
