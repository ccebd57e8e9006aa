"""The store's periodic and stateful work as Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.session import ensure_checkpoint_dir


def follow(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's files as a stream; the schema comes from the files that are there."""
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, as the table may be one file or a folder of files
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return stream.select(*columns) if columns else stream


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all files there are, then reads back its output.

    Output and checkpoint lie in the shared folder. A batch that is run again writes to its own folder again, so a
    lost driver or executor doubles nothing; in complete mode the last batch holds the whole result.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        written.append(number)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/batch={n}" for n in (written if mode == "append" else written[-1:])])


def once(stream: DataFrame, at: str) -> DataFrame:
    """Each record once, however often and in whatever order it is delivered: no row is ever late.

    Rows are one record if they are equal in all columns of the stream, so what comes out doesn't depend on which of
    two came first. What was seen stays in the state, spread over its partitions; the tables tell no time after which
    a record can't return.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).dropDuplicates()


def audit_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """(action, ok, start, n): tumbling counts of a stream of audit rows."""
    counts = stream.groupBy("action", "ok", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("action", "ok", F.to_timestamp_ntz(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "n")


def gate_log(stream: DataFrame) -> DataFrame:
    """(day, n, status): one line a day, FAIL if anything failed on it."""
    return stream.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_and("ok"), "OK").otherwise("FAIL").alias("status"))


def captured_sessions(stream: DataFrame, gap: str = "13 hours") -> DataFrame:
    """(session_id, start, end, n): activity of each session, closed when nothing comes for `gap`."""
    s = stream.where("session_id <> '' AND NOT startswith(session_id, 'cron')").groupBy("session_id", F.session_window("ts", gap).alias("w"))
    counts = s.agg(F.count(F.lit(1)).alias("n"))
    as_ntz = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return counts.select("session_id", as_ntz("w.start").alias("start"), as_ntz("w.end").alias("end"), "n")


def to_inject(stream: DataFrame, window: int = 5, together: bool = False, repeats: int = 0) -> DataFrame:
    """(session_id, fact_id, turn) of the facts to inject: not again within `window` turns of the last injection.

    stream: session_id, fact_id, at, id. A session's turns are counted from 1 as its rows come, those that come
    together in order of `at` and `id`. Its state is the number of turns and the last injection of each fact, which is
    dropped after `window` turns, so it stays small however long a session gets. With `together`, rows of one `at` that
    come in one trigger are one turn; if all facts of a turn were injected lately, the `repeats` longest ago come again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, last = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        for _, facts in rows.groupby(rows["at"] if together else list(range(len(rows))), sort=False)["fact_id"]:
            turn += 1
            facts = list(dict.fromkeys(facts))
            chosen = [f for f in facts if f not in last or turn - last[f] > window]
            chosen = chosen or sorted(facts, key=lambda f: last[f])[:repeats]
            out += [(key[0], f, turn) for f in chosen]
            last = {f: t for f, t in (last | dict.fromkeys(chosen, turn)).items() if turn - t <= window}
        state.update((turn, json.dumps(last)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "fact_id", "turn"])

    return stream.groupBy("session_id").applyInPandasWithState(
        step, "session_id string, fact_id string, turn bigint", "turn bigint, last string", "append", GroupStateTimeout.NoTimeout
    )


def injected(rows: DataFrame, window: int = 5) -> DataFrame:
    """The same in a batch: a fold over the sorted turns of each session and fact."""
    turns = rows.groupBy("session_id", "fact_id").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    kept = F.aggregate(
        "turns",
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > window), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return turns.select("session_id", "fact_id", F.explode(kept).alias("turn"))
