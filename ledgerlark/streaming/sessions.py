"""Chat sessions as keyed state: a stream of turns keeps the last turns of every conversation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, n_turns long, history string, expired boolean"


def histories(turns: DataFrame, last: int = 6, idle: str | None = None) -> DataFrame:
    """conv_id, n_turns, history (JSON: the last `last` turns in order as [turn, role, text], ties by
    role and text) of every conversation that a batch of the stream touches, whatever the batches. The
    state holds a number and `last` turns a conversation. With `idle` (turns have `ts`, and come at
    most that late), a conversation without a turn for so long ends: it is given once more with
    expired = true and leaves the state; later turns begin another. Null text counts as empty;
    turns without conv_id go into none."""
    rows = turns.where("conv_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    if idle:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
        wait = pd.Timedelta(idle)
    rows = rows.select("conv_id", "turn", "role", "text", *(["ts"] if idle else []))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept, latest = state.get if state.exists else (0, "[]", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "history": [kept], "expired": [True]})
            return
        found = [tuple(x) for x in json.loads(kept)]
        for part in parts:
            found += list(zip(part["turn"].tolist(), part["role"].tolist(), part["text"].tolist(), strict=True))
            n += len(part)
            found = sorted(found, key=lambda x: tuple((y is not None, y) if y is not None else (False, 0) for y in x))[-last:]
            if idle:
                latest = max(latest, int(part["ts"].max().value // 1_000_000))
        kept = json.dumps(found, ensure_ascii=False)
        state.update((n, kept, latest))
        if idle:
            state.setTimeoutTimestamp(max(latest + int(wait.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "history": [kept], "expired": [False]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("conv_id").applyInPandasWithState(update, OUT, "n long, kept string, latest long", "update", timeout)


def run_to_table(spark: SparkSession, folder: str, schema, out: str, last: int = 6, idle: str | None = None, files: int = 1) -> DataFrame:
    """Run the histories over a folder of turns, `files` files a batch, as far as it goes: (batch, conv_id,
    n_turns, history, expired). A batch that runs again replaces its own folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/histories/batch={batch}")

    query = histories(stream, last, idle).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{out}/histories")


def latest(found: DataFrame) -> DataFrame:
    """Each conversation as its last batch left it."""
    return found.groupBy("conv_id").agg(F.max_by(F.struct("n_turns", "history", "expired"), F.struct("batch", "n_turns")).alias("_s")).select("conv_id", "_s.*")
