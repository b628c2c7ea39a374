"""The run guard on a stream of ticks: keyed by run, its state the last ticks of each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.guard import HELDOUT_DROP, LENGTH_FLOOR, PATIENCE, RULES, TRAIN_GAIN, TRUNC_CEILING

OUTPUT = "run string, step long, reason string"
STATE = "fired boolean, ticks string"


def guarded(ticks: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """(run, step, reason), once a run, when its guard first fires. ticks: run, step, train_reward, spotcheck_total,
    tokens, ref_tokens, truncated_rate. Ticks of a micro-batch are taken in order of step; there is no event time."""

    def judge(held: list) -> str | None:
        if len(held) < patience:
            return None
        first, last = held[0], held[-1]
        ratios = [t[3] / t[4] for t in held if t[4]]
        if last[1] - first[1] >= TRAIN_GAIN and last[2] - first[2] <= -HELDOUT_DROP:
            return RULES[0]
        if ratios and sum(ratios) / len(ratios) < LENGTH_FLOOR:
            return RULES[1]
        return RULES[2] if sum(t[5] for t in held) / len(held) > TRUNC_CEILING else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        fired, kept = state.get if state.exists else (False, "[]")
        held, out = json.loads(kept), []
        rows = [r for pdf in batches for r in pdf[["step", "train_reward", "spotcheck_total", "tokens", "ref_tokens", "truncated_rate"]].itertuples(index=False)]
        for r in sorted(rows, key=lambda r: r.step):
            if fired:
                break
            ref = 0 if pd.isna(r.ref_tokens) else float(r.ref_tokens)
            held = [*held, [int(r.step), float(r.train_reward), float(r.spotcheck_total), float(r.tokens), ref, float(r.truncated_rate)]][-patience:]
            if why := judge(held):
                fired = True
                out.append((key[0], int(r.step), why))
        state.update((fired, json.dumps(held)))
        yield pd.DataFrame(out, columns=["run", "step", "reason"])

    return ticks.groupBy("run").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(history: DataFrame, folder: str, parts: int = 3, patience: int = PATIENCE) -> DataFrame:
    """(run, step, reason) of a run's first abort, as first_abort has them, by the stream: a history comes in parts, by ranges of
    steps, and after each the stream is run to its end and stopped. The next takes up from its checkpoint, where each
    run's last ticks are held, so no tick is read twice. No ticks give no row."""
    spark = history.sparkSession
    low, high = history.agg(F.min("step"), F.max("step")).first()
    ticks = history.select("run", F.col("step").cast("long").alias("step"), *[F.col(c).cast("double") for c in ("train_reward", "spotcheck_total", "tokens")], F.col("ref_tokens").cast("long"), F.col("truncated_rate").cast("double"))
    for k in range(parts if low is not None else 0):
        since, until = low + (high + 1 - low) * k // parts, low + (high + 1 - low) * (k + 1) // parts
        ticks.filter((F.col("step") >= since) & (F.col("step") < until)).write.mode("append").parquet(f"{folder}/ticks")
        stream = spark.readStream.schema(ticks.schema).parquet(f"{folder}/ticks")
        out = guarded(stream, patience).writeStream.format("parquet").option("path", f"{folder}/aborts").option("checkpointLocation", f"{folder}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/aborts") if low is not None else spark.createDataFrame([], OUTPUT)
