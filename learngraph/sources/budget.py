"""Model calls within a budget that holds for the whole cluster.

Prompts are asked in waves. A wave has as many partitions as there are call slots, so no more calls are open at once however many cores there
are, and each partition paces its calls so that all together keep the rate. A call that meets a rate limit ends its partition's
wave: no task waits and knocks again. Between waves the driver lowers the rate where a limit was met, and raises it slowly
where none was, up to the budget; what was not answered is asked in a later wave. Answers are written wave by wave, so none is lost or asked for
again. Speculative execution must be off, as a second copy of a task would call too.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.shared import written
from learngraph.sources.connectors import RateLimited, prompt_key

SCHEMA = "key string, response string, status string"
LIMITED, WAITING = "limited", "waiting"


@dataclass(frozen=True)
class Budget:
    slots: int = 8  # calls at once
    per_minute: float = 600.0  # calls at most, and to begin with
    least: float = 1.0  # calls a minute that the rate never falls below
    fall: float = 0.5
    rise: float = 1.25
    seconds: float = 60.0  # of a wave's calls
    wait: float = 10.0  # before the wave after a limit; twice as long after each further one in a row
    longest_wait: float = 600.0
    patience: int = 20  # waves in a row without any answer, after which the rest counts as failed


def call_within(prompts: DataFrame, client: Callable[[], Callable], budget: Budget, *, temperature: float = 0.2, replay: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, list[tuple[float, int, int]]]:
    """key, batch, model, response and status of prompts (batch, model, messages), and each wave's rate, answers and limits met.

    ``client`` makes a callable (messages, model, temperature) -> text that raises ``RateLimited`` at once. Prompts of one key are asked once. Those whose
    key stands in ``replay`` (key, response, status) aren't asked. A failing call has status ``error: ...`` and isn't repeated here.
    """
    if prompts.sparkSession.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("calls within a budget need spark.speculation to be off")
    keyed = written(prompts.select("batch", "model", "messages").withColumn("key", prompt_key(F.col("messages"), F.col("model"), temperature)), "prompts")
    open_ = keyed.groupBy("key").agg(F.first("model").alias("model"), F.first("messages").alias("messages"))
    done = keyed.sparkSession.createDataFrame([], SCHEMA)
    if replay is not None:
        done = replay.where("status = 'ok'").groupBy("key").agg(F.max("response").alias("response")).select("key", "response", F.lit("ok").alias("status"))
        open_ = open_.join(done.select("key"), "key", "left_anti")
    open_ = written(open_, "open-prompts")
    rate, wait, idle, history = budget.per_minute, budget.wait, 0, []
    while not open_.isEmpty():
        size = max(budget.slots, int(rate * budget.seconds / 60))
        made = written(_wave(open_.orderBy("key").limit(size), client, budget.slots, 60 * budget.slots / rate, temperature), "wave")
        counts = {r["status"]: r["n"] for r in made.groupBy(F.when(F.col("status").isin("ok", LIMITED, WAITING), F.col("status")).otherwise("error").alias("status")).agg(F.count(F.lit(1)).alias("n")).collect()}
        history.append((rate, counts.get("ok", 0), counts.get(LIMITED, 0)))
        told = made.where(~F.col("status").isin(LIMITED, WAITING))
        done = done.unionByName(told)
        open_ = written(open_.join(told.select("key"), "key", "left_anti"), "open-prompts")
        idle = idle + 1 if not counts.get("ok", 0) + counts.get("error", 0) else 0
        if idle >= budget.patience:
            done = done.unionByName(open_.select("key", F.lit(None).cast("string").alias("response"), F.lit("error: RateLimited").alias("status")))
            break
        if counts.get(LIMITED, 0):
            rate = max(budget.least, rate * budget.fall)
            sleep(wait)
            wait = min(2 * wait, budget.longest_wait)
        else:
            rate, wait = min(budget.per_minute, rate * budget.rise), budget.wait
    return keyed.join(done, "key").select("key", "batch", "model", "response", "status"), history


def _wave(prompts: DataFrame, client: Callable[[], Callable], slots: int, pause: float, temperature: float) -> DataFrame:
    def run(frames):
        ask, limited, due = client(), False, time.monotonic()
        for frame in frames:
            out = []
            for messages, model in zip(frame["messages"], frame["model"], strict=True):
                if limited:
                    out.append((None, WAITING))
                    continue
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic() - pause) + pause
                try:
                    out.append((ask(json.loads(messages), model, temperature), "ok"))
                except RateLimited:
                    limited = True
                    out.append((None, LIMITED))
                except Exception as e:
                    out.append((None, f"error: {type(e).__name__}: {e}"[:500]))
            yield frame[["key"]].assign(response=[o[0] for o in out], status=[o[1] for o in out])

    return prompts.repartition(slots).mapInPandas(run, SCHEMA)
