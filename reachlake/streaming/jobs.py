"""Ledgers as Structured Streaming jobs; each has a batch twin in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_quota(observations: DataFrame) -> DataFrame:
    """Latest observation of each service (update mode)."""
    return observations.groupBy("service").agg(F.max_by(F.struct("observed_at", "event_id", "remaining", "status_code"), F.struct("observed_at", "event_id")).alias("r")).select("service", "r.*")


def first_piece_results(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of each (plan_id, source, source_id) within the watermark; rows need a timestamp ts."""
    return results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["plan_id", "source", "source_id"])


def response_freshness(requests: DataFrame, records: DataFrame, stale_if_error: bool = True) -> DataFrame:
    """Each request (endpoint_type, job_id, asked_at) with fresh, stale or missing from a static table of records.

    With a column failed (the upstream call did) a stale record is stale-if-error where that is allowed and the call failed, else expired: it is
    not to be served.
    """
    r = records.groupBy("endpoint_type", "job_id").agg(F.max("retrieved_at").alias("retrieved_at"), F.max_by("ttl_seconds", "retrieved_at").alias("ttl_seconds"))
    j = requests.join(r.hint("shuffle_hash"), ["endpoint_type", "job_id"], "left")
    age = F.unix_timestamp("asked_at") - F.unix_timestamp("retrieved_at")
    late = F.when(F.col("failed") & F.lit(stale_if_error), "stale-if-error").otherwise("expired") if "failed" in requests.columns else F.lit("stale")
    state = F.when(F.col("retrieved_at").isNull(), "missing").when((F.col("ttl_seconds") > 0) & (age > F.col("ttl_seconds")), late).otherwise("fresh")
    return j.withColumn("state", state)


class JobStates(StatefulProcessor):
    """Highest state and input fingerprint of a job; emits a verdict for each event. The final state is published from `ready` only."""

    def __init__(self, ready: int = 8, final: int = 9):
        self.ready, self.final = ready, final

    def init(self, handle) -> None:
        self.top = handle.getValueState("top", "idx int, fingerprint string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        top, fp = self.top.get() if self.top.exists() else (-1, None)
        out = []
        for e in events.itertuples():
            if fp is not None and e.fingerprint != fp:
                verdict = "fingerprint-conflict"
            elif e.state_idx < top:
                verdict = "regression"
            elif e.state_idx == self.final and top not in (self.ready, self.final):
                verdict, fp = "not-ready", fp or e.fingerprint
            else:
                verdict, fp, top = ("created" if fp is None else "repeat" if e.state_idx == top else "advanced"), fp or e.fingerprint, int(e.state_idx)
            out.append((key[0], e.event_id, int(e.state_idx), verdict))
        self.top.update((top, fp))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "state_idx", "verdict"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ready: int = 8, final: int = 9) -> DataFrame:
    """Verdict of each event (job_id, event_id, ts, state_idx, fingerprint). Needs the RocksDB state store provider.

    Order within a job is made in each micro-batch; an event that comes in a later batch than a higher state is a regression.
    """
    return events.groupBy("job_id").transformWithStateInPandas(JobStates(ready, final), "job_id int, event_id bigint, state_idx int, verdict string", "append", "none")
