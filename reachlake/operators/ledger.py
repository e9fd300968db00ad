"""Job and service ledgers: totals, state audits, budgets, approvals, quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_int, header_reset
from .publish import latest_by_key


def ledger_totals(events: DataFrame) -> DataFrame:
    """ROLLUP over (service, job_id): events, attempted and upstream sums, with level 0 job, 1 service, 3 overall."""
    return events.rollup("service", "job_id").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("attempted").alias("attempted"), F.sum("upstream").alias("upstream"))


def audit_transitions(events: DataFrame, terminal: int = 9) -> DataFrame:
    """Adds regression: a state before the highest one so far of its job; repeats are no regression, finished jobs exempt."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    d = events.withColumns({"so_far": F.max("state_idx").over(w.rowsBetween(Window.unboundedPreceding, -1)), "previous": F.lag("state_idx").over(w)})
    return d.withColumn("regression", F.coalesce((F.col("state_idx") < F.col("so_far")) & (F.col("previous") != terminal), F.lit(False)))


def illegal_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps (from_state, to_state) of jobs that the table of allowed edges does not have, with their counts."""
    d = events.withColumn("from_state", F.lag("state_idx").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))).where("from_state is not null and from_state <> state_idx")
    steps = d.groupBy("from_state", F.col("state_idx").alias("to_state")).agg(F.count("*").alias("n"))
    return steps.join(edges.hint("merge"), ["from_state", "to_state"], "left_anti")


def audit_budget(events: DataFrame, budgets: DataFrame, minutes: int = 60) -> DataFrame:
    """First event of each service whose running upstream sum passes its budget: (service, event_id, running).

    Sums by time slice come first and are added up over slices; only the slice where the budget breaks is ordered event by
    event, so a service with most of the events is not sorted in one task.
    """
    slice_ = F.floor(F.unix_timestamp("ts") / (60 * minutes))
    e = events.withColumn("slice", slice_)
    s = e.groupBy("service", "slice").agg(F.sum("upstream").alias("up"))
    w = Window.partitionBy("service").orderBy("slice")
    s = s.withColumn("before", F.sum("up").over(w) - F.col("up")).join(budgets.hint("merge"), "service")
    broken = s.where("before <= budget and before + up > budget").groupBy("service").agg(F.min_by(F.struct("slice", "before", "budget"), "slice").alias("b")).select("service", "b.*")
    inner = e.join(broken.hint("merge"), ["service", "slice"])
    run = F.col("before") + F.sum("upstream").over(Window.partitionBy("service").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return inner.withColumn("running", run).where("running > budget").groupBy("service").agg(F.min_by(F.struct("event_id", "running"), F.struct("ts", "event_id")).alias("f")).select("service", "f.*")


def profile_totals(plans: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests by profile in the list's order; null where a profile has no plan."""
    return profiles.join(plans.groupBy("profile").agg(F.sum("requests").alias("requests"), F.count("*").alias("plans")), "profile", "left").select("position", "profile", "requests", F.coalesce("plans", F.lit(0)).alias("plans"))


def merge_quota(old: DataFrame, new: DataFrame, context: str = "live") -> DataFrame:
    """Latest observation by service; rows without remaining never replace one that has it. freshness: in a cache's context what is there was last observed."""
    d = latest_by_key(old.unionByName(new).where("remaining is not null"), ["service"], "observed_at", "event_id")
    return d.withColumn("freshness", F.lit("last-observed" if context == "cache" else "live"))


def observe_quota(responses: DataFrame) -> DataFrame:
    """Quota record of each response: status, limit, remaining, reset_at, freshness and retry_after_s (of a 429 only).

    Columns status_code, observed_at and header texts (null: not sent) limit_header, remaining_header, reset_header, retry_header.
    """
    d = responses.withColumns({"limit": header_int(F.col("limit_header")), "remaining": header_int(F.col("remaining_header")), "reset_at": header_reset(F.col("reset_header"), F.col("observed_at"))})
    known = F.coalesce("limit", "remaining", F.unix_timestamp("reset_at")).isNotNull()
    status = F.when(F.col("status_code") == 429, "rate-limited").when(F.col("status_code") == 403, "upstream-403").when(known, "known").otherwise("unknown")
    return d.withColumns({"status": status, "freshness": F.when(known, "live").otherwise("unknown"), "retry_after_s": F.when(F.col("status_code") == 429, header_int(F.col("retry_header")))})


def gate_plans(plans: DataFrame, approvals: DataFrame, quota: DataFrame, now, keep_back: float = 0.2) -> DataFrame:
    """verdict of each plan: no-approval, budget-exceeded, rate-limited, quota-unknown, quota-exceeded or allowed.

    An approval fits on fingerprint and profile, and on center and ranges where both sides have them, while created_at <= now < expires_at;
    of several the largest counts. Unknown quota is allowed for a run of one profile (column profile_count, 1 if
    there is none). The approvals are reduced to one row a key before the join.
    """
    keys = [c for c in ("fingerprint", "profile", "center", "ranges") if c in plans.columns and c in approvals.columns]
    a = approvals.where((F.col("created_at") <= now) & (now < F.col("expires_at"))).groupBy(*keys).agg(F.max("approved").alias("approved"))
    q = quota.select("service", "remaining", "status_code")
    d = plans.join(a.hint("merge"), keys, "left").join(q.hint("merge"), "service", "left")
    room = F.floor(F.col("remaining") * (1 - keep_back))
    one = F.col("profile_count") == 1 if "profile_count" in plans.columns else F.lit(True)
    verdict = (
        F.when(F.col("approved").isNull(), "no-approval").when(F.col("approved") > F.col("budget"), "budget-exceeded").when(F.col("status_code") == 429, "rate-limited")
        .when(F.col("remaining").isNull(), F.when(one, "allowed").otherwise("quota-unknown")).when(F.col("approved") > room, "quota-exceeded").otherwise("allowed")
    )
    return d.withColumn("verdict", verdict)


def job_verdicts(events: DataFrame, ready: int = 8, final: int = 9) -> DataFrame:
    """Verdict of each event (job_id, event_id, ts, state_idx, fingerprint) in a job's (ts, event_id) order: the batch twin of the job-state stream.

    created, advanced, repeat, regression, fingerprint-conflict (other than the job's first), or not-ready (the final state from another than `ready`).
    """
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = events.withColumns({"_fp": F.first("fingerprint").over(w), "_i": F.row_number().over(w)})
    fits = F.col("fingerprint").eqNullSafe(F.col("_fp"))
    d = d.withColumn("_low", F.max(F.when(fits & (F.col("state_idx") < final), F.col("state_idx"))).over(before))
    end = fits & (F.col("state_idx") == final)
    d = d.withColumn("_done", F.coalesce(F.max(end & (F.col("_low") == ready)).over(before), F.lit(False)))
    top = F.when(F.col("_done"), final).otherwise(F.coalesce("_low", F.lit(-1)))
    late = (F.col("state_idx") == final) & ~F.col("_done") & (top != ready)
    first = F.when(late, "not-ready").otherwise("created")
    verdict = F.when(F.col("_i") == 1, first).when(~fits, "fingerprint-conflict").when(F.col("state_idx") < top, "regression").when(late, "not-ready").when(F.col("state_idx") == top, "repeat").otherwise("advanced")
    return d.select("job_id", "event_id", "state_idx", verdict.alias("verdict"))
