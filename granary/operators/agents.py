"""The registry of agents as a log: who is registered, what they can do, and how they are, as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log rows: agent, ts, event_id, kind (`register`, `unregister`, `heartbeat`), capabilities (array, of registrations).
KINDS = ("register", "unregister", "heartbeat")


def registry(log: DataFrame, as_of: Column | None = None, timeout: float = 60.0) -> DataFrame:
    """Agents that are registered as of a time (None: the end of the log), with what their last registration says:
    agent, capabilities, registered_at, replaced (registrations before the last, since the agent was last away), last_seen
    (last heartbeat since then, null if none), healthy (seen, or registered, less than timeout seconds before).

    One aggregation per agent: its last registration and unregistration are largest structs, so a busy agent's rows are
    summed where they lie. Of rows of one time, the larger event_id is later. Rows without agent, ts or kind take no part."""
    rows = log.dropna(subset=["agent", "ts", "kind"])
    if as_of is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))  # one row
    else:
        rows = rows.withColumn("now", as_of).filter(F.col("ts") <= F.col("now"))
    at = F.struct("ts", "event_id")
    last = lambda kind: F.max(F.when(F.col("kind") == kind, at))
    ends = rows.groupBy("agent").agg(last("register").alias("joined"), last("unregister").alias("away"), F.max_by("capabilities", F.when(F.col("kind") == "register", at)).alias("capabilities"))
    ends = ends.filter(F.col("joined").isNotNull() & (F.col("away").isNull() | (F.col("joined") > F.col("away"))))
    since = rows.join(ends.select(F.col("agent").alias("__a"), "joined", "away"), F.col("agent") == F.col("__a"))
    here = F.col("away").isNull() | (at > F.col("away"))
    state = since.groupBy("agent").agg(
        F.count_if((F.col("kind") == "register") & here & (at < F.col("joined"))).alias("replaced"),
        F.max(F.when((F.col("kind") == "heartbeat") & (at > F.col("joined")), F.col("ts"))).alias("last_seen"), F.max("now").alias("now"),
    )
    out = ends.join(state, "agent").withColumn("registered_at", F.col("joined.ts"))
    gap = (F.unix_micros("now") - F.unix_micros(F.coalesce("last_seen", "registered_at"))) / 1e6
    return out.select("agent", "capabilities", "registered_at", "replaced", "last_seen", (gap < timeout).alias("healthy"))


def capability_index(agents: DataFrame) -> DataFrame:
    """The agents of each capability: capability, n, agents (ids in order), healthy (how many of them are)."""
    rows = agents.select("agent", "healthy", F.explode(F.array_distinct("capabilities")).alias("capability"))
    return rows.groupBy("capability").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("agent")).alias("agents"), F.count_if("healthy").alias("healthy"))


def discover(agents: DataFrame, capability: str) -> DataFrame:
    """The registered agents with a capability."""
    return agents.filter(F.array_contains("capabilities", capability))
