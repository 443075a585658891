"""Trailing-window throughput, input metrics, peaks and global metrics.

`ticks` are the instants of a query: (tick, tick_seq, collector_run_id, now_ns). Reading has no side effects: peaks are running
maxima over the ticks. Live rows meet their ticks through buckets of five seconds, an equi-join that copies a tick to the two
buckets it can see, never to all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.usage import input_metric, interval_metric

SECOND = 1_000_000_000
KEPT = 5 * SECOND
#: Numbers of the order of observation that one task puts in order for an agent.
SPAN = 1 << 18


def live_eligible() -> Column:
    return (F.col("temporal_accuracy") == "StreamExact") & (F.col("gap_state") == "Normal") & (F.col("measurement_kind") != "TokenizerEstimate")


def event_rates(deltas: DataFrame) -> DataFrame:
    """Tokens of the trailing second and five seconds at each delta itself, as range frames over the monotonic clock."""
    clock = Window.partitionBy("collector_run_id", "agent_id").orderBy("observed_monotonic_ns")
    out = F.when(live_eligible(), F.col("delta_output"))
    at = F.when(live_eligible(), F.col("observed_monotonic_ns"))
    five = clock.rangeBetween(-KEPT, 0)
    rows = deltas.withColumn("out_1s", F.coalesce(F.sum(out).over(clock.rangeBetween(-SECOND, 0)), F.lit(0)).cast("long"))
    rows = rows.withColumn("out_5s", F.coalesce(F.sum(out).over(five), F.lit(0)).cast("long")).withColumn("_oldest", F.min(at).over(five))
    elapsed = F.greatest((F.col("observed_monotonic_ns") - F.coalesce("_oldest", "observed_monotonic_ns")) / float(SECOND), F.lit(1.0))
    return rows.withColumn("avg_5s", F.col("out_5s") / elapsed).drop("_oldest")


def agent_tps(events: DataFrame, seen: DataFrame, ticks: DataFrame) -> DataFrame:
    """For each tick and agent seen by then: out_tps, avg_5s_out_tps, peak_out_tps, in_tps with its kind, the last interval.

    events: live deltas and finals as reconcile.events() gives them; seen: (agent_id, seq) of each agent's first sample;
    ticks: (tick, tick_seq, collector_run_id, now_ns), tick_seq being the last seq that the tick sees.

    A pushed delta drops from an agent's buffer what is of another run or more than KEPT older than itself. What is left at
    a tick is therefore what was pushed since the run last changed and is at most KEPT older than the latest clock value
    pushed since then; that holds as long as the clock of a run does not fall back by more than KEPT.
    """
    rows = events.filter("not rejected")
    live = ~F.col("final")
    metric = input_metric(F.col("context_input"))
    interval = interval_metric(F.col("output"), F.col("timing.measurement_interval_ms"))
    run, ns = F.col("collector_run_id").alias("run"), F.col("observed_monotonic_ns").alias("ns")
    facts = rows.select(
        "agent_id",
        "seq",
        F.lit(0).alias("side"),
        F.when(live, F.struct(run, ns)).alias("push"),
        F.when(live & live_eligible(), F.col("output")).alias("out"),
        F.when(metric["value"].isNotNull(), F.struct(run, ns, metric.alias("metric"))).alias("m"),
        F.when(live & (F.col("temporal_accuracy") == "IntervalExact") & (F.col("output") > 0), interval).alias("i"),
    )
    # One row for each tick and agent: the size of the result.
    marks = ticks.select(F.col("tick").cast("long").alias("tick"), F.col("tick_seq").cast("long").alias("tick_seq"), F.col("collector_run_id").alias("tick_run"), F.col("now_ns").cast("long").alias("now_ns"))
    marks = marks.join(seen.select("agent_id", F.col("seq").alias("_first")), F.col("_first") <= F.col("tick_seq"))
    marks = marks.select("agent_id", F.col("tick_seq").alias("seq"), F.lit(1).alias("side"), "tick", "tick_run", "now_ns")
    rows = _segments(facts.unionByName(marks, allowMissingColumns=True))

    at = rows.filter("side = 1")
    pushed = rows.filter("out is not null").select("agent_id", "segment", F.col("push.ns").alias("ns"), "seq", "out", F.floor(F.col("push.ns") / KEPT).alias("bucket"))
    wanted = at.filter("run = tick_run").select("agent_id", "segment", F.col("seq").alias("tick_seq"), "tick", "now_ns", "latest", F.explode(F.sequence(F.floor((F.col("latest") - KEPT) / KEPT), F.floor(F.col("latest") / KEPT))).alias("bucket"))
    held = wanted.join(pushed, ["agent_id", "segment", "bucket"]).filter((F.col("seq") <= F.col("tick_seq")) & (F.col("latest") - F.col("ns") <= KEPT))
    age = F.greatest(F.col("now_ns") - F.col("ns"), F.lit(0).cast("long"))
    out = held.groupBy("agent_id", "tick", "now_ns").agg(F.sum(F.when(age <= SECOND, F.col("out"))).alias("_1s"), F.sum("out").alias("_5s"), F.min("ns").alias("_oldest"))
    elapsed = F.greatest(F.greatest(F.col("now_ns") - F.col("_oldest"), F.lit(0)) / float(SECOND), F.lit(1.0))
    out = out.select("agent_id", "tick", F.coalesce("_1s", F.lit(0)).cast("double").alias("out_tps"), (F.col("_5s") / elapsed).alias("avg_5s_out_tps"))

    rows = at.select("agent_id", "tick", "tick_run", "now_ns", "m", "i").join(out, ["agent_id", "tick"], "left").fillna(0.0, ["out_tps", "avg_5s_out_tps"])
    fresh = (F.col("m.run") == F.col("tick_run")) & (F.greatest(F.col("now_ns") - F.col("m.ns"), F.lit(0)) <= SECOND)
    peak = Window.partitionBy("agent_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "agent_id",
        "tick",
        "out_tps",
        "avg_5s_out_tps",
        F.max("out_tps").over(peak).alias("peak_out_tps"),
        F.when(fresh, F.col("m.metric.value")).alias("in_tps"),
        F.when(fresh, F.col("m.metric.kind")).otherwise(F.lit("Unavailable")).alias("in_kind"),
        F.col("i.tokens").alias("interval_tokens"),
        F.col("i.seconds").alias("interval_seconds"),
        F.col("i.tps").alias("interval_tps"),
    )


def _segments(rows: DataFrame) -> DataFrame:
    """Adds what each row of an agent has before it: run, segment and latest clock of its buffer, last m, last i.

    A segment is what was pushed since the run last changed, named by the seq of its first row. Rows are put in order
    within spans of SPAN numbers of an agent, so that no agent is one task; a span takes what the spans before it end with
    from a table of one row a span.
    """
    rows = rows.withColumn("span", F.expr(f"seq div {SPAN}"))
    span = Window.partitionBy("agent_id", "span").orderBy("seq", "side")
    upto, before = span.rowsBetween(Window.unboundedPreceding, 0), span.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("agent_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    ends = rows.groupBy("agent_id", "span").agg(last("push"), last("m"), last("i"))
    ends = ends.select("agent_id", "span", *[F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_before") for c in ("push", "m", "i")])
    rows = rows.join(ends, ["agent_id", "span"])
    own = F.last("push", ignorenulls=True)
    changed = F.col("push").isNotNull() & ~F.col("push.run").eqNullSafe(F.coalesce(own.over(before), F.col("push_before"))["run"])
    rows = rows.withColumns({"run": F.coalesce(own.over(upto), F.col("push_before"))["run"], "m": F.coalesce(F.last("m", ignorenulls=True).over(upto), F.col("m_before")), "i": F.coalesce(F.last("i", ignorenulls=True).over(upto), F.col("i_before")), "change": F.when(changed, F.col("seq"))})
    # Segments grow, so the largest (segment, clock) is the latest clock of the last segment; null: the one that goes on.
    rows = rows.withColumn("segment", F.max("change").over(upto)).withColumn("top", F.when(F.col("push").isNotNull(), F.struct("segment", F.col("push.ns").alias("ns"))))
    tops = rows.groupBy("agent_id", "span").agg(F.max("top").alias("top"))
    by_span = Window.partitionBy("agent_id").orderBy("span")
    tops = tops.withColumn("s", F.last("top.segment", ignorenulls=True).over(by_span.rowsBetween(Window.unboundedPreceding, 0)))
    tops = tops.withColumn("clock", F.max("top.ns").over(Window.partitionBy("agent_id", "s").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)))
    tops = tops.select("agent_id", "span", F.lag("s").over(by_span).alias("segment_before"), F.lag("clock").over(by_span).alias("clock_before"))
    rows = rows.join(tops, ["agent_id", "span"])
    here = F.max("top").over(upto)
    clock = F.when(here["segment"].isNotNull(), here["ns"]).otherwise(F.greatest(here["ns"], F.col("clock_before")))
    return rows.withColumn("latest", clock).withColumn("segment", F.coalesce("segment", "segment_before"))


def global_metrics(tps: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Each tick over all agents: sums, coverage of the input rate (null if none is measured), and the peak of the sums."""
    rows = tps
    if status is not None:
        rows = rows.join(status.select("agent_id", F.coalesce("request_active", F.lit(False)).alias("request_active")), "agent_id", "left")
    else:
        rows = rows.withColumn("request_active", F.lit(False))
    making = F.col("out_tps") > 0
    out = rows.groupBy("tick").agg(
        F.sum("out_tps").alias("global_out_tps"),
        F.sum("in_tps").alias("global_in_tps"),
        F.count("in_tps").alias("in_coverage_measured"),
        F.count(F.lit(1)).alias("in_coverage_total"),
        F.count_if(making).alias("generating_agents"),
        F.count_if(~making & F.coalesce("request_active", F.lit(False))).alias("working_agents"),
    )
    # One row a tick: ticks are the instants of a query, not data.
    peak = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("peak_out_tps", F.max("global_out_tps").over(peak))


def agent_status(samples: DataFrame) -> DataFrame:
    """The last row of each agent."""
    row = F.struct("agent_id", "agent_name", "model", "provider", "session_id", "source_adapter_id", "event_kind", "wall_timestamp_ms", "observed_monotonic_ns")
    return samples.groupBy("agent_id").agg(F.max_by(row, "seq").alias("r")).select("r.*")


def status_with_rates(status: DataFrame, tps: DataFrame) -> DataFrame:
    """Agents with their rates at one instant of query, null where there are none."""
    return status.join(tps.drop("tick"), "agent_id", "left")
