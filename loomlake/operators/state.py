"""Lifecycle folds over ordered events, step traces, and metrics of requests and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import numbered

#: The metrics of a broker, their kinds and what they tell.
METRICS = [
    ("process_readiness", "gauge", "Whether the broker is ready for traffic"),
    ("shard_count", "gauge", "Configured reactor shard count"),
    ("startup_duration_seconds", "gauge", "Time from application start to readiness"),
    ("shutdown_total", "counter", "Number of initiated broker shutdowns"),
    ("http_requests_total", "counter", "Administrative HTTP requests"),
]
STATE = "struct<state:string,shards:bigint,startup:double,shutdowns:bigint>"


def _initial() -> Column:
    return F.struct(F.lit("stopped").alias("state"), F.lit(0).cast("long").alias("shards"), F.lit(0.0).alias("startup"), F.lit(0).cast("long").alias("shutdowns"))


def transition(state: Column, event: Column) -> Column:
    """The state after an event (fields kind and value).

    A listener makes live with its shard count from anywhere; ready stores its duration in
    any state but leads to ready from live alone; shutdown counts and drains from live or
    ready alone; stopped stops.
    """
    kind, up = event["kind"], state["state"].isin("live", "ready")
    return F.struct(
        F.when(kind == "listener", "live")
        .when((kind == "ready") & (state["state"] == "live"), "ready")
        .when((kind == "shutdown") & up, "draining")
        .when(kind == "stopped", "stopped")
        .otherwise(state["state"])
        .alias("state"),
        F.when(kind == "listener", event["value"].cast("long")).otherwise(state["shards"]).alias("shards"),
        F.when(kind == "ready", event["value"]).otherwise(state["startup"]).alias("startup"),
        (state["shutdowns"] + F.when((kind == "shutdown") & up, 1).otherwise(0)).cast("long").alias("shutdowns"),
    )


#: The states of a lifecycle.
STATES = ["stopped", "live", "ready", "draining"]


def lifecycle(events: DataFrame, key: str, order: list[str], kind: str, value: str, piece: int = 1000) -> DataFrame:
    """key, state, shards, startup, shutdowns, live, ready after all events of each key.

    Events are sorted by range and cut into pieces of about this many, folded from each of
    the four states they may begin in; a key's pieces are then put one after the other. So a
    key with any share of the events is spread over tasks.
    """
    own = F.struct(*order, F.col(kind).alias("kind"), F.col(value).cast("double").alias("value")).alias("_e")
    rows = numbered(events.select(F.col(key).alias("_key"), *(F.col(o) for o in order), own), "_key", *order)
    pieces = rows.groupBy("_key", F.floor(F.col("i") / piece).alias("_piece")).agg(F.array_sort(F.collect_list("_e")).alias("_events"))
    initial = lambda name: F.struct(F.lit(name).alias("state"), F.lit(None).cast("long").alias("shards"), F.lit(None).cast("double").alias("startup"), F.lit(0).cast("long").alias("shutdowns")).cast(STATE)
    folded = lambda name: F.aggregate("_events", initial(name), lambda s, e: transition(s, e).cast(STATE)).alias(name)
    effects = pieces.select("_key", "_piece", F.struct(*map(folded, STATES)).alias("_to"))
    ordered = effects.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_piece", "_to"))).alias("_pieces"))

    def follow(s: Column, p: Column) -> Column:
        to = F.coalesce(*(F.when(s["state"] == name, p["_to"][name]) for name in STATES))
        return F.struct(to["state"].alias("state"), F.coalesce(to["shards"], s["shards"]).alias("shards"), F.coalesce(to["startup"], s["startup"]).alias("startup"), (s["shutdowns"] + to["shutdowns"]).alias("shutdowns")).cast(STATE)

    done = ordered.select(F.col("_key").alias(key), F.aggregate("_pieces", _initial().cast(STATE), follow).alias("_s"))
    return done.select(key, "_s.*", F.col("_s.state").isin("live", "ready").alias("live"), (F.col("_s.state") == "ready").alias("ready"))


def trace(steps: Column) -> Column:
    """What a start of these steps does, as an array of strings.

    steps: ordered array of struct<name, outcome>; outcome is ok, fail, abort_before or
    abort_after. A step aborted before it starts leaves no trace; one that fails has started
    but is not stopped; after the first that is not ok all started ones stop in reverse.
    """
    bad = F.filter(F.transform(steps, lambda s, i: F.when(s["outcome"] != "ok", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.get(bad, F.lit(0)), F.size(steps))
    outcome = F.when(last < F.size(steps), F.get(steps, last)["outcome"]).otherwise("ok")
    begun = F.slice(steps, 1, last + F.when(outcome.isin("fail", "abort_after"), 1).otherwise(0))
    running = F.slice(steps, 1, last + F.when(outcome == "abort_after", 1).otherwise(0))
    starts = F.transform(begun, lambda s: F.concat(F.lit("start:"), s["name"]))
    stops = F.transform(F.reverse(running), lambda s: F.concat(F.lit("stop:"), s["name"]))
    return F.when(outcome == "ok", starts).otherwise(F.concat(starts, stops))


def first_stop_failure(steps: Column) -> Column:
    """The name of the first step, in reverse order, whose stop fails; all are stopped all the same."""
    return F.get(F.filter(F.reverse(steps), lambda s: s["stop_fails"]), F.lit(0))["name"]


def metric_rollup(events: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """name, gauge (the last value), counter (how many) of each name."""
    return events.groupBy(name).agg(F.max_by(value, F.struct(*order)).alias("gauge"), F.count("*").alias("counter"))


def exposition(prefix: str, name: Column, kind: Column, value: Column, description: Column) -> Column:
    """The three lines of a metric in the Prometheus text format."""
    full = F.concat(F.lit(f"{prefix}_"), name)
    return F.concat(F.lit("# HELP "), full, F.lit(" "), description, F.lit("\n# TYPE "), full, F.lit(" "), kind, F.lit("\n"), full, F.lit(" "), value.cast("string"), F.lit("\n"))


def metric_value(text: Column, name: Column) -> Column:
    """The value of the only sample with this name in an exposition; null where there are none or several."""
    lines = F.filter(F.split(text, "\n"), lambda line: (line == name) | line.startswith(F.concat(name, F.lit("{"))) | line.startswith(F.concat(name, F.lit(" "))))
    return F.when(F.size(lines) == 1, F.element_at(F.split(F.get(lines, F.lit(0)), r"\s+"), -1).try_cast("double"))


def metrics(spark: SparkSession) -> DataFrame:
    """name, kind, description of the registered metrics."""
    return spark.createDataFrame(METRICS, "name string, kind string, description string")


def exposed(states: DataFrame, key: str, requests: DataFrame) -> DataFrame:
    """key, metric, kind, sample, description: every registered metric of what lifecycle() gives.

    requests: key, requests; a key without any has 0.
    """
    values = {
        "process_readiness": F.col("ready").cast("double"),
        "shard_count": F.col("shards").cast("double"),
        "startup_duration_seconds": F.col("startup"),
        "shutdown_total": F.col("shutdowns").cast("double"),
        "http_requests_total": F.coalesce("requests", F.lit(0)).cast("double"),
    }
    named = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("sample")) for k, v in values.items()))
    samples = states.join(requests, key, "left").select(key, F.explode(named).alias("_m")).select(key, "_m.*")
    known = F.broadcast(metrics(states.sparkSession))  # five rows
    return samples.join(known, "name").select(key, F.col("name").alias("metric"), "kind", "sample", "description")
