"""Registered queries: the library's operators over the given tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import errors, text, units
from loomlake.operators import codec, config, dependencies, graph, paths, relational, state
from loomlake.session import materialize, table

NORMAL = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def shard_sum(spark: SparkSession, sf: str) -> DataFrame:
    found = relational.shard_sum(table(spark, sf, "documents"), "source", "n_chars")
    return found.select(F.col("total").cast("long").alias("total"), "shards")


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), text.normalized(F.col("text")).alias("name"), F.split_part("text", F.lit(" "), F.lit(1)).alias("version"))
    docs = table(spark, sf, "documents").select(text.normalized(F.col("text")).alias("cell"), F.col("text").alias("detail"))
    return relational.inventory(items, docs)


def inventory_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(spark, sf).where("n_rows = 0").select("id", "name")


def inventory_present(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(spark, sf).where("n_rows > 0").select("id", "name")


def inventory_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(spark, sf).select("id", "n_rows", relational.inventory_error().alias("error"))


_INVENTORY_SQL = f"""WITH b AS (SELECT item_id AS id, {NORMAL.format("text")} AS name, split_part(text, ' ', 1) AS version FROM benchmark),
d AS (SELECT {NORMAL.format("text")} AS cell, text AS detail FROM documents),
h AS (SELECT id, count(*) AS n, bool_or(contains(detail, version)) AS v FROM b JOIN d ON contains(cell, name) GROUP BY id),
r AS (SELECT b.*, coalesce(n, 0) AS n_rows, v FROM b LEFT JOIN h USING (id)) """


def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return relational.last_wins(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


def union_distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("a/"), "source", F.lit("/"), "lang").alias("path"))
    events = table(spark, sf, "events").select(F.concat(F.lit("a-b/"), "event_type").alias("path"))
    return relational.union_distinct(docs, events)


def xor_fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.bit_xor("event_id").alias("folded"))


def first_error(spark: SparkSession, sf: str) -> DataFrame:
    checks = [
        (F.col("p_name").rlike(r"\A\s*\z"), "missing_key"),
        (F.col("p_size") > 40, "invalid_size"),
        (F.col("p_retailprice") > 1500, "invalid_price"),
        (~F.col("p_brand").startswith("Brand#1"), "unknown_key"),
    ]
    return table(spark, sf, "part").select("p_partkey", errors.first_error(checks).alias("error"))


MARKERS = ["the", "and", "of", "."]


def ordered_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.ordered_end(F.col("text"), MARKERS).cast("long").alias("after"))


def _ordered_sql() -> str:
    step = "SELECT doc_id, text, 1::BIGINT AS p FROM documents"
    for m in MARKERS:
        step = f"SELECT doc_id, text, CASE WHEN strpos(substr(text, p), '{m}') > 0 THEN p - 1 + strpos(substr(text, p), '{m}') + {len(m)} END AS p FROM ({step})"
    return f"SELECT doc_id, p AS after FROM ({step})"


def redacted_render(spark: SparkSession, sf: str) -> DataFrame:
    line = text.render_pairs([("key", F.col("c_custkey").cast("string"), True), ("name", F.col("c_name"), True), ("balance", F.col("c_acctbal").cast("string"), False), ("segment", F.col("c_mktsegment"), True)])
    return table(spark, sf, "customer").select("c_custkey", line.alias("line"))


def escape_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.escape_line(F.col("text")).alias("line"))


def json_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.json_string(F.col("text")).alias("body"))


def _escape_sql(column: str, named: dict[str, str], rare: dict[str, str]) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c, e in {**named, **rare}.items():
        out = f"replace({out}, chr({ord(c)}), '{e}')" if c != "\0" else out
    return out


_LINE_SQL = _escape_sql("text", text.LINE_NAMED, {chr(i): f"\\x{i:02x}" for i in [*range(32), 127] if chr(i) not in text.LINE_NAMED})
_JSON_SQL = _escape_sql("text", text.JSON_NAMED, {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in text.JSON_NAMED})


def json_envelope(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_type") == "click", "invalid_argument").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", errors.envelope(code, F.col("props"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))).alias("body"))


def health_responses(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("value") > 50
    rows = table(spark, sf, "events").select("event_id", errors.health(flag, "live").alias("l"), errors.health(flag, "ready").alias("r"))
    return rows.select("event_id", F.col("l.status").alias("live_status"), F.col("l.body").alias("live_body"), F.col("r.status").alias("ready_status"), F.col("r.body").alias("ready_body"))


def error_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("code"))
    return errors.described(rows, F.col("code")).select("p_partkey", "code", "message", "condition")


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return state.metric_rollup(table(spark, sf, "events"), "event_type", "value", ["ts", "event_id"])


def metric_exposition(spark: SparkSession, sf: str) -> DataFrame:
    rolled = metric_rollup(spark, sf)
    lines = state.exposition("events", F.col("event_type"), F.lit("counter"), F.col("counter"), F.lit("Events seen"))
    return rolled.select("event_type", lines.alias("lines"))


def metric_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The value of a user's only click, through an exposition with one line for each of the user's kinds of events, two for a kind that occurs more often."""
    sample = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, '{shard="0"}').otherwise(""), F.lit(" "), F.col("event_id").cast("string"))
    kinds = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(sample).alias("low"), F.max(sample).alias("high"), F.count("*").alias("n"))
    lines = F.when(F.col("n") > 1, F.concat("low", F.lit("\n"), "high")).otherwise(F.col("low"))
    rows = kinds.groupBy("user_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(lines))).alias("text"))
    return rows.select("user_id", state.metric_value(F.col("text"), F.lit("click")).alias("value"))


def metric_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values in the forms that an exposition may have, read back as numbers."""
    form = F.when(F.col("c_acctbal") > 9000, "+Inf").when(F.col("c_acctbal") < 0, F.concat(F.floor("c_acctbal").cast("string"), F.lit("e-3"))).when(F.col("c_mktsegment") == "BUILDING", F.concat(F.col("c_custkey").cast("string"), F.lit("000000000000"))).otherwise(F.concat(F.lit("0.0000"), F.col("c_custkey").cast("string")))
    line = F.concat("c_mktsegment", F.lit(' 1\nbalance{key="'), F.col("c_custkey").cast("string"), F.lit('"} '), form)
    value = state.metric_value(line, F.lit("balance"))
    return table(spark, sf, "customer").select("c_custkey", (value > 1e300).alias("infinite"), F.when(value <= 1e300, value).alias("value"))


def metric_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered metric of each user's lifecycle; requests are the views."""
    requests = table(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("requests"))
    return state.exposed(lifecycle_fold(spark, sf), "user_id", requests)


def build_info_json(spark: SparkSession, sf: str) -> DataFrame:
    members = {"version": F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")), "revision": F.sha1("p_name"), "build_mode": F.col("p_type")}
    return table(spark, sf, "part").select("p_partkey", text.json_object(members).alias("body"))


def logger_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The logger's level for the level that a customer's segment names."""
    level = F.lower(F.when(F.col("c_acctbal") < 0, "error").when(F.col("c_acctbal") < 1000, "warn").when(F.col("c_acctbal") < 5000, "Debug").otherwise(F.col("c_mktsegment")))
    named = F.when(F.col("c_acctbal") >= 1000, F.initcap(level)).otherwise(level)
    return table(spark, sf, "customer").select("c_custkey", named.alias("log_level")).select("c_custkey", "log_level", config.log_levels().alias("logger_level"))


KINDS = ["listener", "ready", "shutdown", "stopped"]


def _lifecycle_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.floor("value").cast("double").alias("value"))


def lifecycle_fold(spark: SparkSession, sf: str) -> DataFrame:
    return state.lifecycle(_lifecycle_events(spark, sf), "user_id", ["ts", "event_id"], "kind", "value")


_LIFECYCLE_SQL = """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  ['listener', 'ready', 'shutdown', 'stopped'][(event_id % 4 + 1)::INT] AS kind, floor(value) AS v FROM events),
f AS (SELECT user_id, list_reduce(list_prepend({'s': 'stopped', 'n': 0::BIGINT, 'u': 0.0::DOUBLE, 'd': 0::BIGINT, 'k': '', 'v': 0.0::DOUBLE},
    list({'s': '', 'n': 0::BIGINT, 'u': 0.0::DOUBLE, 'd': 0::BIGINT, 'k': kind, 'v': v::DOUBLE} ORDER BY i)),
  lambda a, b: {'s': CASE WHEN b.k = 'listener' THEN 'live' WHEN b.k = 'ready' AND a.s = 'live' THEN 'ready'
      WHEN b.k = 'shutdown' AND a.s IN ('live', 'ready') THEN 'draining' WHEN b.k = 'stopped' THEN 'stopped' ELSE a.s END,
    'n': CASE WHEN b.k = 'listener' THEN b.v::BIGINT ELSE a.n END, 'u': CASE WHEN b.k = 'ready' THEN b.v ELSE a.u END,
    'd': a.d + CASE WHEN b.k = 'shutdown' AND a.s IN ('live', 'ready') THEN 1 ELSE 0 END, 'k': '', 'v': 0.0::DOUBLE}) AS r FROM e GROUP BY user_id)
SELECT user_id, r.s AS state, r.n AS shards, r.u AS startup, r.d AS shutdowns, r.s IN ('live', 'ready') AS live, r.s = 'ready' AS ready FROM f
"""


def lifecycle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The final states of the fold as a stream over the events, read from its output."""
    from loomlake.session import scratch
    from loomlake.streaming.lifecycle import lifecycle_stream as streamed

    events = _lifecycle_events(spark, sf)
    key = F.col("user_id").cast("string").alias("key")
    at = F.row_number().over(_by_user()).cast("long").alias("seq")
    source = materialize(events.select(key, at, "kind", "value"), "stream-source")
    path = source.inputFiles()[0].rsplit("/", 1)[0]
    out, marks = scratch(spark, "stream-out"), scratch(spark, "stream-marks")
    stream = streamed(spark.readStream.schema(source.schema).parquet(path))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(out)
    return states.groupBy("key").agg(F.max_by(F.struct("state", "shards", "startup", "shutdowns", "events"), "events").alias("s")).select("key", "s.*")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def step_traces(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ["ok", "ok", "ok", "fail", "ok", "abort_before", "ok", "abort_after"])), (F.col("l_partkey") % 8 + 1).cast("int"))
    step = F.struct("l_linenumber", F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("name"), outcome.alias("outcome"), (F.col("l_suppkey") % 3 == 0).alias("stop_fails"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(step)).alias("steps"))
    return rows.select("l_orderkey", F.concat_ws(",", state.trace(F.col("steps"))).alias("trace"), state.first_stop_failure(F.col("steps")).alias("failure"))


_TRACE_SQL = """
WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber AS i, 's' || l_linenumber AS name,
  ['ok', 'ok', 'ok', 'fail', 'ok', 'abort_before', 'ok', 'abort_after'][(l_partkey % 8 + 1)::INT] AS o, l_suppkey % 3 = 0 AS sf FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i, name, o, sf) AS k FROM s),
b AS (SELECT l_orderkey, min(k) FILTER (o <> 'ok') AS bad, arg_max(name, k) FILTER (sf) AS failure FROM n GROUP BY 1),
j AS (SELECT n.*, bad, max(CASE WHEN k = bad THEN n.o END) OVER (PARTITION BY n.l_orderkey) AS bo FROM n JOIN b USING (l_orderkey)),
t AS (SELECT l_orderkey, k AS pos, 'start:' || name AS m FROM j WHERE bad IS NULL OR k < bad OR (k = bad AND bo IN ('fail', 'abort_after'))
  UNION ALL SELECT l_orderkey, 1000000 - k, 'stop:' || name FROM j WHERE bad IS NOT NULL AND (k < bad OR (k = bad AND bo = 'abort_after')))
SELECT b.l_orderkey, coalesce(string_agg(m, ',' ORDER BY pos), '') AS trace, any_value(failure) AS failure FROM b LEFT JOIN t USING (l_orderkey) GROUP BY b.l_orderkey
"""


def checked_units(spark: SparkSession, sf: str) -> DataFrame:
    a = units.count_of(F.col("l_orderkey")) * F.lit("3074457345618258").cast("decimal(16,0)")  # 37 digits: the sum's own test is the only one
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), units.count_of(F.col("l_partkey")).alias("b"))
    both = rows.select("*", units.checked_add(F.col("a"), F.col("a")).alias("s"), units.checked_sub(F.col("b"), F.lit(500).cast("decimal(20,0)")).alias("d"))
    return both.select("l_orderkey", "l_linenumber", F.col("s").cast("string").alias("added"), F.col("d").cast("string").alias("left_over"))


SUFFIXES = ["GiB", "MiB", "GB", "MB", "G", "M", "K", ""]


def size_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    size = F.concat((F.col("p_size") % 10).cast("string"), suffix)
    return table(spark, sf, "part").select("p_partkey", size.alias("size"), text.size_mib(size).cast("long").alias("mib"))


def version_fields(spark: SparkSession, sf: str) -> DataFrame:
    line = text.fields_line({"version": F.concat_ws(".", "p_size", "p_partkey"), "revision": F.sha1(F.col("p_name")), "mode": F.col("p_type"), "name": F.col("p_name")})
    rows = table(spark, sf, "part").select("p_partkey", line.alias("line"))
    fields = text.fields_map(F.col("line"))
    return rows.select("p_partkey", "line", fields["revision"].alias("revision"), text.field(F.col("line"), "mode").alias("mode"), F.size(fields).alias("n"))


def hex_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.concat(F.lower(F.hex("p_name")), F.when(F.col("p_partkey") % 5 == 0, "0").when(F.col("p_partkey") % 5 == 1, " \n").when(F.col("p_partkey") % 5 == 2, "zz").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", text.hex_bytes(digits).cast("string").alias("name"))


def stamps(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 8 == 0, None).when(F.col("o_orderkey") % 8 == 4, "").when(F.col("o_orderkey") % 4 == 1, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.unsigned_or_default(raw).alias("stamp"))


def numbered_seeds(spark: SparkSession, sf: str) -> DataFrame:
    rows = relational.numbered(table(spark, sf, "part").select("p_brand", "p_name"), "p_brand", "p_name")
    return rows.select("p_brand", F.format_string("%03d-%s", "i", "p_name").alias("seed"))


def rewritten_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("id: "), F.col("o_orderkey").cast("string"), F.lit("\nport: "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "\nport: 1").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", text.rewritten_once(line, r"(?m)^port: *[0-9]+ *$", "port: 7").alias("rewritten"))


def module_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    version = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(',\n version = "'), F.col("p_size").cast("string"), F.lit('"'))).otherwise("")
    named = F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit('name = "'), "p_name", F.lit('"'))).otherwise("dev = True")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("bazel_dep("), named, version, F.lit(")\nbazel_dep(name = \"extra\")")).alias("text"))
    return dependencies.module_dependencies(rows, "text")


def inventory_table(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("| Dependency | Version |\n| --- | --- |\nprose\n| "), "s_name", F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(" |\n|lone|"))
    rows = table(spark, sf, "supplier").select("s_suppkey", line.alias("text"))
    return dependencies.inventory_rows(rows, "text")


def workflow_pins(spark: SparkSession, sf: str) -> DataFrame:
    revision = F.when(F.col("c_custkey") % 3 == 0, F.sha1("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("sha256:"), F.sha2("c_name", 256))).otherwise(F.lit("v1"))
    line = F.concat(F.lit("uses: org/step-"), (F.col("c_custkey") % 400).cast("string"), F.lit("@"), revision, F.lit(" ./skip/me@v2"))
    found = dependencies.workflow_references(table(spark, sf, "customer").select(line.alias("text")), "text")
    held = table(spark, sf, "supplier").select(F.concat(F.lit("| Org / Step "), F.col("s_suppkey").cast("string"), F.lit(" | any |")).alias("text"))
    return dependencies.workflow_errors(found, dependencies.inventory_rows(held, "text"))


def templates(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).cast("string").alias("v"))
    variables = last.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("vars"))
    return variables.select("user_id", dependencies.substituted(F.lit("c=${click};v=$view $$x"), F.col("vars")).alias("filled"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    top = F.element_at(F.array(*map(F.lit, ["src", "proto", "bazel-bin", "bazel-thirdparty", "docs", "bazel-x"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    middle = F.element_at(F.array(*map(F.lit, ["core", "tests", "bazel-out", "net"])), (F.col("p_size") % 4 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, ["a.cc", "a_test.cc", "b_fuzz.cc", "BUILD", "BUILD.x.oss", "c.pyc", "d.pb.h", "compile_commands.json", "rules.bzl", "E.CPP"])), (F.floor(F.col("p_retailprice")) % 10 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("/", top, middle, end).alias("path"))


def path_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf).select("p_partkey", "path", paths.is_generated(p).alias("generated"), paths.is_build_file(p).alias("build"), paths.is_production(p).alias("production"), paths.is_cpp(p).alias("cpp"))


_PATHS_SQL = """WITH p AS (SELECT p_partkey, ['src', 'proto', 'bazel-bin', 'bazel-thirdparty', 'docs', 'bazel-x'][(p_partkey % 6 + 1)::INT] || '/' ||
  ['core', 'tests', 'bazel-out', 'net'][(p_size % 4 + 1)::INT] || '/' ||
  ['a.cc', 'a_test.cc', 'b_fuzz.cc', 'BUILD', 'BUILD.x.oss', 'c.pyc', 'd.pb.h', 'compile_commands.json', 'rules.bzl', 'E.CPP'][(floor(p_retailprice)::BIGINT % 10 + 1)::INT] AS path FROM part) """


def production_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).where(paths.is_production(F.col("path")) & paths.is_cpp(F.col("path"))).select("path").distinct().orderBy("path")


def compile_commands(spark: SparkSession, sf: str) -> DataFrame:
    compiles = F.array(F.lit("cc"), F.lit("-O2"), F.lit("-c"), "path", F.concat(F.lit("-DN="), F.col("p_partkey").cast("string")))
    arguments = F.when(F.col("p_partkey") % 9 == 0, F.array(F.lit("ld"), "path")).otherwise(compiles)
    found = dependencies.compile_commands(_paths(spark, sf).select("p_partkey", arguments.alias("arguments")), "p_partkey")
    return found.select("source", F.concat_ws(" ", "arguments").alias("command"))


def absolute_commands(spark: SparkSession, sf: str) -> DataFrame:
    compiler = F.when(F.col("p_size") > 25, "/usr/bin/cc").otherwise("tools/cc")
    given = F.array(compiler, F.lit("-c"), F.col("p_name"), F.concat(F.lit("external/"), F.col("p_type")), F.concat(F.lit("-I=external/"), F.col("p_brand"), F.lit("=external/x")))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", dependencies.absolute_arguments(given, F.lit("/out/base/root/main"))).alias("command"))


def reactor_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Whether arguments set a reactor's resources, and a test's environment over the default one."""
    given = F.array(F.concat(F.lit("--name="), "p_brand"), F.when(F.col("p_size") < 10, F.concat(F.lit("--smp="), F.col("p_size").cast("string"))).when(F.col("p_size") < 20, "-c2").when(F.col("p_size") < 30, "--memoryless").otherwise(F.lit("--memory")))
    base = F.create_map(F.lit("SEED"), F.lit("1"), F.lit("MODE"), F.lit("plain"))
    extra = F.create_map(F.lit("MODE"), F.col("p_type"), F.lit("BRAND"), F.col("p_brand"))
    env = F.concat_ws(",", F.transform(F.array_sort(F.map_entries(dependencies.merged(base, extra))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf, "part").select("p_partkey", dependencies.sets_reactor_resources(given).alias("sets"), env.alias("env"))


def config_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration documents made from customers, some of them faulty, validated."""
    fault = F.col("c_custkey") % 12
    line = lambda n, bad, good: F.concat(F.lit("  "), F.when(fault == n, bad).otherwise(good), F.lit("\n"))
    yaml = F.concat(
        F.when(fault == 1, "other: true\n").otherwise(""),
        F.lit("broker:\n"),
        line(2, "schema_version: 2", "schema_version: 1"),
        line(3, "node_id: -1", F.concat(F.lit("node_id: "), F.col("c_custkey").cast("string"))),
        line(4, "data_directory: ' '", F.concat(F.lit("data_directory: \""), "c_name", F.lit("\""))),
        F.when(fault == 5, "  admin: {port: 65536}\n").when(fault == 6, "  admin: {address: 'a b'}\n").otherwise("  admin: {port: 80}\n"),
        line(7, "log_level: loud", "log_level: warn"),
        line(8, "developer_mode: maybe", "developer_mode: yes"),
        F.when(fault == 9, "  node_id: 3\n").when(fault == 10, "  extra: [\n").otherwise(""),
    )
    rows = table(spark, sf, "customer").select("c_custkey", yaml.alias("yaml"))
    checked = config.validated(config.parsed(rows, "yaml", "broker"), "broker")
    return checked.select("c_custkey", F.col("error.code").alias("code"), F.col("error.field").alias("field"), F.when(F.col("error").isNull(), config.rendered()).alias("line"))


_CONFIG_SQL = """
SELECT c_custkey, [NULL, 'unknown_key', 'unsupported_schema_version', 'invalid_node_id', 'invalid_data_directory', 'invalid_admin_port',
  'invalid_admin_address', 'invalid_log_level', 'invalid_type', 'duplicate_key', 'malformed_yaml', NULL][(c_custkey % 12 + 1)::INT] AS code,
  [NULL, 'root.other', 'broker.schema_version', 'broker.node_id', 'broker.data_directory', 'broker.admin.port', 'broker.admin.address',
  'broker.log_level', 'broker.developer_mode', 'broker.node_id', 'root', NULL][(c_custkey % 12 + 1)::INT] AS field,
  CASE WHEN c_custkey % 12 IN (0, 11) THEN 'schema_version=1 node_id=' || c_custkey || ' data_directory=' || c_name ||
  ' admin_address=127.0.0.1 admin_port=80 log_level=warn developer_mode=true' END AS line FROM customer
"""


def wire_messages(spark: SparkSession, sf: str) -> DataFrame:
    values = {"version": F.col("p_size").cast("string"), "revision": F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, F.repeat(F.lit("x"), 4200)).otherwise("")), "build_mode": F.col("p_type")}
    payload = codec.encoded(values)
    damaged = F.when(F.col("p_partkey") % 4 == 1, F.substring(payload, 1, 9)).otherwise(payload)
    rows = codec.decoded(table(spark, sf, "part").select("p_partkey", damaged.alias("payload")), "payload")
    return rows.select("p_partkey", F.col("info.version").alias("version"), F.col("info.revision").alias("revision"), F.col("info.build_mode").alias("build_mode"))


_WIRE_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_size::VARCHAR AS v, p_name AS n, p_type AS t FROM part)
SELECT p_partkey, CASE WHEN k > 1 THEN v END AS version, CASE WHEN k > 1 THEN n END AS revision, CASE WHEN k > 1 THEN t END AS build_mode FROM p
"""


def _package_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A graph of packages for each customer segment: nations by name, towards suppliers' nations of their orders' items."""
    nation = table(spark, sf, "nation")
    label = lambda c: F.concat(F.lit("//src/"), F.col(c), F.lit(":lib"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = orders.join(table(spark, sf, "customer"), "c_custkey").join(items, "o_orderkey").join(table(spark, sf, "supplier"), "s_suppkey")
    named = joined.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("b")), "s_nationkey")
    return named.groupBy("c_mktsegment", label("a").alias("name")).agg(F.collect_set(label("b")).alias("inputs"))


def package_cycles(spark: SparkSession, sf: str) -> DataFrame:
    rules = _package_rules(spark, sf)
    own = rules.select("c_mktsegment", graph.package(F.col("name"), ["//src", "//proto"]).alias("src"), F.explode("inputs").alias("i"))
    edges = own.select("c_mktsegment", "src", graph.package(F.col("i"), ["//src", "//proto"]).alias("dst")).where("src <> dst")
    return graph.cycles(edges, "c_mktsegment")


def packages_on_cycles(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = graph.adjacency(_package_rules(spark, sf), ["//src", "//proto"])
    return graph.on_cycles(edges)


def package_status(spark: SparkSession, sf: str) -> DataFrame:
    """2 where a segment's rules lack a name, 1 where they have a cycle, else 0; the last segment's rule of Chinese customers has none."""
    rules = _package_rules(spark, sf)
    named = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("name") == "//src/CHINA:lib"), None).otherwise(F.col("name"))
    upward = F.filter("inputs", lambda i: (F.col("c_mktsegment") != "BUILDING") | (i > F.col("name")))
    return graph.statuses(rules.select("c_mktsegment", named.alias("name"), upward.alias("inputs")), "c_mktsegment", ["//src", "//proto"])


_EDGES_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT c_mktsegment AS k, '//src/' || a.n_name AS src, '//src/' || b.n_name AS dst
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey) """
_ON_CYCLES_SQL = _EDGES_SQL + """, u AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
r AS (SELECT src, dst FROM u UNION SELECT r.src, u.dst FROM r JOIN u ON u.src = r.dst),
c AS (SELECT src AS node FROM r WHERE src = dst)
SELECT node FROM (SELECT src AS node FROM u UNION SELECT dst FROM u)
WHERE node IN (SELECT node FROM c) OR (node IN (SELECT dst FROM r WHERE src IN (SELECT node FROM c)) AND node IN (SELECT src FROM r WHERE dst IN (SELECT node FROM c)))"""
_STATUS_SQL = _EDGES_SQL + """, g AS (SELECT k, src, dst FROM e WHERE NOT (k = 'BUILDING' AND dst <= src) AND NOT (k = 'MACHINERY' AND src = '//src/CHINA') AND src <> dst),
r AS (SELECT k, src, dst FROM g UNION SELECT r.k, r.src, g.dst FROM r JOIN g ON g.k = r.k AND g.src = r.dst)
SELECT k AS c_mktsegment, CASE WHEN bool_or(k = 'MACHINERY' AND src = '//src/CHINA') THEN 2 WHEN k IN (SELECT k FROM r WHERE src = dst) THEN 1 ELSE 0 END AS status FROM e GROUP BY k"""


QUERIES = {f.__name__: f for f in (
    shard_sum, inventory_missing, inventory_present, inventory_errors, last_wins, union_distinct_sorted, xor_fold, first_error, ordered_search,
    redacted_render, escape_line, json_text, json_envelope, health_responses, error_catalog, metric_rollup, metric_exposition, metric_lookup,
    lifecycle_fold, lifecycle_stream, step_traces, checked_units, size_suffixes, version_fields, hex_round_trip, stamps, numbered_seeds,
    rewritten_lines, module_dependencies, inventory_table, workflow_pins, templates, path_kinds, production_sources, compile_commands,
    config_documents, wire_messages, package_cycles, packages_on_cycles, package_status, metric_values, metric_registry, build_info_json,
    logger_levels, absolute_commands, reactor_arguments,
)}

ORACLE_SQL = {
    "shard_sum": "SELECT sum(s)::BIGINT AS total, count(*) AS shards FROM (SELECT source, sum(n_chars) AS s FROM documents GROUP BY source)",
    "inventory_missing": _INVENTORY_SQL + "SELECT id, name FROM r WHERE n_rows = 0",
    "inventory_present": _INVENTORY_SQL + "SELECT id, name FROM r WHERE n_rows > 0",
    "inventory_errors": _INVENTORY_SQL + "SELECT id, n_rows, CASE WHEN n_rows = 0 THEN 'missing' WHEN version IS NOT NULL AND NOT v THEN 'not_inventoried' END AS error FROM r",
    "last_wins": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "union_distinct_sorted": "SELECT 'a/' || source || '/' || lang AS path FROM documents UNION SELECT 'a-b/' || event_type FROM events",
    "xor_fold": "SELECT event_type, bit_xor(event_id) AS folded FROM events GROUP BY event_type",
    "first_error": "SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'missing_key' WHEN p_size > 40 THEN 'invalid_size' WHEN p_retailprice > 1500 THEN 'invalid_price' WHEN NOT starts_with(p_brand, 'Brand#1') THEN 'unknown_key' END AS error FROM part",
    "ordered_search": _ordered_sql(),
    "redacted_render": "SELECT c_custkey, 'key=' || c_custkey || ' name=' || c_name || ' balance=<redacted> segment=' || c_mktsegment AS line FROM customer",
    "escape_line": f"SELECT doc_id, {_LINE_SQL} AS line FROM documents",
    "json_text": f"SELECT doc_id, '\"' || {_JSON_SQL} || '\"' AS body FROM documents",
    "json_envelope": """SELECT event_id, '{"code":"' || CASE WHEN event_type = 'click' THEN 'invalid_argument' ELSE event_type END || '","message":"' || replace(props, '"', '\\"') || '","correlation_id":' || CASE WHEN user_id % 2 = 0 THEN '"' || user_id || '"' ELSE 'null' END || '}' AS body FROM events""",
    "health_responses": """SELECT event_id, CASE WHEN value > 50 THEN 200 ELSE 503 END AS live_status,
CASE WHEN value > 50 THEN '{"status":"live"}' ELSE '{"code":"broker_not_live","message":"broker shutdown is in progress","correlation_id":null}' END AS live_body,
CASE WHEN value > 50 THEN 200 ELSE 503 END AS ready_status,
CASE WHEN value > 50 THEN '{"status":"ready"}' ELSE '{"code":"broker_not_ready","message":"broker is not ready","correlation_id":null}' END AS ready_body FROM events""",
    "error_catalog": "SELECT p_partkey, p_size % 7 AS code, coalesce(['success', 'invalid argument', 'value out of range', 'malformed data', 'service unavailable'][p_size % 7 + 1], 'unknown error') AS message, [NULL, 'invalid_argument', 'result_out_of_range', 'invalid_argument', 'resource_unavailable_try_again'][p_size % 7 + 1] AS condition FROM part",
    "metric_rollup": "SELECT event_type, arg_max(value, (ts, event_id)) AS gauge, count(*) AS counter FROM events GROUP BY event_type",
    "metric_exposition": "SELECT event_type, '# HELP events_' || event_type || ' Events seen' || chr(10) || '# TYPE events_' || event_type || ' counter' || chr(10) || 'events_' || event_type || ' ' || count(*) || chr(10) AS lines FROM events GROUP BY event_type",
    "metric_lookup": "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'click') = 1 THEN max(event_id) FILTER (event_type = 'click')::DOUBLE END AS value FROM events GROUP BY user_id",
    "lifecycle_fold": _LIFECYCLE_SQL,
    "lifecycle_stream": _LIFECYCLE_SQL.replace("SELECT user_id, r.s AS state, r.n AS shards, r.u AS startup, r.d AS shutdowns, r.s IN ('live', 'ready') AS live, r.s = 'ready' AS ready FROM f", "SELECT user_id::VARCHAR AS key, r.s AS state, r.n AS shards, r.u AS startup, r.d AS shutdowns, (SELECT count(*) FROM e WHERE e.user_id = f.user_id) AS events FROM f"),
    "step_traces": _TRACE_SQL,
    "checked_units": """WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey::HUGEINT * 3074457345618258 AS a, l_partkey AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a + a <= 18446744073709551615 THEN (a + a)::VARCHAR END AS added, CASE WHEN b >= 500 THEN (b - 500)::VARCHAR END AS left_over FROM l""",
    "size_suffixes": """WITH p AS (SELECT p_partkey, p_size % 10 AS n, ['GiB', 'MiB', 'GB', 'MB', 'G', 'M', 'K', ''][(p_partkey % 8 + 1)::INT] AS s FROM part)
SELECT p_partkey, n || s AS size, CASE WHEN n > 0 THEN CASE WHEN s IN ('GiB', 'GB', 'G') THEN n::BIGINT * 1024 WHEN s IN ('MiB', 'MB', 'M') THEN n::BIGINT END END AS mib FROM p""",
    "version_fields": """SELECT p_partkey, 'version=' || p_size || '.' || p_partkey || chr(9) || 'revision=' || sha1(p_name) || chr(9) || 'mode=' || p_type || chr(9) || 'name=' || p_name AS line, sha1(p_name) AS revision, p_type AS mode, 4 AS n FROM part""",
    "hex_round_trip": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2) THEN NULL ELSE p_name END AS name FROM part",
    "stamps": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE o_custkey::VARCHAR END AS stamp FROM orders",
    "packages_on_cycles": _ON_CYCLES_SQL,
    "package_status": _STATUS_SQL,
    "metric_values": """SELECT c_custkey, c_acctbal > 9000 AS infinite, CASE WHEN c_acctbal <= 9000 THEN (CASE WHEN c_acctbal < 0 THEN floor(c_acctbal)::BIGINT || 'e-3'
WHEN c_mktsegment = 'BUILDING' THEN c_custkey || '000000000000' ELSE '0.0000' || c_custkey END)::DOUBLE END AS value FROM customer""",
    "metric_registry": _LIFECYCLE_SQL.replace("WITH e AS", "WITH e AS", 1).rsplit("SELECT user_id, r.s AS state", 1)[0] + """,
q AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id),
m AS (SELECT f.user_id, r.s = 'ready' AS ready, r.n AS shards, r.u AS startup, r.d AS shutdowns, coalesce(q.n, 0) AS requests FROM f LEFT JOIN q ON q.user_id = f.user_id)
SELECT user_id, 'process_readiness' AS metric, 'gauge' AS kind, ready::INT::DOUBLE AS sample, 'Whether the broker is ready for traffic' AS description FROM m
UNION ALL SELECT user_id, 'shard_count', 'gauge', shards::DOUBLE, 'Configured reactor shard count' FROM m
UNION ALL SELECT user_id, 'startup_duration_seconds', 'gauge', startup, 'Time from application start to readiness' FROM m
UNION ALL SELECT user_id, 'shutdown_total', 'counter', shutdowns::DOUBLE, 'Number of initiated broker shutdowns' FROM m
UNION ALL SELECT user_id, 'http_requests_total', 'counter', requests::DOUBLE, 'Administrative HTTP requests' FROM m""",
    "build_info_json": """SELECT p_partkey, '{"version":"' || p_size || '.' || p_partkey || '","revision":"' || sha1(p_name) || '","build_mode":"' || p_type || '"}' AS body FROM part""",
    "logger_levels": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'error' WHEN c_acctbal < 1000 THEN 'warn' WHEN c_acctbal < 5000 THEN 'Debug' ELSE c_mktsegment[1] || lower(c_mktsegment[2:]) END AS log_level,
CASE WHEN c_acctbal < 0 THEN 'ERROR' WHEN c_acctbal < 1000 THEN 'WARN' ELSE 'INFO' END AS logger_level FROM customer""",
    "absolute_commands": """SELECT p_partkey, CASE WHEN p_size > 25 THEN '/usr/bin/cc' ELSE '/out/base/root/main/tools/cc' END || ' -c ' || p_name ||
' /out/base/external/' || p_type || ' -I=/out/base/external/' || p_brand || '=external/x' AS command FROM part""",
    "reactor_arguments": "SELECT p_partkey, p_size < 20 OR p_size >= 30 AS sets, 'BRAND=' || p_brand || ',MODE=' || p_type || ',SEED=1' AS env FROM part",
    "numbered_seeds": "SELECT p_brand, printf('%03d-%s', row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1, p_name) AS seed FROM part",
    "rewritten_lines": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'id: ' || o_orderkey || chr(10) || 'port: 7' END AS rewritten FROM orders",
    "module_dependencies": "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size::VARCHAR END AS version FROM part WHERE p_partkey % 7 > 0 UNION ALL SELECT p_partkey, 'extra', NULL FROM part",
    "inventory_table": "SELECT s_suppkey, s_name AS cell0, s_nationkey::VARCHAR AS cell1 FROM supplier",
    "workflow_pins": """WITH r AS (SELECT DISTINCT 'org/step-' || c_custkey % 400 AS name, CASE c_custkey % 3 WHEN 0 THEN sha1(c_name) WHEN 1 THEN 'sha256:' || sha256(c_name) ELSE 'v1' END AS revision FROM customer)
SELECT name, revision, 'missing' AS error FROM r WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE contains('orgstep' || s_suppkey, 'orgstep' || split_part(name, '-', 2))) UNION ALL SELECT name, revision, 'not_pinned' FROM r WHERE revision = 'v1'""",
    "templates": """WITH l AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
SELECT user_id, 'c=' || max(v) FILTER (event_type = 'click') || ';v=' || max(v) FILTER (event_type = 'view') || ' $x' AS filled FROM l GROUP BY user_id""",
    "path_kinds": _PATHS_SQL + """SELECT p_partkey, path,
split_part(path, '/', 3) IN ('compile_commands.json', 'c.pyc', 'd.pb.h') OR split_part(path, '/', 1) IN ('bazel-bin', 'bazel-x') OR split_part(path, '/', 2) = 'bazel-out' AS generated,
split_part(path, '/', 3) IN ('BUILD', 'BUILD.x.oss', 'rules.bzl') AS build,
split_part(path, '/', 1) IN ('src', 'proto') AND split_part(path, '/', 2) <> 'tests' AND NOT split_part(path, '/', 3) IN ('a_test.cc', 'b_fuzz.cc') AS production,
split_part(path, '/', 3) IN ('a.cc', 'a_test.cc', 'b_fuzz.cc', 'd.pb.h', 'E.CPP') AS cpp FROM p""",
    "production_sources": _PATHS_SQL + "SELECT DISTINCT path FROM p WHERE split_part(path, '/', 1) IN ('src', 'proto') AND split_part(path, '/', 2) <> 'tests' AND split_part(path, '/', 3) IN ('a.cc', 'd.pb.h', 'E.CPP')",
    "compile_commands": _PATHS_SQL + "SELECT path AS source, 'cc -O2 -c ' || path || ' -DN=' || max(p_partkey) AS command FROM p WHERE p_partkey % 9 <> 0 AND split_part(path, '/', 3) IN ('a.cc', 'a_test.cc', 'b_fuzz.cc', 'd.pb.h', 'E.CPP') GROUP BY path",
    "config_documents": _CONFIG_SQL,
    "wire_messages": _WIRE_SQL,
}
