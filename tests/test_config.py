import pytest

pytest.importorskip("yaml")

from pyspark.sql import functions as F  # noqa: E402

from loomlake.operators import config  # noqa: E402

#: What a scalar setting takes, and what it does not, with the error that the latter gives.
GOOD = {"schema_version": ["1", "0x1", "01"], "node_id": ["0", "7", "0x1f", "2147483647"], "data_directory": ["'/srv/x'", "!!str 9", '"8"'], "log_level": ["trace", "error"], "developer_mode": ["on", "FALSE", "Y"]}
BAD = {
    "schema_version": [("9", "unsupported_schema_version"), ("one", "invalid_type"), ("~", "invalid_type"), ("[1]", "invalid_type"), ("08", "invalid_type")],
    "node_id": [("-5", "invalid_node_id"), ("2147483648", "invalid_node_id"), ("x7", "invalid_type"), ("{}", "invalid_type"), ("1.5", "invalid_type")],
    "data_directory": [("'  '", "invalid_data_directory"), ("44", "invalid_type"), ("no", "invalid_type"), ("-.5e3", "invalid_type"), ("0x2a", "invalid_type")],
    "log_level": [("chatty", "invalid_log_level"), ("INFO", "invalid_log_level"), ("6", "invalid_type"), ("off", "invalid_type")],
    "developer_mode": [("2", "invalid_type"), ("perhaps", "invalid_type"), ("[]", "invalid_type")],
}
ADMIN_GOOD = {"address": ["'::1'", "host.example"], "port": ["1", "65535", "0x50"]}
ADMIN_BAD = {
    "address": [("'tab\\there'", None), ('"tab\\there"', "invalid_admin_address"), ("'two words'", "invalid_admin_address"), ("12", "invalid_type"), ("yes", "invalid_type")],
    "port": [("-1", "invalid_admin_port"), ("70000", "invalid_admin_port"), ("web", "invalid_type")],
}


def document(root="top", admin=(), **settings):
    """A block-style document of these settings; the version is there unless given."""
    lines = [f"{root}:"] + [f"  {k}: {v}" for k, v in {"schema_version": "1", **settings}.items() if v is not None]
    if admin:
        lines += ["  admin:"] + [f"    {k}: {v}" for k, v in admin]
    return "\n".join(lines) + "\n"


def cases():
    for name, values in GOOD.items():
        for value in values:
            yield document(**{name: value}), None
    for name, values in BAD.items():
        for value, code in values:
            yield document(**{name: value}), (code, f"top.{name}")
    for name, values in ADMIN_GOOD.items():
        for value in values:
            yield document(admin=[(name, value)]), None
    for name, values in ADMIN_BAD.items():
        for value, code in values:
            yield document(admin=[(name, value)]), code and (code, f"top.admin.{name}")
    # Anchors and aliases, an alias of nothing, two documents, and none.
    yield "top: {schema_version: &v 1, node_id: *v}", None
    yield "top: {schema_version: *gone}", ("malformed_yaml", "root")
    yield document() + "---\n" + document(), ("malformed_yaml", "root")
    yield "", ("invalid_type", "root")
    # Structure: unknown, repeated and missing keys, other shapes, and text that is no YAML.
    yield document(colour="red"), ("unknown_key", "top.colour")
    yield document(admin=[("host", "x")]), ("unknown_key", "top.admin.host")
    yield document() + "second: {}\n", ("unknown_key", "root.second")
    yield document(node_id="4") + "  node_id: 5\n", ("duplicate_key", "top.node_id")
    yield document(admin=[("port", "5"), ("port", "6")]), ("duplicate_key", "top.admin.port")
    yield document(schema_version=None, node_id="4"), ("missing_key", "top.schema_version")
    yield "{}", ("missing_key", "top")
    yield "- top", ("invalid_type", "root")
    yield "top: 5", ("invalid_type", "top")
    yield "top: {schema_version: 1, admin: 5}", ("invalid_type", "top.admin")
    yield document() + "  broken: [", ("malformed_yaml", "root")
    # Of several errors, the first in the order of the checks.
    order = ["schema_version", "node_id", "data_directory", "log_level", "developer_mode"]
    for at in range(len(order) - 1):
        yield document(**{n: BAD[n][0][0] for n in reversed(order[at:])}), (BAD[order[at]][0][1], f"top.{order[at]}")


def test_errors(spark):
    every = list(cases())
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(every)], "i int, yaml string")
    got = {r.i: r.error and (r.error.code, r.error.field) for r in config.validated(config.parsed(frame, "yaml", "top"), "top").collect()}
    assert {i: (c[0], got[i]) for i, c in enumerate(every) if got[i] != c[1]} == {}


def test_defaults_and_strings(spark):
    texts = [document(), document(data_directory="'5'", node_id="0x10", developer_mode="Yes", admin=[("address", "!!str 7"), ("port", "010")])]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, yaml string")
    rows = config.validated(config.parsed(frame, "yaml", "top"), "top").withColumn("line", config.rendered()).withColumn("level", config.log_levels()).orderBy("i").collect()
    assert rows[0].line == "schema_version=1 node_id=0 data_directory=./data admin_address=127.0.0.1 admin_port=9644 log_level=info developer_mode=false"
    assert rows[1].line == "schema_version=1 node_id=16 data_directory=5 admin_address=7 admin_port=8 log_level=info developer_mode=true"
    assert rows[0].level == "INFO"


def test_one_file_is_parsed_by_many_tasks(spark):
    """Small files with many documents, and any with one row group, are read by one task; parsing is shared out."""
    one = spark.range(400).coalesce(1).select("id", F.concat(F.lit(document()), F.lit("  node_id: "), "id").alias("yaml"))
    rows = config.validated(config.parsed(one, "yaml", "top"), "top").select("id", "error", "node_id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.id, r.node_id) for r in rows if r.error is None) == [(i, i) for i in range(400)]
    assert len({r.task for r in rows}) > 1


def test_null_and_odd_texts(spark):
    texts = [(0, None), (1, "top: {schema_version: 1, data_directory: 'é\U0001f600'}"), (2, "top: \x00"), (3, "[" * 300), (4, "top: &a {schema_version: 1, admin: *a}"), (5, "--- {}\n--- {}")]
    rows = config.parsed(spark.createDataFrame(texts, "i int, yaml string"), "yaml", "top").orderBy("i").collect()
    assert [r.parsed for r in rows] == [True, True, False, False, True, False]
    assert [r.key_error and tuple(r.key_error) for r in rows] == [("invalid_type", "root"), None, None, None, None, None]
    assert rows[1].nodes["data_directory"].value == "é\U0001f600" and rows[3].nodes == {} and rows[4].nodes["admin_error"].kind == "unknown_key"


def test_logger_levels(spark):
    rows = spark.createDataFrame([(level,) for level in [*config.LEVELS, "other", None]], "log_level string").select(config.log_levels().alias("x"))
    assert [r.x for r in rows.collect()] == ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "INFO", "INFO"]
    assert spark.range(1).select(F.lit(1)).count() == 1
