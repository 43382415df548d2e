import random
import string

import pytest
from pyspark.sql import functions as F

from loomlake.functions import errors, text, units
from loomlake.operators import codec, dependencies, graph, paths, relational, state


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_escape_line(spark):
    raw = "a\\b\n\r\t\x00\x07\x1b\x1f\x7f é"
    assert one(spark, text.escape_line(F.col("t")), t=raw) == "a\\\\b\\n\\r\\t\\x00\\x07\\x1b\\x1f\\x7f é"


def test_json(spark):
    assert one(spark, text.json_string(F.col("t")), t='q"\\\b\f\n\x1b\x7f') == '"q\\"\\\\\\b\\f\\n\\u001b\x7f"'
    body = errors.envelope(F.col("c"), F.col("m"), F.lit(None).cast("string"))
    assert one(spark, body, c="bad", m='a "b"\n') == '{"code":"bad","message":"a \\"b\\"\\n","correlation_id":null}'
    live = one(spark, errors.health(F.col("f"), "live"), f=True)
    assert (live["status"], live["body"]) == (200, '{"status":"live"}')
    ready = one(spark, errors.health(F.col("f"), "ready"), f=False)
    assert (ready["status"], ready["body"]) == (503, '{"code":"broker_not_ready","message":"broker is not ready","correlation_id":null}')


def test_redaction(spark):
    line = text.render_pairs([("a", F.col("v"), True), ("token", F.col("v"), False)])
    assert one(spark, line, v="x\ny") == "a=x\\ny token=<redacted>"


@pytest.mark.parametrize("size, mib", [("2GiB", 2048), ("3GB", 3072), ("1G", 1024), ("512MiB", 512), ("7MB", 7), ("9M", 9), ("0M", None), ("-1M", None), ("1.5G", None), ("12", None), ("K", None), ("M", None), ("007M", 7), ("99999999999999999G", 99999999999999999 * 1024), ("9" * 35 + "M", None)])
def test_sizes(spark, size, mib):
    assert one(spark, text.size_mib(F.col("s")), s=size) == mib


@pytest.mark.parametrize("digits, raw", [("0a 0B\n", b"\n\x0b"), ("", b""), ("0a0", None), ("zz", None)])
def test_hex(spark, digits, raw):
    got = one(spark, text.hex_bytes(F.col("s")), s=digits)
    assert (None if got is None else bytes(got)) == raw


def test_fields_and_search(spark):
    line = "version=1\trevision=a=b\tmode="
    assert one(spark, text.fields_map(F.col("s")), s=line) == {"version": "1", "revision": "a=b", "mode": ""}
    assert one(spark, text.ordered_end(F.col("s"), ["ab", "ab"]), s="xabyab") == 7
    assert one(spark, text.ordered_end(F.col("s"), ["ab", "b"]), s="ab") is None
    assert one(spark, text.normalized(F.col("s")), s="Rules_CC 2.0é") == "rulescc20é"
    assert one(spark, text.unsigned_or_default(F.lit(None).cast("string"))) == one(spark, text.unsigned_or_default(F.lit(""))) == "0"
    assert one(spark, text.unsigned_or_default(F.col("s")), s="12\n") is None
    assert one(spark, text.rewritten_once(F.col("s"), "a.", "b"), s="a1a2") is None


def test_checked_counts(spark):
    most = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    assert one(spark, units.checked_add(most, F.lit(1).cast("decimal(20,0)"))) is None
    assert int(one(spark, units.checked_add(most, F.lit(0).cast("decimal(20,0)")))) == 2**64 - 1
    assert one(spark, units.checked_sub(F.lit(1).cast("decimal(20,0)"), F.lit(2).cast("decimal(20,0)"))) is None
    assert int(one(spark, units.checked_sub(most, most))) == 0


def test_lifecycle(spark):
    rows = [("a", 1, "listener", 3.0), ("a", 2, "ready", 1.25), ("a", 3, "shutdown", 0.0), ("a", 4, "shutdown", 0.0), ("a", 5, "stopped", 0.0), ("b", 1, "ready", 2.0)]
    found = {r.key: r for r in state.lifecycle(spark.createDataFrame(rows, "key string, seq int, kind string, value double"), "key", ["seq"], "kind", "value").collect()}
    assert tuple(found["a"])[1:] == ("stopped", 3, 1.25, 1, False, False)
    assert tuple(found["b"])[1:] == ("stopped", 0, 2.0, 0, False, False)


@pytest.mark.parametrize("outcomes, expected", [
    (["ok", "ok"], ["start:0", "start:1"]),
    (["ok", "ok", "fail", "ok"], ["start:0", "start:1", "start:2", "stop:1", "stop:0"]),
    (["ok", "abort_after", "ok"], ["start:0", "start:1", "stop:1", "stop:0"]),
    (["ok", "abort_before"], ["start:0", "stop:0"]),
    (["abort_before"], []),
    ([], []),
])
def test_traces(spark, outcomes, expected):
    frame = spark.createDataFrame([([(str(i), o) for i, o in enumerate(outcomes)],)], "steps array<struct<name:string,outcome:string>>")
    assert frame.select(state.trace(F.col("steps"))).first()[0] == expected


def test_metrics(spark):
    lines = one(spark, state.exposition("node", F.lit("shard_count"), F.lit("gauge"), F.lit(3), F.lit("Shards")))
    assert lines == "# HELP node_shard_count Shards\n# TYPE node_shard_count gauge\nnode_shard_count 3\n"
    assert one(spark, state.metric_value(F.col("t"), F.lit("node_shard_count")), t=lines) == 3.0
    assert one(spark, state.metric_value(F.col("t"), F.lit("n")), t='n{a="1"} 1\nn 2') is None
    assert one(spark, state.metric_value(F.col("t"), F.lit("n")), t='n{a="1"} 1.5\nnn 2') == 1.5


@pytest.mark.parametrize("form", ["1e+06", "+Inf", "0.00012345678", "1234567890123456", "-3", "NaN"])
def test_metric_forms(spark, form):
    got = one(spark, state.metric_value(F.col("t"), F.lit("m")), t=f"m {form}\n")
    assert got == float(form) or got != got and form == "NaN"


def test_wire_lengths(spark):
    sizes = [0, 1, 127, 128, 16_383, 16_384, 40_000, 2_097_151, 2_097_152, 268_435_455, 268_435_456, 2**31 - 1]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", codec._varint(F.col("n")).alias("v")).collect()
    for n, v in rows:
        assert bytes(v)[-1] < 128 and all(b & 128 for b in bytes(v)[:-1])
        assert sum((b & 127) << 7 * k for k, b in enumerate(bytes(v))) == n
        assert len(v) == max(1, -(-n.bit_length() // 7))


def test_arguments_and_environment(spark):
    given = F.array(*map(F.lit, ["cc", "external/a.h", "-I=external/x=external/y", "plain"]))
    assert one(spark, dependencies.absolute_arguments(given, F.lit("/o/b/r/main"))) == ["/o/b/r/main/cc", "/o/b/external/a.h", "-I=/o/b/external/x=external/y", "plain"]
    assert one(spark, dependencies.absolute_arguments(F.array(F.lit("/cc")), F.lit("/o/b/r/main"))) == ["/cc"]
    assert one(spark, dependencies.absolute_arguments(F.array().cast("array<string>"), F.lit("/o/b/r/main"))) == []
    for argument, sets in {"-c": True, "-m4": True, "--memory=1": True, "--memories": False, "--smp": True, "x-c": False}.items():
        assert one(spark, dependencies.sets_reactor_resources(F.array(F.lit("first"), F.lit(argument)))) is sets
    assert one(spark, dependencies.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def test_numbered(spark):
    rows = [("k", f"v{i % 7}", i) for i in range(200)] + [("n", "v", 0), (None, "x", 1), (None, "w", 2)]
    got = relational.numbered(spark.createDataFrame(rows, "key string, v string, n int"), "key", "v", "n").collect()
    for key in ("k", "n", None):
        own = sorted((r.v, r.n) for r in got if r.key == key)
        assert [(r.v, r.n) for r in sorted((r for r in got if r.key == key), key=lambda r: r.i)] == own
        assert sorted(r.i for r in got if r.key == key) == list(range(len(own)))


def test_lifecycle_in_pieces(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice(["listener", "ready", "shutdown", "stopped", "other"]), float(rng.randrange(9))) for i in range(400)]
    frame = spark.createDataFrame(rows, "key string, seq int, kind string, value double")
    whole, pieces = ([tuple(r) for r in state.lifecycle(frame, "key", ["seq"], "kind", "value", n).orderBy("key").collect()] for n in (1000, 3))
    assert whole == pieces
    from loomlake.streaming.lifecycle import advance

    for found in whole:
        s = ("stopped", 0, 0.0, 0, 0)
        for key, _, kind, value in rows:
            s = advance(s, kind, value) if key == found[0] else s
        assert found[1:5] == s[:4]


def test_statuses(spark):
    rules = [("k", "//s/a:x", ["//s/b:y"]), ("k", "//s/b:y", ["//s/a:x"]), ("n", "//s/a:x", ["//s/b:y", "//s/a:z"]), ("n", "//s/b:y", []), ("bad", None, []), ("bad", "//s/a:x", [])]
    frame = spark.createDataFrame(rules, "key string, name string, inputs array<string>")
    assert {r.key: r.status for r in graph.statuses(frame, "key", ["//s"]).collect()} == {"k": 1, "n": 0, "bad": 2}


def test_containment_edges(spark):
    names = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, ""), (4, None), (5, "b"), (6, "zz")], "id int, name string")
    rows = spark.createDataFrame([("xabx", 1), (None, 2), ("", 3), ("b", 4)], "cell string, name int")
    got = sorted((r.id, r.name) for r in relational.containing(names, "id", "name", rows, "cell", "name").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 3), (3, 4), (5, 1), (5, 4)]
    assert relational.containing(names.limit(0), "id", "name", rows, "cell").count() == 0


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from loomlake import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch(cluster, "x")


def test_wire_format(spark):
    golden = bytes.fromhex("0a05302e312e301210303132333435363738396162636465661a0772656c65617365")
    assert codec.parse(golden) == ("0.1.0", "0123456789abcdef", "release")
    assert codec.parse(golden[:-1]) is None and codec.parse(b"") == ("", "", "") and codec.parse(b"\x20\x05") == ("", "", "")
    exact = b"\x12" + bytes([4093 & 127 | 128, 4093 >> 7]) + b"r" * 4093
    assert len(exact) == 4096 and codec.parse(exact)[1] == "r" * 4093
    assert codec.parse(b"\x12" + bytes([4094 & 127 | 128, 4094 >> 7]) + b"r" * 4094) is None
    payload = codec.encoded({"version": F.lit("0.1.0"), "revision": F.lit("0123456789abcdef"), "build_mode": F.lit("release")})
    assert bytes(one(spark, payload)) == golden
    rows = spark.createDataFrame([(golden,), (None,), (b"\xff",)], "p binary")
    assert [r.info and r.info.version for r in codec.decoded(rows, "p").collect()] == ["0.1.0", None, None]


def test_dependencies(spark):
    module = 'bazel_dep(name = "rules_cc", version = "0.1")\nbazel_dep(\n  name = "plain",\n)\nbazel_dep(version = "9")'
    found = dependencies.module_dependencies(spark.createDataFrame([(module,)], "t string"), "t").collect()
    assert [(r.name, r.version) for r in found] == [("rules_cc", "0.1"), ("plain", None)]
    inventory = "| Dependency | Version |\n| --- | --- |\n| Rules CC | 0.1 |\ntext\n|lone|"
    rows = dependencies.inventory_rows(spark.createDataFrame([(inventory,)], "t string"), "t").collect()
    assert [(r.cell0, r.cell1) for r in rows] == [("Rules CC", "0.1")]
    workflow = "uses: a/b@v1\nuses: c/d@" + "0" * 40 + "\nrun: ./x/y@z a/b@v1"
    refs = dependencies.workflow_references(spark.createDataFrame([(workflow,)], "t string"), "t")
    errors_ = dependencies.workflow_errors(refs, spark.createDataFrame([("the C-D step",), ("A",)], "cell0 string")).collect()
    assert sorted((r.name, r.error) for r in errors_) == [("a/b", "missing"), ("a/b", "not_pinned")]
    assert one(spark, dependencies.substituted(F.lit("v ${A} ${A} ${B}"), F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2")))) == "v 1 1 2"
    assert one(spark, dependencies.substituted(F.lit("${C}"), F.create_map(F.lit("A"), F.lit("1")))) is None
    chained = F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("z"))
    for template in ("${a}|${b}", "$a$b_", "$$a $b.", "cost: $$5 ${b}", "", "plain\n$b\n", "$", "${9x}", "$9", "${b", "a $ b"):
        try:
            expected = string.Template(template).substitute({"a": "${b}", "b": "z"})
        except (KeyError, ValueError):
            expected = None
        assert one(spark, dependencies.substituted(F.lit(template), chained)) == expected, template


def test_inventory_join(spark, monkeypatch):
    names = spark.createDataFrame([(1, "rulescc", "0.1"), (2, "gone", None), (3, "rulespy", "9"), (4, "rulespy", None)], "id int, name string, version string")
    rows = spark.createDataFrame([("therulescc", "0.1"), ("rulescc", "7"), ("rulespy", "8")], "cell string, detail string")
    expected = {1: None, 2: "missing", 3: "not_inventoried", 4: None}
    for size in (8 << 20, 40):
        monkeypatch.setattr(relational, "BLOCK_BYTES", size)
        got = relational.inventory(names, rows).withColumn("e", relational.inventory_error()).collect()
        assert {r.id: r.e for r in got} == expected


def test_paths(spark):
    cases = {"bazel-out/a.cc": (True, False), "bazel-thirdparty/a.cc": (False, False), "src/x/compile_commands.json": (True, False), "a/b.pyc": (True, False), "a/BUILD.z.oss": (False, True), "BUILD": (False, True), "a/WORKSPACE.x": (False, False), "a/.bzl": (False, False), "a/x.bzl": (False, True)}
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = rows.select("p", paths.is_generated(F.col("p")).alias("g"), paths.is_build_file(F.col("p")).alias("b")).collect()
    assert {r.p: (r.g, r.b) for r in got} == cases
    both = relational.union_distinct(spark.createDataFrame([("a-b/c",), ("a/c",)], "path string"), spark.createDataFrame([("a/c",)], "path string"))
    assert [r.path for r in both.collect()] == ["a/c", "a-b/c"]


def test_compile_commands(spark):
    rows = [(0, ["cc", "-c", "a.cc", "-O1"]), (1, ["cc", "-c", "a.cc", "-O2"]), (2, ["cc", "-c", "external/x.cc"]), (3, ["cc", "x.cc", "-c"]), (4, []), (5, ["cc", "-c", "b.py"]), (6, ["cc", "-c", "B.CPP"])]
    got = dependencies.compile_commands(spark.createDataFrame(rows, "i int, arguments array<string>"), "i").collect()
    assert [(r.source, r.arguments[-1]) for r in got] == [("B.CPP", "B.CPP"), ("a.cc", "-O2")]


def test_cycles(spark):
    edges = [("k", "a", "b"), ("k", "a", "z"), ("k", "b", "c"), ("k", "c", "b"), ("k", "z", "a"), ("n", "a", "b"), ("n", "b", "c"), ("n", "a", "c")]
    frame = spark.createDataFrame(edges, "key string, src string, dst string")
    got = {r.key: (r.cycle, r.status) for r in graph.cycles(frame, "key").collect()}
    assert got == {"k": ("b -> c -> b", 1), "n": (None, 0)}
    assert {r.node for r in graph.on_cycles(frame.where("key = 'k'")).collect()} == {"a", "b", "c", "z"}
    assert graph.on_cycles(frame.where("key = 'n'")).count() == 0
    rules = spark.createDataFrame([("//src/a:x", ["//src/b:y", "//src/a:z", "@other//q"]), ("//srcs/no:x", ["//src/a:x"]), ("//proto:p", [])], "name string, inputs array<string>")
    nodes, pairs = graph.adjacency(rules, ["//src", "//proto"])
    assert {r.node for r in nodes.collect()} == {"//src/a", "//src/b", "//proto"} and [tuple(r) for r in pairs.collect()] == [("//src/a", "//src/b")]
