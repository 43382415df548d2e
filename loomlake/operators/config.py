"""Bootstrap configuration: YAML documents to rows of nodes, and their validation, first error first.

Reading YAML needs Python; everything after the nodes is column work on one row a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import render_pairs
from loomlake.session import ship

try:
    import yaml
except ImportError:
    yaml = None  # the column functions do without

#: The keys of a document, and the defaults of those that may be left out.
SETTINGS = ["schema_version", "node_id", "data_directory", "admin", "log_level", "developer_mode"]
ADMIN = ["address", "port"]
DEFAULTS = {"node_id": "0", "data_directory": "./data", "admin_address": "127.0.0.1", "admin_port": "9644", "log_level": "info", "developer_mode": "false"}
LEVELS = ["trace", "debug", "info", "warn", "error"]
SCHEMA_VERSION = 1

NODE = "struct<kind:string,value:string,is_text:boolean>"
NODES = f"parsed boolean, key_error struct<code:string,field:string>, nodes map<string,{NODE}>"
BOOLEANS = "y yes true on n no false off".split()
NUMBER = re.compile(r"[-+]?(0[xX][0-9a-fA-F]+|0[0-7]*|[0-9]+|([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?|\.(inf|Inf|INF))|\.(nan|NaN|NAN)")


def _is_text(tag: str | None, plain: bool, value: str) -> bool:
    """Whether a scalar is a string: by quotes or tag, or because it is no boolean and no number."""
    if not plain or tag == "tag:yaml.org,2002:str":
        return True
    if tag is not None:
        return False
    case = value.lower() if value in (value.lower(), value.upper(), value.capitalize()) else value
    return case not in BOOLEANS and not NUMBER.fullmatch(value)


@dataclass(slots=True)
class Node:
    """A YAML node as written: kind, the value of a scalar, whether it is plain, its tag if one is given, and what it holds."""

    kind: str
    value: object = None
    plain: bool = False
    tag: str | None = None


#: Plain scalars that are null.
NULLS = ["", "~", "null", "Null", "NULL"]


def _events(text: str) -> Iterator:
    """The parser's events of a text: in C where PyYAML has it, and then without the rest of a loader."""
    if yaml.__with_libyaml__:
        return iter(yaml.cyaml.CParser(text).get_event, None)
    return yaml.parse(text, Loader=yaml.SafeLoader)


def _top(text: str) -> Node | None:
    """The node of a text's only document, built from the parser's events."""
    stack, named, top, documents = [], {}, None, 0
    for event in _events(text):
        kind = type(event)
        if kind is yaml.ScalarEvent:
            node = Node("scalar", event.value, not event.style, event.tag)
        elif kind is yaml.MappingStartEvent or kind is yaml.SequenceStartEvent:
            node = Node("mapping" if kind is yaml.MappingStartEvent else "sequence", [], False, event.tag)
        elif kind is yaml.MappingEndEvent or kind is yaml.SequenceEndEvent:
            stack.pop()
            continue
        elif kind is yaml.AliasEvent:
            if event.anchor not in named:
                raise ValueError("an alias without an anchor")
            node = named[event.anchor]
        else:
            if kind is yaml.DocumentStartEvent:
                documents += 1
                named = {}
            continue
        if stack:
            stack[-1].value.append(node)
        else:
            top = node
        if kind is yaml.AliasEvent:
            continue
        if event.anchor:
            if event.anchor in named:
                raise ValueError("an anchor twice")
            named[event.anchor] = node
        if kind is not yaml.ScalarEvent:
            stack.append(node)
    if documents > 1:
        raise ValueError("more than one document")
    return top


def _nodes(text: str, root: str):
    """Whether it parses, the first key error in document order, and the nodes that are needed."""
    try:
        top = _top(text)
    except (yaml.YAMLError, ValueError):
        return False, None, {}
    pairs = lambda node: list(zip(node.value[::2], node.value[1::2]))
    nodes: dict[str, tuple] = {}

    def take(path: str, node) -> None:
        if node.kind == "scalar":
            is_null = node.plain and (node.tag == "tag:yaml.org,2002:null" or node.tag is None and node.value in NULLS)
            nodes[path] = ("null" if is_null else "scalar", node.value, _is_text(node.tag, node.plain, node.value))
        else:
            nodes[path] = (node.kind, None, False)

    def keys(node, field: str, allowed: list[str]):
        if node is None or node.kind != "mapping":
            return "invalid_type", field
        seen = set()
        for key, _ in pairs(node):
            if key.kind != "scalar":
                return "invalid_type", field
            if key.value not in allowed:
                return "unknown_key", f"{field}.{key.value}"
            if key.value in seen:
                return "duplicate_key", f"{field}.{key.value}"
            seen.add(key.value)
        return None

    error = keys(top, "root", [root])
    if error:
        return True, error, nodes
    if not top.value:
        return True, ("missing_key", root), nodes
    settings = top.value[1]
    error = keys(settings, root, SETTINGS)
    if error:
        return True, error, nodes
    admin_error = None
    for key, node in pairs(settings):
        take(key.value, node)
        if key.value == "admin":
            admin_error = keys(node, f"{root}.admin", ADMIN)
            if admin_error is None:
                for name, inner in pairs(node):
                    take(f"admin_{name.value}", inner)
    if admin_error:
        nodes["admin_error"] = (*admin_error, False)
    return True, None, nodes


def parsed(rows: DataFrame, text: str, root: str) -> DataFrame:
    """Adds parsed, key_error and nodes of each YAML document.

    Parsing is the work here and a table of many rows may be a few small files, so rows are
    dealt to all cores first.
    """
    spark = ship(rows.sparkSession)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.arrow_udf(NODES)
    def run(column: pa.Array) -> pa.Array:
        goods, codes, fields, ends, paths = [], [], [], [0], []
        kinds, values, texts = [], [], []
        for value in column.to_pylist():
            good, error, nodes = _nodes(value or "", root)
            goods.append(good)
            code, field = error or (None, None)
            codes.append(code)
            fields.append(field)
            for path, (kind, content, is_text) in nodes.items():
                paths.append(path)
                kinds.append(kind)
                values.append(content)
                texts.append(is_text)
            ends.append(len(paths))
        strings = lambda x: pa.array(x, pa.string())
        errors = pa.StructArray.from_arrays([strings(codes), strings(fields)], ["code", "field"], mask=pa.array([c is None for c in codes], pa.bool_()))
        node = pa.StructArray.from_arrays([strings(kinds), strings(values), pa.array(texts, pa.bool_())], ["kind", "value", "is_text"])
        maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), strings(paths), node)
        return pa.StructArray.from_arrays([pa.array(goods, pa.bool_()), errors, maps], ["parsed", "key_error", "nodes"])

    return rows.repartition(parts).withColumn("_yaml", run(text)).select(*rows.columns, "_yaml.*")


def _integer(value: Column) -> Column:
    """A whole number: decimal, octal after 0 or hexadecimal after 0x."""
    sign = F.when(value.startswith("-"), -1).otherwise(1)
    digits = lambda pattern: F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
    based = lambda pattern, base: sign * F.conv(digits(pattern), base, 10).try_cast("bigint")
    plain = F.when(value.rlike(r"\A[-+]?([1-9][0-9]*|0)\z"), value.try_cast("bigint"))
    return F.coalesce(plain, based(r"\A[-+]?0[xX]0*([0-9a-fA-F]{1,16})\z", 16), based(r"\A[-+]?0+([0-7]{1,21})\z", 8))


def log_levels(default: str = "INFO") -> Column:
    """Spark's level for the setting log_level; the default for any other text."""
    return F.coalesce(*(F.when(F.col("log_level") == level, F.lit(level.upper())) for level in LEVELS), F.lit(default))


def validated(rows: DataFrame, root: str) -> DataFrame:
    """Adds error (struct<code, field>, null if valid) and the seven settings, with defaults, to what parsed() gives."""
    nodes = F.col("nodes")
    kind, value, is_text = (lambda k: nodes[k]["kind"]), (lambda k: nodes[k]["value"]), (lambda k: nodes[k]["is_text"])
    there = lambda k: F.map_contains_key(nodes, F.lit(k))
    no_integer = lambda k: there(k) & ((kind(k) != "scalar") | _integer(value(k)).isNull())
    no_text = lambda k: there(k) & ((kind(k) != "scalar") | ~is_text(k))
    outside = lambda k, low, high: there(k) & ~_integer(value(k)).between(low, high)
    booleans = F.lower(value("developer_mode")).isin(BOOLEANS)
    blank = lambda k: value(k).rlike(r"\A\s*\z")
    checks = [
        (~F.col("parsed"), "malformed_yaml", "root"),
        (~there("schema_version"), "missing_key", "schema_version"),
        (no_integer("schema_version"), "invalid_type", "schema_version"),
        (_integer(value("schema_version")) != SCHEMA_VERSION, "unsupported_schema_version", "schema_version"),
        (no_integer("node_id"), "invalid_type", "node_id"),
        (outside("node_id", 0, 2**31 - 1), "invalid_node_id", "node_id"),
        (no_text("data_directory"), "invalid_type", "data_directory"),
        (there("data_directory") & (blank("data_directory") | value("data_directory").contains("\0")), "invalid_data_directory", "data_directory"),
        (no_text("admin_address"), "invalid_type", "admin.address"),
        (there("admin_address") & value("admin_address").rlike(r"\A\z|[\s\x00-\x1f\x7f]"), "invalid_admin_address", "admin.address"),
        (no_integer("admin_port"), "invalid_type", "admin.port"),
        (outside("admin_port", 1, 65535), "invalid_admin_port", "admin.port"),
        (no_text("log_level"), "invalid_type", "log_level"),
        (there("log_level") & ~value("log_level").isin(LEVELS), "invalid_log_level", "log_level"),
        (there("developer_mode") & ((kind("developer_mode") != "scalar") | ~booleans), "invalid_type", "developer_mode"),
    ]
    error = lambda code, name: F.struct(F.lit(code).alias("code"), F.lit(name if name == "root" else f"{root}.{name}").alias("field"))
    at = {i: F.when(failed, error(code, name)) for i, (failed, code, name) in enumerate(checks)}
    admin = F.when(there("admin_error"), F.struct(kind("admin_error").alias("code"), value("admin_error").alias("field")))
    first = F.coalesce(at[0], F.col("key_error"), *(at[i] for i in range(1, 8)), admin, *(at[i] for i in range(8, len(checks))))
    good = F.col("error").isNull()
    setting = lambda k: F.when(good, F.coalesce(value(k), F.lit(DEFAULTS[k])))
    return rows.withColumn("error", first).withColumns({
        "schema_version": F.when(good, F.lit(SCHEMA_VERSION).cast("long")),
        "node_id": F.when(good, F.coalesce(_integer(value("node_id")), F.lit(int(DEFAULTS["node_id"])))).cast("int"),
        "data_directory": setting("data_directory"),
        "admin_address": setting("admin_address"),
        "admin_port": F.when(good, F.coalesce(_integer(value("admin_port")), F.lit(int(DEFAULTS["admin_port"])))).cast("int"),
        "log_level": setting("log_level"),
        "developer_mode": F.when(good, F.lower(F.coalesce(value("developer_mode"), F.lit("false"))).isin("y", "yes", "true", "on")),
    })


def rendered() -> Column:
    """The seven settings of a valid row on one line."""
    names = ["schema_version", "node_id", "data_directory", "admin_address", "admin_port", "log_level", "developer_mode"]
    return render_pairs([(n, F.col(n).cast("string"), True) for n in names])


