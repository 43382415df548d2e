"""Package graphs: edges of rules, existence of cycles by reachability, and the first cycle of a depth-first walk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.session import discard, materialize, ship


def package(label: Column, roots: list[str]) -> Column:
    """The package of a label if it is one of these roots or below one, else null."""
    own = F.split_part(label, F.lit(":"), F.lit(1))
    inside = F.lit(False)
    for root in roots:
        inside = inside | (own == root) | own.startswith(f"{root}/")
    return F.when(inside, own)


def adjacency(rules: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) and edges (src, dst) of rules with a name and an array of input names.

    Labels outside the roots and edges of a package to itself are left out; a missing name raises.
    """
    checked = rules.select(
        F.when(F.col("name").isNull(), F.raise_error(F.lit("rule element is missing required name attribute"))).otherwise(F.col("name")).alias("name"),
        "inputs",
    )
    own = checked.select(package(F.col("name"), roots).alias("src"), F.explode_outer("inputs").alias("input"))
    named = own.where("src IS NOT NULL").select("src", package(F.col("input"), roots).alias("dst"))
    edges = named.where("dst IS NOT NULL AND src <> dst").distinct()
    nodes = named.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    return nodes, edges


def on_cycles(edges: DataFrame) -> DataFrame:
    """The nodes that no peeling of sources and sinks removes: none exactly where there is no cycle.

    Each round drops edges from nodes without an incoming edge and to nodes without an
    outgoing one, and is cut off by a written table; rounds grow with the longest path that
    leads into or out of cycles.
    """
    current = materialize(edges.select("src", "dst").distinct(), "cycle-edges")
    left = current.count()
    while left:
        inner = current.join(current.select(F.col("dst").alias("_n")).distinct(), F.col("src") == F.col("_n"), "left_semi")
        inner = inner.join(current.select(F.col("src").alias("_n")).distinct(), F.col("dst") == F.col("_n"), "left_semi")
        previous, current = current, materialize(inner, "cycle-edges")
        discard(previous)
        now = current.count()
        if now == left:
            break
        left = now
    return current.select(F.col("src").alias("node")).distinct()


def first_cycle(frame: pd.DataFrame) -> list[str] | None:
    """The closed path that a depth-first walk in sorted order meets first."""
    after = {src: sorted(set(group)) for src, group in frame.groupby("src")["dst"]}
    done: set[str] = set()
    for start in sorted({*after, *frame["dst"]}):
        path, on_path, waiting = [], {}, [(start, iter(after.get(start, [])))]
        if start in done:
            continue
        path.append(start)
        on_path[start] = 0
        while waiting:
            node, following = waiting[-1]
            for succ in following:
                if succ in on_path:
                    return path[on_path[succ] :] + [succ]
                if succ not in done:
                    on_path[succ] = len(path)
                    path.append(succ)
                    waiting.append((succ, iter(after.get(succ, []))))
                    break
            else:
                waiting.pop()
                path.pop()
                del on_path[node]
                done.add(node)
    return None


def cycles(edges: DataFrame, key: str) -> DataFrame:
    """key, cycle (null where there is none) and status (0 none, 1 cycle) of each graph.

    A graph, the edges of one key, is a module tree that one task holds.
    """
    ship(edges.sparkSession)
    kind = edges.schema[key].dataType.simpleString()

    def walk(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = first_cycle(frame)
        return pd.DataFrame({key: [keys[0]], "cycle": [" -> ".join(found) if found else None], "status": [int(found is not None)]})

    return edges.select(key, "src", "dst").distinct().groupBy(key).applyInPandas(walk, f"{key} {kind}, cycle string, status int")


def statuses(rules: DataFrame, key: str, roots: list[str]) -> DataFrame:
    """key, status of each graph of rules (name, inputs): 2 where a rule has no name, else 1 where there is a cycle, else 0.

    All graphs are peeled together, as one whose nodes carry their key.
    """
    own = rules.select(key, F.col("name").isNull().alias("_bad"), package(F.col("name"), roots).alias("_src"), F.explode_outer("inputs").alias("_input"))
    edges = own.select(key, "_src", package(F.col("_input"), roots).alias("_dst")).where("_src IS NOT NULL AND _dst IS NOT NULL AND _src <> _dst")
    node = lambda c: F.struct(F.col(key).alias("key"), F.col(c).alias("package"))
    cyclic = on_cycles(edges.select(node("_src").alias("src"), node("_dst").alias("dst"))).select(F.col("node.key").alias(key), F.lit(1).alias("_cycle")).distinct()
    bad = own.groupBy(key).agg(F.bool_or("_bad").alias("_bad"))
    return bad.join(cyclic, key, "left").select(key, F.when(F.col("_bad"), 2).otherwise(F.coalesce("_cycle", F.lit(0))).alias("status"))
