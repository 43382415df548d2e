"""Dependencies declared in module and workflow texts, inventory tables, templates and variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import normalized

from .relational import containing

#: The patterns of a module declaration, its fields, and a workflow reference.
MODULE = r"(?s)bazel_dep\((.*?)\)"
NAME = r"\bname\s*=\s*\"([^\"]+)\""
VERSION = r"\bversion\s*=\s*\"([^\"]+)\""
REFERENCE = r"(?<![./])\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+@[^\s\"']+)"
PIN = r"\A(?:[0-9a-fA-F]{40}|sha256:[0-9a-fA-F]{64})\z"


def group_or_null(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def module_dependencies(rows: DataFrame, text: str) -> DataFrame:
    """Adds name and version (null: none given) of each named declaration in the text."""
    bodies = rows.withColumn("_body", F.explode(F.regexp_extract_all(F.col(text), F.lit(MODULE), F.lit(1))))
    named = bodies.withColumns({"name": group_or_null(F.col("_body"), NAME), "version": group_or_null(F.col("_body"), VERSION)})
    return named.where("name IS NOT NULL").drop("_body", text)


def inventory_rows(rows: DataFrame, text: str) -> DataFrame:
    """Adds cell0 and cell1 of each table row with two cells or more that is no header or rule."""
    lines = rows.withColumn("_line", F.explode(F.split(F.col(text), "\n"))).where(F.col("_line").startswith("|"))
    inner = F.regexp_replace("_line", r"\A\|+|\|+\z", "")
    cells = lines.withColumn("_cells", F.transform(F.split(inner, r"\|"), lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", ""))).where(F.size("_cells") >= 2)
    kept = cells.where(~F.get("_cells", F.lit(0)).isin("Dependency", "---"))
    return kept.withColumns({"cell0": F.get("_cells", F.lit(0)), "cell1": F.get("_cells", F.lit(1))}).drop("_line", "_cells", text)


def workflow_references(rows: DataFrame, text: str) -> DataFrame:
    """The distinct name and revision of all references in the texts."""
    found = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(REFERENCE), F.lit(1))).alias("_ref")).distinct()
    at = F.locate("@", F.col("_ref"))
    return found.select(F.substr("_ref", F.lit(1), at - 1).alias("name"), F.substr("_ref", at + 1).alias("revision"))


def workflow_errors(references: DataFrame, inventory: DataFrame) -> DataFrame:
    """name, revision, error of each reference; a reference may have either error or both.

    missing: no cell0 of the inventory contains its name, both reduced to letters and digits;
    not_pinned: its revision is no full digest.
    """
    names = references.select("name").distinct().withColumn("_key", normalized(F.col("name")))
    cells = inventory.select(normalized(F.col("cell0")).alias("_cell")).distinct()
    held = containing(names, "name", "_key", cells, "_cell").select("name").distinct()
    missing = references.join(held, "name", "left_anti").select("name", "revision", F.lit("missing").alias("error"))
    loose = references.where(~F.col("revision").rlike(PIN)).select("name", "revision", F.lit("not_pinned").alias("error"))
    return missing.unionAll(loose)


#: Fixed value: the name of a template's variable.
VARIABLE = "[A-Za-z_][A-Za-z0-9_]*"


def substituted(template: Column, variables: Column) -> Column:
    """The template with ${KEY} and $KEY looked up once in a map and $$ as a dollar; null where a key is missing or a dollar stands alone."""
    pieces = F.regexp_extract_all(template, F.lit(rf"(?s)(\$\$|\$\{{{VARIABLE}\}}|\${VARIABLE}|\$|[^$]+)"), F.lit(1))
    looked = lambda p: F.try_element_at(variables, F.regexp_extract(p, VARIABLE, 0))
    filled = F.transform(pieces, lambda p: F.when(~p.startswith("$"), p).when(p == "$$", "$").when(p != "$", looked(p)))
    return F.when(F.forall(filled, lambda p: p.isNotNull()), F.array_join(filled, ""))


def compile_commands(actions: DataFrame, order: str) -> DataFrame:
    """source, arguments of the last compile action of each source, sorted by source.

    The source follows the first -c that has something after it; external and generated
    sources, and those that are no C or C++, are left out.
    """
    from .paths import is_cpp

    args = F.col("arguments")
    at = F.array_position(F.slice(args, 1, F.greatest(F.size(args) - 1, F.lit(0))), "-c")
    source = F.when(at > 0, F.get(args, at.cast("int")))
    found = actions.withColumn("source", source).where(F.col("source").isNotNull() & is_cpp(F.col("source")) & ~F.col("source").startswith("external/") & ~F.col("source").startswith("bazel-out/"))
    return found.groupBy("source").agg(F.max_by("arguments", order).alias("arguments")).orderBy("source")


def absolute_arguments(arguments: Column, root: Column) -> Column:
    """A command's arguments with the compiler below root unless its path is absolute, and external/ paths, alone or after an equals sign, in the folder external beside root's parent.

    A wrapper script is kept as the compiler: what it would run depends on files of another machine.
    """
    compiler = F.get(arguments, F.lit(0))
    outside = F.concat(F.regexp_replace(root, r"/[^/]+/[^/]+/?\z", ""), F.lit("/external/"))
    first = F.when(compiler.startswith("/"), compiler).otherwise(F.concat(root, F.lit("/"), compiler))
    at = lambda a: F.locate("=external/", a)
    moved = lambda a: F.when(a.startswith("external/"), F.concat(outside, F.substr(a, F.lit(10)))).when(at(a) > 0, F.concat(F.substr(a, F.lit(1), at(a)), outside, F.substr(a, at(a) + 10))).otherwise(a)
    rest = F.transform(F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0))), moved)
    return F.when(F.size(arguments) > 0, F.concat(F.array(first), rest)).otherwise(arguments)


#: Arguments that set a reactor's CPUs or memory, alone or as what an argument begins with.
REACTOR_WORDS = ["-c", "-m", "--memory", "--smp"]
REACTOR_STARTS = ["-c", "-m", "--memory=", "--smp="]


def sets_reactor_resources(arguments: Column) -> Column:
    starts = lambda a: reduce(lambda x, s: x | a.startswith(s), REACTOR_STARTS, a.isin(REACTOR_WORDS))
    return F.exists(arguments, starts)


def merged(base: Column, extra: Column) -> Column:
    """The map of both; extra wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)
