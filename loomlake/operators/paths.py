"""Predicates over slash-separated paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names, directories and suffixes of generated files, and names of build files.
FORBIDDEN_NAMES = ["compile_commands.json"]
FORBIDDEN_DIRECTORIES = ["bazel-bin", "bazel-out", "bazel-testlogs"]
FORBIDDEN_SUFFIXES = [".o", ".pyc", ".pb.cc", ".pb.h", "_generated.h"]
CPP_SUFFIXES = [".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"]
BUILD_SUFFIXES = [".bazel", ".bzl", ".BUILD", ".sky"]
BUILD_NAMES = ["BUILD", "WORKSPACE", "WORKSPACE.bzlmod", "WORKSPACE.oss"]


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def ends(text: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | text.endswith(s)
    return out


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    """Whether the name has one of these suffixes after something else: a name that begins with its only dot has none."""
    return path.rlike(rf"[^/](?:{'|'.join(map(re.escape, suffixes))})\z")


def is_generated(path: Column) -> Column:
    """Generated by name, directory or suffix, or below a generated top directory."""
    top = parts(path)[0]
    return (
        name(path).isin(FORBIDDEN_NAMES)
        | F.arrays_overlap(parts(path), F.array(*map(F.lit, FORBIDDEN_DIRECTORIES)))
        | ends(name(path), FORBIDDEN_SUFFIXES)
        | (top.startswith("bazel-") & (top != "bazel-thirdparty"))
    )


def is_build_file(path: Column) -> Column:
    own = name(path)
    oss = (own.startswith("BUILD.") | own.startswith("WORKSPACE.")) & own.endswith(".oss")
    return own.isin(BUILD_NAMES) | oss | has_suffix(path, BUILD_SUFFIXES)


def is_production(path: Column) -> Column:
    """Under src or proto, in no tests directory, and neither a test nor a fuzz source."""
    return parts(path)[0].isin("src", "proto") & ~F.array_contains(parts(path), "tests") & ~ends(name(path), ["_test.cc", "_fuzz.cc"])


def is_cpp(path: Column) -> Column:
    return has_suffix(F.lower(path), CPP_SUFFIXES)
