"""The gate before the quality report: are the files there, are their headers whole, is the
period one? Only headers are read. What is fatal stops the report."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import fatal_findings

FINDING = "source string, finding string, what string"


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files at a path (a file, a folder or a pattern); none if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(where) or []:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [x.getPath().toString() for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> DataFrame:
    """A file's first line, of its first split: a limit over several splits would take any one's."""
    return spark.read.text(path).where("_metadata.file_block_start = 0").coalesce(1).limit(1)


def headers(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, dict[str, list[str]]]:
    """table -> file -> header. The first line of each file and no more, of all files in one job;
    an empty file has no header. A byte order mark doesn't count."""
    by_table = {name: files(spark, path) for name, path in paths.items()}
    first = [first_line(spark, f).select(F.lit(name).alias("name"), F.lit(f).alias("file"), "value") for name, found in by_table.items() for f in found]
    lines = {(r["name"], r["file"]): r["value"] for r in reduce(lambda a, b: a.unionAll(b), first).collect()} if first else {}
    parsed = lambda line: next(csv.reader([line.lstrip("﻿")]), []) if line else []
    return {name: {f: parsed(lines.get((name, f))) for f in found} for name, found in by_table.items()}


def fatal(spark: SparkSession, paths: Mapping[str, str], required: Mapping[str, Sequence[str]], start: str, end: str) -> DataFrame:
    """source, finding, what: a missing table, a missing or incomplete header of any of its files,
    repeated columns, and a period that is no period. No rows: the tables may be checked."""
    found = headers(spark, paths)
    out = set(fatal_findings({}, {}, start, end)[1])
    for name in required:
        for header in found.get(name, {}).values() or [None]:
            out |= set(fatal_findings({name: header}, {name: required[name]}, "2000-01-01", "2000-01-01")[1])
    return spark.createDataFrame(sorted(out), FINDING)


def gated(fatal_rows: DataFrame, report: Callable[[], DataFrame]) -> DataFrame:
    """The report's code, count and samples; or, if anything is fatal, that alone, and the
    report isn't run."""
    if fatal_rows.isEmpty():
        return report()
    return fatal_rows.groupBy(F.concat("source", F.lit(":"), "finding").alias("code")).agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_list("what")), ",").alias("samples"))
