"""Reading deliveries: delimited text, headers, directories by file name, row numbers."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.functions.predicates import blank_to_null, is_missing

KEY = re.compile(r"^(B\d\d\.\d\d)(.*)$")


def normalised_names(names: Sequence[str]) -> list[str]:
    """``0010`` and ``10`` become ``c0010``; others stay; repeated names get ``_1``, ``_2``."""
    out, seen = [], {}
    for raw in names:
        name = raw.strip()
        if re.fullmatch(r"\d{1,4}", name):
            name = f"c{name.zfill(4)}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def resolve_column(df: DataFrame, code: str) -> str | None:
    """A column by its code: exact, with or without ``c``, padded to four digits; else none."""
    bare = code[1:] if code.startswith("c") else code
    for name in (code, f"c{code}", bare, f"c{bare.zfill(4)}"):
        if name in df.columns:
            return name
    return None


def cells_of(line: Column, sep: str = ";") -> Column:
    """The cells of a line: separators outside quotes, and one."""
    return F.regexp_count(F.regexp_replace(line, F.lit('"(?:[^"]|"")*"'), F.lit("")), F.lit(re.escape(sep))) + 1


def read_delimited(spark: SparkSession, paths: str | Sequence[str], header: str, sep: str = ";", quoted_breaks: bool = False, strict: bool = True) -> DataFrame:
    """All-text rows of files with one header line; a byte order mark and blank lines are dropped, blanks are null.

    ``header`` is the header line, read once by ``header_of``; every file of
    ``paths`` has it.  A line with fewer cells has nulls in the others.  A line
    with more is an error of the query that reads it, unless ``strict`` is off:
    then its further cells are dropped.  Line breaks in quoted fields need
    ``quoted_breaks``, with which Spark no longer splits files.
    """
    names = normalised_names(header.removeprefix("﻿").split(sep))
    odd = "line as it was"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([odd] if strict else [])]])
    read = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("multiLine", quoted_breaks)
    raw = (read.option("columnNameOfCorruptRecord", odd) if strict else read).csv(paths)
    cells = [blank_to_null(F.col(f"`{n}`")).alias(n) for n in names]
    if strict:  # the check is part of the first cell, so that no projection loses it
        long = cells_of(F.col(f"`{odd}`"), sep) > len(names)
        said = F.raise_error(F.concat(F.lit(f"a line has more than {len(names)} cells: "), F.col(f"`{odd}`")))
        cells[0] = F.when(long, said).otherwise(cells[0]).alias(names[0])
    return raw.select(*cells)


def malformed_lines(spark: SparkSession, files: Mapping[str, int], sep: str = ";") -> DataFrame:
    """(path, line, cells, expected, text) of lines with more cells than their file's header has, by path.

    Lines are numbered from 1 in each file, of which quoted breaks make several.
    One scan of the text; nothing of it reaches the driver.
    """
    plain = lambda p: F.regexp_replace(F.replace(p, F.lit("%20"), F.lit(" ")), "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  # one spelling of a scheme's slashes
    wanted = spark.createDataFrame(sorted(files.items()), "path string, expected int").withColumn("place", plain(F.col("path")))  # a row a file
    lines = with_row_numbers(spark.read.text(sorted(files)).withColumn("place", plain(F.col("_metadata.file_path"))), "line", 1, by_file=True)
    told = lines.withColumn("cells", cells_of(F.col("value"), sep)).join(F.broadcast(wanted), "place")
    return told.where(F.col("cells") > F.col("expected")).select("path", F.col("line").cast("long").alias("line"), "cells", "expected", F.col("value").alias("text"))


def header_of(spark: SparkSession, path: str) -> str | None:
    """The first line; none of an empty file or folder."""
    found = headers_of(spark, [path])
    return next((h for _, h in sorted(found.items())), None)


def headers_of(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The first lines of files by path, in one scan that keeps the first row of each file's first split; empty files are left out."""
    if not paths:
        return {}
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id")).where("block = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "id").alias("value"))
    return {r["path"]: r["value"] for r in first.collect() if r["value"].strip("﻿ \t")}  # a row a file


def table_key(file_name: str) -> str | None:
    """``B02.00_TypeA.csv`` is ``B02.00_TypeA``; names of another form are no tables."""
    stem = re.sub(r"\.csv$", "", file_name, flags=re.I)
    m = KEY.match(stem)
    return None if m is None else m[1] + (m[2] if m[2].startswith("_") else "_" + m[2].lstrip(" -") if m[2].strip(" -") else "")


def read_directory(spark: SparkSession, path: str, sep: str = ";", quoted_breaks: bool = False) -> dict[str, DataFrame]:
    """Tables by key, from the text files of a folder.

    A file, or a folder of part files as Spark writes it, is named by its key;
    the files of one key are appended.  Only names and header lines reach the
    driver, and the names of files that are not well formed.  Empty files are left
    out; files without a header, and files and folders in which a line has more
    cells than its header, with a warning.  That takes a scan of all lines
    before; with ``quoted_breaks`` such a line is an error of the query instead.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()
    named: dict[tuple[str, str], list[str]] = {}
    filled = {r["path"] for r in files if r["length"]}
    for f in sorted(r["path"] for r in files):
        parts = f.replace("%20", " ").split("/")
        for i in range(len(parts) - 1, max(len(parts) - 3, -1), -1):
            key = table_key(parts[i])
            if key:
                named.setdefault((key, "/".join(parts[: i + 1])), []).append(f)
                break
    named = {k: [p for p in paths if p in filled] for k, paths in named.items()}
    plain = lambda p: re.sub("^([a-z0-9]+):/+", r"\1:/", p.replace("%20", " "))
    headers = {plain(p): h for p, h in headers_of(spark, [paths[0].replace("%20", " ") for paths in named.values() if paths]).items()}
    of = {place: headers[plain(paths[0])] for (_, place), paths in named.items() if paths and plain(paths[0]) in headers}
    bad = set()
    if of and not quoted_breaks:
        cells = {p: len(of[place].split(sep)) for (_, place), paths in named.items() if place in of for p in paths}
        bad = {plain(r["path"]) for r in _malformed_paths(spark, cells, sep)}
    out: dict[str, list[DataFrame]] = {}
    for (key, place), paths in sorted(named.items()):
        if place not in of:
            warnings.warn(f"{place} has no header and is left out", stacklevel=2)
        elif any(plain(p) in bad for p in paths):
            warnings.warn(f"{place} has lines with more cells than its header and is left out", stacklevel=2)
        else:
            out.setdefault(key, []).append(read_delimited(spark, [p.replace("%20", " ") for p in paths], of[place], sep, quoted_breaks))
    return {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) for k, dfs in out.items()}


def _malformed_paths(spark: SparkSession, cells: Mapping[str, int], sep: str) -> list:
    """Of these files, by the cells of their headers, the names of those with a longer line."""
    sizes: dict[int, list[str]] = {}
    for p, n in cells.items():
        sizes.setdefault(n, []).append(p.replace("%20", " "))
    found = [spark.read.text(own).where(cells_of(F.col("value"), sep) > n).select(F.col("_metadata.file_path").alias("path")) for n, own in sorted(sizes.items())]
    return reduce(DataFrame.unionByName, found).distinct().collect()  # a row a file


def family(tables: Mapping[str, DataFrame], base: str) -> list[str]:
    """Keys equal to ``base`` or starting with it, in order."""
    if not base:
        raise ValueError("a table id is needed")
    return sorted(k for k in tables if k == base or k.startswith(base))


def first_of_family(tables: Mapping[str, DataFrame], base: str) -> DataFrame | None:
    keys = family(tables, base)
    return tables[base] if base in tables else tables[keys[0]] if keys else None


def with_row_numbers(df: DataFrame, name: str = "row", first: int = 2, by_file: bool = False) -> DataFrame:
    """Number the rows of a file-backed table in file order, the first as ``first``.

    Rows are numbered within their input split; the sizes of the splits before,
    in the order of their offsets, give the rest.  Needs a relation that is read
    from files; several files are numbered one after the other by name, or each
    from ``first`` on with ``by_file``.
    """
    place = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    sizes = place.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    ahead = W.partitionBy("_file").orderBy("_block") if by_file else W.orderBy("_file", "_block")
    before = F.coalesce(F.sum("_n").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a split
    starts = sizes.select("_file", "_block", "_low", before.alias("_before"))
    return place.join(starts, ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_id") - F.col("_low") + first).drop("_file", "_block", "_id", "_low", "_before")


def reference_date(tables: Mapping[str, DataFrame], given: str | None = None, table: str = "B99.00", field: str = "c0070", row: str = "row") -> Column | None:
    """The caller's date, or the first ten characters of the first row's, as a scalar subquery that runs with the query that uses it.

    None where no table has the field; null where its first row has none.
    """
    if given:
        return F.lit(given[:10])
    df = first_of_family(tables, table)
    if df is None or field not in df.columns:
        return None
    first = F.min_by(F.struct(field), row) if row in df.columns else F.first(F.struct(field))
    return df.agg(first.alias("first")).select(F.when(~is_missing(F.col(f"first.{field}")), F.substring(F.col(f"first.{field}"), 1, 10))).scalar()
