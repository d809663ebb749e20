"""Text tables with quoted line breaks, read by many tasks.

A file is read as physical lines by Spark's text reader, which cuts it in byte ranges. Whether a line begins inside a
quoted field depends on all that stands before it, but what a line does to either state is known from the line alone: it
maps inside or outside at its beginning to inside or outside at its end. Each range gives the composition of its lines'
maps, one row; composed in order of the ranges (a row a range) they tell how every range begins. A second pass puts
lines together to records within each range and writes them to the checkpoint folder, as header, types and rows are all
read from them. Only the pieces of a record that crosses ranges are joined, before Spark parses the records.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.functions.ranks import ensure_checkpoints, lookup_side


def line_maps(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """(lines that leave a field open when they begin outside of one, the same for lines that begin inside). A quote opens
    a field only at its beginning, behind blanks; a doubled quote does not close it."""
    s = re.escape(sep)
    blank = r"[ \t]*+" if sep != "\t" else r"[ ]*+"
    inner = r'[^"]*+(?:""[^"]*+)*+'
    field = rf'{blank}(?:"{inner}"[^{s}]*+|[^{s}"][^{s}]*+)?+'
    opening = rf'{blank}"{inner}'
    return re.compile(rf"(?:{field}{s})*+{opening}"), re.compile(rf'{inner}|{inner}"[^{s}]*+{s}(?:{field}{s})*+{opening}')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[str]]]:
    """Lines of each range in a batch, in order, by its file and start (and whether it begins inside, where given)."""
    if not batch.num_rows:
        return
    ends = np.zeros(batch.num_rows - 1, bool)
    for c in batch.columns[1:3]:
        ends |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    at = 0
    for k in (*(np.flatnonzero(ends) + 1).tolist(), batch.num_rows):
        yield tuple(c[at].as_py() for c in batch.columns[1:]), batch.column(0)[at:k].to_pylist()
        at = k


def range_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, start, inside): whether each range begins inside a quoted field."""
    ensure_checkpoints(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside, inside = line_maps(sep)
        ends: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for key, values in _runs(batch):
                state = ends.setdefault(key, [False, True])
                for v in values:
                    if '"' in v:  # any other line leaves both as they are
                        state[:] = [(inside if s else outside).fullmatch(v) is not None for s in state]
        rows = [(*k, *v) for k, v in ends.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.bool_(), pa.bool_())], names=["file", "start", "from_outside", "from_inside"])

    maps = lines.mapInArrow(run, "file string, start bigint, from_outside boolean, from_inside boolean").checkpoint()  # a row a range
    # a map that doesn't look at the state forgets all before it; from there on only the others need to be composed
    steps = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("start").alias("at"), F.col("from_outside").alias("state")))
    turns = F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)
    placed = maps.withColumn("fixed", F.last(fixed, ignorenulls=True).over(steps)).withColumn("turns", F.sum(turns).over(steps)).withColumn("turned", F.sum(turns).over(steps.rowsBetween(Window.unboundedPreceding, 0)))
    at_fixed = placed.select(F.col("file").alias("_file"), F.col("start").alias("_at"), F.col("turned").alias("until"))
    met = placed.join(at_fixed, (F.col("file") == F.col("_file")) & (F.col("fixed.at") == F.col("_at")), "left")
    odd = (F.coalesce("turns", F.lit(0)) - F.coalesce("until", F.lit(0))) % 2 == 1
    return met.select("file", "start", (F.coalesce("fixed.state", F.lit(False)) != odd).alias("inside"))


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, start, nth, first, record): logical lines, with whether each is its file's first."""
    lines = _lines(spark, path)
    states = lookup_side(range_states(lines, sep).select(F.col("file").alias("_file"), F.col("start").alias("_start"), "inside"))
    placed = lines.join(states, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start"))).select("value", "file", "start", "inside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside, inside = line_maps(sep)
        key, held, state, nth, tail = None, [], False, 0, False

        def closed(kinds: list[str], found: list[str], first: int) -> pa.RecordBatch:
            n = len(found)
            columns = [pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(np.arange(first, first + n)), pa.array(kinds, pa.string()), pa.array(found, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "nth", "kind", "record"])

        for batch in batches:
            for (file, start, begins), values in _runs(batch):
                if (file, start) != key:
                    if key is not None and held:
                        yield closed(["middle" if tail else "open"], ["\n".join(held)], nth)
                    key, held, state, nth, tail = (file, start), [], begins, 0, begins
                kinds, found = [], []
                for v in values:
                    held.append(v)
                    if '"' in v:
                        state = (inside if state else outside).fullmatch(v) is not None
                    if not state:
                        kinds.append("end" if tail else "whole")
                        found.append("\n".join(held) if len(held) > 1 else v)
                        held, tail = [], False
                if found:
                    yield closed(kinds, found, nth)
                    nth += len(found)
        if key is not None and held:
            yield closed(["middle" if tail else "open"], ["\n".join(held)], nth)

    ensure_checkpoints(spark)
    pieces = placed.mapInArrow(run, "file string, start bigint, nth bigint, kind string, record string").checkpoint()
    crossing = pieces.filter("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("start", "nth")  # at most two rows a range
    numbered = crossing.withColumn("of", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("start", "nth", "record")))
    joined = numbered.groupBy("file", "of").agg(parts.alias("p")).select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["nth"].alias("nth"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    both = pieces.filter("kind = 'whole'").drop("kind").unionByName(joined)
    return both.select("file", "start", "nth", ((F.col("start") == 0) & (F.col("nth") == 0)).alias("first"), "record")


def column_names(header: str, sep: str) -> list[str]:
    """Names of a header line; empty ones are _c and their place, and of names that differ in case only all get theirs."""
    found = next(csv.reader([header.removeprefix("﻿")], delimiter=sep, skipinitialspace=True), [])
    lower = [n.strip().lower() for n in found]
    return [f"_c{k}" if not n.strip() else f"{n.lstrip()}{k}" if lower.count(n.strip().lower()) > 1 else n.lstrip() for k, n in enumerate(found)]


def read_split_csv(spark: SparkSession, path: str, sep: str = ",", row_id: str | None = None) -> DataFrame:
    """All columns as text, by the names in the first file's header line; each file's first line is a header. Where
    that ends with a carriage return, line breaks within quotes lose theirs too.
    With row_id, a column of that name numbers rows in the order of files and of places in them, with gaps: a range's
    first byte and the place within it, as no range has more records than bytes."""
    made = records(spark, path, sep)
    top = made.filter("first").orderBy("file").select("record").first()
    if top is None:
        return spark.createDataFrame([], "_c0 string")
    names = column_names(top["record"].removesuffix("\r"), sep)
    line = F.regexp_replace("record", "\r$", "")
    if top["record"].endswith("\r"):
        line = F.replace(line, F.lit("\r\n"), F.lit("\n"))
    schema = ", ".join(f"`_f{k}` string" for k in range(len(names)))
    options = {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    body = made.filter(~F.col("first"))
    if row_id:
        files = made.select("file").distinct().select(F.col("file").alias("_file"), F.row_number().over(Window.orderBy("file")).alias("_nth"))  # a row a file
        body = body.join(lookup_side(files), F.col("file") == F.col("_file")).withColumn("_place", F.shiftleft((F.col("_nth") - 1).cast("bigint"), 44) + F.col("start") + F.col("nth"))
    body = body.select(line.alias("record"), *["_place"] * bool(row_id)).filter(F.trim("record") != "")
    parsed = body.select(F.from_csv("record", schema, options).alias("r"), *["_place"] * bool(row_id))
    own = [F.col(f"r._f{k}").alias(n) for k, n in enumerate(names)]
    return parsed.select(*own, F.col("_place").alias(row_id)) if row_id else parsed.select(*own)
