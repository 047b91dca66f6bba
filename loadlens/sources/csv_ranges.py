"""CSV with quoted line breaks, read by byte ranges in parallel.

A quoted field may hold line breaks, so a line end is a record's end only if it stands outside quotes, and a task that
starts in the middle of a file cannot tell. Spark's own multi-line reader therefore gives a file to one task. Here:

1. the text reader splits the files as usual; for every range one pass works out in which state the range ends (outside
   or inside a quoted field) for either state in which it may start: one small row per range;
2. a window along each file's ranges composes these functions: every range learns its true starting state;
3. a second pass cuts each range into records at true line ends. What crosses an edge becomes a fragment (two a range at
   most), and the fragments of a record are put together by file and position;
4. the records go through Spark's own CSV parser (``from_csv``).

Nothing is collected; the driver only reads the header's names. What the ranges must know is broadcast: at most one row
of 18 bytes per range of the scan, which the driver plans anyway.

The rules are those of the multi-line reader with quotes doubled inside quotes: a quote opens a field only as its first
character; behind a closing quote everything up to the separator belongs to the field; empty lines are no records; the
first record of every file is its header. Line ends are ``\\n`` or ``\\r\\n``, as the file's first line has it; in a file
of the second kind the breaks inside quotes become ``\\n`` (lone ``\\r`` never ends a line here). An unclosed quote takes
the rest of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

OUTSIDE, INSIDE = 0, 1
#: Pieces of a range: whole records; what ends a record begun before; what begins one that goes on; a range inside one.
RECORD, HEAD, TAIL, MIDDLE = range(4)

_BODY = r'[^"]*+(?:""[^"]*+)*+'


def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    s = re.escape(sep)
    field = rf'(?:"{_BODY}"[^{s}]*+|(?!")[^{s}]*+)'
    opened = rf'(?:{field}{s})*+"{_BODY}'
    return re.compile(opened, re.S), re.compile(rf'{_BODY}(?:"[^{s}]*+{s}{opened})?+', re.S)


class LineStates:
    """The state behind a line by the state before it."""

    def __init__(self, sep: str = ","):
        self.from_outside, self.from_inside = _patterns(sep)

    def after(self, line: str, state: int) -> int:
        pattern = self.from_inside if state else self.from_outside
        return int(pattern.fullmatch(line) is not None)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where a new range begins, with (file, start)."""
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file"), b.column("start")
        fresh = pc.or_(pc.not_equal(file.slice(1), file.slice(0, b.num_rows - 1)),
                       pc.not_equal(start.slice(1), start.slice(0, b.num_rows - 1)))
        cuts = [0, *[i + 1 for i in pc.indices_nonzero(fresh).to_pylist()], b.num_rows]
        for a, z in pairwise(cuts):
            yield (file[a].as_py(), start[a].as_py()), b.slice(a, z - a)


class BatchStates:
    """``LineStates`` for all lines of a batch at once, in patterns without possessive parts.

    A line of records reads in one way only: a field's first character says whether it is quoted, and a body ends at the
    first quote that no other quote follows. So a pattern that says this needs no possessive parts.
    """

    def __init__(self, sep: str = ","):
        s = re.escape(sep)
        body, rest = r'[^"]*(?:""[^"]*)*', rf'(?:[^"{s}][^{s}]*)?'
        opened = rf'(?:(?:"{body}"{rest}|{rest}){s})*"{body}'
        self.from_outside = rf"\A(?:{opened})\z"
        self.from_inside = rf'\A{body}(?:"{rest}{s}{opened})?\z'

    def ends(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per line: whether it ends inside quotes if it starts outside, and if it starts inside."""
        n = len(lines)
        outside, inside = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
        quoted = _mask(pc.match_substring(lines, '"'))  # other lines change no state
        if quoted.any():
            some = lines.filter(pa.array(quoted))
            outside[quoted] = _mask(pc.match_substring_regex(some, self.from_outside))
            inside[quoted] = _mask(pc.match_substring_regex(some, self.from_inside))
        return outside, inside

    @staticmethod
    def along(outside: np.ndarray, inside: np.ndarray, state: int) -> np.ndarray:
        """The state behind each line, from the state before the first: that of the last line that fixes it, turned as
        often as lines since then turn it."""
        n = len(outside)
        turned = np.cumsum(outside & ~inside)
        last = np.maximum.accumulate(np.where(outside == inside, np.arange(n), -1))
        known = last >= 0
        fixed = np.where(known, outside[last], bool(state))
        return fixed ^ ((turned - np.where(known, turned[last], 0)) % 2 == 1)


def _mask(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


_ENDS = "file long, start long, outside int, inside int, crlf boolean"


def _range_ends(sep: str):
    """Per range: the state at its end for either state at its start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, now, ends, crlf = BatchStates(sep), None, [], False
        for key, b in _ranges(batches):
            lines = b.column("value")
            if key != now:
                if now is not None:
                    yield _ends_row(now, ends, crlf)
                now, ends = key, [OUTSIDE, INSIDE]
                crlf = key[1] == 0 and lines[0].as_py().endswith("\r")
            outside, inside = states.ends(lines)
            ends = [int(states.along(outside, inside, s)[-1]) for s in ends]
        if now is not None:
            yield _ends_row(now, ends, crlf)
    return run


def _ends_row(key: tuple, ends: list[int], crlf: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()),
                                       pa.array([ends[0]], pa.int32()), pa.array([ends[1]], pa.int32()), pa.array([crlf])],
                                      ["file", "start", "outside", "inside", "crlf"])


def range_starts(ends: DataFrame) -> DataFrame:
    """(file, start, inside, crlf) of the ranges that start inside quotes, by composing the functions of the ranges
    before, and of those in files with ``\\r\\n`` line ends; all other ranges need no row.

    A range either fixes the state, whatever it was, or keeps it, or turns it. So the state is that of the last range
    that fixes it (outside at the file's start), turned as often as ranges since then turn it.
    """
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when((F.col("outside") == INSIDE) & (F.col("inside") == OUTSIDE), 1).otherwise(0)
    counted = ends.withColumn("turned", F.sum(turns).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("start", F.col("outside").alias("state"), "turned"))
    state = counted.withColumn("last", F.max(fixed).over(before)).withColumn("so_far", F.max("turned").over(before))
    turned = F.coalesce("so_far", F.lit(0)) - F.coalesce("last.turned", F.lit(0))
    inside = (F.coalesce("last.state", F.lit(OUTSIDE)) + turned) % 2 == INSIDE
    return state.select("file", "start", inside.alias("inside"), F.max("crlf").over(Window.partitionBy("file")).alias("crlf")) \
        .where("inside or crlf")


_PIECES = "file long, start long, kind int, first boolean, text string"


def _cut(sep: str):
    """The records and fragments of each range; ``first`` marks a file's first record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = BatchStates(sep)
        now, state, open_, head, fresh, crlf = None, OUTSIDE, [], False, False, False
        for key, b in _ranges(batches):
            if key != now:
                if open_:
                    yield _piece(now, MIDDLE if head else TAIL, fresh, open_)
                now, open_ = key, []
                state = INSIDE if b.column("inside")[0].as_py() else OUTSIDE
                crlf = b.column("crlf")[0].as_py()
                head, fresh = state == INSIDE, key[1] == 0
            lines = b.column("value")
            after = states.along(*states.ends(lines), state)
            if crlf:
                lines = pc.replace_substring_regex(lines, r"\r\z", "")
            stops = np.flatnonzero(~after) + 1  # a record ends behind each of these lines
            begin = 0
            if state == INSIDE:  # what is open takes the lines up to the first end
                begin = int(stops[0]) if len(stops) else len(lines)
                open_ += lines.slice(0, begin).to_pylist()
                if len(stops):
                    yield _piece(now, HEAD if head else RECORD, fresh, open_)
                    open_, head, fresh, stops = [], False, False, stops[1:]
            if len(stops):
                texts = _joined(lines, np.concatenate([[begin], stops]))
                texts = texts.filter(pc.not_equal(texts, ""))  # empty lines are no records
                if len(texts):
                    yield _records(now, fresh, texts)
                    fresh = False
                begin = int(stops[-1])
            open_ += lines.slice(begin).to_pylist()
            state = INSIDE if after[-1] else OUTSIDE
        if open_:
            yield _piece(now, MIDDLE if head else TAIL, fresh, open_)
    return run


def _joined(lines: pa.Array, edges: np.ndarray) -> pa.Array:
    """The lines from each edge up to the next as one text."""
    if edges[-1] - edges[0] == len(edges) - 1:
        return lines.slice(int(edges[0]), len(edges) - 1)  # every record is one line
    groups = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), lines)
    return pc.binary_join(groups, "\n")


def _records(key: tuple, first: bool, texts: pa.Array) -> pa.RecordBatch:
    n = len(texts)
    fresh = np.zeros(n, dtype=bool)
    fresh[0] = first
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0], np.int64)), pa.array(np.full(n, key[1], np.int64)),
                                       pa.array(np.full(n, RECORD, np.int32)), pa.array(fresh), texts],
                                      ["file", "start", "kind", "first", "text"])


def _piece(key: tuple, kind: int, first: bool, lines: list[str]) -> pa.RecordBatch:
    """A record, or a part of one, from its lines."""
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()),
                                       pa.array([kind], pa.int32()), pa.array([first]),
                                       pa.array(["\n".join(lines)], pa.string())],
                                      ["file", "start", "kind", "first", "text"])


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The records of CSV files as texts (column ``text``), without each file's header record."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    known = range_starts(lines.mapInArrow(_range_ends(sep), _ENDS))
    # bounded: a row per range of the scan at most
    marked = lines.join(F.broadcast(known), ["file", "start"], "left").select(
        "value", "file", "start", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("inside", "crlf")])
    pieces = marked.mapInArrow(_cut(sep), _PIECES)
    whole = pieces.where((F.col("kind") == RECORD) & ~F.col("first")).select("text")
    parts = pieces.where(F.col("kind") != RECORD)
    # a record begins with a tail; the head that ends the record before comes first in its range
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = parts.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = numbered.groupBy("file", "chain").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts")) \
        .where(~F.col("first")).select(F.concat_ws("\n", "parts.text").alias("text"))
    return whole.unionByName(joined)


def fits_one_range(spark: SparkSession, path: str) -> bool:
    """Whether all files together are no larger than one range of a scan (from the file listing; no job)."""
    size = spark.read.text(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return int(str(size)) <= most


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, as ``spark.read.csv(header=True, multiLine=True, quote='"', escape='"')`` gives them."""
    options = {"quote": '"', "escape": '"', "sep": sep, "multiLine": "true"}
    names = spark.read.options(header=True, inferSchema=False, **options).csv(path).columns  # reads the header alone
    options["lineSep"] = "\n"
    if not names:
        return spark.createDataFrame([], StructType([]))
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    cells = records(spark, path, sep).select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options)
                                             .alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])
