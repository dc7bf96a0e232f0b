"""Multi-line CSV files read by many tasks.

Spark reads lines of a file in byte ranges, one task a range, but a line break inside quotes does not
end a record, and whether a range starts inside quotes depends on all that stands before it. So a
first pass tells for every range how it ends if it starts outside quotes, and how if it starts inside.
These maps have two states, and a range either forgets its start or keeps or turns it over; a running
window over the ranges of a file composes them. A second pass then forms the records of each range,
and the parts of records that cross a border are put together by their order. Records are parsed by
Spark's own CSV parser.

Lines end with LF or CR LF. A quote opens a field only at its start, a doubled quote inside quotes
stands for one, and what follows a closing quote belongs to the field up to the next comma. Empty
lines are no records. The first record of every file is its header.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facets.session import cut, ship_package

_OPTIONS = {"quote": '"', "escape": '"'}
_ROWS = 4096
WHOLE, TAIL, MIDDLE, HEAD = range(4)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside quotes, or outside, ends inside them."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1:at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
        at = line.find(",", at)
        # Outside, the next field that opens with a quote is the next place of interest.
        while at >= 0 and line[at + 1:at + 2] != '"':
            at = line.find(",", at + 1)
        if at < 0:
            return False
        at, inside = at + 2, True


def line_ends_inside(line: str, inside: bool) -> bool:
    """``ends_inside`` for a line from its start: outside quotes its first field may open with one."""
    if not inside and line.startswith('"'):
        return ends_inside(line[1:], True)
    return ends_inside(line, inside)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): lines in order inside each byte range of each file."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _runs(batches):
    """(file, start, lines) for stretches of lines of one range, as they come."""
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(files):
            to = at + 1
            while to < min(len(files), at + _ROWS) and files[to] == files[at] \
                    and starts[to] == starts[at]:
                to += 1
            yield files[at], starts[at], batch.column(2).slice(at, to - at).to_pylist()
            at = to


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each byte range starts inside quotes."""
    def kernel(batches):
        maps: dict[tuple, list[bool]] = {}
        for file, start, part in _runs(batches):
            ends = maps.setdefault((file, start), [False, True])
            for line in part:
                if '"' in line:
                    from_out = line_ends_inside(line, ends[0])
                    ends[1] = from_out if ends[0] == ends[1] else line_ends_inside(line, ends[1])
                    ends[0] = from_out
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in maps], pa.int64()), pa.array([k[1] for k in maps], pa.int64()),
             pa.array([m[0] for m in maps.values()], pa.bool_()),
             pa.array([m[1] for m in maps.values()], pa.bool_())],
            ["file", "start", "from_out", "from_in"])

    maps = lines.mapInArrow(kernel, "file long, start long, from_out boolean, from_in boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    turned = F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)
    settled = F.when(F.col("from_out") == F.col("from_in"),
                     F.struct(F.col("from_out").cast("int").alias("state"),
                              F.col("turns").alias("turns")))
    # A file starts outside quotes; after that the last settled range and the turns since count.
    return (maps.withColumn("turns", F.sum(turned).over(upto))
            .withColumn("_last", F.last(settled, ignorenulls=True).over(before))
            .withColumn("_turns", F.coalesce(F.sum(turned).over(before), F.lit(0)))
            .select("file", "start", (F.pmod(
                F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_turns")
                - F.coalesce(F.col("_last.turns"), F.lit(0)), F.lit(2)) == 1).alias("inside")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header): every record of every file as text, without its line end."""
    ship_package(spark)
    lines = _lines(spark, path)
    # Two numbers for each byte range that starts inside quotes.
    inside = {(r["file"], r["start"]) for r in range_states(lines).where("inside").collect()}
    shared = spark.sparkContext.broadcast(inside)

    def kernel(batches):
        out: list[tuple] = []
        state = None  # range, open text, kind of what is open, inside quotes

        def batch():
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int8(),
                                                          pa.string(), pa.bool_()))],
                ["file", "start", "kind", "record", "header"])

        def close(key, held, headless):
            """The range is over: what is still open goes on in the next one."""
            if held:
                out.append((*key, MIDDLE if headless else TAIL, "\n".join(held), False))

        key, held, headless, quoted, first = None, [], False, False, False
        for file, start, part in _runs(batches):
            if (file, start) != key:
                if key is not None:
                    close(key, held, headless)
                key = file, start
                quoted = headless = key in shared.value
                held, first = [], start == 0
            for line in part:
                quoted = line_ends_inside(line, quoted)
                held.append(line)
                if quoted:
                    continue
                text = "\n".join(held)
                text = text.removesuffix("\r")
                if headless:
                    out.append((*key, HEAD, text, False))
                elif text:
                    out.append((*key, WHOLE, text, first))
                    first = False
                held, headless = [], False
            if len(out) >= _ROWS:
                yield batch()
        if key is not None:
            close(key, held, headless)
        yield batch()

    found = cut(lines.mapInArrow(
        kernel, "file long, start long, kind byte, record string, header boolean"))
    whole = found.where(F.col("kind") == WHOLE).select("record", "header")
    # At most two parts for each byte range.
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    parts = (found.where(F.col("kind") != WHOLE)
             .withColumn("_nr", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order)))
    opens_file = F.min(F.struct("start", F.col("kind"))).alias("_first")
    headers = (found.where(F.col("start") == 0).groupBy("file")
               .agg(F.max("header").alias("_has")))
    joined = (parts.groupBy("file", "_nr").agg(
        opens_file, F.sort_array(F.collect_list(F.struct("start", "record"))).alias("_p"))
        .join(headers, "file", "left")
        .select(F.regexp_replace(F.array_join("_p.record", "\n"), "\r$", "").alias("record"),
                ((F.col("_nr") == 1) & (F.col("_first.start") == 0)
                 & ~F.coalesce("_has", F.lit(False))).alias("header")))
    return whole.union(joined)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all columns as text; large files are read by many tasks."""
    names = spark.read.csv(path, header=True, multiLine=True, **_OPTIONS).columns
    kind = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records(spark, path).where(~F.col("header"))
    return rows.select(F.from_csv("record", kind, _OPTIONS).alias("_r")).select("_r.*")
