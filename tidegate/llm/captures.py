"""Capture histories: locally sorted runs of archive indexes, merged by loser trees into one global order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegate.llm import warc
from tidegate.llm.common import bounded, written

#: Captures that a merge task holds, about: narrow rows of some 200 bytes.
PER_RANGE = 50_000
_MERGED = warc.CAPTURE + ", range_no int, place long, nth long, last boolean"


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one path.

    `runs` are sequences in ascending order; equal entries come from the earlier run first."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's next entry comes before run b's; used-up runs come last."""
        if self.at[a] == len(self.runs[a]):
            return False
        if self.at[b] == len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.losers[node]
            if held < 0:  # while the tree is built, the first to arrive waits
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of every entry in merged order."""
        for _ in range(sum(map(len, self.runs))):
            run = self.losers[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def sorted_runs(archives: DataFrame) -> DataFrame:
    """Index rows of the archives in the table (file, ...): one run an archive, sorted by its reader."""
    target = to_arrow_schema(StructType.fromDDL(warc.CAPTURE))
    files = archives.select("file")
    number = max(files.count(), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["file"].to_pylist():
                rows = sorted(warc.captures(path), key=_order)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return written(bounded(files.repartition(number, "file")).mapInArrow(read, warc.CAPTURE), "runs")


def _order(row: tuple) -> tuple:
    """URL key, time, page (without an id last), run and place in it: no two captures are equal."""
    return row[1], row[2], row[3] is None, row[3] or 0, row[0], row[9]


def merged(runs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """All captures with `range_no` and `place`, whose order is the global one; `nth` counts a URL's captures
    inside the range. Ranges are cut by the whole order, so that a URL of any number of captures is spread."""
    target = to_arrow_schema(StructType.fromDDL(_MERGED))
    width = len(StructType.fromDDL(warc.CAPTURE))
    order = ["url_key", "captured_us", F.col("page_id").asc_nulls_last(), "run", "offset"]
    parts = math.ceil(runs.count() / per_range) or 1
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions("run", *order).withColumn("range_no", F.spark_partition_id())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[tuple]] = []
        number = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            number = columns[width][0] if batch.num_rows else number
            for row in zip(*columns[:width], strict=True):
                if not pieces or pieces[-1][0][0] != row[0]:
                    pieces.append([])
                pieces[-1].append(row)
        tree = LoserTree([[_order(r) for r in piece] for piece in pieces])
        out, nth, before = [], 0, None
        for place, (run, at) in enumerate(tree):
            row = pieces[run][at]
            nth = nth + 1 if row[1] == before else 1
            before = row[1]
            out.append((*row, number, place, nth))
        for start in range(0, len(out), 10_000):
            rows = [(*r, start + i == len(out) - 1) for i, r in enumerate(out[start : start + 10_000])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return written(bounded(dealt).mapInArrow(merge, _MERGED), "merged")


def histories(archives: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The captures of all archives in the global order (range_no, place), with `capture_no`: which capture of
    its URL key a row is. Only the first URL key of a range can go on from earlier ranges: a table with one row
    per range carries its count over. No archives give no rows."""
    rows = merged(sorted_runs(archives), per_range)
    tails = rows.where("last").select("url_key", "range_no", F.col("nth").alias("n"))
    heads = rows.where("place = 0").select("url_key", "range_no", F.lit(0).cast("long").alias("n"))
    # A range whose only key is carried on is head and tail; both are summed before its successor.
    both = tails.unionByName(heads).groupBy("url_key", "range_no").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("url_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_carried", F.sum("n").over(before)).where("_carried > 0").drop("n")
    return (
        rows.join(carried, ["range_no", "url_key"], "left")
        .withColumn("capture_no", F.col("nth") + F.coalesce("_carried", F.lit(0)))
        .drop("_carried", "nth", "last")
    )


def captured(pages: DataFrame, least_bytes: int = 0, records_per_file: int = warc.RECORDS, per_range: int = PER_RANGE) -> DataFrame:
    """Pages (page_id, url, html, captured_us) written as WARC archives and read back as capture histories.

    Null html is an empty payload and a null URL an empty key; pages with equal ids are captures of their own; see
    `warc.deduplicated` for ties. Other columns are not looked at. No pages give no rows."""
    return histories(warc.write_archives(warc.deduplicated(pages, least_bytes), records_per_file), per_range)
