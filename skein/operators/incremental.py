"""Exactly-once processing of what is new or changed since the last successful run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.intervals import add_points, points_in
from skein.session import materialize, scratch
from skein.sources.manifests import ManifestLog


class IncrementalJob:
    """Runs a transformation over the records that were not yet processed. A record is a sequence number and an id.

    State is a table of disjoint intervals of the numbers met so far in ``home`` (a folder all executors share), beside the
    records of the committed runs. A run
      1. reads the intervals of the last commit and, from the source, only numbers beyond the settled ones (pushed down),
      2. subtracts the intervals from the numbers that occur: what lies in the gaps, late commits between processed numbers
         included, is new. Of the rows whose number is covered it takes those whose id no committed record has under
         that number (an exact check). All are written as this run's input, so that a second look at a moving source
         cannot differ from the first,
      3. writes the output and the merged intervals under a fresh name,
      4. commits both by one small manifest file that must not exist yet.
    A run that dies before 4 leaves nothing that anyone reads; the next repeats it. Two runs at once: the second fails to
    commit. ``settle`` takes all numbers up to a mark for processed, as one interval that needs no table and is never
    read again; ``acknowledge`` takes over records that another process has done.

    ``watch``: columns whose new content makes a known record count as changed: it is taken again. Without them, rows of one
    number and id are one record and later copies of it are not taken. Rows without a sequence number are ignored; a null id
    is an id of its own. A source without the column ``id`` names its records by number; a job that began so cannot go on by
    id, nor the other way round.
    """

    def __init__(self, spark: SparkSession, home: str, seq: str = "event_order", id: str = "id", watch: Sequence[str] = ()):
        self.spark, self.home, self.seq, self.id, self.watch = spark, home.rstrip("/"), seq, id, list(watch)
        self.log = ManifestLog(spark, f"{self.home}/commits")

    def processed(self) -> DataFrame:
        """Disjoint intervals (lo, hi), cut at multiples of 65,536, of the numbers beyond the settled ones under which records
        were processed so far."""
        _, last = self.log.last()
        empty = self.spark.createDataFrame([], "lo bigint, hi bigint")
        return self.spark.read.schema(empty.schema).parquet(last["intervals"]) if last and last["intervals"] else empty

    def settled(self) -> int | None:
        """All numbers up to this one are processed."""
        _, last = self.log.last()
        return last and last["settled"]

    def output(self) -> DataFrame | None:
        """Everything committed so far; None before the first output."""
        paths = [c["output"] for c in self.log.all() if c["output"]]
        return self.spark.read.parquet(*paths) if paths else None

    def settle(self, upto: int) -> dict:
        """Commits that all numbers up to ``upto`` are processed; the intervals up to it are dropped from the state."""
        commits = self.log.all()
        mark = max(upto, commits[-1]["settled"]) if commits and commits[-1]["settled"] is not None else upto
        path = None
        if commits and commits[-1]["intervals"]:
            rest = self.processed().where(F.col("hi") > mark).select(F.greatest("lo", F.lit(mark + 1)).alias("lo"), "hi")
            rest.write.parquet(path := f"{self.home}/intervals/{uuid.uuid4().hex}")
        return self._commit(commits, input=None, output=None, intervals=path, settled=mark)

    def acknowledge(self, done: DataFrame) -> dict:
        """Commits the records of ``done`` as processed elsewhere: they give no output here."""
        return self._take(done, None)

    def run(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> dict:
        """One run; the manifest that was committed."""
        return self._take(source, transform)

    def _commit(self, commits: list[dict], **entry) -> dict:
        last = commits[-1] if commits else {"settled": None, "by_id": None}
        manifest = {"n": len(commits), "settled": last["settled"], "by_id": last["by_id"]} | entry
        self.log.append(len(commits), manifest)
        return manifest

    def _open(self, source: DataFrame, settled: int | None) -> DataFrame:
        return source.where(F.col(self.seq).isNotNull() if settled is None else F.col(self.seq) > settled)

    def _new(self, source: DataFrame, keys: list[str], inputs: list[str]) -> DataFrame:
        """The source rows of the records that no commit has. Only numbers, ids and watched columns are compared; whole rows move once."""
        records = source.select(*keys).distinct()
        narrow = set(source.columns) == set(keys)
        if not inputs:
            return records if narrow else source
        records = materialize(records, "records")
        covered = points_in(records, self.seq, self.processed()).withColumn("_met", F.lit(True))
        told = records.join(covered, self.seq, "left")
        new = told.where(F.col("_met").isNull()).select(*keys)
        same = lambda a, b: reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])
        if len(keys) > 1:
            seen = self.spark.read.schema(T.StructType([source.schema[k] for k in keys])).parquet(*inputs)
            again = told.where(F.col("_met")).select(*keys)
            new = new.unionByName(again.join(seen, same(again, seen), "left_anti"))
        return new if narrow else source.join(new, same(source, new), "left_semi")

    def _take(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame] | None) -> dict:
        commits = self.log.all()
        by_id = self.id in source.columns
        if any(c["by_id"] not in (None, by_id) for c in commits):
            raise ValueError(f"the runs before named records by {'number' if by_id else self.id}")
        keys = [self.seq, *([self.id] if by_id else []), *self.watch]
        inputs = [c["input"] for c in commits if c["input"]]
        name = f"{len(commits):012d}-{uuid.uuid4().hex}"
        settled = commits[-1]["settled"] if commits else None
        new = self._new(self._open(source if transform else source.select(*keys), settled), keys, inputs)
        new.write.parquet(taken := f"{self.home}/input/{name}")
        rows = self.spark.read.schema(new.schema).parquet(taken)
        output = None
        if transform:
            transform(rows).write.parquet(output := f"{self.home}/output/{name}")
        add_points(self.processed(), rows, self.seq).write.parquet(intervals := f"{self.home}/intervals/{name}")
        return self._commit(commits, input=taken, output=output, intervals=intervals, by_id=by_id)


def pending_events(events: DataFrame, low_mark: int | None, *, id: str = "id", seq: str = "event_order", done: str = "processed_at", home: str | None = None) -> DataFrame:
    """(event_id, event_order) of every event beyond ``low_mark`` of which no row carries ``done``.

    A run of IncrementalJob (in ``home``, else in a scratch folder): numbers up to the mark are settled, the events that
    are done are acknowledged, so their numbers become intervals, and the run takes what lies in the gaps, and under a
    number that several events share those that are not done. Only numbers beyond the mark are read, by a filter that
    reaches the scan, and only three columns.

    Defined cases: repeated rows of one event count once; an event is done if any of its rows says so; of several events
    that share a number only the open ones come out; an event stands under one number (rows of one id under two numbers
    are two records); events without id or number have no place in the feed and are ignored; low_mark None takes all
    numbers; attempts, failures and locks do not matter; an empty feed gives no rows. In a ``home`` that was used before,
    the events that earlier runs took stay in the result.
    """
    job = IncrementalJob(events.sparkSession, home or scratch(events.sparkSession, "pending"), seq, id)
    if low_mark is not None:
        job.settle(low_mark)
    feed = events.where(F.col(id).isNotNull()).select(F.col(seq).cast("bigint").alias(seq), id, done)
    job.acknowledge(feed.where(F.col(done).isNotNull()))
    job.run(feed.select(seq, id), lambda rows: rows.select(F.col(id).alias("event_id"), F.col(seq).alias("event_order")).distinct())
    return job.output()
