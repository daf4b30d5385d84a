"""Experiments that go on where they stopped: a ledger of claims and results, from which what is left is read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.tables import existing

SCHEMA = "session string, run string, fraction double, corpus string, state string, cached boolean, at timestamp"
ROW = ["run", "fraction", "corpus"]


class Ledger:
    """Events of runs and of their (fraction, corpus) rows, appended to a folder; a row's result has a folder of its own.

    States of a run: ``trained``.  States of a row: ``claimed`` before its work, ``written`` after its result is there.  A
    claim without a result counts for nothing, so work that stopped is done again, and its result written over.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.session = spark, path.rstrip("/"), uuid.uuid4().hex

    def events(self) -> DataFrame:
        there = existing(self.spark, [f"{self.path}/events"])
        return self.spark.read.schema(SCHEMA).parquet(there[0]) if there else self.spark.createDataFrame([], SCHEMA)

    def note(self, run: str, state: str, fraction: float | None = None, corpus: str | None = None, cached: bool | None = None) -> None:
        row = self.spark.createDataFrame([(self.session, run, fraction, corpus, state, cached)], ", ".join(SCHEMA.split(", ")[:-1]))
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    def written(self) -> DataFrame:
        return self.events().where("state = 'written'").select(*ROW).distinct()

    def left(self, plan: DataFrame) -> DataFrame:
        """The rows of ``plan`` (run, fraction, corpus) without a result."""
        return plan.select(*ROW).distinct().join(self.written(), ROW, "left_anti")

    def place(self, run: str, fraction: float, corpus: str) -> str:
        return f"{self.path}/results/run={run}/fraction={fraction}/corpus={corpus}"

    def results(self) -> DataFrame | None:
        """All results, with run, fraction and corpus; those that a claim left half-written are not among them."""
        if not existing(self.spark, [f"{self.path}/results"]):
            return None
        every = self.spark.read.parquet(f"{self.path}/results")
        every = every.withColumns({"run": F.col("run").cast("string"), "fraction": F.col("fraction").cast("double"), "corpus": F.col("corpus").cast("string")})
        return every.join(self.written(), ROW, "left_semi")

    def tallies(self, plan: DataFrame) -> DataFrame:
        """One row for this session: runs, trained, runs_skipped, rows_written, rows_cached, rows_skipped."""
        own = self.events().where(F.col("session") == self.session)
        done = own.where("state = 'written'").groupBy("run").agg(F.count("*").alias("written"), F.count_if("cached").alias("cached"))
        trained = own.where("state = 'trained'").select("run", F.lit(1).alias("trained")).distinct()
        each = plan.select(*ROW).distinct().groupBy("run").agg(F.count("*").alias("n")).join(done, "run", "left").join(trained, "run", "left").na.fill(0, ["written", "cached", "trained"])
        sums = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return each.agg(F.count("*").alias("runs"), sums("trained").alias("trained"), F.count_if(F.col("written") == 0).alias("runs_skipped"), sums("written").alias("rows_written"), sums("cached").alias("rows_cached"), sums(F.col("n") - F.col("written")).alias("rows_skipped"))


def execute(ledger: Ledger, plan: DataFrame, train: Callable[[str], None], evaluate: Callable[[str, float, str], tuple[DataFrame, bool]], force: bool = False) -> DataFrame:
    """Do what ``plan`` (run, fraction, corpus) lacks, and return the session's tallies.

    ``train(run)`` is called for a run that has work left and no ``trained`` event; ``evaluate`` gives a row's result and
    whether it came from a cache.  A plan is a grid of runs: its rows, some hundreds, are driven from here, the work in
    them is Spark's.  ``force`` does all of it again.
    """
    todo = plan.select(*ROW).distinct() if force else ledger.left(plan)
    done = set() if force else {r["run"] for r in ledger.events().where("state = 'trained'").select("run").distinct().collect()}
    for r in todo.orderBy(*ROW).collect():
        if r["run"] not in done:
            train(r["run"])
            ledger.note(r["run"], "trained")
            done.add(r["run"])
        ledger.note(r["run"], "claimed", r["fraction"], r["corpus"])
        result, cached = evaluate(r["run"], r["fraction"], r["corpus"])
        result.write.mode("overwrite").parquet(ledger.place(*r))
        ledger.note(r["run"], "written", r["fraction"], r["corpus"], cached)
    return ledger.tallies(plan)


def described(ledger: Ledger, plan: DataFrame) -> DataFrame:
    """(run, n, left, trained): a plan in words that a report can print."""
    left = ledger.left(plan).groupBy("run").agg(F.count("*").alias("left"))
    trained = ledger.events().where("state = 'trained'").select("run", F.lit(True).alias("trained")).distinct()
    each = plan.select(*ROW).distinct().groupBy("run").agg(F.count("*").alias("n"))
    return each.join(left, "run", "left").join(trained, "run", "left").select("run", "n", F.coalesce("left", F.lit(0)).cast("long").alias("left"), F.coalesce("trained", F.lit(False)).alias("trained"))
