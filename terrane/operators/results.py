"""The keyed result table: grids, what is left to do, upserts, typing, and the report queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.vectors import near

#: What identifies a result row, and the parts of it that name a run in a small grid.
IDENTITY = ("exp", "model", "loss", "tau", "pair_set", "aux", "lambda", "ckpt_frac", "seed", "corpus")
KEY = ("model", "pair_set", "tau", "seed")


def runs(events: DataFrame) -> DataFrame:
    """Result rows from the event log: the user is the model, the type the pair set, the id gives temperature, seed and
    fraction, the value the metrics."""
    e = F.col("event_id")
    frac = (e % 5) / 4.0
    more = (
        F.concat(F.lit("exp"), 1 + e % 4).alias("exp"), F.when(e % 3 == 0, "triplet").otherwise("mnrl").alias("loss"), F.when(e % 7 == 0, "dist_preserve").when(e % 7 == 1, F.lit(None)).otherwise("").alias("aux"),
        F.when(e % 7 == 0, 0.1 * (1 + e % 2)).alias("lambda"), F.when(e % 7 < 4, "S").otherwise("M").alias("corpus"), F.concat(F.lit("0.0"), 1 + e % 4, F.when(e % 3 == 0, "0").otherwise("")).alias("tau_text"),
        (468 + F.when(F.col("user_id") % 7 == 3, e % 2).otherwise(0)).cast("double").alias("total_steps"), (F.col("value") / 3).alias("router"),
    )
    return events.select(
        *more,
        F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"), F.col("event_type").alias("pair_set"), (F.lit(0.01) * (1 + F.col("event_id") % 4)).alias("tau"), (F.col("event_id") % 3).cast("int").alias("seed"),
        frac.alias("ckpt_frac"), "event_id", F.col("value").alias("gap"), (F.col("value") / 2 - F.col("event_id") % 11).alias("rho"), ((F.col("event_id") % 100) / 100.0).alias("coverage"), (F.col("event_id") % 40).cast("double").alias("nodes"),
    )


def disintegrated(coverage: Column, nodes: Column, least_coverage: float = 0.05, least_nodes: float = 5) -> Column:
    """Missing or NaN values, or too little coverage, or too few nodes."""
    missing = coverage.isNull() | F.isnan(coverage) | nodes.isNull() | F.isnan(nodes)
    return missing | (coverage < least_coverage) | (nodes < least_nodes)


def canonical(c: Column) -> Column:
    """A key's text: numbers by ten significant digits, blanks and names of nothing as an empty text.

    Only texts that begin as numbers do are tried as such: a failed attempt is dear.
    """
    t = F.trim(c.cast("string"))
    number = F.when(t.rlike(r"^[+-]?\.?[0-9]"), t.try_cast("double"))
    rounded = F.format_string("%.9e", number).cast("double").cast("string")
    return F.when(t.isNull() | F.lower(t).isin("", "nan", "none", "null"), "").otherwise(F.when(number.isNotNull() & (F.abs(number) < float("inf")), rounded).otherwise(t))


def upsert(table: DataFrame, key: tuple[str, ...] = IDENTITY, order: str = "event_id") -> DataFrame:
    """The last row of every key in canonical form, with the place of the key's first row as ``pos``."""
    names = [c for c in table.columns if c != "pos"]
    first_at = F.least("pos", order) if "pos" in table.columns else F.col(order)
    same = [canonical(F.col(k)).alias(f"key{i}_") for i, k in enumerate(key)]
    best = table.groupBy(*same).agg(F.min(first_at).alias("pos"), F.max_by(F.struct(*names), order).alias("last"))
    return best.select(*[F.col(f"last.`{c}`").alias(c) for c in names], "pos")


def matching(table: DataFrame, models: list[str] | None = None, taus: list[float] | None = None) -> DataFrame:
    """Rows that meet every filter; an empty filter keeps all.  Temperatures compare within a relative 1e-9."""
    if models:
        table = table.where(F.col("model").isin(*models))
    if taus:
        table = table.where(F.exists(F.array(*[F.lit(float(t)) for t in taus]), lambda t: near(F.col("tau"), t)))
    return table


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def plain(v: Column) -> Column:
    """A number's shortest text of up to six significant digits, without trailing zeros; as %g for 1e-4 to 1e5."""
    six = F.format_string("%.5e", v).cast("double")
    return F.regexp_replace(F.regexp_replace(F.call_function("format_number", six, F.lit("0.##########")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def run_id(model: Column, loss: Column, tau: Column, pair_set: Column, aux: Column, lam: Column, seed: Column) -> Column:
    """<model>_<loss>_tau<tau>_<pair set>[_<aux>_lam<lambda>]_s<seed>."""
    extra = F.when(F.coalesce(aux, F.lit("")) != "", F.concat(F.lit("_"), aux, F.lit("_lam"), plain(lam))).otherwise("")
    return F.concat(model, F.lit("_"), loss, F.lit("_tau"), plain(tau), F.lit("_"), pair_set, extra, F.lit("_s"), seed.cast("string"))


def fraction_tag(frac: Column) -> Column:
    """0.0, 0.1, 0.25, 1.0: two decimals at most, one at least."""
    return F.regexp_replace(F.format_string("%.2f", frac.cast("double")), "(?<=[0-9])0$", "")


def steps_of(checkpoints: DataFrame, run_totals: DataFrame) -> DataFrame:
    """(run, frac, step, total_steps): a checkpoint's own total, else its run's, else NULL."""
    totals = run_totals.select("run", F.col("total_steps").alias("run_total_"))
    return checkpoints.join(totals, "run", "left").select("run", "frac", "step", F.coalesce("total_steps", "run_total_").alias("total_steps"))


def agreed(c: str) -> Column:
    """The one distinct finite value of a group, else NULL."""
    v = F.when(finite(F.col(c)), F.col(c))
    return F.when(F.countDistinct(v) == 1, F.max(v))


def baseline_of(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with plain contrastive loss of the same model, pair set and (nearly) temperature as ``rows``."""
    want = rows.select(F.col("model").alias("m_"), F.col("pair_set").alias("p_"), F.col("tau").alias("t_")).distinct()
    plain_ = table.where((F.col("loss") == "mnrl") & (F.coalesce("aux", F.lit("")) == ""))
    return plain_.join(want, (F.col("model") == F.col("m_")) & (F.col("pair_set") == F.col("p_")) & (F.abs(F.col("tau") - F.col("t_")) <= 1e-8 + 1e-5 * F.abs("t_")), "left_semi")


def density(values: DataFrame, group: list[str], points: int = 200) -> DataFrame:
    """(group, x, y): a Gaussian kernel density of ``v`` on a grid between its ends, with Scott's width.

    Groups without two different values have none.  Equal values are one with a weight; rows grow with the different
    values times the points.
    """
    values = values.groupBy(*group, "v").agg(F.count("*").alias("times_"))
    ends = values.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("times_").alias("n_"), (F.sum(F.col("v") * F.col("times_")) / F.sum("times_")).alias("mean_")).where("hi > lo")
    spread = values.join(ends.select(*group, "n_", "mean_"), group).groupBy(*group).agg((F.sqrt(F.sum(F.col("times_") * F.pow(F.col("v") - F.col("mean_"), 2)) / (F.max("n_") - 1)) * F.pow(F.max("n_"), -0.2)).alias("w"))
    ends = ends.join(spread, group)
    grid = ends.select(*group, "w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1))).alias("x"))
    return grid.join(values, group).groupBy(*group, "x").agg((F.sum(F.col("times_") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("w"), 2))) / F.sum("times_") / (F.max("w") * math.sqrt(2 * math.pi))).alias("y"))


def warm_up(step: Column, total: Column, ratio: float) -> Column:
    """The share of the learning rate at a step: up to 1 over round(ratio total) steps, then down to 0."""
    warm = F.bround(total * ratio)
    return F.when(step < warm, step / F.greatest(warm, F.lit(1))).otherwise(F.greatest(F.lit(0.0), (total - step) / F.greatest(total - warm, F.lit(1))))


def text_table(table: DataFrame, reference: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(corpus, metric, ours, ref, delta): means of ``table`` next to ``reference`` (corpus, <metrics>); "-" where one is missing."""
    long = lambda df, out: df.select("corpus", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("corpus", "x.metric", F.col("x.v").alias(out))
    ours = long(table.groupBy("corpus").agg(*[F.avg(m).alias(m) for m in metrics]), "ours")
    shown = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("-"))
    text = lambda c: F.when(c.isNull(), "-").otherwise(shown(c))
    both = ours.join(long(reference, "ref"), ["corpus", "metric"], "left")
    return both.select("corpus", "metric", text(F.col("ours")).alias("ours"), text(F.col("ref")).alias("ref"), text(F.col("ours") - F.col("ref")).alias("delta"))


def expanded(spark, models, losses, taus, pair_sets, auxes, lambdas, seeds) -> DataFrame:
    """Every run of a grid, once; without an auxiliary loss its weight is 0."""
    if not all((models, losses, taus, pair_sets, seeds)):
        raise ValueError("a grid needs models, losses, temperatures, pair sets and seeds")
    out = None
    for name, values in (("model", models), ("loss", losses), ("tau", taus), ("pair_set", pair_sets), ("aux", auxes or [""]), ("lambda", lambdas or [0.0]), ("seed", seeds)):
        one = spark.createDataFrame([(v,) for v in values], [name]).coalesce(1)
        out = one if out is None else out.crossJoin(one)
    aux = F.when(F.coalesce("aux", F.lit("")).isin("", "none"), "").otherwise(F.col("aux"))
    return out.withColumn("aux", aux).withColumn("lambda", F.when(F.col("aux") == "", 0.0).otherwise(F.col("lambda"))).dropDuplicates()


def plan(grid_rows: DataFrame, fracs: list[float], corpora: list[str], done: DataFrame) -> DataFrame:
    """(model, loss, tau, pair_set, aux, lambda, seed, todo, total): how many (fraction, corpus) results a run still lacks."""
    at = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("ckpt_frac"), F.lit(c).alias("corpus")) for f in fracs for c in corpora])).alias("x")
    key = [c for c in IDENTITY if c != "exp"]
    rows = grid_rows.select("*", at).select(*grid_rows.columns, "x.*")
    rows = rows.withColumn("lambda_", F.when(F.col("aux") == "", F.lit(None)).otherwise(F.col("lambda")))
    canon = lambda df, lam: [canonical(F.col(lam if k == "lambda" else k)).alias(f"k{i}_") for i, k in enumerate(key)]
    have = done.select(*canon(done, "lambda")).distinct().withColumn("done_", F.lit(True))
    left = rows.select("*", *canon(rows, "lambda_")).join(have, [f"k{i}_" for i in range(len(key))], "left")
    return left.groupBy(*grid_rows.columns).agg(F.count_if(F.col("done_").isNull()).alias("todo"), F.count("*").alias("total"))


def complete(runs_: DataFrame, checkpoints: DataFrame, fracs: list[float]) -> DataFrame:
    """(run, complete): whether a run says so and has a checkpoint for every fraction."""
    tags = checkpoints.where(F.col("tag").isin(*[f"{float(f):.2f}".rstrip("0") + ("0" if f"{float(f):.2f}".rstrip("0").endswith(".") else "") for f in fracs]))
    have = tags.groupBy("run").agg(F.countDistinct("tag").alias("n"))
    return runs_.join(have, "run", "left").select("run", ((F.col("status") == "complete") & (F.coalesce("n", F.lit(0)) == len(set(fracs)))).alias("complete"))


def todo(grid: DataFrame, done: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of the grid whose key has no result; keys compare in canonical form, missing ones equal missing ones."""
    right = done.select(*[canonical(F.col(k)).alias(f"k_{k}") for k in key]).distinct()
    match = None
    for k in key:
        one = canonical(F.col(k)) == F.col(f"k_{k}")
        match = one if match is None else match & one
    return grid.join(right, match, "left_anti")


def grid(spark, models: list[str], pair_sets: list[str], taus: list[float], seeds: list[int]) -> DataFrame:
    """Every combination, once."""
    frames = [spark.createDataFrame([(v,) for v in dict.fromkeys(values)], [name]).coalesce(1) for name, values in zip(KEY, (models, pair_sets, taus, seeds), strict=True)]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def typed(raw: DataFrame, numbers: tuple[str, ...], flags: tuple[str, ...] = (), seed: str | None = None) -> DataFrame:
    """Texts as numbers (NULL where they are none), as flags (true, 1, yes), and the seed as an integer (-1)."""
    out = raw
    for c in numbers:
        out = out.withColumn(c, F.col(c).try_cast("double"))
    for c in flags:
        out = out.withColumn(c, F.coalesce(F.lower(F.trim(F.col(c))).isin("true", "1", "yes"), F.lit(False)))
    return out.withColumn(seed, F.coalesce(F.col(seed).try_cast("double").cast("int"), F.lit(-1))) if seed else out


def checkpoint_steps(rows: DataFrame, frac: str, total: str) -> DataFrame:
    """The step of a fraction of all steps, halves to even."""
    return rows.withColumn("step", F.bround(F.col(frac) * F.col(total)).cast("long"))


def rho_by_step(table: DataFrame) -> DataFrame:
    return table.groupBy("model", "tau", "ckpt_frac").agg(F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), F.bool_or(disintegrated(F.col("coverage"), F.col("nodes"))).alias("any_disintegrated"))


def gap_against_rho(table: DataFrame, reference: DataFrame) -> DataFrame:
    """(model, final, gap, rho, ref_gap): means of final and other rows, with the reference's where it is in one piece."""
    rows = table.groupBy("model", (F.abs(F.col("ckpt_frac") - 1) <= 1e-8 + 1e-5).alias("final")).agg(F.avg("gap").alias("gap"), F.avg("rho").alias("rho"))
    return rows.join(reference, "model", "left")


def pair_set_bars(table: DataFrame) -> DataFrame:
    """Final rows by pair set: mean and deviation, and the mean of the untrained ones."""
    last, first = table.where("ckpt_frac = 1"), table.where("ckpt_frac = 0")
    base = first.groupBy("pair_set").agg(F.avg("rho").alias("untrained"))
    return last.groupBy("pair_set").agg(F.avg("rho").alias("mean_rho"), F.stddev_samp("rho").alias("sd_rho"), F.count("*").alias("n")).join(base, "pair_set", "left")


def roster(table: DataFrame, least_seeds: int = 2) -> DataFrame:
    """Models by mean rho of scorable rows; models with too few come last.  One row per model is ordered."""
    ok = ~disintegrated(F.col("coverage"), F.col("nodes"))
    rows = table.groupBy("model").agg(F.avg(F.when(ok, F.col("rho"))).alias("mean_rho"), F.countDistinct(F.when(ok, F.col("seed"))).alias("n_seeds"))
    rows = rows.withColumn("scorable", F.col("n_seeds") >= least_seeds)
    place = F.row_number().over(W.orderBy(F.desc("scorable"), F.desc("mean_rho"), "model"))
    return rows.withColumn("place", place.cast("long"))


def per_seed(table: DataFrame) -> DataFrame:
    """(model, n, mean, sd, bound): over seeds, with twice the standard error."""
    each = table.groupBy("model", "seed").agg(F.avg("rho").alias("rho"))
    return each.groupBy("model").agg(F.count("*").alias("n"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), (2 * F.stddev_samp("rho") / F.sqrt(F.count("*"))).alias("bound"))


def pareto(table: DataFrame) -> DataFrame:
    return table.where("ckpt_frac = 1").groupBy("tau", "pair_set").agg(F.avg("gap").alias("gap"), F.avg("rho").alias("rho"), F.count("*").alias("n"))


def trade_off(table: DataFrame) -> DataFrame:
    """(aux, lambda, gap, rho, router, n) of final rows with an auxiliary loss, and of their baseline with none."""
    last = table.where("ckpt_frac = 1")
    with_aux = last.where(F.coalesce("aux", F.lit("")) != "")
    rows = with_aux.unionByName(baseline_of(last, with_aux))
    return rows.groupBy(F.coalesce("aux", F.lit("")).alias("aux"), F.coalesce("lambda", F.lit(0.0)).alias("lambda")).agg(F.avg("gap").alias("gap"), F.avg("rho").alias("rho"), F.avg("router").alias("router"), F.count("*").alias("n"))


def per_seed_report(rows: DataFrame, most: int = 2) -> DataFrame:
    """(machine, model, corpus, n, mean, sd, bound) of (machine, model, corpus, seed, rho), bound being two errors of the mean.

    More machines than ``most``, and a model and corpus without any seed's value on a machine, are errors: a report
    would show halves that can't be compared.
    """
    machines = [r["machine"] for r in rows.select("machine").distinct().orderBy("machine").limit(most + 1).collect()]
    if len(machines) > most:
        raise ValueError(f"a report compares {most} machines at most")
    out = rows.groupBy("machine", "model", "corpus").agg(F.count("rho").alias("n"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), (2 * F.stddev_samp("rho") / F.sqrt(F.count("rho"))).alias("bound"))
    name = F.concat_ws("/", "machine", "model", "corpus")
    return out.where(F.when(F.col("n") > 0, True).otherwise(F.raise_error(F.concat(F.lit("no seed has a value: "), name)).cast("boolean")))


def figures_of(table: DataFrame) -> dict[str, list[str]]:
    """The figures that a table's experiments allow, in order, and ``missing``: those whose rows it lacks, to be warned of."""
    wanted = {"exp1": ["rho_vs_step", "gap_vs_step"], "exp2": ["pair_sets"], "exp3": ["losses"], "exp4": ["trade_off"]}
    there = {r["exp"] for r in table.select("exp").distinct().collect()}  # experiments
    made = [f for e, names in wanted.items() if e in there for f in names]
    return {"made": made, "missing": [f for e, names in wanted.items() if e not in there for f in names]}
