"""Report and bookkeeping queries over the result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import results
from terrane.plans import registry as r
from terrane.plans.base import query, rounded
from terrane.sources import tables
from terrane.sources.tables import table

RUNS, runs = r.RUNS, r.runs


@query(f"WITH {RUNS} SELECT model, round(tau, 6) AS tau, count(*) AS n FROM runs WHERE model IN ('m1', 'm3') AND (abs(tau - 0.02) < 1e-9 OR abs(tau - 0.04) < 1e-9) GROUP BY model, runs.tau")
def selected_runs(spark, d):
    return rounded(results.matching(runs(spark, d), ["m1", "m3"], [0.02, 0.04]).groupBy("model", "tau").agg(F.count("*").alias("n")), "tau")


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 = 3 AND value IS NOT NULL")
def finite_rows(spark, d):
    """Rows whose metric is a finite number; every fourth of NaN, infinity, nothing and its value."""
    v = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).when(F.col("event_id") % 4 == 2, F.lit(None)).otherwise(F.col("value"))
    return table(spark, d, "events").withColumn("v", v).where(results.finite(F.col("v"))).select("event_id", "event_type")


@query(f"WITH {RUNS} SELECT event_id, model || '_' || loss || '_tau0.0' || (1 + event_id % 4) || '_' || pair_set || CASE WHEN event_id % 7 = 0 THEN '_dist_preserve_lam0.' || (1 + event_id % 2) ELSE '' END || '_s' || seed AS run FROM runs")
def run_ids(spark, d):
    t = runs(spark, d)
    return t.select("event_id", results.run_id(*[F.col(c) for c in ("model", "loss", "tau", "pair_set", "aux", "lambda", "seed")]).alias("run"))


@query(f"WITH {RUNS} SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0.0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' WHEN 3 THEN '0.75' ELSE '1.0' END AS tag FROM runs")
def fraction_tags(spark, d):
    return runs(spark, d).select("event_id", results.fraction_tag(F.col("ckpt_frac")).alias("tag"))


@query("WITH c AS (SELECT 'u' || (user_id % 50) AS run, event_id AS frac, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 470 END AS own FROM events), t AS (SELECT 'u' || k AS run, CASE WHEN k % 4 = 0 THEN NULL ELSE 400 + k END AS total FROM range(40) s(k)) SELECT c.run, frac, coalesce(own, total)::BIGINT AS total_steps FROM c LEFT JOIN t ON t.run = c.run")
def step_fallback(spark, d):
    """A checkpoint's total steps: its own, else its run's, else nothing."""
    c = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("run"), F.col("event_id").alias("frac"), F.lit(0).alias("step"), F.when(F.col("event_id") % 3 != 0, 470).alias("total_steps"))
    t = spark.range(40).select(F.concat(F.lit("u"), "id").alias("run"), F.when(F.col("id") % 4 != 0, 400 + F.col("id")).alias("total_steps"))
    return results.steps_of(c, t).select("run", "frac", F.col("total_steps").cast("long").alias("total_steps"))


@query(f"WITH {RUNS} SELECT model, CASE WHEN count(DISTINCT total_steps) = 1 THEN max(total_steps) END AS total_steps FROM runs GROUP BY model")
def agreed_steps(spark, d):
    return runs(spark, d).groupBy("model").agg(results.agreed("total_steps").alias("total_steps"))


@query(f"WITH {RUNS}, w AS (SELECT DISTINCT model, pair_set, tau FROM runs WHERE exp = 'exp4' AND aux = 'dist_preserve') SELECT event_id FROM runs r WHERE loss = 'mnrl' AND coalesce(aux, '') = '' AND EXISTS (SELECT 1 FROM w WHERE w.model = r.model AND w.pair_set = r.pair_set AND abs(w.tau - r.tau) <= 1e-8 + 1e-5 * w.tau)")
def baseline_rows(spark, d):
    t = runs(spark, d)
    return results.baseline_of(t, t.where("exp = 'exp4' and aux = 'dist_preserve'")).select("event_id")


@query(f"""WITH {RUNS}, f AS (SELECT * FROM runs WHERE ckpt_frac = 1), w AS (SELECT DISTINCT model, pair_set, tau FROM f WHERE aux = 'dist_preserve'),
b AS (SELECT * FROM f WHERE aux = 'dist_preserve' UNION ALL SELECT * FROM f r WHERE loss = 'mnrl' AND coalesce(aux, '') = '' AND EXISTS (SELECT 1 FROM w WHERE w.model = r.model AND w.pair_set = r.pair_set AND abs(w.tau - r.tau) <= 1e-8 + 1e-5 * w.tau))
SELECT coalesce(aux, '') AS aux, round(coalesce(lam, 0), 6) AS lam, round(avg(gap), 6) AS gap, round(avg(rho), 6) AS rho, round(avg(router), 6) AS router, count(*) AS n FROM b GROUP BY coalesce(aux, ''), coalesce(lam, 0)""")
def fig_trade_off(spark, d):
    return rounded(results.trade_off(runs(spark, d)).withColumnRenamed("lambda", "lam"), "lam", "gap", "rho", "router")


_KDE = "WITH {runs}, v AS (SELECT model, seed, avg(rho) AS v FROM runs GROUP BY ALL), e AS (SELECT model, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS w FROM v GROUP BY model HAVING max(v) > min(v)), g AS (SELECT model, w, k, lo + k * (hi - lo) / 199 AS x FROM e, range(200) s(k)) SELECT model, round(x, 6) AS x, round(avg(exp(-0.5 * pow((x - v) / w, 2))) / (max(w) * sqrt(2 * pi())), 6) AS y FROM g JOIN v USING (model) GROUP BY model, k, g.x"


@query(_KDE.format(runs=RUNS))
def seed_density(spark, d):
    v = runs(spark, d).groupBy("model", "seed").agg(F.avg("rho").alias("v"))
    return rounded(results.density(v, ["model"]), "x", "y")


@query(f"WITH {RUNS}, e AS (SELECT model, corpus, 'box' || (event_id % 2) AS machine, seed, avg(rho) AS rho FROM runs GROUP BY ALL) SELECT machine, model, corpus, count(*) AS n, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS sd, round(2 * stddev_samp(rho) / sqrt(count(*)), 6) AS bound FROM e GROUP BY machine, model, corpus")
def fig_per_seed(spark, d):
    t = runs(spark, d).withColumn("machine", F.concat(F.lit("box"), F.col("event_id") % 2))
    each = t.groupBy("machine", "model", "corpus", "seed").agg(F.avg("rho").alias("rho"))
    out = results.per_seed_report(each)
    return rounded(out, "mean", "sd", "bound")


@query(f"""WITH {RUNS}, o AS (SELECT corpus, avg(gap) AS gap, avg(rho) AS rho FROM runs GROUP BY corpus), q AS (SELECT corpus, avg(gap) AS gap, avg(rho) AS rho FROM runs WHERE model = 'm0' AND corpus = 'S' GROUP BY corpus),
l AS (SELECT o.corpus, 'gap' AS metric, o.gap AS ours, q.gap AS ref FROM o LEFT JOIN q ON o.corpus = q.corpus UNION ALL SELECT o.corpus, 'rho', o.rho, q.rho FROM o LEFT JOIN q ON o.corpus = q.corpus)
SELECT corpus, metric, coalesce(printf('%.4f', ours), '-') AS ours, coalesce(printf('%.4f', ref), '-') AS ref, coalesce(printf('%.4f', ours - ref), '-') AS delta FROM l""")
def metric_table(spark, d):
    t = runs(spark, d)
    return results.text_table(t, t.where("model = 'm0' and corpus = 'S'").groupBy("corpus").agg(F.avg("gap").alias("gap"), F.avg("rho").alias("rho")), ("gap", "rho"))


@query("SELECT event_id, round(CASE WHEN s < w THEN s / greatest(w, 1) ELSE greatest(0, (t - s) / greatest(t - w, 1)) END, 6) AS share FROM (SELECT event_id, (event_id % 470)::DOUBLE AS s, 468.0::DOUBLE AS t, round_even(46.8, 0)::DOUBLE AS w FROM events)")
def warm_up_shares(spark, d):
    e = table(spark, d, "events")
    return rounded(e.select("event_id", results.warm_up((F.col("event_id") % 470).cast("double"), F.lit(468.0), 0.1).alias("share")), "share")


@query(f"""WITH {RUNS}, g AS (SELECT DISTINCT model, loss, tau, pair_set, aux, CASE WHEN aux = '' THEN 0 ELSE lam END AS lam, seed FROM (SELECT DISTINCT model FROM runs), (SELECT DISTINCT loss FROM runs), (SELECT DISTINCT round(tau, 6) AS tau FROM runs), (SELECT DISTINCT pair_set FROM runs), (SELECT unnest(['', 'dist_preserve']) AS aux), (SELECT DISTINCT round(lam, 6) AS lam FROM runs WHERE lam IS NOT NULL), (SELECT DISTINCT seed FROM runs))
SELECT model, loss, round(tau, 6) AS tau, pair_set, aux, round(lam, 6) AS lam, seed::BIGINT AS seed FROM g""")
def grid_runs(spark, d):
    """The whole grid of what the runs of a table vary; without an auxiliary loss its weights are one run."""
    t = runs(spark, d)
    told = t.agg(*[F.sort_array(F.collect_set(c)).alias(n) for n, c in (("model", "model"), ("loss", "loss"), ("tau", F.round("tau", 6)), ("pair_set", "pair_set"), ("lam", F.round("lambda", 6)), ("seed", "seed"))]).first()  # values that runs vary
    grid = results.expanded(spark, told["model"], told["loss"], told["tau"], told["pair_set"], ["", "dist_preserve"], told["lam"], told["seed"])
    return rounded(grid.withColumnRenamed("lambda", "lam").withColumn("seed", F.col("seed").cast("long")), "tau", "lam")


@query(f"""WITH {RUNS}, g AS (SELECT DISTINCT model, loss, tau, pair_set, aux, CASE WHEN aux = '' THEN 0 ELSE lam END AS lam, seed FROM (SELECT unnest(['m0', 'm1']) AS model), (SELECT unnest(['mnrl', 'triplet']) AS loss), (SELECT unnest([0.01, 0.02]::DOUBLE[]) AS tau), (SELECT unnest(['view']) AS pair_set), (SELECT unnest(['', 'dist_preserve']) AS aux), (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS lam), (SELECT unnest([0, 1]) AS seed)),
k AS (SELECT g.*, f, c FROM g, (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS f), (SELECT unnest(['S', 'M']) AS c))
SELECT model, loss, round(tau, 6) AS tau, pair_set, aux, round(lam, 6) AS lam, seed::BIGINT AS seed, count(*) FILTER (NOT EXISTS (SELECT 1 FROM runs r WHERE r.model = k.model AND r.loss = k.loss AND abs(r.tau - k.tau) < 1e-9 AND r.pair_set = k.pair_set AND coalesce(r.aux, '') = k.aux AND coalesce(r.lam, 0) = k.lam AND r.seed = k.seed AND r.ckpt_frac = k.f AND r.corpus = k.c)) AS todo, count(*) AS total FROM k GROUP BY model, loss, k.tau, pair_set, aux, k.lam, seed""")
def plan_rows(spark, d):
    """How many results each run of a grid still lacks."""
    grid = results.expanded(spark, ["m0", "m1"], ["mnrl", "triplet"], [0.01, 0.02], ["view"], ["", "dist_preserve"], [0.1, 0.2], [0, 1])
    return rounded(results.plan(grid, [0.0, 0.5, 1.0], ["S", "M"], runs(spark, d)).withColumnRenamed("lambda", "lam"), "tau", "lam")


@query("WITH r AS (SELECT 'u' || user_id AS run, CASE WHEN max(event_id) % 3 = 0 THEN 'running' ELSE 'complete' END AS status, count(DISTINCT event_id % 5) FILTER (event_id % 5 IN (0, 1, 2, 3, 4)) AS n FROM events GROUP BY user_id) SELECT run, status = 'complete' AND n = 5 AS complete FROM r")
def completed_runs(spark, d):
    """Runs that say they are complete and have all five checkpoints."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("run"), "event_id", results.fraction_tag((F.col("event_id") % 5) / 4.0).alias("tag"))
    status = e.groupBy("run").agg(F.when(F.max("event_id") % 3 == 0, "running").otherwise("complete").alias("status"))
    return results.complete(status, e, [0.0, 0.25, 0.5, 0.75, 1.0])


@query("SELECT source AS key FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)")
def keys_in_all(spark, d):
    """Sources that every language has."""
    return tables.keys_of_all(table(spark, d, "documents").where("source is not null and lang is not null").select(F.col("lang").alias("corpus"), F.col("source").alias("key")))


@query("SELECT DISTINCT md5(text) AS text FROM (SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE text IS NOT NULL)")
def unique_texts(spark, d):
    """Different texts of three tables."""
    t = [table(spark, d, n).select("text").where("text is not null") for n in ("documents", "benchmark", "conversations")]
    return t[0].union(t[1]).union(t[2]).select(F.md5("text").alias("text")).distinct()


@query("SELECT md5(text) AS text FROM documents WHERE text IS NOT NULL INTERSECT SELECT md5(text) FROM benchmark")
def shared_texts(spark, d):
    """Whole texts that documents share with the benchmark; a guard wants none."""
    return table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("text")).intersect(table(spark, d, "benchmark").select(F.md5("text").alias("text")))


@query("SELECT event_type, min(event_id) AS first_at FROM events GROUP BY event_type")
def first_seen(spark, d):
    """Distinct values with the place where each comes first."""
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_at"))


@query(f"WITH {RUNS} SELECT exp, count(*) FILTER (ckpt_frac = 1) AS trained, count(*) FILTER (ckpt_frac < 1) AS partial, count(DISTINCT model) AS models FROM runs GROUP BY exp")
def run_tallies(spark, d):
    return runs(spark, d).groupBy("exp").agg(F.count_if(F.col("ckpt_frac") == 1).alias("trained"), F.count_if(F.col("ckpt_frac") < 1).alias("partial"), F.countDistinct("model").alias("models"))
