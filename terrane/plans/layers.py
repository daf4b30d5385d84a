"""Queries that compose operators: anchors over hops, losses of pair batches, classifiers, and whole evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import losses
from terrane.functions.vectors import as_doubles, hash_rank, unit
from terrane.operators import agreement, align, anchor, classify, cover, encoders, geometry, graph
from terrane.operators.ranks import placed
from terrane.plans import registry as r
from terrane.plans.base import query, rounded
from terrane.sources.tables import stored, table

NAMES, N = r.NAMES, anchor.MOST_PAIRS
#: Features of the documents that have a vector, standardized over themselves.
HAVE = f"{r.FEATS}, own AS (SELECT feats.* FROM feats WHERE id IN (SELECT vec_id FROM embeddings)), fit AS (SELECT {r._FIT} FROM own), zf AS MATERIALIZED (SELECT id AS vec_id, {', '.join(f'({c} - mu_{c}) / sd_{c} AS {c}' for c in NAMES)} FROM own, fit)"
HOPS = f"""{r.EDGES}, parts AS MATERIALIZED (SELECT seed, vec_id, min(node) AS node FROM nodes GROUP BY ALL), both_ways AS (SELECT seed, src, dst FROM edges UNION SELECT seed, dst, src FROM edges),
walk AS (SELECT DISTINCT seed, node AS src, node AS dst, 0 AS h FROM nodes UNION SELECT w.seed, w.src, e.dst, w.h + 1 FROM walk w JOIN both_ways e ON e.seed = w.seed AND e.src = w.dst WHERE w.h < 24), hop AS MATERIALIZED (SELECT seed, src, dst, min(h) AS hops FROM walk GROUP BY ALL)"""
PAIRED = f"""{HOPS}, {HAVE}, known AS MATERIALIZED (SELECT p.* FROM parts p WHERE vec_id IN (SELECT vec_id FROM zf)), docs AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5('11:' || seed || ':' || vec_id), vec_id) AS ord FROM known QUALIFY ord <= {anchor.MOST_DOCS}),
dp AS MATERIALIZED (SELECT a.seed, a.vec_id AS i, b.vec_id AS j, a.ord AS a, b.ord AS b, hops FROM docs a JOIN docs b ON a.seed = b.seed AND a.ord < b.ord JOIN hop ON hop.seed = a.seed AND hop.src = a.node AND hop.dst = b.node)"""


def _rho_sql(order, few):
    far = "sqrt(" + " + ".join(f"pow(x.{c} - y.{c}, 2)" for c in NAMES) + ")"
    return f"""{PAIRED}, taken AS (SELECT seed, hops, round({far}, 9) AS far FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {order}) AS nth FROM dp QUALIFY nth <= {N}) t JOIN zf x ON x.vec_id = i JOIN zf y ON y.vec_id = j),
ranked AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY hops) + (count(*) OVER (PARTITION BY seed, hops) - 1) / 2 AS rh, rank() OVER (PARTITION BY seed ORDER BY far) + (count(*) OVER (PARTITION BY seed, far) - 1) / 2 AS rf FROM taken),
c AS (SELECT seed, CASE WHEN stddev_pop(rh) * stddev_pop(rf) > 0 THEN covar_pop(rh, rf) / (stddev_pop(rh) * stddev_pop(rf)) END AS rho FROM ranked GROUP BY seed), k AS (SELECT seed, count(*) AS covered FROM known GROUP BY seed), m AS (SELECT seed, count(*) AS connected FROM dp GROUP BY seed),
rhos AS (SELECT k.seed, CASE WHEN covered < {anchor.LEAST_DOCS} OR coalesce(connected, 0) < {anchor.LEAST_PAIRS} THEN {few} ELSE rho END AS rho, CASE WHEN covered < {anchor.LEAST_DOCS} THEN 0 ELSE least(coalesce(connected, 0), {N}) END AS n_pairs_used FROM k LEFT JOIN m USING (seed) LEFT JOIN c USING (seed))"""


UNIFORM = _rho_sql("md5('13:' || seed || ':' || i || ':' || j), i, j", "NULL")
LEGACY = _rho_sql("a, b", "0.0")


def doc_features(spark, d):
    """(vec_id, <features>, z): features of documents with a vector, standardized over them."""
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    f = stored(r.features(spark, d).select("id", *NAMES).join(ids, "id", "left_semi"))
    z = r.text.z_scores(f, f)
    return z.select(F.col("id").alias("vec_id"), *[F.col(f"z_{c}").alias(c) for c in NAMES], F.array(*[F.col(f"z_{c}") for c in NAMES]).alias("z"))


def _graph(spark, d):
    n = stored(r.nodes(spark, d))
    return n, stored(cover.nerve(n))


@query(f"WITH RECURSIVE {HOPS} SELECT seed::INTEGER AS seed, src, dst, hops FROM hop")
def hop_distances(spark, d):
    n, e = _graph(spark, d)
    return graph.hops(n.select("seed", "node").distinct(), e)


def _rhos(spark, d, legacy):
    n, e = _graph(spark, d)
    return anchor.rho(cover.partition(n), e, stored(doc_features(spark, d)), legacy)


@query(f"WITH RECURSIVE {UNIFORM} SELECT seed::INTEGER AS seed, round(rho, 6) AS rho, n_pairs_used FROM rhos")
def anchor_rho_uniform(spark, d):
    return rounded(_rhos(spark, d, False), "rho")


@query(f"WITH RECURSIVE {LEGACY} SELECT seed::INTEGER AS seed, round(rho, 6) AS rho, n_pairs_used FROM rhos")
def anchor_rho_legacy(spark, d):
    return rounded(_rhos(spark, d, True), "rho")


@query(f"WITH RECURSIVE {UNIFORM} SELECT round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS sd, count(rho) AS n FROM rhos")
def anchor_summary(spark, d):
    return rounded(anchor.summary(_rhos(spark, d, False)), "mean", "sd")


_ALIGN = " UNION ALL ".join(f"SELECT '{c}' AS feature, '{a}' AS axis, round({c}, 9) AS x, round({e}, 9) AS y FROM lens JOIN zf USING (vec_id) WHERE seed = 42" for c in NAMES for a, e in (("u", "u"), ("v", "v"), ("radial", "sqrt(u * u + v * v)")))


@query(f"WITH {r.LENS}, {HAVE}, both_ AS ({_ALIGN}), k AS (SELECT feature, axis, rank() OVER (PARTITION BY feature, axis ORDER BY x) + (count(*) OVER (PARTITION BY feature, axis, x) - 1) / 2 AS a, rank() OVER (PARTITION BY feature, axis ORDER BY y) + (count(*) OVER (PARTITION BY feature, axis, y) - 1) / 2 AS b FROM both_) SELECT feature, axis, round(coalesce(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 0), 6) AS rho FROM k GROUP BY ALL")
def feature_alignment(spark, d):
    lens = cover.lens(table(spark, d, "embeddings"), cover.seeds(spark, 42, 1))
    return rounded(anchor.alignment(lens, doc_features(spark, d), NAMES), "rho")


STATS = ["n_nodes", "n_edges", "n_components", "coverage", "mean_size", "median_size", "largest_share", "b1", "avg_degree", "density"]


def seed_stats(spark, d):
    n, e = _graph(spark, d)
    return stored(graph.statistics(n, e, table(spark, d, "embeddings").count()))


@query(f"WITH RECURSIVE {r.STATISTICS} SELECT count(*) AS n_successful_seeds, {', '.join(f'round(avg({c}), 6) AS mean_{c}, round(CASE WHEN avg({c}) = 0 THEN 0 ELSE coalesce(stddev_samp({c}), 0) / avg({c}) END, 6) AS cv_{c}' for c in STATS)} FROM statistics")
def bootstrap_statistics(spark, d):
    """Mean and relative deviation over the seeds of every statistic of the graph."""
    out = agreement.bootstrap(seed_stats(spark, d), STATS)
    return rounded(out, *[c for c in out.columns if c != "n_successful_seeds"])


@query(f"WITH RECURSIVE {r.STATISTICS} SELECT list(seed ORDER BY seed) AS seed, {', '.join(f'list(round({c}::DOUBLE, 6) ORDER BY seed) AS {c}' for c in STATS)} FROM statistics")
def per_seed_lists(spark, d):
    """Every statistic as a list in the order of the seeds (25 of them)."""
    rows = seed_stats(spark, d)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seed", F.col(c).cast("double").alias("v")))), lambda x: F.round(x.v, 6))
    return rows.agg(F.sort_array(F.collect_list("seed")).alias("seed"), *[listed(c).alias(c) for c in STATS])


# Losses over batches of pairs of one class: a vector and the next one of its class by hash, 32 to a batch.
PB = """pb AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id) - 1) // 32 AS batch, (row_number() OVER (ORDER BY h, vec_id) - 1) % 32 AS i, vec_id AS anchor_id, nxt AS positive_id, neg AS negative_id FROM (SELECT vec_id, md5('5:' || vec_id) AS h, lead(vec_id) OVER (PARTITION BY label ORDER BY md5('5:' || vec_id), vec_id) AS nxt, lead(vec_id) OVER (ORDER BY md5('6:' || vec_id), vec_id) AS neg FROM embeddings) WHERE nxt IS NOT NULL AND neg IS NOT NULL),
n AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings), t AS MATERIALIZED (SELECT batch, i, a.e AS ea, p.e AS ep, q.e AS en FROM pb JOIN n a ON a.vec_id = anchor_id JOIN n p ON p.vec_id = positive_id JOIN n q ON q.vec_id = negative_id),
c AS MATERIALIZED (SELECT x.batch, x.i AS a, y.i AS p, list_dot_product(x.ea, y.ep) AS c FROM t x JOIN t y USING (batch))"""


def class_pairs(spark, d):
    """(batch, i, anchor_id, positive_id, negative_id): places by hash instead of windows over all rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", hash_rank(5, F.col("vec_id")).alias("h"), hash_rank(6, F.col("vec_id")).alias("g"))
    own = stored(placed(rows, ["label"], ["h", "vec_id"], "k"))
    free = stored(placed(rows, [], ["g", "vec_id"], "k"))
    follower = lambda df, keys, out: df.select(*keys, F.col("vec_id").alias(out), (F.col("k") - 1).alias("k"))
    pairs = own.join(follower(own, ["label"], "positive_id"), ["label", "k"]).select("vec_id", "h", "positive_id")
    negs = free.join(follower(free, [], "negative_id"), "k").select("vec_id", "negative_id")
    at = placed(pairs.join(negs, "vec_id"), [], ["h", "vec_id"], "k")
    return at.select(F.floor(F.col("k") / 32).alias("batch"), (F.col("k") % 32).alias("i"), F.col("vec_id").alias("anchor_id"), "positive_id", "negative_id")


def _batches(spark, d):
    return losses.batched(class_pairs(spark, d), table(spark, d, "embeddings"))


def _triples(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", unit(as_doubles(F.col("embedding"))).alias("e"))
    out = class_pairs(spark, d)
    for key, name in (("anchor_id", "ea"), ("positive_id", "ep"), ("negative_id", "en")):
        out = out.join(v.toDF(key, name), key)
    return out


@query(f"WITH {PB} SELECT batch, round(avg(c) FILTER (a = p), 6) AS pos_cos, round(avg(c) FILTER (a <> p), 6) AS neg_cos FROM c GROUP BY batch")
def batch_cosine_stats(spark, d):
    return rounded(losses.cosine_stats(losses.in_batch(_batches(spark, d))), "pos_cos", "neg_cos")


@query(f"WITH {PB}, z AS (SELECT batch, a, ln(sum(exp(c / 0.05 - 20))) AS z, max(c / 0.05 - 20) FILTER (a = p) AS own FROM c GROUP BY ALL) SELECT batch, round(avg(z - own), 6) AS loss FROM z GROUP BY batch")
def contrastive_loss(spark, d):
    return rounded(losses.contrastive(losses.in_batch(_batches(spark, d))), "loss")


@query(f"WITH {PB} SELECT batch, round(avg(greatest(list_distance(ea, ep) - list_distance(ea, en) + 5, 0)), 6) AS loss FROM t GROUP BY batch")
def triplet_loss(spark, d):
    return rounded(losses.triplet(_triples(spark, d)), "loss")


@query(f"WITH {PB} SELECT x.batch, round(ln(1 + sum(exp(20 * (list_dot_product(y.ea, y.en) - list_dot_product(x.ea, x.ep))))), 6) AS loss FROM t x JOIN t y USING (batch) GROUP BY x.batch")
def cosent_loss(spark, d):
    return rounded(losses.cosent(_triples(spark, d)), "loss")


DIST = f"""{HAVE}, n AS (SELECT vec_id, vec_id // 32 AS batch, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e, [{', '.join(NAMES)}] AS z FROM embeddings JOIN zf USING (vec_id)),
p AS MATERIALIZED (SELECT x.batch, x.vec_id AS a, y.vec_id AS b, greatest(1 - list_dot_product(x.e, y.e), 0) AS x, list_distance(x.z, y.z) AS d FROM n x JOIN n y ON x.batch = y.batch AND x.vec_id < y.vec_id)"""


def _distances(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", unit(as_doubles(F.col("embedding"))).alias("e")).join(doc_features(spark, d).select("vec_id", "z"), "vec_id")
    return losses.distances(v.select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("vec_id").alias("i"), "e", "z"))


@query(f"WITH {DIST}, s AS (SELECT batch, CASE WHEN avg(d) > 0 THEN avg(x) / avg(d) ELSE 1 END AS s FROM p GROUP BY batch) SELECT batch, round(avg(pow(x - s * d, 2)), 6) AS loss FROM p JOIN s USING (batch) GROUP BY batch")
def distance_preservation_loss(spark, d):
    return rounded(losses.distance_preservation(_distances(spark, d)), "loss")


@query(f"WITH {DIST} SELECT batch, round(avg(pow(x - d, 2)), 6) AS unscaled, round(avg(pow(x - 0.5 * d, 2)), 6) AS halved FROM p GROUP BY batch")
def reference_scales(spark, d):
    """The distance loss with the other two ways to scale the reference."""
    p = stored(_distances(spark, d))
    a, b = (losses.distance_preservation(p, m).withColumnRenamed("loss", n) for m, n in (("none", "unscaled"), (0.5, "halved")))
    return rounded(a.join(b, "batch"), "unscaled", "halved")


EVERY, MOST, LAMBDA = 4, 24, 0.1
_AUX = f"""WITH {PB}, {HAVE}, ids AS (SELECT batch, vec_id FROM (SELECT DISTINCT batch, unnest([anchor_id, positive_id]) AS vec_id FROM pb WHERE batch % {EVERY} = 0) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY md5('17:' || batch || ':' || vec_id), vec_id) <= {MOST}),
spot AS (SELECT ids.batch, ids.vec_id, n.e, [{', '.join(NAMES)}] AS z FROM ids JOIN n USING (vec_id) JOIN zf USING (vec_id)), far AS (SELECT x.batch, greatest(1 - list_dot_product(x.e, y.e), 0) AS x, list_distance(x.z, y.z) AS d FROM spot x JOIN spot y ON x.batch = y.batch AND x.vec_id < y.vec_id),
s AS (SELECT batch, CASE WHEN avg(d) > 0 THEN avg(x) / avg(d) ELSE 1 END AS s FROM far GROUP BY batch), aux AS (SELECT batch, avg(pow(x - s * d, 2)) AS aux FROM far JOIN s USING (batch) GROUP BY batch),
each AS (SELECT batch, a, ln(sum(exp(c / 0.05 - 20))) AS z, max(c / 0.05 - 20) FILTER (a = p) AS own FROM c GROUP BY ALL), main AS (SELECT batch, avg(z - own) AS loss FROM each GROUP BY batch)
SELECT batch, round(loss, 6) AS loss, round(aux, 6) AS aux, round(loss + {LAMBDA} * coalesce(aux, 0), 6) AS total FROM main LEFT JOIN aux USING (batch)"""


@query(_AUX)
def auxiliary_losses(spark, d):
    """The contrastive loss of every batch, with the distance loss of some of its points in every fourth one."""
    pairs = stored(class_pairs(spark, d))
    ids = losses.subsample(pairs.select("batch", F.explode(F.array("anchor_id", "positive_id")).alias("vec_id")).distinct(), EVERY, MOST, 17)
    v = table(spark, d, "embeddings").select("vec_id", unit(as_doubles(F.col("embedding"))).alias("e"))
    points = ids.join(v, "vec_id").join(doc_features(spark, d).select("vec_id", "z"), "vec_id").select("batch", F.col("vec_id").alias("i"), "e", "z")
    main = losses.contrastive(losses.in_batch(losses.batched(pairs, table(spark, d, "embeddings"))))
    return rounded(losses.with_auxiliary(main, losses.distance_preservation(losses.distances(points)), LAMBDA), "loss", "aux", "total")


@query()
def spanning_tree_losses(spark, d):
    return rounded(losses.tree_losses(_distances(spark, d)), "persistence", "topoae")


def _headed(spark, d, many=None):
    x = as_doubles(F.col("embedding"))
    return table(spark, d, "embeddings").join(doc_features(spark, d), "vec_id").select((F.slice(x, 1, many) if many else x).alias("features"), *NAMES)


@query()
def textstat_head(spark, d):
    """Mean squared error of a linear map from vectors to each standardized feature."""
    return rounded(losses.linear_head(_headed(spark, d), NAMES).select("target", "mse"), "mse")


@query(f"WITH {HAVE}, x AS (SELECT embedding[1]::DOUBLE AS x, zf.* FROM embeddings JOIN zf USING (vec_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS target, round(regr_syy({c}, x) / count(*) * (1 - regr_r2({c}, x)), 6) AS mse, round(regr_slope({c}, x), 6) AS slope, round(regr_intercept({c}, x), 6) AS intercept FROM x" for c in NAMES))
def textstat_head_of_one(spark, d):
    """The same from the vectors' first entry alone."""
    out = losses.linear_head(_headed(spark, d, 1), NAMES)
    return rounded(out.select("target", "mse", F.col("weights")[0].alias("slope"), "intercept"), "mse", "slope", "intercept")


@query()
def lr_holdout(spark, d):
    return rounded(classify.accuracy(table(spark, d, "embeddings")), "accuracy")


@query()
def lr_cv(spark, d):
    return rounded(classify.accuracy(table(spark, d, "embeddings"), folds=3, only=None), "accuracy")


@query("WITH k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS y FROM (SELECT DISTINCT source AS label FROM documents WHERE source IS NOT NULL)) SELECT doc_id, y::INTEGER AS y FROM documents JOIN k ON label = source")
def label_encoding(spark, d):
    return classify.encoded(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "y")


@query("SELECT 'a:' || label AS label, 'a' AS side, count(*) AS n FROM embeddings WHERE label < 5 GROUP BY ALL UNION ALL SELECT 'b:' || label, 'b', count(*) FROM embeddings WHERE label >= 5 GROUP BY ALL")
def stacked_corpora(spark, d):
    v = table(spark, d, "embeddings")
    return classify.stacked(v.where("label < 5"), v.where("label >= 5")).groupBy("label", "side").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings) SELECT label, fold::INTEGER AS fold, count(*) AS n, min(vec_id) AS least FROM k GROUP BY ALL")
def stratified_fold_sizes(spark, d):
    return classify.stratified_folds(table(spark, d, "embeddings"), 5).groupBy("label", "fold").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))


@query("WITH p AS (SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS side, CASE WHEN label < 5 THEN 'a:' ELSE 'b:' END || label AS label, CASE WHEN vec_id % 3 = 0 THEN 'a:1' WHEN vec_id % 3 = 1 THEN 'b:7' ELSE CASE WHEN label < 5 THEN 'a:' ELSE 'b:' END || label END AS predicted FROM embeddings) SELECT round(avg((label = predicted)::INT) FILTER (side = 'a'), 6) AS accuracy_a, round(avg((label = predicted)::INT) FILTER (side = 'b'), 6) AS accuracy_b, round(avg((predicted LIKE 'b:%')::INT) FILTER (side = 'a'), 6) AS a_to_b, round(avg((predicted LIKE 'a:%')::INT) FILTER (side = 'b'), 6) AS b_to_a FROM p")
def misroutes(spark, d):
    """Shares of rows sent to the other corpus's labels, of given predictions."""
    v = table(spark, d, "embeddings").withColumn("side", F.when(F.col("label") < 5, "a").otherwise("b"))
    v = v.withColumn("label", F.concat_ws(":", "side", F.col("label").cast("string")))
    rows = v.withColumn("predicted", F.when(F.col("vec_id") % 3 == 0, "a:1").when(F.col("vec_id") % 3 == 1, "b:7").otherwise(F.col("label")))
    return rounded(classify.routes(rows), "accuracy_a", "accuracy_b", "a_to_b", "b_to_a")


@query()
def router_accuracy(spark, d):
    v = table(spark, d, "embeddings")
    return rounded(classify.router(v.where("label < 5"), v.where("label >= 5")), "accuracy_a", "accuracy_b", "a_to_b", "b_to_a")


@query()
def router_per_corpus(spark, d):
    v = table(spark, d, "embeddings")
    return rounded(classify.router_per_corpus(v.where("label < 5"), v.where("label >= 5")), "accuracy_a", "accuracy_b")


def geometry_of(vectors):
    """One row: cosine geometry, the number of vectors and of classes."""
    sizes = vectors.agg(F.count("*").alias("n_docs"), F.countDistinct("label").alias("n_classes"))
    return geometry.within_between(vectors).crossJoin(geometry.centroid_separation(vectors).select("separation")).crossJoin(sizes)


def layer1(vectors):
    """One row: cosine geometry and hold-out accuracy."""
    return geometry_of(vectors).crossJoin(classify.accuracy(vectors).select(F.col("accuracy").alias("lr_acc")))


@query(f"SELECT * FROM ({r.SQL['within_between_gap']}), (SELECT separation FROM ({r.SQL['centroid_separation']})), (SELECT count(*) AS n_docs, count(DISTINCT label) AS n_classes FROM embeddings)")
def layer_one_geometry(spark, d):
    """All of layer one but its accuracy."""
    return rounded(geometry_of(table(spark, d, "embeddings")), "within", "between", "gap", "separation")


@query()
def layer_one(spark, d):
    return rounded(layer1(table(spark, d, "embeddings")), "within", "between", "gap", "separation", "lr_acc")


def layers_two_three(spark, vectors, features, cells=r.CELLS, seeds=cover.SEEDS):
    """One row: stability of the covers over the seeds, purity and legacy correlation of the first seed's graph, and the
    per-seed correlations' summary; ``features``: (vec_id, z)."""
    n = stored(cover.clusters(cover.cover(cover.lens(vectors, cover.seeds(spark, many=seeds)), cells), vectors))
    e, parts = stored(cover.nerve(n)), stored(cover.partition(n))
    stats = stored(graph.statistics(n, e, vectors.count()))
    pairs = stored(agreement.ari_nmi(parts))
    boot = agreement.bootstrap(stats, ["coverage", "n_nodes"]).select(F.col("mean_coverage").alias("coverage"), F.col("mean_n_nodes").alias("nodes"), "n_successful_seeds")
    se = lambda c: agreement.jackknife(pairs.select("seed_a", "seed_b", F.col(c).alias("value"))).select(F.col("se").alias(f"se_{c}"))
    base = F.col("seed") == 42
    out = agreement.pair_summary(pairs).drop("pairs").crossJoin(se("ari")).crossJoin(se("nmi")).crossJoin(boot)
    out = out.crossJoin(cover.purity(n.where(base), vectors).select("weighted", "mean").toDF("purity", "mean_purity"))
    out = out.crossJoin(anchor.rho(parts.where(base), e.where(base), features, legacy=True).select(F.col("rho").alias("anchor_rho"), "n_pairs_used"))
    out = out.crossJoin(anchor.summary(anchor.rho(parts, e, features)).toDF("anchor_rho_mean", "anchor_rho_sd", "n_anchor_seeds"))
    return out.withColumn("disintegrated", r.results.disintegrated(F.col("coverage"), F.col("nodes")))


_SE = lambda c: f"WITH RECURSIVE {r.AGREE}, s AS (SELECT DISTINCT unnest([seed_a, seed_b]) AS k FROM agree), m AS (SELECT k, avg({c}) AS m FROM s JOIN agree ON k <> seed_a AND k <> seed_b GROUP BY k) SELECT round(sqrt((count(*) - 1) * var_pop(m)), 6) AS se_{c} FROM m"
LAYERS = f"""SELECT s.* EXCLUDE (pairs), se_ari, se_nmi, mean_coverage AS coverage, mean_n_nodes AS nodes, n_successful_seeds, weighted AS purity, m.mean AS mean_purity, l.rho AS anchor_rho, l.n_pairs_used, a.mean AS anchor_rho_mean, a.sd AS anchor_rho_sd, a.n AS n_anchor_seeds,
 mean_coverage IS NULL OR mean_n_nodes IS NULL OR mean_coverage < 0.05 OR mean_n_nodes < 5 AS disintegrated
FROM ({r.SQL['bootstrap_summary']}) s, ({_SE('ari')}), ({_SE('nmi')}), ({r.SQL['bootstrap_statistics']}) b, (SELECT weighted, mean FROM ({r.SQL['purity']}) WHERE seed = 42) m, (SELECT rho, n_pairs_used FROM ({r.SQL['anchor_rho_legacy']}) WHERE seed = 42) l, ({r.SQL['anchor_summary']}) a"""


@query(LAYERS)
def layers_two_and_three(spark, d):
    out = layers_two_three(spark, table(spark, d, "embeddings"), stored(doc_features(spark, d)))
    return rounded(out, *[f.name for f in out.schema if f.dataType.simpleString() == "double"])


def reanalysed(spark, vectors, rows, features, seeds=cover.SEEDS):
    """Layers two and three of kept vectors (vec_id, embedding) for the evaluation rows (vec_id, label); other ids, missing
    or doubled ones raise before anything is computed."""
    both = align.checked(vectors.select("vec_id", "embedding"), rows.select("vec_id", "label"), "vec_id")
    return layers_two_three(spark, stored(both), features, seeds=seeds)


def checkpoint(spark, vectors, features, first=5, seeds=cover.SEEDS):
    """All layers of one encoder's vectors in one row, the router being between the labels below ``first`` and the others."""
    two, router = layers_two_three(spark, vectors, features, seeds=seeds), classify.router(vectors.where(F.col("label") < first), vectors.where(F.col("label") >= first))
    return layer1(vectors).crossJoin(two).crossJoin(router)


@query()
def checkpoint_evaluation(spark, d):
    out = checkpoint(spark, table(spark, d, "embeddings"), stored(doc_features(spark, d)))
    return rounded(out, *[f.name for f in out.schema if f.dataType.simpleString() == "double"])


@query("""WITH g AS (SELECT doc_id AS id, string_split('  ' || lower(text) || '  ', '') AS c FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM g), k AS (SELECT id, ('0x' || substr(md5('3:' || g), 1, 4))::BIGINT % 4096 AS bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT id, count(*) AS buckets, sum(n)::BIGINT AS trigrams, max(n) AS most FROM k GROUP BY id""")
def trigram_buckets(spark, d):
    """How a text's trigrams fall into 4,096 buckets."""
    return encoders.bucket_figures(r.docs_all(spark, d))


@query()
def random_projection(spark, d):
    """(id, embedding): 64 dimensions by a seeded normal matrix from 4,096 bucket counts."""
    out = encoders.random_projection(r.docs_all(spark, d))
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))
