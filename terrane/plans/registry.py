"""Queries over the driver's tables by name, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text
from terrane.functions.vectors import unit_or_self
from terrane.operators import agreement, corpus, cover, encoders, geometry, graph, pairs, results
from terrane.plans.base import DIGITS, QUERIES, SQL, query, rounded
from terrane.sources.tables import stored, table

#: Evaluation rows of a subset, and the smaller number of them where pairs are built from the rest.
CAP, PAIR_CAP = 20, 4
#: Cells of an axis for the driver's few vectors; the operator's own default is finer.
CELLS = 4


def queries() -> dict:
    from terrane.plans import layers, mapper, reports  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


CORPUS = "corpus AS (SELECT doc_id AS id, text, coalesce(source, 'unknown') AS subset, coalesce(lang, 'unknown') AS domain FROM documents WHERE regexp_matches(text, '\\S'))"
def split_sql(cap):
    return f"""{CORPUS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY md5('42:' || id), id) AS rn FROM corpus),
placed AS (SELECT id, row_number() OVER (ORDER BY subset, rn) - 1 AS place FROM ranked WHERE rn <= {cap}),
split AS (SELECT corpus.*, CASE WHEN place IS NULL THEN 'train' ELSE 'eval' END AS split, coalesce(place, -1)::BIGINT AS eval_order FROM corpus LEFT JOIN placed USING (id))"""


SPLIT = split_sql(CAP)
_RAW = """raw AS (SELECT id, subset, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))::DOUBLE AS lexicon_count, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS sentence_count,
 len(regexp_extract_all(lower(text), '[aeiouy]+'))::DOUBLE AS syllable_count, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: len(regexp_extract_all(w, '[aeiouy]+')) >= 3))::DOUBLE AS difficult_words FROM corpus),
feats AS MATERIALIZED (SELECT *, lexicon_count / sentence_count AS avg_sentence_length, 206.835 - 1.015 * lexicon_count / sentence_count - 84.6 * syllable_count / greatest(lexicon_count, 1) AS flesch_reading_ease FROM raw)"""
FEATS = f"{CORPUS}, {_RAW}"
NAMES = text.FEATURES
_FIT = f"{', '.join(f'avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS sd_{c}' for c in NAMES)}"
FIT = f"{split_sql(PAIR_CAP)}, {_RAW}, fit AS (SELECT {_FIT} FROM feats WHERE id IN (SELECT id FROM split WHERE split = 'train'))"
Z = f"{FIT}, z AS (SELECT feats.id, feats.subset, split.split, [{', '.join(f'({c} - mu_{c}) / sd_{c}' for c in NAMES)}] AS z FROM feats JOIN split USING (id), fit)"


def docs(spark, d):
    return corpus.corpus(table(spark, d, "documents"))


def split(spark, d, cap=CAP):
    return corpus.with_split(docs(spark, d), cap)


def features(spark, d):
    return text.with_features(docs(spark, d))


def z_rows(spark, d):
    """(id, subset, split, z): features of all rows, standardized by the training rows; texts are read once for them."""
    rows = split(spark, d, PAIR_CAP).select("id", "split")
    f = stored(features(spark, d).select("id", "subset", *NAMES).join(rows, "id"))
    z = text.z_scores(f, f.where("split = 'train'"))
    return z.select("id", "subset", "split", F.array(*[F.col(f"z_{c}") for c in NAMES]).alias("z"))


def train_rows(spark, d):
    return z_rows(spark, d).where("split = 'train'")


@query(f"WITH {CORPUS} SELECT 'documents' AS corpus, subset, count(*) AS n FROM corpus GROUP BY subset UNION ALL SELECT 'conversations', coalesce(role, 'unknown'), count(*) FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY ALL")
def corpora_by_name(spark, d):
    """How many rows each subset of each corpus has."""
    rows = [corpus.load(n, lambda t: table(spark, d, t)).groupBy("subset").agg(F.count("*").alias("n")).select(F.lit(n).alias("corpus"), "subset", "n") for n in sorted(corpus.CORPORA)]
    return rows[0].union(rows[1])


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round((x / CASE WHEN sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) = 0 THEN 1 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END)::FLOAT::DOUBLE, 5) + 0.0) AS e FROM embeddings")
def unit_floats(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(unit_or_self(F.col("embedding")), lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)).alias("e"))


@query(f"WITH {SPLIT} SELECT id, subset, domain, split, eval_order, length(text)::BIGINT AS chars FROM split")
def corpus_frame(spark, d):
    return split(spark, d).select("id", "subset", "domain", "split", "eval_order", F.length("text").cast("long").alias("chars"))


@query(f"WITH {CORPUS} SELECT subset, domain, count(*) AS n, sum(length(text))::BIGINT AS chars FROM corpus GROUP BY ALL")
def nonempty_filter(spark, d):
    return docs(spark, d).groupBy("subset", "domain").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("WITH m AS (SELECT * FROM (VALUES ('user', 'asks'), ('assistant', 'answers')) t(role, domain)) SELECT conv_id, turn, c.role, coalesce(domain, 'unknown') AS domain FROM conversations c LEFT JOIN m ON c.role = m.role")
def domain_lookup(spark, d):
    names = F.create_map(F.lit("user"), F.lit("asks"), F.lit("assistant"), F.lit("answers"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(names[F.col("role")], F.lit("unknown")).alias("domain"))


@query(f"WITH {SPLIT} SELECT id, subset, rn FROM ranked WHERE rn <= {CAP}")
def stratified_sample(spark, d):
    return corpus.stratified(docs(spark, d).select("id", "subset"), CAP).select("id", "subset", "rn")


@query(f"WITH {SPLIT} SELECT subset, split, count(*) AS n FROM split GROUP BY ALL")
def split_counts(spark, d):
    return split(spark, d).groupBy("subset", "split").agg(F.count("*").alias("n"))


@query(f"WITH {SPLIT} SELECT id, subset, eval_order FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY eval_order) AS t FROM split WHERE split = 'eval') ORDER BY t, subset LIMIT 50")
def round_robin_head(spark, d):
    return corpus.round_robin(split(spark, d).where("split = 'eval'").select("id", "subset", "eval_order"), 50)


@query(f"WITH {FEATS} SELECT id, {', '.join(f'round({c}, {DIGITS}) AS {c}' for c in NAMES)} FROM feats")
def text_features(spark, d):
    return rounded(features(spark, d).select("id", *NAMES), *NAMES)


@query(f"WITH {FIT} SELECT {', '.join(f'round({p}_{c}, {DIGITS}) AS {p}_{c}' for c in NAMES for p in ('mu', 'sd'))} FROM fit")
def standardizer(spark, d):
    rows = split(spark, d, PAIR_CAP).where("split = 'train'").select("id")
    out = text.standardizer(features(spark, d).join(rows, "id", "left_semi"))
    return rounded(out, *out.columns)


@query(f"WITH {Z} SELECT id, {', '.join(f'round(z[{i + 1}], {DIGITS}) AS z_{c}' for i, c in enumerate(NAMES))} FROM z")
def zscores(spark, d):
    return z_rows(spark, d).select("id", *[F.round(F.col("z")[i], DIGITS).alias(f"z_{c}") for i, c in enumerate(NAMES)])


def _pair_sql(kind):
    low, high = pairs.BANDS[kind]
    band = f"d >= {low}" + (f" AND d <= {high}" if high < 1e9 else "")
    return f"""{Z}, ring AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY md5('7:' || id), id) - 1 AS r, count(*) OVER (PARTITION BY subset) AS n FROM z WHERE split = 'train'),
every AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY step) AS use FROM (SELECT a.subset, a.id AS anchor_id, p.id AS positive_id, a.r, (p.r - a.r + a.n) % a.n AS step, list_distance(a.z, p.z) AS d FROM ring a JOIN ring p ON p.subset = a.subset AND p.id <> a.id) WHERE {band} QUALIFY use <= 3),
many AS (SELECT 2 * count(*) AS many FROM ring), s AS (SELECT subset, count(*) AS n FROM ring GROUP BY 1), e AS (SELECT subset, n, n * many / (SELECT sum(n) FROM s) AS x FROM s, many),
quota AS (SELECT subset, n, (floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, subset) <= (SELECT many FROM many) - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END)::BIGINT AS quota FROM e),
met AS MATERIALIZED (SELECT subset, anchor_id, positive_id, d, use FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY r, anchor_id) AS nth FROM every WHERE use = 1) JOIN quota USING (subset) WHERE nth <= quota),
more AS (SELECT subset, anchor_id, positive_id, d, use, row_number() OVER (ORDER BY use, md5('7:' || use || ':' || anchor_id), anchor_id) AS k FROM every WHERE (anchor_id, use) NOT IN (SELECT (anchor_id, use) FROM met) QUALIFY k <= (SELECT many FROM many) - (SELECT count(*) FROM met)),
pairs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('7:' || anchor_id || ':' || positive_id), anchor_id, positive_id) - 1 AS place FROM (SELECT subset, anchor_id, positive_id, d AS ts_dist, use, false AS filled FROM met UNION ALL SELECT subset, anchor_id, positive_id, d, use, true FROM more))"""


def _wanted(spark, d, kind):
    rows = stored(z_rows(spark, d))
    train = rows.where("split = 'train'")
    return pairs.wanted(train, kind, 2 * max(train.count(), 1), 7, rows.where("split = 'eval'"))


def _pairs(kind):
    @query(f"WITH {_pair_sql(kind)} SELECT subset, anchor_id, positive_id, round(ts_dist, {DIGITS}) AS ts_dist, use, filled, place FROM pairs", name=f"pairs_{kind}")
    def run(spark, d):
        return rounded(_wanted(spark, d, kind)[0], "ts_dist")

    @query(f"""WITH {_pair_sql(kind)}, built AS (SELECT subset, count(*) AS pairs, count(*) FILTER (filled) AS filled, max(use) AS max_use, count(DISTINCT anchor_id) AS anchors FROM pairs GROUP BY subset),
dead AS (SELECT subset, count(*) AS dead FROM ring LEFT JOIN (SELECT anchor_id, count(*) AS have FROM every GROUP BY 1) ON anchor_id = id WHERE coalesce(have, 0) < (SELECT coalesce(max(use), 1) FROM pairs) GROUP BY subset)
SELECT subset, quota.n, quota, coalesce(pairs, 0) AS pairs, quota - coalesce(pairs, 0) + coalesce(filled, 0) AS shortfall, coalesce(filled, 0) AS filled, coalesce(max_use, 0) AS max_use, coalesce(anchors, 0) AS anchors, coalesce(dead, 0) AS dead FROM quota LEFT JOIN built USING (subset) LEFT JOIN dead USING (subset)""", name="pair_report" if kind == "matched" else f"pair_report_{kind}")
    def report(spark, d):
        return _wanted(spark, d, kind)[1]


for _kind in pairs.BANDS:
    _pairs(_kind)


@query(f"WITH {_pair_sql('matched')} SELECT anchor_id, positive_id, md5(a.text) AS anchor, md5(p.text) AS positive FROM pairs JOIN corpus a ON a.id = anchor_id JOIN corpus p ON p.id = positive_id")
def pair_text_join(spark, d):
    found = pairs.with_texts(_wanted(spark, d, "matched")[0], docs(spark, d).select("id", F.md5("text")))
    return found.select("anchor_id", "positive_id", "anchor", "positive")


@query(f"WITH {_pair_sql('random')} SELECT place, anchor_id, positive_id FROM pairs WHERE place < 100")
def first_pairs(spark, d):
    """The first pairs of the shuffle."""
    return _wanted(spark, d, "random")[0].where("place < 100").select("place", "anchor_id", "positive_id")


@query(f"""WITH {_pair_sql('random')}, rows AS (SELECT id, row_number() OVER (ORDER BY md5('9:' || id), id) - 1 AS k FROM ring), spot AS (SELECT anchor_id, positive_id, row_number() OVER (ORDER BY md5('10:' || anchor_id || ':' || positive_id), anchor_id, positive_id) - 1 AS k FROM pairs)
SELECT anchor_id, positive_id, arg_min(id, i) AS negative_id FROM spot, range(3) t(i) JOIN rows ON rows.k = (spot.k + i) % (SELECT count(*) FROM rows) WHERE id <> anchor_id AND id <> positive_id GROUP BY ALL""")
def pair_negatives(spark, d):
    """A training row for each pair that is neither of its two."""
    return pairs.negatives(_wanted(spark, d, "random")[0], train_rows(spark, d), 7)


@query(f"""WITH {_pair_sql('random')} SELECT count(*) AS pairs, count(DISTINCT (anchor_id, positive_id)) AS distinct_pairs FROM pairs""")
def pair_counts(spark, d):
    return _wanted(spark, d, "random")[0].agg(F.count("*").alias("pairs"), F.countDistinct("anchor_id", "positive_id").alias("distinct_pairs"))


@query()
def duplicate_free_batches(spark, d):
    """Batches of 16 pairs in which no id comes twice."""
    found = _wanted(spark, d, "matched")[0]
    return pairs.batches(found, 16, 7)


@query(f"""WITH {CORPUS}, s AS (SELECT subset, count(*) AS n FROM corpus GROUP BY 1), e AS (SELECT subset, n * 100 / (SELECT sum(n) FROM s) AS x FROM s),
r AS (SELECT *, floor(x) AS q, row_number() OVER (ORDER BY x - floor(x) DESC, subset) AS r FROM e) SELECT subset, (q + CASE WHEN r <= 100 - (SELECT sum(q) FROM r) THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def pair_quotas(spark, d):
    return corpus.largest_remainder(docs(spark, d).groupBy("subset").agg(F.count("*").alias("n")), 100)


@query(f"WITH {SPLIT} SELECT t.id, t.subset FROM split t WHERE t.split = 'train' AND md5(t.text) IN (SELECT md5(text) FROM split WHERE split = 'eval')")
def leak_guard(spark, d):
    rows = split(spark, d).select("id", "subset", "split", F.md5("text").alias("text"))
    return corpus.leaked(rows.where("split = 'train'"), rows.where("split = 'eval'"), "text").select("id", "subset")


UNIT = "u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings)"
COS = "c AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"WITH {UNIT} SELECT label, pos::INTEGER AS pos, round(avg(x), {DIGITS}) AS x FROM u GROUP BY label, pos")
def class_centroids(spark, d):
    return rounded(geometry.centroids(table(spark, d, "embeddings")), "x")


@query(f"""WITH {UNIT}, m AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL) GROUP BY label)
SELECT round(avg(list_cosine_similarity(a.v, b.v)), {DIGITS}) AS separation, (SELECT count(*) FROM m) AS labels FROM m a JOIN m b ON a.label <> b.label""")
def centroid_separation(spark, d):
    return rounded(geometry.centroid_separation(table(spark, d, "embeddings")), "separation")


@query(f"WITH {COS} SELECT round(w, {DIGITS}) AS within, round(b, {DIGITS}) AS between, round(w - b, {DIGITS}) AS gap FROM (SELECT (SELECT avg(m) FROM (SELECT avg(c) AS m FROM c WHERE la = lb GROUP BY la)) AS w, (SELECT avg(c) FROM c WHERE la <> lb) AS b)")
def within_between_gap(spark, d):
    return rounded(geometry.within_between(table(spark, d, "embeddings")), "within", "between", "gap")


@query(f"WITH {COS} SELECT la AS label, (SELECT count(*) FROM embeddings WHERE label = la) AS n, round(avg(c), {DIGITS}) AS within FROM c WHERE la = lb GROUP BY la")
def class_cohesion(spark, d):
    return rounded(geometry.class_cohesion(table(spark, d, "embeddings")), "within")


LENS = f"""lens AS MATERIALIZED (SELECT seed, vec_id, sum(x * CASE WHEN md5('1:' || seed || ':' || pos)[1] < '8' THEN 1 ELSE -1 END) AS u, sum(x * CASE WHEN md5('2:' || seed || ':' || pos)[1] < '8' THEN 1 ELSE -1 END) AS v
 FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings), range(42, {42 + cover.SEEDS}) s(seed) GROUP BY ALL)"""
_T = lambda c: f"(({c} - {c}0) / CASE WHEN {c}1 > {c}0 THEN ({c}1 - {c}0) / {CELLS} ELSE 1 END)"
_B = lambda c: f"least({CELLS - 1}, greatest(0, floor({_T(c)} - {cover.OVERLAP / 2})))::INTEGER AS {c}a, least({CELLS - 1}, floor({_T(c)} + {cover.OVERLAP / 2}))::INTEGER AS {c}b"
COVER = f"""{LENS}, e AS (SELECT seed, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM lens GROUP BY seed), b AS (SELECT seed, vec_id, {_B('u')}, {_B('v')} FROM lens JOIN e USING (seed)),
cells AS MATERIALIZED (SELECT seed, vec_id, cx, unnest(range(va, vb + 1)) AS cy FROM (SELECT *, unnest(range(ua, ub + 1)) AS cx FROM b))"""
NODES = f"""{COVER}, near AS MATERIALIZED (SELECT a.seed, a.cx, a.cy, a.vec_id AS a, b.vec_id AS b FROM cells a JOIN cells b ON a.seed = b.seed AND a.cx = b.cx AND a.cy = b.cy JOIN embeddings p ON p.vec_id = a.vec_id JOIN embeddings q ON q.vec_id = b.vec_id
 WHERE list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= {1 - cover.RADIUS}),
reach AS (SELECT * FROM near UNION SELECT r.seed, r.cx, r.cy, r.a, n.b FROM reach r JOIN near n ON n.seed = r.seed AND n.cx = r.cx AND n.cy = r.cy AND n.a = r.b),
nodes AS MATERIALIZED (SELECT seed, cx || '-' || cy || '-' || root AS node, vec_id FROM (SELECT *, count(*) OVER (PARTITION BY seed, cx, cy, root) AS n FROM (SELECT seed, cx, cy, a AS vec_id, min(b) AS root FROM reach GROUP BY ALL)) WHERE n >= {cover.LEAST})"""
EDGES = f"{NODES}, edges AS MATERIALIZED (SELECT DISTINCT a.seed, a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.seed = b.seed AND a.vec_id = b.vec_id AND a.node < b.node)"
COMPS = f"{EDGES}, both_ways AS (SELECT seed, src, dst FROM edges UNION SELECT seed, dst, src FROM edges), walk AS (SELECT DISTINCT seed, node AS src, node AS dst FROM nodes UNION SELECT w.seed, w.src, e.dst FROM walk w JOIN both_ways e ON e.seed = w.seed AND e.src = w.dst), comps AS (SELECT seed, src AS node, min(dst) AS component FROM walk GROUP BY ALL)"
PARTS = f"{NODES}, parts AS MATERIALIZED (SELECT seed, vec_id, min(node) AS node FROM nodes GROUP BY ALL)"


def points(spark, d):
    return cover.lens(table(spark, d, "embeddings"), cover.seeds(spark))


def nodes(spark, d):
    return cover.clusters(cover.cover(points(spark, d), CELLS), table(spark, d, "embeddings"))


@query(f"WITH {COVER} SELECT seed::INTEGER AS seed, vec_id, cx, cy FROM cells")
def cover_membership(spark, d):
    return cover.cover(points(spark, d), CELLS)


@query(f"WITH {LENS} SELECT seed::INTEGER AS seed, vec_id, round(u, {DIGITS}) AS u, round(v, {DIGITS}) AS v FROM lens")
def lens_points(spark, d):
    return rounded(points(spark, d), "u", "v")


@query(f"WITH RECURSIVE {NODES} SELECT seed::INTEGER AS seed, node, vec_id FROM nodes")
def mapper_nodes(spark, d):
    return nodes(spark, d)


@query(f"WITH RECURSIVE {EDGES} SELECT seed::INTEGER AS seed, src, dst FROM edges")
def mapper_edges(spark, d):
    return cover.nerve(stored(nodes(spark, d)))


@query(f"WITH RECURSIVE {PARTS} SELECT seed::INTEGER AS seed, vec_id, node FROM parts")
def doc_partition(spark, d):
    return cover.partition(nodes(spark, d))


@query(f"WITH RECURSIVE {COMPS} SELECT seed::INTEGER AS seed, node, component FROM comps")
def components(spark, d):
    n = stored(nodes(spark, d))
    return graph.components(n, cover.nerve(n))


STATISTICS = f"""{COMPS}, s AS (SELECT seed, node, count(*) AS n FROM nodes GROUP BY ALL), g AS (SELECT seed, count(*) AS n_nodes, avg(n) AS mean_size, quantile_cont(n, 0.5) AS median_size FROM s GROUP BY seed),
k AS (SELECT seed, count(*) AS n_components, max(n) AS largest FROM (SELECT seed, component, count(*) AS n FROM comps GROUP BY ALL) GROUP BY seed), w AS (SELECT seed, count(*) AS n_edges FROM edges GROUP BY seed), cov AS (SELECT seed, count(DISTINCT vec_id) / (SELECT count(*) FROM embeddings) AS coverage FROM nodes GROUP BY seed),
statistics AS (SELECT seed::INTEGER AS seed, n_nodes, coalesce(n_edges, 0) AS n_edges, n_components, coverage, mean_size, median_size::DOUBLE AS median_size, largest / n_nodes AS largest_share,
 greatest(coalesce(n_edges, 0) - n_nodes + n_components, 0) AS b1, 2 * coalesce(n_edges, 0) / n_nodes AS avg_degree, CASE WHEN n_nodes > 1 THEN 2 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END AS density FROM g JOIN k USING (seed) JOIN cov USING (seed) LEFT JOIN w USING (seed))"""


@query(f"WITH RECURSIVE {STATISTICS} SELECT seed, n_nodes, n_edges, n_components, round(coverage, 6) AS coverage, round(mean_size, 6) AS mean_size, median_size, round(largest_share, 6) AS largest_share, b1, round(avg_degree, 6) AS avg_degree, round(density, 6) AS density FROM statistics")
def graph_stats(spark, d):
    n = stored(nodes(spark, d))
    out = graph.statistics(n, stored(cover.nerve(n)), table(spark, d, "embeddings").count())
    return rounded(out, "coverage", "mean_size", "largest_share", "avg_degree", "density")


@query(f"WITH RECURSIVE {PARTS}, x AS (SELECT seed, node, label, count(*) AS n FROM nodes JOIN embeddings USING (vec_id) GROUP BY ALL), y AS (SELECT seed, node, max(n) AS m, sum(n) AS n FROM x GROUP BY ALL) SELECT seed::INTEGER AS seed, round(sum(m) / sum(n), 6) AS weighted, round(avg(m / n), 6) AS mean FROM y GROUP BY seed")
def purity(spark, d):
    return rounded(cover.purity(nodes(spark, d), table(spark, d, "embeddings")), "weighted", "mean")


AGREE = f"""{PARTS}, t AS (SELECT x.seed AS seed_a, y.seed AS seed_b, x.node AS a, y.node AS b, count(*) AS n FROM parts x JOIN parts y ON x.vec_id = y.vec_id AND x.seed < y.seed GROUP BY ALL),
w AS (SELECT seed_a, seed_b, sum(n) AS t, sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS h FROM t GROUP BY ALL), pa AS (SELECT seed_a, seed_b, sum(m * (m - 1) / 2) AS p, sum(m * ln(m)) AS h FROM (SELECT seed_a, seed_b, a, sum(n) AS m FROM t GROUP BY ALL) GROUP BY ALL), pb AS (SELECT seed_a, seed_b, sum(m * (m - 1) / 2) AS p, sum(m * ln(m)) AS h FROM (SELECT seed_a, seed_b, b, sum(n) AS m FROM t GROUP BY ALL) GROUP BY ALL),
agree AS MATERIALIZED (SELECT seed_a, seed_b, CASE WHEN abs((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)) < 1e-12 THEN 1 ELSE (ij - pa.p * pb.p / (t * (t - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)) END AS ari,
 CASE WHEN ln(t) - pa.h / t + ln(t) - pb.h / t <= 1e-12 THEN 1 ELSE (ln(t) - pa.h / t + ln(t) - pb.h / t - (ln(t) - w.h / t)) / ((ln(t) - pa.h / t + ln(t) - pb.h / t) / 2) END AS nmi FROM w JOIN pa USING (seed_a, seed_b) JOIN pb USING (seed_a, seed_b) WHERE t > 1)"""


def agreements(spark, d):
    """Agreement of the covers' partitions of every two seeds."""
    return agreement.ari_nmi(stored(cover.partition(nodes(spark, d))))


@query(f"WITH RECURSIVE {AGREE} SELECT seed_a::INTEGER AS seed_a, seed_b::INTEGER AS seed_b, round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM agree")
def pairwise_agreement(spark, d):
    return rounded(agreements(spark, d), "ari", "nmi")


@query(f"WITH RECURSIVE {AGREE} SELECT count(*) AS pairs, round(coalesce(avg(ari), 0), 6) AS mean_ari, round(coalesce(stddev_samp(ari), 0), 6) AS sd_ari, round(coalesce(avg(nmi), 0), 6) AS mean_nmi, round(coalesce(stddev_samp(nmi), 0), 6) AS sd_nmi FROM agree")
def bootstrap_summary(spark, d):
    return rounded(agreement.pair_summary(agreements(spark, d)), "mean_ari", "sd_ari", "mean_nmi", "sd_nmi")


@query(f"WITH RECURSIVE {AGREE}, s AS (SELECT DISTINCT unnest([seed_a, seed_b]) AS k FROM agree), m AS (SELECT k, avg(ari) AS m FROM s JOIN agree ON k <> seed_a AND k <> seed_b GROUP BY k) SELECT count(*) AS seeds, round(sqrt((count(*) - 1) * var_pop(m)), 6) AS se FROM m")
def jackknife_se(spark, d):
    return rounded(agreement.jackknife(agreements(spark, d).select("seed_a", "seed_b", F.col("ari").alias("value"))), "se")


@query(f"WITH {FEATS}, r AS (SELECT subset, rank() OVER (PARTITION BY subset ORDER BY lexicon_count) + (count(*) OVER (PARTITION BY subset, lexicon_count) - 1) / 2 AS a, rank() OVER (PARTITION BY subset ORDER BY avg_sentence_length) + (count(*) OVER (PARTITION BY subset, avg_sentence_length) - 1) / 2 AS b FROM feats) SELECT subset, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY subset")
def feature_rank_correlation(spark, d):
    return rounded(agreement.spearman(features(spark, d), ["subset"], "lexicon_count", "avg_sentence_length"), "rho")


_P = f"""WITH {FEATS}, k AS (SELECT subset, rank() OVER (PARTITION BY subset ORDER BY id) + (count(*) OVER (PARTITION BY subset, id) - 1) / 2 AS a, rank() OVER (PARTITION BY subset ORDER BY lexicon_count) + (count(*) OVER (PARTITION BY subset, lexicon_count) - 1) / 2 AS b FROM feats),
c AS (SELECT subset, count(*) AS n, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM k GROUP BY subset), t AS (SELECT *, n - 2 AS v, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c),
f AS (SELECT subset, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(t * i / 4000, 2) / v, -(v + 1) / 2) * t / 12000 AS f FROM t, range(4001) s(i) WHERE n > 2)
SELECT subset, n, round(rho, 6) AS rho, round((SELECT 1 - 2 * sum(f.f) FROM f WHERE f.subset = t.subset), 6) AS p FROM t"""


@query(_P)
def rank_correlation_p(spark, d):
    """Rank correlation of id and words in every subset, with its p-value."""
    return rounded(agreement.with_p(agreement.spearman(features(spark, d), ["subset"], "id", "lexicon_count")), "rho", "p")


RUNS = """runs AS (SELECT 'm' || (user_id % 7) AS model, event_type AS pair_set, 0.01::DOUBLE * (1 + event_id % 4) AS tau, (event_id % 3)::INTEGER AS seed, (event_id % 5) / 4.0::DOUBLE AS ckpt_frac, event_id, value AS gap, value / 2 - event_id % 11 AS rho, (event_id % 100) / 100.0::DOUBLE AS coverage, (event_id % 40)::DOUBLE AS nodes,
 'exp' || (1 + event_id % 4) AS exp, CASE WHEN event_id % 3 = 0 THEN 'triplet' ELSE 'mnrl' END AS loss, CASE event_id % 7 WHEN 0 THEN 'dist_preserve' WHEN 1 THEN NULL ELSE '' END AS aux, CASE WHEN event_id % 7 = 0 THEN 0.1::DOUBLE * (1 + event_id % 2) END AS lam, CASE WHEN event_id % 7 < 4 THEN 'S' ELSE 'M' END AS corpus,
 '0.0' || (1 + event_id % 4) || CASE WHEN event_id % 3 = 0 THEN '0' ELSE '' END AS tau_text, (468 + CASE WHEN user_id % 7 = 3 THEN event_id % 2 ELSE 0 END)::DOUBLE AS total_steps, value / 3 AS router FROM events)"""
_DIS = "(coverage IS NULL OR nodes IS NULL OR coverage < 0.05 OR nodes < 5)"


def runs(spark, d):
    return results.runs(table(spark, d, "events"))


@query(f"WITH {RUNS} SELECT model, {_DIS} AS disintegrated, count(*) AS n FROM runs GROUP BY ALL")
def disintegrated_flag(spark, d):
    return runs(spark, d).groupBy("model", results.disintegrated(F.col("coverage"), F.col("nodes")).alias("disintegrated")).agg(F.count("*").alias("n"))


_IDENTITY = "exp, model, loss, round(TRY_CAST(tau_text AS DOUBLE), 10), pair_set, coalesce(aux, ''), coalesce(lam, -1), ckpt_frac, seed, corpus"


@query(f"WITH {RUNS} SELECT arg_max(exp, event_id) AS exp, arg_max(model, event_id) AS model, arg_max(tau_text, event_id) AS tau, min(event_id) AS pos, max(event_id) AS event_id, round(arg_max(gap, event_id), 6) AS gap FROM runs GROUP BY {_IDENTITY}")
def upsert_results(spark, d):
    """Result rows by their ten identifying columns, temperatures being texts of unequal form and nothing being NULL or empty."""
    rows = runs(spark, d).drop("tau").withColumnRenamed("tau_text", "tau")
    return rounded(results.upsert(rows).select("exp", "model", "tau", "pos", "event_id", "gap"), "gap")


_GRID = "g AS (SELECT model, pair_set, round(tau, 2) AS tau, seed FROM (SELECT unnest(['m0', 'm1', 'm9']) AS model), (SELECT unnest(['view', 'click', 'none']) AS pair_set), (SELECT unnest([0.01, 0.02, 0.05]::DOUBLE[]) AS tau), (SELECT unnest([0, 1, 2]) AS seed))"


@query(f"WITH {RUNS}, {_GRID} SELECT model, pair_set, tau, seed::BIGINT AS seed FROM g WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.model = g.model AND r.pair_set = g.pair_set AND abs(r.tau - g.tau) < 1e-9 AND r.seed = g.seed)")
def todo_rows(spark, d):
    grid = results.grid(spark, ["m0", "m1", "m9"], ["view", "click", "none"], [0.01, 0.02, 0.05], [0, 1, 2])
    return results.todo(grid, runs(spark, d).withColumn("tau", F.round("tau", 6)))


@query("SELECT event_id, event_type, round(TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), 6) AS metric, event_id % 2 = 1 AS flag, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 5 END::INTEGER AS seed FROM events")
def load_typed_results(spark, d):
    raw = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("metric"), F.when(F.col("event_id") % 2 == 1, "Yes").otherwise("no").alias("flag"), F.when(F.col("event_id") % 5 == 0, "").otherwise((F.col("event_id") % 5).cast("string")).alias("seed"))
    return rounded(results.typed(raw, ("metric",), ("flag",), "seed"), "metric")


@query(f"WITH {RUNS} SELECT model, round(tau, 6) AS tau, ckpt_frac, round(avg(rho), 6) AS mean_rho, round(min(rho), 6) AS min_rho, round(max(rho), 6) AS max_rho, bool_or({_DIS}) AS any_disintegrated FROM runs GROUP BY model, runs.tau, ckpt_frac")
def fig_rho_vs_step(spark, d):
    return rounded(results.rho_by_step(runs(spark, d)), "tau", "mean_rho", "min_rho", "max_rho")


@query(f"WITH {RUNS}, ref AS (SELECT model, CASE WHEN NOT bool_or({_DIS}) THEN avg(gap) END AS ref_gap FROM runs WHERE ckpt_frac = 0 AND seed = 0 GROUP BY model) SELECT model, ckpt_frac = 1 AS final, round(avg(gap), 6) AS gap, round(avg(rho), 6) AS rho, round(any_value(ref_gap), 6) AS ref_gap FROM runs LEFT JOIN ref USING (model) GROUP BY model, ckpt_frac = 1")
def fig_gap_vs_rho(spark, d):
    t = runs(spark, d)
    bad = F.bool_or(results.disintegrated(F.col("coverage"), F.col("nodes")))
    ref = t.where("ckpt_frac = 0 and seed = 0").groupBy("model").agg(F.when(~bad, F.avg("gap")).alias("ref_gap"))
    return rounded(results.gap_against_rho(t, ref), "gap", "rho", "ref_gap")


@query(f"WITH {RUNS} SELECT pair_set, round(avg(rho) FILTER (ckpt_frac = 1), 6) AS mean_rho, round(stddev_samp(rho) FILTER (ckpt_frac = 1), 6) AS sd_rho, count(*) FILTER (ckpt_frac = 1) AS n, round(avg(rho) FILTER (ckpt_frac = 0), 6) AS untrained FROM runs GROUP BY pair_set")
def fig_pairset_bars(spark, d):
    return rounded(results.pair_set_bars(runs(spark, d)), "mean_rho", "sd_rho", "untrained")


@query(f"WITH {RUNS} SELECT round(tau, 6) AS tau, pair_set, round(avg(gap), 6) AS gap, round(avg(rho), 6) AS rho, count(*) AS n FROM runs WHERE ckpt_frac = 1 GROUP BY runs.tau, pair_set")
def fig_pareto(spark, d):
    return rounded(results.pareto(runs(spark, d)), "tau", "gap", "rho")


@query(f"WITH {RUNS}, m AS (SELECT model, avg(rho) FILTER (NOT {_DIS}) AS mean_rho, count(DISTINCT seed) FILTER (NOT {_DIS}) AS n_seeds FROM runs GROUP BY model) SELECT model, round(mean_rho, 6) AS mean_rho, n_seeds, n_seeds >= 2 AS scorable, row_number() OVER (ORDER BY n_seeds >= 2 DESC, mean_rho DESC, model) AS place FROM m")
def roster_order(spark, d):
    return rounded(results.roster(runs(spark, d)), "mean_rho")


@query(f"WITH {RUNS}, e AS (SELECT model, seed, avg(rho) AS rho FROM runs GROUP BY ALL) SELECT model, count(*) AS n, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS sd, round(2 * stddev_samp(rho) / sqrt(count(*)), 6) AS bound FROM e GROUP BY model")
def per_seed_summary(spark, d):
    return rounded(results.per_seed(runs(spark, d)), "mean", "sd", "bound")


@query(f"WITH {RUNS} SELECT event_id, round_even(ckpt_frac * (470 + event_id % 3), 0)::BIGINT AS step FROM runs")
def checkpoint_steps(spark, d):
    rows = runs(spark, d).withColumn("total", F.lit(470) + F.col("event_id") % 3)
    return results.checkpoint_steps(rows, "ckpt_frac", "total").select("event_id", "step")


@query("""WITH c AS (SELECT doc_id AS id, string_split('  ' || lower(text) || '  ', '') AS c FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM c), n AS (SELECT id, g, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT id, n, ('0x' || substr(md5('3:' || g), 1, 4))::BIGINT % 16 AS dim, md5('4:' || g)[1] < '8' AS up FROM n) SELECT id, dim, sum(CASE WHEN up THEN n ELSE -n END)::BIGINT AS x FROM h GROUP BY ALL""")
def hashed_trigrams(spark, d):
    """Trigrams fold into 16 signed hash buckets a text."""
    return encoders.signed_buckets(docs_all(spark, d))


def docs_all(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")


