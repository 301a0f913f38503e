"""ML, SCR and JN5: deterministic parts against SQL, fitted parts as row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import (
    CASE_STATUS, CASE_WEAKEST, COLS, U, V, check, lines_view, modeling_view, r, rs, table, units_view,
)
from regiometra.domain import ADVICE, STATUS_ORDER, advice_table
from regiometra.operators import clustering as km
from regiometra.operators import evaluation as ev
from regiometra.operators import scoring as sc
from regiometra.operators.filters import sample_n
from regiometra.operators.joins import lookup_explode
from regiometra.operators.scalars import one_row, with_scalars
from regiometra.operators.splitting import stratified_split
from regiometra.plans import classify as pc
from regiometra.plans import cluster as pk

INDICES = ["iks", "ike", "ikl"]
# A labelling given from outside, the same in both engines.
GIVEN = "CASE WHEN idm < 0.5 THEN 1 WHEN ike > iks THEN 2 ELSE 3 END"


@check("ml1_stratified_split", f"""WITH {U}, s AS (SELECT unit, status, row_number() OVER (PARTITION BY status
  ORDER BY md5('42|' || unit), unit) AS rn, round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY status), 0) AS take
  FROM u) SELECT unit, status, rn <= take AS is_test FROM s""")
def _(spark, folder):
    split = stratified_split(units_view(spark, folder), "status", "unit", STATUS_ORDER)
    return split.select("unit", "status", "is_test")


@check("ml1_apportioned_split", f"""WITH {U}, n AS (SELECT status, count(*) AS n FROM u GROUP BY status),
  t AS (SELECT sum(n) AS n, ceil(0.2::DOUBLE * sum(n)) AS draws FROM n),
  q AS (SELECT status, draws, n.n::DOUBLE / t.n::DOUBLE * draws AS share FROM n, t),
  p AS (SELECT status, floor(share) AS part, draws - sum(floor(share)) OVER () AS more,
  row_number() OVER (ORDER BY share - floor(share) DESC, status) AS place FROM q),
  s AS (SELECT unit, status, row_number() OVER (PARTITION BY status ORDER BY md5('42|' || unit), unit) AS rn FROM u)
  SELECT unit, status, rn <= part + CASE WHEN place <= more THEN 1 ELSE 0 END AS is_test FROM s JOIN p USING (status)""")
def _(spark, folder):
    split = stratified_split(units_view(spark, folder), "status", "unit", STATUS_ORDER, apportion=True)
    return split.select("unit", "status", "is_test")


_Z = ", ".join(rs(f"({c} - (SELECT avg({c}) FROM v)) / (SELECT stddev_pop({c}) FROM v)") + f" AS {c}"
               for c in INDICES)


@check("ml2_standardize", f"WITH {V} SELECT unit, n_rec, {_Z}, 0.0::DOUBLE AS const FROM v")
def _(spark, folder):
    v = lines_view(spark, folder).withColumn("const", F.lit(3.0))
    return r(km.standardize(v, [*INDICES, "const"]).select("unit", "n_rec", *INDICES, "const"), *INDICES)


@check("ml3_inverse_standardize", f"""WITH {V} SELECT flag, {', '.join(f"{rs(f'avg({c})')} AS {c}" for c in INDICES)}
  FROM v GROUP BY flag""")
def _(spark, folder):
    v = lines_view(spark, folder)
    scaler = km.Scaler.fit(v, INDICES)
    centers = scaler.stage("z").transform(v).groupBy("flag").agg(
        *[F.avg(f"z{i}").alias(c) for i, c in enumerate(INDICES)])
    return r(scaler.inverse(centers, INDICES), *INDICES)


@check("ml8_silhouette_exact", f"""WITH {U}, s AS (SELECT unit, iks, ike, ikl, {GIVEN} AS c FROM u
  ORDER BY md5('42|' || unit), unit LIMIT 10000), n AS (SELECT c, count(*) AS size FROM s GROUP BY c),
  d AS (SELECT a.unit, a.c AS own, b.c AS other, sum(sqrt((a.iks - b.iks) * (a.iks - b.iks)
  + (a.ike - b.ike) * (a.ike - b.ike) + (a.ikl - b.ikl) * (a.ikl - b.ikl))) AS total
  FROM s a, s b GROUP BY a.unit, a.c, b.c),
  m AS (SELECT unit, max(CASE WHEN own = other THEN total / greatest(size - 1, 1) END) AS a,
  min(CASE WHEN own <> other THEN total / size END) AS b,
  max(CASE WHEN own = other THEN size END) AS own_size FROM d JOIN n ON d.other = n.c GROUP BY unit)
  SELECT 'cluster_id' AS labelling,
  {rs('avg(CASE WHEN own_size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM m""")
def _(spark, folder):
    given = units_view(spark, folder).withColumn("cluster_id", F.expr(GIVEN))
    taken = sample_n(given.select("unit", "cluster_id", *INDICES), 10_000, "unit")
    return r(km.silhouette_exact(taken, INDICES, ["cluster_id"]), "silhouette")


@check("ml10_cluster_sizes", f"""WITH {V} SELECT 'Klaster ' || n_rec AS cluster_label, count(*) AS JUMLAH
  FROM v GROUP BY n_rec ORDER BY 1""")
def _(spark, folder):
    v = lines_view(spark, folder).withColumn("cluster_label", F.concat(F.lit("Klaster "), "n_rec"))
    return km.cluster_sizes(v, "cluster_label")


@check("ext2_cluster_points", f"WITH {U} SELECT ikl, ike, iks, ({GIVEN})::INT AS cluster_id FROM u WHERE unit % 4 <> 0")
def _(spark, folder):
    placed = units_view(spark, folder).withColumn(
        "cluster_id", F.when(F.col("unit") % 4 != 0, F.expr(GIVEN)))
    return pk.cluster_points(placed, ["ikl", "ike", "iks"], COLS)


def judged(spark, folder):
    """Status as the label, and the class of one index as its prediction."""
    v = lines_view(spark, folder)
    guess = F.expr(CASE_STATUS.replace("idm", "iks").replace("::DOUBLE", "D"))
    return v.select("unit", "status", guess.alias("guess"))


_JUDGED = f"{V}, p AS (SELECT status, {CASE_STATUS.replace('idm', 'iks')} AS guess FROM v)"


@check("ml15_accuracy", f"""WITH {_JUDGED} SELECT
  {rs('avg(CASE WHEN status = guess THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy FROM p""")
def _(spark, folder):
    return r(ev.accuracy(judged(spark, folder), "status", "guess"), "accuracy")


_CLASSES = ", ".join(f"('{s}')" for s in STATUS_ORDER)
_REPORT = f"""{_JUDGED}, t AS (SELECT l.label, (SELECT count(*) FROM p WHERE status = l.label) AS support,
  (SELECT count(*) FROM p WHERE guess = l.label) AS pn, (SELECT count(*) FROM p WHERE status = l.label
  AND guess = l.label) AS tp FROM (VALUES {_CLASSES}) AS l(label)),
  k AS (SELECT label, support, tp, coalesce(tp::DOUBLE / nullif(pn, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall FROM t),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM k)"""


@check("ml16_classification_report", f"""WITH {_REPORT}
  SELECT label, {rs('precision')} AS precision, {rs('recall')} AS recall, {rs('f1')} AS f1, support FROM f
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT {rs('sum(tp)::DOUBLE / sum(support)')} AS a,
  sum(support)::BIGINT AS n FROM f)
  UNION ALL SELECT 'macro avg', {rs('avg(precision)')}, {rs('avg(recall)')}, {rs('avg(f1)')},
  sum(support)::BIGINT FROM f
  UNION ALL SELECT 'weighted avg', {rs('sum(precision * support) / sum(support)')},
  {rs('sum(recall * support) / sum(support)')}, {rs('sum(f1 * support) / sum(support)')},
  sum(support)::BIGINT FROM f""")
def _(spark, folder):
    return r(ev.classification_report(judged(spark, folder), "status", "guess", STATUS_ORDER),
             "precision", "recall", "f1")


@check("ml17_confusion_matrix", f"WITH {_JUDGED} SELECT l.label AS actual, " + ", ".join(
    f"count(*) FILTER (guess = '{s}') AS \"{s}\"" for s in sorted(STATUS_ORDER))
    + f" FROM (VALUES {_CLASSES}) AS l(label) LEFT JOIN p ON status = l.label GROUP BY l.label")
def _(spark, folder):
    return ev.confusion_matrix(judged(spark, folder), "status", "guess", STATUS_ORDER)


# Scenarios: the distinct index triples of the first lines; population: all lines.
def scenarios(spark, folder):
    first = lines_view(spark, folder).filter("n_rec = 1").select(*INDICES).distinct()
    return first.withColumn("scenario", F.concat_ws("/", *[
        F.rint(F.col(c) * 10000).cast("bigint").cast("string") for c in INDICES]))


_S = f"""{V}, s0 AS (SELECT DISTINCT iks, ike, ikl FROM v WHERE n_rec = 1),
  s AS (SELECT *, concat_ws('/', {', '.join(f'round_even({c} * 10000, 0)::BIGINT' for c in INDICES)})
  AS scenario FROM s0)"""


@check("jn5_lookup_explode", f"""WITH {V}, a(dimension, seq, advice) AS (VALUES
  {', '.join(f"('{d}', {n}, '{t}')" for d, n, t in ADVICE)})
  SELECT unit, n_rec, weakest, seq, advice FROM v JOIN a ON weakest = dimension""")
def _(spark, folder):
    v = lines_view(spark, folder).select("unit", "n_rec", "weakest")
    return lookup_explode(v, "weakest", advice_table(spark), "dimension", ["seq", "advice"])


def _features_sql(gap: str) -> str:
    flags = ", ".join(f"(weakest = '{d}')::INT AS weakest_{d}" for d in ("Ekonomi", "Lingkungan", "Sosial"))
    return f"""WITH {_S}, {U}, w AS (SELECT *, {CASE_WEAKEST} AS weakest FROM s)
  SELECT scenario, iks, ike, ikl, {gap.format('iks - ike')} AS gap_e, {gap.format('iks - ikl')} AS gap_l,
  weakest, {flags}, (SELECT median(n_rec) FROM u)::DOUBLE AS n_rec,
  {rs('(SELECT median(total_rec) FROM u)')} AS total_rec,
  {rs('(SELECT median(intensity) FROM u)')} AS intensity FROM w"""


@check("scr1_scenario_features", _features_sql("abs({})"))
def _(spark, folder):
    return r(sc.scenario_features(scenarios(spark, folder), modeling_view(spark, folder), COLS),
             "total_rec", "intensity")


@check("scr1_scenario_features_signed", _features_sql("{}"))
def _(spark, folder):
    return r(sc.scenario_features(scenarios(spark, folder), modeling_view(spark, folder), COLS, signed=True),
             "total_rec", "intensity")


def _pct_sql(c: str) -> str:
    return (f"round_even((SELECT coalesce(sum(cnt), 0) FROM (SELECT {c} AS x, count(*) AS cnt FROM v GROUP BY {c}) h "
            f"WHERE h.x < s.{c})::DOUBLE / (SELECT count(*) FROM v) * 100 * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS {c}_pct")


@check("scr4_benchmark_percentile", f"""WITH {_S} SELECT scenario, iks, ike, ikl,
  {', '.join(_pct_sql(c) for c in INDICES)} FROM s""")
def _(spark, folder):
    return sc.benchmark_percentile(scenarios(spark, folder), lines_view(spark, folder),
                                   {c: f"{c}_pct" for c in INDICES})


@check("scr5_advice", f"""WITH {_S}, a(dimension, seq, advice) AS (VALUES
  {', '.join(f"('{d}', {n}, '{t}')" for d, n, t in ADVICE)}), w AS (SELECT scenario, {CASE_WEAKEST} AS weakest,
  greatest(iks, ike, ikl) - least(iks, ike, ikl) < 0.1::DOUBLE AS balanced FROM s)
  SELECT scenario, weakest, balanced, seq, advice FROM w JOIN a ON weakest = dimension""")
def _(spark, folder):
    from regiometra.operators.features import arg_min_column
    s = scenarios(spark, folder).withColumn("weakest", arg_min_column(COLS.dimension_of))
    return sc.advice(s, "weakest", INDICES).select("scenario", "weakest", "balanced", "seq", "advice")


# Fitted models: their numbers depend on the library, so only rows are checked here and
# properties in the tests. Restarts, trees and iterations are the operators' own.

@check("ml4_kmeans_centroids")
def _(spark, folder):
    return pk.fit_clusters(modeling_view(spark, folder), 4, COLS)[1]


@check("ml5_kmeans_assign")
def _(spark, folder):
    units = modeling_view(spark, folder)
    model, _centers = pk.fit_clusters(units, 4, COLS)
    return model.transform(units).select("unit", *INDICES, "cluster_id", "cluster_label")


@check("ml6_k_sweep")
def _(spark, folder):
    units = units_view(spark, folder)
    scaled = km.standardize(units.select("unit", *INDICES), INDICES)
    return km.k_sweep(scaled, INDICES, "unit", restarts=20)


@check("ml4_centroids_are_means", "SELECT 4::BIGINT AS n_clusters, 0::BIGINT AS n_off")
def _(spark, folder):
    units = modeling_view(spark, folder)
    model, centers = pk.fit_clusters(units, 4, COLS)
    means = model.transform(units).groupBy("cluster_id").agg(*[F.avg(c).alias(f"m_{c}") for c in INDICES])
    off = [F.abs(F.col(c) - F.col(f"m_{c}")) > 1e-9 for c in INDICES]
    return centers.join(means, "cluster_id", "left").agg(
        F.count("*").alias("n_clusters"), F.count_if(F.coalesce(off[0] | off[1] | off[2], F.lit(True))).alias("n_off"))


_SCALED = ", ".join(f"(x.{c} - (SELECT avg({c}) FROM u)) / (SELECT stddev_pop({c}) FROM u) AS {c}" for c in INDICES)
_GAPS = " + ".join(f"p.{c} * p.{c} * g.n - 2 * p.{c} * g.s_{c} + g.q_{c}" for c in INDICES)


@check("ml9_silhouette_fast", f"""WITH {U}, z AS (SELECT x.unit, {GIVEN} AS c, {_SCALED} FROM u x), g AS (SELECT c, count(*) AS n,
  {', '.join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in INDICES)} FROM z GROUP BY c),
  d AS (SELECT p.unit, p.c, g.n, g.c = p.c AS own, {_GAPS} AS total FROM z p, g),
  m AS (SELECT unit, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own THEN total / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN NOT own THEN total / n END) AS b FROM d GROUP BY unit)
  SELECT {rs('avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette_squared FROM m""")
def _(spark, folder):
    given = units_view(spark, folder).withColumn("cluster_id", F.expr(GIVEN))
    value = km.silhouette_fast(km.standardize(given, INDICES), INDICES, "cluster_id")
    return r(spark.createDataFrame([(value,)], "silhouette_squared double"), "silhouette_squared")


def _classified(spark, folder):
    """Every query fits its own models."""
    return pc.classify(modeling_view(spark, folder), COLS)


_TREE_INPUTS, _TREE_DEPTH = [*INDICES, "n_rec", "total_rec"], 5


def _tree_sql() -> str:
    """A tree grown in SQL: at every level the best of all splits of every node, from counts by distinct value."""
    k, names = range(len(STATUS_ORDER)), sorted(STATUS_ORDER)
    label = "CASE status " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"
    steps = [f"r0 AS (SELECT {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(_TREE_INPUTS))}, {label} AS y, 1 AS node FROM u)"]

    def kept(counts: list[str]) -> str:
        return f"({' + '.join(f'{c} * {c}' for c in counts)}) / ({' + '.join(counts)})"

    for d in range(_TREE_DEPTH):
        long = " UNION ALL ".join(f"SELECT node, y, {i} AS f, x{i} AS v FROM r{d}" for i in range(len(_TREE_INPUTS)))
        value = "CASE f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(_TREE_INPUTS))) + " END"
        score = kept([f"l{i}" for i in k]) + " + " + kept([f"(t{i} - l{i})" for i in k])
        steps += [
            f"g{d} AS (SELECT node, f, v, {', '.join(f'count(*) FILTER (y = {i})::DOUBLE AS c{i}' for i in k)} FROM ({long}) GROUP BY node, f, v)",
            f"w{d} AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nxt, "
            + ", ".join(f"sum(c{i}) OVER (PARTITION BY node, f ORDER BY v) AS l{i}, sum(c{i}) OVER (PARTITION BY node, f) AS t{i}" for i in k)
            + f" FROM g{d})",
            f"s{d} AS (SELECT *, {score} AS score FROM w{d} WHERE nxt IS NOT NULL AND greatest({', '.join(f't{i}' for i in k)}) < {' + '.join(f't{i}' for i in k)})",
            f"b{d} AS (SELECT node, f, (v + nxt) / 2 AS cut, {' + '.join(f'l{i}' for i in k)} AS nl, {' + '.join(f't{i} - l{i}' for i in k)} AS nr "
            f"FROM s{d} QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, f, v) = 1)",
            f"r{d + 1} AS (SELECT r.* REPLACE (2 * node + CASE WHEN {value} <= cut THEN 0 ELSE 1 END AS node) FROM r{d} r JOIN b{d} USING (node))"]
    feature = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_TREE_INPUTS)) + " END"
    found = " UNION ALL ".join(f"SELECT node::INTEGER AS node, {feature} AS feature, {rs('cut', 9)} AS threshold, "
                               f"nl::BIGINT AS n_left, nr::BIGINT AS n_right FROM b{d}" for d in range(_TREE_DEPTH))
    return f"WITH {U}, {', '.join(steps)} {found}"


@check("ml11_exact_tree_splits", _tree_sql())
def _(spark, folder):
    from regiometra.operators import exact_tree
    from regiometra.operators.features import encode_label
    from regiometra.session import stage

    units = modeling_view(spark, folder).select(*_TREE_INPUTS, encode_label("status", STATUS_ORDER).alias("label"))
    tree = exact_tree.fit(stage(units, "training"), _TREE_INPUTS, STATUS_ORDER, _TREE_DEPTH)
    return r(tree.table(spark), "threshold", digits=9)


@check("ml11_ml12_ml14_predictions")
def _(spark, folder):
    return _classified(spark, folder).predictions


@check("ml18_feature_importance")
def _(spark, folder):
    return _classified(spark, folder).tables["importance"]


@check("ml19_model_comparison")
def _(spark, folder):
    return _classified(spark, folder).tables["report"]


@check("scr2_score")
def _(spark, folder):
    features = sc.scenario_features(scenarios(spark, folder), modeling_view(spark, folder), COLS)
    return sc.score(_classified(spark, folder).forest, features).select(
        "scenario", "predicted_status", "confidence")


@check("scr3_class_probabilities")
def _(spark, folder):
    features = sc.scenario_features(scenarios(spark, folder), modeling_view(spark, folder), COLS)
    scored = sc.score(_classified(spark, folder).forest, features)
    return sc.class_probabilities(scored, "scenario", STATUS_ORDER)


# What any right fit must satisfy, whatever its numbers, can be said in SQL.

@check("ml5_assigned_to_nearest", f"WITH {U} SELECT count(*) AS n_units, 0::BIGINT AS n_not_nearest FROM u")
def _(spark, folder):
    units = modeling_view(spark, folder)
    model, centers = pk.fit_clusters(units, 4, COLS)
    placed = km.standardize(model.transform(units), INDICES, "_z")
    stats = units.agg(*[f(c).alias(f"{n}_{c}") for c in INDICES for n, f in
                        (("m", F.avg), ("s", F.stddev_pop))])
    scaled = with_scalars(centers, stats).select("cluster_id", *[
        ((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in INDICES])
    table_ = one_row(scaled.agg(F.collect_list(F.struct("cluster_id", *INDICES)).alias("centers")))
    distance = F.transform(F.col("all.centers"), lambda x: F.struct(
        sum((F.pow(F.col(f"{c}_z") - x[c], F.lit(2)) for c in INDICES), F.lit(0.0)).alias("d"),
        x["cluster_id"].alias("id")))
    ranked = placed.withColumn("all", table_).withColumn("ds", distance)
    own = F.filter("ds", lambda x: x["id"] == F.col("cluster_id"))[0]["d"]
    return ranked.agg(F.count("*").alias("n_units"),
                      F.count_if(own > F.array_min(F.transform("ds", lambda x: x["d"])) + 1e-9)
                      .alias("n_not_nearest"))


@check("ml6_ml7_sweep_properties", """SELECT 2 AS k_from, 8 AS k_to, 7::BIGINT AS n_k,
  true AS wcss_falls, true AS scores_valid, true AS best_is_largest""")
def _(spark, folder):
    units = units_view(spark, folder)
    scaled = km.standardize(units.select("unit", *INDICES), INDICES)
    sweep = km.k_sweep(scaled, INDICES, "unit", restarts=20)
    best = km.choose_k(sweep)
    return sweep.agg(
        F.min("k").alias("k_from"), F.max("k").alias("k_to"), F.count("*").alias("n_k"),
        (F.max_by("wcss", "k") < F.min_by("wcss", "k")).alias("wcss_falls"),
        F.bool_and(F.col("silhouette").between(-1, 1)).alias("scores_valid"),
        (F.max_by("k", F.struct("silhouette", -F.col("k"))) == best).alias("best_is_largest"))


@check("ml19_same_test_set", f"""WITH {U}, t AS (SELECT status, round_even(0.2::DOUBLE * count(*), 0)::BIGINT AS n
  FROM u GROUP BY status) SELECT model, status, n FROM t, (VALUES ('decision_tree'), ('random_forest')) AS m(model)""")
def _(spark, folder):
    return _classified(spark, folder).predictions.groupBy("model", "status").agg(F.count("*").alias("n"))


@check("ml18_importance_properties", "SELECT 11::BIGINT AS n_features, 1.0::DOUBLE AS total, true AS none_negative")
def _(spark, folder):
    found = _classified(spark, folder).tables["importance"]
    return r(found.agg(F.count("*").alias("n_features"), F.sum("IMPORTANCE").alias("total"),
                       F.bool_and(F.col("IMPORTANCE") >= 0).alias("none_negative")), "total")


@check("scr3_probability_properties", f"""WITH {_S} SELECT scenario, 5::BIGINT AS n_status,
  1.0::DOUBLE AS total, true AS top_is_prediction FROM s""")
def _(spark, folder):
    features = sc.scenario_features(scenarios(spark, folder), modeling_view(spark, folder), COLS)
    scored = sc.score(_classified(spark, folder).forest, features)
    chances = sc.class_probabilities(scored, "scenario", STATUS_ORDER)
    best = scored.select("scenario", "confidence", "predicted_status")
    joined = chances.join(best, "scenario").groupBy("scenario").agg(
        F.count("*").alias("n_status"), F.sum("probability").alias("total"),
        F.bool_or((F.col("status") == F.col("predicted_status"))
                  & (F.col("probability") == F.col("confidence"))).alias("top_is_prediction"))
    return r(joined, "total")


@check("pl3_segmentation", f"""WITH {U} SELECT count(*) AS n_units, true AS k_is_best, true AS scores_valid,
  true AS sizes_add_up, true AS numbered, true AS mix_is_whole, true AS means_agree FROM u""")
def _(spark, folder):
    units = modeling_view(spark, folder)
    made = pk.segment(units, COLS)
    tables = made.tables
    sizes = tables["sizes"].agg(F.sum("JUMLAH").alias("n_units"), F.count("*").alias("k"))
    best = tables["sweep"].agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best"),
                               F.bool_and(F.col("silhouette").between(-1, 1)).alias("scores_valid"))
    numbers = tables["centroids"].agg(F.array_sort(F.collect_list("cluster_id")).alias("ids"))
    mix = tables["status_mix"].select(sum((F.col(s) for s in STATUS_ORDER), F.lit(0.0)).alias("whole")).agg(
        F.bool_and(F.abs(F.col("whole") - 100) < 1e-9).alias("mix_is_whole"))
    own = made.clustered.groupBy("cluster_id").agg(*[F.avg(c).alias(f"m_{c}") for c in INDICES])
    means = tables["centroids"].join(own, "cluster_id").agg(F.bool_and(
        (F.abs(F.col("iks") - F.col("m_iks")) < 1e-9) & (F.abs(F.col("ike") - F.col("m_ike")) < 1e-9)
        & (F.abs(F.col("ikl") - F.col("m_ikl")) < 1e-9)).alias("means_agree"))
    joined = sizes
    for one in (best, numbers, mix, means):
        joined = with_scalars(joined, one)
    return joined.withColumn("units", F.lit(units.count()).cast("bigint")).select(
        F.col("units").alias("n_units"), (F.col("best") == made.k).alias("k_is_best"),
        (F.col("scores_valid") & F.lit(-1 <= made.silhouette <= 1)).alias("scores_valid"),
        ((F.col("n_units") == F.col("units")) & (F.col("k") == made.k)).alias("sizes_add_up"),
        (F.col("ids") == F.sequence(F.lit(1), F.lit(made.k))).alias("numbered"), "mix_is_whole", "means_agree")


@check("pl6_what_if", f"""WITH {_S}, {U}, a(dimension, seq, advice) AS (VALUES
  {', '.join(f"('{d}', {n}, '{t}')" for d, n, t in ADVICE)}), w AS (SELECT *, {CASE_WEAKEST} AS weakest,
  greatest(iks, ike, ikl) - least(iks, ike, ikl) < 0.1::DOUBLE AS balanced FROM s)
  SELECT scenario, weakest, balanced, seq, advice, {', '.join(_pct_sql(c).replace('FROM v', 'FROM u').replace('s.', 'w.') for c in INDICES)},
  {rs('(SELECT median(total_rec) FROM u)')} AS total_rec FROM w JOIN a ON weakest = dimension""")
def _(spark, folder):
    from regiometra.plans.whatif import what_if

    tables = what_if(scenarios(spark, folder), modeling_view(spark, folder), None, "scenario", COLS)
    ranks = tables["benchmark"].select("scenario", *[f"{c}_pct" for c in INDICES])
    features = tables["features"].select("scenario", "total_rec")
    advice = tables["advice"].select("scenario", "weakest", "balanced", "seq", "advice")
    return r(advice.join(ranks, "scenario").join(features, "scenario"), "total_rec")
