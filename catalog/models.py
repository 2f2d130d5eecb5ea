"""Model queries: what the data fix about a fit, with SQL twins.

The fitted numbers themselves depend on the learner, so a query gives the counts behind its metrics (rows of every slice, classes,
queries) and truths that hold for every sound fit: an accuracy not below chance, a loss that falls, a planted column that
comes first, contributions that add up. The operators return the metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.numbers import hash_unit
from placewise.operators import contributions as co
from placewise.operators import models as m
from placewise.operators.evaluate import binary_metrics, first_hit_metrics, rank_candidates, regression_metrics
from placewise.plans.levels import LEVELS, enriched_names, feature_names
from placewise.session import stage

from . import evaluation, next_place, pairs, reviews, roles, trips
from .core import query
from .roles import sql
from .staged import staged

KEY = pairs.PAIR
#: Training trips of the duration task: the workload's own size, taken in the shuffled order of the trips.
N_TRAIN_TRIPS = 50_000


#: Pairs of the friendship task: the workload's own 20,000 and 1,000.
N_TRAIN_PAIRS, N_TEST_PAIRS = 20_000, 1_000
TIERS = ("venue_id", "latlng", "enriched")
#: Trees of each fit of a grid, which has up to fifteen of them.
GRID_TREES = 15


@staged
def slices(spark, sf):
    """Training and test pairs with the columns of all tiers."""
    from placewise.plans import friendship as plan

    chosen = stage(plan.friendship_slices(roles.friends(spark, sf), pairs.active(spark, sf), N_TRAIN_PAIRS, N_TEST_PAIRS, pairs.SEED), "slices")
    measured = stage(pairs.measures(spark, sf, chosen.select(*KEY, "label"), True), "slice-measures")
    wide = plan.friendship_features(chosen.select(*KEY, "label"), measured, "enriched")
    cells = plan.friendship_features(chosen.select(*KEY, "label"), measured, "latlng")
    own = [c for c in feature_names("friendship", "latlng") if c not in wide.columns]
    return chosen.select(*KEY, "split").join(wide, KEY).join(cells.select(*KEY, *own), KEY)


def pair_split(spark, sf):
    """Friendship pairs for training and for the test."""
    rows = slices(spark, sf)
    return rows.filter(F.col("split") == "train").drop("split"), rows.filter(F.col("split") == "test").drop("split")


#: Sizes of the slices, told by counting friends and users: n_train, n_total, n_positive.
_SIZES = sql(
    "friends checkins",
    """select (t*20//21+n*20//21)::BIGINT as n_train, (t-t*20//21+n-n*20//21)::BIGINT as n_total, (t-t*20//21)::BIGINT as n_positive from drawn""",
    active=pairs._ACTIVE,
    found="""select (select count(*) from friends where a in (select user_id from active) and b in (select user_id from active)) as p,
  (select count(*) from active) as u""",
    drawn=f"select least(p,{(N_TRAIN_PAIRS + N_TEST_PAIRS) // 2}) as t, least(p,{(N_TRAIN_PAIRS + N_TEST_PAIRS) // 2},u*(u-1)//2-p) as n from found",
)
_TRUE = "true as in_range"
_BINARY = f"select n_train, n_total, n_total as n_valid, n_positive, {_TRUE}, true as as_good_as_chance from ({_SIZES})"


def in_range(*names: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).between(0, 1) for c in names)).alias("in_range")


def as_good_as_chance(n: str = "n_total", positive: str = "n_positive") -> Column:
    """Whether the accuracy is at least the share of the larger class, but for three standard errors."""
    share = F.greatest(F.col(positive), F.col(n) - F.col(positive)) / F.greatest(F.col(n), F.lit(1))
    return (F.col("accuracy") >= share - 1.5 / F.sqrt(F.greatest(F.col(n), F.lit(1)))).alias("as_good_as_chance")


def _binary_check(scored: DataFrame, train: DataFrame) -> DataFrame:
    metrics = binary_metrics(scored).withColumns({"n_positive": F.col("tp") + F.col("fn"), "n_train": F.lit(train.count()).cast("long")})
    return metrics.select(
        "n_train", "n_total", "n_valid", "n_positive", in_range("accuracy", "precision", "recall", "f1"), as_good_as_chance()
    )


@query("boosted_friendship", "M1 M6", _BINARY)
def _(spark, sf):
    train, test = pair_split(spark, sf)
    names = feature_names("friendship", "enriched")
    train = stage(train, "boosted-train")
    model = m.boosted_classifier(train, names, KEY)
    return _binary_check(m.score_binary(model, test, names, [*KEY, "label"]), train)


@query("boosted_next_place", "M1 M8",
       f"with f as ({next_place.features_sql('enriched')}) select split, count(distinct user_id) as n_queries, {_TRUE} from f where label=1 group by 1")
def _(spark, sf):
    rows = stage(next_place.features(spark, sf, "enriched"), "next-place-features")
    names = feature_names("next_place", "enriched")
    model = m.boosted_classifier(rows.filter(F.col("split") == "train"), names, ["user_id"])
    scored = m.score_binary(model, rows, names, ["split", "user_id", "location_id", "label"])
    ranked = rank_candidates(scored, ["user_id"], "score", [F.col("location_id")])
    metrics = first_hit_metrics(ranked, ["user_id"], by=["split"])
    return metrics.select("split", "n_queries", in_range("acc_at_1", "acc_at_5", "mrr"))


@query("boosted_duration", "M2 M9 D9", f"with f as ({trips._duration_sql('enriched')}) select count(*) as n, {_TRUE} from f")
def _(spark, sf):
    names = feature_names("duration", "enriched")
    train = stage(trips.duration_features(spark, sf, "enriched", trips.train(spark, sf), N_TRAIN_TRIPS), "duration-train")
    test = trips.duration_features(spark, sf, "enriched")
    model = m.boosted_regressor(train, names, ["trip_id"], "duration_min")
    scored = m.score_number(model, test, names, ["trip_id", "duration_min"])
    metrics = regression_metrics(scored, "duration_min", "prediction")
    sound = (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-3)
    return metrics.select("n", sound.alias("in_range"))


@query("neural_friendship", "M3 M5 M6", _BINARY)
def _(spark, sf):
    train, test = pair_split(spark, sf)
    names = feature_names("friendship", "enriched")
    train, test = m.standardise(stage(train, "neural-rows"), [test], names)
    train = stage(train, "neural-train")
    model = m.neural_classifier(train, names)
    return _binary_check(m.score_binary(model, test, names, [*KEY, "label"]), train)


_CELLS = {(t, g): feature_names("friendship", t, g) for t in TIERS for g in LEVELS}
_GRID = ", ".join(f"('{t}','{g}',{len(names)})" for (t, g), names in _CELLS.items())


@query("logistic_tiers", "M4 M13",
       f"""select tier, level, n_features::INTEGER as n_features, n_total, n_positive, {_TRUE}, true as as_good_as_chance
  from ({_SIZES}), (values {_GRID}) v(tier, level, n_features)""")
def _(spark, sf):
    """Every tier and level: columns used, test pairs, metrics within range."""
    train, test = pair_split(spark, sf)
    learner = LogisticRegression(maxIter=200, regParam=0.01)
    scored = m.grid(train, test, _CELLS, learner, [*KEY, "label"])
    metrics = binary_metrics(scored, by=["tier", "level", "n_features"]).withColumn("n_positive", F.col("tp") + F.col("fn"))
    return metrics.select(
        "tier", "level", "n_features", "n_total", "n_positive", in_range("accuracy", "precision", "recall", "f1"), as_good_as_chance()
    )


@query("logistic_loss", "M4 M5", f"select n_train, true as falls from ({_SIZES})")
def _(spark, sf):
    """The loss of the fit never rises from one iteration to the next."""
    train, _ = pair_split(spark, sf)
    names = feature_names("friendship", "enriched")
    (train,) = m.standardise(stage(train, "logistic-rows"), [], names)
    train = stage(train, "logistic-train")
    history = m.logistic_classifier(train, names).summary.objectiveHistory
    falls = len(history) > 1 and all(b <= a + 1e-9 for a, b in zip(history, history[1:], strict=False))
    return train.agg(F.count(F.lit(1)).alias("n_train")).withColumn("falls", F.lit(falls))


def _widths(*columns: str) -> str:
    """Level, number of enrichment columns and of all columns, as SQL values."""
    rows = (f"('{g}', {len(enriched_names('friendship', g))}, {len(feature_names('friendship', 'enriched', g))})" for g in LEVELS)
    return f"(values {', '.join(rows)}) v({', '.join(columns)})"


@query("enrichment_ablation", "M15 P10",
       f"""select level, n_enrichment::INTEGER as n_enrichment, n_features::INTEGER as n_features, n_total, {_TRUE} from ({_SIZES}),
  {_widths('level', 'n_enrichment', 'n_features')}""")
def _(spark, sf):
    train, test = (stage(t, "ablation") for t in pair_split(spark, sf))
    tables = [
        m.ablation(train, test, feature_names("friendship", "enriched", g), enriched_names("friendship", g), KEY, g, maxIter=GRID_TREES)
        for g in LEVELS
    ]
    n = test.count()
    gap = F.abs((F.col("acc_with") - F.col("acc_without")) * 100 - F.col("delta_pp")) < 0.02
    sound = in_range("acc_with", "acc_without") & gap
    return reduce(DataFrame.unionByName, tables).select(
        "level", "n_enrichment", "n_features", F.lit(n).cast("long").alias("n_total"), sound.alias("in_range")
    )


#: A column that is the label for nine pairs in ten: a sound measure of importance puts it first.
_PLANTED = [*feature_names("friendship", "enriched"), "planted"]


def with_planted(rows):
    wrong = hash_unit("planted", *KEY) < 0.1
    return rows.withColumn("planted", F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")).cast("double"))


@query("tree_importance", "M16",
       f"select n_train, 'planted' as first, {len(_PLANTED)}::BIGINT as n_features, {len(enriched_names('friendship'))}::BIGINT as n_enrichment, true as sums_to_one from ({_SIZES})")
def _(spark, sf):
    train, _ = pair_split(spark, sf)
    train = stage(with_planted(train), "importance-train")
    model = m.boosted_classifier(train, _PLANTED, KEY, maxIter=50)
    rows = m.importances(model, _PLANTED, enriched_names("friendship"), spark)
    return rows.agg(
        F.lit(train.count()).cast("long").alias("n_train"), F.max_by("name", "importance").alias("first"),
        F.count(F.lit(1)).alias("n_features"), F.count_if("is_enrichment").alias("n_enrichment"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"),
    )


@query("permutation_importance", "M17",
       "select name, name='planted' as is_first from (values " + ", ".join(f"('{n}')" for n in _PLANTED) + ") v(name)")
def _(spark, sf):
    train, test = (stage(with_planted(t), "permutation") for t in pair_split(spark, sf))
    model = m.boosted_classifier(train, _PLANTED, KEY, maxIter=50)
    rows = m.permutation_importance(model, test, _PLANTED, KEY)
    most = rows.agg(F.max("accuracy_drop")).first()[0]
    return rows.select("name", (F.col("accuracy_drop") == F.lit(most)).alias("is_first"))


@query("contributions", "M17 M16",
       f"select n_total as n, 0.0::DOUBLE as largest_gap, 'planted' as first, {len(_PLANTED)}::BIGINT as n_features from ({_SIZES})")
def _(spark, sf):
    """Contributions of all columns to all test pairs add up to the margin; the planted column has the largest mean."""
    train, test = (stage(with_planted(t), "contributions") for t in pair_split(spark, sf))
    model = m.boosted_classifier(train, _PLANTED, KEY, maxIter=50)
    rows = stage(co.contributions(model, test, _PLANTED, KEY), "contribution-rows")
    shares = co.contribution_shares(rows, _PLANTED, enriched_names("friendship"))
    told = shares.agg(F.max_by("name", "importance").alias("first"), F.count(F.lit(1)).alias("n_features")).first()
    return co.largest_gap(rows).select("n", "largest_gap", F.lit(told["first"]).alias("first"), F.lit(told["n_features"]).alias("n_features"))


@query("class_separation", "M18 M5",
       f"select level, full_dims::INTEGER as full_dims, (full_dims-n_enriched)::INTEGER as plain_dims, {_TRUE} from {_widths('level', 'n_enriched', 'full_dims')}")
def _(spark, sf):
    drop = set(enriched_names("friendship"))
    levels = {}
    for g in LEVELS:
        full = feature_names("friendship", "enriched", g)
        levels[g] = (full, [c for c in full if c not in drop])
    table = m.separation_table(evaluation.enriched_pairs(spark, sf), levels, KEY)
    sound = F.col("full_silhouette").between(-1, 1) & F.col("plain_silhouette").between(-1, 1)
    return table.select("level", "full_dims", "plain_dims", sound.alias("in_range"))


# -- learners over tiers and levels ----------------------------------------------


def _level_cells(task: str, tiers) -> dict:
    return {(t, g): feature_names(task, t, g) for t in tiers for g in LEVELS}


def _cells_sql(task: str, tiers) -> str:
    return ", ".join(f"('{t}','{g}',{len(c)})" for (t, g), c in _level_cells(task, tiers).items())


def _ranking_check(scored: DataFrame, case: list[str], item: str) -> DataFrame:
    by = ["tier", "level", "n_features"]
    ranked = rank_candidates(scored, [*by, *case], "score", [F.col(item)])
    metrics = first_hit_metrics(ranked, case, by=by)
    ordered = (F.col("acc_at_1") <= F.col("mrr") + 1e-4) & (F.col("acc_at_1") <= F.col("acc_at_5"))
    return metrics.select(*by, "n_queries", (in_range("acc_at_1", "acc_at_5", "mrr") & ordered).alias("in_range"))


_ZONE_TIERS = ("zone_id", "latlng", "enriched")


def od_rows(spark, sf, cases):
    """Candidates of drop-off ranking with the columns of all tiers, prefixed by the tier where tiers differ in meaning."""
    from placewise.plans import trips as plan

    rows = cases.select("query_id", "candidate_zone", "label")
    for tier in _ZONE_TIERS:
        zones = trips.enriched_zones(spark, sf) if tier == "enriched" else roles.open_zones(spark, sf)
        made = plan.od_ranking_features(cases, trips.stats(spark, sf), zones, tier)
        own = [F.col(c).alias(f"{tier}_{c}") for c in feature_names("od_ranking", tier)]
        rows = rows.join(made.select("query_id", "candidate_zone", *own), ["query_id", "candidate_zone"])
    return rows


@query("boosted_od_ranking", "M1 M8 D8",
       sql("test pool", f"""select tier, level, n_features::INTEGER as n_features, n_queries, {_TRUE} from (select count(*) as n_queries from cases where label=1),
  (values {_cells_sql('od_ranking', _ZONE_TIERS)}) v(tier, level, n_features)""", **trips.cases_sql("test", 20)))
def _(spark, sf):
    """Drop-off ranking: trained on 1,000 queries of the training months, every tier and level."""
    from placewise.plans import trips as plan

    train = plan.od_ranking_cases(trips.train(spark, sf), roles.open_zones(spark, sf), 1000, "train-queries")
    cells = {(t, g): [f"{t}_{c}" for c in names] for (t, g), names in _level_cells("od_ranking", _ZONE_TIERS).items()}
    learner = GBTClassifier(maxIter=GRID_TREES, maxDepth=4, stepSize=0.1, seed=42)
    rows, asked = od_rows(spark, sf, stage(train, "od-train")), od_rows(spark, sf, trips.cases(spark, sf))
    return _ranking_check(m.grid(rows, asked, cells, learner, ["query_id", "candidate_zone", "label"]), ["query_id"], "candidate_zone")


@query("boosted_rating", "M2 M9 D6",
       sql("rtest rranked", f"""select tier, level, n_features::INTEGER as n_features, n, {_TRUE} from (select count(*) as n from cs),
  (values {_cells_sql('rating', ['reviews'])}) v(tier, level, n_features)""", cs=reviews._RATING_CS))
def _(spark, sf):
    """Star rating: trained on three reviews of each of 1,500 training users, every level."""
    from placewise.plans import reviews as plan

    cases, history = plan.rating_cases(reviews.reviews(spark, sf), reviews.train_users(spark, sf, reviews.N_TRAIN), all_targets=True)
    train = plan.review_features(cases, history, plan.DEFAULT_STARS).join(cases.select("case_id", "stars"), "case_id")
    asked, past = plan.rating_cases(reviews.reviews(spark, sf), reviews.test_users(spark, sf))
    test = plan.review_features(asked, past, plan.DEFAULT_STARS).join(asked.select("case_id", "stars"), "case_id")
    learner = GBTRegressor(labelCol="stars", maxIter=GRID_TREES, maxDepth=4, stepSize=0.1, seed=42)
    keep = ["case_id", "stars", *feature_names("rating", "reviews")]
    scored = m.grid(train.select(*keep), test.select(*keep), _level_cells("rating", ["reviews"]), learner, ["case_id", "stars"])
    metrics = regression_metrics(scored, "stars", "prediction", by=["tier", "level", "n_features"])
    sound = (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-3) & in_range("exact", "within_1")
    return metrics.select("tier", "level", "n_features", "n", sound.alias("in_range"))


@query("boosted_next_business", "M1 M8 D7",
       sql("bcand", f"""select tier, level, n_features::INTEGER as n_features, n_queries, {_TRUE} from (select count(*) as n_queries from bcand where label=1),
  (values {_cells_sql('next_business', ['reviews'])}) v(tier, level, n_features)"""))
def _(spark, sf):
    """Next business: trained on the candidates of 500 training users, every level."""
    from placewise.plans import reviews as plan

    cands, history = plan.next_business_cases(reviews.reviews(spark, sf), reviews.train_users(spark, sf, reviews.N_RANK_TRAIN), "train-businesses")
    cands = stage(cands, "business-train")
    keep = ["case_id", "user_id", "business_id", "label", *feature_names("next_business", "reviews")]
    train = plan.review_features(cands, history, 0.5).join(cands.select("case_id", "business_id", "label"), "case_id").select(*keep)
    asked = reviews.candidates(spark, sf)
    test = reviews.business_features(spark, sf).join(asked.select("case_id", "business_id", "label"), "case_id").select(*keep)
    learner = GBTClassifier(maxIter=GRID_TREES, maxDepth=4, stepSize=0.1, seed=42)
    cells = _level_cells("next_business", ["reviews"])
    return _ranking_check(m.grid(train, test, cells, learner, ["user_id", "business_id", "label"]), ["user_id"], "business_id")


@query("duration_grid", "M2 M9 D9",
       f"""with f as ({trips._duration_sql('enriched')}) select tier, level, n_features::INTEGER as n_features, n, {_TRUE} from (select count(*) as n from f),
  (values {_cells_sql('duration', _ZONE_TIERS)}) v(tier, level, n_features)""")
def _(spark, sf):
    """Trip durations: every tier and level."""

    def rows(source, n):
        out = None
        for tier in _ZONE_TIERS:
            made = trips.duration_features(spark, sf, tier, source, n)
            own = made.select("trip_id", *([] if out is not None else ["duration_min"]),
                              *(F.col(c).alias(f"{tier}_{c}") for c in feature_names("duration", tier)))
            out = own if out is None else out.join(own, "trip_id")
        return out

    cells = {(t, g): [f"{t}_{c}" for c in names] for (t, g), names in _level_cells("duration", _ZONE_TIERS).items()}
    learner = GBTRegressor(labelCol="duration_min", maxIter=GRID_TREES, maxDepth=4, stepSize=0.1, seed=42)
    scored = m.grid(rows(trips.train(spark, sf), N_TRAIN_TRIPS), rows(None, trips.N_TRIPS), cells, learner, ["trip_id", "duration_min"])
    metrics = regression_metrics(scored, "duration_min", "prediction", by=["tier", "level", "n_features"])
    sound = (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-3)
    return metrics.select("tier", "level", "n_features", "n", sound.alias("in_range"))
