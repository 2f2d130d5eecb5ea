"""Trip tasks: ranking the drop-off zone, and predicting the duration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import KM_PER_MILE, haversine_km
from placewise.functions.numbers import flag, round_to
from placewise.functions.texts import UNKNOWN
from placewise.operators import trip_stats as ts
from placewise.operators.history import array_mean
from placewise.operators.sampling import keep_per_case, probe, shuffled_position, take_shuffled
from placewise.session import stage

from .levels import feature_names

N_CANDIDATES = 20
_EVERYWHERE = "*"


@dataclass(frozen=True)
class TripStats:
    """Training-trip statistics, one table per key."""

    origins: DataFrame
    destinations: DataFrame
    pairs: DataFrame
    origin_hours: DataFrame
    spread: DataFrame
    recent: DataFrame
    cell_pickups: DataFrame
    cell_dropoffs: DataFrame
    cell_pairs: DataFrame


def trip_stats(train: DataFrame, zones: DataFrame) -> TripStats:
    """All statistics of the training trips. ``zones`` may carry ``primary_category``.

    The trips are read twice: once for the counts, which are written, and once for the last trips.
    """
    counts = stage(ts.trip_counts(train), "trip-counts")
    cells = ts.zone_cells(zones)
    if "primary_category" not in cells.columns:
        cells = cells.withColumn("primary_category", F.lit(UNKNOWN))
    pickups, dropoffs, cell_pairs = ts.cell_counts(counts, zones)
    recent = ts.recent_trips(train, counts=counts)
    # At most five entries per origin are opened, looked up and packed again.
    opened = recent.select("pu_zone", F.posexplode("recent").alias("_k", "_t"))
    there = cells.select(
        F.col("zone_id").alias("_z"), "lat", "lon", "cell_lat", "cell_lon", "primary_category"
    )
    looked_up = opened.withColumn("_z", F.col("_t.do_zone")).join(there, "_z", "left")
    item = F.struct(
        "_k", F.col("_t.do_zone").alias("do_zone"), F.col("_t.duration_min").alias("duration_min"),
        F.col("_t.pickup_hour").alias("pickup_hour"), "lat", "lon", "cell_lat", "cell_lon", "primary_category",
    )
    recent = looked_up.groupBy("pu_zone").agg(F.sort_array(F.collect_list(item)).alias("recent"))
    return TripStats(
        ts.origin_stats(counts),
        ts.destination_stats(counts),
        ts.od_stats(counts),
        ts.origin_hour_stats(counts),
        ts.origin_spread(counts, zones),
        recent,
        pickups,
        dropoffs,
        cell_pairs,
    )


def od_ranking_cases(
    trips: DataFrame, zones: DataFrame, n_queries: int, seed: str, n_candidates: int = N_CANDIDATES
) -> DataFrame:
    """Sampled trips, each with its true drop-off and other zones of the origin's borough.

    Where the borough has too few zones left, the other zones come from all
    boroughs. ``query_id`` keeps several queries of one origin apart.
    """
    wanted = n_candidates - 1
    queries = take_shuffled(trips, ["trip_id"], n_queries, seed).select(
        F.col("trip_id").alias("query_id"), F.col("pu_zone").alias("origin_zone"),
        F.col("do_zone").alias("_truth"), "pickup_hour", "pickup_dow",
    )
    z = zones.select("zone_id", F.coalesce("borough", F.lit("")).alias("_pool"))
    members = z.filter(F.col("_pool") != "").unionByName(z.select("zone_id", F.lit(_EVERYWHERE).alias("_pool")))
    index = shuffled_position(members, ["zone_id"], seed, ["_pool"])
    sizes = index.groupBy("_pool").agg(F.max("pool_size").alias("_n"))
    everywhere = sizes.filter(F.col("_pool") == _EVERYWHERE).select("_n").scalar()
    o = z.select(F.col("zone_id").alias("origin_zone"), F.col("_pool").alias("_home"))
    t = z.select(F.col("zone_id").alias("_truth"), F.col("_pool").alias("_there"))
    q = queries.join(o, "origin_zone", "left").join(t, "_truth", "left")
    q = q.join(sizes.withColumnRenamed("_pool", "_home"), "_home", "left")
    taken = F.lit(1) + F.when(
        (F.col("_there") == F.col("_home")) & (F.col("_truth") != F.col("origin_zone")), 1
    ).otherwise(0)
    local = F.coalesce(F.col("_n") - taken >= wanted, F.lit(False))
    q = q.withColumns(
        {
            "_pool": F.when(local, F.col("_home")).otherwise(F.lit(_EVERYWHERE)),
            "_size": F.when(local, F.col("_n")).otherwise(everywhere),
        }
    )
    # Two more probes than needed: the origin and the true zone may be hit.
    probes = probe(q.drop("_n", "_home", "_there"), ["query_id"], "_size", F.lit(wanted + 2), seed, "pos")
    is_truth = F.col("pos") == -1
    rows = probes.join(index.drop("pool_size"), ["_pool", "pos"], "left")
    rows = rows.withColumns(
        {"candidate_zone": F.when(is_truth, F.col("_truth")).otherwise(F.col("zone_id")), "label": is_truth.cast("int")}
    ).filter(
        is_truth | ((F.col("zone_id") != F.col("_truth")) & (F.col("zone_id") != F.col("origin_zone")))
    )
    return keep_per_case(rows, ["query_id"], ["candidate_zone"], wanted, seed).select(
        "query_id", "origin_zone", "pickup_hour", "pickup_dow", "candidate_zone", "label"
    )


def duration_cases(trips: DataFrame, n: int, seed: str) -> DataFrame:
    """Sampled trips with their target duration."""
    return take_shuffled(trips, ["trip_id"], n, seed).select(
        "trip_id", "pu_zone", "do_zone",
        round_to("duration_min", 2).alias("duration_min"),
        round_to("trip_distance", 3).alias("trip_distance"),
        "pickup_hour", "pickup_dow",
    )


def _zone_side(zones: DataFrame, key: str, prefix: str, enriched: bool) -> DataFrame:
    cells = ts.zone_cells(zones)
    columns = [
        F.col("zone_id").alias(key),
        F.coalesce("borough", F.lit("")).alias(f"{prefix}_borough"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("lat", "lon", "cell_lat", "cell_lon")],
    ]
    if enriched:
        columns += [
            F.col("primary_category").alias(f"{prefix}_cat"),
            F.col("all_categories").alias(f"{prefix}_cats"),
        ]
    return cells.select(*columns)


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("double")


def _list_entropy(categories: str) -> Column:
    """Entropy of a list of distinct names: log2 of its length."""
    n = F.size(categories)
    return F.when(n > 0, F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _same_borough(a: str, b: str) -> Column:
    return flag((F.col(f"{a}_borough") == F.col(f"{b}_borough")) & (F.col(f"{a}_borough") != ""))


def _apart(a: str, b: str) -> Column:
    km = haversine_km(f"{a}_lat", f"{a}_lon", f"{b}_lat", f"{b}_lon")
    return F.coalesce(km, F.lit(0.0))


def od_ranking_features(
    cases: DataFrame, stats: TripStats, zones: DataFrame, tier: str, zone_keyed_cells: bool = False
) -> DataFrame:
    """Feature table of the top level for one tier.

    In the ``latlng`` tier trips are counted per pair of cells. With
    ``zone_keyed_cells`` that count is 0 instead, as it is when cell keys are
    looked up in zone-keyed statistics.
    """
    enriched = tier == "enriched"
    rows = (
        cases.join(_zone_side(zones, "origin_zone", "o", enriched), "origin_zone", "left")
        .join(_zone_side(zones, "candidate_zone", "c", enriched), "candidate_zone", "left")
        .join(stats.origins.withColumnRenamed("pu_zone", "origin_zone"), "origin_zone", "left")
        .join(stats.spread.withColumnRenamed("pu_zone", "origin_zone"), "origin_zone", "left")
        .join(stats.recent.withColumnRenamed("pu_zone", "origin_zone"), "origin_zone", "left")
        .join(
            stats.pairs.withColumnRenamed("pu_zone", "origin_zone").withColumnRenamed("do_zone", "candidate_zone"),
            ["origin_zone", "candidate_zone"],
            "left",
        )
    )
    if tier == "latlng":
        rows = rows.join(
            stats.cell_dropoffs.withColumnsRenamed({"d_lat": "c_cell_lat", "d_lon": "c_cell_lon"}),
            ["c_cell_lat", "c_cell_lon"], "left",
        ).join(
            stats.cell_pairs.withColumnsRenamed(
                {"o_lat": "o_cell_lat", "o_lon": "o_cell_lon", "d_lat": "c_cell_lat", "d_lon": "c_cell_lon"}
            ),
            ["o_cell_lat", "o_cell_lon", "c_cell_lat", "c_cell_lon"], "left",
        )
        near = F.transform(
            F.filter("recent", lambda r: r["cell_lat"].isNotNull()),
            lambda r: F.struct(r["cell_lat"].alias("y"), r["cell_lon"].alias("x")),
        )
        near = F.array_distinct(near)
        n_near = F.coalesce(F.size(near), F.lit(0))
        dropoffs = F.when(n_near > 0, n_near).otherwise(F.coalesce("unique_dropoffs", F.lit(0))).cast("double")
        here = F.struct(F.col("c_cell_lat").alias("y"), F.col("c_cell_lon").alias("x"))
        visited = flag(F.array_contains(near, here))
        popular = _number("dropoffs")
        od_trips = F.lit(0.0) if zone_keyed_cells else _number("cell_od_count")
    else:
        rows = rows.join(
            stats.destinations.withColumnRenamed("do_zone", "candidate_zone"), "candidate_zone", "left"
        )
        dropoffs, popular = _number("unique_dropoffs"), _number("do_count")
        visited, od_trips = flag(F.col("od_count") > 0), _number("od_count")
    km = F.filter(
        F.transform("recent", lambda r: haversine_km(r["lat"], r["lon"], F.col("c_lat"), F.col("c_lon"))),
        lambda d: d.isNotNull(),
    )
    rows = rows.withColumn("_km", km)
    last = F.try_element_at("recent", F.lit(-1))
    zero = F.lit(0.0)
    columns: dict[str, Column] = {
        "origin_trips": _number("pu_count"),
        "origin_dropoffs": dropoffs,
        "popularity": popular,
        "same_borough": _same_borough("o", "c"),
        "distance_km_f": _apart("o", "c"),
        "geo_spread": _number("geo_spread"),
        "active_days_f": _number("active_days"),
        "visited": visited,
        "od_trips": od_trips,
        "distance_to_last": F.coalesce(haversine_km(last["lat"], last["lon"], "c_lat", "c_lon"), zero),
        "recent_min_km": F.coalesce(F.array_min("_km"), zero),
        "recent_mean_km": F.coalesce(array_mean(F.col("_km")), zero),
        "recent_last_km": F.coalesce(F.try_element_at("_km", F.lit(-1)), zero),
        "mean_hour": F.coalesce("mean_hour", F.lit(12.0)),
        "std_hour": F.coalesce("std_hour", zero),
        "mean_od_hour": F.coalesce("avg_hour_od", F.lit(-1.0)),
    }
    if enriched:
        known = F.col("c_cat") != UNKNOWN
        at_origin = F.array_contains("o_cats", F.col("c_cat"))
        same = F.size(F.filter("recent", lambda r: r["primary_category"] == F.col("c_cat")))
        columns |= {
            "origin_cat_known": flag(F.col("o_cat") != UNKNOWN),
            "cand_cat_known": flag(known),
            "cand_cat_at_origin": flag(known & at_origin),
            "origin_cat_entropy": _list_entropy("o_cats"),
            "cand_cat_count": flag(at_origin),
            "cand_cat_share": flag(at_origin) / F.greatest(F.size("o_cats"), F.lit(1)),
            "recent_same_cat": F.when(known & F.col("recent").isNotNull(), same).otherwise(0).cast("double"),
        }
    names = feature_names("od_ranking", tier)
    return rows.select(
        "query_id", "origin_zone", "candidate_zone", "label", *[columns[c].alias(c) for c in names]
    )


def duration_features(
    cases: DataFrame, stats: TripStats, zones: DataFrame, tier: str, zone_keyed_cells: bool = False
) -> DataFrame:
    """Feature table of the top level for one tier.

    ``latlng`` counts pickups at the origin's cell and drop-offs at the
    destination's, and trips per cell pair. With ``zone_keyed_cells`` both ends
    use the drop-off counts and the pair statistics are 0.
    """
    enriched = tier == "enriched"
    rows = (
        cases.join(_zone_side(zones, "pu_zone", "o", enriched), "pu_zone", "left")
        .join(_zone_side(zones, "do_zone", "d", enriched), "do_zone", "left")
        .join(stats.origins.drop("mean_hour", "std_hour"), "pu_zone", "left")
        .join(stats.destinations, "do_zone", "left")
        .join(stats.spread, "pu_zone", "left")
        .join(stats.recent, "pu_zone", "left")
        .join(stats.origin_hours, ["pu_zone", "pickup_hour"], "left")
    )
    if tier == "latlng":
        origin_counts, origin_count = stats.cell_pickups, "pickups"
        if zone_keyed_cells:
            origin_counts = stats.cell_dropoffs.select(
                F.col("d_lat").alias("o_lat"), F.col("d_lon").alias("o_lon"), F.col("dropoffs").alias("pickups")
            )
        keys = {"o_lat": "o_cell_lat", "o_lon": "o_cell_lon", "d_lat": "d_cell_lat", "d_lon": "d_cell_lon"}
        rows = (
            rows.join(origin_counts.withColumnsRenamed(keys), ["o_cell_lat", "o_cell_lon"], "left")
            .join(stats.cell_dropoffs.withColumnsRenamed(keys), ["d_cell_lat", "d_cell_lon"], "left")
            .join(stats.cell_pairs.withColumnsRenamed(keys), list(keys.values()), "left")
        )
        origin_trips, dest_trips = _number(origin_count), _number("dropoffs")
        od_trips, od_mean = _number("cell_od_count"), _number("cell_od_mean_dur")
        if zone_keyed_cells:
            od_trips = od_mean = F.lit(0.0)
    else:
        rows = rows.join(stats.pairs, ["pu_zone", "do_zone"], "left")
        origin_trips, dest_trips = _number("pu_count"), _number("do_count")
        od_trips, od_mean = _number("od_count"), _number("od_mean_dur")
    minutes = F.transform("recent", lambda r: r["duration_min"])
    zero = F.lit(0.0)
    columns: dict[str, Column] = {
        "origin_trips": origin_trips,
        "dest_trips": dest_trips,
        "origin_mean_min": _number("pu_mean_dur"),
        "dest_mean_min": _number("do_mean_dur"),
        "origin_id": F.col("pu_zone").cast("double"),
        "dest_id": F.col("do_zone").cast("double"),
        "same_borough": _same_borough("o", "d"),
        "distance_km_f": _apart("o", "d"),
        "geo_spread": _number("geo_spread"),
        "active_days_f": _number("active_days"),
        "od_trips": od_trips,
        "od_mean_min": od_mean,
        "trip_km": F.coalesce("trip_distance", zero) * KM_PER_MILE,
        "recent_min": F.coalesce(F.array_min(minutes), zero),
        "recent_mean": F.coalesce(array_mean(minutes), zero),
        "recent_last": F.coalesce(F.try_element_at(minutes, F.lit(-1)), zero),
        "hour_f": F.coalesce("pickup_hour", F.lit(12)).cast("double"),
        "dow_f": F.coalesce("pickup_dow", F.lit(0)).cast("double"),
        "hour_mean_min": _number("hour_mean"),
        "hour_std_min": _number("hour_std"),
    }
    if enriched:
        known = F.col("d_cat") != UNKNOWN
        same = F.transform(
            F.filter("recent", lambda r: (r["primary_category"] == F.col("d_cat")) & known),
            lambda r: r["duration_min"],
        )
        columns |= {
            "origin_cat_known": flag(F.col("o_cat") != UNKNOWN),
            "dest_cat_known": flag(known),
            "same_main_cat": flag((F.col("o_cat") == F.col("d_cat")) & (F.col("o_cat") != UNKNOWN)),
            "origin_cat_entropy": _list_entropy("o_cats"),
            "dest_cat_entropy": _list_entropy("d_cats"),
            "shared_cats": F.size(F.array_intersect("o_cats", "d_cats")).cast("double"),
            "recent_same_cat_min": F.coalesce(array_mean(same), zero),
        }
    names = feature_names("duration", tier)
    return rows.select("trip_id", "duration_min", *[columns[c].alias(c) for c in names])
