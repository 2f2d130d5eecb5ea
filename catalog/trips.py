"""Trip queries: cleaning, statistics, cases, features, popularity ranking."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.numbers import round_to
from placewise.operators import trip_stats as ts
from placewise.operators.evaluate import popularity_line
from placewise.operators.filters import clean_trips
from placewise.operators.spatial import zone_categories, zone_category_counts
from placewise.plans import trips as plan
from placewise.plans.levels import feature_names
from placewise.session import stage

from . import roles
from .core import cell, draw, fix, hav, key, permuted, query, rnd
from .roles import part, sql
from .staged import staged

SEED = "od"
N_QUERIES = 200
N_TRIPS = 1000


@staged
def raw(spark: SparkSession, sf: str) -> DataFrame:
    """The trip table, put in the place of monthly trip files."""
    return roles.trips(spark, sf)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_trips(raw(spark, sf), roles.EXCLUDED_ZONES)


# The cheap condition on the time comes first: durations are only worked out for the rows of one side.


def train(spark: SparkSession, sf: str) -> DataFrame:
    before = raw(spark, sf).filter(F.col("pickup_ts") < F.lit(roles.TEST_FROM).cast("timestamp_ntz"))
    return clean_trips(before, roles.EXCLUDED_ZONES)


def test(spark: SparkSession, sf: str) -> DataFrame:
    after = raw(spark, sf).filter(F.col("pickup_ts") >= F.lit(roles.TEST_FROM).cast("timestamp_ntz"))
    return clean_trips(after, roles.EXCLUDED_ZONES)


@staged
def enriched_zones(spark: SparkSession, sf: str) -> DataFrame:
    z = roles.open_zones(spark, sf)
    return zone_categories(z, zone_category_counts(z, roles.zone_pois(spark, sf)))


# -- shared SQL steps --------------------------------------------------------

part("od", ("train",), f"""select pu_zone, do_zone, count(*) as od_count, {rnd('avg(duration_min)',2)} as od_mean_dur,
  {rnd('avg(pickup_hour)',2)} as avg_hour_od from train group by all""")
part("origin", ("train",), f"""select pu_zone, count(*) as pu_count, {rnd('avg(duration_min)',2)} as pu_mean_dur,
  count(distinct do_zone) as unique_dropoffs, count(distinct pickup_date) as active_days,
  {rnd('avg(pickup_hour)',2)} as mean_hour, {rnd('stddev_pop(pickup_hour)',2)} as std_hour from train group by all""")
part("dest", ("train",), f"""select do_zone, count(*) as do_count, {rnd('avg(duration_min)',2)} as do_mean_dur
  from train group by all""")
part("spread", ("train", "zones"), f"""select pu_zone, {rnd('coalesce(stddev_pop(km),0)',4)} as geo_spread from (
  select distinct pu_zone, do_zone, {hav('o.lat','o.lon','d.lat','d.lon')} as km
  from train join zones o on o.zone_id=pu_zone join zones d on d.zone_id=do_zone) group by all""")
part("hourly", ("train",), f"""select pu_zone, pickup_hour, {rnd('avg(duration_min)',2)} as hour_mean,
  {rnd('coalesce(stddev_samp(duration_min),0)',2)} as hour_std from train group by all""")
part("recent5", ("train",), f"""select pu_zone, rn, do_zone, {rnd('duration_min',2)} as duration_min, pickup_hour from (
  select *, row_number() over (partition by pu_zone order by pickup_ts desc, trip_id desc) as rn from train) where rn<=5""")
part("zone_cat_counts", ("open_zones", "zone_pois"), f"""select zone_id, category, count(*) as n, min(poi_id) as first_id
  from open_zones z join zone_pois p on category is not null and {hav('z.lat','z.lon','p.lat','p.lon')} <= 1.0 group by all""")
part("zone_cats", ("open_zones", "zone_cat_counts"), """select z.*, coalesce(main,'unknown') as primary_category,
  coalesce(cats, []) as all_categories, coalesce(n,0)::BIGINT as poi_count from open_zones z left join (
  select zone_id, first(category order by n desc, first_id) as main, list(category order by category) as cats, sum(n) as n
  from zone_cat_counts group by 1) using (zone_id)""")
part("pool", ("open_zones",), f"""select pool, zone_id, row_number() over (partition by pool order by {key(SEED,'zone_id')}, zone_id)-1 as pos,
  count(*) over (partition by pool) as n from (select borough as pool, zone_id from open_zones union all
  select '*', zone_id from open_zones)""")


def cases_sql(source: str, n_candidates: int) -> dict[str, str]:
    """Named steps ending in ``cases``."""
    w = n_candidates - 1
    return {
        "queries": f"select * from {source} order by {key(SEED,'trip_id')}, trip_id limit {N_QUERIES}",
        "sized": f"""select q.trip_id as query_id, pu_zone as origin_zone, do_zone as truth, pickup_hour, pickup_dow,
  case when (select count(*) from open_zones z where z.borough=o.borough and z.zone_id not in (q.pu_zone,q.do_zone)) >= {w}
  then o.borough else '*' end as pool from queries q join open_zones o on o.zone_id=q.pu_zone""",
        "probes": f"""select s.*, {permuted('j','n',SEED,'query_id')} as pos from sized s
  join (select distinct pool, n from pool) using (pool), range(0,{w+2}) t(j) where j < least({w+2},n)""",
        "kept": f"""select *, row_number() over (partition by query_id order by {key(SEED,'query_id','zone_id')}, zone_id) as rn
  from probes join pool using (pool, pos) where zone_id not in (truth, origin_zone)""",
        "cases": f"""select query_id, origin_zone, pickup_hour, pickup_dow, truth as candidate_zone, 1 as label from sized
  union all select query_id, origin_zone, pickup_hour, pickup_dow, zone_id, 0 from kept where rn<={w}""",
    }


# -- cleaning and statistics -------------------------------------------------


@query("trip_cleaning", "P1 P2 P12 S5",
       sql("clean", f"""select trip_id, pu_zone, do_zone, {rnd('duration_min',4)} as duration_min, pickup_hour, pickup_dow,
  pickup_date, {rnd('trip_distance*1.60934',4)} as trip_km from clean"""))
def _(spark, sf):
    return clean(spark, sf).select(
        "trip_id", "pu_zone", "do_zone", round_to("duration_min", 4).alias("duration_min"),
        "pickup_hour", "pickup_dow", "pickup_date",
        round_to(F.col("trip_distance") * plan.KM_PER_MILE, 4).alias("trip_km"),
    )


@staged
def day_counts(spark, sf):
    return ts.trip_counts(train(spark, sf))


@query("od_statistics", "A14 A15 A19 D10", sql("od", "select * from od"))
def _(spark, sf):
    return ts.od_stats(day_counts(spark, sf))


@query("origin_statistics", "A14 A15 A16 A19 D10", sql("origin", "select * from origin"))
def _(spark, sf):
    return ts.origin_stats(day_counts(spark, sf))


@query("destination_statistics", "A14 A15 D10", sql("dest", "select * from dest"))
def _(spark, sf):
    return ts.destination_stats(day_counts(spark, sf))


@query("origin_geo_spread", "A17 D10", sql("spread", "select * from spread"))
def _(spark, sf):
    return ts.origin_spread(day_counts(spark, sf), roles.zones(spark, sf))


@query("origin_hour_statistics", "A18 D10", sql("hourly", "select * from hourly"))
def _(spark, sf):
    return ts.origin_hour_stats(day_counts(spark, sf))


@query("recent_trips_per_origin", "W2 W1 D10",
       sql("recent5", f"""select pu_zone, string_agg(do_zone||':'||{fix('duration_min',2)}||':'||pickup_hour, ' ' order by rn desc) as recent
  from recent5 group by 1"""))
def _(spark, sf):
    from placewise.functions.numbers import fixed

    item = lambda r: F.concat_ws(":", r["do_zone"], fixed(r["duration_min"], 2), r["pickup_hour"])
    return ts.recent_trips(train(spark, sf)).select(
        "pu_zone", F.array_join(F.transform("recent", item), " ").alias("recent")
    )


@query("drop_off_cell_popularity", "A20 F3",
       sql("train zones", f"""select {cell('lat',3)} as cell_lat, {cell('lon',3)} as cell_lon, count(*) as dropoffs
  from train join zones on zone_id=do_zone group by all"""))
def _(spark, sf):
    return ts.cell_counts(day_counts(spark, sf), roles.zones(spark, sf))[1].withColumnsRenamed(
        {"d_lat": "cell_lat", "d_lon": "cell_lon"}
    )


# -- zone categories -----------------------------------------------------------


@query("zone_categories_within_radius", "J4 A21 P8",
       sql("zone_cats", """select zone_id, borough, zone_name, primary_category, array_to_string(all_categories,',') as all_categories,
  poi_count from zone_cats"""))
def _(spark, sf):
    return enriched_zones(spark, sf).select(
        "zone_id", "borough", "zone_name", "primary_category",
        F.array_join("all_categories", ",").alias("all_categories"), "poi_count",
    )


@query("zone_category_summary", "A22",
       sql("zone_cats", """select count(*) as n_zones, count(*) filter (poi_count>0) as n_with_pois, sum(poi_count)::BIGINT as n_pois,
  count(distinct primary_category) as n_main_categories from zone_cats"""))
def _(spark, sf):
    return enriched_zones(spark, sf).agg(
        F.count(F.lit(1)).alias("n_zones"),
        F.count(F.when(F.col("poi_count") > 0, 1)).alias("n_with_pois"),
        F.sum("poi_count").alias("n_pois"),
        F.count_distinct("primary_category").alias("n_main_categories"),
    )


# -- cases and features ----------------------------------------------------------


def build_cases(spark, sf, n_candidates=plan.N_CANDIDATES):
    return plan.od_ranking_cases(test(spark, sf), roles.open_zones(spark, sf), N_QUERIES, SEED, n_candidates)


@staged
def cases(spark, sf):
    return build_cases(spark, sf)


_STATS: dict[tuple[str, str], plan.TripStats] = {}


def stats(spark, sf) -> plan.TripStats:
    """All training statistics, each table written once and read back."""
    key_ = (spark.sparkContext.applicationId, sf)
    if key_ not in _STATS:
        tables = plan.trip_stats(train(spark, sf), enriched_zones(spark, sf))
        names = [f.name for f in fields(plan.TripStats)]
        _STATS[key_] = plan.TripStats(*[stage(getattr(tables, n), f"stats-{n}") for n in names])
    return _STATS[key_]


@query("od_ranking_cases", "D8 J12 T6 U3",
       sql("test pool", "select * from cases", **cases_sql("test", 20)))
def _(spark, sf):
    return build_cases(spark, sf)


@query("od_ranking_cases_within_borough", "D8 J12",
       sql("test pool", "select * from cases", **cases_sql("test", 5)))
def _(spark, sf):
    return build_cases(spark, sf, 5)


@query("drop_off_by_popularity", "M8 M19 W9 A20 D8 D10 J5",
       sql("test pool dest", f"""select {rnd('avg((r=1)::int)',4)} as acc_at_1, {rnd('avg((r<=5)::int)',4)} as acc_at_5,
  {rnd('avg(1.0/r)',4)} as mrr, count(*) as n_queries from (select query_id, min(r) as r from (
  select *, row_number() over (partition by query_id order by coalesce(do_count,0) desc, {key('tie','query_id','candidate_zone')}) as r
  from cases left join dest on do_zone=candidate_zone) where label=1 group by 1)""", **cases_sql("test", 20)))
def _(spark, sf):
    from placewise.functions.numbers import hash_key

    counts = ts.destination_stats(day_counts(spark, sf)).select(
        F.col("do_zone").alias("candidate_zone"), F.col("do_count").alias("popularity")
    )
    tie = [hash_key("tie", "query_id", "candidate_zone")]
    return popularity_line(build_cases(spark, sf), ["query_id"], "candidate_zone", counts, tie)


_RECENT_Z = "recent5 r join {z} on zone_id=r.do_zone"


def _rounded(df: DataFrame, keys: list[str], names: list[str], places: int = 4) -> DataFrame:
    return df.select(*keys, *[round_to(c, places).alias(c) for c in names])


def _od_sql(tier: str) -> str:
    zones = "zone_cats" if tier == "enriched" else "open_zones"
    cells = f"{cell('lat',3)} as cy, {cell('lon',3)} as cx"
    own: dict[str, str] = dict(cases_sql("test", 20))
    own["zc"] = f"select *, {cells} from {zones}"
    own["near"] = f"""select query_id, candidate_zone, min(km) as recent_min_km, avg(km) as recent_mean_km,
  first(km order by rn) as recent_last_km {", sum((r_cat=c_cat and c_cat<>'unknown')::int) as recent_same_cat" if tier=='enriched' else ''}
  from (select query_id, candidate_zone, rn, {hav('z.lat','z.lon','c.lat','c.lon')} as km
  {", z.primary_category as r_cat, c.primary_category as c_cat" if tier=='enriched' else ''}
  from cases join recent5 r on r.pu_zone=origin_zone join zc z on z.zone_id=r.do_zone join zc c on c.zone_id=candidate_zone) group by all"""
    base = {
        "origin_trips": "coalesce(pu_count,0)", "origin_dropoffs": "coalesce(unique_dropoffs,0)",
        "popularity": "coalesce(do_count,0)", "same_borough": "(o.borough=c.borough and o.borough<>'')::int",
        "distance_km_f": hav("o.lat", "o.lon", "c.lat", "c.lon"), "geo_spread": "coalesce(geo_spread,0)",
        "active_days_f": "coalesce(active_days,0)", "visited": "(coalesce(od_count,0)>0)::int",
        "od_trips": "coalesce(od_count,0)", "distance_to_last": "coalesce(recent_last_km,0)",
        "recent_min_km": "coalesce(recent_min_km,0)", "recent_mean_km": "coalesce(recent_mean_km,0)",
        "recent_last_km": "coalesce(recent_last_km,0)", "mean_hour": "coalesce(mean_hour,12.0)",
        "std_hour": "coalesce(std_hour,0)", "mean_od_hour": "coalesce(avg_hour_od,-1.0)",
    }
    joins = ""
    if tier == "latlng":
        own["recent_cells"] = "select distinct pu_zone, cy, cx from recent5 join zc on zone_id=do_zone"
        own["cell_do"] = "select cy, cx, count(*) as n from train join zc on zone_id=do_zone group by all"
        own["cell_od"] = """select a.cy as oy, a.cx as ox, b.cy, b.cx, count(*) as n from train join zc a on a.zone_id=pu_zone
  join zc b on b.zone_id=do_zone group by all"""
        base["origin_dropoffs"] = """case when (select count(*) from recent_cells x where x.pu_zone=origin_zone)>0
  then (select count(*) from recent_cells x where x.pu_zone=origin_zone) else coalesce(unique_dropoffs,0) end"""
        base["popularity"] = "coalesce(cd.n,0)"
        base["visited"] = "exists(select 1 from recent_cells x where x.pu_zone=origin_zone and x.cy=c.cy and x.cx=c.cx)::int"
        base["od_trips"] = "coalesce(co.n,0)"
        joins = """left join cell_do cd on cd.cy=c.cy and cd.cx=c.cx
  left join cell_od co on co.oy=o.cy and co.ox=o.cx and co.cy=c.cy and co.cx=c.cx"""
    if tier == "enriched":
        base |= {
            "origin_cat_known": "(o.primary_category<>'unknown')::int",
            "cand_cat_known": "(c.primary_category<>'unknown')::int",
            "cand_cat_at_origin": "(c.primary_category<>'unknown' and list_contains(o.all_categories,c.primary_category))::int",
            "origin_cat_entropy": "case when len(o.all_categories)>0 then log2(len(o.all_categories)) else 0 end",
            "cand_cat_count": "list_contains(o.all_categories,c.primary_category)::int",
            "cand_cat_share": "list_contains(o.all_categories,c.primary_category)::int/greatest(len(o.all_categories),1)",
            "recent_same_cat": "coalesce(recent_same_cat,0)",
        }
    items = ", ".join(f"{rnd(base[n],4)} as {n}" for n in feature_names("od_ranking", tier))
    return sql(
        f"test pool od origin dest spread recent5 {zones}",
        f"""select query_id, origin_zone, candidate_zone, label, {items} from cases
  join zc o on o.zone_id=origin_zone join zc c on c.zone_id=candidate_zone
  left join origin on origin.pu_zone=origin_zone left join spread on spread.pu_zone=origin_zone
  left join dest on dest.do_zone=candidate_zone left join od on od.pu_zone=origin_zone and od.do_zone=candidate_zone
  left join near using (query_id, candidate_zone) {joins}""",
        **own,
    )


_TIER_COVER = {"latlng": "V6 W8 F1", "zone_id": "V6 W8 J5 F1", "enriched": "V7 W8 A7"}


def _register_od(tier: str) -> None:
    @query(f"od_ranking_features_{tier}", _TIER_COVER[tier], _od_sql(tier))
    def _(spark, sf):
        zones = enriched_zones(spark, sf) if tier == "enriched" else roles.open_zones(spark, sf)
        rows = plan.od_ranking_features(cases(spark, sf), stats(spark, sf), zones, tier)
        names = feature_names("od_ranking", tier)
        return _rounded(rows, ["query_id", "origin_zone", "candidate_zone", "label"], names)


def _duration_sql(tier: str) -> str:
    zones = "zone_cats" if tier == "enriched" else "open_zones"
    own: dict[str, str] = {
        "zc": f"select *, {cell('lat',3)} as cy, {cell('lon',3)} as cx from {zones}",
        "cases": f"""select trip_id, pu_zone, do_zone, {rnd('duration_min',2)} as duration_min, {rnd('trip_distance',3)} as trip_distance,
  pickup_hour, pickup_dow from (select * from test order by {key(SEED,'trip_id')}, trip_id limit {N_TRIPS})""",
        "near": """select pu_zone, min(duration_min) as recent_min, avg(duration_min) as recent_mean,
  first(duration_min order by rn) as recent_last from recent5 group by 1""",
    }
    base = {
        "origin_trips": "coalesce(pu_count,0)", "dest_trips": "coalesce(do_count,0)",
        "origin_mean_min": "coalesce(pu_mean_dur,0)", "dest_mean_min": "coalesce(do_mean_dur,0)",
        "origin_id": "t.pu_zone", "dest_id": "t.do_zone", "same_borough": "(o.borough=d.borough and o.borough<>'')::int",
        "distance_km_f": hav("o.lat", "o.lon", "d.lat", "d.lon"), "geo_spread": "coalesce(geo_spread,0)",
        "active_days_f": "coalesce(active_days,0)", "od_trips": "coalesce(od_count,0)",
        "od_mean_min": "coalesce(od_mean_dur,0)", "trip_km": "trip_distance*1.60934",
        "recent_min": "coalesce(recent_min,0)", "recent_mean": "coalesce(recent_mean,0)",
        "recent_last": "coalesce(recent_last,0)", "hour_f": "t.pickup_hour", "dow_f": "pickup_dow",
        "hour_mean_min": "coalesce(hour_mean,0)", "hour_std_min": "coalesce(hour_std,0)",
    }
    joins = ""
    if tier == "latlng":
        own["cell_pu"] = "select cy, cx, count(*) as n from train join zc on zone_id=pu_zone group by all"
        own["cell_do"] = "select cy, cx, count(*) as n from train join zc on zone_id=do_zone group by all"
        own["cell_od"] = f"""select a.cy as oy, a.cx as ox, b.cy, b.cx, count(*) as n, {rnd('avg(duration_min)',2)} as m from train
  join zc a on a.zone_id=pu_zone join zc b on b.zone_id=do_zone group by all"""
        joins = """left join cell_pu cp on cp.cy=o.cy and cp.cx=o.cx left join cell_do cd on cd.cy=d.cy and cd.cx=d.cx
  left join cell_od co on co.oy=o.cy and co.ox=o.cx and co.cy=d.cy and co.cx=d.cx"""
        base |= {"origin_trips": "coalesce(cp.n,0)", "dest_trips": "coalesce(cd.n,0)",
                 "od_trips": "coalesce(co.n,0)", "od_mean_min": "coalesce(co.m,0)"}
    if tier == "enriched":
        own["same"] = """select trip_id, avg(r.duration_min) as m from cases c join zc d on d.zone_id=c.do_zone join recent5 r
  on r.pu_zone=c.pu_zone join zc z on z.zone_id=r.do_zone where z.primary_category=d.primary_category
  and d.primary_category<>'unknown' group by 1"""
        joins = "left join same using (trip_id)"
        e = "case when len({0}.all_categories)>0 then log2(len({0}.all_categories)) else 0 end"
        base |= {
            "origin_cat_known": "(o.primary_category<>'unknown')::int",
            "dest_cat_known": "(d.primary_category<>'unknown')::int",
            "same_main_cat": "(o.primary_category=d.primary_category and o.primary_category<>'unknown')::int",
            "origin_cat_entropy": e.format("o"), "dest_cat_entropy": e.format("d"),
            "shared_cats": "len(list_intersect(o.all_categories,d.all_categories))",
            "recent_same_cat_min": "coalesce(same.m,0)",
        }
    items = ", ".join(f"{rnd(base[n],4)} as {n}" for n in feature_names("duration", tier))
    return sql(
        f"test od origin dest spread hourly recent5 {zones}",
        f"""select trip_id, t.duration_min, {items} from cases t join zc o on o.zone_id=t.pu_zone join zc d on d.zone_id=t.do_zone
  left join origin on origin.pu_zone=t.pu_zone left join spread on spread.pu_zone=t.pu_zone
  left join dest on dest.do_zone=t.do_zone left join od on od.pu_zone=t.pu_zone and od.do_zone=t.do_zone
  left join hourly on hourly.pu_zone=t.pu_zone and hourly.pickup_hour=t.pickup_hour
  left join near on near.pu_zone=t.pu_zone {joins}""",
        **own,
    )


_DURATION_COVER = {"latlng": "V8 D9 P12", "zone_id": "V8 D9 P12 J5", "enriched": "V9 D9"}


def duration_features(spark, sf, tier, trips=None, n=N_TRIPS):
    zones = enriched_zones(spark, sf) if tier == "enriched" else roles.open_zones(spark, sf)
    chosen = plan.duration_cases(test(spark, sf) if trips is None else trips, n, SEED)
    return plan.duration_features(chosen, stats(spark, sf), zones, tier)


def _register_duration(tier: str) -> None:
    @query(f"duration_features_{tier}", _DURATION_COVER[tier], _duration_sql(tier))
    def _(spark, sf):
        rows = duration_features(spark, sf, tier)
        return _rounded(rows, ["trip_id", "duration_min"], feature_names("duration", tier))


for _tier in ("latlng", "zone_id", "enriched"):
    _register_od(_tier)
    _register_duration(_tier)
