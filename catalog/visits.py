"""Check-in queries: filters, profiles, categories, place matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions.geo import cell_label, haversine_km
from placewise.functions.numbers import fixed, round_to
from placewise.functions.texts import UNKNOWN, category_title
from placewise.operators import profiles as pr
from placewise.operators.filters import active_entities, both_ends, covered_entities
from placewise.operators.history import hold_out, last_n
from placewise.operators.spatial import match_statistics, nearest_category, top_categories
from placewise.plans.friendship import region_sizes
from placewise.session import stage

from . import roles
from .core import cell, fix, hav, query, region_label, rnd
from .roles import part, sql
from .staged import staged

ORDER = ["ts", "event_id"]
MIN_ROWS, MIN_KNOWN = 20, 0.8


@staged
def visits(spark, sf):
    return pr.visit_counts(roles.checkins(spark, sf))


@staged
def profiles(spark, sf):
    return pr.profile_users(visits(spark, sf))


@staged
def categories(spark, sf):
    """Place -> category by nearest categorised POI."""
    return nearest_category(pr.place_points(visits(spark, sf)), roles.pois(spark, sf))


@staged
def counts(spark, sf):
    return pr.category_counts(visits(spark, sf), categories(spark, sf))


@staged
def category_profiles(spark, sf):
    return pr.profile_categories(counts(spark, sf), profiles(spark, sf))


def covered_users(spark, sf):
    known = pr.with_category(visits(spark, sf), categories(spark, sf))
    stats = known.groupBy("user_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("category") != UNKNOWN, F.col("n")).otherwise(0)).alias("known")
    )
    return stats.filter((F.col("n") >= MIN_ROWS) & (F.col("known") / F.col("n") >= MIN_KNOWN)).select("user_id")


# -- shared SQL steps --------------------------------------------------------

part("points", ("checkins",), "select location_id, median(latitude) as lat, median(longitude) as lon from checkins group by 1")
part("matched", ("points", "pois"), f"""select location_id, coalesce(first(category order by km, poi_id), 'unknown') as category,
  first(name order by km, poi_id) as poi_name, {rnd('min(km)*1000',1)} as distance_m
  from (select l.location_id, p.*, {hav('l.lat','l.lon','p.lat','p.lon')} as km from points l
  left join pois p on p.category is not null and {hav('l.lat','l.lon','p.lat','p.lon')} <= 0.05) group by 1""")
part("visited", ("checkins", "matched"), """select c.*, m.category from checkins c join matched m using (location_id)""")
part("centre", ("checkins",), """select user_id, count(*) as total_checkins, count(distinct location_id) as unique_locations,
  count(distinct cast(ts as date)) as active_days, avg(latitude) as clat, avg(longitude) as clon,
  count(distinct (round(latitude*1000)::int, round(longitude*1000)::int)) as unique_cells from checkins group by 1""")
part("region_of", ("checkins",), f"""select user_id, first(cy order by n desc, f) as region_lat, first(cx order by n desc, f) as region_lon
  from (select user_id, {cell('latitude',1)} as cy, {cell('longitude',1)} as cx, count(*) as n, min((ts,event_id)) as f
  from checkins group by all) group by 1""")
part("profile", ("centre", "region_of", "checkins"), f"""select c.*, region_lat, region_lon, {region_label('region_lat','region_lon')} as primary_region,
  geo_spread_km from centre c join region_of using (user_id) join (select user_id, {rnd('sqrt(avg(km*km))',2)} as geo_spread_km
  from (select user_id, {hav('clat','clon','latitude','longitude')} as km from checkins join centre using (user_id)) group by 1) using (user_id)""")
part("ucat", ("visited",), """select user_id, category, count(*) as n, min((ts,event_id)) as f from visited
  where category<>'unknown' group by all""")
part("cprof", ("ucat", "profile"), """select user_id, count(category)::BIGINT as unique_categories, coalesce(sum(n),0)::BIGINT as known_visits,
  coalesce(sum(n)/total_checkins::DOUBLE,0) as known_ratio, coalesce(-sum(s*log2(s)),0) as entropy, coalesce(sum(s*s),0) as concentration,
  list(category order by n desc, f) filter (category is not null) as ranked, list(n order by n desc, f) filter (category is not null) as ranked_n
  from profile left join (select *, n/sum(n) over (partition by user_id)::DOUBLE as s from ucat) using (user_id) group by user_id, total_checkins""")
part("covered", ("visited",), f"""select user_id from visited group by 1 having count(*)>={MIN_ROWS}
  and avg((category<>'unknown')::int)>={MIN_KNOWN}""")

_PROFILE_OUT = ["user_id", "total_checkins", "unique_locations", "unique_cells", "active_days", "geo_spread_km", "primary_region"]


@query("user_profile", "A1 A9 F1 F2 F5",
       sql("profile", f"select {', '.join(_PROFILE_OUT)}, {rnd('clat',6)} as centroid_lat, {rnd('clon',6)} as centroid_lon from profile"))
def _(spark, sf):
    return profiles(spark, sf).select(
        *_PROFILE_OUT, round_to("centroid_lat", 6).alias("centroid_lat"), round_to("centroid_lon", 6).alias("centroid_lon")
    )


@query("history_profile_without_last", "A1 W5 §7.4",
       sql("checkins", f"""select user_id, count(*) as total_checkins, count(distinct location_id) as unique_locations,
  {rnd('avg(latitude)',6)} as centroid_lat from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from checkins) where rn>1 group by 1"""))
def _(spark, sf):
    _, history = hold_out(roles.checkins(spark, sf), ["user_id"], ORDER)
    # Written, as the parts of a profile would each derive it again, all of them side by side in one task.
    return pr.profile_users(pr.visit_counts(stage(history, "history"))).select(
        "user_id", "total_checkins", "unique_locations", round_to("centroid_lat", 6).alias("centroid_lat")
    )


@query("venue_dimension", "A2 S10 U4",
       sql("visited", f"""select location_id, first(category order by ts, event_id) as category, first(location_id::VARCHAR order by ts, event_id) as category_id,
  {rnd('avg(latitude)',6)} as latitude, {rnd('avg(longitude)',6)} as longitude from visited group by 1"""))
def _(spark, sf):
    rows = pr.with_category(roles.checkins(spark, sf), categories(spark, sf))
    rows = rows.withColumn("category_id", F.col("location_id").cast("string"))
    return pr.venue_dimension(rows, ORDER).withColumns(
        {"latitude": round_to("latitude", 6), "longitude": round_to("longitude", 6)}
    )


@query("median_place_point", "A3", sql("points", f"select location_id, {rnd('lat',6)} as lat, {rnd('lon',6)} as lon from points"))
def _(spark, sf):
    return pr.place_points(visits(spark, sf)).select(
        "location_id", round_to("lat", 6).alias("lat"), round_to("lon", 6).alias("lon")
    )


@query("nearest_poi_category", "J3 J2 P8 A3", sql("matched", "select * from matched"))
def _(spark, sf):
    return categories(spark, sf)


@query("category_lookup", "J2 F4",
       sql("visited", """select event_id, category, case when category='unknown' then 'Unknown Venue' else
  array_to_string(list_transform(string_split(category,'_'), lambda w: upper(w[1])||w[2:]),' ') end as title from visited"""))
def _(spark, sf):
    rows = pr.with_category(roles.checkins(spark, sf), categories(spark, sf))
    return rows.select("event_id", "category", category_title("category").alias("title"))


@query("match_rate", "A22",
       sql("matched", f"""select count(*) as n_locations, count(*) filter (category<>'unknown') as n_matched,
  {rnd("count(*) filter (category<>'unknown')*100.0/count(*)",1)} as match_rate_pct from matched"""))
def _(spark, sf):
    return match_statistics(categories(spark, sf))


@query("top_matched_categories", "A22 T2",
       sql("matched", "select category, count(*) as n from matched where category<>'unknown' group by 1 order by n desc, category limit 20"))
def _(spark, sf):
    return top_categories(categories(spark, sf))


@query("user_category_counts", "A4", sql("ucat", "select user_id, category, n from ucat"))
def _(spark, sf):
    return counts(spark, sf).select("user_id", "category", "n")


@query("user_category_profile", "A6 A7 A8 A9 T2",
       sql("cprof", f"""select user_id, unique_categories, known_visits, {rnd('known_ratio',4)} as known_ratio, {rnd('entropy',4)} as entropy,
  {rnd('concentration',4)} as concentration, coalesce(array_to_string(list_transform(range(1, least(len(ranked),5)+1),
  lambda i: ranked[i]||':'||ranked_n[i]),','),'') as top5 from cprof"""))
def _(spark, sf):
    top5 = F.array_join(F.transform("top_categories", lambda t: F.concat_ws(":", t["category"], t["n"])), ",")
    return category_profiles(spark, sf).select(
        "user_id", "unique_categories", "known_visits",
        *[round_to(c, 4).alias(c) for c in ("known_ratio", "entropy", "concentration")], top5.alias("top5"),
    )


@query("active_users", "P3", sql("checkins", f"select user_id from checkins group by 1 having count(*)>={MIN_ROWS}"))
def _(spark, sf):
    return active_entities(roles.checkins(spark, sf), "user_id", MIN_ROWS)


@query("covered_users", "P4", sql("covered", "select user_id from covered"))
def _(spark, sf):
    rows = pr.with_category(roles.checkins(spark, sf), categories(spark, sf))
    return covered_entities(rows, "user_id", F.col("category") != UNKNOWN, MIN_KNOWN, MIN_ROWS)


@query("covered_friend_pairs", "P5 P6",
       sql("friends covered", "select a, b from friends where a in (select user_id from covered) and b in (select user_id from covered)"))
def _(spark, sf):
    return both_ends(roles.friends(spark, sf), covered_users(spark, sf), "user_id", "a", "b")


@query("region_user_counts", "A23",
       sql("profile", "select primary_region, count(*) as n_users from profile group by 1 having count(*)>=5"))
def _(spark, sf):
    return region_sizes(profiles(spark, sf))


@query("place_popularity", "A20", sql("checkins", "select location_id, count(*) as popularity from checkins group by 1"))
def _(spark, sf):
    return pr.popularity(visits(spark, sf), "location_id").withColumn("popularity", F.col("popularity").cast("long"))


@query("cell_popularity", "A20 F3",
       sql("checkins", f"""select printf('%.3f',{cell('latitude',3)}/1000.0::DOUBLE) as cell_lat, printf('%.3f',{cell('longitude',3)}/1000.0::DOUBLE) as cell_lon,
  count(*) as popularity from checkins group by all"""))
def _(spark, sf):
    from placewise.functions.geo import cell as cell_of

    rows = pr.popularity(visits(spark, sf), cell_of("latitude", 3).alias("cy"), cell_of("longitude", 3).alias("cx"))
    return rows.select(cell_label("cy", 3).alias("cell_lat"), cell_label("cx", 3).alias("cell_lon"), "popularity")


@query("last_fifteen_checkins", "W1 T1",
       sql("checkins", """select user_id, event_id, rn from (select *, (row_number() over (partition by user_id
  order by ts desc, event_id desc))::INTEGER as rn from checkins) where rn<=15"""))
def _(spark, sf):
    return last_n(roles.checkins(spark, sf), ["user_id"], ORDER, 15).select("user_id", "event_id", "rn")


@query("hold_out_last_three", "W6 W5",
       sql("checkins", """select event_id, case when rn<=3 then 'held' else 'history' end as part from (select *, row_number() over
  (partition by user_id order by ts desc, event_id desc) as rn from checkins)"""))
def _(spark, sf):
    held, history = hold_out(roles.checkins(spark, sf), ["user_id"], ORDER, 3)
    return held.select("event_id", F.lit("held").alias("part")).unionByName(
        history.select("event_id", F.lit("history").alias("part"))
    )


@query("distance_between_consecutive_checkins", "F1 W8",
       sql("checkins", f"""select event_id, {rnd('coalesce(' + hav('latitude','longitude','plat','plon') + ',0)',4)} as km from (
  select *, lag(latitude) over w as plat, lag(longitude) over w as plon from (select *, row_number() over (partition by user_id
  order by ts desc, event_id desc) as rn from checkins) where rn<=5 window w as (partition by user_id order by ts, event_id))"""))
def _(spark, sf):
    from pyspark.sql import Window

    recent = last_n(roles.checkins(spark, sf), ["user_id"], ORDER, 5)
    w = Window.partitionBy("user_id").orderBy(*ORDER)  # five rows per user
    km = haversine_km("latitude", "longitude", F.lag("latitude").over(w), F.lag("longitude").over(w))
    return recent.select("event_id", round_to(F.coalesce(km, F.lit(0.0)), 4).alias("km"))
