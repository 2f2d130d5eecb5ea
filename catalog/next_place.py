"""Next-place queries: regional pools, cases, features in three tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions.numbers import round_to
from placewise.operators import profiles as pr
from placewise.operators.evaluate import first_hit_metrics, rank_candidates
from placewise.operators.history import hold_out
from placewise.plans import next_place as plan
from placewise.plans.levels import feature_names

from . import roles
from . import visits as v
from .core import cell, hav, key, permuted, query, region_label, rnd
from .roles import PARTS, part, sql
from .staged import staged

SEED = "places"
N_TRAIN, N_TEST = 1000, 200


def mine(spark, sf):
    return roles.checkins(spark, sf).join(v.covered_users(spark, sf), "user_id", "left_semi")


@staged
def cases(spark, sf):
    return plan.next_place_cases(roles.checkins(spark, sf), v.covered_users(spark, sf), N_TRAIN, N_TEST, SEED)[0]


@staged
def history(spark, sf):
    chosen = cases(spark, sf).select("user_id", "split").distinct()
    _, past = hold_out(mine(spark, sf), ["user_id"], plan.ORDER)
    return past.join(chosen, "user_id")


def train_checkins(spark, sf):
    users = cases(spark, sf).filter(F.col("split") == "train").select("user_id").distinct()
    return mine(spark, sf).join(users, "user_id", "left_semi")


@staged
def history_counts(spark, sf):
    return pr.category_counts(pr.visit_counts(history(spark, sf)), v.categories(spark, sf))


part("mine", ("checkins", "covered"), """select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from checkins where user_id in (select user_id from covered)""")
part("nvenues", ("mine",), """select location_id, first(latitude order by ts, event_id) as lat, first(longitude order by ts, event_id) as lon
  from mine group by 1""")
part("npool", ("mine", "nvenues"), f"""select user_id, m.location_id as truth, s.location_id, s.lat, s.lon,
  row_number() over (partition by user_id order by {cell('s.lat',1)}, {cell('s.lon',1)}, {key(SEED,'s.location_id')}, s.location_id)-1 as pos,
  count(*) over (partition by user_id) as n from mine m join nvenues s on abs({cell('s.lat',1)}-{cell('m.latitude',1)})<=1
  and abs({cell('s.lon',1)}-{cell('m.longitude',1)})<=1 where rn=1""")
part("nready", ("npool",), """select user_id, count(*) filter (location_id<>truth) as n_candidates from npool group by 1""")
part("nchosen", ("nready",), f"""select user_id, case when k<=least(n,{N_TRAIN+N_TEST})*{N_TRAIN}//{N_TRAIN+N_TEST} then 'train' else 'test' end as split
  from (select user_id, row_number() over (order by {key(SEED,'user_id')}, user_id) as k, count(*) over () as n from nready
  where n_candidates>=19) where k<={N_TRAIN+N_TEST}""")
part("ncases", ("nchosen", "npool", "mine"), f"""with probes as (select user_id, n, {permuted('j','n',SEED,'user_id')} as pos
  from (select *, unnest(range(least(20,n))) as j from (select distinct user_id, n from npool) semi join nchosen using (user_id)))
  select split, user_id, location_id, latitude as lat, longitude as lon, 1 as label
  from mine join nchosen using (user_id) where rn=1 union all
  select split, user_id, location_id, lat, lon, 0 from (select *, row_number() over (partition by user_id
  order by {key(SEED,'user_id','location_id')}, location_id) as k from nchosen join npool p using (user_id) join probes using (user_id, pos)
  where location_id<>truth) where k<=19""")
part("hist", ("mine", "nchosen"), "select * exclude (rn) from mine join nchosen using (user_id) where rn>1")
# The profile steps again, over the histories.
for _step in ("centre", "region_of", "profile"):
    _needs, _text = PARTS[_step]
    for _a, _b in (("checkins", "hist"), ("region_of", "hregion"), ("centre c", "hcentre c"), ("join centre", "join hcentre")):
        _text = _text.replace(_a, _b)
    part({"centre": "hcentre", "region_of": "hregion", "profile": "hprofile"}[_step], ("hist",) + (
        () if _step != "profile" else ("hcentre", "hregion")), _text.replace("total_hist", "total_checkins"))
part("hvisited", ("hist", "matched"), "select c.*, m.category from hist c join matched m using (location_id)")
part("hucat", ("hvisited",), PARTS["ucat"][1].replace("visited", "hvisited"))
part("hcprof", ("hucat", "hprofile"), PARTS["cprof"][1].replace("from profile", "from hprofile").replace("ucat", "hucat"))


@query("next_place_pool_size", "J11 F2", sql("nready", "select user_id, n_candidates from nready"))
def _(spark, sf):
    rows = mine(spark, sf)
    last, _ = hold_out(rows, ["user_id"], plan.ORDER)
    last = last.select("user_id", "location_id", "latitude", "longitude")
    return plan.pool_sizes(last, pr.first_points(pr.visit_counts(rows)))


@query("next_place_cases", "D4 J11 W5 T5 U3",
       sql("ncases", f"select split, user_id, location_id, {rnd('lat',6)} as lat, {rnd('lon',6)} as lon, label from ncases"))
def _(spark, sf):
    return cases(spark, sf).withColumns({"lat": round_to("lat", 6), "lon": round_to("lon", 6)})


def features_sql(tier: str) -> str:
    by_cell = tier == "latlng"
    same = (f"{cell('h.latitude',3)}={cell('k.lat',3)} and {cell('h.longitude',3)}={cell('k.lon',3)}" if by_cell
            else "h.location_id=k.location_id")
    item = {
        "user_checkins": "p.total_checkins", "user_places": "p.unique_cells" if by_cell else "p.unique_locations",
        "popularity": "coalesce(pop,0)",
        "in_main_region": f"({cell('k.lat',1)}=p.region_lat and {cell('k.lon',1)}=p.region_lon)::int",
        "distance_to_centre": rnd(hav("p.clat", "p.clon", "k.lat", "k.lon"), 2),
        "geo_spread": "p.geo_spread_km", "active_days_f": "p.active_days", "visited": "(coalesce(vis,0)>0)::int",
        "visits": "coalesce(vis,0)", "distance_to_last": "coalesce(last_km,0)", "recent_min_km": "coalesce(min_km,0)",
        "recent_mean_km": "coalesce(mean_km,0)", "recent_last_km": "coalesce(last_km,0)", "mean_hour": "coalesce(mean_h,12.0)",
        "std_hour": "coalesce(std_h,0)", "mean_visit_hour": "coalesce(vis_h,-1.0)",
        "cat_known": "(kc.category<>'unknown')::int", "cat_in_profile": "(coalesce(cn.n,0)>0)::int",
        "cat_is_top": "coalesce((cp.ranked[1]=kc.category and kc.category<>'unknown')::int,0)", "cat_entropy": "cp.entropy",
        "cat_visits": "coalesce(cn.n,0)", "cat_share": "coalesce(cn.n,0)/greatest(cp.known_visits,1)::DOUBLE",
        "recent_same_cat": "coalesce(same_cat,0)",
    }
    items = ", ".join(f"{rnd(item[n],4)} as {n}" for n in feature_names("next_place", tier))
    own = {
        "k": "select * from ncases",
        "pops": f"select k.user_id, k.location_id, count(*) as pop from k join mine h on {same} where h.user_id in (select user_id from nchosen where split='train') group by all",
        "viss": f"select k.user_id, k.location_id, count(*) as vis, avg(hour(ts)) as vis_h from k join hist h on h.user_id=k.user_id and {same} group by all",
        "near": f"""select k.user_id, k.location_id, min(km) as min_km, avg(km) as mean_km, first(km order by ts desc, event_id desc) as last_km
  from (select k.user_id, k.location_id, h.ts, h.event_id, {hav('h.latitude','h.longitude','k.lat','k.lon')} as km
  from k join (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from hist) h
  on h.user_id=k.user_id and r<=5) k group by all""",
        "hours": """select user_id, avg(hour(ts)) as mean_h, stddev_pop(hour(ts)) as std_h from (select *,
  row_number() over (partition by user_id order by ts desc, event_id desc) as r from hist) where r<=15 group by 1""",
    }
    needs, joins = "ncases mine hist hprofile", ""
    if tier == "enriched":
        needs += " matched hvisited hucat hcprof"
        own["sames"] = """select k.user_id, k.location_id, count(*) as same_cat from k join matched kc using (location_id)
  join (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from hvisited) h
  on h.user_id=k.user_id and r<=15 and h.category=kc.category and kc.category<>'unknown' group by all"""
        joins = """join matched kc on kc.location_id=k.location_id join hcprof cp on cp.user_id=k.user_id
  left join hucat cn on cn.user_id=k.user_id and cn.category=kc.category
  left join sames s on s.user_id=k.user_id and s.location_id=k.location_id"""
    return sql(needs, f"""select k.split, k.user_id, k.location_id, k.label, {items} from k join hprofile p on p.user_id=k.user_id
  left join pops on pops.user_id=k.user_id and pops.location_id=k.location_id
  left join viss on viss.user_id=k.user_id and viss.location_id=k.location_id
  left join near on near.user_id=k.user_id and near.location_id=k.location_id left join hours on hours.user_id=k.user_id {joins}""", **own)


def features(spark, sf, tier: str):
    return plan.next_place_features(
        cases(spark, sf), history(spark, sf), train_checkins(spark, sf), tier,
        v.categories(spark, sf) if tier == "enriched" else None,
        history_counts(spark, sf) if tier == "enriched" else None,
    )


def _register(tier: str, covers: str) -> None:
    @query(f"next_place_features_{tier}", covers, features_sql(tier))
    def _(spark, sf):
        names = feature_names("next_place", tier)
        return features(spark, sf, tier).select(
            "split", "user_id", "location_id", "label", *[round_to(c, 4).alias(c) for c in names]
        )


_register("latlng", "V4 A25 W8 F3")
_register("venue_id", "V4 A25 W8 W1")
_register("enriched", "V5 A25 A6")


@query("next_place_by_popularity", "M8 M19 W9",
       sql("ncases mine nchosen", f"""select split, {rnd('avg((r=1)::int)',4)} as acc_at_1, {rnd('avg((r<=5)::int)',4)} as acc_at_5, {rnd('avg(1.0/r)',4)} as mrr,
  count(*) as n_queries from (select split, label, row_number() over (partition by user_id order by coalesce(pop,0) desc, location_id) as r
  from ncases left join (select location_id, count(*) as pop from mine where user_id in (select user_id from nchosen where split='train')
  group by 1) using (location_id)) where label=1 group by 1"""))
def _(spark, sf):
    counts = train_checkins(spark, sf).groupBy("location_id").agg(F.count(F.lit(1)).alias("popularity"))
    scored = cases(spark, sf).join(counts, "location_id", "left").withColumn("score", F.coalesce("popularity", F.lit(0)))
    ranked = rank_candidates(scored, ["user_id"], "score", [F.col("location_id")])
    return first_hit_metrics(ranked, ["user_id"], by=["split"])
