"""Friendship queries: pair measures, cases and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions.numbers import round_to
from placewise.operators import pairs as pp
from placewise.operators.profiles import upper_median
from placewise.operators.sampling import split_bands, take_shuffled
from placewise.plans import friendship as plan
from placewise.plans.levels import feature_names

from . import roles
from . import visits as v
from .core import cell, draw, hav, key, permuted, query, ratio, rnd
from .roles import part, sql
from .staged import staged

PAIR = pp.PAIR
SEED = "friends"
# Half of the 1,000 test pairs are positives.
N_EACH = 500


def friend_pairs(spark, sf):
    return roles.friends(spark, sf).select(F.col("a").alias("user_a"), F.col("b").alias("user_b"))


part("fpairs", ("friends",), "select a as user_a, b as user_b from friends")
part("up", ("checkins",), "select user_id, location_id, count(*) as n from checkins group by all")
part("uc", ("checkins",), f"select user_id, {cell('latitude',3)} as cy, {cell('longitude',3)} as cx, count(*) as n from checkins group by all")


def measures_sql(pairs: str) -> dict[str, str]:
    """Named step ``measures`` over the pairs in step ``pairs``."""
    return {
        "sh": f"""select user_a, user_b, count(*) as shared from (select distinct user_a, user_b from {pairs})
  join up a on a.user_id=user_a join up b on b.user_id=user_b and a.location_id=b.location_id group by all""",
        "shc": f"""select user_a, user_b, count(*) as shared_cells from (select distinct user_a, user_b from {pairs})
  join uc a on a.user_id=user_a join uc b on b.user_id=user_b and a.cy=b.cy and a.cx=b.cx group by all""",
        "co": f"""select user_a, user_b, count(*) as co from (select distinct user_a, user_b from {pairs}) join checkins b on b.user_id=user_b
  where exists (select 1 from checkins a where a.user_id=user_a and a.location_id=b.location_id
  and date_trunc('hour',a.ts)=date_trunc('hour',b.ts)) group by all""",
        "coc": f"""select user_a, user_b, count(*) as coc from (select distinct user_a, user_b from {pairs}) join checkins b on b.user_id=user_b
  where exists (select 1 from checkins a where a.user_id=user_a and {cell('a.latitude',3)}={cell('b.latitude',3)}
  and {cell('a.longitude',3)}={cell('b.longitude',3)} and date_trunc('hour',a.ts)=date_trunc('hour',b.ts)) group by all""",
        "measures": f"""select p.*, coalesce(shared,0) as shared_locations,
  {rnd(ratio('coalesce(shared,0)','a.unique_locations+b.unique_locations-coalesce(shared,0)'),4)} as jaccard_locations,
  {rnd(hav('a.clat','a.clon','b.clat','b.clon'),2)} as centroid_distance_km,
  (a.region_lat=b.region_lat and a.region_lon=b.region_lon)::int as same_region, coalesce(co,0) as temporal_co_occurrences,
  coalesce(shared_cells,0) as shared_cells,
  {rnd(ratio('coalesce(shared_cells,0)','a.unique_cells+b.unique_cells-coalesce(shared_cells,0)'),4)} as jaccard_cells,
  coalesce(coc,0) as temporal_co_cells, a as pa, b as pb from {pairs} p join profile a on a.user_id=user_a join profile b on b.user_id=user_b
  left join sh using (user_a,user_b) left join shc using (user_a,user_b) left join co using (user_a,user_b) left join coc using (user_a,user_b)""",
    }


_MEASURES = ["shared_locations", "jaccard_locations", "centroid_distance_km", "same_region", "temporal_co_occurrences",
             "shared_cells", "jaccard_cells", "temporal_co_cells"]


@query("pair_overlap_measures", "J6 J7 A12 A1 F1 F3",
       sql("fpairs profile up uc", f"select user_a, user_b, {', '.join(_MEASURES)} from measures", **measures_sql("fpairs")))
def _(spark, sf):
    c, vis = roles.checkins(spark, sf), v.visits(spark, sf)
    return pp.pair_features(friend_pairs(spark, sf), c, vis, v.profiles(spark, sf)).select(*PAIR, *_MEASURES)


@query("co_occurrence_within_an_hour", "J7 §7.5-1",
       sql("fpairs checkins", """select user_a, user_b, count(*) as met from fpairs join checkins b on b.user_id=user_b where exists (
  select 1 from checkins a where a.user_id=user_a and a.location_id=b.location_id
  and abs(date_diff('hour', date_trunc('hour',a.ts), date_trunc('hour',b.ts)))<=1) group by all"""))
def _(spark, sf):
    return pp.co_occurrences(friend_pairs(spark, sf), roles.checkins(spark, sf), ["location_id"], "met", 1)


def category_measures_sql(pairs: str) -> dict[str, str]:
    return {
        "up2": "select user_id, location_id, category, count(*) as n from visited group by all",
        "ns": f"""select user_a, user_b, side, category, count(*) as n from (select distinct user_a, user_b from {pairs}), (values ('a'),('b')) s(side)
  join visited c on c.user_id=case side when 'a' then user_a else user_b end where category<>'unknown' and not exists (select 1 from up o
  where o.user_id=case side when 'a' then user_b else user_a end and o.location_id=c.location_id) group by all""",
        "grid": f"""select user_a, user_b, category, coalesce(a.n,0) as na, coalesce(b.n,0) as nb, coalesce(x.n,0) as sa, coalesce(y.n,0) as sb
  from (select distinct user_a, user_b from {pairs}) p cross join (select distinct category from ucat) k
  left join ucat a on a.user_id=user_a and a.category=k.category left join ucat b on b.user_id=user_b and b.category=k.category
  left join ns x on x.user_a=p.user_a and x.user_b=p.user_b and x.side='a' and x.category=k.category
  left join ns y on y.user_a=p.user_a and y.user_b=p.user_b and y.side='b' and y.category=k.category""".replace(
            "select user_a, user_b, category,", "select p.user_a, p.user_b, k.category,"),
        "shares": """select *, na/greatest(sum(na) over w,1)::DOUBLE as p, nb/greatest(sum(nb) over w,1)::DOUBLE as q from grid
  window w as (partition by user_a, user_b)""",
        "cmeasures": f"""select user_a, user_b, count(*) filter (na>0 and nb>0) as shared_categories,
  {rnd(ratio('count(*) filter (na>0 and nb>0)','count(*) filter (na>0 or nb>0)'),4)} as category_jaccard,
  {rnd(ratio('sum(na*nb)','sqrt(sum(na*na)::DOUBLE)*sqrt(sum(nb*nb)::DOUBLE)'),4)} as category_cosine,
  count(*) filter (na>0) as unique_categories_a, count(*) filter (nb>0) as unique_categories_b,
  {rnd(ratio('count(*) filter (sa>0 and sb>0)','count(*) filter (sa>0 or sb>0)'),4)} as non_shared_category_jaccard,
  {rnd(ratio('sum(sa*sb)','sqrt(sum(sa*sa)::DOUBLE)*sqrt(sum(sb*sb)::DOUBLE)'),4)} as non_shared_category_cosine,
  {rnd('coalesce(sum(case when p>0 then p*log2(p/((p+q)/2)) else 0 end + case when q>0 then q*log2(q/((p+q)/2)) else 0 end)/2,0)',4)} as category_js_divergence
  from shares group by all""",
        "call": """select m.*, coalesce((a.ranked[1]=b.ranked[1])::int,0) as same_top_category,
  len(list_intersect(coalesce(a.ranked[1:3],[]), coalesce(b.ranked[1:3],[])))::BIGINT as top3_category_overlap,
  a.entropy as entropy_a, b.entropy as entropy_b, a.concentration as concentration_a, b.concentration as concentration_b
  from cmeasures m join cprof a on a.user_id=user_a join cprof b on b.user_id=user_b""",
    }


_CATEGORY = ["shared_categories", "category_jaccard", "category_cosine", "unique_categories_a", "unique_categories_b",
             "same_top_category", "non_shared_category_jaccard", "non_shared_category_cosine", "category_js_divergence",
             "top3_category_overlap"]


@query("pair_category_measures", "A10 A11 A12 A13 T3 U5",
       sql("fpairs visited up cprof", f"select user_a, user_b, {', '.join(_CATEGORY)} from call", **category_measures_sql("fpairs")))
def _(spark, sf):
    return pp.pair_category_features(
        friend_pairs(spark, sf), v.visits(spark, sf), v.categories(spark, sf), v.counts(spark, sf),
        v.category_profiles(spark, sf),
    ).select(*PAIR, *_CATEGORY)


# -- cases ---------------------------------------------------------------------


def non_friends_sql(group: list[str], n: int) -> dict[str, str]:
    """Steps ``walk`` and ``neg`` over the placed users in step ``idx``: all pairs of a group in the seeded order, no cap."""
    g = "".join(f"{c}, " for c in group)
    place = permuted("j", "pairs", SEED, *(group or ["'all'"]))
    turn = draw(SEED + "o", *group) if group else "0"
    return {
        "pools": f"select {g}max(n)*(max(n)-1)//2 as pairs from idx group by all",
        "walk": f"""select *, {place} as k, {turn} as o
  from (select *, unnest(range(pairs)) as j from pools where pairs>0)""",
        "spots": "select *, k-yy*(yy-1)//2 as xx from (select *, (case when y0*(y0-1)//2>k then y0-1 when y0*(y0+1)//2<=k then y0+1 else y0 end) as yy"
        " from (select *, floor((1+sqrt(1+8*k::DOUBLE))/2)::BIGINT as y0 from walk))",
        "met": f"""select least(x.user_id,y.user_id) as user_a, greatest(x.user_id,y.user_id) as user_b, p.j, p.o
  from spots p join idx x on x.pos=p.xx{''.join(f' and x.{c}=p.{c}' for c in group)}
  join idx y on y.pos=p.yy{''.join(f' and y.{c}=p.{c}' for c in group)}""",
        "neg": f"""select user_a, user_b from met d where not exists (select 1 from friends f where f.a=d.user_a and f.b=d.user_b)
  order by j, o, user_a, user_b limit {n}""",
    }


def cases_sql(users: str, n: int) -> dict[str, str]:
    """Named steps ``pos``, ``neg`` and ``cases`` over the users in step ``users``."""
    return {
        "pos": f"""select a as user_a, b as user_b from friends where a in (select user_id from {users}) and b in (select user_id from {users})
  order by {key(SEED,'a','b')}, a, b limit {n}""",
        "idx": f"select user_id, row_number() over (order by {key(SEED,'user_id')}, user_id)-1 as pos, count(*) over () as n from {users}",
        **non_friends_sql([], n),
        "cases": "select user_a, user_b, 1 as label from pos union all select user_a, user_b, 0 from neg",
    }


_ACTIVE = f"select user_id from checkins group by 1 having count(*)>={v.MIN_ROWS}"


def active(spark, sf):
    from placewise.operators.filters import active_entities

    return active_entities(roles.checkins(spark, sf), "user_id", v.MIN_ROWS)


@query("friendship_cases", "D1 J8 P6 U2 T4",
       sql("friends checkins", "select * from cases", active=_ACTIVE, **cases_sql("active", N_EACH)))
def _(spark, sf):
    return plan.friendship_cases(roles.friends(spark, sf), active(spark, sf), N_EACH, SEED)


@query("friendship_cases_covered", "D2 P4 J8",
       sql("friends covered", "select * from cases", **cases_sql("covered", N_EACH)))
def _(spark, sf):
    return plan.friendship_cases(roles.friends(spark, sf), v.covered_users(spark, sf), N_EACH, SEED)


def hard_cases(spark, sf):
    p = v.profiles(spark, sf).join(v.covered_users(spark, sf), "user_id", "left_semi")
    return plan.hard_friendship_cases(roles.friends(spark, sf), p, N_EACH, SEED)


def hard_cases_sql(n: int) -> dict[str, str]:
    base = cases_sql("people", n)
    return {
        "people": "select * from profile where user_id in (select user_id from covered)",
        "pos": base["pos"],
        "idx": f"""select * from (select user_id, region_lat, region_lon, row_number() over (partition by region_lat, region_lon order by {key(SEED,'user_id')}, user_id)-1 as pos,
  count(*) over (partition by region_lat, region_lon) as n from people) where n>=5""",
        **non_friends_sql(["region_lat", "region_lon"], n),
        "cases": base["cases"],
    }


@query("friendship_cases_same_region", "D3 A23 J8",
       sql("friends profile covered", "select * from cases", **hard_cases_sql(N_EACH)))
def _(spark, sf):
    return hard_cases(spark, sf)


@query("case_distance_by_label", "A24",
       sql("friends profile covered", f"""select label, {rnd('avg(d)',4)} as mean_value, first(d order by d) filter (rn > n//2) as upper_median, max(n) as n
  from (select label, d, row_number() over (partition by label order by d) as rn, count(*) over (partition by label) as n
  from (select label, {rnd(hav('a.clat','a.clon','b.clat','b.clon'),2)} as d from cases join profile a on a.user_id=user_a
  join profile b on b.user_id=user_b)) group by 1""", **hard_cases_sql(N_EACH)))
def _(spark, sf):
    from placewise.functions.geo import haversine_km

    wide = pp.both_profiles(hard_cases(spark, sf), v.profiles(spark, sf), ("centroid_lat", "centroid_lon"))
    km = round_to(haversine_km("centroid_lat_a", "centroid_lon_a", "centroid_lat_b", "centroid_lon_b"), 2)
    stats = upper_median(wide.withColumn("d", km), "label", "d")
    return stats.withColumn("mean_value", round_to("mean_value", 4))


_BANDS = {"test": 100, "train": 200, "ml_test": 150, "ml_train": 300}


@query("disjoint_edge_slices", "T5 T4 T11",
       sql("friends", f"""select a, b, case when rn<=100 then 'test' when rn<=300 then 'train' when rn<=450 then 'ml_test' else 'ml_train' end as split
  from (select *, row_number() over (order by {key('bands','a','b')}, a, b) as rn from friends) where rn<=750"""))
def _(spark, sf):
    return split_bands(roles.friends(spark, sf), ["a", "b"], _BANDS, "bands")


# -- features --------------------------------------------------------------------

_VENUE = {
    "checkins_a": "pa.total_checkins", "checkins_b": "pb.total_checkins", "checkins_sum": "pa.total_checkins+pb.total_checkins",
    "same_region_f": "same_region", "centroid_distance": "centroid_distance_km", "region_match": "(pa.primary_region=pb.primary_region)::int",
    "locations_a": "pa.unique_locations", "locations_b": "pb.unique_locations", "shared_locs": "shared_locations",
    "jaccard_locs": "jaccard_locations", "spread_a": "pa.geo_spread_km", "spread_b": "pb.geo_spread_km",
    "days_a": "pa.active_days", "days_b": "pb.active_days", "co_occurrences": "temporal_co_occurrences",
    "scaled_distance": "centroid_distance_km/greatest(pa.geo_spread_km+pb.geo_spread_km,0.01)",
    "weighted_jaccard": "jaccard_locations*(temporal_co_occurrences+1)",
    "cells_a": "pa.unique_cells", "cells_b": "pb.unique_cells", "shared_cells_f": "shared_cells", "jaccard_cells_f": "jaccard_cells",
    "co_cells": "temporal_co_cells", "weighted_jaccard_cells": "jaccard_cells*(temporal_co_cells+1)",
    "same_top_cat": "same_top_category", "entropy_a": "entropy_a", "entropy_b": "entropy_b", "top3_overlap": "top3_category_overlap",
    "shared_cats": "shared_categories", "cat_jaccard": "category_jaccard", "cats_a": "unique_categories_a", "cats_b": "unique_categories_b",
    "ns_cat_jaccard": "non_shared_category_jaccard", "cat_js": "category_js_divergence", "concentration_a": "concentration_a",
    "concentration_b": "concentration_b", "cat_cosine": "category_cosine", "ns_cat_cosine": "non_shared_category_cosine",
}


def features_sql(tier: str) -> str:
    items = ", ".join(f"{rnd(_VENUE[n],4)} as {n}" for n in feature_names("friendship", tier))
    own = {"active": _ACTIVE} | cases_sql("active", N_EACH) | measures_sql("cases")
    needs, joins = "friends profile up uc", ""
    if tier == "enriched":
        own |= category_measures_sql("cases")
        needs, joins = needs + " visited cprof", "join call using (user_a, user_b)"
    return sql(needs, f"select user_a, user_b, label, {items} from measures {joins}", **own)


@staged
def cases(spark, sf):
    return plan.friendship_cases(roles.friends(spark, sf), active(spark, sf), N_EACH, SEED)


def measures(spark, sf, cases, enriched: bool):
    c, vis, prof = roles.checkins(spark, sf), v.visits(spark, sf), v.profiles(spark, sf)
    if not enriched:
        return plan.pair_measures(cases, c, vis, prof)
    return plan.pair_measures(
        cases, c, vis, prof, v.categories(spark, sf), v.counts(spark, sf), v.category_profiles(spark, sf)
    )


def features(spark, sf, tier: str):
    chosen = cases(spark, sf)
    return plan.friendship_features(chosen, measures(spark, sf, chosen, tier == "enriched"), tier)


def _register(tier: str, covers: str) -> None:
    @query(f"friendship_features_{tier}", covers, features_sql(tier))
    def _(spark, sf):
        names = feature_names("friendship", tier)
        return features(spark, sf, tier).select(*PAIR, "label", *[round_to(c, 4).alias(c) for c in names])


_register("venue_id", "V1 F8")
_register("latlng", "V2 F3 F8")
_register("enriched", "V3 A13 F8")
