"""Review queries: profiles, cases, features, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions.numbers import hash_key, round_to
from placewise.functions.texts import overlap_share, split_list, split_set
from placewise.operators.filters import active_entities, first_per_key
from placewise.operators.history import last_n
from placewise.operators.sampling import group_validation_split, take_shuffled, with_replacement
from placewise.plans import reviews as plan
from placewise.plans.levels import feature_names
from placewise.session import stage

from . import roles
from .core import draw, hav, key, permuted, query, ratio, rnd
from .roles import part, sql
from .staged import staged

SEED = "reviews"
# The sampled users: 100 test cases, and 1,500 (rating) or 500 (ranking) training users.
N_TEST, N_TRAIN, N_RANK_TRAIN = 100, 1500, 500
CATS = "list_filter(list_transform(string_split({0},','), lambda x: trim(x)), lambda x: x<>'')"


@staged
def reviews(spark, sf):
    return roles.reviews(spark, sf)


@staged
def _test_users(spark, sf):
    return take_shuffled(plan.eligible_users(reviews(spark, sf)), ["user_id"], N_TEST, SEED)


def test_users(spark, sf):
    """The test users; their number is a parameter, so reviews meet them in a broadcast join."""
    return F.broadcast(_test_users(spark, sf))


def train_users(spark, sf, n):
    rest = plan.eligible_users(reviews(spark, sf), without=test_users(spark, sf))
    return F.broadcast(stage(take_shuffled(rest, ["user_id"], n, SEED), "train-users"))


part("eligible", ("reviews",), f"select user_id from reviews group by 1 having count(*)>={plan.MIN_REVIEWS}")
part("rtest", ("eligible",), f"select user_id from eligible order by {key(SEED,'user_id')}, user_id limit {N_TEST}")
part("rtrain", ("eligible", "rtest"), f"""select user_id from eligible where user_id not in (select user_id from rtest)
  order by {key(SEED,'user_id')}, user_id limit {N_TRAIN}""")
part("rranked", ("reviews",), "select *, row_number() over (partition by user_id order by review_date desc, review_id desc) as rn from reviews")
part("biz", ("reviews",), """select business_id, first(business_name order by review_date, review_id) as business_name,
  first(categories order by review_date, review_id) as categories, first(city order by review_date, review_id) as city,
  first(latitude order by review_date, review_id) as latitude, first(longitude order by review_date, review_id) as longitude
  from reviews group by 1""")


@query("active_reviewers", "P3", sql("eligible", "select user_id from eligible"))
def _(spark, sf):
    return plan.eligible_users(reviews(spark, sf))


@query("first_row_per_business", "U4", sql("biz", f"""select business_id, business_name, categories, city, {rnd('latitude',6)} as latitude,
  {rnd('longitude',6)} as longitude from biz"""))
def _(spark, sf):
    rows = reviews(spark, sf).select("business_id", *plan.BUSINESS, *plan.ORDER)
    return first_per_key(rows, ["business_id"], plan.ORDER).select(
        "business_id", "business_name", "categories", "city",
        round_to("latitude", 6).alias("latitude"), round_to("longitude", 6).alias("longitude"),
    )


@query("category_star_profile", "A5 F6",
       sql("reviews", f"""select user_id, category, count(*) as n, {rnd('avg(stars)',1)} as avg_stars from (select user_id, stars,
  unnest({CATS.format('categories')}) as category from reviews) group by all"""))
def _(spark, sf):
    return plan.category_profile(reviews(spark, sf)).select("user_id", "category", "n", "avg_stars")


@query("star_statistics", "A26",
       sql("reviews", f"""select user_id, city, count(*) as n, {rnd('avg(stars)',4)} as mean_stars, {rnd('stddev_pop(stars)',4)} as std_stars
  from reviews group by all"""))
def _(spark, sf):
    return reviews(spark, sf).groupBy("user_id", "city").agg(
        F.count(F.lit(1)).alias("n"), round_to(F.avg("stars"), 4).alias("mean_stars"),
        round_to(F.stddev_pop("stars"), 4).alias("std_stars"),
    )


@query("date_statistics", "A29",
       sql("reviews", f"""select user_id, {rnd('avg(coalesce(gap,0))*count(*)/greatest(count(*)-1,1)',4)} as mean_gap_days,
  {rnd('avg((isodow(review_date)>=6)::int)',4)} as weekend_share from (select *, date_diff('day', lag(review_date) over
  (partition by user_id order by review_date, review_id), review_date) as gap from reviews) group by 1"""))
def _(spark, sf):
    stats = reviews(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.datediff(F.max("review_date"), F.min("review_date")).alias("days"),
        F.avg((F.weekday("review_date") >= 5).cast("double")).alias("w"),
    )
    gap = F.col("days") / F.greatest(F.col("n") - 1, F.lit(1))
    return stats.select("user_id", round_to(gap, 4).alias("mean_gap_days"), round_to("w", 4).alias("weekend_share"))


@query("rating_cases_test", "D6 W6 P3 J10 T4",
       sql("rtest rranked", "select r.user_id||'-'||rn as case_id, r.user_id, review_id, stars from rranked r where rn=1 and user_id in (select user_id from rtest)"))
def _(spark, sf):
    cases, _ = plan.rating_cases(reviews(spark, sf), test_users(spark, sf))
    return cases.select("case_id", "user_id", "review_id", "stars")


@query("rating_cases_train", "D6 W6 J10 T4",
       sql("rtrain rranked", "select r.user_id||'-'||rn as case_id, r.user_id, review_id, stars from rranked r where rn<=3 and user_id in (select user_id from rtrain)"))
def _(spark, sf):
    cases, _ = plan.rating_cases(reviews(spark, sf), train_users(spark, sf, N_TRAIN), all_targets=True)
    return cases.select("case_id", "user_id", "review_id", "stars")


def features_steps(source: str, n_held: int) -> dict[str, str]:
    """Named step ``feats`` for the cases in step ``cs`` (case_id, user_id, business columns)."""
    cats = CATS.format("categories")
    return {
        "rh": f"select *, {cats} as cats from rranked where rn>{n_held} and user_id in (select user_id from cs)",
        "ru": """select user_id, count(*) as n_history, avg(stars) as us, stddev_pop(stars) as ustd, avg((isodow(review_date)>=6)::int) as wk,
  date_diff('day', min(review_date), max(review_date)) as days, avg(latitude) filter (latitude<>0) as ulat,
  avg(longitude) filter (longitude<>0) as ulon from rh group by 1""",
        "rcity": "select user_id, city, count(*) as cn, avg(stars) as cstars, min((review_date,review_id)) as f from rh group by all",
        "rmain": "select user_id, first(city order by cn desc, f) as main_city from rcity group by 1",
        "rcat": f"select user_id, category, count(*) as n, {rnd('avg(stars)',1)} as avg_stars from (select user_id, stars, unnest(cats) as category from rh) group by all",
        "rmatch": f"""select case_id, count(*) as m, avg(avg_stars) as cs_stars, sum(n) as cs_n from (select case_id, user_id,
  unnest(list_distinct({cats})) as category from cs) join rcat using (user_id, category) group by 1""",
        "rrec": f"""select case_id, k, h.stars as stars, len(list_intersect(h.cats, list_distinct({CATS.format('c.categories')})))>0 as hit, h.cats from cs c join (select *, row_number() over (partition by user_id order by review_date desc, review_id desc) as k from rh) h
  on h.user_id=c.user_id and k<=15""",
        "rr": """select case_id, avg(stars) as rs, case when count(*)>1 then stddev_pop(stars) else 0 end as rstd, avg(hit::int) as rm,
  case when count(*)>=3 then regr_slope(stars, -k) else 0 end as slope, coalesce(min(k) filter (not hit)-1, count(*)) as streak,
  len(list_distinct(flatten(list(cats)))) as ncat, avg(stars) filter (k<=5) as l5 from rrec group by 1""",
        "rdist": f"""select case_id, avg(d) as radius, avg((d<=km+1e-9)::int) as rank from (select c.case_id, {hav('ulat','ulon','h.latitude','h.longitude')} as d,
  {hav('ulat','ulon','c.latitude','c.longitude')} as km from cs c join ru using (user_id) join rh h on h.user_id=c.user_id where h.latitude<>0) group by 1""",
        "feats": f"""select c.case_id, c.user_id, n_history, len({cats}) as n_categories, length(business_name) as name_length,
  (c.city=main_city)::int as in_main_city, coalesce(cn,0)/n_history::DOUBLE as city_share, coalesce(cstars,3.0) as city_stars,
  {ratio('coalesce(m,0)', f'len(list_distinct({cats}))')} as cat_overlap, coalesce(cs_stars,us) as cat_stars, coalesce(cs_n,0) as cat_visits,
  us as user_stars, ustd as user_std, rs as recent_stars, rstd as recent_std, rm as recent_match, slope as recent_slope, streak as recent_streak,
  ncat as recent_categories, l5 as last5_stars, {hav('ulat','ulon','c.latitude','c.longitude')} as distance_km_f, radius as mean_radius_km,
  rank as distance_rank, case when n_history>1 then days/(n_history-1)::DOUBLE else 0 end as mean_gap_days, wk as weekend_share
  from cs c join ru on ru.user_id=c.user_id join rmain rm_ on rm_.user_id=c.user_id
  left join rcity rc on rc.user_id=c.user_id and rc.city=c.city left join rmatch using (case_id) join rr using (case_id) join rdist using (case_id)""",
    }


_NAMES = feature_names("rating", "reviews")


def _feature_items(prior: float) -> str:
    return ", ".join(f"{rnd(str(prior) if n == 'prior' else n, 4)} as {n}" for n in _NAMES)


def rating_features(spark, sf):
    cases, history = plan.rating_cases(reviews(spark, sf), test_users(spark, sf))
    return plan.review_features(cases, history, plan.DEFAULT_STARS)


_RATING_CS = "select user_id||'-'||rn as case_id, * from rranked where rn=1 and user_id in (select user_id from rtest)"


@query("rating_features", "V10 A26 A27 A28 A29 W1 W7 F6 F7",
       sql("rtest rranked", f"select case_id, user_id, {_feature_items(3.0)} from feats", cs=_RATING_CS, **features_steps("rtest", 3)))
def _(spark, sf):
    return rating_features(spark, sf).select("case_id", "user_id", *[round_to(c, 4).alias(c) for c in _NAMES])


def _compact_items() -> str:
    return ", ".join(f"{rnd(n, 4)} as {n}" for n in plan.COMPACT)


@query("compact_rating_summary", "V12",
       sql("rtest rranked", f"select case_id, {_compact_items()} from feats", cs=_RATING_CS, **features_steps("rtest", 3)))
def _(spark, sf):
    summary = plan.compact_summary(rating_features(spark, sf))
    return summary.select("case_id", *[round_to(c, 4).alias(c) for c in plan.COMPACT])


part("bcand", ("rtest", "rranked", "biz"), f"""with mine as (select * from rranked where user_id in (select user_id from rtest)),
  idx as (select business_id, row_number() over (order by {key(SEED,'business_id')}, business_id)-1 as pos, count(*) over () as n from biz),
  sized as (select user_id, least(count(distinct business_id)+19, (select max(n) from idx)) as m from mine group by 1),
  probes as (select user_id, {permuted('j','n',SEED,'user_id')} as pos from (select *, unnest(range(m)) as j from sized, (select max(n) as n from idx))),
  neg as (select user_id, business_id, row_number() over (partition by user_id order by {key(SEED,'user_id','business_id')}, business_id) as k
  from probes join idx using (pos) where not exists (select 1 from mine x where x.user_id=probes.user_id and x.business_id=idx.business_id)),
  enough as (select user_id from neg where k=19),
  b as (select user_id, business_id, 1 as label from mine where rn=1 and user_id in (select user_id from enough)
  union all select user_id, business_id, 0 from neg where k<=19 and user_id in (select user_id from enough))
  select *, (row_number() over (partition by user_id order by {key(SEED,'user_id','business_id')}, business_id)-1)::INTEGER as pos,
  user_id||'-'||business_id as case_id from b""")


@staged
def candidates(spark, sf):
    return plan.next_business_cases(reviews(spark, sf), test_users(spark, sf), SEED)[0]


def ranking_history(spark, sf):
    from placewise.operators.history import hold_out

    rows = reviews(spark, sf).join(candidates(spark, sf).select("user_id").distinct(), "user_id", "left_semi")
    return hold_out(stage(rows, "ranking-reviews"), ["user_id"], plan.ORDER, 1)[1]


@query("next_business_cases", "D7 J9 T10 W5 U4 U3",
       sql("bcand", "select user_id, business_id, label, pos from bcand"))
def _(spark, sf):
    return plan.next_business_cases(reviews(spark, sf), test_users(spark, sf), SEED)[0].select(
        "user_id", "business_id", "label", "pos"
    )


@query("next_business_train_users", "D7 J10 T4",
       sql("eligible rtest", f"""select user_id from eligible where user_id not in (select user_id from rtest)
  order by {key(SEED,'user_id')}, user_id limit {N_RANK_TRAIN}"""))
def _(spark, sf):
    return train_users(spark, sf, N_RANK_TRAIN)


_BIZ_CS = "select c.case_id, c.user_id, b.* from bcand c join biz b using (business_id)"


def business_features(spark, sf):
    return plan.review_features(candidates(spark, sf), ranking_history(spark, sf), 0.5)


@query("next_business_features", "V11 A26 A27 A28 A29 W7 F7",
       sql("bcand rranked biz", f"select case_id, user_id, {_feature_items(0.5)} from feats", cs=_BIZ_CS, **features_steps("bcand", 1)))
def _(spark, sf):
    return business_features(spark, sf).select("case_id", "user_id", *[round_to(c, 4).alias(c) for c in _NAMES])


@query("compact_business_summary", "V13",
       sql("bcand rranked biz", f"select case_id, {_compact_items()} from feats", cs=_BIZ_CS, **features_steps("bcand", 1)))
def _(spark, sf):
    summary = plan.compact_summary(business_features(spark, sf))
    return summary.select("case_id", *[round_to(c, 4).alias(c) for c in plan.COMPACT])


@query("listwise_to_pointwise", "D11",
       sql("bcand", "select user_id, business_id, pos, label from bcand"))
def _(spark, sf):
    return plan.pointwise(plan.listwise(candidates(spark, sf)))


@query("validation_cases", "T9",
       sql("bcand", f"""select user_id, business_id, rn <= floor(n*0.15) as is_validation from bcand join (select user_id, row_number() over
  (order by {key('val','user_id')}, user_id) as rn, count(*) over () as n from (select distinct user_id from bcand)) using (user_id)"""))
def _(spark, sf):
    return group_validation_split(candidates(spark, sf), ["user_id"], 0.15, "val").select(
        "user_id", "business_id", "is_validation"
    )


@query("trend_slope_of_recent_stars", "A27 W1",
       sql("rranked", f"""select user_id, {rnd('case when count(*)>=3 then regr_slope(stars,-rn) else 0 end',4)} as slope, count(*) as n
  from rranked where rn<=15 group by 1"""))
def _(spark, sf):
    from placewise.operators.history import array_slope, last_n_array

    recent = last_n_array(reviews(spark, sf), ["user_id"], plan.ORDER, 15, ["stars"], "recent")
    stars = F.transform("recent", lambda r: r["stars"])
    return recent.select(
        "user_id", round_to(array_slope(stars), 4).alias("slope"), F.size("recent").cast("long").alias("n")
    )


@query("streak_of_good_reviews", "W7",
       sql("rranked", "select user_id, coalesce(min(rn) filter (stars<3)-1, count(*)) as streak from rranked where rn<=15 group by 1"))
def _(spark, sf):
    from placewise.operators.history import last_n_array, streak

    recent = last_n_array(reviews(spark, sf), ["user_id"], plan.ORDER, 15, ["stars"], "recent")
    return recent.select("user_id", streak(F.col("recent"), lambda r: r["stars"] >= 3).alias("streak"))


@query("sample_with_replacement", "T7",
       sql("eligible", f"""select (case when n<{10_000} then j else pos end)::INTEGER as draw_no, user_id from (select user_id, n, pos, j from
  (select user_id, row_number() over (order by {key('draw','user_id')}, user_id)-1 as pos, count(*) over () as n from eligible) p
  join range(0,{10_000}) t(j) on pos = {draw('draw','j')} % n where n<{10_000} union all
  select user_id, n, pos, pos from (select user_id, row_number() over (order by {key('draw','user_id')}, user_id)-1 as pos, count(*) over () as n
  from eligible) where n>={10_000} and pos<{10_000})"""))
def _(spark, sf):
    return with_replacement(plan.eligible_users(reviews(spark, sf)), ["user_id"], 10_000, "draw").select("draw_no", "user_id")


@query("category_overlap_ratio", "F6 F7",
       sql("reviews", f"""select review_id, {rnd(ratio("len(list_intersect(list_distinct(" + CATS.format('categories') + "), ['red','small','blue','ring']))", "len(list_distinct(" + CATS.format('categories') + "))"),4)} as share,
  len({CATS.format('categories')}) as n_categories from reviews"""))
def _(spark, sf):
    wanted = F.array(*map(F.lit, ("red", "small", "blue", "ring")))
    return reviews(spark, sf).select(
        "review_id",
        round_to(overlap_share(split_set("categories"), wanted), 4).alias("share"),
        F.size(split_list("categories")).cast("long").alias("n_categories"),
    )
