"""Text request queries: all context levels of every case, compared as whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions.geo import cell as cell_of, haversine_km
from placewise.functions.numbers import round_to
from placewise.operators import profiles as pr
from placewise.operators import trip_stats as ts
from placewise.operators.history import last_n_array
from placewise.operators.sampling import balanced
from placewise.plans import reviews as rplan
from placewise.plans import texts as tx
from placewise.plans import trips as tplan
from placewise.plans.levels import LEVELS

from . import next_place, pairs, reviews, roles, sessions, trips
from . import visits as v
from .core import cell, fix, hav, key, query, region_label, rnd
from .roles import part, sql
from .staged import staged

NL = "chr(10)"
GAP = f"{NL}||{NL}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def join_sql(parts: list[str], sep: str = GAP) -> str:
    return f"concat_ws({sep}, {', '.join(parts)})"


def title(c: str) -> str:
    return (f"(case when {c}='unknown' then 'Unknown Venue' else array_to_string(list_transform(string_split({c},'_'),"
            " lambda w: upper(w[1])||w[2:]),' ') end)")


def by_level(text, frm: str, keys: str) -> str:
    return " union all ".join(f"select {keys}, '{g}' as level, {text(g)} as text from {frm}" for g in LEVELS)


def _ge(level: str, lowest: str) -> bool:
    return LEVELS.index(level) >= LEVELS.index(lowest)


ISO = "strftime(ts,'%Y-%m-%dT%H:%M:%SZ')"


def lines_sql(tier: str, timed: bool, order: str) -> str:
    where = f"'at ('||{fix('latitude',3 if tier=='latlng' else 4)}||', '||{fix('longitude',3 if tier=='latlng' else 4)}||')'"
    if tier == "venue_id":
        where = f"'Location '||location_id||' '||{where}"
    if tier == "enriched":
        where = f"{title('category')}||' '||{where}"
    if timed:
        where = f"'['||{ISO}||'] '||{where}"
    return f"string_agg('  '||({order})||'. '||{where}, {NL} order by rn desc)"


def recent_step(src: str) -> str:
    """Per user: number of recent check-ins and their lines in all tiers, plain and timed."""
    cols = ", ".join(
        f"{lines_sql(t, timed, 'n-rn+1')} as l_{t}{'_t' if timed else ''}" for t in ("latlng", "venue_id", "enriched") for timed in (False, True)
    )
    short = "string_agg({0}, '; ' order by rn desc)"
    point = f"'('||{fix('latitude',4)}||','||{fix('longitude',4)}||')'"
    return f"""select user_id, count(*) as n_recent, {cols},
  {short.format("'Loc'||location_id||' '||" + point)} as s_venue_id, {short.format("'['||" + ISO + "||'] Loc'||location_id||' '||" + point)} as s_venue_id_t,
  {short.format(title('category') + "||' '||" + point)} as s_enriched, {short.format("'['||" + ISO + "||'] '||" + title('category') + "||' '||" + point)} as s_enriched_t
  from (select *, least(count(*) over (partition by user_id),15) as n from (select *, row_number() over (partition by user_id
  order by ts desc, event_id desc) as rn from {src}) ) where rn<=15 group by 1"""


def shares(c: str) -> str:
    return (f"coalesce(array_to_string(list_transform(range(1,least(len({c}.ranked),5)+1), lambda i: {title(c+'.ranked[i]')}||' ('||"
            f"{fix(c + '.ranked_n[i]*100.0/greatest(' + c + '.known_visits,1)', 0)}||'%)'),', '),'')")


def person(tag: str, owner: str, p: str, c: str, r: str, tier: str, level: str, kinds: bool) -> str:
    n, noun = (f"{p}.unique_cells", "areas") if tier == "latlng" else (f"{p}.unique_locations", "locations")
    if level == "G0":
        return f"({q(tag+': ')}||{p}.total_checkins||' total check-ins across '||{n}||' unique {noun}.')"
    out = [f"{q(tag+' is primarily active in region ')}||{p}.primary_region||'.'"]
    if tier == "enriched":
        out.append(f"case when {shares(c)}<>'' then {q(tag+' frequently visits: ')}||{shares(c)}||'.' end")
    if _ge(level, "G2"):
        k = f"{c}.unique_categories||' venue categories, '||" if tier == "enriched" and kinds else ""
        out.append(f"{q(tag+' statistics: ')}||{p}.total_checkins||' total check-ins, '||{n}||' unique {noun}, '||{k}'geographic spread '||"
                   f"{fix(p+'.geo_spread_km',1)}||' km, active for '||{p}.active_days||' days.'")
    if _ge(level, "G3"):
        out.append(f"{q(owner+' ')}||{r}.n_recent||' check-ins:'||{NL}||{r}.l_{tier}{'_t' if level=='G4' else ''}")
    return join_sql(out, NL)


# -- friendship ------------------------------------------------------------------


@staged
def recent(spark, sf):
    rows = pr.with_category(roles.checkins(spark, sf), v.categories(spark, sf))
    return last_n_array(rows, ["user_id"], v.ORDER, 15, ["ts", "location_id", "latitude", "longitude", "category"], "recent")


@staged
def pair_rows(spark, sf):
    cases = pairs.cases(spark, sf)
    measured = cases.join(pairs.measures(spark, sf, cases, True), pairs.PAIR)
    return tx.friendship_rows(measured, recent(spark, sf), v.category_profiles(spark, sf))


def pair_body(tier: str, level: str) -> str:
    out = [person("User A", "User A recent", "pa", "ca", "ra", tier, level, True),
           person("User B", "User B recent", "pb", "cb", "rb", tier, level, True)]
    if _ge(level, "G2"):
        if tier == "latlng":
            ls = ["'Approximate shared areas: '||shared_cells", f"'Area overlap (Jaccard): '||{fix('jaccard_cells',4)}"]
            met = "'Approximate temporal co-visits (nearby within 1h): '||temporal_co_cells"
        else:
            ls = ["'Shared locations: '||shared_locations", f"'Location Jaccard similarity: '||{fix('jaccard_locations',4)}"]
            met = "'Temporal co-occurrences (same location within 1h): '||temporal_co_occurrences"
        if tier == "enriched":
            ls += ["'Shared venue categories: '||shared_categories", f"'Category similarity (Jaccard): '||{fix('category_jaccard',4)}"]
        ls += [f"'Distance between centroids: '||{fix('centroid_distance_km',1)}||' km'",
               "'Same primary region: '||case when same_region=1 then 'Yes' else 'No' end"]
        if tier == "enriched":
            ls.append("'Same top venue category: '||case when same_top_category=1 then 'Yes' else 'No' end")
        if level == "G4":
            ls.append(met)
        out.append("'Pair statistics:'||" + NL + "||" + join_sql([f"'  - '||{x}" for x in ls], NL))
    return join_sql(out)


_PAIR_NEEDS = "friends profile up uc visited cprof"
_PAIR_FROM = """measures m join call using (user_a, user_b) join cprof ca on ca.user_id=m.user_a join cprof cb on cb.user_id=m.user_b
  join rec ra on ra.user_id=m.user_a join rec rb on rb.user_id=m.user_b"""


def pair_steps() -> dict[str, str]:
    return ({"active": pairs._ACTIVE, "rec": recent_step("visited")} | pairs.cases_sql("active", pairs.N_EACH)
            | pairs.measures_sql("cases") | pairs.category_measures_sql("cases"))


def _register_pairs(tier: str) -> None:
    text = lambda g: join_sql([pair_body(tier, g), q(tx.FRIENDSHIP_QUESTION)])

    @query(f"friendship_texts_{tier}", "X2 F4 F12", sql(_PAIR_NEEDS, by_level(text, _PAIR_FROM, "user_a, user_b, label"), **pair_steps()))
    def _(spark, sf):
        return tx.friendship_texts(pair_rows(spark, sf), ["user_a", "user_b", "label"], tier)


for _tier in ("venue_id", "latlng", "enriched"):
    _register_pairs(_tier)

_SHOTS = 4


@query("few_shot_texts", "X5b T8",
       sql(_PAIR_NEEDS, f"""select t.user_a, t.user_b, t.label, level, concat_ws({NL}, 'Here are '||n||' labeled examples:'||{NL}, shown, '--- Now predict for this new pair ---', text) as text
  from t join (select level, count(*) as n, string_agg('--- Example '||i||' ---'||{NL}||body||{NL}||'Answer: '||case when label=1 then 'Yes' else 'No' end||{NL}, {NL} order by i) as shown
  from (select *, row_number() over (partition by level order by {key('shot','user_a','user_b')}, body) as i from (
  select *, row_number() over (partition by level, label order by {key('shot','user_a','user_b')}, user_a, user_b) as rn from b)
  where rn<={_SHOTS//2}) group by 1) using (level) anti join (select user_a, user_b from (select *, row_number() over (partition by level, label
  order by {key('shot','user_a','user_b')}, user_a, user_b) as rn from b) where rn<={_SHOTS//2}) using (user_a, user_b)""",
           **pair_steps(),
           b=by_level(lambda g: pair_body("enriched", g), _PAIR_FROM, "user_a, user_b, label").replace(" as text", " as body"),
           t=by_level(lambda g: join_sql([pair_body("enriched", g), q(tx.FRIENDSHIP_QUESTION)]), _PAIR_FROM, "user_a, user_b, label")))
def _(spark, sf):
    rows = pair_rows(spark, sf)
    # Every pair that is no example is asked, so no request shows its own answer.
    examples = balanced(rows, "label", pairs.PAIR, _SHOTS, "shot")
    prefix = tx.few_shot_prefix(examples, "enriched", "shot")
    texts = tx.friendship_texts(rows.join(examples.select(*pairs.PAIR), pairs.PAIR, "left_anti"), ["user_a", "user_b", "label"], "enriched")
    return tx.with_few_shots(texts, prefix).select("user_a", "user_b", "label", "level", "text")


def _register_summary(tier: str) -> None:
    def text(g: str) -> str:
        if g == "G0":
            return "'User with '||p.total_checkins||' check-ins'"
        out = ["'Region: '||p.primary_region"]
        if tier == "enriched":
            out.append(f"case when {shares('c')}<>'' then 'Top venues: '||{shares('c')} end")
        if _ge(g, "G2"):
            k = "c.unique_categories||' venue categories, '||" if tier == "enriched" else ""
            out.append(f"'Stats: '||p.total_checkins||' check-ins, '||p.unique_locations||' unique locations, '||{k}'spread '||{fix('p.geo_spread_km',1)}||' km, '||p.active_days||' active days'")
        if _ge(g, "G3"):
            out.append(f"'Recent: '||r.s_{tier}{'_t' if g=='G4' else ''}")
        return join_sql(out, "'. '")

    @query(f"user_summary_texts_{tier}", "X5c",
           sql("profile cprof visited", by_level(text, "profile p join cprof c on c.user_id=p.user_id join rec r on r.user_id=p.user_id", "p.user_id"), rec=recent_step("visited")))
    def _(spark, sf):
        rows = v.profiles(spark, sf).join(v.category_profiles(spark, sf).drop("total_checkins"), "user_id").join(recent(spark, sf), "user_id")
        return tx.one_row_per_level(rows, ["user_id"], lambda g: tx.user_summary(tier, g))


_register_summary("venue_id")
_register_summary("enriched")


# -- next place --------------------------------------------------------------------


@staged
def next_place_rows(spark, sf):
    past = next_place.history(spark, sf)
    visits = pr.visit_counts(past)
    profile = pr.profile_users(visits)
    counts = next_place.history_counts(spark, sf)
    cats = v.categories(spark, sf)
    rows = next_place.cases(spark, sf).withColumns({"_cy": cell_of("lat", 3), "_cx": cell_of("lon", 3)})
    at_place = past.groupBy("user_id", "location_id").agg(F.count(F.lit(1)).alias("place_visits"))
    at_cell = past.groupBy("user_id", cell_of("latitude", 3).alias("_cy"), cell_of("longitude", 3).alias("_cx")).agg(
        F.count(F.lit(1)).alias("cell_visits"))
    latest = last_n_array(pr.with_category(past, cats), ["user_id"], v.ORDER, 15,
                          ["ts", "location_id", "latitude", "longitude", "category"], "recent")
    own = counts.select("user_id", "category", F.col("n").alias("cat_n"))
    rows = (
        pr.with_category(rows, cats).join(profile, "user_id")
        .join(pr.profile_categories(counts, profile).drop("total_checkins"), "user_id")
        .join(at_place, ["user_id", "location_id"], "left").join(at_cell, ["user_id", "_cy", "_cx"], "left")
        .join(own, ["user_id", "category"], "left").join(latest, "user_id")
    )
    centre = round_to(haversine_km("centroid_lat", "centroid_lon", "lat", "lon"), 2)
    return rows.withColumn("centre_km", centre).fillna(0, ["place_visits", "cell_visits", "cat_n"]).drop("_cy", "_cx")


def _register_next(tier: str) -> None:
    by_cell = tier == "latlng"
    visits = "cell_visits" if by_cell else "place_visits"
    place = "area" if by_cell else "venue"

    def text(g: str) -> str:
        if by_cell:
            cand = f"'Candidate venue at ('||{fix('k.lat',3)}||', '||{fix('k.lon',3)}||').'"
        else:
            name = "'Location '||k.location_id"
            if tier == "enriched":
                name = f"{title('kc.category')}||' ('||{name}||')'"
            cand = f"'Candidate: '||{name}||' at ('||{fix('k.lat',4)}||', '||{fix('k.lon',4)}||').'"
        out = [person("User", "User's recent", "p", "c", "r", tier, g, False), cand]
        if g != "G0":
            ls = [f"'Candidate is '||case when {region_label(cell('k.lat',1),cell('k.lon',1))}=p.primary_region then 'in' else 'outside' end||' user''s primary region.'",
                  f"'Distance from user''s center of activity: '||{fix(rnd(hav('p.clat','p.clon','k.lat','k.lon'),2),1)}||' km.'"]
            if _ge(g, "G2"):
                ls.append(f"case when coalesce({visits},0)>0 then 'User has visited this {place} '||{visits}||' time(s) before.' else 'User has never visited this {place}.' end")
                if tier == "enriched":
                    share = fix("coalesce(cn.n,0)*100.0/greatest(c.known_visits,1)", 0)
                    ls.append(f"case when kc.category<>'unknown' then 'User has visited '||{title('kc.category')}||' venues '||coalesce(cn.n,0)||' time(s) ('||{share}||'% of check-ins).' end")
            out.append(join_sql(ls, NL))
        return join_sql([*out, q(tx.NEXT_PLACE_QUESTION)])

    frm = """k join hprofile p on p.user_id=k.user_id join hcprof c on c.user_id=k.user_id join rec r on r.user_id=k.user_id
  join matched kc on kc.location_id=k.location_id left join hucat cn on cn.user_id=k.user_id and cn.category=kc.category
  left join vp on vp.user_id=k.user_id and vp.location_id=k.location_id left join vc on vc.user_id=k.user_id and vc.location_id=k.location_id"""

    @query(f"next_place_texts_{tier}", "X3 F12",
           sql("ncases hist hprofile hcprof hucat hvisited matched", by_level(text, frm, "k.user_id, k.location_id, k.label"),
               k="select * from ncases", rec=recent_step("hvisited"),
               vp="select user_id, location_id, count(*) as place_visits from hist group by all",
               vc=f"""select k.user_id, k.location_id, count(*) as cell_visits from k join hist h on h.user_id=k.user_id and {cell('h.latitude',3)}={cell('k.lat',3)}
  and {cell('h.longitude',3)}={cell('k.lon',3)} group by all"""))
    def _(spark, sf):
        rows = next_place_rows(spark, sf).withColumn("visits", F.col(visits))
        return tx.next_place_texts(rows, ["user_id", "location_id", "label"], tier)


for _tier in ("venue_id", "latlng", "enriched"):
    _register_next(_tier)


# -- trips ---------------------------------------------------------------------------


def zone_text(z: str, zone: str, tier: str) -> str:
    out = [f"'Zone '||{zone}||' ('||coalesce({z}.borough,'Unknown')||')'"]
    if tier == "enriched":
        names = f"array_to_string(list_transform({z}.all_categories[1:5], lambda x: {title('x')}),', ')"
        out += [f"case when {z}.primary_category<>'unknown' then 'Primary category: '||{title(z+'.primary_category')} end",
                f"case when {z}.primary_category<>'unknown' and len({z}.all_categories[1:5])>1 then 'Nearby POIs: '||{names} end"]
    return join_sql(out, "'. '")


def _grouped(x: str) -> str:
    return f"format('{{:,}}', coalesce({x},0)::BIGINT)"


def _same(a: str, b: str) -> str:
    return (f"'Same borough: '||case when {a}.borough={b}.borough and {a}.borough<>'' then 'Yes' else 'No' end||'. Distance: '||"
            f"{fix(hav(a+'.lat',a+'.lon',b+'.lat',b+'.lon'),1)}||' km.'")


def od_rows(spark, sf, tier):
    zones = trips.enriched_zones(spark, sf) if tier == "enriched" else roles.open_zones(spark, sf)
    s = trips.stats(spark, sf)
    side = lambda k, p: tplan._zone_side(zones, k, p, tier == "enriched")
    km = haversine_km("o_lat", "o_lon", "c_lat", "c_lon")
    as_origin = lambda df: df.withColumnRenamed("pu_zone", "origin_zone")
    return (
        trips.cases(spark, sf).join(side("origin_zone", "o"), "origin_zone").join(side("candidate_zone", "c"), "candidate_zone")
        .join(as_origin(s.origins), "origin_zone", "left").join(as_origin(s.spread), "origin_zone", "left")
        .join(as_origin(s.recent), "origin_zone", "left")
        .join(s.destinations.withColumnRenamed("do_zone", "candidate_zone"), "candidate_zone", "left")
        .join(as_origin(s.pairs).withColumnRenamed("do_zone", "candidate_zone"), ["origin_zone", "candidate_zone"], "left")
        .withColumn("distance_km", km)
    )


def duration_rows(spark, sf, tier):
    zones = trips.enriched_zones(spark, sf) if tier == "enriched" else roles.open_zones(spark, sf)
    s = trips.stats(spark, sf)
    side = lambda k, p: tplan._zone_side(zones, k, p, tier == "enriched")
    chosen = tplan.duration_cases(trips.test(spark, sf), trips.N_TRIPS, trips.SEED)
    return (
        chosen.join(side("pu_zone", "o"), "pu_zone").join(side("do_zone", "d"), "do_zone")
        .join(s.origins.drop("mean_hour", "std_hour"), "pu_zone", "left").join(s.destinations, "do_zone", "left")
        .join(s.pairs, ["pu_zone", "do_zone"], "left").join(s.recent, "pu_zone", "left")
        .join(s.origin_hours, ["pu_zone", "pickup_hour"], "left")
        .withColumn("distance_km", haversine_km("o_lat", "o_lon", "d_lat", "d_lon"))
    )


def _register_trips(tier: str) -> None:
    zones = "zone_cats" if tier == "enriched" else "open_zones"

    def od(g: str) -> str:
        out = [f"'Origin: '||{zone_text('o','origin_zone',tier)}",
               f"'Origin has '||{_grouped('pu_count')}||' total trips to '||coalesce(unique_dropoffs,0)||' distinct dropoff zones.'",
               f"'Candidate: '||{zone_text('c','candidate_zone',tier)}", f"'Candidate dropoff popularity: '||{_grouped('do_count')}||' trips.'"]
        if _ge(g, "G1"):
            out.append(_same("o", "c"))
        if _ge(g, "G2"):
            out.append(f"'Origin geo-spread: '||{fix('coalesce(geo_spread,0)',1)}||' km. Active days: '||coalesce(active_days,0)||'. Trips from origin to candidate: '||coalesce(od_count,0)||'.'")
        if _ge(g, "G3"):
            out.append("'Recent 5 dropoff zones from origin: '||near.zones||'.'")
        if g == "G4":
            out.append(f"'Mean dropoff hour: '||{fix('coalesce(mean_hour,12.0)',1)}||' (std: '||{fix('coalesce(std_hour,0)',1)}||').'")
        return join_sql([*out, q(tx.OD_QUESTION)], NL)

    near = f"select pu_zone, string_agg(do_zone::VARCHAR, ', ' order by rn desc) as zones, string_agg({fix('duration_min',0)}, ', ' order by rn desc) as mins from recent5 group by 1"

    @query(f"drop_off_texts_{tier}", "X4 F12",
           sql(f"test pool od origin dest spread recent5 {zones}",
               by_level(od, f"""cases join {zones} o on o.zone_id=origin_zone join {zones} c on c.zone_id=candidate_zone left join origin on origin.pu_zone=origin_zone
  left join spread on spread.pu_zone=origin_zone left join dest on dest.do_zone=candidate_zone
  left join od on od.pu_zone=origin_zone and od.do_zone=candidate_zone left join near on near.pu_zone=origin_zone""", "query_id, candidate_zone, label"),
               **trips.cases_sql("test", 20), near=near))
    def _(spark, sf):
        return tx.od_texts(od_rows(spark, sf, tier), ["query_id", "candidate_zone", "label"], tier)

    def duration(g: str) -> str:
        out = [f"'Origin: '||{zone_text('o','t.pu_zone',tier)}", f"'Destination: '||{zone_text('d','t.do_zone',tier)}",
               f"'Origin has '||{_grouped('pu_count')}||' trips (mean duration: '||{fix('coalesce(pu_mean_dur,0)',1)}||' min). Destination has '||{_grouped('do_count')}||' arrivals (mean duration: '||{fix('coalesce(do_mean_dur,0)',1)}||' min).'"]
        if _ge(g, "G1"):
            out.append(_same("o", "d"))
        if _ge(g, "G2"):
            out.append(f"'Trips on this OD pair: '||coalesce(od_count,0)||' (mean duration: '||{fix('coalesce(od_mean_dur,0)',1)}||' min). Trip distance: '||{fix('trip_distance*1.60934',1)}||' km.'")
        if _ge(g, "G3"):
            out.append("'Recent 5 trip durations from origin: '||near.mins||' min.'")
        if g == "G4":
            days = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"
            out.append(f"'Pickup: '||({days})[pickup_dow+1]||' at '||printf('%02d',t.pickup_hour)||':00. Mean duration from origin at this hour: '||{fix('coalesce(hour_mean,0)',1)}||' min.'")
        return join_sql([*out, q(tx.DURATION_QUESTION)], NL)

    @query(f"duration_texts_{tier}", "X4 F12 F13",
           sql(f"test od origin dest hourly recent5 {zones}",
               by_level(duration, f"""cases t join {zones} o on o.zone_id=t.pu_zone join {zones} d on d.zone_id=t.do_zone left join origin on origin.pu_zone=t.pu_zone
  left join dest on dest.do_zone=t.do_zone left join od on od.pu_zone=t.pu_zone and od.do_zone=t.do_zone
  left join hourly on hourly.pu_zone=t.pu_zone and hourly.pickup_hour=t.pickup_hour left join near on near.pu_zone=t.pu_zone""", "trip_id, t.duration_min"),
               cases=f"""select trip_id, pu_zone, do_zone, {rnd('duration_min',2)} as duration_min, {rnd('trip_distance',3)} as trip_distance, pickup_hour, pickup_dow
  from (select * from test order by {key(trips.SEED,'trip_id')}, trip_id limit {trips.N_TRIPS})""", near=near))
    def _(spark, sf):
        return tx.duration_texts(duration_rows(spark, sf, tier), ["trip_id", "duration_min"], tier)


# The two id-less tiers share their wording, so one of them is enough.
for _tier in ("zone_id", "enriched"):
    _register_trips(_tier)


# -- reviews -----------------------------------------------------------------------------


def review_steps(n_held: int) -> dict[str, str]:
    """Named step ``ctx`` for the users in step ``cs``: recent reviews and category profile as text."""
    line = "business_name||' ('||categories||')'"
    point = f"' at ('||{fix('latitude',4)}||', '||{fix('longitude',4)}||')'"
    tight = f"' at ('||{fix('latitude',4)}||','||{fix('longitude',4)}||')'"
    day = "'['||strftime(review_date,'%Y-%m-%d')||'] '||"
    stars = "||' -> '||stars||' stars'"
    num = "'  '||(n-k+1)||'. '||"
    agg = "string_agg({0}, {1} order by k desc)"
    return {
        "rh": f"select *, rn-{n_held} as k from rranked where rn>{n_held} and user_id in (select user_id from cs)",
        "rrec": f"""select user_id, count(*) as n, {agg.format(num+line+stars, NL)} as l3, {agg.format(num+day+line+'||'+point+stars, NL)} as l4,
  {agg.format(line+stars, "'; '")} as s3, {agg.format(day+line+'||'+tight+stars, "'; '")} as s4 from (select *, least(count(*) over (partition by user_id),15) as n from rh) where k<=15 group by 1""",
        "rcat": f"""select user_id, category, count(*) as n, {rnd('avg(stars)',1)} as s, min((review_date,review_id)) as f from (select user_id, stars, review_date, review_id,
  unnest({reviews.CATS.format('categories')}) as category from rh) group by all""",
        "rprof": f"""select user_id, count(*) as n_cat, string_agg('  - '||category||': '||n||' visits, avg '||printf('%.1f',s)||' stars', {NL} order by o) filter (o<=15) as lines,
  string_agg(category||': '||n||' visits, avg '||printf('%.1f',s)||' stars', '; ' order by o) filter (o<=15) as short
  from (select *, row_number() over (partition by user_id order by n desc, f, category) as o from rcat) group by 1""",
        "ctx": f"""select u.user_id, r.n, l3, l4, s3, s4, n_cat, lines, short, lines||case when n_cat>15 then {NL}||'  - ... and '||(n_cat-15)||' other categories' else '' end as profile
  from (select distinct user_id from cs) u left join rrec r using (user_id) left join rprof using (user_id)""",
    }


def user_sections(g: str, city: str, noun: str) -> list[str]:
    out = []
    if _ge(g, "G1"):
        out.append(f"'The user is located in '||{city}||'.'")
    if _ge(g, "G2"):
        out += ["case when n_cat>0 then 'The user''s review history by category (visits and average rating):' end", "profile"]
    if _ge(g, "G3"):
        extra = " with locations and dates" if g == "G4" else ""
        out += [f"'The user''s '||x.n||' most recent {noun}{extra} (oldest to newest):'", "l4" if g == "G4" else "l3"]
    return out


def biz_text(a: str, g: str) -> str:
    at = f"||' at ('||{fix(a+'.latitude',4)}||', '||{fix(a+'.longitude',4)}||')'" if g == "G4" else ""
    return f"""'"'||{a}.business_name||'" (Categories: '||{a}.categories||')'{at}"""


@staged
def rating_rows(spark, sf):
    cases, history = rplan.rating_cases(reviews.reviews(spark, sf), reviews.test_users(spark, sf))
    return tx.review_context(cases, history)


_RFROM = "cs c join ctx x on x.user_id=c.user_id"


def _register_rating(name: str, question: str, covers: str) -> None:
    text = lambda g: join_sql([*user_sections(g, "c.city", "reviews"), f"'Target business: '||{biz_text('c', g)}", q(question)])

    @query(name, covers, sql("rtest rranked", by_level(text, _RFROM, "c.case_id, c.stars"), cs=reviews._RATING_CS, **review_steps(3)))
    def _(spark, sf):
        return tx.rating_texts(rating_rows(spark, sf), ["case_id", "stars"], question)


_register_rating("rating_texts", tx.RATING_QUESTION, "X5")
_register_rating("rating_reasoning_texts", tx.RATING_REASONING, "X5c")


@query("rating_text_parts", "X5c",
       sql("rtest rranked", " union all ".join(
           f"""select c.case_id, '{g}' as level, {join_sql(user_sections(g, 'c.city', 'reviews')) if g != 'G0' else q(tx.NO_CONTEXT)} as user_text,
  'Target business: '||{biz_text('c', g)} as item_text from {_RFROM}""" for g in LEVELS), cs=reviews._RATING_CS, **review_steps(3)))
def _(spark, sf):
    return tx.rating_text_parts(rating_rows(spark, sf), ["case_id"])


@staged
def business_rows(spark, sf):
    """One row per user: context, the truth's city, and the ordered candidate array."""
    c = reviews.candidates(spark, sf)
    item = F.struct("pos", *rplan.BUSINESS)
    packed = c.groupBy("user_id").agg(
        F.sort_array(F.collect_list(item)).alias("candidates"), F.max(F.when(F.col("label") == 1, F.col("city"))).alias("city"),
        F.max(F.when(F.col("label") == 1, F.col("pos"))).alias("truth_pos"),
    )
    return tx.review_context(packed, reviews.ranking_history(spark, sf))


_BIZ_STEPS = {
    "cs": "select c.*, b.business_name, b.categories, b.city, b.latitude, b.longitude from bcand c join biz b using (business_id)",
    **review_steps(1),
    "cand": f"""select user_id, max(pos) filter (label=1) as truth_pos, max(city) filter (label=1) as city, count(*) as nc,
  string_agg('  '||(pos+1)||'. '||business_name||' ('||categories||')', {NL} order by pos) as c0,
  string_agg('  '||(pos+1)||'. '||business_name||' ('||categories||') at ('||{fix('latitude',4)}||', '||{fix('longitude',4)}||')', {NL} order by pos) as c4 from cs group by 1""",
}


@query("business_ranking_texts", "X5 D11",
       sql("bcand rranked biz", by_level(
           lambda g: join_sql([*user_sections(g, "c.city", "visits"), "'Candidate businesses to rank:'", "c4" if g == "G4" else "c0",
                               "'Rank all '||nc||' candidates from most to least likely for this user to visit next. Return ONLY a JSON list of candidate numbers (1-indexed).'"]),
           "cand c join ctx x on x.user_id=c.user_id", "c.user_id, c.truth_pos"), **_BIZ_STEPS))
def _(spark, sf):
    return tx.business_ranking_texts(business_rows(spark, sf), ["user_id", "truth_pos"])


def _reason(g: str) -> str:
    out = []
    if _ge(g, "G1"):
        out.append("'The user is located in '||t.city||'.'")
    if _ge(g, "G2"):
        out.append(f"'The user''s review history by category:'||{NL}||lines")
    if _ge(g, "G3"):
        out.append(f"'Recent '||x.n||' visits:'||{NL}||{'l4' if g=='G4' else 'l3'}")
    user = join_sql(out) if out else q(tx.NO_CONTEXT)
    return join_sql([user, f"'Candidate business: '||{biz_text('k', g)}", q(tx.BUSINESS_REASONING)])


@query("business_reasoning_texts", "X5c S13",
       sql("bcand rranked biz", by_level(_reason, "cs k join cand t on t.user_id=k.user_id join ctx x on x.user_id=k.user_id", "k.case_id"), **_BIZ_STEPS))
def _(spark, sf):
    c = reviews.candidates(spark, sf).select("case_id", "user_id", *[F.col(b).alias(f"cand_{b}") for b in rplan.BUSINESS])
    return tx.business_reasoning_texts(c.join(business_rows(spark, sf), "user_id"), ["case_id"])


def _brief(g: str) -> str:
    out = ["'User located in '||c.city||'.'"] if _ge(g, "G1") else []
    out += ["'Category history: '||short"] if _ge(g, "G2") else []
    out += [f"'Recent visits: '||{'s4' if g=='G4' else 's3'}"] if _ge(g, "G3") else []
    return join_sql(out, "' '") if out else q(tx.NO_CONTEXT)


@query("business_user_summaries", "X5c", sql("bcand rranked biz", by_level(_brief, "cand c join ctx x on x.user_id=c.user_id", "c.user_id"), **_BIZ_STEPS))
def _(spark, sf):
    return tx.business_user_summaries(business_rows(spark, sf), ["user_id"])


# -- trajectories ----------------------------------------------------------------------------

_CITY = "New York City"
_KEYS = ["user_id", "session_no"]


@staged
def trajectory_rows(spark, sf):
    cands, context = sessions.cases(spark, sf)
    cats = v.categories(spark, sf)
    points = pr.first_points(v.visits(spark, sf)).select("location_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    rows = pr.with_category(cands.join(points, "location_id"), cats)
    packed = rows.groupBy(*_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("pos", "location_id", "category", "latitude", "longitude"))).alias("candidates"),
        F.max(F.when(F.col("label") == 1, F.col("pos"))).alias("truth_pos"))
    recent10 = last_n_array(pr.with_category(context, cats), _KEYS, v.ORDER, 10, ["ts", "location_id", "category", "latitude", "longitude"], "recent")
    train = sessions.split(spark, sf).filter(F.col("split") == "train").select(*_KEYS)
    seen = pr.with_category(sessions.stops(spark, sf).join(train, _KEYS, "left_semi"), cats)
    item = F.struct((-F.col("n")).alias("k"), "first_seen", "category", "n")
    profile = sessions.plan.visit_profile(seen).groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("profile"))
    rows = packed.join(recent10, _KEYS).join(profile, "user_id", "left")
    return rows.withColumn("profile", tx._or_empty(rows, "profile"))


def _trajectory(g: str) -> str:
    out = [q(f"The user is located in {_CITY}.")] if _ge(g, "G1") else []
    if _ge(g, "G2"):
        out += ["case when prof is not null then 'The user''s historical visit profile (category: visit count):' end", "prof"]
    if _ge(g, "G3"):
        extra = " with locations and timestamps" if g == "G4" else ""
        out += [f"'The user''s '||r.n||' most recent check-ins{extra} (oldest to newest):'", "l4" if g == "G4" else "l3"]
    return join_sql([*out, "'Candidate places to rank:'", "c4" if g == "G4" else "c0",
                     "'Rank all '||nc||' candidates from most to least likely for this user to visit next. Return ONLY a JSON list of candidate numbers (1-indexed).'"])


_VENUE = "category||' (Venue '||location_id||')'"
_VENUE_AT = f"{_VENUE}||' at ('||{fix('latitude',4)}||', '||{fix('longitude',4)}||')'"


@query("trajectory_texts", "X1 D5",
       sql("tcases stops sess visited matched points", by_level(_trajectory, "cand c join r using (user_id, session_no) left join p using (user_id)", "user_id, session_no, truth_pos"),
           cand=f"""select user_id, session_no, count(*) as nc, max(pos) filter (label=1) as truth_pos, string_agg('  '||(pos+1)||'. '||{_VENUE}, {NL} order by pos) as c0,
  string_agg('  '||(pos+1)||'. '||{_VENUE_AT}, {NL} order by pos) as c4 from (select t.*, m.category, pt.lat as latitude, pt.lon as longitude from tcases t
  join matched m using (location_id) join points pt using (location_id)) group by all""",
           st="select s.*, m.category from stops s join matched m using (location_id)",
           r=f"""select user_id, session_no, count(*) as n, string_agg('  '||(n-k+1)||'. '||{_VENUE}, {NL} order by k desc) as l3,
  string_agg('  '||(n-k+1)||'. ['||strftime(ts,'%Y-%m-%d %H:%M:%S')||'+00:00] '||{_VENUE_AT}, {NL} order by k desc) as l4 from (select *, least(count(*) over (partition by user_id, session_no),10) as n
  from (select *, row_number() over (partition by user_id, session_no order by ts desc, event_id desc)-1 as k from st) where k>0) where k<=10 group by all""",
           p=f"""select user_id, string_agg('  - '||category||': '||n||' visits', {NL} order by n desc, f) as prof from (select user_id, category, count(*) as n, min((ts,event_id)) as f
  from st join sess using (user_id, session_no) where split='train' group by all) group by 1"""))
def _(spark, sf):
    return tx.trajectory_texts(trajectory_rows(spark, sf), [*_KEYS, "truth_pos"], _CITY)
