"""Reader and writer queries.

A query writes the input file form of a role with Spark, then reads it back with
the reader under test; the twin states what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions.geo import cell_pair_label, within_box
from placewise.functions.numbers import fixed, round_to
from placewise.functions.texts import day_name
from placewise.functions.numbers import thousands
from placewise.operators.filters import without_pairs
from placewise.operators.history import last_n_array
from placewise.operators.sampling import balanced, take_first
from placewise.session import scratch_path
from placewise.sources.polygons import polygon_centroids
from placewise.sources import checkins as ci
from placewise.sources import places, requests, reviews as rv, sinks
from placewise.sources import trips as tr

from . import roles
from .core import cell, fix, key, query, region_label, rnd
from .roles import sql


def write_lines(df, name: str) -> str:
    """Write one text column and return the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("edge_list_scan", "S1", sql("friends", "select a, b from friends"))
def _(spark, sf):
    e = roles.friends(spark, sf)
    # White space of any kind may stand at the ends of a good line.
    forward = e.select(F.concat(F.lit("\t "), F.concat_ws("\t", "a", "b")).alias("value"))
    back = e.select(F.concat(F.concat_ws("  ", "b", "a"), F.lit("\t")).alias("value"))
    noise = e.select(F.concat_ws(" ", F.lit("#"), "a", "b").alias("value")).union(
        e.select(F.concat_ws(" ", "a", "b", F.lit("7")).alias("value"))
    ).union(e.select(F.concat_ws(" ", "a", F.lit("x9")).alias("value")))
    return ci.read_edges(spark, write_lines(forward.union(back).union(noise), "edges"))


@query("checkin_scan", "S2 F5",
       sql("checkins", f"""select user_id, strftime(ts,'%Y-%m-%dT%H:%M:%S') as ts, {rnd('latitude',6)} as latitude, {rnd('longitude',6)} as longitude,
  location_id::BIGINT as location_id from checkins where event_id%97<>0"""))
def _(spark, sf):
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    c = roles.checkins(spark, sf)
    # Every 97th line loses its last field, or has an empty or a wrong one, and must be dropped; other lines end in a tab.
    wrong = F.element_at(F.array(F.lit(None), F.lit(""), F.lit("none")), (F.col("event_id") % 3 + 1).cast("int"))
    place = F.when(F.col("event_id") % 97 != 0, F.col("location_id").cast("string")).otherwise(wrong)
    end = F.when(F.col("event_id") % 5 == 0, F.lit("\t")).otherwise(F.lit(""))
    lines = c.select(F.concat(F.concat_ws("\t", "user_id", ts, "latitude", "longitude", place), end).alias("value"))
    return ci.read_checkins(spark, write_lines(lines, "checkins")).select(
        "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        round_to("latitude", 6).alias("latitude"), round_to("longitude", 6).alias("longitude"), "location_id",
    )


@query("venue_checkin_scan", "S3 T1",
       sql("checkins", f"""select user_id, 'v'||location_id as location_id, 'cat '||(location_id%7) as category, strftime(ts,'%Y-%m-%d %H:%M:%S') as ts,
  {rnd('latitude',6)} as latitude from checkins"""))
def _(spark, sf):
    c = roles.checkins(spark, sf)
    path = scratch_path(spark, "venue-checkins")
    sinks.write_csv(
        c.select(
            F.col("user_id").alias("userId"), F.concat(F.lit("v"), "location_id").alias("venueId"),
            F.concat(F.lit("c"), F.col("location_id") % 7).alias("venueCategoryId"),
            F.concat(F.lit("cat "), F.col("location_id") % 7).alias("venueCategory"), "latitude", "longitude",
            F.lit(-300).alias("timezoneOffset"),
            F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")).alias("utcTimestamp"),
        ),
        path,
    )
    return ci.read_venue_checkins(spark, path).select(
        "user_id", "location_id", "category", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        round_to("latitude", 6).alias("latitude"),
    )


@query("review_scan", "S4 J1",
       sql("reviews", """select user_id::VARCHAR as user_id, business_id::VARCHAR as business_id, stars, strftime(review_date,'%Y-%m-%d') as review_date,
  case when business_id%5=0 then '' else categories end as categories from reviews where business_id%11<>0"""))
def _(spark, sf):
    r = roles.reviews(spark, sf)
    biz = r.filter(F.col("business_id") % 11 != 0).groupBy("business_id").agg(F.min("categories").alias("categories"))
    biz = biz.select(F.col("business_id").cast("string"), F.lit("x").alias("name"),
                     F.when(F.col("business_id") % 5 != 0, F.col("categories")).alias("categories"))
    b_path, r_path = scratch_path(spark, "business"), scratch_path(spark, "review")
    sinks.write_json(biz, b_path)
    sinks.write_json(
        r.select(F.col("user_id").cast("string"), F.col("business_id").cast("string"),
                 F.col("stars").cast("double"), F.date_format("review_date", "yyyy-MM-dd 00:00:00").alias("date")), r_path)
    return rv.read_reviews(spark, b_path, r_path).select(
        "user_id", "business_id", "stars", F.date_format("review_date", "yyyy-MM-dd").alias("review_date"), "categories"
    )


@query("trip_month_scan", "S5 U1",
       sql("trips", f"""select pu_zone, do_zone, strftime(pickup_ts,'%Y-%m-%d %H:%M:%S') as pickup_ts, {rnd('trip_distance',4)} as trip_distance
  from trips"""))
def _(spark, sf):
    t = roles.trips(spark, sf)
    back = {v: k for k, v in tr.TRIP_COLUMNS.items()}
    raw = t.drop("trip_id").withColumnsRenamed(back).withColumn("fare", F.lit(1.0))
    paths = []
    for half, keep in (("h1", F.month("tpep_pickup_datetime") <= 6), ("h2", F.month("tpep_pickup_datetime") > 6)):
        paths.append(scratch_path(spark, f"trips-{half}"))
        raw.filter(keep).write.parquet(paths[-1])
    return tr.read_trips(spark, [*paths, f"{paths[0]}-missing"]).select(
        "pu_zone", "do_zone", F.date_format("pickup_ts", "yyyy-MM-dd HH:mm:ss").alias("pickup_ts"),
        round_to("trip_distance", 4).alias("trip_distance"),
    )


_BOX = (40.02, -73.97, 40.14, -73.9)


@query("place_scan", "S6 P7",
       sql("pois", f"""select poi_id, name, category, {rnd('lat',6)} as lat, {rnd('lon',6)} as lon from pois
  where lat between 40.02 and 40.14 and lon between -73.97 and -73.9"""))
def _(spark, sf):
    p = roles.pois(spark, sf)
    path = scratch_path(spark, "places")
    nested = p.select(
        F.col("poi_id").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"),
        F.struct(F.col("category").alias("primary"), F.lit("z").alias("alternate")).alias("categories"),
        F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin")).alias("bbox"), F.lit("place").alias("type"),
    )
    nested.write.partitionBy("type").parquet(path)
    return places.read_places(spark, path, _BOX).select(
        "poi_id", "name", "category", round_to("lat", 6).alias("lat"), round_to("lon", 6).alias("lon")
    )


@query("place_table_round_trip", "S11 P7 P8",
       sql("zone_pois", f"""select poi_id, category, {rnd('lat',6)} as lat from zone_pois where lat between 40.5 and 40.56 and lon between -74.15 and -74.05
  and category is not null"""))
def _(spark, sf):
    path = scratch_path(spark, "poi-table")
    places.write_places(roles.zone_pois(spark, sf), path)
    found = places.read_written_places(spark, path, (40.5, -74.15, 40.56, -74.05)).filter(F.col("category").isNotNull())
    return found.select("poi_id", "category", round_to("lat", 6).alias("lat"))


@query("zone_lookup_scan", "S7",
       sql("zones", "select zone_id, borough, zone_name, 's'||(zone_id%3) as service_zone from zones"))
def _(spark, sf):
    path = scratch_path(spark, "zone-lookup")
    z = roles.zones(spark, sf)
    sinks.write_csv(
        z.select(F.col("zone_id").alias("LocationID"), F.col("borough").alias("Borough"), F.col("zone_name").alias("Zone"),
                 F.concat(F.lit("s"), F.col("zone_id") % 3).alias("service_zone")), path)
    return tr.read_zone_lookup(spark, path)


@query("zone_centroids", "S8",
       sql("zone_pois", f"select poi_id%25 as zone_id, {rnd('avg(lat)',6)} as lat, {rnd('avg(lon)',6)} as lon from zone_pois group by 1"))
def _(spark, sf):
    corners = roles.zone_pois(spark, sf).withColumn("zone_id", F.col("poi_id") % 25)
    return tr.zone_centroids(corners)


#: Rings of a zone around its point, as (lat, lon) steps of a thousandth: a part, its hole (the other way round), a second part.
_RINGS = ([(0, 0), (9, 0), (9, 7), (4, 9), (0, 6)], [(2, 2), (2, 4), (5, 4), (5, 2)], [(20, 1), (23, 1), (22, 5)])


def _zone_rings(zones):
    """Boundary vertices of zones of different sizes; every third zone has no hole, every fifth one part."""
    corners = F.array(*(
        F.struct(F.lit(r).alias("ring"), F.lit(i).alias("seq"), F.lit(a / 1000).alias("a"), F.lit(b / 1000).alias("b"))
        for r, ring in enumerate(_RINGS) for i, (a, b) in enumerate(ring)
    ))
    size = F.lit(1.0) + F.col("zone_id") % 7
    rows = zones.select("zone_id", "lat", "lon", F.explode(corners).alias("c"))
    rows = rows.filter(~((F.col("c.ring") == 1) & (F.col("zone_id") % 3 == 0)) & ~((F.col("c.ring") == 2) & (F.col("zone_id") % 5 == 0)))
    return rows.select("zone_id", "c.ring", "c.seq", (F.col("lat") + F.col("c.a") * size).alias("lat"), (F.col("lon") + F.col("c.b") * size).alias("lon"))


_CORNERS = ", ".join(f"({r},{i},{a}/1000.0::DOUBLE,{b}/1000.0::DOUBLE)" for r, ring in enumerate(_RINGS) for i, (a, b) in enumerate(ring))


@query("polygon_centroids", "S8",
       sql("open_zones", f"""select zone_id, {rnd('sum(my+y0*a2)/sum(a2)',6)} as lat, {rnd('sum(mx+x0*a2)/sum(a2)',6)} as lon,
  {rnd('abs(sum(a2))/2',9)} as area from ring_moments group by 1""",
           corners=f"""select zone_id, ring, seq, lat+a*(1+zone_id%7) as y, lon+b*(1+zone_id%7) as x from open_zones, (values {_CORNERS}) c(ring, seq, a, b)
  where not (ring=1 and zone_id%3=0) and not (ring=2 and zone_id%5=0)""",
           own="""select *, x-first(x) over w as u, y-first(y) over w as t, first(x) over w as x0, first(y) over w as y0 from corners
  window w as (partition by zone_id, ring order by seq)""",
           edges="select *, coalesce(lead(u) over w, 0) as nu, coalesce(lead(t) over w, 0) as nt from own window w as (partition by zone_id, ring order by seq)",
           ring_moments="""select zone_id, ring, sum(u*nt-nu*t) as a2, sum((u+nu)*(u*nt-nu*t))/3 as mx, sum((t+nt)*(u*nt-nu*t))/3 as my,
  any_value(x0) as x0, any_value(y0) as y0 from edges group by all"""))
def _(spark, sf):
    return polygon_centroids(_zone_rings(roles.open_zones(spark, sf)))


@query("case_table_round_trip", "S9",
       sql("checkins", """select user_id, count(*) as n, min(event_id) as first_event from (select *, row_number() over (partition by user_id
  order by ts desc, event_id desc) as r from checkins) where r<=15 group by 1"""))
def _(spark, sf):
    """A nested history column of the last fifteen check-ins, written and read back."""
    nested = last_n_array(roles.checkins(spark, sf), ["user_id"], ["ts", "event_id"], 15, ["event_id"], "events")
    path = scratch_path(spark, "cases")
    sinks.write_table(nested, path)
    return sinks.read_table(spark, path).select(
        "user_id", F.size("events").cast("long").alias("n"), F.array_min("events.event_id").alias("first_event")
    )


@query("request_chunks", "S13",
       sql("", """select custom_id, ((row_number() over (order by custom_id)-1)//500)::BIGINT as chunk from (
  select 'test|G'||(doc_id%5)||'|'||printf('%05d', doc_id) as custom_id from documents)"""))
def _(spark, sf):
    d = roles.table(spark, sf, "documents")
    level = F.concat(F.lit("G"), (F.col("doc_id") % 5).cast("string"))
    rows = d.select(requests.custom_id(F.lit("test"), level, F.col("doc_id")).alias("custom_id"))
    return requests.number_chunks(rows, "custom_id", 500)


@query("request_files", "S13 C1",
       sql("", """select chunk, count(*) as n, min(custom_id) as first, max(custom_id) as last, sum(length(body))::BIGINT as n_chars from (
  select custom_id, body, ((row_number() over (order by custom_id)-1)//300)::BIGINT as chunk from (
  select 'test|G'||(doc_id%5)||'|'||printf('%05d', doc_id) as custom_id, text as body from documents)) group by 1"""))
def _(spark, sf):
    """Requests written as files of at most 300 and read back, file by file."""
    d = roles.table(spark, sf, "documents")
    level = F.concat(F.lit("G"), (F.col("doc_id") % 5).cast("string"))
    rows = d.select(requests.custom_id(F.lit("test"), level, F.col("doc_id")).alias("custom_id"), F.col("text").alias("body"))
    path = scratch_path(spark, "requests")
    requests.write_requests(rows, path, "custom_id", 300)
    back = spark.read.schema("custom_id string, body string, chunk long").json(path)
    return back.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("custom_id").alias("first"), F.max("custom_id").alias("last"),
        F.sum(F.length("body")).alias("n_chars"),
    )


def _response(spark, sf):
    c = roles.table(spark, sf, "conversations")
    status = F.when(F.col("turn") % 5 == 4, 500).otherwise(200)
    content = F.when(F.col("turn") % 5 != 3, F.col("text"))
    message = F.struct(F.struct(F.coalesce(content, F.lit("")).alias("content")).alias("message"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"),
        F.struct(status.alias("status_code"), F.struct(F.array(message).alias("choices")).alias("body")).alias("response"),
    )


@query("response_scan", "S14",
       sql("", """select conv_id||'-'||turn as custom_id, case when turn%5 in (3,4) or text='' then 'No reasoning.' else text end as text from conversations"""))
def _(spark, sf):
    path = scratch_path(spark, "responses")
    sinks.write_json(_response(spark, sf), path)
    return requests.read_responses(spark, path)


@query("prediction_file_scan", "S15",
       sql("", """select model, level, doc_id as index, quality as label, case when doc_id%10<>0 then toxic end as prediction from labels,
  (values ('m-one','G0'),('m-one','G3'),('m_two','G1')) t(model, level)"""))
def _(spark, sf):
    root = scratch_path(spark, "predictions")
    rows = roles.table(spark, sf, "labels").select(
        F.col("doc_id").alias("index"), F.col("quality").alias("label"),
        F.when(F.col("doc_id") % 10 != 0, F.col("toxic")).alias("prediction"),
    )
    for name in ("m-one__G0", "m-one__G3", "m_two__G1"):
        sinks.write_json(rows, f"{root}/{name}")
    return requests.read_predictions(spark, f"{root}/*").select("model", "level", "index", "label", "prediction")


@query("chat_files", "S12 T8",
       sql("", f"""select case when rn<=100 then 'train' else 'test' end as split, 'G0' as level, doc_id, case when rn<=100 then 3 else 2 end as n_turns,
  case when rn<=100 then case when quality=1 then 'Yes' else 'No' end end as answer from (select *, row_number() over
  (partition by quality order by {key('chat','doc_id')}, doc_id) as rn from labels)"""))
def _(spark, sf):
    from placewise.plans.texts import chat_rows

    rows = roles.table(spark, sf, "labels").withColumnRenamed("quality", "label")
    train = balanced(rows, "label", ["doc_id"], 200, "chat").select("doc_id", F.lit("train").alias("split"))
    rows = rows.join(train, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))
    texts = rows.select("doc_id", "split", "label", F.lit("G0").alias("level"), F.concat(F.lit("Document "), "doc_id").alias("text"))
    answer = F.when(F.col("label") == 1, "Yes").otherwise("No")
    path = scratch_path(spark, "chat")
    sinks.write_chat(chat_rows(texts, "Answer Yes or No.", answer, F.col("split")), path)
    back = spark.read.schema(
        "doc_id bigint, label int, messages array<struct<role:string,content:string>>, split string, level string").json(path)
    last = F.try_element_at("messages", F.lit(3))["content"]
    return back.select("split", "level", "doc_id", F.size("messages").alias("n_turns"), last.alias("answer"))


@query("union_of_labelled_sets", "U2 U5",
       sql("friends checkins", """select a, b, 1 as label from friends where a%2=0 union all select user_id as a, user_id+1 as b, 0 from
  (select distinct user_id from checkins) where not exists (select 1 from friends f where f.a=user_id and f.b=user_id+1)"""))
def _(spark, sf):
    f = roles.friends(spark, sf)
    near = roles.checkins(spark, sf).select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).distinct()
    fresh = near.withColumnsRenamed({"a": "x", "b": "y"})
    fresh = without_pairs(fresh, f, "x", "y").withColumnsRenamed({"x": "a", "y": "b"})
    return f.filter(F.col("a") % 2 == 0).withColumn("label", F.lit(1)).unionByName(fresh.withColumn("label", F.lit(0)))


@query("first_rows_of_an_order", "T11", sql("clean", "select trip_id from clean order by pickup_ts, trip_id limit 20000"))
def _(spark, sf):
    from .trips import clean

    return take_first(clean(spark, sf), ["pickup_ts", "trip_id"], 20_000).select("trip_id")


@query("balanced_subset", "T8",
       sql("", f"""select doc_id, quality from (select *, row_number() over (partition by quality order by {key('bal','doc_id')}, doc_id) as rn from labels) where rn<=50"""))
def _(spark, sf):
    return balanced(roles.table(spark, sf, "labels"), "quality", ["doc_id"], 100, "bal").select("doc_id", "quality")


@query("labels_and_formats", "F2 F3 F12 F13 P7",
       sql("checkins", f"""select event_id, {region_label(cell('latitude',1),cell('longitude',1))} as region, {fix('latitude',4)} as lat_text,
  format('{{:,}}', event_id*1000) as grouped, (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[isodow(ts)] as day_name,
  latitude between 40.02 and 40.14 and longitude between -73.97 and -73.9 as in_box from checkins"""))
def _(spark, sf):
    from placewise.functions.geo import cell as cell_of

    return roles.checkins(spark, sf).select(
        "event_id", cell_pair_label(cell_of("latitude", 1), cell_of("longitude", 1), 1).alias("region"),
        fixed("latitude", 4).alias("lat_text"), thousands(F.col("event_id") * 1000).alias("grouped"),
        day_name(F.weekday("ts")).alias("day_name"), within_box("latitude", "longitude", *_BOX).alias("in_box"),
    )
