"""The given tables in the roles of check-ins, places, friends, zones, trips and reviews.

Each role exists twice: as a DataFrame and as a SQL common table expression
for the twins. These views only stand in for real inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED_ZONES = (23, 24)
TEST_FROM = "2000-01-01"
REVIEWED = ("business_name", "categories", "city", "latitude", "longitude")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def checkins(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", k.alias("location_id"))
    ones, fifty, tens = F.col("location_id") % 10, F.floor(F.col("location_id") / 50), F.floor((F.col("location_id") % 50) / 10)
    return rows.withColumns(
        {
            "latitude": F.lit(40.0) + ones * F.lit(0.02) + fifty * F.lit(0.0002),
            "longitude": F.lit(-74.0) + tens * F.lit(0.02),
        }
    )


def pois(spark: SparkSession, sf: str) -> DataFrame:
    names = ["coffee_shop", "bar", "park", "gym", "museum", "fast_food_restaurant"]
    k = F.col("poi_id")
    nudge = F.when(k % 7 == 5, 0.001).otherwise(0.0003)
    places = checkins(spark, sf).select(F.col("location_id").alias("poi_id")).distinct()
    return places.select(
        "poi_id",
        F.concat(F.lit("poi_"), k.cast("string")).alias("name"),
        F.get(F.array(*map(F.lit, names)), k % 7).alias("category"),
        (F.lit(40.0) + (k % 10) * F.lit(0.02) + F.floor(k / 50) * F.lit(0.0002) + nudge).alias("lat"),
        (F.lit(-74.0) + F.floor((k % 50) / 10) * F.lit(0.02)).alias("lon"),
    )


def friends(spark: SparkSession, sf: str) -> DataFrame:
    c = checkins(spark, sf)
    top = c.select(F.max("user_id")).scalar()
    i = F.col("i")
    people = c.select(F.col("user_id").alias("u")).distinct()
    pairs = people.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(6))))
    pairs = pairs.withColumn("v", (F.col("u") + i * i * 3) % (top + 1)).filter(F.col("u") != F.col("v"))
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def zones(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        k.alias("zone_id"),
        (F.lit(40.5) + (k % 5) * F.lit(0.03)).alias("lat"),
        (F.lit(-74.2) + F.floor(k / 5) * F.lit(0.04)).alias("lon"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("zone_name"),
    )


def open_zones(spark: SparkSession, sf: str) -> DataFrame:
    return zones(spark, sf).filter(~F.col("zone_id").isin(*EXCLUDED_ZONES))


def padded(c: str, width: int) -> Column:
    """``%0<width>d``; the formatter itself is only needed for numbers beyond the width, below zero or missing."""
    k, scale = F.col(c), 10**width
    digits = F.substring((k + F.lit(scale).cast("long")).cast("string"), 2, width)
    return F.when(k.between(0, scale - 1), digits).otherwise(F.format_string(f"%0{width}d", k))


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """All trips. Customers are looked up per order, before the orders meet their lines; suppliers last: their nation is the origin."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("do_zone"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("pu_zone"))
    placed = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", "do_zone")
    rows = li.join(placed, li.l_orderkey == F.col("o_orderkey")).join(s, F.col("l_suppkey") == s.s_suppkey)
    parts = (("l_orderkey", 10), ("l_partkey", 8), ("l_suppkey", 6), ("l_linenumber", 2))
    hours = F.expr("make_dt_interval(0, cast(l_linenumber * 3 + l_suppkey % 5 as int))")
    seconds = F.expr("make_dt_interval(0, 0, 0, l_quantity * 150)")
    return rows.select(
        F.concat_ws("-", *[padded(c, width) for c, width in parts]).alias("trip_id"),
        "pu_zone",
        "do_zone",
        (F.col("o_orderdate") + hours).alias("pickup_ts"),
        (F.col("o_orderdate") + hours + seconds).alias("dropoff_ts"),
        (F.col("l_extendedprice") / 10000).alias("trip_distance"),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    k = F.col("p_partkey")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.format_string("%010d-%08d-%06d-%02d", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("review_id"),
            F.col("o_custkey").alias("user_id"),
            k.alias("business_id"),
            F.col("p_name").alias("business_name"),
            F.concat_ws(", ", "p_type", word(1), word(2)).alias("categories"),
            F.concat(F.lit("City_"), (k % 6).cast("string")).alias("city"),
            (F.lit(33.0) + (k % 6) * F.lit(0.5) + (k % 97) * F.lit(0.001)).alias("latitude"),
            (F.lit(-112.0) + (k % 89) * F.lit(0.001)).alias("longitude"),
            (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("stars"),
            F.col("o_orderdate").cast("date").alias("review_date"),
        )
    )


# The same roles in SQL; each may use the ones before it.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "checkins": (
        (),
        """select event_id, user_id, ts, k as location_id,
  cast(40.0 + (k%10)*0.02 + floor(k/50)*0.0002 as double) as latitude,
  cast(-74.0 + floor((k%50)/10)*0.02 as double) as longitude
from (select event_id, user_id, ts, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events) e""",
    ),
    "pois": (
        ("checkins",),
        """select k as poi_id, 'poi_'||k as name,
  case k%7 when 0 then 'coffee_shop' when 1 then 'bar' when 2 then 'park' when 3 then 'gym'
           when 4 then 'museum' when 5 then 'fast_food_restaurant' end as category,
  cast(40.0 + (k%10)*0.02 + floor(k/50)*0.0002 + case when k%7=5 then 0.001 else 0.0003 end as double) as lat,
  cast(-74.0 + floor((k%50)/10)*0.02 as double) as lon
from (select distinct location_id as k from checkins) z""",
    ),
    "friends": (
        ("checkins",),
        """select distinct least(u,v) as a, greatest(u,v) as b from (
  select user_id as u, (user_id + i*i*3) % (m+1) as v from (select distinct user_id from checkins) q
  cross join (select max(user_id) as m from checkins) mm cross join range(1,7) t(i)) e where u<>v""",
    ),
    "zones": (
        (),
        """select n_nationkey as zone_id, cast(40.5+(n_nationkey%5)*0.03 as double) as lat,
  cast(-74.2+floor(n_nationkey/5)*0.04 as double) as lon, r_name as borough, n_name as zone_name
from nation join region on n_regionkey=r_regionkey""",
    ),
    "open_zones": (("zones",), "select * from zones where zone_id not in (23,24)"),
    "trips": (
        (),
        """select printf('%010d-%08d-%06d-%02d', l_orderkey, l_partkey, l_suppkey, l_linenumber) as trip_id,
  s_nationkey as pu_zone, c_nationkey as do_zone,
  o_orderdate + to_hours((l_linenumber*3+l_suppkey%5)::int) as pickup_ts,
  o_orderdate + to_hours((l_linenumber*3+l_suppkey%5)::int) + to_seconds((l_quantity*150)::int) as dropoff_ts,
  l_extendedprice/10000 as trip_distance
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
  join supplier on l_suppkey=s_suppkey""",
    ),
    "clean": (
        ("trips",),
        """select *, epoch_us(dropoff_ts - pickup_ts)/60e6 as duration_min, hour(pickup_ts)::int as pickup_hour,
  (isodow(pickup_ts)-1)::int as pickup_dow, strftime(pickup_ts,'%Y-%m-%d') as pickup_date
from trips where pu_zone not in (23,24) and do_zone not in (23,24) and trip_distance > 0
  and epoch_us(dropoff_ts - pickup_ts)/60e6 between 1 and 120""",
    ),
    "train": (("clean",), f"select * from clean where pickup_ts < timestamp '{TEST_FROM}'"),
    "test": (("clean",), f"select * from clean where pickup_ts >= timestamp '{TEST_FROM}'"),
    "reviews": (
        (),
        """select printf('%010d-%08d-%06d-%02d', l_orderkey, l_partkey, l_suppkey, l_linenumber) as review_id,
  o_custkey as user_id, p_partkey as business_id, p_name as business_name,
  concat_ws(', ', p_type, split_part(p_name,' ',1), split_part(p_name,' ',2)) as categories,
  'City_'||(p_partkey%6) as city,
  cast(33.0+(p_partkey%6)*0.5+(p_partkey%97)*0.001 as double) as latitude,
  cast(-112.0+(p_partkey%89)*0.001 as double) as longitude,
  (1+cast(l_quantity as int)%5)::int as stars, cast(o_orderdate as date) as review_date
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey""",
    ),
}


def _needed(names: tuple[str, ...], extra: dict) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in (extra | SQL)[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a shared building block for SQL twins."""
    PARTS[name] = (needs, sql)


def sql(needs: str, body: str, **own: str) -> str:
    """A statement over roles and parts (space-separated ``needs``) and its own named steps."""
    names = _needed(tuple(needs.split()), PARTS)
    steps = [f"{n} as ({(PARTS | SQL)[n][1]})" for n in names]
    steps += [f"{n} as ({text})" for n, text in own.items()]
    return ("with " + ",\n".join(steps) + "\n" if steps else "") + body


def zone_pois(spark: SparkSession, sf: str) -> DataFrame:
    """Categorised places around the zones' points; some have no category."""
    key = F.col("p_partkey")
    k = key % 25
    return table(spark, sf, "part").select(
        key.alias("poi_id"),
        F.col("p_name").alias("name"),
        F.when(
            F.col("p_size") % 6 != 0,
            F.concat(F.lower("p_type"), F.lit("_"), F.split_part("p_name", F.lit(" "), F.lit(2))),
        ).alias("category"),
        (F.lit(40.5) + (k % 5) * F.lit(0.03) + (key % 17 - 8) * F.lit(0.001)).alias("lat"),
        (F.lit(-74.2) + F.floor(k / 5) * F.lit(0.04) + (key % 19 - 9) * F.lit(0.0012)).alias("lon"),
    )


SQL["zone_pois"] = (
    (),
    """select p_partkey as poi_id, p_name as name,
  case when p_size%6<>0 then lower(p_type)||'_'||split_part(p_name,' ',2) end as category,
  cast(40.5+((p_partkey%25)%5)*0.03+(p_partkey%17-8)*0.001 as double) as lat,
  cast(-74.2+floor((p_partkey%25)/5)*0.04+(p_partkey%19-9)*0.0012 as double) as lon from part""",
)
