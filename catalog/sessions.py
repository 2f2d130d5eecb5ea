"""Trajectory queries: sessions, splits, cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.operators import profiles as pr
from placewise.operators.filters import first_per_key
from placewise.plans import trajectories as plan
from placewise.streaming.sessions import closed_sessions

from . import roles
from . import visits as v
from .core import key, permuted, query
from .roles import part, sql
from .staged import staged

SEED = "trips"
N_CASES = 300
SESSION = plan.SESSION
GAP = 24

part("stops", ("checkins",), f"""select * from (select *, count(*) over (partition by user_id, session_no) as n_stops from (
  select *, sum(b) over (partition by user_id order by ts, event_id)::BIGINT as session_no from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '{GAP}' hour
  or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as b from checkins))) where n_stops>=3""")
part("sess", ("stops",), """select *, case when k <= floor(n*0.8) then 'train' when k <= floor(n*0.9) then 'val' else 'test' end as split from (
  select *, row_number() over (order by start_ts, user_id, session_no) as k, count(*) over () as n from (
  select user_id, session_no, min(ts) as start_ts, count(*) as n_stops from stops group by user_id, session_no))""")


@staged
def stops(spark, sf):
    return plan.trajectories(roles.checkins(spark, sf), GAP)


@staged
def split(spark, sf):
    return plan.split_sessions(stops(spark, sf))


@query("sessions", "W3", sql("stops", "select event_id, user_id, session_no from stops"))
def _(spark, sf):
    return plan.trajectories(roles.checkins(spark, sf), GAP).select("event_id", "user_id", "session_no")


@query("session_time_split", "W4",
       sql("sess", "select user_id, session_no, n_stops, strftime(start_ts,'%Y-%m-%d %H:%M:%S') as start_ts, split from sess"))
def _(spark, sf):
    return plan.split_sessions(stops(spark, sf)).select(
        *SESSION, "n_stops", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "split"
    )


@query("checkin_time_split", "W4",
       sql("checkins", """select event_id, case when k <= floor(n*0.8) then 'train' when k <= floor(n*0.9) then 'val' else 'test' end as split
  from (select event_id, row_number() over (order by ts, event_id) as k, count(*) over () as n from checkins)"""))
def _(spark, sf):
    from placewise.operators.history import chronological_split

    return chronological_split(roles.checkins(spark, sf), "ts", ["event_id"]).select("event_id", "split")


@query("train_visit_profile", "A4",
       sql("stops sess visited", """select user_id, category, count(*) as n from stops join sess using (user_id, session_no)
  join (select event_id, category from visited) using (event_id) where split='train' group by all"""))
def _(spark, sf):
    train = split(spark, sf).filter(F.col("split") == "train")
    rows = pr.with_category(stops(spark, sf), v.categories(spark, sf)).join(train.select(*SESSION), SESSION, "left_semi")
    return plan.visit_profile(rows).select("user_id", "category", "n")


def cases(spark, sf):
    test = split(spark, sf).filter(F.col("split") == "test")
    venues = v.visits(spark, sf).select("location_id").distinct()
    return plan.trajectory_cases(stops(spark, sf), test, venues, N_CASES, SEED)


part("tcases", ("stops", "sess", "checkins"), f"""with chosen as (select user_id, session_no from sess where split='test'
  order by {key(SEED,'user_id','session_no')}, user_id, session_no limit {N_CASES}),
  mine as (select *, row_number() over (partition by user_id, session_no order by ts desc, event_id desc) as rn from stops semi join chosen using (user_id, session_no)),
  truths as (select user_id, session_no, location_id as truth from mine where rn=1),
  idx as (select location_id, row_number() over (order by {key(SEED,'location_id')}, location_id)-1 as pos, count(*) over () as n from (select distinct location_id from checkins)),
  sized as (select t.*, inside, n, n-inside>=19 as strict, least((case when n-inside>=19 then inside else 1 end)+19, n) as m from truths t join
  (select user_id, session_no, count(distinct location_id) as inside from mine group by all) using (user_id, session_no), (select max(n) as n from idx)),
  probes as (select *, {permuted('j','n',SEED,'user_id','session_no')} as pos from (select *, unnest(range(m)) as j from sized)),
  neg as (select s.user_id, s.session_no, i.location_id, row_number() over (partition by s.user_id, s.session_no
  order by {key(SEED,'s.user_id','s.session_no','i.location_id')}, i.location_id) as k from probes s join idx i on i.location_id<>truth and i.pos=s.pos
  where not (strict and exists (select 1 from mine x where x.user_id=s.user_id and x.session_no=s.session_no and x.location_id=i.location_id))),
  both_sides as (select user_id, session_no, truth as location_id, 1 as label from truths union all select user_id, session_no, location_id, 0 from neg where k<=19)
  select *, (row_number() over (partition by user_id, session_no order by {key(SEED,'user_id','session_no','location_id')}, location_id)-1)::INTEGER as pos from both_sides""")


@query("trajectory_cases", "D5 W3 W4 W5 J9 T10 T4 U3",
       sql("tcases", "select user_id, session_no, location_id, label, pos from tcases"))
def _(spark, sf):
    return cases(spark, sf)[0].select(*SESSION, "location_id", "label", "pos")


@query("closed_sessions", "ST1",
       sql("checkins", """select user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start_ts, count(*) as n_events from (
  select *, sum(b) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id
  order by ts, event_id) > interval 24 hour then 1 else 0 end as b from checkins)) group by user_id, s
  having max(ts) + interval 25 hour <= (select date_trunc('millisecond', max(ts)) from checkins)"""))
def _(spark, sf):
    return closed_sessions(roles.checkins(spark, sf)).select(
        "user_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "n_events"
    )


@query("streamed_sessions", "ST1",
       sql("checkins", """select user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start_ts, count(*) as n_events from (
  select *, sum(b) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id
  order by ts, event_id) > interval 24 hour then 1 else 0 end as b from checkins)) group by user_id, s
  having max(ts) + interval 25 hour <= (select date_trunc('millisecond', max(ts)) from checkins)"""))
def _(spark, sf):
    """The sessions a drained stream over the event file has closed."""
    from placewise.session import scratch_path
    from placewise.streaming.sessions import stream_sessions

    schema = roles.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    out, state = scratch_path(spark, "stream-sessions"), scratch_path(spark, "stream-state")
    run = (
        stream_sessions(stream).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", state).trigger(availableNow=True).start(out)
    )
    run.awaitTermination()
    return spark.read.parquet(out).select(
        "user_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "n_events"
    )


def drained(spark, sf, stream_of):
    """The checkpoint of a stream that has read all check-ins in about five micro-batches."""
    from placewise.session import scratch_path
    from placewise.streaming import rolling

    rows = roles.checkins(spark, sf)
    source, checkpoint = scratch_path(spark, "stream-input"), scratch_path(spark, "rolling")
    rows.write.option("maxRecordsPerFile", 2000).parquet(source)
    n_files = len(spark.read.schema(rows.schema).parquet(source).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, n_files // 5)).parquet(source)
    rolling.start(stream_of(stream), checkpoint).awaitTermination()
    return checkpoint


@query("rolling_popularity", "ST2 A20",
       sql("checkins", "select location_id, count(*) as popularity from checkins group by 1"))
def _(spark, sf):
    """Counts in the state of a streaming count."""
    from placewise.streaming.rolling import popularity_stream, read_popularity

    return read_popularity(spark, drained(spark, sf, popularity_stream))


@query("rolling_last_checkins", "ST2 W1",
       sql("checkins", """select user_id, event_id, location_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r
  from checkins) where r<=5"""))
def _(spark, sf):
    """The last five check-ins of every user, in a list state."""
    from placewise.streaming.rolling import last_rows_stream, read_last_rows

    checkpoint = drained(spark, sf, lambda rows: last_rows_stream(rows.select("user_id", "ts", "event_id", "location_id")))
    return read_last_rows(spark, checkpoint).select("user_id", "event_id", "location_id")
