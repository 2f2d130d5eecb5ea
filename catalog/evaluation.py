"""Evaluation queries: metrics, rankings, intervals, comparisons, parsing, request ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.functions import parsing
from placewise.functions.numbers import finite_or_zero, hash_draw, hash_key, round_to, star_prediction
from placewise.functions.vectors import pair_vector
from placewise.operators import compare as cmp
from placewise.operators import evaluate as ev
from placewise.operators import ledger
from placewise.plans.levels import LEVELS, enriched_names, feature_names

from . import pairs, reviews, roles, trips
from .core import draw, key, query, ratio, rnd
from .roles import part, sql
from .staged import staged

MODELS = ("enriched", "venue_id")
N_RESAMPLES = 1000

# -- predictions per model and level -----------------------------------------

part("preds", (), f"""select model, 'G'||g as level, doc_id, quality as label, case when doc_id%10=0 then null
  when {draw('pred','model',"'G'||g",'doc_id')}%100 < 55+5*g then quality else 1-quality end as prediction
  from labels, (values ('enriched'),('venue_id')) m(model), range(0,5) t(g)""")


def predictions(spark, sf):
    labels = roles.table(spark, sf, "labels")
    grid = labels.withColumn("model", F.explode(F.array(*map(F.lit, MODELS)))).withColumn(
        "level", F.explode(F.array(*map(F.lit, LEVELS)))
    )
    right = hash_draw("pred", "model", "level", "doc_id") % 100 < 55 + 5 * F.substring("level", 2, 1).cast("int")
    prediction = F.when(F.col("doc_id") % 10 != 0, F.when(right, F.col("quality")).otherwise(1 - F.col("quality")))
    return grid.select("model", "level", "doc_id", F.col("quality").alias("label"), prediction.alias("prediction"))


_TP = "count(*) filter (prediction=1 and label=1)"
_TN = "count(*) filter (prediction=0 and label=0)"
_FP = "count(*) filter (prediction=1 and label=0)"
_FN = "count(*) filter (prediction=0 and label=1)"
_BINARY = f"""select {{by}} {rnd(ratio(f'{_TP}+{_TN}','count(prediction)'),4)} as accuracy, {rnd(ratio(_TP,f'{_TP}+{_FP}'),4)} as precision,
  {rnd(ratio(_TP,f'{_TP}+{_FN}'),4)} as recall, {rnd(ratio(f'2*{_TP}',f'2*{_TP}+{_FP}+{_FN}'),4)} as f1, {_TP} as tp, {_TN} as tn, {_FP} as fp, {_FN} as fn,
  count(prediction) as n_valid, count(*) as n_total from {{src}} {{group}}"""
part("metrics", ("preds",), _BINARY.format(by="model, level,", src="preds", group="group by model, level"))


def metrics(spark, sf):
    return ev.binary_metrics(predictions(spark, sf), by=["model", "level"])


@query("binary_metrics", "M6", sql("metrics", "select * from metrics"))
def _(spark, sf):
    return metrics(spark, sf)


@query("binary_metrics_plain_labels", "M6",
       sql("", _BINARY.format(by="", src="(select quality as label, case when doc_id%10<>0 then toxic end as prediction from labels)", group="")))
def _(spark, sf):
    rows = roles.table(spark, sf, "labels").select(
        F.col("quality").alias("label"), F.when(F.col("doc_id") % 10 != 0, F.col("toxic")).alias("prediction")
    )
    return ev.binary_metrics(rows)


@query("condition_table", "M11", sql("metrics", """select model, max(accuracy) filter (level='G0') as "G0", max(accuracy) filter (level='G1') as "G1",
  max(accuracy) filter (level='G2') as "G2", max(accuracy) filter (level='G3') as "G3", max(accuracy) filter (level='G4') as "G4" from metrics group by 1"""))
def _(spark, sf):
    return cmp.condition_table(metrics(spark, sf), "accuracy", LEVELS)


@query("grid_with_missing_conditions", "J14 S15",
       sql("metrics", """select m.model, 'G'||g as level, accuracy, n_total from (values ('enriched'),('venue_id'),('latlng')) m(model)
  cross join range(0,5) t(g) left join metrics x on x.model=m.model and x.level='G'||g"""))
def _(spark, sf):
    return cmp.complete_grid(metrics(spark, sf).select("model", "level", "accuracy", "n_total"), (*MODELS, "latlng"), LEVELS)


@query("marginal_gains", "W12",
       sql("metrics", f"""select model, from_level, level, {rnd('coalesce(accuracy-before,0)',6)} as gain from (select *, lag(accuracy) over w as before,
  lag(level) over w as from_level from metrics window w as (partition by model order by level)) where from_level is not null"""))
def _(spark, sf):
    return cmp.marginal_gains(metrics(spark, sf), "accuracy")


@query("tier_crossover", "M12 M13",
       sql("metrics", f"""select level, a.f1 as first_value, b.f1 as second_value, {rnd('a.f1-b.f1',4)} as delta,
  case when a.f1>b.f1 then 'enriched' when a.f1<b.f1 then 'venue_id' else 'tie' end as winner from metrics a join metrics b using (level)
  where a.model='enriched' and b.model='venue_id'"""))
def _(spark, sf):
    return cmp.compare_arms(metrics(spark, sf), "model", *MODELS, ["level"], "f1")


#: Settings of a run: negatives from the same region or from anywhere, with a few examples or none, tuned or plain.
CONTRASTS = (("hard", "easy"), ("few", "zero"), ("tuned", "plain"))
_SETTINGS = [x for pair in CONTRASTS for x in pair]
part("runs", (), f"""select setting, model, 'G'||g as level, doc_id, quality as label, case when doc_id%10=0 or (setting='tuned' and g=4) then null
  when {draw('run','setting','model',"'G'||g",'doc_id')}%100 < 52+4*g+length(setting) then quality else 1-quality end as prediction
  from labels, (values {", ".join(f"('{x}')" for x in _SETTINGS)}) s(setting), (values ('enriched'),('venue_id')) m(model), range(0,5) t(g)
  where not (setting='few' and g=0)""")
part("run_metrics", ("runs",), _BINARY.format(by="setting, model, level,", src="runs", group="group by setting, model, level"))


@query("arm_deltas", "M13",
       sql("run_metrics", "select contrast, metric, model, level, first_value, second_value, "
           + f"{rnd('first_value-second_value',4)} as delta, case when first_value>second_value then a when first_value<second_value then b else 'tie' end as winner from ("
           + " union all ".join(
               f"select '{a} - {b}' as contrast, '{n}' as metric, '{a}' as a, '{b}' as b, x.model, x.level, x.{n} as first_value, y.{n} as second_value"
               f" from run_metrics x join run_metrics y on x.model=y.model and x.level=y.level and x.setting='{a}' and y.setting='{b}'"
               for a, b in CONTRASTS for n in ("accuracy", "f1")) + ")"))
def _(spark, sf):
    """Hard - easy, few - zero and tuned - plain per model and level; conditions without one side are left out."""
    grid = roles.table(spark, sf, "labels")
    for name, values in (("setting", _SETTINGS), ("model", MODELS), ("level", LEVELS)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    grid = grid.filter(~((F.col("setting") == "few") & (F.col("level") == "G0")))
    g = F.substring("level", 2, 1).cast("int")
    right = hash_draw("run", "setting", "model", "level", "doc_id") % 100 < 52 + 4 * g + F.length("setting")
    silent = (F.col("doc_id") % 10 == 0) | ((F.col("setting") == "tuned") & (F.col("level") == "G4"))
    rows = grid.select("setting", "model", "level", F.col("quality").alias("label"),
                       F.when(~silent, F.when(right, F.col("quality")).otherwise(1 - F.col("quality"))).alias("prediction"))
    metrics = ev.binary_metrics(rows, by=["setting", "model", "level"])
    return cmp.arm_deltas(metrics, "setting", CONTRASTS, ["model", "level"], ["accuracy", "f1"])


@query("disagreement", "M14 J13",
       sql("preds", f"""select level, count(*) as n_cases, {rnd('avg(same::int)',4)} as agreement_rate, count(*) filter (not same) as n_disagreements,
  count(*) filter (not same and r1 and not r2) as first_right, count(*) filter (not same and r2 and not r1) as second_right,
  count(*) filter (not same and r1=r2) as both_wrong,
  {rnd(ratio('count(*) filter (not same and r1 and not r2)','count(*) filter (not same)'),4)} as first_right_rate,
  {rnd(ratio('count(*) filter (not same and r2 and not r1)','count(*) filter (not same)'),4)} as second_right_rate,
  case when count(*) filter (not same and r1 and not r2) > count(*) filter (not same and r2 and not r1) then 'enriched'
  when count(*) filter (not same and r1 and not r2) < count(*) filter (not same and r2 and not r1) then 'venue_id' else 'tie' end as winner
  from (select level, a.prediction is not distinct from b.prediction as same, a.prediction is not distinct from a.label as r1,
  b.prediction is not distinct from a.label as r2 from preds a join preds b using (level, doc_id) where a.model='enriched' and b.model='venue_id') group by 1"""))
def _(spark, sf):
    p = predictions(spark, sf)
    return cmp.disagreement(
        p.filter(F.col("model") == "enriched"), p.filter(F.col("model") == "venue_id"), ["doc_id"], MODELS, ["level"]
    )


def _intervals_sql(rows: str, by: list[str]) -> str:
    """Intervals of the means of ``v`` (millionths) in ``rows``: one Poisson weight per different value and resample."""
    g = ", ".join(by)
    digests = f"({key('boot', *by, 'v', 'b')}||{key('boot+', *by, 'v', 'b')})"
    draws = ", ".join(f"('0x'||substr(h,{8 * i + 1},8))::BIGINT as d{i}" for i in range(8))
    small = "+".join(
        f"case when c&{1 << i}>0 then {'+'.join(f'(d{i}>={x})::int' for x in ev.poisson_borders(float(1 << i)))} else 0 end" for i in range(6)
    )
    z = "(sqrt(-2.0*ln(d6/4294967296.0::DOUBLE+1/4294967296.0::DOUBLE))*cos(2*pi()*(d7/4294967296.0::DOUBLE)))"
    mean = "(c-c%64)::DOUBLE"
    large = f"case when c>=64 then floor(greatest({mean}+sqrt({mean})*{z}+({z}*{z}-1)/6,0)+0.5) else 0 end"
    return f"""select {g}, {rnd('quantile_cont(m,0.025)',6)} as ci_lower, {rnd('quantile_cont(m,0.975)',6)} as ci_upper, count(*) as n_resamples
  from (select {g}, b, sum(v*w)/nullif(sum(w),0)::DOUBLE/1e6 as m from (select *, ({small}+{large})::BIGINT as w from (select *, {draws} from (
  select *, {digests} as h from (select {g}, v, count(*) as c from ({rows}) where v is not null group by all), range(0,{N_RESAMPLES}) t(b))))
  group by all) group by all"""


_BORDERS = " + ".join(f"(d>={b})::int" for b in ev.poisson_thresholds())


@query("bootstrap_interval", "M10",
       sql("preds", f"""select model, level, {rnd('quantile_cont(m,0.025)',6)} as ci_lower, {rnd('quantile_cont(m,0.975)',6)} as ci_upper, count(*) as n_resamples
  from (select model, level, b, sum(v*w)/sum(w)::DOUBLE as m from (select *, {_BORDERS} as w from (select model, level, b, (prediction=label)::int as v,
  {draw('boot','doc_id','b')} as d from preds, range(0,{N_RESAMPLES}) t(b) where prediction is not null)) where w>0 group by all) group by all"""))
def _(spark, sf):
    rows = predictions(spark, sf)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return ev.row_bootstrap_interval(rows, ["doc_id"], hit, N_RESAMPLES, by=["model", "level"])


@query("effect_of_enrichment", "M15",
       sql("metrics", f"""select level, {rnd('(a.accuracy-b.accuracy)*100',2)} as delta_pp, case when a.accuracy-b.accuracy>0.005 then 'helps'
  when a.accuracy-b.accuracy<-0.005 then 'hurts' else 'neutral' end as effect from metrics a join metrics b using (level)
  where a.model='enriched' and b.model='venue_id'"""))
def _(spark, sf):
    arms = cmp.compare_arms(metrics(spark, sf), "model", *MODELS, ["level"], "accuracy")
    delta = F.col("first_value") - F.col("second_value")
    return arms.select("level", round_to(delta * 100, 2).alias("delta_pp"), cmp.effect_label(delta).alias("effect"))


@query("importance_shares", "M16",
       sql("", f"""select name, is_enrichment, {rnd('imp',4)} as importance, {rnd('imp*100/sum(imp) over ()',2)} as share_pct,
  {rnd('(sum(imp) filter (is_enrichment) over ())*100/sum(imp) over ()',2)} as enrichment_share_pct, (row_number() over (order by imp desc, name))::INTEGER as position
  from (select p_brand as name, right(p_brand,1) in ('1','3','5') as is_enrichment, sum(p_size)::DOUBLE as imp from part group by 1)"""))
def _(spark, sf):
    rows = roles.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.sum("p_size").cast("double").alias("importance")
    )
    return cmp.importance_shares(rows.withColumn("is_enrichment", F.substring("name", -1, 1).isin("1", "3", "5")))


@query("regression_metrics", "M9 F9",
       sql("reviews", f"""select city, {rnd('avg(abs(stars-p))',4)} as mae, {rnd('sqrt(avg((stars-p)*(stars-p)))',4)} as rmse, {rnd('avg((abs(stars-r)=0)::int)',4)} as exact,
  {rnd('avg((abs(stars-r)<=1)::int)',4)} as within_1, count(*) as n from (select *, least(greatest(round_even(p,0),1),5) as r from
  (select *, 0.5+(length(business_name)%11)*0.5::DOUBLE as p from reviews)) group by 1"""))
def _(spark, sf):
    rows = reviews.reviews(spark, sf).withColumn("p", F.lit(0.5) + F.length("business_name") % 11 * F.lit(0.5))
    return ev.regression_metrics(rows, "stars", "p", by=["city"])


# -- answers and rankings --------------------------------------------------------

_ANSWERS = ("[3, 1, 2]", "Ranking: [2,1,3]", "3, 1, 3, 2", "none", "4", "Yes.", "\n\tYES, friends", "\t No.\n")
_CASES = " ".join(f"when {i} then '{a}'" for i, a in enumerate(_ANSWERS))
part("answers", (), f"select event_id, event_type, (event_id%3)::INTEGER as truth_pos, case event_id%8 {_CASES} end as answer from events")
part("parsed", ("answers",), r"""select *, case event_id%8 when 0 then [2,0,1] when 1 then [1,0,2] when 2 then [2,0,1] end as ranking from answers""")


def answers(spark, sf):
    e = roles.table(spark, sf, "events")
    return e.select(
        "event_id", "event_type", (F.col("event_id") % 3).cast("int").alias("truth_pos"),
        F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("event_id") % 8).cast("int")).alias("answer"),
    )


@query("parse_ranking", "X6 F14", sql("parsed", "select event_id, array_to_string(ranking,',') as ranking from parsed"))
def _(spark, sf):
    rows = answers(spark, sf).withColumn("ranking", parsing.parse_ranking("answer", 3))
    return rows.select("event_id", F.array_join("ranking", ",").alias("ranking"))


@query("parse_star_yes_no_minutes", "X7 X8 X9 F14",
       sql("answers", r"""select event_id, nullif(regexp_extract(answer,'\b([1-5])\b',1),'')::INTEGER as star,
  case when lower(answer) like 'yes%' then 1 when lower(answer) like 'no%' then 0 end as yes_no,
  coalesce(try_cast(nullif(regexp_extract(answer,'[\d.]+'),'') as double),15.0) as minutes
  from (select event_id, regexp_replace(answer,'^\s+|\s+$','','g') as answer from answers)"""))
def _(spark, sf):
    return answers(spark, sf).select(
        "event_id", parsing.parse_star("answer").alias("star"), parsing.parse_yes_no("answer").alias("yes_no"),
        parsing.parse_minutes("answer").alias("minutes"),
    )


@query("numbers_in_texts", "X6 X9 F14",
       sql("", r"""select doc_id, coalesce(try_cast(nullif(regexp_extract(text,'[\d.]+'),'') as double),15.0) as minutes,
  nullif(regexp_extract(trim(text),'\b([1-5])\b',1),'')::INTEGER as star from documents"""))
def _(spark, sf):
    return roles.table(spark, sf, "documents").select(
        "doc_id", parsing.parse_minutes("text").alias("minutes"), parsing.parse_star("text").alias("star")
    )


@query("ranking_metrics", "M7 X6",
       sql("parsed", f"""select event_type, {rnd("avg((coalesce(list_position(ranking,truth_pos),0)=1)::int) filter (ranking is not null)",6)} as acc_at_1,
  {rnd("avg((coalesce(list_position(ranking,truth_pos),0) between 1 and 5)::int) filter (ranking is not null)",6)} as acc_at_5,
  {rnd("avg(coalesce(1.0/nullif(list_position(ranking,truth_pos),0),0)) filter (ranking is not null)",6)} as mrr,
  count(*) as n_total, count(ranking) as n_valid, count(*)-count(ranking) as n_parse_failures from parsed group by 1"""))
def _(spark, sf):
    rows = answers(spark, sf).withColumn("ranking", parsing.parse_ranking("answer", 3))
    return ev.ranking_metrics(rows, by=["event_type"])


_AT = "list_position(ranking,truth_pos)"
_RANK_VALUES = f"""select event_type as model, 'G'||(event_id%5) as level, unnest([{{'metric': 'acc_at_1', 'x': (coalesce({_AT},0)=1)::int::DOUBLE}},
  {{'metric': 'acc_at_5', 'x': (coalesce({_AT},0) between 1 and 5)::int::DOUBLE}}, {{'metric': 'mrr', 'x': coalesce(1.0/nullif({_AT},0),0)::DOUBLE}}]) as i
  from parsed where ranking is not null"""


@query("ranking_intervals", "M10 M7",
       sql("parsed", _intervals_sql(f"select model, level, i.metric as metric, round(i.x*1e6)::BIGINT as v from ({_RANK_VALUES})", ["model", "level", "metric"])))
def _(spark, sf):
    """Intervals of every ranking metric per model (the kind of event) and level."""
    rows = answers(spark, sf).withColumn("ranking", parsing.parse_ranking("answer", 3)).select(
        F.col("event_type").alias("model"), F.concat(F.lit("G"), F.col("event_id") % 5).alias("level"), "ranking", "truth_pos"
    )
    return ev.ranking_intervals(rows, by=["model", "level"], n_resamples=N_RESAMPLES)


_RESULT_SQL = """select model, level, event_id, event_id%7=6 as bad, label, prediction, case when model='ranker' then ranking end as ranking,
  case when model='ranker' then truth_pos end as truth_pos, case when event_id%3=0 then event_id%100 end as tokens, event_id%4=0 as cached from (
  select *, case when event_id%2=0 then 'labeller' else 'ranker' end as model, 'G'||(event_id%5) as level,
  case when event_id%2=0 then (event_id%4)//2 end as label, case when event_id%2=0 and event_id%6<>0 then 1 end as prediction from parsed)"""


def _result_files(spark, sf):
    """Files of two shapes per level: labels with predictions, rankings with usage; with missing fields and bad lines."""
    from placewise.session import scratch_path

    rows = answers(spark, sf).withColumn("ranking", parsing.parse_ranking("answer", 3))
    n = F.col("event_id")
    usage = F.when(n % 3 == 0, F.struct((n % 100).alias("total_tokens")))
    labelled = F.to_json(F.struct(n.alias("index"), (F.floor(n % 4 / 2)).alias("label"), F.when(n % 6 != 0, 1).alias("prediction"),
                                  usage.alias("usage"), (n % 4 == 0).alias("cached")))
    # A null ranking is written out, as an answer that could not be read is.
    ranked = F.to_json(F.struct(n.alias("index"), "ranking", F.col("truth_pos").alias("ground_truth_idx"), usage.alias("usage")),
                       {"ignoreNullFields": "false"})
    line = F.when(n % 7 == 6, F.lit("{not json")).when(n % 2 == 0, labelled).otherwise(ranked)
    condition = F.concat(F.when(n % 2 == 0, "labeller").otherwise("ranker"), F.lit("__G"), n % 5)
    path = scratch_path(spark, "results")
    for name in [f"{m}__G{g}" for m in ("labeller", "ranker") for g in range(5)]:
        rows.filter(condition == name).select(line.alias("value")).write.text(f"{path}/{name}")
    return f"{path}/*"


@query("result_file_counts", "S15 S14 A30",
       sql("parsed", f"""select model, level, count(*) filter (not bad) as n_total, count(*) filter (not bad and prediction is null and ranking is null) as n_unanswered,
  count(*) filter (bad) as n_bad, coalesce(sum(tokens) filter (not bad),0)::BIGINT as total_tokens, count(*) filter (cached and not bad and model='labeller') as cached_responses
  from ({_RESULT_SQL}) group by all"""))
def _(spark, sf):
    from placewise.sources.requests import read_results, result_counts

    return result_counts(read_results(spark, _result_files(spark, sf)))


@query("ranking_file_metrics", "S15 M7 M11",
       sql("parsed", f"""select level, {rnd(f"avg((coalesce({_AT},0)=1)::int) filter (ranking is not null)",6)} as acc_at_1,
  {rnd(f"avg((coalesce({_AT},0) between 1 and 5)::int) filter (ranking is not null)",6)} as acc_at_5, {rnd(f"avg(coalesce(1.0/nullif({_AT},0),0)) filter (ranking is not null)",6)} as mrr,
  count(*) as n_total, count(ranking) as n_valid, count(*)-count(ranking) as n_parse_failures from ({_RESULT_SQL}) where not bad and model='ranker' group by level"""))
def _(spark, sf):
    from placewise.sources.requests import read_results

    rows = read_results(spark, _result_files(spark, sf)).filter((F.col("model") == "ranker") & ~F.col("is_bad"))
    return ev.ranking_metrics(rows, by=["level"])


@query("usage_totals", "A30",
       sql("", "select event_type, sum(event_id%100)::BIGINT as total_tokens, count(*) filter (event_id%4=0) as cached_responses from events group by 1"))
def _(spark, sf):
    rows = roles.table(spark, sf, "events").select(
        "event_type", F.struct((F.col("event_id") % 100).alias("total_tokens")).alias("usage"),
        (F.col("event_id") % 4 == 0).alias("cached"),
    )
    return ev.usage_totals(rows, by=["event_type"])


@query("rank_yes_no_answers", "W11",
       sql("test pool", f"""select query_id, candidate_zone, (row_number() over (partition by query_id order by ({draw('yn','query_id','candidate_zone')}%4=0)::int desc,
  {key('ties','query_id','candidate_zone')}, candidate_zone))::INTEGER as rank from cases""", **trips.cases_sql("test", 20)))
def _(spark, sf):
    said = F.when(hash_draw("yn", "query_id", "candidate_zone") % 4 == 0, "\n\tYes.").otherwise("\tno")
    rows = trips.cases(spark, sf).withColumn("prediction", said)
    return ev.rank_yes_no(rows, ["query_id"], "candidate_zone", "prediction").select("query_id", "candidate_zone", "rank")


@query("rank_by_score_reversed_ties", "W10 W9",
       sql("bcand reviews", """select user_id, business_id, (row_number() over (partition by user_id order by n desc, pos desc))::INTEGER as rank
  from bcand join (select business_id, count(*) as n from reviews group by 1) using (business_id)"""))
def _(spark, sf):
    n = reviews.reviews(spark, sf).groupBy("business_id").agg(F.count(F.lit(1)).alias("score"))
    rows = reviews.candidates(spark, sf).join(n, "business_id")
    ranked = ev.rank_candidates(rows, ["user_id"], "score", [F.col("pos").desc()])
    return ranked.select("user_id", "business_id", "rank")


@query("random_and_popularity_lines", "M19",
       sql("test pool dest", f"""select 'random' as line, 0.05 as acc_at_1, 0.25 as acc_at_5, {rnd('(select sum(1.0/r)/20 from range(1,21) t(r))',4)} as mrr, null::BIGINT as n_queries
  union all select 'popularity', {rnd('avg((r=1)::int)',4)}, {rnd('avg((r<=5)::int)',4)}, {rnd('avg(1.0/r)',4)}, count(*) from (select label,
  row_number() over (partition by query_id order by coalesce(do_count,0) desc, candidate_zone) as r from cases left join dest on do_zone=candidate_zone) where label=1""",
           **trips.cases_sql("test", 20)))
def _(spark, sf):
    from placewise.operators.trip_stats import destination_stats

    counts = destination_stats(trips.day_counts(spark, sf)).select(
        F.col("do_zone").alias("candidate_zone"), F.col("do_count").alias("popularity")
    )
    popular = ev.popularity_line(trips.cases(spark, sf), ["query_id"], "candidate_zone", counts, [F.col("candidate_zone")])
    line = ev.random_line(20)
    chance = popular.select(
        F.lit("random").alias("line"), *[round_to(F.lit(line[c]), 4).alias(c) for c in ("acc_at_1", "acc_at_5", "mrr")],
        F.lit(None).cast("bigint").alias("n_queries"),
    )
    return chance.unionByName(popular.withColumn("line", F.lit("popularity")))


# -- features: projections, cleaning, correlation ----------------------------------


@staged
def enriched_pairs(spark, sf):
    names = feature_names("friendship", "enriched")
    rows = pairs.features(spark, sf, "enriched")
    return rows.select(*pairs.PAIR, "label", *[round_to(c, 4).alias(c) for c in names])


_E, _P = enriched_names("friendship"), [n for n in feature_names("friendship", "enriched") if n not in enriched_names("friendship")]
_PAIRS_SQL = pairs.features_sql("enriched")


def _corr(a: str, b: str) -> str:
    ok = f"stddev_pop({a})>1e-9 and stddev_pop({b})>1e-9"
    return f"case when {ok} then corr({a},{b}) else 0 end"


@query("enrichment_correlations", "A31 P10",
       f"""with f as ({_PAIRS_SQL}), w as (select {', '.join(f'{_corr(a,b)} as "{a}|{b}"' for a in _E for b in _P)} from f)
  select split_part(k,'|',1) as first, split_part(k,'|',2) as second, {rnd('r',4)} as r from (unpivot w on * into name k value r)""")
def _(spark, sf):
    rows = cmp.cross_correlations(enriched_pairs(spark, sf), _E, _P)
    return rows.withColumn("r", round_to("r", 4))


@query("enrichment_correlation_summary", "A31",
       f"""with f as ({_PAIRS_SQL}), w as (select {', '.join(f'{_corr(a,b)} as "{a}|{b}"' for a in _E for b in _P)} from f)
  select {rnd('avg(abs(r))',4)} as mean_correlation, {rnd('max(abs(r))',4)} as max_correlation, count(*) filter (abs(r)>0.3) as pairs_above_03,
  count(*) filter (abs(r)>0.5) as pairs_above_05, count(*) as n_pairs from (unpivot w on * into name k value r)""")
def _(spark, sf):
    return cmp.correlation_summary(cmp.cross_correlations(enriched_pairs(spark, sf), _E, _P))


def _level_pairs_sql() -> str:
    """Correlations of every enrichment with every plain column of a level, from the columns' moments."""
    named = []
    for g in LEVELS:
        own = enriched_names("friendship", g)
        named += [f"('{g}','{a}|{b}')" for a in own for b in feature_names("friendship", "enriched", g) if b not in own]
    return f"""f as ({_PAIRS_SQL}), w as (select {', '.join(f'{_corr(a,b)} as "{a}|{b}"' for a in _E for b in _P)} from f),
  r as (select level, split_part(k,'|',1) as first, split_part(k,'|',2) as second, abs(r) as r from (unpivot w on * into name k value r)
  join (values {', '.join(named)}) v(level, k) using (k))"""


@query("enrichment_redundancy", "A31",
       f"""with {_level_pairs_sql()} select level, {rnd('avg(r)',4)} as mean_correlation, {rnd('max(r)',4)} as max_correlation,
  count(*) filter (r>0.3) as pairs_above_03, count(*) filter (r>0.5) as pairs_above_05, count(*) as n_pairs from r group by level""")
def _(spark, sf):
    """The summary of every level, from one matrix over all columns."""
    return cmp.correlation_summary(_level_correlations(spark, sf), ["level"])


@query("most_correlated_pairs", "A31",
       f"""with {_level_pairs_sql()} select level, position::INTEGER as position, first, second, {rnd('r',3)} as correlation from (
  select *, row_number() over (partition by level order by round(r,9) desc, first, second) as position from r) where position<=5""")
def _(spark, sf):
    """The five most correlated pairs of every level, from the same matrix."""
    return cmp.top_correlations(_level_correlations(spark, sf), 5)


def _level_correlations(spark, sf):
    levels = {g: (enriched_names("friendship", g), feature_names("friendship", "enriched", g)) for g in LEVELS}
    return cmp.level_correlations(enriched_pairs(spark, sf), levels)


@query("features_at_level_two", "P9",
       f"with f as ({_PAIRS_SQL}) select user_a, user_b, {', '.join(feature_names('friendship','enriched','G2'))} from f")
def _(spark, sf):
    from placewise.plans.levels import at_level

    return at_level(enriched_pairs(spark, sf), "friendship", "enriched", "G2", pairs.PAIR)


@query("features_without_enrichment", "P10",
       f"with f as ({_PAIRS_SQL}) select user_a, user_b, {', '.join(_P)} from f")
def _(spark, sf):
    from placewise.plans.levels import without_enrichment

    return without_enrichment(enriched_pairs(spark, sf), "friendship", "G4", pairs.PAIR)


@query("column_moments", "M5",
       f"with f as ({_PAIRS_SQL}), " + "w as (select " + ", ".join(f'avg({c}) as "m|{c}", stddev_pop({c}) as "s|{c}"' for c in _E + _P) + f""" from f)
  select split_part(k,'|',2) as name, {rnd("max(v) filter (k like 'm|%')",4)} as mean, {rnd("max(v) filter (k like 's|%')",4)} as std
  from (unpivot w on * into name k value v) group by 1""")
def _(spark, sf):
    from placewise.operators.models import column_moments

    return column_moments(enriched_pairs(spark, sf), _E + _P).select(
        "name", round_to("mean", 4).alias("mean"), round_to("std", 4).alias("std")
    )


@query("finite_values", "P11 F8",
       sql("", f"""select event_id, {rnd("case when event_id%5=0 then 0 when event_id%5 in (1,2) then 0 else value end",4)} as plain,
  {rnd("case when event_id%5=0 then 0 when event_id%5=1 then 1e6 when event_id%5=2 then -1e6 else value end",4)} as clipped from events"""))
def _(spark, sf):
    n = F.col("event_id") % 5
    raw = F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("inf"))).when(n == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return roles.table(spark, sf, "events").select(
        "event_id", round_to(finite_or_zero(raw), 4).alias("plain"), round_to(finite_or_zero(raw, 1e6), 4).alias("clipped")
    )


@query("star_rounding", "F9",
       sql("", "select event_id, least(greatest(round_even(value/2,0),1),5)::INTEGER as star from events"))
def _(spark, sf):
    return roles.table(spark, sf, "events").select("event_id", star_prediction(F.col("value") / 2).alias("star"))


@query("item_vectors", "V14 F10",
       sql("", f"""select vec_id, len(embedding)+6 as n_dims, {rnd("list_sum(list_transform(embedding, lambda x: x::DOUBLE))+label+vec_id%7+3.5",4)} as total,
  {rnd("embedding[1]::DOUBLE",6)} as first, {rnd("label::DOUBLE",6)} as after from embeddings"""))
def _(spark, sf):
    """Model inputs of a list item: its embedding and six numbers of the summary after it."""
    from placewise.functions.vectors import item_vector

    numbers = [F.col("label").cast("double"), (F.col("vec_id") % 7).cast("double"), F.lit(0.5), F.lit(1.0), F.lit(2.0), F.lit(0.0)]
    rows = roles.table(spark, sf, "embeddings").withColumn("v", item_vector(F.col("embedding").cast("array<double>"), F.array(*numbers)))
    return rows.select(
        "vec_id", F.size("v").cast("long").alias("n_dims"), round_to(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        round_to(F.get("v", F.lit(0)), 6).alias("first"), round_to(F.get("v", F.size("v") - 6), 6).alias("after"),
    )


@query("embedding_pair_vectors", "F10 V14",
       sql("", f"""select a.vec_id, 4*len(a.embedding)+2 as n_dims, {rnd("list_sum(list_transform(range(1,len(a.embedding)+1), lambda i: (a.embedding[i]::DOUBLE-b.embedding[i]::DOUBLE)))",4)} as sum_diff,
  {rnd("list_sum(list_transform(range(1,len(a.embedding)+1), lambda i: (a.embedding[i]::DOUBLE*b.embedding[i]::DOUBLE)))",4)} as sum_product
  from embeddings a join embeddings b on b.vec_id=a.vec_id+1"""))
def _(spark, sf):
    e = roles.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y"), F.col("label").alias("lb"))
    rows = a.join(b, "vec_id")
    extra = F.array(F.col("la").cast("double"), F.col("lb").cast("double"))
    rows = rows.withColumn("v", pair_vector(F.col("x"), F.col("y"), extra)).withColumn("d", F.size("x"))
    add = lambda acc, x: acc + x
    return rows.select(
        "vec_id", F.size("v").cast("long").alias("n_dims"),
        round_to(F.aggregate(F.slice("v", 2 * F.col("d") + 1, F.col("d")), F.lit(0.0), add), 4).alias("sum_diff"),
        round_to(F.aggregate(F.slice("v", 3 * F.col("d") + 1, F.col("d")), F.lit(0.0), add), 4).alias("sum_product"),
    )


# -- request ledger ------------------------------------------------------------------

_DOC = """'{"max_tokens":64,"messages":'||to_json(text)::VARCHAR||',"model":"m","temperature":0.0}'"""
_OLD = """'{"messages":'||to_json(text)::VARCHAR||',"model":"m","temperature":0.0}'"""
part("reqs", (), f"""select conv_id||'-'||turn as custom_id, conv_id, turn, text, sha256({_DOC}) as key, sha256({_OLD}) as older_key from conversations""")
# Two thirds of the conversations have been asked before, one third of them under the older key.
part("done", ("reqs",), """select key, min(content) as content from (select case when conv_id%3=0 then key else older_key end as key,
  case when turn%4=3 then '' else 'answer '||length(text) end as content from reqs where conv_id%3<2) group by 1""")


@staged
def requests(spark, sf):
    rows = roles.table(spark, sf, "conversations")
    model, temperature, text = F.lit("m"), F.lit(0.0), F.col("text")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"), "conv_id", "turn", "text",
        ledger.request_key(model, text, temperature, F.lit(64)).alias("key"),
        ledger.request_key(model, text, temperature, None).alias("older_key"),
    )


def done(spark, sf):
    rows = requests(spark, sf).filter(F.col("conv_id") % 3 < 2)
    k = F.when(F.col("conv_id") % 3 == 0, F.col("key")).otherwise(F.col("older_key"))
    content = F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit("answer "), F.length("text").cast("string")))
    return rows.select(k.alias("key"), content.alias("content")).groupBy("key").agg(F.min("content").alias("content"))


@query("request_keys", "F11", sql("reqs", "select custom_id, key, older_key from reqs"))
def _(spark, sf):
    return requests(spark, sf).select("custom_id", "key", "older_key")


@query("pending_requests", "C1 J15", sql("reqs done", "select custom_id from reqs where key not in (select key from done)"))
def _(spark, sf):
    return ledger.pending(requests(spark, sf), done(spark, sf)).select("custom_id")


@query("answered_requests", "C2 J15",
       sql("reqs done", """select custom_id, case when a.key is not null then a.content else b.content end as content, a.key is null as from_older_key
  from reqs r left join done a on a.key=r.key left join done b on b.key=r.older_key and b.content<>'' where a.key is not null or b.key is not null"""))
def _(spark, sf):
    return ledger.answered(requests(spark, sf), done(spark, sf)).select("custom_id", "content", "from_older_key")


@query("unique_texts", "C3",
       sql("", """select key, count(*) as n_rows, min(length(text)) as n_chars from (select sha256('model:256:'||text) as key, text from documents) group by 1"""))
def _(spark, sf):
    keyed, distinct = ledger.unique_texts(roles.table(spark, sf, "documents"), "text", ("model", "256"))
    sizes = distinct.select("key", F.length("text").cast("long").alias("n_chars"))
    # Fan out again: the number of rows each distinct text stands for.
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).join(sizes, "key").select("key", "n_rows", "n_chars")


@query("cases_left_to_do", "C4", sql("", "select distinct conv_id from conversations where conv_id not in (select conv_id from conversations where turn>=3)"))
def _(spark, sf):
    rows = roles.table(spark, sf, "conversations")
    finished = rows.filter(F.col("turn") >= 3).select("conv_id").distinct()
    return ledger.not_completed(rows.select("conv_id").distinct(), finished, "conv_id")


@query("missing_answers", "C5",
       sql("reqs", "select turn, count(*) as n_requests, count(*) filter (conv_id%5=0) as n_missing from reqs group by 1"))
def _(spark, sf):
    responses = requests(spark, sf).filter(F.col("conv_id") % 5 != 0).select("custom_id", F.upper("text").alias("text"))
    collected = ledger.collect_answers(requests(spark, sf).drop("text"), responses, "No reasoning.")
    return ledger.missing_counts(collected, ["turn"])
