"""The data flow over ``events`` in SQL, as named parts that the catalog's SQL builds on."""

CHAIN = """
with cyc as (
  select user_id as engine, (row_number() over w)::int as cycle,
    (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::int as op_mode,
    hour(ts)::double as op1, value as s1, json_extract_string(props, '$.k')::double as s2,
    round(ln(1 + coalesce((epoch_us(ts) - lag(epoch_us(ts)) over w)::double / 1e6::double, 0::double)), 6) as s3
  from events window w as (partition by user_id order by ts, event_id)),
life as (select engine, count(*) as cycle_count, max(cycle) as max_cycle from cyc group by 1),
strat as (select engine, cycle_count, max_cycle, greatest(ceil(((r - 1) * 5)::double / greatest(t - 1, 1)) - 1, 0)::int as stratum
  from (select *, row_number() over (order by max_cycle, engine) as r, count(*) over () as t from life)),
quo as (select *, n - f1 - f2 - f3 as rest from (select stratum, n, floor(e1) as f1, floor(e2) as f2, floor(e3) as f3, e1 - floor(e1) as r1, e2 - floor(e2) as r2, e3 - floor(e3) as r3
  from (select stratum, count(*) as n, round(count(*) * 0.6::double, 9) as e1, round(count(*) * 0.2::double, 9) as e2, round(count(*) * 0.2::double, 9) as e3 from strat group by 1))),
spl as (select engine, cycle_count, max_cycle, s.stratum, case
    when i <= f1 + ((r2 > r1)::int + (r3 > r1)::int < rest)::int then 'train'
    when i <= f1 + ((r2 > r1)::int + (r3 > r1)::int < rest)::int + f2 + ((r1 >= r2)::int + (r3 > r2)::int < rest)::int then 'validation' else 'test' end as split
  from (select *, row_number() over (partition by stratum order by md5(engine::varchar || ':42'), engine) as i from strat) s join quo using (stratum)),
cs as (select c.*, split, max_cycle, cycle <= floor(max_cycle::double * 0.3::double) as healthy from cyc c join spl using (engine)),
fitrows as (select * from cs where split = 'train' and healthy),
gscal as (select avg(s1) as m1, avg(s2) as m2, avg(s3) as m3, stddev_pop(s1) as d1, stddev_pop(s2) as d2, stddev_pop(s3) as d3, count(*) as n from fitrows),
mscal as (select m.op_mode, coalesce(f.n, 0) as fit_rows, coalesce(f.n, 0) < 30 as fallback,
    case when coalesce(f.n, 0) < 30 then g.m1 else f.m1 end as m1, case when coalesce(f.n, 0) < 30 then g.m2 else f.m2 end as m2, case when coalesce(f.n, 0) < 30 then g.m3 else f.m3 end as m3,
    case when coalesce(f.n, 0) < 30 then g.d1 else f.d1 end as d1, case when coalesce(f.n, 0) < 30 then g.d2 else f.d2 end as d2, case when coalesce(f.n, 0) < 30 then g.d3 else f.d3 end as d3
  from (select unnest(range(5))::int as op_mode) m cross join gscal g left join (select op_mode, count(*) as n, avg(s1) as m1, avg(s2) as m2, avg(s3) as m3, stddev_pop(s1) as d1, stddev_pop(s2) as d2, stddev_pop(s3) as d3 from fitrows group by 1) f using (op_mode)),
tr as (select engine, cycle, op_mode, op1, split, max_cycle, healthy, (s1 - m1) / d1 as s1, (s2 - m2) / d2 as s2, (s3 - m3) / d3 as s3 from cs join mscal using (op_mode)),
meta as (select printf('%s:e%03d:c%04d-%04d', split, engine, cycle - 9, cycle) as window_id, engine, split, cycle - 9 as start_cycle, cycle as end_cycle, cycle - 4 as midpoint_cycle, max_cycle, cycle::double / max_cycle as life_fraction, 'unlabeled' as label_state, op_mode from cs where cycle >= 10),
feat as (select printf('%s:e%03d:c%04d-%04d', split, engine, end_cycle - 9, end_cycle) as window_id, * from (select engine, split, op_mode, cycle as end_cycle, cycle - 9 as start_cycle, max_cycle,
    round(avg(s1) over w, 9) as mean_s1, round(avg(s2) over w, 9) as mean_s2, round(avg(s3) over w, 9) as mean_s3,
    round(stddev_pop(s1) over w, 9) as std_s1, round(stddev_pop(s2) over w, 9) as std_s2, round(stddev_pop(s3) over w, 9) as std_s3,
    round(s1 - first(s1) over w, 9) as slope_s1, round(s2 - first(s2) over w, 9) as slope_s2, round(s3 - first(s3) over w, 9) as slope_s3
  from tr window w as (partition by engine order by cycle rows between 9 preceding and current row)) where end_cycle >= 10),
elig as (select * from feat where split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)),
fsc as (select {fsc} from elig),
zf as (select window_id, engine, split, start_cycle, end_cycle, max_cycle, op_mode, {zcols} from feat cross join fsc),
raws as ({raws}),
ref as (select * from raws where split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)),
rcum as (select detector_id, raw_score, max(k) as upto, max(t) as total from (select detector_id, raw_score, row_number() over (partition by detector_id order by raw_score) as k, count(*) over (partition by detector_id) as t from ref) group by 1, 2),
sc as (select s.*, coalesce(r.upto, 0)::double / t.total as alert_score from raws s asof left join rcum r on s.detector_id = r.detector_id and s.raw_score >= r.raw_score join (select detector_id, count(*) as total from ref group by 1) t on s.detector_id = t.detector_id),
scref as (select * from sc where split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)),
rules as (select * from (values ('quantile_0.900', 'quantile', 0.9::double), ('quantile_0.950', 'quantile', 0.95::double), ('quantile_0.975', 'quantile', 0.975::double), ('quantile_0.990', 'quantile', 0.99::double), ('quantile_0.995', 'quantile', 0.995::double), ('mean_plus_1.0_std', 'mean_plus_std', 1::double), ('mean_plus_1.5_std', 'mean_plus_std', 1.5::double), ('mean_plus_2.0_std', 'mean_plus_std', 2::double)) v(rule_id, kind, value)),
lists as (select detector_id, 'global' as context, null::int as op_mode, list(alert_score order by alert_score) as xs, avg(alert_score) as m, stddev_pop(alert_score) as d from scref group by 1
  union all select detector_id, 'per_mode', op_mode, list(alert_score order by alert_score), avg(alert_score), stddev_pop(alert_score) from scref group by 1, 3),
thr as (select detector_id, context, rule_id, op_mode, case when kind = 'quantile' then xs[ceil((len(xs) - 1)::double * value)::int + 1] else m + value * d end as threshold, len(xs)::bigint as reference_count from lists cross join rules),
hist as (select *, list(alert_score) over (partition by detector_id, engine order by end_cycle rows between unbounded preceding and current row) as xs from sc),
sm as (select h.* exclude (xs), a.ewma_id, a.alpha, case when alpha is null then alert_score else list_reduce(xs, lambda s, x: a.alpha * x + (1 - a.alpha) * s) end as smoothed_score
  from hist h cross join (values ('off', null::double), ('alpha_0.20', 0.2::double), ('alpha_0.50', 0.5::double), ('alpha_0.80', 0.8::double)) a(ewma_id, alpha)),
viol as (select s.*, t.threshold, smoothed_score > t.threshold as v from sm s join thr t on t.detector_id = s.detector_id and t.context = 'per_mode' and t.rule_id = 'quantile_0.950' and t.op_mode = s.op_mode where ewma_id = 'alpha_0.20'),
trace as (select *, case when v then row_number() over (partition by detector_id, engine, isl, v order by end_cycle) else 0 end::int as persistence_count from (select *, sum((not v)::int) over (partition by detector_id, engine order by end_cycle) as isl from viol)),
act as (select *, persistence_count >= 3 as alert_active from trace),
ev3 as (select detector_id, engine, min(end_cycle) as event_start_cycle, max(end_cycle) as event_end_cycle, count(*) as event_duration_endpoints from (select *, end_cycle - row_number() over (partition by detector_id, engine order by end_cycle) as g from act where alert_active) group by detector_id, engine, g),
events3 as (select *, row_number() over (partition by detector_id, engine order by event_start_cycle)::int as event_number from ev3),
pol as (select * from (values ('normalized_life_last_10pct_endpoint', 0.1::double, 'endpoint', true), ('normalized_life_last_20pct_endpoint', 0.2::double, 'endpoint', true), ('normalized_life_last_30pct_endpoint', 0.3::double, 'endpoint', true), ('normalized_life_last_20pct_full_window', 0.2::double, 'full_window', false), ('normalized_life_last_30pct_full_window', 0.3::double, 'full_window', false)) v(policy_id, onset_fraction, policy_semantics, selection_policy)),
lab as (select *, case when label_state = 'anomalous' then 1 when label_state = 'healthy' then 0 end as proxy_label from (select *, case when end_cycle < onset_cycle then 'healthy' when policy_semantics = 'full_window' and start_cycle < onset_cycle then 'ambiguous' else 'anomalous' end as label_state
  from (select m.* exclude (label_state), p.*, (floor(max_cycle::double * (1::double - onset_fraction)) + 1)::int as onset_cycle from meta m cross join pol p))),
ons as (select policy_id, engine, any_value(onset_cycle) as onset_cycle, any_value(max_cycle) as max_cycle from lab group by 1, 2),
outc as (select d.detector_id, o.policy_id, o.engine, any_value(onset_cycle) as onset_cycle, any_value(max_cycle) as max_cycle, min(case when event_start_cycle >= onset_cycle then event_start_cycle end) as first_detection,
    count(*) filter (event_start_cycle < onset_cycle) as false_events, count(*) filter (event_start_cycle < onset_cycle and event_end_cycle >= onset_cycle) as crossing_events, count(*) filter (event_start_cycle >= onset_cycle) as detection_events
  from ons o cross join (values ('energy'), ('peak')) d(detector_id) left join events3 e on e.engine = o.engine and e.detector_id = d.detector_id group by 1, 2, 3),
conf as (select a.detector_id, l.policy_id, count(*) filter (alert_active and proxy_label = 1) as tp, count(*) filter (alert_active and proxy_label = 0) as fp, count(*) filter (not alert_active and proxy_label = 0) as tn, count(*) filter (not alert_active and proxy_label = 1) as fn
  from act a join lab l using (window_id) where proxy_label is not null group by 1, 2)
"""

FEATURES = [f"{k}_s{i}" for k in ("mean", "std", "slope") for i in (1, 2, 3)]

CHAIN = (
    CHAIN.replace("{fsc}", ", ".join(f"avg({f}) as a_{f}, case when stddev_pop({f}) > 1e-12 then stddev_pop({f}) else 1 end as b_{f}" for f in FEATURES))
    .replace("{zcols}", ", ".join(f"({f} - a_{f}) / b_{f} as {f}" for f in FEATURES))
)

_SQUARES = {"energy": FEATURES, "level": FEATURES[:3], "spread": FEATURES[3:6], "drift": FEATURES[6:]}
SCORES = {k: f"({' + '.join(f'{f} * {f}' for f in fs)}) / {len(fs)}" for k, fs in _SQUARES.items()} | {"peak": f"greatest({', '.join(f'abs({f})' for f in FEATURES)})"}


def chain(select: str, sources: tuple[str, ...] = ("energy", "peak")) -> str:
    """``select`` over the named parts, of which ``raws`` has the scores of those sources."""
    ids = "window_id, engine, split, start_cycle, end_cycle, max_cycle, op_mode"
    raws = " union all ".join(f"select {ids}, '{k}' as detector_id, round({SCORES[k]}, 9) as raw_score from zf" for k in sources)
    return CHAIN.replace("{raws}", raws) + "\n" + select
