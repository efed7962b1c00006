"""Queries on the data-processing operators, over whole tables, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.regular_grid import regular_grid
from tidegraph.operators.rolling_totals import rolling_totals
from tidegraph.operators.skewed_keys import heavy_keys, per_key_stats
from tidegraph.operators.spikes import flag_readings

YEAR_S = 365 * 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "ts"), "id", "ts", "v", 0.035).select("id")


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    s = per_key_stats(table(spark, d, "ts"), "id", "ts", "v")
    return s.select("id", "n_rows", "n_values", "v_min", "v_max", "v_sum", "v_mean", F.unix_micros("first_order").alias("first_us"), F.unix_micros("last_order").alias("last_us"), "first_value", "last_value", "max_step", "change")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "ts"), "id", "ts", "v").where("n = 0").select("id", "slot")


def p2_days(spark: SparkSession, d: str) -> DataFrame:
    """The periods from the first to the last reading of each source and UTC day, as p2_found has them."""
    return regular_grid(table(spark, d, "ts"), "id", "ts", "v")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every period from a source's first to its last reading, nights and empty days included.

    A silence of more than a year divides a source's life: clocks reset to 1970 would stretch it to decades. p2_life has these too.
    """
    return regular_grid(table(spark, d, "ts"), "id", "ts", "v", whole_life=True, max_silence_s=YEAR_S)


def p2_life(spark: SparkSession, d: str) -> DataFrame:
    """Every period from a source's first to its last reading, however long it was silent: 52 years of them for a clock reset to 1970."""
    return regular_grid(table(spark, d, "ts"), "id", "ts", "v", whole_life=True)


def p2_life_sums(spark: SparkSession, d: str) -> DataFrame:
    """What p2_life has of each source and status, few enough rows to be held against the SQL."""
    sums = (F.count(F.lit(1)).alias("periods"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.sum("slot").alias("slot_sum"), F.sum("n").alias("n"), F.sum("filled").alias("filled_sum"))
    return p2_life(spark, d).groupBy("id", "status").agg(*sums)


def _turbine_days(spark: SparkSession, d: str) -> DataFrame:
    """The rows, repeated ones once, with their day; a day that no calendar has is null."""
    rows = table(spark, d, "wtur_avg").distinct()
    first = F.make_date(F.when(F.col("year").between(1, 9999), F.col("year")), F.when(F.col("month").between(1, 12), F.col("month")), F.lit(1))
    return rows.withColumn("calendar_day", F.when(F.col("day").between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, F.col("day") - 1)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = rolling_totals(_turbine_days(spark, d), ["site_label", "wtur_label"], "calendar_day", "avg_val", (7, 30), per_quarter=True)
    late = F.datediff("day", F.date_trunc("quarter", "day").cast("date")) >= 29
    return r.where(late & (10 * F.col("total_7d") < F.col("total_30d"))).select("site_label", "wtur_label", F.date_format("day", "yyyy-MM-dd").alias("calendar_day"))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling_totals(_turbine_days(spark, d), ["site_label", "wtur_label"], "calendar_day", "avg_val", (7, 30))
    # totals are sums of quarters and therefore exact; a mean is rounded, for it is a quotient
    return r.select("site_label", "wtur_label", F.date_format("day", "yyyy-MM-dd").alias("calendar_day"), "total_7d", "n_7d", F.round("mean_7d", 3).alias("mean_7d"), "total_30d", "n_30d", F.round("mean_30d", 3).alias("mean_30d"))


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_readings(table(spark, d, "ts1"), table(spark, d, "sensors"), "id", "timestamp", "value", "dp", "phys_min", "phys_max").withColumnRenamed("row", "dp")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).select("dp")


QUERIES = {f.__name__: f for f in (p1_found, p1_key_stats, p2_found, p2_grid, p2_life, p2_life_sums, p2_days, p3_found, p3_rolling, p5_found, p5_flags)}

_BUCKETS = """
r as (select id, epoch_us(ts) us, v from ts where id is not null and ts is not null and v is not null),
b as (select id, us // 86400000000 seg, us // 600000000 * 600 slot, count(*) n, avg(v) v_mean, min(v) v_min, max(v) v_max,
    arg_max(v, (us, v)) v_last from r group by all),
g as (select id, seg, unnest(generate_series(min(slot), max(slot), 600)) slot from b group by id, seg)"""

_LIFE = """
with r as (select id, epoch_us(ts) us, v from ts where id is not null and ts is not null and v is not null),
b as (select id, us // 600000000 * 600 slot, count(*) n, avg(v) v_mean, min(v) v_min, max(v) v_max, arg_max(v, (us, v)) v_last from r group by all),
g as (select id, unnest(generate_series(min(slot), max(slot), 600)) slot from b group by id),
j as (select g.id, g.slot, coalesce(n, 0) n, v_mean, v_min, v_max, v_last from g left join b using (id, slot)),
f as (select *, last_value(case when n > 0 then slot end ignore nulls) over w seen, last_value(v_last ignore nulls) over w carried
    from j window w as (partition by id order by slot))
select id, slot, n, v_mean, v_min, v_max, v_last, case when slot - seen <= 3600 then carried end filled,
    case when n > 0 then 'observed' when slot - seen <= 3600 then 'carried' else 'missing' end status from f"""

_DAYS = """
rows as (select distinct * from wtur_avg where site_label is not null and wtur_label is not null),
daily as (select site_label, wtur_label, make_date(year, month, day) d, count(avg_val) n, coalesce(sum(avg_val), 0) total from rows group by all)"""

# told by running medians, where the operator goes by wavelet details
_FLAGS = """
with r as (select dp, id, epoch_us(timestamp) t, min(value) v from ts1 where dp is not null and id is not null and timestamp is not null and value is not null group by all),
b as (select id, max(phys_min) lo, min(phys_max) hi from sensors group by id),
o as (select r.*, coalesce(v < lo or v > hi, false) impossible, v - lag(v) over w step, row_number() over w ix from r left join b using (id) window w as (partition by id order by t, dp)),
i as (select *, ix - row_number() over (partition by id, v order by ix) island from o),
s as (select *, count(*) over (partition by id, v, island) >= 10 stuck from i),
d as (select id, median(abs(step)) m, min(abs(step)) filter (where step <> 0) least from o where step is not null group by id),
n as (select id, greatest(m / 0.6745, least(sqrt(avg(pow(least(abs(step), 4 * d.least), 2))), d.least)) / sqrt(2) scale from o join d using (id) where step is not null group by id, m, d.least),
l as (select dp, id, t, ix, v, median(v) over (partition by id order by ix rows between 5 preceding and 5 following) mid from s where not impossible),
u as (select l.*, case when abs(v - mid) > 8 * scale then sign(v - mid) else 0 end off, row_number() over (partition by id order by ix) nr from l join n using (id)),
g as (select *, nr - row_number() over (partition by id, off order by nr) island from u),
k as (select dp, id, ix from (select *, count(*) over (partition by id, off, island) size from g) where off <> 0 and size <= 3)
select dp, impossible, stuck, k.dp is not null spike from s left join k using (dp, id, ix) where impossible or stuck or k.dp is not null"""

SQL = {
    "p5_flags": _FLAGS,
    "p5_found": f"select dp from ({_FLAGS})",
    "p1_found": "select id from ts where id is not null group by id having count(*) >= 0.035 * (select count(*) from ts)",
    "p1_key_stats": """
with o as (select *, epoch_us(ts) us, lag(epoch_us(ts)) over (partition by id order by ts) p from ts),
b as (select id, v, lag(v) over (partition by id order by ts, v) pv from ts where ts is not null and v is not null),
e as (select id, arg_min(v, (epoch_us(ts), v)) first_value, arg_max(v, (epoch_us(ts), v)) last_value from ts where ts is not null and v is not null group by id),
c as (select id, sum(abs(v::bigint - pv))::bigint change from b group by id),
s as (select id, count(*) n_rows, count(v) n_values, min(v)::bigint v_min, max(v)::bigint v_max, sum(v)::bigint v_sum, avg(v) v_mean,
    min(us) first_us, max(us) last_us, max(us - p) filter (where p is not null) max_step from o group by id)
select s.*, first_value::bigint first_value, last_value::bigint last_value, coalesce(change, 0) change
from s left join e on s.id is not distinct from e.id left join c on s.id is not distinct from c.id""",
    "p2_found": f"with {_BUCKETS} select id, slot from g anti join b using (id, slot)",
    "p2_days": f"""
with {_BUCKETS},
j as (select g.id, g.seg, g.slot, coalesce(n, 0) n, v_mean, v_min, v_max, v_last from g left join b using (id, seg, slot)),
f as (select *, last_value(case when n > 0 then slot end ignore nulls) over w seen, last_value(v_last ignore nulls) over w carried
    from j window w as (partition by id, seg order by slot))
select id, slot, n, v_mean, v_min, v_max, v_last, case when slot - seen <= 3600 then carried end filled,
    case when n > 0 then 'observed' when slot - seen <= 3600 then 'carried' else 'missing' end status from f""",
    "p2_grid": f"""
with r as (select id, epoch_us(ts) us, v from ts where id is not null and ts is not null and v is not null),
b as (select id, us // 600000000 * 600 slot, count(*) n, avg(v) v_mean, min(v) v_min, max(v) v_max, arg_max(v, (us, v)) v_last from r group by all),
s as (select id, slot, slot - lag(slot) over (partition by id order by slot) > {YEAR_S} begins from b),
l as (select id, slot, count(*) filter (where begins) over (partition by id order by slot) life from s),
g as (select id, unnest(generate_series(min(slot), max(slot), 600)) slot from l group by id, life),
j as (select g.id, g.slot, coalesce(n, 0) n, v_mean, v_min, v_max, v_last from g left join b using (id, slot)),
f as (select *, last_value(case when n > 0 then slot end ignore nulls) over w seen, last_value(v_last ignore nulls) over w carried
    from j window w as (partition by id order by slot))
select id, slot, n, v_mean, v_min, v_max, v_last, case when slot - seen <= 3600 then carried end filled,
    case when n > 0 then 'observed' when slot - seen <= 3600 then 'carried' else 'missing' end status from f""",
    "p2_life_sums": f"""select id, status, count(*) periods, min(slot) first_slot, max(slot) last_slot, sum(slot)::bigint slot_sum, sum(n)::bigint n,
    sum(filled)::bigint filled_sum from ({_LIFE}) group by id, status""",
    "p3_found": f"""
with {_DAYS},
c as (select site_label, wtur_label, unnest(generate_series(date_trunc('quarter', d)::date + 29, max(d), interval 1 day))::date d
    from daily group by site_label, wtur_label, date_trunc('quarter', d)),
t as (select c.*, coalesce(sum(total) filter (where c.d - x.d < 7), 0) t7, coalesce(sum(total), 0) t30
    from c left join daily x on c.site_label = x.site_label and c.wtur_label = x.wtur_label and x.d between c.d - 29 and c.d group by all)
select site_label, wtur_label, strftime(d, '%Y-%m-%d') calendar_day from t where 10 * t7 < t30""",
    "p3_rolling": f"""
with {_DAYS},
c as (select site_label, wtur_label, unnest(generate_series(min(d), max(d), interval 1 day))::date d from daily group by site_label, wtur_label)
select c.site_label, c.wtur_label, strftime(c.d, '%Y-%m-%d') calendar_day,
    coalesce(sum(total) filter (where c.d - x.d < 7), 0) total_7d, coalesce(sum(n) filter (where c.d - x.d < 7), 0)::bigint n_7d,
    round(sum(total) filter (where c.d - x.d < 7 and n > 0) / nullif(sum(n) filter (where c.d - x.d < 7), 0), 3) mean_7d,
    coalesce(sum(total), 0) total_30d, coalesce(sum(n), 0)::bigint n_30d, round(sum(total) / nullif(sum(n), 0), 3) mean_30d
from c left join daily x on c.site_label = x.site_label and c.wtur_label = x.wtur_label and x.d between c.d - 29 and c.d
group by all""",
}
