"""Queries of sources, joins, deduplication, set operations and text classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import economics as E
from tidemark.functions import text as T
from tidemark.operators import tables as O
from tidemark.operators.mentions import mention_features, mentions
from tidemark.sources import landed as D
from tidemark.sources import tables as S
from tidemark.sources.landed import asof_features, store_features
from tidemark.sources.staging import new_folder


@query("s03_lazy_scan", "select event_id, user_id, value from events where event_type = 'purchase' and value >= 50")
def scan(spark, d):
    return S.table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("value") >= 50)).select("event_id", "user_id", "value")


@query(
    "s05_market_payloads",
    """select cast(event_id as varchar) as ticker, case when event_type in ('view', 'click', 'error') then cast(round(cast(value as decimal(12, 2)) * 100) as bigint) else event_id % 100 end as last_price_cents, cast(event_id % 1000 as double) as volume, event_type = 'error' as can_close_early from events""",
)
def market_payloads(spark, d):
    e = S.table(spark, d, "events")
    dollars = F.format_string('"last_price_dollars": "%s"', F.col("value").cast("decimal(12,2)").cast("string"))
    whole = F.format_string('"last_price": %d', F.pmod("event_id", F.lit(100)))
    size = F.when(F.pmod("event_id", F.lit(2)) == 0, F.format_string('"volume": %d', F.pmod("event_id", F.lit(1000)))).otherwise(F.format_string('"volume_fp": "%d.00"', F.pmod("event_id", F.lit(1000))))
    early = F.when(F.col("event_type") == "error", "true").otherwise("false")
    payload = F.concat(F.lit('{"ticker": "'), F.col("event_id").cast("string"), F.lit('", '), F.when(F.col("event_type").isin("view", "click", "error"), dollars).otherwise(whole), F.lit(", "), size, F.lit(', "can_close_early": '), early, F.lit("}"))
    return D.market_rows(e.select(payload.alias("payload"))).select("ticker", "last_price_cents", "volume", "can_close_early")


@query("s06_trade_payloads", "select cast(event_id as varchar) as trade_id, cast(user_id as varchar) as ticker, 1 + event_id % 99 as yes_price_cents, cast(event_id % 7 as double) as count, false as is_block_trade from events")
def trade_payloads(spark, d):
    payload = F.format_string('{"trade_id": "%d", "ticker": "%d", "yes_price": %d, "count": %d}', "event_id", "user_id", 1 + F.pmod("event_id", F.lit(99)), F.pmod("event_id", F.lit(7)))
    return D.trade_rows(S.table(spark, d, "events").select(payload.alias("payload"))).select("trade_id", "ticker", "yes_price_cents", "count", "is_block_trade")


@query(
    "s07_metadata_rows",
    "select cast(o_custkey as varchar) as ticker, min(cast(o_orderkey as varchar)) as event_ticker, count(*) > 0 as known from orders group by o_custkey",
)
def metadata(spark, d):
    payload = F.format_string('{"ticker": "%d", "event_ticker": "%d", "floor_strike": "%d"}', "o_custkey", "o_orderkey", F.pmod("o_orderkey", F.lit(9)))
    return D.metadata_rows(S.table(spark, d, "orders").select(payload.alias("payload"))).select("ticker", "event_ticker", F.lit(True).alias("known"))


@query(
    "s09_hourly_forecasts",
    """with h as (select user_id as station, date_trunc('day', ts) as day, ts, value from events), e as (select station, day, lead, max(value) as hi, min(value) as lo, max(ts) as last from h, (values (1), (2)) l(lead) group by all)
    select station, lead as lead_days, cast(cast(day as date) as varchar) as target_date, weather_stat, case when weather_stat = 'max' then round(hi + lead, 4) else round(lo + lead, 4) end as forecast_f, date_trunc('second', last) - to_days(lead) + interval 6 hour as available_at from e, (values ('max'), ('min')) s(weather_stat)""",
)
def hourly(spark, d):
    e = S.table(spark, d, "events")
    # A payload holds one hour of a station, and of each second the extremes: at most 7,200 values, however many events there are.
    second = e.groupBy(F.col("user_id").alias("station"), F.date_trunc("second", "ts").alias("at")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    row = F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "hi", "lo")
    g = second.groupBy("station", F.date_trunc("hour", "at").alias("hour")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    values = lambda k: F.concat(F.transform("r", lambda x: (x["hi"] + k).cast("string")), F.transform("r", lambda x: (x["lo"] + k).cast("string")))
    times = F.transform("r", lambda x: x["t"])
    hourly_map = F.create_map(F.lit("time"), F.concat(times, times), F.lit("temperature_2m_previous_day1"), values(1), F.lit("temperature_2m_previous_day2"), values(2))
    payload = F.to_json(F.struct(hourly_map.alias("hourly")))
    out = D.hourly_forecasts(g.select("station", F.lit("UTC").alias("timezone"), payload.alias("payload")))
    return out.select("station", "lead_days", F.col("target_date").cast("string").alias("target_date"), "weather_stat", F.round("forecast_f", 4).alias("forecast_f"), F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query(
    "s10_daily_observations",
    """with x as (select o_custkey as station, cast(o_orderdate as date) as date, max(o_totalprice) as hi, min(o_totalprice) as lo from orders group by all)
    select station, cast(date as varchar) as target_date, s as weather_stat, case s when 'max' then hi else lo end as observed_f, cast(date + 2 as timestamp) + interval 5 hour as available_at from x, (values ('max'), ('min')) v(s)""",
)
def observations(spark, d):
    o = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("station"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("tmax"), F.min("o_totalprice").alias("tmin"))
    return D.daily_observations(o.withColumn("timezone", F.lit("GMT-5"))).withColumns({"available_at": F.col("available_at").cast("timestamp_ntz"), "target_date": F.col("target_date").cast("string")})


@query(
    "s11_station_temperature",
    """select l_orderkey, l_linenumber, count(*) as n, round(sum(case when l_quantity = 50 or l_linenumber in (2, 3, 6, 7) then null else l_quantity * 10 / 10.0 * 9.0 / 5.0 + 32.0 end), 4) as f from lineitem group by all""",
)
def temperature(spark, d):
    li = S.table(spark, d, "lineitem")
    q = (F.col("l_quantity") * 10).cast("int")
    raw = F.concat(F.lit("+"), F.lpad(F.when(F.col("l_quantity") == 50, 9999).otherwise(q).cast("string"), 4, "0"), F.lit(","), F.col("l_linenumber").cast("string"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(T.station_temperature(raw)), 4).alias("f"))


FORMS = "case when o_orderpriority like '1%' then 'S-1' when o_orderpriority like '2%' then 'F-1/A' else 'X' end"


@query(
    "s12_filings",
    f"""with h as (select o_custkey % 300 as entity, {FORMS} as form, cast(o_orderdate as date) as file_date from orders) select e.entity, coalesce(arg_max(h.form, (h.file_date, h.form)), 'NO_MATCH') as value, cast(max(h.file_date) as varchar) as file_date
    from (select distinct entity from h) e left join h on h.entity = e.entity and form <> 'X' and file_date <= date '1995-06-01' group by e.entity""",
)
def filings(spark, d):
    p = F.col("o_orderpriority")
    h = S.table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(300)).alias("entity"), F.when(p.startswith("1"), "S-1").when(p.startswith("2"), "F-1/A").otherwise("X").alias("form"), F.to_date("o_orderdate").alias("file_date"))
    return D.filing_features(h, h, F.lit("1995-06-01").cast("timestamp")).select("entity", "value", F.col("file_date").cast("string").alias("file_date"))


@query("s16_normalised_features", "select cast(user_id as varchar) as entity, event_type as metric, cast(cast(ts as date) as timestamp) as available_at, arg_max(cast(event_id as varchar), (ts, cast(event_id as varchar))) as value from events group by all")
def normalised(spark, d):
    e = S.table(spark, d, "events")
    day = F.date_trunc("day", "ts")
    f = e.select(F.lit("events").alias("source"), F.col("user_id").alias("entity"), F.col("event_type").alias("metric"), day.alias("effective_at"), day.alias("available_at"), F.col("ts").alias("retrieved_at"), F.col("event_id").alias("value"), F.lit("r1").alias("revision"), F.lit("").alias("evidence"))
    return D.normalise_features(f).select("entity", "metric", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "value")


@query("p11_new_markets", "select cast(p_partkey as varchar) as ticker from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49) and p_size % 5 <> 0")
def new_markets(spark, d):
    page = S.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.concat(F.lit("S"), F.pmod("p_size", F.lit(5)).cast("string"), F.lit("-X")).alias("event_ticker"))
    series = spark.createDataFrame([("S0", "excluded"), ("S1", "deployment")], "ticker string, tier string")
    stored = S.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("ticker"))
    return D.new_markets(page, series, stored).select("ticker")


@query("j02_lookup_coalesce", "select o_orderkey, coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, o_orderpriority) as label from orders left join customer on o_custkey = c_custkey")
def lookup(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.col("c_mktsegment")).alias("segment"))
    return O.override(S.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label")), c, "o_custkey", "label", "segment").select("o_orderkey", "label")


@query("j03_semi_join", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi(spark, d):
    big = S.table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j04_u04_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 150000)")
def anti(spark, d):
    return O.missing_keys(S.table(spark, d, "customer").select("c_custkey"), S.table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "j06_full_outer",
    f"with {S.FILLS}, a as (select ticker, count(*) as dn from fills where period = 'discovery' group by 1), b as (select ticker, count(*) as cn from fills where period <> 'discovery' group by 1) select ticker, dn, cn from a full join b using (ticker)",
)
def full_outer(spark, d):
    # One conditional aggregation says what the join of two aggregates would.
    is_d = F.col("period") == "discovery"
    g = S.fills(spark, d).groupBy("ticker").agg(F.count_if(is_d).alias("dn"), F.count_if(~is_d).alias("cn"))
    return g.select("ticker", F.nullif("dn", F.lit(0)).alias("dn"), F.nullif("cn", F.lit(0)).alias("cn"))


@query("j07_exact_prints", f"with {S.TRADES} select a.trade_id, b.count from trades a join trades b on a.ticker = b.ticker and a.created_time = b.created_time and a.yes_price_cents = b.yes_price_cents where a.yes_price_cents <= 20")
def exact_prints(spark, d):
    t = S.trades(spark, d)
    a = t.where("yes_price_cents <= 20").select("ticker", "created_time", "yes_price_cents", "trade_id")
    return a.join(t.select("ticker", "created_time", "yes_price_cents", "count"), ["ticker", "created_time", "yes_price_cents"]).select("trade_id", "count")


@query("j20_dictionary", "select l_suppkey, n_name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all")
def dictionary(spark, d):
    n = F.broadcast(S.table(spark, d, "nation"))  # 25 rows at every scale
    s = S.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    g = S.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return g.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "n_name", "n")


@query("w01_running_sums", f"with {S.TRADES} select trade_id, cast(sum(count) over w as bigint) as volume, cast(sum(case when taker_side = 'yes' then count else 0 end) over w as bigint) as yes_volume from trades window w as (partition by ticker order by created_time, trade_id rows unbounded preceding)")
def running_sums(spark, d):
    w = Window.partitionBy("ticker").orderBy("created_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    yes = F.when(F.col("taker_side") == "yes", F.col("count")).otherwise(0)
    return S.trades(spark, d).select("trade_id", F.sum("count").over(w).alias("volume"), F.sum(yes).over(w).alias("yes_volume"))


@query("w08_log_norm", "with v as (select l_suppkey, ln(1 + count(*)) as v from lineitem group by 1) select l_suppkey, round(v / max(v) over (), 6) as score from v")
def log_norm(spark, d):
    v = S.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.log1p(F.count(F.lit(1))).alias("v"))
    top = v.agg(F.max("v").alias("top"))  # one row
    return v.crossJoin(F.broadcast(top)).select("l_suppkey", F.round(F.col("v") / F.col("top"), 6).alias("score"))


@query("t03_top_per_group", f"with {S.TRADES} select ticker, trade_id, count from trades qualify row_number() over (partition by ticker order by count desc, trade_id) <= 5")
def top_per_group(spark, d):
    return O.pick(S.trades(spark, d), ["ticker"], [F.desc("count"), F.col("trade_id")], 5).select("ticker", "trade_id", "count")


@query("t05_preferred_row", f"with {S.TRADES} select ticker, trade_id from trades qualify row_number() over (partition by ticker order by case when taker_side = 'no' then 0 else 1 end, created_time, trade_id) = 1")
def preferred(spark, d):
    rank = F.when(F.col("taker_side") == "no", 0).otherwise(1)
    return O.pick(S.trades(spark, d), ["ticker"], [rank, F.col("created_time"), F.col("trade_id")]).select("ticker", "trade_id")


@query("t06_t07_latest", f"with {S.TRADES} select ticker, arg_max(trade_id, created_time) as trade_id, arg_max(yes_price_cents, created_time) as yes_price_cents from trades group by ticker")
def latest(spark, d):
    return O.latest(S.trades(spark, d), "ticker", F.col("created_time")).select("ticker", "trade_id", "yes_price_cents")


@query("t01_t02_sorted_head", "select c_custkey, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey limit 20")
def head(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(20)


@query("u01_u02_union", "select n_nationkey as key, n_name as name, null as region from nation union all select r_regionkey, r_name, r_regionkey from region union all select s_suppkey, s_name, null from supplier")
def union(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    r = S.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("region"))
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"))
    return O.union_all([r, n, s]).select("key", "name", "region")


@query("u03_distinct", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def distinct(spark, d):
    return S.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("u05_subset", "select not exists (select 1 from orders where o_custkey not in (select c_custkey from customer)) as complete, count(*) as expected from (select distinct o_custkey from orders)")
def subset(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    gone = O.missing_keys(o, S.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k").agg(F.count(F.lit(1)).alias("m"))
    return o.agg(F.count(F.lit(1)).alias("expected")).crossJoin(gone).select((F.col("m") == 0).alias("complete"), "expected")


WORDS = "regexp_matches(lower(text), '{}')"


@query(
    "s08_series_catalogue",
    """with p as (select c_custkey, 'KX' || (c_custkey % 400) as ticker, case c_custkey % 6 when 0 then 'deployment' when 1 then 'instrumentation' when 2 then 'instrumentation' when 3 then 'instrumentation' when 4 then 'excluded' else 'deployment' end as tier, c_custkey % 6 as k from customer)
    select ticker, case when k = 4 then 'excluded' else tier end as tier, 'Title ' || k as title from (select case when k = 4 then 'XX' || ticker else ticker end as ticker, tier, k, c_custkey from p) qualify row_number() over (partition by ticker order by c_custkey) = 1""",
)
def catalogue(spark, d):
    c = S.table(spark, d, "customer").withColumn("k", F.pmod("c_custkey", F.lit(6)))
    k = F.col("k")
    ticker = F.concat(F.when(k == 4, "XX").otherwise(""), F.lit("KX"), F.pmod("c_custkey", F.lit(400)).cast("string"))
    category = F.when(k == 1, "Sports").when(k == 2, "Crypto").otherwise("Politics")
    tags = F.when(k == 3, F.array(F.lit(" Sports "), F.lit("x"))).otherwise(F.array(F.lit("x")))
    payload = F.to_json(F.struct(ticker.alias("ticker"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), category.alias("category"), tags.alias("tags")))
    landed = c.select(F.col("c_custkey").alias("landed"), payload.alias("payload"))
    return D.series_catalogue(landed, excluded=("XX",)).select("ticker", "tier", "title")


@query(
    "p03_tiers",
    r"""select doc_id, case when upper(lang || '-' || doc_id) like 'ES-1%' then 'excluded' when regexp_matches(lower(text), '\b(?:sports?|esports|athlete|baseball|basketball|football|hockey|soccer|tennis|golf|golfer|cricket|boxing|wrestling|wrestler|olympics?|super bowl|world cup|stanley cup|mlb|nba|nfl|nhl|wnba|ncaa|cfb|atp|uefa|fifa|ufc|madden|btc|eth|bitcoin)\b')
    or source = 'src3' then 'instrumentation' else 'deployment' end as tier from documents""",
)
def tiers(spark, d):
    t = T.tier(F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")), F.lit(None).cast("string"), F.col("text"), F.array(F.when(F.col("source") == "src3", "Sports ").otherwise("none")), excluded=("ES-1",))
    return S.table(spark, d, "documents").select("doc_id", t.alias("tier"))


@query(
    "e21_rule_classes",
    r"""select doc_id, case when regexp_matches(text, '(?i)\b(substantial(?:ly)?|significant(?:ly)?|credible|consensus|acknowledg(?:e|es|ed)|attribut(?:e|es|ed|ion)|determined\s+by|according\s+to|deemed|considered)\b') then 'judgment_or_attribution'
    when regexp_matches(text, '(?i)\b(signed\s+into\s+law|officially\s+(?:announc|confirm)|filed\s+with|published\s+by|recorded\s+by|certified\s+by|sworn\s+in|takes?\s+office)\b') then 'official_act'
    when doc_id % 7 = 0 or doc_id % 5 = 1 or (regexp_matches(text, '\d') and regexp_matches(text, '(?i)\b(value|price|rate|temperature|votes?|points?|percent|%|above|below)\b')) then 'numeric_objective' else 'unclassified' end as class from documents""",
)
def rule_classes(spark, d):
    floor = F.when(F.pmod("doc_id", F.lit(7)) == 0, 1.0)
    expiration = F.when(F.pmod("doc_id", F.lit(5)) == 1, " 12.5").otherwise("Yes ")
    return S.table(spark, d, "documents").select("doc_id", T.rule_class(F.col("text"), floor, F.lit(None).cast("double"), expiration).alias("class"))


@query(
    "e22_ladder_direction",
    """with x as (select o_orderkey, case o_custkey % 4 when 0 then '10 or above' when 1 then 'under 5' when 2 then 'above or below' end as sub, case when o_orderkey % 2 = 0 then 'must exceed 3' else 'at most 4' end as rules from orders)
    select o_orderkey, case when sub like '%or above' then 'above' when sub like 'under%' then 'below' when rules like 'must%' then 'above' else 'below' end as direction from x""",
)
def ladder_direction(spark, d):
    k = F.pmod("o_custkey", F.lit(4))
    sub = F.when(k == 0, "10 or above").when(k == 1, "under 5").when(k == 2, "above or below")
    rules = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "must exceed 3").otherwise("at most 4")
    return S.table(spark, d, "orders").select("o_orderkey", T.ladder_direction(sub, rules).alias("direction"))


@query("e23_target_dates", "select o_orderkey, case when o_orderkey % 5 <> 0 then cast(cast(o_orderdate as date) as varchar) end as target_date from orders")
def target_dates(spark, d):
    code = F.upper(F.date_format("o_orderdate", "yyMMMdd"))
    day = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.concat(F.substring(code, 1, 5), F.lit("39"))).otherwise(code)
    # Two-digit years mean 20yy; the tables' years are brought back for comparison.
    got = T.target_date(F.concat(F.lit("EV-"), day))
    return S.table(spark, d, "orders").select("o_orderkey", F.when(F.year(got) >= 2050, F.add_months(got, F.lit(-1200))).otherwise(got).cast("string").alias("target_date"))


@query(
    "e24_last_names",
    """select c_custkey, case when c_custkey % 3 = 0 then 'Smith' || c_custkey when c_custkey % 3 = 1 then 'O' || c_custkey else 'III' end as last from customer""",
)
def last_names(spark, d):
    k = F.pmod("c_custkey", F.lit(3))
    c = F.col("c_custkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Ann Smith"), c, F.lit(" Jr."))).when(k == 1, F.concat(F.lit(" Bo  O"), c, F.lit(" IV"))).otherwise("III")
    return S.table(spark, d, "customer").select("c_custkey", T.last_name(name).alias("last"))


@query(
    "e19_source_classes",
    r"""select page_id, case when page_id % 4 = 0 then 'missing' when page_id % 4 = 1 then 'government' when page_id % 4 = 2 then 'exchange_or_data' else 'media_or_other' end as class from pages""",
)
def source_classes(spark, d):
    k = F.pmod("page_id", F.lit(4))
    host = F.when(k == 1, "https://www.bureau.gov/x").when(k == 2, "http://prices.nasdaq.com").otherwise("https://paper.example.org/a?b=c")
    raw = F.when(k == 0, F.when(F.pmod("page_id", F.lit(8)) == 0, "not json").otherwise("[]")).otherwise(F.concat(F.lit('[{"url": "'), host, F.lit('"}]')))
    return S.table(spark, d, "pages").select("page_id", T.source_class(raw).alias("class"))


@query(
    "e20_host_scores",
    r"""with h as (select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') as host from pages), c as (select * from (values ('example.com', 0.8, 0.5), ('m.ththth.example.net', 0.9, 1.0), ('example.net', 0.6, 0.4)) c(suffix, upstream, pit)),
    b as (select page_id, max((upstream, pit, suffix)) as best from h join c on host = suffix or ends_with(host, '.' || suffix) group by page_id) select h.page_id, cast(coalesce(best[1], 0.3) as double) as upstream, cast(coalesce(best[2], 0.3) as double) as pit from h left join b using (page_id)""",
)
def host_scores(spark, d):
    catalog = spark.createDataFrame([("example.com", 0.8, 0.5), ("m.ththth.example.net", 0.9, 1.0), ("example.net", 0.6, 0.4)], "suffix string, upstream double, pit double")
    return T.host_scores(S.table(spark, d, "pages"), "page_id", "url", catalog)


@query("e26_session_days", "select o_orderkey, cast((select count(*) from generate_series(cast(o_orderdate as date), cast(o_orderdate as date) + cast(o_orderkey % 40 as integer) - 1, interval 1 day) t(x) where isodow(x) < 6 and not x between timestamp '1995-03-01' and timestamp '1995-08-15') as bigint) as days from orders")
def session_days(spark, d):
    today = F.to_date("o_orderdate")
    closed = F.array(F.struct(F.lit("1995-03-01").cast("date").alias("begin"), F.lit("1995-08-15").cast("date").alias("end")))
    days = T.session_days(today, F.date_add(today, F.pmod("o_orderkey", F.lit(40)).cast("int")), closed)
    return S.table(spark, d, "orders").select("o_orderkey", days.cast("long").alias("days"))


@query(
    "x20_information_atlas",
    """with v as (select l_suppkey, count(*) as n, sum(l_quantity) as q, avg(l_discount) as gap from lineitem group by 1), s as (select l_suppkey, n, ln(1 + q) / max(ln(1 + q)) over () as flow, case when n < 100 then 0.3 else greatest(0, least(gap - 0.02, 0.05)) / 0.05 end as tail from v)
    select l_suppkey, round(case when flow <= 0 or tail <= 0 then 0 else exp((ln(flow) + ln(tail) + ln(0.5)) / 3) end, 6) as rank_score from s""",
)
def atlas(spark, d):
    v = S.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.log1p(F.sum("l_quantity")).alias("q"), F.avg("l_discount").alias("gap"))
    top = v.agg(F.max("q").alias("top"))  # one row
    s = v.crossJoin(F.broadcast(top))
    scores = F.array(F.col("q") / F.col("top"), E.tail_gap_score(F.col("gap") - 0.02, F.col("n")), F.lit(0.5))
    return s.select("l_suppkey", F.round(E.geometric_mean(scores), 6).alias("rank_score"))


SECTION = "the "
NAME = r"^[^\p{L}]*(\p{L}+)[^\p{L}]+(\p{L}+)"


def named(spark, d):
    """The first two words of each benchmark text, as names to look for."""
    first, last = (F.regexp_extract("text", NAME, i) for i in (1, 2))
    return S.table(spark, d, "benchmark").where(last != "").select(F.concat_ws(" ", first, last).alias("entity"))


def found_mentions(spark, d):
    return mentions(S.table(spark, d, "documents"), named(spark, d), section_word=SECTION)


@query("x25_mentions")
def mentioned(spark, d):
    """Names from a table against every whole document. (SQL would search all texts for all names; a test compares with that on a fixture.)"""
    return found_mentions(spark, d)


@query("x25_mention_features")
def mention_store(spark, d):
    """The same as point-in-time features in their store, read from it as of a later decision."""
    checked = F.lit("2024-02-01 00:00:00")
    features = store_features(mention_features(found_mentions(spark, d), named(spark, d), checked), f"{new_folder(spark)}/features")
    points = named(spark, d).distinct().withColumn("decision_time", F.lit("2024-02-02 00:00:00").cast("timestamp"))
    return asof_features(points, features, "mention").select("entity", F.col("feature_value").alias("value"), F.col("feature_evidence").alias("evidence"))
