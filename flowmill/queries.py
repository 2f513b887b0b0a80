"""The registered queries on the star-schema tables and their DuckDB oracles.

Keys carry the operator ids of the inventory: ``o..`` tables, keys, joins and aggregates, ``i..``
indicators, ``a..`` assumptions, ``p..`` preparation, ``v..`` validation, ``x..`` analytics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.functions import safe
from flowmill.functions.aggspec import AggSpec, Binding, aggregate
from flowmill.functions.keep import kept
from flowmill.operators import analytics, assumptions, capital, flows, indicators, leontief, preparation, recomputed, relational, rollup, validation
from flowmill.plans import registry
from flowmill.plans import run as plan
from flowmill.plans.config import admitted, methods
from flowmill.sources import market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
METHODS = methods()
BASE = "with " + market.SQL
LAM = "with recursive " + market.SQL_LAMBDA
#: Valued flows, balance factor and transfers on top of lambda.
VAL = LAM + """,
val as (select f.*, f.value * l.lam as worth from flow f join lam l on f.year = l.year and f.o_country = l.country and f.o_sector = l.sector),
bf as (select year, sum(worth) filter (o_country <> d_country) / sum(value) filter (o_country <> d_country and o_sector <> 'S4') as bf from val group by year),
tr as (select val.*, bf, case when o_country <> d_country then value * bf - worth else 0 end as transfer from val join bf using (year))"""


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def economy(spark: SparkSession, sf_dir: str, grain: str = "region") -> plan.Economy:
    """One pass over the facts gives the cells, which are kept (years x industries^2 rows at most); flows and
    accounts are made from them. The accounts, which many branches read, are kept too."""
    cells = kept(market.cells(spark, sf_dir, grain), "cells")
    return plan.Economy(market.flows_of(cells), kept(market.accounts_of(cells), "accounts"), market.productive)


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows and accounts of ``economy``. ``market.flows`` and ``market.accounts`` read the facts anew wherever a plan
    or a job uses them, so they are for queries that do so once."""
    e = economy(spark, sf_dir)
    return e.flows, e.accounts


def sector_labels(acc: DataFrame) -> DataFrame:
    return acc.select("sector").distinct().withColumn("productive", market.productive("sector").cast("int"))


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# ---------------------------------------------------------------- masks, keys, projections


@q(BASE + " select year, o_country, o_sector, d_country, d_sector, kind, value from flow where o_sector <> 'S4'")
def o40_productive(s, d):
    f, a = tables(s, d)
    return flows.only_productive(f, sector_labels(a))


@q(BASE + " select year, o_country, o_sector, d_country, d_sector, kind, value from flow where o_country <> d_country")
def o41_trade(s, d):
    return market.flows(s, d).where(flows.trade())


@q(BASE + " select year, o_country, d_country, round(sum(value), 2) as value, count(*) as n from flow group by all")
def o42_bilateral_key(s, d):
    return rounded(market.flows(s, d).groupBy(*flows.PAIR).agg(F.sum("value").alias("value"), F.count("*").alias("n")), 2, "value")


@q(BASE + " select year, d_country as country, o_sector as sector, round(sum(value) filter (o_country <> d_country), 2) as value from flow group by all")
def o43_imports_key(s, d):
    return rounded(flows.imports(market.flows(s, d), {"value": F.col("value")}), 2, "value")


@q(BASE + ", c as (select distinct o_country as c from flow), y as (select distinct year from flow) select y.year, a.c as origin, b.c as destination, round(coalesce(sum(case when a.c <> b.c then value end), 0), 2) as value from y cross join c a cross join c b left join flow f on f.year = y.year and f.o_country = a.c and f.d_country = b.c group by all")
def o44_zero_diagonal(s, d):
    f = economy(s, d).flows
    return rounded(flows.bilateral(f, {"value": F.col("value")}, f.select(F.col("o_country").alias("country")).distinct()), 2, "value")


@q(BASE + ' select year, country, sector, emp as emp_s_un, hours_emp as hours_s_hr, gdp_us as gdp_s_us from acc')
def o45_raw_copy(s, d):
    return indicators.copied(market.accounts(s, d), {"emp_s_un": "emp", "hours_s_hr": "hours_emp", "gdp_s_us": "gdp_us"})


@q(BASE + " select year, country, sector, go_us from acc where year in (1996, 1998) and country in ('ASIA', 'EUROPE') and sector in ('S0', 'S4')")
def o46_label_slice(s, d):
    return market.accounts(s, d).where(F.col("year").isin(1996, 1998) & F.col("country").isin("ASIA", "EUROPE") & F.col("sector").isin("S0", "S4")).select("year", "country", "sector", "go_us")


@q(BASE + " select year, country, sector, round(comp_emp + comp_empe + comp_hs + comp_ms, 2) as total from acc")
def o47_row_sum(s, d):
    return rounded(relational.row_sum(market.accounts(s, d), "^comp_", "total"), 2, "total").select("year", "country", "sector", "total")


def _layers(s: SparkSession, d: str) -> list[DataFrame]:
    p = market.read(s, d, "part")
    layer = lambda low, high, tag: p.where(F.col("p_size").between(low, high)).groupBy(F.col("p_brand").alias("names")).agg(F.min("p_partkey").alias("pos")).withColumn("solution", F.concat(F.lit(tag), F.col("pos").cast("string")))
    return [layer(1, 2, "m"), layer(3, 10, "s"), layer(1, 50, "c")]


_LAYERS = "with l as (select 0 as layer, p_brand as names, min(p_partkey) as pos, 'm' || min(p_partkey) as solution from part where p_size between 1 and 2 group by p_brand union all select 1, p_brand, min(p_partkey), 's' || min(p_partkey) from part where p_size between 3 and 10 group by p_brand union all select 2, p_brand, min(p_partkey), 'c' || min(p_partkey) from part where p_size between 1 and 50 group by p_brand)"


@q(_LAYERS + " select names, pos, solution, layer::int as layer from (select *, row_number() over (partition by names order by layer, pos) as rn from l) where rn = 1")
def o48_precedence(s, d):
    return relational.precedence(_layers(s, d), "names").select("names", "pos", "solution", "layer")


@q("select p_partkey as pos, (p_size % 6)::int as stage, case when p_size % 4 = 0 then null else p_size % 4 end::int as \"order\", row_number() over (order by p_size % 6, case when p_size % 4 = 0 then null else p_size % 4 end nulls last, p_partkey) as place from part")
def o49_execution_order(s, d):
    rows = market.read(s, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 6).cast("int").alias("stage"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4).cast("int").alias("order"))
    return relational.execution_order(rows)


@q("select c_custkey, case when c_acctbal >= 0 then 'finite' else 'source_missing' end as state from customer")
def o53_missing_state(s, d):
    c = market.read(s, d, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return c.select("c_custkey", safe.classify("v", F.col("c_acctbal") < 0).alias("state"))


@q(BASE + " select year, country, sector, indicator, value from (select year, country, sector, 'go_us' as indicator, case when sector = 'S3' and country = 'ASIA' then 'NaN'::double else go_us end as value from acc union all select year, country, sector, 'gdp_us', case when sector = 'S1' and year = 1997 then 'Infinity'::double else gdp_us end from acc union all select year, country, sector, 'hours_emp', hours_emp from acc) where isnan(value) or isinf(value)")
def o54_special_values(s, d):
    """NaN and infinities are planted; all of them have to be found."""
    nan, inf = (F.lit(v).cast("double") for v in ("NaN", "Infinity"))
    a = market.accounts(s, d).withColumns({"go_us": F.when(F.expr("sector = 'S3' and country = 'ASIA'"), nan).otherwise(F.col("go_us")), "gdp_us": F.when(F.expr("sector = 'S1' and year = 1997"), inf).otherwise(F.col("gdp_us"))})
    return safe.special_cells(a, ["go_us", "gdp_us", "hours_emp"], ["year", "country", "sector"])


@q(BASE + " select year, country, sector, case when country = 'ASIA' and sector = 'S4' then 'source_missing' when sector = 'S4' then 'not_applicable' else 'finite' end as declared from acc where sector = 'S4' or country = 'ASIA'")
def o55_declared_states(s, d):
    cells = market.accounts(s, d).where("sector = 'S4' or country = 'ASIA'").select("year", "country", "sector", F.col("sector").alias("indicator"), F.lit("1").alias("checkpoint"))
    rules = s.createDataFrame([("S4", "1", None, "not_applicable"), ("S4", "1", "ASIA", "source_missing")], "indicator string, checkpoint string, country string, state string")
    return safe.declared_states(cells, rules).select("year", "country", "sector", "declared")


@q(BASE + " select year, o_country || '.' || o_sector || '.x' as label, o_country as country, o_sector || '.x' as sector from flow group by all")
def o57_labels(s, d):
    f = market.flows(s, d).select("year", F.concat(flows.joined_label("o_country", "o_sector"), F.lit(".x")).alias("label")).distinct()
    country, sector = flows.split_label(F.col("label"))
    return f.select("year", "label", country.alias("country"), sector.alias("sector"))


@q("select n_nationkey, case n_name when 'NATION_0' then 'UK' else case when n_nationkey % 2 = 0 then 'XA' else null end end as code from (select n_nationkey, case when n_nationkey = 0 then 'NATION_0' else n_name end as n_name from nation)")
def o58_country_codes(s, d):
    key = F.when(F.col("n_nationkey") == 0, "GBR").otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    return market.read(s, d, "nation").select("n_nationkey", relational.iso2(key, {f"N{k}": "XA" for k in range(0, 200, 2)}).alias("code"))


@q("select n_name as country, count(*) filter (s_acctbal > 9000) as n from nation left join supplier on s_nationkey = n_nationkey group by 1 having count(*) filter (s_acctbal > 9000) <> 1")
def o59_exactly_one(s, d):
    sup = market.read(s, d, "supplier").join(market.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("country", F.col("n_name"))
    return relational.not_exactly_one(sup, "country", F.col("s_acctbal") > 9000, market.read(s, d, "nation").select(F.col("n_name").alias("country")))


# ---------------------------------------------------------------- joins


@q(BASE + ", k as (select c.country, t.sector from (select distinct country from acc) c cross join (select distinct sector from acc) t) select 1996::int as year, k.country, k.sector, a.gdp_us from k left join acc a on a.year = 1996 and a.country = k.country and a.sector = k.sector")
def o60_left_join(s, d):
    a = economy(s, d).accounts
    k = relational.skeleton(a.select("country").distinct(), a.select("sector").distinct()).withColumn("year", F.lit(1996))
    return k.join(a.select("year", "country", "sector", "gdp_us"), ["year", "country", "sector"], "left")


@q(BASE + " select c.country, t.sector from (select distinct country from acc) c cross join (select distinct sector from acc) t")
def o61_skeleton(s, d):
    a = economy(s, d).accounts
    return relational.skeleton(a.select("country").distinct(), a.select("sector").distinct())


@q(BASE + " select year, country, sector, case when sector in ('S0', 'S1') then 'hours_hs' else 'hours_ms' end as ktype, case when sector in ('S0', 'S1') then hours_hs else hours_ms end as amount from acc")
def o62_typed_lookup(s, d):
    a = economy(s, d).accounts
    rows = a.select("year", "country", "sector", F.when(F.col("sector").isin("S0", "S1"), "hours_hs").otherwise("hours_ms").alias("ktype"))
    return relational.typed_lookup(rows, a.select("year", "country", "sector", "hours_hs", "hours_ms"), ["year", "country", "sector"], ["hours_hs", "hours_ms"], "ktype", "amount")


@q(BASE + ", t as (select year, country, sector, gdp_us as v from acc where country in ('ASIA', 'EUROPE') union all select year, 'MD', sector, avg(gdp_us) from acc where country in ('ASIA', 'EUROPE') group by all) select a.year, a.country, a.sector, round(t.v, 7) as v from acc a left join t on t.year = a.year and t.sector = a.sector and t.country = case when a.country in ('ASIA', 'EUROPE') then a.country else 'MD' end")
def o63_fallback_join(s, d):
    a = economy(s, d).accounts
    t = preparation.with_mean_country(a.where(F.col("country").isin("ASIA", "EUROPE")).select("year", "country", "sector", F.col("gdp_us").alias("v")), "v")
    return rounded(relational.with_fallback(a.select("year", "country", "sector"), t, "country", "MD", ["year", "sector"]), 7, "v").select("year", "country", "sector", "v")


@q(BASE + " select a.year, a.country, a.sector, round(a.gdp_us / t.total, 9) as share from acc a join (select year, sum(gdp_us) as total from acc group by year) t using (year)")
def o64_broadcast_scalar(s, d):
    a = economy(s, d).accounts
    t = a.groupBy("year").agg(F.sum("gdp_us").alias("total"))
    return rounded(a.join(F.broadcast(t), "year").withColumn("share", F.col("gdp_us") / F.col("total")), 9, "share").select("year", "country", "sector", "share")


@q(BASE + " select a.year, a.country, a.sector, round(a.gdp_us / b.gdp_us, 9) as gdp_us from acc a left join acc b on b.year = 1996 and a.country = b.country and a.sector = b.sector")
def o65_base_year(s, d):
    return rounded(capital.rebased(market.accounts(s, d).select("year", "country", "sector", "gdp_us"), "gdp_us", ["country", "sector"], 1996), 9, "gdp_us")


@q(BASE + " select a.year, a.country, a.sector, b.gdp_us as next from acc a left join acc b on b.year = a.year + 1 and a.country = b.country and a.sector = b.sector")
def o66_year_offset(s, d):
    a = economy(s, d).accounts
    return relational.shifted(a.select("year", "country", "sector"), a.select("year", "country", "sector", F.col("gdp_us").alias("next")), ["country", "sector"], 1)


@q(LAM + " select f.year, f.o_country, f.o_sector, f.d_country, f.d_sector, f.kind, round(f.value * lam, 6) as worth from flow f join lam l on f.year = l.year and f.o_country = l.country and f.o_sector = l.sector")
def o67_lambda_on_flows(s, d):
    e = economy(s, d)
    r = plan.calculate(e, METHODS["wiodr13"])
    return rounded(flows.with_lambda(e.flows, r.lam), 6, "worth").drop("value")


@q("with a as (select distinct l_orderkey as key, year(l_shipdate) as year from lineitem), b as (select o_orderkey as key, year(o_orderdate) as year from orders) select coalesce(a.key, b.key) as key, coalesce(a.year, b.year)::int as year, case when a.key is null then 'right' else 'left' end as only from a full join b on a.key = b.key and a.year = b.year where a.key is null or b.key is null")
def o70_bijection(s, d):
    """Orders by the years in which they were placed and shipped."""
    a = market.read(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.year("l_shipdate").alias("year")).distinct()
    b = market.read(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("year"))
    return relational.unmatched(a, b, ["key", "year"])


@q("with e as (select case when s_acctbal < 0 then -s_suppkey else s_suppkey end as s_suppkey, s_acctbal + case when s_nationkey < 10 then 1 else 0 end as s_acctbal from supplier) select coalesce(o.s_suppkey, e.s_suppkey) as s_suppkey, case when e.s_suppkey is null then 'unexpected' when o.s_suppkey is null then 'missing' else 'different' end as problem from supplier o full join e on o.s_suppkey = e.s_suppkey where e.s_suppkey is null or o.s_suppkey is null or abs(o.s_acctbal - e.s_acctbal) > 1e-9 * greatest(1.0, abs(e.s_acctbal))")
def o71_exact_set(s, d):
    """Planted: other keys for suppliers in debt, other values for some nations."""
    t = market.read(s, d, "supplier")
    changed = t.select(F.expr("if(s_acctbal < 0, -s_suppkey, s_suppkey)").alias("s_suppkey"), F.expr("s_acctbal + if(s_nationkey < 10, 1, 0)").alias("s_acctbal"))
    return capital.exact_set_errors(t, changed, ["s_suppkey"], "s_acctbal", 1e-9)


# ---------------------------------------------------------------- aggregations


def _spec(name: str, sql_value: str, spec: AggSpec, where: str = "true"):
    """A query of one spec per (year, country), with its state."""

    def f(s, d):
        return rounded(aggregate(market.accounts(s, d), ["year", "country"], {"v": spec}, states=True), 6, "v").withColumnRenamed("v__state", "state")

    f.__name__ = name
    QUERIES[name] = f
    ORACLE[name] = BASE + f" select year, country, {sql_value} from acc where {where} group by year, country"


_spec("o80_sum", "round(sum(gdp_us), 6) as v, 'finite' as state", AggSpec("sum", "gdp_us"))
_spec("o81_mean", "round(avg(gdp_us), 6) as v, 'finite' as state", AggSpec("mean", "gdp_us"))
_spec("o82_ratio_of_sums", "round(sum(gdp_us) / sum(hours_emp), 6) as v, 'finite' as state", AggSpec("ratio_of_sums", numerator="gdp_us", denominator="hours_emp"))
_spec("o83_weighted_mean", "round(sum(emp * hours_emp) / sum(hours_emp), 6) as v, 'finite' as state", AggSpec("weighted_mean", "emp", weight="hours_emp"))
_spec("o85_not_applicable", "null::double as v, 'not_applicable' as state", AggSpec("not_applicable"))


@q(BASE + " select year, country, round(min(t), 6) as v, 'finite' as state from (select *, sum(go_us) over (partition by year, country) as t from acc) group by all")
def o84_invariant(s, d):
    a = market.accounts(s, d).withColumn("t", F.sum("go_us").over(W.partitionBy("year", "country")))
    return rounded(aggregate(a, ["year", "country"], {"v": AggSpec("invariant", "t", order="sector")}, states=True), 6, "v").withColumnRenamed("v__state", "state")


@q(BASE + " select year, country, round(sum(go_us) / sum(emp), 6) as per_person from acc group by all union all select year, 'WWW', round(sum(go_us) / sum(emp), 6) from acc group by all")
def o86_formula(s, d):
    r = rollup.two_levels(market.accounts(s, d), {n: plan.sum_of(n) for n in ("go_us", "emp")}, {"per_person": lambda: safe.divide("go_us", "emp", "not_applicable")})
    return rounded(r, 6, "per_person").select("year", "country", "per_person")


_LACK = "(select *, case when sector = 'S1' and country = 'ASIA' then null else hours_emp end as h, case when sector in ('S0','S1','S2','S3','S4') and country = 'AFRICA' then null else gdp_us end as g from acc)"


def _lacking(s, d, a=None):
    a = market.accounts(s, d) if a is None else a
    return a.withColumn("h", F.when((F.col("sector") == "S1") & (F.col("country") == "ASIA"), None).otherwise(F.col("hours_emp"))).withColumn("g", F.when(F.col("country") == "AFRICA", None).otherwise(F.col("gdp_us")))


@q(BASE + f" select year, country, sum(h) as available, case when count(h) = count(*) then sum(h) end as propagated, case when count(h) = count(*) then 'finite' else 'partial' end as state, case when count(g) = 0 then 'missing' else 'finite' end as g_state from {_LACK} group by all")
def o87_missing_policy(s, d):
    r = aggregate(_lacking(s, d), ["year", "country"], {"available": AggSpec("sum", "h"), "propagated": AggSpec("sum", "h", missing="propagate"), "g": AggSpec("sum", "g")}, states=True)
    return r.select("year", "country", "available", "propagated", F.col("available__state").alias("state"), F.col("g__state").alias("g_state"))


@q(BASE + " select year, country, case when sum(z) <> 0 then round(sum(go_us) / sum(z), 6) end as na, case when sum(z) <> 0 then round(sum(go_us) / sum(z), 6) else 0 end as zero, case when sum(z) = 0 then 'not_applicable' else 'finite' end as state from (select *, case when country = 'ASIA' then 0 else emp end as z from acc) group by all")
def o88_zero_policy(s, d):
    a = market.accounts(s, d).withColumn("z", F.when(F.col("country") == "ASIA", 0.0).otherwise(F.col("emp")))
    spec = lambda zero: AggSpec("ratio_of_sums", numerator="go_us", denominator="z", zero=zero)
    r = aggregate(a, ["year", "country"], {"na": spec("not_applicable"), "zero": spec("zero")}, states=True)
    return rounded(r, 6, "na", "zero").select("year", "country", "na", "zero", F.col("na__state").alias("state"))


@q(BASE + ", c as (select year, country, sum(gdp_us) as gdp, sum(emp) as emp, sum(gdp_us) / sum(hours_emp) as rate from acc group by all) select year, country, round(gdp, 4) as gdp_us, emp, round(rate, 9) as rate from c union all select year, 'WWW', round(sum(gdp), 4), sum(emp), round(avg(rate), 9) from c group by year")
def o89_two_levels(s, d):
    reg = {"gdp_us": plan.sum_of("gdp_us"), "emp": plan.sum_of("emp"), "rate": Binding("rate", AggSpec("ratio_of_sums", numerator="gdp_us", denominator="hours_emp"), AggSpec("mean", "rate"))}
    return rounded(rounded(rollup.two_levels(market.accounts(s, d), reg), 4, "gdp_us"), 9, "rate")


@q(BASE + f" select year, sector, round(sum(g), 4) as g, case when count(g) = count(*) then 'finite' when count(g) > 0 then 'partial' else 'source_missing' end as state from {_LACK} group by all")
def o93_margin(s, d):
    return rounded(safe.aggregate_margin(_lacking(s, d), ["year", "sector"], "g"), 4, "g")


@q(BASE + " select year, country, case when max(case when sector = 'S1' and country = 'ASIA' then 1 else 0 end) = 1 then 'uncomputed' when max(case when sector = 'S2' then 1 else 0 end) = 1 then 'source_missing' else 'finite' end as state from acc group by all")
def o94_group_state(s, d):
    st = F.when((F.col("sector") == "S1") & (F.col("country") == "ASIA"), "uncomputed").when(F.col("sector") == "S2", "source_missing").when(F.col("sector") == "S3", "not_applicable").otherwise("finite")
    return market.accounts(s, d).withColumn("st", st).groupBy("year", "country").agg(safe.group_state("st").alias("state"))


@q(BASE + " select year, country, sector, round((comp_emp / hours_emp) / min(comp_emp / hours_emp) filter (comp_emp > 0) over (partition by year, country), 6) as m from acc")
def o98_least_positive(s, d):
    a = indicators.with_indicators(market.accounts(s, d), ["multiplier_national_wage"])
    return a.select("year", "country", "sector", F.round("multiplier_national_wage", 6).alias("m"))


@q(BASE + ", r as (select year, country, case when sum(hours_emp) = 0 then 'inf'::double else sum(capital) / sum(hours_emp) end as ratio from acc group by all) select year, min(country) as least from r where ratio = (select min(ratio) from r b where b.year = r.year) group by year")
def o99_argmin(s, d):
    return assumptions.least_intensive(market.accounts(s, d), exclude_row=False).select("year", "least")


@q(BASE + " select year, sector, round(avg(gdp_us), 7) as gdp_us from acc where country <> 'ASIA' group by all")
def o100_country_mean(s, d):
    m = preparation.with_mean_country(economy(s, d).accounts.where("country <> 'ASIA'").select("year", "country", "sector", "gdp_us"), "gdp_us", "MD").where("country = 'MD'")
    return rounded(m.select("year", "sector", "gdp_us"), 7, "gdp_us")


@q(BASE + f", p as (select year, country, sum(h) as t, sum(g) as b from {_LACK} where h is not null and g is not null and sector <> 'S4' group by all) select year, country, round(t / b, 9) as rate from p union all select year, 'WWW', round(sum(t) / sum(b), 9) from p group by year")
def o101_ratio_of_pairs(s, d):
    return rounded(rollup.ratio_of_pairs(_lacking(s, d), "h", "g", "rate", market.productive("sector")), 9, "rate")


@q(BASE + " select count(*) as n, count(*) filter (value = 0) as zeros, count(*) filter (value < 0) as negatives, min(value) as least, max(value) as most from flow")
def o102_counts(s, d):
    return market.flows(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(F.col("value") < 0).alias("negatives"), F.min("value").alias("least"), F.max("value").alias("most"))


@q(BASE + ", v as (select year, o_country, o_sector, d_country, value - 100000 as value from flow where kind = 'final') select case when grouping_id(year, d_country, o_country, o_sector) = 15 then 'total' when grouping_id(year, d_country, o_country, o_sector) = 7 then 'year' when grouping_id(year, d_country, o_country, o_sector) = 11 then 'investing_country' when grouping_id(year, d_country, o_country, o_sector) = 13 then 'supplying_country' else 'supplying_sector' end as scope, coalesce(year::varchar, d_country, o_country, o_sector, 'all') as label, count(*) as n, round(sum(value), 2) as sum, round(sum(case when value < 0 then -value else 0 end), 2) as removed, round(min(value), 2) as least from v group by grouping sets ((), (year), (d_country), (o_country), (o_sector))")
def o103_scoped_summary(s, d):
    v = market.flows(s, d).where("kind = 'final'").withColumn("value", F.col("value") - 100000)
    return rounded(rollup.scoped_summary(v), 2, "sum", "removed", "least")


@q(BASE + " select year, round(sum(gdp_us * emp) / sum(emp), 4) as gdp_us from acc where country in ('EUROPE', 'ASIA') group by year")
def o104_regional_mean(s, d):
    return rounded(analytics.regional_average(market.accounts(s, d), ["EUROPE", "ASIA"], "gdp_us", "emp"), 4, "gdp_us")


@q("select l_shipmode as strategy, 0.0::double as median, 0.0::double as least, 0.0::double as most from (select 'x' as l_shipmode) where 1 = 0 union all select o_orderpriority, median(o_totalprice), min(o_totalprice), max(o_totalprice) from orders group by 1")
def o105_timing_summary(s, d):
    return analytics.timing_summary(market.read(s, d, "orders").select(F.col("o_orderpriority").alias("strategy"), F.col("o_totalprice").alias("seconds")))


@q(BASE + f" select year, sector, case when count(h) = count(*) then sum(h) end as h from {_LACK} group by all")
def o106_poisoned_sum(s, d):
    return _lacking(s, d).groupBy("year", "sector").agg(relational.poisoned_sum("h").alias("h"))


@q("select p_brand, p_partkey, p_name from (select *, row_number() over (partition by p_brand order by p_partkey) as rn from part) where rn = 1")
def o107_first_wins(s, d):
    return relational.first_wins(market.read(s, d, "part"), ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "p_name")


# ---------------------------------------------------------------- analytic, order, sets


@q(BASE + " select year, country, sector, round(gdp_us / sum(gdp_us) over (partition by year, country), 9) as share from acc")
def o110_share(s, d):
    return market.accounts(s, d).select("year", "country", "sector", F.round(capital.share("gdp_us", ["year", "country"]), 9).alias("share"))


@q(BASE + " select year, country, sector, round(gdp_us / max(gdp_us) filter (sector = 'S0') over (partition by year, country), 9) as share from acc")
def o111_share_of_row(s, d):
    return market.accounts(s, d).select("year", "country", "sector", F.round(relational.share_of_total("gdp_us", "sector", "S0", ["year", "country"]), 9).alias("share"))


@q(BASE + " select year, o_country, o_sector, d_country, d_sector, row_number() over (partition by year order by abs(value) desc, o_country, o_sector, d_country, d_sector) as rank from flow")
def o113_absolute_rank(s, d):
    ties = ["o_country", "o_sector", "d_country", "d_sector"]
    return relational.absolute_rank(market.flows(s, d), "value", ties, ["year"]).select("year", *ties, "rank")


@q(BASE + ", p as (select country, year, sum(hours_hs) / sum(hours_emp) * 10 as pct from acc group by all), l as (select country, year, exp(sum(ln(1 + pct / 100)) over (partition by country order by year)) as v from p) select country, year, round(100 * v / max(v) filter (year = 1996) over (partition by country), 6) as index from l")
def o114_cumulative_index(s, d):
    p = market.accounts(s, d).groupBy("country", "year").agg((F.sum("hours_hs") / F.sum("hours_emp") * 10).alias("pct"))
    return rounded(relational.cumulative_index(p, "pct", ["country"], 1996), 6, "index").select("country", "year", "index")


@q(BASE + " select year, country, sector, last_value(case when year % 2 = 1 then gdp_us end ignore nulls) over (partition by country, sector order by year rows between unbounded preceding and current row) as v from acc")
def o115_carried_forward(s, d):
    a = market.accounts(s, d).withColumn("v", F.when(F.col("year") % 2 == 1, F.col("gdp_us")))
    return a.select("year", "country", "sector", relational.carried_forward("v", ["country", "sector"]).alias("v"))


@q("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn <= 3")
def o116_latest_n(s, d):
    return relational.latest(market.read(s, d, "orders"), ["o_custkey"], "o_orderkey", 3).select("o_custkey", "o_orderkey")


@q("select n_name, n_nationkey, row_number() over (order by n_name desc, n_nationkey) as place from nation")
def o120_sort(s, d):
    n = market.read(s, d, "nation")
    return n.orderBy(F.desc("n_name"), "n_nationkey").select("n_name", "n_nationkey", F.row_number().over(W.orderBy(F.desc("n_name"), "n_nationkey")).alias("place"))


@q("select s_suppkey, s_acctbal from supplier where s_acctbal < 1000 order by s_suppkey limit 3")
def o121_first_examples(s, d):
    """A report of the first three offenders: the limit is the feature."""
    return market.read(s, d, "supplier").where("s_acctbal < 1000").orderBy("s_suppkey").limit(3).select("s_suppkey", "s_acctbal")


@q("select o_orderpriority, max_by(o_orderkey, o_orderkey) as newest from orders group by 1")
def o122_top_one(s, d):
    return market.read(s, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_orderkey").alias("newest"))


@q(BASE + ", w as (select *, row_number() over (partition by year order by gdp_us / go_us desc, country, sector) as rn, round(gdp_us / go_us, 9) as scaled from acc) select year, country, sector, scaled from w where rn = 1")
def o123_worst_cell(s, d):
    a = market.accounts(s, d).withColumn("scaled", F.col("gdp_us") / F.col("go_us"))
    return rounded(relational.worst(a, "scaled", ["country", "sector"], ["year"]), 9, "scaled")


@q("select k::bigint as key, case when k in (select distinct o_custkey from orders) then 'unexpected' else 'missing' end as problem from (select c_custkey as k from customer where c_acctbal > 0 except select o_custkey from orders union (select o_custkey from orders except select c_custkey from customer where c_acctbal > 0))")
def o125_set_difference(s, d):
    return relational.missing_and_unexpected(market.read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), market.read(s, d, "orders").select(F.col("o_custkey").alias("key")), "key")


@q("select c_custkey as key from customer where c_acctbal > 0 intersect select o_custkey from orders")
def o126_intersection(s, d):
    return market.read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")).intersect(market.read(s, d, "orders").select("o_custkey"))


@q("select count(*) = 0 as equal from (select n_nationkey from nation except select s_nationkey from supplier union all (select s_nationkey from supplier except select n_nationkey from nation))")
def o127_set_equality(s, d):
    apart = relational.missing_and_unexpected(market.read(s, d, "nation").select(F.col("n_nationkey").alias("k")), market.read(s, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")
    return apart.agg((F.count("*") == 0).alias("equal"))


@q("select c_custkey::bigint as key, c_acctbal as amount, null::varchar as priority from customer union all select o_orderkey, o_totalprice, o_orderpriority from orders")
def o128_union(s, d):
    a = market.read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    return a.unionByName(market.read(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority")), allowMissingColumns=True)


@q(BASE + " select year, country, sector, 'emp' as indicator, emp as value from acc union all select year, country, sector, 'hours', hours_emp from acc")
def o129_bind_indicators(s, d):
    a = economy(s, d).accounts
    return a.select("year", "country", "sector", F.lit("emp").alias("indicator"), F.col("emp").alias("value")).unionByName(a.select("year", "country", "sector", F.lit("hours").alias("indicator"), F.col("hours_emp").alias("value")))


@q(BASE + " select year, md5(string_agg(l, chr(10) order by l)) as md5 from (select distinct year, o_country || '.' || o_sector as l from flow) group by year")
def o130_fingerprint(s, d):
    return relational.set_fingerprint(market.flows(s, d), ["year"], flows.joined_label("o_country", "o_sector"))


@q(BASE + " select country as name, 'country' as kind from acc group by 1 union select sector, 'sector' from acc group by 1")
def o34_stacked_labels(s, d):
    a = economy(s, d).accounts
    return relational.stacked_labels({"country": a.select("country"), "sector": a.select("sector")})


# ---------------------------------------------------------------- matrices and the solve


@q(BASE + " select year, o_country, o_sector, d_country, d_sector, round(value + case when o_sector = 'S0' then value * 0.1 else 0 end, 4) as value from flow where kind = 'industry'")
def o140_input_flows(s, d):
    f = economy(s, d).flows
    dep = f.where("kind = 'industry' and o_sector = 'S0'").withColumn("value", F.col("value") * 0.1)
    return rounded(leontief.input_flows(f, dep), 4, "value")


@q(BASE + ", x as (select year, country, sector, case when sector = 'S3' then 0 else go_us end as x from acc) select f.year, f.o_country, f.o_sector, f.d_country, f.d_sector, case when f.value = 0 then '0/0' else 'nonzero/0' end as class from flow f left join x on x.year = f.year and x.country = f.d_country and x.sector = f.d_sector where kind = 'industry' and coalesce(x, 0) = 0")
def o141_zero_output(s, d):
    f, a = tables(s, d)
    x = a.select("year", "country", "sector", F.when(F.col("sector") == "S3", 0.0).otherwise(F.col("go_us")).alias("x"))
    return leontief.zero_output_scan(leontief.input_flows(f, None), x).select("year", "o_country", "o_sector", "d_country", "d_sector", "class")


@q(LAM + " select year, i_c as o_country, i_s as o_sector, j_c as d_country, j_s as d_sector, round(sum(a), 12) as a from a group by all having sum(a) <> 0")
def o142_coefficients(s, d):
    e = economy(s, d)
    x = e.accounts.select("year", "country", "sector", F.col("go_us").alias("x"))
    return rounded(leontief.coefficients(leontief.input_flows(e.flows, None), x, market.productive), 12, "a")


@q(BASE + " select year, country, sector, case when go_us = 0 then 0 when sector = 'S4' then 0 else round(hours_emp / go_us, 12) end as l from acc")
def o143_direct_labour(s, d):
    r = leontief.direct_labour(market.accounts(s, d), "hours_emp", "go_us", market.productive)
    return rounded(r, 12, "l").select("year", "country", "sector", "l")


def _lam(s, d):
    """The economy, its coefficients, labour requirements and lambda."""
    e = economy(s, d)
    return e, *plan.values(e, METHODS["wiodr13"], plan.prepared(e, METHODS["wiodr13"]))


def _valued(s, d):
    """The economy, its valued flows, and these by destination country."""
    e, _, _, lam = _lam(s, d)
    return e, *plan.revalued(e, lam)


def _traded(s, d):
    """The economy and its valued flows by destination country."""
    e, _, traded = _valued(s, d)
    return e, traded


@q(LAM + " select year, country, sector, round(lam, 9) as lam from lam")
def o144_lambda(s, d):
    return rounded(_lam(s, d)[3], 9, "lam")


def _diagnosed(s, d):
    e = economy(s, d)
    c, labour = plan.system(e, METHODS["wiodr13"], plan.prepared(e, METHODS["wiodr13"]))
    return kept(leontief.solution(c, labour), "solution")


@q()
def o150_diagnostics(s, d):
    """The published table: 47 columns."""
    return leontief.for_method(leontief.diagnostics_of(_diagnosed(s, d)), "wiodr13")


#: Columns of the diagnostics that SQL can express: what rounding errors alone decide is left out.
_TOLD = ("total_dimension", "productive_dimension", "refinement_count", "coefficient_count", "coefficient_zero_count", "coefficient_negative_count", "coefficient_nonfinite_count", "gross_output_count", "gross_output_zero_count", "gross_output_nonfinite_count", "labour_zero_count", "labour_negative_count", "labour_nonfinite_count", "lambda_zero_count", "lambda_negative_count", "lambda_nonfinite_count")
_ROUNDED = ("rcond", "coefficient_min", "coefficient_max", "labour_min", "labour_max", "lambda_min", "lambda_max", "certificate_rcond", "certificate_margin", "certificate_ratio_upper")
_DIAGNOSED = LAM + """,
e as (select year, i_c, i_s, j_c, j_s, sum(a) as a from a group by all),
zs(k, year, country, sector, z) as (select 0, year, country, sector, 1.0::double from x union all select k + 1, a.year, a.j_c, a.j_s, 1 + sum(a.a * zs.z) from zs join a on zs.year = a.year and zs.country = a.i_c and zs.sector = a.i_s where k < 150 group by k, a.year, a.j_c, a.j_s),
zr as (select year, max(z) as top, max((z - 1) / z) as ratio from zs where k = 150 group by year),
mr as (select year, max(size) as norm from (select year, j_c, j_s, sum(case when i_c = j_c and i_s = j_s then abs(1 - a) else abs(a) end) as size from e group by all) group by year),
cs as (select year, count(*) filter (a <> 0) as filled, count(*) filter (a < 0) as neg, max(a) as high from e group by year),
ac as (select year, count(*) as t, count(*) filter (sector <> 'S4') as p, count(*) filter (go_us = 0) as x0, min(go_us) as x_low, max(go_us) as x_high, count(*) filter (sector = 'S4' or hours_emp = 0) as l0,
  min(case when sector = 'S4' then 0 else hours_emp / go_us end) as l_low, max(case when sector = 'S4' then 0 else hours_emp / go_us end) as l_high from acc group by year),
vs as (select year, count(*) filter (lam = 0) as v0, count(*) filter (lam < 0) as vn, min(lam) as v_low, max(lam) as v_high from lam group by year)
select 'wiodr13' as method, year, 'productivity_nonnegative' as certificate_type, t::int as total_dimension, p::int as productive_dimension, 0 as refinement_count, t * t as coefficient_count, t * t - filled as coefficient_zero_count, neg as coefficient_negative_count, 0::bigint as coefficient_nonfinite_count,
  t as gross_output_count, x0 as gross_output_zero_count, 0::bigint as gross_output_nonfinite_count, x_low as gross_output_min, x_high as gross_output_max, l0 as labour_zero_count, 0::bigint as labour_negative_count, 0::bigint as labour_nonfinite_count, v0 as lambda_zero_count, vn as lambda_negative_count, 0::bigint as lambda_nonfinite_count,
  round(1 / (norm * top), 9) as rcond, 0.0::double as coefficient_min, round(high, 9) as coefficient_max, round(l_low, 9) as labour_min, round(l_high, 9) as labour_max, round(v_low, 9) as lambda_min, round(v_high, 9) as lambda_max, round(1 / (norm * top), 9) as certificate_rcond, 1.0::double as certificate_margin, round(ratio, 9) as certificate_ratio_upper,
  2.0::double ** -52 as machine_epsilon, p * 2.0::double ** -52 / (1 - p * 2.0::double ** -52) as gamma_n, 1e-8::double as forward_error_budget, 64 * 2.0::double ** -52 as refinement_trigger
from ac join cs using (year) join vs using (year) join mr using (year) join zr using (year)"""


@q(_DIAGNOSED)
def o150_diagnostics_figures(s, d):
    """The figures of the diagnostics that SQL can express."""
    r = leontief.for_method(leontief.diagnostics_of(_diagnosed(s, d)), "wiodr13")
    return rounded(r.select("method", "year", "certificate_type", *_TOLD, "gross_output_min", "gross_output_max", *_ROUNDED, "machine_epsilon", "gamma_n", "forward_error_budget", "refinement_trigger"), 9, *_ROUNDED)


@q("with recursive " + market.SQL_LAMBDA.replace("sr.r_name", "sn.n_name").replace("cr.r_name", "cn.n_name") + " select year, country, sector, round(lam, 9) as lam from lam")
def o144_lambda_in_rounds(s, d):
    """The solve by nation with no year in one task: rounds of a join and a sum over the cells."""
    e = economy(s, d, "nation")
    c, labour = plan.system(e, METHODS["wiodr13"], plan.prepared(e, METHODS["wiodr13"]))
    return rounded(leontief.solve(c, labour, limit=1), 9, "lam")


_NATIONS = market.SQL_LAMBDA.replace("sr.r_name", "sn.n_name").replace("cr.r_name", "cn.n_name")


@q("with recursive " + _NATIONS + " select year, country, sector, round(lam, 9) as lam from lam")
def o144_lambda_nations(s, d):
    """The solve by nation: five times as many countries as in the other queries."""
    e = economy(s, d, "nation")
    return rounded(plan.values(e, METHODS["wiodr13"], plan.prepared(e, METHODS["wiodr13"]))[2], 9, "lam")


@q(LAM + ", r as (select a.year, a.j_c as c, a.j_s as s, sum(a.a * l.lam) as inflow from a join lam l on l.year = a.year and l.country = a.i_c and l.sector = a.i_s group by all) select l.year, l.country, l.sector, round(abs(l.lam - inflow - hours / x.x), 9) as residual from lam l join r on r.year = l.year and r.c = l.country and r.s = l.sector join x on x.year = l.year and x.country = l.country and x.sector = l.sector")
def o146_residual(s, d):
    _, c, labour, lam = _lam(s, d)
    side = lam.select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), "lam")
    inflow = c.join(side, ["year", "o_country", "o_sector"]).groupBy("year", F.col("d_country").alias("country"), F.col("d_sector").alias("sector")).agg(F.sum(F.col("a") * F.col("lam")).alias("inflow"))
    rows = labour.where("productive and x > 0").join(lam, ["year", "country", "sector"]).join(inflow, ["year", "country", "sector"], "left")
    return rows.select("year", "country", "sector", F.round(F.abs(F.col("lam") - F.coalesce("inflow", F.lit(0.0)) - F.col("l")), 9).alias("residual"))


@q(VAL + " select year, round(bf, 9) as bf from bf")
def o152_balance_factor(s, d):
    return rounded(_traded(s, d)[1].select("year", "bf").distinct(), 9, "bf")


@q(VAL + " select year, o_country, o_sector, d_country, d_sector, kind, round(transfer, 5) + 0.0 as transfer from tr")
def o153_transfers(s, d):
    return _valued(s, d)[1].select(*flows.ORIGIN, "d_country", "d_sector", "kind", (F.round("transfer", 5) + 0.0).alias("transfer"))


@q(BASE + " select year, o_country, o_sector, d_country, round(value / sum(value) over (partition by year, d_country), 9) as basket from flow where kind = 'final'")
def o154_national_basket(s, d):
    return rounded(capital.national_basket(market.flows(s, d), "HH"), 9, "basket")


@q(BASE + ", g as (select year, o_country, o_sector, sum(value) as v from flow where kind = 'final' group by all) select year, o_country, o_sector, round(v / sum(v) over (partition by year), 9) as basket from g")
def o155_international_basket(s, d):
    return rounded(capital.international_basket(market.flows(s, d), "HH"), 9, "basket")


_INV = "inv as (select year, o_country, o_sector, case when o_sector in ('S0', 'S1') then 'k0' else 'k1' end as ktype, d_country, sum(value) as value from flow where kind = 'final' group by all), sh as (select year, country, sector, 'k0' as ktype, hours_hs / hours_emp as share from acc where country in ('ASIA', 'EUROPE') union all select year, country, sector, 'k1', 1 - hours_hs / hours_emp from acc where country in ('ASIA', 'EUROPE')), shm as (select * from sh union all select year, 'MD', sector, ktype, avg(share) from sh group by year, sector, ktype), rt as (select year, country, sector, gdp_us / sum(gdp_us) over (partition by year, country) as ratio from acc), kw as (select i.year, i.o_country, i.o_sector, i.d_country, r.sector as d_sector, i.ktype, i.value * r.ratio * s.share as weight from inv i join rt r on r.year = i.year and r.country = i.d_country join shm s on s.year = i.year and s.sector = r.sector and s.ktype = i.ktype and s.country = case when r.country in ('ASIA', 'EUROPE') then r.country else 'MD' end), kc as (select kw.*, weight / sum(weight) over (partition by kw.year, d_country, d_sector) * a.capital as value from kw join acc a on a.year = kw.year and a.country = d_country and a.sector = d_sector)"


def _composition(f, a):
    """Weights of capital by type and the stocks, from flows and accounts that are kept."""
    ktype = F.when(F.col("o_sector").isin("S0", "S1"), "k0").otherwise("k1")
    inv = f.where("kind = 'final'").groupBy("year", "o_country", "o_sector", ktype.alias("ktype"), "d_country").agg(F.sum("value").alias("value"))
    own = a.where(F.col("country").isin("ASIA", "EUROPE")).select("year", "country", "sector", (F.col("hours_hs") / F.col("hours_emp")).alias("k0"), (1 - F.col("hours_hs") / F.col("hours_emp")).alias("k1"))
    shares = preparation.with_mean_country(own.unpivot(["year", "country", "sector"], ["k0", "k1"], "ktype", "share"), "share")
    ratio = a.select("year", "country", "sector", capital.share("gdp_us", ["year", "country"]).alias("ratio"))
    return capital.composition(shares, inv, ratio), a.select("year", "country", "sector", F.col("capital").alias("stock"))


@q(BASE + ", " + _INV + " select year, o_country, o_sector, d_country, d_sector, round(value, 3) as value from kc")
def o157_capital_composition(s, d):
    w, stock = _composition(*tables(s, d))
    return rounded(capital.allocate(w.drop("ktype"), stock, strict=True), 3, "value")


@q(BASE + ", " + _INV + " select year, o_country, o_sector, d_country, d_sector, round(value * case when ktype = 'k0' then 0.05 else 0.1 end, 3) as value from kc where year < (select max(year) from acc)")
def o160_depreciation(s, d):
    return rounded(_depreciation(s, d), 3, "value")


def _depreciation(s, d):
    w, stock = _composition(*tables(s, d))
    k = capital.allocate(w.drop("ktype"), stock)
    labels = stock.select("year", "sector").distinct()
    rates = labels.withColumn("ktype", F.lit("k0")).withColumn("rate", F.lit(0.05)).unionByName(labels.withColumn("ktype", F.lit("k1")).withColumn("rate", F.lit(0.1)))
    ktypes = stock.select(F.col("sector").alias("o_sector")).distinct().withColumn("ktype", F.when(F.col("o_sector").isin("S0", "S1"), "k0").otherwise("k1"))
    return capital.depreciation(k, rates, ktypes, year_offset=1)


@q(BASE + ", " + _INV + " select year, d_country as country, d_sector as sector, round(sum(value * case when ktype = 'k0' then 0.05 else 0.1 end), 2) as depreciation from kc where year < (select max(year) from acc) group by all")
def i25_capital_depreciation(s, d):
    k = _depreciation(s, d)
    return rounded(k.groupBy("year", F.col("d_country").alias("country"), F.col("d_sector").alias("sector")).agg(F.sum("value").alias("depreciation")), 2, "depreciation")


@q(BASE + ", w as (select year, o_country, o_sector, d_country, d_sector, case when d_sector = 'S3' then 0 else value end as weight from flow where kind = 'industry'), t as (select year, d_country, d_sector, sum(weight) as t from w group by all), fb as (select year, o_country, o_sector, d_country, sum(value) as v from flow where kind = 'final' group by all), main as (select w.year, w.o_country, w.o_sector, w.d_country, w.d_sector, weight / t * capital as value from w join t using (year, d_country, d_sector) join acc a on a.year = w.year and a.country = d_country and a.sector = d_sector where t <> 0), rest as (select a.year, o_country, o_sector, d_country, a.sector as d_sector, v / sum(v) over (partition by a.year, d_country, a.sector) * capital as value from acc a join fb on fb.year = a.year and fb.d_country = a.country where capital <> 0 and not exists (select 1 from t where t.year = a.year and t.d_country = a.country and t.d_sector = a.sector and t <> 0)) select year, o_country, o_sector, d_country, d_sector, round(value, 3) as value from (select * from main union all select * from rest)")
def o162_column_allocation(s, d):
    f, a = tables(s, d)
    w = f.where("kind = 'industry'").select(*flows.ORIGIN, "d_country", "d_sector", F.when(F.col("d_sector") == "S3", 0.0).otherwise(F.col("value")).alias("weight"))
    fb = f.where("kind = 'final'").select(*flows.ORIGIN, "d_country", F.col("value").alias("weight"))
    return rounded(capital.allocate(w, a.select("year", "country", "sector", F.col("capital").alias("stock")), fb), 3, "value")


@q(BASE + " select year, o_country, o_sector, d_country, round(greatest(value - 100000, 0), 2) as value from flow where kind = 'final'")
def o164_truncated_negatives(s, d):
    v = market.flows(s, d).where("kind = 'final'").select(*flows.ORIGIN, "d_country", (F.col("value") - 100000).alias("value"))
    return rounded(capital.truncated(v, "value")[0], 2, "value")


@q(BASE + " select year, country, sector, case when gdp_us = 0 and go_us = 0 then 0 else round(abs((gdp_us - comp_emp * 5) / go_us), 9) end as ratio from acc")
def o166_value_added_ratio(s, d):
    r = capital.value_added_ratio(F.col("gdp_us") - F.col("comp_emp") * 5, F.col("go_us"))
    return market.accounts(s, d).select("year", "country", "sector", F.round(r, 9).alias("ratio"))


def _reduction(name: str, column: str, sql: str):
    def f(s, d):
        e, traded = _traded(s, d)
        return flows.reduced(traded, market.productive("o_sector"), e.accounts.select("country").distinct()).select("year", "origin", "destination", (F.round(column, 5) + 0.0).alias("value"))

    f.__name__ = name
    QUERIES[name] = f
    ORACLE[name] = VAL + f", c as (select distinct country from acc) select y.year, a.country as origin, b.country as destination, round(coalesce(sum(case when a.country <> b.country then {sql} end), 0), 5) + 0.0 as value from (select distinct year from acc) y cross join c a cross join c b left join tr on tr.year = y.year and tr.o_country = a.country and tr.d_country = b.country group by all"


_reduction("o168_exports_values", "exports_values", "worth")
_reduction("o169_exports_mp", "exports_mp", "value")
_reduction("o170_exports_productive_mp", "exports_productive_mp", "case when o_sector <> 'S4' then value else 0 end")
_reduction("o171_transfers_values", "transfers_values", "transfer")
_reduction("o172_transfers_productive_values", "transfers_productive_values", "case when o_sector <> 'S4' then transfer else 0 end")
_reduction("o173_transfers_dp", "transfers_dp", "transfer / bf")
_reduction("o174_transfers_productive_dp", "transfers_productive_dp", "case when o_sector <> 'S4' then transfer / bf else 0 end")


# ---------------------------------------------------------------- indicators


def _simple(name: str, made: str, sql: str, prepare=lambda t: t, places: int = 6, cte: str = ""):
    """A query of one indicator of the sector table."""

    def f(s, d):
        t = indicators.with_indicators(prepare(market.accounts(s, d).withColumn("productive", market.productive("sector").cast("double"))), [made])
        return t.select("year", "country", "sector", F.round(made, places).alias("value"))

    f.__name__ = name
    QUERIES[name] = f
    ORACLE[name] = BASE + cte + f" select year, country, sector, round({sql}, {places}) as value from acc"


def _lcu(t):
    return t.withColumn("gdp_lcu", F.col("gdp_us") * (1 + F.length("country") / 10)).withColumn("lab", F.col("comp_emp") * 2)


_X = "(sum(gdp_us * (1 + length(country) / 10.0)) over (partition by year, country) / sum(gdp_us) over (partition by year, country))"
_simple("i05_exchange", "exchange", _X, _lcu)
_simple("i06_exchange_by_sector", "exchange_v09", "gdp_us * (1 + length(country) / 10.0) / gdp_us", _lcu)
_simple("i08_compensation", "comp_emp_us", f"comp_emp * 2 / {_X}", _lcu, 4)
_simple("i08_profit", "profit_us", "gdp_us - comp_emp", places=4)
_simple("i04_price_index", "go_price", "(go_us / hours_emp) / first_value(go_us / hours_emp) over (partition by country, sector order by year)", places=9)
_simple("i12_hours", "hours_emp_from_empe", "case when empe = 0 then 0 else hours_empe / empe * emp end", places=4)
_simple("i13_multiplier_one", "multiplier_one", "1.0")
_simple("i15_multiplier_skills", "multiplier_skills", "6.25 * hours_hs / hours_emp + 2.5 * hours_ms / hours_emp + (1 - hours_hs / hours_emp - hours_ms / hours_emp)")
_simple("i16_multiplier_world_wage", "multiplier_world_wage", "(comp_emp / hours_emp) / min(comp_emp / hours_emp) filter (comp_emp > 0) over (partition by year)")
_simple("i17_multiplier_national_wage", "multiplier_national_wage", "(comp_emp / hours_emp) / min(comp_emp / hours_emp) filter (comp_emp > 0) over (partition by year, country)")
_R = "((sum(comp_{0}) over (partition by year) / sum(hours_{0}) over (partition by year)) / (sum(comp_emp - comp_hs - comp_ms) over (partition by year) / sum(hours_emp - hours_hs - hours_ms) over (partition by year)))"
_simple("i18_multiplier_relative_wages", "multiplier_relative_wages", _R.format("hs") + " * hours_hs / hours_emp + " + _R.format("ms") + " * hours_ms / hours_emp + (1 - hours_hs / hours_emp - hours_ms / hours_emp)")
_simple("i19_abstract_labour", "abstract_emp_mv", "hours_emp", places=4)
_simple("i20_gdp_mv", "gdp_mv", "case when sector = 'S4' then 0 else hours_emp end", places=4)
_simple("i21_gdp_productive", "gdp_p_us", "case when sector = 'S4' then 0 else gdp_us end", places=4)

_simple("i07_exchange_index", "exchange_id", "1.0", _lcu)
_simple("i09_capital_stock", "capital_us", f"capital * 1.5 / {_X}", lambda t: _lcu(t).withColumn("k_gfcf", F.col("capital")).withColumn("gfcf_p", F.lit(1.5)), 6)
_simple("i11_capital_stock_constant", "capital_cu", "capital / ((go_us / hours_emp) / first_value(go_us / hours_emp) over (partition by country, sector order by year)) / (1 + length(country) / 10.0)", lambda t: _lcu(t).withColumn("k_gfcf", F.col("capital")), 3)
_simple("i36_surplus_by_skill", "surplus_hs", "hours_empe * (hours_hs / hours_emp) / nullif(comp_empe * 0.001 * (comp_hs / comp_emp), 0) - 1", lambda t: t.withColumn("lfv_empe", F.col("comp_empe") * 0.001))
_simple("i41_compensation_constant", "comp_emp_cu", "comp_emp / 1.25", lambda t: t.withColumn("basket_price", F.lit(1.25)), 4)


#: Sector table with everything from flows, for the later indicators.
SEC = VAL + """,
ind as (select a.year, a.country, a.sector, a.go_us, a.gdp_us, a.emp, a.hours_emp, a.comp_emp, l.lam, case when a.sector = 'S4' then 0 else 1 end as p,
  coalesce((select sum(worth) from val v where v.year = a.year and v.o_country = a.country and v.o_sector = a.sector), 0) as go_mv,
  coalesce((select sum(value) from tr v where v.year = a.year and v.o_country = a.country and v.o_sector = a.sector and v.d_country <> a.country), 0) as x_us,
  coalesce((select sum(worth) from tr v where v.year = a.year and v.o_country = a.country and v.o_sector = a.sector and v.d_country <> a.country), 0) as x_mv,
  coalesce((select sum(transfer) from tr v where v.year = a.year and v.o_country = a.country and v.o_sector = a.sector and v.d_country <> a.country), 0) as x_tr,
  coalesce((select sum(value) from tr v where v.year = a.year and v.d_country = a.country and v.o_sector = a.sector and v.o_country <> a.country), 0) as m_us,
  coalesce((select sum(worth) from tr v where v.year = a.year and v.d_country = a.country and v.o_sector = a.sector and v.o_country <> a.country), 0) as m_mv,
  coalesce((select sum(transfer) from tr v where v.year = a.year and v.d_country = a.country and v.o_sector = a.sector and v.o_country <> a.country), 0) as m_tr,
  a.comp_emp * (select sum(f.value / h.t * lf.lam) from flow f join (select year, d_country, sum(value) as t from flow where kind = 'final' group by all) h on h.year = f.year and h.d_country = f.d_country
    join lam lf on lf.year = f.year and lf.country = f.o_country and lf.sector = f.o_sector where f.kind = 'final' and f.year = a.year and f.d_country = a.country) as lfv
  from acc a join lam l on l.year = a.year and l.country = a.country and l.sector = a.sector)"""


def _result(name: str, made: str, sql: str, places: int = 5):
    """A query of one indicator of a full calculation."""

    def f(s, d):
        return plan.calculate(economy(s, d), METHODS["wiodr13"]).sectors.select("year", "country", "sector", (F.round(made, places) + 0.0).alias("value"))

    f.__name__ = name
    QUERIES[name] = f
    ORACLE[name] = SEC + f" select year, country, sector, round({sql}, {places}) + 0.0 as value from ind"


_result("i22_value", "value_m_mv", "lam", 9)
_result("i23_gross_output_mv", "go_mv", "go_mv")
_result("i24_labour_force_value", "lfv_emp", "lfv", 4)
_result("i26_exports_us", "exports_us", "x_us", 2)
_result("i26_exports_mv", "exports_mv", "x_mv")
_result("i27_imports_us", "imports_us", "m_us", 2)
_result("i27_imports_mv", "imports_mv", "m_mv")
_result("i28_trade_transfers", "transfers_mv", "x_tr - m_tr")
_result("i28_trade_transfers_productive", "transfers_p_mv", "(x_tr - m_tr) * p")
_result("i31_gdp_du", "gdp_du", "hours_emp * p * sum(go_us) over (partition by year) / sum(go_mv) over (partition by year)", 2)
_result("i31_gross_output_du", "go_du", "go_mv * sum(go_us) over (partition by year) / sum(go_mv) over (partition by year)", 2)
_result("i32_abstract_labour_mean", "abstract_emp_m_mv", "hours_emp / emp", 9)
_result("i33_labour_force_value_mean", "lfv_emp_m_mv", "lfv / emp", 6)
_result("i34_surplus_value", "surplus_emp", "hours_emp / lfv - 1", 6)
_result("i35_surplus_value_productive", "surplus_emp_p", "(hours_emp / lfv - 1) * p", 6)
_result("i37_trade_balance_us", "balance_us", "x_us - m_us", 2)
_result("i37_trade_balance_mv", "balance_mv", "x_mv - m_mv")
_result("i38_transfers_unproductive", "transfers_u_mv", "(x_tr - m_tr) * (1 - p)", 4)
_result("i39_transfers_over_gdp", "transfers_p_m_pc", "case when p = 1 then (x_tr - m_tr) / hours_emp end", 9)


@q(SEC + ", c as (select year, country, sum(go_mv) as go_mv, sum(go_us) as go_us, sum(hours_emp) as h, sum(lfv) as lfv, sum((x_tr - m_tr) * p) as tp, sum(hours_emp * p) as g from ind group by all), w as (select * from c union all select year, 'WWW', sum(go_mv), sum(go_us), sum(h), sum(lfv), sum(tp), sum(g) from c group by year) select year, country, round(go_mv, 4) as go_mv, round(go_mv / go_us, 9) as value_m_mv, round(h / lfv - 1, 6) as surplus_emp, round(tp / g, 6) + 0.0 as transfers_p_m_pc from w")
def i_country_rollup(s, d):
    r = plan.calculate(economy(s, d), METHODS["wiodr13"]).countries
    return r.select("year", "country", F.round("go_mv", 4).alias("go_mv"), F.round("value_m_mv", 9).alias("value_m_mv"), F.round("surplus_emp", 6).alias("surplus_emp"), (F.round("transfers_p_m_pc", 6) + 0.0).alias("transfers_p_m_pc"))


@q(BASE + ", b as (select o_country, o_sector, d_country, value / sum(value) over (partition by d_country) as b from flow where kind = 'final' and year = 1995), p as (select year, country, sector, go_us / hours_emp as price from acc), l as (select p.year, b.d_country as country, sum(b * price) as v from b join p on p.country = o_country and p.sector = o_sector group by all) select year, country, round(v / max(v) filter (year = 1995) over (partition by country), 9) as index from l")
def i29_basket_price(s, d):
    f, a = tables(s, d)
    prices = a.select("year", "country", "sector", (F.col("go_us") / F.col("hours_emp")).alias("price"))
    return rounded(capital.laspeyres(capital.national_basket(f, "HH"), prices, 1995), 9, "index")


@q(LAM + ", b as (select o_country, o_sector, d_country, value / sum(value) over (partition by d_country) as b from flow where kind = 'final' and year = 1995), p as (select a.year, a.country, a.sector, go_us / hours_emp * lam as pv from acc a join lam l on l.year = a.year and l.country = a.country and l.sector = a.sector), l2 as (select p.year, b.d_country as country, sum(b * pv) as v from b join p on p.country = o_country and p.sector = o_sector group by all) select year, country, round(v / max(v) filter (year = 1995) over (partition by country), 8) as basket_value from l2")
def i30_basket_value(s, d):
    e, _, _, lam = _lam(s, d)
    prices = e.accounts.select("year", "country", "sector", (F.col("go_us") / F.col("hours_emp")).alias("price"))
    return rounded(indicators.basket_value(capital.national_basket(e.flows, "HH"), prices, lam, 1995), 8, "basket_value")


@q(BASE + " select year, country, sector, round((gdp_us - comp_emp - go_us * 0.05) / capital, 9) as value from acc")
def i40_appropriated_profit(s, d):
    t = market.accounts(s, d).withColumn("depreciation_us", F.col("go_us") * 0.05)
    return indicators.with_indicators(t, ["profit_us", "appropriated_profit"]).select("year", "country", "sector", F.round("appropriated_profit", 9).alias("value"))


@q(BASE + " select year, country, round(sum(greatest(capital, 0.01) * (gdp_us - go_us * 0.05 - comp_emp) / capital) / sum(greatest(capital, 0.01)), 9) as monetary_rate from acc group by all")
def i42_monetary_rate(s, d):
    t = indicators.with_indicators(market.accounts(s, d).withColumn("depreciation_us", F.col("go_us") * 0.05), ["monetary_rate"])
    return rounded(indicators.monetary_rate_by_country(t), 9, "monetary_rate")


# ---------------------------------------------------------------- methods

#: In these queries AFRICA stands for the rest of the world.
REGION = "AFRICA"


def _method_economy(s, d) -> plan.Economy:
    e = economy(s, d)
    w, stock = _composition(e.flows, e.accounts)
    labels = stock.select("year", "sector").distinct()
    rates = labels.withColumn("ktype", F.lit("k0")).withColumn("rate", F.lit(0.01)).unionByName(labels.withColumn("ktype", F.lit("k1")).withColumn("rate", F.lit(0.02)))
    ktypes = stock.select(F.col("sector").alias("o_sector")).distinct().withColumn("ktype", F.when(F.col("o_sector").isin("S0", "S1"), "k0").otherwise("k1"))
    jobs = e.accounts.groupBy("year").agg((F.sum("emp") / 4).alias("total"))
    shares = e.accounts.where("country in ('ASIA', 'AFRICA')").select("country", "year").distinct().withColumn("percent", (60 + F.col("year") % 10).cast("double"))
    return replace(e, row=REGION, jobs=jobs, wage_shares=shares, capital_countries=("ASIA", "EUROPE"), capital=(capital.allocate(w.drop("ktype"), stock), rates, ktypes))


def _method_sql(region: str, multiplier: str, offset: int | None) -> str:
    """``region``: how AFRICA is filled; ``offset``: year of the depreciation rates, None for none."""
    per = "emp" if region == "old" else "hours_emp"
    among = "true" if region == "old" else "country <> 'AFRICA'"
    new_capital = "a.gdp_us * lc.r" if region == "reduction" else f"nr.{per} * lk.capital / lk.{per}"
    comp = "c.total * c.key / sum(c.key) over (partition by a.year)" if region == "reduction" else "a.comp_emp"
    parts = [market.SQL, _INV, f"""world as (select year, sector, sum(emp) as e, sum(hours_emp) as h, sum(gdp_us) as va, sum(comp_emp) as w from acc where country <> 'AFRICA' group by all),
jobs as (select year, sum(emp) / 4 as total from acc group by year),
persons as (select a.year, a.sector, total * (gdp_us * e / va) / sum(gdp_us * e / va) over (partition by a.year) as emp, h / e as per from acc a join world using (year, sector) join jobs on jobs.year = a.year where country = 'AFRICA'),
nr as (select year, sector, emp, emp * per as hours_emp from persons),
least as (select year, arg_min(country, r) as country from (select year, country, sum(capital) / sum({per}) as r from acc where {among} group by all) group by year),
lc as (select year, sector, sum(capital) / sum(gdp_us) as r from acc where country in ('ASIA', 'EUROPE') group by all),
tot as (select year, sum(comp_emp) filter (country <> 'AFRICA') / sum(gdp_us) filter (country <> 'AFRICA') * sum(gdp_us) filter (country = 'AFRICA') as total from acc group by year),
c as (select a.year, a.sector, total, gdp_us * w / e as key from acc a join world using (year, sector) join tot on tot.year = a.year where country = 'AFRICA'),
filled as (select a.year, a.country, a.sector, nr.emp, nr.hours_emp, {new_capital} as capital, {comp} as comp_emp from acc a join nr on nr.year = a.year and nr.sector = a.sector join least on least.year = a.year
  join acc lk on lk.year = a.year and lk.sector = a.sector and lk.country = least.country join lc on lc.year = a.year and lc.sector = a.sector join c on c.year = a.year and c.sector = a.sector where a.country = 'AFRICA')"""]
    if region == "none":
        parts.append("full_acc as (select * replace (case when country = 'AFRICA' then 0 else emp end as emp, case when country = 'AFRICA' then 0 else hours_emp end as hours_emp, case when country = 'AFRICA' then 0 else capital end as capital, case when country = 'AFRICA' then 0 else comp_emp end as comp_emp) from acc)")
    else:
        parts.append("full_acc as (select a.* replace (coalesce(f.emp, a.emp) as emp, coalesce(f.hours_emp, a.hours_emp) as hours_emp, coalesce(f.capital, a.capital) as capital, coalesce(f.comp_emp, a.comp_emp) as comp_emp) from acc a left join filled f on f.year = a.year and f.country = a.country and f.sector = a.sector)")
    dep = "" if offset is None else f" union all select year, o_country, o_sector, d_country, d_sector, value * case when ktype = 'k0' then 0.01 else 0.02 end from kc where exists (select 1 from acc where acc.year = kc.year + {offset} and acc.sector = kc.d_sector)"
    parts.append(f"inputs as (select year, o_country, o_sector, d_country, d_sector, 'industry' as kind, sum(value) as value from (select year, o_country, o_sector, d_country, d_sector, value from flow where kind = 'industry'{dep}) group by all)")
    parts.append(f"labour as (select * replace (hours_emp * coalesce(m, 0) as hours_emp) from (select *, {multiplier} as m from full_acc))")
    solve = market.SQL_LAMBDA.removeprefix(market.SQL + ",").replace("from acc where", "from labour where").replace("from flow f", "from inputs f").replace("from acc p", "from labour p")
    return "with recursive " + ",".join([*parts, solve]) + " select l.year, l.country, l.sector, round(case when l.sector = 'S4' then 0 else hours_emp end, 3) + 0.0 as abstract, round(lam, 9) + 0.0 as lam, round(capital, 2) + 0.0 as capital from labour l join lam on lam.year = l.year and lam.country = l.country and lam.sector = l.sector"


def _method(name: str, region: str, multiplier: str = "1.0", offset: int | None = 1):
    """Abstract labour, labour values and capital stock under one method."""

    def f(s, d):
        (method,) = admitted([name], "calculate", allow_experimental=True, catalog=METHODS)
        e = _method_economy(s, d)
        t = plan.prepared(e, method)
        lam = plan.values(e, method, t)[2]
        rows = t.select("year", "country", "sector", F.col("abstract_emp_mv").alias("abstract"), "capital").join(lam, ["year", "country", "sector"])
        return rows.select("year", "country", "sector", (F.round(F.when(market.productive("sector"), F.col("abstract")).otherwise(0.0), 3) + 0.0).alias("abstract"), (F.round("lam", 9) + 0.0).alias("lam"), (F.round("capital", 2) + 0.0).alias("capital"))

    f.__name__ = f"m_{name}"
    QUERIES[f.__name__] = f
    ORACLE[f.__name__] = _method_sql(region, multiplier, offset)


_WAGE = "(comp_emp / hours_emp) / min(comp_emp / hours_emp) filter (comp_emp > 0) over (partition by year{})"
_method("wiodr13", "row")
_method("zerodep_1", "row", offset=None)
_method("norow_w13", "none")
_method("wiodr13v09", "old")
_method("alternative_1", "reduction", offset=0)
_method("alternative_2", "reduction", "6.25 * hours_hs / hours_emp + 2.5 * hours_ms / hours_emp + (1 - hours_hs / hours_emp - hours_ms / hours_emp)", 0)
_method("ochoa_1", "reduction", _WAGE.format(""), 0)
_method("ochoa_2", "reduction", _WAGE.format(", country"), 0)
_method("petrovic", "reduction", _R.format("hs") + " * hours_hs / hours_emp + " + _R.format("ms") + " * hours_ms / hours_emp + (1 - hours_hs / hours_emp - hours_ms / hours_emp)", 0)


# ---------------------------------------------------------------- assumptions


@q(BASE + " select year, country, sector, case when country = 'ASIA' then emp else empe end as empe, case when country = 'ASIA' then hours_emp else hours_empe end as hours_empe from acc")
def a1_employees_as_engaged(s, d):
    return assumptions.employees_as_engaged(market.accounts(s, d), "ASIA").select("year", "country", "sector", "empe", "hours_empe")


@q(BASE + " select year, country, sector, case when country = 'ASIA' then emp * 2.5 * 1000 else hours_emp end as hours_emp from acc")
def a2_hours_per_worker(s, d):
    a = market.accounts(s, d)
    return assumptions.hours_per_worker(a, "ASIA", a.select("year", "sector").distinct().withColumn("coefficient", F.lit(2.5))).select("year", "country", "sector", "hours_emp")


@q(BASE + " select year, country, sector, round(case when country = 'ASIA' then emp * (year - 1940) / 100 else empe end, 6) as empe from acc")
def a3_wage_share(s, d):
    a = economy(s, d).accounts
    return rounded(assumptions.wage_share(a, "ASIA", a.select("year", (F.col("year") - 1940.0).alias("percent")).distinct()), 6, "empe").select("year", "country", "sector", "empe")


@q(BASE + """, w as (select year, sector, sum(emp) as e, sum(hours_emp) as h, sum(gdp_us) as va from acc where country <> 'ASIA' group by all),
li as (select year, country, sum(capital) / sum(hours_emp) as r from acc where country <> 'ASIA' group by all), le as (select year, min(country) as least from li where r = (select min(r) from li b where b.year = li.year) group by year),
k as (select a.year, a.sector, a.capital / a.hours_emp as ph from acc a join le on le.year = a.year and le.least = a.country),
o as (select a.year, a.sector, 5000.0 * (a.gdp_us * e / va) / sum(a.gdp_us * e / va) over (partition by a.year) as emp, h / e as he from acc a join w using (year, sector) where a.country = 'ASIA')
select o.year, o.sector, round(emp, 6) as emp, round(emp * he, 6) as hours_emp, round(emp * he * ph, 4) as capital from o left join k on k.year = o.year and k.sector = o.sector""")
def a4_rest_of_world(s, d):
    a = economy(s, d).accounts
    r = assumptions.rest_of_world(a.withColumn("country", F.when(F.col("country") == "ASIA", "ROW").otherwise(F.col("country"))), a.select("year").distinct().withColumn("total", F.lit(5000.0)))
    return rounded(rounded(r.where("country = 'ROW'"), 6, "emp", "hours_emp"), 4, "capital").select("year", "sector", "emp", "hours_emp", "capital")


@q(BASE + ", t as (select *, hours_hs / hours_emp as hs, hours_ms / hours_emp as ms from acc), m as (select year, sector, avg(hs) as hs, avg(ms) as ms from t where country <> 'ASIA' group by all) select t.year, t.country, t.sector, round(case when country = 'ASIA' then 1 - m.hs - m.ms else 1 - t.hs - t.ms end, 9) as share_ls from t join m using (year, sector)")
def a7_skill_shares(s, d):
    t = indicators.with_indicators(economy(s, d).accounts, ["share_hs", "share_ms"])
    return rounded(assumptions.skill_shares_from_mean(t, "ASIA"), 9, "share_ls").select("year", "country", "sector", "share_ls")


@q(BASE + ", m as (select year, sector, sum(comp_emp) / sum(gdp_us) as r from acc where country <> 'ASIA' group by all) select a.year, a.country, a.sector, round(case when country = 'ASIA' then gdp_us * r else comp_emp end, 4) as comp_emp from acc a left join m using (year, sector)")
def a7_compensation(s, d):
    return rounded(assumptions.compensation_from_world(economy(s, d).accounts, "ASIA"), 4, "comp_emp").select("year", "country", "sector", "comp_emp")


@q(BASE + ", m as (select year, sector, sum(capital) / sum(gdp_us) as r from acc where country in ('EUROPE', 'AMERICA') group by all) select a.year, a.country, a.sector, round(case when country = 'ASIA' then gdp_us * r else capital end, 4) as capital from acc a left join m using (year, sector)")
def a7_capital(s, d):
    return rounded(assumptions.capital_from_list(economy(s, d).accounts, ["EUROPE", "AMERICA"], "ASIA"), 4, "capital").select("year", "country", "sector", "capital")


@q(BASE + " select year, country, sector, case when country = 'ASIA' then 0 else emp end as emp, case when country = 'ASIA' then 0 else hours_emp end as hours_emp from acc")
def a8_without_region(s, d):
    return assumptions.without_region(market.accounts(s, d), ["emp", "hours_emp"], "ASIA").select("year", "country", "sector", "emp", "hours_emp")


@q(BASE + " select year, o_country, o_sector, d_country, d_sector, kind, round(value * (year - 1990) / 10, 4) as value from flow")
def a9_conversion(s, d):
    f, a = tables(s, d)
    return rounded(assumptions.converted(f, a, a.select("year", ((F.col("year") - 1990) / 10).alias("rate")).distinct(), ["gdp_us"])[0], 4, "value")


# ---------------------------------------------------------------- preparation, validation, analytics


@q(BASE + " select country, sector as code, year, gdp_us as value from acc where sector <> 'S0'")
def p1_long_years(s, d):
    a = economy(s, d).accounts
    years = [r.year for r in a.select("year").distinct().orderBy("year").collect()]
    wide = a.groupBy("country", F.col("sector").alias("code")).pivot("year", years).agg(F.first("gdp_us"))
    wide = wide.select("country", "code", *(F.col(str(y)).alias(f"_{y}") for y in years))
    return preparation.long_years(wide, ["country", "code"], "S0").where("value is not null")


@q(BASE + " select year, country, sector, gdp_us * 1000000 as gdp_us, emp * 1000 as emp, true as normalised from acc")
def p4_units(s, d):
    return preparation.normalised(market.accounts(s, d).select("year", "country", "sector", "gdp_us", "emp"), {"gdp_us": 1e6, "emp": 1e3})


@q(BASE + ", t as (select year, country, sum(capital) as value from acc group by all) select a.year, a.country, a.sector as code, round(t.value * a.gdp_us / sum(a.gdp_us) over (partition by a.year, a.country), 4) as value from acc a join t using (year, country)")
def p5_disaggregation(s, d):
    a = economy(s, d).accounts
    totals = a.groupBy("year", "country").agg(F.sum("capital").alias("value")).withColumn("code", F.lit("TOT"))
    mapping = a.select(F.lit("TOT").alias("aggregated"), F.col("sector").alias("disaggregated")).distinct()
    return rounded(preparation.disaggregated(totals, mapping, a.select("year", "country", F.col("sector").alias("code"), F.col("gdp_us").alias("weight"))), 4, "value")


@q(BASE + ", o as (select year, country, sector, go_us * case when country = 'ASIA' and sector = 'S0' then 1.01 when sector = 'S3' then 1 + 1e-10 else 1 end as x from acc where not (country = 'EUROPE' and year = 1996)), u as (select year, o_country as country, o_sector as sector, sum(value) as uses from flow group by all) select year, country, sector, round(uses, 2) as uses, round(x, 2) as x from u full join o using (year, country, sector) where abs(coalesce(uses, 0) - coalesce(x, 0)) > 1e-6 + 1e-8 * abs(coalesce(x, 0))")
def p6_accounting_identity(s, d):
    """Planted: output 1 % too high, output missing, and output off by less than the tolerance."""
    x = F.col("go_us") * F.when(F.expr("country = 'ASIA' and sector = 'S0'"), 1.01).when(F.col("sector") == "S3", 1 + 1e-10).otherwise(1.0)
    f, a = tables(s, d)
    output = a.where("not (country = 'EUROPE' and year = 1996)").select("year", "country", "sector", x.alias("x"))
    return rounded(preparation.accounting_errors(f, output), 2, "uses", "x")


@q(BASE + ", t as (select year, country, sector, case when country = 'ASIA' and sector = 'S2' then null else go_us end as go_us, case when sector = 'S4' then 'Infinity'::double else gdp_us end as gdp_us from acc union all select year, country, sector, go_us, gdp_us from acc where sector = 'S1') select * from (select 'repeated key' as problem, count(*) as n from (select 1 from t group by year, country, sector having count(*) > 1) union all select 'go_us: not finite', count(*) from t where go_us is null or isnan(go_us) or isinf(go_us) union all select 'gdp_us: not finite', count(*) from t where gdp_us is null or isnan(gdp_us) or isinf(gdp_us)) where n > 0")
def p8_table_keys(s, d):
    """Planted: repeated keys, missing and infinite values."""
    a = economy(s, d).accounts.select("year", "country", "sector", "go_us", "gdp_us")
    damaged = a.withColumns({"go_us": F.when(~F.expr("country = 'ASIA' and sector = 'S2'"), F.col("go_us")), "gdp_us": F.when(F.col("sector") == "S4", F.lit("Infinity").cast("double")).otherwise(F.col("gdp_us"))})
    return preparation.key_errors(damaged.unionByName(a.where("sector = 'S1'")), ["year", "country", "sector"], ["go_us", "gdp_us"])


_SEVEN = BASE + """, a as (select *, comp_emp / hours_emp as pay, go_us / emp as share, 1995 + 0.0 as base_year from acc),
c as (select year, country, sum(gdp_us) as gdp_us, avg(hours_emp) as hours_emp, sum(emp) as emp, sum(go_us) as go_us, sum(pay * emp) / sum(emp) as pay, sum(go_us) / sum(emp) as share, any_value(base_year) as base_year from a group by all),
w as (select year, 'WWW' as country, sum(gdp_us) as gdp_us, avg(hours_emp) as hours_emp, sum(emp) as emp, sum(go_us) as go_us, sum(pay * emp) / sum(emp) as pay, sum(go_us) / sum(emp) as share, any_value(base_year) as base_year from c group by year),
b as (select * from c union all by name select * from w)
select year, country, round(gdp_us, 4) as gdp_us, round(hours_emp, 6) as hours_emp, round(pay, 9) as pay, round(share, 6) as share, base_year, null::double as gini, round(go_us / emp, 6) as per_person from b"""


def _seven(s, d):
    """A registry with all seven strategies at both levels, its sector table and the roll-up."""
    one = [("gdp_us", "sum"), ("emp", "sum"), ("go_us", "sum"), ("hours_emp", "mean"), ("pay", "weighted_mean"), ("share", "ratio_of_sums"), ("base_year", "invariant"), ("gini", "not_applicable"), ("per_person", "formula")]
    more = {"weighted_mean": {"weight": "emp"}, "ratio_of_sums": {"numerator": "go_us", "denominator": "emp"}, "formula": {"module": "output_per_person"}}
    rows = [{"indicator": i, "level": level, "strategy": k, **more.get(k, {})} for i, k in one for level in ("country", "world")]
    found = registry.rules(rows)
    registry.checked(found, {"gdp_us", "emp", "go_us", "hours_emp"}, [], declared={"pay": "USD#current/hour", "share": "USD#current/person", "base_year": "1", "gini": "1"})
    t = kept(market.accounts(s, d).withColumns({"pay": F.col("comp_emp") / F.col("hours_emp"), "base_year": F.lit(1995.0)}), "sectors")
    return found, t, rollup.two_levels(t, found.direct, {i: f.make for i, f in found.formulas.items()})


@q(_SEVEN)
def o91_registry(s, d):
    """One registry with all seven strategies at both levels, its units checked before the roll-up."""
    r = _seven(s, d)[2]
    return rounded(rounded(rounded(r, 4, "gdp_us"), 6, "hours_emp", "share", "per_person"), 9, "pay").select("year", "country", "gdp_us", "hours_emp", "pay", "share", "base_year", "gini", "per_person")


_RECOMPUTED = BASE + """, y as (select count(distinct year) as w from acc), c as (select count(*) as n from (select distinct year, country from acc)),
planted(check_id, scope, off) as (values ('recomputed_country', 'pay', 0.1), ('recomputed_country', 'share', 0.1), ('recomputed_country', 'per_person', 0.1), ('recomputed_world', 'gdp_us', 0.1), ('recomputed_world', 'hours_emp', 0.1), ('recomputed_world', 'base_year', round(1 / 1995.0, 6))),
l(check_id, n) as (select 'recomputed_country', n from c union all select 'recomputed_world', w from y),
i(scope) as (select unnest(['gdp_us', 'emp', 'go_us', 'hours_emp', 'pay', 'share', 'base_year', 'gini', 'per_person']))
select l.check_id, i.scope, n, coalesce(off, 0)::double as max_scaled, case when off is null then 'passed' else 'failed' end as status from l cross join i left join planted p on p.check_id = l.check_id and p.scope = i.scope"""


@q(_RECOMPUTED)
def v2_recomputed(s, d):
    """Every strategy recomputed by error-free sums at both levels. Planted: a fault in each kind of rule, at one level."""
    found, t, r = _seven(s, d)
    at = lambda c, place, by=1.1, plus=0.0: F.when(F.col("country") == place, F.col(c) * by + plus).otherwise(F.col(c))
    published = r.withColumns({"pay": at("pay", "ASIA"), "share": at("share", "EUROPE"), "per_person": at("per_person", "AMERICA"), "gdp_us": at("gdp_us", "WWW"), "hours_emp": at("hours_emp", "WWW"), "base_year": at("base_year", "WWW", 1.0, 1.0)})
    rows = recomputed.recomputed_all(t, published, found)
    return rows.select("check_id", "scope", "n", F.round(F.when(F.col("status") == "passed", 0.0).otherwise(F.col("max_scaled")), 6).alias("max_scaled"), "status")


_RUN = BASE + """, y as (select count(distinct year) as w from acc), c as (select count(*) as n from (select distinct year, country from acc)), l(check_id, n) as (select 'recomputed_country', n from c union all select 'recomputed_world', w from y)
select check_id, sum(n)::bigint * 26 as n, 26::bigint as indicators, 0::bigint as failed from l group by check_id"""


@q(_RUN)
def v2_recomputed_run(s, d):
    """All 26 roll-ups of a full calculation, recomputed at both levels."""
    r = plan.calculate(economy(s, d), METHODS["wiodr13"])
    rows = recomputed.recomputed_all(r.sectors, r.countries, r.rules)
    return rows.groupBy("check_id").agg(F.sum("n").alias("n"), F.count("*").alias("indicators"), F.count_if(F.col("status") == "failed").alias("failed"))


_RANGES = BASE + """, planted(scope, off) as (values ('exports_us', 1.0), ('emp', 1.0), ('depreciation_us', 0.5)),
i(scope) as (select unnest(['go_us', 'gdp_us', 'emp', 'hours_emp', 'comp_emp', 'abstract_emp_mv', 'gdp_mv', 'gdp_p_us', 'go_mv', 'lfv_emp', 'value_m_mv', 'exports_us', 'exports_mv', 'imports_us', 'imports_mv', 'gdp_du', 'go_du', 'depreciation_us', 'surplus_emp']))
select 'range' as check_id, i.scope, (select count(*) from acc) as n, coalesce(off, 0)::double as max_abs, case when off is null then 'passed' else 'failed' end as status from i left join planted p using (scope)"""


@q(_RANGES)
def v7_ranges(s, d):
    """The range profile of a method without depreciation over all its indicators. Planted: negative exports, a pinned
    negative cell (excused), a pin on a cell that is sound (stale) and depreciation where there must be none."""
    t = plan.calculate(economy(s, d), METHODS["wiodr13"]).sectors
    cell = lambda year, country, sector: F.expr(f"year = {year} and country = '{country}' and sector = '{sector}'")
    t = t.withColumns({
        "exports_us": F.when(F.expr("country = 'AFRICA' and sector = 'S0'"), -1.0).otherwise(F.col("exports_us")), "comp_emp": F.when(cell(1996, "ASIA", "S2"), -5.0).otherwise(F.col("comp_emp")),
        "depreciation_us": F.when(cell(1995, "ASIA", "S4"), 0.5).otherwise(0.0),
    })
    pinned = s.createDataFrame([(1996, "ASIA", "S2", "comp_emp", -1), (1997, "EUROPE", "S3", "emp", -1)], "year int, country string, sector string, indicator string, sign int")
    profile = recomputed.profile_of("zero", ({"indicator": "surplus_emp", "low": -1.0, "missing": True},))
    return recomputed.in_profile(t, profile, pinned).select("check_id", "scope", "n", "max_abs", "status")


@q(BASE + ", " + _INV + ", g as (select distinct year, d_country, d_sector, ktype from kc where year < (select max(year) from acc)) select 'depreciation_sums' as check_id, count(*) as n, 0.01::double as max_scaled, 'failed' as status from g")
def v5_depreciation_sums(s, d):
    """Depreciation against capital times rates. Planted: one destination's, of one type, 1 % too high."""
    w, stock = _composition(*tables(s, d))
    k = kept(capital.allocate(w.drop("ktype"), stock), "composition")
    labels = stock.select("year", "sector").distinct()
    rates = labels.withColumn("ktype", F.lit("k0")).withColumn("rate", F.lit(0.05)).unionByName(labels.withColumn("ktype", F.lit("k1")).withColumn("rate", F.lit(0.1)))
    ktype = F.when(F.col("o_sector").isin("S0", "S1"), "k0").otherwise("k1")
    ktypes = stock.select(F.col("sector").alias("o_sector")).distinct().withColumn("ktype", ktype)
    dep = capital.depreciation(k, rates, ktypes, year_offset=1).withColumn("ktype", ktype)
    dep = dep.withColumn("value", F.when(F.expr("d_country = 'EUROPE' and ktype = 'k0'"), F.col("value") * 1.01).otherwise(F.col("value")))
    last = rates.agg(F.max("year").alias("last"))
    applied = rates.select((F.col("year") - 1).alias("year"), F.col("sector").alias("d_sector"), "ktype", "rate")
    base = k.withColumn("ktype", ktype).crossJoin(last).where("year < last").drop("last")  # one row
    return recomputed.depreciation_sums(dep, base, applied).select("check_id", "n", F.round("max_scaled", 6).alias("max_scaled"), "status")


_SIDECAR = BASE + """, r(indicator) as (select unnest(['abstract_emp_m_mv', 'value_m_mv'])) select indicator, 'formula' as strategy, (select count(distinct year) from acc) as years from r"""


@q(_SIDECAR)
def o92_sidecar(s, d):
    """Formulas among a calculation's stored rules, reconciled with those in force, with the years they were applied to."""
    r = plan.calculate(economy(s, d), METHODS["wiodr13"])
    stored = kept(registry.sidecar(s, r.rules), "sidecar")
    registry.reconciled(r.rules, stored)
    years = r.countries.agg(F.count_distinct("year").alias("years"))
    named = stored.where("strategy = 'formula' and level = 'world' and module in ('abstract_labour_per_person', 'value_of_money')")
    return named.select("indicator", "strategy").crossJoin(years)  # one row


_LEDGER = SEC + """, checks as (
  select 'structure' as check_id, 1 as n, case when count(*) = count(distinct (year, country, sector)) then 0.0 else 1.0 end as scaled from acc
  union all select 'recomputed_country', count(*), max(abs(want - got) / greatest(1, abs(want))) from (select year, country, sum(gdp_us) as want, sum(gdp_us * case when country = 'ASIA' then 1.1 else 1 end) as got from acc group by all)
  union all select 'recomputed_world', count(*), max(abs(want - got) / greatest(1, abs(want))) from (select year, sum(gdp_us) as want, sum(gdp_us * case when country = 'ASIA' then 1.1 else 1 end) as got from acc group by all)
  union all select 'zero_diagonal', count(distinct (year, o_country)), 0.0 from flow where o_country = d_country
  union all select 'transfers_cancel', count(*), max(abs(t) / greatest(1, size)) from (select year, sum(t) as t, sum(abs(t)) as size from (select year, o_country, d_country, sum(case when o_sector <> 'S4' then transfer else 0 end) as t from tr group by all) group by year)
  union all select 'column_sums', count(*), 0.0 from acc
  union all select 'row_sums', count(*), max(abs(go_mv - bad) / greatest(1, abs(bad))) from (select go_mv, go_mv * case when sector = 'S1' then 1.01 else 1 end as bad from ind)
  union all select 'range', count(*), max(greatest(-lam, 0)) from lam
  union all select 'diagnostics', count(distinct year), 0.0 from acc)
select check_id, n, round(scaled, 6) as max_scaled, case when scaled > 1e-9 then 'failed' else 'passed' end as status from checks"""


@q(_LEDGER)
def v_ledger(s, d):
    """Planted: one country's published value added 10 % too high, one sector's output in values 1 %."""
    e = economy(s, d)
    r = plan.calculate(e, METHODS["wiodr13"])
    n = e.accounts.count()
    w, stock = _composition(e.flows, e.accounts)
    k = capital.allocate(w.drop("ktype"), stock)
    totals = stock.select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), F.col("stock").alias("total"))
    raised = F.when(F.col("country") == "ASIA", F.col("gdp_us") * 1.1).otherwise(F.col("gdp_us"))
    published = r.sectors.groupBy("year", "country").agg(F.sum("gdp_us").alias("gdp_us")).withColumn("gdp_us", raised)
    published = published.unionByName(published.groupBy("year").agg(F.lit("WWW").alias("country"), F.sum("gdp_us").alias("gdp_us")))
    damaged = r.sectors.withColumn("go_mv", F.when(F.col("sector") == "S1", F.col("go_mv") * 1.01).otherwise(F.col("go_mv")))
    rows = validation.ledger(
        validation.structure(r.sectors, ["year", "country", "sector"], n), validation.recomputed(r.sectors, published, "gdp_us"), validation.recomputed_world(r.sectors, published, "gdp_us"),
        validation.zero_diagonal(r.bilateral, ["exports_values", "transfers_values"]), validation.transfers_cancel(r.bilateral), validation.column_sums(k, totals, "column_sums"),
        validation.row_sums(r.valued, damaged), validation.in_range(r.lam, "lam"), validation.diagnostics_profile(r.diagnostics),
    )
    return rows.select("check_id", "n", F.round("max_scaled", 6).alias("max_scaled"), "status")


@q(BASE + ", p as (select year, gdp_us as x, comp_emp as y from acc where gdp_us <> 0 and comp_emp <> 0) select year, count(*) as n, round(corr(x, y), 8) as r, round(avg(abs(x - y) / abs(y)), 8) as mad, round(sum(abs(x - y)) / sum(y), 8) as mawd, round(sqrt(sum((x - y) * (x - y))) / sqrt(sum(y * y)), 8) as nvd, round(sqrt(avg(((x - y) / y) * ((x - y) / y))), 8) as rmspe, round(stddev_samp(x / y) / avg(x / y), 8) as cv, round(degrees(atan(stddev_samp(x / y) / avg(x / y))), 6) as theta, round(2 * sin(atan(stddev_samp(x / y) / avg(x / y)) / 2), 8) as d from p group by year")
def x1_deviations(s, d):
    r = analytics.deviations(market.accounts(s, d), ["year"], "gdp_us", "comp_emp")
    return rounded(rounded(r, 8, "r", "mad", "mawd", "nvd", "rmspe", "cv", "d"), 6, "theta").select("year", "n", "r", "mad", "mawd", "nvd", "rmspe", "cv", "theta", "d")


@q(BASE + " select year, country, round(sum(go_us) / 1e6, 6) as market, round(sum(gdp_us) / 1e6, 6) as net, round(100 * (sum(gdp_us) - sum(go_us)) / sum(go_us), 6) as net_pct from acc group by all")
def x3_price_table(s, d):
    a = economy(s, d).accounts
    rows = analytics.by_method({"market": a.select("year", "country", F.col("go_us").alias("value")), "net": a.select("year", "country", F.col("gdp_us").alias("value"))})
    return rounded(analytics.price_table(rows, ["market", "net"]), 6, "market", "net", "net_pct")


@q(BASE + ", p as (select year, o_country as o, d_country as d, sum(value) as v from flow where o_country <> d_country group by all) select a.year, a.o as origin, a.d as destination, round(a.v - coalesce(b.v, 0), 2) as net from p a left join p b on b.year = a.year and b.o = a.d and b.d = a.o where a.o < a.d")
def x4_pair_series(s, d):
    pairs = flows.bilateral(economy(s, d).flows, {"v": F.col("value")})
    return rounded(analytics.pair_series(pairs, "v"), 2, "net")


@q(SEC + ", g as (select year, country, sum(hours_emp * p) as gdp_mv from ind group by all), st as (select year, o_country as country, sum(transfer) as v from tr group by all), gt as (select year, d_country as country, sum(transfer) as v from tr group by all) select g.year, g.country, round((coalesce(st.v, 0) - coalesce(gt.v, 0)) / gdp_mv, 8) as share from g left join st using (year, country) left join gt using (year, country)")
def x4_net_transfer_share(s, d):
    r = plan.calculate(economy(s, d), METHODS["wiodr13"])
    return rounded(flows.net_transfer_share(r.bilateral, r.sectors.groupBy("year", "country").agg(F.sum("gdp_mv").alias("gdp_mv"))), 8, "share")


@q(BASE + " select year, country, sector, case when comp_emp / gdp_us - 0.3 < 0 then null else round(comp_emp / gdp_us - 0.3, 9) end as rate from acc")
def x5_rate_series(s, d):
    return rounded(analytics.rate_series(market.accounts(s, d).select("year", "country", "sector", (F.col("comp_emp") / F.col("gdp_us") - 0.3).alias("rate")), "rate"), 9, "rate")


@q(BASE + " select year, country, case when sector in ('S0', 'S1') then 'goods' else 'services' end as bundle, round(sum(go_us) / 2e9, 12) as go_us from acc group by all")
def x6_bundle_sums(s, d):
    a = market.accounts(s, d)
    bundles = a.select("sector", F.when(F.col("sector").isin("S0", "S1"), "goods").otherwise("services").alias("bundle")).distinct()
    return rounded(analytics.bundle_sums(a, bundles, "go_us"), 12, "go_us")
