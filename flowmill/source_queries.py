"""Further registered queries: sources and sinks, pinned exceptions, capital by list, assumptions about
the rest of the world, preparation and checks of results. They join those of ``flowmill.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions import safe
from flowmill.functions.aggspec import AggSpec, audited
from flowmill.functions.keep import kept, shared_path
from flowmill.operators import assumptions, capital, flows, preparation, relational, satellites, validation
from flowmill.queries import _INV, _LACK, BASE, LAM, _lacking, _lam, _lcu, _simple, economy, q, rounded, tables
from flowmill.sources import bundles, market, positions, readers

KEYS = ["year", "country", "sector"]


# ---------------------------------------------------------------- sources and sinks


@q(BASE + " select year, country, sector, go_us from acc")
def o01_bundle(s, d):
    """Written with its sidecar, verified and read (O-01, O-20)."""
    path = shared_path(s, "bundle")
    readers.write_bundle(market.accounts(s, d).select(*KEYS, "go_us"), path)
    return readers.read_bundle(s, path)


@q(BASE + " select year, country, sector, go_us from acc")
def o03_european_csv(s, d):
    path = shared_path(s, "european")
    comma = F.translate(F.col("go_us").cast("decimal(18,2)").cast("string"), ".", ",")
    market.accounts(s, d).select(*KEYS, comma.alias("go_us")).write.csv(path, sep=";", header=True)
    return readers.european_csv(s, path, "year int, country string, sector string, go_us double")


@q(BASE + " select distinct country, sector, case when sector = 'S4' then '' else 'p' end as note from acc")
def o04_catalog_csv(s, d):
    path = shared_path(s, "catalog")
    note = F.when(F.col("sector") == "S4", "").otherwise(" p ")
    market.accounts(s, d).select(F.concat(F.lit(" "), "country").alias("country"), "sector", note.alias("note")).distinct().write.csv(path, header=True)
    return readers.catalog_csv(s, path, ["country", "sector", "note"])


@q(BASE + " select o_country, o_sector, d_country, 'HH' as d_sector, round(sum(value), 2) as value from flow where kind = 'final' group by all")
def o08_wide_block(s, d):
    """A block of final demand as tab-separated lines with a header, read back as cells."""
    path = shared_path(s, "block")
    f = economy(s, d).flows.where("kind = 'final'")
    countries = [r.d_country for r in f.select("d_country").distinct().orderBy("d_country").collect()]
    wide = f.groupBy("o_country", "o_sector").pivot("d_country", countries).agg(F.sum(market.money("value")))
    line = F.concat_ws("\t", "o_country", "o_sector", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0")) for c in countries))
    head = s.createDataFrame([("\t".join(["country", "sector", *countries]),)], "value string")
    head.unionByName(wide.select(line.alias("value"))).write.text(path)
    return readers.wide_block(s, path, 2, [(c, "HH") for c in countries], header_rows=1).where("value <> 0")


@q(BASE + " select year, country, sector, go_us, case when sector = 'S1' and country = 'ASIA' then null else hours_emp end as h from acc")
def o21_result_csv(s, d):
    path = shared_path(s, "result")
    readers.write_result_csv(_lacking(s, d).select(*KEYS, "go_us", "h"), path)
    return s.read.csv(path, sep=";", header=True, schema="year int, country string, sector string, go_us double, h double")


@q(BASE + f" select year, country, sector, h, g, case when h is null then 'source_missing' else 'finite' end as h__state, case when g is null then 'not_applicable' else 'finite' end as g__state from {_LACK}")
def o22_sparse_states(s, d):
    """States stored as one row per missing cell and put back."""
    a = _lacking(s, d, economy(s, d).accounts).select(*KEYS, "h", "g")
    stated = a.withColumns({"hs": F.lit("source_missing"), "gs": F.lit("not_applicable")})
    sparse = kept(safe.sparse_states(stated, KEYS, ["h", "g"], {"h": "hs", "g": "gs"}), "states")
    return safe.restored_states(a, KEYS, ["h", "g"], sparse).select(*KEYS, "h", "g", "h__state", "g__state")


_ODD = f"(select year, country, sector, 'h' as indicator, 'missing' as problem, c as context, 'stop' as action from {_LACK}, (values ('first'), ('second')) v(c) where h is null union all select year, country, sector, 'g', 'missing', c, 'stop' from {_LACK}, (values ('first'), ('second')) v(c) where g is null and sector <> 'S4')"


def _odd(s, d, context):
    declared = (F.col("indicator") == "g") & (F.col("sector") == "S4")
    return safe.anomalies(_lacking(s, d), KEYS, ["h", "g"], declared, context, "stop")


@q(BASE + f" select * from {_ODD}")
def o23_anomaly_report(s, d):
    """Two runs append their anomalies to one report."""
    path = shared_path(s, "report")
    readers.append_report(_odd(s, d, "first"), path)
    return readers.append_report(_odd(s, d, "second"), path)


@q(BASE + f" select * exclude (rn) from (select *, row_number() over (partition by indicator order by year, country, sector) as rn from {_ODD} where context = 'first') where rn <= 3")
def o56_anomaly_examples(s, d):
    """The first three examples of each indicator: the limit is the feature."""
    return relational.first_examples(_odd(s, d, "first"), ["indicator"], KEYS)


_WIDE = f"(select year, country, sector, i as indicator, case i when 'go_us' then go_us else emp end as value from acc, (values ('emp'), ('go_us')) v(i) where not (sector = 'S2' and i = 'emp'))"


@q(BASE + f" select y.year, i.indicator, s.sector, c.country, w.value from (select distinct year from acc) y cross join (select distinct country from acc) c cross join (select distinct sector from acc) s cross join (values ('emp'), ('go_us')) i(indicator) left join {_WIDE} w on w.year = y.year and w.country = c.country and w.sector = s.sector and w.indicator = i.indicator")
def o02_legacy_array(s, d):
    """An array of four axes as lines in column-major order, over many files; labels come back from positions."""
    a = economy(s, d).accounts
    cells = a.unpivot(KEYS, ["emp", "go_us"], "indicator", "value").where("not (sector = 'S2' and indicator = 'emp')")
    of = lambda c: sorted(r[0] for r in a.select(c).distinct().collect())
    axes = {"year": of("year"), "indicator": ["emp", "go_us"], "sector": of("sector"), "country": of("country")}
    path = shared_path(s, "legacy")
    text = F.coalesce(F.col("value").cast("string"), F.lit("NA"))
    positions.encoded(cells, axes).repartitionByRange(6, "pos").sortWithinPartitions("pos").select(text.alias("value")).write.text(path)
    read = positions.numbered_lines(s, path).select(F.col("line").alias("pos"), F.when(F.col("value") != "NA", F.col("value").cast("double")).alias("value"))
    kinds = dict(cells.dtypes)
    return positions.decoded(read, {k: (v, kinds[k]) for k, v in axes.items()}, [len(v) for v in axes.values()])


_BY_NATION = "with " + market.SQL.replace("sr.r_name", "sn.n_name").replace("cr.r_name", "cn.n_name")


@q(_BY_NATION + " select year, o_country, o_sector, d_country, d_sector, round(sum(value) / 1000, 6) as value from flow where kind = 'industry' and o_country not in ('CHINA', 'EGYPT') and d_country not in ('CHINA', 'EGYPT') group by all having sum(value) <> 0")
def o09_positioned_block(s, d):
    """Flows by nation as lines of bare numbers, labels in files of their own, two nations named ROW, over many files and splits."""
    f = kept(market.flows(s, d, "nation").where("kind = 'industry'"), "flows")
    renamed = lambda c: F.when(F.col(c).isin("CHINA", "EGYPT"), "ROW").otherwise(F.col(c))
    columns = f.select("d_country", "d_sector").distinct().orderBy("d_country", "d_sector").collect()
    wide = f.withColumn("d", F.concat_ws(".", "d_country", "d_sector")).groupBy(*flows.ORIGIN).pivot("d", [f"{r.d_country}.{r.d_sector}" for r in columns]).agg(F.sum("value"))
    wide = kept(wide.select(*flows.ORIGIN, F.concat_ws("\t", *(F.coalesce(F.col(f"`{r.d_country}.{r.d_sector}`"), F.lit(0.0)).cast("decimal(30,2)").cast("string") for r in columns)).alias("value")), "wide")
    block, rows, cols = (shared_path(s, n) for n in ("block", "rows", "columns"))
    ordered = wide.repartitionByRange(5, *flows.ORIGIN).sortWithinPartitions(*flows.ORIGIN)
    ordered.select("value").write.text(block)
    wide.repartitionByRange(3, *flows.ORIGIN).sortWithinPartitions(*flows.ORIGIN).select(F.concat_ws("\t", "year", renamed("o_country"), F.lit("Industries"), "o_sector").alias("value")).write.text(rows)
    labels = s.createDataFrame(columns).repartitionByRange(2, "d_country", "d_sector").sortWithinPartitions("d_country", "d_sector")
    labels.select(F.concat_ws("\t", F.lit("x"), renamed("d_country"), F.lit("Industries"), "d_sector").alias("value")).write.text(cols)
    left = positions.label_file(s, rows, {"year": 0, "o_country": 1, "o_sector": 3})
    r = positions.positioned_block(s, block, left, positions.label_file(s, cols, {"d_country": 1, "d_sector": 3}), scale=1 / 1000)
    return r.where("value <> 0").withColumns({"year": F.col("year").cast("int"), "value": F.round("value", 6)})


@q(BASE + " select year, case year when 1995 then 'changed' when 1996 then 'removed' else 'added' end as problem from (select distinct year from acc where year in (1995, 1996) union all select 2050)")
def o26_generation(s, d):
    """A source generation verified after a file was changed under its old name, one removed and one added."""
    path, other = shared_path(s, "source"), shared_path(s, "other")
    a = kept(market.accounts(s, d).select(*KEYS, "go_us"), "accounts")
    a.repartition(1).write.partitionBy("year").parquet(path)
    before = kept(bundles.scanned(s, path), "manifest")
    bundles.verified(s, path, before, bundles.generation_id(before))
    folder = lambda root, year: bundles.files(s, root, True).where(F.col("file").startswith(f"year={year}/")).first().file
    changed = a.withColumns({"go_us": F.col("go_us") + 1})
    changed.where("year = 1995").withColumn("year", F.when(F.col("year") == 1995, 1995)).unionByName(a.where("year = 1997").withColumn("year", F.lit(2050))).repartition(1).write.partitionBy("year").parquet(other)
    old, new = folder(path, 1995), folder(other, 1995)
    bundles.removed(s, f"{path}/{old}")
    bundles.moved(s, f"{other}/{new}", f"{path}/{old}")
    bundles.removed(s, f"{path}/year=1996")
    bundles.moved(s, f"{other}/year=2050", f"{path}/year=2050")
    now = bundles.scanned(s, path, before)
    return bundles.changes(before, now).select(F.regexp_extract("file", "year=(\\d+)", 1).cast("int").alias("year"), "problem")


@q(BASE + " select year, country, sector, go_us * 2 as go_us from acc")
def o20_install(s, d):
    """A bundle with file hashes, replaced by another in two steps, verified and read."""
    path = shared_path(s, "bundle")
    a = economy(s, d).accounts.select(*KEYS, "go_us")
    bundles.install(a, path)
    bundles.install(a.withColumn("go_us", F.col("go_us") * 2), path, replace=True)
    return bundles.opened(s, path)


@q(BASE + " select distinct year from acc")
def o17_years(s, d):
    """Years of a partitioned table from its folders, beside the table's own."""
    path = shared_path(s, "by_year")
    market.accounts(s, d).select(*KEYS, "go_us").write.partitionBy("year").parquet(path)
    return s.createDataFrame([(y,) for y in bundles.years_of(s, path)], "year int")


# ---------------------------------------------------------------- joins, audits, lists


@q(BASE + ", a as (select year, country, sum(go_us) as output, sum(emp) as jobs from acc group by all), b as (select year, country, sum(gdp_us) as output from acc where country <> 'ASIA' group by all) select a.year, a.country, round(a.output, 2) as output_x, jobs, round(b.output, 2) as output_y from a left join b using (year, country)")
def o69_cross_method(s, d):
    a = economy(s, d).accounts
    x = a.groupBy("year", "country").agg(F.sum("go_us").alias("output"), F.sum("emp").alias("jobs"))
    y = a.where("country <> 'ASIA'").groupBy("year", "country").agg(F.sum("gdp_us").alias("output"))
    return rounded(relational.side_by_side(x, y, ["year", "country"]), 2, "output_x", "output_y")


@q(BASE + f" select year, country, round(sum(h), 6) as hours, case when count(h) = count(*) then 'finite' else 'partial' end as hours__state, 'equal' as hours__audit, round(avg(g), 6) as mean, case when count(g) = 0 then 'missing' else 'finite' end as mean__state, case when count(g) = 0 then 'no value' else 'equal' end as mean__audit from {_LACK} group by all")
def o95_audited(s, d):
    r = audited(_lacking(s, d), ["year", "country"], {"hours": AggSpec("sum", "h"), "mean": AggSpec("mean", "g")})
    return rounded(r, 6, "hours", "mean")


@q(BASE + " select year, o_country, o_sector, d_country, round(value / sum(value) over (partition by year, d_country), 9) as basket from flow where kind = 'final'")
def o156_named_basket(s, d):
    """The national basket of a source that names its household column otherwise."""
    f = market.flows(s, d)
    named = f.withColumn("d_sector", F.when(F.col("kind") == "final", "Household final").otherwise(F.col("d_sector")))
    return rounded(capital.national_basket(named, "Household final"), 9, "basket")


_INV_CUT = _INV.replace("sum(value) as value from flow", "sum(greatest(value - 30000, 0)) as value from flow", 1)


@q(BASE + ", " + _INV_CUT + " select year, o_country, o_sector, d_country, d_sector, round(value, 3) as value from kc where value is not null and not isnan(value)")
def o158_capital_composition_listed(s, d):
    """Investment 30 000 lower: the negative cells that arise are those of the list, and count as 0."""
    f, a = tables(s, d)
    ktype = F.when(F.col("o_sector").isin("S0", "S1"), "k0").otherwise("k1")
    final = f.where("kind = 'final'")
    cells = final.groupBy("year", "o_country", "o_sector", ktype.alias("ktype"), "d_country").agg((F.sum("value") - 30000).alias("value"))
    listed = final.where("value < 30000").select("year", "o_country", "o_sector", "d_country")
    inv = capital.truncated(cells, "value", listed, ["year", "o_country", "o_sector", "d_country"])[0]
    own = a.where(F.col("country").isin("ASIA", "EUROPE")).select(*KEYS, (F.col("hours_hs") / F.col("hours_emp")).alias("k0"), (1 - F.col("hours_hs") / F.col("hours_emp")).alias("k1"))
    shares = preparation.with_mean_country(own.unpivot(KEYS, ["k0", "k1"], "ktype", "share"), "share")
    ratio = a.select(*KEYS, capital.share("gdp_us", ["year", "country"]).alias("ratio"))
    weights = capital.composition(shares, inv, ratio).drop("ktype")
    return rounded(capital.allocate(weights, a.select(*KEYS, F.col("capital").alias("stock")), strict=True), 3, "value")


@q(BASE + ", w as (select *, case when d_sector = 'S3' then 0 else value end as weight from flow where kind = 'industry'), main as (select w.year, o_country, o_sector, d_country, d_sector, weight / nullif(sum(weight) over (partition by w.year, d_country, d_sector), 0) * capital as value from w join acc a on a.year = w.year and a.country = d_country and a.sector = d_sector), fb as (select * from flow where kind = 'final'), rest as (select a.year, o_country, o_sector, d_country, a.sector as d_sector, value / sum(value) over (partition by a.year, d_country, a.sector) * capital as value from acc a join fb on fb.year = a.year and fb.d_country = a.country where capital <> 0 and (a.sector = 'S3' or not exists (select 1 from flow f where kind = 'industry' and f.year = a.year and f.d_country = a.country and f.d_sector = a.sector))) select year, o_country, o_sector, d_country, d_sector, round(value, 3) as value from (select * from main where value is not null union all select * from rest)")
def o163_strict_allocation(s, d):
    """Columns that S3 buys have no weights; these, and the ones without flows, are the allowed ones."""
    f, a = tables(s, d)
    w = f.where("kind = 'industry'").select(*flows.ORIGIN, "d_country", "d_sector", F.when(F.col("d_sector") == "S3", 0.0).otherwise(F.col("value")).alias("weight"))
    fb = f.where("kind = 'final'").select(*flows.ORIGIN, "d_country", F.col("value").alias("weight"))
    stock = a.select(*KEYS, F.col("capital").alias("stock"))
    bought = f.where("kind = 'industry'").select("year", "d_country", "d_sector").distinct()
    columns = stock.where("stock <> 0").select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"))
    allowed = columns.where("d_sector = 'S3'").unionByName(columns.where("d_sector <> 'S3'").join(bought, capital.COLUMN, "left_anti"))
    return rounded(capital.strict_allocation(w, stock, fb, allowed), 3, "value")


@q(BASE + " select year, country, sector, greatest(gdp_us - comp_emp * 5, 0) as weight from acc")
def o165_listed_weights(s, d):
    """Negative weights become 0; they have to be the listed ones."""
    a = economy(s, d).accounts
    listed = a.where("comp_emp * 5 > gdp_us").select(*KEYS)
    return capital.truncated(a.select(*KEYS, (F.col("gdp_us") - F.col("comp_emp") * 5).alias("weight")), "weight", listed, KEYS)[0]


@q(BASE + " select year, country, sector, case when sector = 'S1' and country = 'ASIA' then 0 else capital end as stock from acc where not (country = 'AFRICA' and sector = 'S2') union all select year, country, sector, null from acc where country = 'AFRICA' and sector = 'S2'")
def o167_sanitised_stock(s, d):
    """Planted: negative stocks that are pinned with their values, missing ones of the rest of the world."""
    a = economy(s, d).accounts
    stock = a.select(*KEYS, F.expr("case when country = 'AFRICA' and sector = 'S2' then null when sector = 'S1' and country = 'ASIA' then -capital else capital end").alias("stock"))
    pinned = a.where("sector = 'S1' and country = 'ASIA' and capital > 0").select(*KEYS, (-F.col("capital")).alias("stock"))
    return capital.sanitised_stock(stock, pinned, "AFRICA")


# ---------------------------------------------------------------- indicators and assumptions

_simple("i02_skill_share", "share_hs", "hours_hs / hours_emp", places=9)
_X = "(sum(gdp_us * (1 + length(country) / 10.0)) over (partition by year, country) / sum(gdp_us) over (partition by year, country))"
_simple("i10_capital_stock_listed", "capital_us", f"greatest(capital - 5000, 0) * 1.2345678 / {_X}", lambda t: _lcu(t).withColumn("k_gfcf", F.greatest(F.col("capital") - 5000, F.lit(0.0))).withColumn("gfcf_p", F.lit(1.2345678)), 4)


@q(BASE + " select a.year, a.country, a.sector, case when a.country = 'AFRICA' then round(a.capital * (1 + (a.year - 1995) * 0.1) / (1 + (a.year - 1995) * 0.05), 6) end as capital_cu from acc a")
def a5_constant_capital(s, d):
    t = F.col("year") - 1995
    a = market.accounts(s, d).withColumns({"exchange_id": 1 + t * 0.1, "go_price": 1 + t * 0.05})
    return rounded(assumptions.constant_capital(a, 1995, "AFRICA"), 6, "capital_cu").select(*KEYS, "capital_cu")


@q(BASE + """, w as (select year, sector, sum(emp) as e, sum(hours_emp) as h, sum(gdp_us) as va from acc where country <> 'ASIA' group by all),
li as (select year, country, sum(capital) / sum(emp) as r from acc group by all), le as (select year, min(country) as least from li where r = (select min(r) from li b where b.year = li.year) group by year),
k as (select a.year, a.sector, a.capital / a.emp as per from acc a join le on le.year = a.year and le.least = a.country), g as (select li.year, r from li join le on le.year = li.year and le.least = li.country),
o as (select a.year, a.sector, 5000.0 * (a.gdp_us * e / va) / sum(a.gdp_us * e / va) over (partition by a.year) as emp, h / e as he from acc a join w using (year, sector) where a.country = 'ASIA')
select o.year, o.sector, round(emp, 6) as emp, round(emp * he, 6) as hours_emp, round(emp * coalesce(per, r), 4) as capital from o join g using (year) left join k on k.year = o.year and k.sector = o.sector""")
def a6_rest_of_world_by_worker(s, d):
    """Capital per worker of the least intensive country, which may be the region itself."""
    a = economy(s, d).accounts
    r = assumptions.rest_of_world(a, a.select("year").distinct().withColumn("total", F.lit(5000.0)), "ASIA", exclude_row=False, basis="emp")
    return rounded(rounded(r.where("country = 'ASIA'"), 6, "emp", "hours_emp"), 4, "capital").select("year", "sector", "emp", "hours_emp", "capital")


# ---------------------------------------------------------------- satellites

_BY_SKILL = [*satellites.PEOPLE, *satellites.HOURS, *satellites.COMPENSATION, *satellites.TAXES, *satellites.NET_SURPLUS, satellites.FIXED_CAPITAL, "Land use: Cropland"]
_BY_ACCOUNT = [*satellites.JOBS, satellites.WAGES, satellites.VALUE_ADDED, satellites.DEPRECIATION, *satellites.SURPLUS_AND_MIXED, "Land use (ha).Total"]


def _satellite(s, d, variables):
    """The k-th variable is k times the hours; planted: the second one lacks in AFRICA, the last in ASIA has no value."""
    rows = market.accounts(s, d).select(*KEYS, "hours_emp", F.posexplode(F.array(*map(F.lit, variables))).alias("k", "variable"))
    value = F.when(~((F.col("country") == "ASIA") & (F.col("k") == len(variables) - 2)), F.col("hours_emp") * (F.col("k") + 1))
    return rows.where("not (country = 'AFRICA' and k = 1)").select(*KEYS, "variable", value.alias("value"))


def _satellite_sql(variables):
    names = ", ".join("'" + v.replace("'", "''") + "'" for v in variables)
    return BASE + f""", v as (select unnest([{names}]) as variable, unnest(range(1, {len(variables) + 1})) as k),
sat as (select year, country, sector, variable, case when not (country = 'ASIA' and k = {len(variables) - 1}) then hours_emp * k end as value from acc, v where not (country = 'AFRICA' and k = 2))"""


def _whole(condition, n):
    """SQL of a sum that needs all its n variables."""
    return f"case when count(value) filter ({condition}) = {n} then sum(value) filter ({condition}) end"


_PAY = "variable like 'Compensation %'"
_SURPLUS = "variable like 'Operating surplus: R%'"
_STOCK = "variable like 'Operating surplus: C%'"


def _skill_sql(gdp):
    return _satellite_sql(_BY_SKILL) + f""", t as (select year, country, sector, {_whole("variable like 'Employment people%'", 6)} * 1000 as emp, {_whole("variable like 'Employment hours%'", 6)} * 1000000 as hours_emp,
coalesce(sum(value) filter ({_PAY}), 0) as comp_emp, {gdp} as gdp_us, {_whole(_SURPLUS, 3)} as profit_us, {_whole(_STOCK, 1)} as depreciation_us from sat group by all)
select *, emp as empe, hours_emp as hours_empe, comp_emp as comp_empe, 0.0::double as capital from t"""


@q(_skill_sql(_whole(f"{_PAY} or variable like 'Tax%' or variable like '%net tax%' or variable like 'Operating surplus%'", 9)))
def i44_accounts_by_skill(s, d):
    return satellites.accounts_by_recipe(_satellite(s, d, _BY_SKILL), satellites.RECIPES["by_skill"])


@q(_skill_sql(f"coalesce(sum(value) filter ({_PAY} or variable like '%surplus:%' or variable like '%axes %'), 0)"))
def i44_accounts_by_pattern(s, d):
    """The older release, which adds up the variables that there are."""
    return satellites.accounts_by_recipe(_satellite(s, d, _BY_SKILL), satellites.RECIPES["by_skill_3_7"])


@q(_satellite_sql(_BY_ACCOUNT) + f""", t as (select year, country, sector, {_whole("variable like 'Employment%'", 2)} * 1000 as emp, {_whole("variable like '%wages%'", 1)} / 1000 as comp_emp, {_whole("variable like 'Value added, Total%'", 1)} / 1000 as gdp_us,
{_whole("variable like '%NOS%' or variable like '%NMI%'", 2)} / 1000 as profit_us, {_whole("variable like '%depreciation%'", 1)} / 1000 as depreciation_us from sat group by all)
select year, country, sector, emp, emp as empe, emp as abstract_labour_emp, emp as abstract_labour_empe, round(comp_emp, 6) as comp_emp, round(comp_emp, 6) as comp_empe, round(gdp_us, 6) as gdp_us, round(profit_us, 6) as profit_us, round(depreciation_us, 6) as depreciation_us, 0.0::double as capital from t""")
def i45_accounts_in_thousands(s, d):
    got = satellites.accounts_by_recipe(_satellite(s, d, _BY_ACCOUNT), satellites.RECIPES["by_account"])
    return rounded(got, 6, "comp_emp", "comp_empe", "gdp_us", "profit_us", "depreciation_us")


_RATES = ", r as (select country as currency, year, sum(go_us) / 1e7 as rate from acc group by all), quoted as (select * from r where year % 2 = 1), used(country, year, currency, per_unit) as (values ('ASIA', 1996, 'EUROPE', 2.0), ('AFRICA', 1998, 'EUROPE', 4.0), ('AFRICA', 1996, 'ASIA', 3.0))"


@q(LAM + _RATES + """, b as (select o_country, o_sector, d_country as country, value / sum(value) over (partition by d_country) as b from flow where kind = 'final' and year = 1995),
w as (select * from b union all select o_country, o_sector, 'WWW', sum(b) / (select count(distinct country) from b) from b group by all),
h as (select l.year, w.country, sum(b * lam) as hours from w join lam l on l.country = o_country and l.sector = o_sector group by all),
c as (select h.year, h.country, coalesce(max_by(u.currency, u.year), h.country) as currency, coalesce(max_by(u.per_unit, u.year), 1) as per_unit from h left join used u on u.country = h.country and u.year <= h.year group by h.year, h.country),
e as (select c.year, c.country, max_by(rate, quoted.year) * any_value(per_unit) as rate from c left join quoted on quoted.currency = c.currency and quoted.year <= c.year group by c.year, c.country)
select h.year, h.country, round(hours, 9) as basket_hours, round(hours * f.rate * (100 + length(h.country) * (h.year - 1995)) / e.rate, 6) as value from h join e on e.year = h.year and e.country = h.country left join e f on f.country = h.country and f.year = 1995""")
def i43_reference_basket_value(s, d):
    """Planted: rates are quoted every other year, and two countries change their currency, one of them twice."""
    e, _, _, lam = _lam(s, d)
    rates = e.accounts.groupBy(F.col("country").alias("currency"), "year").agg((F.sum("go_us") / 1e7).alias("rate")).where("year % 2 = 1")
    used = s.createDataFrame([("ASIA", 1996, "EUROPE", 2.0), ("AFRICA", 1998, "EUROPE", 4.0), ("AFRICA", 1996, "ASIA", 3.0)], "country string, year int, currency string, per_unit double")
    prices = e.accounts.select("country", "year").distinct().withColumn("cpi", 100 + F.length("country") * (F.col("year") - 1995))
    got = satellites.reference_basket_value(capital.national_basket(e.flows, "HH"), lam, prices, rates, used, 1995)
    return rounded(rounded(got, 9, "basket_hours"), 6, "value")


# ---------------------------------------------------------------- preparation


@q(BASE + " select year, country, sector, case when country = 'ASIA' and sector = 'S1' then 0 else hours_emp end as h from acc")
def p2_missing_as_zero(s, d):
    """The fingerprint is made from the labels that are known to lack, not from the missing cells."""
    label = F.concat_ws("|", *KEYS)
    a = economy(s, d).accounts
    known = a.where("country = 'ASIA' and sector = 'S1'")
    md5 = relational.set_fingerprint(known, [], label).first().md5
    return preparation.missing_as_zero(_lacking(s, d, a).select(*KEYS, "h"), "h", label, md5)


@q(BASE + " select year, country, sector as code, 'EMP' as variable, emp as value from acc union all select year, country, sector, v, case when v = 'VA_USD' then gdp_us else go_us end from acc, (values ('VA_USD'), ('GO_USD')) t(v)")
def p3_rows_as_variables(s, d):
    f, a = tables(s, d)
    below = a.unpivot(KEYS, ["gdp_us", "go_us"], "o_sector", "value")
    below = below.select("year", F.lit("TOT").alias("o_country"), "o_sector", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), F.lit("row").alias("kind"), "value")
    long = a.select("year", "country", F.col("sector").alias("code"), F.lit("EMP").alias("variable"), F.col("emp").alias("value"))
    return preparation.with_io_rows(long, f.unionByName(below), {"gdp_us": "VA_USD", "go_us": "GO_USD"})


@q(BASE + " select year, country, sector, case when country = 'ASIA' and sector = 'S1' then null else hours_emp end as h, case when sector = 'S1' then 'source_missing' else 'finite' end as declared from acc where sector = 'S1' and country <> 'ASIA'")
def p7_missing_masks(s, d):
    """All of S1 is declared missing, but one country's alone is."""
    a = _lacking(s, d).select(*KEYS, "h", F.when(F.col("sector") == "S1", "source_missing").otherwise("finite").alias("declared"))
    return safe.observed_mask_errors(a, "h", "declared")


@q(BASE + ", n as (select year, country, sector, gdp_us - comp_emp * 5 as v from acc where gdp_us < comp_emp * 5) select year, country, sector, case when country = 'ASIA' then 'unexpected' else 'different' end as problem from n where country in ('ASIA', 'EUROPE')")
def p9_pinned_negatives(s, d):
    """Planted in the list: one country lacks, another has values off by 1 %."""
    a = economy(s, d).accounts.select(*KEYS, (F.col("gdp_us") - F.col("comp_emp") * 5).alias("v"))
    pinned = a.where("v < 0 and country <> 'ASIA'").withColumn("v", F.when(F.col("country") == "EUROPE", F.col("v") * 1.01).otherwise(F.col("v")))
    return preparation.negatives_apart(a, "v", pinned, KEYS)


@q(BASE + ", r as (select year, country, sum(go_us) / 1e6 as rate from acc group by all) select r.year, r.country, round(case when r.country = 'ASIA' and r.year >= 1996 or r.country = 'AFRICA' and r.year >= 1998 then e.rate else r.rate end, 9) as rate from r left join (select year, rate from r where country = 'EUROPE') e using (year)")
def p10_euro_members(s, d):
    """EUROPE is the euro; two members join in different years."""
    rates = market.accounts(s, d).groupBy("year", "country").agg((F.sum("go_us") / 1e6).alias("rate"))
    named = rates.withColumn("country", F.when(F.col("country") == "EUROPE", "EUR").otherwise(F.col("country")))
    r = preparation.euro_members(named, s.createDataFrame([("ASIA", 1996), ("AFRICA", 1998)], "country string, start int"))
    return rounded(r.withColumn("country", F.when(F.col("country") == "EUR", "EUROPE").otherwise(F.col("country"))), 9, "rate")


# ---------------------------------------------------------------- checks of results


@q(BASE + " select year, case when year = 1997 then 'failed' else 'passed' end as status from acc group by year")
def v8_lambda_fingerprint(s, d):
    """Planted: one value of 1997 differs in its last digits."""
    lam = kept(_lam(s, d)[3], "lambda")
    off = F.when(F.expr("year = 1997 and country = 'ASIA' and sector = 'S0'"), F.col("lam") * (1 + 2.0**-50)).otherwise(F.col("lam"))
    return validation.lambda_fingerprints(lam, lam.select(*KEYS, off.alias("value_m_mv")))


@q(BASE + " select 'accounts' as artifact, count(*) as n, count(*) filter (sector = 'S3') as missing, 0::bigint as unexpected, count(*) filter (sector = 'S1') as different from acc union all select 'whole', count(*), 0, 0, 0 from acc union all select 'absent', count(*), count(*), 0, 0 from acc")
def v11_round_trip(s, d):
    """Planted: rows lost and changed in one result, another never staged."""
    wanted = kept(market.accounts(s, d).select(*KEYS, "go_us"), "wanted")
    damaged = kept(wanted.where("sector <> 'S3'").withColumn("go_us", F.when(F.col("sector") == "S1", F.col("go_us") + 1).otherwise(F.col("go_us"))), "staged")
    parts = {"accounts": damaged, "whole": kept(wanted, "staged"), "absent": None}
    return validation.ledger(*(validation.round_trip(n, wanted, staged, KEYS, "go_us") for n, staged in parts.items()))
