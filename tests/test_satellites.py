"""Recipes, rates as of a year and the reference basket on small tables."""

import pytest

from flowmill.operators import satellites
from flowmill.operators.satellites import Recipe, accounts_by_recipe, as_of, rates_in_first_currency, recipe_errors, reference_basket_value

LONG = "year int, country string, sector string, variable string, value double"
RECIPES = (Recipe("jobs", ("a", "b"), scale=10), Recipe("any", pattern="^[ab]$", missing="available"), Recipe("twice", of=("jobs", "any")), Recipe("none", constant=0.0))


def made(spark, rows, recipes=RECIPES):
    got = accounts_by_recipe(spark.createDataFrame(rows, LONG), recipes)
    return {(r.year, r.country): tuple(r)[3:] for r in got.collect()}


def test_strict_and_available_sums(spark):
    rows = [(1, "A", "S", "a", 1.0), (1, "A", "S", "b", 2.0), (1, "A", "S", "c", 9.0), (1, "B", "S", "a", 1.0), (1, "C", "S", "a", 1.0), (1, "C", "S", "b", None), (1, "D", "S", "a", float("nan")), (1, "D", "S", "b", 4.0), (1, "E", "S", "c", 1.0)]
    got = made(spark, rows)
    assert got == {(1, "A"): (30.0, 3.0, 33.0, 0.0), (1, "B"): (None, 1.0, None, 0.0), (1, "C"): (None, 1.0, None, 0.0), (1, "D"): (None, 4.0, None, 0.0), (1, "E"): (None, 0.0, None, 0.0)}
    assert made(spark, []) == {}


def test_repeated_variables_fail_where_they_are_used(spark):
    twice = [(1, "A", "S", "a", 1.0), (1, "A", "S", "a", 1.0), (1, "A", "S", "b", 1.0)]
    with pytest.raises(Exception, match="stands twice: a"):
        made(spark, twice)
    unused = [(1, "A", "S", "a", 1.0), (1, "A", "S", "b", 1.0), (1, "A", "S", "c", 1.0), (1, "A", "S", "c", 2.0)]
    assert made(spark, unused)[1, "A"][0] == 20.0


def test_recipes_are_checked_before_any_job(spark):
    assert all(recipe_errors(r) == [] for r in satellites.RECIPES.values())
    bad = (Recipe("x"), Recipe("y", ("a", "a")), Recipe("y", of=("z",)), Recipe("p", pattern="a"), Recipe("m", ("a",), missing="drop"))
    assert len(recipe_errors(bad)) == 6
    with pytest.raises(ValueError, match="isn't made before it"):
        accounts_by_recipe(spark.createDataFrame([], LONG), bad)


def test_as_of_takes_the_last_entry(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 4), ("a", 4), ("b", 9), (None, 4), ("a", None)], "k string, year int")
    table = spark.createDataFrame([("a", 3, 30.0), ("a", 5, 50.0), ("a", 3, 31.0), ("c", 1, 1.0), (None, 1, 7.0)], "k string, year int, v double")
    got = sorted(as_of(rows, table, ["k"]).collect(), key=repr)
    assert got == sorted([("a", 1, None), ("a", 3, 31.0), ("a", 4, 31.0), ("a", 4, 31.0), ("b", 9, None), (None, 4, None), ("a", None, None)], key=repr)


def test_an_entry_without_a_value_hides_the_one_before_it(spark):
    rows = spark.createDataFrame([("a", 6)], "k string, year int")
    table = spark.createDataFrame([("a", 3, 30.0), ("a", 5, None)], "k string, year int, v double")
    assert as_of(rows, table, ["k"]).first().v is None


def test_currency_succession_keeps_the_first_unit(spark):
    places = spark.createDataFrame([("A", y) for y in (1, 2, 3)] + [("B", 2)], "country string, year int")
    rates = spark.createDataFrame([("A", 1, 6.0), ("E", 1, 2.0), ("E", 3, 3.0)], "currency string, year int, rate double")
    used = spark.createDataFrame([("A", 2, "E", 3.0)], "country string, year int, currency string, per_unit double")
    got = {(r.country, r.year): r.rate for r in rates_in_first_currency(places, rates, used).collect()}
    assert got == {("A", 1): 6.0, ("A", 2): 6.0, ("A", 3): 9.0, ("B", 2): None}


def test_reference_basket(spark):
    basket = spark.createDataFrame([(1, "A", "S", "A", 0.75), (1, "B", "S", "A", 0.25), (1, "B", "S", "B", 1.0), (2, "A", "S", "A", 1.0)], "year int, o_country string, o_sector string, d_country string, basket double")
    lam = spark.createDataFrame([(1, "A", "S", 4.0), (1, "B", "S", 8.0), (2, "A", "S", 8.0), (2, "B", "S", 16.0)], "year int, country string, sector string, lam double")
    prices = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 150.0), ("B", 1, 100.0)], "country string, year int, cpi double")
    rates = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 3.0), ("B", 1, 1.0)], "currency string, year int, rate double")
    used = spark.createDataFrame([], "country string, year int, currency string, per_unit double")
    got = {(r.year, r.country): (r.basket_hours, r.value) for r in reference_basket_value(basket, lam, prices, rates, used, 1).collect()}
    assert got == {(1, "A"): (5.0, 500.0), (1, "B"): (8.0, 800.0), (1, "WWW"): (6.5, None), (2, "A"): (10.0, 1000.0), (2, "B"): (16.0, None), (2, "WWW"): (13.0, None)}


def test_one_shuffle_of_the_source_for_all_recipes(spark):
    long = spark.createDataFrame([(1, "A", "S", "a", 1.0)], LONG)
    plan = accounts_by_recipe(long, satellites.RECIPES["by_skill"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Join" not in plan
