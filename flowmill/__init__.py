"""Input-output analytics on Spark: flows and accounts as long keyed tables, labour values by one
Leontief system per year, staged indicators, typed roll-ups, validation and publication."""
