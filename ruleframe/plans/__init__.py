"""Programs: parsing, rules, evaluation on values, compilation to DataFrames."""
