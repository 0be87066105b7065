"""Set-oriented operators on measurement, registry and catalogue DataFrames."""
