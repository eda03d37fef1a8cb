"""DataFrame programs: each takes and returns DataFrames."""
