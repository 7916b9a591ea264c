"""Tables and transcript lines as DataFrames."""
