"""Scene-data mining on DataFrames: catalog, clips, tags, decisions, duplicates, evaluation, annotations."""
