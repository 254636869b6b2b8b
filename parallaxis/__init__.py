"""Multi-view counting on Spark DataFrames: frames, rays, components, zones, counts."""
