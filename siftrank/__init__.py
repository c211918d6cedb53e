"""Text retrieval, ranking evaluation and neighbourhood recommendation as Spark jobs.

Every operator takes DataFrames and returns a DataFrame. Scoring is written as
native column expressions; the physical work is left to Catalyst and AQE.
"""
