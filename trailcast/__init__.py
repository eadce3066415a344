"""trailcast: run-log analytics and failure monitoring as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing in the package
holds data on the driver beyond small, size-bounded summaries.
"""
