"""corploom: corpus curation as Spark jobs (DataFrame in, DataFrame out)."""
