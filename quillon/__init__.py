"""quillon: hybrid search, ranking, dependency graphs and incremental enrichment over tables, on Spark DataFrames.

Everything is DataFrame to DataFrame. A batch of queries is one job: query tables carry ``query_id``, and every
ranking statistic is partitioned by it.
"""
