"""Operations of a training-data pipeline, each written as Spark jobs.

Nothing outside this subpackage imports it.
"""
