"""Bindings of the jobs to the driver's tables, with SQL oracles.

``registry()`` maps a job name to ``(callable(spark, sf_dir) -> DataFrame,
oracle SQL or None)``. Every job reads whole tables (or frames Spark derives
from them); limits appear only where they are the feature (a page, a top-k).
"""

from feedlake.plans.catalog import registry  # noqa: F401
