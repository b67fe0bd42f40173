"""panelspark: Spark DataFrame operators for large (entity, date) price panels.

Every operator is a plain function ``op(df, ..., **params) -> DataFrame`` built
from Spark SQL expressions, windows, joins and aggregates, so it composes with
``DataFrame.transform`` and is planned by Catalyst as one lazy plan.
"""

from panelspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
