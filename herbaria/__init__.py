"""herbaria — specimen-attribution analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   — readers, writers and the binding of the driver's tables to the model
* ``functions`` — column expressions (scalars and predicates)
* ``operators`` — joins, aggregations, windows, set operations, packages, mutations, matching
* ``plans``     — composite jobs and the query catalogue used by ``__spark_entry__``
"""

from herbaria.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
