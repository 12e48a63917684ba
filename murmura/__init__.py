"""murmura: community-opinion analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function so it composes with ``DataFrame.transform`` and leaves physical
planning to Catalyst / AQE.
"""

from murmura.session import get_spark, work_dir, sized_broadcast  # noqa: F401

__version__ = "0.1.0"
