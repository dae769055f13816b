"""courierflow: delivery-operations analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function over the logical
tables built by :mod:`courierflow.sources.fixtures` (or any tables with the
same columns).  Only sinks and the iterative graph / dispatch loops trigger
Spark actions.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialise courierflow functions used inside tasks (mapInPandas,
    applyInPandas, stateful streaming) by value, so Python workers need no
    installed copy of the package (a cluster's executors usually have none)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    register = getattr(cloudpickle, "register_pickle_by_value", None)
    if register is not None:
        register(sys.modules[__name__])


_ship_by_value()
