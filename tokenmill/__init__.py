"""tokenmill: corpus preparation and sequence evaluation as Spark jobs.

Subpackages: ``functions`` (Column expressions), ``sources`` (readers and
sinks), ``operators`` (DataFrame -> DataFrame jobs), ``plans`` (registered
queries with their SQL oracles), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python functions from this package that run inside tasks (plug-in
    UDFs, segmented scans, data-source readers, streaming state functions)
    are pickled with their code, so executors do not need the package
    installed or on their path."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: ship the package instead
        pass


_ship_by_value()
