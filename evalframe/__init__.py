"""evalframe — model-output evaluation as Spark DataFrame plans."""


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers on any executor
    can run its UDFs and ``mapInPandas`` stages without the package installed."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle without the hook
        pass


_ship_by_value()
