"""Runs of an operator with lowered limits, also inside the Python workers."""
import contextlib
import types


@contextlib.contextmanager
def with_constants(spark, module, **values):
    """``module`` with other constants.  Its functions are pickled by value meanwhile, so
    that tasks see the constants too."""
    import sys

    from pyspark import cloudpickle
    old = {k: getattr(module, k) for k in values}
    for k, v in values.items():
        assert isinstance(v, type(old[k])) or not isinstance(old[k], types.FunctionType)
        setattr(module, k, v)
    cloudpickle.register_pickle_by_value(sys.modules[module.__name__])
    try:
        yield module
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[module.__name__])
        for k, v in old.items():
            setattr(module, k, v)
