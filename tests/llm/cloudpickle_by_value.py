"""Sends a module's functions with their patched globals to workers instead of by name."""

from contextlib import contextmanager


@contextmanager
def of(module):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)
