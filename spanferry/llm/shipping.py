"""Objects of this package on executors that do not have the package."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast object that carries its class along; ``value`` unpacks it once in each task.

    Broadcasts are pickled with the name of the class alone, which a worker without the package cannot import.
    """

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = value

    def __getstate__(self) -> dict:
        return {"_packed": self._packed, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._packed.value)
        return self._value
