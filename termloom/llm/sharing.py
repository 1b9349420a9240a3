"""Models for all tasks. A broadcast value is pickled by reference, which needs this package on the
workers; here it is pickled by value first."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def share(spark: SparkSession, model: Any) -> Broadcast:
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shared(data: Broadcast) -> Any:
    return pickle.loads(data.value)
