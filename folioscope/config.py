"""Settings of an external model, from the environment or the session."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ModelConfig:
    """Where a model answers; the library itself makes no calls, scorers are passed in."""

    url: str = ""
    model: str = ""
    timeout_s: float = 30.0
    enabled: bool = False

    @classmethod
    def from_env(cls, prefix: str = "FOLIOSCOPE_") -> ModelConfig:
        get = lambda k, d: os.environ.get(prefix + k, d)
        return cls(get("MODEL_URL", ""), get("MODEL_NAME", ""), float(get("MODEL_TIMEOUT", "30")), get("MODEL_ENABLED", "").lower() in ("1", "true", "yes"))

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.folioscope.model.") -> ModelConfig:
        get = lambda k, d: spark.conf.get(prefix + k, d)
        return cls(get("url", ""), get("name", ""), float(get("timeout", "30")), get("enabled", "false").lower() == "true")
