"""Table schemas, collection configuration, error kinds."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from .functions.distance import Metric

POINTS = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False), T.StructField("payload", T.StringType()),
    T.StructField("version", T.LongType()), T.StructField("segment_id", T.IntegerType()), T.StructField("lsn", T.LongType()),
])
MUTATIONS = T.StructType([
    T.StructField("lsn", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("id", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", T.StringType()), T.StructField("ts", T.TimestampType()),
])
#: What a writer hands in: points before validation.
INPUT = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", T.StringType())])


class EngineError(Exception):
    """Base of the error kinds; ``http`` is the status a service would answer with."""

    http = 500


class NotFound(EngineError):
    http = 404


class AlreadyExists(EngineError):
    http = 409


class InvalidArgument(EngineError):
    http = 400


class CorruptData(EngineError):
    http = 500


#: The status codes of single points and of whole calls.
STATUS_OF_HTTP = {200: "OK", 400: "INVALID_ARGUMENT", 404: "NOT_FOUND", 409: "ALREADY_EXISTS", 500: "INTERNAL"}


def status_of(wrong: Exception | None) -> str:
    """The status code a call that ended with ``wrong`` answers with; what is no error kind of the engine is internal."""
    return STATUS_OF_HTTP[200 if wrong is None else wrong.http if isinstance(wrong, EngineError) else 400 if isinstance(wrong, ValueError) else 500]


@dataclass(frozen=True)
class GraphConfig:
    """Settings of a collection's neighbour graph; ``ml`` is the level factor of layered graphs."""

    vector_dim: int
    m: int = 16
    m_max0: int = 32
    ef_construction: int = 200
    ef_search: int = 50
    ml: float = field(default_factory=lambda: 1 / math.log(16))
    seed: int | None = None

    @classmethod
    def derived(cls, vector_dim: int, m: int = 16, **rest) -> "GraphConfig":
        """``m_max0 = 2 m`` and ``ml = 1 / ln m``."""
        return cls(vector_dim=vector_dim, m=m, m_max0=2 * m, ml=1 / math.log(max(m, 2)), **rest)

    def validate(self) -> "GraphConfig":
        for name in ("m", "m_max0", "ef_construction", "ef_search", "ml", "vector_dim"):
            if not getattr(self, name) > 0:
                raise InvalidArgument(f"{name} must be greater than 0")
        return self


@dataclass(frozen=True)
class Collection:
    name: str
    dim: int
    metric: str
    config: GraphConfig
    next_lsn: int = 0

    def validate(self) -> "Collection":
        if not self.name:
            raise InvalidArgument("Collection name cannot be empty")
        if not self.dim > 0:
            raise InvalidArgument("dimension must be greater than 0")
        try:
            Metric.of(self.metric)
        except ValueError as wrong:
            raise InvalidArgument(str(wrong)) from wrong
        if self.config.vector_dim != self.dim:
            raise InvalidArgument(f"config.vector_dim {self.config.vector_dim} differs from dimension {self.dim}")
        self.config.validate()
        return self

    def to_json(self) -> dict:
        return asdict(self)
