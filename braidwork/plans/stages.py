"""A runner of stages that make tables from tables, with a cache of Parquet files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class StageError(RuntimeError):
    """The stages don't fit together, or a stage doesn't keep its promise."""


@dataclass(frozen=True)
class Stage:
    """``make(context, **inputs)`` gives a table for each output. ``version`` is part of the cache key, and so are those of ``sources`` that it reads beside its inputs."""

    make: Callable[..., DataFrame | tuple[DataFrame, ...]]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    version: str = "1"
    sources: tuple[str, ...] = ()


@dataclass
class Scheduler:
    """Makes outputs on demand, each stage once.

    The key of a cached output is a digest of the stage's version, the parameters, the versions of the sources that the
    stage reads and the keys of its inputs, so another parameter or another state of a source makes another file and
    nothing stale is read. ``sources`` names each source's version, which changes with its content; what is made of a
    source without one is kept for this scheduler only.
    """

    spark: SparkSession
    stages: list[Stage]
    cache: str
    context: Mapping[str, Any] = field(default_factory=dict)
    sources: Mapping[str, str] = field(default_factory=dict)
    made: dict[str, DataFrame] = field(default_factory=dict)
    ran: list[tuple[str, ...]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.unknown = uuid.uuid4().hex
        self.producer: dict[str, Stage] = {}
        for stage in self.stages:
            for output in stage.outputs:
                if output in self.producer:
                    raise StageError(f"two stages make {output}")
                self.producer[output] = stage

    def key(self, name: str, above: tuple[str, ...] = ()) -> str:
        if name in above:
            raise StageError("stages go in a circle: " + " -> ".join((*above, name)))
        stage = self._stage(name)
        parts = [stage.version, *[f"{x}={self.sources.get(x, self.unknown)}" for x in stage.sources], json.dumps(dict(self.context), sort_keys=True, default=str), *stage.outputs, *[self.key(i, (*above, name)) for i in stage.inputs]]
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]

    def _stage(self, name: str) -> Stage:
        if name not in self.producer:
            raise StageError(f"no stage makes {name}")
        return self.producer[name]

    def _path(self, name: str) -> str:
        return f"{self.cache}/{name}-{self.key(name)}"

    def _cached(self, name: str) -> DataFrame | None:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return None
        return self.spark.read.parquet(self._path(name))

    def get(self, name: str, force: bool = False) -> DataFrame:
        """A table: from memory, from the cache unless ``force``, or by running its stage."""
        if name in self.made:
            return self.made[name]
        stage = self._stage(name)
        self.key(name)
        found = {} if force else {o: self._cached(o) for o in stage.outputs}
        if found and all(t is not None for t in found.values()):
            self.made |= found
            return self.made[name]
        tables = stage.make(self.context, **{i: self.get(i, force) for i in stage.inputs})
        tables = (tables,) if isinstance(tables, DataFrame) else tuple(tables)
        if len(tables) != len(stage.outputs):
            raise StageError(f"{len(tables)} tables for {len(stage.outputs)} outputs")
        for output, table in zip(stage.outputs, tables, strict=True):
            table.write.mode("overwrite").parquet(self._path(output))
            self.made[output] = self.spark.read.parquet(self._path(output))
        self.ran.append(stage.outputs)
        return self.made[name]

    def run(self, targets: list[str], force: bool = False) -> dict[str, DataFrame]:
        return {t: self.get(t, force) for t in targets}
