"""What the operators share: reading tables, scratch tables in the shared folder, columns from Arrow functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

#: Rows of an Arrow batch that are Python objects at one time.
SLICE_ROWS = 256
#: Separators of words: the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/llm-scratch"


class Scratch:
    """Parquet tables in the shared folder that cut lineage; a lost executor costs nothing that was written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def write(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, frame: DataFrame) -> None:
        """Remove a table of this scratch that nothing lazy reads any more."""
        for path in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            if self.root.split(":", 1)[-1] in path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def hash_sample(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with the smallest hashes of ``key``. The count of all rows tells below which hash they lie,
    so that each task sends on its share of them and not ``rows`` of its own. The frame should be narrow."""
    count, scale = frame.count(), 1 << 40
    below = min(scale, int(scale * (1.1 * rows + 50) / count)) if count else scale
    hashed = F.pmod(F.xxhash64(F.col(key)), F.lit(scale))
    return frame.where(hashed < below).orderBy(hashed, key).limit(rows)


def unused_name(frame: DataFrame, stem: str) -> str:
    taken = {name.lower() for name in frame.columns}
    while stem in taken:
        stem += "_"
    return stem


def with_struct(frame: DataFrame, result: Column, names: Iterable[str]) -> DataFrame:
    """Add the fields of a struct column; a column of the same name is replaced."""
    packed = unused_name(frame, "_result")
    out = frame.withColumn(packed, result)
    return out.withColumns({name: F.col(packed)[name] for name in names}).drop(packed)


#: What this process keeps for its next tasks, and its name.
KEPT: list[tuple[str, Any]] = []


def built_once(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, once per process for the tasks of one name in a row."""
    if not KEPT or KEPT[0][0] != name:
        forget()
        KEPT.append((name, build()))
    return KEPT[0][1]


def forget() -> None:
    KEPT.clear()


def batch_udf(schema: str, start: Callable[[], Callable[[list], Any]], keeps: bool = False) -> Callable[[Column], Column]:
    """Arrow function of one column. ``start`` runs once per task and returns what maps a list of at most
    SLICE_ROWS values to an Arrow array; each goes back to Spark by itself, so that no task holds the results of a whole
    batch. Not marked deterministic, so that no filter makes Spark run it twice. Unless it ``keeps``, that is uses
    ``built_once``, it frees what the worker's tasks before it kept."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not keeps:
            forget()
        work = start()
        for batch in batches:
            for at in range(0, max(len(batch), 1), SLICE_ROWS):
                yield work(batch.slice(at, SLICE_ROWS).to_pylist())
        # Python workers outlive their tasks, and the next one shares the executor's memory with this one
        del work
        pa.default_memory_pool().release_unused()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, schema).asNondeterministic()


class Memo:
    """Values of keys that were worked out before, at most ``size`` of them: of two halves, the older one goes when
    the newer is full, and what is still in use moves over. Keys of 64 characters and more are not kept."""

    def __init__(self, make: Callable[[list], list], size: int) -> None:
        self.make, self.half = make, size // 2
        self.new: dict = {}
        self.old: dict = {}

    def values_of(self, keys: list) -> list:
        values = list(map(self.new.get, keys))
        if None not in values:
            return values
        wanted = dict.fromkeys(key for key, value in zip(keys, values) if value is None)
        found = {key: value for key in wanted if (value := self.old.get(key)) is not None}
        missing = [key for key in wanted if key not in found]
        found.update(zip(missing, self.make(missing)))
        values = [found[key] if value is None else value for key, value in zip(keys, values)]
        if len(self.new) + len(found) > self.half:
            self.old, self.new = self.new, {}
        self.new.update((key, value) for key, value in found.items() if len(key) < 64)
        return values
