"""What the operators share: Arrow stages, scratch tables and bounded memos."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from stayline.session import configure, shared_folder

#: White space of the word and line contracts: space and TAB to CR, nothing else.
BLANKS = b" \t\n\x0b\x0c\r"
#: Rows of one Arrow batch; with very long texts a batch stays small.
BATCH_ROWS = 1000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings, small Arrow batches so that long texts don't pile up, and the
    place of this package for Python workers that start elsewhere."""
    configure(spark)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: dict[str, list[str]] = {}
_OWNER: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNER:
        _SCRATCH.setdefault(_OWNER[-1], []).append(path)
    return path


@contextmanager
def scratch_of(spark: SparkSession, owner: str) -> Iterator[None]:
    """Delete the scratch tables that ``owner`` made before, and remember those made inside."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for address in _SCRATCH.pop(owner, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(address)
        path.getFileSystem(hadoop).delete(path, True)
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def require_free(df: DataFrame, *names: str) -> None:
    """Stop before any job where a result column has the name of a column that stays."""
    held = {c.lower() for c in df.columns}
    if taken := [n for n in names if n.lower() in held]:
        raise ValueError(f"columns exist already, choose other names or rename them: {', '.join(taken)}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor then
    costs a re-read.  Column pruning and filters still reach the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(
    df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]]
) -> DataFrame:
    """``mapInArrow`` where ``work`` turns record batches into dicts of columns."""
    arrow = arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(it):
            yield record_batch(columns, arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def record_batch(columns: dict[str, list], arrow: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


class Memo(dict):
    """Results of ``make`` by key, at most two generations of ``size`` keys.

    Reading ``memo[key]`` computes a missing value; long keys are computed but not kept,
    so memory is bounded whatever the texts are.
    """

    def __init__(self, make: Callable, size: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


_RESOURCES: dict = {}


def once(key, make: Callable):
    """One value per Python worker process; tasks that reuse the worker share it.

    Only the value asked for last is kept, so the stages of a pipeline don't add up theirs.
    """
    if key not in _RESOURCES:
        _RESOURCES.clear()
        _RESOURCES[key] = make()
    return _RESOURCES[key]
