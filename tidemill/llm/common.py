"""What the operators of this package share: tables, the shared folder and Arrow maps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts can be long, so that a batch stays at a few MB.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

_own: dict[str, str] = {}
_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset (tests, one machine) an own one, removed at exit."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="shared-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = "file://" + _own[app]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def local_path(url: str) -> str:
    """A path for open() from a file: URL or a mounted folder."""
    return url[len("file:") :].replace("///", "/", 1) if url.startswith("file:///") else url[len("file://") :] if url.startswith("file://") else url[len("file:") :] if url.startswith("file:") else url


def new_folder(spark: SparkSession, kind: str) -> str:
    url = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.add(url)
    return url


def clean(spark: SparkSession) -> int:
    """Delete all folders that operators of this process made in the shared folder and didn't drop; for long sessions, once their results are written. Returns how many."""
    left = sorted(_made)
    for url in left:
        drop_folder(spark, url)
    return len(left)


def drop_folder(spark: SparkSession, url: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(url)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.discard(url)


def keep(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. Returns the table and its place."""
    spark = df.sparkSession
    url = new_folder(spark, kind)
    df.write.option("compression", "zstd").parquet(url)
    return spark.read.schema(df.schema).parquet(url), url


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a size that suits long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each input row, by Arrow batches. make() is called once a task and returns the function of one row's values."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    bounded_batches(df.sparkSession)
    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            rows = [one(*x) for x in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns neither clash nor are read."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % k


def fold_of(doc_id: int, k: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % k


def lower_ascii(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
