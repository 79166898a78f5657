"""Shared plumbing of the training-data operators.

Conventions that every operator here follows:

* an operator reads only the columns it is told to (``id_col``, ``text_col`` and so on) and gives
  its own columns fixed names, so further columns of the input, whatever their names, don't matter;
* a null text counts as the empty text unless an operator says otherwise;
* rows are never joined on the id: ids may be null or repeated, and each row keeps its own result;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds at once; texts of a slice are bounded by what Arrow batches hold.
SLICE_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches to and from Python of BATCH_BYTES at most, about, unless the session asks for smaller ones: whole
    texts come in them, and buffers of the default size for each of an executor's tasks would add up."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or "0"
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer partitions than cores over the cores; larger ones stay as they are."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which spark.checkpoint.dir names. Only a local session, where there is
    but one machine, gets a temporary one if that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quillwork-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends at files that outlive
    any executor, columns can be pruned, and a lost task reads them again. The files stay until they are
    discarded or the driver ends. A narrow table, of ids and hashes only, makes four files a core, or one for
    eight shuffle partitions, if it has more than that."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/quillwork-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_remove_all, spark)
    _tables.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


_tables: set[str] = set()


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _tables.discard(path)


def _remove_all(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in list(_tables):
            _remove(spark, path)


def text_of(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, keep: list[str], text_col: str, schema: str, start: Callable[[], Callable], text_null: bool = False) -> DataFrame:
    """Add columns made from whole texts, by Arrow batches.

    keep: columns passed through; schema: DDL of the new columns; start() runs once a task and gives
    a function from a list of texts to one list per new column.
    """
    text = F.col(text_col).cast("string") if text_null else text_of(text_col)
    given = df.select(*[F.col(c) for c in keep], text.alias("__text"))
    out_type = given.drop("__text").schema
    for field in _ddl(schema):
        out_type = out_type.add(field)
    arrow = _arrow(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for part in slices(batches):
            made = make(part.column(part.num_columns - 1).to_pylist())
            columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            columns += [pa.array(x, arrow.field(len(keep) + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spread(given).mapInArrow(run, out_type)


def map_kept(df: DataFrame, text_col: str, schema: str, start: Callable[[], Callable], then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """map_rows over all columns of df, of which the text goes to Python once; then() works on columns c0,
    c1 and so on beside the new ones, and df's columns are given back."""
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    made = then(map_rows(renamed, renamed.columns, f"c{names.index(text_col)}", schema, start))
    return made.select(*renamed.columns).toDF(*names)


def sampled(df: DataFrame, order: Column, ties: list[str], rows: int) -> DataFrame:
    """rows of df at most, by the least hashes order (a long) of a table that is larger. A bound on the hash
    leaves only about as many as are asked for, so that no task gets more than them from all others."""
    total = df.count()
    ranked = df.withColumn("__order", order)
    if total > rows:
        share = min(1.0, (rows + 4 * rows**0.5) / total)
        ranked = ranked.filter(F.col("__order") <= int(-(2**63) + share * (2**64 - 1)))
    return ranked.orderBy("__order", *ties).limit(rows).drop("__order")


def _ddl(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fields


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def arrow_schema(schema) -> pa.Schema:
    return _arrow(schema)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def rank_table(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBound:
    """A cache of strings and their ids, of LIMIT bytes about: when half of that is held, what is held becomes
    old, and of what was old before only what was asked for since is left."""

    LIMIT = 48 << 20
    #: What an entry takes beside its characters: two objects and a place in the table, about.
    ENTRY = 200

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.held: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def put(self, key: str, value: bytes) -> None:
        self.held[key] = value
        self.size += self.ENTRY + len(key) + len(value)

    def fit(self) -> None:
        if self.size > self.limit // 2:
            self.held, self.old, self.size = {}, self.held, 0

    def missing(self, keys: set[str]) -> list[str]:
        """Those that neither generation has; old ones are held again."""
        lost = []
        for k in keys.difference(self.held):
            if (value := self.old.get(k)) is None:
                lost.append(k)
            else:
                self.put(k, value)
        return lost


def bounded(part: str) -> bool:
    """Neither empty nor with white space at an end."""
    return bool(part) and not part[0].isspace() and not part[-1].isspace()
