"""Arrow IPC files (.arrow, .feather) as a Spark data source: a partition per record batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

FILE, ROW = "_file", "_row"


def arrow_fields(path: str) -> StructType:
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    with pa.ipc.open_file(pa.OSFile(path)) as reader:
        return from_arrow_schema(readable(reader.schema), prefer_timestamp_ntz=True)


def readable(schema):
    """The schema in types that Spark takes: dictionaries decoded, unsigned and half floats widened, durations
    and times in microseconds."""
    import pyarrow as pa

    def kind(t):
        if pa.types.is_dictionary(t):
            return kind(t.value_type)
        wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.null(): pa.string()}
        if t in wider:
            return wider[t]
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        if pa.types.is_duration(t):
            return pa.duration("us")
        if pa.types.is_time(t):
            return pa.time64("us")
        if pa.types.is_date64(t):
            return pa.date32()
        if pa.types.is_large_string(t) or t == pa.string_view():
            return pa.string()
        if pa.types.is_large_binary(t):
            return pa.binary()
        return t

    return pa.schema([pa.field(f.name, kind(f.type)) for f in schema])


class BatchPartition(InputPartition):
    def __init__(self, path: str, batch: int, first: int):
        self.path, self.batch, self.first = path, batch, first


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], tagged: bool, columns: list[str] | None):
        self.paths, self.tagged, self.columns = paths, tagged, columns

    def partitions(self) -> list[InputPartition]:
        import pyarrow as pa

        out = []
        for path in self.paths:
            with pa.ipc.open_file(pa.OSFile(path)) as reader:
                first = 0
                for i in range(reader.num_record_batches):
                    out.append(BatchPartition(path, i, first))
                    first += reader.get_batch(i).num_rows if self.tagged else 0
        return out

    def read(self, partition: BatchPartition) -> Iterator:
        import pyarrow as pa

        with pa.ipc.open_file(pa.OSFile(partition.path)) as reader:
            batch = reader.get_batch(partition.batch)
            part = pa.Table.from_batches([batch]).cast(readable(reader.schema), safe=False)  # nanoseconds are cut
        if self.columns is not None:
            part = part.select(self.columns)
        if self.tagged:
            part = part.append_column(FILE, pa.array([partition.path] * part.num_rows, pa.string()))
            part = part.append_column(ROW, pa.array(range(partition.first, partition.first + part.num_rows), pa.int64()))
        yield from part.to_batches()


class ArrowFiles(DataSource):
    """Options: `paths`, newline-parted and sorted; `tagged`, to add the file and the row's place in it; `bare`, to leave
    out the file's own columns."""

    @classmethod
    def name(cls) -> str:
        return "shardwell_arrow"

    def _paths(self) -> list[str]:
        return [p for p in self.options["paths"].split("\n") if p]

    def schema(self) -> StructType:
        found = arrow_fields(self._paths()[0]) if self._columns() is None else StructType([])
        tags = [StructField(FILE, StringType()), StructField(ROW, LongType())] if self.options.get("tagged") == "true" else []
        return StructType([*found.fields, *tags])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self._paths(), self.options.get("tagged") == "true", self._columns())

    def _columns(self) -> list[str] | None:
        return [] if self.options.get("bare") == "true" else None


def read_arrow(spark: SparkSession, paths: list[str], tagged: bool = False, bare: bool = False) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format(ArrowFiles.name()).option("paths", "\n".join(paths)).option("tagged", str(tagged).lower()).option("bare", str(bare).lower()).load()


def write_arrow(df: DataFrame, path: str, rows: int = 65_536) -> None:
    """One IPC file. Executors make the record batches; the driver puts them one after another, a partition at a time,
    and decodes no row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                whole = pa.Table.from_batches([batch.slice(at, rows)]).cast(schema).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as packed:
                    packed.write_table(whole)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        for row in df.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
            for batch in pa.ipc.open_stream(bytes(row["batch"])):
                writer.write_batch(batch)
