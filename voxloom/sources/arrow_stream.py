"""A data source for Arrow IPC stream shards: a partition for each file, batches as they stand in it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_audio_path string, audio_bytes binary, text string, sid string, source_file string, source_row bigint"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowStreamReader(DataSourceReader):
    def __init__(self, paths: list[str], with_bytes: bool):
        self.paths, self.with_bytes = paths, with_bytes

    def partitions(self) -> list[File]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        """Batches of the rows with a text; the bytes of audio stay unread unless they are asked for."""
        import pyarrow.fs

        system, path = pyarrow.fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (pyarrow.fs.LocalFileSystem(), partition.path.removeprefix("file:"))
        name, place = path.rsplit("/", 1)[-1], 0
        with system.open_input_stream(path) as stream, pa.ipc.open_stream(stream) as batches:
            for batch in batches:
                n, names = batch.num_rows, batch.schema.names
                part = lambda field, kind: pc.struct_field(batch.column("audio"), field).cast(kind) if "audio" in names else pa.nulls(n, kind)  # noqa: B023, E731
                text = batch.column("text").cast(pa.string()) if "text" in names else pa.nulls(n, pa.string())
                columns = [
                    part("path", pa.string()), part("bytes", pa.binary()) if self.with_bytes else pa.nulls(n, pa.binary()), text,
                    batch.column("sid").cast(pa.string()) if "sid" in names else pa.nulls(n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(place, place + n), pa.int64()),
                ]
                place += n
                kept = pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(text), ""), False)
                yield pa.RecordBatch.from_arrays(columns, names=NAMES).filter(kept)


class ArrowStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrowstream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrowStreamReader:
        return ArrowStreamReader(self.options["paths"].split("\n"), self.options.get("bytes", "false") == "true")


def read_arrow_stream(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """Rows of all Arrow stream files of a path; Spark lists the files, so that any store does."""
    spark.dataSource.register(ArrowStream)
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").orderBy("path").toLocalIterator()]
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("arrowstream").option("paths", "\n".join(files)).option("bytes", str(with_bytes).lower()).load()
