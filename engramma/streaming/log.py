"""An append-only message log as a stream source with consumer groups.

A log is a folder with two lanes, ``main`` and ``retry``. A lane is a row of numbered segments, each a folder of Parquet
files that counts once its marker of success is there. A consumer group has its own offset in each lane, moved on when a
batch is done (acknowledged), so a group goes on where it stopped even with a new checkpoint, and its lag can be told.
Messages that a consumer could not handle are put into the retry lane under the number of the batch that failed them;
the same batch run again writes the same segment, so nothing is doubled. After ``attempts`` tries they are dead letters.

Folders are named as URIs that Arrow and Spark both know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LANES = ("main", "retry")
_FIELDS = [T.StructField("id", T.StringType()), T.StructField("body", T.StringType()), T.StructField("tries", T.LongType())]
MESSAGE = T.StructType(_FIELDS)
_ARROW = pa.schema([("id", pa.string()), ("body", pa.string()), ("tries", pa.int64())])


def _segments(folder: str, lane: str) -> int:
    """How many segments of a lane are whole, without a gap before them."""
    system, path = fs.FileSystem.from_uri(f"{folder}/{lane}")
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = {x.base_name for x in found}
    n = 0
    while f"{n:012d}" in names and system.get_file_info(f"{path}/{n:012d}/_SUCCESS").type == fs.FileType.File:
        n += 1
    return n


def append(messages: DataFrame, folder: str, lane: str = "main", segment: int | None = None) -> int:
    """Writes messages (id, body) as a lane's next segment, or again as a given one; its number. One writer a lane at a time."""
    n = _segments(folder, lane) if segment is None else segment
    tries = F.col("tries") if "tries" in messages.columns else F.lit(0)
    messages.select(F.col("id").cast("string").alias("id"), F.col("body").cast("string").alias("body"), tries.cast("long").alias("tries")).write.mode("overwrite").parquet(f"{folder}/{lane}/{n:012d}")
    return n


def _group_path(folder: str, group: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, f"{path}/groups/{group}"


def acknowledged(folder: str, group: str) -> dict[str, int]:
    """How many segments of each lane a group is done with."""
    system, path = _group_path(folder, group)
    found = [x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.base_name.endswith(".json")]
    if not found:
        return dict.fromkeys(LANES, 0)
    with system.open_input_stream(f"{path}/{max(found)}") as f:
        return json.loads(f.read())


def lag(folder: str, group: str) -> dict[str, int]:
    """How many segments of each lane are waiting for a group."""
    done = acknowledged(folder, group)
    return {lane: _segments(folder, lane) - done[lane] for lane in LANES}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.group, self.most = options["path"].rstrip("/"), options["group"], int(options.get("segmentspertrigger", "1000000"))
        self.seen: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return acknowledged(self.folder, self.group)

    def latestOffset(self) -> dict:  # noqa: N802
        # no more than ``most`` segments behind what was last told, so that batches stay bounded
        base = self.seen or acknowledged(self.folder, self.group)
        self.seen = {lane: min(_segments(self.folder, lane), base[lane] + self.most) for lane in LANES}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {lane: max(end[lane], (self.seen or end)[lane]) for lane in LANES}
        out: list[InputPartition] = []
        for lane in LANES:
            for n in range(start[lane], end[lane]):
                system, path = fs.FileSystem.from_uri(f"{self.folder}/{lane}/{n:012d}")
                scheme = self.folder.partition("://")[0] if "://" in self.folder else "file"
                out += [_File(f"{scheme}://{x.path}") for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]
        return out

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as f:
            yield from (b.cast(_ARROW) for b in pq.ParquetFile(f).iter_batches())

    def commit(self, end: dict) -> None:
        """Acknowledges: a new file for each state, the last by name counts; two are kept."""
        system, path = _group_path(self.folder, self.group)
        system.create_dir(path, recursive=True)
        name = f"{path}/{sum(end.values()):012d}.json"
        with system.open_output_stream(f"{name}.draft") as f:
            f.write(json.dumps(end).encode())
        system.move(f"{name}.draft", name)
        old = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".json"))[:-2]
        for x in old:
            system.delete_file(x)


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").option("path", …).option("group", …)``: rows (id, body, tries)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> T.StructType:
        return MESSAGE

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def messages(spark: SparkSession, folder: str, group: str, segments_per_trigger: int = 10) -> DataFrame:
    """A stream of the messages (id, body, tries) that a group has not acknowledged."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").option("path", folder).option("group", group).option("segmentsPerTrigger", str(segments_per_trigger)).load()


def consume(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], folder: str, out: str, checkpoint: str, attempts: int = 3):
    """Starts a query that handles the waiting messages of as many segments as ``stream`` takes at a time; ``handle`` gives its rows with ``ok``, whether each was handled.

    Handled rows go to ``out/done``, others back into the log's retry lane, and those tried ``attempts`` times to
    ``out/dead``. A batch that is run again writes the same folders and the same segment. One consumer a log may retry.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        path = f"{out}/handled/batch={batch_id}"
        handle(df).write.mode("overwrite").parquet(path)
        h = df.sparkSession.read.parquet(path)
        failed = ~F.coalesce("ok", F.lit(False))
        h.where(~failed).drop("ok").write.mode("overwrite").parquet(f"{out}/done/batch={batch_id}")
        h.where(failed & (F.col("tries") + 1 >= attempts)).drop("ok").write.mode("overwrite").parquet(f"{out}/dead/batch={batch_id}")
        append(h.where(failed & (F.col("tries") + 1 < attempts)).withColumn("tries", F.col("tries") + 1), folder, "retry", batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
