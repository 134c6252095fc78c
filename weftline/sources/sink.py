"""Output files with their receipts, placed without overwriting anything, all of a job or none.

``write_outputs`` writes rows ``name, content, receipt`` to a folder and returns what was placed, which
``read_outputs`` reads back. Files are written, named, cleaned up and read by tasks; the driver handles a
listing per task, never a file.

Tasks write both files of a row into a folder of the job's own below the target, under names that nothing
else has, and list them. Only when every task has ended are names taken, by hard links, which fail where
a name exists: so nothing is ever overwritten, not even by a race, and an output is taken together with
its receipt. Names that could ever meet are one family and are taken by one task; a task that is run again
finds the names it took before. When all names are taken, the job's folder is renamed, which ends the job, and
then removed. If anything fails before that, the folder is renamed too, so that tasks which still run find
nothing more to link, every link that leads to one of the job's own files is taken back, and the folder goes.
A job that died in between is cleaned up by ``recover`` in the same way: it leaves neither output nor receipt,
or, past its end, all of them. So a task lost between the two files never shows.

Conflicts: ``suffix`` numbers a name from 2 to 999, before the last dot; ``skip`` leaves what is there and
writes nothing, no receipt either; ``fail`` refuses the whole job. A receipt is named after the output
and follows the same rule. Names are taken in order of the partitions and of rows within them. A name
with a folder in it, an empty name and null are errors; null content is an empty file.

The first step is a data source: ``outputs.write.format("weftline_files").option("conflict", ...)
.mode("append").save(folder)``. Used by itself, it takes the names on the driver, one after another.

The target is a path that driver and executors share and that can link files.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.batches import slices
from weftline.scratch import scratch_path, written
from weftline.session import MOST_TASKS, dealt, table

STAGED = ".weftline-outputs-"
#: A job's folder once all its names are taken.
PLACED = ".weftline-placed-"
LAST_SUFFIX = 999
#: Files that are written or read in a task.
PER_TASK = 4096


def local(folder: str) -> str:
    return folder.removeprefix("file://").removeprefix("file:").rstrip("/")


def candidates(name: str, conflict: str) -> Iterator[str]:
    """The names to try in turn. A leading dot begins no extension."""
    yield name
    if conflict == "suffix":
        stem, dot, extension = name.rpartition(".")
        for n in range(2, LAST_SUFFIX + 1):
            yield f"{stem} ({n}).{extension}" if stem else f"{name} ({n})"


def family(name: str) -> F.Column:
    """The same for a name, all names tried for it, and all names tried for their receipts."""
    return F.regexp_replace(F.regexp_replace(name, r" \([0-9]+\)", ""), r"(\.receipt\.json)+\z", "")


def _same(path: str, staged: str) -> bool:
    try:
        return os.path.samestat(os.lstat(path), os.stat(staged))
    except FileNotFoundError:
        return False


def take(staged: str, folder: str, name: str, conflict: str) -> str | None:
    """Give a staged file the first free name, or the one it has; null where the policy is to leave what is there."""
    for candidate in candidates(name, conflict):
        path = os.path.join(folder, candidate)
        try:
            os.link(staged, path)
            return candidate
        except FileExistsError:
            if _same(path, staged):
                return candidate
    if conflict == "skip":
        return None
    raise FileExistsError(f"{name} already exists" if conflict == "fail" else f"{name}: {LAST_SUFFIX - 1} numbered names already exist")


def take_both(output: str, receipt: str | None, folder: str, name: str, conflict: str) -> tuple[str | None, str | None]:
    """The names that an output and its receipt get."""
    placed = take(output, folder, name, conflict)
    return placed, take(receipt, folder, f"{placed}.receipt.json", conflict) if placed is not None and receipt is not None else None


def _take_back(folder: str, staged: str) -> None:
    """Remove the links to files of a staging folder, and then the folder. Eight bytes are held per link."""
    undone = staged if staged.endswith("-undone") else f"{staged}-undone"
    os.rename(staged, undone)
    device = os.stat(undone).st_dev
    files = (f.stat(follow_symlinks=False) for at, _, _ in os.walk(undone) for f in os.scandir(at) if f.is_file(follow_symlinks=False))
    own = np.sort(np.fromiter((s.st_ino for s in files if s.st_nlink > 1), np.uint64))
    for f in os.scandir(folder) if len(own) else ():
        at = np.searchsorted(own, np.uint64(f.inode()))
        if at < len(own) and own[at] == f.inode() and f.is_file(follow_symlinks=False) and f.stat(follow_symlinks=False).st_dev == device:
            os.unlink(f.path)
    shutil.rmtree(undone)


def _end(staged: str) -> str:
    """All names are taken: from here on the job is done, whatever becomes of its folder."""
    done = os.path.join(os.path.dirname(staged), PLACED + os.path.basename(staged).removeprefix(STAGED))
    os.rename(staged, done)
    return done


def recover(folder: str) -> int:
    """Undo the jobs that died before they ended; how many there were. Not while a job writes."""
    folder, undone = local(folder), 0
    for f in list(os.scandir(folder)):
        if f.name.startswith(STAGED) and f.is_dir():
            _take_back(folder, f.path)
            undone += 1
        elif f.name.startswith(PLACED) and f.is_dir():
            shutil.rmtree(f.path)
    return undone


@dataclass
class Staged(WriterCommitMessage):
    partition: int
    listing: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, conflict: str, staged: str | None):
        self.folder, self.conflict = local(folder), conflict.lower()
        if self.conflict not in ("suffix", "skip", "fail"):
            raise ValueError("conflict is suffix, skip or fail")
        self.placing = staged is None
        self.staged = staged or os.path.join(self.folder, STAGED + uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        # The attempt is part of the name, so that a task that is run again meets nothing of its past.
        at = os.path.join(self.staged, f"{context.partitionId()}-{context.taskAttemptId()}")
        (os.makedirs if self.placing else os.mkdir)(at)
        with open(at + ".list", "w", encoding="utf-8") as listing:
            rows = (row for b in slices(iterator) for row in zip(*(b[c].to_pylist() for c in ("name", "content", "receipt"))))
            for i, (name, content, receipt) in enumerate(rows):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"not a file name: {name!r}")
                with open(f"{at}/{i}.out", "xb") as out:
                    out.write(content or b"")
                if receipt is not None:
                    with open(f"{at}/{i}.receipt", "x", encoding="utf-8") as out:
                        out.write(receipt + "\n")
                listing.write(json.dumps([name, f"{at}/{i}.out", f"{at}/{i}.receipt" if receipt is not None else None]) + "\n")
        return Staged(context.partitionId(), at + ".list")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Leaves the listings of the tasks that count for ``write_outputs``, as the only ones with a plain number."""
        if not os.path.isdir(self.staged):
            return
        ended = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if not self.placing:
            for message in ended:
                os.rename(message.listing, os.path.join(self.staged, f"{message.partition}.listing"))
            return
        try:
            for message in ended:
                for _, name, output, receipt in _lines(message.listing):
                    take_both(output, receipt, self.folder, name, self.conflict)
            done = _end(self.staged)
        except BaseException:
            _take_back(self.folder, self.staged)
            raise
        shutil.rmtree(done)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.isdir(self.staged):
            _take_back(self.folder, self.staged)


class OutputFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_files"

    def schema(self) -> str:
        return "name string, content binary, receipt string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("conflict", "suffix"), self.options.get("staged"))


def _lines(listing: str) -> Iterator[tuple[int, str, str, str | None]]:
    with open(listing, encoding="utf-8") as lines:
        for i, line in enumerate(lines):
            yield i, *json.loads(line)


def _columns(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as they come, in batches."""
    while held := list(islice(rows, PER_TASK)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("partition", pa.int32()), ("row", pa.int64()), ("name", pa.string()), ("output", pa.string()), ("receipt", pa.string())])
    yield from _columns(((p, *line) for b in batches for p, path in zip(*(c.to_pylist() for c in b.columns)) for line in _lines(path)), schema)


def write_outputs(outputs: DataFrame, folder: str, conflict: str = "suffix") -> DataFrame:
    """``name, content, receipt`` (may be null) to files beside each other; all or none. Returns the names asked for and placed: ``name, output, receipt``."""
    spark, folder, conflict = outputs.sparkSession, local(folder), conflict.lower()
    os.makedirs(folder, exist_ok=True)
    spark.dataSource.register(OutputFiles)
    staged = os.path.join(folder, STAGED + uuid.uuid4().hex)
    os.mkdir(staged)
    rows = outputs.select("name", F.col("content").cast("binary").alias("content"), "receipt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for b in batches for line in zip(*(b[c].to_pylist() for c in ("name", "output", "receipt"))))
        taken = ((name, *take_both(output, receipt, folder, name, conflict)) for name, output, receipt in lines)
        yield from _columns((t for t in taken if t[1] is not None), pa.schema([(c, pa.string()) for c in ("name", "output", "receipt")]))

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                shutil.rmtree(path, ignore_errors=True)
            yield b

    try:
        rows.write.format("weftline_files").option("conflict", conflict).option("staged", staged).mode("append").save(folder)
        listings = [(int(f.name.removesuffix(".listing")), f.path) for f in os.scandir(staged) if f.name.endswith(".listing")]
        lines = spark.createDataFrame(listings, "partition int, path string").mapInArrow(_listed, "partition int, row long, name string, output string, receipt string")
        in_turn = lines.withColumn("family", family("name")).repartition("family").sortWithinPartitions("family", "partition", "row")
        placed = written(in_turn.mapInArrow(place, "name string, output string, receipt string"), "outputs-placed")
        done = _end(staged)
    except BaseException:
        if os.path.isdir(staged):
            _take_back(folder, staged)
        raise
    folders = [(f.path,) for f in os.scandir(done) if f.is_dir()]
    spark.createDataFrame(folders, "path string").mapInArrow(clear, "path string").write.format("noop").mode("overwrite").save()
    shutil.rmtree(done)
    return placed


def read_outputs(placed: DataFrame, folder: str) -> DataFrame:
    """The files that ``write_outputs`` placed, by tasks: ``name, content, receipt``. A file that is gone is an error."""
    folder = local(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held(name: str | None) -> bytes | None:
            if name is None:
                return None
            with open(os.path.join(folder, name), "rb") as file:
                return file.read()

        for b in slices(batches):
            contents, receipts = ([held(name) for name in b[c].to_pylist()] for c in ("output", "receipt"))
            yield pa.RecordBatch.from_arrays([b["output"], pa.array(contents, pa.binary()), pa.array(receipts, pa.binary())], ["name", "content", "receipt"])

    return dealt(placed, PER_TASK).mapInArrow(read, "name string, content binary, receipt binary")


def receipt_json(name: str = "name", content: str = "content") -> F.Column:
    """What a receipt says at least: the output's name, size and content id."""
    return F.to_json(F.struct(F.col(name).alias("output"), F.octet_length(content).cast("long").alias("output_bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("content_id")))


def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files, three with a name, and their receipts, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.floor(F.col("doc_id") / 3), F.lit(".tar.txt")).alias("name"), F.col("text").alias("content"))
    folder = scratch_path(spark, "outputs")
    in_turn = docs.repartitionByRange(min(MOST_TASKS, docs.count() // PER_TASK + 1), "doc_id").sortWithinPartitions("doc_id")
    files = read_outputs(write_outputs(in_turn.withColumn("receipt", receipt_json()), folder), folder)
    content_id = F.get_json_object(F.decode("receipt", "UTF-8"), "$.content_id")
    return files.select("name", F.octet_length("content").cast("long").alias("bytes"), (F.sha2("content", 256) == content_id).alias("matches"))


QUERIES = {"output_files": output_files}
ORACLES = {
    "output_files": """
WITH d AS (SELECT 'doc-' || (doc_id // 3) AS stem, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS n, strlen(text) AS bytes FROM documents)
SELECT stem || '.tar' || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.txt' AS name, bytes::BIGINT AS bytes, true AS matches FROM d"""
}
