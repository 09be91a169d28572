"""A change journal as a streaming source of its own: offsets are sequence numbers, partitions are runs of segments.

A journal is a folder of segments, JSON lines named by the first and last sequence number in them; a segment appears
whole (written aside and renamed) and never changes.  A query resumes after the last number that it has committed, in
the midst of a segment if need be, so a restart neither loses nor repeats a change.

    spark.dataSource.register(journal.JournalSource)
    spark.readStream.format("journal").option("path", folder).load()
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, frn long, reason int, name string"
SEGMENT = re.compile(r"(\d{20})-(\d{20})\.jsonl$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """(first, last, path) of the segments, in order."""
    files, at = opened(path)
    found = ((SEGMENT.search(f.path), f.path) for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)))
    return sorted((int(m[1]), int(m[2]), p) for m, p in found if m)


def write_segment(path: str, rows: list[tuple]) -> None:
    """Appends a segment of rows (seq, frn, reason, name) in the order of seq."""
    files, at = opened(path)
    files.create_dir(at, recursive=True)
    name = f"{rows[0][0]:020}-{rows[-1][0]:020}.jsonl"
    aside = f"{at}/_{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    files.move(aside, f"{at}/{name}")


class Part(InputPartition):
    """The changes of one segment with after < seq <= until."""

    def __init__(self, path: str, segment: str, after: int, until: int):
        self.path, self.segment, self.after, self.until = path, segment, after, until


def parts(path: str, after: int, until: int) -> list[Part]:
    return [Part(path, p, after, until) for first, last, p in segments(path) if last > after and first <= until]


def changes(part: Part) -> Iterator[tuple]:
    with opened(part.path)[0].open_input_stream(part.segment) as file:
        lines = file.read().decode().splitlines()  # a segment is bounded by its writer
    yield from (tuple(r) for r in map(json.loads, lines) if part.after < r[0] <= part.until)


class JournalSource(DataSource):
    """The format "journal"; option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return JournalReader(self.options["path"])

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return JournalStream(self.options["path"])


class JournalReader(DataSourceReader):
    """The whole journal as a table."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return parts(self.path, -1, 1 << 62)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return changes(partition) if partition else iter(())


class JournalStream(DataSourceStreamReader):
    """The journal from the last committed sequence number on."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max((last for _, last, _ in segments(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(self.path, start["seq"], end["seq"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return changes(partition)

    def commit(self, end: dict) -> None:
        """Segments stay: other readers may be behind."""
