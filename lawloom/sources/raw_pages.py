"""A folder of raw pages as a data source: one file for each page, with what is known of it beside it.

``<name>.html`` has the page as it came, ``<name>.json`` its address and when it
was fetched.  The folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import blank, is_blocked

FORMAT = "raw_pages"
SCHEMA = "name string, url string, fetched_at string, html string"
#: Bytes of the pages that one task reads.
PARTITION_BYTES = 64 << 20


@dataclass
class _Files(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self) -> list[InputPartition]:
        """Names only are listed here, in parts of a bounded size; a large page comes alone."""
        found = sorted((e.name, e.stat().st_size) for e in os.scandir(self.path) if e.name.endswith(".html"))
        parts: list[list[str]] = []
        room = 0
        for name, size in found:
            if not parts or size > room:
                parts.append([])
                room = self.limit
            parts[-1].append(name)
            room -= size
        return [_Files(tuple(p)) for p in parts] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for file in partition.names:
            name = file.removesuffix(".html")
            with open(f"{self.path}/{file}", encoding="utf-8", errors="replace", newline="") as f:
                html = f.read()
            # A page without its sidecar, or with a broken one, is a page all the same.
            try:
                with open(f"{self.path}/{name}.json", encoding="utf-8") as f:
                    known = json.load(f)
            except (FileNotFoundError, ValueError):
                known = {}
            known = known if isinstance(known, dict) else {}
            yield name, known.get("url"), known.get("fetched_at"), html


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> _Written:
        """Each file is written under another name first, so that no reader meets half of one, however often a task is tried."""
        os.makedirs(self.path, exist_ok=True)
        names = []
        for row in iterator:
            known = {"url": row["url"], "fetched_at": row["fetched_at"]}
            stem = re.sub("[^A-Za-z0-9._-]+", "_", row["name"] or "page")[:80]
            mark = hashlib.sha256(json.dumps([row["name"], row["url"]]).encode()).hexdigest()[:12]
            name = row["name"] if row["name"] and row["name"] == stem else f"{stem}-{mark}"
            for ending, content in ((".json", json.dumps(known)), (".html", row["html"] or "")):
                half = f"{self.path}/.{name}{ending}.{os.getpid()}"
                with open(half, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(half, f"{self.path}/{name}{ending}")
            names.append(name)
        return _Written(tuple(names))

    def commit(self, messages: list[_Written]) -> None:
        """What was there before goes last, where it is replaced."""
        if self.overwrite:
            new = {n for m in messages if m for n in m.names}
            for e in [*os.scandir(self.path)] if os.path.isdir(self.path) else []:
                if e.name.rsplit(".", 1)[-1] in ("html", "json") and e.name.rsplit(".", 1)[0] not in new:
                    os.remove(e.path)

    def abort(self, messages: list[_Written]) -> None:
        """Pages that were written stay: each is whole."""


class RawPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def read_pages(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(name, url, fetched_at, html) of every page of a folder; none of an empty one."""
    spark.dataSource.register(RawPages)
    return spark.read.format(FORMAT).option("partitionBytes", partition_bytes).load(path)


def write_pages(pages: DataFrame, path: str, rejected: str) -> dict[str, int]:
    """Writes pages (name, url, fetched_at, html), and those that a bot check has blocked to the folder ``rejected``; how many went where.

    Pages of one name and address are one file.  A null html is an empty page,
    and a name that no file may have is spelled anew.
    """
    pages.sparkSession.dataSource.register(RawPages)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    blocked = is_blocked(blank(F.col("html")))
    counts = {}
    for kind, where, folder in (("written", ~blocked, path), ("rejected", blocked, rejected)):
        seen = Observation()
        rows = pages.select(columns).where(where).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.format(FORMAT).mode("overwrite").save(folder)
        counts[kind] = seen.get["n"]
    return counts
