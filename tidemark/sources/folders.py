"""Folders of reply files as a data source: rows of changed files only, with a manifest of content ids as the offset.

For what collectors leave behind (records, ledgers, logs, search replies) in a
folder that the driver and all executors have mounted. Spark's own file sources
read any store, but tell files by name, not by content; this one reads a file
again when, and only when, its content has changed. Plain listings and files go
through ``files.py``.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..plans.shipping import by_value

by_value(__name__)

#: Bytes of files that one task reads together, unless the option bytesPerTask says otherwise.
PER_TASK = 32 << 20
SCHEMA = "path string, id string, source string, modified timestamp, line long, value string"


def blob_id(content: bytes) -> str:
    """The content id of a file, as ``files.blob_id``."""
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def _file_id(path: str) -> str:
    head = hashlib.sha1(b"blob %d\0" % os.path.getsize(path))
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            head.update(part)
    return head.hexdigest()


def scan(folder: str, known: dict[str, list]) -> dict[str, list]:
    """{relative path: [content id, size, modification time in ns]} of all files; those of known size and time aren't read."""
    found = {}
    for at, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if not d.startswith((".", "_")))
        for name in sorted(names):
            if name.startswith((".", "_")):
                continue
            path = os.path.join(at, name)
            stat, own = os.stat(path), os.path.relpath(path, folder)
            old = known.get(own)
            same = old is not None and old[1:] == [stat.st_size, stat.st_mtime_ns]
            found[own] = old if same else [_file_id(path), stat.st_size, stat.st_mtime_ns]
    return found


@dataclass
class Files(InputPartition):
    """Files for one task: (relative path, content id if it is known, modification time in ns)."""

    files: list[tuple[str, str | None, int]]

    def __init__(self, files: list[tuple[str, str | None, int]]):
        self.files = files


def _dealt(files: dict[str, list], per_task: int) -> list[Files]:
    out, own, size = [], [], 0
    for path, (id_, n, at) in sorted(files.items()):
        if own and size + n > per_task:
            out.append(Files(own))
            own, size = [], 0
        own.append((path, id_, at))
        size += n
    return [*out, Files(own)] if own else out


def _rows(folder: str, part: Files, lines: bool) -> Iterator[tuple]:
    import datetime

    for path, id_, at in part.files:
        with open(os.path.join(folder, path), "rb") as f:
            content = f.read()
        now = blob_id(content)
        if id_ not in (None, now):
            raise RuntimeError(f"{path} changed while it was read; the next run finds it")
        head = (path, now, path.split("/", 1)[0] if "/" in path else None, datetime.datetime.fromtimestamp(at / 1e9, datetime.UTC))
        text = content.decode("utf-8", "replace")
        if lines:
            yield from ((*head, k, x) for k, x in enumerate(text.splitlines()) if x)
        else:
            yield (*head, 0, text)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.lines, self.per_task = options["path"], options.get("lines", "false") == "true", int(options.get("pertask", PER_TASK))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  a name of the interface
        """Paths and sources asked for: other files are not even opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("path",), ("source",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        names = {}
        for at, folders, files in os.walk(self.folder):
            own = os.path.relpath(at, self.folder)
            folders[:] = sorted(d for d in folders if not d.startswith((".", "_")) and (own != "." or "source" not in self.wanted or d in self.wanted["source"]))
            for name in files:
                path = name if own == "." else f"{own}/{name}"
                if name.startswith((".", "_")) or ("source" in self.wanted and own == ".") or ("path" in self.wanted and path not in self.wanted["path"]):
                    continue
                full = os.path.join(at, name)
                stat = os.stat(full)
                names[path] = [None, stat.st_size, stat.st_mtime_ns]  # contents are for the tasks
        return _dealt(names, self.per_task) or [Files([])]

    def read(self, partition: Files):
        return _rows(self.folder, partition, self.lines)


class _Stream(DataSourceStreamReader):
    """The offset names a manifest, a file of all content ids; what differs between two of them is a batch.

    The driver lists the folder for it and opens only files whose size or time is new.
    """

    def __init__(self, options: dict):
        self.folder, self.manifests = options["path"], options["manifests"]
        self.lines, self.per_task = options.get("lines", "false") == "true", int(options.get("pertask", PER_TASK))

    def _load(self, offset: dict) -> dict[str, list]:
        if not offset["manifest"]:
            return {}
        with open(os.path.join(self.manifests, offset["manifest"])) as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"manifest": ""}

    def _newest(self) -> dict[str, list]:
        names = [os.path.join(self.manifests, n) for n in os.listdir(self.manifests) if n.endswith(".json")] if os.path.isdir(self.manifests) else []
        if not names:
            return {}
        with open(max(names, key=lambda n: (os.stat(n).st_mtime_ns, n))) as f:
            return json.load(f)

    def latestOffset(self) -> dict:  # noqa: N802
        known = self._newest()
        found = scan(self.folder, known)
        text = json.dumps(found, sort_keys=True)
        name = hashlib.sha1(text.encode()).hexdigest() + ".json"
        os.makedirs(self.manifests, exist_ok=True)
        path = os.path.join(self.manifests, name)
        if not os.path.exists(path):
            with open(path + ".new", "w") as f:
                f.write(text)
            os.replace(path + ".new", path)
        elif found != known:
            os.utime(path)  # an earlier state of the folder is back
        return {"manifest": name if found else ""}

    def partitions(self, start: dict, end: dict):
        before = self._load(start)
        return _dealt({p: v for p, v in self._load(end).items() if p not in before or before[p][0] != v[0]}, self.per_task)

    def read(self, partition: Files):
        return _rows(self.folder, partition, self.lines)

    def commit(self, end: dict) -> None:
        pass


class ReplyFolder(DataSource):
    """Format ``reply_folder``: options path, lines (a row per line, else per file), pertask (bytes), and for streams manifests (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "reply_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReplyFolder)
