"""Claims and commits that two runs can't both win, on a file system that both see.

Everything rests on ``put_once``: a folder that holds a text is moved to its
place, and whoever's text stands there afterwards has put it. File systems move
a folder in one step; onto a place that is taken they either refuse or put it
inside, and in both cases the first text stays. Stores that copy instead of
moving (plain object stores) don't promise that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Times that a commit is tried before it gives up.
ATTEMPTS = 5


class Lost(RuntimeError):
    """Every try met another writer's commit."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, f"{path}/text")
    try:
        stream = fs.open(p)
    except Exception as e:  # py4j wraps what the file system throws
        if "FileNotFound" in str(e):
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a text at a place where there is none; whether it is this call's text that stands there now."""
    mark = uuid.uuid4().hex
    above, name = path.rsplit("/", 1)
    fs, tmp = _fs(spark, f"{above}/.{name}-{mark}")
    place, jvm = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm
    if fs.exists(place):
        return False
    out = fs.create(jvm.org.apache.hadoop.fs.Path(tmp, "text"))
    out.write(bytearray((mark + "\n" + text).encode()))
    out.close()
    try:
        fs.rename(tmp, place)
    except Exception as e:
        if "Exist" not in str(e) and "not empty" not in str(e):
            raise
    won = (_read(spark, path) or "").startswith(mark)
    if not won:
        fs.delete(tmp, True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(place, tmp.getName()), True)  # where a move went inside
    return won


def text_at(spark: SparkSession, path: str) -> str | None:
    """The text that was put at a place."""
    found = _read(spark, path)
    return None if found is None else found.split("\n", 1)[1]


def claim(spark: SparkSession, folder: str, week: str, step: str, who: str) -> bool:
    """Whether a run may do a week's step: the first that asks, and that one again."""
    path = f"{folder}/{week}/{step}"
    return put_once(spark, path, who) or text_at(spark, path) == who


def release(spark: SparkSession, folder: str, week: str, step: str, who: str) -> bool:
    """Let go of a claim after a failure, if this run holds it."""
    path = f"{folder}/{week}/{step}"
    if text_at(spark, path) != who:
        return False
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def latest(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """The number of the newest commit (0: none yet) and where its tables lie."""
    fs, p = _fs(spark, f"{folder}/commits")
    if not fs.exists(p):
        return 0, {}
    n = max((int(s.getPath().getName()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")), default=0)
    return n, json.loads(text_at(spark, f"{folder}/commits/{n}")) if n else {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table as of the newest commit; None before it was first written."""
    at = latest(spark, folder)[1].get(table)
    return spark.read.parquet(at) if at else None


def commit(spark: SparkSession, folder: str, changes: dict[str, Callable[[DataFrame | None], DataFrame]], attempts: int = ATTEMPTS) -> int:
    """Rewrite several tables in one commit, and return its number.

    ``changes``: by table, what becomes of it: a function of what it holds now
    (None at first). All tables are written aside and become visible together,
    by one ``put_once`` of their places under the next number. If another writer
    took that number, everything is computed again from what that one wrote, so
    its rows survive; after ``attempts`` such losses ``Lost`` is raised and nothing
    has changed. Tables without a change keep their place.
    """
    for _ in range(attempts):
        n, places = latest(spark, folder)
        mine = f"{folder}/tables/{uuid.uuid4().hex}"
        for table, change in changes.items():
            now = spark.read.parquet(places[table]) if table in places else None
            change(now).write.parquet(f"{mine}/{table}")
        if put_once(spark, f"{folder}/commits/{n + 1}", json.dumps(places | {t: f"{mine}/{t}" for t in changes})):
            return n + 1
        fs, p = _fs(spark, mine)
        fs.delete(p, True)
    raise Lost(f"{attempts} tries, each after another writer's commit")


def forget(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete the commits before the last ``keep``, and tables that none of the kept ones has and that are older than those."""
    fs, p = _fs(spark, f"{folder}/commits")
    numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if not s.getPath().getName().startswith("."))
    kept = {x.rsplit("/", 2)[1] for n in numbers[-keep:] for x in json.loads(text_at(spark, f"{folder}/commits/{n}")).values()}
    for n in numbers[:-keep]:
        for x in json.loads(text_at(spark, f"{folder}/commits/{n}")).values():
            if x.rsplit("/", 2)[1] not in kept:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(x.rsplit("/", 1)[0]), True)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/{n}"), True)
