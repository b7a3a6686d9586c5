"""Object stores: a paged listing as a Spark data source, and copying as a data source writer.

    rows = store.listed(spark, "https://store.example/bucket", prefix="stock/")      # key, size, modified, etag
    moved = store.transfer(spark, local, stored, "/data", "/backup")                 # what the store lacks

A listing has a partition for each folder under the prefix; an executor pages through it, a page token at a time, and holds one page.
A root is the address of a service that lists objects as `?list-type=2` does, or a folder that driver and executors share.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, StringStartsWith, WriterCommitMessage

from ..functions.shipping import ship
from ..operators.long_series import sums_before
from ..operators.ordered import matched
from .files import to_send

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def folder_of(root: str) -> str:
    return root.removeprefix("file://")


def is_service(root: str) -> bool:
    return root.startswith(("http://", "https://"))


class Pages:
    """Pages of the objects below a prefix, in order of their keys: (key, size, modified in seconds, etag)."""

    def __init__(self, root: str, size: int):
        self.root, self.size = root.rstrip("/"), size

    def of(self, prefix: str):
        token = ""
        while True:
            page, token = (self._asked if is_service(self.root) else self._found)(prefix, token)
            yield page
            if not token:
                return

    def folders(self, prefix: str) -> tuple[list[str], bool]:
        """The prefixes one level further down, and whether objects lie on this level."""
        if is_service(self.root):
            found, here, token = [], False, ""
            while True:
                answer = self._answer(prefix, token, "/")
                found += [p.findtext("Prefix") for p in answer.iter("CommonPrefixes")]
                here |= any(True for _ in answer.iter("Contents"))
                if not (token := answer.findtext("NextContinuationToken") or ""):
                    return found, here
        top = f"{folder_of(self.root)}/{prefix}"
        level, start = (top, "") if not prefix or prefix.endswith("/") else (os.path.dirname(top), os.path.basename(top))
        base = prefix[: len(prefix) - len(start)]
        entries = [e for e in os.scandir(level) if e.name.startswith(start)] if os.path.isdir(level) else []
        return sorted(f"{base}{e.name}/" for e in entries if e.is_dir()), any(e.is_file() for e in entries)

    def _found(self, prefix: str, token: str):
        """A page of a folder: walks on from the key that the last page ended with."""
        out = []
        for entry in self._walk(prefix, token):
            out.append(entry)
            if len(out) == self.size:
                return out, entry[0]
        return out, ""

    def _walk(self, prefix: str, after: str):
        """Files below prefix with keys after `after`, in order; folders that end before it are not entered."""
        def level(base: str):
            path = f"{folder_of(self.root)}/{base}"
            # A folder sorts as its keys do: with the slash.
            for name, entry in sorted((e.name + "/" * e.is_dir(), e) for e in os.scandir(path)):
                key = base + name
                if entry.is_dir():
                    if (key.startswith(prefix) or prefix.startswith(key)) and not (after > key and not after.startswith(key)):
                        yield from level(key)
                elif key.startswith(prefix) and key > after:
                    stat = entry.stat()
                    yield key, stat.st_size, stat.st_mtime, f"{stat.st_mtime_ns:x}-{stat.st_size:x}"

        top = prefix[: prefix.rfind("/") + 1]
        if os.path.isdir(f"{folder_of(self.root)}/{top}"):
            yield from level(top)

    def _answer(self, prefix: str, token: str, delimiter: str = ""):
        from urllib.parse import urlencode
        from urllib.request import urlopen
        from xml.etree import ElementTree

        asked = {"list-type": 2, "prefix": prefix, "continuation-token": token, "max-keys": self.size, "delimiter": delimiter}
        with urlopen(f"{self.root}?{urlencode({k: v for k, v in asked.items() if v})}", timeout=60) as answer:
            tree = ElementTree.fromstring(answer.read())
        for node in tree.iter():
            node.tag = node.tag.rsplit("}", 1)[-1]
        return tree

    def _asked(self, prefix: str, token: str):
        import datetime as dt

        answer = self._answer(prefix, token)
        page = []
        for o in answer.iter("Contents"):
            at = dt.datetime.fromisoformat((o.findtext("LastModified") or "1970-01-01T00:00:00Z").replace("Z", "+00:00"))
            page.append((o.findtext("Key"), int(o.findtext("Size") or 0), at.timestamp(), (o.findtext("ETag") or "").strip('"')))
        return page, answer.findtext("NextContinuationToken") or ""


class OnePrefix(InputPartition):
    def __init__(self, prefix: str, flat: bool):
        self.prefix, self.flat = prefix, flat


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.prefix, self.pages = options.get("prefix", ""), Pages(options["root"], int(options.get("page_size", "1000")))

    def pushFilters(self, filters):
        """A start of the key that a filter asks for becomes the prefix; Spark still applies what it narrows only."""
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("key",) and f.value.startswith(self.prefix):
                self.prefix = f.value
                if isinstance(f, StringStartsWith):
                    continue
            yield f

    def partitions(self):
        below, here = self.pages.folders(self.prefix)
        return [OnePrefix(p, False) for p in below] + [OnePrefix(self.prefix, True)] * (here or not below)

    def read(self, partition):
        import datetime as dt

        cut = self.prefix.rfind("/") + 1
        for page in self.pages.of(partition.prefix):
            for key, size, at, etag in page:
                if not partition.flat or "/" not in key[max(len(partition.prefix), cut) :]:
                    yield key, size, dt.datetime.fromtimestamp(at, dt.timezone.utc), etag


class Listing(DataSource):
    @classmethod
    def name(cls):
        return "store_listing"

    def schema(self):
        return "key string, size long, modified timestamp, etag string"

    def reader(self, schema):
        return ListingReader(self.options)


def listed(spark: SparkSession, root: str, prefix: str = "", page_size: int = 1000) -> DataFrame:
    """key (the path below root), size, modified and etag of every object whose key starts with prefix. A filter on the key's start narrows the prefix."""
    ship(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Listing)
    return spark.read.format("store_listing").option("root", root).option("prefix", prefix).option("page_size", page_size).load()


class Staged(WriterCommitMessage):
    def __init__(self, manifest: str, files: int):
        self.manifest, self.files = manifest, files


class CopyWriter(DataSourceWriter):
    """Tasks copy into a hidden folder of the target and note what they copied; commit moves the files to their places, abort removes them.

    Only the driver makes the folder, so a task that goes on after an abort finds it gone and makes nothing.
    """

    def __init__(self, options):
        self.source, self.target = folder_of(options["from"]), folder_of(options["to"])
        self.stage = stage_of(options["to"], options["run"])

    def write(self, iterator):
        import shutil

        own, done = f"{self.stage}/{uuid.uuid4().hex}", 0
        os.mkdir(own)
        with open(f"{own}/keys", "w", encoding="utf-8") as manifest:
            for row in iterator:
                shutil.copy2(f"{self.source}/{row.key}", f"{own}/{done}")
                if os.path.getsize(f"{own}/{done}") != row.size:
                    raise OSError(f"{row.key} has changed while it was copied")
                print(row.to, file=manifest)
                done += 1
        return Staged(own, done)

    def commit(self, messages):
        for m in messages:
            if m is not None:
                with open(f"{m.manifest}/keys", encoding="utf-8") as manifest:
                    for n, key in enumerate(line.rstrip("\n") for line in manifest):
                        os.makedirs(os.path.dirname(f"{self.target}/{key}"), exist_ok=True)
                        os.replace(f"{m.manifest}/{n}", f"{self.target}/{key}")
        self._removed()

    def abort(self, messages):
        self._removed()

    def _removed(self):
        """Takes the folder away from tasks that still run, then deletes it."""
        import shutil
        import time

        if not os.path.isdir(self.stage):
            return
        os.rename(self.stage, gone := f"{self.stage}-gone")
        for _ in range(50):  # a task may be at its last file
            shutil.rmtree(gone, ignore_errors=True)
            if not os.path.exists(gone):
                return
            time.sleep(0.1)


def stage_of(target: str, run: str) -> str:
    return f"{folder_of(target)}/_staged-{run}"


class Copies(DataSource):
    @classmethod
    def name(cls):
        return "store_copy"

    def schema(self):
        return "key string, size long, to string"

    def writer(self, schema, overwrite):
        return CopyWriter(self.options)


def packed(files: DataFrame, task_bytes: int) -> DataFrame:
    """files (key, size) with the number of the task that copies each: neighbours by hash until task_bytes are full, a large file by itself."""
    cell = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    rows = files.select("key", "size", cell.alias("cell"), F.lit(0).alias("all"))
    from pyspark.sql import Window

    before = sums_before(rows.groupBy("all", "cell").agg(F.sum("size").alias("before")), ["all"], "cell", ["before"])
    within = F.sum("size").over(Window.partitionBy("all", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = matched(rows.withColumn("within", within), before, ["all", "cell"])
    small = F.floor((F.col("before") + F.col("within")) / task_bytes).cast("string")
    return rows.select("key", "size", F.when(F.col("size") >= task_bytes, F.concat(F.lit("file "), F.col("key"))).otherwise(small).alias("task"))


def transfer(spark: SparkSession, local: DataFrame, stored: DataFrame, source: str, target: str, task_bytes: int = 256 << 20) -> int:
    """Copies the files of `local` (key, size; below source) that `stored` lacks or holds with another size to below target; how many.

    All of them are there when it ends, or none: a run that fails leaves the target as it was.
    """
    return _copied(spark, packed(to_send(local.select("key", "size"), stored), task_bytes).withColumn("to", F.col("key")), source, target)


def _copied(spark: SparkSession, files: DataFrame, source: str, target: str) -> int:
    """Copies files (key, size, task, to: the key in the target) by tasks."""
    from .sinks import kept

    ship(spark)
    spark.dataSource.register(Copies)
    todo = kept(files)
    facts = todo.agg(F.count("*").alias("files"), F.countDistinct("task").alias("tasks")).first()
    if facts.files:
        os.makedirs(stage_of(target, run := uuid.uuid4().hex))
        rows = todo.repartition(facts.tasks, "task").select("key", "size", "to")
        rows.write.format("store_copy").option("from", source).option("to", target).option("run", run).mode("append").save()
    return facts.files


def renamed_by_partition(spark: SparkSession, source: str, column: str, target: str) -> int:
    """Copies the Parquet files of a table written by partition (`column=value/part-x`) to files named by the value; how many.

    A value's only file becomes `value.parquet`, further ones `value-1.parquet` and so on.
    """
    from pyspark.sql import Window

    found = listed(spark, source).where(F.col("key").startswith(f"{column}=") & F.col("key").endswith(".parquet"))
    value = F.regexp_extract("key", r"^[^=]+=([^/]+)/", 1)
    nth = F.row_number().over(Window.partitionBy(value).orderBy("key")) - 1
    name = F.concat(value, F.when(nth > 0, F.concat(F.lit("-"), nth)).otherwise(""), F.lit(".parquet"))
    return _copied(spark, packed(found.select("key", "size"), 256 << 20).join(found.select("key", name.alias("to")), "key"), source, target)
