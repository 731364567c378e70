"""Files and folders that the driver and all executors share, reached through Hadoop's file systems."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none: a temporary folder if everything runs in one process (tests), else one in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        app = context.applicationId
        if app not in _OWN:
            alone = context.master == "local" or context.master.startswith("local[")
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-") if alone else f"{warehouse}/_corpusloom-{app}"
        root = _OWN[app]
    return root.rstrip("/")


def local_path(path: str) -> str:
    """A path of the mounted file system, as sources with files of their own kind need it; ValueError for other systems."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not on a mounted file system")
    return path


class Folder:
    """A folder of some Hadoop file system: a path without a scheme means the local one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def modified(self, name: str) -> float:
        """Seconds since the epoch."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def fingerprint(self, name: str) -> tuple[int, int]:
        """Bytes and last change of a file or folder."""
        at = self._path(name)
        return self._fs.getContentSummary(at).getLength(), self._fs.getFileStatus(at).getModificationTime()

    def names(self, name: str = "") -> list[str]:
        """Folders and files in a folder, sorted; none where it is missing."""
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def is_folder(self, name: str) -> bool:
        at = self._path(name)
        return self._fs.exists(at) and self._fs.getFileStatus(at).isDirectory()

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _put(self, name: str, data: bytes, overwrite: bool) -> None:
        out = self._fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def write(self, name: str, data: bytes) -> None:
        """Written beside its place and renamed over it: readers see the old file or the new one."""
        part = f".{name.rpartition('/')[2]}.{uuid.uuid4().hex}"
        part = f"{name.rpartition('/')[0]}/{part}".lstrip("/")
        self._put(part, data, False)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        context.rename(self._path(part), self._path(name), how)

    def create(self, name: str, data: bytes) -> bool:
        """Write a file that does not exist; False where it does."""
        try:
            self._put(name, data, False)
        except Exception as e:  # py4j wraps the file system's FileAlreadyExistsException
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def put_absent(self, name: str, data: bytes) -> bool:
        """Put a whole file where none is; False where there is one. Of two who try, one succeeds, and nobody sees a part of it.

        On the local file system by a hard link, elsewhere by a rename that does not replace (atomic on HDFS).
        """
        folder, _, leaf = name.rpartition("/")
        part = f"{folder}/.{leaf}.{uuid.uuid4().hex}".lstrip("/")
        self._fs.mkdirs(self._path(folder))
        self._put(part, data, False)
        try:
            if self.root.startswith("file:"):
                at = local_path(self.root)
                os.link(f"{at}/{part}", f"{at}/{name}")
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
                context.rename(self._path(part), self._path(name), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except FileExistsError:
            return False
        except Exception as e:  # py4j wraps the file system's FileAlreadyExistsException
            if "AlreadyExists" not in str(e):
                raise
            return False
        finally:
            self._fs.delete(self._path(part), False)
        return True

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"cannot rename {self.path(name)} to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def copy_to(self, other: str) -> None:
        util, to = self._jvm.org.apache.hadoop.fs.FileUtil, self._jvm.org.apache.hadoop.fs.Path(other)
        util.copy(self._fs, self._path(""), to.getFileSystem(self._conf), to, False, self._conf)


class Lock:
    """One holder at a time, without waiting. A lock says who made it and when; one older than `stale` seconds is taken over."""

    def __init__(self, folder: Folder, name: str = ".lock", stale: float = 6 * 3600.0):
        self.folder, self.name, self.stale = folder, name, stale
        self.mine = json.dumps({"owner": f"{os.uname().nodename}:{os.getpid()}", "token": uuid.uuid4().hex, "at": time.time()}).encode()

    def __enter__(self) -> Lock:
        if not self.folder.create(self.name, self.mine):
            held = self.folder.read(self.name)
            try:
                owner = json.loads(held or b"{}")
            except ValueError:  # its maker stopped while writing
                owner = {}
            age = time.time() - owner.get("at", self.folder.modified(self.name))
            if age < self.stale:
                raise RuntimeError(f"another writer ({owner.get('owner', 'unknown')}) holds {self.folder.path(self.name)}")
            self.folder.delete(self.name)
            if not self.folder.create(self.name, self.mine):
                raise RuntimeError(f"another writer took over {self.folder.path(self.name)}")
        return self

    def __exit__(self, *_) -> None:
        if self.folder.read(self.name) == self.mine:
            self.folder.delete(self.name)
