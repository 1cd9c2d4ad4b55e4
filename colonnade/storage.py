"""Small files and folders through Hadoop's file system API: a local path, or a URI of any file system that the session knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def make(self, path: str) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target)

    def names(self, path: str) -> list[str]:
        fs, target = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def read(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> bool:
        """Writes a file; with ``new`` only where there is none, which the file system decides, and says whether it did."""
        fs, target = self._at(path)
        if new and fs.exists(target):
            return False
        try:
            stream = fs.create(target, not new)
        except Exception:
            if new and fs.exists(target):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file and moves the new one to its place: a reader sees one or the other."""
        self.write(f"{path}.new", text)
        fs, target = self._at(path)
        fs.delete(target, False)
        fs.rename(self._at(f"{path}.new")[1], target)

    def read_replaced(self, path: str) -> str | None:
        """What ``replace`` wrote last, be it before or after the move; None if there is nothing."""
        return self.read(path) if self.exists(path) else self.read(f"{path}.new") if self.exists(f"{path}.new") else None

    def remove(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)
