"""Named workspaces with in-memory, temporary and persistent tiers over one session, and their store on disk."""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.schema import check_name
from colonnade.storage import Files

#: tiers in ascending order
TIERS = ("memory", "temp", "persistent")
SAMPLES = 10


class StoreLocked(RuntimeError):
    pass


class Namespace:
    """Named elements of one tier. Anonymous ones get a generated name, which begins with an underscore and isn't listed."""

    def __init__(self, space: Workspace, tier: str):
        self.space, self.tier, self._elements, self._counter = space, tier, {}, itertools.count(1)

    def assign(self, name: str, df: DataFrame) -> DataFrame:
        self.space._check(df)
        check_name(name)
        if name in self._elements:
            raise ValueError(f"{self.tier} has a variable {name}")
        self.space._forget(df, self)
        stored = self.space._keep(self.tier, name, df)
        self._elements[name] = stored
        stored.createOrReplaceTempView(f"{self.tier}__{name}")
        self.space._changed()
        return stored

    def add(self, df: DataFrame) -> str:
        name = f"__{self._kind(df)}_{next(self._counter)}"
        self.assign(name, df)
        return name

    def assign_all(self, elements: dict[str, DataFrame]) -> None:
        with self.space.batch():
            for name, df in elements.items():
                self.assign(name, df)

    def add_all(self, frames: list[DataFrame]) -> list[str]:
        with self.space.batch():
            return [self.add(df) for df in frames]

    def get(self, name: str) -> DataFrame:
        self.space._open()
        return self._elements[name]

    def has(self, name: str) -> bool:
        return name in self._elements

    def names(self) -> list[str]:
        return sorted(n for n in self._elements if not n.startswith("_"))

    def remove(self, name: str) -> None:
        self.space._open()
        df = self._elements.pop(name)
        self.space._drop(self.tier, name, df)
        self.space._changed()

    @staticmethod
    def _kind(df: DataFrame) -> str:
        if "rid" not in df.columns:
            return "Scalar" if len(df.columns) == 1 else "Frame"
        return "Vector" if len(df.columns) == 2 else "Frame"

    def kind(self, name: str) -> str:
        return self._kind(self._elements[name]).lower()


class _Batch:
    def __init__(self, space):
        self.space = space

    def __enter__(self):
        self.space._depth += 1

    def __exit__(self, *_):
        self.space._depth -= 1
        self.space._changed()


class Workspace:
    """A folder with the temporary and persistent elements, a manifest, and a lock: one writer or any readers.

    Names are ``ns.name`` or, in the default tier temp, ``name``. The store's folder must be one that the executors reach.
    """

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False):
        self.spark, self.folder, self.read_only, self.files = spark, str(folder).rstrip("/"), read_only, Files(spark)
        self._id, self._depth, self._closed = uuid.uuid4().hex, 0, False
        self.files.make(self.folder)
        self._lock()
        self.spaces = {t: Namespace(self, t) for t in TIERS}
        self._owner: dict[int, tuple[str, str]] = {}
        written = self.files.read_replaced(f"{self.folder}/manifest.json")
        held = json.loads(written) if written else {}
        #: notes on the store, kept in its manifest, and the number of elements that were ever stored
        self.notes, self.stored = held.get("notes", {}), held.get("stored", 0)
        if held:
            for name, entry in held["elements"].items():
                df = spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.folder}/persistent/{name}")
                self.spaces["persistent"]._elements[name] = df
                df.createOrReplaceTempView(f"persistent__{name}")

    # names
    def _split(self, name: str) -> tuple[str, str]:
        tier, _, rest = name.partition(".")
        return (tier, rest) if rest else ("temp", name)

    def assign(self, name: str, df: DataFrame) -> DataFrame:
        tier, short = self._split(name)
        return self.spaces[tier].assign(short, df)

    def get(self, name: str) -> DataFrame:
        tier, short = self._split(name)
        return self.spaces[tier].get(short)

    def has(self, name: str) -> bool:
        tier, short = self._split(name)
        return self.spaces[tier].has(short)

    def remove(self, name: str) -> None:
        tier, short = self._split(name)
        self.spaces[tier].remove(short)

    def batch(self) -> _Batch:
        """Changes within it are written to the manifest at once at the end."""
        return _Batch(self)

    # tiers
    def _keep(self, tier: str, name: str, df: DataFrame) -> DataFrame:
        if tier == "memory":
            kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            if self.read_only:
                raise PermissionError("the workspace is open for reading")
            path = f"{self.folder}/{tier}/{name}"
            self.stored += tier == "persistent"
            df.write.mode("overwrite").parquet(path)
            kept = self.spark.read.schema(df.schema).parquet(path)
        kept._colonnade_space = self._id
        self._owner[id(kept)] = (tier, name)
        return kept

    def _drop(self, tier: str, name: str, df: DataFrame) -> None:
        self.spark.catalog.dropTempView(f"{tier}__{name}")
        self._owner.pop(id(df), None)
        if tier == "memory":
            df.unpersist()
        elif not self.read_only:
            self.files.remove(f"{self.folder}/{tier}/{name}")

    def _forget(self, df: DataFrame, to: Namespace) -> None:
        """An element that already has a name moves: read before its files go, so it is kept apart until it is written anew."""
        if id(df) in self._owner:
            tier, name = self._owner[id(df)]
            if TIERS.index(tier) > TIERS.index(to.tier):
                raise ValueError("an element doesn't move to a lower tier")
            self._moved = (tier, name, df)
            self.spaces[tier]._elements.pop(name, None)

    def _check(self, df: DataFrame) -> None:
        self._open()
        if getattr(df, "_colonnade_space", self._id) != self._id:
            raise ValueError("the element belongs to another workspace")

    def _changed(self) -> None:
        moved = self.__dict__.pop("_moved", None)
        if moved:
            self._drop(*moved)
        if self._depth or self.read_only:
            return
        kept = self.spaces["persistent"]._elements
        entries = {n: {"schema": df.schema.jsonValue()} for n, df in kept.items()}
        self.files.replace(f"{self.folder}/manifest.json", json.dumps({"elements": entries, "stored": self.stored, "notes": self.notes}, indent=1))

    def note(self, **values) -> None:
        """Keeps notes on the store in its manifest; None removes one."""
        self._open()
        if self.read_only:
            raise PermissionError("the workspace is open for reading")
        self.notes = {k: v for k, v in (self.notes | values).items() if v is not None}
        self._changed()

    def copy_to(self, name: str, other: Workspace, new_name: str | None = None) -> DataFrame:
        """Copies an element into another workspace, whose own element it becomes; without a new name it keeps its own, tier included."""
        df = self.get(name)
        other._open()
        return other.assign(new_name or name, df.select("*"))

    # lock
    def _lock(self) -> None:
        writer, readers = f"{self.folder}/writer.lock", f"{self.folder}/readers"
        self.files.make(readers)
        if self.read_only:
            if self.files.exists(writer):
                raise StoreLocked("a writer has the store open")
            self.files.write(f"{readers}/{self._id}", "")
            return
        if [n for n in self.files.names(readers) if not n.startswith(".")]:
            raise StoreLocked("readers have the store open")
        if not self.files.write(writer, "", new=True):
            raise StoreLocked("another writer has the store open")

    def _open(self) -> None:
        if self._closed:
            raise RuntimeError("the workspace is closed")

    @property
    def closed(self) -> bool:
        return self._closed

    def close(self) -> None:
        """Temporary elements go, persistent ones stay, the lock is given back."""
        if self._closed:
            return
        for tier in ("memory", "temp"):
            for name in list(self.spaces[tier]._elements):
                self.spaces[tier].remove(name)
        for name in self.spaces["persistent"]._elements:
            self.spark.catalog.dropTempView(f"persistent__{name}")
        if not self.read_only:
            self.files.remove(f"{self.folder}/temp")
        self.files.remove(f"{self.folder}/readers/{self._id}" if self.read_only else f"{self.folder}/writer.lock")
        self._closed = True

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def delete(self) -> None:
        """Closes the workspace and deletes its store with all elements; a reader can't."""
        self._open()
        if self.read_only:
            raise PermissionError("the workspace is open for reading")
        self.close()
        self.files.remove(self.folder)

    def collect_garbage(self) -> list[str]:
        """Removes folders of stored elements that no name holds, such as those a lost session left; gives their names."""
        self._open()
        if self.read_only:
            raise PermissionError("the workspace is open for reading")
        lost = [f"{tier}/{n}" for tier in ("temp", "persistent") for n in self.files.names(f"{self.folder}/{tier}") if n not in self.spaces[tier]._elements and not n.startswith(".")]
        for path in lost:
            self.files.remove(f"{self.folder}/{path}")
        return lost

    def wipe(self) -> None:
        """Drops every element."""
        self._open()
        with self.batch():
            for space in self.spaces.values():
                for name in list(space._elements):
                    space.remove(name)

    def report(self) -> str:
        """Text on each persistent element: type, rows, sort note, least, greatest and some values of each column."""
        lines = []
        for name in sorted(self.spaces["persistent"]._elements):
            df = self.spaces["persistent"].get(name)
            lines.append(f"{name}: {self.spaces['persistent'].kind(name)}")
            simple = [f for f in df.schema if f.name != "rid"]
            row = df.agg(F.count("*").alias("n"), *[x for f in simple for x in (F.min(f.name), F.max(f.name))]).first()
            samples = df.limit(SAMPLES).collect()
            for i, f in enumerate(simple):
                shown = ", ".join(str(r[f.name]) for r in samples)
                lines.append(f"  {f.name} {f.dataType.simpleString()}, {row[0]} rows{', sorted' if (f.metadata or {}).get('sorted') else ''}, {row[1 + 2 * i]} to {row[2 + 2 * i]}: {shown}")
        return "\n".join(lines) + "\n"
