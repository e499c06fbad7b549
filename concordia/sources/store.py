"""Versioned tables under one root with an atomic manifest (SNK1-SNK4, SNK6, SNK7, MUT7, STR10).

Data files are written under fresh names and nothing sees them until a manifest names them.
Manifests are numbered; a number can be published once, so of two writers one loses and must read
again.  On a local disk the finished file is linked to its number; elsewhere it is created
exclusively, and a newest manifest that stays unreadable for ``DEAD_AFTER`` seconds is one whose
writer died, and is passed over.  The manifest holds what is of a table's size in files beside it
(states of chunks, paths of buckets, parts of the log), and only the newest ``KEEP`` manifests stay.
All file work goes through Hadoop's file systems, so the root may be on any of them.

Whoever changes a job holds a lease with an epoch, a number that grows with every lease taken.  What
the holder publishes goes through its lease, which is looked up in the very state that the commit
replaces: a holder that was paused until its lease ran out, or was taken over, publishes nothing.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

VERSION = 5
KEEP, DEAD_AFTER, LEASE = 20, 10.0, 60.0
#: Leases under which no other lease may be held.
ALONE = ("vacuum",)


class Refused(RuntimeError):
    """The state does not allow what was asked for."""


class Lost(Refused):
    """The lease that this was done under ran out or has another holder."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._path("manifest"))
        state = self.manifest()
        if state["version"] > VERSION:
            raise Refused(f"the state is of version {state['version']}, newer than {VERSION}")
        if state["version"] < VERSION:  # SNK4: missing steps in order, one commit
            self.commit(self._upgrade)

    def _upgrade(self, s: dict) -> None:
        for k, v in (("tables", {}), ("chunks", {}), ("log", []), ("positions", {}), ("runs", []), ("events", []), ("leases", {}), ("epoch", 0), ("captured_of", {}), ("applied_of", {})):
            s.setdefault(k, v)
        if 0 < s["version"] < 4 and s["tables"]:
            raise Refused("tables loaded under a state of version 3 have to be copied again")
        if s["version"] == 4:  # its log has no index of parts, and its buckets were numbered by a plain remainder
            if s["log"]:
                raise Refused("a state of version 4 has to be drained by the version that wrote it")
            for t, of in s["tables"].items():
                if of.pop("buckets", None) is not None:
                    of["files"] = self.put_files(t, {"-1": [p for ps in self.files(s, t).values() for p in ps]})
        s["version"] = VERSION

    # ------------------------------------------------------------ manifest

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _newest(self) -> tuple[int, dict]:
        """The greatest number, and the state in the newest manifest that is whole."""
        while True:
            numbers = self._numbers()
            for n in reversed(numbers):
                try:
                    return (numbers[-1], json.loads(self._read(f"manifest/{n}.json")))
                except json.JSONDecodeError:
                    if time.time() - self._age_of(f"manifest/{n}.json") < DEAD_AFTER:
                        break  # its writer may still be at it
                except Exception as e:
                    if "FileNotFound" not in str(e):
                        raise
                    break  # pruned meanwhile
            else:
                return (numbers[-1] if numbers else 0, {"version": 0})
            time.sleep(0.2)

    def _age_of(self, name: str) -> float:
        try:
            return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000
        except Exception:
            return time.time()

    def manifest(self) -> dict:
        return self._newest()[1]

    def commit(self, change: Callable[[dict], object], tries: int = 100) -> dict:
        """Apply ``change`` to the latest state and publish it; if another writer came first, start over from theirs."""
        for _ in range(tries):
            last, state = self._newest()
            change(state)
            if self._publish(f"manifest/{last + 1}.json", json.dumps(state, sort_keys=True)):
                for n in self._numbers()[:-KEEP]:
                    self._fs.delete(self._path(f"manifest/{n}.json"), False)
                return state
        raise Refused("too many writers")

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, name: str, text: str) -> bool:
        """Create the file with its whole content unless it exists."""
        if self._local:
            path = self._fs.pathToFile(self._path(name)).getPath()
            aside = f"{os.path.dirname(path)}/{uuid.uuid4().hex}.tmp"
            with open(aside, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(aside, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
        try:
            self._write(name, text)
            return True
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            return False

    # ------------------------------------------------------------ tables

    def save(self, df: DataFrame, name: str) -> str:
        """Data files under a fresh name; they count once a commit names it."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    def save_parts(self, df: DataFrame, name: str, column: str) -> dict[str, str]:
        """As ``save``, in a folder for each value of ``column``: value to folder, in one write."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        df.repartition(column).write.partitionBy(column).parquet(f"{self.root}/{path}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(path))]
        return {n.split("=", 1)[1]: f"{path}/{n}" for n in names if "=" in n}

    def open(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def put_files(self, table: str, files: dict[str, list[str]], rows: dict[str, int] | None = None) -> str:
        """A table's paths, and numbers of rows, by bucket, beside the manifest, which only names them."""
        name = f"files/{table}/{uuid.uuid4().hex}.json"
        self._publish_in(name, json.dumps({"files": files, "rows": rows or {}}))
        return name

    def _of_buckets(self, state: dict, table: str, what: str) -> dict:
        name = state["tables"].get(table, {}).get("files")
        found = json.loads(self._read(name)) if name else {}
        return found.get(what, {}) if "files" in found else found if what == "files" else {}

    def files(self, state: dict, table: str) -> dict[str, list[str]]:
        return self._of_buckets(state, table, "files")

    def bucket_rows(self, state: dict, table: str) -> dict[str, int]:
        return self._of_buckets(state, table, "rows")

    def put_json(self, folder: str, value) -> str:
        """A value of a table's or log's size, beside the manifest; its name."""
        name = f"{folder}/{uuid.uuid4().hex}.json"
        self._publish_in(name, json.dumps(value))
        return name

    def get_json(self, name: str):
        return json.loads(self._read(name))

    def _publish_in(self, name: str, text: str) -> bool:
        self._fs.mkdirs(self._path(name).getParent())
        return self._publish(name, text)

    def vacuum(self, age: float = 3600.0) -> int:
        """Delete data that no kept manifest names and whose newest file is older than ``age`` seconds; the number of folders and files.

        Refused while any lease is held, and no other can be taken meanwhile.
        """
        with self.lock("vacuum"):
            named: set[str] = set()
            for n in self._numbers():
                state = json.loads(self._read(f"manifest/{n}.json"))
                named |= {b[k] for b in state["log"] for k in ("path", "index") if k in b} | {r[k] for r in state["runs"] for k in ("results", "diffs")}
                for t, c in state["chunks"].items():
                    if state["tables"].get(t, {}).get("status") != "LOADED":  # afterwards its paths are named one by one
                        named.add(f"data/{t}/{c['load']}")
                for t, s in state["tables"].items():
                    if s.get("files"):
                        named |= {s["files"], *[p.removesuffix("/*") for ps in self.files(state, t).values() for p in ps]}
            prefixes = {p.rsplit("/", i)[0] for p in named for i in range(3)} | named
            gone = 0
            for top in ("data", "files", "index"):
                if not self._fs.exists(self._path(top)):
                    continue
                for table in self._names(top):
                    for one in self._names(f"{top}/{table}"):
                        path = f"{top}/{table}/{one}"
                        inner = path in prefixes and path not in named
                        for p in [f"{path}/{x}" for x in self._names(path) if not x.startswith(("_SUCCESS", "."))] if inner else [path]:
                            if p not in prefixes and time.time() - self._newest_in(p) >= age:
                                self.drop(p)
                                gone += 1
            return gone

    def _newest_in(self, path: str) -> float:
        """When the newest file at or below the path was written."""
        newest, found = self._age_of(path), self._fs.listFiles(self._path(path), True)
        while found.hasNext():
            newest = max(newest, found.next().getModificationTime() / 1000)
        return newest

    def _names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(path))]

    # ------------------------------------------------------------ leases

    @contextmanager
    def lock(self, name: str, seconds: float = LEASE):
        """One holder at a time; gives its ``Lease``.  A holder renews its lease while it lives; that of a killed one runs out, and the next may begin.

        The lease is part of the manifest, so taking it is one commit.  Clocks of the machines that
        share a store must agree to within a few seconds.
        """
        lease, stop = Lease(self, name, seconds), threading.Event()
        self.commit(lease.take)
        thread = threading.Thread(target=lease.keep, args=(stop,), daemon=True)
        thread.start()
        try:
            yield lease
            lease.check()
        finally:
            stop.set()
            thread.join()
            try:
                self.commit(lease.give_back)
            except Exception as e:  # it runs out by itself
                print(f"lease {name}: {type(e).__name__}", file=sys.stderr)

    def held(self, state: dict | None = None) -> list[str]:
        """Names of the leases that have not run out."""
        return sorted(n for n, v in (state or self.manifest()).get("leases", {}).items() if v["until"] > time.time())


class Lease:
    """STR10: a name held under an epoch.  ``commit`` publishes nothing once the lease has run out or has another holder."""

    def __init__(self, store: Store, name: str, seconds: float) -> None:
        self.store, self.name, self.seconds, self.owner = store, name, seconds, uuid.uuid4().hex
        self.epoch, self.until, self.lost = 0, 0.0, threading.Event()

    def take(self, s: dict) -> None:
        now = time.time()
        held = {n: v for n, v in s["leases"].items() if v["until"] > now}
        if self.name in held:
            raise Refused(f"{self.name} is running")
        if held and (self.name in ALONE or any(n in ALONE for n in held)):
            raise Refused(f"{self.name} is not allowed while {', '.join(sorted(held))} runs")
        s["epoch"] = self.epoch = s.get("epoch", 0) + 1
        self.until = now + self.seconds
        s["leases"][self.name] = {"owner": self.owner, "until": self.until, "epoch": self.epoch}

    def _mine(self, s: dict) -> bool:
        return s["leases"].get(self.name, {}).get("epoch") == self.epoch

    def _renew(self, s: dict) -> None:
        if not self._mine(s):
            raise Lost(f"the lease on {self.name} was lost")
        s["leases"][self.name]["until"] = time.time() + self.seconds

    def keep(self, stop: threading.Event) -> None:
        """Renew in time; an error of the file system is met by trying again, another holder ends it."""
        pause = self.seconds / 3
        while not stop.wait(pause):
            try:
                self.until, pause = self.store.commit(self._renew)["leases"][self.name]["until"], self.seconds / 3
            except Lost:
                self.lost.set()
                return
            except Exception:
                pause = self.seconds / 10

    def check(self) -> None:
        """Raises once the lease is known to be lost, or could not be renewed in time."""
        if self.lost.is_set() or time.time() >= self.until:
            raise Lost(f"the lease on {self.name} was lost")

    def commit(self, change: Callable[[dict], object], tries: int = 100) -> dict:
        """As ``Store.commit``, if the state that it replaces still has this lease."""

        def guarded(s: dict) -> None:
            if not self._mine(s) or s["leases"][self.name]["until"] <= time.time():
                raise Lost(f"the lease on {self.name} was lost")
            change(s)

        return self.store.commit(guarded, tries)

    def give_back(self, s: dict) -> None:
        if self._mine(s):
            s["leases"].pop(self.name)


# ---------------------------------------------------------------- job states

#: Names of a job's states.
STATES = ("PLANNED", "SCHEMA_DONE", "LOADING", "SYNCING", "CUTOVER", "VERIFIED", "DONE", "FAILED")
#: WFL2, fixed values: the states from which each command may start.
ALLOWED = {
    "load": ("SCHEMA_DONE", "LOADING", "SYNCING", "FAILED"),
    "sync": ("SCHEMA_DONE", "LOADING", "SYNCING", "FAILED"),
    "cutover": ("SYNCING", "CUTOVER", "VERIFIED", "FAILED"),
}


def require(state: dict, command: str) -> None:
    now = state.get("job", "PLANNED")
    if now not in ALLOWED[command]:
        raise Refused(f"{command} is not allowed while the job is {now}")


def log_event(state: dict, level: str, message: str) -> None:
    state["events"] = [*state.get("events", []), [len(state.get("events", [])) + 1, level, message]][-400:]
