"""Deployment by descriptors: a `.control` file names the data, its format and its table.

Keys: file (relative to the descriptor), type (json, csv, parquet), table, firstRowId (accepted, not needed),
columnType.<column>, defaultColumnType, autoFlatten (comma-separated fields). A loaded descriptor gets a `.ready`
file beside it, one that cannot be loaded a `.failure` file with the reason.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from lattica.errors import LoadError
from lattica.plans.tree import STRING
from lattica.sources import ingest
from lattica.sources.catalog import Catalog


@dataclass(frozen=True)
class Descriptor:
    file: str
    type: str
    table: str
    types: dict[str, str] = field(default_factory=dict)
    default_type: str = STRING
    auto_flatten: tuple[str, ...] = ()


def parse_descriptor(text: str, folder: str = "") -> Descriptor:
    """`key=value` lines; `#` and `!` begin comments."""
    values: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, mark, value = line.partition("=")
            if not mark:
                raise LoadError(f"no value in line {line!r}")
            values[key.strip()] = value.strip()
    for key in ("file", "type", "table"):
        if not values.get(key):
            raise LoadError(f"{key} is missing")
    if values["type"] not in ingest.FORMATS:
        raise LoadError(f"there is no format {values['type']}")
    if "firstRowId" in values and not values["firstRowId"].isdigit():
        raise LoadError("firstRowId is no number")
    known = {"file", "type", "table", "firstRowId", "defaultColumnType", "autoFlatten"}
    types = {k.removeprefix("columnType."): v for k, v in values.items() if k.startswith("columnType.")}
    unknown = [k for k in values if k not in known and not k.startswith("columnType.")]
    if unknown:
        raise LoadError(f"unknown keys: {', '.join(unknown)}")
    file = values["file"]
    path = file if "://" in file or file.startswith("/") or not folder else str(Path(folder) / file)
    flat = tuple(x.strip() for x in values.get("autoFlatten", "").split(",") if x.strip())
    return Descriptor(path, values["type"], values["table"], types, values.get("defaultColumnType", STRING), flat)


#: How often a descriptor is tried; its data may still be on the way.
TRIES = 5


class Deployment:
    """Keeps a catalog in step with the descriptors of a folder, at each ``scan`` or, after ``watch``, by itself.

    A descriptor that cannot be loaded is tried again at the next scans, ``TRIES`` times in all, and again once it
    changes.
    """

    def __init__(self, catalog: Catalog, folder: str):
        self.catalog, self.folder = catalog, Path(folder)
        self._loaded: dict[Path, tuple[str, DataFrame]] = {}
        self._failed: dict[Path, tuple[float, int]] = {}
        self._stop, self._watcher, self._lock = threading.Event(), None, threading.Lock()

    def watch(self, seconds: float = 1.0) -> None:
        """Scan every so often on a thread of its own, until ``stop``."""
        if self._watcher is None:
            self._stop.clear()

            def run() -> None:
                while not self._stop.wait(seconds):
                    self.scan()

            self._watcher = threading.Thread(target=run, daemon=True)
            self._watcher.start()

    def stop(self) -> None:
        self._stop.set()
        if self._watcher is not None:
            self._watcher.join()
            self._watcher = None

    def scan(self) -> None:
        """Load new descriptors and unload those that are gone."""
        with self._lock:
            there = sorted(self.folder.glob("*.control"))
            for path in [p for p in self._loaded if p not in there]:
                self.unload(path)
            for path in there:
                changed, tries = self._failed.get(path, (0.0, 0))
                if path not in self._loaded and (tries < TRIES or changed != path.stat().st_mtime):
                    self.load(path)

    def load(self, path: Path) -> None:
        ready, failure = path.with_suffix(".ready"), path.with_suffix(".failure")
        ready.unlink(missing_ok=True)
        failure.unlink(missing_ok=True)
        try:
            d = parse_descriptor(path.read_text(), str(path.parent))
            df = ingest.read(self.catalog.spark, d.type, d.file, d.types, d.default_type)
            self.catalog.add(d.table, df)
            for f in d.auto_flatten:
                self.catalog.prepare_flatten(d.table, f)
        except Exception as e:  # the reason goes to the file; the folder's other tables stay
            changed, tries = self._failed.get(path, (0.0, 0))
            now = path.stat().st_mtime
            self._failed[path] = (now, tries + 1 if changed == now else 1)
            failure.write_text(f"{type(e).__name__}: {e}\n")
            return
        self._failed.pop(path, None)
        self._loaded[path] = (d.table, df)
        ready.write_text("")

    def unload(self, path: Path) -> None:
        table, df = self._loaded.pop(path)
        self.catalog.remove_part(table, df)
        path.with_suffix(".ready").unlink(missing_ok=True)
