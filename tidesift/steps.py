"""Which steps of a run are done: names, fingerprints and results in one small file beside the output."""

from __future__ import annotations

import functools
import hashlib
import json
import pathlib
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from .operators import files


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=list).encode()).hexdigest()


@functools.cache
def code_fingerprint() -> str:
    """Of this package's modules: a step is run again when the code has changed."""
    folder = pathlib.Path(__file__).parent
    return fingerprint([(str(p.relative_to(folder)), p.read_text()) for p in sorted(folder.rglob("*.py"))])


class Steps:
    """The steps done so far. A step leaves the list before its output is touched and comes back when it is complete."""

    def __init__(self, spark: SparkSession, path: str, resume: bool):
        self.spark, self.path = spark, path
        text = files.read_text(spark, path) if resume else None
        self.entries: dict[str, dict] = json.loads(text) if text else {}
        self.reused: list[str] = []

    def _save(self) -> None:
        files.replace_text(self.spark, self.path, json.dumps(self.entries, indent=1, sort_keys=True))

    def done(self, name: str, print_: str, make: Callable[[], object], outputs: Callable[[object], Iterable[str]]):
        """The step's result, made anew unless the list has it with this fingerprint and all its outputs are complete.

        A result must survive JSON; ``outputs`` names the folders that it stands for.
        """
        entry = self.entries.get(name)
        if entry and entry["fingerprint"] == print_ and all(files.complete(self.spark, p) for p in outputs(entry["result"])):
            self.reused.append(name)
            return entry["result"]
        if self.entries.pop(name, None) or not self.entries:
            self._save()
        result = make()
        self.entries[name] = {"fingerprint": print_, "result": result}
        self._save()
        return result
