"""A fill as a transaction over a table of cells: journal ahead, staging, verification, one atomic step, recovery.

A store is a folder of versions. A version counts from the moment when its small
record, named by its number, is renamed into place; readers take the highest one, so
they see a fill whole or not at all. Each step of an operation is told in a journal
before it begins. What an operation that was killed leaves behind is settled by
``recover``: it ends as done if its version counts, else as failed, with its staging
gone. The versions before stay as backups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots
from .transactions import fingerprint

STEPS = ["begun", "staged", "verified", "committed", "done"]
MISSING = "NOT_AVAILABLE"


class FillError(RuntimeError):
    """A fill that did not happen; ``code`` says why, ``stage`` where."""

    def __init__(self, code: str, stage: str, message: str):
        super().__init__(f"{code} at {stage}: {message}")
        self.code, self.stage, self.message = code, stage, message


@dataclass
class FillStore:
    """Versions of a table of cells (sheet, row, col, value, formula, style) under ``base``, a folder that all machines share."""

    spark: SparkSession
    base: str

    # ------------------------------------------------------------ small files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, *parts: str) -> dict:
        stream = self._fs().open(self._path(*parts))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, value: dict, *parts: str) -> bool:
        """Write a small record under a new name in one step; False if the name is taken."""
        fs, path, temp = self._fs(), self._path(*parts), self._path("temp", uuid.uuid4().hex)
        stream = fs.create(temp)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        fs.mkdirs(path.getParent())
        return not fs.exists(path) and fs.rename(temp, path)

    # --------------------------------------------------------------- versions

    def create(self, cells: DataFrame) -> None:
        """The first version."""
        folder = f"cells-{uuid.uuid4().hex}"
        cells.write.parquet(f"{self.base}/{folder}")
        if not self._put({"folder": folder, "operation": None, "plan": None}, "versions", f"{1:09d}.json"):
            raise FillError("PLAN_CONFLICT", "begun", "the store has versions already")

    def current(self) -> tuple[int, dict]:
        """(number, record) of the version that counts."""
        name = self._list("versions")[-1]
        return int(name[:9]), self._read("versions", name)

    def read(self, number: int | None = None) -> DataFrame:
        """The cells of a version, the newest if none is named."""
        record = self.current()[1] if number is None else self._read("versions", f"{number:09d}.json")
        return self.spark.read.parquet(f"{self.base}/{record['folder']}")

    # ---------------------------------------------------------------- journal

    def tell(self, operation: str, step: str, **facts) -> None:
        at = (STEPS + ["failed"]).index(step)
        self._put({"operation": operation, "step": step, **facts}, "journal", operation, f"{at}-{step}.json")

    def story(self, operation: str) -> list[dict]:
        return [self._read("journal", operation, n) for n in self._list("journal", operation)]

    def operations(self) -> dict[str, str]:
        """The last step of each operation."""
        return {o: self.story(o)[-1]["step"] for o in self._list("journal")}


def filled(cells: DataFrame, writes: DataFrame) -> DataFrame:
    """``cells`` with the values of ``writes`` (sheet, row, col, value), new cells included; formulas and styles stay."""
    keys = ["sheet", "row", "col"]
    new = writes.select(*keys, F.col("value").alias("new"), F.lit(True).alias("hit"))
    out = cells.join(new, keys, "full")
    return out.select(*[F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value") if c == "value" else F.col(c) for c in cells.columns])


def region(cells: DataFrame, writes: DataFrame) -> str:
    """One digest of the planned cells as they stand."""
    own = cells.join(writes.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_semi").withColumn("all", F.lit(1))
    found = fingerprint(own, ["all"], "sheet", F.col("row").cast("string"), F.col("col").cast("string"), F.coalesce("value", F.lit(""))).first()
    return found["fingerprint"] if found else ""


def record_failure(store: FillStore, operation: str, plan: str, error: FillError, before: int, folder: str | None, region_before: str | None) -> dict:
    """Tell how an operation failed: every field is there, and what does not exist is said to be missing."""
    fs = store._fs()
    staged = folder is not None and fs.exists(store._path(folder))
    facts = {
        "plan": plan, "status": "failed", "commit_state": "FAILED", "stage": error.stage, "error_code": error.code, "error_message": error.message[:300],
        "version_before": before, "region_before": region_before or MISSING, "temp": folder if staged else MISSING, "backup": store._read("versions", f"{before:09d}.json")["folder"], "write_count": 0,
    }
    store.tell(operation, "failed", **facts)
    if staged:
        fs.delete(store._path(folder), True)
    return facts


def execute(store: FillStore, plan: str, writes: DataFrame, apply: Callable = filled, fault: Callable[[str], None] = lambda step: None) -> dict:
    """Carry out ``writes`` of a plan that preflight lets pass; returns operation, status, version and write_count.

    A plan whose committed values still stand is not carried out again (status
    already_applied). Any error leaves the newest version as it was, is told in the
    journal and raised as FillError: QA_FAILED if anything but the planned values
    would change, PLAN_CONFLICT if another fill came first. ``fault`` is called after
    each step: tests stop there.
    """
    before, record = store.current()
    cells = store.read(before)
    standing = region(cells, writes)
    for number in range(before, 0, -1):
        old = store._read("versions", f"{number:09d}.json")
        if old["plan"] == plan and old.get("region") == standing:
            return {"operation": old["operation"], "status": "already_applied", "version": number, "write_count": 0}
    operation, folder, stage = f"op-{uuid.uuid4().hex}", f"cells-{uuid.uuid4().hex}", "begun"
    store.tell(operation, "begun", plan=plan, version_before=before, folder=folder, region_before=standing)
    try:
        fault(stage)
        apply(cells, writes).write.parquet(f"{store.base}/{folder}")
        stage = "staged"
        store.tell(operation, stage)
        fault(stage)
        staged = store.spark.read.parquet(f"{store.base}/{folder}")
        found = snapshots.changes(snapshots.snapshot(cells), snapshots.snapshot(staged), writes)
        odd = found.where("status = 'unexpected'").limit(5).collect()
        asked = writes.select("sheet", "row", "col", F.col("value").alias("asked"))
        wrong = asked.join(staged, ["sheet", "row", "col"], "left").where(~F.col("asked").eqNullSafe(F.col("value"))).limit(5).collect()
        if odd or wrong:
            raise FillError("QA_FAILED", stage, "; ".join(f"{r.sheet}!{r.key if 'key' in r else f'R{r.row}C{r.col}'}" for r in [*odd, *wrong]))
        stage = "verified"
        store.tell(operation, stage)
        fault(stage)
        n = writes.count()
        if not store._put({"folder": folder, "operation": operation, "plan": plan, "region": region(staged, writes)}, "versions", f"{before + 1:09d}.json"):
            raise FillError("PLAN_CONFLICT", stage, "another fill came first")
    except Exception as e:
        error = e if isinstance(e, FillError) else FillError("EXECUTION_FAILED", stage, str(e))
        record_failure(store, operation, plan, error, before, folder, standing)
        raise error from e
    store.tell(operation, "committed", version=before + 1)
    fault("committed")
    store.tell(operation, "done", version=before + 1, write_count=n)
    return {"operation": operation, "status": "committed", "version": before + 1, "write_count": n}


def recover(store: FillStore) -> dict[str, str]:
    """Settle what killed operations left: done where their version counts, else failed; returns how each ended."""
    out = {}
    counted = {store._read("versions", n)["operation"]: int(n[:9]) for n in store._list("versions")}
    for operation, step in store.operations().items():
        if step in ("done", "failed"):
            continue
        first = store.story(operation)[0]
        if operation in counted:
            store.tell(operation, "done", version=counted[operation], recovered=True)
            out[operation] = "done"
        else:
            error = FillError("INTERRUPTED", step, "the run ended before its version counted")
            record_failure(store, operation, first["plan"], error, first["version_before"], first["folder"], first["region_before"])
            out[operation] = "failed"
    return out
