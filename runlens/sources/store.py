"""The results store: four relations below one folder, changed together or not at all.

A commit writes new rows, and the keys of rows that go, into folders of its own. Then it writes a snapshot, a small file that lists the folders of all
relations, and renames it to the next number. Readers take the newest snapshot, so they see all of a commit or none of it; what a commit
that died has written is listed nowhere, and the commit is simply done again. Of two commits at a time one fails (``ConflictError``).

Rows are merged with deleted keys when they are read: a key takes away the rows of earlier commits. Deletes name the parents
of rows where they can (an experiment, a run), so they are few and are broadcast; how many there are stands in the snapshot. So a
refresh writes each new row once and no row that stays. ``compact`` folds deletes and many small commits into one folder,
``vacuum`` removes what no snapshot lists.

``experiment``, ``experiment_run`` and ``experiment_event`` are partitioned by suite: queries of a suite read its folders only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from runlens.operators import relational as rel
from runlens.operators.extract.base import clamp
from runlens.operators.relational import ConstraintError
from runlens.schemas import FOREIGN_KEYS, PRIMARY_KEYS, RELATIONS
from runlens.session import BROADCAST_BYTES, BROADCAST_ROWS, key_side, measure

PARENT_FIRST = ("system", "experiment", "experiment_run", "experiment_event")
BY_SUITE = ("experiment", "experiment_run", "experiment_event")


def stored_schema(name: str) -> T.StructType:
    """Columns of a relation in the store; runs and events carry the suite they belong to."""
    schema = RELATIONS[name]
    if name in BY_SUITE and "suite" not in schema.fieldNames():
        return T.StructType([*schema.fields, T.StructField("suite", T.StringType(), False)])
    return schema


class ConflictError(RuntimeError):
    """Another commit took the number of this one."""


@dataclass
class Change:
    """What a commit does to a relation: rows that come, and values of columns whose rows go."""

    rows: DataFrame | None = None
    gone: dict[str, DataFrame] = field(default_factory=dict)
    replaces: bool = False


class ResultsStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- snapshots ---------------------------------------------------------------------------

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        fs, target = self._fs(), self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def versions(self) -> list[int]:
        """Numbers of the snapshots there are."""
        return sorted(int(n[:-5]) for n in self._list(f"{self.root}/_snapshots") if n.endswith(".json"))

    def _snapshot(self, version: int) -> dict:
        """Folders per relation: ``data`` as [commit, folder], ``gone`` by column as [commit, folder, rows, bytes]."""
        stream = self._fs().open(self._path(f"{self.root}/_snapshots/{version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict]:
        versions = self.versions()
        return (versions[-1], self._snapshot(versions[-1])) if versions else (0, {})

    def _switch(self, version: int, snapshot: dict) -> None:
        """Make a snapshot the current one, by a rename that does not replace."""
        jvm, target = self.spark.sparkContext._jvm, f"{self.root}/_snapshots/{version:08d}.json"
        draft = self._path(f"{self.root}/_snapshots/.{version:08d}-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, self._path(target), none)
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"snapshot {version} was taken meanwhile") from e
            raise

    # -- folders -----------------------------------------------------------------------------

    def _folder(self, name: str, commit: int, part: str, column: str | None = None) -> str:
        return f"{self.root}/{name}{f'-gone-{column}' if column else ''}/commit={commit}/part={part}"

    def exists(self, name: str) -> bool:
        return name in self._current()[1]

    def create(self) -> None:
        """Create what is absent, parents first."""
        version, snapshot = self._current()
        absent = {n: {"data": [], "gone": {}} for n in PARENT_FIRST if n not in snapshot}
        if absent:
            self._switch(version + 1, snapshot | absent)

    def drop(self) -> None:
        """Remove everything, the snapshots first."""
        self._fs().delete(self._path(f"{self.root}/_snapshots"), True)
        for name in reversed(PARENT_FIRST):
            for folder in self._folders(name):
                self._fs().delete(self._path(folder), True)

    def _folders(self, name: str) -> list[str]:
        return [f"{self.root}/{f}" for f in self._list(self.root) if f == name or f.startswith(f"{name}-gone-")]

    # -- rows --------------------------------------------------------------------------------

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """Rows of a relation in the newest snapshot, or in an earlier one that was kept."""
        return self._rows(name, (self._current()[1] if version is None else self._snapshot(version))[name])

    def _scan(self, name: str, folders: list) -> DataFrame:
        """Rows of some commits, with the number of the commit."""
        schema = stored_schema(name)
        if not folders:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("commit", T.IntegerType())]))
        read = T.StructType([*schema.fields, T.StructField("commit", T.IntegerType()), T.StructField("part", T.StringType())])
        paths = [self._folder(name, c, p) for c, p in folders]
        return self.spark.read.schema(read).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.fieldNames(), "commit")

    def _rows(self, name: str, entry: dict) -> DataFrame:
        found = self._scan(name, entry["data"])
        for column, folders in entry["gone"].items():
            kind = stored_schema(name)[column].dataType.simpleString()
            keys = self.spark.read.schema(f"key {kind}, commit int, part string").option("basePath", f"{self.root}/{name}-gone-{column}")
            keys = keys.parquet(*[self._folder(name, c, p, column) for c, p, _, _ in folders])
            last = keys.groupBy("key").agg(F.max("commit").alias("until"))
            if sum(n for _, _, n, _ in folders) <= BROADCAST_ROWS and sum(b for *_, b in folders) <= BROADCAST_BYTES:
                last = F.broadcast(last)
            found = found.join(last, (F.col(column) == F.col("key")) & (F.col("commit") < F.col("until")), "left_anti")
        return found.select(*stored_schema(name).fieldNames())

    def _write(self, df: DataFrame, name: str, path: str) -> None:
        schema = stored_schema(name)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        rows = (clamp(df) if name == "experiment_event" else df).select(*columns)
        if name in BY_SUITE:
            # rows of a suite meet in few files; large suites are split again
            rows.hint("rebalance", "suite").write.partitionBy("suite").parquet(path)
        else:
            rows.write.parquet(path)

    def _commit(self, changes: dict[str, Change], check=None) -> None:
        """Write the changes, check them, switch. ``check`` gets the new rows as written, per relation. Runs jobs."""
        version, old = self._current()
        commit, part, snapshot, fresh, written = version + 1, uuid.uuid4().hex, dict(old), {}, []
        try:
            for name, change in changes.items():
                entry = {"data": [], "gone": {}} if change.replaces else json.loads(json.dumps(old[name]))
                for column, keys in change.gone.items():
                    written.append(self._folder(name, commit, part, column))
                    keys.select(F.col(keys.columns[0]).alias("key")).distinct().write.parquet(written[-1])
                    rows, size = measure(self.spark.read.parquet(written[-1]))
                    if rows:
                        entry["gone"].setdefault(column, []).append([commit, part, rows, size])
                if change.rows is not None:
                    written.append(self._folder(name, commit, part))
                    self._write(change.rows, name, written[-1])
                    entry["data"].append([commit, part])
                    fresh[name] = self._scan(name, [[commit, part]]).drop("commit")
                snapshot[name] = entry
            if check is not None:
                # what was there, without the rows that go
                left = {n: self._rows(n, {"data": old[n]["data"], "gone": snapshot[n]["gone"]}) for n in PARENT_FIRST if n in old}
                check(fresh, left)
        except Exception:
            for path in written:
                self._fs().delete(self._path(path), True)
            raise
        self._switch(commit, snapshot)

    # -- maintenance -------------------------------------------------------------------------

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows that are known to be sound; ``insert`` checks them first."""
        self._commit({name: Change(rows)})

    def insert(self, name: str, rows: DataFrame) -> None:
        """Insert one or many rows, all or none.

        Rows are written and checked before they are listed: keys must be new, unique and set, required
        columns set, and parents there; else ``ConstraintError``. Runs jobs.
        """
        self._commit({name: Change(rows)}, lambda fresh, left: self._check(name, fresh, left))

    def _check(self, name: str, fresh: dict[str, DataFrame], left: dict[str, DataFrame]) -> None:
        """Rules for the new rows of a relation, given all new rows and those that stay."""
        new, key = fresh[name], PRIMARY_KEYS[name]
        rel.require_unique(new, key, name)
        known = left[name].join(new.select(key), key, "left_semi")  # written, so its size is known
        if taken := [r[0] for r in known.select(key).take(5)]:
            raise ConstraintError(f"{name}: {key} taken, e.g. {taken}")
        required = [f.name for f in stored_schema(name).fields if not f.nullable]
        if holes := [r["column"] for r in rel.null_violations(new, required).collect()]:
            raise ConstraintError(f"{name}: null in {holes}")
        if name in FOREIGN_KEYS:
            child, parent, parent_key, _ = FOREIGN_KEYS[name]
            parents = left[parent].select(parent_key)
            if parent in fresh:
                parents = parents.unionByName(fresh[parent].select(parent_key))
            if missing := [r[0] for r in rel.orphans(new, parents, child, parent_key).select(child).take(5)]:
                raise ConstraintError(f"{name}: no {parent} for {child}, e.g. {missing}")

    def insert_missing(self, name: str, rows: DataFrame) -> None:
        self._commit({name: Change(rel.missing_rows(self.read(name), rows))})

    def update(self, name: str, rows: DataFrame) -> None:
        """Set all non-key columns of the rows with matching keys. Events can not be changed.

        Only changed rows are written; a row that changes its suite moves with it.
        """
        if name == "experiment_event":
            raise NotImplementedError("events are immutable")
        key = PRIMARY_KEYS[name]
        hit = self.read(name).join(key_side(rows.select(key)), key, "left_semi")
        self._commit({name: Change(rel.update_by_key(hit, rows, key), {key: hit.select(key)})})

    def delete(self, name: str, victims: DataFrame) -> None:
        """Delete by key, following the delete rules of the references."""
        doomed = self.read(name).join(key_side(victims.select("id")), "id", "left_semi").select("id")
        if name == "system":
            held = rel.restrict_violations(doomed, self.read("experiment"), "id", "system")
            blocked = [r["id"] for r in held.select("id").limit(5).collect()]
            if blocked:
                raise ConstraintError(f"systems still in use, e.g. {blocked}")
        if doomed.isEmpty():
            return
        changes = {name: Change(gone={"id": doomed})}
        if name == "experiment":
            changes |= self._children_of(doomed)
        elif name == "experiment_run":
            changes["experiment_event"] = Change(gone={"experiment_run_id": doomed})
        self._commit(changes)

    def _children_of(self, experiments: DataFrame) -> dict[str, Change]:
        """Runs and events that go with experiments (ids), named by their parents."""
        parents = key_side(experiments.select(F.col("id").alias("experiment_id")))
        runs = self.read("experiment_run").join(parents, "experiment_id", "left_semi").select("id")
        return {"experiment_run": Change(gone={"experiment_id": parents}), "experiment_event": Change(gone={"experiment_run_id": runs})}

    def refresh_suites(
        self, systems: DataFrame, experiments: DataFrame, runs: DataFrame, events: DataFrame
    ) -> None:
        """Replace the given experiments with their runs and events, all or nothing. Doing it twice is doing it once.

        Experiments of the same suites that are not part of this import stay. Each new row is written once, no other row
        is. Before the switch, the new rows of all relations are checked as in ``insert``; ids are looked for among the
        rows of the same suites only, where ids made of names and files can meet. Runs jobs.
        """
        names = experiments.select("suite").distinct()
        known = self.read("experiment").join(key_side(experiments.select("id")), "id", "left_semi").select("id")
        children = self._children_of(known)
        changes = {
            "system": Change(rel.missing_rows(self.read("system"), systems)),
            "experiment": Change(experiments, {"id": known}),
            "experiment_run": Change(runs, children["experiment_run"].gone),
            "experiment_event": Change(events, children["experiment_event"].gone),
        }

        def check(fresh: dict[str, DataFrame], left: dict[str, DataFrame]) -> None:
            suites = F.broadcast(names) if measure(names)[0] <= BROADCAST_ROWS else names
            near = {n: df.join(suites, "suite", "left_semi") if n in BY_SUITE else df for n, df in left.items()}
            for name in PARENT_FIRST:
                self._check(name, fresh, near)

        self._commit(changes, check)

    def compact(self, names: tuple[str, ...] = PARENT_FIRST) -> None:
        """Rewrite relations that have deletes or several commits, as one folder each; one commit. Runs jobs."""
        snapshot = self._current()[1]
        worn = [n for n in names if snapshot[n]["gone"] or len(snapshot[n]["data"]) > 1]
        if worn:
            self._commit({n: Change(self._rows(n, snapshot[n]), replaces=True) for n in worn})

    def vacuum(self, keep: int = 1) -> None:
        """Forget all snapshots but the last ``keep``, and remove the folders that none of those lists.

        Not while others write, as folders of a commit under way are not listed yet.
        """
        versions = self.versions()
        for version in versions[:-keep]:
            self._fs().delete(self._path(f"{self.root}/_snapshots/{version:08d}.json"), False)
        listed = set()
        for version in versions[-keep:]:
            for name, entry in self._snapshot(version).items():
                listed |= {self._folder(name, c, p) for c, p in entry["data"]}
                listed |= {self._folder(name, c, p, column) for column, folders in entry["gone"].items() for c, p, *_ in folders}
        for name in PARENT_FIRST:
            for base in self._folders(name):
                for commit in self._list(base):
                    for part in self._list(f"{base}/{commit}"):
                        if f"{base}/{commit}/{part}" not in listed:
                            self._fs().delete(self._path(f"{base}/{commit}/{part}"), True)

    # -- constraints -------------------------------------------------------------------------

    def violations(self) -> dict[str, DataFrame]:
        """Rows that break a key, null or reference rule, per rule; all frames are empty in a sound store."""
        found: dict[str, DataFrame] = {}
        for name in PARENT_FIRST:
            table = self.read(name)
            found[f"{name}.unique"] = rel.duplicate_keys(table, [PRIMARY_KEYS[name]])
            required = [f.name for f in stored_schema(name).fields if not f.nullable]
            found[f"{name}.not_null"] = rel.null_violations(table, required)
            if name in FOREIGN_KEYS:
                child, parent, parent_key, _ = FOREIGN_KEYS[name]
                found[f"{name}.references"] = rel.orphans(table, self.read(parent), child, parent_key)
        return found
