"""A data set as its manifest describes it: specs, options, defaults and lazy tables, and its tables clustered by entry."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from angula.operators import distribution as D
from angula.sources.tables import counted_write, load_entries, load_family, row_counts
from angula.spec import LEVELS, EntryFilter, FamilySpec, ObsFilter, ParameterSpec, View

# Kinds of options, with their names among the manifest's controls.
OPTIONS = {"form": "form_options", "method": "method_options", "cleanliness": "cleanliness_options", "duplex": "duplex_gate_options", "resolution": "resolution_options", "terminal": "terminal_policy_options"}
#: Parameter of a session that must be off for tables bucketed by pid to be joined by pid and site without a shuffle.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class Defaults:
    """What is shown before anything is chosen."""

    family_id: str
    parameter_id: str
    entries: EntryFilter
    observations: ObsFilter


def parameter_specs(manifest: dict) -> dict[str, ParameterSpec]:
    """By id; a circular parameter without a period turns at 360."""
    out = {}
    for p in manifest.get("parameter_registry") or []:
        span = p.get("display_range_default")
        out[p["param_id"]] = ParameterSpec(p["param_id"], p.get("value_type") == "numeric_circular", float(p.get("period") or 360.0), tuple(map(float, span)) if span else None, p.get("unit") or "")
    return out


def family_specs(manifest: dict) -> dict[str, FamilySpec]:
    """By id. The default contexts that are valid are those of the default family; other families start with all options."""
    params, defaults, out = parameter_specs(manifest), manifest.get("defaults") or {}, {}
    for name, m in (manifest.get("families") or {}).items():
        ids = lambda kind: tuple(o["id"] for o in m.get(f"{kind}_options") or [])  # noqa: E731, B023
        unknown = [p for p in m["param_ids"] if p not in params]
        if unknown:
            raise ValueError(f"{name}: the registry has no parameter {', '.join(unknown)}")
        wanted = defaults.get("contexts") if name == defaults.get("family_id") else None
        out[name] = FamilySpec(
            name, tuple(params[p] for p in m["param_ids"]), LEVELS.get(name, "residue"),
            m.get("context_column"), ids("context"), m.get("context_empty_value") or "",
            m.get("secondary_context_column"), ids("secondary_context"), m.get("secondary_context_empty_value") or "",
            context_default=tuple(c for c in wanted or () if c in ids("context")),
        )
    return out


def default_choice(manifest: dict) -> Defaults:
    d = manifest["defaults"]
    forms = d.get("forms") or [o["id"] for o in (manifest.get("controls") or {}).get("form_options") or []]
    entries = EntryFilter(d.get("cleanliness") or "all", d.get("duplex_gate") or "any", tuple(d["methods"]) if d.get("methods") is not None else None, d.get("resolution") or "any", tuple(forms) or None)
    return Defaults(d["family_id"], d["parameter_id"], entries, ObsFilter(d.get("terminal_policy") or "include"))


def write_clustered(df: DataFrame, path: str, buckets: int, order: tuple[str, ...] = ("pid", "row_index")) -> int:
    """df as Parquet in so many buckets by pid, each one file in the given order; gives the row count, counted while writing."""
    table = "angula_" + hashlib.md5(path.encode()).hexdigest()
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    return counted_write(df.repartition(buckets, "pid"), lambda d: d.write.format("parquet").mode("overwrite").bucketBy(buckets, "pid").sortBy(*order).option("path", path).saveAsTable(table))


def open_clustered(spark: SparkSession, path: str, buckets: int, order: tuple[str, ...] = ("pid", "row_index")) -> DataFrame:
    """What write_clustered() wrote, known by its buckets: joins and groupings by pid (and more) don't shuffle it, a filter by pids
    reads their buckets alone. Turns off, for the session, the rule that joins need all their keys in the partitioning.
    """
    spark.conf.set(CO_PARTITION, "false")
    table = "angula_" + hashlib.md5(path.encode()).hexdigest()
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (pid) SORTED BY ({', '.join(order)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


class Catalog:
    """Specs at once, tables when they are asked for, each made once.

    A family is read from its clustered table if the manifest names one, else from its text file. shared() keeps a table's
    columns for several queries until release().
    """

    def __init__(self, spark: SparkSession, manifest: dict, root: str):
        self.spark, self.manifest, self.root = spark, manifest, root.rstrip("/")
        self.parameters, self._specs = parameter_specs(manifest), family_specs(manifest)
        self.defaults = default_choice(manifest) if manifest.get("defaults") else None
        self._held: dict[str, DataFrame] = {}
        self._shared: dict[tuple, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        """The data set of a manifest; paths in it are relative to its folder. A missing manifest is an error."""
        text = spark.read.text(path, wholetext=True).first()
        if text is None:
            raise ValueError(f"{path} is empty")
        return cls(spark, json.loads(text.value), path.rstrip("/").rpartition("/")[0])

    def at(self, relative: str) -> str:
        return relative if "://" in relative or relative.startswith("/") else f"{self.root}/{relative.removeprefix('./')}"

    def options(self) -> DataFrame:
        """(kind, id, label) of all controls and of the families' contexts, the kind of these being <family>.context or .secondary_context."""
        rows = [(kind, o["id"], o.get("label") or o["id"]) for kind, name in OPTIONS.items() for o in (self.manifest.get("controls") or {}).get(name) or []]
        rows += [(f"{f}.{kind}", o["id"], o.get("label") or o["id"]) for f, m in (self.manifest.get("families") or {}).items() for kind in ("context", "secondary_context") for o in m.get(f"{kind}_options") or []]
        return self.spark.createDataFrame(rows, "kind string, id string, label string")

    def row_counts(self) -> DataFrame:
        """family_id, row_count as the manifest records them."""
        return row_counts(self.spark, {f: int(m.get("row_count") or 0) for f, m in (self.manifest.get("families") or {}).items()})

    def _once(self, key: str, make) -> DataFrame:
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    def entries(self) -> DataFrame:
        files = self.manifest["file_map"]
        if c := files.get("clustered_entries"):
            return self._once("", lambda: open_clustered(self.spark, self.at(c["path"]), c["buckets"], ("pid",)))
        return self._once("", lambda: load_entries(self.spark, self.at(files["pdb_manifest"])))

    def family(self, family_id: str) -> DataFrame:
        m = self.manifest["families"][family_id]
        if c := m.get("clustered"):
            return self._once(family_id, lambda: open_clustered(self.spark, self.at(c["path"]), c["buckets"]))
        return self._once(family_id, lambda: load_family(self.spark, self.at(m["file"]), list(m["param_ids"]), m.get("context_column"), m.get("secondary_context_column")))

    def spec(self, family_id: str) -> FamilySpec:
        """The family's spec; without a site label in its table, rows are matched by their place in the entry."""
        s = self._specs[family_id]
        return s if "site_label" in self.family(family_id).columns else replace(s, site=None)

    def shared(self, family_id: str, *params: str) -> DataFrame:
        """The family with some of its parameters (none named: all), kept in memory and on disk from its first use."""
        s, t = self.spec(family_id), self.family(family_id)
        keep = ["pid", "row_index", "edge_flag", *[c for c in (s.site, s.context, s.secondary) if c], *(params or [p.param_id for p in s.params])]
        key = (family_id, *sorted(params))
        if key not in self._shared:
            self._shared[key] = t.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
        return self._shared[key]

    def release(self) -> None:
        for df in self._shared.values():
            df.unpersist()
        self._shared.clear()

    def _choice(self, family_id: str | None, param: str | None, f: EntryFilter | None, o: ObsFilter | None):
        d = self.defaults
        if (family_id is None or f is None or o is None) and d is None:
            raise ValueError("the manifest has no defaults")
        family_id = family_id or d.family_id
        s = self.spec(family_id)
        param = param or (d.parameter_id if d and family_id == d.family_id else s.params[0].param_id)
        p = next((p for p in s.params if p.param_id == param), None)
        if p is None:
            raise ValueError(f"{family_id} has no parameter {param}")
        return family_id, s, p, f or d.entries, o or d.observations

    def distribution(self, param: str | None = None, family_id: str | None = None, f: EntryFilter | None = None, o: ObsFilter | None = None, v: View | None = None) -> tuple[DataFrame, DataFrame]:
        """(series, summary) of a parameter; what isn't given is the manifest's default."""
        family_id, s, p, f, o = self._choice(family_id, param, f, o)
        return D.distribution(self.entries(), self.family(family_id), s, p, f, o, v or View())

    def overview(self, family_id: str | None = None, f: EntryFilter | None = None, o: ObsFilter | None = None, v: View | None = None) -> tuple[DataFrame, DataFrame]:
        """(series, panels) of all parameters of a family."""
        family_id, s, _, f, o = self._choice(family_id, None, f, o)
        return D.family_overview(self.entries(), self.family(family_id), s, f, o, v or View())

    def clustered(self, path: str, buckets: int) -> Catalog:
        """The same data set with all its tables clustered by pid under path, and a manifest there that names them and their rows.

        buckets: of each table; a bucket is the least that one task reads, and holds whole entries.
        """
        path, m = path.rstrip("/"), json.loads(json.dumps(self.manifest))
        write_clustered(self.entries(), f"{path}/entries", buckets, ("pid",))
        m["file_map"]["clustered_entries"] = {"path": "entries", "buckets": buckets}
        for name, meta in m["families"].items():
            meta["row_count"] = write_clustered(self.family(name), f"{path}/{name}", buckets)
            meta["clustered"] = {"path": name, "buckets": buckets}
        write_manifest(self.spark, m, f"{path}/manifest")
        return Catalog(self.spark, m, path)


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """A folder with the manifest's one file."""
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
