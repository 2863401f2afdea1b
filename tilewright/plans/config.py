"""Job specifications: dataclasses, YAML and command-line parsing, validation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..functions.envelope import RELATIONS
from ..operators.progressive import ALGORITHMS, SCHEMES, WEIGHTS

#: Names of the interface.
THETAS = ("max", "min", "avg", "avg2", "none")
GRIDS = ("KDBTREE", "QUADTREE")
ENTITIES = ("SPATIAL_ENTITY", "SPATIOTEMPORAL_ENTITY", "PREPARED_ENTITY", "DECOMPOSED_ENTITY", "INDEXED_DECOMPOSED_ENTITY")
APPROXIMATIONS = ("FINEGRAINED_ENVELOPES", "MBR")
FILE_TYPES = ("nt", "csv", "tsv", "shp", "geojson")


def file_kind(path: str, file_type: str | None = None) -> str | None:
    """The kind of a path's files by its extension; none for a directory."""
    name = path.rstrip("/").rpartition("/")[2]
    return (file_type or (name.rpartition(".")[2] if "." in name and not path.endswith("/") else "")).lower() or None


@dataclass(frozen=True)
class Dataset:
    path: str
    id_field: str | None = None
    geometry_field: str | None = None
    date_field: str | None = None
    date_pattern: str | None = None
    file_type: str | None = None

    def problems(self) -> list[str]:
        kind = file_kind(self.path, self.file_type)
        out = []
        if kind is None:  # a directory: its files tell, when they are read
            return out
        if kind not in FILE_TYPES:
            out.append(f"{self.path}: no reader for {kind!r}")
        if kind in ("csv", "tsv"):
            out += [f"{self.path}: {n} must be a column number" for n, v in (("id", self.id_field), ("geometry", self.geometry_field)) if not str(v or "").isdigit()]
        elif kind in ("shp", "geojson") and not self.id_field:
            out.append(f"{self.path}: an id field is needed")
        return out


@dataclass(frozen=True)
class Job:
    source: Dataset | None = None
    target: Dataset | None = None
    relation: str = "DE9IM"
    partitions: int = -1
    theta: str = "avg"
    main_weight: str = "JS"
    secondary_weight: str | None = None
    scheme: str = "SIMPLE"
    grid: str = "QUADTREE"
    budget: int = 0
    algorithm: str = "PROGRESSIVE_GIANT"
    entity: str = "SPATIAL_ENTITY"
    approximation: str = "MBR"
    decomposition: float | None = None
    batch_size: int = 10_000
    violations: int = 3
    precision_limit: float = 0.1
    total_verifications: int | None = None
    qualifying_pairs: int | None = None
    geometry_predicate: str | None = None
    export: str | None = None
    stats: bool = False
    unknown: tuple[str, ...] = field(default=())

    def problems(self) -> list[str]:
        checks = (("relation", self.relation, RELATIONS), ("theta", self.theta, THETAS), ("mwf", self.main_weight, WEIGHTS), ("ws", self.scheme, SCHEMES), ("gt", self.grid, GRIDS), ("pa", self.algorithm, ALGORITHMS), ("et", self.entity, ENTITIES), ("gat", self.approximation, APPROXIMATIONS))
        out = [f"{k}: {v!r} is none of {', '.join(all_)}" for k, v, all_ in checks if v not in all_]
        if self.secondary_weight and self.secondary_weight not in WEIGHTS:
            out.append(f"swf: {self.secondary_weight!r} is none of {', '.join(WEIGHTS)}")
        out += [f"unknown option {u}" for u in self.unknown]
        for d in (self.source, self.target):
            out += d.problems() if d else []
        return out


#: Command-line options and the fields that they set.
FLAGS = {
    "p": ("partitions", int), "partitions": ("partitions", int), "relation": ("relation", str), "geometryPredicate": ("geometry_predicate", str), "gt": ("grid", str), "export": ("export", str),
    "et": ("entity", str), "gat": ("approximation", str), "b": ("budget", int), "budget": ("budget", int), "pa": ("algorithm", str), "mwf": ("main_weight", str), "swf": ("secondary_weight", str),
    "ws": ("scheme", str), "tv": ("total_verifications", int), "qp": ("qualifying_pairs", int), "dcmpT": ("decomposition", float), "batchSize": ("batch_size", int), "violations": ("violations", int),
    "precisionLimit": ("precision_limit", float), "theta": ("theta", str),
}
#: Keys of the YAML file's `configurations`.
KEYS = {"thetaGranularity": "theta", "theta": "theta", "partitions": "p", "relation": "relation", "gridType": "gt", "budget": "b", "progressiveAlgorithm": "pa", "mainWF": "mwf", "secondaryWF": "swf", "ws": "ws", "entityType": "et", "decompositionThreshold": "dcmpT", "batchSize": "batchSize", "violations": "violations", "precisionLimit": "precisionLimit"}


def from_arguments(arguments: list[str]) -> tuple[dict[str, Any], str | None]:
    """Fields set by command-line options, and the configuration file's path."""
    out: dict[str, Any] = {"unknown": ()}
    conf, at = None, 0
    while at < len(arguments):
        name = arguments[at].lstrip("-")
        if name == "stats":
            out["stats"] = True
            at += 1
            continue
        value = arguments[at + 1] if at + 1 < len(arguments) else ""
        if name in ("c", "conf"):
            conf = value
        elif name in ("source", "target"):
            out[name] = Dataset(value)
        elif name in FLAGS:
            out[FLAGS[name][0]] = FLAGS[name][1](value)
        else:
            out["unknown"] += (arguments[at],)
        at += 2
    return out, conf


def from_mapping(tree: dict[str, Any]) -> dict[str, Any]:
    """Fields of a parsed YAML file: source, target, relation, configurations."""
    out: dict[str, Any] = {}
    for side in ("source", "target"):
        if d := tree.get(side):
            text = lambda k: None if d.get(k) is None else str(d[k])  # noqa: B023, E731
            out[side] = Dataset(str(d["path"]), text("realIdField"), text("geometryField"), text("dateField"), text("datePattern"), text("fileType"))
    if tree.get("relation"):
        out["relation"] = tree["relation"]
    unknown = ()
    for key, value in (tree.get("configurations") or {}).items():
        flag = KEYS.get(key, key)
        if flag in FLAGS:
            out[FLAGS[flag][0]] = FLAGS[flag][1](value)
        else:
            unknown += (key,)
    return out | ({"unknown": unknown} if unknown else {})


def parse(arguments: list[str]) -> Job:
    """A job from command-line options over the YAML file that they name; raises ValueError with all problems."""
    given, conf = from_arguments(arguments)
    base: dict[str, Any] = {}
    if conf:
        import yaml

        base = from_mapping(yaml.safe_load(Path(conf).read_text()))
    unknown = base.pop("unknown", ()) + given.pop("unknown", ())
    job = replace(Job(), **(base | given), unknown=unknown)
    if job.algorithm == "EARLY_STOPPING":
        job = replace(job, scheme="THIN_MULTI_COMPOSITE", main_weight="JS", secondary_weight="JS")
    if job.entity in ("DECOMPOSED_ENTITY", "INDEXED_DECOMPOSED_ENTITY") and job.decomposition is None:
        job = replace(job, decomposition=1.0)
    if problems := job.problems():
        raise ValueError("; ".join(problems))
    return job
