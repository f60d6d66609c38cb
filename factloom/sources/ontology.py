"""Ontologies: node kinds, relations and their properties, from a YAML mapping; checked, then given as three small tables."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

# Property types (with [] for an array of one level) and the sources of a property.
TYPES = ["STRING", "INT64", "INT32", "INT16", "INT8", "UINT64", "UINT32", "UINT16", "UINT8", "DOUBLE", "FLOAT", "BOOLEAN", "TIMESTAMP", "DATE", "INTERVAL", "BLOB"]
SOURCES = ["umls", "gleif", "llm", "pipeline"]


class OntologyError(ValueError):
    """The mapping isn't an ontology."""


def _known(kind: type, given: object, where: str) -> dict:
    """given, if it is a mapping with no keys but kind's."""
    if not isinstance(given, dict):
        raise OntologyError(f"{where} must be a mapping")
    strange = set(given) - {f.name for f in fields(kind)}
    if strange:
        raise OntologyError(f"{where} has unknown keys {sorted(map(str, strange))}")
    return given


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    source: str
    primary_key: bool = False
    optional: bool = False
    pipeline_field: str | None = None
    hint: str = ""

    def __post_init__(self) -> None:
        if self.type.removesuffix("[]").strip() not in TYPES:
            raise OntologyError(f"property {self.name}: unknown type {self.type}")
        if self.source not in SOURCES:
            raise OntologyError(f"property {self.name}: unknown source {self.source}")
        if self.source == "pipeline" and not self.pipeline_field:
            raise OntologyError(f"property {self.name}: a pipeline property needs its pipeline_field")


@dataclass(frozen=True)
class Node:
    properties: list[Property]
    description: str = ""
    sem_group: str = ""
    semantic_types: list[str] = field(default_factory=list)
    umls_vocabs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        keys = [p.type for p in self.properties if p.primary_key]
        if len(keys) != 1 or keys[0].endswith("[]"):
            raise OntologyError(f"a node has one scalar primary key, not {keys}")


@dataclass(frozen=True)
class Relation:
    rel_type: str
    from_node: str
    from_field: str
    to_node: str
    to_field: str
    from_hint: str = ""
    to_hint: str = ""
    extract_prompt: str = ""
    examples: list[dict] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)


@dataclass(frozen=True)
class Ontology:
    nodes: dict[str, Node]
    relationships: list[Relation]

    def __post_init__(self) -> None:
        for r in self.relationships:
            for end in (r.from_node, r.to_node):
                if end not in self.nodes:
                    raise OntologyError(f"relation {r.rel_type}: node {end} isn't defined")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """nodes, properties (owner_kind node or relation) and relations: a row for each definition."""
        owned = [("node", k, p) for k, n in self.nodes.items() for p in n.properties] + [("relation", r.rel_type, p) for r in self.relationships for p in r.properties]
        return {
            "nodes": spark.createDataFrame(
                [(k, n.description, n.sem_group, n.semantic_types, n.umls_vocabs) for k, n in self.nodes.items()],
                "label string, description string, sem_group string, semantic_types array<string>, umls_vocabs array<string>",
            ),
            "properties": spark.createDataFrame(
                [(kind, owner, p.name, p.type, p.source, p.primary_key, p.optional, p.pipeline_field, p.hint) for kind, owner, p in owned],
                "owner_kind string, owner string, name string, type string, source string, primary_key boolean, optional boolean, pipeline_field string, hint string",
            ),
            "relations": spark.createDataFrame(
                [(r.rel_type, r.from_node, r.from_field, r.from_hint, r.to_node, r.to_field, r.to_hint, r.extract_prompt) for r in self.relationships],
                "rel_type string, from_node string, from_field string, from_hint string, to_node string, to_field string, to_hint string, extract_prompt string",
            ),
        }


def _make(kind: type, given: object, where: str, **parts: object):
    try:
        return kind(**{**_known(kind, given, where), **parts})
    except TypeError as e:
        raise OntologyError(f"{where}: {e}") from e


def _properties(given: object, where: str) -> list[Property]:
    return [_make(Property, p, f"{where}, property {i}") for i, p in enumerate(given or [])]


def ontology(given: object) -> Ontology:
    """Checked; unknown keys and relations of undefined nodes raise OntologyError."""
    top = _known(Ontology, given, "the ontology")
    nodes = {k: _make(Node, n, f"node {k}", properties=_properties(n.get("properties") if isinstance(n, dict) else None, f"node {k}")) for k, n in _known_names(top.get("nodes")).items()}
    rels = [_make(Relation, r, f"relation {i}", properties=_properties(r.get("properties") if isinstance(r, dict) else None, f"relation {i}")) for i, r in enumerate(top.get("relationships") or [])]
    return Ontology(nodes, rels)


def _known_names(nodes: object) -> dict:
    if not isinstance(nodes, dict):
        raise OntologyError("nodes must be a mapping")
    return nodes


def read_ontology(spark: SparkSession, path: str) -> Ontology:
    """From a YAML file, read by Spark, so that the path may be in any store."""
    import yaml

    found = spark.read.text(path, wholetext=True).first()
    return ontology(yaml.safe_load(found[0]) if found else None)
