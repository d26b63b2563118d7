"""The JSON interchange document for hypergraphs: nodes, edges, incidences and metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SetGraphError
from ..functions.properties import STRINGS, decode_value, encode_value, no_properties
from ..graph import HGraph, Properties

#: The most objects of a document that is made on the driver.
MOST_OBJECTS = 5_000_000

NETWORK_TYPES = ("undirected", "directed", "asc")


def normalize_dataframe(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weight, attrs: columns beyond these become entries of attrs, null ones with the text nil."""
    rest = [c for c in df.columns if c not in (*keys, "weight", "misc")]
    extra = F.create_map(*(x for c in rest for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("nil"))))).cast(STRINGS) if rest else no_properties()
    attrs = F.map_concat(F.map_filter("misc", lambda k, v: ~k.isin(rest)) if rest else F.col("misc"), extra)
    return df.select(*keys, "weight", attrs.alias("attrs"))


def to_records(graph: HGraph) -> dict[str, DataFrame]:
    """The three tables of a document, for graphs too large for one: write each as JSON lines."""
    return {
        "incidences": normalize_dataframe(graph.incidences, ["edge", "node"]),
        "edges": normalize_dataframe(graph.edges.dataframe(), ["uid"]).withColumnRenamed("uid", "edge"),
        "nodes": normalize_dataframe(graph.nodes.dataframe(), ["uid"]).withColumnRenamed("uid", "node"),
    }


def validate(document: dict) -> dict:
    """The document; raises where it isn't one."""
    if not isinstance(document, dict) or not isinstance(document.get("incidences"), list):
        raise SetGraphError("a document needs a list of incidences")
    if document.get("network-type", "undirected") not in NETWORK_TYPES:
        raise SetGraphError(f"network-type has to be one of {', '.join(NETWORK_TYPES)}")
    for part, needed in (("incidences", ("edge", "node")), ("edges", ("edge",)), ("nodes", ("node",))):
        for record in document.get(part) or []:
            if not isinstance(record, dict) or any(not isinstance(record.get(k), (str, int)) for k in needed):
                raise SetGraphError(f"a record of {part} lacks {' or '.join(needed)}")
            if not isinstance(record.get("weight", 1), (int, float)) or not isinstance(record.get("attrs", {}), dict):
                raise SetGraphError(f"a record of {part} has a weight or attrs of the wrong kind")
    return document


def to_hif(graph: HGraph, filename: str | None = None, network_type: str = "undirected", metadata: dict | None = None) -> dict:
    """The document of a graph of at most MOST_OBJECTS objects; written as one JSON text where a path is given."""
    document: dict = {}
    for part, table in to_records(graph).items():
        rows = table.limit(MOST_OBJECTS + 1).collect()
        if len(rows) > MOST_OBJECTS:
            raise SetGraphError(f"more than {MOST_OBJECTS} {part}; write to_records() instead")
        document[part] = [r.asDict() | {"attrs": {k: decode_value(v) for k, v in r["attrs"].items()}} for r in rows]
    defaults = {"incidences": {"weight": graph.default_cell_weight, "attrs": {}}}
    defaults |= {part: {"attrs": {}} | dict(p.defaults) for part, p in (("edges", graph.edge_properties), ("nodes", graph.node_properties))}
    document["network-type"] = network_type
    document["metadata"] = dict(metadata or {}) | {"default_attrs": defaults} | ({"name": graph.name} if graph.name else {})
    validate(document)
    if filename:
        lines = graph.spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1)
        lines.write.mode("overwrite").text(filename)
    return document


def _id_kind(records: list[dict], key: str) -> str:
    return "bigint" if records and all(isinstance(r[key], int) for r in records) else "string"


def from_hif(spark: SparkSession, hif: dict | None = None, filename: str | None = None) -> HGraph:
    """The graph of a document (a dict, or a JSON text that Spark can read)."""
    if hif is None:
        if filename is None:
            raise SetGraphError("neither a document nor a path")
        hif = json.loads("\n".join(r[0] for r in spark.read.text(filename, wholetext=True).collect()))
    validate(hif)
    metadata = hif.get("metadata") or {}
    defaults = {part: (metadata.get("default_attrs") or {}).get(part) or {} for part in ("incidences", "edges", "nodes")}
    weight = {part: float(d.get("weight", 1)) for part, d in defaults.items()}
    kinds = {"edge": _id_kind(hif["incidences"], "edge"), "node": _id_kind(hif["incidences"], "node")}

    def table(part: str, keys: list[str]) -> DataFrame:
        rows = []
        for at, r in enumerate(hif.get(part) or []):
            ids = [r[k] if kinds[k] == "bigint" else str(r[k]) for k in keys]
            values = {k: v for k, v in r.items() if k not in (*keys, "weight", "attrs")} | dict(r.get("attrs") or {})
            rows.append((at, *ids, None if r.get("weight") is None else float(r["weight"]), {k: encode_value(v) for k, v in values.items()}))
        return spark.createDataFrame(rows, f"_ord long, {', '.join(f'{k} {kinds[k]}' for k in keys)}, weight double, misc map<string,string>")

    graph = HGraph.from_dataframe(table("incidences", ["edge", "node"]), "edge", "node", "weight", "misc", weight["incidences"], "first", "_ord", metadata.get("name"))
    props = {}
    for part, key in (("edges", "edge"), ("nodes", "node")):
        rows = table(part, [key]).drop("_ord").withColumnRenamed(key, "uid").withColumn("weight", F.coalesce("weight", F.lit(weight[part])))
        named = {k: v for k, v in defaults[part].items() if k not in ("weight", "attrs")}
        props[part] = Properties(rows, defaults={"weight": weight[part]}).set_defaults(named) if named else Properties(rows, defaults={"weight": weight[part]})
    from dataclasses import replace

    return replace(graph, edge_properties=props["edges"], node_properties=props["nodes"])


RECORD = T.StructType([T.StructField("edge", T.StringType()), T.StructField("node", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("attrs", STRINGS)])


def read_records(spark: SparkSession, path: str) -> HGraph:
    """A graph from incidence records written as JSON lines (to_records); read in parallel, ids as text."""
    rows = spark.read.schema(RECORD).json(path)
    return HGraph.from_dataframe(rows, "edge", "node", "weight", "attrs")
