"""What protocols, fields and values a packet table holds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import flat_fields, normalised


def protocols(packets: DataFrame) -> DataFrame:
    layer = packets.select(F.explode("layers").alias("l"))
    return layer.select(F.col("l.protocol").alias("protocol"), F.col("l.protocol_label").alias("full_name")).distinct()


def fields(packets: DataFrame, protocol: str | None = None) -> DataFrame:
    """``qualified_name, protocol, path, kind, optional``: fields seen, and whether some layer lacks one.

    A protocol that is not there gives no rows.
    """
    layers = packets.select("capture_id", "number", F.explode("layers").alias("l"))
    if protocol is not None:
        layers = layers.where(F.col("l.proto_norm") == normalised(protocol))
    totals = layers.groupBy(F.col("l.protocol").alias("protocol")).agg(F.count("*").alias("_all"))
    each = layers.select(F.col("l.protocol").alias("protocol"), F.explode(F.array_distinct(F.transform("l.fields", lambda f: F.struct(f["path"].alias("path"), f["kind"].alias("kind"))))).alias("f"))
    seen = each.groupBy("protocol", "f.path", "f.kind").agg(F.count("*").alias("_n"))
    return seen.join(totals, "protocol").select(F.concat(F.lower("protocol"), F.lit("."), "path").alias("qualified_name"), "protocol", "path", "kind", (F.col("_n") < F.col("_all")).alias("optional"))


def field_nodes(packets: DataFrame, protocol: str | None = None) -> DataFrame:
    """``protocol, path, kind, parent, optional``: fields and the containers above them, each under its parent (null: the layer).

    A node is optional if some occurrence of its parent lacks it: of a list, some element. What a
    layer has is told apart within the layer, so that only counts are shuffled.
    """
    layers = packets.select(F.explode("layers").alias("l"))
    if protocol is not None:
        layers = layers.where(F.col("l.proto_norm") == normalised(protocol))

    def of(f: Column) -> Column:
        steps = F.split(f["path"], r"\.")
        places = lambda k: F.slice(f["elem"], 1, F.when(f["depth"].isNull(), F.least(k, F.size(f["elem"]))).otherwise(F.aggregate(F.slice(f["depth"], 1, k), F.lit(0), lambda a, b: a + b)))
        name = lambda k: F.array_join(F.slice(steps, 1, k), ".")
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(name(k).alias("path"), F.when(k > 1, name(k - 1)).alias("parent"), F.when(k == F.size(steps), f["kind"]).otherwise(F.lit("object")).alias("kind"), places(k - 1).alias("above"), places(k).alias("own")))

    parts = layers.select(F.col("l.protocol").alias("protocol"), F.flatten(F.transform("l.fields", of)).alias("n"))
    distinct = lambda *names: F.array_distinct(F.transform("n", lambda x: F.struct(*(x[n].alias(n) for n in names))))
    under = parts.select("protocol", F.explode(distinct("path", "parent", "above")).alias("x")).groupBy("protocol", "x.path", "x.parent").agg(F.count("*").alias("_n"))
    own = parts.select("protocol", F.explode(distinct("path", "own")).alias("x")).groupBy("protocol", F.col("x.path").alias("parent")).agg(F.count("*").alias("_all"))
    whole = layers.groupBy(F.col("l.protocol").alias("protocol")).agg(F.count("*").alias("_all")).withColumn("parent", F.lit(None).cast("string"))
    kinds = parts.select("protocol", F.explode(distinct("path", "kind")).alias("x")).groupBy("protocol", "x.path").agg(F.min("x.kind").alias("kind"))
    above = own.unionByName(whole)
    same = (F.col("a.protocol") == F.col("b.protocol")) & F.col("a.parent").eqNullSafe(F.col("b.parent"))
    found = under.alias("a").join(above.alias("b"), same).select("a.protocol", "a.path", "a.parent", (F.col("a._n") < F.col("b._all")).alias("optional"))
    return found.join(kinds, ["protocol", "path"]).select("protocol", "path", "kind", "parent", "optional")


def field_trees(packets: DataFrame, protocol: str | None = None) -> DataFrame:
    """``protocol, qualified_name, descriptor``: a JSON text for each field of a layer, with its children in it.

    A descriptor has ``qualified_name, display_name, type, optional, protocol`` and, for a container,
    ``children`` by name. The display name is the name's words. The rows put together are those of
    ``field_nodes``, one a distinct path.
    """

    def build(nodes: pd.DataFrame) -> pd.DataFrame:
        under: dict = {}
        for r in nodes.sort_values("path").to_dict("records"):
            under.setdefault(r["parent"] if isinstance(r["parent"], str) else None, []).append(r)

        def of(r: dict) -> dict:
            name = r["path"].rsplit(".", 1)[-1]
            out = {"qualified_name": f"{r['protocol'].lower()}.{r['path']}", "display_name": name.replace("_", " ").title(), "type": r["kind"], "optional": bool(r["optional"]), "protocol": r["protocol"]}
            children = [of(x) for x in under.get(r["path"], ())]
            return out | ({"children": children} if children else {})

        tops = [of(r) for r in under.get(None, ())]
        return pd.DataFrame([(t["protocol"], t["qualified_name"], json.dumps(t, ensure_ascii=False, separators=(",", ":"))) for t in tops], columns=["protocol", "qualified_name", "descriptor"])

    return field_nodes(packets, protocol).groupBy("protocol").applyInPandas(build, "protocol string, qualified_name string, descriptor string")


def field_paths(packets: DataFrame) -> DataFrame:
    """Distinct qualified paths, without values of values."""
    return flat_fields(packets).where(~F.contains("path", F.lit(".value.value."))).select(F.concat("proto_norm", F.lit("."), "path").alias("path")).distinct()


def field_values(packets: DataFrame, field: str) -> DataFrame:
    """Distinct values of ``protocol.path``; a path ending in ``_name`` gives labels."""
    protocol, _, path = field.partition(".")
    rows = flat_fields(packets).where(F.col("proto_norm") == normalised(protocol))
    plain = rows.where(F.col("path") == path).select(F.coalesce("str", F.col("num").cast("string")).alias("value"))
    if path.endswith("_name"):
        plain = plain.unionByName(rows.where(F.col("path") == path.removesuffix("_name")).select(F.col("name").alias("value")))
    return plain.where("value is not null").distinct()


