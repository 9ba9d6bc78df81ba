"""From texts to a graph: chunks, extraction by a provider (cached by chunk), resolution, publication."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolve import resolve
from tessera.plans.ontology import Ontology
from tessera.sources.files import chunks, uncached

RESPONSE = (
    "struct<nodes:array<struct<id:string,type:string,name:string,summary:string,props:map<string,string>,valid_from:string,valid_to:string>>,"
    "edges:array<struct<type:string,from:string,to:string,description:string,props:map<string,string>,valid_from:string,valid_to:string>>,aliases:map<string,array<string>>>"
)
Provider = Callable[[str], str]


def recovered(raw: str) -> str | None:
    """The first JSON object in a reply, whatever stands around it: fences, prose, commas before a closing bracket; None if there is none."""
    text = re.sub(r"```(?:json)?", "", raw or "")
    begin = text.find("{")
    while begin >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(begin, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
                continue
            quoted = c == '"'
            depth += (c in "{[") - (c in "}]")
            if not depth and c in "}]":
                for candidate in (text[begin : i + 1], re.sub(r",(\s*[}\]])", r"\1", text[begin : i + 1])):
                    try:
                        return json.dumps(json.loads(candidate), ensure_ascii=False)
                    except ValueError:
                        pass
                break
        begin = text.find("{", begin + 1)
    return None


def email_rules(text: str) -> str:
    """A provider without a network: people and their mail hosts, from addresses in the text."""
    found = sorted(set(re.findall(r"([a-z0-9.]+)@([a-z0-9]+)\.example\.com", text)))
    nodes = [{"id": f"user:{u}", "type": "person", "name": u} for u in sorted({u for u, _ in found})] + [{"id": f"group:{h}", "type": "team", "name": h} for h in sorted({h for _, h in found})]
    return json.dumps({"nodes": nodes, "edges": [{"type": "member_of", "from": f"user:{u}", "to": f"group:{h}"} for u, h in found], "aliases": {}})


def replies(cut: DataFrame, provider: Provider) -> DataFrame:
    """(hash, reply, error): the provider's reply to each chunk as JSON, or why there is none. One failed chunk fails no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, text in zip(pdf["hash"], pdf["text"], strict=True):
                try:
                    reply = recovered(provider(text))
                    out.append((h, reply, None if reply else "no JSON in the reply"))
                except Exception as e:  # noqa: BLE001  a provider can fail in any way; the error is part of the result
                    out.append((h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["hash", "reply", "error"])

    return cut.select("hash", "text").dropDuplicates(["hash"]).mapInPandas(run, "hash string, reply string, error string")


def prefixed(id_: Column, type_: Column, ontology: Ontology) -> Column:
    """An id with its type's prefix, whatever prefix it came with."""
    prefix = F.element_at(F.create_map(*[x for t, v in ontology.node_types.items() for x in (F.lit(t), F.lit(v[0]))]), type_)
    return F.concat(F.coalesce(prefix, type_), F.lit(":"), F.regexp_replace(id_, "^[^:]*:", ""))


def candidates(cut: DataFrame, answered: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate nodes, edges and names (canonical_name, variants) from replies; unknown types are dropped, ids get their type's prefix."""
    r = cut.join(answered.where("reply is not null").select("hash", F.from_json("reply", RESPONSE).alias("r")), "hash")
    date = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    bag = lambda x, *more: F.map_filter(F.map_concat(F.coalesce(F.col(f"{x}.props"), F.create_map().cast("map<string,string>")), F.create_map(*[c for m in more for c in (F.lit(m), F.col(f"{x}.{m}"))])), lambda _, v: v.isNotNull())
    raw = r.select(F.array("namespace").alias("ns"), F.array("src").alias("src"), "hash", F.explode("r.nodes").alias("n")).where(F.col("n.type").isin(*ontology.node_types) & F.col("n.id").isNotNull())
    new_id = prefixed(F.col("n.id"), F.col("n.type"), ontology)
    nodes = raw.select(new_id.alias("id"), F.col("n.type").alias("type"), "ns", date(F.col("n.valid_from")).alias("valid_from"), date(F.col("n.valid_to")).alias("valid_to"), bag("n", "name", "summary").alias("props"), "src")
    moved = raw.select("hash", F.col("n.id").alias("old"), new_id.alias("new")).dropDuplicates(["hash", "old"])
    e = r.select("hash", F.array("namespace").alias("ns"), F.array("src").alias("src"), F.posexplode("r.edges").alias("no", "e")).where(F.col("e.type").isin(*ontology.edge_types))
    for end in ("from", "to"):
        m = moved.select("hash", F.col("old").alias(f"_{end}"), F.col("new").alias(f"{end}_new"))
        e = e.withColumn(f"_{end}", F.col(f"e.{end}")).join(m, ["hash", f"_{end}"], "left")
    edges = e.select(F.concat("hash", F.lit(":"), F.col("no").cast("string")).alias("id"), F.col("e.type").alias("type"), "ns", date(F.col("e.valid_from")).alias("valid_from"), date(F.col("e.valid_to")).alias("valid_to"), bag("e", "description").alias("props"), "src", F.coalesce("from_new", "_from").alias("from_id"), F.coalesce("to_new", "_to").alias("to_id"))
    names = r.select(F.explode("r.aliases").alias("canonical_name", "v")).groupBy("canonical_name").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("variants"))
    return nodes, edges, names


def compile_graph(docs: DataFrame, provider: Provider, *, ontology: Ontology | None = None, cache: DataFrame | None = None, lines: int = 60) -> dict[str, DataFrame]:
    """nodes, edges, aliases, quarantine, and replies (the cache for the next run) of docs (path, text)."""
    from tessera.operators.components import stored

    ontology = ontology or Ontology()
    cut = stored(chunks(docs, lines), "chunks")
    answered = replies(cut if cache is None else uncached(cut, cache), provider)
    if cache is not None:
        answered = answered.unionByName(cache.join(cut.select("hash").distinct(), "hash", "left_semi").select("hash", "reply", "error"))
    answered = stored(answered, "replies")
    nodes, edges, names = candidates(cut, answered, ontology)
    return resolve(nodes, edges, names=names, ontology=ontology) | {"replies": answered}
