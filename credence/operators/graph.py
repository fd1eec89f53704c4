"""The property graph: nodes(name, content, type) and edges(src, dst, type, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.config import BELIEF, CHUNK, ENTITY
from credence.functions.text import content_of, key, kind_of, owner_of, present

EDGE = ["src", "dst", "type", "weight"]


def new_rows(rows: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key is not yet known, one per key."""
    return rows.dropDuplicates(by).join(known.select(*by).distinct(), by, "left_anti")


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The last written row of each key."""
    value = F.struct(*[c for c in rows.columns if c != by])
    return rows.groupBy(by).agg(F.max_by(value, order).alias("v")).select(by, "v.*")


def belief_map(beliefs: DataFrame) -> DataFrame:
    """beliefs(text, entities, source, attitude, ordinal) keyed by text; the last statement wins."""
    keyed = beliefs.where(present(F.col("text"))).withColumn("prop_key", key(BELIEF, F.col("text")))
    keyed = keyed.withColumn("source", owner_of(F.col("source")))
    return latest(keyed, "prop_key", "ordinal")


def belief_edges(beliefs: DataFrame) -> DataFrame:
    """Agency edges from speakers to beliefs, inclusion edges from beliefs to their entities."""
    stated = beliefs.where(present(F.col("text"))).select(
        key(BELIEF, F.col("text")).alias("prop"), owner_of(F.col("source")).alias("source"), "entities"
    )
    agency = stated.select(key(ENTITY, F.col("source")).alias("src"), F.col("prop").alias("dst"), F.lit("agency").alias("type"))
    named = stated.select("prop", F.explode("entities").alias("entity")).where(present(F.col("entity")))
    inclusion = named.select(F.col("prop").alias("src"), key(ENTITY, F.col("entity")).alias("dst"), F.lit("inclusion").alias("type"))
    return agency.union(inclusion).distinct().withColumn("weight", F.lit(1.0))


def passage_edges(chunks: DataFrame) -> DataFrame:
    """Contains edges from chunks(content, entities) to their entities."""
    named = chunks.select(key(CHUNK, F.col("content")).alias("src"), F.explode("entities").alias("entity"))
    named = named.where(present(F.col("entity")))
    return (
        named.select("src", key(ENTITY, F.col("entity")).alias("dst"), F.lit("contains").alias("type"))
        .distinct()
        .withColumn("weight", F.lit(1.0))
    )


def clique_edges(beliefs: DataFrame) -> DataFrame:
    """Each ordered pair of different entities of a belief, weighted by the beliefs that hold both.

    Pairs are made within a belief's own entity list, so nothing is joined.
    """
    own = beliefs.select(F.array_distinct("entities").alias("e"))
    pairs = own.select(
        F.explode(
            F.flatten(
                F.transform("e", lambda a: F.transform(F.filter("e", lambda b: a != b), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
            )
        ).alias("p")
    )
    counted = pairs.groupBy("p.src", "p.dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counted.select("src", "dst", F.lit("clique").alias("type"), "weight")


def nodes_of(edges: DataFrame) -> DataFrame:
    names = edges.select(F.col("src").alias("name")).union(edges.select(F.col("dst").alias("name"))).distinct()
    return names.select("name", content_of(F.col("name")).alias("content"), kind_of(F.col("name")).alias("type"))


def accumulated(staged: DataFrame) -> DataFrame:
    """Staged edges summed by their ends."""
    return staged.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))


def between_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    names = nodes.select("name")
    return edges.join(names, edges["src"] == names["name"], "left_semi").join(
        names.withColumnRenamed("name", "other"), F.col("dst") == F.col("other"), "left_semi"
    )


def augmented(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with new nodes and the staged edges between known nodes; repeating it changes nothing."""
    all_nodes = nodes.unionByName(new_rows(more_nodes, nodes, ["name"]).select(*nodes.columns))
    fresh = new_rows(between_known(accumulated(staged), all_nodes), edges, ["src", "dst"])
    return all_nodes, edges.unionByName(fresh.select(*edges.columns))


def flushed(staged: DataFrame) -> DataFrame:
    """Staged edges without loops, summed by their ends; nodes need not be known."""
    return accumulated(staged.where("src <> dst"))


def new_passage_edges(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Contains edges of weight 1 for the chunks that are not among known(chunk_key)."""
    keyed = chunks.withColumn("chunk_key", key(CHUNK, F.col("content")))
    return passage_edges(keyed.join(known, "chunk_key", "left_anti").select("content", "entities"))


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Views of the edges: beliefs of agents, entities of beliefs, and beliefs of entities."""
    agency = edges.where("type = 'agency'").select(F.col("src").alias("agent"), F.col("dst").alias("prop_key"))
    inclusion = edges.where("type = 'inclusion'").select(F.col("src").alias("prop_key"), F.col("dst").alias("entity"))
    return agency, inclusion, inclusion.select("entity", "prop_key")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, parallel edges summed."""
    ends = edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    both = ends.union(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The subgraph on the given names."""
    return between_known(edges, names.select("name").distinct())


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, other) for every edge at one of the names, in either direction."""
    ends = edges.select(F.col("src").alias("name"), F.col("dst").alias("other"))
    ends = ends.union(edges.select(F.col("dst").alias("name"), F.col("src").alias("other")))
    return ends.join(names.select("name").distinct(), "name", "left_semi").distinct()


def graph_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; synonym edges are what the passage edges leave of the total."""
    by_node = nodes.agg(
        F.count_if(F.col("type") == "entity").alias("n_entities"),
        F.count_if(F.col("type") == "chunk").alias("n_passages"),
        F.count_if(F.col("type") == "belief").alias("n_beliefs"),
        F.count(F.lit(1)).alias("n_nodes"),
    )
    at_passage = F.col("src").startswith(CHUNK) | F.col("dst").startswith(CHUNK)
    by_edge = edges.agg(
        F.count_if(at_passage).alias("n_passage_edges"),
        F.count_if(~at_passage).alias("n_other_edges"),
        F.count(F.lit(1)).alias("n_edges"),
    )
    # two rows of one each
    return by_node.join(F.broadcast(by_edge), F.lit(True))


def entity_chunks(edges: DataFrame) -> DataFrame:
    """In how many chunks each entity occurs."""
    contains = edges.where("type = 'contains'")
    return contains.groupBy(F.col("dst").alias("entity")).agg(F.countDistinct("src").alias("n_chunks"))


def memories(edges: DataFrame, beliefs: DataFrame, batch: DataFrame) -> DataFrame:
    """(agent, prop_key) of every belief stated by an agent, the current batch's left out."""
    stated = edges.where("type = 'agency'").select(F.col("src").alias("agent"), F.col("dst").alias("prop_key"))
    known = stated.join(beliefs.select("prop_key"), "prop_key", "left_semi")
    return known.join(batch.select("prop_key").distinct(), "prop_key", "left_anti")


def ranked(rows: DataFrame, by: list[str], order: list, k: int | None = None) -> DataFrame:
    """Rows with their rank within the group; the first ``k`` of each if given."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)
