"""Incremental indexing and audits by micro-batch, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.config import BELIEF, CHUNK, DEFAULT, ENTITY, Settings
from credence.functions.text import key
from credence.operators.audit import audited
from credence.operators.extraction import beliefs_of, chunk_entities
from credence.operators.graph import belief_edges, new_rows, nodes_of, passage_edges
from credence.operators.knn import synonym_edges
from credence.operators.providers import Encoder, HashingEncoder, Model, embedded
from credence.operators.registry import canonical, profiles
from credence.session import settled
from credence.sources.stores import Store

TRAITS = "array<struct<entity:string,trait:string>>"
Extractor = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Indexes batches of texts into a store and audits what is new.

    ``extract`` turns chunks(chunk_key, content) into extraction records;
    ``encoder`` gives the vectors of chunks, entities and beliefs. A batch is
    visible as a whole once it is committed, and reads only what earlier
    batches committed. So a batch that is run again, after a crash at any point
    or under its old number, has the effect of one run, audits included; a text
    that is known adds nothing.
    """

    def __init__(self, store: Store, extract: Extractor, model: Model, encoder: Encoder | None = None, settings: Settings = DEFAULT):
        self.store, self.extract, self.model = store, extract, model
        self.encoder, self.settings = encoder or HashingEncoder(), settings

    def _vectors(self, namespace: str, prefix: str, contents: DataFrame) -> DataFrame:
        fresh = self.store.missing(contents.where(F.length(F.trim("content")) > 0), namespace, prefix)
        return embedded(fresh, "content", self.encoder).withColumn("namespace", F.lit(namespace))

    def _synonyms(self, vectors: DataFrame, edges: DataFrame) -> DataFrame:
        """Synonym edges between the batch's entities and all, in both directions."""
        new = vectors.where("namespace = 'entity'").select("hash_id", "content", "embedding")
        old = self.store.vectors("entity").select("hash_id", "content", "embedding")
        every = settled(old.unionByName(new).withColumn("id", F.xxhash64("hash_id")))
        own = every.join(new.select("hash_id"), "hash_id", "left_semi")
        found = synonym_edges(every, self.settings.synonym_top_k, self.settings.synonym_threshold, self.settings.synonym_most, own)
        names = every.select("id", "hash_id")
        ends = found.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
        one = ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", "weight")
        both = one.unionByName(ends.select(F.col("b").alias("src"), F.col("a").alias("dst"), "type", "weight")).dropDuplicates(["src", "dst"])
        return new_rows(both, edges, ["src", "dst"])

    def process(self, texts: DataFrame, batch: int | None = None) -> dict[str, DataFrame]:
        """new_beliefs and audits of a batch of texts(content); ``batch`` is its number in a stream."""
        store = self.store
        last = store.last()
        if batch is not None and batch <= last:
            # done before: everything that it made is there
            return {"new_beliefs": store.read("beliefs").where("false"), "audits": store.read("audits").where("false")}
        number = last + 1 if batch is None else batch
        known = store.vectors("chunk").select(F.col("hash_id").alias("chunk_key"))
        chunks = texts.where(F.length(F.trim("content")) > 0).select(key(CHUNK, F.col("content")).alias("chunk_key"), "content")
        fresh = settled(new_rows(chunks, known, ["chunk_key"]))
        records = self.extract(fresh)
        if "traits" not in records.columns:
            records = records.withColumn("traits", F.array().cast(TRAITS))
        records = settled(records)
        # later batches have larger ordinals: the batch's number stands before the row's
        ordinal = F.shiftleft(F.lit(number).cast("long"), 48).bitwiseOR(F.monotonically_increasing_id())
        stated = settled(beliefs_of(records).withColumn("ordinal", ordinal))
        earlier = store.read("beliefs")
        # a belief is new by its text: another speaker's repetition is not
        new = settled(new_rows(stated.select(*earlier.columns), earlier, ["prop_key"]))
        held = chunk_entities(records).join(fresh, "chunk_key").select("content", "entities")
        old_edges = store.read("edges")
        edges = new_rows(belief_edges(stated).unionByName(passage_edges(held)), old_edges, ["src", "dst"])
        entities = stated.select(F.explode("entities").alias("content")).union(stated.select(F.col("source").alias("content"))).distinct()
        vectors = settled(
            self._vectors("chunk", CHUNK, fresh)
            .unionByName(self._vectors("entity", ENTITY, entities))
            .unionByName(self._vectors("belief", BELIEF, stated.select(F.col("text").alias("content"))))
        )
        edges = settled(edges.unionByName(self._synonyms(vectors, old_edges)).dropDuplicates(["src", "dst"]))
        nodes = settled(new_rows(nodes_of(edges), store.read("nodes"), ["name"]))
        told = records.select(F.explode("traits").alias("t")).select("t.entity", "t.trait")
        traits = canonical(told.withColumnRenamed("entity", "mention"), store.read("aliases")).select("canonical", "trait")
        traits = settled(new_rows(traits, store.read("traits"), ["canonical", "trait"]).withColumn("ordinal", ordinal))
        named = traits.select(F.col("canonical").alias("alias"), "canonical").distinct()
        aliases = settled(new_rows(named, store.read("aliases"), ["alias"]))
        profile = settled(profiles(store.read("traits").unionByName(traits)))

        agency = old_edges.where("type = 'agency'")
        said = agency.join(earlier, agency["dst"] == earlier["prop_key"]).select(
            F.expr("substring(src, length('entity-') + 1)").alias("agent"), "prop_key", "text"
        )
        _, answers = audited(new, said, profile, self.model, store.read("cache"))
        answers = settled(answers)
        verdicts = settled(audited(new, said, profile, self.model, store.read("cache").unionByName(answers))[0])
        made = {
            "cache": answers, "beliefs": new, "nodes": nodes, "edges": edges, "traits": traits, "aliases": aliases, "audits": verdicts, "vectors": vectors,
        }
        for name, rows in made.items():
            store.append(name, rows, number)
        store.commit(number)
        return {"new_beliefs": new, "audits": verdicts}

    def start(self, texts: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process a stream of texts until what is available is done; audits are in the store."""

        def step(batch: DataFrame, number: int) -> None:
            self.process(batch, number)

        return texts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    """Events and their values by window and type; works on streams and on tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    ).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """Each user's sessions, which end after ``gap`` without an event."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
