"""Queries that run the engine's own parts: stores, caches, models, extraction, retrieval and the event pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import CHUNK
from credence.functions import parsing, text, vectors
from credence.operators import audit, beam, extraction, graph, knn, providers, qa, registry, retrieval
from credence.plans.catalogue import COSINE, NORMAL_SQL, QUERIES, SQL, _vectors, query
from credence.plans.projection import EDGES_SQL, all_edges, named, named_edges, named_nodes, numbered_edges, order_beliefs, supplier_chunks, table
from credence.session import dropped, settled, work_path
from credence.sources import datasets, stores
from credence.streaming import events as streams

__all__ = ["QUERIES", "SQL"]

MODEL = providers.RuleModel()


def _md5(column) -> Column:
    return F.md5(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"))


def _cache(spark) -> DataFrame:
    return spark.createDataFrame([], stores.SCHEMAS["cache"])


def _json_file(rows: DataFrame) -> str:
    """Writes the rows, a small stated set, as one JSON array; returns its path."""
    path = work_path(rows.sparkSession)
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.text(path)
    return path


# ------------------------------------------------------------------ sources and stores
@query("SELECT md5('chunk-t' || item_id || chr(10) || text) AS key_md5 FROM benchmark")
def corpus_scan(spark, sf):
    rows = table(spark, sf, "benchmark").select(named("t", "item_id").alias("title"), "text")
    return datasets.corpus(spark, _json_file(rows)).select(_md5("chunk_key").alias("key_md5"))


@query(
    """SELECT 'q' || item_id AS question, CASE WHEN item_id % 2 = 0 THEN md5('t' || item_id || chr(10) || text) ELSE md5('') END AS docs_md5,
    CASE WHEN item_id % 3 = 0 THEN 'a' || item_id || '|b' ELSE '' END AS answers FROM benchmark"""
)
def qa_dataset(spark, sf):
    """Gold documents and answers of a question set; what is missing is an empty string."""
    gold = F.array(F.struct(named("t", "item_id").alias("title"), F.col("text").alias("paragraph_text"), F.lit(True).alias("is_supporting")))
    rows = table(spark, sf, "benchmark").select(
        named("q", "item_id").alias("question"),
        F.when(F.col("item_id") % 2 == 0, gold).alias("paragraphs"),
        F.when(F.col("item_id") % 3 == 0, named("a", "item_id")).alias("answer"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("b"))).alias("answer_aliases"),
    )
    found = datasets.qa_dataset(spark, _json_file(rows))
    return found.select("question", _md5(F.array_join("gold_docs", "|")).alias("docs_md5"), F.array_join("gold_answers", "|").alias("answers"))


@query("SELECT md5('chunk-' || text) AS key_md5, 64 AS size, count(*) AS n_rows FROM (SELECT DISTINCT text FROM conversations) GROUP BY 1")
def vector_upsert(spark, sf):
    """Vectors of all turns: the users' first, then everything, of which only the rest is encoded."""
    store = stores.Store(spark, work_path(spark))
    turns = table(spark, sf, "conversations").select("role", F.col("text").alias("content"))
    encoder = providers.HashingEncoder()
    store.upsert(turns.where("role = 'user'"), "chunk", CHUNK, encoder)
    store.upsert(turns, "chunk", CHUNK, encoder)
    found = store.lookup(store.ids("chunk"), "chunk").groupBy("hash_id").agg(F.max(F.size("embedding")).alias("size"), F.count(F.lit(1)).alias("n_rows"))
    return found.select(_md5("hash_id").alias("key_md5"), "size", "n_rows")


@query("SELECT md5('chunk-' || text) AS key_md5 FROM (SELECT DISTINCT text FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'user'))")
def openie_missing(spark, sf):
    """Chunks for which the extraction file has no record."""
    turns = table(spark, sf, "conversations").select("role", F.col("text").alias("content"))
    none = F.array().cast("array<string>")
    users = extraction.chunk_keys(turns.where("role = 'user'"))
    path = work_path(spark)
    datasets.write_records(users.select(F.lit("old").alias("idx"), F.col("content").alias("passage"), none.alias("extracted_entities")), path)
    missing = datasets.unextracted(extraction.chunk_keys(turns), datasets.records(spark, path))
    return missing.select(_md5("chunk_key").alias("key_md5"))


@query(
    """SELECT round(avg(length('p' || l_partkey)), 4) AS avg_chars, 1.0::DOUBLE AS avg_words FROM lineitem"""
)
def openie_averages(spark, sf):
    """The averages that stand beside the extraction records."""
    lines = table(spark, sf, "lineitem")
    records = lines.groupBy(named("s", "l_suppkey").alias("passage")).agg(F.collect_list(named("p", "l_partkey")).alias("extracted_entities"))
    path = work_path(spark)
    datasets.write_records(records.withColumn("idx", F.col("passage")), path)
    return spark.read.schema("avg_chars double, avg_words double").json(f"{path}/averages")


@query("SELECT count(*) AS n_beliefs, count(DISTINCT 'c' || o_custkey) AS n_sources, max(o_orderkey) AS last FROM orders")
def belief_store(spark, sf):
    """Beliefs appended in two batches and read back."""
    store = stores.Store(spark, work_path(spark))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("ordinal"))
    rows = order_beliefs(spark, sf).withColumn("o_orderkey", F.substring("text", 2, 20).cast("long")).join(orders, "o_orderkey")
    keyed = rows.select(text.key("proposition-", F.col("text")).alias("prop_key"), "text", "entities", "source", F.lit("states").alias("attitude"), "ordinal")
    store.append("beliefs", keyed.where("ordinal <= 1000"))
    store.append("beliefs", keyed.where("ordinal > 1000"))
    return store.read("beliefs").agg(F.count(F.lit(1)).alias("n_beliefs"), F.countDistinct("source").alias("n_sources"), F.max("ordinal").alias("last"))


@query(
    f"""WITH {EDGES_SQL}, names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges)
    SELECT 'edge' AS kind, count(*) AS n, md5(string_agg(src || dst, '' ORDER BY src, dst)) AS names_md5 FROM edges WHERE src LIKE 'chunk-%'
    UNION ALL SELECT 'node', count(*), md5(string_agg(name, '' ORDER BY name)) FROM names WHERE name LIKE 'chunk-%'"""
)
def graph_export(spark, sf):
    """The graph written as GraphML and read again; its passages and their edges."""
    numbers = settled(numbered_edges(spark, sf))
    path = work_path(spark)
    stores.export_graphml(named_nodes(numbers), named_edges(numbers), path, "gzip")
    dropped(numbers)
    nodes, edges = stores.import_graphml(spark, path)

    def digest(kind, rows, *columns):
        found = stores.ordered_md5(rows.where(F.col(columns[0]).startswith(CHUNK)), list(columns))
        return found.select(F.lit(kind).alias("kind"), "n", F.col("md5").alias("names_md5"))

    return digest("edge", edges, "src", "dst").union(digest("node", nodes, "name"))


@query(
    """WITH first AS (SELECT o_custkey, o_orderpriority AS trait, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
    p AS (SELECT o_custkey, string_agg(trait, '; ' ORDER BY k) AS profile FROM first GROUP BY 1)
    SELECT 'c' || c_custkey AS canonical, 'c' || c_custkey || ' (' || c_name || '): ' || coalesce(profile, '') AS line
    FROM customer LEFT JOIN p ON o_custkey = c_custkey"""
)
def registry_sync(spark, sf):
    """Names and traits stored in batches, read back, and written out as text."""
    store = stores.Store(spark, work_path(spark))
    customers = table(spark, sf, "customer").select(named("c", "c_custkey").alias("canonical"), F.col("c_name").alias("alias"))
    store.append("aliases", customers.select("alias", "canonical"))
    own = customers.select(F.col("canonical").alias("alias"), "canonical")
    store.append("aliases", graph.new_rows(own, store.read("aliases"), ["alias"]))
    traits = table(spark, sf, "orders").select(
        named("c", "o_custkey").alias("canonical"), F.col("o_orderpriority").alias("trait"), F.col("o_orderkey").alias("ordinal")
    )
    store.append("traits", traits.groupBy("canonical", "trait").agg(F.min("ordinal").alias("ordinal")))
    return registry.dump(store.read("aliases"), store.read("traits"))


# ------------------------------------------------------------------ models and their caches
FIRST_WORD = "coalesce(nullif(regexp_extract({0}, '\\S+'), ''), 'none')"


def _asked(turns: DataFrame) -> DataFrame:
    return turns.withColumn("prompt", text.prompt(F.array("text"), F.lit("which?"), 5))


@query(
    f"""WITH a AS (SELECT text, min(CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS late FROM conversations GROUP BY 1)
    SELECT md5(text) AS text_md5, 'Answer: ' || {FIRST_WORD.format("text")} AS response, late = 1 AS fresh FROM a"""
)
def llm_cache(spark, sf):
    """Answers through the request cache: users' turns are known when all turns are asked."""
    store = stores.Store(spark, work_path(spark))
    turns = table(spark, sf, "conversations").select("role", "text")
    _, first = providers.answered(_asked(turns.where("role = 'user'")), store.read("cache"), MODEL, must_hold="Answer:")
    store.append("cache", first)
    told, more = providers.answered(_asked(turns.select("text").distinct()), store.read("cache"), MODEL, must_hold="Answer:")
    more = settled(more)
    keyed = told.withColumn("request", providers.request_key(F.col("prompt"), "built-in", 0, 0.0))
    flags = keyed.join(more.select("request", F.lit(True).alias("new")), "request", "left")
    return flags.select(_md5("text").alias("text_md5"), "response", F.coalesce("new", F.lit(False)).alias("fresh"))


@query(
    """WITH u AS (SELECT DISTINCT text FROM conversations WHERE role = 'user')
    SELECT count(*) AS n_requests, count(*) FILTER (WHERE text IN (SELECT text FROM u)) AS n_hits,
    coalesce(sum(CASE WHEN text NOT IN (SELECT text FROM u) THEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) + 4 END), 0)::BIGINT AS prompt_words
    FROM conversations"""
)
def llm_usage(spark, sf):
    """Requests, cache hits, and words that had to be sent."""
    turns = table(spark, sf, "conversations").select("role", "text")
    _, first = providers.answered(_asked(turns.where("role = 'user'")), _cache(spark), MODEL)
    return providers.usage(_asked(turns), settled(first))


@query(
    """SELECT count(DISTINCT CASE WHEN role = 'user' THEN text END) AS n_first,
    count(DISTINCT text) - count(DISTINCT CASE WHEN role = 'user' THEN text END) AS n_second, count(*) AS n_rows FROM conversations"""
)
def embedding_cache(spark, sf):
    """Texts are encoded once for each instruction and model."""
    turns = table(spark, sf, "conversations").select("role", "text")
    cache, encoder = spark.createDataFrame([], stores.SCHEMAS["embeddings"]), providers.HashingEncoder()
    asked = providers.instruction_for("passage")
    _, first = providers.embedded_through(turns.where("role = 'user'"), "text", cache, encoder, asked)
    first = settled(first)
    rows, second = providers.embedded_through(turns, "text", first, encoder, asked)
    n_rows = rows.where("embedding is not null").agg(F.count(F.lit(1)).alias("n_rows"))
    # one row each
    return first.agg(F.count(F.lit(1)).alias("n_first")).join(second.agg(F.count(F.lit(1)).alias("n_second")), F.lit(True)).join(n_rows, F.lit(True))


@query("SELECT p_partkey, 'é' || chr((65 + p_partkey % 26)::INT) AS decoded FROM part")
def escape_decoding(spark, sf):
    code = F.lpad(F.lower(F.hex(65 + F.col("p_partkey") % 26)), 4, "0")
    return table(spark, sf, "part").select("p_partkey", parsing.decode_escapes(F.concat(F.lit("\\u00e9\\u"), code)).alias("decoded"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'say \"x\" now' ELSE 'cut' END AS name, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size END AS size FROM part")
def json_faults(spark, sf):
    """Prose before the object, quotes within a text, and a text that is cut off."""
    size = F.col("p_size").cast("string")
    faulty = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('Here it is: {"name": "x", "size": '), size, F.lit("} and more")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"name": "say "x" now", "size": '), size, F.lit("}")))
        .otherwise(F.lit('{"name": "cut", "size'))
    )
    rows = table(spark, sf, "part").select("p_partkey", parsing.parsed(parsing.repair_json(faulty), "name string, size int").alias("v"))
    return rows.select("p_partkey", "v.name", "v.size")


@query(
    """SELECT p_partkey, 'p' || p_partkey || '|' || p_brand AS found FROM part"""
)
def embedded_objects(spark, sf):
    """An object with a list of entities, found in prose."""
    answer = F.concat(F.lit('Sure: {"named_entities": ["p'), F.col("p_partkey").cast("string"), F.lit('", "'), F.col("p_brand"), F.lit('"]} done.'))
    value = parsing.parsed(parsing.object_with(answer, "named_entities"), extraction.ENTITIES)
    return table(spark, sf, "part").select("p_partkey", F.array_join(value["named_entities"], "|").alias("found"))


PROMPT_VARIABLES = [
    ("answer", "context,passage"), ("entities", "passage"), ("entities_all", "passage"), ("entities_strict", "passage"), ("query_entities", "passage"),
    ("reason", "context,passage"), ("reason_steps", "context,passage"), ("repair", "passage"), ("statements", "entities,passage"),
    ("triples", "entities,passage"), ("triples_in_context", "context,passage"),
]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, PROMPT_VARIABLES))}) AS v(name, variables)")
def prompt_variables(spark, sf):
    return spark.createDataFrame(extraction.prompt_table(), "name string, variables string")


@query("SELECT item_id, 'Instruct: Given a question, retrieve passages that answer it.' || chr(10) || 'Query: ' || text AS asked FROM benchmark")
def instructed_queries(spark, sf):
    asked = providers.instructed(F.col("text"), providers.instruction_for("passage"))
    return table(spark, sf, "benchmark").select("item_id", asked.alias("asked"))


# ------------------------------------------------------------------ extraction
CAPITALS = "regexp_extract_all({0}, '[A-Z][a-z]+')"


@query(f"SELECT md5('chunk-' || text) AS key_md5, array_to_string(list_sort(list_distinct({CAPITALS.format('text')})), ',') AS entities FROM (SELECT DISTINCT text FROM conversations)")
def entity_extraction(spark, sf):
    """Named entities of every turn by the built-in model, with repair of what can't be read."""
    chunks = extraction.chunk_keys(table(spark, sf, "conversations").select(F.col("text").alias("content")))
    found, _ = extraction.entities_of(chunks, MODEL, _cache(spark))
    return found.select(_md5("chunk_key").alias("key_md5"), F.array_join(F.array_sort("entities"), ",").alias("entities"))


@query(
    f"""WITH t AS (SELECT text, len(list_distinct({CAPITALS.format("text")})) AS n FROM (SELECT DISTINCT text FROM conversations WHERE role = 'user'))
    SELECT md5('chunk-' || text) AS key_md5, n::BIGINT AS n_entities, greatest(n - 1, 0)::BIGINT AS n_triples,
    len(list_filter(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x) <> ''))::BIGINT AS n_statements FROM t"""
)
def batch_extraction(spark, sf):
    """Entities, statements over them, and triples, as one record a chunk."""
    users = table(spark, sf, "conversations").where("role = 'user'")
    chunks = extraction.chunk_keys(users.select(F.col("text").alias("content")))
    records, _ = extraction.extracted(chunks, MODEL, _cache(spark), with_triples=True)
    size = lambda c: F.size(c).cast("long")
    return records.select(
        _md5("idx").alias("key_md5"), size("extracted_entities").alias("n_entities"), size("extracted_triples").alias("n_triples"), size("propositions").alias("n_statements")
    )


@query(
    """SELECT (SELECT count(*) FROM (SELECT 'p' || l_partkey FROM lineitem UNION SELECT 's' || l_suppkey FROM lineitem)) AS n_entities,
    (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS n_relations, (SELECT count(DISTINCT (l_partkey, l_returnflag, l_suppkey)) FROM lineitem) AS n_facts"""
)
def triple_flattening(spark, sf):
    lines = table(spark, sf, "lineitem")
    triple = F.array(named("p", "l_partkey"), F.col("l_returnflag"), named("s", "l_suppkey"))
    records = lines.groupBy("l_orderkey").agg(F.collect_list(triple).alias("extracted_triples"))
    every = extraction.facts(records)
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    # one row each
    found = one(extraction.triple_entities(every), "n_entities").join(one(extraction.triple_relations(every), "n_relations"), F.lit(True))
    return found.join(one(every, "n_facts"), F.lit(True))


@query(
    """WITH a AS (SELECT p_name AS alias, 'p' || min(p_partkey) AS canonical FROM part WHERE p_size <= 25 GROUP BY 1),
    m AS (SELECT p_partkey AS ordinal, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS mention FROM part)
    SELECT ordinal, mention, coalesce(a.canonical, p_name) AS canonical FROM m LEFT JOIN a ON alias = mention"""
)
def entity_resolution(spark, sf):
    """Mentions by alias, and those that no alias names by the model, from their candidates."""
    parts = table(spark, sf, "part")
    aliases = parts.where("p_size <= 25").groupBy(F.col("p_name").alias("alias")).agg(F.concat(F.lit("p"), F.min("p_partkey").cast("string")).alias("canonical"))
    mention = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("mention")
    mentions = parts.select(mention, F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("context"))
    found = parts.select(mention, F.concat(F.lit("- nobody\n- "), F.col("p_name")).alias("section")).distinct()
    return registry.resolved(mentions, aliases, found, MODEL, _cache(spark))[0].select("ordinal", "mention", "canonical")


@query("SELECT 'p' || l_partkey AS entity FROM lineitem UNION SELECT 'c' || o_custkey FROM orders")
def batch_entities(spark, sf):
    """All entities and speakers of a batch, once each."""
    beliefs = order_beliefs(spark, sf)
    chunks = supplier_chunks(spark, sf).select(F.explode("entities").alias("entity"))
    return chunks.union(beliefs.select("source")).distinct()


@query("SELECT conv_id, turn, role, role = 'assistant' AS done, md5(CASE WHEN role = 'assistant' THEN 'So the answer is: ' ELSE '' END || text) AS thought_md5 FROM conversations")
def reasoning_steps(spark, sf):
    """One step of reasoning a turn, and whether it comes to an answer."""
    asked = F.concat(F.when(F.col("role") == "assistant", "So the answer is: ").otherwise(""), "text")
    turns = table(spark, sf, "conversations").select(F.struct("conv_id", "turn", "role").alias("query_id"), asked.alias("question"), F.lit("").alias("context"))
    found, _ = extraction.reasoned(turns, MODEL, _cache(spark))
    return found.select("query_id.*", "done", _md5("thought").alias("thought_md5"))


# ------------------------------------------------------------------ graph and registry
@query(
    """SELECT 'chunk-s' || l_suppkey AS src, 'entity-p' || l_partkey AS dst FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2"""
)
def new_passage_edges(spark, sf):
    """Contains edges of the passages that are not known yet."""
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select(named("chunk-s", "s_suppkey").alias("chunk_key"))
    return graph.new_passage_edges(supplier_chunks(spark, sf), known).select("src", "dst")


@query("SELECT 'n' || l_suppkey % 50 AS src, 'n' || l_partkey % 50 AS dst, count(*)::DOUBLE AS weight FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50 GROUP BY 1, 2")
def flushed_edges(spark, sf):
    """Staged edges without loops, summed."""
    end = lambda c: F.concat(F.lit("n"), (F.col(c) % 50).cast("string"))
    staged = table(spark, sf, "lineitem").select(end("l_suppkey").alias("src"), end("l_partkey").alias("dst"), F.lit("staged").alias("type"), F.lit(1.0).alias("weight"))
    return graph.flushed(staged).select("src", "dst", "weight")


@query(
    f"""WITH {EDGES_SQL} SELECT 'agency' AS kind, count(*) AS n, count(DISTINCT src) AS n_keys FROM edges WHERE type = 'agency'
    UNION ALL SELECT 'inclusion', count(*), count(DISTINCT src) FROM edges WHERE type = 'inclusion'
    UNION ALL SELECT 'mentions', count(*), count(DISTINCT dst) FROM edges WHERE type = 'inclusion'"""
)
def adjacency_views(spark, sf):
    views = graph.adjacency(all_edges(spark, sf))
    out = None
    for kind, view, column in zip(("agency", "inclusion", "mentions"), views, ("agent", "prop_key", "entity"), strict=True):
        row = view.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("n_keys"))
        out = row if out is None else out.union(row)
    return out


@query(
    f"""WITH {EDGES_SQL}, old AS (SELECT * FROM edges WHERE type <> 'contains'), staged AS (SELECT * FROM edges WHERE type = 'contains'),
    names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges)
    SELECT (SELECT count(*) FROM names) AS n_nodes, (SELECT count(*) FROM old) + (SELECT count(*) FROM staged) AS n_edges"""
)
def augmented_graph(spark, sf):
    """Nodes and staged edges added to the graph, twice; the second time adds nothing."""
    every = settled(all_edges(spark, sf))
    old, staged = every.where("type <> 'contains'"), every.where("type = 'contains'")
    nodes, more = settled(graph.nodes_of(old)), settled(graph.nodes_of(every))
    for _ in range(2):
        nodes, old = (settled(x) for x in graph.augmented(nodes, old, more, staged))
    # one row each
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(old.agg(F.count(F.lit(1)).alias("n_edges")), F.lit(True))


@query(
    """WITH first AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY 1, 2)
    SELECT event_type, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first DESC, user_id) AS rank FROM first) WHERE rank <= 10"""
)
def recent_as_inserted(spark, sf):
    found = registry.recent_as_inserted(table(spark, sf, "events"), "event_type", "user_id", "event_id")
    return found.select("event_type", "user_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def registry_first(spark, sf):
    return registry.known_first(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 10)


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS key_id, {COSINE} AS score FROM embeddings a CROSS JOIN embeddings b
      WHERE a.vec_id < 20 AND b.vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM s WHERE TRUE)
    SELECT query_id, string_agg('- v' || key_id, chr(10) ORDER BY rank) AS section FROM r WHERE rank <= 5 GROUP BY 1"""
)
def registry_candidates(spark, sf):
    """Candidates of the first mentions without the recent entities, as text for a prompt."""
    v = _vectors(spark, sf)
    found = registry.candidates(v.where("id < 20"), v, v.where("label = 3").select("id"), 5)
    return registry.section(found.withColumn("content", named("v", "key_id")))


@query(
    f"""WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {COSINE} AS weight FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM s WHERE weight >= 0.2)
    SELECT src, dst, weight FROM r WHERE rank <= 3"""
)
def synonym_cut(spark, sf):
    """At most three synonyms of each name."""
    v = _vectors(spark, sf).withColumn("content", named("name", "id"))
    return knn.synonym_edges(v, 100, 0.2, 3).select("src", "dst", "weight")


# ------------------------------------------------------------------ scores and retrieval
@query(
    """WITH n AS (SELECT n_regionkey::BIGINT AS query_id, 'p' || l_partkey AS name, count(*)::DOUBLE AS weight FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT query_id, name, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, name) <= 5 THEN weight ELSE 0.0 END AS weight FROM n"""
)
def linking_top_k(spark, sf):
    """Entity weights of which only the five largest of each query count."""
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("query_id"))
    sellers = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "query_id")
    lines = table(spark, sf, "lineitem").join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    weights = lines.groupBy("query_id", named("p", "l_partkey").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return retrieval.top_weights(weights, 5)


def _totals_sql(total: str) -> str:
    return f"""WITH b AS (SELECT o_custkey AS query_id, o_orderkey, round(o_totalprice / 1000, 6) AS score,
      row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 1000, 6) DESC, 'proposition-o' || o_orderkey) AS r FROM orders),
    i AS (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS entity FROM lineitem),
    e AS (SELECT query_id, entity, {total} AS score FROM b JOIN i ON l_orderkey = o_orderkey WHERE r <= 3 GROUP BY 1, 2)
    SELECT query_id, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM e) WHERE rank <= 4"""


def _path_entities(spark, sf, total):
    orders = table(spark, sf, "orders")
    beliefs = orders.select(F.col("o_custkey").alias("query_id"), named("proposition-o", "o_orderkey").alias("prop_key"), F.round(F.col("o_totalprice") / 1000, 6).alias("score"))
    inclusion = table(spark, sf, "lineitem").select(named("proposition-o", "l_orderkey").alias("prop_key"), named("p", "l_partkey").alias("entity")).distinct()
    paths = beam.free_paths(beliefs, inclusion, 3, 0)
    return beam.entities_of_paths(paths, inclusion, 4, total).select("query_id", "entity", "score")


@query(_totals_sql("max(score)"))
def path_entities_best(spark, sf):
    """Entities on each customer's three best beliefs by their best."""
    return _path_entities(spark, sf, False)


@query(_totals_sql("round(sum(score), 6)"))
def path_entities_total(spark, sf):
    return _path_entities(spark, sf, True)


@query(
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, i, avg(x) AS a, max(x) AS m FROM e GROUP BY 1, 2)
    SELECT label, round(sum(a) / sqrt(sum(a * a)), 6) AS average, round(sum(m) / sqrt(sum(m * m)), 6) AS max_pool FROM m GROUP BY 1"""
)
def combined_vectors(spark, sf):
    """One vector for the vectors of each label, in two ways; the sum of its elements."""
    listed = F.array_sort(F.collect_list(F.struct("id", "embedding")))
    rows = _vectors(spark, sf).groupBy("label").agg(F.transform(listed, lambda x: x["embedding"]).alias("v"))
    total = lambda mode: F.round(F.aggregate(vectors.combined(F.col("v"), mode), F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select("label", total("average").alias("average"), total("max_pool").alias("max_pool"))


class Letters:
    """Counts of the small letters a to z: an encoder that SQL can spell out."""

    size = 26

    def encode(self, texts: list[str], instruction: str = "") -> np.ndarray:
        return np.array([[t.count(chr(97 + k)) for k in range(26)] for t in texts], float).reshape(-1, 26)


LETTERS_SQL = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{chr(97 + k)}', '')))::DOUBLE" for k in range(26)) + "]"
RETRIEVE_SQL = f"""q AS MATERIALIZED (SELECT item_id AS query_id, {LETTERS_SQL.format("text")} AS e FROM benchmark),
p AS MATERIALIZED (SELECT 'chunk-' || doc_id AS name, text, {LETTERS_SQL.format("text")} AS e FROM documents WHERE lang = 'en' AND length(text) > 200),
s AS (SELECT query_id, name, text, CASE WHEN list_sum(p.e) = 0 OR list_sum(q.e) = 0 THEN 0 ELSE round(list_cosine_similarity(q.e, p.e), 6) END AS raw FROM q CROSS JOIN p),
d AS (SELECT *, round((raw - min(raw) OVER w) / nullif(max(raw) OVER w - min(raw) OVER w, 0), 6) AS score FROM s WINDOW w AS (PARTITION BY query_id)),
ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name DESC) AS rank FROM d) WHERE rank <= 200)"""


def _question_set(spark, sf):
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    documents = table(spark, sf, "documents").where("lang = 'en' and length(text) > 200")
    return questions, documents.select(named("chunk-", "doc_id").alias("name"), F.col("text").alias("content"))


@query(f"WITH {RETRIEVE_SQL} SELECT query_id, name, score, rank FROM ranked WHERE rank <= 5")
def retrieve(spark, sf):
    """The best passages of all questions at once."""
    found = qa.retrieve(*_question_set(spark, sf), Letters())
    return found.where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {RETRIEVE_SQL} SELECT query_id, 'chosen' AS kind, {FIRST_WORD.format("text")} AS answer, round(score, 4) AS score FROM ranked WHERE rank = 1"""
)
def rag_qa(spark, sf):
    """Answers from the best passages."""
    told, _, _ = qa.rag_qa(*_question_set(spark, sf), Letters(), MODEL, _cache(spark))
    first = qa.shown(told)
    return first.select("query_id", F.lit("chosen").alias("kind"), "answer", F.col("doc_scores")[0].alias("score"))


@query(
    f"""WITH {RETRIEVE_SQL}, a AS (SELECT query_id, {NORMAL_SQL.format(FIRST_WORD.format("text"))} AS predicted FROM ranked WHERE rank = 1),
    g AS (SELECT item_id AS query_id, {NORMAL_SQL.format(FIRST_WORD.format("text"))} AS gold FROM benchmark)
    SELECT round(avg((gold = predicted)::INT::DOUBLE), 4) AS exact_match,
    round(avg(CASE WHEN gold = predicted AND gold <> '' THEN 1.0 ELSE 0.0 END), 4) AS f1 FROM a JOIN g USING (query_id)"""
)
def rag_scores(spark, sf):
    """Exact match and F1 of one-word answers."""
    questions, passages = _question_set(spark, sf)
    golds = questions.select("query_id", F.coalesce(F.nullif(F.regexp_extract("question", "\\S+", 0), F.lit("")), F.lit("none")).alias("gold"))
    return qa.rag_qa(questions, passages, Letters(), MODEL, _cache(spark), golds)[1]


# ------------------------------------------------------------------ events
SAID_SQL = """said AS (SELECT user_id, event_id, ts, 'u' || user_id || CASE WHEN value < 50 THEN ' not ' ELSE ' ' END || event_type AS text FROM events)"""
STATUS_SQL = """CASE WHEN EXISTS (SELECT 1 FROM {0} o WHERE o.user_id = n.user_id AND o.text <> n.text AND replace(o.text, ' not ', ' ') = replace(n.text, ' not ', ' ')) THEN 'Inconsistent'
  WHEN EXISTS (SELECT 1 FROM {0} o WHERE o.user_id = n.user_id) THEN 'Consistent' ELSE 'Neutral' END"""


def _said(spark, sf) -> DataFrame:
    denied = F.when(F.col("value") < 50, " not ").otherwise(" ")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.concat(named("u", "user_id"), denied, "event_type").alias("text"))


@query(
    f"""WITH {SAID_SQL}, n AS (SELECT user_id, arg_max(text, event_id) AS text, max(event_id) AS last FROM said GROUP BY 1),
    old AS (SELECT DISTINCT s.user_id, s.text FROM said s JOIN n USING (user_id) WHERE s.event_id < n.last AND s.text NOT IN (SELECT text FROM n))
    SELECT 'u' || user_id AS agent, text AS statement, {STATUS_SQL.format("old")} AS status, (SELECT count(*) FROM old o WHERE o.user_id = n.user_id) AS n_evidence FROM n"""
)
def event_audit(spark, sf):
    """Each user's last statement, judged by the model against what the user said before."""
    said = _said(spark, sf)
    last = said.groupBy("user_id").agg(F.max_by("text", "event_id").alias("text"), F.max("event_id").alias("last"))
    new = last.select(F.col("text").alias("prop_key"), "text", named("u", "user_id").alias("source"))
    before = said.join(last.select("user_id", "last"), "user_id").where("event_id < last")
    stated = before.select(named("u", "user_id").alias("agent"), F.col("text").alias("prop_key"), "text").distinct()
    traits = table(spark, sf, "events").select(named("u", "user_id").alias("canonical"), F.col("event_type").alias("trait"), F.col("event_id").alias("ordinal"))
    found, _ = audit.audited(new, stated, registry.profiles(traits), MODEL, _cache(spark))
    return found.select("agent", "statement", "status", F.size("evidence").cast("long").alias("n_evidence"))


class Sayings:
    """Reads texts 'who: what' as one statement each, and what is said as a trait of who says it."""

    def __call__(self, chunks: DataFrame) -> DataFrame:
        who, what = F.split("content", ": ")[0], F.split("content", ": ")[1]
        statement = F.struct(what.alias("text"), F.array(F.element_at(F.split(what, " "), -1)).alias("entities"), who.alias("source"), F.lit("states").alias("attitude"))
        trait = F.struct(who.alias("entity"), F.element_at(F.split(what, " "), -1).alias("trait"))
        return chunks.select(F.col("chunk_key").alias("idx"), F.array(statement).alias("propositions"), F.array(trait).alias("traits"))


@query(
    f"""WITH {SAID_SQL}, old AS (SELECT DISTINCT user_id, text FROM said WHERE ts < '2024-01-15'),
    n AS (SELECT DISTINCT user_id, text FROM said WHERE ts >= '2024-01-15' AND text NOT IN (SELECT text FROM old))
    SELECT 'u' || user_id AS agent, text AS statement, 'Neutral' AS status FROM old
    UNION ALL SELECT 'u' || user_id, text, {STATUS_SQL.format("old")} FROM n"""
)
def event_pipeline(spark, sf):
    """Two batches of statements through the whole pipeline; the audits that it stored."""
    store = stores.Store(spark, work_path(spark))
    flow = streams.Pipeline(store, Sayings(), MODEL)
    said = _said(spark, sf).withColumn("content", F.concat(named("u", "user_id"), F.lit(": "), "text"))
    for batch in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        flow.process(said.where(batch).select("content").distinct())
    return store.read("audits").select("agent", "statement", "status")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Daily windows of a real stream with a watermark."""
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*")  # a pattern may match a file or a folder
    path = work_path(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/windows")

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    running = streams.tumbling(timed, "1 day", "40 days").writeStream.outputMode("complete").foreachBatch(keep)
    running.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ------------------------------------------------------------------ small functions
@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') = count(*) FILTER (WHERE o_orderstatus = 'F') AS equal FROM orders GROUP BY 1")
def equal_lengths(spark, sf):
    """Whether the lists of each customer's open and finished orders are equally long."""
    pick = lambda s: F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(pick("O").alias("a"), pick("F").alias("b"))
    return rows.select("o_custkey", text.equal_sizes(F.col("a"), F.col("b")).alias("equal"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def present_texts(spark, sf):
    return table(spark, sf, "documents").where(text.present(F.col("text"))).select("doc_id")


@query("SELECT 'o' || o_orderkey AS text FROM orders WHERE o_orderpriority <> '1-URGENT'")
def subjective_beliefs(spark, sf):
    """Beliefs that somebody in particular holds."""
    source = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(named("c", "o_custkey"))
    rows = table(spark, sf, "orders").select(named("o", "o_orderkey").alias("text"), text.owner_of(source).alias("source"))
    return audit.subjective(rows).select("text")
