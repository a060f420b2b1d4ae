"""Entities, aliases and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import dims, text
from heliograph.operators import entities, graph
from heliograph.plans.registry import query
from heliograph.plans.source_queries import SQL_ALIASES, part_aliases
from heliograph.plans.text_queries import NORM, SQUASH, TOKEN
from heliograph.session import stored

c = F.col
# RE2 knows no Unicode word boundary: both sides read the documents with each
# letter outside ASCII folded to "x".
SQL_FOLD = SQUASH.format(r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')")
SQL_MENTIONS = rf"""
found AS (SELECT doc_id, regexp_extract_all({SQL_FOLD}, '\b([A-Z][\w&.-]+(?:\s+[A-Z][\w&.-]+)*)\b', 1) AS f FROM documents),
m AS (SELECT doc_id, unnest(range(len(f)))::int AS pos, unnest(f) AS text FROM found)
"""


def found(t):
    folded = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    docs = t.documents.select("doc_id", text.normalize_text(folded).alias("n"))
    return entities.mentions(docs, "doc_id", "n")


@query("extract_entities", f"WITH {SQL_MENTIONS} SELECT doc_id, pos, text, 'MISC' AS label, 0.9::double AS confidence FROM m")
def _(t):
    return found(t)


@query(
    "link_all",
    f"WITH {SQL_MENTIONS} SELECT doc_id, lower(text) AS key, arg_min(text, pos) AS text, min(pos) AS pos FROM m GROUP BY doc_id, lower(text)",
)
def _(t):
    return entities.link(found(t), "doc_id").select("doc_id", "key", "text", "pos")


@query(
    "alias_resolve",
    f"""WITH {SQL_ALIASES}, fam AS (SELECT qid, array_to_string(list_sort(list_distinct(list(surface))), '|') AS aliases FROM aliases GROUP BY qid),
    s AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'Open AI' ELSE p_name END AS surface FROM part)
    SELECT p_partkey, coalesce(canonical, s.surface) AS canonical, a.qid, coalesce(fam.aliases, s.surface) AS aliases
    FROM s LEFT JOIN aliases a ON a.surface = lower(s.surface) LEFT JOIN fam ON fam.qid = a.qid""",
)
def _(t):
    surfaces = t.part.select("p_partkey", F.when(c("p_size") > 40, "Open AI").otherwise(c("p_name")).alias("surface"))
    resolved = entities.resolve_aliases(surfaces, "surface", part_aliases(t))
    return resolved.select("p_partkey", "canonical", "qid", F.array_join("aliases", "|").alias("aliases"))


@query(
    "merge_duplicates",
    """
    WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS seq, p_name AS canonical, CASE WHEN p_size > 10 THEN 'Q' || p_brand END AS qid,
               p_type AS a1, p_brand AS a2, l_quantity::bigint AS n FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT coalesce(qid, lower(canonical)) AS key, arg_min(qid, seq) AS qid, sum(n)::bigint AS count,
           array_to_string(list_sort(list_distinct(list_concat(list(a1), list(a2)))), '|') AS aliases FROM e GROUP BY 1
    """,
)
def _(t):
    sold = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity").join(
        t.part, c("l_partkey") == c("p_partkey")
    )
    rows = sold.select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"), c("p_name").alias("canonical"),
        F.when(c("p_size") > 10, F.concat(F.lit("Q"), "p_brand")).alias("qid"),
        F.array("p_type", "p_brand").alias("aliases"), c("l_quantity").cast("bigint").alias("count"),
    )
    merged = entities.merge_duplicates(rows)
    return merged.select("key", "qid", "count", F.array_join("aliases", "|").alias("aliases"))


@query(
    "nodes_from_entities",
    r"""
    SELECT p_partkey, CASE WHEN p_size > 10 THEN 'Q' || p_partkey ELSE 'entity:' || regexp_replace(lower(p_name), '\s+', '_', 'g') END AS id,
           'entity' AS type, p_name AS name, p_size / 50.0 AS weight, p_brand AS ner_label FROM part
    """,
)
def _(t):
    rows = t.part.select(
        "p_partkey", c("p_name").alias("text"), c("p_brand").alias("label"), (c("p_size") / 50.0).alias("confidence"),
        F.lit("en").alias("language"), F.when(c("p_size") > 10, F.concat(F.lit("Q"), "p_partkey")).alias("qid"),
    )
    keyed = rows.withColumn("label", F.concat_ws("|", "p_partkey", "label"))
    made = graph.nodes_from_entities(keyed)
    tag = F.split(F.element_at("attrs", "ner_label"), r"\|")
    return made.select(F.get(tag, F.lit(0)).cast("bigint").alias("p_partkey"), "id", "type", "name", "weight",
                       F.get(tag, F.lit(1)).alias("ner_label"))


# -- topics ----------------------------------------------------------------------------
SQL_STOP = ", ".join(f"'{w}'" for w in dims.STOPWORDS)
SQL_TOPICS = f"""
kw AS MATERIALIZED (SELECT doc_id, {NORM} AS n,
       list_filter(regexp_extract_all(lower({NORM}), '{TOKEN}'), lambda x: x NOT IN ({SQL_STOP}) AND length(x) > 2) AS k FROM documents),
cl AS (SELECT doc_id, k, (('0x' || substr(md5(coalesce(k[1], n)), 1, 8))::ubigint % 20)::int AS cluster FROM kw)
"""


def clustered(t):
    docs = text.with_normalized(t.documents.select("doc_id", "text"), "text")
    cut = stored(docs.select("doc_id", "normalized"), tokens=text.tokens(F.lower("normalized")))
    return cut.withColumn("cluster", entities.hash_cluster(c("tokens"), c("normalized"), 20))


@query("hash_cluster", f"WITH {SQL_TOPICS} SELECT doc_id, cluster FROM cl")
def _(t):
    return clustered(t).select("doc_id", "cluster")


@query(
    "cluster_keywords",
    f"""WITH {SQL_TOPICS}, w AS (SELECT cluster, unnest(k) AS token FROM cl),
    r AS (SELECT cluster, token, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, token) AS rank FROM w GROUP BY cluster, token)
    SELECT cluster, token, n, rank::int AS rank FROM r WHERE rank <= 5""",
)
def _(t):
    return entities.cluster_keywords(clustered(t)).select("cluster", "token", c("count").alias("n"), "rank")


@query("kmeans_topics")
def _(t):
    assigned, labels = entities.kmeans_topics(t.documents.select("doc_id", "text"), "text", n_clusters=20)
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n_docs"))
    return sizes.join(labels, "cluster").select("cluster", "n_docs", F.array_join("terms", ", ").alias("terms"))


@query("kmeans_nearest", "SELECT doc_id, true AS at_nearest FROM documents")
def _(t):
    """Each document lies at the nearest of the 20 centres."""
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = entities.kmeans_distances(docs, "text", n_clusters=20)
    return found.select("doc_id", (c("own") <= c("nearest") + 1e-6).alias("at_nearest"))
