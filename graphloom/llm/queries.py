"""The pN_ queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import clusters, distinct, mixing, neardup, packing, similar, spam, termfreq
from graphloom.llm.tokens import token_count
from graphloom.llm.vectors import DISCRETE, instance_sequences, instance_vectors, node_sequences, node_vectors, table
from graphloom.operators.nodes import current_nodes
from graphloom.store import keep


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instance_vectors(spark, sf_dir).unionByName(node_vectors(spark, sf_dir))


def p1_found(spark, sf_dir):
    return clusters.tight_pairs(instance_vectors(spark, sf_dir))


def p1_clusters(spark, sf_dir):
    return clusters.similarity_clusters(instance_vectors(spark, sf_dir))


def p2_found(spark, sf_dir):
    found = similar.most_similar(_fields(spark, sf_dir), k=5, least=0.8)
    return found.select("field_name", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def p2_similar(spark, sf_dir):
    return similar.most_similar(_fields(spark, sf_dir), k=5, features=12)


def _near(spark, sf_dir):
    words = neardup.word_sets(current_nodes(table(spark, sf_dir, "nodes"), ("m_discrete",)), DISCRETE)
    return neardup.near_duplicates(neardup.instance_sets(instance_vectors(spark, sf_dir)).unionByName(words))


def p3_found(spark, sf_dir):
    return neardup.all_pairs(*_near(spark, sf_dir))


def p3_links(spark, sf_dir):
    """One row per record with a near-duplicate: the smallest id of its equal sets, and its links to other sets."""
    found, members = _near(spark, sf_dir)
    found = keep(found)
    ends = found.select("field_name", F.col("id_a").alias("id")).unionByName(found.select("field_name", F.col("id_b").alias("id")))
    links = ends.groupBy("field_name", "id").agg(F.count(F.lit(1)).alias("links"))
    own = members.select("field_name", "id", "rep", "n").unionByName(links.join(members, ["field_name", "id"], "left_anti").select("field_name", "id", F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("n")))
    return own.join(links.withColumnRenamed("id", "rep"), ["field_name", "rep"], "left").select("field_name", "id", F.col("rep").alias("class_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instance_sequences(spark, sf_dir).unionByName(node_sequences(spark, sf_dir))


def p4_found(spark, sf_dir):
    scored = distinct.distinctive_terms(_sequences(spark, sf_dir))
    return scored.where("held_by between 2 and 20 and share >= 0.1").select("field_name", "record_id", "fid")


def p4_scores(spark, sf_dir):
    return distinct.distinctive_terms(_sequences(spark, sf_dir)).withColumn("value", F.round("value", 6))


def p5_frequencies(spark, sf_dir):
    nodes = keep(current_nodes(table(spark, sf_dir, "nodes")))
    entries, holders = termfreq.node_entries(nodes)
    return termfreq.term_frequencies(termfreq.postings(entries), holders)


def p5_found(spark, sf_dir):
    return p5_frequencies(spark, sf_dir).where("mark <> 'useful'").select("field_name", "attr", "term", "mark")


def _sized(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns, token_count("text").alias("n_tokens"))


def p6_pack(spark, sf_dir):
    return packing.pack(_sized(spark, sf_dir), table(spark, sf_dir, "containers"))


def p6_fill(spark, sf_dir):
    return packing.fill_report(p6_pack(spark, sf_dir), table(spark, sf_dir, "containers"))


def p6_checks(spark, sf_dir):
    """Per container: documents placed, and whatever breaks a rule: overfull containers, documents in wrong pieces or needlessly divided."""
    boxes = table(spark, sf_dir, "containers")
    return packing.packing_checks(keep(p6_pack(spark, sf_dir)), keep(_sized(spark, sf_dir)), boxes)


def p7_mix(spark, sf_dir):
    return mixing.mix(_sized(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir):
    return mixing.share_report(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_checks(spark, sf_dir):
    return mixing.mixture_checks(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark, sf_dir):
    return spam.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p8_pages(spark, sf_dir):
    return spam.stuffed_pages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_similar, p3_found, p3_links, p4_found, p4_scores, p5_found, p5_frequencies, p6_pack, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_pages)
}
