"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotledger.llm import bpe, fingerprints, html, language, licenses, mixing, negatives, quality, repair, simhash, subwords, suffixes, urls
from shotledger.llm.common import table


def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*fingerprints.COLUMNS)


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return named.withColumn("held_out", F.coalesce(language.held_out("doc_id"), F.lit(False))).select(*language.COLUMNS)


def op3_suffix_array_dedup(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*suffixes.COLUMNS)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*simhash.COLUMNS)


def op5_license_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known_table(spark)).select(*licenses.COLUMNS)


def op6_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(*urls.COLUMNS)


def op7_byte_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(*html.COLUMNS)


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(*mixing.COLUMNS)


def op10_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*quality.COLUMNS)


def op11_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = subwords.classify(docs, subwords.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.withColumn("held_out", subwords.held_out("doc_id")).select(*subwords.COLUMNS)


def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(rows, repair.damaged(rows)).select(*repair.COLUMNS)


def op13_hard_negatives(spark, sf_dir):
    rows = negatives.usable(negatives.relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
    return negatives.mine(rows, rows.filter("item % 100 = 0")).select(*negatives.COLUMNS)


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_language_id, op3_suffix_array_dedup, op4_simhash_near_dedup, op5_license_scans, op6_url_filters, op7_byte_bpe, op8_html_extraction, op9_mixing, op10_quality_rules, op11_quality_classifier, op12_conversation_repair, op13_hard_negatives)}
ORACLE = {
    "op5_license_scans": licenses.oracle_sql(),
    "op6_url_filters": urls.oracle_sql(),
    "op9_mixing": mixing.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
    "op12_conversation_repair": repair.oracle_sql(),
    "op13_hard_negatives": negatives.oracle_sql(),
}
