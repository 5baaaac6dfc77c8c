"""The registered queries of the operators."""

from __future__ import annotations

import os

import public_tokenizers

from . import (decontaminate, html, language, licences, pieces, ppm, pseudonyms, quality, runs, secrets, sharding, simhash,
               whitening)

MODEL = os.environ.get("PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op3_licence_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.scanned(docs, licences.trained(docs))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(language.remainder("doc_id", 5) != 0)
    return language.identified(docs, language.dictionaries(learn))


def op5_sentencepiece(spark, sf_dir):
    return pieces.encoded(table(spark, sf_dir, "documents"), MODEL)


def op6_ppm_scoring(spark, sf_dir):
    return ppm.scored(table(spark, sf_dir, "documents"), ppm.remainder("doc_id", 7) == 2)


def op7_pii_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"), wanted=4)


def op12_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scanned(docs, secrets.limits(docs))


def op13_periodic_runs(spark, sf_dir):
    return runs.periodic(table(spark, sf_dir, "documents"), plant=True)


def queries():
    found = [op1_quality_rules, op2_sharding, op3_licence_scan, op4_language_id, op5_sentencepiece, op6_ppm_scoring, op7_pii_pseudonyms, op8_html_extraction,
             op9_simhash_near_dedup, op10_decontamination, op11_embedding_whitening, op12_secret_scan, op13_periodic_runs]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {}
