"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from . import common, decontaminate, licenses, lmscore, media, mixing, near_dup, secret_scan, tokens, toxicity, warc


def op1_token_ids(spark, sf_dir):
    return tokens.token_digest(common.table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.taken(common.table(spark, sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    return licenses.matches(common.table(spark, sf_dir, "documents"))


def op6_near_dup(spark, sf_dir):
    return near_dup.groups(common.table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op3_decontaminate(spark, sf_dir):
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_media(spark, sf_dir):
    return media.round_trip(common.table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op7_lm_score(spark, sf_dir):
    return lmscore.score(common.table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secret_scan.digest(common.table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


def queries():
    return {
        "op1_token_ids": op1_token_ids,
        "op2_mixing": op2_mixing,
        "op3_decontaminate": op3_decontaminate,
        "op4_media": op4_media,
        "op5_toxicity": op5_toxicity,
        "op6_near_dup": op6_near_dup,
        "op7_lm_score": op7_lm_score,
        "op8_secrets": op8_secrets,
        "op9_licenses": op9_licenses,
        "op10_warc": op10_warc,
    }


def oracle_sql():
    return {"op9_licenses": licenses.oracle()}
