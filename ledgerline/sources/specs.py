"""Spec readers: validation targets (YAML), role specs and privilege models (JSON).

Validation lists are a handful of entries and stay on the driver. Role specs
and privilege models are read by Spark and exploded to one row per rule /
level / permission, which is the shape the operators join on.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.tieout import Validation

_RULE = "struct<TYPE:string,DATABASE:string,SCHEMA:string,WAREHOUSE:string,ROLE:string>"
ROLE_SPEC_SCHEMA = (f"map<string,struct<ORDER:string,INCLUDE:array<{_RULE}>,EXCLUDE:array<{_RULE}>,"
                    "CUSTOM_INCLUDE:array<string>,CUSTOM_EXCLUDE:array<string>,SCIM_ROLES:array<string>>>")
MODEL_SCHEMA = ("struct<TYPE:string,ROLE_OWNER:string,ROLE_HIERARCHY:array<string>,"
                "ROLE_PERMISSIONS:map<string,map<string,array<string>>>,AR_PREFIX:string>")


def overlay(docs: Iterable[dict]) -> dict:
    """Later documents override earlier ones by top-level key."""
    out: dict = {}
    for d in docs:
        out.update(d or {})
    return out


def read_validations(paths: Iterable[str], target: str) -> tuple[dict, list[Validation]]:
    """A YAML validation target → (output settings, validations).

    Raises with the known targets when ``target`` is missing.
    """
    import yaml  # driver-side, small documents only

    docs = []
    for p in paths:
        with open(p) as fh:
            docs.append(yaml.safe_load(fh))
    cfg = overlay(docs)
    if target not in cfg:
        raise KeyError(f"{target!r} is not a target; targets available: {', '.join(map(repr, cfg))}")
    t = cfg[target]
    vals = [Validation(v["NAME"], tuple(v["KEY"]), v["FROM_TBL"], v["TO_TBL"], tuple(v.get("IGNORE_COLS") or ()))
            for v in t["VALIDATIONS"]]
    settings = {k: t[k] for k in ("OUTPUT_DB", "OUTPUT_SC", "OUTPUT_PREFIX") if k in t}
    return settings, vals


def _json_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file with its place in the list; the list is a few files long."""
    read = spark.read.option("wholetext", "true")
    docs = [read.text(p).select(F.col("value").alias("doc"), F.lit(i).alias("seq")) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b), docs)


def role_spec_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs(doc STRING)`` of role-spec JSON → (rules, custom) frames.

    rules: role_name, rule (INCLUDE/EXCLUDE), obj_type, db_pattern, sc_pattern,
    wh_pattern, role_pattern, role_type. For TYPE ROLE the ROLE field is the
    role-name pattern; otherwise it is the access level.
    custom: role_name, rule (CUSTOM_INCLUDE/CUSTOM_EXCLUDE), role_ref.

    With a ``seq`` column, a role named by several documents is taken whole from
    the one with the largest ``seq``.
    """
    order = F.col("seq") if "seq" in docs.columns else F.lit(0)
    roles = (docs.select(order.alias("seq"), F.explode(F.from_json("doc", ROLE_SPEC_SCHEMA)).alias("role_name", "s"))
             .groupBy("role_name").agg(F.max_by("s", "seq").alias("s")))
    parts = []
    for rule in ("INCLUDE", "EXCLUDE"):
        r = roles.select("role_name", F.lit(rule).alias("rule"), F.explode_outer(f"s.{rule}").alias("x"))
        parts.append(r.filter(F.col("x").isNotNull()).select(
            "role_name", "rule", F.col("x.TYPE").alias("obj_type"), F.col("x.DATABASE").alias("db_pattern"),
            F.col("x.SCHEMA").alias("sc_pattern"), F.col("x.WAREHOUSE").alias("wh_pattern"),
            F.when(F.col("x.TYPE") == "ROLE", F.col("x.ROLE")).alias("role_pattern"),
            F.when(F.col("x.TYPE") != "ROLE", F.col("x.ROLE")).alias("role_type")))
    rules = parts[0].unionByName(parts[1])
    custom = (roles.select("role_name", F.lit("CUSTOM_INCLUDE").alias("rule"), F.explode("s.CUSTOM_INCLUDE").alias("role_ref"))
              .unionByName(roles.select("role_name", F.lit("CUSTOM_EXCLUDE").alias("rule"),
                                        F.explode("s.CUSTOM_EXCLUDE").alias("role_ref"))))
    return rules, custom


def read_role_spec(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    return role_spec_rows(_json_text(spark, paths))


def privilege_model_rows(docs: DataFrame) -> DataFrame:
    """``docs(doc STRING)`` of model JSON → (obj_type, ar_prefix, pos, role,
    privilege, kind, role_owner) rows; a level whose privilege lists no kinds
    keeps one row with NULL kind."""
    m = docs.select(F.from_json("doc", MODEL_SCHEMA).alias("m"))
    lv = m.select(F.col("m.TYPE").alias("obj_type"), F.col("m.AR_PREFIX").alias("ar_prefix"),
                  F.col("m.ROLE_OWNER").alias("role_owner"), F.col("m.ROLE_PERMISSIONS").alias("perms"),
                  F.posexplode("m.ROLE_HIERARCHY").alias("pos", "role"))
    pr = lv.select("obj_type", "ar_prefix", "role_owner", "pos", "role",
                   F.explode_outer(F.col("perms")[F.col("role")]).alias("privilege", "kinds"))
    return pr.select("obj_type", "ar_prefix", "pos", "role", "privilege",
                     F.explode_outer("kinds").alias("kind"), "role_owner")


def read_privilege_model(spark: SparkSession, paths: list[str]) -> DataFrame:
    return privilege_model_rows(_json_text(spark, paths))


def docs_frame(spark: SparkSession, docs: Iterable[dict]) -> DataFrame:
    """In-memory documents (already parsed) as a ``docs`` frame."""
    return spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)], "doc string, seq int")
