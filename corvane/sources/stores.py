"""Stores of JSON documents: snapshots of selections, and saved mixes of paths."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "schema_version int, id string, created_at string, goal string, budget long, used long, "
    "entries array<struct<path:string,sha256:string,tokens:bigint,relevance:string,score:bigint,reason:string>>, skipped array<struct<path:string,reason:string>>"
)
MIX = "id string, name string, goal string, budget long, paths array<string>"


def valid_id(text: str) -> str:
    """Letters, digits, `.`, `_` and `-`, not led by a dot."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", text):
        raise ValueError(f"not an id: {text!r}")
    return text


class ManifestStore:
    """One folder of JSON a snapshot; saving never overwrites."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, manifest: DataFrame, name: str) -> None:
        manifest.coalesce(1).write.mode("errorifexists").json(f"{self.root}/{valid_id(name)}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/{valid_id(name)}")

    def list(self) -> DataFrame:
        """(id, created_at, goal) of all, oldest first."""
        rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(self.root)
        return rows.select("id", "created_at", "goal").orderBy("created_at", "id")

    def entries(self, name: str) -> DataFrame:
        return self.load(name).select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")


def find_mix(mixes: DataFrame, key: str) -> DataFrame:
    """The mix of this id, else the only one of this name; no row if none or several fit."""
    by_id = mixes.where(F.col("id") == key)
    named = mixes.where(F.col("name") == key)
    lone = named.join(named.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name"), "name", "left_semi")
    return by_id.unionByName(lone.join(by_id.select("name").limit(1), F.lit(True), "left_anti").select(by_id.columns)).limit(1)
