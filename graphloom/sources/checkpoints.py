"""Checkpoints of long runs: tables and a manifest that appears at once, and refusal to resume a different run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


def _files(spark: SparkSession, path: str):
    """The path's file system and what makes a path of a name in it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: make(f"{path}/{name}")


def save(spark: SparkSession, path: str, step: int, tables: Tables, signature: str) -> None:
    """Writes the tables under path and then the manifest of this step.

    Tables go to new folders and the manifest is renamed into place when all is written, so a run that ends in between leaves
    the step before as the last one. A step that has a manifest already is left alone.
    """
    places = {}
    for name, df in tables.items():
        places[name] = f"step-{step}-{uuid.uuid4().hex}/{name}"
        df.write.parquet(f"{path}/{places[name]}")
    fs, at = _files(spark, path)
    fs.mkdirs(at("manifests"))
    part = at(f"manifests/.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(json.dumps({"step": step, "signature": signature, "tables": places}).encode())
    out.close()
    fs.rename(part, at(f"manifests/{step:09d}.json"))


def load(spark: SparkSession, path: str, signature: str) -> tuple[int, Tables] | None:
    """The last whole step and its tables, or None where there is none. A manifest of another signature is refused with ValueError."""
    fs, at = _files(spark, path)
    if not fs.exists(at("manifests")):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(at("manifests")))
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return None
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifests/{names[-1]}").collect()))
    if manifest["signature"] != signature:
        raise ValueError("the checkpoint is of a run with other parameters or sources")
    return manifest["step"], {name: spark.read.parquet(f"{path}/{place}") for name, place in manifest["tables"].items()}


def resumable(spark: SparkSession, path: str, signature: str, start: Callable[[], Tables], step: Callable[[int, Tables], Tables], steps: int) -> Tables:
    """The tables after so many steps from start, a checkpoint after each; a run with the same signature goes on after the last whole step."""
    found = load(spark, path, signature)
    if found is None:
        save(spark, path, 0, start(), signature)
        found = load(spark, path, signature)
    done, tables = found
    for k in range(done + 1, steps + 1):
        save(spark, path, k, step(k, tables), signature)
        _, tables = load(spark, path, signature)
    return tables
