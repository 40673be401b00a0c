"""Vectors of texts: the encoder interface, a hashing encoder that needs no model, and a cache keyed by what vectors depend on."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.text import prompted


class Encoder(Protocol):
    """What encoders offer: a width, a name that tells their vectors apart, and vectors of a batch of texts, made on executors."""

    width: int
    name: str

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed counts of hashed words, scaled to length 1. The same on every machine."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hashing-{width}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.width] += 1 if h >> 63 else -1
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def encode(df: DataFrame, key: str, text: str, encoder: Encoder, prompt: str = "", batch: int = 256) -> DataFrame:
    """`<key>`, `v` of each row's text; null texts are empty."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = np.asarray(encoder([x or "" for x in part.column("text").to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))],
                    names=["key", "v"]
                )

    rows = df.select(F.col(key).cast("string").alias("key"), prompted(prompt, F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return rows.mapInArrow(kernel, "key string, v array<float>").withColumnRenamed("key", key)


def context(**what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    fs, at = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def store_name(base: str, *parts: str) -> str:
    """A name for a store of one model's vectors: the base and a slug of the parts, of 64 characters at most, a digest in place of
    what is cut off.
    """
    slug = re.sub(r"[^a-zA-Z0-9._-]+", "-", "__".join(p for p in parts if p).lower()).strip(".-_") or "model"
    if len(slug) > 64:
        slug = f"{slug[:53]}-{hashlib.sha1(slug.encode()).hexdigest()[:10]}"
    return f"{base}_{slug}"


def cached(
    spark: SparkSession, folder: str, key: str, df: DataFrame, make: Callable[[DataFrame], DataFrame],
    column: str = "docno", resume: str = "auto", chunks: int = 8
) -> DataFrame:
    """make(df), kept at folder/key. Rows go in `chunks` by a hash of `column`; chunks that are finished stay, so what an interruption left is done again chunk by chunk.

    `restart` makes all of them again. `fail` takes only a folder that holds no other context.
    """
    path = f"{folder.rstrip('/')}/{key}"
    fs, at = _folder(spark, path)
    if resume == "restart":
        fs.delete(at, True)
    if resume == "fail" and not fs.exists(at) and fs.exists(at.getParent()) and len(fs.listStatus(at.getParent())):
        raise ValueError(f"{folder} holds vectors of another context")
    parts = [f"{path}/chunk-{i:04}-of-{chunks:04}" for i in range(chunks)]
    for i, part in enumerate(parts):
        if not finished(spark, part):
            make(df.where(F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(chunks)) == i)).write.mode("overwrite").parquet(part)
    return spark.read.parquet(*parts)


def newest(spark: SparkSession, folder: str) -> str | None:
    """The latest finished table in a folder of cached ones."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(folder)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(to):
        return None
    whole = lambda p: any(fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")) for x in [p, *(c.getPath() for c in fs.listStatus(p) if c.isDirectory())])
    done = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(to) if s.isDirectory() and whole(s.getPath())]
    return max(done)[1] if done else None
