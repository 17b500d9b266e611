"""Filling fixed-capacity containers with items (problem 8).

Sum-of-squares online packing: an item goes to the fill level that makes the sum
over all levels of the squared number of partly filled containers least; the
numbers stand in a level array. Texts longer than a container are divided into
whole containers and a rest; no other text is divided.

Items are packed in groups of about GROUP (all groups at once); each leaves some
partly filled containers, which are items of the next round, until one group is
left. Groups and orders derive from the rows, so a task that runs again gives
the same containers.

Empty and null texts need no container (container_id null); repeated doc_ids
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.llm.bpe import encode_table
from quireloom.session import cut

CAPACITY, GROUP = 2048, 200_000


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container number of each item, in the order given; sizes between 1 and the capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by fill level
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    enough = np.iinfo(np.int64).max // 4
    out, made = [], 0
    for s in sizes:
        if s == capacity:
            out.append(made)
            made += 1
            continue
        grow = 2 * count[s:] + 1  # the change at the new level s, s+1, ..., capacity
        grow[-1] = 0  # a full container leaves the array
        leave = np.where(count[: capacity - s + 1] > 0, 1 - 2 * count[: capacity - s + 1], enough)
        leave[0] = 0  # level 0: a new container
        delta = (leave + grow)[::-1]
        level = capacity - s - int(np.argmin(delta))  # on ties the fullest
        if level:
            c = open_at[level].pop()
            count[level] -= 1
        else:
            c, made = made, made + 1
        if level + s < capacity:
            open_at[level + s].append(c)
            count[level + s] += 1
        out.append(c)
    return out


def _pack_groups(capacity: int, tag: str):  # noqa: ANN202
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["first", "item"], kind="stable")
        c = pack(b["size"].tolist(), capacity)
        return pd.DataFrame({"item": b["item"], "container": [f"{tag}-{key[0]}-{x}" for x in c], "size": b["size"]})

    return run


def pack_table(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items (item string, size int) -> (item, size, container string). Sizes outside 1..capacity aren't allowed."""
    sized = cut(items.select("item", F.col("size").cast("int").alias("size")))
    n = sized.count()
    groups, rnd = max(1, math.ceil(n / group)), 0
    todo = sized.withColumns({"g": F.pmod(F.xxhash64("item"), F.lit(groups)), "first": F.xxhash64("item")})
    placed = cut(todo.groupBy("g").applyInPandas(_pack_groups(capacity, "0"), "item string, container string, size int"))
    result = placed
    while groups > 1:  # what is partly filled in one group may complete what is in another
        rnd, groups = rnd + 1, max(1, groups // 16)
        part = result.groupBy("container").agg(F.sum("size").cast("int").alias("size")).where(F.col("size") < capacity)
        part = part.select(F.col("container").alias("item"), "size").withColumns({"g": F.pmod(F.xxhash64("item"), F.lit(groups)), "first": -F.col("size")})
        moved = cut(part.groupBy("g").applyInPandas(_pack_groups(capacity, str(rnd)), "item string, container string, size int"))
        moved = moved.select(F.col("item").alias("container"), F.col("container").alias("to"))
        result = cut(result.join(moved, "container", "left").select("item", F.coalesce("to", "container").alias("container"), "size"))
    return result


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): whole containers and the rest of long texts, one piece of others."""
    n = F.col("n_tokens")
    rest = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / capacity).cast("int") - 1)), lambda i: F.struct(i.alias("piece"), (i * capacity).alias("first_token"), F.least(F.lit(capacity), n - i * capacity).alias("n_tokens")))
    return docs.select("doc_id", F.inline(rest))


def packed_documents(spark: SparkSession, d: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container_id)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    p = cut(pieces(encode_table(docs, lengths_only=True).dropDuplicates(["doc_id"]), capacity))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    c = pack_table(p.where(F.col("n_tokens") > 0).select(key.alias("item"), F.col("n_tokens").alias("size")), capacity, group)
    return p.withColumn("item", key).join(c.select("item", F.col("container").alias("container_id")), "item", "left").drop("item")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of each document with its container."""
    return packed_documents(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers used, the least number possible, tokens, and the unused share in millionths."""
    p = packed_documents(spark, d).where(F.col("container_id").isNotNull())
    per = p.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    n, t = F.count("*"), F.coalesce(F.sum("fill"), F.lit(0))
    return per.agg(n.alias("n_containers"), F.ceil(t / CAPACITY).alias("n_least"), t.alias("n_tokens"), F.coalesce(F.floor((1 - t / (n * CAPACITY)) * 1_000_000), F.lit(0)).alias("unused_ppm"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, empty, whole, fits): whether a document has no token, its pieces are its tokens without gap or repetition, and its containers hold no more than they can."""
    p = cut(packed_documents(spark, d))
    load = p.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    end = F.col("first_token") + F.col("n_tokens")
    long = (F.count("*") == 1) | F.every((F.col("n_tokens") == CAPACITY) | (F.col("first_token") + F.col("n_tokens") == F.col("length")))
    j = p.join(load, "container_id", "left").join(p.groupBy("doc_id").agg(F.max(end).alias("length")), "doc_id")
    whole = (F.sum("n_tokens") == F.max("length")) & (F.countDistinct("piece") == F.count("*")) & (F.max("piece") + 1 == F.count("*")) & long
    return j.groupBy("doc_id").agg(F.every(F.col("container_id").isNull()).alias("empty"), whole.alias("whole"), F.every(F.coalesce(F.col("load") <= CAPACITY, F.lit(True))).alias("fits"))
