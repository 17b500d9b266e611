"""References to records that do not exist: runs of parent keys and as-of matches of references.

Parent keys with an integer order are compressed into contiguous runs of keys
that lived at the same times. A run has its first and last integer, these
lifetimes and, in order, what the keys are besides their integer. A reference is
matched as of its integer and time: to the run whose start precedes the integer,
beyond whose end it leads nowhere, and within which it leads nowhere unless a
lifetime holds the reference's time (else the parent came late or is deleted)
and the key at that place is the one referred to.

Runs are cut at multiples of WIDTH, so that one group's runs spread over many
tasks, a match never leaves its (group, slot), and at most WIDTH keys meet a
reference. Keys without a readable integer are runs of one in slots of their own.
Null reference lists and null ids hold no reference; a null group, or a null
time, finds no parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 64


def key_number(block_id: Column) -> Column:
    """The running number in ids such as p0001-b0023-0123456789abcdef; null for other forms."""
    return F.regexp_extract(block_id, r"^p\d+-b(\d{1,15})-[0-9a-f]+$", 1).try_cast("bigint")


def _slot(number: Column, key: Column) -> Column:
    return F.when(number.isNotNull(), F.floor(number / WIDTH).cast("bigint")).otherwise(F.xxhash64(key))


def key_runs(parents: DataFrame, group: str, key: str) -> DataFrame:
    """(group, slot, runs): per slot the runs {lo, hi, lives, keys} of parents (group, key, b, e)."""
    n = key_number(F.col(key))
    p = parents.where(F.col(key).isNotNull()).select(group, F.col(key).alias("key"), "b", "e", F.coalesce(n, F.lit(0)).alias("n"), _slot(n, F.col(key)).alias("slot"))
    p = p.repartition(group, "slot")  # once; all steps below keep it
    one = p.groupBy(group, "slot", "n", "key").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("lives"))
    w = Window.partitionBy(group, "slot", "lives").orderBy("n", "key")
    runs = one.withColumn("island", F.col("n") - F.row_number().over(w)).groupBy(group, "slot", "lives", "island")
    runs = runs.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("ks"))
    run = F.struct("lo", "hi", "lives", F.col("ks.key").alias("keys"))
    return runs.groupBy(group, "slot").agg(F.collect_list(run).alias("runs"))  # at most WIDTH runs of the integers of a slot


def matched(refs: DataFrame, runs: DataFrame, group: str, key: str, at: str) -> DataFrame:
    """refs with in_run (a run reaches the integer; null: no integer), in_life (and lived then) and alive (and has the key)."""
    n, k = key_number(F.col(key)), F.col(key)
    r = refs.withColumns({"ref_n": F.coalesce(n, F.lit(0)), "ref_plain": n.isNotNull(), "slot": _slot(n, k)})
    j = r.join(runs, [group, "slot"], "left")
    reach = F.filter("runs", lambda x: (x["lo"] <= F.col("ref_n")) & (F.col("ref_n") <= x["hi"]))
    j = j.withColumn("reach", reach)
    lived = lambda x: F.exists(x["lives"], lambda t: (t["b"] <= F.col(at)) & (t["e"].isNull() | (F.col(at) < t["e"])))
    found = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumns({
        "in_run": F.when(F.col("ref_plain"), found(F.size("reach") > 0)), "in_life": found(F.exists("reach", lived)),
        "alive": found(F.exists("reach", lambda x: lived(x) & (F.get(x["keys"], (F.col("ref_n") - x["lo"]).cast("int")) == k))),
    }).drop("slot", "runs", "reach", "ref_n", "ref_plain")


def orphans(refs: DataFrame, parents: DataFrame, group: str, key: str, at: str, begins: str, ends: str) -> DataFrame:
    """Rows of refs whose key has no parent row of the same group that is alive at the reference's time, with in_run and in_life.

    Alive: begins <= at and (ends null or at < ends). refs and parents have the
    columns group and key; refs has at, parents has begins and ends. Repeated
    parents count once; rows of refs are kept as they are.
    """
    runs = key_runs(parents.select(group, key, F.col(begins).alias("b"), F.col(ends).alias("e")), group, key)
    return matched(refs, runs, group, key, at).where(~F.col("alive")).select(*refs.columns, "in_run", "in_life")
