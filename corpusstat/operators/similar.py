"""Candidate terms, expansion by vectors, sentence matches, coherence against chance, occupation overlap and seeded clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.functions.vectors import length
from corpusstat.functions.vectors import unit as unit_vector
from corpusstat.operators.vectors import matrix
from corpusstat.tables import Scratch


def candidate_sheet(scored: DataFrame, found: DataFrame, seeds: Column, least_titles: int = 2, part: float = 0.8, most: int = 200) -> DataFrame:
    """Terms (term, a, z, ...) with positive z that a seed filter (true: too near a seed) lets through and that stand in at least so many distinct titles of
    `found` (term, title); a term that a longer kept one holds as a run of words, with at least `part` of its count, goes. The best `most` by z.

    Terms are settled by their number of words, the longest first, and meet through the runs of words of those kept, not as pairs of all terms. The terms let through are made once."""
    titles = found.select("term", F.lower(F.trim("title")).alias("t")).distinct().groupBy("term").agg(F.count("*").alias("titles"))
    rows = scored.where((F.col("z") > 0) & ~seeds).join(titles.where(F.col("titles") >= least_titles), "term").withColumn("n", F.size(F.split("term", " ")))
    rows = Scratch(scored.sparkSession, "sheet").write("rows", rows)
    kept = None
    for n in range(rows.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], 0, -1):
        level = rows.where(F.col("n") == n)
        if kept is not None:
            words = F.split("term", " ")
            spans = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
            inner = kept.select(F.col("a").alias("_a"), F.explode(F.array_distinct(spans)).alias("term")).groupBy("term").agg(F.max("_a").alias("_a"))
            level = level.join(inner, "term", "left").where(F.col("_a").isNull() | (F.col("_a") < part * F.col("a"))).drop("_a")
        kept = level if kept is None else kept.unionByName(level)
    return kept.drop("n").orderBy(F.desc("z"), "term").limit(most)


def expansion(near: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """T4: of the pairs (query: seed id, neighbour: candidate id, cosine) each candidate's best similarity, its seed (ties by term) and channel, and how many
    distinct seed terms reach it; the best `most`. seeds: (query, term, channel); a seed's spellings are queries of their own."""
    rows = near.join(seeds, "query")
    out = rows.groupBy("neighbour").agg(F.max(F.struct("cosine", F.col("query") * -1, "term", "channel")).alias("b"), F.count_distinct("term").alias("n_seeds"))
    out = out.select("neighbour", F.col("b.cosine").alias("sim"), F.col("b.term").alias("nearest_seed"), F.col("b.channel").alias("channel"), "n_seeds")
    return out.orderBy(F.desc("sim"), "neighbour").limit(most)


def sentence_matches(sentences: DataFrame, skills: DataFrame, unit: str, vector: str, skill: str, least: float, most_bytes: int = 64 << 20) -> DataFrame:
    """Of each unit and skill the best cosine of its sentences (rounded to 6) where it reaches `least`, and its band of 0.05. Skills' vectors are broadcast in blocks of
    about most_bytes, one pass over the sentences each, which stream past them in batches; so there may be any number of skills."""
    size, n = skills.agg(F.max(F.size(vector)), F.count("*")).first()
    kind, own = sentences.schema[unit].dataType.simpleString(), skills.schema[skill].dataType.simpleString()
    blocks, pairs = max(1, -(-(n * 8 * (size or 1)) // most_bytes)), None
    for block in range(blocks):
        table = skills.where(F.pmod(F.xxhash64(skill), F.lit(blocks)) == block).select(F.col(skill).alias("skill"), F.col(vector).alias("v")).orderBy("skill").toArrow()
        if not table.num_rows and (block or blocks > 1):
            continue
        shared = skills.sparkSession.sparkContext.broadcast((table.column("skill").to_pylist(), matrix(table.column("v")) if table.num_rows else None, table.column("skill").type))

        def f(batches, shared=shared):
            names, m, kind_pa = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows if m is not None else 0, 2048):
                    rows = batch.slice(at, 2048)
                    c = np.round(matrix(rows.column(1)) @ m.T, 6)
                    i, j = np.nonzero(c >= least)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(i)), pa.array([names[x] for x in j.tolist()], kind_pa), pa.array(c[i, j])], names=["unit", "skill", "sim"])

        part = sentences.select(unit, vector).mapInArrow(f, f"unit {kind}, skill {own}, sim double")
        pairs = part if pairs is None else pairs.union(part)
    best = pairs.groupBy("unit", "skill").agg(F.max("sim").alias("sim"), F.count("*").alias("sentences"))
    return best.withColumnsRenamed({"unit": unit, "skill": skill}).withColumn("band", F.floor(F.col("sim") * 20) / 20)


def vector_mean(df: DataFrame, by: list[str], vector: Column) -> DataFrame:
    """(by, n, m): the mean vector of each group, summed by position before the shuffle."""
    rows = df.select(*by, F.posexplode(vector).alias("at", "x"))
    means = rows.groupBy(*by, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("m"))


def centred(df: DataFrame, vector: str) -> DataFrame:
    """df with _v: the vector less the mean of all, of length 1 (a zero vector stays zero)."""
    mean = vector_mean(df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")), [], F.col("v")).select(F.col("m").alias("_mean"))
    out = df.join(F.broadcast(mean)).withColumn("_v", F.zip_with(F.transform(vector, lambda x: x.cast("double")), "_mean", lambda a, b: a - b))  # one row
    return out.withColumn("_v", unit_vector(F.col("_v"), 1e-9)).drop("_mean")


def coherence_lift(df: DataFrame, key: str, vector: str, items: Column, least: int, sets: int = 5, most: int = 2000, seed: int = 1) -> DataFrame:
    """Of each item with at least `least` rows, the length of the mean of its rows' centred vectors, and by how much that exceeds the mean of `sets` random
    sets of its size (in steps of 5, at most `most`). A random set of a size is the rows with the least hashes of set and key, so sets of several sizes share
    one ranking, which keeps `most` rows a set. Items of a row count once."""
    rows = centred(df.select(key, vector, F.array_distinct(items).alias("_items")), vector)
    own = vector_mean(rows.select(F.explode("_items").alias("item"), "_v"), ["item"], F.col("_v")).where(F.col("n") >= least)
    own = own.select("item", "n", length(F.col("m")).alias("coherence"), F.greatest(F.floor(F.least("n", F.lit(most)) / 5) * 5, F.lit(5)).cast("int").alias("size"))
    drawn = None
    for s in range(sets):
        h = F.xxhash64(F.lit(seed * 1000 + s), key)
        one = rows.select(F.lit(s).alias("set"), "_v", h.alias("_h"), F.col(key).alias("_k")).orderBy("_h", "_k").limit(most)
        drawn = one if drawn is None else drawn.union(one)
    ranked = drawn.withColumn("_rank", F.row_number().over(W.partitionBy("set").orderBy("_h", "_k"))).drop("_h", "_k")
    sizes = own.select("size").distinct()
    inside = ranked.join(F.broadcast(sizes), F.col("_rank") <= F.col("size"))  # at most most / 5 sizes
    base = vector_mean(inside, ["set", "size"], F.col("_v")).groupBy("size").agg(F.avg(length(F.col("m"))).alias("base"))
    return own.join(F.broadcast(base), "size").select("item", "n", "coherence", "base", (F.col("coherence") - F.col("base")).alias("lift"))


def occupation_overlap(members: DataFrame, items: DataFrame, relations: DataFrame, key: str, cluster: str, least: int, top: int) -> DataFrame:
    """Of each cluster (0 or more) with at least `least` rows that have items, the `top` occupations by the cosine of its items' shares and the occupation's
    items (1 essential, 0.5 optional), both times ln(rows / rows with the item). members (key, cluster), items (key, item) distinct, relations
    (occupation, item, essential) distinct."""
    held = members.join(items, key)
    n = held.agg(F.count_distinct(key).alias("_n"))
    idf = held.groupBy("item").agg(F.count("*").alias("_df")).join(F.broadcast(n)).select("item", F.log(F.col("_n") / F.col("_df")).alias("idf"))  # one row
    have = held.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count_distinct(key).alias("with_items")).where(F.col("with_items") >= least)
    profile = held.groupBy(cluster, "item").agg(F.count("*").alias("_c")).join(have, cluster).join(idf, "item")
    profile = profile.select(cluster, "item", "with_items", (F.col("_c") / F.col("with_items") * F.col("idf")).alias("x"))
    occ = relations.join(idf, "item").select("occupation", "item", (F.when(F.col("essential"), 1.0).otherwise(0.5) * F.col("idf")).alias("y"))
    norm = lambda df, by, c, name: df.groupBy(by).agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(name))
    dots = profile.join(occ, "item").groupBy(cluster, "with_items", "occupation").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norm(profile, cluster, "x", "nx"), cluster).join(norm(occ, "occupation", "y", "ny"), "occupation")
    scored = scored.where("nx > 0 and ny > 0").withColumn("score", F.round(F.col("dot") / (F.col("nx") * F.col("ny")), 6))
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("score"), "occupation"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(cluster, "with_items", "occupation", "score", "rank")


def seeded_clusters(df: DataFrame, key: str, vector: str, seed: str, part: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, report). A seed cluster's centre is the mean of its seeds' vectors (column `seed`, null for the others). Its threshold is the larger of its
    seeds' least similarity to the centre of the other seeds (or, with part, that quantile of them) and the 99th percentile of all rows'
    similarities. Members are its seeds, and the rows whose nearest centre it is at or above the threshold. Centres are a short list and are broadcast."""
    rows = df.select(key, F.col(seed).alias("seed"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("v", unit_vector(F.col("v")))
    centres = vector_mean(rows.where("seed is not null"), ["seed"], F.col("v")).select(F.col("seed").alias("cluster"), F.col("n").alias("seeds"), F.col("m").alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sims = rows.join(F.broadcast(centres)).withColumn("sim", dot(F.col("v"), F.col("c")) / length(F.col("c")))  # rows by the short list of centres
    background = sims.groupBy("cluster").agg(F.percentile_approx("sim", 0.99, 10_000).alias("background"))
    # a seed against the mean of the others: n * c - v points the same way
    rest = F.zip_with("c", "v", lambda c, v: c * F.col("seeds") - v)
    loo = sims.where("seed = cluster and seeds > 1").withColumn("rest", rest).withColumn("loo", F.coalesce(F.try_divide(dot(F.col("v"), F.col("rest")), length(F.col("rest"))), F.lit(0.0)))
    floor = loo.groupBy("cluster").agg((F.percentile("loo", part) if part is not None else F.min("loo")).alias("floor"))
    report = background.join(floor, "cluster", "left").withColumn("threshold", F.greatest("floor", "background"))
    best = sims.groupBy(key, "seed").agg(F.max(F.struct("sim", "cluster")).alias("b")).select(key, "seed", F.col("b.cluster").alias("cluster"), F.col("b.sim").alias("sim"))
    near = best.where("seed is null").join(F.broadcast(report.select("cluster", "threshold")), "cluster").where(F.col("sim") >= F.col("threshold"))
    members = near.select(key, "cluster", F.lit(False).alias("is_seed")).union(rows.where("seed is not null").select(key, "seed", F.lit(True)))
    return members, report
