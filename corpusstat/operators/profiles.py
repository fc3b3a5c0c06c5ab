"""Profiles: occupation lookup and matching, sector and degree priors, tiers, and alias merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occupation_skills(relations: DataFrame, occupation: str = "occupation", skill: str = "skill", kind: str = "kind", place: str = "place") -> DataFrame:
    """Per occupation its essential skills, then its optional ones, in table order, each once."""
    first = relations.groupBy(occupation, skill).agg(F.min(F.struct((F.col(kind) != "essential").alias("o"), F.col(place).alias("p"))).alias("at"))
    return first.groupBy(occupation).agg(F.sort_array(F.collect_list(F.struct("at.o", "at.p", F.col(skill).alias("s")))).alias("l")).select(occupation, F.col("l.s").alias("skills"))


#: Characters of a piece by which texts and labels that may hold each other meet.
PIECE = 6


def pieces(df: DataFrame, lengths: Column) -> DataFrame:
    """(s, piece): the distinct pieces of each string that are as long as any of the lengths."""
    chars = df.select("s", F.filter(F.split("s", ""), lambda c: c != "").alias("c"))
    at = lambda n: F.when(F.size("c") >= n, F.transform(F.sequence(F.lit(1), F.size("c") - n + 1), lambda i: F.array_join(F.slice("c", i, n), "")))
    cut = F.flatten(F.filter(F.transform(lengths, at), lambda x: x.isNotNull()))
    return chars.select("s", F.explode(F.array_distinct(cut)).alias("piece"))


def held(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer, inner): all pairs of the strings s of both tables of which the first contains the second, both distinct and not empty.

    They meet by a piece of the inner string: the one that the fewest outer ones have (the whole string, if it is shorter than a piece). So a common piece is a key only for strings that have nothing
    rarer, and a string with a piece that no outer one has meets none."""
    short = [n for (n,) in inner.select(F.least(F.length("s"), F.lit(PIECE)).alias("n")).distinct().collect()]  # at most PIECE numbers
    have = pieces(outer, F.array(*(F.lit(n) for n in sorted(short)))) if short else pieces(outer.limit(0), F.array(F.lit(1)))
    often = have.groupBy("piece").agg(F.count("*").alias("n"))
    # Pieces are many times the strings, which an estimate of sizes doesn't see: these joins are never to be broadcast.
    wanted = pieces(inner, F.array(F.least(F.length("s"), F.lit(PIECE)))).join(often.hint("merge"), "piece", "left")
    rarest = wanted.groupBy("s").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min(F.struct("n", "piece")).alias("m")).where("missing = 0")
    met = have.select(F.col("s").alias("outer"), "piece").hint("merge").join(rarest.select(F.col("s").alias("inner"), F.col("m.piece").alias("piece")), "piece")
    return met.where(F.contains("outer", "inner")).select("outer", "inner")


def match_labels(rows: DataFrame, text: str, labels: DataFrame, label: str, code: str) -> DataFrame:
    """The code of the label that equals a text, else of the longest label that contains it or is contained in it (ties by label). Null and empty texts and labels match none; of a
    label's codes the least counts. Each distinct text is matched once, and texts and labels may be many: those that hold each other meet by pieces (held()), not in a loop over both."""
    found = labels.select(F.lower(F.trim(label)).alias("_label"), F.col(code).alias("_code")).where("_label <> ''").groupBy("_label").agg(F.min("_code").alias("_code"))
    texts = rows.select(F.lower(F.trim(text)).alias("s")).where("s <> ''").distinct()
    names = found.select(F.col("_label").alias("s"))
    rest = texts.join(names, "s", "left_anti")
    longer, shorter = held(names, rest), held(rest, names)
    met = longer.select(F.col("inner").alias("_text"), F.col("outer").alias("_label")).union(shorter.select("outer", "inner"))
    # greatest by length, and of those the least label: two steps, since strings have no negative
    most = met.groupBy("_text").agg(F.max(F.length("_label")).alias("_n"))
    best = met.join(most, "_text").where(F.length("_label") == F.col("_n")).groupBy("_text").agg(F.min("_label").alias("_label"))
    best = best.union(texts.join(names, "s", "left_semi").select("s", F.col("s")))
    chosen = best.join(found, "_label").select("_text", F.col("_code").alias(code), F.col("_label").alias(label))
    return rows.withColumn("_text", F.lower(F.trim(text))).join(chosen, "_text", "left").drop("_text")


def prior_buckets(tier1: DataFrame, sectors: str = "sectors", degree: str = "degree", skills: str = "skills", least: int = 20) -> DataFrame:
    """P2, first half: rows (sector, degree, size, skill, n) of the buckets with at least `least` profiles; degree is null in the bucket
    of a whole sector. A sector named twice in a profile counts twice, as do its skills."""
    rows = tier1.where(F.size(skills) > 0).select(F.explode(sectors).alias("sector"), F.nullif(F.col(degree), F.lit("")).alias("degree"), F.col(skills).alias("skills"))
    both = rows.where("degree is not null").unionByName(rows.withColumn("degree", F.lit(None).cast("string")))
    sizes = both.groupBy("sector", "degree").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    counts = both.select("sector", "degree", F.explode("skills").alias("skill")).groupBy("sector", "degree", "skill").agg(F.count("*").alias("n"))
    c, s = counts.alias("c"), sizes.alias("s")
    return c.join(s, (F.col("c.sector") == F.col("s.sector")) & F.col("c.degree").eqNullSafe(F.col("s.degree"))).select("c.sector", "c.degree", "size", "skill", "n")


def default_skills(profiles: DataFrame, buckets: DataFrame, key: str, sectors: str = "sectors", degree: str = "degree", top: int = 10) -> DataFrame:
    """P2, second half: per profile the `top` most frequent skills of its sectors' buckets together (ties by skill), the specific bucket of a
    sector first, else the sector's own; bucket_type is mixed where both were used. Profiles with no bucket give no row.
    Distinct (sectors, degree) are worked out once and joined back, so the work doesn't grow with the profiles."""
    kinds = profiles.select(F.col(sectors).alias("_s"), F.nullif(F.col(degree), F.lit("")).alias("_d")).where(F.size("_s") > 0).distinct()
    wants = kinds.select("_s", "_d", F.posexplode("_s").alias("_at", "sector"))
    have = buckets.select("sector", F.col("degree").alias("_bd"), "size").distinct()
    used = wants.join(have, "sector").where(F.col("_bd").isNull() | (F.col("_bd") == F.col("_d")))
    used = used.groupBy("_s", "_d", "_at", "sector").agg(F.max_by(F.struct("_bd", "size"), F.col("_bd").isNotNull()).alias("_b")).select("_s", "_d", "sector", "_b.*")
    about = used.groupBy("_s", "_d").agg(F.sum("size").alias("bucket_size"), F.count_if(F.col("_bd").isNotNull()).alias("_spec"), F.count_if(F.col("_bd").isNull()).alias("_wide"))
    u, b = used.alias("u"), buckets.alias("b")
    met = u.join(b, (F.col("u.sector") == F.col("b.sector")) & F.col("u._bd").eqNullSafe(F.col("b.degree"))).groupBy("_s", "_d", "skill").agg(F.sum("n").alias("n"))
    ranked = met.withColumn("_rn", F.row_number().over(W.partitionBy("_s", "_d").orderBy(F.desc("n"), "skill"))).where(F.col("_rn") <= top)
    lists = ranked.groupBy("_s", "_d").agg(F.sort_array(F.collect_list(F.struct("_rn", "skill"))).alias("_l"))
    kind = F.when((F.col("_spec") > 0) & (F.col("_wide") > 0), "mixed").when(F.col("_spec") > 0, "sector_degree").otherwise("sector_only")
    a, x = about.alias("a"), lists.alias("x")
    ready = a.join(x, (F.col("a._s") == F.col("x._s")) & F.col("a._d").eqNullSafe(F.col("x._d"))).select(F.col("a._s").alias("_s"), F.col("a._d").alias("_d"), F.col("_l.skill").alias("default_skills"), kind.alias("bucket_type"), "bucket_size")
    p = profiles.select(key, F.col(sectors).alias("_ps"), F.nullif(F.col(degree), F.lit("")).alias("_pd"))
    return p.join(ready, (F.col("_ps") == F.col("_s")) & F.col("_pd").eqNullSafe(F.col("_d"))).select(key, "default_skills", "bucket_type", "bucket_size")


def occupation_uri(uris: Column, prefix: str) -> Column:
    """The first of the addresses that starts with the prefix."""
    return F.get(F.filter(uris, lambda u: u.startswith(prefix)), 0)


def tiers(profiles: DataFrame, relations: DataFrame, labels: DataFrame, key: str, prefix: str, least: int = 20) -> DataFrame:
    """Per profile its tier, mechanism and skills. Tier 1 has skills of its own, tier 2 those of its occupation by address and then by
    text, tier 3 those of its sectors and degree (learned from tier 1), tier 4 none. profiles has key, skills, occupation_uris, occupation,
    sectors, degree; relations has occupation, skill, kind, place; labels has label and uri. Null lists are empty."""
    known = occupation_skills(relations)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    p = profiles.select(key, empty("skills").alias("skills"), empty("sectors").alias("sectors"), "degree", "occupation", occupation_uri(empty("occupation_uris"), prefix).alias("_uri"))
    p = p.join(known.select(F.col("occupation").alias("_uri"), F.col("skills").alias("_by_uri")), "_uri", "left")
    p = match_labels(p, "occupation", labels, "label", "uri").join(known.select(F.col("occupation").alias("uri"), F.col("skills").alias("_by_text")), "uri", "left")
    prior = default_skills(p.where(F.size("skills") == 0), prior_buckets(p, least=least), key)
    p = p.join(prior, key, "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    ways = [("skills", 1, "direct"), ("_by_uri", 2, "occupation_uris"), ("_by_text", 2, "occupation_text_exact"), ("default_skills", 3, None)]
    pick = lambda value, other: F.coalesce(*(F.when(some(c), value(c, n, m)) for c, n, m in ways), other)
    return p.select(key, pick(lambda c, n, m: F.lit(n), F.lit(4)).alias("tier"), pick(lambda c, n, m: F.lit(m) if m else F.col("bucket_type"), F.lit("none")).alias("mechanism"), pick(lambda c, n, m: F.col(c), F.array().cast("array<string>")).alias("skills_used"))


def merge_alias(df: DataFrame, source: str, alias: str, canon: str, keys: list[Column]) -> DataFrame:
    """Rows of the alias source that share any key with a row of the canonical source go; its other rows are relabelled. Null keys match nothing."""
    tagged = df.withColumn("_row", F.xxhash64(F.to_json(F.struct("*")))).withColumn("_keys", F.array(*(F.struct(F.lit(i).alias("i"), k.cast("string").alias("k")) for i, k in enumerate(keys))))
    exploded = lambda s: tagged.where(F.col(source) == s).select("_row", F.explode("_keys").alias("_k")).where("_k.k is not null")
    gone = exploded(alias).join(exploded(canon).select("_k").distinct(), "_k", "left_semi").select("_row").distinct()
    merged = tagged.where(F.col(source) == alias).join(gone, "_row", "left_anti").withColumn(source, F.lit(canon))
    return tagged.where(~F.col(source).eqNullSafe(F.lit(alias))).unionByName(merged).drop("_row", "_keys")
