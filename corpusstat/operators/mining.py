"""Text mining and similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.functions.vectors import unit as unit_vector
from corpusstat.tables import Scratch

#: Hashes of n-grams that are broadcast at once, at most.
HASHES_AT_ONCE = 4_000_000


def term_counts(df: DataFrame, unit: str, terms: Column) -> DataFrame:
    """Rows (unit, term, tf)."""
    return df.select(unit, F.explode(terms).alias("term")).groupBy(unit, "term").agg(F.count("*").alias("tf"))


def log_odds(df: DataFrame, unit: str, terms: Column, flagged: Column) -> DataFrame:
    """Z of a term's document counts in flagged against other documents, with 0.5 for smoothing."""
    sizes = df.agg(F.sum(F.when(flagged, 1).otherwise(0)).alias("na"), F.sum(F.when(flagged, 0).otherwise(1)).alias("nb"))
    rows = df.select(F.when(flagged, 1).otherwise(0).alias("f"), F.explode(F.array_distinct(terms)).alias("term"))
    counts = rows.groupBy("term").agg(F.sum("f").alias("a"), F.sum(1 - F.col("f")).alias("b")).join(F.broadcast(sizes))
    a, b, na, nb = (F.col(c) for c in ("a", "b", "na", "nb"))
    odds = F.log((a + 0.5) / (na - a + 0.5)) - F.log((b + 0.5) / (nb - b + 0.5))
    return counts.select("term", "a", "b", (odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).alias("z"))


def tf_idf(df: DataFrame, unit: str, terms: Column) -> DataFrame:
    """Mean over documents of (1 + ln tf) * idf, idf = ln((N + 1) / (df + 1)) + 1."""
    n = df.agg(F.count("*").alias("docs"))
    by_term = term_counts(df, unit, terms).groupBy("term").agg(F.count("*").alias("df"), F.sum(1 + F.log("tf")).alias("s")).join(F.broadcast(n))
    return by_term.select("term", "df", (F.col("s") / F.col("docs") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))


def class_tf_idf(df: DataFrame, group: str, terms: Column, k: int) -> DataFrame:
    """A group's k top words by n * ln(1 + A / f), A the mean words of a group; ties by word."""
    cells = df.select(group, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    words, mean = cells.groupBy("term").agg(F.sum("n").alias("f")), cells.groupBy(group).agg(F.sum("n").alias("t")).agg(F.avg("t").alias("mean"))
    scored = cells.join(words, "term").join(F.broadcast(mean)).withColumn("score", F.round(F.col("n") * F.log(1 + F.col("mean") / F.col("f")), 6))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= k).select(group, "term", "n", "score", "rank")


def upper_fence(df: DataFrame, value: str) -> DataFrame:
    """Tukey's upper fence of log10 of a share."""
    q = F.percentile(F.log10(value), F.array(F.lit(0.25), F.lit(0.75)))
    return df.agg(q.alias("q")).select(F.pow(F.lit(10.0), F.get("q", 1) + 1.5 * (F.get("q", 1) - F.get("q", 0))).alias("fence"))


#: Stop words by language.
STOP_WORDS = {
    "en": "the and of to in for with a is are you we our will be as on that this your or by from at an have it".split(),
    "de": "und der die das mit für von zu den im ist sie wir ein eine auf bei als oder nicht sich werden dem".split(),
    "fr": "les des et de la le du pour avec une un dans vous nous sur est que qui au aux en ou par pas".split(),
    "nl": "het een van de en voor met je wij u op te zijn bij ook naar niet als maar dat die".split(),
    "sv": "och att i på för med är en som du vi till av det den har ett kan inte om eller våra".split(),
    "es": "los las del con para por una que es en el la y de se su al como más o sus nuestro".split(),
    "it": "il lo gli le di del della con per una che è sono nel nella e ed in non si come tra più".split(),
    "pl": "i w z na do się jest oraz nie dla przez lub który od jak to po przy czy".split(),
    "el": "και το την του της τα των με για στο στη από που να είναι σε ένα μια".split(),
}


def own_words(words: dict[str, list[str]]) -> dict[str, list[str]]:
    """Each language's words that no other language has."""
    seen = [w for ws in words.values() for w in set(ws)]
    return {lang: [w for w in ws if seen.count(w) == 1] for lang, ws in words.items()}


def language(df: DataFrame, key: str, text: Column, words: dict[str, list[str]] = STOP_WORDS, least: int = 5) -> DataFrame:
    """The language whose own stop words (those in no other language's list) a text has at least `least` times and more than twice as often as the next
    one's; else unclear."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    count = lambda ws: F.size(F.filter("w", lambda w: w.isin(ws)))
    df = df.select(key, found.alias("w"))
    counts = F.reverse(F.array_sort(F.array(*(F.struct(count(ws).alias("n"), F.lit(lang).alias("lang")) for lang, ws in own_words(words).items()))))
    df = df.select(key, counts.alias("c"))
    first, second = F.get("c", 0), F.get("c", 1)
    return df.select(key, F.when((first["n"] >= least) & (first["n"] > 2 * second["n"]), first["lang"]).otherwise("unclear").alias("language"), first["n"].alias("hits"))


def ngrams(segments: Column, n: int) -> Column:
    """The distinct n-grams of arrays of words; none crosses a segment."""
    grams = lambda words: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return F.array_distinct(F.flatten(F.filter(F.transform(segments, grams), lambda g: g.isNotNull())))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit words, each bit of which depends on all of the given ones'."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """A batch's words, segment by segment: each one's hash, its document, and how many words its segment still has from it on."""

    def __init__(self, segments: pa.ListArray):
        inner = segments.flatten()
        size = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = inner.flatten()
        coded = self.words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in names], np.uint64)
        self.hash = own[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(segments)), segments.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.doc = np.repeat(doc, size)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(self.hash))

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + i])
        return h.view(np.int64)

    def grams(self, at: np.ndarray, n: int) -> pa.Array:
        words = [self.words.take(pa.array(at + i)) for i in range(n)]
        return pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]


def once_each(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, and in how many documents each is."""
    order = np.lexsort((doc, value))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return np.unique(value[new], return_counts=True)


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def frequent_ngrams(df: DataFrame, segments: Column, longest: int, least: int, stop: list[str] = ()) -> DataFrame:
    """N-grams of 1 to `longest` words found in at least `least` documents, with that count. Only n-grams whose first and last n - 1
    words are frequent are counted. Those with a stop word at an edge are left out of the result, not of the search.

    Texts are cut up once. From two words on, n-grams are first counted by their 64-bit hashes, summed up in each batch; only those whose hash is frequent are written out as words, and counted as
    such, so equal hashes change no count. Frequent hashes are broadcast in blocks of HASHES_AT_ONCE, one pass each; where one level has more than that, the next isn't held against it
    before it is counted, which changes what is counted but not what is found. Each level is made once."""
    spark = df.sparkSession
    tables, levels, before = Scratch(spark, "ngrams"), [], None
    docs = tables.write("docs", df.select(segments.cast("array<array<string>>").alias("_segments")))

    def sorted_hashes(t: DataFrame) -> np.ndarray:
        return np.sort(t.toArrow().column(0).to_numpy())

    def written(n: int, hashes: np.ndarray | None) -> DataFrame:
        """(gram, df) of each batch, of the n-grams with one of the hashes."""
        shared = spark.sparkContext.broadcast(hashes)

        def f(batches):
            for batch in batches:
                runs = Runs(batch.column(0))
                at = runs.starts(n)
                if shared.value is not None:
                    at = at[among(runs.hashes(at, n), shared.value)]
                coded = runs.grams(at, n).dictionary_encode()
                code, docs_ = once_each(runs.doc[at], coded.indices.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(docs_, pa.int64())], names=["gram", "df"])

        return docs.mapInArrow(f, "gram string, df long")

    def counted(n: int, known: np.ndarray | None) -> DataFrame:
        """(h, df) of each batch's n-grams, without those whose first or last n - 1 words aren't known."""
        shared = spark.sparkContext.broadcast(known)

        def f(batches):
            for batch in batches:
                runs = Runs(batch.column(0))
                at = runs.starts(n)
                if shared.value is not None:
                    at = at[among(runs.hashes(at, n - 1), shared.value)]
                    at = at[among(runs.hashes(at + 1, n - 1), shared.value)]
                h, docs_ = once_each(runs.doc[at], runs.hashes(at, n))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(docs_, pa.int64())], names=["h", "df"])

        return docs.mapInArrow(f, "h long, df long")

    def of_words(batches):
        for batch in batches:
            each = np.arange(batch.num_rows + 1, dtype=np.int32)
            runs = Runs(pa.ListArray.from_arrays(pa.array(each), pa.ListArray.from_arrays(pa.array(each), batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(runs.hashes(runs.starts(1), 1), pa.int64())], names=["h"])

    total = lambda rows, by: rows.groupBy(by).agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    for n in range(1, longest + 1):
        if n == 1:
            words = tables.write("level-1", total(written(1, None), "gram"))
            levels.append(words.withColumn("n", F.lit(1)))
            often = words.select("gram").mapInArrow(of_words, "h long")
            many = words.count()
        else:
            often = tables.write("often", total(counted(n, before), "h").select("h"))
            many = often.count()
            blocks, found = max(1, -(-many // HASHES_AT_ONCE)), None
            for b in range(blocks):
                part = written(n, sorted_hashes(often.where(F.pmod("h", F.lit(blocks)) == b)))
                found = part if found is None else found.union(part)
            levels.append(tables.write(f"level-{n}", total(found, "gram")).withColumn("n", F.lit(n)))
        before = sorted_hashes(often) if many <= HASHES_AT_ONCE else None
    tables.drop("docs", "often")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    words = F.split("gram", " ")
    return out.where(~F.get(words, F.lit(0)).isin(list(stop)) & ~F.element_at(words, -1).isin(list(stop))) if stop else out


def npmi(df: DataFrame, terms: Column, tops: DataFrame, group: str, term: str) -> DataFrame:
    """Normalised pointwise mutual information of each pair of a group's top words, by documents; -1 for a pair never seen, 1 where
    it is in all. tops has a bounded number of words (k a group) and is broadcast; a document's pairs are of those words alone."""
    words = df.sparkSession.createDataFrame([(sorted({r[0] for r in tops.select(term).distinct().collect()}),)], "top array<string>")  # k words a group
    seen = df.select(terms.alias("_t")).join(F.broadcast(words)).select(F.array_sort(F.array_intersect("_t", "top")).alias("s"))
    total = seen.agg(F.count("*").alias("docs"))
    pairs = seen.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"))
    single = pairs.where("a = b")
    left, right = tops.select(group, F.col(term).alias("a")), tops.select(F.col(group).alias("_g"), F.col(term).alias("b"))
    wanted = left.join(right, (F.col(group) == F.col("_g")) & (F.col("a") < F.col("b"))).select(group, "a", "b")
    out = wanted.join(pairs, ["a", "b"], "left").join(single.select("a", F.col("n").alias("na")), "a").join(single.select(F.col("b"), F.col("n").alias("nb")), "b").join(F.broadcast(total))
    p = F.col("n") / F.col("docs")
    value = F.when(F.col("n").isNull(), -1.0).when(p >= 1, 1.0).otherwise(F.log(p / (F.col("na") / F.col("docs") * F.col("nb") / F.col("docs"))) / -F.log(p))
    return out.select(group, "a", "b", value.alias("npmi"))


def df_distribution(df: DataFrame, unit: str, terms: Column, cuts: list[float]) -> DataFrame:
    """For each cut the items in more than that share of documents, their part of items and mentions, and the part of documents that
    hold one of them or would be left empty without them. A document needs only its rarest and most frequent item."""
    rows = df.select(unit, F.explode(F.array_distinct(terms)).alias("item"))
    counts = rows.groupBy("item").agg(F.count("*").alias("c"))
    total = df.agg(F.count("*").alias("docs"))
    cut = F.explode(F.array(*(F.lit(float(c)) for c in cuts))).alias("cut")
    items = counts.join(F.broadcast(total)).select("c", "docs", cut).groupBy("cut").agg(F.count_if(F.col("c") / F.col("docs") > F.col("cut")).alias("items"), F.count("*").alias("_all"), F.sum(F.when(F.col("c") / F.col("docs") > F.col("cut"), F.col("c")).otherwise(0)).alias("_m"), F.sum("c").alias("_mentions"))
    docs = rows.join(counts, "item").groupBy(unit).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).join(F.broadcast(total)).select("lo", "hi", "docs", cut)
    hit = docs.groupBy("cut").agg((F.count_if(F.col("hi") / F.col("docs") > F.col("cut")) / F.first("docs")).alias("hit"), (F.count_if(F.col("lo") / F.col("docs") > F.col("cut")) / F.first("docs")).alias("emptied"))
    return items.join(hit, "cut").select("cut", "items", (F.col("items") / F.col("_all")).alias("item_share"), (F.col("_m") / F.col("_mentions")).alias("mention_share"), "hit", "emptied")


def coherence(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Length of the mean of a group's vectors, each first brought to length 1; its rows are summed by position before the shuffle. Zero vectors stay zero."""
    rows = df.select(group, F.posexplode(unit_vector(F.col(vector).cast("array<double>"))).alias("at", "x"))
    means = rows.groupBy(group, "at").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(group).agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("coherence"))


def knn_vote(near: DataFrame, labels: DataFrame, key: str, label: str, least: float) -> DataFrame:
    """The most frequent label among each query's neighbours (ties by label), where its part of them reaches `least`; else null."""
    votes = near.join(labels.select(F.col(key).alias("neighbour"), label), "neighbour").groupBy("query", label).agg(F.count("*").alias("n"))
    best = votes.groupBy("query").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    won = votes.join(best, "query").where("n = most").groupBy("query").agg(F.min(label).alias(label), (F.first("most") / F.first("all")).alias("agreement"))
    return won.select("query", F.when(F.col("agreement") >= least, F.col(label)).alias(label), "agreement")
