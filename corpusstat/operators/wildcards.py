"""Word forms and the wildcards that catch them, from the words that texts are observed to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.tables import Scratch

#: A word: letters alone.
WORD = r"[\p{L}\p{M}]+"
#: Caught words that are broadcast to the texts, at most; more meet them by a shuffle.
FORMS_AT_ONCE = 200_000


def words_of(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def patterns_for(word: Column) -> Column:
    """The forms of a keyword that are tried: itself, wildcards for what follows it whole, without its last letter, without two, and of its first half (three letters at least), with an s, with one
    and a wildcard, and a wildcard for its first letter. Each once; none that is a wildcard alone."""
    n = F.length(word)
    star = lambda c: F.concat(c, F.lit("*"))
    cut = lambda k: F.substring(word, F.lit(1), k)
    half = F.greatest(F.lit(3), F.floor(n / 2).cast("int"))
    made = F.array(word, star(word), star(cut(F.greatest(n - 1, F.lit(0)))), star(cut(F.greatest(n - 2, F.lit(0)))), star(cut(half)), F.concat(word, F.lit("s")), star(F.concat(word, F.lit("s"))), F.concat(F.lit("*"), F.substring(word, F.lit(2), n)))
    return F.filter(F.array_distinct(made), lambda p: F.replace(p, F.lit("*"), F.lit("")) != "")


def keyword_forms(df: DataFrame, key: str, group: list[str], text: Column, cases: DataFrame, word: str, top: int = 6) -> DataFrame:
    """PB12: per case (group, word) and pattern the texts of the group that have a word that it catches, and its `top` word forms with the texts that have them (most first, then by name).

    The group's distinct words, with the texts that have them, are what patterns meet: by their fixed part, words being joined by their first (or last) letters, of only those lengths that patterns have, so
    no word is held against all patterns. Texts then meet the words that were caught alone. A pattern without a wildcard catches the word itself. Null words and texts catch and have nothing; a pattern that
    catches nothing has 0."""
    tables = Scratch(df.sparkSession, "forms")
    tried = cases.select(*group, F.lower(word).alias("word")).where("word <> ''").distinct().withColumn("pattern", F.explode(patterns_for(F.col("word"))))
    tried = tables.write("tried", tried.withColumns({"ahead": F.col("pattern").startswith("*"), "open": F.contains("pattern", F.lit("*")), "fixed": F.replace("pattern", F.lit("*"), F.lit(""))}))
    lengths = [r.n for r in tried.where("open").select(F.length("fixed").alias("n")).distinct().orderBy("n").collect()]  # as many as words have lengths
    groups = tried.select(*group).distinct()
    said = df.join(groups, group, "left_semi").select(*group, F.col(key).alias("_key"), F.explode(words_of(text)).alias("form"))
    seen = tables.write("seen", said.groupBy(*group, "form").agg(F.count("*").alias("n")))
    ends = F.array(*(F.when(F.length("form") >= n, F.struct(F.lit(True).alias("open"), F.lit(side).alias("ahead"), (F.right("form", F.lit(n)) if side else F.left("form", F.lit(n))).alias("fixed"))) for n in lengths for side in (False, True)),
                   F.struct(F.lit(False).alias("open"), F.lit(False).alias("ahead"), F.col("form").alias("fixed")))
    parts = seen.select(*group, "form", "n", F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e")).select(*group, "form", "n", "e.*")
    forms = tables.write("caught", parts.join(tried, [*group, "open", "ahead", "fixed"]).select(*group, "word", "pattern", "form", "n"))
    caught = tables.write("by_form", forms.groupBy(*group, "form").agg(F.collect_list(F.struct("word", "pattern")).alias("_p")))
    small = F.broadcast if caught.count() <= FORMS_AT_ONCE else lambda x: x
    # the patterns of a text's words, each once a text; what is left are as many rows as texts have patterns
    met = said.join(small(caught), [*group, "form"]).select(*group, "_key", F.explode("_p").alias("_p")).select(*group, "_p.word", "_p.pattern", "_key").distinct()
    texts = met.groupBy(*group, "word", "pattern").agg(F.count("_key").alias("texts"))
    rank = F.row_number().over(W.partitionBy(*group, "word", "pattern").orderBy(F.desc("n"), "form"))
    best = forms.withColumn("rank", rank).where(F.col("rank") <= top).groupBy(*group, "word", "pattern").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "form", "n"))), lambda f: F.concat_ws(" ", f["form"], f["n"])), ", ").alias("forms"))
    names = [*group, "word", "pattern"]
    return tried.select(*names).join(texts, names, "left").join(best, names, "left").select(*names, F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("forms", F.lit("")).alias("forms"))


def shortest_wildcards(seen: DataFrame, families: DataFrame, least: int = 3, spill: float = 0.0, top: int = 6) -> DataFrame:
    """PB12's design: per word the shortest prefix of at least `least` letters that all its forms share and whose other catches are at most `spill` of all texts' mentions that it catches; where none is, the longest. With it the forms'
    mentions, those of other words that it would catch, how many others, and the `top` of them.

    seen: (form, n), each observed word once with its mentions; families: (word, form). A prefix index of the observed words, cut to the prefixes that families have, gives the mentions under each
    prefix, so no word is held against all wildcards. Forms that were never observed count for the common prefix but have no mentions. Words whose forms share fewer than `least` letters give no row."""
    own = families.where("word is not null and form <> ''").select("word", "form").distinct()
    # The common prefix of all forms is that of the least and the greatest.
    ends = own.groupBy("word").agg(F.min("form").alias("a"), F.max("form").alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.length("a"), F.length("b"))), lambda n: F.when(F.left("a", n) == F.left("b", n), n).otherwise(0))
    tried = ends.select("word", F.array_max(same).alias("n"), "a").where(F.col("n") >= least).select("word", F.explode(F.sequence(F.lit(least), F.col("n"))).alias("length"), "a").select("word", "length", F.left("a", F.col("length")).alias("prefix"))
    wanted = tried.select("prefix").distinct()
    index = seen.where(F.length("form") >= least).select("form", "n", F.explode(F.transform(F.sequence(F.lit(least), F.length("form")), lambda k: F.left(F.col("form"), k))).alias("prefix")).join(wanted, "prefix", "left_semi")
    under = index.groupBy("prefix").agg(F.sum("n").alias("mentions"), F.count("*").alias("words"))
    mine = own.join(seen, "form").groupBy("word").agg(F.sum("n").alias("own_mentions"), F.count("*").alias("own_words"))
    held = tried.join(under, "prefix", "left").join(mine, "word", "left").na.fill(0, ["mentions", "words", "own_mentions", "own_words"])
    held = held.withColumn("others", F.col("mentions") - F.col("own_mentions")).withColumn("good", F.coalesce(F.try_divide("others", "mentions") <= spill, F.lit(True)))
    best = held.groupBy("word").agg(F.coalesce(F.min(F.when(F.col("good"), F.struct("length", "prefix", "mentions", "words", "own_mentions", "own_words", "others"))), F.max(F.struct("length", "prefix", "mentions", "words", "own_mentions", "own_words", "others"))).alias("b")).select("word", "b.*")
    caught = best.select("word", "prefix").join(index, "prefix").join(own, ["word", "form"], "left_anti")
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("n"), "form"))
    few = caught.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "form", "n"))), lambda f: F.concat_ws(" ", f["form"], f["n"])), ", ").alias("other_forms"))
    return best.join(few, "word", "left").select("word", F.concat("prefix", F.lit("*")).alias("wildcard"), "own_mentions", "others", (F.col("words") - F.col("own_words")).alias("other_words"), F.coalesce("other_forms", F.lit("")).alias("other_forms"))


def keyword_months(df: DataFrame, day: Column, source: str, text: Column, words: list[str]) -> DataFrame:
    """PB14: per month and source all texts and those that have any of the words (in any case, as whole words of letters), with 0 for months between the first and the last in which a source has none. Null days and
    sources are left out. Months and sources are few; texts are counted once."""
    low = F.array(*(F.lit(w.lower()) for w in words))
    hit = F.arrays_overlap(words_of(text), low)
    counts = df.select(F.trunc(day, "month").alias("month"), F.col(source).alias("source"), hit.alias("hit")).where("month is not null and source is not null")
    counts = counts.groupBy("month", "source").agg(F.count("*").alias("texts"), F.count_if("hit").alias("with_word"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    cells = counts.select("source").distinct().join(F.broadcast(grid))  # a row a month
    return cells.join(counts, ["month", "source"], "left").select("month", "source", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("with_word", F.lit(0)).alias("with_word"))
