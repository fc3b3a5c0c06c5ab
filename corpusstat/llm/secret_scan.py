"""Secret scans: candidates by shape, and a random forest that takes out the false ones.

Search and scoring are built from Spark's own functions alone: the trees become CASE expressions. The forest is fitted
with numpy on the driver from at most MAX_LABELLED labelled findings, whose features Spark computes with the same expressions.
"""

from __future__ import annotations

import random
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 5000
TREES, DEPTH, SEED = 15, 5, 7
MASK = "[SECRET]"
#: A candidate: a run of these characters, at least 20 long, with a digit.
RUN = "[A-Za-z0-9+/_=-]{20,}"
#: Behind a cue word, or as the password of an address, also what is shorter or has no digit.
SHORT = "[A-Za-z0-9+/_=!?@#$%^&*.~-]{7,}[A-Za-z0-9+/_=!@#$%^&*~-]"
USER, PASSWORD = "^//[^/@]*$", "^([^/@]{4,})@"
#: Pieces that readable strings are made of.
DICTIONARY = "example sample test dummy your key token secret here change placeholder insert user name path file home local share python lib the and ing tion ment heit ver data config value default class func get set module node version build release image index page report summary chapter section".split()
CUES = "(?i)(token|secret|passw|api.?key|access.?key|private.?key|auth|credential|bearer)"
ANTI = "(?i)(sha-?(1|256|512)|md5|digest|checksum|commit|revision|hash|uuid|guid|etag|fingerprint|integrity|sample|example|placeholder)"
PATHS = "(?i)(test|example|mock|fixture|doc|lock|sample)"
NAMES = ("length", "changes", "digits", "uppers", "distinct", "covered", "hex", "cue", "anti", "path", "slashes")


#: What stands between words.
BREAK = "[\\s\"'`=:,;()<>{}|]+"


def bound(x: Column, f) -> Column:
    """f of x, worked out once: the lambda of an array of one binds it."""
    return F.get(F.transform(F.array(x), f), 0)


def words(text: Column) -> Column:
    return F.split(text, BREAK)


def candidates(text: Column) -> Column:
    """array of struct<place, run, value, before>: candidates by word and number within it, with the two words before each. They are the
    runs with a digit, and of a word without one, if it stands behind a cue word or a user's name, what may be a password."""
    return bound(words(text), among)  # split once, not for each word


def among(w: Column) -> Column:
    """The candidates among the words of a text."""
    placed = F.transform(w, lambda x, i: F.struct(i.alias("place"), x.alias("word")))
    before = lambda p: F.replace(F.concat_ws(" ", F.get(w, p["place"] - 2), F.get(w, p["place"] - 1)), F.lit(MASK), F.lit(""))
    user = lambda p: p["word"].contains("@") & F.coalesce(F.get(w, p["place"] - 1).rlike(USER), F.lit(False)) & p["word"].rlike(PASSWORD)
    runs = lambda p: F.filter(F.regexp_extract_all(p["word"], F.lit(f"({RUN})"), 1), lambda r: r.rlike("[0-9]"))
    near = F.filter(placed, lambda p: (F.length(p["word"]) >= 5) & ((p["word"].rlike(RUN) & p["word"].rlike("[0-9]")) | user(p) | ((F.length(p["word"]) >= 8) & before(p).rlike(CUES) & p["word"].rlike(SHORT))))
    full = F.transform(near, lambda p: F.struct(p["place"].alias("place"), p["word"].alias("word"), before(p).alias("before"), user(p).alias("user"), runs(p).alias("runs")))
    short = lambda p: F.when(p["user"], F.array(F.regexp_extract(p["word"], PASSWORD, 1))).when(p["before"].rlike(CUES) & p["word"].rlike(SHORT), F.array(F.regexp_extract(p["word"], SHORT, 0))).otherwise(F.array().cast("array<string>"))
    values = lambda p: F.when(F.size(p["runs"]) > 0, p["runs"]).otherwise(short(p))
    cue = lambda p: F.when(p["user"], F.concat(p["before"], F.lit(" password"))).otherwise(p["before"])
    return F.flatten(F.transform(full, lambda p: F.transform(values(p), lambda v, i: F.struct(p["place"].alias("place"), i.alias("run"), v.alias("value"), cue(p).alias("before")))))


def suspect(text: Column) -> Column:
    """Whether a text can have a candidate."""
    return text.rlike(RUN) | text.rlike(CUES) | text.rlike("//[^/@]*@")


def features(value: Column, before: Column, path: Column) -> list[Column]:
    """Whole numbers, in the order of NAMES; shares are in percent."""
    n = F.length(value)
    kinds = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    only = lambda rx: n - F.length(F.regexp_replace(value, rx, ""))
    percent = lambda k: F.floor(k * 100 / n).cast("int")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1
    return [
        n, percent(changes), percent(only("[0-9]")), percent(only("[A-Z]")), F.size(F.array_distinct(F.split(value, ""))), percent(n - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), ""))),
        F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 1).otherwise(0), F.when(before.rlike(CUES), 1).otherwise(0), F.when(before.rlike(ANTI), 1).otherwise(0), F.when(path.rlike(PATHS), 1).otherwise(0), only("/"),
    ]


def labelled(seed: int = SEED, each: int = 60) -> list[tuple[str, str, str, int]]:
    """Labelled findings (value, words before, path, is a secret), drawn from shapes of true secrets and of what is often mistaken for one."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    words_of = lambda n: "_".join(r.choice(DICTIONARY) for _ in range(n))
    plain = "of the in was with from und der les que".split()
    cue = lambda: r.choice(("token", "api_key", "secret", "password", "auth token", "access_key", "bearer", "x token"))
    anti = lambda: r.choice(("commit", "sha256", "md5", "checksum", "digest", "revision", "uuid", "etag", "hash"))
    near = lambda: f"{r.choice(plain)} {r.choice(plain)}"
    path = lambda: r.choice(("src0", "src7", "app/settings.py", "deploy.yml", "notes.txt"))
    out = []
    for _ in range(each):
        out += [(pick(hexes, r.choice((32, 40, 64))), cue(), path(), 1), (pick(alnum + "+/", 40), cue(), path(), 1), ("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), r.choice((cue(), near())), path(), 1), ("ghp_" + pick(alnum, 36), r.choice((cue(), near())), path(), 1), ("sk-" + pick(alnum, 45), r.choice((cue(), near())), path(), 1)]
        out += [(pick(hexes, r.choice((32, 40, 64))), anti(), path(), 0), (pick(hexes.upper(), 40), r.choice((anti(), near())), path(), 0), (str(uuid.UUID(int=r.getrandbits(128))), r.choice((anti(), near(), "id")), path(), 0), (words_of(4) + str(r.randrange(100)), r.choice((near(), cue())), path(), 0), ("your_" + words_of(2) + "_here_123", cue(), path(), 0)]
        out += [("/" + words_of(2).replace("_", "/") + "/lib/python3/" + words_of(1), near(), path(), 0), (pick("0123456789", r.randrange(20, 30)), near(), path(), 0), ("x" * r.randrange(16, 30) + "1234", cue(), path(), 0), (pick(hexes, 40), r.choice(("cue", "x")) + " example", "tests/fixture.py", 0)]
    # What stands behind a cue word: passwords and keys without a digit, parts of keys with points, and the words of running text.
    syllables = "ba ce di fo gu han ler mis nor pel qui ras ste tor und ver wei zon".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(3, 7)))
    for _ in range(each):
        mixed = lambda n: "".join(r.choice(kind) for kind in r.sample([alnum[:26], alnum[26:52], "0123456789", "!@#$%^&*"], 4)) + pick(alnum + "!@#$%^&*", n - 4)
        out += [(mixed(r.randrange(8, 20)), cue(), path(), 1), (pick(alnum, r.randrange(10, 20)) + str(r.randrange(10)), cue(), path(), 1), (pick(alnum[:52], r.randrange(20, 50)), cue(), path(), 1), (pick(alnum + "_-", r.choice((22, 43, 60, 90))) + str(r.randrange(10)), cue(), path(), 1)]
        out += [(r.choice((word(), word().capitalize(), word() + "-" + word(), word().upper())), cue(), path(), 0), (words_of(r.randrange(1, 5)) + "_value", cue(), path(), 0), (f"{r.randrange(1990, 2030)}-0{r.randrange(1, 10)}-{r.randrange(10, 30)}", cue(), path(), 0), (word() + r.choice(("/", ".", "...")) + word(), cue(), path(), 0)]
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees as nested (feature, threshold, low, high) or a leaf's share of secrets in thousandths; each from a bootstrap sample, each
    split the best by Gini of some of the features."""
    rng = np.random.default_rng(seed)

    def grow(rows, left):
        share = y[rows].mean()
        if not left or share in (0, 1) or len(rows) < 4:
            return int(round(1000 * share))
        best = None
        for f in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 3)]:
            for t in np.unique(np.percentile(x[rows, f], range(5, 100, 10), method="lower")).tolist():
                low = x[rows, f] <= t
                if low.all() or not low.any():
                    continue
                a, b = y[rows[low]], y[rows[~low]]
                gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or gini < best[0]:
                    best = (gini, int(f), int(t), low)
        if best is None:
            return int(round(1000 * share))
        _, f, t, low = best
        return (f, t, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def fit(spark: SparkSession, rows: list[tuple[str, str, str, int]] | None = None, **options) -> list:
    rows = rows or labelled()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled findings")
    df = spark.createDataFrame(rows, "value string, before string, path string, label int").coalesce(1)
    table = np.array([list(r) for r in df.select(*features(F.col("value"), F.col("before"), F.col("path")), "label").collect()])
    return forest(table[:, :-1], table[:, -1], **options)


def score(trees: list, values: list[Column]) -> Column:
    """Mean share of secrets over the trees, in thousandths."""

    def branch(tree):
        if isinstance(tree, int):
            return F.lit(tree)
        f, t, low, high = tree
        return F.when(values[f] <= t, branch(low)).otherwise(branch(high))

    return F.floor(sum((branch(t) for t in trees[1:]), branch(trees[0])) / len(trees)).cast("int")


def findings(text: Column, path: Column, trees: list) -> Column:
    """array of struct<place, run, value, score, secret> of one text."""
    rated = F.transform(candidates(text), lambda c: F.struct(c["place"].alias("place"), c["run"].alias("run"), c["value"].alias("value"), F.array(*features(c["value"], c["before"], path)).alias("f")))
    scored = F.transform(rated, lambda c: F.struct(c["place"].alias("place"), c["run"].alias("run"), c["value"].alias("value"), score(trees, [F.get(c["f"], i) for i in range(len(NAMES))]).alias("score")))
    return F.transform(scored, lambda c: F.struct(c["place"], c["run"], c["value"], c["score"], (c["score"] >= 500).alias("secret")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", trees: list | None = None) -> DataFrame:
    """One row per candidate: id, place (number of the word), run (number within the word), value, score (0 to 1000), secret (500 or more).

    Nulls: a null or empty text has no candidates, a null path no path words, a null id stays. Repeated rows are scanned one by
    one. No rows, or none with a candidate, give no rows; other columns are ignored."""
    trees = trees or fit(docs.sparkSession)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), path.alias("_path"))
    rows = rows.where(suspect(F.col("_text"))).select("_id", F.explode(findings(F.col("_text"), F.col("_path"), trees)).alias("c"))
    return rows.select(F.col("_id").alias(id_col), "c.*")


def redact(docs: DataFrame, *, text_col: str = "text", path_col: str | None = "source", trees: list | None = None, mask: str = MASK) -> DataFrame:
    """docs with each secret replaced by the mask in the word where it was found; the same string in a word where the forest judged it harmless stays, as do
    all other columns and rows. Texts without a secret, nulls among them, stay the same. Texts of any length are read whole; repeated rows are treated
    alike; no rows give no rows."""
    trees = trees or fit(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found = F.filter(findings(text, path, trees), lambda c: c["secret"])

    def masked(found: Column) -> Column:
        """The text in pieces, one up to each word with secrets and one for the rest, so it takes time in proportion to words and secrets."""
        # Findings stand in the order of their words: a word's group begins where the place changes.
        starts = F.filter(F.transform(found, lambda c, i: F.when((i == 0) | (F.get(found, i - 1)["place"] != c["place"]), i)), lambda i: i.isNotNull())
        longest = lambda f: F.array_sort(f, lambda a, b: F.length(b["value"]) - F.length(a["value"]))  # noqa: E731  (a value within another comes after it)
        groups = bound(starts, lambda at: F.transform(at, lambda i, k: longest(F.slice(found, i + 1, F.coalesce(F.get(at, k + 1), F.size(found)) - i))))
        parts = F.array(F.struct(words(text).alias("w"), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0)).alias("s"), groups.alias("g")))

        def rebuilt(p):
            end = lambda i: F.coalesce(F.get(p["s"], i), F.lit(""))
            between = lambda a, b: F.array_join(F.zip_with(F.slice(p["w"], a + 1, b - a), F.slice(p["s"], a + 1, b - a), lambda w, s: F.concat(w, F.coalesce(s, F.lit("")))), "")
            place = lambda k: F.get(F.get(p["g"], k), 0)["place"]
            clean = lambda g, i: F.concat(F.aggregate(g, F.get(p["w"], i), lambda t, c: F.replace(t, c["value"], F.lit(mask))), end(i))
            pieces = F.transform(p["g"], lambda g, k: F.concat(between(F.when(k > 0, place(k - 1) + 1).otherwise(0), place(k)), clean(g, place(k))))
            last = place(F.size(p["g"]) - 1) + 1
            return F.concat(F.array_join(pieces, ""), between(last, F.size(p["w"])))

        return F.get(F.transform(parts, rebuilt), 0)

    either = bound(found, lambda f: F.when(F.size(f) > 0, masked(f)).otherwise(text))
    return docs.withColumn(text_col, F.when(suspect(text), either).otherwise(text))
