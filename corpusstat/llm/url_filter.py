"""URL filters: allow and block rules, and a logistic regression on hashed character n-grams of host and path.

Scoring is built from Spark's own functions alone. The model is fitted with numpy on the driver, on a labelled table of
at most MAX_LABELLED rows. Weights are whole numbers, so sums don't depend on an order and SQL can repeat them.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 2000
#: Buckets of the hash, size of an n-gram, and whole units of a weight.
BUCKETS, GRAM, UNIT = 2048, 3, 10_000

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: The small labelled table is drawn from these words: of pages worth reading (0), and of bets, pills, loans, copies and adult pages (1).
GOOD_WORDS = "news history science museum library weather garden recipe health travel music school university research city council article climate language culture biology physics chemistry literature theatre cinema sport football election economy report review guide tutorial documentation reference archive encyclopedia journal magazine blog forum community photo map village river mountain cooking bread tomato bicycle train railway energy water forest animal bird dog cat children family teacher student lecture book novel poem painting architecture bridge church castle war peace law court parliament minister mayor police hospital doctor nurse medicine vaccine computer software programming python database network security privacy open data statistics method theory".split()
BAD_WORDS = "casino poker slots bonus jackpot betting roulette gamble spins wager viagra cialis pills pharmacy steroids weightloss xxx porn sex adult cams escort nude milf dating hookup replica rolex fake cheap discount outlet loan payday cash credit debt crypto doubler forex binary profit rich winner prize lottery giveaway free click ads banner popup tracker affiliate referral promo torrent crack keygen serial warez nulled hack cheat followers likes".split()
GENERAL = "www index page home about en de fr es www2 m item view main".split()


def labelled(seed: int = 3, each: int = 400) -> list[tuple[str, str, int]]:
    """(host, path, label), drawn from the words."""
    r = random.Random(seed)
    out = []
    for y, own in ((0, GOOD_WORDS), (1, BAD_WORDS)):
        word = lambda: r.choice(own) if r.random() < 0.8 else str(r.randrange(1, 10_000)) if r.random() < 0.5 else r.choice(GENERAL)
        for _ in range(each):
            host = r.choice(("", "www.", "m.", "blog.")) + r.choice(own) + r.choice(("", "-" + word(), word(), "." + r.choice(own))) + r.choice((".example", "")) + r.choice((".com", ".org", ".net", ".info", ".biz"))
            path = "".join("/" + word() + r.choice(("", "-" + word(), "_" + word())) for _ in range(r.randrange(0, 4))) + r.choice(("", "/", ".html"))
            out.append((host, path, y))
    for _ in range(each // 4):  # neutral addresses
        out.append((r.choice(("", "www.")) + r.choice(("example", "site", "host", "web")) + str(r.randrange(100)) + ".example" + r.choice((".com", ".org", ".net")), "".join(f"/{r.choice(GENERAL)}/{r.randrange(10_000)}" for _ in range(r.randrange(3))), 0))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null or an address without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(text: str) -> list[int]:
    """Buckets of a text's n-grams; the SQL in codes() and scores() is the same."""
    codes = [ord(c) for c in text]
    return [(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:])]


@lru_cache
def fit(rows: tuple[tuple[str, str, int], ...], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[tuple[int, ...], int]:
    """Whole weights of the buckets and the intercept, by full-batch gradient descent."""
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled rows")
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r[2] for r in rows], float)
    for i, (host, path, _) in enumerate(rows):
        np.add.at(x[i], grams(f"^{host}^{path}$"), 1)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + decay * w)
        b -= rate * error.mean()
    return tuple(int(v) for v in np.round(w * UNIT)), int(round(b * UNIT))


def score(text: Column, weights: tuple[int, ...], intercept: int) -> Column:
    """The model's log odds in units, from the n-grams of text."""
    table = F.expr(f"cast(split('{','.join(map(str, weights))}', ',') as array<bigint>)")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    hashed = lambda held: F.transform(held, lambda c, i: F.when(i >= 2, F.get(held, i - 2) * 961 + F.get(held, i - 1) * 31 + c))
    add = lambda a, h: a + F.coalesce(F.get(table, h % BUCKETS), F.lit(0).cast("long"))
    # An array of one array: its lambda binds the codes, so they are made once a text and not once a character.
    return F.get(F.transform(F.array(codes), lambda held: F.aggregate(hashed(held), F.lit(intercept).cast("long"), add)), 0)


def judge(pages: DataFrame, *, rules=RULES, rows: list[tuple[str, str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, log_odds (in 1/UNIT), verdict.

    A rule is a host and the start of a path; it fits the host and its subdomains if the path starts so. Of the rules that
    fit, the longest gives the verdict (of equally long ones the first in the order of the text); where none fits, the model blocks at log odds of 0 or more. rules are a
    short list, at most 1,000. A null or malformed url has an empty host and path and is judged like any other; a url of any length is read whole, in time that grows with its length; null and repeated ids stay as they are.
    No rows give no rows; other columns are ignored."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    weights, intercept = fit(tuple(rows or labelled()))
    df = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    df = df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    fits = [(F.col("path").startswith("/" + r.partition("/")[2])) & ((F.col("host") == r.partition("/")[0]) | F.col("host").endswith("." + r.partition("/")[0])) for r, _ in ordered]
    rule = F.coalesce(*(F.when(f, F.lit(r)) for f, (r, _) in zip(fits, ordered)), F.lit(None).cast("string"))
    fixed = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in ordered), F.lit(None).cast("string"))
    df = df.withColumn("rule", rule).withColumn("_text", F.concat(F.lit("^"), "host", F.lit("^"), "path", F.lit("$"))).withColumn("log_odds", score(F.col("_text"), weights, intercept))
    verdict = F.coalesce(fixed, F.when(F.col("log_odds") >= 0, "block").otherwise("allow"))
    return df.select(F.col("_id").alias(id_col), "host", "path", "rule", "log_odds", verdict.alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for judge() over pages."""
    weights, intercept = fit(tuple(labelled()))
    fits = lambda r: f"(starts_with(path, '/{r.partition('/')[2]}') AND (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')))"
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in ordered) + " WHEN log_odds >= 0 THEN 'block' ELSE 'allow' END"
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule, list_transform(string_split('^' || host || '^' || path || '$', ''), lambda x: unicode(x)) AS codes, {list(weights)} AS weights FROM b),
d AS (SELECT *, CAST({intercept} + coalesce(list_sum(list_transform(range(3, len(codes) + 1), lambda i: weights[(codes[i - 2] * 961 + codes[i - 1] * 31 + codes[i]) % {BUCKETS} + 1])), 0) AS BIGINT) AS log_odds FROM c)
SELECT page_id, host, path, rule, log_odds, {verdict} AS verdict FROM d"""
