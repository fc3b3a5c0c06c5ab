"""Operators on small made-up rows: profiles and their tiers, allocation, jumps, streams."""

from datetime import date

from pyspark.sql import functions as F

from corpusstat.operators import mining, ordered, profiles, stretches
from corpusstat.streaming import days

PROFILE = "id int, skills array<string>, occupation_uris array<string>, occupation string, sectors array<string>, degree string"
PREFIX = "http://example.org/occupation/"


def people():
    full = [(i, ["s1", "s2"] if i % 2 else ["s1"], None, None, ["ict"], "bachelor" if i < 25 else "master") for i in range(50)]
    full += [(i, ["s3"], [], None, ["retail"], "bachelor" if i < 65 else "master") for i in range(50, 80)]
    return full + [
        (100, [], [PREFIX + "a"], None, ["ict"], None),
        (101, None, ["http://example.org/isco/1"], " Senior Cook ", None, None),
        (102, [], None, "unknown trade", ["ict"], "bachelor"),
        (103, [], None, None, ["retail"], "bachelor"),
        (104, [], None, None, ["ict", "retail"], "bachelor"),
        (105, None, None, None, ["space"], "phd"),
        (106, None, None, None, None, None),
    ]


def test_tiers(spark):
    relations = spark.createDataFrame([(PREFIX + "a", "x2", "optional", 1), (PREFIX + "a", "x1", "essential", 2), (PREFIX + "a", "x1", "optional", 0), (PREFIX + "c", "x3", "essential", 3)], "occupation string, skill string, kind string, place int")
    labels = spark.createDataFrame([("cook", PREFIX + "c"), ("baker", PREFIX + "b")], "label string, uri string")
    got = {r.id: (r.tier, r.mechanism, r.skills_used) for r in profiles.tiers(spark.createDataFrame(people(), PROFILE), relations, labels, "id", PREFIX).collect()}
    assert len(got) == 87 and all(got[i][0] == 1 for i in range(80))
    assert got[100] == (2, "occupation_uris", ["x1", "x2"])
    assert got[101] == (2, "occupation_text_exact", ["x3"])
    assert got[102] == (3, "sector_degree", ["s1", "s2"])
    assert got[103] == (3, "sector_only", ["s3"])
    assert got[104] == (3, "mixed", ["s3", "s1", "s2"])
    assert got[105] == got[106] == (4, "none", [])


def test_allocate():
    assert ordered.allocate({"a": 2, "b": 10, "c": 10, "d": 0}, 12) == {"a": 2, "b": 5, "c": 5, "d": 0}
    assert ordered.allocate({"a": 1}, 5) == {"a": 1}
    assert ordered.allocate({}, 5) == {}


def test_apart(spark):
    rows = spark.createDataFrame([("u", 1, 3.0), ("u", 3, 9.0), ("u", 12, 0.2), ("u", 20, 1.1)], "unit string, at int, ratio double")
    assert {(r.at, r.ratio) for r in stretches.jumps(rows, ["unit"], "at", "ratio", 2, 7).collect()} == {(3, 9.0), (12, 0.2)}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", "x"), ("2024-01-01 11:00:00", "a", "x"), ("2024-01-02 01:00:00", "b", "y")], "ts string, kind string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    for name, df, want in [
        ("day_counts", days.day_counts(stream, "ts", "kind"), {(date(2024, 1, 1), "a", 2), (date(2024, 1, 2), "b", 1)}),
        ("first_seen", days.first_seen(stream, "ts", "text").select("kind", "text"), {("a", "x"), ("b", "y")}),
    ]:
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "day_counts" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_frequent_ngrams(spark, monkeypatch):
    """Against plain loops, with hashes broadcast at once and in blocks; texts are cut up once, and what is shuffled from two words on are counts of hashes."""
    import random

    r = random.Random(5)
    docs = [[[r.choice(["a", "b", "c", "né", "the"]) for _ in range(r.randint(0, 9))] for _ in range(r.randint(0, 4))] for _ in range(200)] + [None, [], [[]]]
    want = {}
    for d in docs:
        for g in {(" ".join(s[i : i + n]), n) for s in d or [] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)}:
            want[g] = want.get(g, 0) + 1
    want = {g: k for g, k in want.items() if k >= 5 and g[0].split()[0] != "the" and g[0].split()[-1] != "the"}
    df, made, write = spark.createDataFrame([(d,) for d in docs], "s array<array<string>>"), [], mining.Scratch.write
    monkeypatch.setattr(mining.Scratch, "write", lambda self, name, t: made.append((name, t.columns)) or write(self, name, t))
    for most in (4_000_000, 3):
        monkeypatch.setattr(mining, "HASHES_AT_ONCE", most)
        assert {(x.gram, x.n): x.df for x in mining.frequent_ngrams(df, F.col("s"), 4, 5, ["the"]).collect()} == want
    assert [m for m in made if m[0] == "docs"] == [("docs", ["_segments"])] * 2 and ("often", ["h"]) in made
