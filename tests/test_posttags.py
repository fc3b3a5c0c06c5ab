"""The rules over tags by what a posting says."""

from pyspark.sql import functions as F

from corpusstat.operators import rules

LONG = ", ".join(f"tool{i}" for i in range(60))
#: ok, channel, intensity, subtype, evidence, terms, raw, text -> rule, channel, intensity, subtype
CASES = [
    ((False, None, None, None, None, None, '{"channel": "sovereign-cloud", "intensity": "medium"}', None), ("R0", "diversification", "medium", "sovereign-tech")),
    ((False, None, None, None, None, None, '{"channel": "defense", "intensity": "low"}', None), (None, None, None, None)),
    ((True, "diversification", "low", "supply-side", "our suppliers", [], "", "Sovereign cloud"), ("R1", "none", "none", "")),
    ((True, "diversification", "low", "supply-side", "reduce our dependence", [], "", ""), (None, "diversification", "low", "supply-side")),
    ((True, "diversification", "low", None, "x", [], "", "A European Cloud"), (None, "diversification", "low", None)),
    ((True, "diversification", "low", "", "x", [], "", "nothing"), ("R1", "none", "none", "")),
    ((True, "none", "none", "", "", ["SecNumCloud"], "", "Intro. You will maintain the SecNumCloud qualification; more"), ("R2", "diversification", "high", "sovereign-tech")),
    ((True, "none", "none", "", "", ["eucs"], "", "You maintain ISO 27001, HDS, SecNumCloud and more. We offer fun"), ("R2", "diversification", "low", "sovereign-tech")),
    ((True, "none", "none", "", "", ["eucs"], "", "You maintain the platform (ISO, SecNumCloud)"), ("R2", "diversification", "high", "sovereign-tech")),
    ((True, "none", "none", "", "", ["eucs"], "", "Knowledge of EUCS to ensure quality"), ("R2", "diversification", "low", "sovereign-tech")),
    ((True, "trade compliance", "medium", "", "", ["eucs"], "", "We offer EUCS services and ensure them"), ("R2", "diversification", "medium", "sovereign-tech")),
    ((True, "none", "none", "", "", ["eucs"], "", "Acme is a leading EUCS brand"), ("R2", "diversification", "low", "sovereign-tech")),
    ((True, "none", "none", "", "ensure EUCS alignment", ["eucs"], "", None), ("R2", "diversification", "high", "sovereign-tech")),
    ((True, "none", "none", "", "nothing", ["eucs"], "", "nothing"), ("R2", "diversification", "low", "sovereign-tech")),
    ((True, "none", "none", "", "", ["eucs"], "", "ensure things" + " x" * 250 + " EUCS"), ("R2", "diversification", "high", "sovereign-tech")),
    ((True, "none", "none", "", "", ["eucs"], "", "x " * 250 + "ensure EUCS"), ("R2", "diversification", "low", "sovereign-tech")),
    ((True, "diversification", "low", "sovereign-tech", "AWS, GCP, OVHcloud, Scaleway", ["OVHcloud", "scaleway"], "", ""), ("R3", "none", "none", "")),
    ((True, "diversification", "low", "sovereign-tech", "You run AWS, GCP, OVHcloud, Scaleway", ["ovhcloud"], "", ""), (None, "diversification", "low", "sovereign-tech")),
    ((True, "diversification", "low", "sovereign-tech", "AWS, GCP, OVHcloud in many large places, Scaleway", ["ovhcloud"], "", ""), (None, "diversification", "low", "sovereign-tech")),
    ((True, "diversification", "low", "sovereign-tech", "AWS, GCP, OVHcloud", ["ovhcloud"], "", ""), (None, "diversification", "low", "sovereign-tech")),
    ((True, "diversification", "low", "sovereign-tech", LONG, ["ovhcloud"], "", ""), (None, "diversification", "low", "sovereign-tech")),
    ((True, "diversification", "low", "sovereign-tech", "a, b, c, d", ["ovhcloud", "azure"], "", ""), (None, "diversification", "low", "sovereign-tech")),
    ((True, "diversification", "low", "sovereign-tech", "a, b, c, d", None, "", ""), (None, "diversification", "low", "sovereign-tech")),
]


def test_rules_by_what_a_posting_says(spark):
    df = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(CASES)], "id int, ok boolean, channel string, intensity string, subtype string, evidence string, terms array<string>, raw string, text string")
    got = {r.id: ((r.post_rule or "")[:2] or None, r.channel, r.intensity, r.subtype) for r in rules.ruled(df, rules.post_rules()).collect()}
    assert {i: (CASES[i][0], got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want} == {}


def test_the_list_around_a_certificate(spark):
    texts = ["(SecNumCloud) and EUCS, A, B", "A, B; ensure SecNumCloud/EUCS/ISO", "first. • ensure eucs or HDS\nand, more", "ensure EUCS", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    level = rules.certificate_intensity(F.lit(""), F.col("text"), F.lit("none"), ("secnumcloud", "eucs"))
    assert [r.level for r in df.select("id", level.alias("level")).orderBy("id").collect()] == ["low", "low", "high", "high", "low"]


def test_peaks_with_nulls_and_ties(spark):
    from corpusstat.operators import peaks

    rows = [("2024-12-01", "a", 1.0, True), ("2024-12-02", "b", 1.0, True), ("2024-12-02", None, 5.0, False), ("2024-12-09", "a", 2.0, None), (None, "a", 9.0, True), ("2023-12-01", "c", 1.0, False)]
    df = spark.createDataFrame(rows, "day string, employer string, w double, hit boolean").withColumn("day", F.to_date("day"))
    got = {(str(r.begin), str(r.week)): (r.taken, r.population, r.tag) for r in peaks.weekly(df, "day", "w", {"tag": F.col("hit")}, [("2024-12-01", "2024-12-08"), ("2024-12-02", "2024-12-31")]).collect()}
    assert got == {("2024-12-01", "2024-11-25"): (1, 1.0, 1.0), ("2024-12-01", "2024-12-02"): (2, 6.0, 1 / 6), ("2024-12-02", "2024-12-02"): (2, 6.0, 1 / 6), ("2024-12-02", "2024-12-09"): (1, 2.0, 0.0)}
    got = [(r.period, r.rank, r.employer, r.taken, r.share_of_hits, r.top1, r.employers) for r in peaks.employers_behind(df, F.year("day"), "employer", "w", F.col("hit"), 1).collect()]
    assert got == [(2024, 1, "a", 1, 0.5, 0.5, 2)]
    got = {(r.period, r.left_out): r.share for r in peaks.without_largest(df, F.year("day"), "employer", "w", F.col("hit"), (0, 1, 2)).collect()}
    assert got == {(2024, 0): 2 / 9, (2024, 1): 1 / 6, (2024, 2): 0.0, (2023, 0): 0.0, (2023, 1): 0.0, (2023, 2): 0.0}
    flagged = df.withColumn("channel", F.when(F.col("hit"), "x"))
    got = {(r.what, r.name): (r.n, r.share) for r in peaks.week_inspection(flagged, "day", "2024-12-01", "2024-12-31", "channel", F.col("employer"), F.lit(None).cast("string")).collect()}
    assert got == {("total", "days"): (3, None), ("total", "rows"): (4, None), ("total", "flagged"): (2, 0.5), ("channel", "x"): (2, 1.0), ("title", "a"): (1, 0.5), ("title", "b"): (1, 0.5), ("opening", ""): (2, 1.0)}
    empty = peaks.week_inspection(flagged.limit(0), "day", "2024-12-01", "2024-12-31", "channel", F.col("employer"), F.col("employer")).collect()
    assert {(r.name, r.n) for r in empty} == {("days", 0), ("rows", 0), ("flagged", 0)}
