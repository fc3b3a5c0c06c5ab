"""Text, title, place and employer preparation on made-up rows."""

import pytest
from pyspark.sql import functions as F

from corpusstat.functions import prepare as P
from corpusstat.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **cells):
        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())) if cells else spark.range(1)
        return row.select(column.alias("v")).first().v

    return value


def test_terms(one):
    hit = lambda term, text, lang="en": one(F.col("t").rlike(X.term_pattern(term, lang)), t=text.lower())
    assert hit("dual-use", "a dual use good") and hit("dual-use", "dualuse") and hit("dual - use", "dual-use") and not hit("dual-use", "dual  use")
    assert hit("supply chain", "supply - chains") and not hit("supply chain", "supplychain") and not hit("chip", "chipset") and hit("chip", "chips.")
    assert hit("försvar", "försvaret", "sv") and not hit("försvar", "försvaret") and hit(" chip ", "chip")
    raw = X.lexicon_pattern("NATO", ["re:nato(?!-)§north atlantic", "otan"])
    assert one(F.col("t").rlike(raw), t="the North Atlantic") and not one(F.col("t").rlike(raw), t="otan") and not one(F.col("t").rlike(raw), t="nato-x")
    assert one(F.col("t").rlike(X.lexicon_pattern("NATO", ["otan"])), t="OTAN")


def test_missing_and_wilson(one):
    assert [one(X.missing(F.lit(v).cast("string"), m)) for v, m in ((None, "any"), ("\n\t", "any"), ("EMPTY", "any"), ("EMPTY", "dashes"), ("--", "dashes"), (" ", "null"), ("", "null"))] == [True, True, True, False, True, False, True]
    low, high = X.wilson(F.lit(0), F.lit(0), empty=0.0)
    assert one(low) == 0.0 and one(high) == 0.0 and one(X.wilson(F.lit(0), F.lit(0))[0]) is None
    low, high = X.wilson(F.lit(0), F.lit(10), clamped=False)
    assert abs(one(low)) < 1e-9 and abs(one(high) - 0.27753) < 1e-4


def test_passages(one):
    long = "x " * 100 + "the lithium mine " + "y " * 300 + "cobalt"
    out = one(P.prompt_text(F.col("d"), F.array(F.lit("Lithium"), F.lit("cobalt"), F.lit("absent")), 150, width=20), d=long)
    head, *passages = out.split("\n[...]\n")
    assert head == long[:150] and len(passages) == 2 and "lithium mine" in passages[0] and passages[1].endswith("cobalt")
    assert one(P.context(F.lit("A\n B c"), F.lit("b"), 2)) == "B c" and one(P.context(F.lit("abc"), F.lit("z"), 2)) == ""


CHANNELS = ["none", "defense", "diversification"]


@pytest.mark.parametrize("raw, want", [
    ('say {"channel": "Defence", "intensity": "HIGH", "evidence": "tanks"} end', ("defense", "high", "tanks", None, None)),
    ('{"channel": "sovereign_tech", "intensity": "low", "evidence": ""}', ("diversification", "low", "", "sovereign-tech", "sovereign tech")),
    ('{"channel": "navy", "intensity": "medium", "evidence": "e", "subtype": "Supply-Side"}', ("defense", "medium", "e", "supply-side", "navy")),
    ('{"channel": "defense", "intensity": "none", "evidence": "e"}', ("none", "none", "e", None, None)),
    ('{"channel": "defense", "intensity": "low", "evidence": "a "quoted" word"}', ("defense", "low", 'a "quoted" word', None, None)),
    ('{"channel": "cooking", "intensity": "low"}', None), ("no braces", None), (None, None), ('{"channel": "defense"}', None),
])
def test_answers(one, raw, want):
    got = one(P.parsed_answer(F.lit(raw).cast("string"), CHANNELS, {"navy": "defense"}))
    assert (tuple(got) if got else None) == want


def test_title_answers(one):
    title = lambda raw: one(P.parsed_title(F.lit(raw)))
    assert title('{"title": " Nurse  aide "}') == "Nurse aide" and title('x "title": "Cook" y') == "Cook" and title('{"title": "unknown"}') is None and title("?") is None


@pytest.mark.parametrize("title, place, want", [
    ("Engineer (m/w/d) - Acme GmbH", "", "Engineer"), ("Chef de projet H/F", "", "Chef de projet"), ("REF-12-a Nurse - Ward 3", "", "Nurse - Ward 3"),
    ("Nurse - Stockholm", "Stockholm, Sweden", "Nurse"), ("Cook - 75 - 100%, day", "", "Cook - 75 - 100%, day"), ("Driver AB12345", "", "Driver"),
    ("Teacher - Known Shop", "", "Teacher"), ("Data & AI – Region Skåne", "", "Data & AI"), (None, "x", ""), ("  (m) ", "", "(m)"),
])
def test_titles(one, title, place, want):
    assert one(P.clean_title(F.lit(title).cast("string"), F.lit(place), F.array(F.lit("known shop")))) == want


def test_languages_places_and_occurrences(one):
    assert one(P.title_languages(F.lit("Chef für Säljare"))) == ["French", "German", "Swedish"] and one(P.title_languages(F.lit("Plumber"))) == []
    places, states = ["athens", "patra"], {"athens": r"\b(georgia|ohio)\b"}
    assert [one(P.place_term(F.lit(x), places, states)) for x in ("Áthens, GR", "Athens, Georgia", "Pátra", "Patras")] == ["athens", "", "patra", ""]
    hits = lambda t: one(P.every_occurrence(F.lit(t), r"\bdefen[cs]e\b", "phd|thesis", "industry"))
    assert [hits(t) for t in ("nothing", "PhD thesis defense", "PhD defence industry", "thesis defense" + " x" * 60 + " defense", "defense, defense thesis")] == ["none", "all", "some", "some", "all"]
    assert one(P.exposed(F.lit("Aciérie"), ["acier"], [])) and not one(P.exposed(F.lit("pacier"), ["acier"], ["aci"])) and one(P.exposed(F.lit("x"), [], [], F.lit("Metal Works"), "metal"))


def test_codes_and_search(one):
    uris = F.array(*map(F.lit, ("http://e/isco/C2512", "http://e/occupation/9")))
    assert tuple(one(P.occupation_code(uris, "http://e/occupation/"))) == ("http://e/occupation/9", "2512")
    assert tuple(one(P.search_hits(F.lit("A hotel"), F.lit("x" * 1000 + " hotels hotel."), "hotel"))) == (True, True, False, True, True)
    assert one(P.named_occupations(F.lit("AI Engineer"), {"ai": r"\bai\b", "nurse": "nurse"})) == ["ai"] and one(P.half_even(F.lit(2.5), 0)) == 2.0


def test_exposed_as_written(one):
    """Without folding, an accented letter is no part of a word, as in SQL's regular expressions."""
    hit = lambda t, folded: one(P.exposed(F.lit(t), ["ba"], ["die"], folded=folded))
    assert [hit(t, False) for t in ("Zu und. Dieüauß der", "üBahn", "Bäume", "abba", "die_x", "DIE 4", "")] == [True, True, False, False, False, True, False]
    assert [hit(t, True) for t in ("Dieüauß", "üBahn", "Bäume")] == [False, False, True]


def test_many_occurrences(spark):
    """A text of many occurrences costs as its length, not with its square: where each occurrence looked at all others, 3,000 of them took over half a minute."""
    import time

    rows = spark.createDataFrame([("lithium battery " * 3000,), ("lithium battery " * 2999 + "x" * 80 + " lithium",)], "t string")
    begun = time.time()
    got = [r[0] for r in rows.select(P.every_occurrence(F.col("t"), "lithium", "batter", "therapy")).collect()]
    assert got == ["all", "some"] and time.time() - begun < 30
