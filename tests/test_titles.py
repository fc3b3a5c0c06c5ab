"""The second title stage: a case for each rule, and its parts against loops."""

import random

from pyspark.sql import functions as F

from corpusstat.operators import title_rules as R
from corpusstat.operators import titles

PLACES = ["stockholm", "västra götaland", "sankt pölten", "new york", "graz", "köln", "paris", "rio de la plata"]
COMMON = ["engineer", "care", "home", "software", "sales", "development", "people"]

#: title, location, clean, rules
CASES = [
    ("Acme is looking for a Senior Nurse", "", "Senior Nurse", ["lead-in"]),
    ("We are looking for an Engineer", "", "Engineer", ["lead-in"]),
    ("Acme is looking for you!", "", "Acme is looking for you", ["tidy"]),
    ("Nurse, Ref. no 1234-A more", "", "Nurse, Ref. no 1234-A more", []),
    ("Nurse, Kennzahl: 1234 und mehr", "", "Nurse", ["reference"]),
    ("Nurse Altersbereich 20 bis 30", "", "Nurse", ["reference"]),
    ("Koch Hauptstraße 12a", "", "Koch", ["reference", "tidy"]),
    ("Driver from 1st August 2025", "", "Driver", ["start", "tidy"]),
    ("Koch ab 01.08.2025", "", "Koch", ["start", "tidy"]),
    ("Nurse 80 - 100% (60%)", "", "Nurse", ["filler", "tidy"]),
    ("Cook full-time or part-time", "", "Cook", ["filler", "tidy"]),
    ("Vendeur en CDI - Mode", "", "Vendeur - Mode", ["filler", "tidy"]),
    ("Drivers wanted immediately!", "", "Drivers", ["filler", "tidy"]),
    ("Cover as needed", "", "Cover as needed", []),
    ("Nurse ( ) , , night!?", "", "Nurse, night", ["tidy"]),
    ("Nurse in Stockholm", "", "Nurse", ["place"]),
    ("Nurse in Västra Götaland", "", "Nurse", ["place"]),
    ("Nurse - Sankt-Pölten", "", "Nurse", ["place"]),
    ("Nurse for Graz-Nord", "", "Nurse", ["place"]),
    ("Nurse in Uppsala", "Uppsala kommun", "Nurse", ["place"]),
    ("Guide Rio de la Plata, Paris", "", "Guide", ["place"]),
    ("Stockholm", "", "Stockholm", []),
    ("Nurse to Karlsson Omsorg", "", "Nurse", ["employer"]),
    ("Nurse at the Karlsson home", "", "Nurse", ["employer"]),
    ("Nurse for home care", "", "Nurse for home care", []),
    ("Nurse to Karlsson care", "", "Nurse to Karlsson care", []),
    ("Assistant for Software Development to Volvo Stockholm", "", "Assistant for Software Development", ["place", "employer"]),
    ("NURSE TO KARLSSON", "", "NURSE TO KARLSSON", []),
    ("Verkäufer im Großraum", "", "Verkäufer", ["area"]),
    ("and Cook with", "", "Cook", ["rim"]),
    ("Engineer I", "", "Engineer I", []),
    ("Developer C# .NET", "", "Developer C# .NET", []),
    ("Developer C ++", "", "Developer C ++", []),
    ("Nurse (night", "", "Nurse (night", []),
    ("Nurse night)", "", "Nurse night", ["rim"]),
    ("50%", "", "50%", []),
    ("", "", "", []),
    (None, None, "", []),
]


def test_a_case_for_each_rule(spark):
    df = spark.createDataFrame([(i, t, loc, "x", "y") for i, (t, loc, _, _) in enumerate(CASES)], "id int, title string, loc string, word string, place string")
    places, common = spark.createDataFrame([(p,) for p in PLACES], "place string"), spark.createDataFrame([(w,) for w in COMMON], "word string")
    got = {r.id: (r.clean, r.rules) for r in R.clean_titles(df, "title", "loc", places, common).collect()}
    wrong = {CASES[i][0]: (got[i], c[2:]) for i, c in enumerate(CASES) if got[i] != c[2:]}
    assert wrong == {}
    off = {r.id: r.clean for r in R.clean_titles(df, "title", "loc", places, common, employer_tail=False).collect()}
    assert off[[c[0] for c in CASES].index("Nurse to Karlsson Omsorg")] == "Nurse to Karlsson Omsorg"
    assert R.clean_titles(df.limit(0), "title", "loc", places, common).collect() == []
    assert len(R.clean_titles(df.union(df), "title", "loc", places.limit(0), common.limit(0)).collect()) == 2 * len(CASES)


def test_places_at_the_end_against_a_loop(spark):
    r = random.Random(4)
    names, links = ["a b", "c", "b", "d e c a", "x-y", "rome"], ["in", "of", "-", "(z)", "A", "++", "»"]
    places = {n.replace("-", " ") for n in names}

    def slow(ws):
        clean = lambda w: w.strip("-()»+").lower()
        empty = lambda w: clean(w) == "" and w not in R.KEPT_SIGNS and ")" not in w

        def dangling(w):
            if w in R.KEPT_SIGNS + R.QUOTES or (len(w) == 1 and w.isupper()):
                return False
            return ")" not in w if clean(w) == "" else clean(w) in R.PREPOSITIONS + R.LINKS + R.DANGLING

        while len(ws) >= 2:
            while ws and empty(ws[-1]):
                ws = ws[:-1]
            for k in (4, 3, 2, 1):
                name = " ".join(clean(w).replace("-", " ") for w in ws[-k:])
                first = name.split(" ")[0]
                if len(ws) > k and (name in places or (k == 1 and "-" in ws[-1] and first in places and len(first) >= 4)):
                    ws = ws[:-k]
                    while ws and dangling(ws[-1]):
                        ws = ws[:-1]
                    break
            else:
                return ws
        return ws

    cases = [[r.choice(["job", "c", "a", "b", "d", "e", "x-y", "rome", "rome-west", "b-c", *links]) for _ in range(r.randint(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, ws) for i, ws in enumerate(cases)], "id int, ws array<string>")
    known = F.array(*(F.lit(p) for p in sorted(places)))
    got = {g.id: g.out for g in df.select("id", R.without_places(F.col("ws"), known, F.array().cast("array<string>")).alias("out")).collect()}
    assert {i: (ws, got[i], slow(ws)) for i, ws in enumerate(cases) if got[i] != slow(ws)} == {}


def test_with_the_boards_tables(spark):
    rows = [(i, f"Nurse to Karlsson {k}", "Lund, Skåne") for i, k in enumerate("abcde")] + [(9, "Helper for care in lund", "Lund, Skåne"), (10, "Chef", "Lund, Skåne")] + [(20 + i, "care of care in care", None) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, title string, loc string")
    places, cases = titles.board_places(df, "loc"), titles.title_case(df, "title")
    got = {r.id: r.clean for r in R.clean_titles(df, "title", "loc", places, titles.common_words(cases)).collect()}
    assert got[9] == "Helper for care" and got[10] == "Chef" and got[20] == "care of care in care"
