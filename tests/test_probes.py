"""Field audits, unknown answers, unknown cells and wildcards on small cases."""

from pyspark.sql import functions as F

from corpusstat.operators import fields, wildcards


def test_field_audit(spark):
    rows = [(1, '{"a": 1, "s": [{"x": "", "created_at": "2024-02-02"}, {"y": 1}], "o": {}, "e": [], "n": null, "list": [1, 2]}'),
            (1, '{"a": "", "s": {"x": 5}, "upload_date": "2024-01-03", "list": ["z"]}'), (0, '{"a": false, "upload_date": {"day": 3}, "s": []}'), (None, '{"upload_date": "2024-01-01"}'), (1, "oops"), (0, None), (0, "[1]")]
    df = spark.createDataFrame([(*r, 9, "p") for r in rows], "d int, record string, level int, path string")
    got = {r.path: (r.level, r.dated, r.undated, r.dated_share, r.examples) for r in fields.field_audit(df, "record", F.col("d") == 1, examples=2).collect()}
    third = 1 / 3
    assert got == {
        "a": (0, 1, 1, third, None), "s": (0, 2, 0, 2 * third, None), "s.x": (1, 1, 0, third, None), "s.created_at": (1, 1, 0, third, ["2024-02-02"]), "o": (0, 0, 0, 0.0, None), "e": (0, 0, 0, 0.0, None), "n": (0, 0, 0, 0.0, None),
        "list": (0, 2, 0, 2 * third, None), "upload_date": (0, 1, 2, third, ["2024-01-01", "2024-01-03"]), "upload_date.day": (1, 0, 1, 0.0, None),
    }
    assert fields.field_audit(df.limit(0), "record", F.col("d") == 1).collect() == []


def test_describe(spark):
    rows = [("list", '[{"location": "b", "count": 9, "ok": true}, {"count": 7, "location": "a"}, {"location": "a"}, {"count": 8}]'), ("down", '[{"z": 3.5, "m": "x"}, {"z": 3.5}, {"z": -1}]'), ("object", '{"items": []}'), ("empty", "[]"),
            ("numbers", "[3, 2]"), ("words", '[{"w": "x"}, 5]'), ("text", '"hi"'), ("bad", "{"), ("null", None), ("nothing", "null")]
    got = {r.id: r for r in fields.describe(spark.createDataFrame([(*r, 1) for r in rows], "id string, answer string, place int"), "id", "answer").collect()}
    assert len(got) == len(rows)
    r = got["list"]
    assert (r.kind, r.rows, r.fields, r.numeric_fields, r.descends, r.first, r.last, r["sum"], r.code, r.code_values) == ("array", 4, ["count", "location", "ok"], ["count"], False, 9, 8, 24, "location", 3)
    r = got["down"]
    assert (r.rows, r.fields, r.numeric_fields, r.descends, r.first, r.last, r["sum"], r.code) == (3, ["m", "z"], ["z"], True, 3.5, -1, 6, None)
    assert (got["words"].rows, got["words"].fields, got["words"].numeric_fields, got["words"].descends) == (2, ["w"], [], None)
    assert {i: (got[i].kind, got[i].rows, got[i].fields) for i in ("object", "empty", "numbers", "text", "bad", "null")} == {
        "object": ("object", 0, None), "empty": ("array", 0, None), "numbers": ("array", 2, None), "text": ("string", 0, None), "bad": (None, 0, None), "null": (None, 0, None)}


def test_unknown_counts(spark):
    rows = [("w1", "TOTAL", 10), ("w1", "a", 3), ("w1", "b", 4), ("w1", "c", 10), ("w2", "TOTAL", 10), ("w2", "a", None), ("w2", "b", 4), ("w3", "TOTAL", None), ("w3", "a", 1), ("w3", "b", 1), ("w4", "TOTAL", 5), ("w4", "a", 5), ("w5", "TOTAL", 0), ("w5", "a", 0), ("w5", "b", 0), ("w5", "b", None)]
    df = spark.createDataFrame(rows, "window string, code string, n long")
    got = {r.window: tuple(r)[1:] for r in fields.other_counts(df, "window", "code", "n", ["a", "b"]).collect()}
    assert got == {"w1": (10, 7, 3, False), "w2": (10, None, None, False), "w3": (None, 2, None, False), "w4": (5, None, None, True), "w5": (0, 0, 0, False)}


def test_keyword_forms(spark):
    assert spark.range(1).select(wildcards.patterns_for(F.lit("nurse")).alias("p")).first().p == ["nurse", "nurse*", "nurs*", "nur*", "nurses", "nurses*", "*urse"]
    assert spark.range(1).select(wildcards.patterns_for(F.lit("é")).alias("p")).first().p == ["é", "é*", "és", "és*"]
    rows = [(1, "x", "Nurse and nurses, nursing"), (2, "x", "nurse, NURSE"), (3, "y", "nurse"), (4, "x", None), (5, "x", "course purse"), (None, "x", "nurs")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, g string, text string, word int")
    got = {(r.g, r.pattern): (r.texts, r.forms) for r in wildcards.keyword_forms(df.drop("word"), "id", ["g"], F.col("text"), spark.createDataFrame([("x", "Nurse"), ("x", "nurse"), ("z", "nurse"), ("x", None)], "g string, word string"), "word").collect()}
    assert got["x", "nurse"] == (2, "nurse 2") and got["x", "nurse*"] == (2, "nurse 2, nurses 1") and got["x", "nurs*"] == (2, "nurse 2, nurs 1, nurses 1, nursing 1")
    assert got["x", "*urse"] == (3, "nurse 2, course 1, purse 1") and got["x", "nurses"] == (1, "nurses 1") and got["z", "nurse*"] == (0, "")
    assert len(got) == 14


def test_shortest_wildcards(spark):
    seen = spark.createDataFrame([("nurse", 50), ("nurses", 20), ("nursing", 5), ("nursery", 4), ("nut", 100), ("run", 7), ("runs", 3), ("runner", 2), ("rune", 1)], "form string, n long")
    families = spark.createDataFrame([("nurse", "nurse"), ("nurse", "nurses"), ("nurse", "nursing"), ("nurse", "nursed"), ("run", "run"), ("run", "runs"), ("run", "runner"), ("nut", "nut"), ("none", "ab"), ("none", "cd"), (None, "x"), ("nut", "nut")], "word string, form string")
    got = {r.word: tuple(r)[1:] for r in wildcards.shortest_wildcards(seen, families, 3, 0.06).collect()}
    assert got == {"nurse": ("nur*", 75, 4, 1, "nursery 4"), "run": ("run*", 12, 1, 1, "rune 1"), "nut": ("nut*", 100, 0, 0, "")}
    strict = {r.word: r.wildcard for r in wildcards.shortest_wildcards(seen, families).collect()}
    assert strict == {"nurse": "nurs*", "run": "run*", "nut": "nut*"}


def test_keyword_forms_by_distinct_words(spark, monkeypatch):
    """Patterns meet the group's distinct words, not each text's; the same where caught words aren't broadcast."""
    rows = [(i, "x" if i % 2 else "y", "nurse nurses nursing other words nu") for i in range(300)]
    df, cases = spark.createDataFrame(rows, "id long, g string, t string"), spark.createDataFrame([("x", "nurse"), ("z", "nurse")], "g string, word string")
    made, write = {}, wildcards.Scratch.write

    def counted(self, name, table):
        out = write(self, name, table)
        made[name] = out.count()
        return out

    monkeypatch.setattr(wildcards.Scratch, "write", counted)
    forms = lambda: sorted(map(tuple, wildcards.keyword_forms(df, "id", ["g"], F.col("t"), cases, "word").collect()))
    first = forms()
    assert made["seen"] == 6 and made["caught"] <= 6 * 8
    assert ("x", "nurse", "nurs*", 150, "nurse 150, nurses 150, nursing 150") in first and ("z", "nurse", "nurse", 0, "") in first
    monkeypatch.setattr(wildcards, "FORMS_AT_ONCE", 0)
    assert forms() == first
