"""The second cleaning stage of titles, an ordered program of rules.

Places and common words are tables (board_places(), common_words()). A title's runs of up to four words are joined with them, so what a rule asks is in a short list beside the title, and the rules themselves are column
functions: patterns first, then what is cut from the words' end. Each distinct title and location is worked out once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.functions.vectors import let
from corpusstat.operators.titles import SMALL

#: Fixed values, all of them, down to FALLBACK: words that may dangle at a title's end, prepositions before an employer, links, and signs that are kept.
PREPOSITIONS = "to for with till för für zu pour à au aux dans en in i på im at hos bei chez mit med of".split()
BEFORE_EMPLOYER, AT_EMPLOYER = "to for till för at hos chez".split(), "at hos chez".split()
LINKS = "or and & / , eller och oder und ou et".split()
DANGLING = ("central centrala die der das den dem the our unsere unseren unser northern southern western eastern norra södra västra östra greater north south west east region county län municipality kommun "
            "st sankt saint about ca approx circa cirka ungefär from ab von bis until around im").split()  # fmt: skip
KEPT_SIGNS, QUOTES = ["++", "+", "#"], ['"', "'", "»", "”", "“"]
MONTHS = (r"jan(?:uary|uar|uari|vier)?|jänner|feb(?:ruary|ruar|ruari|rier)?|mar(?:ch|z|s)?|märz|mars|apr(?:il)?|may|mai|maj|jun(?:e|i|)|juin|jul(?:y|i)?|juillet|"
          r"aug(?:ust|usti)?|août|sep(?:t|tember)?|septembre|oct(?:ober)?|okt(?:ober)?|octobre|nov(?:ember)?|novembre|dec(?:ember)?|dez(?:ember)?|décembre")  # fmt: skip
PERCENT = r"\d{1,3}(?:[.,]\d+)?\s?(?:[-–]\s?\d{1,3}(?:[.,]\d+)?\s?)?%"
ARTICLES = r"(?:an?\s+|the\s+|some\s+|several\s+|new\s+)?"
LEAD_INS = [
    rf"^.{{2,70}}?\b(?:is|are)\s+(?:now\s+)?(?:looking for|searching for|seeking|recruiting|hiring|in need of)\s+{ARTICLES}(.{{3,}})$",
    r"^(?:now\s+)?(?:we are looking for|we are seeking|looking for|we need|wanted:?)\s+(?:an?\s+|the\s+|some\s+|several\s+)?(.{3,})$",
]
PRONOUN = r"^(?:you|us|someone|people|colleagues?|new colleagues?|more|dig|dej|er|vous|toi)[ !?.]*$"
REFERENCE = r"\s*[,;(\[]?\s*\b(?:Kennzahl|Kennziffer|Chiffre|Referenz(?:nummer)?|Ref\.?|Job[- ]?ID)\s*[:#]?\s*\S*\d.*$"
AGE_BAND = r"\s*,?\s*\bAltersbereich\b.*$"
NUMBER_AT_STREET = r"\s*\d+(?:\s?[a-zA-Z]\b)?(?:\s?[/-]\s?\d+)?"
ADDRESS = rf"\b[\wäöüÄÖÜß-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|stieg|halde|morgen){NUMBER_AT_STREET}|\b[\wäöüÄÖÜß-]+\s+(?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse){NUMBER_AT_STREET}"
START = (rf"\b(?:ab|from|starting(?:\s+from)?|beginning|zum|per|as of|dès|à partir de|från)\s+(?:\d{{1,2}}\.\s?\d{{1,2}}\.?(?:\s?20\d\d)?|(?:\d{{1,2}}(?:st|nd|rd|th)?\.?\s+)?(?:{MONTHS})\b\.?"
         r"(?:\s+\d{1,2}(?:st|nd|rd|th)?(?!\d))?(?:\s+20\d\d)?|20[2-3]\d)")  # fmt: skip
AND = r"(?:/|or|and|&)"
HOURS = "|".join([
    rf"\(\s*{PERCENT}(?:\s*[-–]\s*{PERCENT})?\s*\)", rf"(?:\b(?:about|ca\.?|approx\.?|circa|cirka|ungefär)\s+)?(?<![\w/])\b{PERCENT}", r"(?:(?<![/\w-])in\s+)?\b(?:voll|teil)[- ]?zeit\b",
    r"(?:(?<![/\w-])in\s+)?\b(?:voll|teil)-\s*(?:/|oder|und|&)\s*(?:voll|teil)zeit\b", rf"\b(?:full|part)[- ]?time\s*{AND}\s*(?:full|part)[- ]?time\b", rf"\b(?:full|part)[- ]?{AND}\s*(?:full|part)[- ]?time\b",
    r"\b(?:(?<![/\w-])in\s+)?(?:full|part)[- ]?time\b", r"\b(?:à\s+)?temps (?:plein|partiel)\b",
])
CONTRACT = r"(?:\s*[-–—/]\s*)?\b(?:en\s+|in\s+)?(?:CDI|CDD)\b(?:\s*[-–—]\s*)?"
FILLER = (r"\b(?:(?:is|are)\s+wanted|wanted(?:\s+(?:immediately|now|urgently))?|needed|urgent(?:ly)?|immediately|hourly(?:\s+employment)?|until further notice|(?:summer|autumn|fall|winter|spring)\s+20\d\d|\d{1,3}\s?h/v)\b[!.]*"
          r"|(?<![\d./-])20[2-3]\d(?![\d/-])")  # fmt: skip
IF_NEEDED = r"\b(if|as|when|where|is|are|be|only)\s+needed\b"
AREA_AT_END = r"\s+(?:im\s+(?:Raum|Großraum|Umkreis)|in\s+and\s+around|in\s+the\s+(?:area|region)(?:\s+of)?|in\s+der\s+(?:Region|Umgebung))\s*$"
FALLBACK = 3

#: What a kept "needed" is called while fillers go.
HELD = "NEEDEDKEEP"
RUN = 4


def without(t: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(t, "(?iuU)" + pattern, by)


def trimmed(t: Column) -> Column:
    """A title without separators at its ends and without full stops, until the last word is one or two letters with one."""
    seps = F.lit(" -–—|,;:")
    ends = lambda x: F.endswith(x, F.lit(".")) & ~x.rlike(r"(?U)\b[A-Za-z]{1,2}\.$")
    step = lambda x: F.when(ends(x), F.rtrim(F.left(x, F.length(x) - 1), seps)).otherwise(x)
    stops = F.length(F.regexp_extract(t, r"[ \-–—|,;:.]*$", 0))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(stops, F.lit(1))), F.btrim(t, seps), lambda x, _: step(x))


def bare(w: Column) -> Column:
    """A word in lower case, without signs at its ends."""
    return F.lower(F.regexp_replace(w, r"(?U)^[\W_]+|[\W_]+$", ""))


def spaced(w: Column) -> Column:
    return F.replace(bare(w), F.lit("-"), F.lit(" "))


def shut(w: Column) -> Column:
    return F.contains(w, F.lit(")")) | F.contains(w, F.lit("]"))


def dangles(w: Column) -> Column:
    """Whether a word means nothing at a title's end."""
    c = bare(w)
    kept = w.isin(KEPT_SIGNS + QUOTES) | w.rlike("[€$£]") | w.rlike(r"^\p{Lu}$")
    return F.when(kept, False).when(c == "", ~shut(w)).otherwise(c.isin([*PREPOSITIONS, *LINKS, *DANGLING]))


def dropped_last(ws: Column, go: Callable[[Column], Column], least: int = 0) -> Column:
    """Words without those at the end that go, `least` words being kept."""
    stay = F.coalesce(F.array_max(F.transform(ws, lambda w, i: F.when(~go(w), i + 1).otherwise(0))), F.lit(0))
    return F.slice(ws, F.lit(1), F.greatest(stay, F.least(F.lit(least), F.size(ws))))


def without_places(ws: Column, places: Column, near: Column) -> Column:
    """Words without names of places at their end, and without what then dangles; the first word stays. places: those of the title's runs of words that are places; near: words of the location."""

    def step(now: Column) -> Column:
        def cut(held: Column) -> Column:
            n = F.size(held)
            last = lambda k: F.array_join(F.transform(F.slice(held, n - k + 1, F.lit(k)), spaced), " ")
            known = lambda name: F.array_contains(places, name) | F.array_contains(near, name)
            first = F.substring_index(last(1), " ", 1)
            part = F.contains(F.element_at(held, -1), F.lit("-")) & F.array_contains(places, first) & (F.length(first) >= 4)
            found = F.coalesce(*(F.when((n > k) & (known(last(k)) | (part if k == 1 else F.lit(False))), k) for k in range(RUN, 0, -1)), F.lit(0))
            return let(found, lambda k: F.when(k > 0, dropped_last(F.slice(held, F.lit(1), n - k), dangles)).otherwise(held))

        empty = lambda w: (bare(w) == "") & ~w.isin(KEPT_SIGNS) & ~shut(w)
        # a name can't be empty, so words that are none at the end go first
        return F.when(F.size(now) < 2, now).otherwise(let(dropped_last(now, empty), lambda held: F.when(F.size(held) < 1, held).otherwise(cut(held))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1))), ws, lambda now, _: step(now))


def proper(w: Column, places: Column, common: Column) -> Column:
    """Whether a word looks like a name: a place, or a capitalised word that the board doesn't write in lower case as often; null for small words and signs."""
    c = bare(w)
    large = w.rlike(r"^\p{Lu}") | ((F.upper(w) == w) & (F.lower(w) != w))
    return F.when((c == "") | c.isin(SMALL), None).when(F.array_contains(places, c), True).otherwise(large & ~F.array_contains(common, c))


def without_employer(ws: Column, places: Column, common: Column) -> Column:
    """Words without an employer at their end: what follows the last 'to', 'for', 'at' and the like before at most six words that look like a name."""

    def ends(i: Column) -> Column:
        tail = F.slice(ws, i + 1, F.greatest(F.size(ws) - i, F.lit(0)))
        names = F.filter(F.transform(tail, lambda w: proper(w, places, common)), lambda x: x.isNotNull())
        at = F.element_at(ws, i)
        # after 'at' one name is enough if the first word may be one; after the others all are to be names
        meant = lambda real: F.when(bare(at).isin(AT_EMPLOYER), F.get(real, 0) & F.exists(real, lambda x: x)).otherwise(F.forall(real, lambda x: x))
        return bare(at).isin(BEFORE_EMPLOYER) & F.size(tail).between(1, 6) & let(names, lambda real: (F.size(real) > 0) & F.coalesce(meant(real), F.lit(False)))

    cut = F.when(F.size(ws) > 2, F.array_max(F.filter(F.sequence(F.lit(2), F.size(ws) - 1), ends)))
    shout = F.array_join(ws, " ")
    return let(cut, lambda i: F.when(i.isNotNull() & ~((F.upper(shout) == shout) & (F.lower(shout) != shout)), F.slice(ws, F.lit(1), i - 1)).otherwise(ws))


def patterns(t: Column) -> list[tuple[str, Callable[[Column], Column]]]:
    """The rules that need no tables, by name, in order."""
    roles = [F.regexp_extract(t, "(?iuU)" + rx, 1) for rx in LEAD_INS]
    role = F.when(roles[0] != "", roles[0]).otherwise(roles[1])
    whole = lambda r: (F.length(F.trim(r)) >= 4) & ~F.trim(r).rlike("(?iuU)" + PRONOUN)
    return [
        ("lead-in", lambda t: let(role, lambda r: F.when(whole(r), r).otherwise(t))),
        ("reference", lambda t: without(without(without(without(t, IF_NEEDED, f"$1 {HELD}"), REFERENCE, ""), AGE_BAND, ""), ADDRESS)),
        ("start", lambda t: without(t, START)),
        ("filler", lambda t: without(F.regexp_replace(without(without(t, HOURS), CONTRACT, " - "), r"\s*[/(]\s*NB\s*\)?", " "), FILLER)),
    ]


def tidy(t: Column) -> Column:
    """A title without what cutting leaves: doubled signs, empty brackets, blanks."""
    for pattern, by in ((HELD, "needed"), (r"[!?]+", " "), (r"[(\[]\s*[-–—]?\s*[)\]]", " "), (r"\(\s*[,;]\s*", "("), (r"(?:\s*[-–—]\s*){2,}", " - "), (r",\s*(?:,\s*)+", ", "), (r"\s+([,;:])", "$1"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    return trimmed(t)


def clean_titles(rows: DataFrame, title: str, location: str, places: DataFrame, common: DataFrame, employer_tail: bool = True) -> DataFrame:
    """rows with clean (the title after the program) and rules (the names of the rules that changed it, in order): lead-in, reference, start, filler, tidy, place, employer, area, rim.

    places (place) and common (word) are the board's tables. employer_tail: whether capitals tell names on this board (title_case_share() below 0.55). A title of which fewer than FALLBACK characters would
    be left stays as it was, with no rules; a null or empty one is ''. Titles are to have been through clean_title() first."""
    keyed = rows.withColumns({"_title": F.coalesce(F.col(title), F.lit("")), "_near": F.coalesce(F.col(location), F.lit(""))})
    one = keyed.select("_title", "_near").distinct().withColumns({"_t": F.col("_title"), "_rules": F.array().cast("array<string>")})
    free = lambda c: F.replace(F.col(c), F.lit(HELD), F.lit("needed"))  # noqa: E731  (a held "needed" is no change)

    def mark(df: DataFrame, name: str, new: Column) -> DataFrame:
        df = df.withColumn("_new", new)
        return df.withColumn("_rules", F.when(free("_new") != free("_t"), F.array_append("_rules", F.lit(name))).otherwise(F.col("_rules"))).withColumn("_t", F.col("_new")).drop("_new")

    for name, f in patterns(F.col("_t")):
        one = mark(one, name, f(F.col("_t")))
    one = mark(one, "tidy", tidy(F.col("_t"))).withColumn("_words", F.filter(F.split("_t", r"\s+"), lambda w: w != ""))
    names = F.transform("_words", spaced)
    none = F.array().cast("array<string>")

    def runs_of(k: int) -> Column:
        return F.when(F.size("_words") >= k, F.transform(F.sequence(F.lit(1), F.size("_words") - k + 1), lambda i: F.array_join(F.slice(names, i, F.lit(k)), " "))).otherwise(none)

    runs = F.flatten(F.array(*map(runs_of, range(1, RUN + 1))))
    asked = one.select("_title", "_near", F.explode(F.array_distinct(F.concat(runs, F.transform("_words", bare), F.transform(names, lambda w: F.substring_index(w, " ", 1))))).alias("_name")).where("_name <> ''")
    of = lambda table, column, name: asked.join(table.select(F.col(column).alias("_name")).distinct(), "_name").groupBy(F.col("_title").alias("_a"), F.col("_near").alias("_b")).agg(F.collect_set("_name").alias(name))
    for table, column, name in ((places, "place", "_places"), (common, "word", "_common")):
        got = of(table, column, name)
        one = one.join(got, (F.col("_title") == F.col("_a")) & (F.col("_near") == F.col("_b")), "left").drop("_a", "_b").withColumn(name, F.coalesce(name, none))
    own = F.transform(F.regexp_extract_all(F.lower("_near"), F.lit(r"(?U)[^\W\d_]{4,}"), F.lit(0)), spaced)
    one = one.withColumn("_own", own)
    joined = lambda ws: F.array_join(ws, " ")
    split = lambda df: df.withColumn("_words", F.filter(F.split("_t", " "), lambda w: w != ""))
    cut_places = lambda df: split(mark(df, "place", joined(without_places(F.col("_words"), F.col("_places"), F.col("_own")))))
    one = cut_places(one)
    if employer_tail:
        one = split(mark(one, "employer", joined(without_employer(F.col("_words"), F.col("_places"), F.col("_common")))))
        one = cut_places(one)
    one = split(mark(one, "area", without(F.col("_t"), AREA_AT_END, "")))
    link = lambda w: bare(w).isin(LINKS) & ~w.isin(KEPT_SIGNS)
    start = F.coalesce(F.array_min(F.filter(F.transform("_words", lambda w, i: F.when(~link(w), i + 1)), lambda i: i.isNotNull())), F.size("_words"))
    rim = let(F.slice(F.col("_words"), F.greatest(start, F.lit(1)), F.size("_words")), lambda ws: dropped_last(ws, dangles, 1))
    last = F.regexp_replace(trimmed(joined(rim)), r"[\[(]\s*[\])]", "")
    last = F.when(F.contains(last, F.lit("(")), last).otherwise(F.regexp_replace(last, r"\s*\)+$", ""))
    one = mark(one, "rim", trimmed(F.regexp_replace(last, r"\s+", " ")))
    short = F.length("_t") < FALLBACK
    one = one.select(F.col("_title").alias("_x"), F.col("_near").alias("_y"), F.when(short, F.col("_title")).otherwise(F.col("_t")).alias("clean"), F.when(short, none).otherwise(F.array_distinct("_rules")).alias("rules"))
    return keyed.join(one, (F.col("_title") == F.col("_x")) & (F.col("_near") == F.col("_y"))).drop("_title", "_near", "_x", "_y")
