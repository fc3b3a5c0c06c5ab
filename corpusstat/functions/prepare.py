"""Column functions that prepare posting texts, titles, places, employers and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusstat.functions.vectors import let

#: Fixed value: the marks that end a segment.
SEGMENT_ENDS = r"[.!?;:,\n\r\t•·|()\[\]{}/\"“”]+"
#: Alphabetic words, with hyphens and apostrophes inside.
WORD = r"\p{L}+(?:[-'’]\p{L}+)*"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def posting_text(title: Column, description: Column, most: int | None = None) -> Column:
    """Title, full stop, description; the first `most` characters if given."""
    whole = stripped(F.concat(stripped(_text(title)), F.lit(". "), _text(description)))
    return F.substring(whole, 1, most) if most else whole


def segments(text: Column) -> Column:
    """Lower-case pieces between sentence, list, bracket and quote marks that aren't blank."""
    return F.filter(F.split(F.lower(_text(text)), SEGMENT_ENDS), lambda s: stripped(s) != "")


def words(segment: Column) -> Column:
    """X3."""
    return F.regexp_extract_all(segment, F.lit(WORD), F.lit(0))


def sentences(text: Column, least: int = 25, most: int = 400) -> Column:
    """Pieces after . ! ? ; : or at bullets and line ends, trimmed of blanks and dashes, of 25 to 400 characters."""
    pieces = F.transform(F.split(_text(text), r"(?<=[.!?;:])\s+|\s*[•·\n]\s*"), lambda s: F.regexp_replace(s, r"^[ \t-]+|[ \t-]+$", ""))
    return F.filter(pieces, lambda s: F.length(s).between(least, most))


def context(text: Column, matched: Column, width: int = 160) -> Column:
    """X8, PB17: what stands around the first occurrence of `matched` in any case, white space as one blank; '' where there is none."""
    at = F.instr(F.lower(text), F.lower(matched))
    from_ = F.greatest(at - width, F.lit(1))
    piece = F.substr(text, from_, at - from_ + F.length(matched) + width)
    return F.when(at > 0, F.trim(F.regexp_replace(piece, r"\s+", " "))).otherwise("")


def prompt_text(description: Column, matched: Column, most: int, passages: int = 3, width: int = 250) -> Column:
    """The first `most` characters, then up to three passages around matches that begin at most - 100 or later."""
    plain = F.trim(F.regexp_replace(_text(description), r"[ \t]+", " "))
    late = F.filter(matched, lambda m: F.instr(F.lower(plain), F.lower(m)) - 1 >= most - 100)
    around = F.transform(F.slice(late, 1, passages), lambda m: context(plain, m, width))
    mark = "\n[...]\n"
    return F.concat(F.substring(plain, 1, most), F.when(F.size(around) > 0, F.concat(F.lit(mark), F.array_join(around, mark))).otherwise(""))


#: What a channel is called by models, and sectors named in its place are given by the caller.
SUBTYPES = {"sovereign-tech": "sovereign-tech", "sovereign tech": "sovereign-tech", "sovereign-cloud": "sovereign-tech", "sovereign cloud": "sovereign-tech", "supply-side": "supply-side", "supply side": "supply-side"}


def parsed_answer(raw: Column, channels: list[str], sectors: dict[str, str], intensities: tuple = ("none", "low", "medium", "high")) -> Column:
    """struct<channel, intensity, evidence, subtype, mapped_from> of a model's answer, or null where it is invalid. The braces' JSON is read, or failing
    that its two short fields. A subtype or sector in the channel's place is mapped; none on one side is none on both."""
    body = F.regexp_extract(_text(raw), r"(?s)\{.*\}", 0)
    json = F.from_json(body, "channel string, intensity string, evidence string, subtype string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    broken = json.isNull() | json["_corrupt"].isNotNull()
    field = lambda name, rx: F.when(broken, F.nullif(F.regexp_extract(body, rx, 1), F.lit(""))).otherwise(json[name])
    channel = field("channel", r'"channel"\s*:\s*"([^"]+)"')
    intensity = field("intensity", r'"intensity"\s*:\s*"([^"]+)"')
    said = F.when(broken, F.regexp_replace(F.regexp_extract(body, r'(?s)"evidence"\s*:\s*"(.*)', 1), r'^[ "}`\n]+|[ "}`\n]+$', "")).otherwise(_text(json["evidence"]))
    name = F.replace(F.replace(F.lower(stripped(_text(channel))), F.lit("_"), F.lit(" ")), F.lit("defence"), F.lit("defense"))
    kinds = F.create_map(*(F.lit(x) for pair in SUBTYPES.items() for x in pair))
    other = F.create_map(*(F.lit(x) for pair in ({"": ""} | sectors).items() for x in pair))
    kind = F.try_element_at(kinds, name)
    sector = F.when(kind.isNull() & ~name.isin(channels), F.try_element_at(other, name))
    final = F.when(kind.isNotNull(), "diversification").otherwise(F.coalesce(sector, name))
    level = F.lower(stripped(_text(intensity)))
    none = (final == "none") | (level == "none")
    ok = (body != "") & final.isin(channels) & level.isin(*intensities) & (~broken | (channel.isNotNull() & intensity.isNotNull()))
    subtype = F.coalesce(kind, F.when(~broken, F.nullif(F.substring(F.lower(stripped(_text(json["subtype"]))), 1, 20), F.lit(""))))
    mapped = F.when(kind.isNotNull() | sector.isNotNull(), name)
    out = F.struct(F.when(none, "none").otherwise(final).alias("channel"), F.when(none, "none").otherwise(level).alias("intensity"), F.substring(said, 1, 300).alias("evidence"), subtype.alias("subtype"), mapped.alias("mapped_from"))
    return F.when(ok, out)


def parsed_title(raw: Column) -> Column:
    """X11: the title of a model's answer (JSON, or the field alone), at most 120 characters; null for UNKNOWN or nothing."""
    body = F.regexp_extract(_text(raw), r"(?s)\{.*\}", 0)
    title = F.coalesce(F.get_json_object(body, "$.title"), F.nullif(F.regexp_extract(_text(raw), r'"title"\s*:\s*"([^"]+)"', 1), F.lit("")))
    title = F.substring(stripped(F.regexp_replace(title, r"\s+", " ")), 1, 120)
    return F.when((title != "") & (F.upper(title) != "UNKNOWN"), title)


#: Gender marks, reference codes, separators, legal forms and words of public bodies in titles.
GENDER = r"(?i)\(?\s*(?<![A-Za-z])[mwfhdx]\s*[/|]\s*[mwfhdx](?:\s*[/|]\s*[mwfhdx])?(?:\s*[/|]\s*nb)?(?![A-Za-z])\s*\)?"
ONE_GENDER = r"(?i)\(\s*[mwfd]\s*\)"
LAST_CODE = r"\s*\(?\b(?:[A-Z]{2,4}\d{5,}|[A-Z]{1,3}\d{4}[A-Z]{1,3}\d{3,}|\d{4}-\d{4,})\b\)?\s*$"
FIRST_CODE = r"^\s*(?=\S*\d)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\s+"
SEPARATOR = r"\s+[-–—|]\s+"
LEGAL_FORM = r"(?i)\b(ab|aktiebolag|gmbh|ag|sas|sarl|sa|oy|as|inc|ltd|llc|kg|se)\.?$"
PUBLIC_BODY = r"(?i)\b(municipality|kommun|region|county|university|universitet|hospital|group|groupe)\b"
EDGES = r"^[ \-–—|,;:]+|[ \-–—|,;:]+$"


def clean_title(title: Column, location: Column, employers: Column | None = None) -> Column:
    """A title without gender marks and reference codes, and of its segments the first and those that name no employer (a list of lower-case
    names in `employers`, a legal form, a public body, a comma) and no place of the location; a percentage range stays. The title itself if nothing is left."""
    space = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    t = space(_text(title))
    s = F.regexp_replace(F.regexp_replace(t, GENDER, " "), ONE_GENDER, " ")
    s = F.regexp_replace(F.regexp_replace(space(s), EDGES, ""), FIRST_CODE, "")
    long_words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{4,}"), F.lit(0)))
    places = long_words(_text(location))
    known = employers if employers is not None else F.array().cast("array<string>")
    pieces = F.transform(F.split(s, SEPARATOR), lambda p, i: F.struct(i.alias("i"), F.trim(p).alias("p")))

    def stays(x):
        p, own = x["p"], long_words(x["p"])
        place = F.array_contains(places, F.lower(p)) | ((F.size(own) > 0) & (F.size(F.array_except(own, places)) == 0))
        drop = F.array_contains(known, F.lower(p)) | p.rlike(LEGAL_FORM) | p.rlike(PUBLIC_BODY) | p.contains(",") | place
        return (x["i"] == 0) | p.rlike("^[0-9]") | ~drop

    out = F.array_join(F.transform(F.filter(pieces, stays), lambda x: x["p"]), " - ")
    out = F.regexp_replace(F.regexp_replace(space(F.regexp_replace(out, LAST_CODE, "")), EDGES, ""), r"[ .]+$", "")
    return F.when(out != "", out).otherwise(t)


def last_segment(title: Column) -> Column:
    """The lower-case last segment of a title that has several, unless it begins with a digit."""
    pieces = F.split(F.trim(F.regexp_replace(_text(title), r"\s+", " ")), SEPARATOR)
    last = F.lower(F.trim(F.element_at(pieces, -1)))
    return F.when((F.size(pieces) > 1) & ~last.rlike("^[0-9]") & (F.length(last) > 1), last)


#: Marks over letters, from the code points U+0300 to U+036F.
ACCENTS = "".join(map(chr, range(0x300, 0x370)))


def plain_letters(c: Column) -> Column:
    """Lower case without the accents of European letters."""
    import unicodedata

    letters = [chr(i) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(i)).rstrip(ACCENTS)) == 1]
    plain = "".join(unicodedata.normalize("NFKD", x)[0].lower() for x in letters)
    return F.translate(F.lower(F.translate(c, "".join(letters), plain)), ACCENTS, "")


def place_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(plain_letters(_text(c)), r"[-'’.()]", " "), r"\s+", " "))


def location_parts(location: Column) -> Column:
    """A location's parts between commas as plain names. In the first, 'and 2 others', a qualifier in brackets and what follows a slash go."""
    parts = F.filter(F.split(_text(location), ","), lambda p: F.trim(p) != "")
    first = lambda p: F.substring_index(F.regexp_replace(F.regexp_replace(p, r"(?i)\s+(?:och|and)\s+\d+\s+(?:andra|others?)\s*$", ""), r"\([^)]*\)", " "), "/", 1)
    return F.transform(parts, lambda p, i: place_name(F.when(i == 0, first(p)).otherwise(p)))


#: Words and letters that tell a title's language.
TITLE_LANGUAGES = {
    "French": r"(?iu)(?<!\w)(ingénieur|ingenieur|chef|responsable|chargé|chargée|technicien|technicienne|développeur|developpeur|gestionnaire|contrôleur|acheteur|consultante|stagiaire|alternance|défense|sécurité|réseau|système|systèmes|projet|projets|poste|pour|avec|des|les|du|de la|et)(?!\w)|[éèêàçùûôîœ]",
    "German": r"(?iu)(?<!\w)(mitarbeiter|fachkraft|kaufmann|kauffrau|sachbearbeiter|leiter|leitung|verkäufer|ausbildung|techniker|fahrer|entwickler|für|und|mit|m/w/d)(?!\w)|[üß]",
    "Swedish": r"(?iu)(?<!\w)(söker|till|sökes|ledare|chef|för|och|med|ingenjör|säljare|sjuksköterska|undersköterska|butik|arbetsledare)(?!\w)|å",
}


def title_languages(title: Column) -> Column:
    """The languages whose words or letters a title has; there can be several."""
    found = [F.when(F.regexp_like(_text(title), F.lit("(?U)" + rx)), F.lit(name)) for name, rx in TITLE_LANGUAGES.items()]
    return F.array_compact(F.array(*found))


def exposed(text: Column, stems: list[str], whole: list[str], sector: Column | None = None, inside: str | None = None, folded: bool = True) -> Column:
    """Whether a text has a word that begins with a stem or is one of the whole words, or a sector that holds a string. Folded (X20), texts lose their accents first; else (X21's screen)
    words are runs of a to z, digits and underscores, as SQL's \\b has them, so an accented letter ends one."""
    if folded:
        low, edge, end = plain_letters(_text(text)), r"\b", r"\b"
    else:
        low, edge, end = F.lower(_text(text)), "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
    parts = [rf"{edge}{s}" for s in stems] + [rf"{edge}{w}{end}" for w in whole]
    hit = low.rlike("|".join(parts)) if parts else F.lit(False)
    return hit | F.lower(_text(sector)).contains(inside.lower()) if sector is not None and inside else hit


def place_term(location: Column, terms: list[str], except_where: dict[str, str]) -> Column:
    """The first of the terms that a location holds as whole words, accents folded; '' for none. A term of except_where doesn't count where its pattern
    (say, the American states that have an Athens) is found too."""
    low = plain_letters(_text(location))
    hit = lambda t: low.rlike(rf"(?U)(?<![^\W_]){t}(?![^\W_])") & (~low.rlike(except_where[t]) if t in except_where else F.lit(True))
    return F.coalesce(*(F.when(hit(t), F.lit(t)) for t in terms), F.lit(""))


def title_employer(title: Column) -> Column:
    """What follows the last ' - '; null without one."""
    return F.when(F.instr(title, " - ") > 0, F.trim(F.substring_index(title, " - ", -1)))


def named_employer(text: Column, names: dict[str, str], within: int = 1500) -> Column:
    """Of the names (with their patterns) the one that matches first in the text's first characters; ties in the order of the names; '' if none does."""
    start = F.substring(_text(text), 1, within)
    found = F.array(*(F.struct(F.regexp_instr(start, F.lit("(?i)" + rx)).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, rx) in enumerate(names.items())))
    first = F.array_min(F.filter(found, lambda x: x["at"] > 0))
    return F.coalesce(first["name"], F.lit(""))


#: Legal forms and articles at an employer's name, and capitalised words that name none.
LEGAL = "sa sas sasu sarl gmbh ag ab aktiebolag inc ltd llc se group groupe the la le les l".split()
CAPITAL_STOP = "the you your our join work place france company description who are about we with for and this that will position mission missions location within paris toulouse bordeaux lyon nantes rennes grenoble lille job role team".split()


def employer_group(name: Column) -> Column:
    """First word of a normalised name that is no legal form (of all words, if there are no others); '' for nothing."""
    full = F.split(F.trim(F.regexp_replace(F.lower(_text(name)), r"(?U)\W+", " ")), " ")
    own = F.filter(full, lambda w: ~w.isin(LEGAL))
    return F.when(F.size(own) > 0, F.get(own, 0)).otherwise(F.get(full, 0))


def capital_words(text: Column, within: int = 300) -> Column:
    """The lower-case capitalised words of three characters or more, without the stop list, in order."""
    found = F.regexp_extract_all(F.substring(_text(text), 1, within), F.lit(r"\b[A-Z][A-Za-z0-9&\-]{2,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, CAPITAL_STOP))))


#: Pieces between occurrences that mostly hold a window; where they don't, as many as it has characters are taken.
FEW = 6


def every_occurrence(text: Column, term: str, beside: str, instead: str | None = None, width: int = 60) -> Column:
    """X27: 'none' where a term's pattern doesn't occur, 'all' where each occurrence has `beside` within `width` characters on either side (and not `instead`
    right of it), else 'some'. A term that is meant otherwise everywhere can then be dropped."""
    rx = f"(?i){term}"
    found = F.regexp_extract_all(_text(text), F.lit(rx), F.lit(0))
    between = F.split(_text(text), rx)
    reach = width + 1

    def told(x):
        n = F.size(x["found"])

        def fits(i):
            before = lambda k: F.substring(F.concat(F.array_join(F.slice(x["pieces"], F.greatest(i + 1 - k, F.lit(1)), F.least(i, F.lit(k))), ""), F.get(x["between"], i)), -width, width)
            after = lambda k: F.substring(F.array_join(F.slice(x["pieces"], i + 2, F.lit(k)), ""), 1, width)
            enough = lambda side: let(side(FEW), lambda t: F.when(F.length(t) < width, side(reach)).otherwise(t))

            def good(sides):
                beside_it = sides["left"].rlike(f"(?i){beside}") | sides["right"].rlike(f"(?i){beside}")
                return beside_it & ~sides["right"].rlike(f"(?i){instead}") if instead else beside_it

            return let(F.struct(enough(before).alias("left"), enough(after).alias("right")), good)

        return F.when(n == 0, "none").when(F.forall(F.sequence(F.lit(0), n - 1), fits), "all").otherwise("some")

    # Worked out once a text, not for each occurrence; a piece holds a character at least, but for the last.
    return let(let(F.struct(found.alias("found"), between.alias("between")), lambda x: F.struct(x["found"].alias("found"), x["between"].alias("between"), F.zip_with(x["between"], x["found"], lambda p, m: F.concat(p, _text(m))).alias("pieces"))), told)


def named_occupations(title: Column, patterns: dict[str, str]) -> Column:
    """The named occupations whose pattern a title matches."""
    return F.array_compact(F.array(*(F.when(_text(title).rlike("(?i)" + rx), F.lit(n)) for n, rx in patterns.items())))


def search_hits(title: Column, description: Column, term: str) -> Column:
    """X30, PB11: struct of how different search rules would find a term: as a token of the title, of the description, in the first 1,000 characters, as a
    substring, and as a token between white space."""
    token = rf"(?iU)(?<!\w){term}(?!\w)"
    first = F.substring(_text(description), 1, 1000)
    both = F.lower(F.concat_ws(" ", _text(title), _text(description)))
    return F.struct(_text(title).rlike(token).alias("title"), _text(description).rlike(token).alias("description"), first.rlike(token).alias("early"),
                    both.contains(term.lower()).alias("substring"), F.array_contains(F.split(both, r"\s+"), term.lower()).alias("spaced"))


def occupation_code(uris: Column, prefix: str) -> Column:
    """Struct of the first occupation address with the prefix and the four digits of the first classification address."""
    uri = F.get(F.filter(uris, lambda u: u.startswith(prefix)), 0)
    code = F.get(F.filter(F.transform(uris, lambda u: F.regexp_extract(u, r"/isco/C?([0-9]{1,4})$", 1)), lambda c: c != ""), 0)
    return F.struct(uri.alias("uri"), code.alias("code"))


def source_parts(source: Column, merged: dict[str, str], boards: dict[str, tuple[str, str | None]]) -> Column:
    """struct<label, platform, country> of a source: its merged label, its platform without a country suffix, and the suffix's country."""
    of = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for pair in ({"": None} | table).items() for x in pair)), source)
    platform, country = {k: v[0] for k, v in boards.items()}, {k: v[1] for k, v in boards.items()}
    return F.struct(F.coalesce(of(merged), source).alias("label"), F.coalesce(of(platform), source).alias("platform"), of(country).cast("string").alias("country"))


def years(text: Column) -> Column:
    """The distinct years 1950 to 2039 that a text mentions, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"\b(19[5-9][0-9]|20[0-3][0-9])\b"), F.lit(1))))


def month_bounds(day: Column) -> Column:
    """Struct of a day's Monday, first and last day of its month and of its quarter."""
    quarter = F.to_date(F.date_trunc("quarter", day))
    return F.struct(F.to_date(F.date_trunc("week", day)).alias("monday"), F.to_date(F.date_trunc("month", day)).alias("month_first"), F.last_day(day).alias("month_last"),
                    quarter.alias("quarter_first"), F.date_sub(F.add_months(quarter, 3), 1).alias("quarter_last"))


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months from a's month to b's."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def length_bin(text: Column) -> Column:
    """X36."""
    n = F.length(_text(text))
    return F.when(n == 0, "0").when(n < 500, "<500").when(n < 1500, "<1500").when(n < 4000, "<4000").otherwise("4000+")


#: Fixed value: words that don't count when titles are compared.
TITLE_STOP = "a an the and or for of at to in with on m f d w job jobs".split()


def title_words(title: Column) -> Column:
    """The distinct words of a title, without a plural s and without stop words."""
    found = F.filter(F.regexp_extract_all(F.lower(_text(title)), F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.isin(TITLE_STOP))
    return F.array_distinct(F.transform(found, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def title_f1(a: Column, b: Column) -> Column:
    """F1 of two titles' words; 0 where either has none."""
    wa, wb = title_words(a), title_words(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(wa, wb)), F.when((F.size(wa) > 0) & (F.size(wb) > 0), F.size(wa) + F.size(wb))), F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    """Rounded half to even on the decimal digits."""
    return F.bround(c, digits)
