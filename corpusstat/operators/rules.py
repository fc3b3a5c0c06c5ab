"""Rules over tags and terms, manual labels, lexicons and review lists. What changes is logged in columns, so a rule's log is a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.functions import prepare as P
from corpusstat.operators.relate import CHANNELS

#: Terms that tie a posting to critical materials, and the intensities of a label.
ANCHORED = ["critical raw materials", "rare earths", "strategic raw materials", "battery materials", "lithium", "raw materials security", "critical metals", "strategic resource", "battery recycling"]
LEVELS = ["high", "medium", "low"]


def ruled(tags: DataFrame, rules: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """The first rule (name, condition, new values) that holds changes a tag; the model's values stay in *_model, post_rule names the rule."""
    fields = sorted({f for _, _, new in rules for f in new})
    hit = [F.coalesce(c, F.lit(False)) for _, c, _ in rules]
    rule = F.coalesce(*(F.when(h, F.lit(name)) for h, (name, _, _) in zip(hit, rules)), F.lit(None).cast("string"))
    new = {}
    for f in fields:
        value = F.col(f)
        for h, (_, _, values) in reversed(list(zip(hit, rules))):
            value = F.when(h, values.get(f, F.col(f))).otherwise(value)
        new[f] = value
    out = tags.withColumns({"_rule": rule} | {f"_new_{f}": v for f, v in new.items()})
    keep = [c for c in tags.columns if c not in fields]
    return out.select(*keep, *(F.col(f"_new_{f}").alias(f) for f in fields), *(F.when(F.col("_rule").isNotNull(), F.col(f)).alias(f"{f}_model") for f in fields), F.col("_rule").alias("post_rule"))


#: Wordings of sovereignty, of supply, of certificates, of duties, of lists of wishes, of an employer about itself, and of work; and the names of providers.
SOVEREIGN = r"sovereign|secnumcloud|\beucs\b|gaia-x|ai factor|gigafactor|eurohpc|european cloud|cloud de confiance"
SUPPLY = (r"dual[- ]?sourc|multi[- ]?sourc|multiple (sources|suppliers)|second[- ]source|alternative (supplier|sourc|source)s?|diversif\w*\s+(the\s+|our\s+)?(supplier|supply|sourcing|source)|"
          r"(reduc\w+|less|lower|decreas\w+|minimi[sz]\w+)\s+(our\s+|the\s+)?(dependen\w+|reliance)|dependen\w+ on (a )?(single|one|china|chinese)|"
          r"single[- ]source|sole[- ]source|nearshor\w+|near-shor\w+|friend-?shor\w+|reshor\w+|free trade agreement|new export markets?|source (from|outside) (china|asia)|supply chain resilien")  # fmt: skip
DUTY = (r"\b(ensur\w*|guarantee\w*|prepar\w*|obtain\w*|audit\w*|maintain\w*|carry\w* out|conduct\w*|lead\w*|manag\w*|align\w*|implement\w*|follow\w*|monitor\w*|validat\w*|driv\w*)\b")
WISHES = (r"\b(plus|appreciated|asset|knowledge|familiar\w*|prerequisite|nice to have|already offers|experience (of|in|with|as)|first experience|have experience|years of experience)\b")
EMPLOYER = r"\bwe offer\b|\bour own\b|already offers|reflected in|brand of|\bis an? (sovereign|leading|trusted)\b"
WORK = r"\b(build|design|develop|operate|run|responsible|join|our|we|you|will|work|lead|manage|ensure|support|is|are|has|have|offers?|provides?)\b"
PROVIDERS = ["s3ns", "outscale", "ovhcloud", "scaleway", "bleu", "numspot", "stackit", "cloud temple", "delos cloud", "gaia-x", "cloud de confiance", "eurostack", "aleph alpha", "secnumcloud", "eucs"]


def tool_list(evidence: Column) -> Column:
    """Whether evidence is a list of tools: at most 200 characters, three commas or more, no word of work, and no item of more than four words."""
    ev = P.stripped(evidence)
    items = F.filter(F.split(ev, "[,:;]"), lambda x: P.stripped(x) != "")
    short = F.forall(items, lambda x: F.size(F.split(P.stripped(x), r"\s+")) <= 4)
    return (F.length(ev) <= 200) & (F.size(F.split(ev, ",")) >= 4) & ~ev.rlike("(?iuU)" + WORK) & short


def certificate_intensity(evidence: Column, text: Column, model: Column, certificates: tuple) -> Column:
    """How closely a role has to do with a certificate, from the sentence or bullet that names it first (of the text, else the evidence that names it): where the employer speaks of itself, what the model said (low, if
    that is no level); high for a duty, with no wishes and the certificate not among three or more things between its commas or brackets; else low."""
    named = "(?:" + "|".join(certificates) + ")"
    within = lambda c, before, after: F.regexp_extract(c, f"(?i)[^{before}]*?{named}[^{after}]*", 0)
    sentence = F.substring(within(text, ".;•\\n", ".;•\\n"), 1, 400)
    sentence = F.when(sentence != "", sentence).when(evidence.rlike("(?i)" + named), evidence).otherwise("")
    span = within(F.when(text != "", text).otherwise(evidence), "(.;•\\n", ").;•\\n")
    many = F.size(F.regexp_extract_all(span, F.lit(r"(?U),|\bor\b|\band\b|/"), F.lit(0))) >= 2
    duty = sentence.rlike("(?iuU)" + DUTY) & ~sentence.rlike("(?iuU)" + WISHES) & ~many
    return F.when(sentence == "", "low").when(sentence.rlike("(?iuU)" + EMPLOYER), F.when(model.isin(LEVELS), model).otherwise("low")).when(duty, "high").otherwise("low")


def post_rules(supply: str = SUPPLY, sovereign: str = SOVEREIGN, providers: list[str] = PROVIDERS, certificates: tuple = ("secnumcloud", "eucs")) -> list[tuple[str, Column, dict[str, Column]]]:
    """R0 to R3 for tags with channel, intensity, subtype, evidence, terms, raw, ok and the posting's text: a cloud label in the channel's place; supply-side, or no subtype and no wording of sovereignty, without
    wording of supply; a certificate's name in a role (certificate_intensity()); a provider named in a list of tools (tool_list()). Patterns ignore case; nulls are empty."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    hay = F.concat_ws(" ", said("evidence"), said("text"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<string>")), F.lower)
    level = F.regexp_extract(said("raw"), r'"channel"\s*:\s*"sovereign[- ]cloud"\s*,\s*"intensity"\s*:\s*"(low|medium|high)"', 1)
    new = lambda channel, intensity, subtype: {"channel": F.lit(channel), "intensity": intensity, "subtype": F.lit(subtype)}
    plain = (said("subtype") == "supply-side") | ((said("subtype") == "") & ~hay.rlike("(?iuU)" + sovereign))
    named = F.arrays_overlap(terms, F.array(*map(F.lit, certificates)))
    only = (F.size(terms) > 0) & (F.size(F.array_except(terms, F.array(*map(F.lit, providers)))) == 0)
    return [
        ("R0 cloud label as channel", ~F.coalesce("ok", F.lit(False)) & (level != ""), new("diversification", level, "sovereign-tech")),
        ("R1 supply-side without its wording", F.col("ok") & (F.col("channel") == "diversification") & plain & ~hay.rlike("(?iuU)" + supply), new("none", F.lit("none"), "")),
        ("R2 certificate in a role", F.col("ok") & F.col("channel").isin("none", "trade compliance") & named, new("diversification", certificate_intensity(said("evidence"), said("text"), said("intensity"), certificates), "sovereign-tech")),
        ("R3 provider in a list of tools", F.col("ok") & (F.col("channel") == "diversification") & (said("subtype") == "sovereign-tech") & tool_list(said("evidence")) & only, new("none", F.lit("none"), "")),
    ]


def anchored(tags: DataFrame, channel: str = "critical materials", anchors: list[str] = ANCHORED) -> DataFrame:
    """Tags of a channel none of whose terms is an anchor become none."""
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    loose = F.col("ok") & (F.col("channel") == channel) & ~F.arrays_overlap(terms, F.array(*map(F.lit, anchors)))
    return ruled(tags, [("no anchored term", loose, {"channel": F.lit("none"), "intensity": F.lit("none")})])


def label_problems(labels: DataFrame, key: str, channels: list[str] = CHANNELS) -> DataFrame:
    """P5: labels with an unknown channel or intensity, or a channel without intensity; blank ones are no labels."""
    channel, level = F.lower(F.trim(F.coalesce("channel", F.lit("")))), F.lower(F.trim(F.coalesce("intensity", F.lit(""))))
    unknown = ~channel.isin([*channels, "none"]) | ~level.isin([*LEVELS, "none", ""])
    problem = F.when(unknown, "unknown channel or intensity").when((channel != "none") & level.isin("", "none"), "intensity missing")
    return labels.where(channel != "").select(key, problem.alias("problem")).where("problem is not null")


def relabelled(tags: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Tags with the labels' channel and intensity in place of their own, what they were before, and the rule's name added; the subtype stays with
    diversification alone. Labels have distinct keys."""
    new = labels.select(key, F.lower(F.trim("channel")).alias("_c"), F.lower(F.trim(F.coalesce("intensity", F.lit("")))).alias("_i")).where("_c <> ''")
    out = tags.join(new, key, "left")
    hit = F.col("_c").isNotNull()
    rule = F.when(hit, F.concat_ws("; ", "rule", F.lit("manual_review"))).otherwise(F.col("rule"))
    return out.select(
        *(c for c in tags.columns if c not in ("channel", "intensity", "subtype", "rule")), F.coalesce("_c", "channel").alias("channel"),
        F.when(F.col("_c") == "none", "none").when(hit, F.col("_i")).otherwise(F.col("intensity")).alias("intensity"),
        F.when(hit & (F.col("_c") != "diversification"), "").otherwise(F.col("subtype")).alias("subtype"), rule.alias("rule"),
        F.when(hit, F.col("channel")).alias("channel_before"), F.when(hit, F.col("intensity")).alias("intensity_before"),
    )


def unmatched(labels: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """P5: labels without a tag."""
    return labels.select(key).join(tags.select(key), key, "left_anti")


def lexicon(seeds: DataFrame, sheets: DataFrame, channels: list[str] = CHANNELS) -> tuple[DataFrame, DataFrame]:
    """(terms, problems). Terms are the seeds and the sheets' rows marked to keep whose key (lower case, hyphens as blanks) no seed, variant or earlier row
    has; problems are unknown channels and terms that stand under two channels. seeds: term, channel, variants; sheets: place, source, term, channel, keep."""
    key = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"[-\s]+", " ")
    forms = F.concat(F.array("term"), F.filter(F.split(F.coalesce("variants", F.lit("")), r"\|"), lambda v: F.trim(v) != ""))
    known = seeds.select("channel", F.explode(forms).alias("f")).select(key(F.col("f")).alias("key"), "channel", F.lit(-1).cast("long").alias("place"), F.col("f").alias("term"), F.lit("seed").alias("source"))
    kept = sheets.where(F.lower(F.trim(F.coalesce("keep", F.lit("")))).isin("1", "y", "yes", "x"))
    kept = kept.select(key(F.col("term")).alias("key"), F.lower(F.trim(F.coalesce("channel", F.lit("")))).alias("channel"), F.col("place").cast("long").alias("place"), F.trim("term").alias("term"), "source")
    bad = kept.where(~F.col("channel").isin(channels)).select("term", F.concat(F.lit("unknown channel "), "channel").alias("problem"))
    good = known.union(kept.where(F.col("channel").isin(channels)))
    first = good.groupBy("key").agg(F.min_by(F.struct("channel", "term", "source", "place"), F.struct("place", "term")).alias("r"))
    two = good.join(first.select("key", F.col("r.channel").alias("_c")), "key").where("channel <> _c")
    problems = bad.union(two.select("term", F.concat(F.lit("already under "), "_c", F.lit(", now "), "channel").alias("problem")))
    own = seeds.select("term", "channel", F.lit("seed").alias("source"))
    return own.union(first.where("r.place >= 0").select("r.term", "r.channel", "r.source")), problems


def wording_tiers(df: DataFrame, key: str, text: Column, tiers: dict[str, str], inside: tuple[str, str] | None = None) -> DataFrame:
    """The tiers whose pattern a text matches, and a fingerprint of what stands around each tier's first match. With inside = (pattern, names), matches
    of the pattern that all stand in one of the names (a ministry's, say) don't count."""
    body = F.coalesce(text, F.lit(""))
    count = lambda c, rx: F.size(F.regexp_extract_all(c, F.lit(f"(?i){rx}"), F.lit(0)))
    if inside:
        rx, names = inside
        in_names = F.aggregate(F.regexp_extract_all(body, F.lit(f"(?i){names}"), F.lit(0)), F.lit(0), lambda a, m: a + count(m, rx))
        body = F.when((count(body, rx) > 0) & (in_names >= count(body, rx)), F.regexp_replace(body, f"(?i){rx}", " ")).otherwise(body)
    around = lambda rx: F.md5(F.trim(F.regexp_replace(F.lower(P.context(body, F.regexp_extract(body, f"(?i){rx}", 0), 60)), r"(?U)\W+", " ")))
    found = F.array_compact(F.array(*(F.when(body.rlike(f"(?i){rx}"), F.struct(F.lit(t).alias("tier"), F.substring(around(rx), 1, 10).alias("fingerprint"))) for t, rx in tiers.items())))
    return df.select(key, F.explode(found).alias("t")).select(key, "t.tier", "t.fingerprint")


def watchlist(df: DataFrame, by: str, name: Column, firms: list[str], w: str) -> DataFrame:
    """By group the weight of rows whose normalised employer name holds a firm of the list, their share of all weight (an upper bound), and the firms met."""
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\W+", " ")), F.lit(" "))
    firm = F.coalesce(*(F.when(norm.contains(f" {f} "), F.lit(f)) for f in firms), F.lit(None).cast("string"))
    rows = df.select(by, F.col(w).alias("_w"), firm.alias("firm"))
    return rows.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("firm").isNotNull(), F.col("_w"))), F.lit(0.0)).alias("weight"),
                                (F.coalesce(F.sum(F.when(F.col("firm").isNotNull(), F.col("_w"))), F.lit(0.0)) / F.sum("_w")).alias("share"), F.count_distinct("firm").alias("firms"))


def truncation_exposed(df: DataFrame, key: str, text: Column, terms: Column, visible: int) -> DataFrame:
    """Rows some of whose terms stand in the text, but none in its first `visible` characters, with those terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    late = F.filter(terms, lambda t: (F.instr(low, F.lower(t)) > 0) & (F.instr(low, F.lower(t)) + F.length(t) - 1 > visible))
    there = F.filter(terms, lambda t: F.instr(low, F.lower(t)) > 0)
    out = df.select(key, late.alias("late"), F.size(there).alias("_n"))
    return out.where((F.col("_n") > 0) & (F.size("late") == F.col("_n"))).drop("_n")


def review_sheet(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """What changed between two sets of tags: new flags and removed ones (channel none counts as unflagged)."""
    old = before.select(key, F.col("channel").alias("_before"))
    out = now.join(old, key, "full").select(key, F.coalesce("_before", F.lit("none")).alias("before"), F.coalesce("channel", F.lit("none")).alias("now"))
    change = F.when((F.col("before") == "none") & (F.col("now") != "none"), "new").when((F.col("before") != "none") & (F.col("now") == "none"), "removed")
    return out.withColumn("change", change).where("change is not null")
