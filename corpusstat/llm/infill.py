"""Fill-in-middle: a text is cut into prefix, middle and suffix, which sentinels mark and put into another order.

Built from Spark SQL functions alone, one row at a time, with no shuffle: the array of units comes from regexp_extract_all, the cuts from
the digits of sha2, the arrangements from slice and array_join, and the text comes back from the sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a run of ASCII letters or any other single code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def digits(name: Column, i: int) -> Column:
    """The i-th group (from 0) of eight hexadecimal digits of name's SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(name, 256), 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix, middle, suffix (null where plain) and output.

    plain is the percentage of texts left as they are, spm that of the others that put the suffix first. A text that is empty or contains
    a sentinel is always plain. The cuts depend on seed and id alone, so equal ids are cut at the same draws and reruns agree. A null text counts as
    empty and a null id as an empty one. Texts of any length are cut as a whole; repeated rows stay; no rows give no rows; other columns are ignored."""
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    df = df.withColumns({"_units": F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)), **{f"_h{i}": digits(name, i) for i in range(4)}})
    n = F.size("_units").cast("long")
    cuts = [F.col(f"_h{i}") % (n + 1) for i in range(2)]
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = F.when((n == 0) | marked | (F.col("_h2") % 100 >= 100 - plain), "plain").when(F.col("_h3") % 100 < spm, "spm").otherwise("psm")
    df = df.withColumns({"n": n, "_a": F.least(*cuts).cast("int"), "_b": F.greatest(*cuts).cast("int"), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    df = df.select("_id", "_text", "n", "form", part(F.lit(1), F.col("_a")).alias("prefix"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
                   part(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    turned = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", turned).otherwise(psm)
    return df.select(F.col("_id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form. No part holds a sentinel and none of the three sentinels ends as another begins, so the first
    of each kind is the one that was put there."""
    between = lambda start, end: F.substring_index(F.substring_index(output, end, 1), start, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    turned = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", turned).otherwise(psm)


SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM a),
c AS (SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS x, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, form, array_to_string(u[1:x], '') AS p, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:n], '') AS s FROM c),
f AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS output FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN regexp_extract(output, '^<P>((?s:.*))<S>', 1) || regexp_extract(output, '<M>((?s:.*))$', 1) || regexp_extract(output, '<S>((?s:.*))<M>', 1)
  ELSE regexp_extract(output, '<P>((?s:.*))<M>', 1) || regexp_extract(output, '<M>((?s:.*))$', 1) || regexp_extract(output, '^<S>((?s:.*))<P>', 1) END) AS restored_sha256 FROM f"""
