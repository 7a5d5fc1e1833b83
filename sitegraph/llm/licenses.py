"""License scans by canonical digest: whole texts, and whole lines, against known licence texts.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import UPPER, LOWER, only, text_of

# --- fixed values: public licence notices and equivalent spellings ---
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
SPELLINGS = [
    ("licence", "license"), ("non commercial", "noncommercial"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("per cent", "percent"), ("copyright holder", "copyright owner"),
    ("http ", "https "),
]
COPYRIGHT_LINE = "(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*"
PUNCTUATION = "[^0-9a-z\\x{80}-\\x{10FFFF}]+"
# --- end of fixed values ---

# full texts in license_texts/<license>.txt; those without a title of their own get each of these, or none
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
}
FULL_TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0",
              "MIT", "MPL-2.0"]


def canonical(text: Column) -> Column:
    """Lower case (A-Z), copyright lines dropped, punctuation and blanks as one blank, spellings unified."""
    c = F.translate(text, UPPER, LOWER)
    c = F.regexp_replace(c, COPYRIGHT_LINE, "\n")
    c = F.btrim(F.regexp_replace(c, PUNCTUATION, " "))
    for other, usual in SPELLINGS:
        c = F.replace(c, F.lit(other), F.lit(usual))
    return c


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def full_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of whole licences in the forms they are passed on in.

    With and without title, "All rights reserved." line, clause numbers and
    (Apache) appendix; wrapped as published, or one line a paragraph.
    """
    forms = []
    for name in FULL_TEXTS:
        text = resources.files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")
        bodies = [text]
        if name == "Apache-2.0":
            end = "END OF TERMS AND CONDITIONS"
            bodies.append(text[:text.index(end) + len(end)])
        if name.startswith("BSD"):
            bodies.append(re.sub(r"(?m)^\d\. ", "* ", text))
            bodies += ["All rights reserved.\n\n" + b for b in bodies]
        heads = ["", *(t + "\n\n" for t in TITLES.get(name, []))]
        for form in (h + b for h in heads for b in bodies):
            forms += [(name, form), (name, re.sub(r"(?<=\S)[ \t]*\n(?=[ \t]*\S)", " ", form))]
    return forms


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES + full_texts(), "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 broadcast_rows: int = 100_000) -> DataFrame:
    """Known licences that a whole text, or one of its whole lines, is canonically equal to.

    ``known`` has ``license, text`` (default: common notices and full texts); licences that
    share a canonical form are all reported. Returns one row per input row:
    ``doc_id, text_digest, text_license`` (comma-joined, sorted; null if none),
    ``line_licenses`` (likewise over all lines) and ``n_license_lines``.

    A null text counts as empty; an empty canonical form matches nothing. Equal
    rows get equal answers; null ids are kept. An empty table gives an empty
    result; further columns are ignored. ``known`` is broadcast only if counted
    at most ``broadcast_rows`` rows; beyond that it is joined by shuffles.
    """
    spark = docs.sparkSession
    known = known if known is not None else known_licenses(spark)
    table = known.select(F.col("license").cast("string").alias("license"), canonical(F.col("text").cast("string")).alias("c")) \
        .where(F.col("c") != "").select("license", F.sha2("c", 256).alias("digest")).distinct()
    small = table.limit(broadcast_rows + 1).count() <= broadcast_rows
    table = F.broadcast(table) if small else table
    t = text_of(text_col)
    rows = only(docs, doc_id=id_col, t=t).select("doc_id", "t", F.xxhash64("t").alias("_h"))
    whole = rows.select("doc_id", "_h", digest(F.col("t")).alias("text_digest"))
    units = rows.select("doc_id", "_h", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("pos"), F.col("t").alias("u"))),
        F.transform(F.split("t", "\n"), lambda u, i: F.struct(i.alias("pos"), u.alias("u"))))).alias("x"))
    hits = units.select("doc_id", "_h", F.col("x.pos").alias("pos"), digest(F.col("x.u")).alias("digest")).join(
        table, "digest").groupBy("doc_id", "_h").agg(
        F.array_sort(F.collect_set(F.when(F.col("pos") < 0, F.col("license")))).alias("tl"),
        F.array_sort(F.collect_set(F.when(F.col("pos") >= 0, F.col("license")))).alias("ll"),
        F.count_distinct(F.when(F.col("pos") >= 0, F.col("pos"))).alias("n"))
    joined = whole.join(hits.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), "tl", "ll", "n"),
                        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")

    def names(c):
        return F.when(F.size(c) > 0, F.array_join(c, ","))

    return joined.select("doc_id", "text_digest", names("tl").alias("text_license"), names("ll").alias("line_licenses"),
                         F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"))
