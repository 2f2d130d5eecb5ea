"""License scans by canonical digest lookup, in DataFrame operations only.

A text is made canonical (lower case; copyright lines removed; everything but a-z and 0-9 one space; equivalent spellings made
one) and digested. The form does not depend on how lines are wrapped or commented, and the title may be missing. Entire texts are hash-joined with the digests of known licenses; lines that hold a trigger word
are canonical texts of their own and are joined with the digests of known one-line notices. Documents are read
once: their digests are written, and only digests are joined. The known digests are whatever table the caller
gives, so nothing is broadcast by force; joins are left to Spark's size checks.

Defined results: a null text is empty; an empty text matches nothing; repeated rows are scanned one by one; null ids are
carried along; of several licenses with one canonical text the smallest id counts; very long texts cost their length; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.session import stage

from .common import text_or_empty

# Fixed values (in lower case): copyright lines, and the copyright notices that stand inside license texts. A copyright line begins, but
# for comment marks, with the word or sign and a year (or the place for one), or follows such a line and begins with "(c)"; a wrapped
# sentence that begins with the word is none.
_YEAR = r"(\(c\)|©|[0-9]{4}|[<\[{](year|yyyy)|by\b)"
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n©(]*((copyright[^a-z0-9\n©(\[<{]*" + _YEAR + r"|©|\(c\)[^a-z0-9\n]*(copyright|[0-9]{4}))[^\n]*(\n[^a-z0-9\n]*\(c\)[^\n]*)*"
    r"|all rights reserved[^a-z0-9\n]*(\n|$))"
)
_OWN_NOTICES = (
    "copyright c( [0-9]{4})+ free software foundation inc( https? (www )?fsf org)?( 51 franklin street( suite 500)?( fifth floor)? boston ma 02110 133[0-9] usa"
    "| 51 franklin street fifth floor boston ma 02110 1301 usa)?",
    "copyright c year name of author",
)
#: The same notices in a text that is not yet canonical: words with anything but letters and digits between them.
OWN_NOTICES = "|".join(n.replace(" ", "[^a-z0-9]+") for n in _OWN_NOTICES)
#: Characters of a first paragraph up to which it is a title, which a copy may lack.
LONGEST_TITLE = 160
# Spellings that count as one.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licenc", "licens"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("recognis", "recogniz"),
    ("sub license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Every known notice holds one of these in its canonical form.
TRIGGERS = ("licens", "public domain", "cc0")

# Names of licenses as notices give them.
NAMES = (
    ("MIT", ("MIT License", "MIT licence terms")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU GPL version 2", "GNU General Public License v2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU GPL version 3", "GNU General Public License v3.0")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License")),
    ("ISC", ("ISC License",)),
    ("Zlib", ("zlib License",)),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0",)),
    ("CC-BY-NC-ND-4.0", ("CC BY-NC-ND 4.0",)),
)
SENTENCES = (
    "{verb} under {name}",
    "{verb} under the {name}",
    "{verb} under the terms of the {name}",
    "This {thing} is {verb} under {name}",
    "This {thing} is {verb} under the {name}",
    "This {thing} is {verb} under a {name}",
)
VERBS = ("Licensed", "Released", "Distributed", "Made available")
THINGS = ("work", "program", "project", "software", "file", "document", "article", "text")

# Lines of the standard headers that name their license.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Entire license texts without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: And those of the data folder, as their authors publish them.
TEXTS |= {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


# -- canonical form ------------------------------------------------------------


def canonical(text: Column) -> Column:
    own = F.regexp_replace(F.lower(text), OWN_NOTICES, " ")
    # Lines that follow each other share their line feed: twice finds every one.
    bare = F.regexp_replace(F.regexp_replace(own, COPYRIGHT_LINE, "\n"), COPYRIGHT_LINE, "\n")
    spaced = F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, spaced)


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    own = f"regexp_replace(lower({text}), '{OWN_NOTICES}', ' ', 'g')"
    bare = f"regexp_replace(regexp_replace({own}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{COPYRIGHT_LINE}', chr(10), 'g')"
    spaced = f"trim(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g'))"
    return reduce(lambda t, pair: f"replace({t}, '{pair[0]}', '{pair[1]}')", SPELLINGS, spaced)


# -- known licenses ------------------------------------------------------------


def notice_rows() -> list[tuple[str, str]]:
    """(license id, notice) by rule: every sentence with every name, and the identifier lines."""
    rows = list(HEADERS)
    for license_id, names in NAMES:
        for sentence, verb, thing, name in product(SENTENCES, VERBS, THINGS, names):
            rows.append((license_id, sentence.format(verb=verb.lower(), thing=thing, name=name)))
        rows += [(license_id, f"SPDX-License-Identifier: {license_id}"), (license_id, f"License: {license_id}")]
    return sorted(row for row in set(rows) if any(t in row[1].lower().replace("licenc", "licens") for t in TRIGGERS))


def untitled(text: str) -> str | None:
    """The text without its first paragraph, if that is a title."""
    title, _, rest = text.strip("\n").replace("\r\n", "\n").partition("\n\n")
    return rest if rest and len(" ".join(title.split())) <= LONGEST_TITLE else None


def text_rows() -> list[tuple[str, str]]:
    """(license id, entire text), with and without the title."""
    return [(i, t) for i, text in TEXTS.items() for t in (text, untitled(text)) if t]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(text_rows(), "license_id string, text string")


def known_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(notice_rows(), "license_id string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id), one row per digest."""
    return known.groupBy(F.md5(canonical(text_or_empty("text"))).alias("digest")).agg(F.min("license_id").alias("license_id"))


# -- the scan ------------------------------------------------------------------


def scan_licenses(
    docs: DataFrame,
    licenses: DataFrame | None = None,
    notices: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, digest of the entire canonical text, license_id of it (or null), n_notices,
    and notice_ids, the licenses of its notice lines (sorted, comma-joined)."""
    spark = docs.sparkSession
    whole = digests(licenses if licenses is not None else known_licenses(spark))
    lines = digests(notices if notices is not None else known_notices(spark))
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    triggered = F.filter(
        F.split(F.replace(F.lower("text"), F.lit("licenc"), F.lit("licens")), "\n"),
        lambda line: reduce(lambda a, b: a | b, (line.contains(t) for t in TRIGGERS)),
    )
    # A row's own number is written with its digests, so that it stays the same in all later reads.
    scanned = stage(
        named.select(
            "doc_id",
            F.md5(canonical(F.col("text"))).alias("digest"),
            F.transform(triggered, lambda line: F.md5(canonical(line))).alias("lines"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    met = scanned.select("row", F.explode("lines").alias("digest")).join(lines, "digest")
    noticed = met.groupBy("row").agg(
        F.count("*").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notice_ids")
    )
    return (
        scanned.join(whole, "digest", "left")
        .join(noticed, "row", "left")
        .select(
            "doc_id",
            "digest",
            "license_id",
            F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
            F.coalesce("notice_ids", F.lit("")).alias("notice_ids"),
        )
    )


def scan_sql() -> str:
    """The scan of ``documents`` with the built-in licenses, in DuckDB's SQL."""

    def values(rows) -> str:
        return ",".join("('{}','{}')".format(a, b.replace("'", "''")) for a, b in rows)

    trigger = " or ".join(f"contains(line, '{t}')" for t in TRIGGERS)
    return f"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
known as (select md5({canonical_sql("text")}) as digest, min(id) as license_id
          from (values {values(text_rows())}) v(id, text) group by 1),
notices as (select md5({canonical_sql("text")}) as digest, min(id) as license_id
            from (values {values(notice_rows())}) v(id, text) group by 1),
lines as (select row, unnest(string_split(replace(lower(text), 'licenc', 'licens'), chr(10))) as line from docs),
met as (select row, count(*) as n_notices, string_agg(distinct license_id, ',' order by license_id) as notice_ids
        from (select row, md5({canonical_sql("line")}) as digest from lines where {trigger}) join notices using (digest)
        group by row),
whole as (select row, doc_id, md5({canonical_sql("text")}) as digest from docs)
select doc_id, digest, license_id, coalesce(n_notices, 0)::bigint as n_notices, coalesce(notice_ids, '') as notice_ids
from whole left join known using (digest) left join met using (row)
"""
