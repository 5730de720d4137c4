"""Licence scans by canonical digests. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import fits, read, stored

# Spellings that count as equal, after lower-casing and removal of punctuation.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("organisation", "organization"), ("organisations", "organizations"),
    ("authorised", "authorized"), ("unauthorised", "unauthorized"), ("recognised", "recognized"), ("favour", "favor"), ("behaviour", "behavior"),
    ("centre", "center"), ("analyse", "analyze"), ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"), ("cancelled", "canceled"),
    ("labour", "labor"), ("honour", "honor"), ("merchantibility", "merchantability"), ("noninfringment", "noninfringement"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
)

# Short licence texts and notices, by identifier.
KNOWN = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
)

#: Published licence texts, whole: a file's name is its identifier, with what tells variants apart before ".txt".
FOLDER = Path(__file__).with_name("licences")
#: Titles under which texts that hold none are published.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Lines that name a holder, with a year or not; a bare "copyright x" only where its paragraph ends, and not the words of a licence that wraps there.
_HOLDER = (
    r"(?im)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|&copy;|<|\[|\{)|©)[^\r\n]*$"
    r"|^[ \t*#/;-]*copyright[ \t]+(?!(?:holders?|owners?|owned|notices?|licen[cs]es?|laws?|acts?|interests?|statements?|doctrines?|treaty|treaties|status|ownership|disclaimers?|infringement|protection|permissions?|grants?|rights?|and|or|in|to|on|is|of|for|as|with)\b)[^\r\n]*"
    r"(?=(?:\r?\n[ \t*#/;-]*(?:\r?\n|copyright\b|all rights reserved|\Z))|\Z)"
)


def _once(x: Column, made: Callable[[Column], Column]) -> Column:
    """made(x) with x worked out once, however often made uses it."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def canonical(text: Column) -> Column:
    """Text as licences compare: copyright lines and comment marks dropped, lower case, letters and digits only, one spelling, single spaces."""
    known = "|".join(a.replace(" ", r"[^\p{L}\p{N}]+") for a, _ in SPELLINGS)

    def spelt(plain: Column) -> Column:
        for a, b in SPELLINGS:
            plain = F.replace(plain, F.lit(f" {a} "), F.lit(f" {b} "))
        return plain

    def of_lower(low: Column) -> Column:
        lines = F.regexp_replace(low, r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©)[^\r\n]*[0-9]{4}[^\r\n]*$|(?m)^[ \t*#/;-]*all rights reserved\.?[ \t]*$", "")
        plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
        return F.trim(_once(plain, lambda p: F.when(low.rlike(known), spelt(p)).otherwise(p)))

    return _once(F.lower(F.coalesce(text.cast("string"), F.lit(""))), of_lower)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null if nothing is left of it."""
    return _once(canonical(text), lambda made: F.when(made != "", F.sha2(made.cast("binary"), 256)))


def unheld(text: Column) -> Column:
    """The digest of a text without the lines that name a holder; null for texts that don't speak of copyright."""
    spoken = F.lower(text.cast("string"))
    return F.when(F.contains(spoken, F.lit("copyright")) | F.contains(spoken, F.lit("©")), digest(F.regexp_replace(text, _HOLDER, "")))


def known_digests(licences: DataFrame) -> DataFrame:
    """(digest, license_id, word) of known texts (license_id, text), with and without lines that name a holder: one row per digest, the least identifier; word is the first one of the canonical text."""
    bare = F.when(unheld(F.col("text")).isNotNull(), canonical(F.regexp_replace("text", _HOLDER, "")))
    made = licences.select("license_id", F.explode(F.array(canonical(F.col("text")), bare)).alias("made")).where("made <> '' and license_id is not null")
    return made.select("license_id", F.sha2(F.col("made").cast("binary"), 256).alias("digest"), F.substring_index("made", " ", 1).alias("word")).groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("word").alias("word"))


def first_words(words: list[str]) -> list[str]:
    """Words that a text may begin with if its canonical text begins with one of these."""
    found, before = set(words), -1
    while len(found) > before:
        before = len(found)
        found |= {a.split()[0] for a, b in SPELLINGS if b.split()[0] in found}
    return sorted(found)


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id, notices) for each row of docs.

    license_id tells of a document whose entire text is a known licence (null if it isn't), be it only without the lines that name a
    holder; digest is that of the text with such lines, unless they hold a year. notices the known licences or notices that
    entire lines of it are (sorted, each once). Null, empty and wordless texts have no digest and match nothing. Repeated rows and
    rows without doc_id stay; an empty table on either side is no error; other columns are ignored.

    Texts are read once: digests of whole texts and of lines are stored and then joined with the known ones. A line is put in its canonical form only if its
    first word begins a known text. What the driver gets of the known texts is their different first words.
    """
    known = known_digests(licences)
    few = (lambda df: F.broadcast(df)) if fits(known) else (lambda df: df)
    begins = first_words([r.word for r in known.select("word").distinct().collect()])
    first = lambda line: F.lower(F.regexp_extract(line, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))
    lines = F.filter(F.array_distinct(F.split("text", r"\R")), lambda line: first(line).isin(begins) if begins else F.lit(False))
    digests = F.filter(F.transform(lines, digest), lambda x: x.isNotNull())
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(text.select(F.monotonically_increasing_id().alias("_row"), "doc_id", digest(F.col("text")).alias("digest"), unheld(F.col("text")).alias("_unheld"), F.when(F.size(digests) > 0, digests).alias("_lines")), "digests")
    found = rows.where("_lines is not null").select(F.col("_row").alias("_of"), F.explode("_lines").alias("digest")).join(few(known.select("digest", "license_id")), "digest")
    notices = found.groupBy("_of").agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    named, bare = known.select("digest", "license_id"), known.select(F.col("digest").alias("_bare"), F.col("license_id").alias("_license"))
    # Most texts have no second digest; their first one stands in, so that they spread over the tasks of a shuffled join.
    whole = rows.join(few(named), "digest", "left").join(few(bare), F.coalesce("_unheld", "digest") == F.col("_bare"), "left").withColumn("license_id", F.coalesce("license_id", "_license"))
    return whole.join(notices, F.col("_row") == F.col("_of"), "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def published() -> list[tuple[str, str]]:
    """(license_id, text) of whole texts as they are published: with and without title, with and without what follows the terms, with http and https."""
    texts = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(FOLDER.glob("*.txt"))]
    texts = [(re.sub(r"\.[a-z]+$", "", name), text) for name, text in texts] + [(name, text) for name, text in KNOWN if "\n" in text]
    found = set()
    for name, text in texts:
        bodies = {text}
        head, _, rest = text.strip().partition("\n\n")
        if rest and len(head.split()) <= 12:
            bodies.add(rest)
        for ends in re.finditer(r"(?m)^[ \t]*(END OF TERMS AND CONDITIONS)[ \t]*$", text):
            bodies |= {b[: b.rindex(ends[1])] + tail for b in tuple(bodies) for tail in ("", ends[1]) if ends[1] in b}
        bodies |= {re.sub(r"(?m)^[ \t]*(?:\d\.|\(\d\))[ \t]+", "", b) for b in tuple(bodies) if name.startswith("BSD")}
        bodies |= {b.replace("https://", "http://") for b in bodies} | {b.replace("http://", "https://") for b in bodies}
        found |= {(name, f"{title}\n\n{b}") for b in bodies for title in ("", *TITLES.get(name, ()))}
    return sorted(found)


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *published()], "license_id string, text string")


def op10_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), known_table(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


def _sql_canonical(x: str) -> str:
    lines = rf"regexp_replace(lower(coalesce({x}, '')), '(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©)[^\r\n]*[0-9]{{4}}[^\r\n]*$|(?m)^[ \t*#/;-]*all rights reserved\.?[ \t]*$', '', 'g')"
    made = rf"' ' || trim(regexp_replace({lines}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        made = f"replace({made}, ' {a} ', ' {b} ')"
    return f"trim({made})"


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QUERIES = {"op10_licence": op10_licence}
ORACLE = {
    "op10_licence": f"""
WITH known AS (
    SELECT digest, min(license_id) AS license_id
    FROM (SELECT license_id, sha256({_sql_canonical("text")}) AS digest FROM (VALUES {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in KNOWN)}) v(license_id, text))
    GROUP BY digest
), d AS (
    SELECT doc_id, text, CASE WHEN {_sql_canonical("text")} <> '' THEN sha256({_sql_canonical("text")}) END AS digest FROM documents
), l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN known ON sha256({_sql_canonical("line")}) = digest WHERE line <> '' GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""
}
