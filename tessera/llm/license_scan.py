"""Licence scan by canonical digest: a text is normalised as a whole and its digest looked up among known licences.

Normalisation folds case, punctuation, spacing, copyright lines and equivalent spellings, so a copy of a licence with
another holder, year, wrapping, comment marks or spelling has the digest of the licence. Whole texts are looked up, and
so is each line on its own, because notices stand as lines in longer documents. Only DataFrame functions take part.

The full texts lie in the folder `licences`, one file for each SPDX identifier; each is known with and without its
usual titles, its list numbers and what follows its terms. Notices of one line and identifiers stand below.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LICENCES = Path(__file__).parent / "licences"

# Licence notices, by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]

# Identifiers that are known in lines such as "SPDX-License-Identifier: MIT".
IDENTIFIERS = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense WTFPL Zlib"

# Titles that licence files begin with.
TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("ISC", "The ISC License"),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "The 2-Clause BSD License"),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "The 3-Clause BSD License"),
    ("BSD-3-Clause", "The BSD License"),
    ("BSD-3-Clause", "New BSD License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
    ("Zlib", "The zlib License"),
]

# Spellings that count as equal, after folding; whole words only.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("per cent", "percent"),
    ("owner", "holder"),
    ("https", "http"),
    ("v 2 0", "version 2 0"),
    ("v 3", "version 3"),
]

#: A line that names a holder or a year, with its line break; a line that only begins with the word copyright stays.
COPYRIGHT = "(^|\\n)[^\\p{L}\\p{N}\\n(©]*((?i:copyright)[ \\t:,]*(\\((?i:c)\\)|©|[0-9]{4}|[<\\[{]|(?i:by)[ \\t]|\\p{Lu}\\p{Ll})|\\((?i:c)\\)|©|(?i:all rights reserved))[^\\n]*"
WORD = "[\\p{L}\\p{N}]+"


def without_holders(text: Column) -> Column:
    """The text with its copyright lines left blank."""
    return F.regexp_replace(text, COPYRIGHT, "\n")


def folded(text: Column) -> Column:
    """One line of lower-case words. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def canonical(words: Column) -> Column:
    """Folded words in their usual spellings."""
    for spelled, usual in SPELLINGS:
        words = F.regexp_replace(words, f"\\b{spelled}\\b", usual)
    return words


#: The usual spellings shorten folded words to no less than this share of their length.
SHRINK = min(1.0, min(len(usual) / len(spelled) for spelled, usual in SPELLINGS))


def digest(words: Column) -> Column:
    return F.sha2(words, 256)


def _forms(licence: str, text: str) -> list[str]:
    """The text as files hold it: with each title or none, with or without list numbers and what follows the terms."""
    bodies = [text]
    if (end := re.search(r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$", text)) is not None:
        bodies += [text[: end.end()], text[: end.start()]]
    if (exhibit := re.search(r"(?m)^Exhibit A - ", text)) is not None:
        bodies.append(text[: exhibit.start()])
    bodies += [re.sub(r"(?m)^\s*[0-9]\.\s", " ", b) for b in bodies]
    titles = ["", *(t for x, t in TITLES if x == licence)]
    return [f"{title}\n\n{b}" if title else b for title in titles for b in bodies]


@lru_cache(2)
def known_texts(folder: Path = LICENCES) -> tuple[tuple[str, str], ...]:
    """(licence, text) of everything that is known: notices, identifiers and all forms of the full texts."""
    found = [*NOTICES, *((x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS.split())]
    for path in sorted(folder.glob("*.txt")):
        found += [(path.stem, form) for form in _forms(path.stem, path.read_text())]
    return tuple(dict.fromkeys(found))


def known_licences(spark: SparkSession, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, licence, size in canonical characters, first canonical word): one row for each known digest; of licences
    with equal text the first in order counts."""
    rows = spark.createDataFrame(known_texts() if texts is None else texts, "licence string, notice string")
    rows = rows.select("licence", F.explode(F.array(canonical(folded(without_holders(F.col("notice")))))).alias("words"))
    rows = rows.select("licence", digest(F.col("words")).alias("digest"), F.length("words").alias("size"), F.substring_index("words", " ", 1).alias("first"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.first("size").alias("size"), F.first("first").alias("first"))


#: Known texts up to this number are broadcast, and their first words given to the tasks.
BROADCAST_ROWS = 100_000


def license_scan(docs: DataFrame, known: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document with a known licence: doc_id, licence, scope and lines.

    scope is document if the whole text is the licence, else line; lines counts the lines that are. A document with
    several licences has a row for each. A text of nothing but copyright lines or punctuation has no licence, as have
    null and empty texts; texts of any length are read whole, and one that folds to more than the longest known licence
    is none. Repeated rows of one doc_id count together; rows with a null doc_id are reported under null.
    Columns other than doc_id and text are not read. An empty table gives no rows. The known digests are broadcast up
    to `broadcast_rows` rows and joined by shuffle beyond.

    Only parts that begin as a known licence does are folded: what else begins otherwise has another digest.
    """
    count, longest, firsts = known.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0)), F.collect_set("first")).first()
    known = known.select("digest", "licence")
    known = F.broadcast(known) if count <= broadcast_rows else known
    firsts = set(firsts)
    firsts |= {spelled.split()[0] for spelled, usual in SPELLINGS if usual.split()[0] in firsts}
    # A generator stands between the steps, so that the expression before it is evaluated once.
    texts = docs.filter("text IS NOT NULL").select("doc_id", F.explode(F.array(without_holders(F.col("text")))).alias("body"))
    begins = lambda part: F.lower(F.regexp_extract(part, WORD, 0)).isin(*sorted(firsts))
    part = lambda entire, text: F.struct(F.lit(entire).alias("entire"), text.alias("part"))
    whole = F.when(begins(F.col("body")), F.array(part(1, F.col("body")))).otherwise(F.array().cast("array<struct<entire:int,part:string>>"))
    lines = F.transform(F.filter(F.split("body", "\n"), begins), lambda line: part(0, line))
    parts = texts.select("doc_id", F.inline(F.concat(whole, lines)))
    words = parts.select("doc_id", "entire", F.explode(F.array(folded(F.col("part")))).alias("words"))
    # No text with more folded characters than this can come out as short as the longest known licence.
    words = words.filter((F.col("words") != "") & (F.length("words") <= int(longest / SHRINK) + 1))
    found = words.select("doc_id", "entire", digest(canonical(F.col("words"))).alias("digest")).join(known, "digest")
    found = found.groupBy("doc_id", "licence").agg(F.max("entire").alias("entire"), F.sum(1 - F.col("entire")).alias("lines"))
    return found.select("doc_id", "licence", F.when(F.col("entire") == 1, "document").otherwise("line").alias("scope"), "lines")


def _sql_canonical(text: str) -> str:
    out = f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelled, usual in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{spelled}\\b', '{usual}', 'g')"
    return out


def oracle_sql() -> str:
    """Every text and line is folded and looked up."""
    quote = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{a}', '{quote(b)}')" for a, b in known_texts())
    body = lambda text: f"regexp_replace({text}, '{COPYRIGHT}', chr(10), 'g')"
    return f"""
        WITH known AS (
            SELECT sha256({_sql_canonical(body('notice'))}) AS digest, min(licence) AS licence
            FROM (VALUES {rows}) AS v(licence, notice) GROUP BY 1),
        bodies AS (SELECT doc_id, {body('text')} AS body FROM documents WHERE text IS NOT NULL),
        parts AS (
            SELECT doc_id, {_sql_canonical('body')} AS words, 1 AS entire FROM bodies
            UNION ALL
            SELECT doc_id, {_sql_canonical('line')} AS words, 0 AS entire
            FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM bodies))
        SELECT doc_id, licence, CASE WHEN max(entire) = 1 THEN 'document' ELSE 'line' END AS scope,
               CAST(sum(1 - entire) AS BIGINT) AS lines
        FROM (SELECT doc_id, sha256(words) AS digest, entire FROM parts WHERE words <> '') JOIN known USING (digest)
        GROUP BY doc_id, licence"""
