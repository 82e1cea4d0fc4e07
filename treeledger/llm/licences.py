"""License scan by canonical digests, with DataFrame operations only.

A text is brought to a canonical form: lower case, lines that hold a copyright notice removed, everything
but letters and digits to single blanks, equivalent spellings made equal.  Its SHA-256 is joined with the
digests of known licences.  Both the entire text and each of its lines are looked up, so a document that
is a licence and a notice inside a document are found; a licence of several lines inside a longer text is
not, because the method compares entire texts.

Entire texts are looked up in a second, looser form too: without notices that name neither year nor sign
("Copyright The X Authors") and without "All rights reserved." lines, and with one name for the parties
that licences name in their terms.  ``text_digest`` is that of the first form.

The known licences are a table (licence, text): the notices below, the full texts of ``licence_texts`` (under
their usual titles, with and without what follows the terms), and any others given.  Their number is
checked before they are sent to all tasks; beyond ``broadcast_rows`` the join shuffles digests instead.

Defined cases: NULL and empty texts match nothing (the digest of NULL is NULL); neither does a line
without letters or digits.  Rows that repeat are answered each.  Copies of a known licence under two names report both.
"""

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BROADCAST_ROWS = 10_000

# Standard notices by SPDX name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]

# Spellings that mean the same, each with the one kept (parts of words, lower case).
SPELLINGS = [("licenc", "licens"), ("organis", "organiz"), ("favour", "favor"), ("programme", "program")]

# A line with a copyright notice: the word or sign, then anything (a year, a name).
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b[^\p{L}\n]*(?:\(c\)|©|[0-9])|\(c\)[^\p{L}\n]*[0-9]|©)[^\n]*$"

# Titles that stand above a text without one of its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"],
}

# What differs between copies that their publisher gave out.
ADDRESSES = [
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
]
ADDRESS = r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"
END_OF_TERMS = "END OF TERMS AND CONDITIONS"

# A line with a notice that names no year and no sign, but a holder or its placeholder; or that reserves all rights.
LOOSE_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:Copyright:?[ \t]+(?!(?i:notice|holder|owner|law|licen|interest|statement|disclaimer)\w*)"
    r"[\p{Lu}\[{<][^\n]*|(?i:all rights reserved)[^\p{L}\p{N}\n]*)$"
)

# Parties named in the terms, in the canonical form, each with the name kept.
PARTIES = [
    (r"neither the names? of .{1,200}? nor the names? of", "neither the name of the copyright holder nor the names of"),
    (r"is provided by .{1,200}? as is", "is provided by the copyright holders as is"),
    (r"in no event shall .{1,200}? be liable", "in no event shall the copyright holders be liable"),
]

# What a text holds whose looser form may differ.
LOOSE_HINT = r"(?i)copyright|all rights reserved|neither the name|is\s+provided\s+by|in\s+no\s+event"


def full_texts() -> list[tuple[str, str]]:
    """licence and text of every full licence, in the variants that are known."""
    found = []
    for file in resources.files(f"{__package__}.licence_texts").iterdir():
        if not file.name.endswith(".txt"):
            continue
        licence, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        bodies = {text, text.split(END_OF_TERMS)[0] + END_OF_TERMS} if END_OF_TERMS in text else {text}
        bodies |= {re.sub(ADDRESS, address, body) for body in bodies for address in ADDRESSES}
        bodies |= {body.replace("https://", "http://") for body in bodies}
        found += [(licence, f"{title}\n\n{body}") for body in sorted(bodies) for title in ["", *TITLES.get(licence, [])]]
    return sorted(found)


def canonical_lines(text: str | Column) -> Column:
    """The canonical form, in which lines are still apart (and blank lines may remain)."""
    column = F.col(text) if isinstance(text, str) else text
    column = F.regexp_replace(F.lower(column), COPYRIGHT_LINE, "")
    column = F.regexp_replace(column, r"[^\p{L}\p{N}\n]+", " ")
    for spelling, kept in SPELLINGS:
        column = F.replace(column, F.lit(spelling), F.lit(kept))
    return column


def _whole(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, r"[ \n]+", " "))


def _loose(text: str) -> Column:
    """The looser form of an entire text, NULL where it cannot differ from the canonical one."""
    whole = _whole(canonical_lines(F.regexp_replace(text, LOOSE_LINE, "")))
    for named, kept in PARTIES:
        whole = F.regexp_replace(whole, named, kept)
    return F.when(F.col(text).rlike(LOOSE_HINT), whole)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """licence, digest and length of the canonical text and of its looser form, distinct."""
    rows = spark.createDataFrame(NOTICES + full_texts(), "licence string, text string")
    if known is not None:
        rows = rows.unionByName(known.select("licence", "text"))
    forms = F.explode(F.array(_whole(canonical_lines("text")), _loose("text")))
    digests = rows.select("licence", forms.alias("text")).where("text <> ''")
    return digests.select("licence", F.sha2("text", 256).alias("digest"), F.length("text").alias("size")).distinct()


def scan_licences(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, licences (names in order), n_notices (matching lines), entire (whether the whole text is one),
    text_digest of every row of ``docs``."""
    digests = written(known_digests(docs.sparkSession, known))
    if digests.count() <= broadcast_rows:
        # A line of another length than every known text is none of them: it needs no digest.
        sizes = [row.size for row in digests.select("size").distinct().collect()]
        possible = lambda line: F.length(line).isin(sizes)
        digests = F.broadcast(digests)
    else:
        possible = lambda line: F.length(line) > 0
    docs = docs.select("doc_id", canonical_lines("text").alias("canonical"), F.sha2(_loose("text"), 256).alias("loose"))
    docs = docs.select("doc_id", "loose", _whole(F.col("canonical")).alias("whole"), F.split("canonical", "\n", -1).alias("lines"))
    trimmed = F.filter(F.transform("lines", lambda line: F.trim(line)), possible)
    lines = F.transform(trimmed, lambda line: F.sha2(line, 256))
    # One row per document from here on, with its digests; written, so that its number is fixed.
    units = docs.select("doc_id", F.sha2("whole", 256).alias("text_digest"), "loose", lines.alias("lines"))
    units = written(units.withColumn("row", F.monotonically_increasing_id()))
    forms = F.explode(F.array_distinct(F.array("text_digest", "loose")))
    entire = units.select("row", forms.alias("digest"), F.lit(1).alias("entire"))
    single = units.select("row", F.explode("lines").alias("digest"), F.lit(0).alias("entire"))
    hits = entire.unionByName(single).join(digests.select("licence", "digest"), "digest")
    found = hits.groupBy("row").agg(
        F.array_sort(F.collect_set("licence")).alias("licences"),
        F.sum(1 - F.col("entire")).alias("n_notices"),
        F.max("entire").alias("entire"),
    )
    joined = units.select("row", "doc_id", "text_digest").join(found, "row", "left")
    return joined.select(
        "doc_id",
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        (F.coalesce("entire", F.lit(0)) == 1).alias("entire"),
        "text_digest",
    )
