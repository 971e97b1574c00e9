"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is cut into pieces, at sentence ends and at line ends, and each piece is
normalised to lower-case words without comment and list marks. A known licence
sentence is found where its words are those of one piece or of several pieces in
a row, so it may be wrapped over lines; one that lies within another one is
dropped. What remains is a sequence of identifiers with their places, which are
numbers of pieces. A rule is an ordered sequence of identifiers; it matches where
its identifiers follow one another with at most MAX_GAP unknown sentences between
two of them. An unknown sentence goes on to its stop or to a blank line; pieces
without words and lone list marks are none. A match that lies within another one
is dropped. All of it is a few expressions per row: nothing is shuffled, and a
text of any length or a source of any size is handled where it lies. Sentences
and rules are literal arrays and maps, so the plan does not grow with their number:
a run of pieces is walked along the known sentences' beginnings, and each found
identifier is compared with the rules that begin with it.

Defined results: a null or empty text has no match and comes back with counts of
0; repeated rows come back as often; of equal spans the first rule in order
wins; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import whole

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache-line": "licensed under the apache license version 2 0",
    "apache-grant": 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license',
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-line": "licensed under cc by 4 0",
    "cc-by-sa-line": "licensed under cc by sa 4 0",
    "cc0-line": "released under cc0 1 0 universal",
    "unlicense-line": "this is free and unencumbered software released into the public domain",
}
# Rules in order; the first of equal spans wins.
RULES = (
    ("apache-2.0-notice", "Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is", "apache-see")),
    ("apache-2.0-notice-split", "Apache-2.0", ("apache-line", "apache-use", "apache-copy", "apache-as-is", "apache-see")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("mit-text-short", "MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("gpl-3.0-or-later-notice", "GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-details")),
    ("gpl-2.0-or-later-notice", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("apache-2.0-line", "Apache-2.0", ("apache-line",)),
    ("mit-line", "MIT", ("mit-line",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("gpl-3.0-line", "GPL-3.0-only", ("gpl3-line",)),
    ("gpl-3.0-grant", "GPL-3.0-or-later", ("gpl3-free",)),
    ("gpl-2.0-grant", "GPL-2.0-or-later", ("gpl2-free",)),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("cc-by-4.0-line", "CC-BY-4.0", ("cc-by-line",)),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("cc0-1.0-line", "CC0-1.0", ("cc0-line",)),
    ("unlicense-line", "Unlicense", ("unlicense-line",)),
)
# Public licences by SPDX identifier, with the words by which a line names them.
NAMES = {
    "0BSD": "zero clause bsd license",
    "AFL-3.0": "academic free license 3 0",
    "AGPL-3.0-only": "gnu affero general public license 3",
    "APSL-2.0": "apple public source license 2 0",
    "Apache-1.1": "apache license 1 1",
    "Apache-2.0": "apache license 2 0",
    "Artistic-1.0": "artistic license 1 0",
    "Artistic-2.0": "artistic license 2 0",
    "BSD-1-Clause": "bsd 1 clause license",
    "BSD-2-Clause": "bsd 2 clause license",
    "BSD-3-Clause": "bsd 3 clause license",
    "BSD-4-Clause": "bsd 4 clause license",
    "BSL-1.0": "boost software license 1 0",
    "BUSL-1.1": "business source license 1 1",
    "Beerware": "beerware license",
    "BlueOak-1.0.0": "blue oak model license 1 0 0",
    "CAL-1.0": "cryptographic autonomy license 1 0",
    "CC-BY-4.0": "creative commons attribution license 4 0",
    "CC-BY-SA-4.0": "creative commons attribution sharealike license 4 0",
    "CC-BY-NC-4.0": "creative commons attribution noncommercial license 4 0",
    "CDDL-1.0": "common development and distribution license 1 0",
    "CDDL-1.1": "common development and distribution license 1 1",
    "CPAL-1.0": "common public attribution license 1 0",
    "CPL-1.0": "common public license 1 0",
    "ECL-2.0": "educational community license 2 0",
    "EFL-2.0": "eiffel forum license 2 0",
    "EPL-1.0": "eclipse public license 1 0",
    "EPL-2.0": "eclipse public license 2 0",
    "EUPL-1.1": "european union public license 1 1",
    "EUPL-1.2": "european union public license 1 2",
    "Elastic-2.0": "elastic license 2 0",
    "FTL": "freetype project license",
    "GFDL-1.3-only": "gnu free documentation license 1 3",
    "GPL-2.0-only": "gnu general public license 2",
    "GPL-3.0-only": "gnu general public license 3",
    "ICU": "icu license",
    "IPL-1.0": "ibm public license 1 0",
    "ISC": "isc license",
    "LGPL-2.1-only": "gnu lesser general public license 2 1",
    "LGPL-3.0-only": "gnu lesser general public license 3",
    "LPPL-1.3c": "latex project public license 1 3c",
    "MIT": "mit license",
    "MIT-0": "mit no attribution license",
    "MPL-1.1": "mozilla public license 1 1",
    "MPL-2.0": "mozilla public license 2 0",
    "MS-PL": "microsoft public license",
    "MS-RL": "microsoft reciprocal license",
    "MulanPSL-2.0": "mulan permissive software license 2",
    "NCSA": "university of illinois ncsa open source license",
    "NPL-1.1": "netscape public license 1 1",
    "ODbL-1.0": "open database license 1 0",
    "OFL-1.1": "sil open font license 1 1",
    "OSL-3.0": "open software license 3 0",
    "OpenSSL": "openssl license",
    "PHP-3.01": "php license 3 01",
    "PSF-2.0": "python software foundation license 2",
    "PostgreSQL": "postgresql license",
    "QPL-1.0": "q public license 1 0",
    "Ruby": "ruby license",
    "SSPL-1.0": "server side public license 1",
    "Sleepycat": "sleepycat license",
    "UPL-1.0": "universal permissive license 1 0",
    "Unlicense": "unlicense license",
    "Vim": "vim license",
    "W3C": "w3c software notice and license",
    "WTFPL": "do what the fuck you want to public license",
    "X11": "x11 license",
    "ZPL-2.1": "zope public license 2 1",
    "Zend-2.0": "zend license 2 0",
    "Zlib": "zlib license",
}
# How a line says it.
PHRASES = (
    "licensed under the {}", "released under the {}", "distributed under the {}", "this project is licensed under the {}",
    "this software is licensed under the {}", "this work is licensed under the {}",
)


def spoken(name: str) -> list[str]:
    """A licence's name with its version as a bare number, after the word, and after a v."""
    words = re.fullmatch(r"(.*?license)( [0-9].*)?", name)
    version = words[2] or ""
    return [name] if not version else [name, f"{words[1]} version{version}", f"{words[1]} v{version[1:]}"]


def lines_of(names: Mapping[str, str], phrases: tuple = PHRASES, but: frozenset = frozenset()) -> dict[str, tuple[str, ...]]:
    """Sentences, but those of ``but``, in which a line names a licence, by identifier ``line-<licence>``."""
    out = {}
    for licence, name in names.items():
        said = [p.format(form) for p in phrases for form in spoken(name)]
        said.append("spdx license identifier " + " ".join(re.findall("[a-z0-9]+", licence.lower())))
        out[f"line-{licence}"] = tuple(s for s in said if s not in but)
    return out


LINES = lines_of(NAMES, but=frozenset(SENTENCES.values()))
#: All sentences by identifier: one, or several that say the same.
KNOWN: dict[str, str | tuple[str, ...]] = SENTENCES | LINES
ALL_RULES = (*RULES, *((f"{licence.lower()}-named", licence, (f"line-{licence}",)) for licence in NAMES))
#: Unknown sentences allowed between two sentences of a rule.
MAX_GAP = 1
#: A piece ends at . ! ? or ; before white space, and at a line's end.
BREAK = r"([.!?;])[ \t]+"
#: A piece with which a sentence ends.
STOP = r"""[.!?;]["')\]*/]*\s*$"""
_MARK = "(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})"
#: Word-like comment and list marks before a sentence, and a list mark that follows a colon at its end.
MARKS = rf"^[^a-z0-9]*(?:{_MARK}[.)][ \t]+|(?:dnl|rem)(?![a-z0-9]))|(?<=:)[ \t]+\(?{_MARK}[.)]\s*$"


def said(known: Mapping[str, str | tuple[str, ...]]) -> dict[str, str]:
    """The identifier of each known sentence."""
    return {s: name for name, some in known.items() for s in ((some,) if isinstance(some, str) else some)}


def anchors(known: Mapping[str, str | tuple[str, ...]]) -> list[str]:
    """A few words of which every known sentence has one; other sentences need no look-up."""
    left, out = [set(s.split()) for s in said(known)], []
    while left:
        words = sorted({w for s in left for w in s if len(w) > 4} or {w for s in left for w in s})
        best = max(words, key=lambda w: sum(w in s for s in left))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), BREAK, "$1\n"), "\n")


def normalise(piece: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(piece, MARKS, ""), "[^a-z0-9]+", " "))


def pieces(text: Column, known: Mapping = KNOWN) -> Column:
    """Pieces of the text that may hold a known sentence, else none: array of (at, s, stop)."""
    hint = "|".join(anchors(known))
    each = F.transform(sentences(text), lambda s, i: F.struct(i.alias("at"), normalise(s).alias("s"), s.rlike(STOP).alias("stop")))
    return F.when(F.lower(text).rlike(hint), each)


def worded(cut: Column) -> Column:
    """Pieces with words: array of (at, s, mark, new), ``new`` where a sentence starts."""

    def of(x: Column, i: Column) -> Column:
        before = F.get(cut, i - 1)
        new = (i == 0) | before["stop"] | (before["s"] == "") | before["s"].rlike(f"^{_MARK}$")
        return F.struct(x["at"].alias("at"), x["s"].alias("s"), x["s"].rlike(f"^{_MARK}$").alias("mark"), new.alias("new"))

    return F.filter(F.transform(cut, of), lambda x: x["s"] != "")


def beginnings(known: Mapping) -> list[str]:
    """The first words of every known sentence, for any number of words."""
    return sorted({" ".join(words[:n]) for words in map(str.split, said(known)) for n in range(1, len(words) + 1)})


def runs(lines: Column, known: Mapping = KNOWN) -> Column:
    """Known sentences in order, the longest from each piece: array of (j, end, id), places in ``lines``."""
    table = F.str_to_map(F.lit("\n".join(f"{s}={name}" for s, name in said(known).items())), F.lit("\n"), F.lit("="))
    starts = F.split(F.lit("\n".join(beginnings(known))), "\n")
    longest = max(len(s.split()) for s in said(known))
    first_word = "^(?:" + "|".join(sorted({s.split()[0] for s in said(known)})) + ")(?: |$)"

    def step(state: Column, y: Column) -> Column:
        """One piece more: not alive once no known sentence begins so."""
        said_so_far = F.when(state["n"] == 0, y["s"]).otherwise(F.concat_ws(" ", state["acc"], y["s"]))
        ahead = F.when(state["alive"] & F.array_contains(starts, said_so_far), said_so_far)
        return F.struct(
            F.coalesce(ahead, F.lit("")).alias("acc"), (state["n"] + 1).alias("n"), ahead.isNotNull().alias("alive"),
            F.when(ahead.isNotNull(), F.coalesce(F.when(F.map_contains_key(table, ahead), state["n"] + 1), state["len"])).otherwise(state["len"]).alias("len"),
        )

    def run(x: Column) -> Column:  # a sentence of n words has n pieces at most
        none = F.struct(F.lit("").alias("acc"), F.lit(0).alias("n"), F.lit(True).alias("alive"), F.lit(0).alias("len"))
        walked = F.aggregate(F.slice(lines, x["j"] + 1, F.lit(longest)), none, step, lambda state: state["len"])
        return F.struct(x["j"].alias("j"), (x["j"] + walked - 1).alias("end"))

    numbered = F.transform(lines, lambda x, j: F.struct(j.alias("j"), x["s"].alias("s")))
    begun = F.filter(numbered, lambda x: x["s"].rlike(first_word) & F.array_contains(starts, x["s"]))
    found = F.filter(F.transform(begun, run), lambda x: x["end"] >= x["j"])

    def named(x: Column) -> Column:
        words = F.array_join(F.transform(F.slice(lines, x["j"] + 1, x["end"] - x["j"] + 1), lambda y: y["s"]), " ")
        return F.struct(x["j"].alias("j"), x["end"].alias("end"), F.try_element_at(table, words).alias("id"))

    return F.transform(found, named)


def alone(found: Column, known: Mapping = KNOWN) -> Column:
    """Runs that do not lie within an earlier one."""
    longest = max(len(s.split()) for s in said(known))

    def held(x: Column, i: Column) -> Column:
        near = F.slice(found, F.greatest(i + 1 - longest, F.lit(1)), F.least(i, F.lit(longest)))
        return F.exists(near, lambda y: (y["end"] >= x["end"]) & (y["j"] < x["j"]))

    return F.filter(found, lambda x, i: ~held(x, i))


def placed(found: Column, lines: Column) -> Column:
    """Runs as (at, last, gap, id): first and last piece, and the unknown sentences since the run before."""

    def of(x: Column, i: Column) -> Column:
        since = F.coalesce(F.get(found, i - 1)["end"], F.lit(-1)) + 1
        between = F.slice(lines, since + 1, F.greatest(x["j"] - since, F.lit(0)))
        unknown = F.filter(between, lambda y, k: ~y["mark"] & (y["new"] | (k == 0)))
        return F.struct(
            F.get(lines, x["j"])["at"].alias("at"), F.get(lines, x["end"])["at"].alias("last"),
            F.size(unknown).alias("gap"), x["id"].alias("id"),
        )

    return F.transform(found, of)


def matches(ids: Column, rules: tuple = ALL_RULES, max_gap: int = MAX_GAP) -> Column:
    """Matches of the rules in an array of (at, last, gap, id): array of (first, last, order, rule, licence)."""
    table = F.array(*[
        F.struct(F.lit(k).alias("order"), F.lit(name).alias("rule"), F.lit(licence).alias("licence"), F.array(*map(F.lit, seq)).alias("seq"))
        for k, (name, licence, seq) in enumerate(rules)
    ])

    def of(x: Column, i: Column) -> Column:
        def follows(s: Column, k: Column) -> Column:
            here = F.get(ids, i + k)
            return F.coalesce((here["id"] == s) & ((k == 0) | (here["gap"] <= max_gap)), F.lit(False))

        begun = F.filter(table, lambda r: F.get(r["seq"], F.lit(0)) == x["id"])
        held = F.filter(begun, lambda r: F.forall(F.transform(r["seq"], follows), lambda b: b))
        return F.transform(held, lambda r: F.struct(
            x["at"].alias("first"), F.get(ids, i + F.size(r["seq"]) - 1)["last"].alias("last"),
            r["order"].alias("order"), r["rule"].alias("rule"), r["licence"].alias("licence"),
        ))

    return F.array_sort(F.flatten(F.transform(ids, of)))


def outermost(found: Column, rules: tuple = ALL_RULES) -> Column:
    """Matches that do not lie within another; of equal spans the first rule's.

    Matches are in order, and a rule spans a bounded number of known sentences, so
    only a bounded number of neighbours can hold a match.
    """
    longest = max(len(seq) for _, _, seq in rules)
    firsts = [seq[0] for _, _, seq in rules]
    reach = longest * max(firsts.count(f) for f in firsts)

    def within(x: Column, y: Column) -> Column:
        inside = (y["first"] <= x["first"]) & (y["last"] >= x["last"])
        larger = (y["last"] - y["first"]) > (x["last"] - x["first"])
        return inside & (larger | (y["order"] < x["order"]))

    def held(x: Column, i: Column) -> Column:
        near = F.slice(found, F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach + 1))
        return F.exists(near, lambda y: within(x, y))

    return F.filter(found, lambda x, i: ~held(x, i))


def scan(docs: DataFrame, text: str = "text", known: Mapping = KNOWN, rules: tuple = ALL_RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """Docs with ``license_ids`` (array of at, last, gap, id) and ``license_matches`` added."""
    has = docs.withColumn("license_ids", pieces(whole(text), known))
    for step in (worded, lambda c: F.struct(c.alias("lines"), runs(c, known).alias("found"))):
        has = has.withColumn("license_ids", F.when(F.size("license_ids") > 0, step(F.col("license_ids"))))
    lines, found = F.col("license_ids.lines"), F.col("license_ids.found")
    has = has.withColumn("license_ids", F.when(F.size(found) > 0, F.struct(lines.alias("lines"), alone(found, known).alias("found"))))
    empty = F.array().cast("array<struct<at:int,last:int,gap:int,id:string>>")
    has = has.withColumn("license_ids", F.coalesce(F.when(F.size(found) > 0, placed(found, lines)), empty))
    some = F.when(F.size("license_ids") > 0, matches(F.col("license_ids"), rules, max_gap))
    none = F.array().cast("array<struct<first:int,last:int,order:int,rule:string,licence:string>>")
    return has.withColumn("license_matches", F.coalesce(some, none)).withColumn(
        "license_matches", outermost(F.col("license_matches"), rules)
    )


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    spans = F.transform("license_matches", lambda m: F.concat_ws(":", m["rule"], m["first"].cast("string"), m["last"].cast("string")))
    return found.select(
        "doc_id",
        F.size("license_ids").cast("bigint").alias("n_known_sentences"),
        F.size("license_matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("license_matches", lambda m: m["licence"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("matches"),
    )


def sql() -> str:
    """The same scan in SQL, over the documents table."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(s)})" for s, n in said(KNOWN).items())
    steps = ", ".join(
        f"({k}, {quoted(name)}, {quoted(licence)}, {len(seq)}, [{', '.join(map(quoted, seq))}])"
        for k, (name, licence, seq) in enumerate(ALL_RULES)
    )
    # The list marks of MARKS without looking around, which this dialect cannot.
    listed = rf"^[^a-z0-9]*{_MARK}[.)][ \t]+"
    comment, colon = "^[^a-z0-9]*(?:dnl|rem)([^a-z0-9]|$)", rf":[ \t]+\(?{_MARK}[.)][ \t\x0b\f\r]*$"
    stop = STOP.replace("'", "''").replace(r"\s", r"[ \t\x0b\f\r]")
    return rf"""
WITH RECURSIVE known(id, s) AS (VALUES {known}),
rules(ord, rule, licence, n, seq) AS (VALUES {steps}),
starts AS (
    SELECT DISTINCT array_to_string(list_slice(w, 1, k), ' ') AS p
    FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT string_split(s, ' ') AS w FROM known))
),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT r, string_split(regexp_replace(lower(text), '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d
), part AS (
    SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS place FROM cut
), bare AS (
    SELECT r, place, part, CASE WHEN regexp_matches(part, '{listed}') THEN regexp_replace(part, '{listed}', '')
        ELSE regexp_replace(part, '{comment}', ' ') END AS body FROM part
), piece AS (
    SELECT r, place, regexp_matches(part, '{stop}') AS stop,
           trim(regexp_replace(regexp_replace(body, '{colon}', ':'), '[^a-z0-9]+', ' ', 'g')) AS s FROM bare
), seen AS (
    SELECT *, regexp_matches(s, '^{_MARK}$') AS mark, lag(stop) OVER w AS stopped, lag(s) OVER w AS before
    FROM piece WINDOW w AS (PARTITION BY r ORDER BY place)
), line AS (
    SELECT r, place, s, mark, coalesce(stopped OR before = '' OR regexp_matches(before, '^{_MARK}$'), true) AS new,
           row_number() OVER (PARTITION BY r ORDER BY place) - 1 AS j
    FROM seen WHERE s <> ''
), walk(r, j, k, acc) AS (
    SELECT r, j, j, s FROM line WHERE s IN (SELECT p FROM starts)
    UNION ALL
    SELECT w.r, w.j, l.j, w.acc || ' ' || l.s FROM walk w JOIN line l ON l.r = w.r AND l.j = w.k + 1
    WHERE w.acc || ' ' || l.s IN (SELECT p FROM starts)
), longest AS (
    SELECT w.r, w.j, max(w.k) AS k, arg_max(n.id, w.k) AS id FROM walk w JOIN known n ON n.s = w.acc GROUP BY w.r, w.j
), apart AS (
    SELECT * FROM longest QUALIFY coalesce(max(k) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < k
), spaced AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY j) AS pos, coalesce(lag(k) OVER (PARTITION BY r ORDER BY j), -1) AS prev FROM apart
), gaps AS (
    SELECT x.r, x.pos, count(*) FILTER (NOT l.mark AND (l.new OR l.j = x.prev + 1)) AS gap
    FROM spaced x JOIN line l ON l.r = x.r AND l.j > x.prev AND l.j < x.j GROUP BY x.r, x.pos
), i AS (
    SELECT x.r, x.pos, x.id, a.place, b.place AS last, coalesce(g.gap, 0) AS gap
    FROM spaced x JOIN line a ON a.r = x.r AND a.j = x.j JOIN line b ON b.r = x.r AND b.j = x.k
    LEFT JOIN gaps g ON g.r = x.r AND g.pos = x.pos
), m AS (
    SELECT a.r, ru.ord, ru.rule, ru.licence, a.place AS first, max(b.last) AS last
    FROM i a JOIN rules ru ON ru.seq[1] = a.id
    JOIN i b ON b.r = a.r AND b.pos >= a.pos AND b.pos < a.pos + ru.n
    GROUP BY a.r, a.pos, a.place, ru.ord, ru.rule, ru.licence, ru.n
    HAVING count(*) = max(ru.n) AND bool_and(b.id = ru.seq[b.pos - a.pos + 1]) AND bool_and(b.pos = a.pos OR b.gap <= {MAX_GAP})
), o AS (
    SELECT x.* FROM m x WHERE NOT EXISTS (
        SELECT 1 FROM m y WHERE y.r = x.r AND y.first <= x.first AND y.last >= x.last
          AND (y.last - y.first > x.last - x.first OR y.ord < x.ord))
), per AS (
    SELECT r, count(*) AS n_matches,
           array_to_string(list_sort(list_distinct(list(licence))), ',') AS licenses,
           string_agg(rule || ':' || first || ':' || last, ',' ORDER BY first, last, ord) AS matches
    FROM o GROUP BY r
), ids AS (SELECT r, count(*) AS n FROM i GROUP BY r)
SELECT d.doc_id, coalesce(ids.n, 0) AS n_known_sentences, coalesce(per.n_matches, 0) AS n_matches,
       coalesce(per.licenses, '') AS licenses, coalesce(per.matches, '') AS matches
FROM d LEFT JOIN ids ON ids.r = d.r LEFT JOIN per ON per.r = d.r
"""
