"""Licence recognition from sentences, in DataFrame functions only.

A text is normalised (lower case, only letters and digits, single blanks) and known licence sentences are sought in it.
A known sentence may begin wherever a sentence or a line begins, and end wherever one ends; line ends, with the comment
signs and white space around them, may stand between any two of its words. So it is found plain, re-wrapped, behind
``#``, ``//`` or ``*``, and next to lines that end without a full stop. Names of holders, and what a work calls itself, are
slots that any name fills. What a text holds is then a sequence of sentence identifiers. Other words between two known
sentences stand in it as ``UNKNOWN`` if what follows the first of them looks like a licence's sentence, else as ``OTHER``; numbers of a list and
copyright lines do not. Ordered rules, more specific ones first, each match a sequence of consecutive identifiers, so other words
break them; what a rule has matched is taken, so that no later rule uses it again. A rule that further clauses would make another
licence does not hold before ``UNKNOWN``. Identifiers that no rule takes are reported as unmatched, and as a partial licence if
only one licence has them.

Very long texts take time in line with their length. Sentences end at ``.``, ``!`` or ``?`` before white space, lines at line ends; ``:`` and ``;`` before a blank count as line ends. Edge cases: null counts as the empty
text; texts without a known sentence have empty strings and no licence. Rows are judged one by one: repeated rows get
equal results, other columns play no part, an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of licence sentences and the sentences, normalised.
SENTENCES = {
    "MIT_SHORT": ["released under the mit license", "licensed under the mit license", "distributed under the mit license"],
    "MIT_GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT_NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS_IS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "NO_LIABILITY": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "APACHE2_SHORT": ["licensed under the apache license version 2 0", "licensed under the apache license 2 0", "released under the apache license version 2 0"],
    "APACHE2_GRANT": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"],
    "APACHE2_COPY": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "APACHE2_AS_IS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "APACHE2_SEE": ["see the license for the specific language governing permissions and limitations under the license"],
    "GPL3_SHORT": ["licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "GPL2_SHORT": ["licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "GPL_FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2_FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "AGPL3_FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "LGPL21_FREE": [f"this {x} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version" for x in ("library", "program")],
    "LGPL3_FREE": [f"this {x} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version" for x in ("library", "program")],
    "GPL_NO_WARRANTY": [f"this {x} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose" for x in ("program", "library")],
    "GPL_SEE": ["see the gnu general public license for more details"],
    "AGPL_SEE": ["see the gnu affero general public license for more details"],
    "LGPL_SEE": ["see the gnu lesser general public license for more details"],
    "CC_BY4": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license", "licensed under the creative commons attribution 4 0 international license"],
    "CC_BY_SA4": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC_BY_ND4": ["licensed under cc by nd 4 0", "licensed under a creative commons attribution noderivatives 4 0 international license"],
    "CC_BY_NC4": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC_BY_NC_SA4": ["licensed under cc by nc sa 4 0", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC_BY_NC_ND4": ["licensed under cc by nc nd 4 0", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC0": ["dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"],
    "BSD_GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD_SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD_BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD_NAME": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD_AS_IS": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BSD_NO_LIABILITY": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "ISC_GRANT": [f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("or ", "")],
    "ISC_AS_IS": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "ISC_NO_LIABILITY": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "ZLIB_AS_IS": ["this software is provided as is without any express or implied warranty"],
    "ZLIB_NO_LIABILITY": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "ZLIB_GRANT": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "UNLICENSE_FREE": ["this is free and unencumbered software released into the public domain"],
    "UNLICENSE_GRANT": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "BSL_GRANT": ["distributed under the boost software license version 1 0"],
    "EPL2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "ARTISTIC2": ["this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"],
    "MPL2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "MPL2_COPY": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "RESERVED": ["all rights reserved"],
}
#: Licences that a tag line may name.
TAGS = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "EPL-2.0", "Artistic-2.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
SENTENCES |= {f"TAG_{tag}": [f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', tag.lower())}"] for tag in TAGS}
#: Ordered rules: (licence, identifiers in a row).
RULES = [
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "AS_IS", "NO_LIABILITY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "AS_IS"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("BSL-1.0", ["BSL_GRANT"]),
    ("Apache-2.0", ["APACHE2_GRANT", "APACHE2_COPY", "APACHE2_AS_IS", "APACHE2_SEE"]),
    ("Apache-2.0", ["APACHE2_GRANT", "APACHE2_COPY", "APACHE2_AS_IS"]),
    ("Apache-2.0", ["APACHE2_SHORT", "APACHE2_GRANT"]),
    ("Apache-2.0", ["APACHE2_GRANT"]),
    ("AGPL-3.0-or-later", ["AGPL3_FREE", "GPL_NO_WARRANTY", "AGPL_SEE"]),
    ("AGPL-3.0-or-later", ["AGPL3_FREE"]),
    ("LGPL-3.0-or-later", ["LGPL3_FREE", "GPL_NO_WARRANTY", "LGPL_SEE"]),
    ("LGPL-3.0-or-later", ["LGPL3_FREE"]),
    ("LGPL-2.1-or-later", ["LGPL21_FREE", "GPL_NO_WARRANTY", "LGPL_SEE"]),
    ("LGPL-2.1-or-later", ["LGPL21_FREE"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL_NO_WARRANTY", "GPL_SEE"]),
    ("GPL-3.0-or-later", ["GPL_FREE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL_NO_WARRANTY", "GPL_SEE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME", "BSD_AS_IS", "BSD_NO_LIABILITY"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS", "BSD_NO_LIABILITY"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("ISC", ["ISC_GRANT", "ISC_AS_IS", "ISC_NO_LIABILITY"]),
    ("ISC", ["ISC_GRANT"]),
    ("Zlib", ["ZLIB_AS_IS", "ZLIB_NO_LIABILITY", "ZLIB_GRANT"]),
    ("Zlib", ["ZLIB_GRANT"]),
    ("Unlicense", ["UNLICENSE_FREE", "UNLICENSE_GRANT"]),
    ("Unlicense", ["UNLICENSE_FREE"]),
    ("MPL-2.0", ["MPL2", "MPL2_COPY"]),
    ("MPL-2.0", ["MPL2"]),
    ("EPL-2.0", ["EPL2"]),
    ("Artistic-2.0", ["ARTISTIC2"]),
    ("MIT", ["MIT_SHORT"]),
    ("Apache-2.0", ["APACHE2_SHORT"]),
    ("GPL-3.0", ["GPL3_SHORT"]),
    ("GPL-2.0", ["GPL2_SHORT"]),
    ("CC-BY-NC-SA-4.0", ["CC_BY_NC_SA4"]),
    ("CC-BY-NC-ND-4.0", ["CC_BY_NC_ND4"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC4"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA4"]),
    ("CC-BY-ND-4.0", ["CC_BY_ND4"]),
    ("CC-BY-4.0", ["CC_BY4"]),
    ("CC0-1.0", ["CC0"]),
    *[(tag, [f"TAG_{tag}"]) for tag in TAGS],
    ("Proprietary", ["RESERVED"]),
]
#: Rules that do not hold where an unknown clause follows: with it the licence may be another one.
OPEN = [("MIT", ["MIT_GRANT", "MIT_NOTICE"]), ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME"]), ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"])]
UNKNOWN, OTHER_WORDS = "UNKNOWN", "OTHER"
#: Identifiers that one licence alone has, with that licence.
OWNED = {name: next(iter(of)) for name in SENTENCES if len(of := {licence for licence, sequence in RULES if name in sequence}) == 1}
#: Every known sentence holds one of these within a word; texts without any are not looked at further.
STEMS = ["licen", "permission", "warrant", "liab", "copyright", "redistribut", "domain", "reserved", "software", "mpl"]
#: Sentence ends and line ends (or what stands like them after a colon) become one character each, everything but letters and digits a blank.
STOP, LINE = r"[.!?]+[\x22\x27)\]]*[ \t\r\n\f]+", r"[\r\n]+|[:;][ \t]+"
OTHER = r"[^a-z0-9\x01\x02]+"
#: Words that begin comment lines of some languages.
LEADER = r"(^|[\x01\x02]) ?(?:dnl|rem) "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text in the form in which sentences are sought: every line, and every sentence of a line, stands in brackets, with a
#: blank between those that a line end parts and a line end between those that a sentence end parts.
BRACKETS = [(r" ?\x01[ \x01\x02]*", ")\n("), (r" ?\x02[ \x02]*", ") (")]


#: Slots, sought in bracketed texts: what any name or kind of work may fill, and the form that SENTENCES have. A blank stands
#: for a blank, a line end or (as after Inc.) a stop, NAME for up to 150 characters of a name, {} for what a group has found.
NAME = r"[a-z0-9 ()\n]{1,150}?"
WORKS = "file|files|project|work|software|code|source code|program|library|package|module|script|document|repository|product|tool"
SLOTS = [
    (r"licence", "license"),
    (rf"\((?:it|(?:this|the|our) (?:{WORKS})) (?:is|are) (?:also )?(licensed|released|distributed|dedicated) (under|to)", "({} {}"),
    (r"(licensed|released|distributed) (under) the terms of the", "{} {} the"),
    (r"\(neither the names? of NAME nor the names? of NAME may be used to", "(neither the name of the copyright holder nor the names of its contributors may be used to"),
    (r"\(this software is provided by NAME as is and any express", "(this software is provided by the copyright holders and contributors as is and any express"),
    (r"\(in no event shall NAME be liable for any claim", "(in no event shall the authors or copyright holders be liable for any claim"),
    (r"\(in no event shall NAME be liable for any direct", "(in no event shall the copyright holder or contributors be liable for any direct"),
    (r"\(in no event shall NAME be liable for any special", "(in no event shall the author be liable for any special"),
]
BLANK = r"(?: |\)[ \n]\()"
#: What may stand between sentences of a rule: numbers of a list, copyright lines.
MARKS = r"\((?:[ivx]{1,4}|[a-z0-9]{1,2}|(?:c|copyright) [^()]*)\)"
#: The first sentence of what follows, over its lines.
NEXT = r"^[ \n]*\(([^\n]*)"


def slots(group: str) -> list[tuple[str, str]]:
    """SLOTS as patterns and replacements, with the sign of a group in a replacement."""
    full = lambda what: BLANK.join(NAME if w == "NAME" else w for w in what.split(" "))
    return [(full(what), form.replace("{}", f"{group}1", 1).replace("{}", f"{group}2", 1)) for what, form in SLOTS]


def _pattern() -> str:
    """Finds known sentences in bracketed texts; line ends may stand between any two words. Longer ones are tried first."""
    every = sorted((s for known in SENTENCES.values() for s in known), key=lambda s: (-len(s), s))
    return r"\((?:" + "|".join(s.replace(" ", r"(?: |\) \()") for s in every) + r")\)"


def bracketed(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), STOP, "\x01"), LINE, "\x02")
    out = F.trim(F.regexp_replace(F.regexp_replace(F.translate(out, UPPER, LOWER), OTHER, " "), LEADER, "$1"))
    for what, mark in BRACKETS:
        out = F.regexp_replace(out, what, mark)
    out = F.concat(F.lit("("), out, F.lit(")"))
    for what, form in slots("$"):
        out = F.regexp_replace(out, what, form)
    return out


def between(gap: Column) -> Column:
    """What other words after a known sentence count as; null for none."""
    words = F.regexp_replace(gap, MARKS, "")
    known = F.regexp_extract(words, NEXT, 1).rlike("|".join(STEMS))
    return F.when(words.rlike("[a-z]{3}"), F.when(known, UNKNOWN).otherwise(OTHER_WORDS))


def identifiers(body: Column) -> Column:
    """Identifiers of a bracketed text's known sentences in order, and what stands behind each of them where words do."""
    known = {sentence: name for name, every in SENTENCES.items() for sentence in every}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    plain = lambda s: F.translate(F.replace(s, F.lit(") ("), F.lit(" ")), "()", "")
    found = F.transform(F.regexp_extract_all(body, F.lit(_pattern()), F.lit(0)), lambda s: F.element_at(table, plain(s)))
    gaps = F.slice(F.split(body, _pattern(), -1), 2, 1_000_000_000)
    both = F.flatten(F.transform(F.arrays_zip(found.alias("id"), gaps.alias("gap")), lambda p: F.array(p["id"], between(p["gap"]))))
    return F.filter(both, lambda x: x.isNotNull())


def matched(ids: Column) -> Column:
    """Identifiers with each rule's sequences replaced, in rule order, by ``=licence``, or by ``~licence`` where a rule may not
    hold; elements stand between ``|``."""
    out = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    for sequence, form in steps():
        out = F.replace(out, F.lit(sequence), F.lit(form))
    return out


def steps() -> list[tuple[str, str]]:
    """What to replace in turn, and by what."""
    out = []
    for licence, sequence in RULES:
        plain = "".join(f"|{s}|" for s in sequence)
        if (licence, sequence) in OPEN:
            out.append((f"{plain}|{UNKNOWN}|", f"|~{licence}||{UNKNOWN}|"))
        out.append((plain, f"|={licence}|"))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: key; sentence_ids, licenses (in order of appearance), partial (licences of which only
    some sentences are there, or with an unknown clause) and unmatched, each joined by commas; n_unknown, the number of
    places behind known sentences where an unknown one stands; and license: the first of licenses, null without any."""
    likely = F.coalesce(F.col(text), F.lit("")).rlike("(?i)" + "|".join(STEMS))
    slim = docs.select(F.col(key).alias("_key"), F.when(likely, bracketed(F.col(text))).otherwise("").alias("_body"))
    slim = slim.select("_key", identifiers(F.col("_body")).alias("_all"))
    slim = slim.withColumn("_parts", F.filter(F.split(matched(F.col("_all")), r"\|+"), lambda x: x != ""))
    gaps = [UNKNOWN, OTHER_WORDS]
    owned = F.create_map(*[F.lit(x) for pair in OWNED.items() for x in pair])
    licences = F.transform(F.filter("_parts", lambda x: x.startswith("=")), lambda x: F.substring(x, 2, 1000))
    rest = F.filter("_parts", lambda x: ~x.startswith("=") & ~x.startswith("~") & ~x.isin(gaps))
    partial = F.transform("_parts", lambda x: F.when(x.startswith("~"), F.substring(x, 2, 1000)).otherwise(F.element_at(owned, x)))
    partial = F.array_sort(F.array_distinct(F.filter(partial, lambda x: x.isNotNull())))
    return slim.select(
        F.col("_key").alias(key),
        F.array_join(F.filter("_all", lambda x: ~x.isin(gaps)), ",").alias("sentence_ids"),
        F.array_join(licences, ",").alias("licenses"),
        F.array_join(partial, ",").alias("partial"),
        F.array_join(rest, ",").alias("unmatched"),
        F.size(F.filter("_all", lambda x: x == UNKNOWN)).cast("long").alias("n_unknown"),
        F.get(licences, F.lit(0)).alias("license"),
    )


def oracle() -> str:
    """The same result in DuckDB SQL: the gaps are found by position, not by splitting."""
    pairs = lambda table: ", ".join(f"'{k}': '{v}'" for k, v in table)
    known = pairs((s, n) for n, every in SENTENCES.items() for s in every)
    rules = "'|' || array_to_string(ids, '||') || '|'"
    for sequence, form in steps():
        rules = f"replace({rules}, '{sequence}', '{form}')"
    text = f"regexp_replace(regexp_replace(coalesce(text, ''), '{STOP}', chr(1), 'g'), '{LINE}', chr(2), 'g')"
    text = f"trim(regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{OTHER}', ' ', 'g'), '{LEADER}', '\\1', 'g'))"
    for (what, _), mark in zip(BRACKETS, ("')' || chr(10) || '('", "') ('"), strict=True):
        text = f"regexp_replace({text}, '{what}', {mark}, 'g')"
    text = f"'(' || {text} || ')'"
    for what, form in slots("\\"):
        text = f"regexp_replace({text}, '{what}', '{form}', 'g')"
    return f"""
WITH known AS (SELECT MAP {{{known}}} AS m, MAP {{{pairs(OWNED.items())}}} AS owned),
t AS (SELECT doc_id, {text} AS t FROM documents),
-- A sign before each known sentence and one after it: what stands from one to the next is a gap.
s AS (SELECT doc_id, string_split(regexp_replace(t, '{_pattern()}', chr(3) || '\\0' || chr(4), 'g'), chr(3)) AS pieces FROM t),
p AS (SELECT doc_id, list_transform(pieces[2:], lambda x: string_split(x, chr(4))) AS pieces FROM s),
g AS (SELECT doc_id, list_transform(pieces, lambda x: [m[translate(replace(x[1], ') (', ' '), '()', '')], regexp_replace(x[2], '{MARKS}', '', 'g')]) AS pairs FROM p, known),
a AS (SELECT doc_id, list_filter(flatten(list_transform(pairs, lambda x: [x[1], CASE WHEN NOT regexp_matches(x[2], '[a-z]{{3}}') THEN NULL
  WHEN regexp_matches(regexp_extract(x[2], '{NEXT}', 1), '{"|".join(STEMS)}') THEN '{UNKNOWN}' ELSE '{OTHER_WORDS}' END])), lambda x: x IS NOT NULL) AS ids FROM g),
b AS (SELECT doc_id, ids, list_filter(string_split_regex({rules}, '\\|+'), lambda x: x <> '') AS parts FROM a),
c AS (SELECT doc_id, ids, list_transform(list_filter(parts, lambda x: starts_with(x, '=')), lambda x: x[2:]) AS found,
  list_filter(parts, lambda x: NOT starts_with(x, '=') AND NOT starts_with(x, '~') AND x NOT IN ('{UNKNOWN}', '{OTHER_WORDS}')) AS rest,
  list_filter(list_transform(parts, lambda x: CASE WHEN starts_with(x, '~') THEN x[2:] ELSE owned[x] END), lambda x: x IS NOT NULL) AS part FROM b, known)
SELECT doc_id, array_to_string(list_filter(ids, lambda x: x NOT IN ('{UNKNOWN}', '{OTHER_WORDS}')), ',') AS sentence_ids, array_to_string(found, ',') AS licenses,
  array_to_string(list_sort(list_distinct(part)), ',') AS partial, array_to_string(rest, ',') AS unmatched,
  len(list_filter(ids, lambda x: x = '{UNKNOWN}')) AS n_unknown, found[1] AS license FROM c
"""
