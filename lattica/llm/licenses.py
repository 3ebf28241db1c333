"""License scan by sentence rules.

Texts are split into sentences, sentences are normalised and mapped to identifiers of known license sentences, and the
sequence of identifiers is matched against ordered license rules. A sentence ends at an empty line and at . ! ? ; : before
white space; a single line break is a space, so wrapped texts read like others. The sentences of rules go through the
same splitter, so a rule's sentence that holds such a sign is two sentences there as well. An SPDX tag is a sentence for
each of its names, and a grant of two licenses is two grants.

A sentence has the identifier of the longest known sentence of a license's text that stands in it, by whole words (known
sentences of fewer than ``WHOLE`` words must be all of it); else,
of the first grant in it ("under the" with a license's name); else, that of a title or tag, which must be all of it. A
sentence that denies, or speaks of what might be, grants nothing. A rule holds where its sentences follow one another in
order with at most ``GAP`` other sentences between neighbours. Identifiers are single code points of a private area, so
that a document is one short string and a rule one regular expression over it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, WHOLE = 2, 3
FIRST = 0xE000
UNKNOWN = "."

# License identifiers and the names by which licenses are granted.
NAMES: list[tuple[str, list[str]]] = [
    ("MIT", ["MIT License", "MIT", "Expat License", "MIT/X11 License", "X11 License"]),
    ("MIT-0", ["MIT No Attribution License", "MIT-0", "MIT-0 License"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, Version 2", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "Apache Software License 2.0", "Apache Software License, Version 2.0", "Apache 2 License"]),
    ("Apache-1.1", ["Apache License, Version 1.1", "Apache Software License, Version 1.1", "Apache-1.1"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPL v2", "GPLv2", "GPL-2.0", "GPL 2.0"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPL v3", "GPLv3", "GPL-3.0", "GPL 3.0"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1", "LGPL 2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3.0", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "GNU LGPL v3", "LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL 3.0"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "GNU Affero General Public License version 3.0", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL 3.0"]),
    ("GFDL-1.3", ["GNU Free Documentation License, Version 1.3", "GFDL 1.3", "GFDL-1.3"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"]),
    ("BSD-4-Clause", ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD-4-Clause"]),
    ("0BSD", ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License", "0BSD"]),
    ("ISC", ["ISC License", "ISC"]),
    ("MPL-1.1", ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1", "MPL-1.1"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0", "MPLv2"]),
    ("EPL-1.0", ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0", "EPL-1.0"]),
    ("EPL-2.0", ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL-2.0"]),
    ("EUPL-1.2", ["European Union Public License, Version 1.2", "European Union Public License 1.2", "EUPL 1.2", "EUPL-1.2"]),
    ("CDDL-1.0", ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0", "CDDL 1.0", "CDDL-1.0"]),
    ("CPL-1.0", ["Common Public License, Version 1.0", "Common Public License 1.0", "CPL-1.0"]),
    ("Zlib", ["zlib License", "zlib/libpng License", "zlib"]),
    ("libpng", ["libpng License"]),
    ("Unlicense", ["Unlicense"]),
    ("WTFPL", ["WTFPL", "Do What The Fuck You Want To Public License"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"]),
    ("Artistic-1.0", ["Artistic License 1.0", "Artistic-1.0"]),
    ("Artistic-2.0", ["Artistic License 2.0", "Artistic License, Version 2.0", "Artistic-2.0"]),
    ("OFL-1.1", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL OFL 1.1", "OFL 1.1", "OFL-1.1"]),
    ("PostgreSQL", ["PostgreSQL License"]),
    ("Python-2.0", ["Python Software Foundation License", "PSF License", "Python-2.0"]),
    ("Ruby", ["Ruby License"]),
    ("PHP-3.01", ["PHP License, version 3.01", "PHP License 3.01", "PHP-3.01"]),
    ("MS-PL", ["Microsoft Public License", "MS-PL"]),
    ("MS-RL", ["Microsoft Reciprocal License", "MS-RL"]),
    ("NCSA", ["University of Illinois/NCSA Open Source License", "NCSA Open Source License", "NCSA"]),
    ("AFL-3.0", ["Academic Free License, version 3.0", "Academic Free License 3.0", "AFL-3.0"]),
    ("OSL-3.0", ["Open Software License, version 3.0", "Open Software License 3.0", "OSL-3.0"]),
    ("ECL-2.0", ["Educational Community License, Version 2.0", "Educational Community License 2.0", "ECL-2.0"]),
    ("UPL-1.0", ["Universal Permissive License, Version 1.0", "Universal Permissive License 1.0", "UPL-1.0"]),
    ("BlueOak-1.0.0", ["Blue Oak Model License 1.0.0", "BlueOak-1.0.0"]),
    ("MulanPSL-2.0", ["Mulan Permissive Software License, Version 2", "Mulan PSL v2", "MulanPSL-2.0"]),
    ("ODbL-1.0", ["Open Database License", "Open Database License 1.0", "ODbL 1.0", "ODbL-1.0"]),
    ("ODC-By-1.0", ["Open Data Commons Attribution License", "ODC-By 1.0", "ODC-By-1.0"]),
    ("PDDL-1.0", ["Open Data Commons Public Domain Dedication and License", "PDDL 1.0", "PDDL-1.0"]),
    ("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "CC0"]),
    ("CC-BY-3.0", ["CC BY 3.0", "CC-BY-3.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution 3.0 License"]),
    ("CC-BY-SA-3.0", ["CC BY-SA 3.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0", "Creative Commons Attribution-ShareAlike 3.0 License"]),
    ("CC-BY-4.0", ["CC BY 4.0", "CC-BY-4.0", "CC-BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC-BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-ND-4.0", ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"]),
]
# License identifiers and the sentences, in order, by which each rule knows a license's own text.
TEXTS: list[tuple[str, list[str]]] = [
    ("MIT", ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
             "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"]),
    ("GPL-2.0-or-later", ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"]),
    ("GPL-3.0-or-later", ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"]),
    ("LGPL-2.1-or-later", ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"]),
    ("LGPL-3.0-or-later", ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"]),
    ("AGPL-3.0-or-later", ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"]),
    ("BSD-3-Clause", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
                      "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
                      "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
                      "may be used to endorse or promote products derived from this software without specific prior written permission"]),
    ("BSD-2-Clause", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
                      "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
                      "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
                      "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"]),
    ("ISC", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
    ("Zlib", ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain"]),
    ("Proprietary", ["All rights reserved"]),
]
# No text without one of these holds a sentence of a rule.
SIGNS = ["licen", "permi", "redistribut", r"copyright\s+holders", r"public\s+domain", r"under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:mit|apache|gpl|lgpl|agpl|gnu|gfdl|bsd|0bsd|isc|mpl|epl|eupl|cddl|cpl|zlib|libpng|wtfpl|do\s+what|bsl|artistic|ofl|sil|ms-|python|php|ncsa|afl|osl|ecl|upl|blueoak|mulan|odbl|odc|pddl|cc|creative)", r"rights\s+reserved"]
# Words by which a sentence denies a grant or speaks of what might be, and what may stand between them and the grant.
NOT = ["not", "never", "no longer", "cannot", "don t", "doesn t", "isn t", "aren t", "won t", "neither", "nor"]
MIGHT = ["might be", "could be", "would be", "may be relicensed", "can be relicensed"]
BETWEEN = ["be", "been", "being", "to", "ever", "yet", "is", "are", "this", "that", "it", "the", "them", "anything", "something", "code", "software", "program", "file", "files", "work", "library", "project", "made", "ship", "shipped",
           "use", "used", "release", "released", "license", "licensed", "relicense", "relicensed", "distribute", "distributed", "redistribute", "redistributed", "publish", "published", "provide", "provided", "available", "offer", "offered", "cover", "covered"]
DENIAL = f"(?:^| )(?:(?:{'|'.join(NOT)})(?: (?:{'|'.join(BETWEEN)}))*|(?:{'|'.join(MIGHT)})(?: (?:{'|'.join(BETWEEN)}))*) under "

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Normalised names, the longest first, so that the first that matches is the longest.
def _plain(name: str) -> str:
    return re.sub("[^a-z0-9.+/-]+", " ", name.lower()).strip()


LICENSE_OF = {_plain(n): license for license, ns in NAMES for n in ns}
ANY_NAME = "|".join(re.escape(n).replace("\\ ", " ").replace("\\-", "-") for n in sorted(LICENSE_OF, key=lambda n: (-len(n), n)))
#: A grant; the name is its group. What follows the name must be no further letter of it.
UNDER = f"(?:^| )under (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?({ANY_NAME})(?: |$)"
#: Several licenses of one family are no grant of one of them.
DENIAL += f"| under (?:the )?(?:{ANY_NAME}) licenses(?: |$)"
#: The splitter: patterns and what they become, on lower-case text. '|' ends a sentence.
STEPS = [
    (r"[^a-z0-9.+/!?;:\n-]+", " "),
    (r"spdx-license-identifier ?: ?([a-z0-9.+-]+)(?: (?:or|and|with) ([a-z0-9.+-]+))?", r"|spdx \1|spdx \2|"),
    (r"\|spdx \|", "|"),
    (r"([a-z0-9])-\n *([a-z0-9])", r"\1-\2"),
    (r" ?\n[\n ]*\n ?", "|"),
    (r"[.!?;:]+(?:[ \n]+|$)", "|"),
    (r"[!?;:\n ]+", " "),
    (r"licence", "license"),
    (f"((?:^|[ |])under (?:the )?(?:{ANY_NAME})) (?:and|or|and/or) (?:the )?((?:{ANY_NAME})(?: |$|\\|))", r"\1|under \2"),
]


def split(text: str) -> list[str]:
    """What ``sentences`` does to one text."""
    low = text.translate(str.maketrans(*LOWER))
    for pattern, to in STEPS:
        low = re.sub(pattern.replace("$", r"\Z"), to, low)
    return [s for s in (x.strip(" .") for x in low.split("|")) if s]


#: Names that are too short or too common to be titles.
NO_TITLE = {"mit", "isc", "zlib", "cc0", "ncsa", "unlicense", "wtfpl"}


def titles() -> dict[str, str]:
    """License by sentence that is a title or a tag as a whole."""
    found: dict[str, str] = {}
    for name, license in LICENSE_OF.items():
        if name not in NO_TITLE:
            found |= dict.fromkeys((name, f"the {name}"), license)
    found |= {"the mit license mit": "MIT", "mit license mit": "MIT", "apache license version 2.0 january 2004": "Apache-2.0", "the unlicense": "Unlicense", "isc license isc": "ISC"}
    tags = {f"spdx {license.lower()}": license for license, _ in NAMES}
    tags |= {f"spdx {x.lower()}-{end}": f"{x}-or-later" if end == "or-later" else x for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later")}
    return found | tags


def _code_points() -> tuple[dict[str, str], dict[str, str]]:
    """Identifier (one code point) by license, for grants, titles and tags; and by sentence of a license's text, the longest first."""
    licenses = list(dict.fromkeys([*LICENSE_OF.values(), *titles().values()]))
    lines = dict.fromkeys(s for _, xs in TEXTS for x in xs for s in split(x))
    ordered = sorted(lines, key=lambda s: (-len(s), s))
    return {n: chr(FIRST + i) for i, n in enumerate(licenses)}, {s: chr(FIRST + len(licenses) + i) for i, s in enumerate(ordered)}


GRANTS, SENTENCES = _code_points()


def patterns() -> list[tuple[str, str]]:
    """Name and expression of each rule: one for all grants of a license, and one for each license's own text."""
    texts = [(name, (r"\.{0,%d}" % GAP).join(SENTENCES[s] for x in xs for s in split(x))) for name, xs in TEXTS]
    return [*GRANTS.items(), *texts]


def identifier(sentence: str) -> str:
    """What ``_id_of`` does to one sentence."""
    if re.search(DENIAL, sentence):
        return UNKNOWN
    line = next((i for s, i in SENTENCES.items() if (f" {s} " in f" {sentence} " if s.count(" ") >= WHOLE - 1 else s == sentence)), None)
    grant = re.search(UNDER, sentence)
    license = LICENSE_OF[grant[1]] if grant else titles().get(sentence)
    return line or (GRANTS[license] if license else UNKNOWN)


def _check() -> None:
    """Each rule must hold for its own text, and the signs must be in all known sentences but those that only follow others."""
    for name, xs in TEXTS:
        ids = "".join(map(identifier, split("\n\n".join(xs))))
        if not any(n == name and re.search(p, ids) for n, p in patterns()) or not any(re.search(s, " ".join(split(x))) for x in xs for s in SIGNS):
            raise ValueError(f"a rule of {name} does not hold for its own text")


_check()


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; lower-cased, other signs than [a-z0-9.+/-] become one space."""
    low = F.translate(F.coalesce(text, F.lit("")), *LOWER)
    for pattern, to in STEPS:
        low = F.regexp_replace(low, pattern, re.sub(r"\\(\d)", r"$\1", to))
    return F.filter(F.transform(F.split(low, r"\|"), lambda s: F.trim(s, F.lit(" ."))), lambda s: s != "")


def identifiers(found: Column, some: Column) -> Column:
    """The sentences as a string: one code point each, '.' where it is unknown."""
    none = F.repeat(F.lit(UNKNOWN), F.size(found))
    return F.when(some, F.array_join(F.transform(found, _id_of), "")).otherwise(none)


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def _id_of(sentence: Column) -> Column:
    padded = F.concat(F.lit(" "), sentence, F.lit(" "))
    lines = [F.when(F.contains(padded, F.lit(f" {s} ")) if s.count(" ") >= WHOLE - 1 else sentence == s, F.lit(i)) for s, i in SENTENCES.items()]
    granted = F.try_element_at(_map({n: GRANTS[x] for n, x in LICENSE_OF.items()}), F.regexp_extract(sentence, UNDER, 1))
    title = F.try_element_at(_map({t: GRANTS[x] for t, x in titles().items()}), sentence)
    return F.when(sentence.rlike(DENIAL), UNKNOWN).otherwise(F.coalesce(*lines, F.when(F.contains(padded, F.lit(" under ")), granted), title, F.lit(UNKNOWN)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_known, licenses (sorted names, comma-joined), n_rules, places: one row per input row.

    ``places`` says of each rule that holds, in the order of the rules, where: name@sentence of its first match, from 1,
    comma-joined. Null and empty texts have no sentence and no license. All rules that hold are reported. Texts of any
    length are read whole; repeated rows get the same answer; an empty table gives an empty result. Rows stay where
    they are: no exchange. Other columns are ignored.
    """
    some = F.translate(F.coalesce(F.col("t"), F.lit("")), *LOWER).rlike("|".join(SIGNS))
    split_up = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select("doc_id", sentences(F.col("t")).alias("found"), some.alias("some"))
    ids = split_up.select("doc_id", identifiers(F.col("found"), F.col("some")).alias("ids"))
    held = F.array_compact(F.array(*[F.when(F.regexp_like("ids", F.lit(p)), F.struct(F.lit(n).alias("name"), F.regexp_instr("ids", F.lit(p)).alias("at"))) for n, p in patterns()]))
    known_ids = F.regexp_replace("ids", r"\.", "")
    none = F.array().cast("array<struct<name:string,at:int>>")
    return ids.withColumn("held", F.when(F.length(known_ids) > 0, held).otherwise(none)).select(
        "doc_id", F.length("ids").cast("long").alias("n_sentences"), F.length(known_ids).cast("long").alias("n_known"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("held", lambda x: x["name"]))), ",").alias("licenses"), F.size("held").cast("long").alias("n_rules"),
        F.array_join(F.transform("held", lambda x: F.concat(x["name"], F.lit("@"), x["at"].cast("string"))), ",").alias("places"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"translate(coalesce(text, ''), {quote(LOWER[0])}, {quote(LOWER[1])})"
    for pattern, to in STEPS:
        low = f"regexp_replace({low}, {quote(pattern)}, {quote(to)}, 'g')"
    lines = " ".join(f"WHEN {f'contains({chr(39)} {chr(39)} || s || {chr(39)} {chr(39)}, {quote(f' {s} ')})' if s.count(' ') >= WHOLE - 1 else f's = {quote(s)}'} THEN {quote(i)}" for s, i in SENTENCES.items())
    cases = lambda of: " ".join(f"WHEN {quote(k)} THEN {quote(GRANTS[x])}" for k, x in of.items())
    case = f"{lines} WHEN regexp_extract(s, {quote(UNDER)}, 1) <> '' THEN CASE regexp_extract(s, {quote(UNDER)}, 1) {cases(LICENSE_OF)} END ELSE CASE s {cases(titles())} ELSE '.' END"
    rules = ", ".join(f"CASE WHEN regexp_matches(ids, {quote(p)}) THEN {{'name': {quote(n)}, 'at': length(regexp_extract(ids, {quote('^(.*?)' + p)}, 1)) + 1}} END" for n, p in patterns())
    return rf"""
WITH a AS (SELECT doc_id, list_filter(list_transform(string_split({low}, '|'), lambda s: trim(s, ' .')), lambda s: s <> '') AS ss FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(ss, lambda s: CASE WHEN regexp_matches(s, {quote(DENIAL)}) THEN '.' {case} END), '') AS ids FROM a),
d AS (SELECT *, list_filter([{rules}], lambda x: x IS NOT NULL) AS held FROM b)
SELECT doc_id, length(ids)::BIGINT AS n_sentences, length(replace(ids, '.', ''))::BIGINT AS n_known, array_to_string(list_sort(list_distinct(list_transform(held, lambda x: x.name))), ',') AS licenses,
  len(held)::BIGINT AS n_rules, array_to_string(list_transform(held, lambda x: x.name || '@' || x.at::VARCHAR), ',') AS places FROM d
"""


ORACLE_SQL = _oracle()
