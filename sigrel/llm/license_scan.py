"""License scans: sentences that licences are made of, and rules over their order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of licence texts (normalised: lower case, other characters than letters and digits as one blank).
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-grant-0": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-grant-old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
    "isc-notice": "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-title": "apache license version 2 0 january 2004",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "gpl-free": "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-free": "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-library": "is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation",
    "agpl-free": "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "gnu-2-or-later": "either version 2 of the license or at your option any later version",
    "gnu-21-or-later": "either version 2 1 of the license or at your option any later version",
    "gnu-3-or-later": "either version 3 of the license or at your option any later version",
    "gnu-2-only": "version 2 of the license",
    "gnu-21-only": "version 2 1 of the license",
    "gnu-3-only": "version 3 of the license",
    "gnu-hope": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl11-header": "the contents of this file are subject to the mozilla public license version 1 1",
    "epl1-header": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "epl2-header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "cddl-header": "the contents of this file are subject to the terms of the common development and distribution license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "wtfpl-copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document",
    "wtfpl-do": "you just do what the fuck you want to",
    "artistic2-title": "the artistic license 2 0",
    "artistic2-copy": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "ofl-grant": "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software",
    "psf-title": "this license agreement is between the python software foundation psf and the individual or organization",
    "cc0-waiver": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "all-rights": "all rights reserved",
    "confidential": "unauthorized copying of this file via any medium is strictly prohibited",
}
# A licence is recognised where the sentences of one of its rules occur in this order, with others between
# or not, and none of those after the bar occurs.
RULES = {
    "MIT": ("mit-grant mit-notice mit-as-is",),
    "MIT-0": ("mit-grant-0 mit-as-is | mit-notice",),
    "ISC": ("isc-grant isc-notice isc-as-is", "isc-grant-old isc-notice isc-as-is"),
    "0BSD": ("isc-grant isc-as-is | isc-notice",),
    "BSD-2-Clause": ("bsd-redistribution bsd-source bsd-binary bsd-as-is | bsd-endorse bsd-advertising",),
    "BSD-3-Clause": ("bsd-redistribution bsd-source bsd-binary bsd-endorse bsd-as-is | bsd-advertising",),
    "BSD-4-Clause": ("bsd-redistribution bsd-source bsd-binary bsd-advertising bsd-endorse",),
    "Apache-2.0": ("apache-header apache-comply apache-copy", "apache-header", "apache-title apache-terms"),
    "GPL-2.0-only": ("gpl-free gnu-2-only", "gpl2-title"),
    "GPL-2.0-or-later": ("gpl-free gnu-2-or-later",),
    "GPL-3.0-only": ("gpl-free gnu-3-only", "gpl3-title"),
    "GPL-3.0-or-later": ("gpl-free gnu-3-or-later",),
    "LGPL-2.0-or-later": ("lgpl-library gnu-2-or-later",),
    "LGPL-2.1-only": ("lgpl-free gnu-21-only", "lgpl21-title"),
    "LGPL-2.1-or-later": ("lgpl-free gnu-21-or-later",),
    "LGPL-3.0-only": ("lgpl-free gnu-3-only", "lgpl3-title"),
    "LGPL-3.0-or-later": ("lgpl-free gnu-3-or-later",),
    "AGPL-3.0-only": ("agpl-free gnu-3-only", "agpl3-title"),
    "AGPL-3.0-or-later": ("agpl-free gnu-3-or-later",),
    "MPL-1.1": ("mpl11-header",),
    "MPL-2.0": ("mpl2-header mpl2-copy", "mpl2-header"),
    "EPL-1.0": ("epl1-header",),
    "EPL-2.0": ("epl2-header",),
    "CDDL-1.0": ("cddl-header",),
    "Unlicense": ("unlicense-free unlicense-anyone", "unlicense-free"),
    "Zlib": ("zlib-as-is zlib-grant",),
    "BSL-1.0": ("boost-grant",),
    "WTFPL": ("wtfpl-copy wtfpl-do", "wtfpl-do"),
    "Artistic-2.0": ("artistic2-title artistic2-copy",),
    "OFL-1.1": ("ofl-grant",),
    "PSF-2.0": ("psf-title",),
    "CC0-1.0": ("cc0-waiver",),
    "Proprietary": ("confidential",),
}
# Rules that count only where no other licence is recognised.
ALONE = {"Proprietary": ("all-rights",)}
# A notice right after one of these words says nothing.
NEGATIONS = ("not", "never", "longer", "t")
# What short notices call a licence, besides its identifier.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "ISC": ("isc license", "isc"),
    "0BSD": ("zero clause bsd license",),
    "BSD-2-Clause": ("simplified bsd license", "bsd 2 clause license", "2 clause bsd license"),
    "BSD-3-Clause": ("new bsd license", "bsd 3 clause license", "3 clause bsd license", "modified bsd license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu gpl version 2", "gnu gplv2", "gplv2"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gplv2 or later"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu gpl version 3", "gnu gplv3", "gplv3"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gplv3 or later"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "lgplv2 1"),
    "LGPL-2.1-or-later": ("gnu lesser general public license version 2 1 or later",),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "lgplv3"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"),
    "EPL-1.0": ("eclipse public license v1 0", "eclipse public license 1 0"),
    "EPL-2.0": ("eclipse public license v2 0", "eclipse public license 2 0"),
    "Unlicense": ("unlicense",),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "WTFPL": ("wtfpl",),
    "Artistic-2.0": ("artistic license 2 0",),
    "OFL-1.1": ("sil open font license version 1 1",),
    "CC0-1.0": ("cc0 1 0", "creative commons zero v1 0", "cc0 1 0 universal"),
}
# Creative Commons licences by their letters, their words, and versions.
CREATIVE = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
CREATIVE_VERSIONS = ("2.0", "3.0", "4.0")
# What stands before the name of a licence in a short notice.
NOTICES = ("licensed under", "released under", "distributed under", "available under", "provided under", "published under", "under the terms of", "license", "spdx license identifier")
#: Texts without any of these can hold no known sentence, so they need no work.
_HINT = r"(?i)anyone|mpl|licen[sc]e|reserved|permi|redistribut|warrant|domain|prohibited|under|everyone|version|just\W+do|acknowledgement|endorse|liable|subject|terms"
_OTHER = re.compile(r"[^a-z0-9]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


# Families whose name and version alone, with "only" or "or later", are names too.
GNU = {"GPL": ("gpl", "gnu gpl", "gnu general public license"), "LGPL": ("lgpl", "gnu lgpl", "gnu lesser general public license"), "AGPL": ("agpl", "gnu agpl", "gnu affero general public license")}
_ID = r"(?:\(\s*)*[A-Za-z0-9][A-Za-z0-9.+-]*(?:\s*\))*"
_EXPRESSION = re.compile(rf"(?i:SPDX-License-Identifier):\s*({_ID}(?:\s+(?:AND|OR|WITH)\s+{_ID})*)")
_EXCEPTION = re.compile(r"\s+WITH\s+\S+")


def expand_expressions(text: str) -> str:
    """The text with each licence expression as one identifier after the other: AND and OR name their sides, WITH the side
    before it, + is "or later"."""

    def each(m: re.Match) -> str:
        ids = re.findall(r"[A-Za-z0-9][A-Za-z0-9.+-]*", _EXCEPTION.sub(" ", m[1]))
        return ". ".join("SPDX-License-Identifier: " + re.sub(r"\+$", "-or-later", x) for x in ids if x not in ("AND", "OR"))

    return _EXPRESSION.sub(each, text)


def notices() -> dict[str, tuple[str, str]]:
    """Short notices of every licence, as sentence -> (identifier, licence): notice words, "the" or "a" or nothing, name."""
    names = {k: {*v, normalise(k)} for k, v in NAMES.items()}
    for k in RULES:
        if k != "Proprietary":
            names.setdefault(k, {normalise(k)})
    for k in list(names):
        if m := re.fullmatch(r"(A?L?GPL)-(\d)\.(\d)-(only|or-later)", k):
            versions = {f"{m[2]} {m[3]}", f"v{m[2]} {m[3]}", f"version {m[2]} {m[3]}"} | ({m[2], f"v{m[2]}", f"version {m[2]}"} if m[3] == "0" else set())
            names[k] |= {f"{name} {v}{end}" for name in GNU[m[1]] for v in versions for end in ((" only", "") if m[4] == "only" else (" or later", " or any later version"))}
    for letters, words in CREATIVE.items():
        for version in CREATIVE_VERSIONS:
            v = normalise(version)
            names[f"CC-{letters}-{version}"] = {f"{a} {b} {v}" for a, b in (("cc", normalise(letters)), ("creative commons", words))} | {f"creative commons {words} {v} international"}
    return {" ".join(filter(None, (before, article, name))): (f"notice-{licence.lower()}", licence) for licence, all_names in names.items() for name in all_names for before in NOTICES for article in ("", "the", "a", "an")}


class Sentences:
    """Known sentences as one automaton over words: finds them in a normalised text, inside longer sentences too."""

    def __init__(self, sentences: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for sentence, name in sentences.items():
            self.automaton.add_word(f" {sentence} ", (len(sentence) + 2, name))
        if sentences:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[str]:
        """Identifiers in text order; of matches that overlap the one that starts first stays, the longest of equal starts."""
        if not len(self.automaton):
            return []
        line = f" {normalise(text)} "
        found = sorted((end - size + 1, -size, name) for end, (size, name) in self.automaton.iter(line))
        out, free = [], -1
        for start, size, name in found:
            if start >= free:
                if not name.startswith("notice-") or line[:start].rpartition(" ")[2] not in NEGATIONS:
                    out.append(name)
                free = start - size - 1  # the blank between two sentences belongs to both
        return out


def matching(ids: list[str], rules: dict[str, tuple[str, ...]], alone: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Licences with a rule whose identifiers are a subsequence of ``ids`` and whose unwanted ones don't occur; if there
    are none, those with a rule of ``alone``."""

    def inside(rule: str) -> bool:
        wanted, _, unwanted = rule.partition("|")
        rest = iter(ids)
        return all(any(x == y for y in rest) for x in wanted.split()) and not set(unwanted.split()) & set(ids)

    found = sorted(name for name, options in rules.items() if any(inside(rule) for rule in options))
    return found or (matching(ids, alone) if alone else [])


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The columns of ``docs`` with license_sentences and licenses (arrays), over whole texts.

    Texts are normalised, known sentences are mapped to their identifiers in text order, also where they stand inside
    longer ones, and the identifiers are matched against ordered rules. Licence expressions name each of their licences;
    a notice after "not" says nothing; "all rights reserved" counts only where no licence is recognised. ``sentences`` (identifier -> sentence) and
    ``rules`` replace the built-in ones. Null and empty texts and texts without a known sentence get empty arrays;
    each row is handled by itself, repeated rows alike, of any length; extra columns pass through under any name
    (license_sentences and licenses are replaced); an empty table gives an empty one.
    """
    if sentences is None:
        short = notices()
        known = {v: k for k, v in SENTENCES.items()} | {k: name for k, (name, _) in short.items()}
        ordered = dict(rules or RULES)
        if rules is None:
            for name, licence in {x for x in short.values()}:
                ordered[licence] = (*ordered.get(licence, ()), name)
    else:
        known, ordered = {normalise(v): k for k, v in sentences.items()}, rules or RULES
    alone = ALONE if rules is None else {}

    @F.pandas_udf("ids array<string>, names array<string>", F.PandasUDFType.SCALAR_ITER)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Sentences(known)
        for texts in batches:
            ids = [finder.find(expand_expressions(t) if sentences is None else t) if t else [] for t in texts.array]
            yield pd.DataFrame({"ids": ids, "names": [matching(x, ordered, alone) if x else [] for x in ids]})

    text = F.col("text").cast("string")
    hinted = text if sentences is not None else F.when(text.rlike(_HINT), text)
    given = [c for c in docs.columns if c not in ("license_sentences", "licenses")]
    out = docs.select(F.struct(*given).alias("it"), scan(hinted).alias("found"))
    return out.select(*[F.col("it").getField(c).alias(c) for c in given], F.col("found.ids").alias("license_sentences"), F.col("found.names").alias("licenses"))
