"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families (fixed values): how a licence is named in a sentence, and its identifier. The longer names come first.
FAMILIES = (
    ("AGPL", r"gnu affero general public licen[sc]e|affero general public licen[sc]e|(?:gnu )?affero gpl|(?:gnu )?agpl"),
    ("LGPL", r"gnu (?:lesser|library) general public licen[sc]e|(?:lesser|library) general public licen[sc]e|(?:gnu )?lesser gpl|(?:gnu )?lgpl"),
    ("GPL", r"gnu general public licen[sc]e|general public licen[sc]e|gnu public licen[sc]e|(?:gnu )?gpl"),
    ("CC0", r"creative commons (?:cc0|zero)|cc0|cc-zero"),
    ("CC", r"(?:creative commons|cc)[ -](?:attribution|by)(?:[ -](?:non-?commercial|nc|share-?alike|sa|no-?deriv(?:ative)?s?(?: works)?|nd))*(?: public)?"),
    ("Apache", r"apache(?: software)?"),
    ("MPL", r"mozilla public|mpl"),
    ("EPL", r"eclipse public|epl"),
    ("EUPL", r"european union public|eupl"),
    ("CDDL", r"common development and distribution|cddl"),
    ("BSL", r"boost software|boost|bsl"),
    ("Artistic", r"artistic"),
    ("BSD", r"(?:[0234]|zero|two|three|four)[ -]clause bsd|(?:new|modified|revised|simplified|original) bsd|bsd(?:[ -](?:[0234]|zero|two|three|four)[ -]clause)?|0bsd"),
    ("MIT", r"mit(?:/x11)?|expat"),
    ("X11", r"x11"),
    ("ISC", r"isc"),
    ("Zlib", r"zlib(?:/libpng)?"),
    ("Unlicense", r"unlicense"),
    ("PostgreSQL", r"postgresql"),
    ("WTFPL", r"wtfpl|do what the fuck you want to public"),
)
#: Families whose identifier has no version (fixed values).
UNVERSIONED = ("BSD", "MIT", "X11", "ISC", "Zlib", "Unlicense", "PostgreSQL", "WTFPL")
#: Clauses of a BSD licence by the words that tell (fixed values).
BSD_CLAUSES = (("0", ("0", "zero")), ("2", ("2", "two", "simplified")), ("3", ("3", "three", "new", "modified", "revised")), ("4", ("4", "four", "original")))

_NAME = (
    "(?<![a-z0-9])(?:" + "|".join(f"(?P<{base}>{names})" for base, names in FAMILIES) + ")"
    r"(?: licen[sc]es?)?(?:,? ?\(?\"?(?:the )?\"?(?:licen[sc]e|[al]?gpl|mpl)\"?\))?(?:,? (?:version |ver\.? ?|v\.? ?)|-|v\.?|,? )?(?P<version>\d+(?:\.\d+)*)?"
    r"(?: (?:international|unported|universal|generic))?(?: licen[sc]e)?(?P<later>\+|-or-later|,? (?:or|and) (?:\(?at your option\)?,? )?(?:any )?(?:later|newer|higher)(?: versions?)?)?(?![a-z0-9])"
)
_NAMED = re.compile(_NAME)
_LEAD = re.compile(
    r"\b(?:(?:re)?licen[sc]ed|released|distributed?|redistribut(?:ed?|ion)|available|published|provided|offered|covered|governed|shared|free|used?|permitted|contributed)\b[^.;:]{0,60}?"
    r"\b(?:under|by|subject to|according to|in accordance with)\b(?: (?:the|a|an|any|either|both|one of the))?(?: terms(?: and conditions)?)?(?: of)?(?: (?:the|a|an|either|both))? (?:[a-z-]+ ){0,3}?"
    r"(?=(?:the )?" + "(?:" + "|".join(names for _, names in FAMILIES) + r"))(?:the )?"
)
_NEXT = re.compile(r"(?:,? (?P<word>and|or|and/or)|/|,)(?: at your option,?)? ?(?:the |a |an )?(?=[a-z])")

#: Sentence rules (fixed values): identifier and pattern over a whole normalised sentence (lower case, single spaces, no
#: comment marks or end mark). Sentences that only name a licence are told by their grammar, in `identify`.
SENTENCES = (
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the \"?software\"?\), to deal in the software without restriction.*"),
    ("mit-notice", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("boost-grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("boost-notice", r"the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted(?: \(subject to the limitations in the disclaimer below\))? provided that the following conditions are met:?.*"),
    ("bsd-source", r"(?:[*\d.() -]*)redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:[*\d.() -]*)redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-advert", r"(?:[*\d.() -]*)all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("bsd-endorse", r"(?:[*\d.() -]*)neither the names? of .* may be used to endorse or promote products.*"),
    ("isc-grant", r"permission to use, copy, modify,? (?:and/or|and) distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted, provided that the above copyright notice.*"),
    ("0bsd-grant", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-as-is", r"this software is provided '?\"?as[- ]is'?\"?, without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose,? including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:?.*"),
    ("zlib-origin", r"(?:[*\d.() -]*)(?:subject to the following restrictions: )?(?:[*\d.() -]*)the origin of this software must not be misrepresented.*"),
    ("apache-limits", r"you may not use this (?:file|work|project|software) except in compliance with the license"),
    ("apache-copy", r"(?:and )?you may obtain a copy of the license at.*"),
    ("apache-basis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"?as is\"? basis.*"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-title", r"apache license,? version 2\.0,? january 2004(?: https?://\S+)?"),
    ("apache-terms", r"terms and conditions for use, reproduction, and distribution"),
    ("apache-grant", r"(?:[\d.]* ?grant of copyright license\. )?subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide.*"),
    ("gpl-title", r"gnu (?P<kind>lesser |library |affero )?general public license version (?P<version>\d+(?:\.\d+)*), \d+ \w+ \d{4}"),
    ("gpl-verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-free", r".*\bis free software[;:,] you can redistribute it and/or modify it under the terms of (?:version (?P<first>\d+(?:\.\d+)*) of )?the gnu (?P<kind>lesser |affero |library )?general public license,?(?: as published by the free software foundation)?(?:[;,]? (?:either )?version (?P<version>\d+(?:\.\d+)*)(?: of the license)?(?: only)?)?(?P<later>,? or \(?at your option\)?,? any later version)?"),
    ("gpl-hope", r".*\b(?:is|are) distributed in the hope that (?:it|they) will be useful,? but without any warranty.*"),
    ("gpl-see", r"see the gnu (?:lesser |affero |library )?general public license for more details"),
    ("gpl-copy", r"(?:if not, see .*|you should have received a copy of the gnu (?:lesser |affero |library )?general public license.*)"),
    ("mpl-subject", r"this source code form is subject to the terms of the mozilla public license, v(?:ersion|\.)? ?(?P<version>\d+(?:\.\d+)*)"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file,? you can obtain one at.*"),
    ("unlicense-free", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.*"),
    ("cc0-waive", r"to the extent possible under law, .* (?:has|have) (?:waived|dedicated) all copyright and related or neighbou?ring rights.*"),
    ("wtfpl-grant", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("as-is", r"(?:the|this) (?:software|program|work) is provided (?:by .{1,200} )?[\"']?as[- ]is[\"']?.*"),
    ("liability", r"in no event (?:shall|will) .* be (?:held )?liable for any .*"),
    ("copyright", r"(?:copyright|\(c\)|©).*\d{4}.*"),
    ("reserved", r"all rights reserved"),
)

#: Ordered rules (fixed values): the first whose sequence begins at a place wins. A mark ? makes an identifier optional;
#: {name} is the licence that a sentence of the sequence names.
RULES = (
    ("MIT", "title? mit-grant mit-notice? as-is? liability?"),
    ("BSL-1.0", "title? boost-grant boost-notice? as-is? liability?"),
    ("BSD-4-Clause", "title? bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse? as-is? liability?"),
    ("BSD-3-Clause", "title? bsd-grant bsd-source bsd-binary bsd-endorse as-is? liability?"),
    ("BSD-2-Clause", "title? bsd-grant bsd-source bsd-binary as-is? liability?"),
    ("BSD", "title? bsd-grant as-is? liability?"),
    ("ISC", "title? isc-grant as-is? liability?"),
    ("0BSD", "title? 0bsd-grant as-is? liability?"),
    ("Zlib", "title? zlib-as-is liability? zlib-grant zlib-origin?"),
    ("Zlib", "title? zlib-grant zlib-origin?"),
    ("Apache-2.0", "apache-title apache-terms? apache-grant?"),
    ("Apache-2.0", "apache-terms apache-grant"),
    ("Apache-2.0", "apache-grant"),
    ("{name}", "ref apache-limits apache-copy? apache-basis? apache-see?"),
    ("Apache-2.0", "apache-limits apache-copy apache-basis? apache-see?"),
    ("{name}", "gpl-title gpl-verbatim?"),
    ("{name}", "gpl-free gpl-hope? gpl-see? gpl-copy? gpl-copy?"),
    ("{name}", "title? mpl-subject mpl-copy?"),
    ("MPL", "mpl-copy"),
    ("Unlicense", "title? unlicense-free unlicense-anyone?"),
    ("CC0-1.0", "title? cc0-waive"),
    ("WTFPL", "title? wtfpl-grant"),
    ("{name}", "spdx"),
    ("{name}", "ref"),
    ("{name}", "title"),
)

_COMPILED = tuple((name, re.compile(pattern)) for name, pattern in SENTENCES)
_SEQUENCES = tuple((licence, tuple((part.rstrip("?"), part.endswith("?")) for part in said.split())) for licence, said in RULES)
#: A sentence without any of these is no known one (fixed values).
_HINTS = (
    "licen", "copyright", "permission", "permitted", "redistribut", "provided", "released", "warranty", "liable", "neither the name", "rights reserved", "free software", "distribut",
    "published", "available", "(c)", "©", "gpl", "obtain a copy", "you may", "advertising materials", "misrepresented", "unencumbered", "is free to copy", "hope that", "if not, see", "mpl", "reproduction", "each contributor", "apache", "-clause",
)
_END = re.compile(
    r"(?<=[.!?])\s+(?=[A-Z\"'(])|;\s+(?=(?:and |or |either |you (?:may|can)\b))|\n[\t #/*;-]*\n|(?<=[.!?:])[\t ]*\n|"
    r"\n(?=[^\S\n]*(?:[*#/;]+[^\S\n]*)?(?:SPDX|Copyright|Licen[sc]ed|Released|Permission|Redistribution|Neither|Everyone is permitted|(?:\(?\d+[.)]|\*|-) +Redistributions|This (?:work|program|library|file|software)))"
)
#: Comment marks at the start or end of a line; blanks take their place, so that offsets stay.
_MARKS = re.compile(r"(?m)^[\t ]*(?:/\*+|\*+/|\*+|//+|#+|;+|--|<!--|\.\.)(?=\s|$)|(?<!\*)\*+/[\t ]*$|-->[\t ]*$")
#: What may follow the bare name of a licence.
_AFTER = re.compile(r"\s*(?:$|[,;:()/\"'-]|and |or |terms\b|only\b)")
_FREE = re.compile(r"is free software$")
_SPACES = re.compile(r"\s+")
_SPDX = re.compile(r".{0,20}?spdx-license-identifier: ?\(?(?P<name>[a-z0-9.+-]+\+?(?:[ ()]+(?:or|and|with)[ (]+[a-z0-9.+-]+\+?\)?)*)\)?(?: ?(?:\*/|-->|\*\)))?")
_META = re.compile(r"[\"']?licen[sc]es?[\"']?(?: name)? ?(?::|=|::) ?[\"'(]?(?:osi approved :: )?")
_KINDS = {"": "GPL", "lesser ": "LGPL", "library ": "LGPL", "affero ": "AGPL"}

Known = tuple[str, str, int, int]


def normalise(sentence: str) -> str:
    said = _SPACES.sub(" ", sentence).replace("“", '"').replace("”", '"').replace("’", "'")
    return said.strip(" \t\n\r#/*").lower().rstrip(".!?;: ")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points. A semicolon ends one where a new clause follows, but for `is free software;`."""
    bounds, at = [], 0
    for m in _END.finditer(text):
        if text[m.start()] == ";" and _FREE.search(normalise(text[max(at, m.start() - 200) : m.start()])):
            continue
        if text[m.start()] == ";" and re.match(r";\s+either ", m[0] + text[m.end() : m.end() + 7]):
            continue
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(text)))
    return [(a, b) for a, b in bounds if b > a]


def _licence(m: re.Match) -> str:
    """Identifier of a named licence: family, parts or clauses, version, and whether later versions do."""
    base = next(b for b, _ in FAMILIES if m[b])
    said = m[base]
    if base == "CC":
        parts = [p for p, words in (("BY", "attribution|by"), ("NC", "non-?commercial|nc"), ("SA", "share-?alike|sa"), ("ND", "no-?deriv|nd")) if re.search(rf"\b(?:{words})", said)]
        base = "CC-" + "-".join(parts)
    elif base == "BSD":
        words = re.split("[ -]", said)
        clauses = next((n for n, tells in BSD_CLAUSES if set(words) & set(tells)), "0" if said == "0bsd" else "")
        base = "0BSD" if clauses == "0" else f"BSD-{clauses}-Clause" if clauses else "BSD"
        return base
    if base in UNVERSIONED:
        return base
    return base + (f"-{m['version']}" if m["version"] else "") + ("-or-later" if m["later"] else "")


def _all_named(said: str, at: int) -> tuple[str, int] | None:
    """Licences named one after the other from a place on, joined by OR or AND, and where they end."""
    m = _NAMED.match(said, at)
    if not m or not ("licen" in m[0] or "gpl" in m[0] or m["version"] or "-" in m[0] or _AFTER.match(said, m.end())):
        return None
    names, end = [_licence(m)], m.end()
    while (step := _NEXT.match(said, end)) and (m := _NAMED.match(said, step.end())):
        names += ["AND" if step["word"] == "and" else "OR", _licence(m)]
        end = m.end()
    return " ".join(names), end


def identify(sentence: str) -> tuple[str, str] | None:
    """(identifier, licence it names or "") of a sentence: a known one, an SPDX line, a reference, a title, or none of these."""
    said = normalise(sentence)
    if m := _SPDX.fullmatch(said):
        return "spdx", re.sub(r"[()]", "", m["name"]).upper()
    for name, pattern in _COMPILED:
        if m := pattern.fullmatch(said):
            groups = m.groupdict()
            if name in ("gpl-free", "gpl-title"):
                version = groups.get("version") or groups.get("first")
                return name, _KINDS[m["kind"] or ""] + (f"-{version}" if version else "") + ("-or-later" if groups.get("later") else "")
            return name, f"MPL-{m['version']}" if name == "mpl-subject" else ""
    for lead in _LEAD.finditer(said):
        if found := _all_named(said, lead.end()):
            return "ref", found[0]
    start = m.end() if (m := _META.match(said)) else 4 if said.startswith("the ") else 0
    found = _all_named(said, start)
    whole = found and re.fullmatch(r"[\"'),]*(?: ?\((?:the )?\"?[a-z0-9. -]{1,30}\"?\))?", said[found[1] :])
    if whole and (start > 4 or "licen" in said or re.search(r"\d", said)):
        return "title", found[0]
    return None


def match_rules(known: list[Known]) -> list[tuple[str, int, int, str]]:
    """Identified sentences in order -> (licence, start, end, identifiers) of the first rule that fits at each place, none overlapping.

    `copyright` and `reserved` may stand anywhere between the sentences of a rule.
    """
    core = [k for k in known if k[0] not in ("copyright", "reserved")]
    out, at = [], 0
    while at < len(core):
        for licence, sequence in _SEQUENCES:
            end = at
            for name, optional in sequence:
                if end < len(core) and core[end][0] == name:
                    end += 1
                elif not optional:
                    break
            else:
                part = core[at:end]
                named = next((p[1] for p in reversed(part) if p[1]), "")
                out.append((licence.replace("{name}", named), part[0][2], part[-1][3], " ".join(p[0] for p in part)))
                at = end
                break
        else:
            at += 1
    return out


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(licence, start, end, identifiers) of each rule's match, left to right, none overlapping. Null or empty: none."""
    if not text:
        return []
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    known, plain = [], _MARKS.sub(lambda m: " " * len(m[0]), text)
    for a, b in sentences(plain):
        said = plain[a:b].lower()
        if any(h in said for h in _HINTS) and (found := identify(plain[a:b])):
            known.append((*found, a, b))
    return match_rules(known)


def find_licenses(docs: DataFrame) -> DataFrame:
    """docs with `licenses`: array of (license, start, stop, sentences) in place of a column so named; all else stays.

    Whole texts; a null or empty text has an empty array; each row is judged by itself, repeated rows alike. An empty
    table gives an empty result.
    """

    @F.pandas_udf("array<struct<license string, start int, stop int, sentences string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"license": x, "start": a, "stop": b, "sentences": s} for x, a, b, s in scan(t)] for t in texts], dtype=object)

    return docs.withColumn("licenses", found(docs["text"]))
