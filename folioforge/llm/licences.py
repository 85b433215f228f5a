"""Licence scans by sentence rules.

A text is cut into sentences twice: at line ends, and with lines joined (wrapped headers). Normalised sentences (lower case,
letters and digits only) are mapped to the identifiers of known licence sentences, or by a pattern where a name stands in the
sentence; unknown ones that speak of licences become `?`, others are dropped. Licence rules, in order, are matched against the identifier sequence; a rule uses up what
it matches, so a short rule does not fire inside a longer one. Only DataFrame functions run here.

Null and empty texts have no sentences and no licence. Repeated rows are scanned each. Ties: rules are tried in their
order; licences of SPDX tags, all those of an expression, come after them. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU = {"Gpl": "", "Lgpl": "lesser ", "LgplLibrary": "library ", "Agpl": "affero "}


def _gnu() -> dict[str, list[str]]:
    """Sentences of the GNU licences: the grant in one sentence (with a colon or none before it) or cut at its semicolons, and short forms."""
    out: dict[str, list[str]] = {}
    for kind, word in _GNU.items():
        name = f"gnu {word}general public license"
        terms = f"you can redistribute it and or modify it under the terms of the {name}"
        out[f"{kind}Terms"] = [f"{terms} as published by the free software foundation"]
        for v, n in (("2", "2"), ("21", "2 1"), ("3", "3")):
            rest = (f"either version {n} of the license or at your option any later version", f"version {n} of the license", f"version {n}")
            for end, tail in (("Later", rest[:1]), ("Only", rest[1:])):
                whole = [f"{terms} as published by the free software foundation {t}" for t in tail]
                if end == "Only":
                    whole.append(f"{terms} version {n} as published by the free software foundation")
                out[f"{kind}{v}{end}"] = whole + [f"this {x} is free software {w}" for x in ("program", "library") for w in whole]
            short = [f"{name} version {n}", f"{name} v{n}", f"{name} version {n} only"]
            later = [f"{name} version {n} or later", f"{name} v{n} or later", f"{name} version {n} or any later version"]
            for end, forms in (("Ref", short), ("LaterRef", later)):
                out[f"{kind}{v}{end}"] = [x + f for f in forms for x in ("", "the ", "licensed under the ", "this work is licensed under the ", "this program is licensed under the ", "released under the ")]
    for v, n in (("2", "2"), ("21", "2 1"), ("3", "3")):
        out[f"Later{v}"] = [f"either version {n} of the license or at your option any later version"]
        out[f"Only{v}"] = [f"version {n} of the license"]
    return out


def _gnu_rules() -> list[tuple[str, str]]:
    out = []
    for kind, names in (("Gpl", {"2": "GPL-2.0", "3": "GPL-3.0"}), ("Lgpl", {"2": "LGPL-2.0", "21": "LGPL-2.1", "3": "LGPL-3.0"}), ("LgplLibrary", {"2": "LGPL-2.0"}), ("Agpl", {"3": "AGPL-3.0"})):
        for v, name in names.items():
            free = "GplFree|" if (kind, v) == ("Gpl", "3") else ""
            rest = "GplHope* GplEven* GplSee* GplCopy* GplCopy*"
            out.append((f"{name}-or-later", f"{free}{kind}{v}Later|{kind}{v}LaterRef {rest}"))
            out.append((f"{name}-or-later", f"{kind}Terms Later{v} {rest}"))
            out.append((f"{name}-only", f"{kind}{v}Only {rest}"))
            out.append((f"{name}-only", f"{kind}Terms Only{v} {rest}"))
    return out


# Normalised sentences of public licences and notices, with an identifier each.
SENTENCES = {
    "ApacheRef": ["licensed under the apache license version 2 0", "this work is licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitRef": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MitLiable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "Gpl3Ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is licensed under the gnu general public license version 3"],
    "Gpl2Ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GplFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GplSee": ["see the gnu general public license for more details"],
    "BsdGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "CcByNc4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "CcBy4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "CcBySa4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "Reserved": ["all rights reserved"],
    "BsdNames": [
        f"neither the name of the {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for x in ("copyright holder", "copyright holders", "author", "organization", "university", "project")
    ]
    + [
        f"{x} may not be used to endorse or promote products derived from this software without specific prior written permission"
        for x in ("the name of the author", "the name of the copyright holder", "the names of its contributors")
    ],
    "BsdAdvert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BsdAsIs": [
        f"this software is provided by {x} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        for x in ("the copyright holders and contributors", "the copyright holder and contributors", "the author", "the author and contributors", "the regents and contributors")
    ],
    "BsdLiable": [
        f"in no event shall {x} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
        for x in ("the copyright holder or contributors", "the copyright owner or contributors", "the copyright holders or contributors", "the author", "the author or contributors", "the regents or contributors")
    ],
    "IscGrant": [f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("and or", "and")],
    "ZeroBsdGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "IscAsIs": [f"the software is provided as is and {x} all warranties with regard to this software including all implied warranties of merchantability and fitness" for x in ("the author disclaims", "isc disclaims", "the authors disclaim")],
    "IscLiable": [
        f"in no event shall {x} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
        for x in ("the author", "isc", "the authors")
    ],
    "IscRef": ["licensed under the isc license", "released under the isc license", "this work is licensed under the isc license"],
    "Bsd3Ref": [x + y for x in ("licensed under the ", "released under the ", "this work is licensed under the ") for y in ("bsd 3 clause license", "3 clause bsd license", "new bsd license")],
    "Bsd2Ref": [x + y for x in ("licensed under the ", "released under the ", "this work is licensed under the ") for y in ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")],
    "Mpl2": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license version 2 0"],
    "Mpl2Ref": [x + y for x in ("licensed under the ", "released under the ", "this work is licensed under the ") for y in ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0")],
    "Mpl11": ["the contents of this file are subject to the mozilla public license version 1 1 the license"],
    "Mpl11Ref": ["licensed under the mozilla public license version 1 1", "this work is licensed under the mozilla public license version 1 1"],
    "GplCopy": [f"you should have received a copy of the gnu {w}general public license along with this {x}" for w in _GNU.values() for x in ("program", "library")] + ["if not see http www gnu org licenses", "if not see https www gnu org licenses"],
    "GplEven": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "SpdxTag": ["spdx license identifier"],
}
SENTENCES["GplHope"] += [f"this {x} is distributed in the hope that it will be useful but without any warranty" for x in ("program", "library")]
SENTENCES["GplSee"] += [f"see the gnu {w}general public license for more details" for w in _GNU.values() if w]
_KNOWN = {t for texts in SENTENCES.values() for t in texts}
for _name, _texts in _gnu().items():
    SENTENCES[_name] = SENTENCES.get(_name, []) + [t for t in _texts if t not in _KNOWN]
# Sentences with a name in them, by a pattern, where no known sentence is the same.
PATTERNS = [
    ("BsdNames", "^(.* )?nor (the )?names? of .*may be used to endorse or promote products derived from this software without( specific)?( prior)?( written)? permission$"),
    ("BsdNames", "^the names? .+ may not be used to endorse or promote products derived from this software without( specific)?( prior)?( written)? permission$"),
    ("BsdAsIs", "^this software is provided by .+ as is and any express(ed)? or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$"),
    ("BsdLiable", "^in no event shall .+ be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services$"),
    ("IscAsIs", "^the software is provided as is and .+ disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness$"),
    ("GplHope", "^.+ is distributed in the hope that it will be useful but without any warranty$"),
    ("GplCopy", "^you should have received a copy of the gnu (lesser |library |affero )?general public license along with .+$"),
    ("SpdxTag", "(^| )spdx license identifier( |$)"),
]
# Licence rules, tried in this order. A rule is a sequence of sentence identifiers; | parts alternatives, a final * may be absent.
RULES = [
    ("Apache-2.0", "ApacheRef ApacheUse ApacheCopy ApacheAsIs ApacheSee*"),
    *_gnu_rules(),
    ("MIT", "MitGrant MitNotice MitAsIs MitLiable*"),
    ("BSD-4-Clause", "BsdGrant BsdSource BsdBinary BsdAdvert BsdNames* BsdNames* BsdAsIs* BsdLiable*"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdNames BsdNames* BsdAsIs* BsdLiable*"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs* BsdLiable*"),
    ("ISC", "IscGrant IscAsIs* IscLiable*"),
    ("0BSD", "ZeroBsdGrant IscAsIs* IscLiable*"),
    ("MPL-2.0", "Mpl2|Mpl2Ref"),
    ("MPL-1.1", "Mpl11|Mpl11Ref ApacheUse* ApacheCopy*"),
    ("Apache-2.0", "ApacheRef"),
    ("MIT", "MitRef|MitGrant"),
    ("ISC", "IscRef"),
    ("BSD-3-Clause", "Bsd3Ref"),
    ("BSD-2-Clause", "Bsd2Ref"),
    ("GPL-3.0-only", "Gpl3Ref"),
    ("GPL-2.0-only", "Gpl2Ref"),
    ("LGPL-3.0-only", "Lgpl3Ref"),
    ("LGPL-2.1-only", "Lgpl21Ref"),
    ("LGPL-2.0-only", "Lgpl2Ref|LgplLibrary2Ref"),
    ("AGPL-3.0-only", "Agpl3Ref"),
    ("CC-BY-NC-4.0", "CcByNc4"),
    ("CC-BY-SA-4.0", "CcBySa4"),
    ("CC-BY-4.0", "CcBy4"),
    ("Proprietary", "Reserved"),
]
#: A sentence that has none of these is neither known nor of interest; every known one has one.
SPEAKS = "licen[cs]e|copyright|permission|warrant|reserved|redistribut|liable|applicable law|advertising materials|either version"
ENDS = "[.!?:;]+[\\x20\\x09-\\x0D]+|[\\x0A\\x0D]+"
ENDS_WRAPPED = "[.!?:;]+[\\x20\\x09-\\x0D]+|[\\x20\\x09]*(\\r?\\n[\\x20\\x09*#/;-]*){2,}"
_ID = "[A-Za-z0-9][A-Za-z0-9.+:-]*"
SPDX = f"(?i:spdx-license-identifier):[ \\t]*([( ]*{_ID}(?: *\\))*(?:[ \\t]+(?:AND|OR|WITH)[ \\t]+[( ]*{_ID}(?: *\\))*)*)"


def _pattern(rule: str) -> str:
    out = ""
    for part in rule.split():
        names = "|".join(part.rstrip("*").split("|"))
        out += f"(?:<(?:{names})>)" + ("?" if part.endswith("*") else "")
    return out


def _sequence(text: Column, ends: str) -> Column:
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, f"<{name}>")])
    plain = F.transform(F.split(F.lower(text), ends), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    said = F.filter(plain, lambda s: s.rlike(SPEAKS))
    free = lambda s: [F.when(s.rlike(p), F.lit(f"<{name}>")) for name, p in PATTERNS]
    return F.array_join(F.transform(said, lambda s: F.coalesce(F.try_element_at(known, s), *free(s), F.lit("<?>"))), "")


def _tagged(text: Column) -> Column:
    """Identifiers of the SPDX tags in a text; exceptions go, the names in use before 3.0 become the present ones."""

    def present(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, "[.:-]+$", ""), r"^([AL]?GPL-[0-9]\.[0-9])\+$", "$1-or-later")
        return F.regexp_replace(x, r"^([AL]?GPL-[0-9]\.[0-9])$", "$1-only")

    plain = F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda x: F.regexp_replace(x, f"[ \\t]WITH[ \\t]+{_ID}", " "))
    ids = F.filter(F.flatten(F.transform(plain, lambda x: F.split(x, "[() \\t]+"))), lambda x: ~x.isin("", "AND", "OR"))
    return F.transform(ids, present)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (comma-joined identifiers in the order of the rules), sentences (identifier sequence by lines), n_known, n_unknown."""
    text = F.coalesce(F.col("text"), F.lit(""))
    speaks = F.lower(text).rlike(SPEAKS)
    out = docs.select("doc_id", F.when(speaks, text).otherwise("").alias("_t"))
    out = out.select("doc_id", _sequence(F.col("_t"), ENDS).alias("sentences"), _sequence(F.col("_t"), ENDS_WRAPPED).alias("_wrapped"), _tagged(F.col("_t")).alias("_tags"))
    found = []
    lines, wrapped = F.col("sentences"), F.col("_wrapped")
    for name, rule in RULES:
        p = _pattern(rule)
        found.append(F.when(lines.rlike(p) | wrapped.rlike(p), F.lit(name)))
        lines, wrapped = F.regexp_replace(lines, p, "<+>"), F.regexp_replace(wrapped, p, "<+>")
    out = out.withColumn("licences", F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(*found)), "_tags")), ","))
    n_all, n_unknown = F.regexp_count("sentences", F.lit("<")), F.regexp_count("sentences", F.lit("<[?]>"))
    return out.select("doc_id", "licences", "sentences", (n_all - n_unknown).cast("long").alias("n_known"), n_unknown.cast("long").alias("n_unknown"))


def scan_sql() -> str:
    """The same in DuckDB's SQL, over a view documents."""

    def sequence(ends: str) -> str:
        pairs = [(t, f"<{name}>") for name, texts in SENTENCES.items() for t in texts]
        known = "map([" + ", ".join(f"'{a}'" for a, _ in pairs) + "], [" + ", ".join(f"'{b}'" for _, b in pairs) + "])"
        plain = f"list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{ends}'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
        return f"coalesce(array_to_string(list_transform(list_filter({plain}, lambda s: regexp_matches(s, '{SPEAKS}')), lambda s: coalesce({known}[s], '<?>')), ''), '')"

    steps, cases, a, b = [], [], "sentences", "wrapped"
    for k, (name, rule) in enumerate(RULES):
        p = _pattern(rule)
        cases.append(f"case when regexp_matches(a{k}, '{p}') or regexp_matches(b{k}, '{p}') then '{name}' end")
        steps.append(f"r{k + 1} as (select *, regexp_replace(a{k}, '{p}', '<+>', 'g') as a{k + 1}, regexp_replace(b{k}, '{p}', '<+>', 'g') as b{k + 1} from r{k})")
    firsts = ", ".join(cases)
    return f"""
with r0 as (select doc_id, {sequence(ENDS)} as sentences, sentences as a0, {sequence(ENDS_WRAPPED)} as b0 from documents),
{", ".join(steps)},
f as (select *, list_filter([{firsts}], lambda x: x is not null) as found from r{len(RULES)}),
u as (select *, list_filter(found, lambda x, i: list_position(found, x) = i) as once from f)
select doc_id, coalesce(array_to_string(once, ','), '') as licences, sentences,
  cast(len(regexp_extract_all(sentences, '<[^?]')) as bigint) as n_known, cast(len(regexp_extract_all(sentences, '<[?]>')) as bigint) as n_unknown from u
"""
