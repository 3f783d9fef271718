"""License scans by ordered signature rules.

A rule is a regular expression over a text's words (joined by single spaces), with a label,
a priority and keywords. Rules run only in texts that hold one of their keywords as a word,
which few texts do. Of overlapping detections, one whose interval lies within another's of at
least its priority is suppressed; among equal intervals the higher priority stays, then the
earlier rule. Signatures of license texts, notices and tags are written out; names and versions
of license families, and the forms in which notices cite them, are multiplied out.

Defined cases: a null or empty text has no words, no places and score 0; a text without
detections has empty label lists; repeated rows are scanned one by one; an empty table gives
no rows; other columns are neither read nor returned. Texts are scanned whole; a very long
one costs a string of its own size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: str
    priority: int
    weight: float

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern)


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ]){pattern}(?![^ ])")


#: Phrases whose places are counted, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
_LICENSE = "licen[sc]e"
#: License families as (label, name patterns, versions, keyword). A version is
#: (suffix of the label, pattern).
FAMILIES = (
    ("gpl", (rf"gnu general public {_LICENSE}", rf"general public {_LICENSE}", "gnu gpl", "gpl"), (("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?"), ("3.0", "3(?: 0)?")), "gpl gnu general"),
    ("lgpl", (rf"gnu lesser general public {_LICENSE}", rf"gnu library general public {_LICENSE}", rf"lesser general public {_LICENSE}", "gnu lgpl", "lgpl"), (("2.0", "2(?: 0)?"), ("2.1", "2 1"), ("3.0", "3(?: 0)?")), "lgpl lesser library"),
    ("agpl", (rf"gnu affero general public {_LICENSE}", rf"affero general public {_LICENSE}", "gnu agpl", "agpl"), (("1.0", "1(?: 0)?"), ("3.0", "3(?: 0)?")), "agpl affero"),
    ("fdl", (rf"gnu free documentation {_LICENSE}", rf"free documentation {_LICENSE}", "gfdl"), (("1.1", "1 1"), ("1.2", "1 2"), ("1.3", "1 3")), "documentation gfdl"),
    ("apache", (rf"apache software {_LICENSE}", rf"apache {_LICENSE}", "apache"), (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?")), "apache"),
    ("mpl", (rf"mozilla public {_LICENSE}", "mpl"), (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?")), "mozilla mpl"),
    ("epl", (rf"eclipse public {_LICENSE}", "epl"), (("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?")), "eclipse epl"),
    ("cddl", (rf"common development and distribution {_LICENSE}", "cddl"), (("1.0", "1 0"), ("1.1", "1 1")), "development cddl"),
    ("cpl", (rf"common public {_LICENSE}",), (("1.0", "1 0"),), "common"),
    ("eupl", (rf"european union public {_LICENSE}", "eupl"), (("1.0", "1 0"), ("1.1", "1 1"), ("1.2", "1 2")), "european eupl"),
    ("artistic", (rf"artistic {_LICENSE}",), (("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?")), "artistic"),
    ("boost", (rf"boost software {_LICENSE}",), (("1.0", "1 0"),), "boost"),
    ("busl", (rf"business source {_LICENSE}",), (("1.1", "1 1"),), "business"),
    ("ofl", (rf"sil open font {_LICENSE}", rf"open font {_LICENSE}"), (("1.0", "1 0"), ("1.1", "1 1")), "font"),
    ("odbl", (rf"open database {_LICENSE}", "odbl"), (("1.0", "1 0"),), "database odbl"),
    ("osl", (rf"open software {_LICENSE}",), (("1.0", "1 0"), ("2.0", "2 0"), ("3.0", "3 0")), "software"),
    ("afl", (rf"academic free {_LICENSE}",), (("2.1", "2 1"), ("3.0", "3 0")), "academic"),
    ("zpl", (rf"zope public {_LICENSE}",), (("2.0", "2 0"), ("2.1", "2 1")), "zope"),
    ("psf", (rf"python software foundation {_LICENSE}", rf"psf {_LICENSE}"), (("2.0", "2(?: 0)?"),), "python psf"),
    ("php", (rf"php {_LICENSE}",), (("3.0", "3 0"), ("3.01", "3 01")), "php"),
    ("bsd", (rf"bsd {_LICENSE}", rf"bsd style {_LICENSE}", "berkeley software distribution"), (), "bsd berkeley"),
    ("bsd-2-clause", (rf"(?:simplified|freebsd|2 clause) bsd(?: {_LICENSE})?", "bsd 2 clause"), (), "bsd"),
    ("bsd-3-clause", (rf"(?:new|modified|revised|3 clause) bsd(?: {_LICENSE})?", "bsd 3 clause"), (), "bsd"),
    ("isc", (rf"isc {_LICENSE}",), (), "isc"),
    ("mit", (rf"mit x11 {_LICENSE}", rf"expat {_LICENSE}", rf"mit {_LICENSE}"), (), "mit expat"),
    ("zlib", (rf"zlib(?: libpng)? {_LICENSE}",), (), "zlib"),
    ("unlicense", (r"the unlicen[sc]e", "unlicense org"), (), "unlicense unlicence"),
    ("wtfpl", ("wtfpl", rf"do what the fuck you want to public {_LICENSE}"), (), "wtfpl fuck"),
    ("cc0", ("cc0", "creative commons zero"), (("1.0", "1 0"),), "cc0 zero"),
)
#: How a notice leads to a license's name, with the weight of such a match.
LEADS = (
    (rf"(?:is|are) (?:released|distributed|published|made available|licensed|provided) under (?:the )?(?:terms of )?(?:the )?", 1.0),
    (r"licensed under (?:the )?", 0.95),
    (r"(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?", 0.9),
    (r"spdx license identifier ", 1.0),
)
#: The elements and versions of one attribution family.
CC_ELEMENTS = (("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("by-sa", "by sa", "attribution share ?alike"), ("by", "by", "attribution"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Signatures of license texts, notices and tags as (label, keywords, weight, pattern).
SIGNATURES = tuple(
    (label, keywords, float(weight), pattern)
    for label, keywords, weight, pattern in (line.split("|", 3) for line in r"""
mit|hereby|1.0|permission is hereby granted free of charge to any person obtaining a copy
mit|notice|0.9|the above copyright notice and this permission notice shall be included in all copies
mit|merchantability|0.6|including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit|sublicense|0.8|to use copy modify merge publish distribute sublicense and or sell copies of the software
mit-0|hereby|0.9|permission is hereby granted free of charge .{0,400}sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit|mit|0.8|(?:released|available|distributed) under mit
mit|mit|0.9|license mit
mit|mit|0.8|mit licensed
x11|x11|0.8|x11 license
x11|consortium|0.9|except as contained in this notice the name of the x consortium shall not be used
bsd|redistribution|1.0|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions|0.9|redistributions of source code must retain the above copyright notice
bsd|redistributions|0.9|redistributions in binary form must reproduce the above copyright notice
bsd-3-clause|contributors|0.9|neither the name of .{1,80} nor the names of its contributors
bsd-3-clause|endorse|0.9|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|advertising|1.0|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear|patent|0.9|no express or implied licenses to any party s patent rights are granted by this license
bsd-2-clause-patent|patent|0.9|subject to the terms and conditions of this license each copyright holder and contributor hereby grants .{0,120}patent license
bsd|bsd|0.8|bsd licensed
bsd|bsd|0.9|license bsd
bsd-0|0bsd zero|0.9|(?:0bsd|zero clause bsd(?: license)?)
isc|purpose|1.0|permission to use copy modify and or distribute this software for any purpose
isc|fee|0.9|with or without fee is hereby granted provided that the above copyright notice
gpl|redistribute|1.0|this program is free software you can redistribute it and or modify it under the terms
gpl|received|1.0|you should have received a copy of the gnu general public license
gpl|hope|0.8|distributed in the hope that it will be useful but without any warranty
gpl|copyleft|0.6|copyleft license for software and other kinds of works
gpl|gpl|0.8|gpl licensed
gpl|gpl|0.9|license gpl
gpl-2.0-only|gpl|0.95|gpl 2 0 only
gpl-2.0-or-later|gpl|0.95|gpl 2 0 or later
gpl-3.0-only|gpl|0.95|gpl 3 0 only
gpl-3.0-or-later|gpl|0.95|gpl 3 0 or later
gpl-2.0|gplv2|0.9|gplv2
gpl-2.0-or-later|gplv2|0.95|gplv2 (?:or later|plus)
gpl-3.0|gplv3|0.9|gplv3
gpl-3.0-or-later|gplv3|0.95|gplv3 (?:or later|plus)
gpl-1.0|gplv1|0.9|gplv1
gpl-2.0-or-later|version|0.95|either version 2 of the license or at your option any later version
gpl-3.0-or-later|version|0.95|either version 3 of the license or at your option any later version
gpl-2.0|preamble|0.9|the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0|practical|0.9|the licenses for most software and other practical works are designed to take away your freedom
gpl-classpath|classpath|0.9|gpl(?: 2 0)? with classpath exception
gpl-classpath|linking|0.9|linking this library statically or dynamically with other modules is making a combined work
gpl-autoconf|configure|0.8|this configure script is free software the free software foundation gives unlimited permission
gpl-gcc|runtime|0.9|gcc runtime library exception
lgpl|library|1.0|this library is free software you can redistribute it and or modify it under the terms
lgpl|received|1.0|you should have received a copy of the gnu (?:lesser|library) general public license
lgpl-2.1|lgplv2|0.9|lgplv2(?: 1)?
lgpl-3.0|lgplv3|0.9|lgplv3
lgpl-2.1-only|lgpl|0.95|lgpl 2 1 only
lgpl-2.1-or-later|lgpl|0.95|lgpl 2 1 or later
lgpl-3.0-or-later|lgpl|0.95|lgpl 3 0 or later
agpl-3.0|agplv3|0.9|agplv3
agpl-3.0-only|agpl|0.95|agpl 3 0 only
agpl-3.0-or-later|agpl|0.95|agpl 3 0 or later
agpl-3.0|remotely|0.9|if you modify the program your modified version must prominently offer all users interacting with it remotely
sspl-1.0|sspl side|0.9|(?:sspl(?: 1 0)?|server side public license)
fdl|invariant|1.0|with no invariant sections no front cover texts and no back cover texts
fdl|document|0.9|permission is granted to copy distribute and or modify this document under the terms
apache-2.0|applicable|1.0|unless required by applicable law or agreed to in writing software distributed under the license
apache-2.0|basis|0.9|distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0|obtain|0.9|you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-2.0|asf|0.9|licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0|asl apache2|0.8|(?:asl 2 0|apache2)
apache-2.0|apache|0.9|license apache 2 0
apache-1.1|acknowledgment|0.9|this product includes software developed by the apache software foundation
apache-2.0-llvm|llvm|0.95|apache 2 0 with llvm exception
mpl-2.0|mozilla|1.0|this source code form is subject to the terms of the mozilla public license
mpl-2.0|mpl|0.9|if a copy of the mpl was not distributed with this file you can obtain one
mpl-1.1|mozilla|1.0|the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1|triple tri|0.8|(?:mpl gpl lgpl (?:triple|tri) license|tri licensed under the mpl)
npl-1.1|netscape|0.9|netscape public license(?: version)? 1 1
epl-2.0|eclipse|0.9|this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0|eclipse|0.9|made available under the terms of the eclipse public license v1 0
cddl-1.0|cddl|0.9|the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0|ibm|0.8|ibm public license
ipl-1.0|ipl|0.8|ibm public license(?: version)? 1 0
eupl-1.2|eupl|0.9|licensed under the eupl(?: version)? 1 2
cecill|cecill|0.9|cecill(?: license)?
cecill-b|cecill|0.95|cecill b(?: license)?
cecill-c|cecill|0.95|cecill c(?: license)?
artistic|artistic|0.9|the artistic license
artistic-perl|perl|0.9|same terms as perl(?: itself)?
perl|perl|0.8|under the same terms as the perl 5 programming language
boost|boost|1.0|distributed under the boost software license version 1 0
boost|machine|0.9|solely in the form of machine executable object code generated by a source language processor
busl|licensor|0.9|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl|change|0.8|change license .{0,60}change date
elastic-2.0|elastic|0.9|elastic license(?: 2 0)?
commons-clause|commons|0.9|commons clause(?: license condition)?
commons-clause|sell|0.9|the grant of rights under the license will not include .{0,60}the right to sell the software
polyform|polyform|0.9|polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use)(?: license)?
confluent|confluent|0.9|confluent community license
redis|redis|0.9|redis source available license
timescale|timescale|0.9|timescale license
ofl|font|1.0|this font software is licensed under the sil open font license
ofl|reserved|0.8|with reserved font name
odbl|database|1.0|open database license
odc-by|odc|0.9|(?:odc by|open data commons attribution license)
pddl|pddl dedication|0.9|(?:pddl|public domain dedication and license)
osl|open|0.7|open software license
osl-3.0|osl|0.9|osl 3 0
afl-3.0|afl|0.9|afl 3 0
zpl|zope|0.9|zope public license zpl
psf|psf|0.9|psf license agreement
psf|python|0.9|python software foundation license version 2
cnri|cnri|0.8|cnri (?:open source )?license agreement
php|php|0.9|this product includes php software freely available from
ruby|ruby|0.9|ruby license
ruby|ruby|0.8|same (?:license|terms) as ruby
vim|vim|0.9|vim license
vim|vim|0.8|vim is charityware
tcl|tcl|0.8|tcl tk license
zlib|warranty|0.7|this software is provided as is without any express or implied warranty
zlib|misrepresented|1.0|the origin of this software must not be misrepresented
zlib|altered|0.9|altered source versions must be plainly marked as such
libpng|libpng|0.9|libpng license
libtiff|leffler|0.9|the names of sam leffler and silicon graphics may not be used
ijg|jpeg|0.9|independent jpeg group(?: s software)?
curl|curl|0.8|curl license
openssl|openssl|0.9|openssl license
openssl|openssl|0.9|this product includes software developed by the openssl project
ssleay|cryptographic|0.9|this product includes cryptographic software written by eric young
unlicense|unencumbered|1.0|this is free and unencumbered software released into the public domain
wtfpl|fuck|1.0|you just do what the fuck you want to
beerware|beer|0.9|(?:beerware|beer ware)(?: license)?
beerware|beer|0.9|buy me a beer in return
jsonlicense|evil|1.0|the software shall be used for good not evil
postgresql|postgresql|0.9|postgresql license
ncsa|ncsa|0.9|university of illinois ncsa open source license
upl-1.0|upl|0.9|universal permissive license(?: upl)?
ms-pl|microsoft|0.9|microsoft public license(?: ms pl)?
ms-rl|microsoft|0.9|microsoft reciprocal license(?: ms rl)?
ms-pl|ms|0.8|ms pl
ms-limited|limited|0.7|microsoft limited public license
blueoak-1.0.0|blue|0.9|blue oak model license(?: 1 0 0)?
mulan-2.0|mulan|0.9|mulan (?:psl|permissive software license)(?: v?2)?
nasa-1.3|nasa|0.9|nasa open source agreement
sgi-b-2.0|sgi|0.9|sgi free software license b
qpl-1.0|qpl|0.9|(?:q public license|qpl)(?: version)?(?: 1 0)?
rpl-1.5|reciprocal|0.9|reciprocal public license
cpal-1.0|cpal|0.9|common public attribution license
watcom|watcom|0.8|sybase open watcom public license
apsl-2.0|apple|0.9|apple public source license
apple-sample|apple|0.7|apple inc grants you a personal non exclusive license
intel|intel|0.7|intel simplified software license
nvidia|nvidia|0.7|nvidia software license agreement
oracle|oracle|0.8|oracle binary code license
oracle|otn|0.8|otn development license
sun|sun|0.8|sun (?:binary code|community source|public) license
w3c|w3c|0.9|w3c software(?: notice and)?(?: document)? license
unicode|unicode|0.9|unicode (?:inc )?license agreement(?: data files and software)?
icu|icu|0.8|icu license
latex|lppl latex|0.9|(?:lppl|latex project public license)
tex|knuth|0.6|knuth license
ecl-2.0|educational|0.9|educational community license
efl-2.0|eiffel|0.8|eiffel forum license
entessa|entessa|0.8|entessa public license
fair|fair|0.6|fair license
naist|naist|0.8|naist license
ogl-uk|ogl government|0.9|(?:ogl|open government licen[sc]e)(?: v?\d(?: 0)?)?
crown|crown|0.7|crown copyright
etalab-2.0|etalab|0.9|licence ouverte(?: etalab)?
dl-de|datenlizenz|0.9|datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?
gfdl|gfdl|0.9|gfdl(?: 1 [123])?
openrail|openrail|0.9|(?:creativeml )?open ?rail(?: [msd]+)?(?: license)?
llama|llama|0.9|llama \d(?: \d)? community license(?: agreement)?
gemma|gemma|0.8|gemma terms of use
rail|responsible|0.8|responsible ai license
cc|creative|0.7|creative commons(?: public)? licen[sc]e
cc|creative|0.6|some rights reserved .{0,80}creative commons
cc|creativecommons|0.9|creativecommons org licenses
cc-by|creativecommons|0.95|creativecommons org licenses by(?: \d \d)?
cc-by-sa|creativecommons|0.95|creativecommons org licenses by sa(?: \d \d)?
cc-by-nc|creativecommons|0.95|creativecommons org licenses by nc(?: \d \d)?
cc-by-nd|creativecommons|0.95|creativecommons org licenses by nd(?: \d \d)?
cc-by-nc-sa|creativecommons|0.95|creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc-nd|creativecommons|0.95|creativecommons org licenses by nc nd(?: \d \d)?
cc0|creativecommons|0.95|creativecommons org publicdomain zero(?: \d \d)?
cc0|waive|0.9|the person who associated a work with this deed has dedicated the work to the public domain
public-domain|domain|0.8|(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain|domain|0.4|public domain
public-domain|disclaims|0.9|the author (?:hereby )?disclaims copyright to this source code
proprietary|reserved|0.4|all rights reserved
proprietary|proprietary|0.6|confidential and proprietary
proprietary|proprietary|0.6|proprietary (?:and confidential|software|information)
proprietary|unauthorized|0.6|unauthorized (?:copying|reproduction|distribution|use) .{0,60}prohibited
proprietary|eula|0.5|end user license agreement
proprietary|trade|0.5|contains trade secrets
shareware|shareware|0.5|shareware
freeware|freeware|0.5|freeware
non-commercial|commercial|0.6|(?:for|free for) non ?commercial use only
non-commercial|personal|0.6|free for personal use
research-only|research|0.6|for research purposes only
evaluation-only|evaluation|0.5|for evaluation (?:purposes )?only
warranty|warranty|0.3|without warranty of any kind
warranty|liable|0.3|in no event shall the (?:authors|copyright holders?|contributors)(?: or copyright holders)? be liable
copyright|copyright|0.3|copyright (?:c )?(?:19|20)\d\d
copyright|copyrighted|0.3|copyrighted (?:material|work)
""".strip().splitlines())
)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order: base phrases, sentences, then the families' forms."""
    out = [Rule(label, phrase, phrase.split()[0], 10, 0.8) for phrase, label in BASE]
    out += [Rule(label, pattern, keywords, 30, weight) for label, keywords, weight, pattern in SIGNATURES]

    def forms(label: str, name: str, keywords: str, priority: int, weight: float):
        out.append(Rule(label, name, keywords, priority, weight))
        out.extend(Rule(label, lead + name, keywords, priority + 10, w) for lead, w in LEADS)

    for family, names, versions, keywords in FAMILIES:
        for name in names:
            if " " in name:
                forms(family, name, keywords, 10, 0.7)
            for suffix, number in versions:
                forms(f"{family}-{suffix}", rf"{name} (?:version |v ?)?{number}(?: or later| only)?", keywords, 20, 0.9)
    for element, code, long in CC_ELEMENTS:
        forms(f"cc-{element}", f"cc {code}", "cc", 10, 0.7)
        forms(f"cc-{element}", rf"creative commons {long}(?: {_LICENSE})?", "creative", 10, 0.7)
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            forms(f"cc-{element}-{version}", f"cc {code} {number}", "cc", 20, 0.9)
            forms(f"cc-{element}-{version}", rf"creative commons {long}(?: {_LICENSE})?(?: version)? {number}", "creative", 20, 0.9)
    return tuple(out)


@cache
def _by_keyword() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for keyword in r.keywords.split():
            out.setdefault(keyword, []).append(i)
    return out


@dataclass(frozen=True)
class Detection:
    start: int  # in the joined words
    end: int
    rule: int


def detect(words: list[str]) -> tuple[str, list[Detection]]:
    """The joined words and every match of every rule whose keyword is among them."""
    keys = _by_keyword()
    if keys.keys().isdisjoint(words):
        return "", []
    joined, out = " ".join(words), []
    for keyword in keys.keys() & set(words):
        for i in keys[keyword]:
            out.extend(Detection(*m.span(), i) for m in rules()[i].regex.finditer(joined))
    return joined, out


def resolved(found: list[Detection]) -> list[Detection]:
    """Detections not contained in one of at least their priority.

    By start, longest first, a detection is covered if some earlier one of at least its
    priority ends no sooner; the furthest end so far of each priority is enough to tell.
    """
    furthest: dict[int, int] = {}
    kept = []
    for d in sorted(set(found), key=lambda d: (d.start, -d.end, -rules()[d.rule].priority, d.rule)):
        priority = rules()[d.rule].priority
        if not any(p >= priority and end >= d.end for p, end in furthest.items()):
            kept.append(d)
        furthest[priority] = max(furthest.get(priority, -1), d.end)
    return kept


def scan(text: str) -> dict:
    """All results of a text; ``detections`` are (first word, words, label, weight)."""
    words = WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    joined, found = detect(words)
    base = sorted({d.start for d in found if d.rule < len(BASE)})
    starts = list(accumulate((len(w) + 1 for w in words), initial=0)) if found else []
    spaces = lambda at: bisect_right(starts, at) - 1
    places = [spaces(at) for at in base]
    base_labels = {rules()[d.rule].label for d in found if d.rule < len(BASE)}
    kept = resolved(found)
    labels = base_labels | {rules()[d.rule].label for d in kept}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": places[0] if places else None,
        "last_word": places[-1] if places else None,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels)),
        "score": max((rules()[d.rule].weight for d in kept), default=0.0),
        "detections": [(spaces(d.start), spaces(d.end) - spaces(d.start) + 1, rules()[d.rule].label, rules()[d.rule].weight) for d in kept],
    }


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, rows_of) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        return rows_of(batch.column(0), [scan(t) for t in texts_of(batch)])

    return map_rows(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kinds = ("bigint", "bigint", "bigint", "bigint", "string", "string", "double")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return _mapped(docs, id_col, text_col, schema, lambda ids, found: {"id": ids} | {n: [f[n] for f in found] for n in names})


def license_detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words, label, weight) of every detection that stays."""

    def rows_of(ids, found):
        flat = [(i, *d) for i, f in zip(ids.to_pylist(), found, strict=True) for d in f["detections"]]
        return dict(zip(("id", "first", "n", "label", "weight"), [list(c) for c in zip(*flat, strict=True)] or [[]] * 5, strict=True))

    return _mapped(docs, id_col, text_col, "first_word bigint, n_words bigint, label string, weight double", rows_of)
