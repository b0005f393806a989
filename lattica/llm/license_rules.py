"""Signature rules of the license scan, written by hand: priority, label, keyword and regex of each.

A rule is looked for only near its keyword, in lower-cased text whose white space
is single blanks.  Every match must hold its keyword and be shorter than
``REACH``.  ``-`` between words of a short name also stands for a blank where a
rule says ``[- ]``.
"""

from __future__ import annotations

import re

#: Longest match in characters.
REACH = 240

# One rule a line: priority | label | keyword | regex.  Notices and texts (70 to 80) outrank names with a version
# (60), these names without one (40), and these vague remarks (5 to 20).
_WRITTEN = r"""
70 | mit | permission is hereby granted, free | permission is hereby granted, free of charge, to any person obtaining a copy of this (?:software|font)
60 | mit | the above copyright notice | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies
60 | as-is | the software is provided | the software is provided ["“']?as is["”']?,? without warranty of any kind
70 | isc | permission to use, copy, modify, and | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
70 | hpnd | permission to use, copy, modify, and | permission to use, copy, modify,? and distribute this software and its documentation for any purpose
70 | bsd | redistribution and use in source | redistribution and use in source and binary forms,? with or without modification,? are permitted
75 | bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
75 | bsd-3-clause | endorse or promote products | (?:neither the name of .{1,80}? nor the names of its contributors may|may not) be used to endorse or promote products derived from this software
76 | bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display
70 | zlib | in no event will the authors | in no event will the authors be held liable for any damages arising from the use of this software
72 | zlib | altered source versions | altered source versions must be plainly marked as such
70 | bsl-1.0 | a copy of the software and accompanying | a copy of the software and accompanying documentation covered by this license
70 | unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
70 | wtfpl | do what the fuck | do what the fuck you want to(?: public license)?
70 | beerware | beer-ware | the beer-ware license
70 | apache-2.0 | licensed under the apache | licensed under the apache license,? version 2\.0 \(the ["“]license["”]\)
72 | apache-2.0 | apache.org/licenses | you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0
65 | apache-2.0 | apache.org/licenses | apache\.org/licenses/license-2\.0
65 | apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
70 | gpl-2.0-or-later | either version 2 of | it under the terms of the gnu general public license as published by the free software foundation[;,] either version 2 of the license,? or
70 | gpl-3.0-or-later | either version 3 of | it under the terms of the gnu general public license as published by the free software foundation[;,] either version 3 of the license,? or
71 | lgpl-2.1-or-later | either version 2.1 of | gnu lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license
71 | lgpl-3.0-or-later | either version 3 of | gnu lesser general public license as published by the free software foundation[;,] either version 3 of the license
71 | agpl-3.0-or-later | affero | gnu affero general public license as published by the free software foundation[;,] either version 3 of the license
69 | gpl-2.0-only | version 2 as published | under the terms of the gnu general public license version 2 as published by the free software foundation
50 | gpl | this program is free software | this program is free software[:;,] you can redistribute it and/or modify it
50 | lgpl | this library is free software | this library is free software[:;,] you can redistribute it and/or modify it
50 | gpl | you should have received a copy | you should have received a copy of the gnu general public license
52 | lgpl | you should have received a copy | you should have received a copy of the gnu lesser general public license
53 | agpl | you should have received a copy | you should have received a copy of the gnu affero general public license
45 | gpl | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl
45 | lgpl | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl
45 | agpl | gnu.org/licenses | gnu\.org/licenses/agpl
45 | gfdl | gnu.org/licenses | gnu\.org/licenses/fdl
70 | gfdl | permission is granted to copy | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
40 | gpl | gnu public license | gnu public licen[sc]e
40 | gpl | copyleft | gnu copyleft
70 | mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0
70 | mpl-1.1 | mozilla public license version | the contents of this file are subject to the mozilla public license version 1\.1
65 | mpl-2.0 | mozilla.org/mpl | mozilla\.org/mpl/2\.0
70 | epl-1.0 | eclipse public license | made available under the terms of the eclipse public license v1\.0
70 | epl-2.0 | eclipse public license | made available under the terms of the eclipse public license(?:,? v(?:ersion)?)? ?2\.0
70 | cddl-1.0 | common development and distribution | subject to the terms of the common development and distribution license
70 | ofl-1.1 | sil open font | this font software is licensed under the sil open font license,? version 1\.1
65 | ofl-1.1 | scripts.sil.org | scripts\.sil\.org/ofl
70 | ncsa | university of illinois | university of illinois/ncsa open source license
60 | ncsa | ncsa | \bncsa licen[sc]e
70 | python-2.0 | python software foundation license | python software foundation license version 2
70 | psf | beopen python | beopen python open source license agreement
70 | openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
60 | openssl | openssl license | openssl licen[sc]e
70 | x11 | x consortium | the name of the x consortium shall not be used
60 | x11 | x11 license | \bx11 licen[sc]e
70 | curl | curl | \bcurl licen[sc]e
70 | libpng | libpng | \blibpng licen[sc]e
70 | ijg | independent jpeg group | based in part on the work of the independent jpeg group
70 | freetype | freetype | (?:the )?freetype (?:project )?licen[sc]e
70 | imagemagick | imagemagick | \bimagemagick licen[sc]e
70 | vim | vim license | \bvim licen[sc]e
70 | ruby | ruby | \b(?:same terms as|the) ruby(?: licen[sc]e)?\b
70 | perl | same terms as perl | (?:under )?the same terms as perl(?: 5)? itself
70 | tcl | tcl/tk | \btcl/tk licen[sc]e
70 | json | for good, not evil | the software shall be used for good, not evil
70 | sleepycat | sleepycat | \bsleepycat licen[sc]e
70 | qpl-1.0 | q public license | \bq public licen[sc]e
70 | watcom-1.0 | sybase open watcom | sybase open watcom public licen[sc]e
70 | ipl-1.0 | ibm public license | \bibm public licen[sc]e
70 | apsl-2.0 | apple public source | apple public source licen[sc]e
70 | apsl-1.2 | apple public source | apple public source licen[sc]e,? v(?:ersion)? ?1\.2
70 | spl-1.0 | sun public license | \bsun public licen[sc]e
70 | sissl | sun industry standards | sun industry standards source licen[sc]e
70 | nokia | nokia open source | nokia open source licen[sc]e
70 | nasa-1.3 | nasa open source | nasa open source agreement
70 | rpl-1.5 | reciprocal public license | reciprocal public licen[sc]e
70 | upl-1.0 | universal permissive | universal permissive licen[sc]e
70 | mulan-psl-2.0 | mulan | mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?,? v(?:ersion)? ?2
70 | 0bsd | zero | zero[- ]clause bsd|bsd zero[- ]clause
68 | 0bsd | 0bsd | \b0bsd\b
70 | blueoak-1.0.0 | blue oak | blue oak model licen[sc]e
70 | hippocratic-2.1 | hippocratic | \bhippocratic licen[sc]e
70 | parity-7.0.0 | parity public | \bparity public licen[sc]e
70 | polyform-noncommercial | polyform | \bpolyform noncommercial licen[sc]e
70 | polyform-small-business | polyform | \bpolyform small business licen[sc]e
70 | polyform-shield | polyform | \bpolyform shield licen[sc]e
70 | commons-clause | commons clause | commons clause(?: licen[sc]e condition)?
70 | prosperity | prosperity public | prosperity public licen[sc]e
70 | openrail | openrail | \bopenrail(?:-[ms]|\+\+)?\b
70 | bigscience-rail | responsible ai license | responsible ai licen[sc]e
70 | llama-community | community license | llama [0-9.]{1,5} community licen[sc]e
70 | gemma-terms | terms of use | gemma terms of use
70 | ogl-3.0 | open government licence | open government licen[sc]e(?: v(?:ersion)? ?3\.0)?
70 | etalab-2.0 | licence ouverte | licence ouverte(?: / open licence)?
70 | etalab-2.0 | etalab | \betalab(?: licen[sc]e)?
70 | dl-de-by-2.0 | datenlizenz | datenlizenz deutschland(?: [-–] )?(?: ?namensnennung)?
70 | cc-pddc | public domain mark | public domain mark(?: 1\.0)?
70 | crown-copyright | crown copyright | © ?crown copyright|crown copyright (?:material|is reproduced)
70 | fal-1.3 | free art license | free art licen[sc]e
70 | gutenberg | project gutenberg | project gutenberg(?:-tm|™)? licen[sc]e
70 | cdla-permissive | community data license | community data licen[sc]e agreement[ -–]{0,3}permissive
70 | cdla-sharing | community data license | community data licen[sc]e agreement[ -–]{0,3}sharing
70 | opl-1.0 | open publication license | open publication licen[sc]e
70 | ogl-1.0a | open game license | open game licen[sc]e
70 | dfsl | design science license | design science licen[sc]e
70 | ms-pl | microsoft public license | this license governs use of the accompanying software
60 | ms-eula | microsoft software license | microsoft software licen[sc]e terms
60 | eula | user licen | end[- ]user licen[sc]e agreement
60 | eula | eula | \beula\b
60 | oracle-bcl | binary code license | oracle binary code licen[sc]e
60 | nvidia | nvidia software license | nvidia software licen[sc]e
60 | intel | intel simplified | intel simplified software licen[sc]e
60 | cc-by | attribution required | attribution required under cc
55 | cc-by | creative commons attribution | licensed under (?:a |the )?creative commons attribution
65 | cc-by-nc | no commercial use | no commercial use without (?:prior )?(?:written )?permission
60 | non-commercial | commercial use | for non[- ]commercial use only|non[- ]commercial use only
60 | non-commercial | non-commercial purposes | (?:only )?for non-commercial purposes(?: only)?
60 | academic-only | academic | for academic (?:and research )?(?:use|purposes) only
60 | research-only | research | for research (?:use|purposes) only
60 | evaluation-only | evaluation | for evaluation (?:use|purposes) only
60 | personal-use | personal use | for (?:your )?personal(?:, non-commercial)? use only
55 | no-derivatives | derivative works | (?:no|may not (?:create|make)|not create) derivative works
55 | no-redistribution | redistribut | (?:may|must|shall) not (?:be )?redistribut(?:e|ed)
55 | no-redistribution | redistribut | do not redistribute|not for redistribution|redistribution (?:is )?(?:prohibited|forbidden)
55 | no-reproduction | reproduc | (?:may|must|shall) not be reproduced
56 | no-reproduction | no part of this | no part of this (?:publication|book|work|document) may be reproduced
55 | no-training | machine learning | may not be used (?:to train|for training) (?:any )?machine learning
56 | no-training | text and data mining | text and data mining (?:rights )?(?:are )?reserved
55 | no-copying | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|software|document))?
55 | proprietary | proprietary | proprietary and confidential|confidential and proprietary
55 | proprietary | proprietary | proprietary (?:software|licen[sc]e|information)
55 | trade-secret | trade secret | contains? (?:proprietary )?trade secrets
50 | confidential | confidential | (?:strictly|company|internal) confidential|confidential(?: information)?:? do not distribute
50 | with-permission | with permission | (?:used|reprinted|reproduced) (?:here )?(?:with|by) (?:kind )?permission
50 | permission-required | permission | without (?:the )?(?:prior |express )(?:written )?(?:permission|consent) of
50 | public-domain | public domain | (?:in|into|to|of) the public domain
52 | public-domain | public domain | public domain dedication|dedicated to the public domain|released (?:in)?to the public domain
50 | public-domain | no rights reserved | no rights reserved
50 | public-domain | waive | waived all copyright and related
52 | some-rights | some rights reserved | some rights reserved
48 | free-use | free to use | free to use, (?:share|copy|modify)
48 | attribution | attribution | (?:with|requires?|requiring) (?:appropriate )?attribution
48 | share-alike | alike | share[- ]?alike
45 | mit | mit license | \bmit licen[sc]e\b
44 | mit | mit/x11 | mit/x11
44 | mit | mit-licensed | mit-licen[sc]ed
45 | isc | isc license | \bisc licen[sc]e\b
44 | bsd | bsd | \bbsd(?:[- ]style|[- ]type)? licen[sc]e\b
46 | bsd-2-clause | bsd | (?:2|two)[- ]clause bsd|bsd[- ](?:2|two)[- ]clause|simplified bsd|freebsd licen[sc]e
46 | bsd-3-clause | bsd | (?:3|three)[- ]clause bsd|bsd[- ](?:3|three)[- ]clause|(?:new|modified|revised) bsd
46 | bsd-4-clause | bsd | (?:4|four)[- ]clause bsd|bsd[- ](?:4|four)[- ]clause|original bsd
45 | zlib | zlib | \bzlib(?:/libpng)? licen[sc]e\b
44 | unlicense | unlicense | \bunlicense\b
44 | wtfpl | wtfpl | \bwtfpl\b
45 | cc0 | cc0 | \bcc0(?:[- ]1\.0)?\b
45 | cc0 | creativecommons.org/publicdomain | creativecommons\.org/publicdomain/zero
45 | cc-pddc | creativecommons.org/publicdomain | creativecommons\.org/publicdomain/mark
20 | cc | creative commons | creative commons licen[sc]e
10 | cc | creative commons | creative commons
90 | spdx | spdx-license-identifier | spdx-license-identifier: ?[a-z0-9.+-]{1,60}(?: (?:and|or|with) [a-z0-9.+-]{1,60})?
30 | spdx-copyright | spdx-filecopyrighttext | spdx-filecopyrighttext: ?[^ ]{1,100}
15 | copyright | copyright | copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}(?:[-–](?:19|20)?[0-9]{2})?
15 | copyright | (c) | \(c\) (?:19|20)[0-9]{2}
15 | copyright | © | © ?(?:19|20)[0-9]{2}(?:[-–](?:19|20)?[0-9]{2})?
12 | copyright | copyright | (?:all )?copyrights? (?:is |are )?(?:held|owned|reserved) by
12 | license-file | license | see (?:the )?(?:accompanying )?licen[sc]e(?:\.txt|\.md| file)?(?: for| in)
10 | licensed | licensed under | (?:dual[- ])?licensed under (?:the )?[a-z0-9]
10 | licensed | licenced under | licenced under (?:the )?[a-z0-9]
10 | licensed | under the terms of | (?:released|distributed|available|published) under the terms of (?:the )?[a-z0-9]
8 | licensed | released under | released under (?:the )?[a-z0-9]
8 | licensed | distributed under | distributed under (?:the )?[a-z0-9]
8 | licensed | available under | available under (?:the )?[a-z0-9]
"""

# Names that come in versions: label | keyword | regex of the name | versions.
_NUMBERED = r"""
apache | apache | apache (?:software )?licen[sc]e | 1.0 1.1 2.0
mpl | mozilla | mozilla public licen[sc]e | 1.0 1.1 2.0
epl | eclipse | eclipse public licen[sc]e | 1.0 2.0
cddl | common development | common development and distribution licen[sc]e | 1.0 1.1
eupl | european union | european union public licen[sc]e | 1.0 1.1 1.2
osl | open software | open software licen[sc]e | 1.0 2.0 2.1 3.0
afl | academic free | academic free licen[sc]e | 1.1 1.2 2.0 2.1 3.0
artistic | artistic | artistic licen[sc]e | 1.0 2.0
cpl | common public | common public licen[sc]e | 1.0
lppl | latex | latex project public licen[sc]e | 1.0 1.1 1.2 1.3
ofl | open font | (?:sil )?open font licen[sc]e | 1.0 1.1
bsl | boost | boost software licen[sc]e | 1.0
zpl | zope | zope public licen[sc]e | 1.1 2.0 2.1
ms-pl | microsoft | microsoft public licen[sc]e |
ms-rl | microsoft | microsoft reciprocal licen[sc]e |
odbl | database | open (?:data ?commons open )?database licen[sc]e | 1.0
odc-by | data commons | open data commons attribution licen[sc]e | 1.0
pddl | public domain dedication | public domain dedication and licen[sc]e | 1.0
npl | netscape | netscape public licen[sc]e | 1.0 1.1
ecl | educational community | educational community licen[sc]e | 1.0 2.0
cecill | cecill | cecill(?: free software)? licen[sc]e | 1.0 2.0 2.1
busl | business source | business source licen[sc]e | 1.1
sspl | server side | server side public licen[sc]e | 1.0
elastic | elastic | elastic licen[sc]e | 1.0 2.0
python | python software | python software foundation licen[sc]e | 2.0
php | php | php licen[sc]e | 3.0 3.01
openldap | openldap | openldap public licen[sc]e | 2.7 2.8
w3c | w3c | w3c software (?:notice and )?licen[sc]e |
unicode | unicode | unicode licen[sc]e |
"""

# The GNU family: label | keyword | regex of the long name | versions.
_GNU = r"""
gpl | general public | general public licen[sc]e | 1.0 2.0 3.0
lgpl | lesser general | lesser general public licen[sc]e | 2.1 3.0
lgpl | library general | library general public licen[sc]e | 2.0 2.1
agpl | affero general | affero general public licen[sc]e | 1.0 3.0
gfdl | free documentation | free documentation licen[sc]e | 1.1 1.2 1.3
"""

# Creative Commons: label | words between "creative commons" and the version.
_CC = r"""
by | attribution
by-sa | attribution[- ]share ?alike
by-nc | attribution[- ]non ?commercial
by-nd | attribution[- ]no ?deriv(?:ative)?s?
by-nc-sa | attribution[- ]non ?commercial[- ]share ?alike
by-nc-nd | attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s?
"""

_VERSION = r"(?:,? (?:version|v\.?) ?|[ -]v?)"
_LATER = {"only": r"(?: only|-only)", "or-later": r"(?: or (?:\(at your option\) )?(?:any )?later(?: version)?|-or-later|\+)"}


def _fields(table: str) -> list[list[str]]:
    return [[field.strip() for field in f"{line} ".split(" | ")] for line in table.strip().split("\n")]


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, regex) of all rules, the highest priority first."""
    out = [(int(priority), label, keyword, pattern) for priority, label, keyword, pattern in _fields(_WRITTEN)]
    for name, keyword, long, *versions in _fields(_NUMBERED):
        out.append((40, name, keyword, long))
        for version in " ".join(versions).split():
            number = version.replace(".0", "(?:.0)?").replace(".", r"\.")
            out += [(60, f"{name}-{version}", keyword, rf"{long}{_VERSION}{number}\b"), (60, f"{name}-{version}", f"{name}-", rf"\b{name}-{number}\b")]
    for name, keyword, long, versions in _fields(_GNU):
        rank = 40 if name == "gpl" else 50
        out += [(rank, name, keyword, long), (rank, name, name, rf"\b{name}\b")]
        for version in versions.split():
            number = version.replace(".0", "(?:.0)?").replace(".", r"\.")
            for form, word in ((long, keyword), (rf"\b{name}", name)):
                out.append((rank + 20, f"{name}-{version}", word, rf"{form}{_VERSION}{number}\b"))
                out += [(rank + 30, f"{name}-{version}-{kind}", word, rf"{form}{_VERSION}{number}{tail}") for kind, tail in _LATER.items()]
    for part, words in _fields(_CC):
        rank, short = 40 + 10 * part.count("-"), part.replace("-", "[- ]")
        forms = (("cc", rf"\bcc[- ]{short}", "[- ]"), ("creative commons", rf"creative commons {words}", " "), ("creativecommons.org/licenses", rf"creativecommons\.org/licenses/{part}/", ""))
        for keyword, form, between in forms:
            out.append((rank, f"cc-{part}", keyword, form if keyword.startswith("creative") else form + r"\b"))
            out += [(rank + 5, f"cc-{part}-{version}", keyword, rf"{form}{between}{version.replace('.', chr(92) + '.')}\b") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    out = list(dict.fromkeys(out))
    # both spellings of the noun hold the keyword's shorter form
    short = [(priority, label, keyword[: keyword.index("licen") + 5] if re.search("licen[sc]e$", keyword) else keyword, pattern) for priority, label, keyword, pattern in out]
    return sorted(short, key=lambda r: (-r[0], r[1], r[3]))
