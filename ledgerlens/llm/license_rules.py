"""Signatures of licenses, hand-written for texts of lower-case words with single spaces between them (operator 11).

``{v}`` stands for an optional "version" or "v" before a number. A rule is looked for only in texts that hold its keyword,
which is a part of whatever the rule can match.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Kinds of rules, the strongest first, and how much each is trusted.
KINDS = {"base": 0.9, "tag": 1.0, "text": 0.98, "grant": 0.95, "link": 0.85, "name": 0.8, "hint": 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    pattern: str


#: Fixed phrases of the base report.
BASE = [
    Rule("gpl", "base", "gnu general public license", "gnu general public license"),
    Rule("apache", "base", "apache license", "apache license"),
    Rule("cc-by", "base", "cc by", "cc by"),
    Rule("mit", "base", "mit license", "mit license"),
]

#: label | keyword of the name | name | short identifier | address
LICENSES = r"""
0bsd | zero clause bsd | zero clause bsd(?: license)? | 0bsd | opensource org licenses 0bsd
afl-2.1 | academic free license | academic free license{v}2 1 | afl 2 1 | opensource org licenses afl 2 1
afl-3.0 | academic free license | academic free license{v}3(?: 0)? | afl 3 0 | opensource org licenses afl 3 0
agpl-3.0 | affero | (?:gnu )?affero general public license{v}3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl(?: 3 0)?
apache-1.0 | apache | apache (?:software )?license{v}1 0 | apache 1 0 | apache org licenses license 1 0
apache-1.1 | apache | apache (?:software )?license{v}1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache (?:software )?license{v}2(?: 0)? | apache 2 0 | apache org licenses license 2 0
apsl-2.0 | apple public source | apple public source license{v}2(?: 0)? | apsl 2 0 | opensource apple com apsl
artistic-1.0 | artistic license | artistic license{v}1(?: 0)? | artistic 1 0(?: perl| cl8)? | opensource org licenses artistic 1 0
artistic-2.0 | artistic license | artistic license{v}2(?: 0)? | artistic 2 0 | opensource org licenses artistic 2 0
beerware | beerware | beerware(?: license)?(?: revision 42)? | beerware | people freebsd org phk
bsd-2-clause | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: license)? | bsd 2 clause(?: patent| views)? | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)? | bsd 3 clause(?: clear| lbnl| attribution)? | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: license)? | bsd 4 clause(?: uc)? | spdx org licenses bsd 4 clause
bsl-1.0 | boost software | boost software license(?:{v}1(?: 0)?)? | bsl 1 0 | boost org license 1 0
busl-1.1 | business source license | business source license(?:{v}1 1)? | busl 1 1 | mariadb com bsl11
bzip2-1.0.6 | bzip2 | bzip2(?: and libbzip2)? license(?:{v}1 0 6)? | bzip2 1 0 6 | sourceware org bzip2
cc-by-1.0 | cc by | cc by{v}1 0 | cc by 1 0 | creativecommons org licenses by 1 0
cc-by-2.0 | cc by | cc by{v}2 0 | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | cc by | cc by{v}2 5 | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-3.0 | cc by | cc by{v}3 0 | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | cc by | cc by{v}4 0 | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-nc-2.0 | cc by nc | cc by nc{v}2 0 | cc by nc 2 0 | creativecommons org licenses by nc 2 0
cc-by-nc-2.5 | cc by nc | cc by nc{v}2 5 | cc by nc 2 5 | creativecommons org licenses by nc 2 5
cc-by-nc-3.0 | cc by nc | cc by nc{v}3 0 | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | cc by nc | cc by nc{v}4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd{v}3 0 | cc by nc nd 3 0 | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd{v}4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa{v}3 0 | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa{v}4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nd-3.0 | cc by nd | cc by nd{v}3 0 | cc by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | cc by nd | cc by nd{v}4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-sa-2.5 | cc by sa | cc by sa{v}2 5 | cc by sa 2 5 | creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | cc by sa | cc by sa{v}3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa{v}4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc0-1.0 | cc0 | cc0(?:{v}1 0)?(?: universal)?(?: public domain dedication)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cddl-1.0 | common development and distribution | common development and distribution license(?:{v}1 0)? | cddl 1 0 | opensource org licenses cddl 1 0
cddl-1.1 | common development and distribution | common development and distribution license{v}1 1 | cddl 1 1 | glassfish java net public cddl 1 1
cecill-2.1 | cecill | cecill(?: free software)?(?: license)?{v}2 1 | cecill 2 1 | cecill info licences licence cecill v2 1
cpal-1.0 | common public attribution | common public attribution license(?:{v}1 0)? | cpal 1 0 | opensource org licenses cpal 1 0
cpl-1.0 | common public license | common public license(?:{v}1 0)? | cpl 1 0 | opensource org licenses cpl1 0
ecl-2.0 | educational community | educational community license(?:{v}2 0)? | ecl 2 0 | opensource org licenses ecl 2 0
epl-1.0 | eclipse public | eclipse public license{v}1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse public | eclipse public license{v}2(?: 0)? | epl 2 0 | eclipse org legal epl (?:v20|2 0)
eupl-1.1 | european union public | european union public licen[cs]e{v}1 1 | eupl 1 1 | joinup ec europa eu software page eupl
eupl-1.2 | european union public | european union public licen[cs]e{v}1 2 | eupl 1 2 | joinup ec europa eu collection eupl
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license{v}1 2 | gfdl 1 2(?: only| or later)? | gnu org licenses old licenses fdl 1 2
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license{v}1 3 | gfdl 1 3(?: only| or later)? | gnu org licenses fdl 1 3
gpl-1.0 | gnu general public license | gnu general public license{v}1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2.0 | gnu general public license | gnu general public license{v}2(?: 0)?(?: or (?:any )?later(?: version)?)? | gpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu general public license | gnu general public license{v}3(?: 0)?(?: or (?:any )?later(?: version)?)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
hpnd | historical permission notice | historical permission notice and disclaimer | hpnd | opensource org licenses hpnd
icu | icu license | icu license | icu | unicode org copyright
ijg | independent jpeg group | independent jpeg group(?: license)? | ijg | ijg org files readme
ipl-1.0 | ibm public license | ibm public license(?:{v}1 0)? | ipl 1 0 | opensource org licenses ibmpl
isc | isc license | isc license | isc | opensource org licenses isc
lgpl-2.0 | library general public license | (?:gnu )?library general public license{v}2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license{v}2 1(?: or (?:any )?later(?: version)?)? | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license{v}3(?: 0)?(?: or (?:any )?later(?: version)?)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl(?: 3 0)?
libpng | libpng | libpng license | libpng(?: 2 0)? | libpng org pub png src libpng license
lppl-1.3c | project public license | latex project public license(?:{v}1 3c)? | lppl 1 3c | latex project org lppl
mit-0 | mit no attribution | mit no attribution(?: license)? | mit 0 | opensource org licenses mit 0
mpl-1.1 | mozilla public license | mozilla public license{v}1 1 | mpl 1 1 | mozilla org mpl mpl 1 1
mpl-2.0 | mozilla public license | mozilla public license{v}2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
ms-pl | microsoft public license | microsoft public license | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal license | ms rl | opensource org licenses ms rl
mulanpsl-2.0 | mulan permissive | mulan permissive software license(?:{v}2)? | mulanpsl 2 0 | license coscl org cn mulanpsl2
ncsa | illinois ncsa | (?:university of )?illinois ncsa open source license | ncsa | opensource org licenses ncsa
nposl-3.0 | non profit open software | non profit open software license(?:{v}3 0)? | nposl 3 0 | opensource org licenses nposl 3 0
odbl-1.0 | open database license | open database license(?:{v}1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | open data commons attribution | open data commons attribution license(?:{v}1 0)? | odc by 1 0 | opendatacommons org licenses by
ofl-1.1 | sil open font | sil open font license(?:{v}1 1)? | ofl 1 1 | scripts sil org ofl
openssl | openssl | openssl license | openssl | openssl org source license
osl-3.0 | open software license | open software license{v}3(?: 0)? | osl 3 0 | opensource org licenses osl 3 0
pddl-1.0 | public domain dedication and license | public domain dedication and license(?:{v}1 0)? | pddl 1 0 | opendatacommons org licenses pddl
php-3.01 | php license | php license(?:{v}3 01)? | php 3 01 | php net license 3 01
postgresql | postgresql licen | postgresql licen[cs]e | postgresql | postgresql org about licence
psf-2.0 | python software foundation license | python software foundation license(?:{v}2)? | psf 2 0 | docs python org 3 license
qpl-1.0 | q public license | q public license(?:{v}1 0)? | qpl 1 0 | opensource org licenses qpl 1 0
rpl-1.5 | reciprocal public license | reciprocal public license(?:{v}1 5)? | rpl 1 5 | opensource org licenses rpl 1 5
sspl-1.0 | server side public license | server side public license(?:{v}1)? | sspl 1 0 | mongodb com licensing server side public license
unicode-3.0 | unicode license | unicode license(?:{v}3)? | unicode 3 0 | unicode org license
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
upl-1.0 | universal permissive | universal permissive license(?:{v}1 0)? | upl 1 0 | oss oracle com licenses upl
vim | vim license | vim license | vim | vimhelp org uganda
w3c | w3c software | w3c software(?: notice)?(?: and)?(?: document)? license | w3c | w3 org consortium legal
wtfpl | do what the fuck you want | do what the fuck you want to public license | wtfpl | wtfpl net
x11 | x11 license | x11 license | x11 | xfree86 org 3 3 6 copyright2
zlib | zlib license | zlib(?: libpng)? license | zlib(?: acknowledgement)? | opensource org licenses zlib
zpl-2.1 | zope public license | zope public license(?:{v}2 1)? | zpl 2 1 | opensource org licenses zpl 2 1
"""

#: label | keyword | sentence of the license's own text
TEXTS = r"""
mit | permission is hereby granted free of charge to any person | permission is hereby granted free of charge to any person obtaining a copy of this software
x11 | shall not be used in advertising | (?:the )?name of the x consortium shall not be used in advertising or otherwise to promote
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-3-clause | redistribution and use in source and binary forms | redistribution and use in source and binary forms(?: \S+){10,160}? neither the name of
bsd-2-clause | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | terms and conditions for use reproduction | terms and conditions for use reproduction and distribution
gpl | as published by the free software foundation | gnu general public license as published by the free software foundation
gpl-2.0 | as published by the free software foundation | gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-3.0 | as published by the free software foundation | gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-2.1 | as published by the free software foundation | gnu lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-3.0 | as published by the free software foundation | gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or (?:at your option )?any later version)?
agpl-3.0 | as published by the free software foundation | gnu affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or (?:at your option )?any later version)?
gpl | everyone is permitted to copy and distribute verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
mpl-2.0 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | made available under the terms of the eclipse public license | made available under the terms of the eclipse public license 2 0
epl-1.0 | made available under the terms of the eclipse public license | made available under the terms of the eclipse public license v1 0
bsl-1.0 | permission is hereby granted free of charge to any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
zlib | this software is provided as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want to | you just do what the fuck you want to
beerware | buy me a beer | you can buy me a beer in return
artistic-2.0 | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this license document(?: but)?(?: \S+){0,40}? artistic
cc0-1.0 | waived all copyright | (?:has )?waived all copyright and related or neighboring rights
cc-by | creative commons attribution | creative commons attribution(?: international)?(?: license)?
cc-by-4.0 | creative commons attribution 4 0 | creative commons attribution 4 0 international(?: public)?(?: license)?
cc-by-3.0 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa | creative commons attribution sharealike | creative commons attribution sharealike(?: license)?
cc-by-sa-3.0 | creative commons attribution share | creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 | creative commons attribution share | creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-nc | creative commons attribution noncommercial | creative commons attribution noncommercial(?: license)?
cc-by-nc-4.0 | creative commons attribution non | creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
cc-by-nc-sa-4.0 | creative commons attribution non | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0 | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s 4 0(?: international)?(?: license)?
ofl-1.1 | licensed under the sil open font | this font software is licensed under the sil open font license version 1 1
openssl | for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
psf-2.0 | python software foundation | psf license agreement for python(?: \S+)? python software foundation
ncsa | illinois | developed by(?: \S+){1,12}? university of illinois(?: \S+){0,10}? permission is hereby granted
public-domain | public domain | (?:released|placed|dedicated|put)(?: \S+){0,4}? (?:in|into|to) the public domain
"""

#: label | keyword | weak sign
HINTS = r"""
gpl-2.0 | gplv2 | gplv2
gpl-2.0 | gpl v2 | gpl v2
gpl-3.0 | gplv3 | gplv3
gpl-3.0 | gpl v3 | gpl v3
lgpl-2.1 | lgplv2 | lgplv2 1
lgpl-3.0 | lgplv3 | lgplv3
agpl-3.0 | agplv3 | agplv3
gpl | gnu gpl | gnu gpl
lgpl | gnu lgpl | gnu lgpl
agpl | gnu agpl | gnu agpl
lgpl | lesser general public license | (?:gnu )?lesser general public license
agpl | affero | (?:gnu )?affero general public license
gfdl | free documentation license | (?:gnu )?free documentation license
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
bsd | bsd license | bsd license
bsd | bsd style | bsd style license
artistic | artistic license | artistic license
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
mit | mit style | mit style license
mit | expat license | expat license
apache-2.0 | asl 2 0 | asl 2 0
eupl | european union public | european union public licen[cs]e
all-rights-reserved | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
proprietary | unauthorized copying of this file | unauthorized copying of this file(?: via any medium)?(?: is strictly prohibited)?
public-domain | public domain mark | public domain mark(?: 1 0)?
non-commercial | non commercial use only | (?:for )?non ?commercial use only
"""

_VERSION = "(?: version)? v?"
_GRANT = "(?:licensed|released|distributed|redistributed|available|published|provided|covered|offered|usable) under (?:the )?(?:terms of (?:the )?)?(?:the )?"


def _rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def _rules() -> list[Rule]:
    found = list(BASE)
    for label, keyword, name, short, address in _rows(LICENSES):
        name = name.replace("{v}", _VERSION)
        found += [
            Rule(label, "tag", "spdx license identifier", f"spdx license identifier {short}"),
            Rule(label, "grant", keyword, _GRANT + name),
            Rule(label, "link", " ".join(address.split(" ")[:2]), address),
            Rule(label, "name", keyword, name),
        ]
    found += [Rule(label, "text", keyword, text) for label, keyword, text in _rows(TEXTS)]
    found += [Rule(label, "hint", keyword, text) for label, keyword, text in _rows(HINTS)]
    return sorted(found, key=lambda r: list(KINDS).index(r.kind))


#: All rules, the strongest kinds first; a rule's place is its priority.
RULES = _rules()
