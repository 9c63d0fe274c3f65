"""The signature rules of the licence scan: hand-written expressions over a text's lower-cased words, and references by name.

A signature is a line ``label ; priority ; keyword ; expression``.  The keyword is a run of words that every match holds, so
that a text without it need not be searched.  ``{l}`` stands for both spellings of licence, ``{v}`` for a version number.
"""

from __future__ import annotations

from functools import cache

#: Sentences of licence bodies (9), notices and titles (8), identifiers (7).
SIGNATURES = r"""
mit ; 9 ; permission is hereby granted free of charge ; permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?
mit ; 6 ; permission is hereby granted free of charge ; permission is hereby granted free of charge
mit ; 9 ; shall be included in all copies or substantial portions ; (?:the above copyright notice and this permission notice )?shall be included in all copies or substantial portions(?: of the software)?
mit ; 7 ; without limitation the rights to use copy modify merge ; without limitation the rights to use copy modify merge(?: publish distribute sublicense and or sell)?
mit ; 8 ; the mit ; the mit {l} mit
mit-0 ; 8 ; mit no attribution ; mit no attribution(?: {l})?
x11 ; 9 ; except as contained in this notice the ; except as contained in this notice the names? of (?:\S+ ){1,6}shall not be used in advertising
isc ; 9 ; permission to use copy modify and ; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd ; 9 ; permission to use copy modify ; permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
0bsd ; 9 ; for any purpose with or without fee ; permission to use copy modify and or distribute this software for any purpose with or without fee
0bsd ; 8 ; zero clause ; (?:bsd )?zero clause(?: bsd)?(?: {l})?
bsd ; 9 ; redistribution and use in source and binary forms ; redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd ; 6 ; redistribution and use in source and binary forms ; redistribution and use in source and binary forms
bsd ; 8 ; redistributions of source code must retain ; redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?
bsd ; 8 ; redistributions in binary form must reproduce ; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause ; 9 ; may be used to endorse or promote products ; neither the names? (?:\S+ ){1,12}may be used to endorse or promote products derived from this software
bsd-4-clause ; 9 ; all advertising materials mentioning features ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear ; 8 ; clear bsd ; clear bsd {l}
bsd-3-clause-clear ; 9 ; no express or implied licenses to any party ; no express or implied licenses to any party s patent rights are granted by this {l}
bsd-2-clause-patent ; 8 ; bsd 2 clause plus patent ; bsd 2 clause plus patent {l}
bsd ; 8 ; berkeley software distribution ; berkeley software distribution(?: {l})?
apache-2.0 ; 9 ; licensed under the apache ; licensed under the apache {l} version 2(?: 0)? the {l} you may not use this file except in compliance with the {l}
apache-2.0 ; 8 ; you may not use this file except in compliance with the ; you may not use this file except in compliance with the {l}
apache-2.0 ; 8 ; apache ; apache {l} version 2(?: 0)?(?: january 2004)?
apache-2.0 ; 7 ; apache 2 0 ; apache 2 0(?: {l})?
apache-2.0 ; 8 ; unless required by applicable law or agreed to in writing ; unless required by applicable law or agreed to in writing software distributed under the {l} is distributed on an as is basis
apache-2.0 ; 9 ; www apache org licenses ; https? www apache org licenses {l} 2 0(?: txt)?
apache-1.1 ; 8 ; apache ; apache (?:software )?{l} version 1 1
apache-1.1 ; 9 ; this product includes software developed by the apache ; this product includes software developed by the apache (?:software foundation|group)
gpl ; 9 ; this program is free software you can redistribute it ; this program is free software you can redistribute it and or modify it under the terms of the gnu general public {l}(?: as published by the free software foundation)?
gpl ; 6 ; you can redistribute it and or modify it ; you can redistribute it and or modify it under the terms of
gpl-1.0 ; 8 ; general public ; (?:gnu )?general public {l} version 1
gpl-2.0 ; 8 ; general public ; (?:gnu )?general public {l}(?: version)? v?2(?: 0)?(?: june 1991)?(?: only)?
gpl-2.0+ ; 8 ; general public ; (?:gnu )?general public {l}(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?(?: of the {l})? or (?:at your option )?any later version
gpl-3.0 ; 8 ; general public ; (?:gnu )?general public {l}(?: version)? v?3(?: 0)?(?: 29 june 2007)?(?: only)?
gpl-3.0+ ; 8 ; general public ; (?:gnu )?general public {l}(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?(?: of the {l})? or (?:at your option )?any later version
gpl ; 9 ; you should have received a copy of the gnu general public ; you should have received a copy of the gnu general public {l}(?: along with this program)?
gpl ; 9 ; www gnu org licenses gpl ; https? www gnu org licenses gpl(?: \d \d)?(?: html| txt)?
gpl ; 8 ; everyone is permitted to copy and distribute verbatim copies ; everyone is permitted to copy and distribute verbatim copies of this {l} document but changing it is not allowed
gpl ; 8 ; gnu gpl ; gnu gpl(?: {v})?
gpl-2.0 ; 7 ; gplv2 ; gplv2(?: only)?
gpl-2.0+ ; 8 ; gplv2 ; gplv2 (?:or later|plus)
gpl-3.0 ; 7 ; gplv3 ; gplv3(?: only)?
gpl-3.0+ ; 8 ; gplv3 ; gplv3 (?:or later|plus)
gpl-2.0 ; 7 ; gpl 2 0 ; gpl 2 0(?: only)?
gpl-2.0+ ; 8 ; gpl 2 0 or later ; gpl 2 0 or later
gpl-3.0 ; 7 ; gpl 3 0 ; gpl 3 0(?: only)?
gpl-3.0+ ; 8 ; gpl 3 0 or later ; gpl 3 0 or later
gpl-classpath ; 8 ; classpath exception ; (?:with )?(?:the )?(?:gnu )?classpath exception
gpl-classpath ; 9 ; linking this library statically or dynamically ; linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception ; 8 ; gcc runtime library exception ; gcc runtime library exception(?: version 3 1)?
bison-exception ; 8 ; bison ; bison exception(?: 2 2)?
font-exception ; 8 ; font exception ; (?:gpl )?font exception(?: 2 0)?
linux-syscall-note ; 8 ; linux syscall note ; linux syscall note
lgpl ; 9 ; this library is free software you can redistribute it ; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {l}
lgpl-2.0 ; 8 ; library general public ; (?:gnu )?library general public {l}(?: version)? v?2(?: 0)?
lgpl-2.1 ; 8 ; lesser general public ; (?:gnu )?lesser general public {l}(?: version)? v?2 1(?: february 1999)?(?: only)?
lgpl-2.1+ ; 9 ; lesser general public ; (?:gnu )?lesser general public {l}(?: as published by the free software foundation)?(?: either)?(?: version)? v?2 1(?: of the {l})? or (?:at your option )?any later version
lgpl-3.0 ; 8 ; lesser general public ; (?:gnu )?lesser general public {l}(?: version)? v?3(?: 0)?(?: only)?
lgpl-2.1 ; 7 ; lgplv2 ; lgplv2(?: 1)?
lgpl-3.0 ; 7 ; lgplv3 ; lgplv3
lgpl-2.1 ; 8 ; lgpl 2 1 ; lgpl 2 1(?: only)?
lgpl-2.1+ ; 9 ; lgpl 2 1 or later ; lgpl 2 1 or later
lgpl-3.0 ; 8 ; lgpl 3 0 ; lgpl 3 0(?: only| or later)?
agpl ; 9 ; remote network interaction use with the gnu general public ; remote network interaction use with the gnu general public {l}
agpl-3.0 ; 9 ; affero general public ; (?:gnu )?affero general public {l}(?: version)? v?3(?: 0)?(?: only| or later)?
agpl-1.0 ; 9 ; affero general public ; affero general public {l} version 1
agpl-3.0 ; 8 ; agplv3 ; agplv3(?: or later)?
agpl-3.0 ; 8 ; agpl 3 0 ; agpl 3 0(?: only| or later)?
gfdl ; 9 ; permission is granted to copy distribute and or modify this document ; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {l}
gfdl ; 8 ; free documentation ; (?:gnu )?free documentation {l}(?: {v})?
gfdl ; 8 ; with no invariant sections ; with no invariant sections(?: no front cover texts and no back cover texts)?
mpl-2.0 ; 9 ; this source code form is subject to the terms of the mozilla public ; this source code form is subject to the terms of the mozilla public {l} v 2 0
mpl-2.0 ; 8 ; mozilla public ; mozilla public {l}(?: version)?(?: v)? ?2(?: 0)?
mpl-1.1 ; 9 ; subject to the mozilla public ; the contents of this file are subject to the mozilla public {l} version 1 1
mpl-1.1 ; 8 ; mozilla public ; mozilla public {l} version 1 1
mpl-1.0 ; 8 ; mozilla public ; mozilla public {l} version 1 0
mpl-2.0 ; 9 ; mozilla org mpl 2 0 ; https? (?:www )?mozilla org mpl 2 0
mpl-2.0 ; 7 ; mpl 2 0 ; mpl 2 0(?: no copyleft exception)?
npl ; 8 ; netscape public ; netscape public {l}(?: {v})?
epl-1.0 ; 8 ; eclipse public ; eclipse public {l}(?: version)?(?: v)? ?1 0
epl-2.0 ; 8 ; eclipse public ; eclipse public {l}(?: version)?(?: v)? ?2 0
epl ; 9 ; made available under the terms of the eclipse public ; (?:this program and the accompanying materials are )?made available under the terms of the eclipse public {l}
edl ; 8 ; eclipse distribution ; eclipse distribution {l}(?: {v})?
cpl ; 8 ; common public ; (?:ibm )?common public {l}(?: {v})?
ipl ; 8 ; ibm public ; ibm public {l}(?: {v})?
cddl-1.0 ; 9 ; common development and distribution ; common development and distribution {l}(?: cddl)?(?: version)? 1 0
cddl-1.1 ; 9 ; common development and distribution ; common development and distribution {l}(?: cddl)?(?: version)? 1 1
cddl ; 8 ; common development and distribution ; (?:subject to the terms of the )?common development and distribution {l}
cc0 ; 9 ; creative commons ; creative commons cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 ; 9 ; public domain see cc0 ; (?:in the |dedicated to the )?public domain see cc0
cc0 ; 8 ; cc0 1 0 ; cc0 1 0(?: universal)?
cc0 ; 9 ; to the extent possible under law ; to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights
cc-by-4.0 ; 9 ; creative commons attribution 4 0 ; creative commons attribution 4 0(?: international)?(?: public)?(?: {l})?
cc-by-3.0 ; 9 ; creative commons attribution 3 0 ; creative commons attribution 3 0(?: unported)?(?: {l})?
cc-by-sa-4.0 ; 9 ; creative commons attribution ; creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: {l})?
cc-by-sa-3.0 ; 9 ; creative commons attribution ; creative commons attribution share ?alike 3 0(?: unported)?(?: {l})?
cc-by-nc-4.0 ; 9 ; creative commons attribution ; creative commons attribution non ?commercial 4 0(?: international)?(?: {l})?
cc-by-nc-sa-4.0 ; 9 ; creative commons attribution ; creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: {l})?
cc-by-nc-nd-4.0 ; 9 ; creative commons attribution ; creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: {l})?
cc-by-nd-4.0 ; 9 ; creative commons attribution ; creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: {l})?
cc-by ; 8 ; creativecommons org licenses by ; https? creativecommons org licenses by \d \d
cc-by-sa ; 8 ; creativecommons org licenses by sa ; https? creativecommons org licenses by sa \d \d
cc-by-nc ; 8 ; creativecommons org licenses by nc ; https? creativecommons org licenses by nc \d \d
cc-by-nc-sa ; 8 ; creativecommons org licenses by nc sa ; https? creativecommons org licenses by nc sa \d \d
cc-by-nc-nd ; 8 ; creativecommons org licenses by nc nd ; https? creativecommons org licenses by nc nd \d \d
cc-by-4.0 ; 7 ; cc by 4 0 ; cc by 4 0
cc-by-sa-4.0 ; 8 ; cc by sa 4 0 ; cc by sa 4 0
cc-by-nc-4.0 ; 8 ; cc by nc 4 0 ; cc by nc 4 0
cc-by-nc-sa ; 8 ; cc by nc sa ; cc by nc sa(?: \d \d)?
cc-by-nc-nd ; 8 ; cc by nc nd ; cc by nc nd(?: \d \d)?
cc-by-nd ; 8 ; cc by nd ; cc by nd(?: \d \d)?
public-domain ; 9 ; this is free and unencumbered software ; this is free and unencumbered software released into the public domain
public-domain ; 8 ; into the public domain ; (?:released|placed|dedicated|put) into the public domain
public-domain ; 8 ; in the public domain ; (?:is|are|work) in the public domain
public-domain ; 8 ; public domain dedication ; public domain dedication
public-domain ; 8 ; public domain mark ; public domain mark(?: 1 0)?
public-domain ; 9 ; the author disclaims copyright to this source code ; the author disclaims copyright to this source code
pddl ; 8 ; public domain dedication and ; (?:open data commons )?public domain dedication and {l}
odbl ; 9 ; open data commons open database ; open data commons open database {l}(?: {v})?
odc-by ; 9 ; open data commons attribution ; open data commons attribution {l}(?: {v})?
wtfpl ; 9 ; do what the fuck you want to public ; do what the fuck you want to public {l}(?: version 2)?
wtfpl ; 8 ; you just do what the fuck you want to ; you just do what the fuck you want to
zlib ; 9 ; this software is provided as is without any express or implied warranty ; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib ; 9 ; the origin of this software must not be misrepresented ; the origin of this software must not be misrepresented
zlib ; 8 ; zlib libpng ; zlib libpng(?: {l})?
libpng ; 8 ; png reference library ; png reference library {l}(?: version)? 2
libpng ; 8 ; libpng ; libpng {l}(?: version)? 2
boost ; 9 ; distributed under the boost software ; distributed under the boost software {l} version 1 0
boost ; 9 ; obtaining a copy of the software and accompanying documentation covered by ; obtaining a copy of the software and accompanying documentation covered by this {l}
boost ; 9 ; www boost org ; https? www boost org {l} 1 0 txt
boost ; 8 ; boost software ; boost software {l}(?: {v})?
artistic-1.0 ; 8 ; artistic ; artistic {l}(?: version)? 1 0
artistic-2.0 ; 8 ; artistic ; artistic {l}(?: version)? 2 0
artistic ; 9 ; under the same terms as perl itself ; (?:redistribute it and or modify it )?under the same terms as perl itself
artistic ; 8 ; the clarified artistic ; the clarified artistic {l}
afl ; 8 ; academic free ; academic free {l}(?: {v})?
osl ; 8 ; open software ; open software {l}(?: {v})?
eupl ; 8 ; european union public ; european union public {l}(?: {v})?
eupl ; 9 ; licensed under the eupl ; licensed under the eupl(?: {v})?
cecill ; 8 ; cecill ; cecill(?: free software)? {l}(?: agreement)?
cecill ; 9 ; this software is governed by the cecill ; this software is governed by the cecill(?: [bc])? {l}
ms-pl ; 8 ; microsoft public ; microsoft public {l}(?: ms pl)?
ms-rl ; 8 ; microsoft reciprocal ; microsoft reciprocal {l}(?: ms rl)?
ms-pl ; 7 ; ms pl ; ms pl
ncsa ; 9 ; university of illinois ; university of illinois (?:ncsa )?open source {l}
ncsa ; 9 ; to deal with the software without restriction ; to deal with the software without restriction
ofl ; 9 ; this font software is licensed under the sil open font ; this font software is licensed under the sil open font {l}(?: {v})?
ofl ; 8 ; sil open font ; sil open font {l}(?: {v})?
openssl ; 9 ; this product includes software developed by the openssl project ; this product includes software developed by the openssl project for use in the openssl toolkit
openssl ; 9 ; this product includes cryptographic software written by eric young ; this product includes cryptographic software written by eric young
php ; 9 ; this source file is subject to version ; this source file is subject to version 3 0\d? of the php {l}
php ; 8 ; php ; php {l}(?: version)? 3 0\d?
postgresql ; 9 ; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement ; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
psf ; 8 ; python software foundation ; python software foundation {l}(?: version 2)?
psf ; 9 ; this license agreement is between the python software foundation ; this license agreement is between the python software foundation
python-2.0 ; 8 ; python 2 0 ; python 2 0 {l}
qpl ; 8 ; q public ; q public {l}(?: {v})?
ruby ; 8 ; ruby ; (?:the )?ruby {l}(?: \S+)?
ruby ; 9 ; you may make and give away verbatim copies of the source form ; you may make and give away verbatim copies of the source form
sspl ; 8 ; server side public ; server side public {l}(?: {v})?
sspl ; 9 ; making the functionality of the program or modified version available to third parties as a service ; making the functionality of the program or modified version available to third parties as a service
elastic ; 8 ; elastic ; elastic {l}(?: agreement)?(?: {v})?
bsl ; 9 ; business source ; business source {l}(?: {v})?
bsl ; 9 ; change date ; change date (?:\S+ ){1,16}change {l}
commons-clause ; 8 ; commons clause ; commons clause {l} condition
commons-clause ; 9 ; does not grant to you the right to sell the software ; does not grant to you the right to sell the software
polyform ; 8 ; polyform ; polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) {l}(?: {v})?
sleepycat ; 9 ; redistributions in any form must be accompanied by information ; redistributions in any form must be accompanied by information on how to obtain complete source code
sleepycat ; 8 ; sleepycat ; sleepycat {l}
unicode ; 9 ; unicode data files and any associated documentation ; unicode data files and any associated documentation
unicode ; 8 ; unicode ; unicode {l}(?: agreement)?(?: v3)?
unicode ; 8 ; unicode inc ; unicode inc {l} agreement
vim ; 8 ; vim ; vim {l}
w3c ; 9 ; w3c software ; w3c software (?:and document )?notice and {l}
w3c ; 8 ; by obtaining using and or copying this work ; by obtaining using and or copying this work you the licensee agree
zpl ; 8 ; zope public ; zope public {l}(?: {v})?
ecl ; 8 ; educational community ; educational community {l}(?: {v})?
upl ; 8 ; universal permissive ; universal permissive {l}(?: {v})?
blueoak ; 8 ; blue oak model ; blue oak model {l}(?: {v})?
mulan ; 8 ; mulan ; mulan (?:psl|permissive software {l})(?: {v})?
anti-996 ; 8 ; anti 996 ; anti 996 {l}
hippocratic ; 8 ; hippocratic ; hippocratic {l}(?: {v})?
json ; 9 ; shall be used for good not evil ; (?:the software )?shall be used for good not evil
beerware ; 9 ; beerware ; (?:the )?beerware {l}
beerware ; 9 ; beer ware ; (?:the )?beer ware {l}
beerware ; 9 ; you can buy me a beer in return ; you can buy me a beer in return
curl ; 8 ; curl ; curl {l}
icu ; 8 ; icu ; icu {l}(?: icu \d+ \d+)?
ftl ; 8 ; freetype ; freetype (?:project )?{l}
ijg ; 8 ; independent jpeg group ; (?:based in part on the work of the )?independent jpeg group(?: {l})?
imagemagick ; 8 ; imagemagick ; imagemagick {l}
tcl ; 8 ; tcl ; tcl tk {l}
lppl ; 8 ; latex project public ; latex project public {l}(?: {v})?
lppl ; 9 ; this work may be distributed and or modified under the conditions of the latex project public ; this work may be distributed and or modified under the conditions of the latex project public {l}
nasa ; 8 ; nasa open source ; nasa open source agreement(?: {v})?
naist ; 8 ; naist ; naist {l}
ogl-uk ; 8 ; open government ; open government {l}(?: {v})?
ogl-uk ; 9 ; contains public sector information ; contains public sector information licensed under the open government {l}
etalab ; 8 ; etalab ; (?:{l} ouverte )?etalab(?: 2 0)?
opl ; 8 ; open publication ; open publication {l}(?: {v})?
fal ; 8 ; free art ; free art {l}(?: {v})?
apsl ; 8 ; apple public source ; apple public source {l}(?: {v})?
intel ; 8 ; intel open source ; intel open source {l}
nokia ; 8 ; nokia open source ; nokia open source {l}
sun-sissl ; 8 ; sun industry standards source ; sun industry standards source {l}(?: {v})?
spl ; 8 ; sun public ; sun public {l}(?: {v})?
rpsl ; 8 ; realnetworks public source ; realnetworks public source {l}(?: {v})?
watcom ; 8 ; sybase open watcom public ; sybase open watcom public {l}(?: {v})?
openrail ; 9 ; openrail ; (?:creativeml |bigscience )?openrail(?: m)?(?: \d)?(?: {l})?
llama ; 8 ; llama ; llama \d community {l}(?: agreement)?
fair ; 8 ; fair ; fair source {l}(?: {v})?
proprietary ; 7 ; proprietary and confidential ; proprietary and confidential(?: information)?
proprietary ; 7 ; unauthorized copying of this file ; unauthorized copying of this file via any medium is strictly prohibited
warranty-disclaimer ; 3 ; without warranty of any kind ; (?:the software is )?provided as is without warranty of any kind(?: express or implied)?
"""

#: Labels and the names that licences of that label go by, in words.
NAMES = """
0bsd: zero clause bsd
afl: academic free
agpl: affero general public | gnu affero general public | agpl
apache: apache | apache software
artistic: artistic | perl artistic
bsd: bsd | berkeley software distribution
bsd-2-clause: bsd 2 clause | simplified bsd | freebsd
bsd-3-clause: bsd 3 clause | new bsd | modified bsd | revised bsd
bsd-4-clause: bsd 4 clause | original bsd
bsl: business source
boost: boost software | boost
cc0: creative commons zero | cc0
cc-by: creative commons attribution | cc by
cc-by-nc: creative commons attribution noncommercial | cc by nc
cc-by-sa: creative commons attribution sharealike | cc by sa
cddl: common development and distribution | cddl
cecill: cecill
cpl: common public
ecl: educational community
epl: eclipse public | epl
eupl: european union public | eupl
gfdl: gnu free documentation | free documentation | gfdl
gpl: general public | gnu general public | gpl
isc: isc | internet systems consortium
lgpl: lesser general public | library general public | gnu lesser general public | lgpl
mit: mit | expat | x11
mpl: mozilla public | mpl
ms-pl: microsoft public
ncsa: university of illinois ncsa open source | ncsa
odbl: open database | odbl
ofl: sil open font | open font
openssl: openssl
osl: open software
php: php
postgresql: postgresql
psf: python software foundation
public-domain: public domain | unlicense
qpl: q public
ruby: ruby
sspl: server side public | sspl
sleepycat: sleepycat
unicode: unicode
vim: vim
w3c: w3c software notice and
wtfpl: do what the fuck you want to public | wtfpl
zlib: zlib | zlib libpng
zpl: zope public
"""

#: Wordings around a name and their priorities.
WORDINGS = (
    (7, "spdx {l} identifier {name}(?: {l})?(?: {v})?(?: only| or later)?"),
    (6, "licensed under the {name} {l}(?: {v})?"),
    (5, "{name} {l} {v}(?: or later| only)?"),
    (4, "(?:released|distributed|available|provided|licensed|covered) under (?:the )?(?:terms of (?:the )?)?{name}(?: {l})?"),
    (3, "{name} {l}(?: agreement)?"),
    (2, "terms (?:and conditions )?of the {name}"),
    (1, "{name} licensed"),
)


#: Words of keywords that many texts have.
_COMMON = frozenset("a an the and or of to in by for under with this that you is are not any all copy software public free general open version use terms notice please work source code program file data new one".split())


def anchor(keyword: str) -> str:
    """The word of a keyword that fewest texts have, by rule of thumb: no common one, and the longest."""
    words = keyword.split()
    return max(words, key=lambda w: (w not in _COMMON, len(w), -words.index(w)))


@cache
def rules() -> tuple[tuple[str, str, int, str], ...]:
    """(label, keyword, priority, regular expression), the highest priority first."""
    fill = lambda x, name="": x.replace("{l}", "licen[sc]e").replace("{v}", "(?:version )?v?[0-9]+(?: [0-9]+)?").replace("{name}", name)
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" ; "))
        out.append((label, keyword, int(priority), fill(pattern)))
    for line in NAMES.strip().splitlines():
        label, _, names = line.partition(": ")
        for name in names.split(" | "):
            out += [(label, name, priority, fill(wording, name)) for priority, wording in WORDINGS]
    return tuple(sorted(((a, b, c, f"(?<= ){d}(?= )") for a, b, c, d in out), key=lambda r: -r[2]))
