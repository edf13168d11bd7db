"""The signature rules of the license scan, written by hand: label, kind and regular expression over the words of a text.

Words are lower-cased runs of letters and digits, joined by single spaces, so "GPL-3.0-or-later" reads "gpl 3 0 or later".
Alternatives stand in parentheses; ``<v>`` is an optional version word, ``<0>`` an optional minor 0, ``<or>`` an optional
"or later", ``<form>`` what may follow the name of a Creative Commons license, ``<gap>`` up to six words. Kinds, the strongest first: text (a sentence of the license itself), tag (an SPDX
identifier), grant (a sentence that puts the work under it), url (its address), name (its name alone), note (a claim
about rights).
"""

from __future__ import annotations

#: Kinds in the order of their priority, with the confidence that a detection of this kind gives.
KINDS = {"text": 1.0, "tag": 0.95, "grant": 0.9, "url": 0.8, "name": 0.6, "note": 0.4}

MACROS = {
    "<v>": "(?:version |ver |v )?v?",
    "<0>": "(?: 0)?",
    "<or>": "(?: only| or later| or any later version|(?: or)? at your option any later version)?",
    "<form>": "(?: [1234] [05]| license| licence| international){0,3}",
    "<gap>": " (?:[^ ]+ ){0,6}",
    "<under>": "(?:licensed|released|distributed|published|provided|available|covered|made available) under(?: the)?(?: terms of| terms and conditions of)?(?: the)?",
}

RULES = r"""
mit text permission is hereby granted free of charge to any person obtaining a copy of this software
mit text to deal in the software without restriction including without limitation the rights to use copy modify merge
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit text in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit tag spdx license identifier mit
mit grant <under> mit licen[cs]e
mit grant <under> mit x11 licen[cs]e
mit grant mit licensed
mit url opensource org licenses? mit(?: license)?
mit url mit license org
mit url choosealicense com licenses mit
mit name mit licen[cs]e
mit name expat licen[cs]e
mit-0 text permission is hereby granted free of charge<gap>without restriction including without limitation the rights(?: to)?(?: [^ ]+){0,12} and to permit persons to whom the software is furnished to do so the software is provided
mit-0 tag spdx license identifier mit 0
mit-0 grant <under> mit no attribution
mit-0 name mit no attribution
x11 text except as contained in this notice the name of the x consortium shall not be used in advertising
x11 tag spdx license identifier x11
x11 name x11 licen[cs]e
isc text permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc text the software is provided as is and the author disclaims all warranties with regard to this software
isc tag spdx license identifier isc
isc grant <under> isc licen[cs]e
isc url opensource org licenses? isc(?: license)?
isc name isc licen[cs]e
0bsd text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
0bsd tag spdx license identifier 0bsd
0bsd name (?:zero clause bsd|0bsd|bsd zero clause) licen[cs]e
bsd-2-clause tag spdx license identifier bsd 2 clause
bsd-2-clause grant <under> (?:2|two) clause bsd
bsd-2-clause grant <under> bsd (?:2|two) clause
bsd-2-clause grant <under> simplified bsd
bsd-2-clause url opensource org licenses? bsd 2 clause
bsd-2-clause name bsd (?:2|two) clause
bsd-2-clause name (?:2|two) clause bsd
bsd-2-clause name (?:simplified|freebsd) (?:bsd )?licen[cs]e
bsd-3-clause text neither the name of<gap>nor the names of its contributors may be used to endorse or promote products
bsd-3-clause tag spdx license identifier bsd 3 clause
bsd-3-clause grant <under> (?:3|three) clause bsd
bsd-3-clause grant <under> bsd (?:3|three) clause
bsd-3-clause grant <under> (?:new|modified|revised) bsd
bsd-3-clause url opensource org licenses? bsd 3 clause
bsd-3-clause name bsd (?:3|three) clause
bsd-3-clause name (?:3|three) clause bsd
bsd-3-clause name (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause text all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause tag spdx license identifier bsd 4 clause
bsd-4-clause name bsd (?:4|four) clause
bsd-4-clause name (?:4|four) clause bsd
bsd-4-clause name original bsd licen[cs]e
bsd text redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd text redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd text redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd grant <under> bsd licen[cs]e
bsd grant <under> bsd style licen[cs]e
bsd url opensource org licenses? bsd license
bsd name bsd licen[cs]e
bsd name bsd style licen[cs]e
apache-2 text unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 text you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 text subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-2 tag spdx license identifier apache 2 0
apache-2 grant <under> apache licen[cs]e <v>2<0>
apache-2 grant <under> apache 2<0>
apache-2 grant <under> apache software licen[cs]e <v>2<0>
apache-2 url apache org licenses license 2 0
apache-2 url opensource org licenses? apache 2 0
apache-2 name apache licen[cs]e <v>2<0>
apache-2 name apache software licen[cs]e <v>2<0>
apache-2 name asl 2 0
apache-1.1 text the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
apache-1.1 tag spdx license identifier apache 1 1
apache-1.1 name apache (?:software )?licen[cs]e <v>1 1
apache tag spdx license identifier apache
apache grant <under> apache licen[cs]e
apache name apache licen[cs]e
apache name apache software foundation licen[cs]e
gpl-2 text gnu general public license version 2 june 1991
gpl-2 text free software foundation either version 2 of the license or at your option any later version
gpl-2 text under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-2 tag spdx license identifier gpl 2 0<or>
gpl-2 grant <under> gnu general public licen[cs]e <v>2<0><or>
gpl-2 grant <under> gnu gpl <v>2<0><or>
gpl-2 grant <under> gpl <v>2<0><or>
gpl-2 url gnu org licenses (?:old licenses )?gpl 2 0
gpl-2 url opensource org licenses? gpl 2 0
gpl-2 name gnu general public licen[cs]e <v>2<0><or>
gpl-2 name gnu gpl <v>2<0><or>
gpl-2 name gpl <v>2<0><or>
gpl-2 name gplv2<0><or>
gpl-3 text gnu general public license version 3 29 june 2007
gpl-3 text the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 text free software foundation either version 3 of the license or at your option any later version
gpl-3 tag spdx license identifier gpl 3 0<or>
gpl-3 grant <under> gnu general public licen[cs]e <v>3<0><or>
gpl-3 grant <under> gnu gpl <v>3<0><or>
gpl-3 grant <under> gpl <v>3<0><or>
gpl-3 url gnu org licenses gpl 3 0
gpl-3 url opensource org licenses? gpl 3 0
gpl-3 name gnu general public licen[cs]e <v>3<0><or>
gpl-3 name gnu gpl <v>3<0><or>
gpl-3 name gpl <v>3<0><or>
gpl-3 name gplv3<0><or>
gpl text this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl text you should have received a copy of the gnu general public license along with
gpl grant <under> gnu general public licen[cs]e
gpl grant <under> gnu gpl
gpl grant <under> gpl
gpl url gnu org (?:copyleft|licenses) gpl(?: html)?
gpl name gnu general public licen[cs]e
gpl name gnu gpl
lgpl-2 text gnu library general public license version 2 june 1991
lgpl-2 tag spdx license identifier lgpl 2 0<or>
lgpl-2 grant <under> gnu library general public licen[cs]e
lgpl-2 name gnu library general public licen[cs]e
lgpl-2.1 text gnu lesser general public license version 2 1 february 1999
lgpl-2.1 text free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.1 tag spdx license identifier lgpl 2 1<or>
lgpl-2.1 grant <under> gnu lesser general public licen[cs]e <v>2 1<or>
lgpl-2.1 grant <under> (?:gnu )?lgpl <v>2 1<or>
lgpl-2.1 url gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.1 name gnu lesser general public licen[cs]e <v>2 1<or>
lgpl-2.1 name lgpl <v>2 1<or>
lgpl-3 text this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl-3 tag spdx license identifier lgpl 3 0<or>
lgpl-3 grant <under> gnu lesser general public licen[cs]e <v>3<0><or>
lgpl-3 grant <under> (?:gnu )?lgpl <v>3<0><or>
lgpl-3 url gnu org licenses lgpl 3 0
lgpl-3 name gnu lesser general public licen[cs]e <v>3<0><or>
lgpl-3 name lgpl <v>3<0><or>
lgpl text you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl text you should have received a copy of the gnu lesser general public license along with
lgpl grant <under> gnu lesser general public licen[cs]e
lgpl grant <under> (?:gnu )?lgpl
lgpl url gnu org (?:copyleft lesser|licenses lgpl)(?: html)?
lgpl name gnu lesser general public licen[cs]e
lgpl name gnu lgpl
agpl-3 text gnu affero general public license version 3 19 november 2007
agpl-3 text you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
agpl-3 tag spdx license identifier agpl 3 0<or>
agpl-3 grant <under> gnu affero general public licen[cs]e <v>3<0><or>
agpl-3 grant <under> (?:gnu )?agpl <v>3<0><or>
agpl-3 url gnu org licenses agpl(?: 3 0)?
agpl-3 name gnu affero general public licen[cs]e <v>3<0><or>
agpl-3 name agpl <v>3<0><or>
agpl grant <under> gnu affero general public licen[cs]e
agpl grant <under> (?:gnu )?agpl
agpl name affero general public licen[cs]e
agpl name gnu affero general public licen[cs]e
gfdl text permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl tag spdx license identifier gfdl 1 [123]<or>
gfdl grant <under> gnu free documentation licen[cs]e
gfdl url gnu org (?:copyleft|licenses) fdl(?: html)?
gfdl name gnu free documentation licen[cs]e
gfdl name gfdl
mpl-1.1 text the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 tag spdx license identifier mpl 1 1
mpl-1.1 url mozilla org mpl (?:mpl )?1 1
mpl-1.1 name mozilla public licen[cs]e <v>1 1
mpl-2 text this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 text if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2 tag spdx license identifier mpl 2 0
mpl-2 grant <under> mozilla public licen[cs]e <v>2<0>
mpl-2 grant <under> mpl <v>2<0>
mpl-2 url mozilla org mpl 2 0
mpl-2 name mozilla public licen[cs]e <v>2<0>
mpl-2 name mpl 2 0
mpl grant <under> mozilla public licen[cs]e
mpl name mozilla public licen[cs]e
epl-1 tag spdx license identifier epl 1 0
epl-1 grant <under> eclipse public licen[cs]e <v>1<0>
epl-1 url eclipse org legal epl v10(?: html)?
epl-1 name eclipse public licen[cs]e <v>1<0>
epl-2 text this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-2 tag spdx license identifier epl 2 0
epl-2 grant <under> eclipse public licen[cs]e <v>2<0>
epl-2 url eclipse org legal epl (?:2 0|v20)
epl-2 name eclipse public licen[cs]e <v>2<0>
epl grant <under> eclipse public licen[cs]e
epl name eclipse public licen[cs]e
cpl tag spdx license identifier cpl 1 0
cpl text the accompanying program is provided under the terms of this common public license
cpl name common public licen[cs]e <v>1<0>
cddl text common development and distribution license cddl version 1 [01]
cddl text the contents of this file are subject to the terms of the common development and distribution license
cddl tag spdx license identifier cddl 1 [01]
cddl grant <under> (?:common development and distribution licen[cs]e|cddl)
cddl name common development and distribution licen[cs]e
eupl text licensed under the eupl
eupl tag spdx license identifier eupl 1 [012]
eupl grant <under> european union public licen[cs]e
eupl name european union public licen[cs]e
artistic-2 text everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package
artistic-2 tag spdx license identifier artistic 2 0
artistic-2 grant <under> artistic licen[cs]e <v>2<0>
artistic-2 url opensource org licenses? artistic license 2 0
artistic-2 name artistic licen[cs]e <v>2<0>
artistic grant <under> same terms as perl
artistic grant <under> artistic licen[cs]e
artistic name artistic licen[cs]e
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib text the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib tag spdx license identifier zlib
zlib grant <under> zlib licen[cs]e
zlib name zlib (?:libpng )?licen[cs]e
boost text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost tag spdx license identifier bsl 1 0
boost grant <under> boost software licen[cs]e
boost url boost org license 1 0
boost name boost software licen[cs]e(?: <v>1<0>)?
unlicense text this is free and unencumbered software released into the public domain
unlicense text anyone is free to copy modify publish use compile sell or distribute this software
unlicense tag spdx license identifier unlicense
unlicense grant <under> unlicense
unlicense url unlicense org
unlicense name the unlicense
wtfpl text everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl tag spdx license identifier wtfpl
wtfpl grant <under> (?:wtfpl|do what the fuck you want to public licen[cs]e)
wtfpl url wtfpl net
wtfpl name do what the fuck you want to public licen[cs]e
cc0 text the person who associated a work with this deed has dedicated the work to the public domain
cc0 tag spdx license identifier cc0 1 0
cc0 grant <under> (?:cc0|creative commons zero)
cc0 url creativecommons org publicdomain zero 1 0
cc0 name cc0(?: <v>1<0>)?(?: universal)?
cc0 name creative commons zero
cc-by tag spdx license identifier cc by [1234] [05]
cc-by grant <under> (?:cc|creative commons) (?:by|attribution)<form>
cc-by url creativecommons org licenses by [1234] [05]
cc-by name creative commons attribution(?: [1234] [05])?(?: international)? licen[cs]e
cc-by name cc by [1234] [05]
cc-by-sa tag spdx license identifier cc by sa [1234] [05]
cc-by-sa grant <under> (?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)<form>
cc-by-sa url creativecommons org licenses by sa [1234] [05]
cc-by-sa name creative commons attribution (?:sharealike|share alike)
cc-by-sa name cc by sa
cc-by-nd tag spdx license identifier cc by nd [1234] [05]
cc-by-nd grant <under> (?:cc|creative commons) (?:by|attribution) (?:nd|noderivs|noderivatives|no derivs|no derivatives)<form>
cc-by-nd url creativecommons org licenses by nd [1234] [05]
cc-by-nd name creative commons attribution (?:noderivs|noderivatives|no derivs|no derivatives)
cc-by-nd name cc by nd
cc-by-nc tag spdx license identifier cc by nc [1234] [05]
cc-by-nc grant <under> (?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)<form>
cc-by-nc url creativecommons org licenses by nc [1234] [05]
cc-by-nc name creative commons attribution (?:noncommercial|non commercial)
cc-by-nc name cc by nc(?: [1234] [05])?
cc-by-nc-sa tag spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-sa grant <under> (?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)<form>
cc-by-nc-sa url creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-sa name creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)
cc-by-nc-sa name cc by nc sa(?: [1234] [05])?
cc-by-nc-nd tag spdx license identifier cc by nc nd [1234] [05]
cc-by-nc-nd grant <under> (?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivs|noderivatives|no derivs|no derivatives)<form>
cc-by-nc-nd url creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-nd name creative commons attribution (?:noncommercial|non commercial) (?:noderivs|noderivatives|no derivs|no derivatives)
cc-by-nc-nd name cc by nc nd(?: [1234] [05])?
cc name some rights reserved
cc name creative commons licen[cs]e
cc url creativecommons org licenses
public-domain grant (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain grant this (?:work|file|text|code|software|document) is in the public domain
public-domain url creativecommons org publicdomain mark 1 0
public-domain note has been identified as being free of known restrictions under copyright law
ofl text this font software is licensed under the sil open font license
ofl tag spdx license identifier ofl 1 1
ofl grant <under> (?:sil )?open font licen[cs]e
ofl url scripts sil org ofl
ofl name sil open font licen[cs]e
openssl text this product includes software developed by the openssl project for use in the openssl toolkit
openssl tag spdx license identifier openssl
openssl name openssl licen[cs]e
python text psf is making python available to licensee on an as is basis
python tag spdx license identifier (?:psf|python) 2 0
python grant <under> (?:psf|python software foundation) licen[cs]e
python name python software foundation licen[cs]e
php tag spdx license identifier php 3 0(?:1)?
php text this product includes php software freely available from
php name php licen[cs]e <v>3(?: 01?)?
ruby tag spdx license identifier ruby
ruby grant <under> same terms as ruby
ruby name ruby licen[cs]e
ms-pl tag spdx license identifier ms pl
ms-pl grant <under> microsoft public licen[cs]e
ms-pl name microsoft public licen[cs]e
ms-rl tag spdx license identifier ms rl
ms-rl name microsoft reciprocal licen[cs]e
busl text the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl tag spdx license identifier busl 1 1
busl grant <under> business source licen[cs]e
busl name business source licen[cs]e(?: <v>1 1)?
sspl text if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
sspl tag spdx license identifier sspl 1 0
sspl grant <under> server side public licen[cs]e
sspl name server side public licen[cs]e
elastic-2 tag spdx license identifier elastic 2 0
elastic-2 grant <under> elastic licen[cs]e
elastic-2 name elastic licen[cs]e <v>2<0>
commons-clause text without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software
commons-clause name commons clause licen[cs]e condition
polyform tag spdx license identifier polyform (?:noncommercial|small business) 1 0 0
polyform grant <under> polyform (?:noncommercial|small business|shield|strict) licen[cs]e
polyform name polyform (?:noncommercial|small business|shield|strict) licen[cs]e
odbl text this database is made available under the open database license
odbl tag spdx license identifier odbl 1 0
odbl grant <under> open (?:data commons open )?database licen[cs]e
odbl url opendatacommons org licenses odbl
odbl name open database licen[cs]e
odc-by tag spdx license identifier odc by 1 0
odc-by grant <under> open data commons attribution licen[cs]e
odc-by url opendatacommons org licenses by
odc-by name open data commons attribution licen[cs]e
pddl tag spdx license identifier pddl 1 0
pddl url opendatacommons org licenses pddl
pddl name public domain dedication and licen[cs]e
ncsa text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
ncsa tag spdx license identifier ncsa
ncsa name university of illinois ncsa open source licen[cs]e
postgresql text permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql tag spdx license identifier postgresql
postgresql name postgresql licen[cs]e
curl tag spdx license identifier curl
curl name curl licen[cs]e
hpnd text permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted
hpnd tag spdx license identifier hpnd
hpnd name historical permission notice and disclaimer
afl tag spdx license identifier afl [123] [01]
afl grant <under> academic free licen[cs]e
afl name academic free licen[cs]e(?: <v>[123] [01])?
osl tag spdx license identifier osl [123] [01]
osl grant <under> open software licen[cs]e
osl name open software licen[cs]e(?: <v>[123] [01])?
upl tag spdx license identifier upl 1 0
upl grant <under> universal permissive licen[cs]e
upl name universal permissive licen[cs]e
blue-oak tag spdx license identifier blueoak 1 0 0
blue-oak name blue oak model licen[cs]e
mulan tag spdx license identifier mulanpsl 2 0
mulan grant <under> mulan psl v?2
mulan name mulan permissive software licen[cs]e
json text the software shall be used for good not evil
json tag spdx license identifier json
json name json licen[cs]e
sleepycat tag spdx license identifier sleepycat
sleepycat name sleepycat licen[cs]e
cecill tag spdx license identifier cecill [12] [01]
cecill grant <under> cecill(?: [bc])? licen[cs]e
cecill url cecill info
openrail text use based restrictions as referenced in paragraph 5 must be included as an enforceable provision
openrail grant <under> (?:creativeml |bigscience |bigcode )?(?:openrail|open rail)(?: m| s)?
openrail name (?:openrail|open rail)(?: m| s)? licen[cs]e
openrail name responsible ai licen[cs]e
beerware text if we meet some day and you think this stuff is worth it you can buy me a beer
beerware tag spdx license identifier beerware
beerware name (?:beerware|beer ware) licen[cs]e
non-commercial note for (?:noncommercial|non commercial) use only
non-commercial note (?:may|must|shall) not be used for commercial purposes
non-commercial note for (?:personal|educational|academic|research) use only
proprietary text this software is the confidential and proprietary information of
proprietary text unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary note proprietary and confidential
proprietary note end user licen[cs]e agreement
proprietary note no part of this (?:publication|book|document|work) may be reproduced
all-rights-reserved note all rights reserved
all-rights-reserved note reproduction (?:in whole or in part )?without (?:written |prior )?permission is prohibited
"""
