"""Signature rules for licence detection, in order of priority (first wins).

Each line: label, weight, keyword, then a regular expression over a text's words, which are
lower-cased and joined by one space each (so punctuation never occurs). A rule runs only on texts
that contain its keyword. Specific rules stand before general ones: a general match that lies
inside a specific one is suppressed.
"""

from __future__ import annotations

RULES = r"""
apache-2.0|.95|apache|(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0|.95|apache|apache licen[sc]e version 2 0(?: january 2004)?
apache-2.0|.95|apache|apache licen[sc]e v ?2(?: 0)?
apache-2.0|.95|apache|spdx license identifier apache 2 0
apache-2.0|.95|apache|https? www apache org licenses license 2 0(?: txt| html)?
apache-2.0|.9|compliance|you may not use this file except in compliance with the license
apache-2.0|.8|warranties|distributed on an as is basis without warranties or conditions of any kind
apache-1.1|.9|apache|(?:the )?apache software licen[sc]e version 1 1
apache-1.1|.9|apache|spdx license identifier apache 1 1
apache-1.0|.9|apache|(?:the )?apache (?:group )?licen[sc]e version 1 0
apache-1.0|.9|apache|spdx license identifier apache 1 0
lgpl-2.1|.95|lesser|gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) 2 1(?: or(?: at your option)? any later version)?
lgpl-3.0|.95|lesser|gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?(?: or(?: at your option)? any later version)?
lgpl-2.0|.95|library|gnu library general public licen[sc]e(?: version 2(?: 0)?)?
lgpl-2.1|.95|lgpl|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|.95|lgpl|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.0|.95|lgpl|spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1|.85|lgpl|lgpl (?:version |v )?2 1
lgpl-2.1|.85|lgplv2|lgplv2 1
lgpl-3.0|.85|lgpl|lgpl (?:version |v )?3(?: 0)?
lgpl-3.0|.85|lgplv3|lgplv3
lgpl|.9|lesser|gnu lesser general public licen[sc]e
lgpl|.8|lgpl|https? www gnu org licenses lgpl(?: \d)?(?: \d)?(?: txt| html)?
lgpl|.7|lgpl|(?:under|the) (?:gnu )?lgpl
agpl-3.0|.95|affero|gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?(?: or(?: at your option)? any later version)?
agpl-3.0|.95|agpl|spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0|.85|agpl|agpl (?:version |v )?3(?: 0)?
agpl-3.0|.85|agplv3|agplv3
agpl|.9|affero|(?:gnu )?affero general public licen[sc]e
agpl|.8|agpl|https? www gnu org licenses agpl(?: \d)?(?: \d)?(?: txt| html)?
gpl-3.0|.95|gnu|(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e (?:version|v) ?3(?: 0)?
gpl-2.0|.95|gnu|(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e (?:version|v) ?2(?: 0)?
gpl-3.0|.95|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?(?: or(?: at your option)? any later version)?
gpl-2.0|.95|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2(?: 0)?(?: or(?: at your option)? any later version)?
gpl-1.0|.95|gnu|gnu general public licen[sc]e (?:version|v) ?1(?: 0)?
gpl-3.0|.95|gpl|spdx license identifier gpl 3 0(?: only| or later)?
gpl-2.0|.95|gpl|spdx license identifier gpl 2 0(?: only| or later)?
gpl-1.0|.95|gpl|spdx license identifier gpl 1 0(?: only| or later)?
gpl-3.0|.85|gpl|gpl (?:version |v )?3(?: 0)?
gpl-2.0|.85|gpl|gpl (?:version |v )?2(?: 0)?
gpl-3.0|.85|gplv3|gplv3(?: 0)?
gpl-2.0|.85|gplv2|gplv2(?: 0)?
gpl-3.0|.8|gpl|https? www gnu org licenses gpl 3 0(?: txt| html)?
gpl-2.0|.8|gpl|https? www gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl|.8|gpl|https? www gnu org (?:licenses|copyleft) gpl(?: txt| html)?
gpl|.85|free|this program is free software you can redistribute it and or modify it
gpl|.8|gnu|(?:the )?gnu general public licen[sc]e
gpl|.7|gpl|(?:under|the) (?:gnu )?gpl
gfdl-1.3|.95|documentation|gnu free documentation licen[sc]e (?:version|v) 1 3
gfdl-1.2|.95|documentation|gnu free documentation licen[sc]e (?:version|v) 1 2
gfdl-1.1|.95|documentation|gnu free documentation licen[sc]e (?:version|v) 1 1
gfdl|.9|documentation|gnu free documentation licen[sc]e
gfdl|.8|gfdl|spdx license identifier gfdl 1 \d(?: only| or later)?
mit|.95|mit|(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit|.95|mit|spdx license identifier mit
mit|.9|permission|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|.8|noninfringement|warranties of merchantability fitness for a particular purpose and noninfringement
mit|.8|opensource|https? (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
mit|.8|mit|(?:the )?mit licen[sc]e
mit-0|.9|mit|mit no attribution(?: licen[sc]e)?
mit-0|.95|mit|spdx license identifier mit 0
x11|.9|x11|(?:the )?x11 licen[sc]e
x11|.8|consortium|the name of the x consortium shall not be used
bsd-4-clause|.9|advertising|all advertising materials mentioning features or use of this software must display
bsd-4-clause|.9|bsd|(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?
bsd-3-clause|.95|bsd|(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-3-clause|.9|neither|neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-3-clause|.95|bsd|spdx license identifier bsd 3 clause(?: clear)?
bsd-2-clause|.95|bsd|(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)
bsd-2-clause|.95|bsd|spdx license identifier bsd 2 clause
bsd|.85|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|.75|bsd|(?:the )?bsd (?:style )?licen[sc]e
0bsd|.95|0bsd|spdx license identifier 0bsd
0bsd|.9|bsd|(?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?
isc|.95|isc|spdx license identifier isc
isc|.85|isc|(?:the )?isc licen[sc]e
isc|.85|permission|permission to use copy modify and or distribute this software for any purpose with or without fee
mpl-2.0|.95|mozilla|mozilla public licen[sc]e (?:version|v) ?2(?: 0)?
mpl-1.1|.95|mozilla|mozilla public licen[sc]e (?:version|v) ?1 1
mpl-1.0|.95|mozilla|mozilla public licen[sc]e (?:version|v) ?1 0
mpl-2.0|.95|mpl|spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-1.1|.95|mpl|spdx license identifier mpl 1 1
mpl-2.0|.85|mpl|mpl (?:version |v )?2(?: 0)?
mpl-2.0|.85|mozilla|https? (?:www )?mozilla org mpl 2 0
mpl|.85|mozilla|mozilla public licen[sc]e
epl-2.0|.95|eclipse|eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-1.0|.95|eclipse|eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl-2.0|.95|epl|spdx license identifier epl 2 0
epl-1.0|.95|epl|spdx license identifier epl 1 0
epl|.85|eclipse|eclipse public licen[sc]e
edl-1.0|.9|eclipse|eclipse distribution licen[sc]e (?:version |v )?1(?: 0)?
cpl-1.0|.9|common|common public licen[sc]e (?:version |v )?1(?: 0)?
cpl-1.0|.9|cpl|spdx license identifier cpl 1 0
cddl-1.1|.95|cddl|(?:spdx license identifier )?cddl (?:version |v )?1 1
cddl-1.0|.95|cddl|(?:spdx license identifier )?cddl (?:version |v )?1 0
cddl|.9|common|common development and distribution licen[sc]e(?: (?:version |v )?1 \d)?
ms-pl|.95|microsoft|microsoft public licen[sc]e(?: ms pl)?
ms-rl|.95|microsoft|microsoft reciprocal licen[sc]e(?: ms rl)?
ms-pl|.9|pl|spdx license identifier ms pl
ms-rl|.9|rl|spdx license identifier ms rl
cc-by-nc-nd|.95|cc|cc by nc nd(?: \d(?: \d)?)?
cc-by-nc-sa|.95|cc|cc by nc sa(?: \d(?: \d)?)?
cc-by-nc|.95|cc|cc by nc(?: \d(?: \d)?)?
cc-by-nd|.95|cc|cc by nd(?: \d(?: \d)?)?
cc-by-sa|.95|cc|cc by sa(?: \d(?: \d)?)?
cc-by-4.0|.95|cc|cc by (?:v )?4(?: 0)?
cc-by-3.0|.95|cc|cc by (?:v )?3(?: 0)?
cc-by-2.5|.95|cc|cc by (?:v )?2 5
cc-by-2.0|.95|cc|cc by (?:v )?2(?: 0)?
cc-by|.8|cc|cc by
cc0-1.0|.95|cc0|(?:spdx license identifier )?cc0 1 0(?: universal)?
cc0-1.0|.85|cc0|(?:licensed|released|dedicated|available) under (?:the )?(?:creative commons )?cc0
cc0-1.0|.85|creative|creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?
cc0-1.0|.85|creativecommons|creativecommons org publicdomain zero 1 0
cc-by-nc-nd|.95|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?
cc-by-nc-sa|.95|creative|creative commons attribution non ?commercial share ?alike(?: \d \d)?
cc-by-nc|.95|creative|creative commons attribution non ?commercial(?: \d \d)?
cc-by-nd|.95|creative|creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?
cc-by-sa|.95|creative|creative commons attribution share ?alike(?: \d \d)?
cc-by|.9|creative|creative commons attribution(?: \d \d)?(?: international| unported| generic)?
cc-by-nc-nd|.9|creativecommons|creativecommons org licenses by nc nd \d \d
cc-by-nc-sa|.9|creativecommons|creativecommons org licenses by nc sa \d \d
cc-by-nc|.9|creativecommons|creativecommons org licenses by nc \d \d
cc-by-nd|.9|creativecommons|creativecommons org licenses by nd \d \d
cc-by-sa|.9|creativecommons|creativecommons org licenses by sa \d \d
cc-by|.9|creativecommons|creativecommons org licenses by \d \d
cc-pdm-1.0|.9|public|(?:creative commons )?public domain mark(?: 1 0)?
cc-pdm-1.0|.9|creativecommons|creativecommons org publicdomain mark 1 0
creative-commons|.6|creative|(?:licensed|released|available) under (?:a |the )?creative commons licen[sc]e
odbl-1.0|.95|odbl|(?:spdx license identifier )?odbl(?: (?:v )?1 0)?
odbl-1.0|.95|database|open (?:data commons )?open database licen[sc]e(?: (?:version |v )?1 0)?
odbl-1.0|.9|database|open database licen[sc]e(?: (?:version |v )?1 0)?
odc-by-1.0|.95|odc|(?:spdx license identifier )?odc by(?: (?:v )?1 0)?
odc-by-1.0|.9|open|open data commons attribution licen[sc]e
pddl-1.0|.95|pddl|(?:spdx license identifier )?pddl(?: 1 0)?
pddl-1.0|.9|public|(?:open data commons )?public domain dedication and licen[sc]e
cdla-permissive|.9|community|community data licen[sc]e agreement permissive
cdla-permissive|.9|cdla|spdx license identifier cdla permissive \d \d
cdla-sharing|.9|community|community data licen[sc]e agreement sharing
cdla-sharing|.9|cdla|spdx license identifier cdla sharing \d \d
ogl-uk-3.0|.95|government|open government licen[sc]e (?:version |v )?3(?: 0)?
ogl-uk|.9|government|open government licen[sc]e(?: v?\d(?: \d)?)?
unlicense|.95|unlicense|spdx license identifier unlicense
unlicense|.9|unencumbered|this is free and unencumbered software released into the public domain
unlicense|.85|unlicense|(?:the unlicense|unlicense org|under (?:the )?unlicense)
wtfpl|.95|wtfpl|(?:spdx license identifier )?wtfpl
wtfpl|.9|want|do what the fuck you want to public licen[sc]e
zlib|.95|zlib|(?:spdx license identifier zlib|(?:the )?zlib(?: libpng)? licen[sc]e)
zlib|.85|misrepresented|the origin of this software must not be misrepresented
libpng|.9|libpng|(?:png reference library|libpng) licen[sc]e(?: version 2)?
bsl-1.0|.95|boost|boost software licen[sc]e(?: (?:version |v )?1 0)?
bsl-1.0|.95|bsl|spdx license identifier bsl 1 0
bsl-1.0|.85|boost|www boost org license 1 0 txt
busl-1.1|.95|business|business source licen[sc]e(?: (?:version )?1 1)?
busl-1.1|.95|busl|spdx license identifier busl 1 1
sspl-1.0|.95|sspl|(?:spdx license identifier )?sspl(?: v?1(?: 0)?)?
sspl-1.0|.95|server|server side public licen[sc]e
elastic-2.0|.95|elastic|elastic licen[sc]e (?:version |v )?2(?: 0)?
elastic-2.0|.9|elastic|spdx license identifier elastic 2 0
elastic|.8|elastic|(?:the )?elastic licen[sc]e
artistic-2.0|.95|artistic|(?:the )?artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic-1.0|.95|artistic|(?:the )?artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic-2.0|.9|artistic|spdx license identifier artistic 2 0
artistic-1.0|.9|artistic|spdx license identifier artistic 1 0(?: perl)?
artistic|.8|artistic|(?:the )?artistic licen[sc]e
perl|.8|perl|(?:under the )?same terms as perl itself
python-2.0|.95|python|python software foundation licen[sc]e(?: version 2)?
python-2.0|.9|psf|(?:spdx license identifier )?psf 2 0
python-2.0|.9|python|spdx license identifier python 2 0
ruby|.9|ruby|(?:spdx license identifier ruby|(?:the )?ruby licen[sc]e)
php-3.01|.95|php|(?:the )?php licen[sc]e version 3 01
php-3.0|.9|php|(?:the )?php licen[sc]e(?: version 3 0)?
php-3.01|.9|php|spdx license identifier php 3 01
postgresql|.9|postgresql|(?:spdx license identifier postgresql|(?:the )?postgresql licen[sc]e)
openssl|.9|openssl|(?:spdx license identifier openssl|(?:the )?openssl licen[sc]e)
openldap|.9|openldap|(?:the )?openldap public licen[sc]e(?: version 2 \d)?
openldap|.9|oldap|spdx license identifier oldap 2 \d
ofl-1.1|.95|sil|sil open font licen[sc]e(?: (?:version |v )?1 1)?
ofl-1.0|.9|ofl|spdx license identifier ofl 1 0
ofl-1.1|.95|ofl|(?:spdx license identifier )?ofl 1 1
eupl-1.2|.95|eupl|(?:spdx license identifier )?eupl (?:v )?1 2
eupl-1.1|.95|eupl|(?:spdx license identifier )?eupl (?:v )?1 1
eupl|.9|european|european union public licen[sc]e(?: (?:version |v )?1 \d)?
cecill-2.1|.95|cecill|(?:spdx license identifier )?cecill (?:v )?2 1
cecill-b|.95|cecill|(?:spdx license identifier )?cecill b
cecill-c|.95|cecill|(?:spdx license identifier )?cecill c
cecill|.85|cecill|(?:the )?cecill(?: free software)? licen[sc]e
osl-3.0|.95|open|open software licen[sc]e (?:version |v )?3(?: 0)?
osl-3.0|.95|osl|spdx license identifier osl 3 0
afl-3.0|.95|academic|academic free licen[sc]e (?:version |v )?3(?: 0)?
afl-3.0|.95|afl|spdx license identifier afl 3 0
afl|.85|academic|academic free licen[sc]e(?: (?:version |v )?[12](?: \d)?)?
ecl-2.0|.95|educational|educational community licen[sc]e(?: (?:version |v )?2(?: 0)?)?
ecl-2.0|.95|ecl|spdx license identifier ecl 2 0
ncsa|.95|ncsa|(?:spdx license identifier ncsa|(?:university of illinois )?ncsa open source licen[sc]e)
lppl-1.3c|.95|lppl|(?:spdx license identifier )?lppl (?:version |v )?1 3c?
lppl|.9|latex|latex project public licen[sc]e(?: (?:version |v )?1 \dc?)?
vim|.9|vim|(?:spdx license identifier vim|(?:the )?vim licen[sc]e)
w3c|.9|w3c|w3c software (?:notice|and document)(?: and)?(?: notice)?(?: and)? licen[sc]e
w3c|.9|w3c|spdx license identifier w3c(?: \d+)?
unicode|.9|unicode|unicode (?:inc )?licen[sc]e agreement(?: data files and software)?
unicode|.9|unicode|spdx license identifier unicode(?: dfs \d+| 3 0)?
icu|.9|icu|(?:spdx license identifier icu|(?:the )?icu licen[sc]e)
curl|.9|curl|(?:spdx license identifier curl|(?:the )?curl licen[sc]e)
ftl|.9|freetype|(?:the )?freetype(?: project)? licen[sc]e
ijg|.9|jpeg|independent jpeg group s? ?(?:software|licen[sc]e)
sleepycat|.9|sleepycat|(?:spdx license identifier sleepycat|(?:the )?sleepycat licen[sc]e)
qpl-1.0|.9|public|(?:the )?q public licen[sc]e(?: (?:version )?1 0)?
ipl-1.0|.9|ibm|ibm public licen[sc]e(?: (?:version |v )?1 0)?
spl-1.0|.9|sun|sun public licen[sc]e(?: (?:version |v )?1 0)?
apsl-2.0|.9|apple|apple public source licen[sc]e(?: (?:version |v )?2 0)?
npl-1.1|.9|netscape|netscape public licen[sc]e(?: (?:version |v )?1 \d)?
zpl-2.1|.9|zope|zope public licen[sc]e(?: (?:version |v )?2 \d)?
ncsa|.7|illinois|university of illinois open source licen[sc]e
upl-1.0|.9|universal|universal permissive licen[sc]e(?: (?:version |v )?1 0)?
upl-1.0|.9|upl|spdx license identifier upl 1 0
mulanpsl-2.0|.95|mulan|mulan (?:permissive software licen[sc]e|psl)(?: (?:version |v)?2)?
mulanpsl-2.0|.9|mulanpsl|(?:spdx license identifier )?mulanpsl 2 0
blueoak-1.0.0|.95|blue|blue oak model licen[sc]e(?: 1 0 0)?
blueoak-1.0.0|.9|blueoak|spdx license identifier blueoak 1 0 0
beerware|.85|beer|(?:the )?beer ?ware licen[sc]e
json|.9|evil|the software shall be used for good not evil
hpnd|.85|permission|permission to use copy modify and distribute this software and its documentation for any purpose
openrail-m|.95|openrail|(?:creativeml |bigcode |bigscience )?open ?rail(?: plus)?(?: \+)? m(?: licen[sc]e)?
openrail|.9|rail|responsible ai licen[sc]e(?:s)?
bigscience-rail|.95|rail|bigscience (?:bloom )?rail(?: licen[sc]e)?(?: 1 0)?
llama-community|.9|llama|llama \d(?: \d)? community licen[sc]e(?: agreement)?
gemma-terms|.85|gemma|gemma terms of use
polyform-nc|.95|polyform|polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?
polyform|.9|polyform|polyform (?:small business|shield|strict|perimeter|internal use)(?: licen[sc]e)?
commons-clause|.9|commons|commons clause (?:licen[sc]e )?condition(?: v1 0)?
fair-source|.85|fair|fair source licen[sc]e
prosperity|.85|prosperity|prosperity public licen[sc]e(?: 3 0 0)?
parity|.85|parity|parity public licen[sc]e(?: 7 0 0)?
proprietary|.7|confidential|proprietary and confidential
proprietary|.7|unauthorized|unauthorized (?:copying|use|distribution) of this (?:file|software|document) .{0,40}?is (?:strictly )?prohibited
all-rights-reserved|.5|rights|all rights reserved(?: worldwide)?
public-domain|.8|public|(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain|.7|public|this (?:work|file|document|software) is in the public domain
see-license|.4|license|see (?:the )?licen[sc]e(?: file| txt| md)?(?: for (?:more )?details)?
spdx-other|.7|spdx|spdx license identifier [a-z0-9]+(?: [0-9]+)*
license-reference|.4|license|(?:licensed|released|distributed) under (?:the )?(?:terms of )?[a-z0-9]+ (?:[a-z0-9]+ ){0,3}?licen[sc]e
"""

#: Phrases that always count, with their labels (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def rules() -> list[tuple[str, float, str, str]]:
    """(label, weight, keyword, pattern) in order of priority."""
    out = []
    for line in RULES.strip().splitlines():
        label, weight, keyword, pattern = line.split("|", 3)
        out.append((label, float(weight), keyword, pattern))
    return out
