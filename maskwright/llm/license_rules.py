"""Signature rules written by hand: label, keyword, pattern.

A pattern is a regex over lower-case words with one space between them. Every
match holds the keyword, or one of several. Sections are in order of strength.
"""

from __future__ import annotations

#: Sentences of the licenses themselves.
TEXTS = """
mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit | sublicense | (?:to )?use copy modify merge publish distribute sublicense and or sell copies(?: of the software)?
mit | substantial | shall be included in all copies or substantial portions of the software
mit | furnished | to permit persons to whom the software is furnished to do so
mit | noninfringement | fitness for a particular purpose and noninfringement
mit | dealings | out of or in connection with the software or the use or other dealings in the software
mit-0 | attribution | mit no attribution
mit-modern | granted | permission is hereby granted without written agreement and without license or royalty fees
isc | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | the author disclaims all warranties with regard to this software
isc | tortious | whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software
0bsd | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | endorse | (?:names? of (?:its|the) (?:contributors?|authors?|copyright holders?) )?may (?:not )?be used to endorse or promote products derived from this software
bsd | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | interruption | loss of use data or profits or business interruption
bsd-patent | royalty | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free
apache | limitations | see the license for the specific language governing permissions and limitations(?: under the license)?
apache | compliance | you may not use this file except in compliance with the license
apache | warranties | distributed on an as is basis without warranties or conditions of any kind
apache | agreed | unless required by applicable law or agreed to in writing software
apache | derivative | reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work
apache | notice | if the work includes a notice text file as part of its distribution
apache | apache | this product includes software developed by the apache software foundation
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
gpl | received | you should have received a copy of the gnu general public
gpl | designed | the licenses for most software are designed to take away your freedom to share and change it
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | copyleft | the gnu general public licen[cs]e is a free copyleft licen[cs]e
gpl | holder | this license applies to any program or other work which contains a notice placed by the copyright holder
gpl | circumvention,conveying | protecting users legal rights from anti circumvention law|conveying verbatim copies|conveying modified source versions
gpl | recipients | we want its recipients to know that what they have is not the original
gpl-exception | exception | as a special exception the copyright holders give (?:you )?permission to link
gpl-exception | classpath | (?:gnu )?classpath exception
gpl-exception | runtime | gcc runtime library exception
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public
lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public
lgpl | lesser | see the gnu lesser general public
lgpl | library | this license applies to any software library(?: or other program)? which contains a notice
lgpl | combined | you may convey a combined work under terms of your choice
lgpl | uses | work that uses the library
agpl | redistribute | you can redistribute it and or modify it under the terms of the (?:gnu )?affero
agpl | affero | you should have received a copy of the (?:gnu )?affero general public
agpl | remotely | all users interacting with it remotely through a computer network
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation
gfdl | manual | to make a manual textbook or other functional and useful document free in the sense of freedom
mpl | mozilla | (?:is )?subject to the terms of the mozilla public
mpl | obtain | if a copy of the mpl was not distributed with this file you can obtain one
mpl | incompatible | this source code form is incompatible with secondary licenses
mpl | initial | the initial developer of the original code is
mpl | contents | the contents of this file are subject to the mozilla public
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public
epl | recipient | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cddl | common | the contents of this file are subject to the terms of the common development and distribution
cddl | header | when distributing covered code include this cddl header
cpl | common | this program is made available under the terms of the common public
eupl | eupl,european | licensed under the eupl|european union public licen[cs]e
eupl | joinup | joinup ec europa eu
osl | adjacent | this original work of authorship (?:[a-z0-9]+ ){0,8}whose owner the licensor has placed the following licensing notice adjacent
afl | academic | licensed under the academic free
artistic | artistic | you may distribute (?:this|it) under (?:the terms of )?(?:either )?the (?:gnu general public licen[cs]e or the )?artistic
artistic | package | the intent of this document is to state the conditions under which a package may be copied
artistic | perl | under the same terms as perl(?: 5)?(?: itself)?
bsl | boost | (?:use modification and distribution (?:is|are) subject to|distributed under) the boost software
bsl | reproduce | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce
ofl | font | this font software is licensed under the sil open font
ofl | reserved | with reserved font names?
ofl | bundled | the fonts including any derivative works can be bundled embedded redistributed and or sold with any software
odbl | database | this (?:[a-z0-9]+ ){0,5}database is made available under the open database
odbl | intact | keep intact any copyright or database right notices
odc-by | attribution | open data commons attribution
pddl | dedication | public domain dedication and licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e ms pl
ms-pl | infringed | if you bring a patent claim against any contributor over patents that you claim are infringed by the software
zpl | zope | this software is subject to the provisions of the zope public
lppl | maintenance | this work has the lppl maintenance status
lppl | latex | it may be distributed and or modified under the conditions of the latex project public
python | psf | psf is making python available to licensee on an as is basis
python | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
python | cnri | cnri open source license agreement
zlib | warranty | provided as is without any express or implied warranty(?: in no event will the authors be held liable)?
zlib | misrepresented | (?:the origin of this software must not be misrepresented|altered source versions must be plainly marked as such and must not be misrepresented)
zlib | notice | this notice may not be removed or altered from any source distribution
libpng | png | the png reference library is supplied as is
upl | larger | with or without larger works|larger work to which the software is contributed
wtfpl | want | you just do what the fuck you want to
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | dedication | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software
cecill | cecill | (?:governed by|licence) (?:the )?cecill
cecill | cea | as circulated by cea cnrs and inria
qpl | public | may be distributed under the terms of the q public licen[cs]e|q public licen[cs]e qpl
postgresql | written | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | supporting | that both that copyright notice and this permission notice appear in supporting documentation
ntp | advertising | not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
curl | daniel | copyright and permission notice (?:[a-z0-9]+ ){0,6}daniel stenberg
openssl | openssl | this product includes software developed by the openssl project
ssleay | eric | this product includes cryptographic software written by eric young
x11 | consortium | the name of the x consortium shall not be used in advertising
ijg | jpeg | this software is based in part on the work of the independent jpeg group
freetype | freetype | portions of this software are copyright (?:[a-z0-9]+ ){0,6}the freetype project
icu | icu | icu licen[cs]e icu 1 8 1 and later
unicode | unicode | unicode data files and software|unicode licen[cs]e agreement
ncsa | urbana | university of illinois at urbana champaign
w3c | w3c | w3c software (?:and document )?notice and licen[cs]e
vim | vim | vim licen[cs]e|vim is charityware
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | evil | the software shall be used for good not evil
sleepycat | berkeley | (?:oracle )?berkeley db (?:java edition )?(?:[a-z0-9]+ ){0,4}sleepycat
php | php | this product includes php software
ruby | ruby | (?:you can redistribute it and or modify it under (?:either )?the (?:same )?terms (?:of|as) ruby|ruby s licen[cs]e)
tcl | scriptics | this software is copyrighted by the regents of the university of california sun microsystems inc scriptics
intel | intel | intel (?:simplified|open source) (?:software )?licen[cs]e
ibm | ibm | ibm public licen[cs]e
apsl | apple | apple public source licen[cs]e
npl | netscape | netscape public licen[cs]e
spl | sun | sun public licen[cs]e
rpl | reciprocal | reciprocal public licen[cs]e
cpal | common | common public attribution licen[cs]e
sspl | server | server side public licen[cs]e
busl | business | business source licen[cs]e
elastic | elastic | elastic licen[cs]e(?: 2 0)?
commons-clause | clause | commons clause(?: licen[cs]e condition)?
polyform | polyform | polyform (?:noncommercial|small business|shield|perimeter|strict) licen[cs]e
confluent | confluent | confluent community licen[cs]e
bigscience-rail | rail | (?:bigscience |openrail |creativeml )?(?:open )?rail (?:m )?licen[cs]e
mulan | mulan | mulan (?:permissive software|psl) ?(?:licen[cs]e)?
anti-996 | 996 | anti 996 licen[cs]e
hippocratic | hippocratic | hippocratic licen[cs]e
eula | eula | end user licen[cs]e agreement eula
cc0 | waiving | the person who associated a work with this deed has dedicated the work to the public domain by waiving
cc0 | overtly | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc | creativecommons | to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org
cc | similar,adapted | you must distribute the resulting work only under the same or similar licen[cs]e|adapted material means material subject to copyright
"""

#: Notices by which a work says what it is licensed under.
NOTICES = """
mit | mit,expat | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: x11)?(?: licen[cs]e)?(?: see (?:[a-z0-9]+ ){0,4}licen[cs]e)?|(?:the )?mit(?: x11)? licen[cs]e mit
mit | expat | expat licen[cs]e
mit | x11 | mit x11 licen[cs]e
isc | isc | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?isc(?: licen[cs]e)?
bsd | bsd | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the |a )?(?:terms of (?:the )?)?(?:(?:2|3|4|two|three|four) clause |new |modified |simplified |revised )?bsd(?: style)?(?: licen[cs]e)?
bsd | bsd | use of this source code is governed by a bsd style licen[cs]e
bsd | governed | use of this source code is governed by
apache | apache | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?(?: version)? 2(?: 0)?
apache | apache | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e
apache | apache | www apache org licenses license 2 0
apache | asf | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | gpl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: v?[1-3])?
gpl | gnu | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu (?:gpl|general public licen[cs]e)
gpl | gnu | www gnu org (?:licenses|copyleft) gpl(?: (?:2|3) 0)?
gpl | copying | see the file copying
gpl | dual | dual licen[cs]ed under (?:the )?(?:mit|bsd|apache) (?:and|or) (?:the )?gpl
lgpl | lgpl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl
lgpl | gnu | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu (?:lesser|library) general public licen[cs]e
lgpl | gnu | www gnu org (?:licenses|copyleft) lgpl
agpl | agpl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl
agpl | affero | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[cs]e
agpl | gnu | www gnu org licenses agpl
gfdl | gfdl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gfdl
gfdl | gnu | www gnu org (?:licenses|copyleft) fdl
mpl | mpl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?mpl(?: (?:v ?)?2(?: 0)?)?
mpl | mozilla | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e
mpl | mozilla | mozilla org mpl 2 0
epl | eclipse | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e
epl | eclipse | www eclipse org legal epl (?:v10|2 0|v20)
cddl | cddl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?cddl
bsl | boost | (?:licen[cs]ed|released|available|provided|published) under (?:the )?(?:terms of (?:the )?)?boost(?: software)? licen[cs]e
bsl | boost | www boost org license 1 0 txt
ofl | ofl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:sil )?ofl
ofl | sil | scripts sil org ofl
zlib | zlib | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?zlib(?: licen[cs]e)?
artistic | artistic | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?artistic licen[cs]e
unlicense | unlicense | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?unlicense
unlicense | unlicense | unlicense org
wtfpl | wtfpl | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?wtfpl
wtfpl | wtfpl | www wtfpl net
cc0 | cc0 | (?:licen[cs]ed|released|distributed|available|provided|published|dedicated) (?:under|with|to) (?:the )?(?:terms of (?:the )?)?cc0
cc0 | creativecommons | creativecommons org publicdomain zero
public-domain | creativecommons | creativecommons org publicdomain mark
cc | creative | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:a |the )?(?:terms of (?:the |a )?)?creative commons
cc | cc | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:a |the )?(?:terms of (?:the |a )?)?cc(?: by)?
osi | opensource | (?:www )?opensource org licenses [a-z0-9]+
artistic | perl | same terms as (?:the )?perl(?: programming language system)?(?: itself)?
"""

#: What says something of rights without naming a license.
GENERAL = """
public-domain | domain | (?:(?:in|into|to|is|are|of) (?:the )?)?public domain
public-domain | dedicated | dedicated to the public
cc0 | zero | (?:creative commons|cc) zero
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
warranty | merchantability | (?:the )?implied warrant(?:y|ies) of merchantability
warranty | liable | in no event (?:shall|will) the (?:authors?|copyright (?:holders?|owner)|regents|contributors)(?: or (?:copyright holders?|contributors))? be (?:held )?liable
warranty | warranty | without (?:any )?warranty(?: of any kind)?
warranty | risk | (?:use it )?at your own risk
proprietary | reserved | all rights reserved
proprietary | confidential | proprietary and confidential|confidential and proprietary
proprietary | confidential | (?:strictly |company )confidential
proprietary | unauthorized | unauthorized (?:copying|use|distribution|reproduction|access|disclosure)
proprietary | prohibited | (?:copying|distribution|reproduction|redistribution|use) is (?:strictly )?prohibited
proprietary | trade | (?:contains|constitutes?) (?:the )?trade secrets?
proprietary | consent | without (?:the )?(?:express |prior )*(?:written )?consent of
proprietary | permission | may not be (?:copied|reproduced|redistributed|used) without (?:the )?(?:express |prior )?(?:written )?permission
proprietary | internal | for internal use only
non-commercial | commercial,noncommercial | (?:for )?non ?commercial (?:use|purposes) only|not for commercial use
non-commercial | noncommercial | (?:for )?noncommercial (?:use|purposes)(?: only)?
non-commercial | personal | for personal use only
academic | research,academic,educational | for (?:academic|research|educational) (?:and (?:academic|research|educational) )?(?:use|purposes)(?: only)?|research use only
freeware | freeware | (?:this (?:software|program) is )?freeware
shareware | shareware | (?:this (?:software|program) is )?shareware
copyright | copyright | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | copyright | (?:the )?copyright holders?
patent | patent,patents | patents? (?:pending|and patents pending)|covered by (?:one or more )?patents
trademark | trademark,trademarks | (?:registered )?trademarks? of
license-file | license | see (?:the )?(?:accompanying |attached |included |enclosed )?license(?: file| txt| md)?(?: for (?:more )?(?:details|information|terms))?
license-file | licence | see (?:the )?(?:accompanying |attached |included |enclosed )?licence(?: file| txt| md)?
spdx | spdx | spdx licen[cs]e identifier [a-z0-9]+
spdx | spdx | spdx filecopyrighttext
"""


def parsed(block: str) -> list[tuple[str, str, str]]:
    """Label, keyword, pattern of each rule; one with several keywords comes once with each."""
    rows = [line.split(" | ", 2) for line in block.strip().splitlines()]
    return [(label.strip(), word, pattern.strip()) for label, words, pattern in rows for word in words.strip().split(",")]
