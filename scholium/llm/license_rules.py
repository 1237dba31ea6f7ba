"""Signature rules of licenses, in the order of their kinds and then as they stand.

One rule a line: kind, keyword, label, and a regular expression over a text's
lower-cased words with one space between them (so "GPL-2.0+" is "gpl 2 0" and a
web address is its words). A rule is only tried on texts that have its keyword,
which is a word of everything that it matches. ``<the>`` and ``<v>`` stand for an
optional article and an optional "version".
"""

from __future__ import annotations

from typing import NamedTuple

#: Kinds from the strongest to the weakest, and how sure a detection of each is.
KINDS = {"text": 1.0, "notice": 0.95, "tag": 0.9, "name": 0.8, "hint": 0.4}
SHORT = {"<the>": "(?:the )?", "<v>": "(?:v(?:ersion)?(?: )?)?", "<under>": "(?:released|licensed|distributed|available|provided|published|covered|made available|redistributable) (?:only )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"}


class Rule(NamedTuple):
    kind: str
    keyword: str
    label: str
    regex: str


LINES = r"""
text permission mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text sublicense mit to use copy modify merge publish distribute sublicense and or sell copies of the software
text permission mit-0 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <the>software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
text consortium x11 name of the x consortium shall not be used in advertising
text fee isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
text fee isc permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
text fee 0bsd permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
text supporting hpnd permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
text endorse bsd-3-clause may be used to endorse or promote products derived from this software without specific prior written permission
text redistributions bsd redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text redistributions bsd redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
text advertising bsd-4-clause all advertising materials mentioning features or use of this software must display the following acknowledge?ment
text patent bsd-3-clause-clear no express or implied licenses to any party s patent rights are granted by this license
text freebsd bsd-2-clause-views official policies either expressed or implied of the freebsd project
text nuclear bsd-3-clause-no-nuclear not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
text apache apache-2.0 apache license version 2 0 january 2004
text apache apache-2.0 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
text perpetual apache-2.0 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
text apache apache-1.1 this product includes software developed by the apache software foundation
text apache apache-1.0 this product includes software developed by the apache group for use in the apache http server project
text copyleft gpl <the>gnu general public license is a free copyleft license for software and other kinds of works
text guarantee gpl <the>gnu general public license is intended to guarantee your freedom to share and change free software
text redistribute gpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
text redistribute gpl-2.0-or-later you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
text redistribute gpl-1.0-or-later you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 or (?:at your option )?any later version
text redistribute gpl-3.0-only you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3(?: of the license)?
text redistribute gpl-2.0-only you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2(?: of the license)?
text redistribute gpl-2.0-only you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
text redistribute lgpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
text redistribute lgpl-2.1-or-later you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
text redistribute lgpl-2.0-or-later you can redistribute it and or modify it under the terms of the gnu (?:library|lesser) general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
text redistribute agpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
text redistribute agpl-3.0-only you can redistribute it and or modify it under the terms of the gnu affero general public license (?:version 3 )?as published by the free software foundation(?: version 3)?
text affero agpl-3.0 <the>gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community
text mozilla mpl-2.0 this source code form is subject to the terms of the mozilla public license <v>2 0
text mozilla mpl-1.1 the contents of this file are subject to the mozilla public license version 1 1
text mozilla mpl-1.0 the contents of this file are subject to the mozilla public license version 1 0
text netscape npl-1.1 the contents of this file are subject to the netscape public license version 1 1
text eclipse epl-2.0 this program and the accompanying materials are made available under the terms of the eclipse public license <v>2 0
text eclipse epl-1.0 (?:this program and the accompanying materials are made available under the terms of the|all rights reserved this program and the accompanying materials are made available under the terms of the) eclipse public license <v>1 0
text development cddl-1.0 subject to the terms of the common development and distribution license <the>license you may not use this file except in compliance with the license
text development cddl-1.0 the contents of this file are subject to the terms of the common development and distribution license
text common cpl-1.0 the accompanying program is provided under the terms of this common public license
text ibm ipl-1.0 the accompanying program is provided under the terms of this ibm public license
text verbatim artistic-2.0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
text semblance artistic-1.0 the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
text boost bsl-1.0 boost software license version 1 0 august 17th 2003
text accompanying bsl-1.0 distributed under the boost software license version 1 0 see accompanying file
text misrepresented zlib the origin of this software must not be misrepresented you must not claim that you wrote the original software
text unencumbered unlicense this is free and unencumbered software released into the public domain
text fuck wtfpl you just do what the fuck you want to
text affirmer cc0-1.0 to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
text extent cc0-1.0 to the extent possible under law the (?:author s|authors|person who associated cc0 with this work) (?:have|has) (?:dedicated|waived) all copyright and related
text retain beerware as long as you retain this notice you can do whatever you want with this stuff
text font ofl-1.1 this font software is licensed under the sil open font license version 1 1
text postgresql postgresql postgresql database management system formerly known as postgres
text university ncsa university of illinois ncsa open source license
text openssl openssl this product includes software developed by the openssl project for use in the openssl toolkit
text cryptographic openssl this product includes cryptographic software written by eric young
text python psf-2.0 this license agreement is between the python software foundation psf and the individual or organization
text stichting psf-2.0 stichting mathematisch centrum amsterdam the netherlands
text bsdl ruby you may redistribute it and or modify it under either the terms of the 2 clause bsdl
text php php-3.01 this product includes php software freely available from
text zope zpl-2.1 zope public license zpl version 2 1
text european eupl-1.2 this european union public licence the eupl applies to the work
text discussions cecill-2.1 this agreement is a free software license agreement that is the result of discussions between its authors
text accompanying ms-pl this license governs use of the accompanying software if you use the software you accept this license
text reciprocal ms-rl microsoft reciprocal license ms rl this license governs use of the accompanying software
text unicode unicode-dfs-2016 unicode inc license agreement data files and software
text evil json the software shall be used for good not evil
text grant commons-clause the license does not grant to you and you are not granted the right to sell the software
text hosted elastic-2.0 you may not provide the software to third parties as a hosted or managed service
text server sspl-1.0 server side public license version 1 october 16 2018
text production busl-1.1 you may make production use of the licensed work provided
text business busl-1.1 the business source license this document or the license is not an open source license
text proprietary proprietary this software is the (?:confidential and )?proprietary (?:information|property) of
text confidential proprietary unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential
notice mit mit <under>mit license
notice mit mit (?:use of this source code is governed by|subject to|governed by) (?:an|the|a) mit style license
notice mit mit dual licensed under <the>mit
notice x11 x11 <under>x11 license
notice isc isc <under>isc license
notice bsd bsd <under>bsd license
notice bsd bsd (?:use of this source code is governed by|governed by) a bsd style license
notice license bsd-2-clause <under>(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) license
notice license bsd-3-clause <under>(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd) license
notice license bsd-4-clause <under>(?:original bsd|bsd 4 clause|4 clause bsd) license
notice apache apache <under>apache (?:software )?license
notice apache apache-2.0 <under>apache (?:software )?license <v>2(?: 0)?
notice apache apache-2.0 <under>apache 2(?: 0)?(?: license)?
notice apache apache-1.1 <under>apache (?:software )?license <v>1 1
notice general gpl <under>(?:gnu )?general public license
notice gpl gpl <under>(?:gnu )?gpl
notice general gpl-3.0 <under>(?:gnu )?general public license <v>3(?: 0)?
notice general gpl-2.0 <under>(?:gnu )?general public license <v>2(?: 0)?
notice general gpl-1.0 <under>(?:gnu )?general public license <v>1(?: 0)?
notice gpl gpl-3.0 <under>(?:gnu )?gpl <v>3(?: 0)?
notice gpl gpl-2.0 <under>(?:gnu )?gpl <v>2(?: 0)?
notice later gpl-3.0-or-later <under>(?:gnu )?general public license <v>3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
notice later gpl-2.0-or-later <under>(?:gnu )?general public license <v>2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
notice later gpl-3.0-or-later <under>(?:gnu )?gpl <v>3(?: 0)? or (?:any )?later
notice later gpl-2.0-or-later <under>(?:gnu )?gpl <v>2(?: 0)? or (?:any )?later
notice lesser lgpl <under>(?:gnu )?lesser general public license
notice lesser lgpl-3.0 <under>(?:gnu )?lesser general public license <v>3(?: 0)?
notice lesser lgpl-2.1 <under>(?:gnu )?lesser general public license <v>2 1
notice library lgpl-2.0 <under>(?:gnu )?library general public license(?: <v>2(?: 0)?)?
notice lgpl lgpl <under>(?:gnu )?lgpl
notice lgpl lgpl-3.0 <under>(?:gnu )?lgpl <v>3(?: 0)?
notice lgpl lgpl-2.1 <under>(?:gnu )?lgpl <v>2 1
notice affero agpl <under>(?:gnu )?affero general public license
notice affero agpl-3.0 <under>(?:gnu )?affero general public license <v>3(?: 0)?
notice agpl agpl <under>(?:gnu )?agpl
notice agpl agpl-3.0 <under>(?:gnu )?agpl <v>3(?: 0)?
notice documentation gfdl <under>gnu free documentation license
notice documentation gfdl-1.3 <under>gnu free documentation license <v>1 3
notice documentation gfdl-1.2 <under>gnu free documentation license <v>1 2
notice mozilla mpl <under>mozilla public license
notice mozilla mpl-2.0 <under>mozilla public license <v>2(?: 0)?
notice mozilla mpl-1.1 <under>mozilla public license <v>1 1
notice mpl mpl-2.0 <under>mpl <v>2(?: 0)?
notice eclipse epl <under>eclipse public license
notice eclipse epl-2.0 <under>eclipse public license <v>2(?: 0)?
notice eclipse epl-1.0 <under>eclipse public license <v>1(?: 0)?
notice boost bsl-1.0 <under>boost software license
notice zlib zlib <under>zlib(?: libpng)? license
notice unlicense unlicense <under>unlicense
notice creative cc <under>creative commons
notice creative cc-by <under>creative commons attribution(?: license)?
notice creative cc-by-4.0 <under>creative commons attribution 4 0(?: international)?(?: license)?
notice creative cc-by-3.0 <under>creative commons attribution 3 0(?: unported)?(?: license)?
notice creative cc-by-sa <under>creative commons attribution share(?: )?alike(?: license)?
notice creative cc-by-sa-4.0 <under>creative commons attribution share(?: )?alike 4 0(?: international)?(?: license)?
notice creative cc-by-sa-3.0 <under>creative commons attribution share(?: )?alike 3 0(?: unported)?(?: license)?
notice creative cc-by-nc <under>creative commons attribution non(?: )?commercial(?: license)?
notice creative cc-by-nc-4.0 <under>creative commons attribution non(?: )?commercial 4 0(?: international)?(?: license)?
notice creative cc-by-nc-sa <under>creative commons attribution non(?: )?commercial share(?: )?alike(?: license)?
notice creative cc-by-nc-sa-4.0 <under>creative commons attribution non(?: )?commercial share(?: )?alike 4 0(?: international)?(?: license)?
notice creative cc-by-nd <under>creative commons attribution no(?: )?deriv(?:ative)?s(?: license)?
notice creative cc-by-nc-nd <under>creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s(?: license)?
notice creative cc0-1.0 <under>creative commons (?:zero|cc0)
notice cc cc-by <under>cc by
notice cc cc-by-4.0 <under>cc by 4 0
notice cc cc-by-3.0 <under>cc by 3 0
notice cc cc-by-2.0 <under>cc by 2 0
notice cc cc-by-sa <under>cc by sa
notice cc cc-by-sa-4.0 <under>cc by sa 4 0
notice cc cc-by-sa-3.0 <under>cc by sa 3 0
notice cc cc-by-nc <under>cc by nc
notice cc cc-by-nc-4.0 <under>cc by nc 4 0
notice cc cc-by-nc-sa <under>cc by nc sa
notice cc cc-by-nc-sa-4.0 <under>cc by nc sa 4 0
notice cc cc-by-nd <under>cc by nd
notice cc cc-by-nd-4.0 <under>cc by nd 4 0
notice cc cc-by-nc-nd <under>cc by nc nd
notice cc cc-by-nc-nd-4.0 <under>cc by nc nd 4 0
notice cc0 cc0-1.0 <under>cc0
notice perl artistic-1.0-perl under the same terms as perl (?:itself|5)
notice artistic artistic <under>artistic license
notice artistic artistic-2.0 <under>artistic license <v>2(?: 0)?
notice ruby ruby <under>ruby license
notice python psf <under>python software foundation license
notice postgresql postgresql <under>postgresql license
notice wtfpl wtfpl <under>wtfpl
notice font ofl-1.1 <under>sil open font license
notice open odbl-1.0 <under>open database license
notice european eupl <under>european union public licen[cs]e
notice commercial proprietary <under>commercial license
notice proprietary proprietary <under>proprietary license
tag spdx mit spdx license identifier mit
tag spdx mit-0 spdx license identifier mit 0
tag spdx apache-2.0 spdx license identifier apache 2 0
tag spdx bsd-2-clause spdx license identifier bsd 2 clause
tag spdx bsd-3-clause spdx license identifier bsd 3 clause
tag spdx 0bsd spdx license identifier 0bsd
tag spdx isc spdx license identifier isc
tag spdx gpl-2.0 spdx license identifier gpl 2 0
tag spdx gpl-2.0-only spdx license identifier gpl 2 0 only
tag spdx gpl-2.0-or-later spdx license identifier gpl 2 0 or later
tag spdx gpl-3.0 spdx license identifier gpl 3 0
tag spdx gpl-3.0-only spdx license identifier gpl 3 0 only
tag spdx gpl-3.0-or-later spdx license identifier gpl 3 0 or later
tag spdx lgpl-2.1 spdx license identifier lgpl 2 1
tag spdx lgpl-2.1-only spdx license identifier lgpl 2 1 only
tag spdx lgpl-2.1-or-later spdx license identifier lgpl 2 1 or later
tag spdx lgpl-3.0 spdx license identifier lgpl 3 0
tag spdx lgpl-3.0-only spdx license identifier lgpl 3 0 only
tag spdx lgpl-3.0-or-later spdx license identifier lgpl 3 0 or later
tag spdx agpl-3.0 spdx license identifier agpl 3 0
tag spdx agpl-3.0-only spdx license identifier agpl 3 0 only
tag spdx agpl-3.0-or-later spdx license identifier agpl 3 0 or later
tag spdx mpl-2.0 spdx license identifier mpl 2 0
tag spdx epl-2.0 spdx license identifier epl 2 0
tag spdx epl-1.0 spdx license identifier epl 1 0
tag spdx cddl-1.0 spdx license identifier cddl 1 0
tag spdx bsl-1.0 spdx license identifier bsl 1 0
tag spdx zlib spdx license identifier zlib
tag spdx unlicense spdx license identifier unlicense
tag spdx cc0-1.0 spdx license identifier cc0 1 0
tag spdx cc-by-4.0 spdx license identifier cc by 4 0
tag spdx cc-by-sa-4.0 spdx license identifier cc by sa 4 0
tag spdx ofl-1.1 spdx license identifier ofl 1 1
tag spdx artistic-2.0 spdx license identifier artistic 2 0
tag spdx eupl-1.2 spdx license identifier eupl 1 2
tag spdx busl-1.1 spdx license identifier busl 1 1
tag spdx elastic-2.0 spdx license identifier elastic 2 0
tag spdx wtfpl spdx license identifier wtfpl
tag osi mit license osi approved mit license
tag osi bsd license osi approved bsd license
tag osi apache license osi approved apache software license
tag osi gpl license osi approved gnu general public license
tag osi gpl-3.0 license osi approved gnu general public license v3
tag osi gpl-2.0 license osi approved gnu general public license v2
tag osi mpl-2.0 license osi approved mozilla public license 2 0
tag osi lgpl license osi approved gnu lesser general public license
name mit mit mit license
name mit mit mit licensed
name mit mit license mit
name mit mit mit x11(?: license)?
name expat mit expat license
name isc isc isc license
name bsd bsd bsd licensed?
name bsd bsd-2-clause bsd 2 clause(?: license)?
name bsd bsd-2-clause (?:2 clause|two clause|simplified) bsd(?: license)?
name bsd bsd-3-clause bsd 3 clause(?: license)?
name bsd bsd-3-clause (?:3 clause|three clause|new|revised|modified) bsd(?: license)?
name bsd bsd-4-clause bsd 4 clause(?: license)?
name apache apache apache (?:software )?license
name apache apache-2.0 apache (?:software )?license <v>2(?: 0)?
name apache apache-2.0 apache 2 0(?: license)?
name apache apache-2.0 apache licensed? 2 0
name general gpl (?:gnu )?general public license
name general gpl-3.0 (?:gnu )?general public license <v>3(?: 0)?
name general gpl-2.0 (?:gnu )?general public license <v>2(?: 0)?
name general gpl-1.0 (?:gnu )?general public license <v>1(?: 0)?
name gpl gpl gnu gpl
name gpl gpl-3.0 gpl <v>3(?: 0)?
name gpl gpl-2.0 gpl <v>2(?: 0)?
name gplv3 gpl-3.0 gplv3
name gplv2 gpl-2.0 gplv2
name lesser lgpl (?:gnu )?lesser general public license
name lesser lgpl-3.0 (?:gnu )?lesser general public license <v>3(?: 0)?
name lesser lgpl-2.1 (?:gnu )?lesser general public license <v>2 1
name library lgpl-2.0 (?:gnu )?library general public license
name lgpl lgpl-3.0 lgpl <v>3(?: 0)?
name lgpl lgpl-2.1 lgpl <v>2 1
name affero agpl (?:gnu )?affero general public license
name affero agpl-3.0 (?:gnu )?affero general public license <v>3(?: 0)?
name agpl agpl-3.0 agpl <v>3(?: 0)?
name documentation gfdl gnu free documentation license
name mozilla mpl mozilla public license
name mozilla mpl-2.0 mozilla public license <v>2(?: 0)?
name mozilla mpl-1.1 mozilla public license <v>1 1
name eclipse epl eclipse public license
name eclipse epl-2.0 eclipse public license <v>2(?: 0)?
name common cpl-1.0 common public license
name cddl cddl-1.0 cddl 1 0
name development cddl common development and distribution license
name boost bsl-1.0 boost software license
name zlib zlib zlib(?: libpng)? license
name unlicense unlicense <the>unlicense
name creative cc creative commons(?: license)?
name creative cc-by creative commons attribution(?: license)?
name creative cc-by-sa creative commons attribution share(?: )?alike(?: license)?
name creative cc-by-nc creative commons attribution non(?: )?commercial(?: license)?
name creative cc-by-nd creative commons attribution no(?: )?deriv(?:ative)?s(?: license)?
name cc cc-by-4.0 cc by 4 0
name cc cc-by-sa-4.0 cc by sa 4 0
name cc cc-by-nc-4.0 cc by nc 4 0
name cc0 cc0-1.0 cc0(?: 1 0)?(?: universal)?
name artistic artistic artistic license
name artistic artistic-2.0 artistic license <v>2(?: 0)?
name wtfpl wtfpl wtfpl
name font ofl-1.1 (?:sil )?open font license
name postgresql postgresql postgresql license
name python psf python software foundation license
name openssl openssl openssl license
name database odbl-1.0 open database license
name elastic elastic-2.0 elastic license(?: <v>2(?: 0)?)?
name server sspl-1.0 server side public license
name source busl-1.1 business source license
name european eupl european union public licen[cs]e
name microsoft ms-pl microsoft public license
name beerware beerware beerware license
name domain public-domain (?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain
hint opensource mit opensource org licenses? mit(?: license)?
hint opensource bsd opensource org licenses? bsd license
hint opensource bsd-3-clause opensource org licenses? bsd 3 clause
hint opensource bsd-2-clause opensource org licenses? bsd 2 clause
hint opensource isc opensource org licenses? isc
hint apache apache-2.0 apache org licenses license 2 0
hint gnu gpl gnu org licenses gpl
hint gnu gpl-3.0 gnu org licenses gpl 3 0
hint gnu gpl-2.0 gnu org licenses (?:old licenses )?gpl 2 0
hint gnu lgpl gnu org licenses lgpl
hint gnu agpl-3.0 gnu org licenses agpl(?: 3 0)?
hint mozilla mpl-2.0 mozilla org mpl 2 0
hint eclipse epl eclipse org legal epl
hint boost bsl-1.0 boost org license 1 0
hint creativecommons cc-by creativecommons org licenses by
hint creativecommons cc-by-4.0 creativecommons org licenses by 4 0
hint creativecommons cc-by-sa-4.0 creativecommons org licenses by sa 4 0
hint creativecommons cc-by-nc-4.0 creativecommons org licenses by nc 4 0
hint creativecommons cc0-1.0 creativecommons org publicdomain zero 1 0
hint unlicense unlicense unlicense org
hint lgpl lgpl lgpl
hint agpl agpl agpl
hint reserved all-rights-reserved all rights reserved
"""


def rules(lines: str = LINES) -> list[Rule]:
    """The rules, strongest kinds first; where detections are otherwise alike, the earlier rule wins."""
    made = []
    for line in lines.strip().splitlines():
        kind, keyword, label, regex = line.split(" ", 3)
        for short, long in SHORT.items():
            regex = regex.replace(short, long)
        made.append(Rule(kind, keyword, label, regex))
    return sorted(made, key=lambda r: list(KINDS).index(r.kind))
