"""Hand-written signatures of licenses: texts, notices, names, addresses, short forms.

One rule a line: priority (1 best), label, keyword, regular expression; ignoring
case, and a blank stands for any white space. The keyword, in lower case, is a
whole word of every match of its rule; after a * it is any part of a match.
"""

TEXTS = r"""
1 mit | obtaining | permission is hereby granted, free of charge, to any person obtaining a copy
1 mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions
1 mit-0 | restriction | to deal in the software without restriction, including without limitation
1 isc | license | isc license:? copyright
1 isc | distribute | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose
1 hpnd | distribute | permission to use, copy, modify,? and distribute this software and its documentation
1 0bsd | distribute | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software
1 bsd | without | redistribution and use in source and binary forms,? with or without modification
1 bsd-3-clause | contributors | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
1 bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
1 bsd-2-clause-patent | contributor | each copyright holder and contributor hereby grants .{0,60}?royalty-free
1 zlib | provided | this software is provided 'as-is', without any express or implied warranty
1 zlib | software | the origin of this software must not be misrepresented
1 libpng | reference | the png reference library is supplied
1 apache-1.1 | developed | this product includes software developed by the apache software foundation
1 apache-2.0 | compliance | you may not use this file except in compliance with the license
1 apache-2.0 | conditions | distributed on an \"?as is\"? basis, without warranties or conditions of any kind
1 apache-2.0 | contributor | each contributor hereby grants to you a perpetual, worldwide, non-exclusive
1 gpl | redistribute | this program is free software[;:,]? you can redistribute it and/or modify
1 gpl | distribute | everyone is permitted to copy and distribute verbatim copies of this license document
1 gpl | copyleft | preamble the gnu general public license is a free, copyleft license
1 gpl-2.0 | foundation | as published by the free software foundation[;,] either version 2
1 gpl-3.0 | foundation | as published by the free software foundation[;,] either version 3
1 gpl-2.0-only | version | gpl,? version 2 only
1 lgpl | redistribute | this library is free software[;:,]? you can redistribute it and/or modify
1 lgpl | lesser | terms of the gnu lesser general public license
1 agpl | affero | terms of the gnu affero general public license
1 agpl | interaction | remote network interaction; use with the gnu general public license
1 gfdl | invariant | with no invariant sections, no front-cover texts,? and no back-cover texts
1 gfdl | documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
1 mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license,? v\. 2\.0
1 mpl-1.1 | contents | the contents of this file are subject to the mozilla public license version 1\.1
1 epl-1.0 | available | accompanying materials are made available under the terms of the eclipse public license v1\.0
1 epl-2.0 | available | accompanying materials are made available under the terms of the eclipse public license 2\.0
1 cddl | distribution | the contents of this file are subject to the terms of the common development and distribution license
1 cpl | accompanying | the accompanying program is provided under the terms of this common public license
1 ipl | accompanying | the accompanying program is provided under the terms of this ibm public license
1 eupl | eupl | licensed under the eupl,? version
1 cecill | governed | this software is governed by the cecill(?:-[bc])? license
1 artistic | distributed | this package may be used, modified,? and distributed under the artistic license
1 artistic | distribute | you may distribute under the terms of either the gnu general public license or the artistic license, as specified in the (?:readme|perl)
1 perl | terms | under the same terms as perl itself
1 bsl-1.0 | software | distributed under the boost software license, version 1\.0
1 bsl-1.0 | executable | solely in the form of machine-executable object code generated by a source language processor
1 busl | licensor | the licensor hereby grants you .{0,80}?change date
1 sspl | functionality | making the functionality of the program .{0,60}?service source code
1 elastic | software | you may not provide the software to third parties as a hosted or managed service
1 commons-clause | grant | the license does not grant to you,? the right to sell the software
1 polyform | noncommercial | polyform noncommercial license
1 unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 public-domain | into | released into the public domain
1 public-domain | public | dedicated to the public domain
1 public-domain | public | (?:placed|put) in the public domain
1 cc0 | unconditionally | affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives
1 cc0 | cc0 | \bcc0 1\.0 universal
1 wtfpl | fuck | do what the fuck you want to public license
1 beerware | buy | you can buy me a beer in return
1 ofl | software | this font software is licensed under the sil open font license
1 ofl | font | with reserved font name
1 odbl | available | this .{0,40}?database is made available under the open database license
1 pddl | dedication | public domain dedication and license
1 openssl | developed | this product includes software developed by the openssl project
1 ssleay | cryptographic | this product includes cryptographic software written by eric young
1 php | includes | this product includes php software
1 psf | nonexclusive | psf hereby grants licensee a nonexclusive, royalty-free,? world-wide license .{0,80}?python
1 cnri | nonexclusive | cnri hereby grants licensee a nonexclusive, royalty-free
1 ruby | verbatim | you may make and give away verbatim copies of the source form .{0,60}?ruby
1 tcl | copyrighted | this software is copyrighted by .{0,120}?tcl
1 vim | distributing | there are no restrictions on distributing unmodified copies of vim
1 w3c | copyright | this work is being provided by the copyright holders under .{0,20}?w3c
1 x11 | contained | except as contained in this notice, the name of the x consortium
1 icu | granted | permission is hereby granted .{0,120}?unicode data files
1 ncsa | illinois | university of illinois/ncsa open source license
1 intel | redistribution | redistribution\. redistribution and use in binary form, without modification, .{0,40}?intel
1 json | software | the software shall be used for good, not evil
1 curl | stenberg | copyright .{0,60}?daniel stenberg .{0,400}?curl
1 ftl | copyright | portions of this software are copyright .{0,20}?the freetype project
1 jpeg | independent | this software is based in part on the work of the independent jpeg group
1 latex | distributed | this work may be distributed and/or modified under the conditions of the latex project public license .{0,200}?lppl
1 ms-pl | reciprocal | microsoft reciprocal license
1 nvidia | software | nvidia software license
1 oracle | license | oracle (?:binary code|technology network) license agreement
1 eula | agreement | end[- ]user license agreement .{0,20}?eula
1 eula | user | this end[- ]user license agreement
1 proprietary | proprietary | \bproprietary and confidential
1 proprietary | strictly | unauthorized copying of this file,? via any medium,? is strictly prohibited
1 proprietary | confidential | contains? confidential and trade secret
1 cc-by | attribution | licensed under a creative commons attribution(?: [0-9.]+ international)? license
1 cc-by-sa | attribution | creative commons attribution-sharealike
1 cc-by-nc | attribution | creative commons attribution-noncommercial
1 cc-by-nd | attribution | creative commons attribution-noderiv(?:ative)?s
1 cc-by-nc-sa | noncommercial | creative commons attribution-noncommercial-sharealike
1 cc-by-nc-nd | noncommercial | creative commons attribution-noncommercial-noderiv(?:ative)?s
1 ogl | information | contains public sector information licensed under the open government licence
1 openrail | responsible | \bresponsible ai license
1 llama | community | llama (?:[0-9] )?community license
"""

ADDRESSES = r"""
1 cc-by | licenses | creativecommons\.org/licenses/by/[0-9.]+
1 cc-by-sa | licenses | creativecommons\.org/licenses/by-sa/[0-9.]+
1 cc-by-nc | licenses | creativecommons\.org/licenses/by-nc/[0-9.]+
1 cc-by-nd | licenses | creativecommons\.org/licenses/by-nd/[0-9.]+
1 cc-by-nc-sa | licenses | creativecommons\.org/licenses/by-nc-sa/[0-9.]+
1 cc-by-nc-nd | licenses | creativecommons\.org/licenses/by-nc-nd/[0-9.]+
1 cc0 | publicdomain | creativecommons\.org/publicdomain/zero/[0-9.]+
1 public-domain | publicdomain | creativecommons\.org/publicdomain/mark/[0-9.]+
1 gpl | licenses | gnu\.org/licenses/(?:old-licenses/)?gpl
1 gpl | copyleft | gnu\.org/copyleft/gpl
1 lgpl | licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl
1 lgpl | copyleft | gnu\.org/copyleft/lesser
1 agpl | licenses | gnu\.org/licenses/agpl
1 gfdl | licenses | gnu\.org/licenses/(?:old-licenses/)?fdl
1 gfdl | copyleft | gnu\.org/copyleft/fdl
1 apache-2.0 | licenses | apache\.org/licenses/license-2\.0
1 apache-1.1 | licenses | apache\.org/licenses/license-1\.1
1 mpl | org | mozilla\.org/(?:en-us/)?mpl
1 epl | org | eclipse\.org/(?:legal|org/documents)/epl
1 bsl-1.0 | org | boost\.org/license_1_0
1 ofl | org | scripts\.sil\.org/ofl
1 unlicense | unlicense | \bunlicense\.org
1 wtfpl | wtfpl | \bwtfpl\.net
1 odbl | licenses | opendatacommons\.org/licenses/odbl
1 pddl | licenses | opendatacommons\.org/licenses/pddl
1 odc-by | licenses | opendatacommons\.org/licenses/by
1 eupl | europa | joinup\.ec\.europa\.eu/.{0,60}?eupl
1 cecill | info | cecill\.info/licen[cs]es
1 sspl | licensing | mongodb\.com/licensing/server-side-public-license
1 elastic | licensing | elastic\.co/licensing/elastic-license
1 ogl | government | nationalarchives\.gov\.uk/doc/open-government-licence
1 mit | org | opensource\.org/licenses?/mit
1 bsd-3-clause | bsd | opensource\.org/licenses?/bsd-3-clause
1 bsd-2-clause | bsd | opensource\.org/licenses?/bsd-2-clause
1 isc | org | opensource\.org/licenses?/isc
1 osi | org | opensource\.org/licenses?/[a-z0-9.-]+
2 rights-statement | vocab | rightsstatements\.org/vocab/[a-z-]+
"""

NAMES = r"""
2 afl | free | academic free license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 agpl | affero | gnu affero general public license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 apache | apache | \bapache (?:software )?license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 apsl | source | apple public source license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 artistic | artistic | \bartistic license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 bsd-2-clause | licence | \b(?:bsd 2-clause|2-clause bsd|simplified bsd|freebsd) licen[cs]e\b
2 bsd-3-clause | bsd | \b(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e
2 bsd-4-clause | bsd | \b(?:bsd 4-clause|4-clause bsd|original bsd) licen[cs]e
2 bsd | bsd | \bbsd(?:-style)? licen[cs]e
2 blueoak | model | blue oak model license
2 bsl-1.0 | software | boost software license
2 busl | source | business source license
2 cddl | distribution | common development and distribution license
2 cecill | cecill | \bcecill(?:-[bc])? licen[cs]e
2 cpl | public | common public license
2 cpal | attribution | common public attribution license
2 cc0 | commons | creative commons zero
2 cc-by | commons | creative commons attribution
2 cc | commons | creative commons licen[cs]e
2 ecl | community | educational community license
2 epl | public | eclipse public license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 eupl | union | european union public licen[cs]e
2 gfdl | documentation | gnu free documentation license
2 gpl | general | gnu general public license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 lgpl | lesser | gnu lesser general public license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 lgpl | library | gnu library general public license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 ipl | public | ibm public license
2 isc | isc | \bisc licen[cs]e
2 lppl | project | latex project public license
2 mit | mit | \bmit(?:/x11| x11)? licen[cs]e
2 mit | expat | \bexpat license
2 ms-pl | public | microsoft public license
2 mpl | public | mozilla public license(?:,? (?:version|v\.?) ?[0-9.]+)?
2 mulan | mulan | \bmulan (?:permissive software|psl) license
2 ncsa | source | ncsa open source license
2 nosa | source | nasa open source agreement
2 npl | public | netscape public license
2 odbl | database | open database license
2 odc-by | attribution | open data commons attribution license
2 ofl | font | (?:sil )?open font licen[cs]e
2 openldap | public | openldap public license
2 openssl | openssl | \bopenssl licen[cs]e
2 osl | software | \bopen software license
2 php | php | \bphp licen[cs]e
2 postgresql | postgresql | \bpostgresql licen[cs]e
2 psf | foundation | python software foundation licen[cs]e
2 qpl | q | \bq public license
2 rpl | public | reciprocal public license
2 ruby | ruby | \bruby licen[cs]e
2 sleepycat | sleepycat | \bsleepycat license
2 sspl | side | server side public license
2 sun | sun | \bsun (?:industry standards source|public) license
2 unlicense | unlicense | \bthe unlicense\b
2 upl | permissive | universal permissive license
2 vim | vim | \bvim license
2 vsl | software | vovida software license
2 w3c | software | w3c software (?:notice and|and document) license
2 watcom | watcom | sybase open watcom public license
2 x11 | x11 | \bx11 license
2 zend | zend | \bzend (?:engine )?license
2 zlib | zlib | \bzlib(?:/libpng)? licen[cs]e
2 zpl | public | zope public license
2 ogl | government | open government licen[cs]e
2 openrail | *rail | \b(?:creativeml |bigscience )?open ?rail(?:\+\+)?(?:-m)?
"""

SHORT = r"""
1 spdx | identifier | spdx-license-identifier: *[a-z0-9.+-]+
3 cc-by-nc-sa | sa | \bcc[ -]by[ -]nc[ -]sa\b
3 cc-by-nc-nd | cc | \bcc[ -]by[ -]nc[ -]nd\b
3 cc-by-sa | sa | \bcc[ -]by[ -]sa\b
3 cc-by-nc | cc | \bcc[ -]by[ -]nc\b
3 cc-by-nd | cc | \bcc[ -]by[ -]nd\b
3 cc-by | cc | \bcc[ -]by\b
3 cc0 | cc0 | \bcc0(?:[ -]1\.0)?\b
3 gpl-2.0 | *gpl | \bgpl ?(?:-|v|version )?2(?:\.0)?\b
3 gpl-3.0 | *gpl | \bgpl ?(?:-|v|version )?3(?:\.0)?\b
3 lgpl-2.1 | *gpl | \blgpl ?(?:-|v|version )?2\.1\b
3 lgpl-3.0 | *gpl | \blgpl ?(?:-|v|version )?3(?:\.0)?\b
3 agpl-3.0 | *gpl | \bagpl ?(?:-|v|version )?3(?:\.0)?\b
3 gpl | public | general public licen[cs]e(?:,? version [0-9.]+)?
3 mpl-2.0 | *mpl | \bmpl ?(?:-|v|version )?2(?:\.0)?\b
3 epl-2.0 | *epl | \bepl ?(?:-|v|version )?2(?:\.0)?\b
3 apache-2.0 | apache | \bapache[ -]2(?:\.0)?\b
3 bsd-3-clause | bsd | \bbsd[ -]3(?:-clause)?\b
3 bsd-2-clause | bsd | \bbsd[ -]2(?:-clause)?\b
3 mit | mit | \b(?:licen[cs]e|licensed)[: ] ?\"?mit\b
3 isc | licence | \blicen[cs]e[: ] ?\"?isc\b
3 copyleft | copyleft | \bcopyleft\b
3 open-source | source | \bopen source licen[cs]e
4 reserved | rights | (?:all|some|no) rights reserved
4 reserved | derechos | (?:todos )?los derechos reservados
4 reserved | rechte | alle rechte vorbehalten
4 reserved | droits | tous droits r.serv.s
4 copyright | copyright | \bcopyright (?:\(c\) |© ?)?[0-9]{4}
4 copyright | c | \(c\) [0-9]{4}
4 copyright | *© | © ?[0-9]{4}
4 licensed | terms | licensed under the terms of
4 licensed | licensed | (?:dual|multi)[- ]licensed under
4 licensed | license | see (?:the )?(?:file )?license (?:file )?for (?:more )?(?:details|information)
4 licensed | copying | see (?:the )?(?:file )?copying (?:file )?for (?:more )?(?:details|information)
4 licensed | license | see (?:the )?(?:accompanying )?license file
4 licensed | license | subject to (?:the terms of )?the license agreement
4 patent | pending | \bpatents? pending\b
4 patent | protected | \bprotected by (?:one or more )?(?:u\.s\. )?patents?
4 trademark | registered | \b(?:is a )?registered trademark
4 trademark | respective | trademarks? of their respective (?:owners|holders)
4 no-redistribution | reproduced | (?:no part of this .{1,40}?may be|may not be) reproduced\b
4 no-redistribution | redistribution | not for redistribution\b
4 no-commercial | use | (?:for )?non-?commercial use only
4 personal-use | personal | for personal use only
4 attribution | reprinted | \breprinted (?:with|by) (?:permission|courtesy) of
4 permission | permission | \b(?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission\b
4 terms | terms | (?:our|the) terms of (?:use|service)
"""


def parsed() -> list[tuple[str, str, str, int]]:
    """(keyword, pattern, label, priority), best first, in the order written."""
    out = []
    for line in (TEXTS + ADDRESSES + NAMES + SHORT).splitlines():
        if line:
            head, keyword, pattern = (x.strip() for x in line.split("|", 2))
            priority, label = head.split()
            for written, meant in (("[ ", r"[\s"), (": ]", r":\s]"), (" ?", r"\s*"), (" *", r"\s*"), (" ", r"\s+")):
                pattern = pattern.replace(written, meant)
            out.append((keyword, pattern, label, int(priority)))
    return sorted(out, key=lambda r: r[3])
