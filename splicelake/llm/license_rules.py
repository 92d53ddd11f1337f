"""Signatures of licenses: one rule a line, written by hand.

``priority | label | keywords | pattern``.  A text reads as lower-case words
(letters, digits and bytes beyond ASCII) joined by one space; a pattern has to
match whole words of it.  A rule is tried only on texts that hold one of its
keywords as a word.  Priorities: 9 identifiers and negations, 8 full notices,
7 grants, 6 addresses, 5 titles with a version, 4 titles, 3 short forms and
clauses, 2 hints, 1 anything that speaks of some license.
"""

from __future__ import annotations

#: The signatures.
SIGNATURES = r"""
9 | none | spdx | spdx licen[sc]e identifier (?:none|noassertion|unlicensed)
9 | mit | spdx | spdx licen[sc]e identifier mit
9 | mit-0 | spdx | spdx licen[sc]e identifier mit 0
9 | isc | spdx | spdx licen[sc]e identifier isc
9 | 0bsd | spdx | spdx licen[sc]e identifier 0bsd
9 | bsd-2-clause | spdx | spdx licen[sc]e identifier bsd 2 clause
9 | bsd-3-clause | spdx | spdx licen[sc]e identifier bsd 3 clause
9 | bsd-4-clause | spdx | spdx licen[sc]e identifier bsd 4 clause
9 | zlib | spdx | spdx licen[sc]e identifier zlib
9 | libpng-2.0 | spdx | spdx licen[sc]e identifier libpng 2 0
9 | unlicense | spdx | spdx licen[sc]e identifier unlicense
9 | wtfpl | spdx | spdx licen[sc]e identifier wtfpl
9 | cc0 | spdx | spdx licen[sc]e identifier cc0 1 0
9 | x11 | spdx | spdx licen[sc]e identifier x11
9 | ncsa | spdx | spdx licen[sc]e identifier ncsa
9 | postgresql | spdx | spdx licen[sc]e identifier postgresql
9 | python-2.0 | spdx | spdx licen[sc]e identifier (?:python|psf) 2 0
9 | openssl | spdx | spdx licen[sc]e identifier openssl
9 | upl-1.0 | spdx | spdx licen[sc]e identifier upl 1 0
9 | odbl-1.0 | spdx | spdx licen[sc]e identifier odbl 1 0
9 | pddl-1.0 | spdx | spdx licen[sc]e identifier pddl 1 0
9 | beerware | spdx | spdx licen[sc]e identifier beerware
9 | not-gpl | gpl general | (?:is|are) not (?:licensed|released|distributed|available|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e)
9 | not-mit | mit | (?:is|are) not (?:licensed|released|distributed|available) under (?:the )?mit licen[sc]e
9 | not-apache | apache | (?:is|are) not (?:licensed|released|distributed|available) under (?:the )?apache licen[sc]e
9 | no-license | license licence | (?:has|have|with|comes? with) no licen[sc]e
9 | no-license | license licence | no licen[sc]e (?:is|was|has been) (?:granted|given|implied|chosen|specified)
9 | no-license | rights | no (?:other )?rights (?:are|is) granted
9 | no-redistribution | redistribution redistribute redistributed | (?:redistribution is (?:not permitted|prohibited|forbidden)|(?:may|must|can) not (?:be )?redistributed?)
9 | all-rights-reserved | reserved | all rights (?:are )?reserved(?: worldwide)?
8 | mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
8 | mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
8 | mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
8 | mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal without restriction without attribution
8 | isc | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
8 | isc | permission | permission to use copy modify and or distribute this software for any purpose
8 | 0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
8 | hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
8 | bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
8 | bsd-3-clause | endorse | neither the name of [a-z0-9 ]{1,80}nor the names of its contributors may be used to endorse or promote products
8 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
8 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
8 | bsd | redistributions | redistributions of source code must retain the above copyright notice
8 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented
8 | zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
8 | libpng | contributing | the png reference library is supplied as is the contributing authors
8 | gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
8 | gpl | redistribute | [a-z0-9]+ is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
8 | lgpl | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
8 | agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
8 | gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
8 | gpl | received | you should have received a copy of the gnu general public licen[sc]e along with this program
8 | lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library
8 | agpl | received | you should have received a copy of the gnu affero general public licen[sc]e along with this program
8 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
8 | gfdl | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
8 | apache-2.0 | apache | licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
8 | apache-2.0 | basis | software distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind
8 | apache | contributor | licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
8 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
8 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
8 | npl | netscape | the contents of this file are subject to the netscape public licen[sc]e
8 | epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
8 | edl | accompanying | made available under the terms of the eclipse distribution licen[sc]e
8 | cpl | accompanying | made available under the terms of the common public licen[sc]e
8 | cddl | distribution | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
8 | eupl | european | licensed under the eupl version 1 [012](?: or as soon they will be approved by the european commission)?
8 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
8 | cc0 | waived | to the extent possible under law [a-z0-9 ]{1,80}has waived all copyright and related or neighboring rights
8 | wtfpl | want | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed
8 | beerware | beer | you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer
8 | bsl-1.0 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
8 | artistic | artistic | under the terms of either the gnu general public licen[sc]e or the artistic licen[sc]e
8 | python | python | psf is making python available to licensee on an as is basis
8 | openssl | openssl | this product includes software developed by the openssl project
8 | postgresql | paragraph | provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
8 | ofl | font | this font software is licensed under the sil open font licen[sc]e
8 | ofl | reserved | no modified version of the font software may use the reserved font name
8 | odbl | database | this [a-z0-9 ]{1,60}is made available under the open database licen[sc]e
8 | odbl | database | any rights in individual contents of the database are licensed under the database contents licen[sc]e
8 | pddl | dedication | made available under the public domain dedication and licen[sc]e
8 | w3c | w3c | copyright [a-z0-9 ]{0,20}w3c mit ercim keio(?: beihang)?
8 | ncsa | ncsa | permission is hereby granted [a-z0-9 ]{0,200}university of illinois ncsa
8 | busl-1.1 | business | use of this software is governed by the business source licen[sc]e
8 | elastic-2.0 | elastic | licensed under the elastic licen[sc]e(?: 2 0)? you may not use this file except in compliance
8 | sspl-1.0 | server | subject to the terms of the server side public licen[sc]e(?: version 1)?
8 | openrail | restrictions | use restrictions as defined in attachment a
8 | llama | llama | licensed under the llama [0-9 ]{0,4}community licen[sc]e
8 | gemma | gemma | gemma is provided under and subject to the gemma terms of use
8 | proprietary | confidential | this (?:document|file|software) (?:contains|is) (?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
8 | proprietary | unauthorized unauthorised | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|document|software|material)
8 | proprietary | written | may not be (?:reproduced|copied|distributed|used) [a-z ]{0,60}without (?:the )?(?:prior |express )?written (?:permission|consent)
7 | gpl | gpl general | (?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e)
7 | lgpl | lgpl lesser library | (?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)
7 | agpl | agpl affero | (?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[sc]e)
7 | mit | mit | (?:licensed|released|distributed|available|published|open sourced) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[sc]e)?
7 | mit | expat | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?expat(?: licen[sc]e)?
7 | apache | apache | (?:licensed|released|distributed|available|published|open sourced) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?
7 | bsd | bsd | (?:licensed|released|distributed|available|published) under (?:an? |the )?(?:terms of )?(?:the )?bsd(?: style)?(?: licen[sc]e)?
7 | bsd-2-clause | bsd | (?:licensed|released|available) under (?:the )?(?:simplified bsd|(?:2|two) clause bsd|bsd (?:2|two) clause)(?: licen[sc]e)?
7 | bsd-3-clause | bsd | (?:licensed|released|available) under (?:the )?(?:(?:new|modified|revised) bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)(?: licen[sc]e)?
7 | isc | isc | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[sc]e)?
7 | mpl | mpl mozilla | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public licen[sc]e)
7 | epl | epl eclipse | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:epl|eclipse public licen[sc]e)
7 | cc | commons | (?:licensed|released|distributed|available|published|shared) under (?:an? |the )?(?:terms of )?(?:an? |the )?creative commons(?: licen[sc]e)?
7 | cc-by | cc | (?:licensed|released|available|published|shared) under (?:an? |the )?cc by(?: licen[sc]e)?
7 | cc-by-sa | cc | (?:licensed|released|available|published|shared) under (?:an? |the )?cc by sa(?: licen[sc]e)?
7 | cc-by-nc | cc | (?:licensed|released|available|published|shared) under (?:an? |the )?cc by nc(?: licen[sc]e)?
7 | cc-by-nd | cc | (?:licensed|released|available|published|shared) under (?:an? |the )?cc by nd(?: licen[sc]e)?
7 | cc0 | cc0 | (?:licensed|released|available|published|shared|dedicated) (?:under|to|with) (?:the )?cc0
7 | unlicense | unlicense | (?:licensed|released|available) under (?:the )?unlicense
7 | artistic | artistic | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic licen[sc]e
7 | bsl-1.0 | boost | distributed under (?:the )?boost software licen[sc]e
7 | zlib | zlib | (?:licensed|released|distributed|available) under (?:the )?zlib(?: libpng)?(?: licen[sc]e)?
7 | wtfpl | wtfpl | (?:licensed|released|available) under (?:the )?wtfpl
7 | ofl | ofl | (?:licensed|released|available) under (?:the )?(?:sil )?ofl
7 | odbl | odbl | (?:licensed|released|available) under (?:the )?odbl
7 | perl | perl | same terms as perl(?: itself)?
7 | ruby | ruby | (?:licensed|distributed) under (?:the )?same (?:terms|licen[sc]e) as ruby
7 | public-domain | domain | (?:released|placed|dedicated|donated|put) (?:in|into|to|in to) the public domain
7 | public-domain | domain | (?:is|are) (?:hereby )?(?:in|part of) the public domain
7 | proprietary | commercial | (?:licensed|available|sold) under (?:a|the) (?:commercial|proprietary) licen[sc]e
7 | dual | dual dually | dual(?:ly)? licensed(?: under)?
7 | non-commercial | commercial noncommercial | (?:for|licensed for) (?:personal (?:and|or) )?non ?commercial (?:use|purposes)(?: only)?
7 | research-only | research | (?:for|licensed for) (?:academic |scientific )?research (?:use|purposes) only
7 | evaluation-only | evaluation | for evaluation (?:use|purposes) only
6 | gpl | gnu | (?:www )?gnu org (?:licen[sc]es|copyleft)(?: gpl(?: [23] 0)?)?(?: (?:html|txt))?
6 | lgpl | gnu | (?:www )?gnu org (?:licen[sc]es|copyleft)(?: old licen[sc]es)? lgpl(?: [23] [01])?(?: (?:html|txt))?
6 | agpl | gnu | (?:www )?gnu org licen[sc]es agpl(?: 3 0)?(?: (?:html|txt))?
6 | gfdl | gnu | (?:www )?gnu org licen[sc]es fdl(?: 1 [123])?(?: (?:html|txt))?
6 | apache-2.0 | apache | (?:www )?apache org licen[sc]es licen[sc]e 2 0(?: (?:html|txt))?
6 | apache | apache | (?:www )?apache org licen[sc]es
6 | mit | opensource | (?:www )?opensource org licen[sc]es? mit(?: licen[sc]e)?(?: (?:php|html))?
6 | bsd | opensource | (?:www )?opensource org licen[sc]es? bsd(?: licen[sc]e)?(?: (?:php|html))?
6 | bsd-2-clause | opensource | (?:www )?opensource org licen[sc]es? bsd 2 clause
6 | bsd-3-clause | opensource | (?:www )?opensource org licen[sc]es? bsd 3 clause
6 | isc | opensource | (?:www )?opensource org licen[sc]es? isc
6 | artistic-2.0 | opensource | (?:www )?opensource org licen[sc]es? artistic (?:licen[sc]e )?2 0
6 | osl | opensource | (?:www )?opensource org licen[sc]es? osl [123] [01]
6 | afl | opensource | (?:www )?opensource org licen[sc]es? afl [123] [01]
6 | ecl-2.0 | opensource | (?:www )?opensource org licen[sc]es? ecl 2 0
6 | unlicense | unlicense | (?:www )?unlicense org
6 | mpl | mozilla | (?:www )?mozilla org mpl(?: [12] [01])?
6 | mpl | mozilla | (?:www )?mozilla org en us mpl(?: [12] [01])?
6 | epl | eclipse | (?:www )?eclipse org legal epl(?: (?:v10|v20|2 0))?(?: html)?
6 | edl | eclipse | (?:www )?eclipse org org documents edl v10
6 | cddl | cddl | (?:www )?(?:sun com|opensolaris org|glassfish [a-z]+ net) [a-z ]{0,30}cddl
6 | bsl-1.0 | boost | (?:www )?boost org licen[sc]e 1 0 txt
6 | ofl | sil | (?:scripts )?sil org ofl
6 | odbl | opendatacommons | opendatacommons org licen[sc]es odbl(?: (?:1 0|summary))?
6 | odc-by | opendatacommons | opendatacommons org licen[sc]es by(?: 1 0)?
6 | pddl | opendatacommons | opendatacommons org licen[sc]es pddl(?: 1 0)?
6 | cc0 | creativecommons | creativecommons org publicdomain zero 1 0
6 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
6 | cc-by | creativecommons | creativecommons org licen[sc]es by(?: [1234] [05])?
6 | cc-by-sa | creativecommons | creativecommons org licen[sc]es by sa(?: [1234] [05])?
6 | cc-by-nc | creativecommons | creativecommons org licen[sc]es by nc(?: [1234] [05])?
6 | cc-by-nd | creativecommons | creativecommons org licen[sc]es by nd(?: [1234] [05])?
6 | cc-by-nc-sa | creativecommons | creativecommons org licen[sc]es by nc sa(?: [1234] [05])?
6 | cc-by-nc-nd | creativecommons | creativecommons org licen[sc]es by nc nd(?: [1234] [05])?
6 | wtfpl | wtfpl | (?:www )?wtfpl net
6 | eupl | joinup europa | (?:joinup )?ec europa eu [a-z ]{0,40}eupl
6 | python | python | (?:www )?python org (?:psf|download releases [0-9 ]{1,12}) licen[sc]e
6 | php | php | (?:www )?php net licen[sc]e(?: 3 01 txt)?
6 | elastic | elastic | (?:www )?elastic co licensing elastic licen[sc]e
6 | sspl | mongodb | (?:www )?mongodb com licensing server side public licen[sc]e
6 | llama | llama | ai meta com llama licen[sc]e
6 | gemma | gemma | ai google dev gemma terms
6 | openrail | responsibleailicenses huggingface | (?:www licenses ai|huggingface co spaces bigscience licen[sc]e)
4 | gpl | general | gnu general public licen[sc]e
4 | lgpl | lesser | (?:gnu )?lesser general public licen[sc]e
4 | lgpl | library | (?:gnu )?library general public licen[sc]e
4 | agpl | affero | (?:gnu )?affero general public licen[sc]e
4 | gfdl | documentation | (?:gnu )?free documentation licen[sc]e
4 | mit | mit | (?:the )?mit licen[sc]e(?: mit)?
4 | mit | mit | mit x11(?: style)? licen[sc]e
4 | mit | expat | expat licen[sc]e
4 | x11 | x11 | x11 licen[sc]e
4 | mit-0 | mit | mit no attribution(?: licen[sc]e)?
4 | apache | apache | apache(?: software)? licen[sc]e
4 | bsd | bsd | (?:original )?bsd(?: style| type)? licen[sc]e
4 | bsd-2-clause | bsd | (?:simplified|freebsd|two clause|2 clause) bsd licen[sc]e
4 | bsd-2-clause | freebsd | freebsd licen[sc]e
4 | bsd-3-clause | bsd | (?:new|modified|revised|three clause|3 clause) bsd licen[sc]e
4 | bsd-4-clause | bsd | (?:four|4) clause bsd licen[sc]e
4 | 0bsd | bsd 0bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[sc]e)?
4 | isc | isc consortium | (?:isc|internet systems consortium) licen[sc]e
4 | mpl | mozilla | mozilla public licen[sc]e
4 | npl | netscape | netscape public licen[sc]e
4 | epl | eclipse | eclipse public licen[sc]e
4 | edl | eclipse | eclipse distribution licen[sc]e
4 | cddl | development | common development and distribution licen[sc]e
4 | cpl | common | common public licen[sc]e
4 | cpal | attribution | common public attribution licen[sc]e
4 | ipl | ibm | ibm public licen[sc]e
4 | eupl | european | european union public licen[sc]e
4 | artistic | artistic | (?:the )?(?:perl |clarified )?artistic licen[sc]e
4 | bsl-1.0 | boost | boost software licen[sc]e
4 | busl | business | business source licen[sc]e
4 | unlicense | unlicense | the unlicense
4 | wtfpl | fuck | do what the fuck you want to public licen[sc]e
4 | beerware | beerware beer | (?:the )?beer ?ware licen[sc]e
4 | zlib | zlib | zlib(?: libpng)? licen[sc]e
4 | libpng | libpng | libpng licen[sc]e
4 | python | python | python(?: software foundation)? licen[sc]e
4 | php | php | php licen[sc]e
4 | ruby | ruby | ruby licen[sc]e
4 | openssl | openssl | openssl licen[sc]e
4 | postgresql | postgresql | postgresql licen[sc]e
4 | sqlite | sqlite | sqlite blessing
4 | curl | curl | curl licen[sc]e
4 | vim | vim | vim licen[sc]e
4 | tcl | tcl | tcl tk licen[sc]e
4 | ofl | font | (?:sil )?open font licen[sc]e
4 | ubuntu-font | ubuntu | ubuntu font licen[sc]e
4 | odbl | database | open database licen[sc]e
4 | odc-by | commons | open data commons attribution licen[sc]e
4 | pddl | commons | open data commons public domain dedication and licen[sc]e
4 | cdla | community | community data licen[sc]e agreement(?: (?:permissive|sharing))?
4 | cc0 | zero | creative commons zero
4 | cc-by | commons | creative commons attribution(?: (?:international|unported|generic))?
4 | cc-by-sa | commons | creative commons attribution share ?alike
4 | cc-by-nc | commons | creative commons attribution non ?commercial
4 | cc-by-nd | commons | creative commons attribution no ?deriv(?:ative)?s?
4 | cc-by-nc-sa | commons | creative commons attribution non ?commercial share ?alike
4 | cc-by-nc-nd | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
4 | afl | academic | academic free licen[sc]e
4 | osl | software | open software licen[sc]e
4 | ecl | educational | educational community licen[sc]e
4 | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
4 | upl | universal | universal permissive licen[sc]e
4 | ms-pl | microsoft | microsoft public licen[sc]e
4 | ms-rl | microsoft | microsoft reciprocal licen[sc]e
4 | lppl | latex | latex project public licen[sc]e
4 | w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
4 | zpl | zope | zope public licen[sc]e
4 | qpl | q | q public licen[sc]e
4 | sleepycat | sleepycat | sleepycat licen[sc]e
4 | apsl | apple | apple public source licen[sc]e
4 | sspl | server | server side public licen[sc]e
4 | elastic | elastic | elastic licen[sc]e
4 | commons-clause | clause | commons clause
4 | polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[sc]e)?
4 | mulan-psl | mulan | mulan permissive software licen[sc]e
4 | cecill | cecill | cecill(?: [abc])?(?: licen[sc]e)?
4 | reciprocal | reciprocal | reciprocal public licen[sc]e
4 | rpl | realnetworks | realnetworks public source licen[sc]e
4 | sgi | sgi | sgi free software licen[sc]e
4 | intel | intel | intel open source licen[sc]e
4 | nasa | nasa | nasa open source agreement
4 | opl | publication | open publication licen[sc]e
4 | ogl | government | open government licen[sc]e
4 | etalab | etalab | (?:licence ouverte|open licence) etalab
4 | openrail | openrail rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m| s| d)?(?: licen[sc]e)?
4 | rail | responsible | responsible ai licen[sc]e
4 | llama | llama | llama (?:[23] )?(?:[12] )?community licen[sc]e
3 | gpl | gpl | (?:gnu )?gpl(?: licensed| compatible)?
3 | lgpl | lgpl | (?:gnu )?lgpl
3 | agpl | agpl | (?:gnu )?agpl
3 | gfdl | gfdl | gfdl
3 | mit | mit | mit licensed
3 | apache | apache | apache licensed
3 | bsd | bsd | bsd licensed
3 | wtfpl | wtfpl | wtfpl
3 | cddl | cddl | cddl
3 | eupl | eupl | eupl
3 | odbl | odbl | odbl
3 | pddl | pddl | pddl
3 | cc0 | cc0 | cc0(?: 1 0)?
3 | cc-by-sa | cc | cc by sa(?: [1234] [05])?
3 | cc-by-nc | cc | cc by nc(?: [1234] [05])?
3 | cc-by-nd | cc | cc by nd(?: [1234] [05])?
3 | cc-by-nc-sa | cc | cc by nc sa(?: [1234] [05])?
3 | cc-by-nc-nd | cc | cc by nc nd(?: [1234] [05])?
3 | copyleft | copyleft | copyleft
3 | warranty | warranty | provided as is without (?:any )?(?:express or implied )?warranty
3 | share-alike | alike | attribution (?:and )?share ?alike
2 | public-domain | domain | public domain
2 | open-source | source | open source (?:software )?licen[sc]e
2 | free-software | free | free software licen[sc]e
2 | proprietary | proprietary | proprietary licen[sc]e
2 | commercial | commercial | commercial licen[sc]e
2 | eula | user eula | (?:end user licen[sc]e agreement|eula)
2 | royalty-free | royalty | royalty free(?: licen[sc]e)?
1 | unknown | spdx | spdx licen[sc]e identifier [a-z0-9]+
1 | unknown | license licence | (?:licensed|released|distributed|available|published) under (?:an?|the|this|its|following) (?:[a-z]+ ){0,3}licen[sc]e
1 | unknown | license licence | see (?:the )?(?:file )?licen[sc]e(?: file)? for (?:details|terms|more information)
"""

#: What has versions.  label | versions | keywords | names.  Each
#: version gives a rule for an identifier and one for a name with a version.
VERSIONED = r"""
gpl | 1.0 2.0 3.0 | general gpl | gnu general public licen[sc]e|gnu gpl|gpl
lgpl | 2.0 2.1 3.0 | lesser library lgpl | gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl
agpl | 1.0 3.0 | affero agpl | (?:gnu )?affero general public licen[sc]e|gnu agpl|agpl
gfdl | 1.1 1.2 1.3 | documentation gfdl | gnu free documentation licen[sc]e|gfdl
apache | 1.0 1.1 2.0 | apache | apache software licen[sc]e|apache licen[sc]e|apache
mpl | 1.0 1.1 2.0 | mozilla mpl | mozilla public licen[sc]e|mpl
epl | 1.0 2.0 | eclipse epl | eclipse public licen[sc]e|epl
cddl | 1.0 1.1 | distribution cddl | common development and distribution licen[sc]e|cddl
eupl | 1.0 1.1 1.2 | european eupl | european union public licen[sc]e|eupl
artistic | 1.0 2.0 | artistic | artistic licen[sc]e
bsl | 1.0 | boost | boost software licen[sc]e
busl | 1.1 | business | business source licen[sc]e
php | 3.0 3.01 | php | php licen[sc]e
ofl | 1.0 1.1 | font ofl | (?:sil )?open font licen[sc]e|ofl
afl | 1.1 1.2 2.0 2.1 3.0 | academic | academic free licen[sc]e
osl | 1.0 2.0 2.1 3.0 | software | open software licen[sc]e
ecl | 1.0 2.0 | educational | educational community licen[sc]e
lppl | 1.0 1.2 1.3 | latex lppl | latex project public licen[sc]e|lppl
zpl | 1.1 2.0 2.1 | zope | zope public licen[sc]e
apsl | 1.0 1.1 2.0 | apple | apple public source licen[sc]e
cc-by | 1.0 2.0 2.5 3.0 4.0 | commons cc | creative commons attribution|cc by
cc-by-sa | 1.0 2.0 2.5 3.0 4.0 | commons cc | creative commons attribution share ?alike|cc by sa
cc-by-nc | 1.0 2.0 2.5 3.0 4.0 | commons cc | creative commons attribution non ?commercial|cc by nc
cc-by-nd | 1.0 2.0 2.5 3.0 4.0 | commons cc | creative commons attribution no ?deriv(?:ative)?s?|cc by nd
"""
