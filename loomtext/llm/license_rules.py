"""Signature rules for licence scans: ``label | priority | confidence | keyword | regex``, one a line.

Texts are lower-cased (A-Z) and their white space is single blanks before they are
matched. The last rules are the sentences of notices and file headers. A rule's regex is only
tried on texts in which its keyword stands, so a keyword is a literal that every
match of the regex contains. Of overlapping detections the one
with the higher priority, then the longer, then the earlier rule stays.
"""

RULES = r"""
mit | 90 | 1.0 | permission is hereby granted, free of charge | permission is hereby granted, free of charge, to any person obtaining a copy\s+of this software and associated documentation
mit | 80 | .95 | mit license | \b(?:released|licensed|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?mit license
mit | 60 | .9 | mit license | \b(?:the )?mit license\b
mit | 60 | .9 | mit licence | \b(?:the )?mit licence\b
mit | 60 | .9 | expat license | \bexpat license\b
mit | 50 | .85 | licensed under mit | \blicensed under mit\b
mit | 50 | .85 | license: | \blicense:\s*mit\b
mit | 50 | .85 | opensource.org/licenses/mit | https?://(?:www\.)?opensource\.org/licenses/mit\b
mit-0 | 92 | 1.0 | mit no attribution | \bmit no attribution\b
mit-0 | 92 | 1.0 | mit-0 | \bmit-0\b
x11 | 85 | .9 | x11 license | \bx11 license\b
x11 | 92 | .95 | x consortium | except as contained in this notice, the name of the x consortium
isc | 90 | 1.0 | permission to use, copy, modify, and | permission to use, copy, modify, and(?:/or)? distribute this software for any\s+purpose with or without fee
isc | 60 | .9 | isc license | \bisc license\b
isc | 60 | .9 | isc licence | \bisc licence\b
0bsd | 92 | 1.0 | zero-clause bsd | \b(?:bsd )?zero-clause bsd\b
0bsd | 92 | 1.0 | 0bsd | \b0bsd\b
bsd-2-clause | 85 | .95 | simplified bsd license | \bsimplified bsd license\b
bsd-2-clause | 85 | .95 | freebsd license | \bfreebsd license\b
bsd-2-clause | 85 | .95 | bsd 2-clause | \bbsd 2-clause\b
bsd-2-clause | 85 | .95 | two-clause bsd | \btwo-clause bsd\b
bsd-2-clause | 85 | .95 | bsd-2-clause | \bbsd-2-clause\b
bsd-3-clause | 88 | .95 | new bsd license | \bnew bsd license\b
bsd-3-clause | 88 | .95 | modified bsd license | \bmodified bsd license\b
bsd-3-clause | 88 | .95 | revised bsd license | \brevised bsd license\b
bsd-3-clause | 88 | .95 | bsd 3-clause | \bbsd 3-clause\b
bsd-3-clause | 88 | .95 | three-clause bsd | \bthree-clause bsd\b
bsd-3-clause | 88 | .95 | bsd-3-clause | \bbsd-3-clause\b
bsd-3-clause | 90 | 1.0 | neither the name | neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse
bsd-4-clause | 91 | .95 | original bsd license | \boriginal bsd license\b
bsd-4-clause | 91 | .95 | bsd-4-clause | \bbsd-4-clause\b
bsd-4-clause | 92 | 1.0 | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd | 70 | .9 | redistribution and use in source and binary forms | redistribution and use in source and binary forms, with or without\s+modification, are permitted
bsd | 50 | .8 | bsd | \bbsd(?:-style)? license\b
bsd | 50 | .8 | bsd licence | \bbsd licence\b
bsd | 50 | .8 | bsd-style | \bbsd-style licen[cs]e\b
apache-2.0 | 90 | 1.0 | licensed under the apache license | licensed under the apache license, version 2(?:\.0)?
apache-2.0 | 88 | .98 | apache license | apache license,? version 2(?:\.0)?
apache-2.0 | 88 | .98 | apache license 2 | \bapache license 2(?:\.0)?\b
apache-2.0 | 88 | .98 | apache-2.0 | \bapache-2\.0\b
apache-2.0 | 86 | .95 | apache 2.0 | \bapache 2\.0\b
apache-2.0 | 86 | .95 | apache.org/licenses/license-2.0 | https?://(?:www\.)?apache\.org/licenses/license-2\.0
apache-1.1 | 88 | .95 | apache software license, version 1.1 | apache software license, version 1\.1
apache-1.1 | 88 | .95 | apache-1.1 | \bapache-1\.1\b
apache-1.0 | 88 | .95 | apache-1.0 | \bapache-1\.0\b
apache | 50 | .85 | apache | \bapache (?:software )?licen[cs]e\b
apache | 48 | .8 | apache software license | \bapache software license\b
gpl-2.0 | 88 | .98 | general public license | general public license,? version 2(?:\.0)?
gpl-2.0 | 88 | .98 | gpl-2.0 | \bgpl-2\.0\b
gpl-2.0 | 86 | .95 | gplv2 | \bgplv2\b
gpl-2.0 | 86 | .95 | gpl v2 | \bgpl v2(?:\.0)?\b
gpl-2.0 | 86 | .95 | gpl | \bgpl,? version 2\b
gpl-2.0-or-later | 92 | 1.0 | either version 2 of the license | either version 2 of the license, or \(?at your option\)? any later version
gpl-2.0-or-later | 92 | 1.0 | gpl-2.0-or-later | \bgpl-2\.0-or-later\b
gpl-2.0-or-later | 92 | .98 | gplv2+ | \bgplv2\+
gpl-2.0-only | 92 | 1.0 | gpl-2.0-only | \bgpl-2\.0-only\b
gpl-3.0 | 88 | .98 | general public license | general public license,? version 3(?:\.0)?
gpl-3.0 | 88 | .98 | gpl-3.0 | \bgpl-3\.0\b
gpl-3.0 | 86 | .95 | gplv3 | \bgplv3\b
gpl-3.0 | 86 | .95 | gpl v3 | \bgpl v3(?:\.0)?\b
gpl-3.0 | 86 | .95 | gpl | \bgpl,? version 3\b
gpl-3.0-or-later | 92 | 1.0 | either version 3 of the license | either version 3 of the license, or \(?at your option\)? any later version
gpl-3.0-or-later | 92 | 1.0 | gpl-3.0-or-later | \bgpl-3\.0-or-later\b
gpl-3.0-or-later | 92 | .98 | gplv3+ | \bgplv3\+
gpl-3.0-only | 92 | 1.0 | gpl-3.0-only | \bgpl-3\.0-only\b
gpl-1.0 | 88 | .95 | gpl-1.0 | \bgpl-1\.0\b
gnu-gpl | 60 | .9 | gnu general public licen | \bgnu general public licen[cs]e\b
gnu-gpl | 58 | .85 | gnu gpl | \bgnu gpl\b
gnu-gpl | 57 | .85 | general public licence | \bgeneral public licence\b
gnu-gpl | 70 | .9 | gnu.org/licenses/gpl | https?://(?:www\.)?gnu\.org/licenses/gpl
gnu-gpl | 65 | .9 | free software foundation | as published by\s+the free software foundation
classpath-exception | 94 | .95 | classpath exception | \bclasspath exception\b
lgpl-2.0 | 90 | .95 | library general public license | \bgnu library general public license\b
lgpl-2.1 | 91 | .98 | lesser general public license | lesser general public license,? version 2\.1
lgpl-2.1 | 91 | .98 | lgpl-2.1 | \blgpl-2\.1\b
lgpl-2.1 | 91 | .95 | lgplv2.1 | \blgplv2\.1\b
lgpl-3.0 | 91 | .98 | lesser general public license | lesser general public license,? version 3
lgpl-3.0 | 91 | .98 | lgpl-3.0 | \blgpl-3\.0\b
lgpl-3.0 | 91 | .95 | lgplv3 | \blgplv3\b
lgpl | 72 | .9 | lesser general public license | \b(?:gnu )?lesser general public license\b
lgpl | 55 | .85 | lgpl license | \blgpl license\b
lgpl | 70 | .9 | gnu.org/licenses/lgpl | https?://(?:www\.)?gnu\.org/licenses/lgpl
agpl-3.0 | 92 | .98 | affero general public license | affero general public license,? version 3
agpl-3.0 | 92 | .98 | agpl-3.0 | \bagpl-3\.0\b
agpl-3.0 | 92 | .95 | agplv3 | \bagplv3\b
agpl | 74 | .9 | affero general public license | \b(?:gnu )?affero general public license\b
agpl | 70 | .9 | gnu.org/licenses/agpl | https?://(?:www\.)?gnu\.org/licenses/agpl
gfdl-1.3 | 91 | .98 | free documentation license | free documentation license,? version 1\.3
gfdl-1.2 | 91 | .98 | free documentation license | free documentation license,? version 1\.2
gfdl | 72 | .9 | free documentation license | \b(?:gnu )?free documentation license\b
gfdl | 60 | .85 | gfdl | \bgfdl(?:-1\.[123])?\b
mpl-1.0 | 88 | .95 | mozilla public license | mozilla public license,? version 1\.0
mpl-1.1 | 88 | .98 | mozilla public license | mozilla public license,? version 1\.1
mpl-1.1 | 88 | .98 | mpl-1.1 | \bmpl-1\.1\b
mpl-2.0 | 90 | 1.0 | subject to the terms of the mozilla | subject to the terms of the mozilla public\s+license, v\. 2\.0
mpl-2.0 | 88 | .98 | mpl-2.0 | \bmpl-2\.0\b
mpl-2.0 | 88 | .98 | mozilla public license 2.0 | mozilla public license 2\.0
mpl-2.0 | 88 | .98 | mozilla.org/mpl/2.0 | https?://(?:www\.)?mozilla\.org/mpl/2\.0
mpl | 60 | .9 | mozilla public licen | \bmozilla public licen[cs]e\b
epl-1.0 | 88 | .98 | epl-1.0 | \bepl-1\.0\b
epl-1.0 | 88 | .98 | eclipse public license | eclipse public license,? v(?:ersion )?1
epl-2.0 | 88 | .98 | epl-2.0 | \bepl-2\.0\b
epl-2.0 | 88 | .98 | eclipse public license | eclipse public license,? v(?:ersion )?2
epl | 60 | .9 | eclipse public licen | \beclipse public licen[cs]e\b
eupl-1.1 | 88 | .98 | eupl-1.1 | \beupl-1\.1\b
eupl-1.2 | 88 | .98 | eupl-1.2 | \beupl-1\.2\b
eupl | 60 | .9 | european union public licen | \beuropean union public licen[cs]e\b
cddl-1.0 | 88 | .98 | cddl-1.0 | \bcddl-1\.0\b
cddl-1.1 | 88 | .98 | cddl-1.1 | \bcddl-1\.1\b
cddl | 60 | .9 | common development and distribution license | \bcommon development and distribution license\b
cpl-1.0 | 80 | .9 | common public license | \bcommon public license\b(?: version 1\.0)?
ipl-1.0 | 80 | .9 | ibm public license | \bibm public license\b
apsl-2.0 | 80 | .9 | apple public source license | \bapple public source license\b
spl-1.0 | 80 | .9 | sun public license | \bsun public license\b
npl | 80 | .9 | netscape public license | \bnetscape public license\b
qpl-1.0 | 80 | .9 | q public license | \bq public license\b
sspl-1.0 | 90 | .98 | server side public license | \bserver side public license\b
sspl-1.0 | 88 | .98 | sspl-1.0 | \bsspl-1\.0\b
busl-1.1 | 90 | .98 | business source license | \bbusiness source license\b(?: 1\.1)?
elastic-2.0 | 88 | .98 | elastic license | \belastic license(?: 2\.0)?\b
commons-clause | 94 | .95 | commons clause | \bcommons clause\b
artistic-1.0 | 88 | .95 | artistic-1.0 | \bartistic-1\.0\b
artistic-2.0 | 88 | .98 | artistic license 2.0 | \bartistic license 2\.0\b
artistic-2.0 | 88 | .98 | artistic-2.0 | \bartistic-2\.0\b
artistic | 60 | .9 | artistic licen | \bartistic licen[cs]e\b
perl | 70 | .85 | same terms as perl itself | \bunder the same terms as perl itself\b
python-2.0 | 80 | .95 | python software foundation license | \bpython software foundation license\b
python-2.0 | 80 | .95 | psf license | \bpsf license\b
ruby | 75 | .9 | ruby license | \bruby license\b
ruby | 75 | .9 | same terms as ruby | \bunder the same terms as ruby\b
php-3.01 | 85 | .95 | php license | \bthe php license\b(?:,? version 3\.01)?
zend-2.0 | 80 | .9 | zend engine license | \bzend engine license\b
boost-1.0 | 90 | 1.0 | boost software license | \bboost software license\b(?:\s*-?\s*version 1\.0)?
boost-1.0 | 88 | .95 | bsl-1.0 | \bbsl-1\.0\b
zlib | 90 | 1.0 | provided 'as-is', without any express | this software is provided 'as-is', without any express or implied\s+warranty
zlib | 70 | .95 | zlib | \bzlib(?:/libpng)? license\b
libpng | 75 | .9 | libpng license | \blibpng license\b
openssl | 80 | .95 | openssl license | \bopenssl license\b
openssl | 85 | .95 | openssl project | developed by the openssl project
curl | 75 | .9 | curl license | \bcurl license\b
unlicense | 92 | 1.0 | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 80 | .95 | the unlicense | \bthe unlicense\b
unlicense | 80 | .95 | unlicense.org | https?://(?:www\.)?unlicense\.org
wtfpl | 90 | 1.0 | what the fuck you want to | do what the fuck you want to
wtfpl | 85 | .98 | wtfpl | \bwtfpl\b
beerware | 88 | .98 | beer-ware | \bbeer-ware license\b
beerware | 85 | .95 | beerware | \bbeerware\b
ncsa | 85 | .95 | university of illinois/ncsa | university of illinois/ncsa open source license
postgresql | 85 | .95 | postgresql license | \bpostgresql license\b
ms-pl | 88 | .95 | microsoft public license | \bmicrosoft public license\b
ms-rl | 88 | .95 | microsoft reciprocal license | \bmicrosoft reciprocal license\b
afl-3.0 | 85 | .95 | academic free license | \bacademic free license\b
osl-3.0 | 85 | .95 | open software license | \bopen software license\b(?:,? v\.? ?3\.0)?
ecl-2.0 | 85 | .95 | educational community license | \beducational community license\b
upl-1.0 | 85 | .95 | universal permissive license | \buniversal permissive license\b
w3c | 85 | .95 | w3c software notice and license | \bw3c software notice and license\b
w3c | 75 | .9 | w3c license | \bw3c license\b
unicode | 85 | .95 | unicode license agreement | \bunicode license agreement\b
ofl-1.1 | 90 | .98 | sil open font license | \bsil open font license\b(?:,? version 1\.1)?
ofl-1.1 | 85 | .95 | ofl-1.1 | \bofl-1\.1\b
vim | 75 | .9 | vim license | \bvim license\b
lppl-1.3c | 85 | .95 | latex project public license | \blatex project public license\b
bittorrent | 80 | .9 | bittorrent open source license | \bbittorrent open source license\b
cecill-2.1 | 85 | .95 | cecill | \bcecill(?:-[bc])?\b
mulan-2.0 | 85 | .95 | mulan permissive software license | \bmulan permissive software license\b
blueoak-1.0 | 85 | .95 | blue oak model license | \bblue oak model license\b
json | 85 | .95 | used for good, not evil | the software shall be used for good, not evil
odbl-1.0 | 88 | .98 | database license | \bopen (?:data commons )?database license\b
odc-by-1.0 | 88 | .95 | open data commons attribution | \bopen data commons attribution license\b
pddl-1.0 | 88 | .95 | public domain dedication and license | \bpublic domain dedication and license\b
openrail | 85 | .95 | openrail | \bopenrail(?:-m|\+\+)?\b
llama | 80 | .9 | community license agreement | \bllama [0-9.]* ?community license agreement\b
cc0-1.0 | 92 | 1.0 | cc0 1.0 | \bcc0 1\.0(?: universal)?\b
cc0-1.0 | 92 | 1.0 | cc0-1.0 | \bcc0-1\.0\b
cc0-1.0 | 90 | .98 | creativecommons.org/publicdomain/zero | https?://creativecommons\.org/publicdomain/zero/1\.0
cc-by-4.0 | 88 | .98 | creative commons attribution 4.0 | creative commons attribution 4\.0
cc-by-4.0 | 88 | .98 | creativecommons.org/licenses/by/4.0 | https?://creativecommons\.org/licenses/by/4\.0
cc-by-4.0 | 88 | .95 | by 4.0 | \bcc[ -]by 4\.0\b
cc-by-4.0 | 88 | .95 | cc-by-4.0 | \bcc-by-4\.0\b
cc-by-3.0 | 88 | .98 | creative commons attribution 3.0 | creative commons attribution 3\.0
cc-by-3.0 | 88 | .95 | cc-by-3.0 | \bcc-by-3\.0\b
cc-by-2.0 | 88 | .95 | creativecommons.org/licenses/by/2.0 | https?://creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 | 91 | .98 | attribution-sharealike 4.0 | attribution-sharealike 4\.0
cc-by-sa-4.0 | 91 | .98 | by-sa 4.0 | \bcc[ -]by-sa 4\.0\b
cc-by-sa-4.0 | 91 | .98 | cc-by-sa-4.0 | \bcc-by-sa-4\.0\b
cc-by-sa-4.0 | 91 | .98 | creativecommons.org/licenses/by-sa/4.0 | https?://creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | 91 | .98 | attribution-sharealike 3.0 | attribution-sharealike 3\.0
cc-by-sa-3.0 | 91 | .98 | cc-by-sa-3.0 | \bcc-by-sa-3\.0\b
cc-by-sa | 75 | .9 | by-sa | \bcc[ -]by-sa\b
cc-by-nc-4.0 | 91 | .98 | attribution-noncommercial 4.0 | attribution-noncommercial 4\.0
cc-by-nc-4.0 | 91 | .98 | cc-by-nc-4.0 | \bcc-by-nc-4\.0\b
cc-by-nc | 75 | .9 | by-nc | \bcc[ -]by-nc\b
cc-by-nc-sa-4.0 | 93 | .98 | noncommercial-sharealike 4.0 | attribution-noncommercial-sharealike 4\.0
cc-by-nc-sa | 78 | .9 | by-nc-sa | \bcc[ -]by-nc-sa\b
cc-by-nc-nd-4.0 | 93 | .98 | noncommercial-noderiv | attribution-noncommercial-noderiv(?:ative)?s 4\.0
cc-by-nc-nd | 78 | .9 | by-nc-nd | \bcc[ -]by-nc-nd\b
cc-by-nd-4.0 | 91 | .98 | attribution-noderiv | attribution-noderiv(?:ative)?s 4\.0
cc-by-nd | 75 | .9 | by-nd | \bcc[ -]by-nd\b
creative-commons | 45 | .8 | creative commons | \bcreative commons\b
creative-commons | 44 | .8 | creativecommons.org | \bcreativecommons\.org\b
spdx-tag | 30 | .7 | spdx-license-identifier | \bspdx-license-identifier:\s*[a-z0-9.+-]+
public-domain | 45 | .8 | public domain | \b(?:in|into|to) the public domain\b
copyright-notice | 35 | .7 | copyright | \bcopyright\s+(?:\(c\)|©)?\s*(?:19|20)[0-9]{2}\b
copyright-notice | 35 | .7 | (c) | \(c\)\s*(?:19|20)[0-9]{2}\b
copyright-notice | 35 | .7 | © | ©\s*(?:19|20)?[0-9]{2}
reserved-notice | 40 | .8 | all rights reserved | \ball rights reserved\b\.?
reserved-notice | 40 | .8 | alle rechte vorbehalten | \balle rechte vorbehalten\b
reserved-notice | 40 | .8 | tous droits réservés | \btous droits réservés\b
reserved-notice | 40 | .8 | todos los derechos reservados | \btodos los derechos reservados\b
proprietary | 55 | .85 | proprietary and confidential | \bproprietary and confidential\b
proprietary | 50 | .8 | unauthorized copying | \bunauthorized copying of this (?:file|software|document)\b
proprietary | 50 | .8 | may not be reproduced | \bmay not be reproduced\b.{0,80}\bwithout\b.{0,40}\bpermission\b
proprietary | 50 | .8 | terms of use apply | \bterms of use apply\b
dual-license | 40 | .7 | licensed | \bdual[- ]licensed\b
dual-license | 40 | .7 | dual-licensed | \bdual-licensed\b
warranty-disclaimer | 20 | .6 | without warranty of any kind | provided "as is",? without warranty of any kind
warranty-disclaimer | 20 | .6 | warranties or conditions | without warranties or conditions of any kind
permissive-notice | 25 | .6 | you are free to | \byou are free to (?:use|copy|share|adapt)\b
permissive-notice | 25 | .6 | may be used freely | \bmay be used freely\b
noncommercial | 40 | .8 | non-commercial use only | \b(?:for )?non-commercial use only\b
noncommercial | 40 | .8 | noncommercial use only | \bnoncommercial use only\b
research-only | 40 | .8 | research purposes only | \bfor research purposes only\b
licence-link | 15 | .5 | /licen | https?://[^\s"'<>]+/licen[cs]es?\b(?:\.(?:txt|md|html))?
licence-notice | 10 | .5 | see the licen | \bsee the licen[cs]e file\b
licence-notice | 10 | .5 | see licen | \bsee licen[cs]e(?:\.txt|\.md)?\b
apache-2.0 | 95 | 1.0 | you may not use this file except in compliance with the license | licensed under the apache license, version 2\.0 \(the "license"\);? you may not use this file except in compliance with the license
apache-2.0 | 87 | .95 | distributed under the license is distributed on an "as is" basis | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
gpl-2.0-or-later | 96 | 1.0 | either version 2 of the license | this (?:program|file|software) is free software[;:] you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] either version 2 of the license, or \(?at your option\)? any later version
gpl-3.0-or-later | 96 | 1.0 | either version 3 of the license | this (?:program|file|software) is free software[;:] you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] either version 3 of the license, or \(?at your option\)? any later version
lgpl-2.1-or-later | 96 | 1.0 | either version 2.1 of the license | this (?:library|program|file) is free software[;:] you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license, or \(?at your option\)? any later version
lgpl-3.0-or-later | 96 | 1.0 | either version 3 of the license | this (?:library|program|file) is free software[;:] you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3 of the license, or \(?at your option\)? any later version
agpl-3.0-or-later | 96 | 1.0 | either version 3 of the license | this (?:program|file|software) is free software[;:] you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation[;,] either version 3 of the license, or \(?at your option\)? any later version
gnu-gpl | 62 | .9 | without even the implied warranty of merchantability | without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose
gnu-gpl | 62 | .9 | you should have received a copy of the gnu | you should have received a copy of the gnu (?:lesser |affero |library )?general public license along with this (?:program|library|file)
mpl-2.0 | 95 | 1.0 | this source code form is subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license, v\. ?2\.0
bsd | 72 | .9 | redistributions of source code must retain the above copyright notice | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd | 72 | .9 | redistributions in binary form must reproduce the above copyright notice | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
mit | 89 | .98 | this permission notice shall be included in all copies | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 88 | .95 | this permission notice appear in all copies | provided that the above copyright notice and this permission notice appear in all copies
boost-1.0 | 95 | 1.0 | the software and accompanying documentation covered by this license | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | 88 | .95 | altered source versions must be plainly marked | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
unlicense | 91 | .98 | anyone is free to copy, modify, publish, use, compile, sell, or distribute | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
ofl-1.1 | 93 | 1.0 | this font software is licensed under the sil open font license | this font software is licensed under the sil open font license(?:, version 1\.1)?
epl-1.0 | 92 | .98 | the accompanying materials are made available under the terms of the eclipse public license | the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )?1\.0
epl-2.0 | 92 | .98 | the accompanying materials are made available under the terms of the eclipse public license | the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion )?)?2\.0
cddl | 75 | .95 | subject to the terms of the common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
cc-by | 74 | .9 | under a creative commons attribution | \b(?:is|are) licen[cs]ed under a creative commons attribution (?:[1-4]\.[05] )?(?:international |unported |generic )?licen[cs]e\b
cc-by-sa | 79 | .95 | under a creative commons attribution-share | \b(?:is|are) licen[cs]ed under a creative commons attribution-share ?alike (?:[1-4]\.[05] )?(?:international |unported |generic )?licen[cs]e\b
cc-by-nc | 79 | .95 | under a creative commons attribution-non | \b(?:is|are) licen[cs]ed under a creative commons attribution-non-?commercial (?:[1-4]\.[05] )?(?:international |unported |generic )?licen[cs]e\b
cc0-1.0 | 91 | .98 | waived all copyright and related or neighb | to the extent possible under law, .{1,120}? (?:has|have) waived all copyright and related or neighbou?ring rights
odbl-1.0 | 90 | .98 | is made available under the open database license | is made available under the open database license(?:: https?://\S+)?
copyright-notice | 36 | .75 | copyright | \bcopyright (?:\(c\) |© )?(?:19|20)[0-9]{2}(?: ?[-,] ?(?:19|20)[0-9]{2}){1,9}\b
proprietary | 56 | .9 | no part of this | \bno part of this (?:publication|document|work|book) may be (?:reproduced|copied)\b.{0,160}?\bwithout (?:the )?(?:prior |express )?(?:written )?permission\b
dual-license | 42 | .75 | at your option | \b(?:mit|apache|bsd|gpl|lgpl|mpl)\b.{0,60}?\bor\b.{0,60}?\b(?:mit|apache|bsd|gpl|lgpl|mpl)\b.{0,40}?\bat your option\b
spdx-tag | 32 | .75 | spdx-license-identifier | \bspdx-license-identifier: ?\(?[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+){1,9}\)?
"""
