"""Signatures of licenses: fixed values, one rule a line, in order; label | kind | regex over normalised words.

Words are lower-cased and joined by single spaces, so "Apache-2.0" reads "apache 2 0". `@` stands for
licen[cs]e, `~` for an optional "version" or "v". Kinds: t a sentence of the license's text, i an
identifier or address, h a notice or header, n a name.
"""

RULES = r"""
mit|t|permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit|t|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|t|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit|t|without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit-0|t|deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit|i|spdx @ identifier mit
mit|i|opensource org licenses mit(?: @)?(?: php| html)?
mit|i|choosealicense com licenses mit
mit|h|(?:released|distributed|published|available|provided|covered|licensed) under (?:the )?(?:terms of (?:the )?)?mit @
mit|h|this (?:project|software|code|package|library|work) is (?:mit licensed|under mit)
mit|h|dual licensed under (?:the )?mit
mit|n|(?:the )?mit (?:x11 |expat )?@
mit|n|expat @
mit|n|x11 @
mit|n|mit style @
mit-0|i|spdx @ identifier mit 0
mit-0|n|mit no attribution(?: @)?
mit-advertising|n|mit @ with advertising clause
apache-2.0|t|licensed under the apache @ version 2 0 the @ you may not use this file except in compliance with the @
apache-2.0|t|unless required by applicable law or agreed to in writing software distributed under the @ is distributed on an as is basis
apache-2.0|t|you may obtain a copy of the @ at (?:http|https) www apache org licenses @ 2 0
apache-2.0|t|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright @ to reproduce
apache-2.0|t|terms and conditions for use reproduction and distribution 1 definitions @ shall mean
apache-1.1|t|the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation
apache-2.0|i|spdx @ identifier apache 2 0
apache-2.0|i|www apache org licenses @ 2 0(?: txt| html)?
apache-2.0|i|opensource org licenses apache 2 0
apache-1.1|i|spdx @ identifier apache 1 1
apache-1.0|i|spdx @ identifier apache 1 0
apache-2.0|h|(?:released|distributed|published|available|provided|covered|licensed) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: @)? ~2(?: 0)?
apache-2.0|n|(?:the )?apache(?: software)? @ ~2 0
apache-2.0|n|(?:the )?apache 2 0(?: @)?
apache-2.0|n|asl 2 0
apache-1.1|n|(?:the )?apache(?: software)? @ ~1 1
apache-1.0|n|(?:the )?apache(?: software)? @ ~1 0
apache|n|(?:the )?apache(?: software)? @
llvm-exception|n|apache @ ~2 0 with llvm exceptions?
bsd-3-clause|t|neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2-clause|t|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause|t|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause|t|redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-4-clause|t|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear|t|no express or implied licenses to any party s patent rights are granted by this @
0bsd|t|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-2-clause-views|t|the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-0-clause|i|spdx @ identifier 0bsd
bsd-1-clause|i|spdx @ identifier bsd 1 clause
bsd-2-clause|i|spdx @ identifier bsd 2 clause
bsd-3-clause|i|spdx @ identifier bsd 3 clause
bsd-4-clause|i|spdx @ identifier bsd 4 clause
bsd-2-clause|i|opensource org licenses bsd 2 clause
bsd-3-clause|i|opensource org licenses bsd 3 clause
bsd|i|opensource org licenses bsd @(?: php)?
bsd|h|use of this source code is governed by a bsd style @ that can be found in the @ file
bsd|h|(?:released|distributed|published|available|provided|covered|licensed) under (?:the )?(?:terms of (?:the )?)?(?:new |revised |simplified |modified |original )?bsd(?: style)? @
bsd-0-clause|n|(?:0|zero) clause bsd(?: @)?
bsd-0-clause|n|bsd (?:0|zero) clause(?: @)?
bsd-1-clause|n|(?:1|one) clause bsd(?: @)?
bsd-1-clause|n|bsd (?:1|one) clause(?: @)?
bsd-2-clause|n|(?:2|two) clause bsd(?: @)?
bsd-2-clause|n|bsd (?:2|two) clause(?: @)?
bsd-3-clause|n|(?:3|three) clause bsd(?: @)?
bsd-3-clause|n|bsd (?:3|three) clause(?: @)?
bsd-4-clause|n|(?:4|four) clause bsd(?: @)?
bsd-4-clause|n|bsd (?:4|four) clause(?: @)?
bsd-2-clause|n|(?:simplified|freebsd) bsd @
bsd-2-clause|n|freebsd @
bsd-3-clause|n|(?:new|revised|modified) bsd @
bsd-4-clause|n|(?:original|old) bsd @
bsd-3-clause-clear|n|clear bsd @
bsd-3-clause-clear|n|bsd 3 clause clear(?: @)?
bsd-protection|n|bsd protection @
bsd|n|(?:the )?bsd(?: style)? @
gpl|t|this program is free software you can redistribute it and or modify it under the terms of the gnu general public @
gpl|t|this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
gpl|t|you should have received a copy of the gnu general public @ along with this (?:program|software|file|package)
gpl-2.0|t|59 temple place suite 330 boston ma 02111 1307 usa
gpl-2.0|t|51 franklin street fifth floor boston ma 02110 1301 usa
gpl-3.0|t|the gnu general public @ is a free copyleft @ for software and other kinds of works
gpl-2.0|t|the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public @
gpl-3.0|t|protecting users legal rights from anti circumvention law
gpl-1.0-only|i|spdx @ identifier gpl 1 0(?: only)?
gpl-2.0-only|i|spdx @ identifier gpl 2 0(?: only)?
gpl-2.0-or-later|i|spdx @ identifier gpl 2 0 or later
gpl-3.0-only|i|spdx @ identifier gpl 3 0(?: only)?
gpl-3.0-or-later|i|spdx @ identifier gpl 3 0 or later
gpl|i|www gnu org (?:licenses|copyleft) gpl(?: html| txt)?
gpl-2.0|i|www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0|i|www gnu org licenses gpl 3 0(?: html| txt)?
gpl-2.0-or-later|h|(?:the )?gnu general public @(?: as published by the free software foundation)?(?: either)? ~2(?: 0)?(?: of the @)? or (?:at your option )?any later version
gpl-3.0-or-later|h|(?:the )?gnu general public @(?: as published by the free software foundation)?(?: either)? ~3(?: 0)?(?: of the @)? or (?:at your option )?any later version
gpl-2.0-only|h|(?:the )?gnu general public @ ~2(?: 0)? only
gpl-3.0-only|h|(?:the )?gnu general public @ ~3(?: 0)? only
gpl-2.0-or-later|h|(?:gnu )?gpl ~2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later|h|(?:gnu )?gpl ~3(?: 0)? or (?:any )?later(?: version)?
gpl|h|(?:released|distributed|published|available|provided|covered|licensed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl|h|(?:released|distributed|published|available|provided|covered|licensed) under (?:the )?(?:terms of (?:the )?)?gnu general public @
gpl-1.0|n|(?:the )?gnu general public @ ~1(?: 0)?
gpl-2.0|n|(?:the )?gnu general public @ ~2(?: 0)?
gpl-3.0|n|(?:the )?gnu general public @ ~3(?: 0)?
gpl-1.0|n|(?:the )?(?:gnu )?gpl ~1(?: 0)?
gpl-2.0|n|(?:the )?(?:gnu )?gpl ~2(?: 0)?
gpl-3.0|n|(?:the )?(?:gnu )?gpl ~3(?: 0)?
gpl-2.0|n|gplv2
gpl-3.0|n|gplv3
gpl|n|(?:the )?gnu general public @
gpl|n|gnu gpl
classpath-exception-2.0|n|(?:gnu )?(?:gpl|general public @)(?: ~2)? with (?:the )?classpath exception
classpath-exception-2.0|t|linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception-3.1|n|gcc runtime library exception
gcc-exception-3.1|t|under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception
font-exception-2.0|n|gpl font exception
lgpl|t|you should have received a copy of the gnu (?:lesser|library) general public @ along with this (?:library|program|software)
lgpl|t|this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public @
lgpl-3.0|t|this version of the gnu lesser general public @ incorporates the terms and conditions of version 3 of the gnu general public @
lgpl-2.0-only|i|spdx @ identifier lgpl 2 0(?: only)?
lgpl-2.1-only|i|spdx @ identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later|i|spdx @ identifier lgpl 2 1 or later
lgpl-3.0-only|i|spdx @ identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later|i|spdx @ identifier lgpl 3 0 or later
lgpl|i|www gnu org (?:licenses|copyleft) lgpl(?: html| txt)?
lgpl-2.1|i|www gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-2.1-or-later|h|(?:the )?gnu lesser general public @(?: as published by the free software foundation)?(?: either)? ~2 1(?: of the @)? or (?:at your option )?any later version
lgpl-3.0-or-later|h|(?:the )?gnu lesser general public @(?: as published by the free software foundation)?(?: either)? ~3(?: 0)?(?: of the @)? or (?:at your option )?any later version
lgpl|h|(?:released|distributed|published|available|provided|covered|licensed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl
lgpl-2.0|n|(?:the )?gnu library general public @ ~2(?: 0)?
lgpl-2.1|n|(?:the )?gnu lesser general public @ ~2 1
lgpl-3.0|n|(?:the )?gnu lesser general public @ ~3(?: 0)?
lgpl-2.0|n|(?:gnu )?lgpl ~2(?: 0)?
lgpl-2.1|n|(?:gnu )?lgpl ~2 1
lgpl-3.0|n|(?:gnu )?lgpl ~3(?: 0)?
lgpl-3.0|n|lgplv3
lgpl-2.1|n|lgplv2 1
lgpl|n|(?:the )?gnu (?:lesser|library) general public @
lgpl|n|gnu lgpl
agpl|t|you should have received a copy of the gnu affero general public @ along with this program
agpl-3.0|t|if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-1.0|i|spdx @ identifier agpl 1 0(?: only)?
agpl-3.0-only|i|spdx @ identifier agpl 3 0(?: only)?
agpl-3.0-or-later|i|spdx @ identifier agpl 3 0 or later
agpl|i|www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl-3.0|n|(?:the )?gnu affero general public @ ~3(?: 0)?
agpl-1.0|n|affero general public @ ~1(?: 0)?
agpl-3.0|n|(?:gnu )?agpl ~3(?: 0)?
agpl-3.0|n|agplv3
agpl|n|(?:the )?(?:gnu )?affero general public @
gfdl|t|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation @
gfdl|t|with no invariant sections no front cover texts and no back cover texts
gfdl-1.1|i|spdx @ identifier gfdl 1 1(?: only| or later)?
gfdl-1.2|i|spdx @ identifier gfdl 1 2(?: only| or later)?
gfdl-1.3|i|spdx @ identifier gfdl 1 3(?: only| or later)?
gfdl|i|www gnu org (?:licenses|copyleft) fdl(?: html| txt)?
gfdl-1.1|n|(?:the )?gnu free documentation @ ~1 1
gfdl-1.2|n|(?:the )?gnu free documentation @ ~1 2
gfdl-1.3|n|(?:the )?gnu free documentation @ ~1 3
gfdl|n|(?:the )?gnu free documentation @
mpl-2.0|t|this source code form is subject to the terms of the mozilla public @ v 2 0
mpl-2.0|t|if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1|t|the contents of this file are subject to the mozilla public @ version 1 1
mpl-1.1|t|software distributed under the @ is distributed on an as is basis without warranty of any kind either express or implied see the @ for the specific language
mpl-1.0|i|spdx @ identifier mpl 1 0
mpl-1.1|i|spdx @ identifier mpl 1 1
mpl-2.0|i|spdx @ identifier mpl 2 0
mpl|i|(?:www )?mozilla org mpl(?: 2 0| mpl 1 1 html)?
mpl-1.0|n|(?:the )?mozilla public @ ~1 0
mpl-1.1|n|(?:the )?mozilla public @ ~1 1
mpl-2.0|n|(?:the )?mozilla public @ ~2 0
mpl-1.1|n|mpl ~1 1
mpl-2.0|n|mpl ~2 0
mpl|n|(?:the )?mozilla public @
epl-1.0|t|this program and the accompanying materials are made available under the terms of the eclipse public @ v1 0
epl-2.0|t|this program and the accompanying materials are made available under the terms of the eclipse public @(?: v| version)? ?2 0
epl-1.0|i|spdx @ identifier epl 1 0
epl-2.0|i|spdx @ identifier epl 2 0
epl|i|www eclipse org (?:legal epl v10|legal epl 2 0|org documents epl v10)(?: html)?
epl-1.0|n|(?:the )?eclipse public @ ~1 0
epl-2.0|n|(?:the )?eclipse public @ ~2 0
epl|n|(?:the )?eclipse public @
edl-1.0|n|eclipse distribution @ ~1 0
cpl-1.0|i|spdx @ identifier cpl 1 0
cpl-1.0|n|(?:the )?common public @ ~1 0
ipl-1.0|n|ibm public @ ~1 0
cddl-1.0|t|the contents of this file are subject to the terms of the common development and distribution @
cddl-1.0|i|spdx @ identifier cddl 1 0
cddl-1.1|i|spdx @ identifier cddl 1 1
cddl-1.0|n|common development and distribution @ ~1 0
cddl-1.1|n|common development and distribution @ ~1 1
cddl|n|common development and distribution @
cddl-1.0|n|cddl ~1 0
eupl-1.1|i|spdx @ identifier eupl 1 1
eupl-1.2|i|spdx @ identifier eupl 1 2
eupl-1.2|t|this european union public @ the eupl applies to the work as defined below
eupl-1.0|n|european union public @ ~1 0
eupl-1.1|n|european union public @ ~1 1
eupl-1.2|n|european union public @ ~1 2
eupl|n|european union public @
cecill-2.1|t|this software is governed by the cecill @ under french law and abiding by the rules of distribution of free software
cecill-2.1|i|spdx @ identifier cecill 2 1
cecill-b|i|spdx @ identifier cecill b
cecill-c|i|spdx @ identifier cecill c
cecill-b|n|cecill b @
cecill-c|n|cecill c @
cecill|n|cecill (?:free software )?@
cc0-1.0|t|to the extent possible under law .{1,120} waived all copyright and related or neighboring rights to this work
cc0-1.0|t|the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0|i|spdx @ identifier cc0 1 0
cc0-1.0|i|creativecommons org publicdomain zero 1 0
cc-pdm-1.0|i|creativecommons org publicdomain mark 1 0
cc0-1.0|n|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0|n|cc zero(?: 1 0)?
cc0-1.0|n|creative commons zero(?: ~1 0)?(?: universal)?
cc-by-1.0|i|creativecommons org licenses by 1 0
cc-by-2.0|i|creativecommons org licenses by 2 0
cc-by-2.5|i|creativecommons org licenses by 2 5
cc-by-3.0|i|creativecommons org licenses by 3 0
cc-by-4.0|i|creativecommons org licenses by 4 0
cc-by-sa-2.0|i|creativecommons org licenses by sa 2 0
cc-by-sa-2.5|i|creativecommons org licenses by sa 2 5
cc-by-sa-3.0|i|creativecommons org licenses by sa 3 0
cc-by-sa-4.0|i|creativecommons org licenses by sa 4 0
cc-by-nd-3.0|i|creativecommons org licenses by nd 3 0
cc-by-nd-4.0|i|creativecommons org licenses by nd 4 0
cc-by-nc-2.0|i|creativecommons org licenses by nc 2 0
cc-by-nc-3.0|i|creativecommons org licenses by nc 3 0
cc-by-nc-4.0|i|creativecommons org licenses by nc 4 0
cc-by-nc-sa-3.0|i|creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0|i|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0|i|creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0|i|creativecommons org licenses by nc nd 4 0
cc-by-4.0|i|spdx @ identifier cc by 4 0
cc-by-sa-4.0|i|spdx @ identifier cc by sa 4 0
cc-by-nc-4.0|i|spdx @ identifier cc by nc 4 0
cc-by|h|this work is licensed under a creative commons attribution(?: \d \d)?(?: international| unported)? @
cc-by-sa|h|this work is licensed under a creative commons attribution share ?alike(?: \d \d)?(?: international| unported)? @
cc-by-nc|h|this work is licensed under a creative commons attribution non ?commercial(?: \d \d)?(?: international| unported)? @
cc-by-nc-sa|h|this work is licensed under a creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported)? @
cc-by-nc-nd|h|this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d \d)?(?: international| unported)? @
cc-by-1.0|n|cc by 1 0
cc-by-2.0|n|cc by 2 0
cc-by-2.5|n|cc by 2 5
cc-by-3.0|n|cc by 3 0
cc-by-4.0|n|cc by 4 0
cc-by-sa-2.0|n|cc by sa 2 0
cc-by-sa-2.5|n|cc by sa 2 5
cc-by-sa-3.0|n|cc by sa 3 0
cc-by-sa-4.0|n|cc by sa 4 0
cc-by-nd-3.0|n|cc by nd 3 0
cc-by-nd-4.0|n|cc by nd 4 0
cc-by-nc-2.0|n|cc by nc 2 0
cc-by-nc-2.5|n|cc by nc 2 5
cc-by-nc-3.0|n|cc by nc 3 0
cc-by-nc-4.0|n|cc by nc 4 0
cc-by-nc-sa-3.0|n|cc by nc sa 3 0
cc-by-nc-sa-4.0|n|cc by nc sa 4 0
cc-by-nc-nd-3.0|n|cc by nc nd 3 0
cc-by-nc-nd-4.0|n|cc by nc nd 4 0
cc-by-nc-sa|n|cc by nc sa
cc-by-nc-nd|n|cc by nc nd
cc-by-sa|n|cc by sa
cc-by-nd|n|cc by nd
cc-by-3.0|n|creative commons attribution 3 0(?: unported)?(?: @)?
cc-by-4.0|n|creative commons attribution 4 0(?: international)?(?: @)?
cc-by-sa-3.0|n|creative commons attribution share ?alike 3 0(?: unported)?(?: @)?
cc-by-sa-4.0|n|creative commons attribution share ?alike 4 0(?: international)?(?: @)?
cc-by-nc-4.0|n|creative commons attribution non ?commercial 4 0(?: international)?(?: @)?
cc-by-nc-sa-4.0|n|creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: @)?
cc-by-nd-4.0|n|creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: @)?
cc-by|n|creative commons attribution(?: @)?
unlicense|t|this is free and unencumbered software released into the public domain
unlicense|t|anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense|i|spdx @ identifier unlicense
unlicense|i|(?:www )?unlicense org
unlicense|n|the unlicense
isc|t|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc|i|spdx @ identifier isc
isc|i|opensource org licenses isc(?: @)?
isc|n|(?:the )?isc @
zlib|t|this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib|t|altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib|i|spdx @ identifier zlib
zlib|n|(?:the )?zlib(?: libpng)? @
libpng-2.0|i|spdx @ identifier libpng 2 0
libpng|n|(?:the )?libpng @
libtiff|n|libtiff @
ijg|t|this software is based in part on the work of the independent jpeg group
bsl-1.0|t|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this @
bsl-1.0|h|distributed under the boost software @ version 1 0
bsl-1.0|i|spdx @ identifier bsl 1 0
bsl-1.0|i|www boost org @ 1 0 txt
bsl-1.0|n|(?:the )?boost software @(?: ~1 0)?
busl-1.1|i|spdx @ identifier busl 1 1
busl-1.1|n|business source @(?: ~1 1)?
busl-1.1|t|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2.0|n|elastic @ ~2(?: 0)?
sspl-1.0|n|server side public @(?: ~1)?
sspl-1.0|i|spdx @ identifier sspl 1 0
confluent-1.0|n|confluent community @
polyform-nc-1.0|n|polyform noncommercial @(?: 1 0 0)?
polyform-sb-1.0|n|polyform small business @(?: 1 0 0)?
commons-clause|t|the @ does not grant to you the right to sell the software
commons-clause|n|commons clause @ condition
artistic-1.0|i|spdx @ identifier artistic 1 0(?: perl)?
artistic-2.0|i|spdx @ identifier artistic 2 0
artistic-2.0|n|(?:the )?artistic @ ~2 0
artistic-1.0|n|(?:the )?artistic @ ~1 0
artistic|n|(?:the )?artistic @
artistic-perl|h|under the same terms as perl itself
ofl-1.1|t|this font software is licensed under the sil open font @ version 1 1
ofl-1.1|i|spdx @ identifier ofl 1 1
ofl-1.1|i|scripts sil org ofl
ofl-1.0|n|(?:the )?sil open font @ ~1 0
ofl-1.1|n|(?:the )?sil open font @ ~1 1
ofl|n|(?:the )?(?:sil )?open font @
ubuntu-font-1.0|n|ubuntu font licen[cs]e ~1 0
bitstream-vera|n|bitstream vera fonts? copyright
odbl-1.0|i|opendatacommons org licenses odbl(?: 1 0)?
odbl-1.0|n|(?:odc )?open database @(?: odbl)?(?: ~1 0)?
odc-by-1.0|i|opendatacommons org licenses by(?: 1 0)?
odc-by-1.0|n|open data commons attribution @(?: ~1 0)?
pddl-1.0|n|(?:open data commons )?public domain dedication (?:and|&) @
cdla-permissive-1.0|n|community data @ agreement permissive(?: ~1 0)?
cdla-permissive-2.0|n|community data @ agreement permissive ~2 0
cdla-sharing-1.0|n|community data @ agreement sharing(?: ~1 0)?
ogl-uk-1.0|n|open government @ ~1 0
ogl-uk-2.0|n|open government @ ~2 0
ogl-uk-3.0|n|open government @ ~3 0
ogl-uk|n|open government @
etalab-2.0|n|licence ouverte(?: open @)?(?: ~2 0)?
etalab-2.0|n|etalab(?: open @)? 2 0
dl-de-by-2.0|n|datenlizenz deutschland namensnennung(?: ~2 0)?
postgresql|t|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql|i|spdx @ identifier postgresql
postgresql|n|(?:the )?postgresql @
ncsa|n|university of illinois (?:open source )?@
ncsa|n|ncsa open source @
ncsa|i|spdx @ identifier ncsa
upl-1.0|n|universal permissive @(?: ~1 0)?
upl-1.0|i|spdx @ identifier upl 1 0
ecl-2.0|n|educational community @ ~2 0
ecl-2.0|t|licensed under the educational community @ version 2 0
afl-3.0|n|academic free @ ~3 0
afl-2.1|n|academic free @ ~2 1
osl-3.0|n|open software @ ~3 0
osl-2.1|n|open software @ ~2 1
rpl-1.5|n|reciprocal public @(?: ~1 5)?
cpal-1.0|n|common public attribution @(?: ~1 0)?
apsl-2.0|n|apple public source @ ~2 0
apsl|n|apple public source @
ms-pl|i|spdx @ identifier ms pl
ms-rl|i|spdx @ identifier ms rl
ms-pl|n|(?:the )?microsoft public @
ms-rl|n|(?:the )?microsoft reciprocal @
ms-lpl|n|microsoft limited public @
npl-1.1|n|netscape public @(?: ~1 1)?
sissl|n|sun industry standards source @
spl-1.0|n|sun public @
oracle-bcl|n|oracle binary code @ agreement
intel-simplified|n|intel simplified software @
qpl-1.0|n|(?:the )?q public @(?: ~1 0)?
python-2.0|t|this @ agreement is between the python software foundation psf and the individual or organization
python-2.0|i|spdx @ identifier python 2 0
python-2.0|n|(?:the )?psf @
python-2.0|n|(?:the )?python(?: software foundation)? @(?: ~2)?
ruby|n|(?:the )?ruby @
ruby|h|under the same terms as ruby
php-3.01|t|this product includes php software freely available from
php-3.01|i|spdx @ identifier php 3 01
php-3.01|n|(?:the )?php @ ~3 01
php-3.0|n|(?:the )?php @ ~3 0
zend-2.0|n|zend (?:engine )?@(?: ~2 0)?
tcl|n|tcl(?: tk)? @
vim|n|(?:the )?vim @
w3c|n|w3c software(?: notice)?(?: and)?(?: document)? @
w3c|t|by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms
unicode-3.0|n|unicode @ ~3
unicode-dfs-2016|n|unicode @ agreement data files and software
unicode-dfs-2016|t|permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
icu|n|icu @
openssl|t|this product includes software developed by the openssl project for use in the openssl toolkit
openssl|n|(?:the )?openssl @
ssleay|t|this product includes cryptographic software written by eric young
curl|n|curl @
curl|i|spdx @ identifier curl
ftl|n|freetype (?:project )?@
imagemagick|n|imagemagick @
hdf5|n|hdf5 @
naist-2003|n|naist 2003 @
ntp|n|ntp @
x11-distribute|n|x11 @ distribution modification variant
xfree86-1.1|n|xfree86 @(?: ~1 1)?
wtfpl|t|everyone is permitted to copy and distribute verbatim or modified copies of this @ document and changing it is allowed as long as the name is changed
wtfpl|t|do what the fuck you want to public @
wtfpl|i|spdx @ identifier wtfpl
wtfpl|n|wtfpl(?: ~2)?
beerware|t|as long as you retain this notice you can do whatever you want with this stuff
beerware|n|beerware @
beerware|n|beer ware @
blueoak-1.0.0|n|blue oak model @(?: 1 0 0)?
mulan-psl-2.0|n|mulan (?:permissive software |psl )?@?(?: ?~2)
json|t|the software shall be used for good not evil
vsl-1.0|n|vovida software @
fair|t|usage of the works is permitted provided that this instrument is retained with the works
efl-2.0|n|eiffel forum @ ~2
latex-lppl-1.3c|t|this work may be distributed and or modified under the conditions of the latex project public @
lppl-1.3c|n|latex project public @ ~1 3c?
lppl|n|latex project public @
sleepycat|n|(?:the )?sleepycat @
sgi-b-2.0|n|sgi free software @ b
watcom-1.0|n|sybase open watcom public @
aladdin|n|aladdin free public @
openrail|n|(?:creativeml )?openrail(?: m| plus plus)? @
openrail|n|open rail(?: m| plus plus)? @
bigscience-rail-1.0|n|bigscience rail @
llama-community|n|llama (?:\d (?:\d )?)?community @ agreement
gemma|n|gemma terms of use
opl-1.0|n|open publication @(?: ~1 0)?
opl-1.0|t|this material may be distributed only subject to the terms and conditions set forth in the open publication @
free-art-1.3|n|free art @(?: ~1 3)?
ogl-1.0a|n|open game @(?: ~1 0a)?
nasa-1.3|n|nasa open source agreement(?: ~1 3)?
cern-ohl-p-2.0|n|cern open hardware @(?: ~2)? permissive
cern-ohl-s-2.0|n|cern open hardware @(?: ~2)? strongly reciprocal
cern-ohl|n|cern open hardware @
tapr-ohl-1.0|n|tapr open hardware @
solderpad|n|solderpad hardware @
public-domain|h|(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain|h|(?:this work|this file|this code|this software) is (?:hereby )?(?:in|dedicated to) the public domain
public-domain|t|the author disclaims copyright to this source code in place of a legal notice here is a blessing
public-domain|n|(?:in|into|to) the public domain
us-gov-pd|t|is a work of the united states government and is not subject to copyright protection
proprietary|t|unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary|t|this software is the confidential and proprietary information of
proprietary|t|no part of this (?:publication|book|document|work) may be reproduced
proprietary|h|proprietary and confidential
proprietary|n|all rights reserved
eula|n|end user @ agreement
nda|h|under (?:a|the terms of a) non ?disclosure agreement
academic|h|for (?:academic|research|non commercial|noncommercial) (?:use|purposes) only
shareware|h|this (?:program|software) is shareware
freeware|h|this (?:program|software) is freeware
mixed|h|see (?:the )?@ file for (?:@ |licensing |copyright )?(?:details|information|terms|rights)
mixed|h|refer to the @ file
"""
