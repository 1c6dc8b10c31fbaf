"""Hand-written signatures of license texts: grants, conditions, warranties, notices and addresses.

Fixed values: label, priority (1 is best), score, a word that every match holds, and the regex. A space stands for any
run of blanks, commas, comment leaders and quotation marks, so that wrapped and commented notices match.
"""

TEXTS = [
    # permissive texts
    ("mit", 2, 0.9, "obtaining", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, 0.8, "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, 0.8, "sublicense", r"the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software"),
    ("mit", 3, 0.7, "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 3, 0.7, "holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 2, 0.9, "opensource.org", r"opensource\.org/licenses/mit(?:-license)?(?![a-z0-9-])"),
    ("mit-0", 2, 0.9, "mit-0", r"opensource\.org/licenses/mit-0"),
    ("x11", 3, 0.8, "advertising", r"except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote"),
    ("isc", 2, 0.9, "fee", r"permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, 0.8, "appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 3, 0.7, "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", 3, 0.7, "tortious", r"whether in an action of contract negligence or other tortious action"),
    ("hpnd", 2, 0.8, "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd", 3, 0.7, "publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("postgresql", 2, 0.9, "agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", 3, 0.7, "california", r"in no event shall the university of california be liable to any party"),
    ("bsd", 2, 0.9, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, 0.8, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 3, 0.8, "reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 3, 0.7, "implied", r"this software is provided by .{1,80}? as is and any express or implied warranties"),
    ("bsd", 3, 0.7, "advised", r"out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-2-clause", 2, 0.9, "bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", 2, 0.9, "bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-3-clause", 2, 0.9, "endorse", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 2, 0.9, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("ncsa", 3, 0.8, "deal", r"to deal with the software without restriction including without limitation the rights"),
    ("zlib", 2, 0.9, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 3, 0.8, "altered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", 3, 0.8, "removed", r"this notice may not be removed or altered from any source distribution"),
    ("zlib", 3, 0.7, "held", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", 2, 0.9, "png", r"the png reference library is supplied as is"),
    ("ijg", 2, 0.8, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 2, 0.8, "freetype", r"portions of this software are copyright .{0,60}? the freetype project"),
    ("bsl-1.0", 2, 0.9, "organization", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", 2, 0.9, "boost.org", r"boost\.org/license_1_0\.txt"),
    ("bsl-1.0", 3, 0.8, "machine-executable", r"machine-executable object code generated by a source language processor"),
    ("unlicense", 2, 0.9, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, 0.8, "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 2, 0.9, "unlicense.org", r"unlicense\.org"),
    ("public-domain", 4, 0.6, "domain", r"(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", 4, 0.6, "domain", r"(?:is|are) (?:hereby )?in the public domain"),
    ("wtfpl", 2, 0.9, "fuck", r"do what the fuck you want to public licen[cs]e"),
    ("wtfpl", 3, 0.8, "fuck", r"you just do what the fuck you want to"),
    ("beerware", 2, 0.9, "beer-ware", r"the beer-ware licen[cs]e"),
    ("beerware", 3, 0.8, "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", 2, 0.9, "evil", r"the software shall be used for good not evil"),
    ("tcl", 2, 0.8, "authors", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("psf-2.0", 2, 0.9, "licensee", r"psf is making python available to licensee on an as is basis"),
    ("psf-2.0", 2, 0.9, "python", r"this license agreement is between the python software foundation"),
    ("psf-2.0", 3, 0.8, "psf", r"psf hereby grants licensee a nonexclusive royalty-free world-wide license"),
    ("openssl", 2, 0.9, "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 3, 0.8, "openssl", r"products derived from this software may not be called openssl"),
    ("ssleay", 2, 0.8, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("vim", 2, 0.9, "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("ruby", 3, 0.7, "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("upl-1.0", 2, 0.9, "universal", r"universal permissive licen[cs]e"),
    ("blueoak-1.0.0", 2, 0.9, "oak", r"blue oak model licen[cs]e"),
    ("mulanpsl-2.0", 2, 0.9, "mulan", r"mulan (?:psl|permissive software licen[cs]e)"),
    ("ecl-2.0", 2, 0.9, "educational", r"educational community licen[cs]e"),
    ("w3c", 2, 0.9, "w3c", r"w3c(?:®)? software (?:notice and|and document) licen[cs]e"),
    ("unicode", 2, 0.9, "unicode", r"unicode inc\.? licen[cs]e agreement"),
    ("unicode", 3, 0.8, "unicode", r"obtaining a copy of the unicode data files"),
    # Apache
    ("apache-2.0", 2, 0.9, "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", 2, 0.9, "apache.org", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.1", 2, 0.8, "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, 0.8, "apache", r"products derived from this software may not be called apache"),
    ("apache-2.0", 3, 0.8, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 3, 0.7, "basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 3, 0.7, "governing", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 2, 0.9, "contributor", r"each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable (?:copyright|\(except as stated in this section\) patent) license"),
    ("apache-2.0", 3, 0.8, "licensor", r"licensor shall mean the copyright owner or entity authorized by the copyright owner"),
    ("apache-2.0", 3, 0.8, "notice", r"if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", 3, 0.8, "boilerplate", r"attach the following boilerplate notice with the fields enclosed by brackets"),
    # copyleft texts
    ("gpl", 2, 0.9, "redistribute", r"this (?:program|software|file) is free software:?;? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 3, 0.7, "hope", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 3, 0.8, "received", r"you should have received a copy of the gnu general public licen[cs]e along with this"),
    ("gpl", 3, 0.6, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("gpl", 3, 0.6, "temple", r"free software foundation,? inc\.? 59 temple place"),
    ("gpl", 3, 0.6, "franklin", r"free software foundation,? inc\.? 51 franklin st"),
    ("gpl", 2, 0.8, "gnu.org", r"gnu\.org/licenses/gpl\.(?:html|txt)"),
    ("gpl-2.0", 2, 0.9, "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", 2, 0.9, "gnu.org", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", 2, 0.9, "option", r"either version 2 of the license or \(?at your option\)? any later version"),
    ("gpl-3.0", 2, 0.9, "option", r"either version 3 of the license or \(?at your option\)? any later version"),
    ("gpl-2.0", 2, 0.9, "version", r"under the terms of version 2 of the gnu general public licen[cs]e"),
    ("gpl-3.0", 2, 0.9, "version", r"under the terms of version 3 of the gnu general public licen[cs]e"),
    ("gpl-2.0", 2, 0.9, "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", 3, 0.8, "applies", r"this general public license applies to most of the free software foundation's software"),
    ("gpl-2.0", 3, 0.8, "activities", r"activities other than copying distribution and modification are not covered by this license"),
    ("gpl-3.0", 2, 0.9, "copyleft", r"the gnu general public licen[cs]e is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", 3, 0.8, "convey", r"to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3.0", 3, 0.8, "propagate", r"to propagate a work means to do anything with it that without permission would make you"),
    ("classpath-exception", 2, 0.9, "statically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", 2, 0.9, "runtime", r"gcc runtime library exception"),
    ("autoconf-exception", 3, 0.8, "autoconf", r"that contains a configuration script generated by autoconf"),
    ("linux-syscall-note", 2, 0.8, "syscall", r"linux-syscall-note"),
    ("lgpl", 2, 0.9, "library", r"this library is free software:?;? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", 3, 0.8, "received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this"),
    ("lgpl", 2, 0.8, "gnu.org", r"gnu\.org/licenses/lgpl\.(?:html|txt)"),
    ("lgpl-2.1", 2, 0.9, "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", 2, 0.9, "gnu.org", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", 2, 0.9, "successor", r"this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("lgpl-3.0", 2, 0.9, "incorporates", r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("lgpl", 3, 0.7, "library", r"a work that uses the library"),
    ("agpl-3.0", 2, 0.9, "remotely", r"must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3.0", 2, 0.9, "cooperation", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3.0", 2, 0.9, "gnu.org", r"gnu\.org/licenses/agpl"),
    ("agpl-3.0", 3, 0.8, "affero", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gfdl", 2, 0.9, "documentation", r"under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", 3, 0.8, "invariant", r"with no invariant sections no front-cover texts and no back-cover texts"),
    ("mpl-2.0", 2, 0.9, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v\.? ?2\.0"),
    ("mpl-2.0", 2, 0.9, "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0", 2, 0.9, "mozilla.org", r"mozilla\.org/(?:[a-z-]+/)?mpl/2\.0"),
    ("mpl-1.1", 2, 0.9, "mozilla.org", r"mozilla\.org/mpl/mpl-1\.1"),
    ("mpl-2.0", 3, 0.8, "secondary", r"incompatible with secondary licenses"),
    ("mpl-1.1", 2, 0.9, "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("mpl-1.1", 3, 0.7, "initial", r"the initial developer of the original code is"),
    ("mpl-1.1", 3, 0.7, "rights", r"see the license for the specific language governing rights and limitations under the license"),
    ("epl", 2, 0.9, "accompanying", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    ("epl", 3, 0.8, "recipient", r"constitutes recipient's acceptance of this agreement"),
    ("epl-1.0", 2, 0.9, "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", 2, 0.9, "eclipse", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("cddl-1.0", 2, 0.9, "opensolaris", r"usr/src/opensolaris\.license"),
    ("cddl-1.0", 3, 0.8, "cddl", r"include this cddl header (?:notice )?in each file"),
    ("eupl-1.2", 2, 0.8, "eupl", r"licen[cs]ed under the eupl"),
    ("cecill", 2, 0.8, "cecill", r"governed by the cecill(?:-[bc])? licen[cs]e"),
    ("osl-3.0", 3, 0.8, "sublicensable", r"grants you a worldwide royalty-free non-exclusive sublicensable license for the duration of the copyright"),
    ("artistic-1.0", 2, 0.9, "semblance", r"maintains some semblance of artistic control"),
    ("artistic-2.0", 3, 0.8, "standard", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("perl", 2, 0.8, "perl", r"under the same terms as perl(?: itself)?"),
    ("lppl-1.3c", 2, 0.8, "latex", r"latex project public licen[cs]e"),
    ("qpl-1.0", 3, 0.8, "trolltech", r"the q public licen[cs]e.{0,40}?trolltech"),
    ("apsl-2.0", 2, 0.8, "apple", r"apple public source licen[cs]e"),
    ("ipl-1.0", 2, 0.8, "ibm", r"ibm public licen[cs]e"),
    ("rpl-1.5", 2, 0.8, "reciprocal", r"reciprocal public licen[cs]e"),
    ("sissl", 2, 0.8, "sun", r"sun industry standards source licen[cs]e"),
    ("ms-pl", 3, 0.7, "governs", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", 3, 0.8, "reciprocal", r"reciprocal grants for any file you distribute that contains code from the software"),
    # content and data
    ("cc0-1.0", 2, 0.9, "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 2, 0.9, "publicdomain", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", 2, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/by/\d"),
    ("cc-by-sa", 2, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/\d"),
    ("cc-by-nc", 2, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/\d"),
    ("cc-by-nd", 2, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/\d"),
    ("cc-by-nc-sa", 2, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/\d"),
    ("cc-by-nc-nd", 2, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/\d"),
    ("cc-by", 3, 0.7, "credit", r"you must give appropriate credit provide a link to the license"),
    ("cc-by-sa", 3, 0.7, "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", 3, 0.7, "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", 3, 0.7, "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl-1.1", 3, 0.8, "font", r"neither the font software nor any of its individual components"),
    ("ofl-1.1", 3, 0.8, "reserved", r"no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", 2, 0.9, "sil.org", r"scripts\.sil\.org/ofl"),
    ("odbl", 2, 0.9, "opendatacommons.org", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", 2, 0.9, "opendatacommons.org", r"opendatacommons\.org/licenses/by"),
    ("pddl", 2, 0.9, "opendatacommons.org", r"opendatacommons\.org/licenses/pddl"),
    # source-available and closed terms
    ("sspl-1.0", 2, 0.9, "server", r"server side public licen[cs]e"),
    ("busl-1.1", 2, 0.9, "business", r"business source licen[cs]e"),
    ("busl-1.1", 3, 0.8, "non-production", r"make non-production use of the licensed work"),
    ("elastic-2.0", 2, 0.9, "elastic", r"elastic licen[cs]e"),
    ("elastic-2.0", 3, 0.8, "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 2, 0.9, "commons", r"commons clause licen[cs]e condition"),
    ("polyform", 2, 0.9, "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e"),
    ("proprietary", 4, 0.6, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 4, 0.6, "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)"),
]
