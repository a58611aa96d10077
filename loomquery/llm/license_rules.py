r"""License signatures: ordered regular expressions over normalised words.

A rule is ``(label, priority, keyword, regex)``.  Texts are matched after
normalisation to lower-case words joined by single spaces, with one space at
either end, so every regex is put between a space and a space ahead.  Each
quantifier is bounded.  ``keyword`` is a literal that every match of the rule
contains, and every keyword contains one of ``ANCHORS``.

Priorities: 4 an explicit identifier or the license's own text, 3 a grant that
names the license, 2 its title or address, 1 a short mention or generic notice.
"""

from __future__ import annotations

#: Written one by one, in order; the position is the rule's number.
SIGNATURES = (
    # Apache
    ("apache-2.0", 4, "identifier apache 2", r"spdx license identifier apache 2 0"),
    ("apache-2.0", 4, "except in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 4, "perpetual worldwide non exclusive no charge royalty free irrevocable copyright", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", 3, "under the apache license", r"(?:licensed|released|distributed|available|provided) under the apache license(?: version 2(?: 0)?| v ?2(?: 0)?)?"),
    ("apache-2.0", 3, "licensed under apache", r"licensed under apache(?: license)?(?: version)? ?v?2(?: 0)?"),
    ("apache-2.0", 2, "apache license version 2", r"apache license version 2(?: 0)?(?: january 2004)?"),
    ("apache-2.0", 2, "apache org licenses license 2", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 1, "apache license", r"(?:the )?apache license"),
    ("apache-2.0", 1, "apache 2 0 licen", r"apache 2 0 licen[cs]ed?"),
    ("apache-1.1", 4, "identifier apache 1", r"spdx license identifier apache 1 [01]"),
    ("apache-1.1", 2, "apache software license", r"(?:the )?apache software license(?: version 1 [01])?"),
    # MIT and relatives
    ("mit", 4, "identifier mit", r"spdx license identifier mit"),
    ("mit", 4, "permission is hereby granted free of charge to any person", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", 4, "above copyright notice and this permission notice shall be included", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "under the mit license", r"(?:licensed|released|distributed|available|published) under the mit license"),
    ("mit", 3, "under the terms of the mit license", r"under the terms of the mit license"),
    ("mit", 2, "the mit license", r"the mit license(?: mit)?"),
    ("mit", 2, "opensource org licenses mit", r"(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php| html)?"),
    ("mit", 1, "mit license", r"mit license"),
    ("mit", 1, "mit licensed", r"mit licensed"),
    ("x11", 2, "x11 license", r"(?:mit )?x11 license"),
    ("mit-0", 4, "identifier mit 0", r"spdx license identifier mit 0"),
    ("mit-0", 2, "mit no attribution licen", r"mit no attribution license"),
    ("mit-0", 2, "mit no attribution", r"mit no attribution"),
    ("isc", 4, "identifier isc", r"spdx license identifier isc"),
    ("isc", 4, "permission to use copy modify and", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 4, "software is provided as is and the author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", 2, "the isc license", r"the isc license(?: isc)?"),
    ("isc", 1, "isc license", r"isc licensed?"),
    ("hpnd", 4, "permission to use copy modify distribute and sell", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    # BSD
    ("bsd-2-clause", 4, "identifier bsd 2 clause", r"spdx license identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", 4, "identifier bsd 3 clause", r"spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", 4, "identifier bsd 4 clause", r"spdx license identifier bsd 4 clause(?: uc)?"),
    ("0bsd", 4, "identifier 0bsd", r"spdx license identifier 0bsd"),
    ("bsd", 4, "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", 4, "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 4, "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 4, "without specific prior written permission", r"neither the names? of (?:\S+ ){1,14}may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 4, "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", 3, "under the 3 clause bsd licen", r"(?:licensed|released|distributed|available) under the 3 clause bsd license"),
    ("bsd-2-clause", 3, "under the 2 clause bsd licen", r"(?:licensed|released|distributed|available) under the 2 clause bsd license"),
    ("bsd", 3, "under the bsd licen", r"(?:licensed|released|distributed|available) under the bsd license"),
    ("bsd", 3, " a bsd style licen", r"(?:licensed|released|distributed|available|governed) (?:under|by) a bsd style license"),
    ("bsd-3-clause", 2, "bsd 3 clause licen", r"bsd 3 clause license"),
    ("bsd-3-clause", 2, "new bsd licen", r"(?:the )?new bsd license"),
    ("bsd-3-clause", 2, "modified bsd licen", r"(?:the )?modified bsd license"),
    ("bsd-3-clause", 2, "revised bsd licen", r"(?:the )?revised bsd license"),
    ("bsd-2-clause", 2, "bsd 2 clause licen", r"bsd 2 clause license"),
    ("bsd-2-clause", 2, "simplified bsd licen", r"(?:the )?simplified bsd license"),
    ("bsd-2-clause", 2, "freebsd licen", r"(?:the )?freebsd license"),
    ("bsd-4-clause", 2, "original bsd licen", r"(?:the )?original bsd license"),
    ("0bsd", 2, "zero clause bsd licen", r"zero clause bsd license"),
    ("bsd", 2, "opensource org licenses bsd", r"(?:https? )?(?:www )?opensource org licenses bsd [23] clause"),
    ("bsd", 1, "bsd licen", r"bsd licensed?"),
    # GNU
    ("gpl-2.0", 4, "identifier gpl 2", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", 4, "identifier gpl 3", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("gpl-1.0", 4, "identifier gpl 1", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl", 4, "under the terms of the gnu general public licen", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", 4, "either version 2 of the licen", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 4, "either version 3 of the licen", r"either version 3 of the license or at your option any later version"),
    ("gpl", 4, "without even the implied warrant", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", 4, "received a copy of the gnu general public licen", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-3.0", 3, "general public license version 3", r"(?:under the )?(?:terms of the )?gnu general public license version 3(?: 0)?"),
    ("gpl-2.0", 3, "general public license version 2", r"(?:under the )?(?:terms of the )?gnu general public license version 2(?: 0)?"),
    ("gpl-3.0", 3, "general public license v3", r"(?:gnu )?general public license v3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", 3, "general public license v2", r"(?:gnu )?general public license v2(?: 0)?(?: only| or later)?"),
    ("gpl", 3, "licensed under the gpl", r"licensed under the gpl(?: ?v[23])?"),
    ("gpl", 3, "released under the gpl", r"released under the gpl(?: ?v[23])?"),
    ("gpl", 2, "gnu general public licen", r"(?:the )?gnu general public licen[cs]e"),
    ("gpl", 2, "gnu org licenses gpl", r"(?:https? )?(?:www )?gnu org licenses gpl(?: [23] 0)?(?: html| txt)?"),
    ("gpl-3.0", 1, "gplv3 licen", r"gplv3 licen[cs]ed?"),
    ("gpl-2.0", 1, "gplv2 licen", r"gplv2 licen[cs]ed?"),
    ("gpl", 1, "gpl licen", r"gpl licen[cs]ed?"),
    ("gpl-exception", 2, "classpath exception", r"(?:gnu )?classpath exception(?: 2 0)?"),
    ("gpl-exception", 2, "runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("lgpl-2.1", 4, "identifier lgpl 2 1", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", 4, "identifier lgpl 3", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", 4, "identifier lgpl 2 0", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl", 4, "under the terms of the gnu lesser general public licen", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-2.0", 4, "under the terms of the gnu library general public licen", r"modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", 3, "lesser general public license version 2 1", r"gnu lesser general public license version 2 1"),
    ("lgpl-3.0", 3, "lesser general public license version 3", r"gnu lesser general public license version 3(?: 0)?"),
    ("lgpl", 3, " under the lgpl", r"(?:licensed|released|distributed) under the lgpl(?: ?v?[23](?: [01])?)?"),
    ("lgpl", 2, "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", 2, "library general public licen", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl", 2, "gnu org licenses lgpl", r"(?:https? )?(?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("lgpl", 1, "lgpl licen", r"lgpl licen[cs]ed?"),
    ("agpl-3.0", 4, "identifier agpl", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl-3.0", 4, "under the terms of the gnu affero general public licen", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", 3, " under the agpl", r"(?:licensed|released|distributed) under the agpl(?: ?v?3(?: 0)?)?"),
    ("agpl-3.0", 2, "affero general public licen", r"(?:gnu )?affero general public licen[cs]e(?: version 3| v3)?"),
    ("agpl-3.0", 2, "gnu org licenses agpl", r"(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl-3.0", 1, "agpl licen", r"agpl licen[cs]ed?"),
    ("gfdl", 4, "identifier gfdl", r"spdx license identifier gfdl 1 [1-3](?: only| or later)?"),
    ("gfdl", 4, "modify this document under the terms of the gnu free documentation licen", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 2, "gnu free documentation licen", r"gnu free documentation licen[cs]e(?: version 1 [1-3])?"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2.0", 4, "identifier mpl 2", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("mpl-1.1", 4, "identifier mpl 1", r"spdx license identifier mpl 1 [01]"),
    ("mpl-2.0", 4, "subject to the terms of the mozilla public licen", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 4, "subject to the mozilla public licen", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 3, "under the mozilla public licen", r"(?:licensed|released|distributed) under the mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", 2, "mozilla public license version 1", r"mozilla public license version 1 [01]"),
    ("mpl-2.0", 2, "mozilla public licen", r"mozilla public licen[cs]e"),
    ("mpl-2.0", 2, "mozilla org mpl 2", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl", 1, "mpl 2 0 licen", r"mpl 2 0 licen[cs]ed?"),
    ("epl-2.0", 4, "identifier epl 2", r"spdx license identifier epl 2 0"),
    ("epl-1.0", 4, "identifier epl 1", r"spdx license identifier epl 1 0"),
    ("epl-2.0", 4, "available under the terms of the eclipse public license 2", r"made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", 4, "available under the terms of the eclipse public license v1", r"made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 2, "eclipse public license v 2", r"eclipse public license v 2(?: 0)?"),
    ("epl", 2, "eclipse public licen", r"eclipse public licen[cs]e"),
    ("edl-1.0", 2, "eclipse distribution licen", r"eclipse distribution licen[cs]e(?: v 1 0)?"),
    ("cddl-1.0", 4, "identifier cddl", r"spdx license identifier cddl 1 [01]"),
    ("cddl-1.0", 4, "subject to the terms of the common development and distribution licen", r"subject to the terms of the common development and distribution license"),
    ("cddl-1.0", 2, "common development and distribution licen", r"common development and distribution licen[cs]e(?: version 1 [01])?"),
    ("cpl-1.0", 4, "identifier cpl", r"spdx license identifier cpl 1 0"),
    ("cpl-1.0", 2, "common public licen", r"common public licen[cs]e(?: version 1 0| v1 0)?"),
    ("ipl-1.0", 2, "ibm public licen", r"ibm public licen[cs]e(?: version 1 0)?"),
    ("eupl", 4, "identifier eupl", r"spdx license identifier eupl 1 [0-2]"),
    ("eupl", 4, "licensed under the eupl", r"licensed under the eupl(?: version)?(?: 1 [0-2])?"),
    ("eupl", 2, "european union public licen", r"european union public licen[cs]e(?: version 1 [0-2]| v 1 [0-2])?"),
    ("cecill", 4, "identifier cecill", r"spdx license identifier cecill(?: [abc12])?(?: [01])?"),
    ("cecill", 4, "governed by the cecill", r"this software is governed by the cecill(?: [abc])? license"),
    ("cecill", 2, "cecill free software licen", r"cecill free software license agreement"),
    ("ms-pl", 4, "identifier ms pl", r"spdx license identifier ms pl"),
    ("ms-pl", 2, "microsoft public licen", r"microsoft public licen[cs]e(?: ms pl)?"),
    ("ms-rl", 4, "identifier ms rl", r"spdx license identifier ms rl"),
    ("ms-rl", 2, "microsoft reciprocal licen", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("osl-3.0", 2, "open software licen", r"open software license(?: version)?(?: v ?)?[123] [01]"),
    ("afl-3.0", 2, "academic free licen", r"academic free license(?: version| v)?(?: ?[123] [01])?"),
    ("nosa", 2, "nasa open source agreement licen", r"nasa open source agreement license(?: version 1 3)?"),
    ("qpl", 2, "q public licen", r"(?:the )?q public license(?: version 1 0)?"),
    ("sleepycat", 2, "sleepycat licen", r"(?:the )?sleepycat license"),
    ("upl-1.0", 2, "universal permissive licen", r"universal permissive license(?: v ?1 0| version 1 0)?"),
    ("artistic", 4, "identifier artistic", r"spdx license identifier artistic [12] 0(?: perl| cl8)?"),
    ("artistic", 2, "the artistic licen", r"the artistic license(?: version)?(?: [12] 0)?"),
    ("artistic", 3, "same terms as perl itself", r"(?:redistribute|redistributed) (?:it )?(?:and or modify it |and or modified )?under the same terms as perl itself"),
    # Permissive, by product
    ("zlib", 4, "identifier zlib", r"spdx license identifier zlib"),
    ("zlib", 4, "misrepresented you must not claim that you wrote the original software permission", r"must not be misrepresented you must not claim that you wrote the original software permission"),
    ("zlib", 4, "permission is granted to anyone to use this software for any purpose", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", 2, "zlib licen", r"(?:the )?zlib license"),
    ("zlib", 2, "zlib libpng licen", r"(?:the )?zlib libpng license"),
    ("libpng", 2, "libpng licen", r"(?:the )?libpng license(?: version 2)?"),
    ("boost", 4, "identifier bsl", r"spdx license identifier bsl 1 0"),
    ("boost", 4, "distributed under the boost software licen", r"distributed under the boost software license version 1 0"),
    ("boost", 2, "boost software licen", r"boost software licen[cs]e(?: 1 0)?"),
    ("boost", 2, "boost org license", r"(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("python-2.0", 4, "identifier psf", r"spdx license identifier psf 2 0"),
    ("python-2.0", 2, "python software foundation licen", r"python software foundation license(?: version 2)?"),
    ("python-2.0", 1, "psf licen", r"psf licen[cs]ed?"),
    ("ruby", 2, "ruby s licen", r"(?:the )?ruby s license"),
    ("ruby", 1, "ruby licen", r"(?:the )?ruby license"),
    ("php", 4, "subject to version 3 0 of the php licen", r"this source file is subject to version 3 0 of the php license"),
    ("php", 4, "subject to version 3 01 of the php licen", r"this source file is subject to version 3 01 of the php license"),
    ("php", 2, "php licen", r"(?:the )?php license(?: version 3 0[01]?)?"),
    ("postgresql", 4, "identifier postgresql", r"spdx license identifier postgresql"),
    ("postgresql", 2, "postgresql licen", r"(?:the )?postgresql licen[cs]e"),
    ("openssl", 4, "identifier openssl", r"spdx license identifier openssl"),
    ("openssl", 2, "openssl licen", r"(?:the )?openssl license"),
    ("openssl", 2, "ssleay licen", r"(?:the )?(?:original )?ssleay license"),
    ("w3c", 4, "identifier w3c", r"spdx license identifier w3c(?: 20150513| 19980720)?"),
    ("w3c", 2, "w3c software notice and licen", r"w3c software notice and license"),
    ("w3c", 2, "w3c software and document licen", r"w3c software and document license"),
    ("ncsa", 4, "identifier ncsa", r"spdx license identifier ncsa"),
    ("ncsa", 2, "ncsa open source licen", r"(?:university of illinois )?ncsa open source license"),
    ("curl", 2, "curl licen", r"(?:the )?curl license"),
    ("ftl", 2, "freetype project licen", r"(?:the )?freetype project license"),
    ("unicode", 2, "unicode licen", r"unicode license(?: v3| agreement)?"),
    ("icu", 2, "icu licen", r"(?:the )?icu license"),
    ("ijg", 2, "independent jpeg group licen", r"independent jpeg group license"),
    ("json", 4, "licensed for good not evil", r"licensed for good not evil"),
    ("json", 2, "json licen", r"(?:the )?json license"),
    ("beerware", 2, "beer ware licen", r"(?:the )?beer ware license(?: revision 42)?"),
    ("wtfpl", 4, "identifier wtfpl", r"spdx license identifier wtfpl"),
    ("wtfpl", 2, "want to public licen", r"do what the fuck you want to public license"),
    ("wtfpl", 1, "wtfpl licen", r"wtfpl licen[cs]ed?"),
    ("tcl", 2, "tcl tk licen", r"(?:the )?tcl tk license"),
    ("vim", 2, "vim licen", r"(?:the )?vim license"),
    ("mulan", 2, "mulan permissive software licen", r"mulan permissive software license(?: version 2| v2)?"),
    ("bzip2", 2, "bzip2 licen", r"bzip2 license"),
    ("intel", 2, "intel simplified software licen", r"intel simplified software license"),
    # Public domain
    ("unlicense", 4, "identifier unlicense", r"spdx license identifier unlicense"),
    ("unlicense", 4, "unencumbered software released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, "the unlicense", r"the unlicense"),
    ("unlicense", 2, "unlicense org", r"(?:https? )?unlicense org"),
    ("pddl", 4, "identifier pddl", r"spdx license identifier pddl 1 0"),
    ("pddl", 1, "pddl 1 0 licen", r"pddl 1 0 licen[cs]ed?"),
    ("public-domain", 3, "released into the public domain", r"(?:is |are |been )?released into the public domain"),
    ("public-domain", 3, "placed in the public domain", r"(?:is |are |been )?placed in the public domain"),
    ("public-domain", 3, "dedicated to the public domain", r"(?:is |are |been )?dedicated to the public domain"),
    ("public-domain", 1, "in the public domain", r"(?:is |are )?in the public domain"),
    ("public-domain", 1, "public domain", r"public domain"),
    # Creative Commons
    ("cc0", 4, "identifier cc0", r"spdx license identifier cc0 1 0"),
    ("cc0", 4, "creativecommons org publicdomain zero", r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("cc0", 3, "cc0 1 0 universal public domain", r"cc0 1 0 universal public domain dedication"),
    ("cc0", 2, "creative commons zero", r"creative commons zero(?: v1 0| 1 0)?(?: universal)?"),
    ("cc0", 2, " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-pdm", 2, "creativecommons org publicdomain mark", r"(?:https? )?creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", 4, "creativecommons org licenses by nc nd", r"(?:https? )?creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", 4, "creativecommons org licenses by nc sa", r"(?:https? )?creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc", 4, "creativecommons org licenses by nc", r"(?:https? )?creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", 4, "creativecommons org licenses by nd", r"(?:https? )?creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", 4, "creativecommons org licenses by sa", r"(?:https? )?creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by", 4, "creativecommons org licenses by", r"(?:https? )?creativecommons org licenses by [1-4] [05]"),
    ("cc", 2, "creativecommons org", r"(?:https? )?(?:www )?creativecommons org(?: licenses)?"),
    ("cc-by-nc-nd", 3, " cc by nc nd", r"cc by nc nd(?: [1-4] [05])?(?: licen[cs]ed?)?"),
    ("cc-by-nc-sa", 3, " cc by nc sa", r"cc by nc sa(?: [1-4] [05])?(?: licen[cs]ed?)?"),
    ("cc-by-nc", 3, " cc by nc", r"cc by nc(?: [1-4] [05])?(?: licen[cs]ed?)?"),
    ("cc-by-nd", 3, " cc by nd", r"cc by nd(?: [1-4] [05])?(?: licen[cs]ed?)?"),
    ("cc-by-sa", 3, " cc by sa", r"cc by sa(?: [1-4] [05])?(?: licen[cs]ed?)?"),
    ("cc-by", 3, " cc by ", r"cc by [1-4] [05](?: licen[cs]ed?)?"),
    ("cc-by-nc-nd", 2, "creative commons attribution noncommercial no", r"creative commons attribution noncommercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-sa", 2, "creative commons attribution noncommercial share", r"creative commons attribution noncommercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", 2, "creative commons attribution noncommercial", r"creative commons attribution noncommercial(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", 2, "creative commons attribution non commercial", r"creative commons attribution non commercial(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nd", 2, "creative commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", 2, "creative commons attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by", 2, "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc", 3, "under a creative commons licen", r"(?:licensed |released |available )?under a creative commons licen[cs]e"),
    ("cc", 1, "creative commons", r"creative commons"),
    # Fonts, data, models
    ("ofl-1.1", 4, "identifier ofl", r"spdx license identifier ofl 1 [01]"),
    ("ofl-1.1", 4, "licensed under the sil open font licen", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 2, "open font licen", r"(?:sil )?open font license(?: 1 [01])?"),
    ("odbl", 4, "available under the open database licen", r"made available under the open database license"),
    ("odbl", 2, "open database licen", r"open database licen[cs]e(?: v ?1 0)?"),
    ("odc-by", 2, "open data commons attribution licen", r"open data commons attribution license(?: v ?1 0)?"),
    ("pddl", 2, "public domain dedication and licen", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("ogl", 3, "licensed under the open government licen", r"(?:contains public sector information )?licensed under the open government licence(?: v ?[123] 0)?"),
    ("ogl", 2, "open government licen", r"open government licen[cs]e(?: v ?[123] 0)?"),
    ("cdla", 2, "community data license agreement", r"community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?"),
    ("openrail", 2, "openrail licen", r"(?:creativeml |bigscience |bigcode )?openrail licen[cs]e"),
    ("openrail", 2, "openrail m licen", r"(?:creativeml |bigscience |bigcode )?openrail m licen[cs]e"),
    ("openrail", 2, "creativeml open", r"creativeml open ?rail(?: m| \+\+ m)?"),
    ("rail", 2, "responsible ai licen", r"responsible ai licen[cs]es?"),
    # Source available and proprietary
    ("sspl", 4, "identifier sspl", r"spdx license identifier sspl 1 0"),
    ("sspl", 2, "server side public licen", r"server side public licen[cs]e(?: version 1| v 1)?"),
    ("elastic-2.0", 4, "identifier elastic", r"spdx license identifier elastic 2 0"),
    ("elastic-2.0", 2, "elastic licen", r"elastic license(?: 2 0| v ?2)?"),
    ("business-source", 4, "identifier busl", r"spdx license identifier busl 1 1"),
    ("business-source", 2, "business source licen", r"business source licen[cs]e(?: 1 1)?"),
    ("polyform", 2, "polyform", r"polyform (?:noncommercial|shield|strict|perimeter|free trial) license(?: 1 0 0)?"),
    ("commons-clause", 3, "commons clause licen", r"commons clause licen[cs]e condition"),
    ("proprietary", 3, "proprietary and confidential", r"(?:is |are )?proprietary and confidential"),
    ("proprietary", 2, "without prior written permission", r"(?:reproduced|copied|distributed|transmitted|used) (?:in any form )?without prior written permission"),
    ("proprietary", 2, "without the prior written permission", r"without the prior written permission of"),
    ("proprietary", 2, "without permission", r"(?:may not|must not|not to) be (?:reproduced|copied|distributed) without permission"),
    ("proprietary", 2, "unauthorized copying", r"unauthorized copying of this file"),
    ("proprietary", 2, "end user license agreement", r"end user license agreement"),
    ("proprietary", 1, "proprietary licen", r"proprietary licen[cs]e"),
    ("non-commercial", 2, "non commercial use only", r"(?:for )?non commercial use only"),
    ("non-commercial", 2, "noncommercial use only", r"(?:for )?noncommercial use only"),
    ("research-only", 2, "research use only", r"(?:for )?(?:academic and )?research use only"),
    ("research-only", 2, "academic use only", r"(?:for )?academic use only"),
    ("personal-use", 2, "personal use only", r"(?:for )?personal use only"),
    ("evaluation-only", 2, "evaluation use only", r"(?:for )?evaluation use only"),
    # Notices
    ("reserved", 2, "all rights reserved", r"copyright (?:\S+ ){0,12}all rights reserved"),
    ("reserved", 1, "some rights reserved", r"some rights reserved"),
    ("no-rights-reserved", 1, "no rights reserved", r"no rights reserved"),
    ("copyright-notice", 1, "copyright c ", r"copyright c (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?"),
    ("copyright-notice", 1, "copyright 19", r"copyright 19[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?"),
    ("copyright-notice", 1, "copyright 20", r"copyright 20[0-9]{2}(?: 20[0-9]{2})?(?: by)?"),
    ("spdx-copyright", 2, "spdx filecopyrighttext", r"spdx filecopyrighttext"),
    ("warranty-disclaimer", 1, "without warranty of any kind", r"without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", 1, "without warranties or conditions", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", 1, "implied warrant", r"any express or implied warrant(?:y|ies)"),
    ("dual-license", 2, "dual licensed under", r"(?:is |are )?dual licensed under"),
    ("dual-license", 2, "licensed under either of", r"licensed under either of"),
    ("multi-license", 2, "licensed under multiple", r"licensed under multiple licenses"),
    ("see-license-file", 1, "see the license file", r"see the license file(?: for details)?"),
    ("see-license-file", 1, "see license txt", r"see license txt(?: for details)?"),
    ("see-license-file", 1, "see license md", r"see license md(?: for details)?"),
    ("see-license-file", 1, "license that can be found in the license file", r"(?:bsd style )?license that can be found in the license file"),
    ("unknown-license", 1, "licensed under the terms of", r"licensed under the terms of"),
    ("unknown-license", 1, "released under the following licen", r"released under the following licen[cs]e"),
)

#: The contract's base phrases.  They are never suppressed.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

#: Every keyword contains one of these, so a text without any of them holds no match of any rule.
ANCHORS = (
    "licen", "identifier ", " under ", " cc by", " cc0 ", "cc0 1 0", "creative commons", "creativecommons org", "rights reserved", "public domain", "copyright",
    "permission", "redistribut", "warrant", "proprietary", "use only", "all advertising materials", "mozilla org", "gnu org", "boost org", "opensource org",
    " exception", "mit no attribution", "terms as perl", "governed by the", "creativeml open", "polyform", "unauthorized copying", "classpath exception", "runtime library exception",
)


def rules() -> list[dict]:
    """All rules in order; the base phrases come first."""
    found = [{"label": label, "priority": 1, "keyword": f" {phrase} ", "regex": f" {phrase}(?= )", "base": True} for label, phrase in BASE]
    for label, priority, keyword, body in SIGNATURES:
        found.append({"label": label, "priority": priority, "keyword": keyword, "regex": f" (?:{body})(?= )", "base": False})
    return found
