"""The license scan's signature rules, and what is derived from their regexes.

A rule is (label, keyword, priority, confidence, regex). Its regex is matched against words
joined by single blanks, lower case, and uses literals, classes, groups, alternatives and
counted repetitions only, so that its possible first words, the longest match and the
literals that every match has can be read from it.
"""

from __future__ import annotations

import re
from functools import cache

# Names and abbreviations of licences.
NAMES = [
    ("gpl", "gnu", 40, 0.90, r"gnu general public licen[cs]e"),
    ("gpl", "gnu", 60, 0.97, r"gnu general public licen[cs]e v(?:ersion)? ?[123](?: 0)?(?: or (?:any )?later(?: version)?| only)?"),
    ("gpl", "gnu", 40, 0.90, r"gnu gpl(?: ?v(?:ersion)? ?[123](?: 0)?)?(?: or later| only)?"),
    ("gpl", "general public", 35, 0.80, r"general public licen[cs]e"),
    ("gpl", "gpl", 30, 0.80, r"gpl(?: ?v?[123](?: 0)?)?"),
    ("gpl", "gpl", 45, 0.92, r"gpl ?(?:v|version )?[123](?: 0)? (?:or later|only)"),
    ("gpl", "gpl", 35, 0.85, r"gpl licen[cs]ed?"),
    ("lgpl", "lesser", 60, 0.97, r"(?:gnu )?lesser general public licen[cs]e(?: v(?:ersion)? ?[23](?: [01])?)?(?: or (?:any )?later(?: version)?| only)?"),
    ("lgpl", "library general", 60, 0.97, r"(?:gnu )?library general public licen[cs]e(?: v(?:ersion)? ?2(?: 0)?)?(?: or (?:any )?later(?: version)?)?"),
    ("lgpl", "lgpl", 40, 0.85, r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?(?: or later| only)?"),
    ("agpl", "affero", 60, 0.97, r"(?:gnu )?affero general public licen[cs]e(?: v(?:ersion)? ?[13](?: 0)?)?(?: or (?:any )?later(?: version)?| only)?"),
    ("agpl", "agpl", 40, 0.85, r"(?:gnu )?agpl(?: ?v?[13](?: 0)?)?(?: or later| only)?"),
    ("gfdl", "free documentation", 60, 0.97, r"(?:gnu )?free documentation licen[cs]e(?: v(?:ersion)? ?1(?: [123])?)?(?: or (?:any )?later(?: version)?)?"),
    ("gfdl", "gfdl", 40, 0.85, r"(?:gnu )?gfdl(?: ?v?1(?: [123])?)?"),
    ("gpl-exception", "classpath", 62, 0.95, r"classpath exception(?: to the gpl)?"),
    ("gpl-exception", "exception", 62, 0.95, r"gcc runtime library exception(?: v(?:ersion)? ?3(?: [01])?)?"),
    ("gpl-exception", "linking exception", 62, 0.93, r"(?:gpl |lgpl )?(?:static )?linking exception"),
    ("gpl-exception", "font exception", 62, 0.93, r"(?:gpl )?font exception"),
    ("gpl-exception", "autoconf", 62, 0.93, r"autoconf (?:configure )?script exception"),
    ("gpl-exception", "bison", 62, 0.93, r"bison exception"),
    ("gpl-exception", "openssl", 62, 0.93, r"openssl (?:linking )?exception"),
    ("gpl-exception", "syscall", 62, 0.93, r"linux syscall note"),
    ("llvm-exception", "llvm", 64, 0.95, r"(?:apache (?:licen[cs]e )?(?:v(?:ersion)? ?)?2 0 with )?llvm exceptions?"),
    ("apache", "apache", 40, 0.90, r"apache(?: software)? licen[cs]e"),
    ("apache", "apache", 60, 0.97, r"apache(?: software)? licen[cs]e v(?:ersion)? ?[12](?: [01])?"),
    ("apache", "apache", 50, 0.93, r"apache(?: software)? licen[cs]e [12] [01]"),
    ("apache", "apache", 45, 0.90, r"apache ?v?2(?: 0)? licen[cs]ed?"),
    ("apache", "apache 2", 35, 0.75, r"apache 2 0"),
    ("apache", "asl", 40, 0.80, r"asl ?v?2 0"),
    ("mit", "mit", 40, 0.90, r"mit(?: x11| expat)? licen[cs]e"),
    ("mit", "mit", 35, 0.85, r"mit licen[cs]ed"),
    ("mit", "mit style", 40, 0.80, r"mit style licen[cs]e"),
    ("mit", "expat", 40, 0.90, r"expat licen[cs]e"),
    ("mit", "x11", 40, 0.88, r"x11 licen[cs]e"),
    ("mit-0", "attribution", 62, 0.95, r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", "mit 0", 40, 0.80, r"mit 0 licen[cs]e"),
    ("isc", "isc", 40, 0.90, r"(?:openbsd )?isc licen[cs]e"),
    ("bsd", "bsd", 40, 0.90, r"(?:new |modified |simplified |revised |original |free ?)?bsd(?: style)? licen[cs]e"),
    ("bsd-4-clause", "clause", 60, 0.95, r"(?:bsd )?(?:4|four) clause (?:original )?(?:bsd(?: licen[cs]e)?|licen[cs]e)"),
    ("bsd-3-clause", "clause", 60, 0.95, r"(?:bsd )?(?:3|three) clause (?:new |revised )?(?:bsd(?: licen[cs]e)?|licen[cs]e)"),
    ("bsd-2-clause", "clause", 60, 0.95, r"(?:bsd )?(?:2|two) clause (?:simplified )?(?:bsd(?: licen[cs]e)?|licen[cs]e)"),
    ("bsd-3-clause", "clause", 40, 0.85, r"bsd (?:3|three) clause"),
    ("bsd-2-clause", "clause", 40, 0.85, r"bsd (?:2|two) clause"),
    ("bsd-4-clause", "clause", 40, 0.85, r"bsd (?:4|four) clause"),
    ("0bsd", "0bsd", 45, 0.90, r"0bsd(?: licen[cs]e)?"),
    ("0bsd", "zero clause", 60, 0.93, r"(?:bsd )?zero clause bsd(?: licen[cs]e)?"),
    ("mpl", "mozilla", 60, 0.97, r"mozilla public licen[cs]e(?: v(?:ersion)? ?[12](?: [01])?| [12] [01])?"),
    ("mpl", "mpl", 35, 0.80, r"mpl ?v?[12](?: [01])?"),
    ("npl", "netscape", 60, 0.95, r"netscape public licen[cs]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("epl", "eclipse public", 60, 0.97, r"eclipse public licen[cs]e(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("edl", "eclipse distribution", 60, 0.97, r"eclipse distribution licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("epl", "epl", 35, 0.75, r"epl ?v?[12] 0"),
    ("cddl", "common development", 60, 0.97, r"common development and distribution licen[cs]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("cddl", "cddl", 40, 0.88, r"cddl(?: ?v?1(?: [01])?)?"),
    ("cpl", "common public", 60, 0.95, r"common public licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("cpal", "common public attribution", 62, 0.96, r"common public attribution licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("ipl", "ibm", 60, 0.95, r"ibm public licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("artistic", "artistic", 50, 0.92, r"artistic licen[cs]e(?: v(?:ersion)? ?[12](?: 0)?| [12] 0)?"),
    ("artistic", "clarified", 60, 0.95, r"clarified artistic licen[cs]e"),
    ("boost", "boost", 60, 0.97, r"boost software licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("boost", "bsl 1", 35, 0.75, r"bsl 1 0"),
    ("zlib", "zlib", 50, 0.92, r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", 50, 0.92, r"libpng licen[cs]e(?: v(?:ersion)? ?2)?"),
    ("wtfpl", "wtfpl", 50, 0.95, r"wtfpl(?: ?v?[12])?"),
    ("unlicense", "unlicense", 50, 0.95, r"unlicense"),
    ("ofl", "open font", 60, 0.96, r"(?:sil )?open font licen[cs]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("ofl", "ofl", 35, 0.75, r"(?:sil )?ofl ?v?1 1"),
    ("eupl", "european", 60, 0.96, r"european union public licen[cs]e(?: v(?:ersion)? ?1(?: [0-2])?)?"),
    ("eupl", "eupl", 40, 0.88, r"eupl(?: ?v?1(?: [0-2])?)?"),
    ("odbl", "open database", 60, 0.96, r"open database licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("odbl", "odbl", 40, 0.88, r"odbl(?: ?v?1(?: 0)?)?"),
    ("odc-by", "commons attribution", 60, 0.95, r"open data commons attribution licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("pddl", "public domain dedication", 60, 0.95, r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("ogl", "open government", 60, 0.95, r"open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    ("psf", "python software", 60, 0.96, r"python software foundation licen[cs]e(?: v(?:ersion)? ?2)?"),
    ("psf", "psf", 40, 0.85, r"psf licen[cs]e"),
    ("php", "php", 50, 0.92, r"php licen[cs]e(?: v(?:ersion)? ?[23](?: [01]{1,2})?)?"),
    ("ruby", "ruby", 45, 0.88, r"ruby licen[cs]e"),
    ("perl", "same terms", 60, 0.93, r"same terms as perl(?: itself)?"),
    ("tcl", "tcl", 50, 0.90, r"tcl tk licen[cs]e"),
    ("vim", "vim", 50, 0.92, r"vim licen[cs]e"),
    ("curl", "curl", 50, 0.92, r"curl licen[cs]e"),
    ("ncsa", "illinois", 60, 0.96, r"university of illinois (?:ncsa )?open source licen[cs]e"),
    ("ncsa", "ncsa", 40, 0.88, r"ncsa licen[cs]e"),
    ("ms-pl", "microsoft public", 60, 0.96, r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", 60, 0.96, r"microsoft reciprocal licen[cs]e"),
    ("ms-pl", "ms pl", 35, 0.75, r"ms pl licen[cs]e"),
    ("postgresql", "postgresql", 50, 0.94, r"postgresql licen[cs]e"),
    ("openssl", "openssl", 50, 0.92, r"openssl licen[cs]e"),
    ("openldap", "openldap", 60, 0.94, r"openldap public licen[cs]e(?: v(?:ersion)? ?2(?: 8)?)?"),
    ("w3c", "w3c", 60, 0.94, r"w3c (?:software (?:notice )?and (?:document )?)?licen[cs]e"),
    ("bsl", "business source", 60, 0.96, r"business source licen[cs]e(?: v(?:ersion)? ?1(?: 1)?| 1 1)?"),
    ("sspl", "server side", 60, 0.96, r"server side public licen[cs]e(?: v(?:ersion)? ?1)?"),
    ("sspl", "sspl", 40, 0.88, r"sspl(?: ?v?1)?"),
    ("elastic", "elastic", 60, 0.94, r"elastic licen[cs]e(?: v(?:ersion)? ?[12](?: 0)?| 2 0)?"),
    ("polyform", "polyform", 60, 0.94, r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial) licen[cs]e"),
    ("commons-clause", "commons clause", 60, 0.94, r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("osl", "open software", 60, 0.95, r"open software licen[cs]e(?: v(?:ersion)? ?[123](?: [01])?)?"),
    ("afl", "academic free", 60, 0.95, r"academic free licen[cs]e(?: v(?:ersion)? ?[123](?: [01])?)?"),
    ("ecl", "educational", 60, 0.95, r"educational community licen[cs]e(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("upl", "universal permissive", 60, 0.95, r"universal permissive licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("cecill", "cecill", 40, 0.90, r"cecill(?: [abc])?(?: licen[cs]e)?(?: v(?:ersion)? ?[12](?: [01])?)?"),
    ("qpl", "q public", 60, 0.94, r"q public licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("sleepycat", "sleepycat", 50, 0.92, r"sleepycat licen[cs]e"),
    ("beerware", "beer", 50, 0.92, r"beer ?ware licen[cs]e(?: revision 42)?"),
    ("json", "json", 50, 0.88, r"json licen[cs]e"),
    ("ftl", "freetype", 50, 0.93, r"freetype (?:project )?licen[cs]e"),
    ("imagemagick", "imagemagick", 50, 0.92, r"imagemagick licen[cs]e"),
    ("lppl", "latex", 60, 0.95, r"latex project public licen[cs]e(?: v(?:ersion)? ?1(?: 3[abc]?)?)?"),
    ("unicode", "unicode", 50, 0.90, r"unicode(?: inc)? licen[cs]e(?: agreement)?"),
    ("icu", "icu", 50, 0.90, r"icu licen[cs]e"),
    ("naist", "naist", 50, 0.90, r"naist licen[cs]e"),
    ("intel", "intel", 50, 0.85, r"intel (?:simplified software|open source) licen[cs]e"),
    ("apsl", "apple public", 60, 0.95, r"apple public source licen[cs]e(?: v(?:ersion)? ?[12](?: [01])?)?"),
    ("sgi", "sgi", 60, 0.93, r"sgi free software licen[cs]e b?(?: ?v(?:ersion)? ?[12](?: [01])?)?"),
    ("sun", "sun", 60, 0.90, r"sun (?:industry standards source|public|community source) licen[cs]e"),
    ("oracle", "oracle", 60, 0.88, r"oracle (?:binary code|free use|technology network) (?:terms and conditions )?licen[cs]e(?: agreement)?"),
    ("zpl", "zope", 60, 0.95, r"zope public licen[cs]e(?: v(?:ersion)? ?[12](?: [01])?)?"),
    ("rpl", "reciprocal public", 60, 0.95, r"reciprocal public licen[cs]e(?: v(?:ersion)? ?1(?: [1-5])?)?"),
    ("rail", "rail", 60, 0.93, r"(?:creativeml |bigscience )?(?:open )?rail(?: m)? licen[cs]e"),
    ("rail", "responsible ai", 60, 0.93, r"responsible ai licen[cs]e"),
    ("fal", "free art", 60, 0.94, r"free art licen[cs]e(?: v(?:ersion)? ?1(?: [0-3])?| 1 3)?"),
    ("blueoak", "blue oak", 60, 0.94, r"blue oak model licen[cs]e(?: v(?:ersion)? ?1(?: 0 0)?)?"),
    ("mulan", "mulan", 60, 0.94, r"mulan (?:psl|permissive software licen[cs]e|public licen[cs]e)(?: v(?:ersion)? ?[12])?"),
    ("hippocratic", "hippocratic", 50, 0.92, r"hippocratic licen[cs]e"),
    ("parity", "parity", 60, 0.90, r"parity public licen[cs]e"),
]

# Creative Commons marks and names.
COMMONS = [
    ("cc0", "cc0", 50, 0.95, r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0", "cc zero", 45, 0.90, r"cc zero"),
    ("cc0", "cc 0", 40, 0.85, r"cc 0(?: 1 0)?"),
    ("cc0", "commons zero", 60, 0.96, r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc-by", "cc by", 30, 0.85, r"cc by"),
    ("cc-by", "cc by", 40, 0.93, r"cc by [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-sa", "cc by sa", 50, 0.93, r"cc by sa(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nd", "cc by nd", 50, 0.93, r"cc by nd(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", "cc by nc", 50, 0.93, r"cc by nc(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-sa", "cc by nc sa", 55, 0.94, r"cc by nc sa(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-nd", "cc by nc nd", 55, 0.94, r"cc by nc nd(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc", "creative commons", 30, 0.75, r"creative commons(?: licen[cs]e)?"),
    ("cc-by", "commons attribution", 45, 0.92, r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-sa", "commons attribution", 55, 0.94, r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nd", "commons attribution", 55, 0.94, r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc", "commons attribution", 55, 0.94, r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "commons attribution", 62, 0.95, r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "commons attribution", 62, 0.95, r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by", "creativecommons", 50, 0.95, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 60, 0.96, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 60, 0.96, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 60, 0.96, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 65, 0.97, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 65, 0.97, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", 60, 0.96, r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", 60, 0.96, r"creativecommons org publicdomain mark 1 0"),
]

# SPDX identifiers after the tag, as words.
TAGGED = [
    ("gpl", r"gpl [123] 0(?: only| or later)?"),
    ("lgpl", r"lgpl [23] [01](?: only| or later)?"),
    ("agpl", r"agpl [13] 0(?: only| or later)?"),
    ("gfdl", r"gfdl 1 [123](?: only| or later)?"),
    ("apache", r"apache [12] [01]"),
    ("llvm-exception", r"apache 2 0 with llvm exception"),
    ("gpl-exception", r"gpl 2 0(?: only| or later)? with (?:linux syscall note|classpath exception 2 0|gcc exception 2 0)"),
    ("mit", r"mit"),
    ("mit-0", r"mit 0"),
    ("isc", r"isc"),
    ("0bsd", r"0bsd"),
    ("bsd-2-clause", r"bsd 2 clause(?: patent)?"),
    ("bsd-3-clause", r"bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", r"bsd 4 clause"),
    ("mpl", r"mpl [12] [01]"),
    ("epl", r"epl [12] 0"),
    ("cddl", r"cddl 1 [01]"),
    ("cpl", r"cpl 1 0"),
    ("artistic", r"artistic [12] 0"),
    ("boost", r"bsl 1 0"),
    ("bsl", r"busl 1 1"),
    ("zlib", r"zlib"),
    ("wtfpl", r"wtfpl"),
    ("unlicense", r"unlicense"),
    ("ofl", r"ofl 1 [01]"),
    ("eupl", r"eupl 1 [0-2]"),
    ("odbl", r"odbl 1 0"),
    ("psf", r"(?:psf|python) 2 0"),
    ("php", r"php 3 0?1?"),
    ("ncsa", r"ncsa"),
    ("ms-pl", r"ms pl"),
    ("ms-rl", r"ms rl"),
    ("postgresql", r"postgresql"),
    ("upl", r"upl 1 0"),
    ("afl", r"afl [123] [01]"),
    ("osl", r"osl [123] [01]"),
    ("cecill", r"cecill(?: [bc])?(?: [12] [01])?"),
    ("sspl", r"sspl 1 0"),
    ("elastic", r"elastic 2 0"),
    ("cc0", r"cc0 1 0"),
    ("cc-by", r"cc by [1-4] [05]"),
    ("cc-by-sa", r"cc by sa [1-4] [05]"),
    ("cc-by-nc", r"cc by nc [1-4] [05]"),
    ("cc-by-nd", r"cc by nd [1-4] [05]"),
    ("cc-by-nc-sa", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", r"cc by nc nd [1-4] [05]"),
    ("proprietary", r"licenseref [^ ]+"),
    ("none", r"(?:none|noassertion)"),
]

# Phrases that grant under a named licence.
GRANTS = [
    ("gpl", "gpl", 60, 0.95, r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: ?v(?:ersion)? ?[123](?: 0)?)?"),
    ("gpl", "gnu", 65, 0.98, r"under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?"),
    ("gpl", "gnu", 65, 0.97, r"received a copy of the gnu general public licen[cs]e"),
    ("gpl", "gnu", 65, 0.97, r"see the gnu general public licen[cs]e for more details"),
    ("gpl", "gnu", 60, 0.95, r"covered by the gnu general public licen[cs]e"),
    ("lgpl", "lesser", 65, 0.98, r"under the terms of the gnu lesser general public licen[cs]e(?: as published by the free software foundation)?"),
    ("lgpl", "lesser", 65, 0.97, r"see the gnu lesser general public licen[cs]e for more details"),
    ("lgpl", "library general", 65, 0.97, r"under the terms of the gnu library general public licen[cs]e"),
    ("agpl", "affero", 65, 0.98, r"under the terms of the gnu affero general public licen[cs]e(?: as published by the free software foundation)?"),
    ("gfdl", "documentation", 65, 0.98, r"under the terms of the gnu free documentation licen[cs]e"),
    ("gpl", "free software", 45, 0.75, r"free software you can redistribute it and or modify it"),
    ("gpl", "version 2", 50, 0.80, r"either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl", "version 3", 50, 0.80, r"either version 3 of the licen[cs]e or at your option any later version"),
    ("apache", "apache", 65, 0.98, r"licen[cs]ed under the apache(?: software)? licen[cs]e(?: v(?:ersion)? ?[12](?: [01])?)?"),
    ("apache", "apache", 65, 0.97, r"apache org licenses license 2 0"),
    ("apache", "apache software foundation", 55, 0.90, r"licen[cs]ed to the apache software foundation"),
    ("apache", "compliance", 45, 0.70, r"use this file except in compliance with the licen[cs]e"),
    ("mit", "mit", 65, 0.97, r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?"),
    ("mit", "opensource", 60, 0.95, r"opensource org licenses mit"),
    ("bsd", "bsd", 60, 0.94, r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:new |modified |simplified |revised )?bsd(?: licen[cs]e)?"),
    ("bsd", "opensource", 60, 0.93, r"opensource org licenses bsd(?: [23] clause| licen[cs]e)?"),
    ("mpl", "mozilla", 65, 0.98, r"subject to the terms of the mozilla public licen[cs]e(?: v(?:ersion)? ?[12](?: [01])?)?"),
    ("mpl", "mozilla", 60, 0.95, r"mozilla org mpl [12] 0"),
    ("epl", "eclipse", 65, 0.97, r"under the terms of the eclipse public licen[cs]e(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("cddl", "common development", 65, 0.97, r"subject to the terms of the common development and distribution licen[cs]e"),
    ("boost", "boost", 65, 0.98, r"distributed under the boost software licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("boost", "boost org", 60, 0.95, r"boost org license 1 0"),
    ("cc", "commons", 45, 0.88, r"(?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?creative commons"),
    ("cc-by", "cc by", 50, 0.92, r"(?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?cc by"),
    ("dual", "dual", 50, 0.85, r"dual licen[cs]ed(?: under)?"),
    ("dual", "tri", 50, 0.85, r"tri licen[cs]ed(?: under)?"),
    ("dual", "either licen", 45, 0.75, r"under the terms of either licen[cs]e"),
]

# Openings and clauses of licence texts.
TEXTS = [
    ("mit", "permission", 70, 0.97, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "permission", 55, 0.90, r"above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "provided as is", 45, 0.70, r"software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission", 70, 0.97, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission", 60, 0.90, r"permission to use copy modify and(?: or)? distribute this software"),
    ("bsd", "redistribution", 70, 0.97, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 60, 0.92, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 60, 0.92, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", 62, 0.92, r"endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", 64, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "altered", 62, 0.93, r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", 62, 0.93, r"origin of this software must not be misrepresented"),
    ("boost", "obtaining a copy", 62, 0.93, r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered", 70, 0.97, r"free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 65, 0.96, r"do what the fuck you want to(?: public licen[cs]e)?"),
    ("beerware", "beer", 62, 0.92, r"buy me a beer in return"),
    ("gpl", "copyleft", 45, 0.75, r"gnu general public licen[cs]e is a free copyleft licen[cs]e"),
    ("gpl", "verbatim", 60, 0.90, r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("gpl", "freedom", 60, 0.90, r"licen[cs]es for most software (?:and other practical works )?are designed to take away your freedom"),
    ("lgpl", "combined work", 55, 0.85, r"convey a combined work under terms of your choice"),
    ("agpl", "interacting", 60, 0.90, r"users interacting with it remotely through a computer network"),
    ("apache", "perpetual", 60, 0.88, r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("mpl", "covered software", 55, 0.85, r"distribution of covered software"),
    ("epl", "contributor", 50, 0.75, r"contributor hereby grants recipient a non exclusive worldwide royalty free (?:copyright|patent) licen[cs]e"),
    ("ofl", "font software", 60, 0.92, r"font software may not be sold by itself"),
    ("ofl", "font software", 60, 0.92, r"neither the font software nor any of its individual components"),
    ("psf", "psf", 60, 0.92, r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("ncsa", "deal with", 60, 0.92, r"deal with the software without restriction"),
    ("cc", "licensed rights", 45, 0.80, r"exercising the licensed rights you accept and agree"),
    ("cc0", "waives", 60, 0.93, r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("odbl", "derivative database", 45, 0.75, r"recipients of the derivative database"),
    ("json", "evil", 62, 0.95, r"software shall be used for good not evil"),
]

# Notices that name no licence.
NOTICES = [
    ("all-rights-reserved", "reserved", 55, 0.90, r"copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,4}all rights reserved"),
    ("all-rights-reserved", "reserved", 50, 0.88, r"all rights reserved"),
    ("all-rights-reserved", "reserved", 25, 0.60, r"rights reserved"),
    ("some-rights-reserved", "reserved", 50, 0.80, r"some rights reserved"),
    ("copyright", "copyright", 20, 0.50, r"copyright (?:c )?[0-9]{4}"),
    ("copyright", "copyright", 15, 0.40, r"copyright c"),
    ("copyright", "copyright", 45, 0.75, r"copyright holders?(?: and contributors)?"),
    ("public-domain", "domain", 55, 0.85, r"(?:released|dedicated|placed|published) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 25, 0.60, r"public domain"),
    ("proprietary", "proprietary", 55, 0.85, r"confidential and proprietary"),
    ("proprietary", "proprietary", 55, 0.85, r"proprietary and confidential"),
    ("proprietary", "proprietary", 50, 0.80, r"proprietary licen[cs]e"),
    ("proprietary", "end user", 50, 0.80, r"end user licen[cs]e agreement"),
    ("proprietary", "eula", 30, 0.60, r"eula"),
    ("proprietary", "commercial licen", 50, 0.78, r"commercial licen[cs]e(?: agreement)?"),
    ("proprietary", "unauthorized", 50, 0.80, r"unauthorized (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? (?:of this (?:file|software|material) )?is (?:strictly )?prohibited"),
    ("proprietary", "permission", 50, 0.78, r"(?:without|unless) (?:the )?(?:prior |express )?written permission"),
    ("proprietary", "trade secret", 50, 0.80, r"trade secrets? of"),
    ("noncommercial", "non commercial", 50, 0.78, r"non commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "noncommercial", 50, 0.78, r"noncommercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "personal", 50, 0.75, r"personal use only"),
    ("noncommercial", "academic", 50, 0.75, r"academic (?:use|purposes) only"),
    ("noncommercial", "research", 50, 0.75, r"research (?:use|purposes) only"),
    ("noncommercial", "evaluation", 50, 0.75, r"evaluation (?:use|purposes) only"),
    ("freeware", "freeware", 30, 0.60, r"freeware"),
    ("shareware", "shareware", 30, 0.60, r"shareware"),
    ("open-source", "open source licen", 30, 0.60, r"open source licen[cs]e"),
    ("licence-file", "licen", 35, 0.65, r"see (?:the )?(?:accompanying )?licen[cs]e (?:file |txt |md )?for (?:details|more information)"),
    ("licence-file", "licen", 35, 0.65, r"found in the licen[cs]e file"),
]


def rules() -> list[tuple[str, str, int, float, str]]:
    """All rules in order."""
    tagged = [(label, "identifier", 80, 0.99, rf"spdx licen[cs]e identifier {name}") for label, name in TAGGED]
    return tagged + TEXTS + GRANTS + COMMONS + NAMES + NOTICES


# ---------------------------------------------------------------- what a regex allows


def _parsed(regex: str) -> list[list[tuple[object, int, int]]]:
    """Alternatives of a regex, each a list of (item, least, most): an item is a character class (a set,
    None for any character but a blank) or a list of alternatives."""
    at = 0

    def alternatives() -> list:
        nonlocal at
        found, row = [], []
        while at < len(regex) and regex[at] != ")":
            c = regex[at]
            if c == "|":
                found.append(row)
                row, at = [], at + 1
                continue
            if regex.startswith("(?:", at):
                at += 3
                item: object = alternatives()
                at += 1
            elif c == "[":
                end = regex.index("]", at)
                said = regex[at + 1 : end]
                ranges = re.findall(r"(.)-(.)|(.)", said)
                item = None if said.startswith("^") else {chr(k) for a, b, one in ranges for k in range(ord(a or one), ord(b or one) + 1)}
                at = end + 1
            else:
                item, at = {c}, at + 1
            least = most = 1
            if at < len(regex) and regex[at] == "?":
                least, at = 0, at + 1
            elif at < len(regex) and regex[at] == "+":
                most, at = 99, at + 1
            elif at < len(regex) and regex[at] == "{":
                numbers = regex[at + 1 : regex.index("}", at)].split(",")
                least, most = int(numbers[0]), int(numbers[-1])
                at = regex.index("}", at) + 1
            row.append((item, least, most))
        return [*found, row]

    return alternatives()


@cache
def longest(regex: str) -> int:
    """Most words of a match."""

    def blanks(alternatives: list) -> int:
        of = lambda item: blanks(item) if isinstance(item, list) else int(item is not None and " " in item)
        return max(sum(most * of(item) for item, _, most in row) for row in alternatives)

    return blanks(_parsed(regex)) + 1


@cache
def openings(regex: str) -> frozenset[str] | None:
    """All first words that a match can have; None if they are not finitely many."""

    def grown(starts: set[str], row: list) -> set[str]:
        """The starts with what row may add, up to a blank."""
        for item, least, most in row:
            done = {s for s in starts if s.endswith(" ")}
            layers = [starts - done]
            for _ in range(most):
                if not layers[-1]:
                    break
                if isinstance(item, list):
                    new = set().union(*[grown(layers[-1], other) for other in item])
                elif item is None:
                    raise ValueError
                else:
                    new = {s + c for s in layers[-1] for c in item}
                done |= {s for s in new if s.endswith(" ")}
                layers.append({s for s in new if not s.endswith(" ")})
            starts = done.union(*layers[least:])
        return starts

    return frozenset(s.strip() for row in _parsed(regex) for s in grown({""}, row))


@cache
def required(regex: str) -> tuple[str, ...]:
    """Literal strings that every match has: runs outside groups that may be absent or differ."""
    runs, alternatives = [""], _parsed(regex)
    if len(alternatives) > 1:
        return ()
    for item, least, most in alternatives[0]:
        if least == most == 1 and isinstance(item, set) and len(item) == 1:
            runs[-1] += next(iter(item))
        else:
            runs.append("")
    return tuple(r for r in runs if r)
