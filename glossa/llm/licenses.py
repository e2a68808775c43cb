"""License scans: ordered signature rules over whole texts.

``rules()`` holds a few hundred regular expressions of five kinds, each with the keyword that any match contains, a priority and a
confidence: sentences that grant a licence (``GRANTS``), identifiers of the SPDX list behind their mark, addresses of licence
texts, names in several forms (``NAMES``, ``FORMS``), and the four ``BASE`` phrases. A text is first searched for the keywords by one
automaton; only rules whose keyword occurs are run. Overlapping detections are resolved in one sweep in order: a detection whose
interval lies within one of higher priority (or of equal priority and greater length, then earlier rule) is suppressed. The base
phrases are always reported.

A word is a run of 0-9, a-z (A-Z lower-cased) and characters above ASCII; positions count words from 0. Defined cases:
a null or empty text has no words and no detections; a very long text is scanned whole, in time that grows with its length and
its detections; of detections of one interval and priority the rule earlier in order stays; repeated rows are scanned each; an
empty table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lower_bytes, raw, result_schema, string_blocks, word_spans

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_EDGE, _END = rb"(?<![^\x00-\x2f\x3a-\x60\x7b-\x7f])", rb"(?![^\x00-\x2f\x3a-\x60\x7b-\x7f])"
_WORD = np.ones(256, dtype=bool)
_WORD[0:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False

# Licence names as people write them: label, keyword, regular expressions (words apart by any separators, written as a space).
NAMES = [
    ("agpl", "affero", r"gnu affero general public licen[cs]e", r"affero gpl", r"affero general public licen[cs]e"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e", r"lesser general public licen[cs]e", r"lesser gpl"),
    ("lgpl", "library general", r"gnu library general public licen[cs]e", r"library general public licen[cs]e", r"library general public terms"),
    ("gfdl", "free documentation", r"gnu free documentation licen[cs]e", r"free documentation licen[cs]e", r"gnu free documentation terms"),
    ("gpl", "general public", r"gnu general public licen[cs]e", r"general public licen[cs]e", r"gnu general public terms"),
    ("gpl", "gpl", r"gnu gpl", r"gplv?[123]", r"the gpl"),
    ("apache", "apache", r"apache licen[cs]e", r"apache software licen[cs]e", r"apache (?:2|v2|public terms)"),
    ("mit", "mit licen", r"mit licen[cs]e", r"the mit licen[cs]e", r"expat mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e", r"expat terms", r"the expat licen[cs]e"),
    ("mit-x11", "x11", r"x11 licen[cs]e", r"mit x11", r"x11 terms"),
    ("isc", "isc", r"isc licen[cs]e", r"internet systems consortium licen[cs]e isc", r"isc terms"),
    ("bsd", "bsd", r"bsd licen[cs]e", r"bsd style licen[cs]e", r"berkeley bsd licen[cs]e"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause", r"2 clause bsd", r"simplified bsd"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause", r"3 clause bsd", r"(?:new|modified|revised) bsd"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause", r"4 clause bsd", r"original bsd licen[cs]e"),
    ("0bsd", "bsd", r"0bsd", r"zero clause bsd", r"bsd zero clause"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mozilla licen[cs]e", r"mozilla mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"eclipse licen[cs]e", r"eclipse epl"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", r"eclipse distribution terms", r"eclipse edl"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"common development distribution licen[cs]e", r"common development and distribution terms"),
    ("cpl", "common public", r"common public licen[cs]e", r"ibm common public licen[cs]e", r"common public licen[cs]e cpl"),
    ("ibm-public", "ibm public", r"ibm public licen[cs]e", r"ibm public licen[cs]e terms", r"ibm public terms"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"perl artistic licen[cs]e", r"clarified artistic licen[cs]e"),
    ("perl", "perl", r"same terms as perl itself", r"perl licen[cs]e", r"licen[cs]ed like perl"),
    ("zlib", "zlib", r"zlib licen[cs]e", r"zlib libpng licen[cs]e", r"zlib terms"),
    ("libpng", "libpng", r"libpng licen[cs]e", r"png reference library licen[cs]e libpng", r"libpng terms"),
    ("boost", "boost", r"boost software licen[cs]e", r"boost licen[cs]e", r"boost software terms"),
    ("unlicense", "unlicen", r"the unlicen[cs]e", r"unlicen[cs]e", r"unlicen[cs]ed to the public"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl licen[cs]e", r"wtfpl version 2"),
    ("python", "python", r"python software foundation licen[cs]e", r"python licen[cs]e", r"psf python licen[cs]e"),
    ("php", "php", r"php licen[cs]e", r"php licen[cs]e version", r"php terms"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"same terms as ruby", r"ruby terms"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl and ssleay licen[cs]e", r"openssl terms"),
    ("sil-ofl", "open font", r"sil open font licen[cs]e", r"open font licen[cs]e", r"open font terms"),
    ("eupl", "european union public", r"european union public licen[cs]e", r"european union public terms", r"european union public licen[cs]e eupl"),
    ("cecill", "cecill", r"cecill licen[cs]e", r"cecill [abc]", r"licence cecill"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", r"universal permissive terms", r"oracle universal permissive"),
    ("odbl", "open database", r"open database licen[cs]e", r"odc open database licen[cs]e", r"open database terms"),
    ("odc-by", "open data commons", r"open data commons attribution", r"open data commons licen[cs]e", r"open data commons"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", r"odc public domain dedication", r"public domain dedication"),
    ("public-domain", "public domain", r"in the public domain", r"released into the public domain", r"public domain work"),
    ("cc0", "cc0", r"cc0", r"cc0 1 0 universal", r"creative commons cc0"),
    ("cc0", "creative commons zero", r"creative commons zero", r"creative commons zero licen[cs]e", r"creative commons zero waiver"),
    ("cc-by", "cc by", r"cc by", r"cc by (?:1|2|2 5|3|4) 0", r"creative commons cc by"),
    ("cc-by", "creative commons attribution", r"creative commons attribution", r"creative commons attribution licen[cs]e", r"creative commons attribution international"),
    ("cc-by-sa", "cc by sa", r"cc by sa", r"cc by sa (?:2|3|4) 0", r"creative commons cc by sa"),
    ("cc-by-sa", "attribution share", r"attribution share ?alike", r"creative commons attribution share ?alike", r"attribution share alike licen[cs]e"),
    ("cc-by-nc", "cc by nc", r"cc by nc", r"cc by nc (?:2|3|4) 0", r"creative commons cc by nc"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", r"cc by nc sa (?:2|3|4) 0", r"creative commons cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", r"cc by nc nd (?:2|3|4) 0", r"creative commons cc by nc nd"),
    ("cc-by-nd", "cc by nd", r"cc by nd", r"cc by nd (?:2|3|4) 0", r"creative commons cc by nd"),
    ("cc-nc", "attribution noncommercial", r"attribution noncommercial", r"creative commons attribution noncommercial", r"attribution noncommercial licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"microsoft public licen[cs]e ms pl", r"microsoft public terms"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"microsoft reciprocal terms", r"microsoft reciprocal licen[cs]e ms rl"),
    ("osl", "open software licen", r"open software licen[cs]e", r"open software licen[cs]e osl", r"the open software licen[cs]e"),
    ("afl", "academic free", r"academic free licen[cs]e", r"academic free terms", r"academic free licen[cs]e afl"),
    ("ncsa", "ncsa", r"ncsa licen[cs]e", r"university of illinois ncsa", r"ncsa open source licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql terms", r"the postgresql licen[cs]e"),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", r"reciprocal public terms", r"the reciprocal public licen[cs]e"),
    ("sspl", "server side public", r"server side public licen[cs]e", r"server side public terms", r"the server side public licen[cs]e"),
    ("bsl", "business source", r"business source licen[cs]e", r"business source terms", r"the business source licen[cs]e"),
    ("elastic", "elastic licen", r"elastic licen[cs]e", r"elastic licen[cs]e 2 0", r"the elastic licen[cs]e"),
    ("openrail", "openrail", r"openrail", r"openrail m", r"creativeml openrail m"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", r"copyright all rights reserved", r"all rights reserved worldwide"),
]

# Sentences by which texts grant a licence or declare it: label, keyword, regular expression.
GRANTS = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "hereby", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("ntp", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "apache", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache", "apache", r"licensed under the apache licen[cs]e version 2 0 the licen[cs]e"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e (?:version 2 )?as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e (?:version 3 )?as published by the free software foundation (?:either )?version 3"),
    ("lgpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "hope", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "received", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cpl", "accompanying", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "damages", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("sil-ofl", "font", r"this font software is licensed under the sil open font licen[cs]e"),
    ("artistic", "artistic", r"the terms of the artistic licen[cs]e"),
    ("perl", "perl", r"under the same terms as perl itself"),
    ("cc0", "waived", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighbou?ring rights"),
    ("cc-by", "creative", r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?licen[cs]e"),
    ("cc-by-sa", "sharealike", r"this work is licensed under (?:a|the) creative commons attribution sharealike"),
    ("cc-nc", "noncommercial", r"this work is licensed under (?:a|the) creative commons attribution noncommercial"),
    ("public-domain", "dedicated", r"(?:the author|this work) (?:has|is) dedicated (?:this work )?to the public domain"),
    ("public-domain", "domain", r"this file has been put into the public domain"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php", "php", r"this product includes php software freely available"),
    ("ncsa", "illinois", r"university of illinois open source licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql is released under the postgresql licen[cs]e"),
    ("all-rights-reserved", "proprietary", r"this (?:file|software|document) is proprietary and confidential"),
    ("all-rights-reserved", "unauthori", r"unauthori[sz]ed copying of this (?:file|software|document)"),
]

# Identifiers of the SPDX list, with the label each stands for.
SPDX = {
    "mit": "MIT MIT-0 MIT-CMU", "isc": "ISC", "0bsd": "0BSD", "bsd": "BSD-1-Clause BSD-Protection", "bsd-2-clause": "BSD-2-Clause BSD-2-Clause-Patent", "bsd-3-clause": "BSD-3-Clause BSD-3-Clause-Clear", "bsd-4-clause": "BSD-4-Clause",
    "apache": "Apache-1.0 Apache-1.1 Apache-2.0", "gpl": "GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later", "lgpl": "LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later",
    "agpl": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later", "gfdl": "GFDL-1.1 GFDL-1.2 GFDL-1.3", "mpl": "MPL-1.0 MPL-1.1 MPL-2.0", "epl": "EPL-1.0 EPL-2.0", "cddl": "CDDL-1.0 CDDL-1.1", "cpl": "CPL-1.0", "artistic": "Artistic-1.0 Artistic-2.0",
    "zlib": "Zlib", "boost": "BSL-1.0", "unlicense": "Unlicense", "wtfpl": "WTFPL", "python": "PSF-2.0 Python-2.0", "php": "PHP-3.0 PHP-3.01", "openssl": "OpenSSL", "sil-ofl": "OFL-1.0 OFL-1.1", "eupl": "EUPL-1.1 EUPL-1.2", "upl": "UPL-1.0",
    "odbl": "ODbL-1.0", "odc-by": "ODC-By-1.0", "pddl": "PDDL-1.0", "cc0": "CC0-1.0", "cc-by": "CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0", "cc-by-sa": "CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-3.0 CC-BY-NC-4.0",
    "cc-by-nc-sa": "CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0", "cc-by-nd": "CC-BY-ND-3.0 CC-BY-ND-4.0", "ms-pl": "MS-PL", "ms-rl": "MS-RL", "osl": "OSL-3.0", "afl": "AFL-3.0", "ncsa": "NCSA", "postgresql": "PostgreSQL",
    "rpl": "RPL-1.5", "sspl": "SSPL-1.0", "bsl": "BUSL-1.1", "elastic": "Elastic-2.0", "cecill": "CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C",
}

# Addresses of licence texts.
ADDRESSES = [
    ("apache", "apache.org/licenses/LICENSE-2.0"), ("apache", "apache.org/licenses/LICENSE-1.1"), ("apache", "opensource.org/licenses/Apache-2.0"), ("mit", "opensource.org/licenses/MIT"), ("mit", "opensource.org/licenses/mit-license"),
    ("mit", "mit-license.org"), ("isc", "opensource.org/licenses/ISC"), ("bsd-2-clause", "opensource.org/licenses/BSD-2-Clause"), ("bsd-3-clause", "opensource.org/licenses/BSD-3-Clause"), ("bsd", "opensource.org/licenses/bsd-license"),
    ("gpl", "gnu.org/licenses/gpl"), ("gpl", "gnu.org/copyleft/gpl"), ("gpl", "opensource.org/licenses/GPL-2.0"), ("gpl", "opensource.org/licenses/GPL-3.0"), ("lgpl", "gnu.org/licenses/lgpl"), ("lgpl", "gnu.org/copyleft/lesser"),
    ("lgpl", "opensource.org/licenses/LGPL-2.1"), ("agpl", "gnu.org/licenses/agpl"), ("gfdl", "gnu.org/licenses/fdl"), ("gfdl", "gnu.org/copyleft/fdl"), ("mpl", "mozilla.org/MPL"), ("mpl", "opensource.org/licenses/MPL-2.0"),
    ("epl", "eclipse.org/legal/epl"), ("edl", "eclipse.org/org/documents/edl"), ("boost", "boost.org/LICENSE"), ("unlicense", "unlicense.org"), ("wtfpl", "wtfpl.net"), ("zlib", "zlib.net/zlib_license"), ("sil-ofl", "scripts.sil.org/OFL"),
    ("cc-by", "creativecommons.org/licenses/by"), ("cc-by-sa", "creativecommons.org/licenses/by-sa"), ("cc-by-nc", "creativecommons.org/licenses/by-nc"), ("cc-by-nd", "creativecommons.org/licenses/by-nd"),
    ("cc-by-nc-sa", "creativecommons.org/licenses/by-nc-sa"), ("cc-by-nc-nd", "creativecommons.org/licenses/by-nc-nd"), ("cc0", "creativecommons.org/publicdomain/zero"), ("public-domain", "creativecommons.org/publicdomain/mark"),
    ("odbl", "opendatacommons.org/licenses/odbl"), ("odc-by", "opendatacommons.org/licenses/by"), ("pddl", "opendatacommons.org/licenses/pddl"), ("cddl", "opensource.org/licenses/CDDL-1.0"), ("eupl", "joinup.ec.europa.eu/software/page/eupl"),
    ("php", "php.net/license"), ("python", "python.org/psf/license"), ("artistic", "perlfoundation.org/artistic"), ("elastic", "elastic.co/licensing/elastic-license"), ("sspl", "mongodb.com/licensing/server-side-public-license"),
]

# Ways in which a text names a licence: prefix, suffix, priority, confidence.
FORMS = [
    ("", "", 10, 0.6),
    (r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?", "", 30, 0.95),
    ("", r" (?:version|v) ?[0-9]+(?: [0-9]+)?", 20, 0.85),
]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float
    base: bool = False


def _compile(pattern: str) -> re.Pattern[bytes]:
    """``pattern`` between word borders; each space outside brackets stands for one or more separators."""
    out = re.sub(rb"(?<!\\) (?!\?)", lambda _: _GAP, pattern.encode()).replace(b" ?", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]*")
    return re.compile(_EDGE + b"(?:" + out + b")" + _END)


def _plain(name: str) -> str:
    """The words of an identifier or address."""
    return " ".join(re.findall(r"[0-9a-z]+", name.lower()))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: the base phrases, grants, identifiers and addresses, then every name in every form."""
    out = [Rule(f"base:{label}", label, phrase.split()[-1] if label != "cc-by" else "cc", _compile(phrase), 100, 0.9, True) for phrase, label in BASE.items()]
    out += [Rule(f"grant:{label}:{i}", label, keyword, _compile(pattern), 50, 0.97) for i, (label, keyword, pattern) in enumerate(GRANTS)]
    for label, names in SPDX.items():
        for name in names.split():
            out.append(Rule(f"spdx:{name}", label, "spdx", _compile(r"spdx licen[cs]e identifier " + _plain(name)), 40, 0.99))
    out += [Rule(f"address:{address}", label, _plain(address).split()[0], _compile(_plain(address)), 35, 0.9) for label, address in ADDRESSES]
    for label, keyword, *names in NAMES:
        for i, name in enumerate(names):
            for j, (before, after, priority, confidence) in enumerate(FORMS):
                out.append(Rule(f"{label}:{keyword}:{i}{j}", label, keyword.split()[0], _compile(before + name + after), priority, confidence))
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for keyword in sorted({r.keyword for r in rules()}):
        found.add_word(keyword, keyword)
    found.make_automaton()
    return found


# Every rule's match contains one of these; searching for them is cheaper than the automaton. The test suite holds each rule against the gate.
_GATE = re.compile(b"|".join([b"licen", b"gpl", b"general public", rb"cc" + _GAP + b"by", b"cc0", b"bsd", b"creative" + _GAP + b"commons", b"attribution", b"rights" + _GAP + b"reserved", b"spdx", b"public" + _GAP, b"openrail", b"terms", b"wtfpl", b"affero", b"x11", b"mpl", b"epl", b"edl", b"apache", b"cecill", b"open" + _GAP + b"data", b"illinois", b"permission", b"redistribut", b"warranty", b"copyright", b"misrepresented", b"damages", b"unencumbered", b"invariant", b"font" + _GAP + b"software", b"advertising", b"compile" + _GAP + b"sell", b"acknowledg", b"endorse", b"what" + _GAP + b"the", b"perl", b"scripts" + _GAP + b"sil", b"publicdomain", b"php", b"proprietary", b"unauthori", b"noninfringement", b"openssl", b"artistic", b"joinup", b"python", b"copyleft", b"universal" + _GAP + b"permissive"]))


@dataclass(frozen=True)
class Detection:
    rule: Rule
    start: int
    end: int


def scan(lowered: bytes) -> list[Detection]:
    """Detections in a text whose A-Z are lower-cased: by byte span, suppressed ones left out, in text order."""
    if not _GATE.search(lowered):
        return []
    present = {k for _, k in _automaton().iter(lowered.decode("latin-1"))}
    found = [Detection(r, m.start(), m.end()) for r in rules() if r.keyword in present for m in r.pattern.finditer(lowered)]
    # Detections that may contain others come first: by start, then the longest, then the highest priority.
    found.sort(key=lambda d: (d.start, -d.end, -d.rule.priority))
    kept: list[Detection] = []
    reach: dict[int, int] = {}  # for each priority how far its detections so far, which all start before, go
    for d in found:
        held = any(end >= d.end for p, end in reach.items() if p >= d.rule.priority)
        reach[d.rule.priority] = max(reach.get(d.rule.priority, 0), d.end)
        if d.rule.base or not held:
            kept.append(d)
    return kept


_DDL = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row, lowered bytes and the byte offsets of the words of each text."""
    for a, _, arr in string_blocks(batch, "_text"):
        data, offsets = raw(arr)
        data = lower_bytes(data)
        starts, _ = word_spans(_WORD[data], offsets)
        cut = np.searchsorted(starts, offsets)
        whole = data.tobytes()
        for i in range(len(offsets) - 1):
            yield a + i, whole[offsets[i] : offsets[i + 1]], starts[cut[i] : cut[i + 1]] - offsets[i]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per detection: ``id_col``, rule, label, base, priority, confidence, first_word, last_word (of the span)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = ["rule", "label", "base", "priority", "confidence", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row, text, starts in _blocks(batch):
                for d in scan(text):
                    at.append(row)
                    out.append((d.rule.name, d.rule.label, d.rule.base, d.rule.priority, d.rule.confidence, int(np.searchsorted(starts, d.start, "right")) - 1, int(np.searchsorted(starts, d.end, "left")) - 1))
            types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), *cols], names=["_id", *names])

    added = "rule string, label string, base boolean, priority int, confidence double, first_word long, last_word long"
    schema = result_schema(base.select("_id").schema, added)
    return base.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    ``score`` is 1 minus the product of the doubts (1 - confidence) of the best detection of each label.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_detections": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text, starts in _blocks(batch):
                found = scan(text)
                words = [int(np.searchsorted(starts, d.start)) for d in found if d.rule.base]
                best: dict[str, float] = {}
                for d in found:
                    best[d.rule.label] = max(best.get(d.rule.label, 0.0), d.rule.confidence)
                doubt = 1.0
                for label in sorted(best):
                    doubt *= 1 - best[label]
                out.append((len(starts), len(words), min(words, default=None), max(words, default=None), ",".join(sorted({d.rule.label for d in found if d.rule.base})), ",".join(sorted(best)), round(1 - doubt, 6), len(found)))
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *cols], names=["_id", *kinds])

    schema = result_schema(base.select("_id").schema, ", ".join(f"{k} {_DDL[t]}" for k, t in kinds.items()))
    return base.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
