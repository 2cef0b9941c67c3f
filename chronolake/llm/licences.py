"""Licence scans by sentence rules."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, batch, pieces, table, words

#: Bytes of other text that may lie between two sentences of one licence; where that text could be a condition, only a number or mark.
GAP, MARK = 2000, 12
#: What stands for a holder's name in a sentence, and its words at most.
HOLDER, HOLDER_WORDS = "<holder>", 24

# Licences and the names that notices give them.
NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution License", "MIT-0"),
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache Software License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0", "Apache Software License 2.0"),
    "BSD-1-Clause": ("BSD 1-Clause License", "BSD-1-Clause"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "2-Clause BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "3-Clause BSD License", "Revised BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "BSD-4-Clause", "Original BSD License"),
    "0BSD": ("BSD Zero Clause License", "0BSD", "Zero-Clause BSD License"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"),
    "MPL-1.1": ("Mozilla Public License 1.1", "MPL 1.1", "Mozilla Public License, Version 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "EPL 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "EPL 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0", "Common Development and Distribution License, Version 1.0"),
    "CDDL-1.1": ("Common Development and Distribution License 1.1", "CDDL 1.1"),
    "CPL-1.0": ("Common Public License 1.0", "CPL 1.0", "Common Public License Version 1.0"),
    "EUPL-1.1": ("European Union Public Licence 1.1", "EUPL 1.1", "European Union Public License 1.1"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2", "European Union Public License 1.2", "EUPL v1.2"),
    "Artistic-1.0": ("Artistic License 1.0", "Artistic-1.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL 1.1"),
    "PostgreSQL": ("PostgreSQL License", "PostgreSQL"),
    "Python-2.0": ("Python License 2.0", "Python-2.0"),
    "PSF-2.0": ("Python Software Foundation License", "Python Software Foundation License Version 2", "PSF-2.0"),
    "X11": ("X11 License", "X11"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "NCSA"),
    "MS-PL": ("Microsoft Public License", "MS-PL"),
    "MS-RL": ("Microsoft Reciprocal License", "MS-RL"),
    "ECL-2.0": ("Educational Community License, Version 2.0", "ECL 2.0", "Educational Community License 2.0"),
    "AFL-3.0": ("Academic Free License 3.0", "AFL 3.0", "Academic Free License version 3.0"),
    "OSL-3.0": ("Open Software License 3.0", "OSL 3.0", "Open Software License version 3.0"),
    "Vim": ("Vim License", "Vim"),
    "PHP-3.01": ("PHP License 3.01", "PHP License, version 3.01"),
    "Ruby": ("Ruby License",),
    "OpenSSL": ("OpenSSL License", "OpenSSL"),
    "QPL-1.0": ("Q Public License 1.0", "QPL 1.0"),
    "UPL-1.0": ("Universal Permissive License v 1.0", "UPL 1.0"),
    "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0", "BlueOak-1.0.0"),
    "MulanPSL-2.0": ("Mulan Permissive Software License, Version 2", "Mulan PSL v2"),
    "CECILL-2.1": ("CeCILL 2.1", "CeCILL License 2.1"),
    "ODbL-1.0": ("Open Database License 1.0", "ODbL 1.0", "Open Data Commons Open Database License v1.0"),
    "ODC-By-1.0": ("Open Data Commons Attribution License v1.0", "ODC-By 1.0"),
    "PDDL-1.0": ("Open Data Commons Public Domain Dedication and License 1.0", "PDDL 1.0"),
    "BUSL-1.1": ("Business Source License 1.1", "BUSL 1.1"),
    "Elastic-2.0": ("Elastic License 2.0", "Elastic License v2"),
    "SSPL-1.0": ("Server Side Public License, v 1", "Server Side Public License, version 1", "SSPL 1.0"),
}
# How a notice says that a named licence holds; {} is the name, and the first word of each may follow "is" and the like.
OPENINGS = ("Licensed", "Released", "Distributed", "Published", "Available", "Made available", "Provided", "Dual licensed")
SUBJECTS = ("This project", "This work", "This software", "This file", "This program", "This library", "This package", "This code", "This repository", "This document", "The code", "The source code", "The text", "All content", "This content", "This dataset")
LINKS = ("under the", "under", "under the terms of the", "under the terms of", "under a", "subject to the")
# The GNU licences and the Creative Commons ones, by their parts.
GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
GNU_VERSIONS = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",)}
GNU_WORKS = ("program", "library", "software", "file", "package")
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

# Sentences of licences and of the notices that go with them.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-contributor": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "apache-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-copyright": "Grant of Copyright License.",
    "apache-patent": "Grant of Patent License.",
    "apache-redistribution": "Redistribution.",
    "apache-contributions": "Submission of Contributions.",
    "apache-trademarks": "Trademarks.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-1": "Neither the name of <holder> nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-2": "Neither the name of <holder> nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-3": "The name of <holder> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-4": "The names of <holder> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-5": "Neither the name of <holder> may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY <holder> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-1.1-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "epl-1-accompanying": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2-accompanying": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-named": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-waived": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "wtfpl-0": "You just DO WHAT THE FUCK YOU WANT TO.",
    "ofl-licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "gpl-1-title": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "lgpl-2-title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "fsf-copying": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "artistic-terms": "You may use, copy, modify and distribute this package under the terms of the Artistic License 2.0.",
}
# Which sentences, one after the other, make which licence. Longer rules are tried first.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-title",)),
    ("MIT-0", ("mit-0-grant", "mit-as-is", "mit-liability")),
    ("MIT-0", ("mit-0-grant",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy-s", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-contributor", "apache-asf", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-contributor", "apache-asf")),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-asf",)),
    ("Apache-2.0", ("apache-terms", "apache-copyright", "apache-patent", "apache-redistribution", "apache-contributions", "apache-trademarks")),
    ("Apache-2.0", ("apache-named",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), MARK),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source", "bsd-as-is"), MARK),
    ("GPL-1.0", ("gpl-1-title",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-3.0", ("gpl-3-title", "fsf-copying", "gpl-3-preamble")),
    ("LGPL-2.0", ("lgpl-2-title",)),
    ("LGPL-2.1", ("lgpl-2.1-title",)),
    ("LGPL-3.0", ("lgpl-3-title",)),
    ("AGPL-3.0", ("agpl-3-title",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-title", "apache-terms", "apache-copyright", "apache-patent", "apache-redistribution", "apache-contributions", "apache-trademarks")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy-s")),
    ("MPL-2.0", ("mpl-subject",)),
    ("MPL-1.1", ("mpl-1.1-subject",)),
    ("EPL-1.0", ("epl-1-accompanying",)),
    ("EPL-2.0", ("epl-2-accompanying",)),
    ("CDDL-1.0", ("cddl-subject",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-named",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("WTFPL", ("wtfpl-0",)),
    ("OFL-1.1", ("ofl-licensed",)),
    ("Artistic-2.0", ("artistic-terms",)),
]


def _names() -> dict[str, list[str]]:
    """NAMES and what follows from the parts of the GNU and Creative Commons licences."""
    out = {k: list(v) for k, v in NAMES.items()}
    for short, name in GNU.items():
        for version in GNU_VERSIONS[short]:
            v = version.removesuffix(".0")
            plain = [f"{gnu}{x}{sep}{n}" for gnu in ("GNU ", "") for x in (name, short) for sep in (" v", ", version ", " version ", " Version ", " ") for n in {v, version}]
            plain += [f"{short}v{v}", f"{short}-{version}", f"GNU {short}v{v}"]
            out[f"{short}-{version}-only"] = [*plain, *(f"{x} only" for x in plain)]
            out[f"{short}-{version}-or-later"] = [f"{x}{end}" for x in plain for end in (" or later", " or any later version", ", or (at your option) any later version")]
    for kind, name in CC.items():
        for version, port in CC_VERSIONS.items():
            out[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"Creative Commons {name} {version}", f"Creative Commons {name} {version} {port}", *(f"Creative Commons {name} {version}{x} License" for x in ("", f" {port}")), f"CC {kind} {version} license"]
    return out


def _default() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]], dict[str, list[str]]]:
    """All sentences, rules, and names by the identifier of the notice that says them."""
    sentences, rules = dict(SENTENCES), list(RULES)
    for endorse in (x for x in SENTENCES if x.startswith("bsd-endorse")):
        rules += [("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", endorse, *end)) for end in ((), ("bsd-as-is",))]
        rules.append(("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", endorse)))
    for work in GNU_WORKS:
        sentences[f"gnu-hope-{work}"] = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    sentences["gnu-implied"] = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    for short, name in GNU.items():
        sentences[f"gnu-see-{short}"] = f"See the GNU {name} for more details."
        for work in GNU_WORKS:
            for version in GNU_VERSIONS[short]:
                v = version.removesuffix(".0")
                free = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
                ends = {"or-later": (f"either version {v} of the License, or (at your option) any later version", f"version {v} or later"), "only": (f"version {v}", f"version {v} of the License")}
                for which, texts in ends.items():
                    for i, text in enumerate(texts):
                        key = f"gnu-free-{short}-{work}-{version}-{which}-{i}"
                        sentences[key] = f"{free}, {text}."
                        licence = f"{short}-{version}-{which}"
                        rules.append((licence, (key,)))
                        rules.append((licence, (key, f"gnu-hope-{work}", "gnu-implied", f"gnu-see-{short}")))
    names = _names()
    rules += [(licence, (f"named-{licence}",)) for licence in names]
    return sentences, rules, {f"named-{licence}": [licence, *own] for licence, own in names.items()}


#: How a sentence begins that goes on with the name of a licence and then ends.
NOTICES = ["License", "Licence", *(f"{o} {link}" for link in LINKS for o in (*OPENINGS, *(f"{w} is {o.lower()}" for w in SUBJECTS for o in OPENINGS)))]

_SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]{1,1000})", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*([A-Za-z0-9][A-Za-z0-9.\-]*\+?|[()])")
_LINK = re.compile(rb"""<a\b[^>]{0,300}\brel=["']?license\b[^>]{0,300}>|<link\b[^>]{0,300}\brel=["']?license\b[^>]{0,300}>""", re.IGNORECASE)
_CC_URL = re.compile(rb"creativecommons\.org/(?:licenses/(by(?:-nc)?(?:-sa|-nd)?)/(\d\.\d)|publicdomain/zero/(1\.0))", re.IGNORECASE)


def _ids() -> dict[str, str]:
    """SPDX identifiers by their lower-case form; the old ones without only and or-later as what they stand for."""
    out = {k.lower(): k for k in _names()}
    for short, versions in GNU_VERSIONS.items():
        for v in versions:
            out[f"{short}-{v}".lower()] = f"{short}-{v}-only"
            out[f"{short}-{v}+".lower()] = f"{short}-{v}-or-later"
    return out


def spdx(text: str, ids: dict[str, str]) -> tuple[str, int] | None:
    """The SPDX expression that ``text`` begins with, in standard spelling, and its length; none if a licence isn't known.

    Licences are joined by AND and OR, have an exception after WITH, and can stand in brackets; the expression ends before what
    doesn't go on with it, such as a comment's end."""
    at, out, open_ = 0, [], 0
    end, kept = 0, 0

    def token():
        m = _TOKEN.match(text, at)
        return (m[1], m.end()) if m else ("", at)

    while True:  # a licence, or a bracket before one
        word, to = token()
        if word == "(":
            out.append("(")
            open_, at = open_ + 1, to
            continue
        name = word.rstrip(".")
        plus = name.endswith("+") and name.lower() not in ids
        known = ids.get(name.rstrip("+").lower() if plus else name.lower()) or (name if name.startswith("LicenseRef-") else None)
        if not known:
            return None if not kept or open_ else (" ".join(out[:kept]).replace("( ", "(").replace(" )", ")"), end)
        out.append(known + "+" * plus)
        at = to - (len(word) - len(name))
        word, to = token() if len(name) == len(word) else ("", at)
        if word.upper() == "WITH":
            at = to
            word, to = token()
            if not word or word in "()":
                return None
            out += ["WITH", word.rstrip(".")]
            at = to - (len(word) - len(word.rstrip(".")))
            word, to = token()
        while word == ")" and open_:
            out.append(")")
            open_, at = open_ - 1, to
            word, to = token()
        if not open_:
            end, kept = at, len(out)
        if word.upper() not in ("AND", "OR"):
            return (" ".join(out[:kept]).replace("( ", "(").replace(" )", ")"), end) if kept else None
        out.append(word.upper())
        at = to


def _lines(data: bytes, ids: dict[str, str]):
    """(licence, begin, end) of SPDX lines, and of links to Creative Commons licences marked as such."""
    for m in _SPDX.finditer(data):
        text = m[1].decode(errors="replace")
        if found := spdx(text, ids):
            yield found[0], m.start(), m.start(1) + len(text[: found[1]].encode())
    for m in _LINK.finditer(data):
        if u := _CC_URL.search(m[0]):
            yield ("CC0-1.0" if u[3] else f"CC-{u[1].decode().upper()}-{u[2].decode()}"), m.start() + u.start(), m.start() + u.end()


_C = U64(0x9E3779B97F4A7C55)
_BACK = U64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_STOPS = np.isin(np.arange(256), list(b".!?;:"))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Known:
    """Sequences of words by their hashes, those of one length together."""

    def __init__(self, texts: list[str], ids: list[int]):
        h, _, _, first = next((words(data, at) for _, _, data, at in pieces(pa.array(texts, pa.large_string()), 1 << 40)), (np.zeros(0, U64),) * 4)
        found: dict[int, dict] = {}
        with np.errstate(over="ignore"):
            for k, own in enumerate(ids):
                x, p = U64(0), U64(1)
                for w in h[first[k] : first[k + 1]]:
                    x, p = x + w * p, p * _C
                found.setdefault(int(first[k + 1] - first[k]), {}).setdefault(int(x), own)
        self.by_length = {n: (np.array(sorted(m), U64), np.array([m[x] for x in sorted(m)], np.int64)) for n, m in sorted(found.items()) if n}
        self.begins = np.unique(h[first[:-1][np.diff(first) > 0]]) if texts else np.zeros(0, U64)

    def at(self, s: np.ndarray, row_end: np.ndarray, total: np.ndarray, back: np.ndarray, stop: np.ndarray | None):
        """(identifier, words) of the longest known sequence that begins at each of the words ``s`` and, given ``stop``, ends
        where a sentence does; -1 if there is none."""
        got, size = np.full(len(s), -1), np.zeros(len(s), np.int64)
        for n, (known, ids) in self.by_length.items():
            m = np.flatnonzero(s + n <= row_end)
            if stop is not None:
                m = m[stop[s[m] + n - 1]]
            x = (total[s[m] + n] - total[s[m]]) * back[s[m]]
            p = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[p] == x
            got[m[hit]], size[m[hit]] = ids[p[hit]], n
        return got, size


class Rules:
    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]], names: dict[str, list[str]]):
        place = {n: i for i, n in enumerate([*sentences, *names])}
        held = {n: x.split(HOLDER) for n, x in sentences.items() if HOLDER in x}
        self.whole = Known([x for n, x in sentences.items() if n not in held], [place[n] for n in sentences if n not in held])
        # sentences with a holder's name: of each beginning the possible ends
        heads = sorted({a for a, _ in held.values()})
        self.heads = Known(heads, list(range(len(heads))))
        self.ends = [Known([b for a, b in held.values() if a == x], [place[n] for n, (a, _) in held.items() if a == x]) for x in heads]
        self.joins = words(*next((data, at) for _, _, data, at in pieces(pa.array(["or and either of the"]))))[0]
        self.names = Known([x for own in names.values() for x in own], [place[n] for n, own in names.items() for _ in own])
        self.notices = Known(NOTICES if names else [], list(range(len(NOTICES) if names else 0)))
        self.begins = np.union1d(np.union1d(self.whole.begins, self.notices.begins), self.heads.begins)
        self.licence = {place[n]: own[0] for n, own in names.items()}
        # by their first identifier, the longest first
        self.rules: dict[int, list] = {}
        for licence, seq, *gap in sorted(rules, key=lambda r: -len(r[1])):
            self.rules.setdefault(place[seq[0]], []).append((licence, [place[x] for x in seq], *(gap or [None])))

    def sentences(self, data: np.ndarray, at: np.ndarray):
        """(row, identifier, first byte, end byte) of all known sentences, the longest at each place, in order. A sentence that
        gives notice of a named licence has the identifier of the name, whatever words the notice begins with."""
        h, start, end, first = words(data, at)
        if not len(h):
            return None
        blank_next = np.concatenate([_BLANK[data[1:]], [True]])
        cut = np.concatenate([[0], np.cumsum((_STOPS[data] & blank_next) | (data == 10))])
        last = np.zeros(len(h), bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        stop = last.copy()
        stop[:-1] |= cut[start[1:]] > cut[end[:-1]]
        opens = np.concatenate([[True], stop[:-1]])
        s = np.flatnonzero(opens)
        s = s[np.isin(h[s], self.begins)]
        if not len(s):
            return None
        row = np.searchsorted(first, s, "right") - 1
        row_end = first[row + 1]
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(h) - 1, _C)]))
            back = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(h) - 1, _BACK)]))
            total = np.concatenate([[U64(0)], np.cumsum(h * up, dtype=U64)])
            got, size = self.whole.at(s, row_end, total, back, stop)
            notice, n = self.notices.at(s, row_end, total, back, None)
            m = np.flatnonzero((notice >= 0) & (s + n < row_end))
            name, n_name = self.names.at(s[m] + n[m], row_end[m], total, back, stop)
            hit = (name >= 0) & (n[m] + n_name > size[m])
            got[m[hit]], size[m[hit]] = name[hit], (n[m] + n_name)[hit]
            self.choices = list(self._choices(h, s[m] + n[m], s[m], row[m], row_end[m], total, back, stop, start, end, at)) if len(m) else []
            head, n = self.heads.at(s, row_end, total, back, None)
            for which in np.unique(head[head >= 0]).tolist():
                for k in range(1, HOLDER_WORDS + 1):
                    m = np.flatnonzero((head == which) & (got < 0) & (s + n + k < row_end))
                    own, n_end = self.ends[which].at(s[m] + n[m] + k, row_end[m], total, back, stop)
                    hit = own >= 0
                    got[m[hit]], size[m[hit]] = own[hit], (n[m] + k + n_end)[hit]
        m = got >= 0
        s, got, size, row = s[m], got[m], size[m], row[m]
        return row, got, start[s] - at[row], end[s + size - 1] - at[row]


    def _choices(self, h, at_name, s, row, row_end, total, back, stop, start, end, at):
        """(row, licence, first byte, end byte) of notices that name two licences, joined by or and and."""
        either, of, the = self.joins[2], self.joins[3], self.joins[4]
        skip = lambda i, word, last: i + ((i < last) & (h[np.minimum(i, len(h) - 1)] == word))
        at_name = skip(skip(at_name, either, row_end), of, row_end)
        at_name = skip(at_name, the, row_end)
        a, n = self.names.at(at_name, row_end, total, back, None)
        m = np.flatnonzero((a >= 0) & (at_name + n + 1 < row_end))
        join = h[at_name[m] + n[m]] if len(m) else np.zeros(0, U64)
        m, join = m[np.isin(join, self.joins[:2])], join[np.isin(join, self.joins[:2])]
        second = skip(at_name[m] + n[m] + 1, the, row_end[m])
        b, n_b = self.names.at(second, row_end[m], total, back, stop)
        for k in np.flatnonzero(b >= 0).tolist():
            word = "OR" if join[k] == self.joins[0] else "AND"
            yield int(row[m[k]]), f"{self.licence[int(a[m[k]])]} {word} {self.licence[int(b[k])]}", int(start[s[m[k]]] - at[row[m[k]]]), int(end[second[k] + n_b[k] - 1] - at[row[m[k]]])


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, names: dict[str, list[str]] | None = None, gap: int = GAP) -> DataFrame:
    """(doc_id, licence, sentences, begin, end) of each licence in ``docs`` (doc_id, text), bytes [begin, end) of the text.

    A text's words (runs of letters, digits, _ and non-ASCII characters, A-Z folded) form sentences that start at a line's
    beginning or after one of . ! ? ; : and white space, and end likewise; line breaks inside one don't matter. Known
    sentences become identifiers: those of ``sentences`` by their words, and those of NOTICES followed by one of ``names`` by
    that name. A rule matches where its identifiers follow each other, with no more than ``gap`` bytes of unknown text between
    two, or than the rule itself allows. The longest rule wins at each place, and matches don't overlap. A sentence can have
    HOLDER in it, which stands for up to HOLDER_WORDS words of any kind. A notice of two names joined by or or and gives both, as
    "A OR B". With the known licences, SPDX lines are read as expressions, and so are links marked as a page's licence. Without ``sentences`` and ``rules`` the known licences are
    those of NAMES, GNU and CC. Whole texts are read, row by row: null and empty texts have none, equal rows give equal
    results, null doc_ids are kept, other columns and tables' emptiness are no matter."""
    sent = docs.sparkSession.sparkContext.broadcast(_default() if sentences is None else (sentences, rules or [], names or {}))
    made: list[Rules] = []
    ids_of = _ids() if sentences is None else {}

    def find(batches):
        if not made:
            made.append(Rules(*sent.value))
        r = made[0]
        for b in batches:
            rows, names, counts, begins, ends = [], [], [], [], []
            for i, _, data, at in pieces(b.column("text")):
                put = lambda *x: [own.append(v) for own, v in zip((rows, names, counts, begins, ends), x, strict=True)]
                if ids_of:
                    for k in range(len(at) - 1):
                        for licence, lo, hi in _lines(data[at[k] : at[k + 1]].tobytes(), ids_of):
                            put(i + k, licence, 1, lo, hi)
                r.choices = []
                got = r.sentences(data, at)
                for k, licence, lo, hi in r.choices:
                    put(i + k, licence, 1, lo, hi)
                if got is None:
                    continue
                row, ids, begin, end = (x.tolist() for x in got)
                k = 0
                while k < len(row):
                    for name, seq, own_gap in r.rules.get(ids[k], ()):
                        n = len(seq)
                        if ids[k : k + n] == seq and row[k : k + n] == [row[k]] * n and all(begin[j + 1] - end[j] <= (gap if own_gap is None else own_gap) for j in range(k, k + n - 1)):
                            rows.append(i + row[k])
                            names.append(name)
                            counts.append(n)
                            begins.append(begin[k])
                            ends.append(end[k + n - 1])
                            k += n - 1
                            break
                    k += 1
            if rows:
                yield batch(doc_id=b.column("doc_id").take(pa.array(rows)), licence=names, sentences=counts, begin=begins, end=ends)

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, licence string, sentences long, begin long, end long")


def op5_licences(spark, sf_dir: str) -> DataFrame:
    """Licences named or given in the documents."""
    return scan(table(spark, sf_dir, "documents"))
