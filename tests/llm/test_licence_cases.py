"""Licences as they are worded in the wild: holders, SPDX expressions, comment ends, choices, titles."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from chronolake.llm import licences  # noqa: E402

S = licences.SENTENCES
BSD = [S["bsd-grant"], "* " + S["bsd-source"], "* " + S["bsd-binary"]]
AS_IS = S["bsd-as-is"].replace(licences.HOLDER, "THE REGENTS AND CONTRIBUTORS")
GOOGLE = S["bsd-endorse"].replace(licences.HOLDER, "Google Inc.")
CASES = [
    ("\n".join([*BSD, "* " + GOOGLE, AS_IS]), ["BSD-3-Clause"]),
    ("\n".join([*BSD, "* " + S["bsd-endorse"].replace(licences.HOLDER, "the University of California, Berkeley"), AS_IS]), ["BSD-3-Clause"]),
    ("\n".join([*BSD, "3. " + S["bsd-endorse-3"].replace(licences.HOLDER, "J. R. Author"), AS_IS]), ["BSD-3-Clause"]),
    ("\n".join([*BSD, AS_IS]), ["BSD-2-Clause"]),
    ("\n".join([*BSD, "* Some other condition that nobody has seen before must be met as well.", AS_IS]), []),
    ("\n".join(BSD), []),
    ("// SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("// SPDX-License-Identifier: LGPL-2.1+\nint x;", ["LGPL-2.1-or-later"]),
    ("# SPDX-License-Identifier: GPL-2.0", ["GPL-2.0-only"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT OR Apache-2.0"]),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", ["GPL-2.0-only WITH Linux-syscall-note"]),
    ("/* SPDX-License-Identifier: MIT */ int x;", ["MIT"]),
    ("<!-- SPDX-License-Identifier: (mit or apache-2.0) AND BSD-3-Clause -->", ["(MIT OR Apache-2.0) AND BSD-3-Clause"]),
    ("SPDX-License-Identifier: Made-Up-1.0", []),
    ("SPDX-License-Identifier: MIT. More text", ["MIT"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license", ["Apache-2.0 OR MIT"]),
    ("This project is licensed under the MIT License and the Apache License 2.0.", ["MIT AND Apache-2.0"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright\n\n" + S["fsf-copying"] + "\n\nPreamble\n\n" + S["gpl-3-preamble"], ["GPL-3.0"]),
    ('This work is under a <a rel="license" href="http://creativecommons.org/licenses/by-sa/4.0/">licence</a>.', ["CC-BY-SA-4.0"]),
    ('See <a href="http://creativecommons.org/licenses/by-sa/4.0/">this</a>.', []),
    ("Licensed under the MIT License.", ["MIT"]),
    ("SPDX-License-Identifier:", []),
]


def test_cases(docs):
    got = {}
    for r in licences.scan(docs([t for t, _ in CASES])).collect():
        got.setdefault(r.doc_id, []).append(r.licence)
    assert [got.get(i, []) for i in range(len(CASES))] == [w for _, w in CASES]


def test_spans_are_the_bytes_of_the_notice(docs):
    text = "é // SPDX-License-Identifier: MIT OR GPL-2.0+ */ x\nLicensed under either of MIT or Zlib."
    got = {r.licence: text.encode()[r.begin : r.end].decode() for r in licences.scan(docs([text])).collect()}
    assert got == {"MIT OR GPL-2.0-or-later": "SPDX-License-Identifier: MIT OR GPL-2.0+", "MIT OR Zlib": "Licensed under either of MIT or Zlib"}


@pytest.mark.parametrize("text", ["(MIT", "MIT OR", "MIT AND (Zlib", "MIT WITH", "OR MIT", ""])
def test_broken_expressions(text):
    assert licences.spdx(text, licences._ids()) in (None, ("MIT", 3))
