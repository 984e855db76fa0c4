"""Licence headers and whole licence texts, read on the driver only.

``HEADERS`` are what sources carry above their code: the notice a licence asks
for, the whole text of a short licence, and the paragraph of it that names the
licence where blank lines part it. Whole texts of the longer licences lie
beside this file, one ``<licence>.txt`` each.
"""

from __future__ import annotations

import re
from importlib import resources

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: "
)
_MIT_ALL = (
    _MIT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _WARRANTY + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: "
)
_BSD_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_PROVIDED = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
)
_APACHE_ASF = (
    "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with "
    "this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version "
    "2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 "
)
_APACHE_END = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License."
)


def _gnu(kind: str, version: str, noun: str = "program", work: str = "program") -> tuple[str, str]:
    """The paragraph that names the licence, and the whole notice."""
    first = (
        f"This {noun} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    )
    rest = (
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details. You should have received a copy of "
        f"the GNU {kind} License along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    )
    return first, first + rest


def _headers() -> list[tuple[str, str]]:
    gnu = [
        ("GPL-2.0", "General Public", "2", "program"),
        ("GPL-3.0", "General Public", "3", "program"),
        ("AGPL-3.0", "Affero General Public", "3", "program"),
        ("LGPL-2.1", "Lesser General Public", "2.1", "library"),
        ("LGPL-3.0", "Lesser General Public", "3", "library"),
    ]
    return [
        ("Apache-2.0", _APACHE),
        ("Apache-2.0", _APACHE + _APACHE_END),
        ("Apache-2.0", _APACHE_ASF + _APACHE_END),
        ("MIT", _MIT),
        ("MIT", _MIT_ALL),
        ("BSD-2-Clause", _BSD + _BSD_2 + _BSD_END),
        ("BSD-3-Clause", _BSD + _BSD_2 + _BSD_3 + _BSD_END),
        ("BSD-3-Clause", _BSD_3),
        # sources often name the licence and point to its file
        ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
        ("ISC", _ISC + _ISC_PROVIDED),
        ("ISC", _ISC + _ISC_PROVIDED + _ISC_END),
        ("0BSD", _ISC + _ISC_END),
        *[(name, text) for name, kind, version, noun in gnu for text in _gnu(kind, version, noun, noun)],
        (
            "MPL-2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
            "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ),
    ]


HEADERS = _headers()


_REMOTE = """13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users
interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the
Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some
standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any
work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under
version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will
continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU
General Public License.
"""


def _affero(gpl: str) -> str:
    """The AGPL-3.0 from the GPL-3.0: other names, another section 13 (its
    preamble, which differs too, is left as in the GPL)."""
    at, end = gpl.index("  13. Use with"), gpl.index("  14. Revised")
    named = [re.sub(r"(?i)(GNU\s+)(General\s+Public)", r"\1Affero \2", part) for part in (gpl[:at], gpl[end:])]
    return named[0] + _REMOTE + named[1]


def full_texts() -> list[tuple[str, str]]:
    """(licence, whole text) of the licences a licence file may hold."""
    files = [f for f in resources.files(__name__).iterdir() if f.name.endswith(".txt")]
    long = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files}
    long["AGPL-3.0"] = _affero(long["GPL-3.0"])
    return sorted(long.items()) + HEADERS
