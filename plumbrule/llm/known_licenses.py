"""Known licence texts and one-line notices, under their SPDX names.

Long texts lie in ``license_texts`` (copied from the GNU, Apache, Mozilla and Creative Commons originals) and are
read by the driver. A text is known as it is wrapped there and with a paragraph per line, because a line that a wrap
begins with "copyright" does not count in the canonical form. Notices are wordings times names.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

Entries = tuple[tuple[str, str], ...]

_HOLDER = "Copyright (c) <year> <owner>\n\n"
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{0[0]}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{0[1]}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_ENDORSE = """
{0[2]}Neither the name of {1} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {2} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Headings that a short text may stand under.
_HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"), "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
}


def paragraphs(text: str) -> str:
    """The text with each paragraph on one line."""
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def _bodies(short: Entries) -> Iterator[tuple[str, str]]:
    for name, text in short:
        yield name, text.split("\n\n", 1)[1]
    for marks in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        for owner in ("HOLDER", "OWNER", "HOLDERS"):
            yield "BSD-2-Clause", _HOLDER + (_CONDITIONS + _DISCLAIMER).format(marks, "", owner)
            for whose in ("the copyright holder", "the copyright holders", "the copyright owner", "the author", "the <organization>"):
                yield "BSD-3-Clause", _HOLDER + (_CONDITIONS + _ENDORSE + _DISCLAIMER).format(marks, whose, owner)
    yield from (("0BSD", _HOLDER + ZERO_BSD), ("Zlib", _HOLDER + ZLIB), ("BSL-1.0", BOOST))


def texts(short: Entries) -> Entries:
    """(name, text) of all known texts; ``short`` has texts under a heading of their own."""
    out = dict.fromkeys(short)
    for name, body in _bodies(short):
        for form in (body, paragraphs(body)):
            out |= dict.fromkeys([(name, form), *[(name, f"{h}\n\n{form}") for h in _HEADINGS.get(name, ())]])
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out |= dict.fromkeys([(path.stem, text), (path.stem, paragraphs(text))])
    return tuple(out)


# Names of licences in notices.
_NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD license"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL 3.0", "AGPL-3.0"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later", "AGPLv3+", "AGPL-3.0+"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2.0 license", "Apache 2 license", "Apache Software License 2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 license",
                "CC0 1.0 Universal license"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, version 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0"),
    "GFDL-1.3-only": ("GNU Free Documentation License, version 1.3",), "GFDL-1.2-only": ("GNU Free Documentation License, version 1.2",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL 2.0", "GPL version 2",
                     "GPLv2 license"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GPLv2+", "GPLv2 or later", "GPL-2.0+"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL 3.0", "GPL version 3",
                     "GPLv3 license"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GPLv3+", "GPLv3 or later", "GPL-3.0+"),
    "ISC": ("ISC License", "ISC"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL 2.1"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later", "LGPLv2.1+", "LGPL-2.1+"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL 3.0"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later", "LGPLv3+", "LGPL-3.0+"),
    "MIT": ("MIT License", "MIT", "MIT/X11 License", "Expat License"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, v. 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense", "Unlicense license"), "Zlib": ("zlib License", "zlib/libpng License"),
}
_CREATIVE = {
    "BY": ("Attribution",), "BY-SA": ("Attribution-ShareAlike", "Attribution-Share Alike"),
    "BY-NC": ("Attribution-NonCommercial", "Attribution-Non-Commercial"), "BY-ND": ("Attribution-NoDerivatives", "Attribution-NoDerivs"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-Share Alike"),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"),
}
_WORDINGS = tuple(
    f"{subject} under {article}" for subject in (
        "Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed", "This software is licensed")
    for article in ("", "the ", "a "))
_LABELS = ("License: ", "SPDX-License-Identifier: ")


def _named() -> Iterator[tuple[str, str]]:
    for name, names in _NAMES.items():
        yield from ((name, n) for n in names)
    for code, words in _CREATIVE.items():
        for version, region in (("4.0", "International"), ("3.0", "Unported")):
            name = f"CC-{code}-{version}"
            for start in (f"CC {code} {version}", *[f"Creative Commons {w} {version}" for w in words]):
                yield from ((name, f"{start}{end}") for end in ("", " license", f" {region}", f" {region} license"))


def notices(own: Entries) -> Entries:
    """``own`` and all wordings of the names that call themselves a licence."""
    out = dict.fromkeys(own)
    for name, said in _named():
        for start in (*_WORDINGS, *_LABELS):
            article = start.endswith(" a ")
            if "licen" in f"{start}{said}".lower() and (not article or said.lower().endswith("license")):
                out[(name, f"{start}{said}")] = None
        out[(name, f"SPDX-License-Identifier: {name}")] = None
    return tuple(out)
