"""Full texts of common licences: short ones as they are, long ones as digests (see ``licenses.py``)."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def _titled(name: str, text: str, *titles: str) -> list[tuple[str, str]]:
    return [(name, f"{title}\n\n{text}") for title in ("", *titles)]


def _bsd(name: str, text: str, title: str) -> list[tuple[str, str]]:
    heads = ("", "All rights reserved.", title, f"{title}\n\nAll rights reserved.")
    # Some copies number the clauses, others have asterisks.
    plain = text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    return [(name, f"{head}\n\n{body}") for head in heads for body in (text, plain)]


#: Fixed values: (license_id, text), a title or "All rights reserved" above it or not.
FULL = (
    *_titled("MIT", _MIT, "MIT License", "The MIT License", "The MIT License (MIT)"),
    *_titled("ISC", _ISC, "ISC License", "The ISC License", "ISC License (ISC)"),
    *_bsd("BSD-2-Clause", _BSD_BEGIN + _BSD_END, "BSD 2-Clause License"),
    *_bsd("BSD-3-Clause", _BSD_BEGIN + _BSD_THIRD + _BSD_END, "BSD 3-Clause License"),
)
#: Fixed values: (license_id, digest of the unwrapped text), from the texts that Debian ships in common-licenses.
DIGESTS = (
    ("Apache-2.0", "1bca074a1b9800bdf6fd0eb214469b96"),
    ("Apache-2.0", "9302f2dac6ecee5f96869f85b42a0660"),
    ("Apache-2.0", "c7c008f261d3b42d7dbfba1462ad6be6"),
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"),
    ("CC0-1.0", "dcb3226ed1c311f82507296410434b55"),
    ("GFDL-1.2", "c969fdb4b731dadf7173c1ffbe49a117"),
    ("GFDL-1.3", "e76911ac48027f61540add69dac75107"),
    ("GPL-1.0", "9c1239f6e3721079191b316c150dfa4d"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-2.0", "7c627f5cbb4a709bc64cbf95da3bcdce"),
    ("GPL-3.0", "3768ad71d0b65aa51cd6eb5ef1f2e7b7"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0", "6608c762a898a5214a0bdfe43ebccdf0"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-2.1", "61babd02f0832750d51cef545886b23e"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "b7edc06df79bc44a04f12befb8111960"),
    ("MPL-2.0", "9827c35216f8009dff41249ae52df7a3"),
)
