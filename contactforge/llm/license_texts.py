"""Public licence texts, the notices that their authors ask for, and usual one-line statements, by SPDX
identifier. Holders and years are left out, as they differ from work to work."""

_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""
_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(kind: str, name: str, version: str, end: str) -> list[str]:
    """Opening paragraph of the notice, and the whole notice."""
    mark = ":" if version.startswith("3") else ";"
    first = f"""This {kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
    rest = f"""This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
    return [first, f"{first} {rest} You should have received a copy of the GNU {name} along with this {kind}{end}"]


_WEB, _POST = ". If not, see <https://www.gnu.org/licenses/>.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

_PORT = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}
#: Short name, what the notice calls the work, name, end of the notice, versions.
_GNU = [
    ("GPL", "program", "General Public License", _WEB, "3.0"),
    ("GPL", "program", "General Public License", _POST, "2.0", "1.0"),
    ("LGPL", "library", "Lesser General Public License", _POST, "2.1"),
    ("LGPL", "program", "Lesser General Public License", _WEB, "3.0"),
    ("AGPL", "program", "Affero General Public License", _WEB, "3.0"),
]


def _cc_name(kind: str, version: str) -> str:
    """Versions before the fourth say NoDerivs."""
    return _CC[kind] if version == "4.0" else _CC[kind].replace("NoDerivatives", "NoDerivs")


def _gnu_named(short: str, kind: str, name: str, version: str, end: str) -> list[tuple[str, str]]:
    """One-line statements of this version alone and of later ones too, and the notices, which allow later ones."""
    number, spdx = version.removesuffix(".0"), f"{short}-{version}"
    lines = [f"This work is licensed under the GNU {x}, version {number}" for x in (name, short)]
    only = [f"{x}{y}" for x in lines for y in (".", " only.")]
    later = [*(f"{x} or later." for x in lines), *_gnu(kind, name, number, end)]
    return [*((f"{spdx}-only", x) for x in only), *((f"{spdx}-or-later", x) for x in later)]


TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_DISCLAIMER}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("LicenseRef-BSD", "Licensed under the BSD License."),
    ("BSD-2-Clause", _BSD_OPENING),
    ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC[: _ISC.index(', provided')]}. {_ISC_DISCLAIMER}"),
    *(x for n, kind, name, end, *vs in _GNU for v in vs for x in _gnu_named(n, kind, name, v, end)),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "EPL-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
at https://www.eclipse.org/legal/epl-2.0/""",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    *((f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for v in _PORT for k in _CC),
    *((f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {_cc_name(k, v)} {v} {port} License.") for v, port in _PORT.items() for k in _CC),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: Lines that name a licence by its SPDX identifier, the former identifiers of the GNU family too.
IDENTIFIERS: list[tuple[str, str]] = [
    *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES)),
    *((f"{n}-{v}-{end}", f"SPDX-License-Identifier: {n}-{v}{mark}") for n, *_, vs in [(g[0], g[4:]) for g in _GNU] for v in vs for mark, end in (("", "only"), ("+", "or-later"))),
]
