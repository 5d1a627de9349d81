"""Public licence notices and texts, as templates. Placeholders such as years and names are left out."""

from pathlib import Path

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

GPL2_HEADER = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of
the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be
removed or altered from any source distribution."""

#: whole licences, as published, one file each; AGPL, EPL and the Creative Commons legal codes other than CC0 are not among them
FILES = Path(__file__).resolve().parent / "licenses"

PUBLIC = "General Public License"


def deed(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


def later(kind: str, version: str) -> str:
    return GPL3_HEADER.replace(f"GNU General\n{PUBLIC.removeprefix('General ')}", f"GNU {kind} {PUBLIC}").replace(f"GNU {PUBLIC}", f"GNU {kind} {PUBLIC}").replace("version 3", f"version {version}")


#: name -> text; a name's part before "/" is the licence, the rest the form of the notice
TEMPLATES: dict[str, str] = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": APACHE_HEADER,
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/text": MIT_BODY,
    "GPL-3.0/notice": f"This work is licensed under the GNU {PUBLIC}, version 3.",
    "GPL-3.0/header": GPL3_HEADER,
    "GPL-2.0/notice": f"This work is licensed under the GNU {PUBLIC}, version 2.",
    "GPL-2.0/header": GPL2_HEADER,
    "LGPL-3.0/notice": f"This work is licensed under the GNU Lesser {PUBLIC}, version 3.",
    "LGPL-2.1/notice": f"This work is licensed under the GNU Lesser {PUBLIC}, version 2.1.",
    "LGPL-3.0/header": later("Lesser", "3"),
    "LGPL-2.1/header": later("Lesser", "2.1"),
    "AGPL-3.0/notice": f"This work is licensed under the GNU Affero {PUBLIC}, version 3.",
    "AGPL-3.0/header": later("Affero", "3"),
    "BSD-2-Clause/text": f"{BSD_HEAD} {DISCLAIMER}",
    "BSD-3-Clause/text": f"{BSD_HEAD} {BSD_THIRD} {DISCLAIMER}",
    "ISC/text": f"{ISC_BODY} {ISC_END}",
    "0BSD/text": f"{ISC_BODY.partition(', provided')[0]}. {ISC_END}",
    "BSL-1.0/text": BOOST,
    "MPL-2.0/header": MPL_HEADER,
    "Unlicense/text": UNLICENSE,
    "Zlib/text": ZLIB,
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0/notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0/notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0/notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0/deed": deed("Attribution"),
    "CC-BY-SA-4.0/deed": deed("Attribution-ShareAlike"),
    "CC-BY-NC-4.0/deed": deed("Attribution-NonCommercial"),
    "CC-BY-ND-4.0/deed": deed("Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0/deed": deed("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0/deed": deed("Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0/deed": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **{f"{name}/identifier": f"SPDX-License-Identifier: {name}" for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "EPL-2.0", "CC0-1.0")},
    **{f"{file.stem}/whole": file.read_text(encoding="utf-8") for file in sorted(FILES.glob("*.txt"))},
}
