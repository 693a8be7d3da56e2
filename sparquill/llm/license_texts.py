"""Texts of short public licences, as their stewards publish them, and the builder of their digests.

Long texts aren't kept here: LONG_DIGESTS holds the digests of what ``long_texts`` reads from the
folder of common licences that Debian ships (base-files), so that they can be checked and made anew.
"""

from __future__ import annotations

import os
import re

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Licence id, titles that may stand above the text, text.
SHORT = {
    "MIT": (["MIT License", "The MIT License", "The MIT License (MIT)"], f"{MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{AS_IS}"),
    "MIT-0": (["MIT No Attribution", "MIT No Attribution License"], f"{MIT_GRANT}.\n\n{AS_IS}"),
    "ISC": (["ISC License", "The ISC License"], f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_END}"),
    "0BSD": (["Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License"], f"{ISC_GRANT}.\n\n{ISC_END}"),
    "BSD-2-Clause": (["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'], f"{BSD_GRANT}\n{BSD_END}"),
    "BSD-3-Clause": (["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'], f"{BSD_GRANT}{BSD_THIRD}\n{BSD_END}"),
    "Zlib": (["zlib License", "The zlib License", "The zlib/libpng License"], """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    "Unlicense": (["The Unlicense", "Unlicense"], """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    "BSL-1.0": (["Boost Software License - Version 1.0 - August 17th, 2003"], """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "WTFPL": (["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"], """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""),
}
#: Names under which a notice may mention a licence.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    **{f"{i.replace(' ', '-')}-4.0": [f"{i} 4.0", f"{i} 4.0 License", f"{i} 4.0 International License", f"Creative Commons {long} 4.0 International License"] for i, long in (("CC BY", "Attribution"), ("CC BY-SA", "Attribution-ShareAlike"), ("CC BY-NC", "Attribution-NonCommercial"), ("CC BY-ND", "Attribution-NoDerivatives"), ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
LEADS = [f"{a} {verb} under{the}" for verb in ("licensed", "released", "distributed") for a in ("", "This work is", "This project is", "This software is", "This document is", "This code is") for the in ("", " the", " the terms of the")]
LEADS += ["License:", "SPDX-License-Identifier:"]
SPDX = """0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0
CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0
MPL-2.0 Unlicense WTFPL Zlib""".split()


def named_notices() -> tuple[list[tuple[str, str]], list[str]]:
    """(licence id, name) and leads: each lead stands before each name."""
    return [(i, name) for i, names in NAMES.items() for name in names], LEADS


def notices() -> list[tuple[str, str]]:
    """(licence id, line): one-line notices, every usual lead with every name."""
    return [(i, f"{lead} {name}") for i, name in named_notices()[0] for lead in LEADS] + single_notices()


def single_notices() -> list[tuple[str, str]]:
    """(licence id, line): notices of other forms."""
    return [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')] + [(i, f"{lead} {i}") for i in SPDX for lead in ("SPDX-License-Identifier:", "License:")]


def short_texts() -> list[tuple[str, str]]:
    """(licence id, text): each short text alone, under each title, and with all rights reserved."""
    out = []
    for i, (titles, text) in SHORT.items():
        for title in ["", *titles]:
            out += [(i, f"{title}\n\n{text}"), (i, f"{title}\n\nAll rights reserved.\n\n{text}")]
    return out


#: Files of the Debian folder and the ids of their licences.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def variants(text: str) -> list[str]:
    """A long licence's text as it is usually distributed: whole, without the appendix on how to apply
    it, and without its preamble's page breaks."""
    out = [text]
    for end in (r"\n\s*END OF TERMS AND CONDITIONS.*", r"\n\s*(?:APPENDIX|How to Apply|ADDENDUM).*"):
        if (cut := re.sub(end, "", text, count=1, flags=re.S)) != text:
            out.append(cut)
            if "END OF TERMS" in end:
                out.append(cut + "\nEND OF TERMS AND CONDITIONS\n")
    return out


def long_texts(folder: str = "/usr/share/common-licenses") -> list[tuple[str, str]]:
    """(licence id, text): the folder's texts in all variants."""
    out = []
    for name, i in FILES.items():
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += [(i, t) for t in variants(f.read())]
    return out


#: Digests of long_texts().
LONG_DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793",
        "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9",
        "a657010cc8660623635462386107381af70d2c7ec43ab36e27484c72cbb3b28f",
    ],
    "Artistic-1.0-Perl": [
        "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39",
    ],
    "BSD-3-Clause-UC": [
        "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f",
        "337a6b06f88d908a84d6cc98a9d560fee1b8a17edd0e4d3eac0cbc7d1df30abe",
    ],
    "GFDL-1.3": [
        "0ceebbb7b6e73e86638816e6996de1984798f9b56e7db2ee39d211853d9bfe72",
        "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480",
    ],
    "GPL-1.0": [
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ],
    "GPL-2.0": [
        "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017",
        "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
        "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999",
    ],
    "GPL-3.0": [
        "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f",
        "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943",
        "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b",
    ],
    "LGPL-2.0": [
        "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3",
        "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499",
        "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c",
    ],
    "LGPL-2.1": [
        "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c",
        "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd",
        "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    ],
    "MPL-2.0": [
        "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
    ],
}
