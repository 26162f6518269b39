"""Licence templates: labels, word sequences and the phrases that must stand in them.

Each paragraph, header or name of a licence is a template of its own, so that texts that quote part of a licence, or
wrap it around names and years, still match. Words are as the scan reads them: lower case, split at whatever is
neither a letter nor a digit.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    #: Places of the words of the phrases that must stand in it.
    key: tuple[int, ...]


# Paragraphs of licences, with the phrase that tells the licence, by label.
TEXTS = {
    "apache-2": (
        ("Licensed under the Apache License, Version 2.0", "Apache License, Version 2"),
        ("Apache License Version 2.0, January 2004", "Apache License Version 2.0"),
        ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "in compliance with the License"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "distributed under the License is distributed on an AS IS BASIS"),
        ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", "each Contributor hereby grants to You a perpetual"),
        ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", "as defined by Sections 1 through 9"),
    ),
    "mit": (
        ("released under the MIT License", "MIT License"),
        ("The MIT License (MIT)", "MIT License MIT"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted, free of charge"),
        ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "publish, distribute, sublicense, and/or sell"),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "copies or substantial portions of the Software"),
        ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
        ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ),
    "isc": (
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "for any purpose with or without fee is hereby granted"),
        ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ),
    "bsd": (
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "must retain the above copyright notice, this list of conditions"),
        ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "in the documentation and/or other materials provided with the distribution"),
        ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
        ("BSD 2-Clause License", "BSD 2 Clause"), ("BSD 3-Clause License", "BSD 3 Clause"), ("released under the BSD License", "BSD License"),
    ),
    "bsd-3": (("may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products derived from this software"),),
    "mpl-2": (
        ("subject to the terms of the Mozilla Public License, Version 2.0", "Mozilla Public License"),
        ("Mozilla Public License Version 2.0", "Mozilla Public License Version 2.0"),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at", "copy of the MPL was not distributed with this file"),
    ),
    "epl-2": (("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"), ("Eclipse Public License - v 2.0", "Eclipse Public License v 2.0")),
    "zlib": (
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "In no event will the authors be held liable"),
        ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "must not be misrepresented"),
        ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "Altered source versions must be plainly marked"),
    ),
    "boost-1": (("Distributed under the Boost Software License, Version 1.0", "Boost Software License"), ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License Version 1.0")),
    "unlicense": (
        ("This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
        ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "either in source code form or as a compiled binary"),
    ),
    "cc0": (("CC0 1.0 Universal", "CC0 1.0 Universal"), ("the person who associated CC0 with this work has waived all copyright and related or neighboring rights", "has waived all copyright and related or neighboring rights")),
    "wtfpl": (("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WHAT THE FUCK YOU WANT TO PUBLIC"),),
}
# Names of the GNU licences, and the dates of their versions.
GNU = {
    "gpl": ("GNU General Public License", {"2": "June 1991", "3": "29 June 2007"}),
    "lgpl": ("GNU Lesser General Public License", {"2.1": "February 1999", "3": "29 June 2007"}),
    "agpl": ("GNU Affero General Public License", {"3": "19 November 2007"}),
}
# Elements of the Creative Commons licences and their names, and the versions that are told.
CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CREATIVE_VERSIONS = ("3.0", "4.0")
# Short identifiers and the label of each; those of the families above follow by rule.
IDENTIFIERS = {
    "Apache-2.0": "apache-2", "MIT": "mit", "ISC": "isc", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2", "Zlib": "zlib",
    "BSL-1.0": "boost-1", "Unlicense": "unlicense", "CC0-1.0": "cc0", "WTFPL": "wtfpl",
}
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: str) -> tuple[str, ...]:
    return tuple(w for w in _NOT_WORD.split(text.lower()) if w)


def _template(label: str, text: str, *keys: str) -> Template:
    words, places = _words(text), set()
    for phrase in map(_words, keys):
        first = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        places |= set(range(first, first + len(phrase)))
    return Template(label, words, tuple(sorted(places)))


def _gnu() -> list[tuple[str, ...]]:
    out = []
    for short, (name, versions) in GNU.items():
        for version, date in versions.items():
            label = f"{short}-{version}"
            out += [
                (label, f"{name} Version {version}, {date}", f"{name} Version {version}"),
                (label, f"licensed under the {name} version {version}", f"{name} version {version}"),
                (label, f"under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.", name, f"either version {version} of the License"),
                (label, f"under the terms of the {name} as published by the Free Software Foundation; version {version}", name, f"Free Software Foundation; version {version}"),
                (label, f"the terms of the {name} version {version} as published by the Free Software Foundation", f"{name} version {version}"),
            ]
    return out


def _creative() -> list[tuple[str, str, str]]:
    out = []
    for of, name in CREATIVE.items():
        for version in CREATIVE_VERSIONS:
            out += [
                (f"cc-{of}", f"licensed under CC {of} {version}", f"CC {of} {version}"),
                (f"cc-{of}", f"Creative Commons {name} {version} International License", f"Creative Commons {name} {version}"),
                (f"cc-{of}", f"creativecommons.org/licenses/{of}/{version}/", f"licenses/{of}/{version}"),
            ]
    return out


def _identifiers() -> list[tuple[str, str, str]]:
    of = dict(IDENTIFIERS)
    for short, (_, versions) in GNU.items():
        for version in versions:
            number = version if "." in version else f"{version}.0"
            of |= {f"{short}-{number}-only": f"{short}-{version}", f"{short}-{number}-or-later": f"{short}-{version}", f"{short}-{number}": f"{short}-{version}"}
    of |= {f"CC-{x}-{v}": f"cc-{x}" for x in CREATIVE for v in CREATIVE_VERSIONS}
    return [(label, f"SPDX-License-Identifier: {name}", f"Identifier: {name}") for name, label in of.items()]


#: Every template once.
TEMPLATES = tuple(dict.fromkeys(_template(*x) for x in [*((label, *x) for label, of in TEXTS.items() for x in of), *_gnu(), *_creative(), *_identifiers()]))
