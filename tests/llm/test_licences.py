"""Licences as their publishers spell them."""

import os

import pytest

from millrace.llm.licences import licences_in

MIT = """MIT License

Copyright (c) 2023 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Copyright (c) 2020, Some Body <some@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD = """BSD {n}-Clause License

Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
TEXTS = {"MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD.format(n=2, third=""), "BSD-3-Clause": BSD.format(n=3, third=THIRD)}
SHARED = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def named(text):
    return {name for name, *_ in licences_in(text)}


@pytest.mark.parametrize("name", TEXTS)
def test_published_texts_alone_in_a_file_commented_and_wrapped_otherwise(name):
    text = TEXTS[name]
    assert name in named(text)
    assert name in named("# My project\n\nHow to use it.\n\n## License\n\n" + text + "\n\n## Authors\nmany\n")
    assert name in named("\n".join(" * " + line for line in text.split("\n")) + "\n */\nint main() {}\n")
    assert name in named("\n\n".join(" ".join(p.split()) for p in text.split("\n\n")))
    assert name in named(text.upper().replace("COPYRIGHT HOLDER", "COPYRIGHT  OWNER"))
    words = text.split(" ")
    assert name not in named(" ".join(words[: len(words) // 2] + ["never"] + words[len(words) // 2 :]))


@pytest.mark.skipif(not os.path.isdir(SHARED), reason="the distribution's licence texts aren't here")
@pytest.mark.parametrize("file", FILES)
def test_whole_licences(file):
    with open(f"{SHARED}/{file}", encoding="utf-8") as f:
        text = f.read()
    assert FILES[file] in named(text) and any(scope == "document" for _, scope, _ in licences_in(text))
    assert FILES[file] in named("intro\n" + text + "\nend") and not any(scope == "document" for _, scope, _ in licences_in("intro\n" + text))


def test_short_notices_are_whole_lines():
    assert named("Licensed under the GPL-3.0 or later") == set() and named("x\nReleased under the MIT licence.\ny") == {"MIT"}
    assert named("Copyright 2020 A. All rights reserved.") == set() and named("All rights reserved.") == {"LicenseRef-all-rights-reserved"}
    assert named("") == set() and named("\n \n") == set()
