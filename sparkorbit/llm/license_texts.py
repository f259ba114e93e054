"""Templates of license texts and statements, by label.

``[[ ]]`` holds an optional region, which may hold others; ``{{a-b}}`` stands for any a to
b words.  All other wording is mandatory; punctuation and letter case do not count.
"""

# The phrases whose places are counted, and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE {{1-12}} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE {{1-12}} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """

# Wording of the public license texts, statements and notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Apache License [[the]] Version 2 [[0]]"),
    (
        "apache-2.0-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at [[http]] [[https]] [[://]] [[www.]] apache.org/licenses/LICENSE-2.0 [[.txt]] [[.html]] Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License""",
    ),
    ("bsd-2-clause", _BSD + _DISCLAIMER),
    (
        "bsd-3-clause",
        _BSD
        + """[[3.]] Neither the name of [[the]] {{1-12}} nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
        + _DISCLAIMER,
    ),
    ("cc-by-nc", "CC BY NC"),
    ("cc-by-nd", "CC BY [[NC]] ND"),
    ("cc-by-sa", "CC BY [[NC]] SA"),
    ("cc-by-text", "Creative Commons Attribution [[NonCommercial]] [[Non Commercial]] [[NoDerivatives]] [[ShareAlike]] [[Share Alike]] {{0-2}} [[International]] [[Unported]] [[Public]] License"),
    ("cc0", "CC0 1 0 [[Universal]]"),
    ("gpl-2.0", "GNU General Public License [[as published by the Free Software Foundation]] [[either]] Version 2"),
    ("gpl-3.0", "GNU General Public License [[as published by the Free Software Foundation]] [[either]] Version 3"),
    (
        "gpl-notice",
        """This program is free software [[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation [[,]] [[either]] version {{1-2}} of the License [[or at your option any later version]]""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{1-8}}
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    ),
    ("lgpl", "GNU Lesser General Public License"),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL [[THE]] {{1-12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. [[If a copy of the MPL was not distributed with
this file, You can obtain one at {{0-6}} mozilla.org/MPL/2.0]]""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
