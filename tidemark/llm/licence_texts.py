"""Texts of well-known public licences that documents are looked up against.

Fixed values: the published wording of each licence, and short notices that stand for one.
"""

from __future__ import annotations

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

LICENCES: list[tuple[str, str]] = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _NO_WARRANTY,
    ),
    (
        "MIT-0",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

""" + _NO_WARRANTY,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_WARRANTY),
    (
        "BSD-3-Clause",
        _BSD_CONDITIONS
        + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
        + _BSD_WARRANTY,
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
]

#: Canonical digests of the full published texts of longer licences.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "e99a5f52544571f7ff475cb2bd25c2ab15fa86969d47e994a2fa2bfbc377a03b"),
    ("Artistic-1.0-Perl", "7b8fc42b4e14e24683a89fd1a844944a58fdc09b330d6b3817f83b298f94afe1"),
    ("CC0-1.0", "8a58796fb749d87126983cebc26e6619b99601332e2fee24acbad509518cad3f"),
    ("GFDL-1.2", "7457c85c8a91ebda99a290734c7a2634aee2e45acae62375e44c50339bdb016c"),
    ("GFDL-1.3", "8a432774852d4eb6af87f60e8d2b93744cedaf734a65a7244c27c598efa1856b"),
    ("GPL-1.0", "37821fa2108a81e24bd78f49fa06d218dff42ae8f6b027b74560159b0bca978b"),
    ("GPL-2.0", "3d2bf885461fba6fb480176365175348539757b12bd149ba06e25e87dcfc250e"),
    ("GPL-3.0", "46bab6d7008bd0d2bb6c2ca2254205206c09640cc53bd24208270acd607b64af"),
    ("LGPL-2.0", "c3c302459eccafae13847fa777b9e28700b244106a6cc26eb627f52163fd1cf4"),
    ("LGPL-2.1", "8cc9f02ad2662199367a4cc364df5f3bd0723333ff597a36eae942cc0cd07f33"),
    ("LGPL-3.0", "d33eeaa77eec4b5f2546d3bfe95c21d2d548188ebdcd41595fd1d29894a2bd62"),
    ("MPL-1.1", "4b0c7f329abfc8da35385a7fea0bfd5c49768cedc4e7bf27d934788cc335263b"),
    ("MPL-2.0", "7b5982c148450518302bb3bb12b9b154f0f34d5628b3f775133a4259000cb8a6"),
]
