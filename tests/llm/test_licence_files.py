"""Licence texts and headers as they stand in files, with their SPDX identifiers; nothing here is taken from the tables."""

from langshift.llm import license_scan
from tests.llm.test_text_operators import same_as_sql

BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY.
"""
MIT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def gnu(name, version, what="program", mark=";"):
    return f"""This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{version}

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


LATER = "either version {} of the License, or\n(at your option) any later version."
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""

FILES = [
    (MIT, ["MIT"]),
    (BSD + THIRD + DISCLAIMER, ["BSD-3-Clause"]),
    (BSD + DISCLAIMER, ["BSD-2-Clause"]),
    ("ISC License\n\nCopyright 2019 Some One\n\n" + ISC, ["ISC"]),
    ("BSD Zero Clause\n\n" + ISC.split(", provided")[0] + ".", ["0BSD"]),
    (gnu("", "; " + LATER.format(2)), ["GPL-2.0-or-later"]),
    (gnu("", ", " + LATER.format(3), mark=":"), ["GPL-3.0-or-later"]),
    (gnu("", "; version 2 of the License."), ["GPL-2.0-only"]),
    (gnu("Lesser ", "; " + LATER.format("2.1"), "library"), ["LGPL-2.1-or-later"]),
    (gnu("Lesser ", ", " + LATER.format(3), "library", ":"), ["LGPL-3.0-or-later"]),
    (gnu("Affero ", ", " + LATER.format(3), mark=":"), ["AGPL-3.0-or-later"]),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""", ["Zlib"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.", ["Unlicense"]),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n\nStatement of Purpose", ["CC0-1.0"]),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge", ["BSL-1.0"]),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file)", ["BSL-1.0"]),
    ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\nPUBLIC LICENSE (\"AGREEMENT\").", ["EPL-2.0"]),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0-only"]),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright", ["LGPL-2.1-only"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", ["Apache-2.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR MIT) */\nint x;", ["MIT", "GPL-2.0-only"]),
    ("# SPDX-License-Identifier: GPL-2.0+\n", ["GPL-2.0-or-later"]),
    ("// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", ["GPL-2.0-only"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause\ncode", ["BSD-3-Clause", "GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: Zlib", ["Zlib"]),
    ("Licensed under the MIT license (see LICENSE).", ["MIT"]),
    ("This project is dual licensed under the MIT license and the Apache License, Version 2.0.", ["MIT OR Apache-2.0"]),
    ("## License\n\nMIT License\n\nMore.", ["MIT"]),
    ("Copyright 2020 Some Company. All rights reserved.", ["Proprietary"]),
    ("All rights reserved.\n\nReleased under the MIT license.", ["MIT"]),
    ("SPDX-License-Identifier: ", []),
    ("SPDX-License-Identifier: WITH OR AND +", []),
    ("An expression of 2.0+ or spdx and so on", []),
]


def test_files_of_known_licences(spark):
    docs = spark.createDataFrame(list(enumerate(text for text, _ in FILES)), "doc_id bigint, text string")
    found = license_scan.scan(docs).collect()
    out = {r.doc_id: sorted(r.licenses) for r in found}
    wrong = {i: (out[i], licenses, text[:60]) for i, (text, licenses) in enumerate(FILES) if out[i] != sorted(licenses)}
    assert not wrong
    same_as_sql(docs, found)
