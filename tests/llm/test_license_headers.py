"""Headers and notices as files have them, with the exact list of licences each should give."""

import pytest
from test_llm import docs

from sigrel.llm import license_scan as ls

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
ENDORSE = "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
AS_IS = 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {} of the License{}."
CASES = [
    ("Copyright (c) 1990 The Regents. All rights reserved.\n" + BSD + ENDORSE + AS_IS.format("THE REGENTS AND CONTRIBUTORS"), ["BSD-3-Clause"]),
    ("All rights reserved.\n" + BSD + AS_IS.format("THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), ["BSD-2-Clause"]),
    (BSD + AS_IS.format("JANE DOE"), ["BSD-2-Clause"]),
    (BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: x\n4. " + ENDORSE[3:] + AS_IS.format("X"), ["BSD-4-Clause"]),
    ("Copyright 2001 Example Corp. All rights reserved.", ["Proprietary"]),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited.", ["Proprietary"]),
    (GPL.format("General Public License", "either version 2", ", or (at your option) any later version"), ["GPL-2.0-or-later"]),
    (GPL.format("General Public License", "version 2", ""), ["GPL-2.0-only"]),
    (GPL.format("Lesser General Public License", "either version 2.1", ", or (at your option) any later version"), ["LGPL-2.1-or-later"]),
    (GPL.format("Affero General Public License", "version 3", ""), ["AGPL-3.0-only"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
    ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC\nimport x", ["BSD-3-Clause", "ISC", "MIT"]),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", ["GPL-2.0-only"]),
    ("/* SPDX-License-Identifier: GPL-2.0 */", ["GPL-2.0-only"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", ["LGPL-3.0-or-later"]),
    ("SPDX-License-Identifier: AGPL-3.0-only", ["AGPL-3.0-only"]),
    ("SPDX-License-Identifier: MIT and so on", ["MIT"]),
    ("This file is licensed under GPL v3.", ["GPL-3.0-only"]),
    ("Distributed under the GPLv2 or later.", ["GPL-2.0-or-later"]),
    ("Released under the GNU GPL version 3 only", ["GPL-3.0-only"]),
    ("licensed under LGPL 2.1", ["LGPL-2.1-only"]),
    ("This is not licensed under the MIT license.", []),
    ("It isn't released under the Apache License 2.0, but licensed under the MIT License.", ["MIT"]),
    ("no longer licensed under the GPLv3", []),
    ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
    ("We permit what the terms allow.", []),
]


@pytest.fixture(scope="module")
def found(spark):
    return {r["doc_id"]: r["licenses"] for r in ls.scan_licenses(docs(spark, [t for t, _ in CASES])).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_header(found, i):
    assert found[i] == CASES[i][1], CASES[i][0][:80]
