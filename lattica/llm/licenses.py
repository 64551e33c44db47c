"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is normalised to lower-case words. A template's window may be shorter or longer than it, but the size bound
t / (2 - t) .. (2 - t) / t follows from the Dice threshold t, and so does the least number of shared bigrams; both
prune templates and windows before anything is compared. Windows begin and end at shared bigrams, so a licence is found
as a whole text, a paragraph or one line of a long document alike.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DICE = 0.8
SCHEMA = "doc_id long, n_licenses long, licenses string, best_dice double, spans string"
WORDS = re.compile(r"\w+")

def gnu(name: str, version: str) -> str:
    """The notice that files under a GNU licence carry."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as
        published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
    USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
    LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
    OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_START = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies."""
CREATIVE = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}
GNU = {
    "GPL-2.0": ("GNU General Public License", "2"), "GPL-3.0": ("GNU General Public License", "3"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3"),
}

#: (id, text). Notices as they are put into files, and short licences in full; WHOLE has the long ones.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    *((id_, gnu(*how)) for id_, how in GNU.items()),
    ("LGPL-2.1", gnu("GNU Lesser General Public License", "2.1").replace("This program", "This library").replace("program is", "library is")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", f"{BSD_START} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_START} {BSD_THIRD} {BSD_END}"),
    ("ISC", ISC_START),
    ("ISC", f"""{ISC_START} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    *((id_, f"Licensed under {id_.replace('CC-BY', 'CC BY').replace('-4.0', ' 4.0')}.") for id_ in CREATIVE),
    *((id_, f"This work is licensed under a Creative Commons {name} 4.0 International License.") for id_, name in CREATIVE.items()),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("LicenseRef-all-rights", "All rights reserved."),
]

#: Licences whose whole texts lie beside this module.
WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")

REMOTE = """13. Remote Network Interaction; Use with the GNU General Public License.
    Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer
    all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity
    to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at
    no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall
    include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated
    pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or
    combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work,
    and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but
    the work with which it is combined will remain governed by version 3 of the GNU General Public License.

  """


def affero(gpl: str) -> str:
    """The Affero licence, near enough for Dice: GPL-3.0 under its name, with a section 13 of its own."""
    start, end = gpl.index("  13. Use with the GNU Affero"), gpl.index("  14. Revised Versions")
    named = [x.replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL") for x in (gpl[:start], gpl[end:])]
    return named[0] + REMOTE + named[1]


def whole_texts() -> list[tuple[str, str]]:
    from importlib.resources import files

    found = [(id_, files("lattica.llm.licence_texts").joinpath(f"{id_}.txt").read_text(encoding="utf-8")) for id_ in WHOLE]
    return [*found, ("AGPL-3.0", affero(dict(found)["GPL-3.0"]))]


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower().replace("licence", "license"))


class Templates:
    """Templates by their bigrams. Equal ids are variants of one licence; the first with the best score is told."""

    def __init__(self, templates: list[tuple[str, str]], dice: float = DICE) -> None:
        self.dice, self.names, self.bags, self.by = dice, [], [], defaultdict(list)
        for name, text in templates:
            w = words(text)
            bag = Counter(zip(w, w[1:]))
            if not bag:
                raise ValueError(f"template {name}: fewer than two words")
            for x in bag:
                self.by[x].append(len(self.names))
            self.names.append(name)
            self.bags.append(bag)
        self.sizes = [sum(b.values()) for b in self.bags]
        # dice = 2 o / (a + b) >= t with o <= a: o >= t b / (2 - t), and a between that and (2 - t) b / t.
        self.least = [math.ceil(dice * n / (2 - dice) - 1e-9) for n in self.sizes]
        self.longest = [math.floor((2 - dice) * n / dice + 1e-9) for n in self.sizes]
        self.known = frozenset(self.by)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(id, first word, end word, dice), in order and without overlap: of overlapping windows the better stays, of equal ones the longer."""
        w = words(text)
        if self.known.isdisjoint(zip(w, w[1:])):
            return []
        hits: dict[int, list[int]] = defaultdict(list)
        grams = list(zip(w, w[1:]))
        for i, x in enumerate(grams):
            for k in self.by.get(x, ()):
                hits[k].append(i)
        found = []
        for k, at in hits.items():
            if len(at) >= self.least[k] and sum(min(c, self.bags[k][x]) for x, c in Counter(grams[i] for i in at).items()) >= self.least[k]:
                found += [(self.names[k], a, b + 2, d) for a, b, d in self._windows(k, at, grams)]
        taken: list[tuple[int, int, str, float]] = []  # disjoint, in order
        for name, a, b, d in sorted(found, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
            i = bisect_left(taken, (a,))
            if (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a):
                taken.insert(i, (a, b, name, d))
        return [(name, a, b, d) for a, b, name, d in taken]

    def _windows(self, k: int, at: list[int], grams: list[tuple[str, str]]) -> Iterator[tuple[int, int, float]]:
        """The best window of each group of overlapping ones that reach the threshold.

        A long template's starts are tried every `step` hits first. A start that is at most so many hits too late has lost as
        many shared bigrams at most, so every start is tried only before those that come that near to the group's best.
        """
        n, least, most = self.sizes[k], self.least[k], self.longest[k]
        step = max(1, n // 100)
        slack = 2 * step / (n + least) if step > 1 else 0.0
        near: list[tuple[int, int, float]] = []  # of one group: hit, end, dice
        best: tuple[int, int, float] | None = None

        def told() -> Iterator[tuple[int, int, float]]:
            floor = max(self.dice, best[2])
            starts = sorted({x for j, _, d in near if d + slack >= floor for x in range(max(0, j - step + 1), j + 1)})
            tries = [best] if step == 1 else [(at[i], b, d) for i in starts for d, b in [self._best_end(k, at, grams, i)]]
            found = max(tries, key=lambda x: (x[2], -x[0]))
            if found[2] >= self.dice:
                yield found

        for i in range(0, len(at) + step - 1, step):
            i = min(i, len(at) - 1)
            if best and at[i] > best[1]:
                yield from told()
                near, best = [], None
            if step == 1 and (i + least > len(at) or at[i + least - 1] - at[i] >= most):
                continue
            d, b = self._best_end(k, at, grams, i)
            if d >= self.dice - slack:
                near.append((i, b, d))
                if not best or d > best[2]:
                    best = (at[i], b, d)
        if best:
            yield from told()

    def _best_end(self, k: int, at: list[int], grams: list[tuple[str, str]], i: int) -> tuple[float, int]:
        """The best Dice of the windows that begin at hit i, and the last bigram of the first such window."""
        bag, n, most, a = self.bags[k], self.sizes[k], self.longest[k], at[i]
        seen: Counter = Counter()
        shared, best, end = 0, 0.0, a
        for j in range(i, len(at)):
            b = at[j]
            if b - a >= most:
                break
            x = grams[b]
            seen[x] += 1
            shared += seen[x] <= bag[x]
            d = 2 * shared / (b - a + 1 + n)
            if d > best:
                best, end = d, b
        return best, end


@lru_cache(maxsize=4)
def standard(dice: float = DICE) -> Templates:
    return Templates(TEMPLATES + whole_texts(), dice)


def scan_licenses(docs: DataFrame, dice: float = DICE) -> DataFrame:
    """For each row of docs: doc_id, n_licenses, licenses (ids in text order, comma-joined), best_dice (null if none), spans (id:first word:end word).

    A null or empty text has none; repeated rows are scanned each; other columns are ignored. A text is scanned whole,
    however long: a template costs its hits times its own length at most. Of overlapping windows the one with the higher
    Dice is told, of equal ones the longer, then the earlier, then the id that comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = standard(dice).scan
        for batch in batches:
            all_ = [scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([len(f) for f in all_], pa.int64()), pa.array([",".join(x[0] for x in f) for f in all_], pa.string()),
                    pa.array([max((x[3] for x in f), default=None) for f in all_], pa.float64()), pa.array([",".join(f"{n}:{a}:{b}" for n, a, b, _ in f) for f in all_], pa.string()),
                ],
                names=["doc_id", "n_licenses", "licenses", "best_dice", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
