"""License scans by conditional compression.

Words within ``CONTEXT`` words of licence vocabulary are candidate blocks, whatever the
lines they stand in.  A block is gone through in windows of ``WINDOW`` words, each overlapping
the one before by ``OVERLAP``: a window is compressed by itself and with each template as
zstandard raw dictionary, and templates are ranked by how much smaller it gets.  The rank is
an order and excludes nothing: in that order each template is compared, by its exact
differences in wording, at every place of the window where it could be.  What is confirmed
takes its words; a later one counts where it takes free words, or where it is longer and
holds what was found before.  So a block can hold any number of licences, and work grows
with its length alone.

A short notice (under ``SHORT`` words) must occur word for word; a longer text may differ in
``TOLERANCE`` of its words, but in none that names a licence or its version.  Case,
punctuation and line breaks do not count.

Null and empty texts have no licence; repeated rows get equal results; an empty table gives
no row; columns other than the id and the text are left behind, so that their names do not
matter.  Very long texts and lines are read whole, and give what short ones give: a block
has no largest size, and a licence is found wherever in it it stands.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SHORT = 20
TOLERANCE = 0.15
CONTEXT = 120
WINDOW = 640
OVERLAP = 240
LEVEL = 6
MARGIN = "\x01\x02\x03\x04\x05\x06\x07\x08" * 2
HINT = r"(?i)licen[cs]|copyright|rights reserved|permission|redistribut|warrant|liab|spdx|public domain"

# Public licence notices and texts, by SPDX identifier.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "2-Clause BSD License"),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "3-Clause BSD License"),
    ("BSD-3-Clause", "New BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License v2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("Zlib", "zlib License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
]
# The GNU family (identifier, name, version) and the wording they share.
GNU = [("AGPL-3.0", "GNU Affero General Public License", "3"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3")]
GNU_NOTICES = [
    "This work is licensed under the {name}, version {version}.", "{name}, version {version}", "{name} v{version}",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
]
# The elements of Creative Commons licences, and how versions are named.
CC_ELEMENTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_LICENSES, CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], {"4.0": "International", "3.0": "Unported"}
CC_NOTICES = ["Licensed under CC {code} {version}.", "Creative Commons {title} {version} {scope} License"]
# Identifiers of tags beside those above.
TAGS = ["0BSD", "BSD-4-Clause", "CDDL-1.0", "EPL-1.0", "EUPL-1.2", "LGPL-2.0", "MPL-1.1", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0"]
# Words that tell one licence from another; no difference may touch them.
DECISIVE = {"affero", "agpl", "apache", "artistic", "attribution", "boost", "bsd", "cc", "cc0", "clause", "eclipse", "general", "gnu", "gpl", "international", "isc", "lesser", "lgpl", "library", "mit", "mozilla", "mpl", "nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike", "unported"}


def _catalogue() -> list[tuple[str, str]]:
    """Notices, those of the two families by their wording, and the tag of every licence."""
    out = NOTICES + [(i, n.format(name=name, version=v)) for i, name, v in GNU for n in GNU_NOTICES]
    for code in CC_LICENSES:
        title = "-".join(CC_ELEMENTS[x] for x in code.split("-"))
        out += [(f"CC-{code}-{v}", n.format(code=code, version=v, title=title, scope=scope)) for v, scope in CC_VERSIONS.items() for n in CC_NOTICES]
    names = dict.fromkeys([n for n, _ in out if not n.startswith("LicenseRef")] + TAGS)
    return out + [(n, f"SPDX-License-Identifier: {n}") for n in names]


_WORD = re.compile(r"[^\W_]+")
_HINT_WORD = re.compile(r"licen[cs]|copyright|reserved|permission|redistribut|warrant|liab|spdx|domain")


def wording(text: str) -> list[str]:
    """Words that count in a comparison."""
    return _WORD.findall(text.lower())


def allowed(words: list[str]) -> int:
    """How many words of a template may differ."""
    return int(len(words) * TOLERANCE) if len(words) >= SHORT else 0


class Finding(NamedTuple):
    license: str
    template: int
    reduction: float
    words: int
    missing: list[str]
    extra: list[str]


def candidate_blocks(text: str) -> list[list[str]]:
    """Runs of words within ``CONTEXT`` words of licence vocabulary."""
    words, blocks = wording(text), []
    lo = hi = 0
    for i, w in enumerate(words):
        if _HINT_WORD.search(w):
            if i - CONTEXT > hi:
                blocks += [words[lo:hi]] if hi else []
                lo = i - CONTEXT
            hi = i + CONTEXT + 1
    return [*blocks, words[max(0, lo) : hi]] if hi else blocks


class Scanner:
    """Templates as dictionaries, and an index of the runs of words that each must share."""

    def __init__(self, templates: list[tuple[str, str]] | None = None):
        self.templates = [(name, wording(text)) for name, text in templates or TEMPLATES]
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.given = []
        self.bags = [Counter(words) for _, words in self.templates]
        self.runs: dict[tuple[str, str], list[tuple[int, int, tuple[str, ...]]]] = {}
        for i, (_, words) in enumerate(self.templates):  # the margin: a dictionary's last bytes start no match
            d = zstandard.ZstdCompressionDict(f"\n {' '.join(words)} \n{MARGIN}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.given.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))
            most = allowed(words)  # differences: at most one run more, one of which is as long as the mean
            need = -(-(len(words) - most) // (most + 1))
            for a in range(len(words) - need + 1):
                run = tuple(words[a : a + need])
                self.runs.setdefault(run[:2], []).append((i, a, run))

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(share by which the words shrink, template), largest first, ties by template."""
        block = f" {' '.join(words)} ".encode()
        base = len(self.alone.compress(block))
        return sorted(((1 - len(c.compress(block)) / base, i) for i, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def places(self, words: list[str], lo: int, hi: int) -> dict[int, list[int]]:
        """Where templates could begin, by runs that start in ``lo:hi``, best first: each shift
        at which a run agrees that a text within the tolerance must have."""
        found: dict[int, dict[int, int]] = {}
        for b in range(lo, min(hi, len(words) - 1)):
            for i, a, run in self.runs.get((words[b], words[b + 1]), ()):
                if tuple(words[b : b + len(run)]) == run:
                    own = found.setdefault(i, {})
                    own[b - a] = own.get(b - a, 0) + 1
        return {i: sorted(own, key=lambda shift: (-own[shift], shift)) for i, own in found.items()}

    def compare_at(self, template: int, words: list[str], shift: int) -> tuple[list[str], list[str], int, int] | None:
        """(words missing, words added, start, end) of the template at about ``shift``, or None
        if it differs too much there."""
        wanted = self.templates[template][1]
        slack = allowed(wanted)
        if not slack:
            whole = shift >= 0 and words[shift : shift + len(wanted)] == wanted
            return ([], [], shift, shift + len(wanted)) if whole else None
        lo = max(0, shift - slack)
        part = words[lo : max(0, shift + len(wanted) + slack)]
        if len(wanted) - (self.bags[template] & Counter(part)).total() > slack:
            return None
        same = [m for m in difflib.SequenceMatcher(None, wanted, part, autojunk=False).get_matching_blocks() if m.size]
        start, end = same[0].b, same[-1].b + same[-1].size
        hit, there = {m.a + k for m in same for k in range(m.size)}, {m.b + k for m in same for k in range(m.size)}
        missing = [w for k, w in enumerate(wanted) if k not in hit]
        extra = [part[k] for k in range(start, end) if k not in there]
        if len(missing) + len(extra) > slack or self.decisive(template, missing, extra):
            return None
        return missing, extra, lo + start, lo + end

    def decisive(self, template: int, missing: list[str], extra: list[str]) -> bool:
        """Whether differences touch a licence's name or version."""
        versioned = "version" in self.bags[template]
        return any(w in DECISIVE or w.isdigit() for w in missing) or any(w in DECISIVE and w not in self.bags[template] or versioned and w.isdigit() and len(w) < 3 for w in extra)

    def scan_block(self, words: list[str]) -> list[Finding]:
        """Findings of a block, in the order of their places."""
        taken: list[tuple[int, int, Finding]] = []
        done: list[tuple[int, int, Finding]] = []
        step = WINDOW - OVERLAP
        for lo in range(0, max(1, len(words) - OVERLAP), step):
            hi = min(len(words), lo + WINDOW)
            places = self.places(words, lo, hi)
            done += [x for x in taken if x[1] <= lo - WINDOW]
            taken = [x for x in taken if x[1] > lo - WINDOW]
            for reduction, i in self.ranked(words[lo:hi]):
                size, held = len(self.templates[i][1]), []
                for shift in places.get(i, ()):
                    if any(a <= shift and shift + size <= b for a, b in held):
                        continue
                    x = self.compare_at(i, words, shift)
                    if x is None:
                        continue
                    missing, extra, start, end = x
                    held.append((start, end))
                    over = [t for t in taken if t[0] < end and start < t[1]]
                    if all(start <= a and b <= end and end - start > b - a for a, b, _ in over):
                        taken = [t for t in taken if t not in over] + [(start, end, Finding(self.templates[i][0], i, reduction, end - start, missing, extra))]
        return [f for _, _, f in sorted(done + taken, key=lambda x: x[:2])]

    def scan(self, text: str | None) -> list[Finding]:
        """Findings of a whole text, in the order of their places."""
        return [f for words in candidate_blocks(text) for f in self.scan_block(words)] if text else []


TEMPLATES = _catalogue()

_SCHEMA = "array<struct<license string, template int, reduction double, words int, missing array<string>, extra array<string>>>"
_TYPE = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("reduction", pa.float64()), ("words", pa.int32()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings) for each row; nothing is shuffled, and only texts with licence
    vocabulary cross over to Python."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            rows = [[f._asdict() for f in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _TYPE)], ["id", "findings"])

    text = F.col(text_col)
    picked = df.select(F.col(id_col).alias("id"), F.when(text.rlike(HINT), text).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, findings {_SCHEMA}")


def op1_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every whole text of ``documents``."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("findings.license")))
    return found.select(F.col("id").alias("doc_id"), F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"))


QUERIES = {"op1_license_compression": op1_license_compression}
ORACLE_SQL = {
    "op1_license_compression": """
with n(notice, license) as (values
  ('apache license version 2 0', 'Apache-2.0'), ('apache license 2 0', 'Apache-2.0'),
  ('licensed under cc by 4 0', 'CC-BY-4.0'), ('licensed under cc by nc 4 0', 'CC-BY-NC-4.0'), ('licensed under cc by sa 4 0', 'CC-BY-SA-4.0'), ('licensed under cc by nd 4 0', 'CC-BY-ND-4.0'),
  ('this work is dedicated to the public domain under cc0 1 0', 'CC0-1.0'), ('cc0 1 0 universal public domain dedication', 'CC0-1.0'),
  ('gnu general public license version 2', 'GPL-2.0'), ('gnu general public license version 3', 'GPL-3.0'), ('gnu general public license v2', 'GPL-2.0'), ('gnu general public license v3', 'GPL-3.0'),
  ('gnu lesser general public license version 2 1', 'LGPL-2.1'), ('gnu lesser general public license version 3', 'LGPL-3.0'), ('gnu affero general public license version 3', 'AGPL-3.0'),
  ('mozilla public license 2 0', 'MPL-2.0'), ('mozilla public license version 2 0', 'MPL-2.0'), ('eclipse public license 2 0', 'EPL-2.0'), ('boost software license version 1 0', 'BSL-1.0'),
  ('bsd 2 clause license', 'BSD-2-Clause'), ('bsd 3 clause license', 'BSD-3-Clause'), ('isc license', 'ISC'), ('mit license', 'MIT'), ('zlib license', 'Zlib'),
  ('spdx license identifier mit', 'MIT'), ('spdx license identifier apache 2 0', 'Apache-2.0'), ('spdx license identifier bsd 3 clause', 'BSD-3-Clause'),
  ('this is free and unencumbered software released into the public domain', 'Unlicense'), ('all rights reserved', 'LicenseRef-all-rights-reserved')
), t as (
  select doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' as w from documents
), f as (
  select t.doc_id, list_sort(list(distinct n.license)) as l from t join n on contains(t.w, ' ' || n.notice || ' ') group by t.doc_id
)
select d.doc_id, coalesce(array_to_string(f.l, ','), '') as licenses, coalesce(len(f.l), 0)::bigint as n_licenses from documents d left join f using (doc_id)
"""
}
