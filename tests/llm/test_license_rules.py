"""Every license rule is reached by a text of its own; known wordings; overlaps; cost; the fixed columns by SQL."""

import itertools
import time
from re import _parser

import duckdb
import pytest

from plexloom.llm import license_scan, registry

SF = "/root/testdata/sf0.001"


def example(pattern: str) -> str:
    """A text that the pattern matches: first branches, optional parts left out."""

    def build(tree) -> str:
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            elif name == "SUBPATTERN":
                out += build(arg[3])
            elif name == "BRANCH":
                out += build(arg[1][0])
            elif name == "MAX_REPEAT":
                out += build(arg[2]) * arg[0]
        return out

    return build(_parser.parse(pattern))


@pytest.mark.parametrize("rule", license_scan.rules(), ids=lambda r: f"{r.label} {r.pattern[:40]}")
def test_gates(rule):
    text = example(rule.pattern)
    line = f" x {text} x ".encode()
    assert license_scan._hint().search(line) and set(rule.keywords) & set(text.split())
    kept = license_scan.scan(f"x {text} x")[5]
    assert any(a <= 1 and 1 + len(text.split()) <= b for a, b, _ in kept)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Licensed under the BSD 3-Clause License", "bsd-3-clause"), ("LGPLv3", "lgpl-3"), ("GPLv3+", "gpl-3"), ("GPL-2.0-or-later", "gpl-2-or-later"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2,mit"), ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "gpl-2"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later AND 0BSD", "0bsd,lgpl-2.1-or-later"), ("SPDX-License-Identifier: Unknown", "spdx"),
        ("Licensed under GPL version 2 or later", "gpl-2-or-later"), ("licensed under the terms of the GNU General Public License, version 2", "gpl-2"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2-or-later"),
        ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl-2.1-or-later"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4"), ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd-4"), ("CC BY-NC", "cc-by-nc"),
        ("GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("the GNU GPL", "gpl"), ("Apache License, Version 2.0", "apache-2"), ("MPL 2.0", "mpl-2"), ("a mitigated apache tribe", ""),
    ],
)
def test_wordings(text, labels):
    assert ",".join(license_scan.scan(text)[3]) == labels


def test_grants_are_certain():
    assert license_scan.scan("see the GNU GPL")[4] < 1 == license_scan.scan("released under the GNU GPL")[4]


def test_containment_by_brute_force():
    spans = [(a, b) for a in range(8) for b in range(a + 1, 9)]
    for kept in itertools.islice(itertools.combinations(spans, 3), 0, None, 37):
        c = license_scan.Covered([a for a, _ in spans])
        for a, b in kept:
            c.add(a, b)
        assert all(c.inside(a, b) == any(x <= a and b <= y for x, y in kept) for a, b in spans)


def test_many_detections():
    """Eight times the detections take far less than 64 times as long."""
    took = []
    for n in (2_000, 16_000):
        text = "GPL version 2 or later, Apache License, Version 2.0; the MIT license " * n
        start = time.process_time()
        assert len(license_scan.scan(text)[5]) >= 3 * n
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]


def test_base_columns_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(license_scan.ORACLE_BASE).fetchall())
    got = registry.QUERIES["op6_license_scans"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
