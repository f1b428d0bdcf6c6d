import textwrap
from pathlib import Path

import duckdb
import pytest

from marginalia.llm.licenses import _BSD_2, _BSD_3, _BSD_END, _ISC_END, _MIT, _PERMISSION, _UNLICENSE, KNOWN, MOST, ORACLE, find_licenses

SHIPPED = Path("/usr/share/common-licenses")

ROWS = [
    (1, "Copyright (c) 2020 A. Body\n\n" + _MIT), (2, _MIT.upper().replace(" ", "  ").replace(",", " -- ")), (3, _MIT + " more"), (4, None), (5, ""), (6, "!!"),
    (7, "Some text.\nReleased under the MIT licence\n(c) someone\nreleased UNDER the mit license!\nLicensed under CC BY-NC 4.0."), (8, "ALL RIGHTS RESERVED"), (9, "é ü 12\nand more"), (None, "All rights reserved."),
    (10, "# Copyright 1999\r\n// Copyright (C) x\nAll rights reserved."), (11, "word " * 500_000), (12, "and & and"), (13, "a license\nof no kind"),
]


def test_whole_texts_and_lines(spark):
    df = spark.createDataFrame([(*r, "clash") for r in [*ROWS, ROWS[7]]], "doc_id long, text string, license_id string")
    got = find_licenses(df).collect()
    assert len(got) == len(ROWS) + 1
    by = {r.doc_id: r for r in got}
    assert by[1].license_id == by[2].license_id == "MIT" and by[1].text_digest == by[2].text_digest
    assert by[3].license_id is None and by[4].text_digest == by[5].text_digest == by[6].text_digest
    assert (by[7].line_licenses, by[7].n_license_lines, by[7].license_id) == ("CC-BY-NC-4.0,MIT", 3, None)
    assert by[8].license_id == by[10].license_id == by[None].license_id == "LicenseRef-all-rights-reserved"
    assert by[9].line_licenses == "" and by[9].n_license_lines == 0
    assert find_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert {r.license_id for r in find_licenses(df, (), ()).collect()} == {None}
    with pytest.raises(ValueError):
        find_licenses(df, KNOWN * MOST)


def test_sql_gives_the_same(spark):
    rows = [r for r in ROWS if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE).fetchall())


def test_texts_are_known_at_any_width(spark):
    texts = {"MIT": _MIT, "ISC": f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}", "BSD-2-Clause": f"{_BSD_2} {_BSD_END}", "BSD-3-Clause": f"{_BSD_3} {_BSD_END}", "Unlicense": _UNLICENSE}
    heads = {"MIT": "Copyright (c) 2021 A. Body\n\n", "ISC": "Copyright 2021 A. Body\n", "BSD-2-Clause": "Copyright (C) A. Body\nAll rights reserved.\n", "BSD-3-Clause": "# Copyright © 1999-2004 A. Body\n", "Unlicense": ""}
    rows = [(f"{i}/{w}", heads[i] + textwrap.fill(t, w)) for i, t in texts.items() for w in range(40, 120)]
    rows += [(f"{i}/plain", t) for i, t in texts.items()]
    got = find_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == 405 and all(r.license_id == r.doc_id.split("/")[0] for r in got)


def test_only_copyright_notices_are_left_out(spark):
    rows = [(1, "copyright holders may\nask"), (2, "ask"), (3, "(c) You must retain\nask"), (4, "Copyright 2001 B\nask"), (5, "(c) 1999 B\nask"), (6, "© B\nask")]
    got = {r.doc_id: r.text_digest for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4] == got[5] == got[6] == got[2] and got[1] != got[2] and got[3] != got[2]


@pytest.mark.skipif(not SHIPPED.is_dir(), reason="no licence texts on this machine")
def test_long_licences_are_known_whole(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (SHIPPED / f).read_text(encoding="utf-8")) for i, f in files.items()]
    rows += [(i, t.upper().replace("\n", "\r\n")) for i, t in rows] + [("none", t + " more") for _, t in rows]
    got = find_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.license_id == (None if r.doc_id == "none" else r.doc_id) for r in got) and len(got) == 18


def test_equal_forms_take_the_first_identifier(spark):
    df = spark.createDataFrame([(1, "Some   notice!")], "doc_id long, text string")
    [r] = find_licenses(df, (("B", "some notice"), ("A", "SOME NOTICE."), ("C", "some notice")), ()).collect()
    assert (r.license_id, r.line_licenses, r.n_license_lines) == ("A", "A", 1)
