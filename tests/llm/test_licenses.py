import textwrap

import duckdb
import pytest

from votescore.llm import oracles
from votescore.llm.known_licenses import NOTICES, TEXTS
from votescore.llm.licenses import known_digests, license_scan


def test_whole_texts_and_notices(spark):
    mit = TEXTS["MIT"][0]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit), (2, mit.upper().replace(",", " ;").replace("\n", "\r\n  ")),
        (3, "MIT Licence\n\n© 1999 A. N. Other. All rights reserved.\n\n" + mit.replace("sublicense", "sub-license")),
        (4, "Some prose.\nReleased under the MIT licence\nMore prose."), (5, mit + "\nAnd one more condition."),
        (6, "prose released under the MIT License."), (7, None), (8, ""), (9, "..."), (None, "apache license 2.0"),
        (10, "Intro.\n\n" + TEXTS["ISC"][0].strip().replace("\n\n", "\n") + "\n\nLicensed under CC BY-NC 4.0.\nend"),
        (4, "Some prose.\nReleased under the MIT licence\nMore prose."),
    ]
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()
    got = sorted((str(r.doc_id), r.whole, r.found, r.n_notices) for r in found)
    assert got == sorted([
        ("1", "MIT", "MIT", 0), ("2", "MIT", "MIT", 0), ("3", "MIT", "MIT", 2), ("4", "", "MIT", 1), ("4", "", "MIT", 1),
        ("5", "", "", 0), ("6", "", "", 0), ("7", "", "", 0), ("8", "", "", 0), ("9", "", "", 0),
        ("None", "Apache-2.0", "Apache-2.0", 0), ("10", "", "CC-BY-NC-4.0,ISC", 2)])


def test_every_known_text_is_found(spark):
    known = [(n, t) for table in (TEXTS, NOTICES) for n, texts in table.items() for t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(known)], "doc_id long, text string")
    found = {r.doc_id: r.whole for r in license_scan(docs, known_digests(spark)).collect()}
    assert all(name in found[i].split(",") for i, (name, _) in enumerate(known))


def test_other_known_texts(spark):
    known = known_digests(spark, [("A", "My own terms."), ("B", "my own  terms"), ("C", "...")])
    docs = spark.createDataFrame([(1, "MY OWN TERMS!"), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.whole) for r in license_scan(docs, known).collect()) == [(1, "A,B"), (2, "")]


def test_known_texts_at_any_width(spark):
    """Wherever lines are broken, with and without a holder's line behind the title."""
    docs, names = [], []
    for name, texts in TEXTS.items():
        for text in texts:
            for i, width in enumerate([30, 45, 60, 68, 70, 72, 74, 76, 78, 80, 100, 120, 10000]):
                parts = [textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)
                         for p in text.strip().split("\n\n")]
                holder = ["Copyright (c) 2020 A. N. Other", "Copyright 2020, 2021 Someone", "Copyright The Authors", "(c) 1999 Someone",
                          "(c) A. N. Other", "© Someone\nAll rights reserved."][i % 6]
                for out in ([*parts], [holder, *parts], [*parts[:1], holder, *parts[1:]]):
                    docs.append((len(docs), "\n\n".join(out)))
                    names.append((name, width))
    found = license_scan(spark.createDataFrame(docs, "doc_id long, text string"), known_digests(spark)).collect()
    assert {names[r.doc_id] for r in found if names[r.doc_id][0] not in r.whole.split(",")} == set()


def test_usual_layout(spark):
    """Lines that begin with `copyright` in the middle of a sentence."""
    isc = TEXTS["ISC"][0].replace("provided that the above copyright", "provided that the above\ncopyright")
    mit = TEXTS["MIT"][0].replace("AUTHORS OR\nCOPYRIGHT HOLDERS", "\nAUTHORS OR COPYRIGHT HOLDERS")
    docs = spark.createDataFrame([(1, isc), (2, mit), (3, mit.replace("COPYRIGHT HOLDERS", ""))], "doc_id long, text string")
    found = {r.doc_id: r.whole for r in license_scan(docs, known_digests(spark)).collect()}
    assert found == {1: "ISC", 2: "MIT", 3: ""}


def in_sql(rows):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(duck.execute(oracles.LICENSE_SCAN).fetchall())


#: Terms that look like a holder's line at first.
TERMS = ["(c) No commercial use", "All rights reserved except as granted by the vendor; commercial use is forbidden.",
         "Copyright assignment to Acme is required before any use", "(c) Private evaluation by members of the club",
         "Copyright 2020 X. Commercial use is forbidden without a paid contract.", "Copyright (c) 2020 Acme, licensed per seat"]
HOLDERS = ["Copyright (c) 2020 Someone", "Copyright © 1999-2004, 2007 A. N. Other <a@b.org>. All rights reserved.", "(c) A. N. Other",
           " * Copyright 1998 The Regents of the University of California", "Copyright The Authors", "© 2011 Größe und Söhne GmbH",
           "Copyright (c) <year> <copyright holders>".replace(" holders", " owner's name").replace("owner's ", ""), "All rights reserved.",
           "COPYRIGHT (C) 2015 FREE SOFTWARE FOUNDATION, INC.\r"]


def test_terms_are_not_taken_for_holders(spark):
    mit = TEXTS["MIT"][0]
    isc = TEXTS["ISC"][0].replace("provided that the above copyright", "provided that the above\ncopyright")
    rows = [(i, f"MIT License\n\n{line}\n\n{mit}") for i, line in enumerate(TERMS)]
    rows += [(100 + i, f"{line}\n{mit}") for i, line in enumerate(HOLDERS)]
    rows += [(200, isc), (201, mit.replace("AUTHORS OR\nCOPYRIGHT HOLDERS", "\nAUTHORS OR COPYRIGHT HOLDERS")), (202, mit), (203, None)]
    found = sorted((r.doc_id, r.whole, r.found, r.n_notices)
                   for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect())
    whole = {r[0]: r[1] for r in found}
    assert [whole[i] for i in range(len(TERMS))] == [""] * len(TERMS)
    assert [whole[100 + i] for i in range(len(HOLDERS))] == ["MIT"] * len(HOLDERS)
    assert (whole[200], whole[201], whole[202]) == ("ISC", "MIT", "MIT")
    assert in_sql(rows) == found


@pytest.mark.parametrize("width", [30, 72, 100])
def test_sql_at_any_width(spark, width):
    rows = []
    for texts in TEXTS.values():
        for text in texts:
            parts = [textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.strip().split("\n\n")]
            rows.append((len(rows), "\n\n".join([HOLDERS[len(rows) % len(HOLDERS)], *parts])))
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()
    assert sorted((r.doc_id, r.whole, r.found, r.n_notices) for r in found) == in_sql(rows)
    assert all(r.whole for r in found)
