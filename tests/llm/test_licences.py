"""Licence scan: against the lines that state one, on other wordings, on odd rows."""

import re

import pyarrow as pa
import pytest

from seqrec.llm import licences, queries

# How the test tables state licences.
STATED = {"gpl": "licensed under the gnu general public license", "cc-by-nc": "licensed under cc by-nc",
          "mit": "released under the mit license", "apache": "licensed under the apache license"}


def stated(text):
    return {(i, f) for i, line in enumerate((text or "").split("\n")) for f, s in STATED.items() if s in line.lower()}


@pytest.fixture(scope="module")
def scanner(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licences.Scanner(licences.fit(docs))


def test_query_finds_the_stated_lines(spark, sf_dir):
    got = {}
    for r in queries.op2_licences(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], set()).add((r["paragraph"], r["family"]))
        assert 0.5 <= r["probability"] <= 1 and r["contained"] >= licences.CONFIRM
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: stated(r["text"]) for r in rows if stated(r["text"])}
    assert got == want and want


def test_templates_and_variants(scanner):
    lines = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    lines += [("gpl", "this work is LICENSED under the GNU general public license, version 2"),
              ("mit", "Words before it. This project is licensed under the MIT License. And words after it.")]
    got = scanner.scan(pa.array([t for _, t in lines]))
    right = sum([x["family"] for x in found] == [family] for found, (family, _) in zip(got, lines))
    assert right >= 0.95 * len(lines)


def test_unknown_stays_unknown(scanner):
    lines = [*licences.NEAR_MISSES, "Licensed under the Foo Bar License, version 9.", "The license plate was blue.", "", None]
    assert not any(scanner.scan(pa.array(lines)))


def test_line_numbers_and_long_lines(scanner):
    prose = "the quiet garden lay beyond the river and nobody came " * 40
    text = f"\n\n{prose}\n{prose} Released under the MIT License. {prose}\n\nLicensed under CC BY-NC 4.0."
    (found,) = scanner.scan(pa.array([text]))
    assert [(x["paragraph"], x["family"]) for x in found] == [(3, "mit"), (5, "cc-by-nc")]
    # the same in the middle of other texts
    both = scanner.scan(pa.array(["a\nb", text, None, text]))
    assert both[1] == both[3] == found and not both[0] and not both[2]


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General "
           "Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
           "(at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser "
            "General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or "
            "(at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided "
           "that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
           "hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


@pytest.mark.parametrize("family", WRAPPED)
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices(scanner, family, mark):
    notice = "\n".join(mark + line for line in WRAPPED[family].split("\n"))
    text = f"Some program\n\n{notice}\n\nThe quiet garden lay beyond the river."
    (found,) = scanner.scan(pa.array([text]))
    assert [x["family"] for x in found] == [family] and 2 <= found[0]["paragraph"] <= 3


def test_several_licences_in_a_line(scanner):
    prose = "the quiet garden lay beyond the river and nobody came " * 40
    (far,) = scanner.scan(pa.array([f"{prose} Released under the MIT License. {prose} Licensed under CC BY-NC 4.0. {prose} "
                                    f"Released under the MIT License. {prose}"]))
    assert [(x["paragraph"], x["family"]) for x in far] == [(0, "mit"), (0, "cc-by-nc"), (0, "mit")]
    for text, families in [("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"mit", "apache"}),
                           ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", {"mit", "apache"}),
                           ("Released under the ISC License. Released under the BSD 3-Clause License.", {"isc", "bsd"})]:
        (near,) = scanner.scan(pa.array([text]))
        assert {x["family"] for x in near} == families and len(near) == len(families)


def test_odd_rows(odd_docs, no_docs):
    model = licences.fit(odd_docs)
    found = licences.scan(odd_docs, model)
    assert found.columns == [*odd_docs.columns, "licences_"] and found.count() == odd_docs.count()
    assert not any(r["licences_"] for r in found.collect())
    assert licences.scan(no_docs, licences.fit(no_docs)).count() == 0
    assert re.match("[a-z]", licences.UNKNOWN)
