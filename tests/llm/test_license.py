"""Licence notices: unknown licences, wrapped notices, cover by brute force."""

import re

import pytest

from pagesift.llm import license_scan as ls

UNKNOWN = ["Eclipse Public License 2.0", "PostgreSQL License", "zlib License", "SPDX-License-Identifier: EPL-2.0",
           "Released under the terms of the WTFPL license", "Licensed under the ISC License.", "SPDX-License-Identifier: Zlib",
           "Distributed under the Boost Software License, Version 1.0."]
WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\n"
           "files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy",
    "gpl": "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General Public License as\n"
           "published by the Free Software Foundation, either version 3 of\nthe License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published",
    "bsd": "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met:",
}
PROSE = "The harbour was quiet that morning and only two boats went out before the fog came in over the bay again"


@pytest.fixture(scope="module")
def rows(spark):
    texts = [f"{PROSE} {i}.\nSome more words of number {i} follow here." for i in range(40)]
    texts += [f"{PROSE}\n\n{n}\n\n{PROSE}" for n in WRAPPED.values()] + UNKNOWN
    texts += [t for ts in ls.TEMPLATES.values() for t in ts] + [None, "", "x " * 30_000, "a\n" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    return texts, [r.asDict() for r in ls.scan(df).collect()]


def test_unknown_licences_are_not_confirmed(rows):
    texts, found = rows
    assert not [r for r in found if r["confirmed"] and texts[r["doc_id"]] in UNKNOWN]


def test_templates_are_confirmed_as_their_family(rows):
    texts, found = rows
    got = {texts[r["doc_id"]]: r["family"] for r in found if r["confirmed"]}
    want = {t: f for f, ts in ls.TEMPLATES.items() for t in ts}
    assert {t: got.get(t) for t in want} == want


def test_wrapped_notices_are_confirmed_where_they_stand(rows):
    texts, found = rows
    for family, notice in WRAPPED.items():
        i = next(k for k, t in enumerate(texts) if t and notice in t)
        hits = [r for r in found if r["doc_id"] == i and r["confirmed"] and r["n_lines"] > 1]
        assert [(r["family"], r["line"], r["text"]) for r in hits] == [(family, 2, notice)]


def test_cover_and_confirmation_by_brute_force(rows):
    def grams(text):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}

    others = set().union(*(grams(t) for t in ls.OTHER))
    for r in rows[1]:
        have, best, fits = grams(r["text"]), 0, False
        alien = others.union(*(grams(t) for f, ts in ls.TEMPLATES.items() if f != r["family"] for t in ts))
        for t in ls.TEMPLATES[r["family"]]:
            g, own = grams(t), grams(t) - alien
            cover = len(g & have) / len(g)
            best = max(best, cover)
            fits |= cover >= ls.MIN_COVER and (not own or len(own & have) / len(own) >= ls.MIN_OWN)
        assert r["cover"] == pytest.approx(best, abs=1e-6) and r["confirmed"] == fits


def test_prose_is_left_alone(rows):
    assert not [r for r in rows[1] if r["doc_id"] < 40]
