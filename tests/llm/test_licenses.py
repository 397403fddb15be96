import random
import re

import pytest

from millrace.llm import licenses

GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""
CASES = {"gpl-notice": GPL, "apache-notice": APACHE, "mit-grant": MIT, "bsd": BSD, "mpl-2.0": MPL}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped(sp, mark):
    rows = [(i, "int x;\n" + "\n".join(mark + x for x in t.split("\n")) + "\nint y;") for i, t in enumerate(CASES.values())]
    got = {r.doc_id: r for r in licenses.scan(sp.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(CASES):
        assert label in got[i].found and got[i].score >= 0.8, label


def test_not_wrapped(sp):
    """Words of a template in two paragraphs, or far apart, are no notice."""
    far = ("filler words stand here\n" * 9).join(["Released here\n", "under the\n", "MIT so\n", "license"])
    scattered = " ".join(f"{w} filler stands here" for w in BSD.split())
    rows = [(0, BSD.replace("\n", "\n\n")), (1, far), (2, ""), (3, scattered * 30), (4, "wor\u212a " * 9)]
    got = licenses.scan(sp.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(not r.found and r.score == 0 for r in got)


def test_against_all_passages(sp):
    """Every window of every paragraph, held against every template."""
    rng = random.Random(2)
    words = sorted({w for t in licenses.TEMPLATES for w in t.split(" ")})
    rows = []
    for i in range(120):
        t = rng.choice(list(licenses.TEMPLATES)).split(" ")
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice([*words, "other"])
        noise = [rng.choice([*words[:9], "x", "y"]) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice(["", " \n- "]).join(w + rng.choice([" ", ", ", "\n# ", " "]) for w in [*noise, *t, *noise]) + rng.choice(["", "\n\nthe end"])))
    got = {r.doc_id: r for r in licenses.scan(sp.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        best = {}
        for para in re.split(r"(?:^|\n)[^a-z0-9\n]*(?=\n|$)", text):
            stream = re.findall("[a-z0-9]+", para)
            for t, label in licenses.TEMPLATES.items():
                of = set(t.split(" "))
                for a in range(len(stream)):
                    c = len(of & set(stream[a : a + len(t.split(" "))])) / len(of)
                    if c >= 0.8 - 1e-9:
                        best[label] = max(best.get(label, 0), c)
        assert set(got[i].found) - set(licenses.PHRASES.values()) == set(best) - set(licenses.PHRASES.values()), text
        assert got[i].score == pytest.approx(max(best.values(), default=0))
