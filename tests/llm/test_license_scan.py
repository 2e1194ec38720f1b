"""The licence scan on wordings that training has not seen, and against a plain scan of all paragraphs."""

from collections import Counter

import pytest
from credence.llm import license

SF = "/root/testdata/sf0.001"
#: Wordings in none of the module's frames and notices.
SAID = [
    ("You are welcome to copy these scripts; they come with the MIT License attached.", "mit"),
    ("Copyright 2021 Ana Ruiz. Covered by an MIT-style license (text in COPYING).", "mit"),
    ("All source in this folder may be used by anyone, see the MIT licence at the end.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to use it as they like.", "mit"),
    ("We ship the tool with the Apache License 2.0 so that companies can use it.", "apache-2.0"),
    ("Contributions are accepted under the same Apache License, Version 2.0 as the rest.", "apache-2.0"),
    ("Code: Apache-2.0. Please keep this header in every file.", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at the address below", "apache-2.0"),
    ("The whole package falls under the GNU General Public License v3.0 unless a file says otherwise.", "gpl-3.0"),
    ("Anyone may pass this program on, as GPLv3 allows and demands.", "gpl-3.0"),
    ("this program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3", "gpl-3.0"),
    ("The kernel module is offered to you by the authors under GPL-2.0-only.", "gpl-2.0"),
    ("This driver comes under the GNU General Public License, version 2, and no other.", "gpl-2.0"),
    ("The plug-in interface is covered by the GNU Lesser General Public License.", "lgpl"),
    ("Linking is allowed, the library being under LGPL-2.1.", "lgpl"),
    ("Whoever runs it as a service must share changes: it is under the GNU Affero General Public License.", "agpl-3.0"),
    ("Server code under AGPL-3.0-or-later, client code under the same.", "agpl-3.0"),
    ("These routines are under the 3-clause BSD license, reproduced below.", "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that these two conditions are met", "bsd"),
    ("You get this under a BSD-style license from the university.", "bsd"),
    ("Files from the browser remain under the Mozilla Public License 2.0.", "mpl-2.0"),
    ("If a copy of the MPL was not distributed with this file, you can obtain one from us under MPL 2.0.", "mpl-2.0"),
    ("Photo by K. Lindt, used here under CC BY 4.0 with thanks.", "cc-by"),
    ("Share and adapt this report: it carries a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Maps are offered under CC BY-SA 4.0, so share what you make of them alike.", "cc-by-sa"),
    ("The articles carry a Creative Commons Attribution-ShareAlike 4.0 license.", "cc-by-sa"),
    ("The recordings may be copied under CC BY-NC 4.0 but not sold.", "cc-by-nc"),
    ("Our slides come with a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("The author has dedicated this to the public domain, so do with it as you please.", "public-domain"),
    ("No rights are kept: the data set is under CC0 1.0.", "public-domain"),
    ("Copyright 2018 Weber Verlag. All rights reserved.", "proprietary"),
    ("This document is proprietary and confidential; copies need our consent.", "proprietary"),
    ("Unauthorized copying of these pages by any means is strictly prohibited.", "proprietary"),
]
#: Licences that the module doesn't know, and sentences that state none.
NOT_SAID = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Distributed under the Boost Software License, Version 1.0, see the accompanying file.",
    "You may use this under the Artistic License 2.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Released under the ISC License.",
    "The fonts are under the SIL Open Font License.",
    "Published under the European Union Public Licence.",
    "The database is made available under the Open Database License.",
    "Licensed under the Academic Free License v3.0.",
    "This is under the Microsoft Public License.",
    "Her licence to fish was renewed for two years.",
    "The committee released a new version of the work under its own name.",
    "He crossed the border without a valid license.",
    "Many lawyers have written about the GNU General Public License, version 3.",
    "The history of the MIT License is told in this article.",
    "A table in the hall was reserved for all guests.",
    "mit dem Zug und mit der Bahn fuhr er nach Hause",
    "Er hat die Lizenz zum Fahren seit dem Frühling.",
    "La licence de pêche coûte dix francs par an.",
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return license.train(documents)


def test_no_planted_or_test_line_is_a_template():
    texts = {t.lower().rstrip(".") for texts in license.TEMPLATES.values() for t in texts}
    assert not texts & {t.lower().rstrip(".") for t, _ in SAID}
    assert not texts & {"licensed under the apache license, version 2.0", "released under the mit license", "this work is licensed under the gnu general public license, version 3", "all rights reserved", "licensed under cc by-nc 4.0"}
    assert not {license._clean(n)[0] for n in license.UNSEEN} & {license._clean(n)[0] for n in license.OTHERS} - {"cc", "creative", "open"}


def test_unseen_wordings(model):
    got = [(model.judge(license._clean(t)), f) for t, f in SAID]
    right = sum(j is not None and j.family == f for j, f in got)
    sure = sum(j is not None and j.family == f and j.confirmed for j, f in got)
    wrong = [j for j in (model.judge(license._clean(t)) for t in NOT_SAID) if j is not None]
    found = sum(j is not None for j, _ in got) + len(wrong)
    print(f"recall {right / len(SAID):.3f}, confirmed {sure / len(SAID):.3f}, precision {right / found:.3f}")
    assert right / len(SAID) >= 0.9 and right / found >= 0.9
    # wordings that are only partly a notice's are found without being confirmed
    assert sure >= 0.85 * right
    # a sentence about a licence may name it in full; hardly anything else wrong is confirmed
    assert sum(j.confirmed for j in wrong) <= 1 and not [j for j, f in got if j and j.confirmed and j.family != f]


def plain_scan(model, doc_id, text):
    lines = [license._clean(x) for x in (text or "").split("\n")]
    judged = [model.judge(w) for w in lines]
    out, taken, run = [], set(), []
    for i in range(len(lines) + 1):
        if i < len(lines) and lines[i] and not (judged[i] and judged[i].confirmed):
            run.append(i)
            continue
        if len(run) > 1:
            whole = model.judge([w for k in run for w in lines[k]])
            if whole and whole.confirmed:
                out.append((run[0], whole))
                taken |= set(run)
        run = []
    out += [(i, j) for i, j in enumerate(judged) if j and i not in taken]
    return Counter((doc_id, i, j.family, round(j.probability, 9), round(j.similarity, 9), j.confirmed) for i, j in out)


def test_scan_is_the_plain_scan_of_all_paragraphs(spark, documents, model):
    notice = license.TEMPLATES["apache-2.0"][0]
    long = " ".join(f"word{i % 89}" for i in range(700))
    more = [(900, None), (901, ""), (None, notice), (None, notice), (902, f"{long} {notice} {long}"), (903, f"{long}\n{notice[:60]}\n{notice[60:]}\n\n{long}"), (904, "GPLv3\n\nAll rights reserved.\nMIT License"), (904, "GPLv3"), (905, "\n".join(["Released under the MIT License"] * 3))]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more + [(1000 + i, t) for i, (t, _) in enumerate(SAID)], "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 as lines", "2 as words", "3 as judged", "4 as runs")
    want = Counter()
    for r in docs.collect():
        want += plain_scan(model, r.doc_id, r.text)
    rows = license.scan(docs, model).collect()
    got = Counter((r.doc_id, r.paragraph, r.family, round(r.probability, 9), round(r.similarity, 9), r.confirmed) for r in rows)
    assert got == want and sum(got.values()) > 30
    assert {(r.family, r.confirmed) for r in rows if r.doc_id == 902} == {("apache-2.0", True)}
