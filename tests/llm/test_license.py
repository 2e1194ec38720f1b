"""Notices that are wrapped over lines."""

import textwrap

from credence.llm import license

GPL = license.TEMPLATES["gpl-3.0"][1]
MIT = license.TEMPLATES["mit"][2]
BSD = license.TEMPLATES["bsd"][1]


def test_wrapped_notices_are_confirmed(spark):
    wrapped = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 50))
    rows = [(i, f"A title\n\n{wrapped(t)}\n\nAnd more.") for i, t in enumerate((GPL, MIT, BSD))]
    rows += [(3, f"SPDX-License-Identifier: MIT\n{wrapped(GPL)}"), (None, wrapped(GPL)), (4, "The driver must show\na valid license at\nthe border."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordinary = [f"The {a} of the {b} was seen near the old {c} that day." for a in ("road", "river", "house") for b in ("town", "king") for c in ("mill", "tree")]
    model = license.fit(license.labelled(ordinary))
    got = {(r.doc_id, r.paragraph, r.family) for r in license.scan(docs, model).collect() if r.confirmed}
    assert got == {(0, 2, "gpl-3.0"), (1, 2, "mit"), (2, 2, "bsd"), (3, 0, "mit"), (3, 1, "gpl-3.0"), (None, 0, "gpl-3.0")}
