import re
from pathlib import Path

import pytest

from quire.llm import licenses as op


def test_scan(spark):
    mit = dict((n, t) for n, t in reversed(op.KNOWN) if len(t) > 800)["MIT"]
    odd = "Copyright (c) 2024 Some One\nAll rights reserved.\n\n" + mit.replace("merchant", "MERCHANT").replace(",", " ,\n").replace('"', "'").replace("sublicense", "sub-licence")
    rows = [(1, mit), (2, odd), (3, odd + " but not quite"), (4, None), (5, ""), (6, "Words.\nReleased under the MIT licence\nmore\n  LICENSED under CC BY-NC 4.0!\nReleased under the MIT License."), (6, "a"), (None, "x" * 100_000), (7, "Copyright © 2020 X\nReleased under the MIT License.")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, license string")
    out = op.scan(df)
    assert set(out.columns) == {"doc_id", "text", "license", "license_digest", "notices"}
    got = [(r.doc_id, r.text, r.license, r.notices) for r in out.collect()]
    assert len(got) == len(rows)
    by = {(d, t): (lic, n) for d, t, lic, n in got}
    assert by[1, mit] == by[2, odd] == ("MIT", [])
    assert by[3, rows[2][1]][0] is None and by[4, None] == by[5, ""] == by[6, "a"] == (None, [])
    assert by[6, rows[5][1]] == (None, ["CC-BY-NC-4.0", "MIT"]) and by[7, rows[8][1]] == ("MIT", ["MIT"])
    assert op.scan(df.limit(0)).count() == 0


def test_known_texts_are_apart_and_plan_is_native(spark):
    digests = op.known_digests(spark).collect()
    assert len({r.digest for r in digests}) == len(digests) >= 20
    plan = op.scan(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_further_digests_are_those_of_the_texts(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = [(n, (folder / f).read_text().upper().replace("\n", "\n ")) for n, f in files.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence texts on this machine")
    assert {(r.n, r.license) for r in op.scan(spark.createDataFrame(rows, "n string, text string")).collect()} == {(n, n) for n, _ in rows}


def test_notices_of_any_wording_are_found(spark):
    known = [("A", "Free for any use under CC0 1.0"), ("B", "Licensed as is"), ("C", "Take it."), ("D", "© c")]
    df = spark.createDataFrame([(1, "x\nfree for ANY use, under cc0 1.0!"), (2, "take it\nLicenced as is"), (3, "give it"), (4, "(c) c")], "n int, text string")
    assert {r.n: r.notices for r in op.scan(df, known=known).collect()} == {1: ["A"], 2: ["B", "C"], 3: [], 4: ["D"]}
    assert op.gate_words(["© c"]) is None and op.gate_words([]) == []
    assert all(set(op.gate_words([t])) & set(re.findall("[a-z0-9]+", t.lower())) for _, t in op.KNOWN if "\n" not in t)
