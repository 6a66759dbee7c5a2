import textwrap
from pathlib import Path

import duckdb
import pytest

from tests.llm import cases
from tidemark.llm import license_scan
from tidemark.llm.licence_texts import LICENCES

MIT = LICENCES[0][1]


def scan(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), cases.DOCS)
    return [r.license_id for r in license_scan.with_licences(docs, **options).orderBy("doc_id").collect()]


def test_known_texts_and_their_variants(spark):
    shouted = "/*\n * Copyright (c) 2020 Somebody\n * All rights reserved.\n" + MIT.upper().replace(",", " -- ").replace(" ", "   ")
    assert scan(spark, [MIT, shouted, MIT + " unless it rains", "Copyright 1999 X\n\n" + MIT, "Released under the MIT Licence!", "(c) X"]) == ["MIT", "MIT", None, "MIT", "MIT", None]


TITLES = {"MIT": "The MIT License (MIT)", "MIT-0": "MIT No Attribution License", "ISC": "ISC License", "0BSD": "Zero-Clause BSD License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "The 3-Clause BSD Licence"}
HOLDERS = ["Copyright (c) 2019-2021 Somebody Else <a@b.example> and others", "Copyright 2007, The Authors. All rights reserved.", "© 2020 Müller & Co. KG", "Copyright (C) 2001 A\nCopyright (C) 2002 B, C"]
COMMON = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def wrapped(text, width, sign=""):
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
    return "\n".join((sign + line).rstrip() for line in lines)


def test_every_known_text_matches_however_it_is_wrapped_and_headed(spark):
    texts, expected = [], []
    for name, text in LICENCES[:6]:
        for width in range(50, 101):
            holder = HOLDERS[width % len(HOLDERS)]
            head = "\n\n".join([TITLES[name], holder] if width % 3 else [holder])
            texts += [wrapped(f"{head}\n\n{text}", width), wrapped(f"{head}\n\n{text}", width, ["# ", " * ", "// ", "-- "][width % 4]), f"{TITLES[name]}\n{holder}\n" + wrapped(text, width), wrapped(text.replace("sublicense", "sub-licence").replace("advised", "advized"), width)]
            expected += [name] * 4
    assert scan(spark, texts) == expected


@pytest.mark.skipif(not Path("/usr/share/common-licenses").exists(), reason="the published texts are not on this machine")
def test_listed_digests_are_those_of_the_published_texts(spark):
    texts = {name: Path(f"/usr/share/common-licenses/{file}").read_text() for name, file in COMMON.items()}
    signed = ["\n".join(f"# {line}" for line in t.split("\n")) for t in texts.values()]
    assert scan(spark, [*texts.values(), *signed]) == [*texts] * 2


def test_wording_about_copyright_is_kept(spark):
    lost = MIT.replace("The above copyright notice", "The above")
    assert scan(spark, [lost, "copyright notice and this permission notice\n" + MIT, MIT + "\ncopyright holders"]) == [None, None, None]


def test_the_sql_twin_finds_planted_licences_alike(spark, tmp_path):
    rows = [(k, wrapped(f"{HOLDERS[k % 4]}\n\n{text}", 40 + 7 * k, ["", "# "][k % 2])) for k, (_, text) in enumerate(LICENCES)]
    # the two engines lower-case a dotted capital I differently
    rows += [(100 + k, t) for k, (_, t) in enumerate(cases.EDGE) if "İ" not in (t or "")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, cases.DOCS).coalesce(1).write.parquet(path)
    own = duckdb.sql(license_scan.ORACLE_SQL["op5_license_scan"].replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()
    found = license_scan.op5_license_scan(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(own) and sum(r.is_license for r in found) == len(LICENCES)


def test_equivalent_spellings(spark):
    known = [("own", "The licence whilst organised by the centre may be sub-licensed; the copyright owner shall favour per cent fulfilment.")]
    same = "the LICENSE while organized by the center may be sublicensed the copyright holder shall favor percent fulfillment"
    other = "the license while organized by the center may be sublicensed the copyright holder shall favor percent anything"
    assert scan(spark, [same, other], licences=known) == ["own", None]


def test_texts_beyond_ascii_keep_their_letters(spark):
    assert scan(spark, [MIT + " 中文", "“" + MIT + "”"]) == [None, "MIT"]


def test_edge_cases(spark):
    found = license_scan.with_licences(cases.edge(spark, extra=True))
    assert found.count() == len(cases.EDGE) and found.where("is_license").count() == 0
    assert license_scan.with_licences(cases.empty(spark)).collect() == []
    assert license_scan.with_licences(cases.edge(spark), [("blank", " "), ("b", "ONE"), ("a", "one.")]).where("is_license").select("doc_id", "license_id").collect() == [(4, "a")]


def test_known_digests_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(license_scan.common.lookup_side, "__defaults__", (0,))
    assert scan(spark, [MIT, "x"]) == ["MIT", None]


def test_the_plan_has_no_python(spark, tiny):
    plan = license_scan.op5_license_scan(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
