from palimpsest.llm import license_texts, licenses

MIT = license_texts.TEXTS["MIT"]
ROWS = [
    (1, "Copyright (c) 2019 Somebody\nAll rights reserved.\n\n" + MIT.upper()),
    (2, MIT.replace("sublicense", "sublicence").replace(",", "\n;")),
    (3, MIT + " And more."),
    (4, None),
    (5, ""),
    (None, "Released under the MIT Licence!"),
    (6, "some prose\n  Licensed under CC BY-NC 4.0.\nmore\nSPDX-License-Identifier: Apache-2.0\nLicensed under CC BY-NC 4.0"),
    (7, "Licensed under nothing.\n" * 20_000),
    (7, "Licensed under nothing.\n" * 20_000),
]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.text_license, r.n_notices, r.notice_licenses) for r in licenses.scan(df).collect()), key=str)
    want = [(1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (None, "MIT", 1, "MIT"), (6, None, 3, "Apache-2.0,CC-BY-NC-4.0"), (7, None, 0, ""), (7, None, 0, "")]
    assert got == sorted(want, key=str)


def test_entire_texts_of_every_kind(spark):
    import hashlib
    import os

    texts = [(spdx, "(c) 1999 X\n" + text.lower()) for spdx, text in license_texts.TEXTS.items()]
    # Long ones are known by digest; where a system keeps their texts, these are found.
    files = {"Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "CC0-1.0": "CC0-1.0"}
    texts += [(spdx, open(f"/usr/share/common-licenses/{f}").read()) for spdx, f in files.items() if os.path.exists(f"/usr/share/common-licenses/{f}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in licenses.scan(df).collect()}
    assert got == {i: spdx for i, (spdx, _) in enumerate(texts)}
    digests = [d for every in license_texts.DIGESTS.values() for d in every]
    assert len(set(digests)) == len(digests) and all(len(bytes.fromhex(d)) == hashlib.sha256().digest_size for d in digests)


def test_notices_pass_the_first_look():
    import re

    assert all(re.search(licenses.MAY_BE_NOTICE, text) for _, text in license_texts.notices())


def test_empty_table_and_no_python(spark):
    df = licenses.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
