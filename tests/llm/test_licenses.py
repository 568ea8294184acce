import os
import re

import pytest
from strandloom.llm import licenses

from .helpers import corpus, docs


def found(spark, texts, **more):
    rows = [(i, t, "", "", 0, 0, "", "") for i, t in enumerate(texts)]
    return {r.doc_id: r.license for r in licenses.scan(docs(spark, rows), **more).collect()}


def test_every_known_text_is_found_in_other_spellings(spark):
    names = sorted(licenses.LICENSES)
    texts = [licenses.LICENSES[n] for n in names]
    changed = ["\r\n".join(["Copyright (c) 2019-2024 Some One", "# (C) 2020 Another", *t.replace("acknowledgment", "acknowledgement").replace("sublicense", "sub-licence").upper().split("\n")]) + "\n\n" for t in texts]
    assert list(found(spark, texts).values()) == names
    assert list(found(spark, changed).values()) == names


def test_parts_and_awkward_texts_are_unknown(spark):
    mit = licenses.LICENSES["MIT"]
    assert set(found(spark, [mit[:-40], mit + " And more.", None, "", "许可", "Copyright 2020 X"]).values()) == {None}
    got = licenses.scan(docs(spark)).collect()
    assert len(got) == len(corpus()) and licenses.scan(docs(spark, [])).count() == 0


def test_a_registry_table(spark):
    registry = licenses.digests(spark.createDataFrame([("ours", "Our Licence, v1")], "license string, text string")).select("license", "canonical_sha256")
    assert found(spark, ["our license v1", "x"], registry=registry) == {0: "ours", 1: None}


def test_notices_on_their_own_line(spark):
    texts = ["Some text.\nReleased under the MIT Licence.\nMore.\nLICENSED under the apache license version 2.0\nReleased under the MIT License.", "x Released under the MIT License.", None]
    rows = [(i, t, "", "", 0, 0, "", "") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.license, r.line_licenses) for r in licenses.report(docs(spark, rows)).collect()}
    assert got == {0: (None, "Apache-2.0 (line),MIT (line)"), 1: (None, ""), 2: (None, "")}


def test_entire_texts_and_their_parts(spark):
    part = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    middle = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    as_is = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    whole = "\n\n".join([part, middle, as_is, "For more information, please refer to <http://unlicense.org/>"])
    assert found(spark, [whole, part]) == {0: "Unlicense", 1: "Unlicense (part)"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_entire_texts_of_common_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"/usr/share/common-licenses/{f}", encoding="utf8").read() for f in files.values()]
    assert list(found(spark, texts).values()) == list(files)
    assert set(found(spark, [t[: len(t) // 2] for t in texts]).values()) == {None}
    terms = texts[0].split("APPENDIX")[0]
    assert found(spark, [terms]) == {0: "Apache-2.0"}


def test_texts_on_one_line_without_the_word_licence(spark):
    names = ["0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense (part)"]
    texts = ["Some text.\n" + licenses.LICENSES[n].removeprefix("Copyright (c) <year> <holder>\n").replace("\n", " ") + "\nMore." for n in names]
    rows = [(i, t, "", "", 0, 0, "", "") for i, t in enumerate(texts)]
    assert {r.doc_id: r.line_licenses for r in licenses.report(docs(spark, rows)).collect()} == dict(enumerate(names))
    assert all(re.search(licenses.WORDS, t) for t in licenses.LICENSES.values())
