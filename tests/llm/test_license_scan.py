"""Licence notices that differ in words without a legal stem, short ones, and wrapped ones."""

from leafmark.llm import license_scan

CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."


def families(spark, texts):
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {(r.doc_id, r.paragraph): r.family for r in found}


def test_creative_commons_kinds_are_told_apart(spark):
    got = families(spark, [CC.format(x) for x in ("", "-NonCommercial", "-ShareAlike", "-NoDerivatives")])
    assert [got[i, 0] for i in range(4)] == ["cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nd"]


def test_short_notices_have_rows(spark):
    lines = ["Released under GPLv3.", "Distributed under LGPL-2.1", "Released under the MIT terms.", "MPL 2.0", "Released under AGPLv3.", "Released under the ISC terms."]
    got = families(spark, lines)
    assert [got[i, 0] for i in range(5)] == ["gpl", "lgpl", "mit", "mpl-2.0", "agpl"] and (5, 0) in got


def test_wrapped_and_surrounded_notices(spark):
    wrapped = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International\nLicense.\n\nplain text"
    comment = "# Licensed under the Apache License,\n# version 2.0 (the License); you may not use this file except in compliance\n# with the License."
    prose = "the day was long and the people of the town said that it was good " * 4
    got = families(spark, [wrapped, comment, prose + "Licensed under the MIT license. " + prose, "license qqq zzz", "an example of simple things", "licensed under qqq"])
    assert got == {(0, 0): "cc-by-nc", (1, 0): "apache-2.0", (2, 0): "mit", (3, 0): "unknown", (5, 0): "unknown"}


OTHERS = ["Licensed under the EUPL, Version 1.2.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: Ruby", "Licensed under the Sleepycat License."]


def test_other_licences_confirm_no_family(spark):
    found = license_scan.scan(spark.createDataFrame(list(enumerate(OTHERS)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.family, r.confirmed) for r in found} == {i: ("unknown", False) for i in range(len(OTHERS))}


def test_a_sentence_about_two_licences_is_no_notice(spark):
    (row,) = license_scan.scan(spark.createDataFrame([(1, "The Apache License is often compared with the MIT License.")], "doc_id long, text string")).collect()
    assert not row.confirmed


def test_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "Released under the MIT License.", "a", 0.5)] * 2 + [(2, "Released under the MIT License.", "b", 0.1)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, family string, probability double")).collect()
    assert sorted((r.doc_id, r.family, r.confirmed) for r in found) == [(1, "mit", True), (2, "mit", True)]
