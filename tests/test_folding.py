"""Compatibility forms in licence numbers, against Unicode's own folding."""

from __future__ import annotations

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from attestry.functions import text


def plain_number(value: str) -> str | None:
    clean = unicodedata.normalize("NFKC", value).strip(" \t\n\r\f\v")
    if re.search(r"[A-Za-z0-9]{9,}\s+(?:OR|AND|VS)\s+[A-Za-z0-9]{9,}", clean, re.I | re.A):
        return None
    if re.search(r"[^A-Za-z0-9\s\-_/.]", clean, re.A):
        return None
    return re.sub(r"[ \t\n\r\f\v\-_/.]", "", clean).upper() or None


def test_every_compatibility_form_gives_the_number_of_its_folding(spark):
    changed = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    rng = random.Random(5)
    plain = "KA01 20110012345-/._"
    mixed = ["".join(rng.choice(rng.choice((plain, changed))) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    marks = ["ÁKA", "KÁ", "ﬁ́", "Ⅷ‍", "é", "漢", "", " ", "ＫＡ０１　２０１１", "ABCDEFGHI ＯＲ ABCDEFGHJ"]
    values = [f"KA{c}7" for c in changed] + mixed + marks
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.licence_number(F.col("v")).alias("n"))
    assert {r.v: r.n for r in rows.collect()} == {v: plain_number(v) for v in values}
    assert plain_number("ﬁ Ⅷ ⑩ x² ｋａ") == "FIVIII10X2KA"
    assert spark.sql("SELECT CAST(NULL AS STRING) AS v").select(text.licence_number(F.col("v"))).first()[0] is None
