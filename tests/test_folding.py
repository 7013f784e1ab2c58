"""Names and titles of all scripts against Unicode's own forms."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from larkspur.functions import extract, text

WORDS = ["Ştefan Inc", "ﬁne ﬂow Ltd", "Ａｃｏｒｎ　Ｌａｂｓ", "Ⅷ Partners", "𝐁old 𝒲ork", "Ångström & Søn", "Café Co", "№ 5", "㎏ scale", "Đuro", "x² + ½", "İstanbul", "Ĳssel", "東京 Tokyo", "", None]


def plain_terms(value):
    value = unicodedata.normalize("NFKD", value)
    return [w for w in re.split("[^a-z0-9]+", "".join(c for c in value if not "̀" <= c <= "ͯ").lower()) if w]


def test_terms_equal_unicode(spark):
    rng = random.Random(9)
    alphabet = [chr(k) for k in (*range(0x20, 0x600), *range(0x1E00, 0x2200), *range(0x2460, 0x2500), *range(0x3200, 0x3400), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFF60), *range(0x1D400, 0x1D7FF)) if unicodedata.category(chr(k))[0] not in "C"]
    said = [w for w in WORDS if w is not None] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(said)), "n int, said string")
    got = [r[0] for r in rows.orderBy("n").select(text.terms(F.col("said"))).collect()]
    wrong = [(s, g, plain_terms(s)) for s, g in zip(said, got) if g != plain_terms(s)]
    assert wrong == []


def test_titles_to_show(spark):
    rows = spark.createDataFrame([("🚀 Ｄａｔａ  Ｉｎｔｅｒｎ ﬁrst",), ("Ştefan’s Praktikum",), (None,)], "said string")
    got = [tuple(r) for r in rows.select(extract.display_title(F.col("said")), extract.search_title(F.col("said"))).collect()]
    assert got[0][0] == "Data Intern first" and got[1] == ("Ştefan’s Praktikum", "stefan s praktikum") and got[2] == (None, None)
