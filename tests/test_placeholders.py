"""Numbers past 99,999, expired rows, several placeholders of one value."""

import pytest
from pyspark.sql import functions as F

from maskframe.functions import placeholders as P
from maskframe.operators import mask, policy, vault

VAULT = "tenant_id string, session_id string, type string, value string, placeholder string, expires_at timestamp"
LATER, NOW, PAST = "2100-01-01", "2030-01-01", "2000-01-01"


def stamp(t):
    return F.lit(t).cast("timestamp")


def held(spark, rows):
    return spark.createDataFrame([("t", "s", *r) for r in rows], VAULT.replace("timestamp", "string")).withColumn("expires_at", F.col("expires_at").cast("timestamp"))


@pytest.mark.parametrize("n", [1, 99_999, 100_000, 199_998, 199_999, 99_999 * 70_000 + 5])
def test_every_number_has_one_spelling(spark, n):
    text = P.spell("KISI", n)
    assert P.PLACEHOLDER.fullmatch(text) and P.parts_of(text) == ("KISI", "", n)
    r = spark.range(1).select(P.spelled(F.lit("KISI"), F.lit(n).cast("long")).alias("t")).select("t", P.number(F.col("t")).alias("n"), P.label(F.col("t")).alias("l"), P.suffix(F.col("t")).alias("s")).first()
    assert tuple(r) == (text, n, "KISI", "")


def test_suffixes_of_collisions_have_their_own_numbers(spark):
    own = "#0123456789abcdef"
    assert P.parts_of(f"[IBAN_7]{own}") == ("IBAN", own, 7) and P.spell("IBAN", 100_000, own) is None
    assert P.parts_of("[IBAN_07]") is None
    r = spark.createDataFrame([(f"[IBAN_7]{own}",), ("none",)], "p string").select(P.number(F.col("p")).alias("n"), P.suffix(F.col("p")).alias("s")).collect()
    assert [tuple(x) for x in r] == [(7, own), (None, "")]


def test_no_placeholder_for_two_values(spark):
    old = held(spark, [("PERSON", "a", "[KISI_99999]", LATER), ("PERSON", "b", P.spell("KISI", 100_000), LATER)])
    new = spark.createDataFrame([("t", "s", "PERSON", "KISI", v, i) for i, v in enumerate("cde")], "tenant_id string, session_id string, type string, label string, value string, first_seen int")
    rows = {r.value: r.placeholder for r in old.unionByName(vault.intern(old, new, stamp(LATER), stamp(NOW))).collect()}
    assert len(set(rows.values())) == 5 and [P.parts_of(rows[v])[2] for v in "cde"] == [100_001, 100_002, 100_003]
    text = " ".join(rows[v] for v in "abcde")
    assert mask.restore(text, {p: v for v, p in rows.items()}) == "a b c d e"


def test_allocation_at_the_end_of_the_numbers(spark):
    own = "#0123456789abcdef"
    old = held(spark, [("PERSON", "a", "[KISI_99999]", LATER), ("ORG", "b", f"[KURUM_99999]{own}", LATER)])
    asked = spark.createDataFrame([("t", "s", "[KISI_99999]", 1), ("t", "s", f"[KURUM_99999]{own}", 2), ("t", "s", "no", 3)], "tenant_id string, session_id string, placeholder string, k int")
    assert {r.k: r.given for r in vault.allocate(old, asked, "k").collect()} == {1: P.spell("KISI", 100_000), 2: None, 3: None}


def test_enforce_knows_no_expired_rows(spark):
    text = "Ali ve Veli"
    rows = spark.createDataFrame([(1, "t", "s", text, [("PERSON", 0, 3, "Ali"), ("PERSON", 7, 11, "Veli")])], "id int, tenant_id string, session_id string, text string, mappings array<struct<type:string,start:int,end:int,value:string>>")
    old = held(spark, [("PERSON", "Ali", "[KISI_1]", PAST), ("PERSON", "Veli", "[KISI_9]", LATER), ("PERSON", "Veli", "[KISI_10]", LATER)])
    acted = spark.createDataFrame([("PERSON", "mask")], "type string, action string")
    out, fresh = policy.enforce(rows.withColumn("__m", F.lit(1)), "id", acted, old, stamp(LATER), now=stamp(NOW))
    assert out.first().out_text == "[KISI_11] ve [KISI_10]"
    assert [tuple(r)[3:5] for r in fresh.collect()] == [("Ali", "[KISI_11]")]
    out, fresh = policy.enforce(rows, "id", acted, old, stamp(LATER))
    assert out.first().out_text == "[KISI_1] ve [KISI_10]" and fresh.count() == 0
