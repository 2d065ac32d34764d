import hashlib
import hmac
import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlens.functions import hashing, money, text


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def dec(x):
    return F.lit(x).cast("decimal(18,4)")


def test_half_up_and_exact_round_trip(spark):
    r = one(spark, a=money.quantize(dec("2.005")), b=money.to_paise(dec("1234.565")), c=money.from_paise(F.lit(41000000).cast("bigint")),
            d=money.to_paise(F.lit(None).cast("decimal(18,2)")), e=money.from_paise(F.lit(None).cast("bigint")))
    assert (r.a, r.b, r.c, r.d, r.e) == (Decimal("2.01"), 123457, Decimal("410000.00"), 0, Decimal("0.00"))


def test_rupees_groups_by_lakh(spark):
    r = one(spark, a=money.rupees(dec("123456")), b=money.rupees(dec("-1234567.5")), c=money.rupees(F.lit(None).cast("decimal(18,2)")),
            d=money.rupees(dec("999.5")), e=money.rupees(dec("123456.785"), paise=True), f=money.rupees(dec("12")))
    assert list(r) == ["₹1,23,456", "-₹12,34,568", "—", "₹1,000", "₹1,23,456.79", "₹12"]


def test_parse_amount(spark):
    r = one(spark, a=money.parse_amount(F.lit("\t₹ 1,23,456.50 ")), b=money.parse_amount(F.lit("")), c=money.parse_amount(F.lit("n/a"), "1"),
            d=money.parse_amount(F.lit(None).cast("string"), "3"))
    assert [float(x) for x in r] == [123456.5, 0, 1, 3]


def test_division_rounds_once(spark):
    cases = [(n, d) for n in (-2500, -25, -5, 0, 5, 15, 25, 35, 12345) for d in (1, 3, 7, 10, 1000)]
    rows = spark.createDataFrame(cases, "n bigint, d bigint").select(
        "n", "d", money.div_half_even(F.col("n"), F.col("d")).alias("e"), money.div_half_up(F.abs("n"), F.col("d")).alias("u")).collect()
    for r in rows:
        assert r.e == int((Decimal(r.n) / r.d).quantize(Decimal(1), ROUND_HALF_EVEN)), r
        assert r.u == int((Decimal(abs(r.n)) / r.d).quantize(Decimal(1), ROUND_HALF_UP)), r


def test_pseudonym_is_hmac(spark):
    r = one(spark, a=hashing.pseudonymise(F.lit("CLM-1"), "pepper"), b=hashing.pseudonymise(F.lit("ä"), "x" * 80))
    assert r.a == hmac.new(b"pepper", b"CLM-1", hashlib.sha256).hexdigest()[:24]
    assert r.b == hmac.new(b"x" * 80, "ä".encode(), hashlib.sha256).hexdigest()[:24]


def test_fingerprint_ignores_key_order(spark):
    r = one(spark, a=hashing.request_fingerprint(x=F.lit(1), y=F.lit("b")), b=hashing.request_fingerprint(y=F.lit("b"), x=F.lit(1)),
            c=hashing.request_fingerprint(x=F.lit(2), y=F.lit("b")))
    assert r.a == r.b != r.c


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=700), min_size=1, max_size=6))
def test_chunks_keep_the_text(spark, parts):
    whole = "x\n" + "\n".join(p * 3 for p in parts)
    pieces = one(spark, p=text.chunk_text(F.lit(whole), 1200)).p
    assert "".join(pieces).rstrip() == whole.rstrip()
    assert all(len(p) <= 1200 or "\n" not in p[:-1] for p in pieces)
    assert all(p.endswith("\n") for p in pieces[:-1])


def test_money_mentions(spark):
    assert one(spark, m=text.money_mentions(F.lit("Rs. 1,234.50, 12 days, ₹99999 and 10%"))).m == ["1,234.50", "99999"]


def test_products_are_exact_on_both_paths(spark):
    rng = random.Random(3)
    cases = [(rng.randrange(10 ** rng.randrange(1, 18)), rng.randrange(10 ** rng.randrange(1, 11)), 1 + rng.randrange(10 ** rng.randrange(1, 11))) for _ in range(300)]
    cases += [(4 * 10**10, 10**8, 10**8), (4 * 10**10 + 1, 10**8, 1), (5, 1, 2), (0, 7, 3)]
    rows = spark.createDataFrame(cases, "a bigint, b bigint, d bigint").where("a / d * b < 9e17").select(
        "a", "b", "d", money.product_div_half_up(F.col("a"), F.col("b"), F.col("d"), 4 * 10**10, 10**8).alias("v")).collect()
    assert len(rows) > 100 and all(r.v == (2 * r.a * r.b + r.d) // (2 * r.d) for r in rows)
