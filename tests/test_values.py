import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.functions import scalars as S

NUMBERS = [("349.000 €", 349000.0), ("349.000,50", 349000.5), ("1,200.50", 1200.5), ("72,5 m²", 72.5), ("72.5", 72.5), ("1,200,000", 1200000.0), ("-5", -5.0), ("3 4", 34.0), ("none", None), ("1'250", 1250.0), ("", None), (None, None), ("１９５６", 1956.0)]


@pytest.mark.parametrize(("raw", "want"), NUMBERS)
def test_numbers(raw, want):
    assert S.parse_number(raw) == want


def test_native_numbers_as_scalar(spark):
    df = spark.createDataFrame(NUMBERS, "raw string, want double")
    assert df.where(~N.parse_number(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


REASONS = [("", "EMPTY"), (None, "EMPTY"), ("x" * 501, "TOO_LONG"), ("soon", "TYPE_MISMATCH"), ("5 €", "BELOW_MIN"), ("999.999 €", "ABOVE_MAX"), ("350 €", "OK"), ("349000", "TYPE_MISMATCH")]


def test_validate_reasons(spark):
    spec = {"type": "price", "min": 10, "max": 1000}
    df = spark.createDataFrame(REASONS, "raw string, want string")
    got = {r["raw"]: r["r"] for r in df.select("raw", N.validate(F.col("raw"), "price", 10, 1000).reason.alias("r")).collect()}
    for raw, want in REASONS:
        assert S.validate(raw, spec)[2] == want
        assert got[raw] == want
    assert S.validate("349000", {"type": "price"}, True)[:2] == (True, 349000.0)
    assert S.validate("x", {"type": "text", "pattern": "("})[2] == "INVALID_PATTERN"


@given(st.text(max_size=60))
def test_fold_is_idempotent(t):
    assert S.fold(S.fold(t)) == S.fold(t) or "&" in t


SCOPES = [("https://www.Shop.example/Expose/12345?x=1", "shop.example/expose/*"), ("https://shop.example/", "shop.example/"), ("", "inline"), ("https://a.example/b/c.html", "a.example/b/c"), ("https://a.example/the-very-long-name-of-a-page/x", "a.example/*/x"), ("https://a_b.example/q|r", "a_b.example/q|r")]


def test_scopes(spark):
    df = spark.createDataFrame(SCOPES, "u string, want string")
    for r in df.select("u", "want", N.scope_of(F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"] == S.scope_of(r["u"])


def test_markers(spark):
    urls = [("https://a.example/l?page=3&x=1", "page", 3, "https://a.example/l?page={page}&x=1"), ("https://a.example/seite/4/", "page", 4, "https://a.example/seite/{page}/"), ("https://a.example/l?offset=20", "offset", 20, "https://a.example/l?offset={offset}"), ("https://a.example/l", None, None, None)]
    from pageloom.functions.paging import marker

    df = spark.createDataFrame(urls, "u string, kind string, value long, template string")
    m = N.marker(F.col("u"))
    for r in df.select("*", m.kind.alias("k"), m.value.alias("v"), N.template(F.col("u"), m).alias("t")).collect():
        assert (r["k"], r["v"], r["t"]) == (r["kind"], r["value"], r["template"])
        assert (marker(r["u"]) or (None, None, None)) == (r["kind"], r["value"], r["template"])


def test_field_specs():
    assert S.field_spec("area")["aliases"] == ["area"]
    for raw, code in (({}, "FIELD_INVALID"), ({"name": "a", "type": "color"}, "FIELD_TYPE_UNKNOWN"), ({"name": "a", "min_provenance": "x"}, "FIELD_INVALID")):
        with pytest.raises(S.FieldError) as e:
            S.field_spec(raw)
        assert e.value.code == code
    with pytest.raises(S.FieldError):
        S.field_specs(["a", "a"])
    with pytest.raises(S.FieldError):
        S.field_specs([])


def test_flatten():
    assert S.flatten(S.load_json('<!--{"a":[{"b":1},{"b":null,"c":true}],"@graph":{"d":"x"}}-->')) == [("a.b", 1), ("d", "x")]
    assert S.load_json("{broken") is None


def test_counts_and_ranks_are_whole(spark, tmp_path):
    from pageloom.plans import portfolio, values

    spark.createDataFrame([(1, "de", "Haus haus See"), (2, "en", "see")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["lang"], r["token"]): r["n"] for r in values.q_token_counts(spark, str(tmp_path)).collect()}
    assert got == {("de", "haus"): 2, ("de", "see"): 1, ("en", "see"): 1}
    spark.createDataFrame([(i, 7 + 50 * i, 20.0 if i % 2 else 1.0, "view") for i in range(9)], "event_id long, user_id long, value double, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    ranks = sorted((r["rank"], r["id"]) for r in portfolio.w_ranked(spark, str(tmp_path)).collect())
    assert ranks == list(zip(range(1, 10), (1, 3, 5, 7, 0, 2, 4, 6, 8), strict=True))
