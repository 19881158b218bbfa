"""Rules on literal rows the driver's tables do not contain."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions import calendar as cal
from retailoom.functions import casts, numbers, places, text
from retailoom.operators import lists, prospects, staging


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_safe_casts(spark):
    raw = ["12,5", "", "abc", "2.0", " 7 ", "-3", "1e3", None]
    assert values(spark, raw, casts.safe_double) == [None, None, None, 2.0, 7.0, -3.0, 1000.0, None]
    assert values(spark, raw, casts.safe_long) == [None, None, None, None, 7, -3, None, None]
    assert [None if d is None else float(d) for d in values(spark, raw, lambda c: casts.safe_decimal(c, 12, 2))][3:6] == [2.0, 7.0, -3.0]


def test_safe_date(spark):
    raw = ["2024-02-30", "2024-02", "2024-02-03 00:00:00", "2024-2-3", "", "03/02/2024", None]
    assert values(spark, raw, casts.safe_date) == [None, None, date(2024, 2, 3), date(2024, 2, 3), None, None, None]


def test_booleans(spark):
    raw = ["True", "true", "1", "False", "0", "yes", None]
    assert values(spark, raw, casts.safe_bool) == [True, True, True, False, False, None, None]
    assert values(spark, raw, casts.active_flag) == [True, True, True, False, False, False, None]


def test_normalize_name(spark):
    raw = ["Dupont S.A.R.L.", "ABC SASU 2021", "A-B_C/D", "Élan Mode EI", "", None, "SA", "Le Bois SL  "]
    assert values(spark, raw, text.normalize_name) == [
        "DUPONT", "ABCSASU2021", "ABCD", "ÉLANMODE", "", None, "SA", "LEBOIS"]
    # the legal form is looked for before the year goes, so it stays in front of a year
    assert values(spark, raw, lambda c: text.normalize_name(c, strip_year=True))[1] == "ABCSASU"


def test_department_codes(spark):
    zips = ["97411", "20090", "20200", "20990", "1000", "75", "4A000", " 69001", None, "97"]
    assert values(spark, zips, places.dept_code_customer) == ["974", "20", "20", "20", "10", None, "4A", " 6", None, "97"]
    assert values(spark, zips, places.dept_code_geo) == ["974", "20", "20", "20", "10", "75", None, "69", None, "97"]
    assert values(spark, zips, places.dept_code_register) == ["974", "2A", "2B", "2A", "10", None, "4A", " 6", None, "97"]


def test_countries(spark):
    assert values(spark, ["", None, "ES"], places.country_default) == ["FR", "FR", "ES"]
    assert values(spark, ["COT", "ISR", "COL", "BE", None], places.country_fix) == ["CI", "IL", "CO", "BE", None]
    assert values(spark, ["FR", "GP", "ES", None], places.in_france) == [True, True, False, True]
    df = spark.createDataFrame([("ES",), ("ZZ",)], "country_iso_code string")
    assert sorted(map(tuple, places.with_country_labels(df).collect())) == [("ES", "ESP", "Espagne"), ("ZZ", "ZZ", "ZZ")]
    listed = {r.iso2: r.country_name for r in places.foreign_countries(spark).collect()}
    assert len(listed) >= 235 and not set(listed) & set(fixed.FRANCE_GROUP)
    assert listed["ES"] == "Espagne" and listed["BR"] == "Brésil" and listed["CN"] == "Chine"


def test_garments(spark):
    raw = ["petite Robe", "pantacourt", "pant 7/8", "TOPAZE", "top", "sacs", "sachet", "sac à dos", "débardeur", "MANTE", None]
    assert values(spark, raw, text.classify_keywords) == [
        "ROBE", "AUTRE", "PANTALON", "AUTRE", "TOP", "SAC", "AUTRE", "SAC", "AUTRE", "MANTEAU", "AUTRE"]
    assert values(spark, ["une blouse", "rien", None], text.classify_words) == ["BLOUSE", None, None]


def test_tags_and_boundaries(spark):
    raw = ["LA ROBE D'ELLE", "ÉELLE", "Dépôt-vente", "DEPOT-VENTE", "mini women XXL", "", None]
    assert values(spark, raw, text.keyword_tags) == [
        ["femme"], ["femme"], [], ["friperie"], ["femme", "enfant", "grande_taille"], [], []]


def test_chain_flag(spark):
    from retailoom import seed_values

    names = ["H & M PARIS", "MIMOSA", "MIM", "LEVIS STORE", "LEVI'S", "C & A", "CAVA", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(prospects.chain_flag("n", seed_values.chain_rows())).collect()]
    assert got == [True, False, True, True, True, True, False, False]


def test_general_patterns_keep_their_boundaries(spark):
    assert values(spark, ["A &", "B"], lambda c: c.rlike(text.whole_words("&|B"))) == [False, True]


def test_seasons(spark):
    days = [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 1), date(2024, 8, 31), date(2024, 9, 1), date(2024, 12, 31)]
    want = ["AH_2023", "AH_2023", "SS_2024", "SS_2024", "AH_2024", "AH_2024"]
    assert values(spark, days, cal.season_label, "date") == want
    assert [cal.season_of(d) for d in days] == want
    for day, label in zip(days, want):
        first, last = cal.season_bounds(label)
        assert first <= day <= last
    assert cal.previous_season("AH_2023") == "AH_2022"
    assert cal.season_bounds("AH_2023")[1] == date(2024, 2, 29)


def test_ranges():
    today = date(2024, 5, 31)
    assert cal.months_before(today, 3) == date(2024, 2, 29)
    assert cal.date_range(30, today) == (date(2024, 5, 1), today)
    assert cal.date_range(31, today)[0] == date(2024, 3, 2)  # not allowed: 90 days
    assert cal.date_range(0, today, allowed=fixed.RANGE_DAYS_MONTHLY)[0] == cal.BEGINNING
    assert cal.date_range(30, today, "2024-06-10", "2024-01-01") == (date(2024, 1, 1), today)
    assert cal.date_range(30, today, "2024-13-10", "2024-01-01")[0] == date(2024, 5, 1)
    with pytest.raises(ValueError):
        cal.period_filter("d", today, 5)
    with pytest.raises(ValueError):
        cal.shop_list("XXX")
    assert cal.shop_list("ALL") == ["SED", "HIP"]


def test_rounding_and_ratios(spark):
    raw = [2.5, -2.5, 0.125, -0.001, None]
    assert values(spark, raw, lambda c: numbers.half_up(c, 0), "double") == [3.0, -3.0, 0.0, 0.0, None]
    assert values(spark, raw, lambda c: numbers.half_up(c, 2), "double")[2] == 0.13
    assert values(spark, [0.0, 4.0, None], lambda c: numbers.ratio(F.lit(2.0), c), "double") == [None, 0.5, None]
    df = spark.createDataFrame([(0.1,)] * 10, "v double")
    assert df.agg(numbers.exact_sum("v")).collect()[0][0] == 1.0


def test_bands(spark):
    assert values(spark, [10, 40, 69, 70, None], lists.sell_through_band, "int") == ["faible", "moyen", "moyen", "bon", None]
    assert values(spark, [-6, -5, 0, 5, 6], lambda c: lists.trend_band(c, 5), "int") == [
        "baisse", "stable", "stable", "stable", "hausse"]
    assert values(spark, [29, 30, 90, 91, None], lists.register_freshness, "int") == ["vert", "amber", "amber", "rouge", "gris"]
    with pytest.raises(ValueError):
        numbers.band("x", (1, 2), ("a",))


def test_natural_order(spark):
    df = spark.createDataFrame([("A10",), ("A9",), ("a1",), (None,)], "v string")
    assert [r[0] for r in lists.sort_natural(df, "v", "asc").collect()] == ["a1", "A9", "A10", None]
    assert [r[0] for r in lists.sort_natural(df, "v", "desc").collect()] == ["A10", "A9", "a1", None]


def test_company_keys(spark):
    rows = [
        ("HIP", "1", "Mode SARL", "123 456 789", None),
        ("SED", "2", "MODE", "123456789", None),
        ("HIP", "3", "X", "12345678", "FR123456"),
        ("HIP", "4", "X", None, "FR12345"),
        ("HIP", "5", "Un", "999999999", None),
        ("SED", "6", "Deux", "999999999", None),
        ("SED", "7", None, None, "fr 12 34 56"),
    ]
    df = spark.createDataFrame(rows, "boutique_id string, id string, name string, siren string, vat_number string")
    got = {r.id: r.unified_key for r in staging.resolve_entities(df).collect()}
    assert got == {
        "1": "SIREN:123456789", "2": "SIREN:123456789", "3": "FALLBACK:HIP|3", "4": "FALLBACK:HIP|4",
        "5": "FALLBACK:HIP|5", "6": "FALLBACK:SED|6", "7": "FALLBACK:SED|7",
    }


def test_id_from_key(spark):
    assert values(spark, ["HIP|12", "SED|a|b"], text.id_from_key) == ["12", "a|b"]


def test_numbers_of_any_length_sort_by_value(spark):
    df = spark.createDataFrame([("a123456789012345678901234",), ("a12345678901234567890",), ("a123456789012345678901235",), ("a007",)], "v string")
    assert [r[0] for r in lists.sort_natural(df, "v", "asc").collect()] == ["a007", "a12345678901234567890", "a123456789012345678901234", "a123456789012345678901235"]


def test_totals_beyond_long_units(spark):
    from retailoom.functions.numbers import exact_sum
    df = spark.createDataFrame([(i % 2, 5e14 + 0.25) for i in range(40)], "g int, x double")
    assert [r.t for r in df.groupBy("g").agg(exact_sum("x").alias("t")).collect()] == [1e16 + 5.0] * 2
    assert df.agg(exact_sum("x").alias("t")).collect()[0].t == 2e16 + 10.0
    mixed = spark.createDataFrame([(-1.00004,), (2.5,), (None,)], "x double")
    assert mixed.agg(exact_sum("x").alias("t")).collect()[0].t == 1.5
    assert mixed.where("x is null").agg(exact_sum("x").alias("t")).collect()[0].t is None


def test_keyword_rules_with_any_pattern(spark):
    from retailoom.functions import text
    rules = (("a", "ROBES?"), ("b", "(PULL|GILET)S"), ("c", r"TOP\b"))
    df = spark.createDataFrame([("robe",), ("gilets",), ("top x",), ("topaze",)], "v string")
    assert [r[0] for r in df.select(text.classify_keywords("v", rules, "-")).collect()] == ["a", "b", "c", "-"]
    chains = spark.createDataFrame([("chez oreal",), ("chez loreal",), ("moreal",)], "v string")
    assert [r[0] for r in chains.select(prospects.chain_flag("v", ["L?OREAL"])).collect()] == [True, True, False]


def test_keyset_pages_give_the_whole_list(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 5)) for i in range(37)]
    df = spark.createDataFrame(rows, "k int, x double")
    for direction in ("asc", "desc"):
        want = [tuple(r) for r in lists.sort_nulls_last(df, "x", direction, "k").collect()]
        got, last = [], None
        while True:
            rows_ = lists.page_after(df, [("x", direction), ("k", "asc")], 8, last).collect()
            if not rows_:
                break
            got += [tuple(r) for r in rows_]
            last = rows_[-1].asDict()
        assert got == want


def test_keyword_anchors_never_miss(spark):
    """One-pass rules against the plain patterns on texts made to hit every kind of anchor."""
    import random
    import re as _re

    from retailoom.functions import keywords

    rules = [("a", "LEVI'?S|MIM"), ("b", "H[ &]*M|C & A"), ("c", "PANT\\b|DEPOT.?VENTE"), ("d", "AB?|XY{0,1}Z"), ("e", "(?:Q|R)S")]
    rng = random.Random(2)
    texts = ["".join(rng.choice(["LEVI", "S", "'", " ", "MIM", "H", "&", "M", "C", "A", "PANT", "DEPOT", "VENTE", "-", "B", "XZ", "XYZ", "QS", "é"])
                     for _ in range(rng.randint(0, 8))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for whole in (True, False):
        alts = keywords.compile_rules(rules, whole)
        got = [r[0] for r in df.orderBy("i").select(keywords.rule_hits("t", alts)).collect()]
        boundary = keywords._ASCII_BOUNDARY
        want = [sorted({a.rank for a in alts if _re.search(a.regex.replace(boundary, r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"), (t or "").upper())})
                for t in texts]
        assert got == want


def test_short_rule_tables_search_bytes_with_the_same_result(spark, monkeypatch, capsys):
    """A short table is searched as bytes, a text is not cut into keys; both ways agree."""
    from retailoom.functions import keywords

    rules = [("a", "TOP|PANT\\b"), ("b", "D.?ART|SEA?S"), ("c", "[XY]{2}|MISS"), ("a", "SAC")]
    texts = ["un top", "pantalon", "PANT 7/8", "d'art", "dart", "ses", "seas", "xy sac", "miss top", "missy", "été", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)

    def run():
        out = df.orderBy("i").select(*[f for w in (True, False) for f in (
            keywords.first_label("t", rules, "-", w).alias(f"f{w}"), keywords.all_labels("t", rules, w).alias(f"l{w}"),
            keywords.any_match("t", [p for _, p in rules], w).alias(f"m{w}"))])
        out.explain()
        return [tuple(r) for r in out.collect()], "split(" in capsys.readouterr().out

    short, cuts = run()
    assert not cuts
    monkeypatch.setattr(keywords, "FEW_ALTERNATIVES", 0)
    keyed, cuts = run()
    assert cuts and short == keyed
    assert short[0][:2] == ("a", ["a"]) and short[8][1] == ["a", "c"] and short[-1][:3] == ("-", [], False)
