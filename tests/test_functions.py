from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.functions import contact, numbers, text


def value(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.key_text, "  Società  D'Élite & Co. ", "societa d elite co"),
        (text.company_key_text, "Immobiliare S.r.l.", "immobiliare srl"),
        (text.company_key_text, "Immobiliare SRL", "immobiliare srl"),
        (text.company_key_text, "Rossi S.R.L.S.", "rossi srls"),
        (text.company_key_text, "Rossi S.p.A.", "rossi spa"),
        (text.company_key_text, None, None),
        (text.slug, "Valle d'Aosta / Nord", "valle_d_aosta_nord"),
        (text.plain_email_signs, "info [at] ditta (dot) it", "info@ditta.it"),
        (text.decode_hex_email, "2a4b6a48044943", "a@b.ci"),
        (text.decode_hex_email, "xyz", None),
        (text.has_mojibake, "CittÃ\u00a0", True),
        (text.has_mojibake, "Città", False),
        (contact.phone_key, "+39 0422 000177", "0422000177"),
        (contact.phone_key, "0039 0422 000177", "0422000177"),
        (contact.phone_key, "123", None),
        (contact.phone_e164, "0422 000177", "+390422000177"),
        (contact.phone_e164, "3934567890", None),
        (contact.phone_e164, "+39 393 456 7890", "+393934567890"),
        (contact.phone_e164, "12345", None),
        (contact.phone_kind, "800 123456", "service"),
        (contact.vat_valid, "IT 07643520567", True),
        (contact.vat_valid, "07643520568", False),
        (contact.vat_valid, None, False),
        (contact.vat_codes, "P.IVA 07643520567, tel 07643520568 e IT07643520567", ["07643520567"]),
        (contact.is_pec, "ditta@pec.it", True),
        (contact.is_pec, "ditta@spec.it", False),
        (contact.host, "https://User@WWW.Ditta.it:80/x?y", "ditta.it"),
        (contact.host, "ditta.it/x", "ditta.it"),
        (contact.host, "", None),
        (contact.registrable_domain, "https://a.b.ditta.co.uk/", "ditta.co.uk"),
        (contact.registrable_domain, "https://padova1.marca.it", "marca.it"),
        (contact.canonical_url, "HTTPS://www.ditta.it/Chi-siamo/?x=1#y", "ditta.it/Chi-siamo"),
        (contact.is_directory_host, "https://it-it.facebook.com/ditta", True),
        (contact.is_directory_host, "https://notfacebook.com", False),
        (contact.social_network, "https://www.instagram.com/ditta", "instagram"),
        (contact.is_public_ipv4, "192.168.1.4", False),
        (contact.is_public_ipv4, "93.184.216.34", True),
        (numbers.parse_number, "4,7", 4.7),
        (numbers.parse_number, "(1.234 recensioni)", 1234.0),
        (numbers.parse_number, "1.234,5", 1234.5),
        (numbers.parse_number, "1,234,567", 1234567.0),
        (numbers.parse_number, "N/A", None),
        (numbers.parse_revenue, "€ 1.500.000", 1500000),
        (numbers.parse_revenue, "2,3 mln", 2300000),
        (numbers.parse_revenue, "500k", 500000),
        (numbers.parse_revenue, "200.000", 200000),
        (numbers.parse_revenue, "", None),
        (numbers.revenue_year, "fatturato 2021, sede dal 1998", 2021),
        (numbers.employee_range, "da 10 a 19", "10-19"),
        (numbers.employee_range, "oltre 50", "50+"),
    ],
)
def test_scalar(spark, f, given, wanted):
    assert value(spark, f, given) == wanted


def test_rounding_is_upwards_at_halves(spark):
    got = spark.createDataFrame([(2.5,), (-2.5,), (0.125,)], "x double").select(numbers.round_up(F.col("x"))).collect()
    assert [r[0] for r in got] == [3.0, -2.0, 0.0]


def test_fnv(spark):
    assert value(spark, text.fnv1a32, "a") == 0xE40C292C


def test_loose_json(spark):
    got = value(spark, lambda c: F.to_json(text.loose_json(c)), 'so: ```json\n{"a": 1}\n``` done')
    assert got == '{"a":1}'
