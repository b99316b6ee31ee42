import pytest
from pyspark.sql import functions as F

from placebook.functions.contacts import (
    listing_key,
    name_key,
    search_task_id,
    standard_phone,
    standard_url,
)


def test_name_key_deletes_endings_everywhere(column):
    names = {
        "Falck Southwest Corp": "falck southwest",
        "Bexar County ESD No. 2": "bexarunty esd no. 2",
        "Crown Shields Transport, LLC": "crown shields transport,",
        "X Incorporated": "xorporated",
        "X Corporation": "xoration",
        "X Company": "x",
        "　 X Inc LLC\x1f": "x",
        "Co": "co",
        "": "",
    }
    assert column(list(names), name_key) == list(names.values())
    assert column([None], name_key) == [""]


def test_name_key_suffix_mode_keeps_words(spark, column):
    names = {"Bexar County": "bexar county", "Crown, Inc.": "crown", "X Company": "x"}
    assert column(list(names), lambda x: name_key(x, "suffix")) == list(names.values())
    with pytest.raises(ValueError):
        name_key(F.col("x"), "other")


def test_listing_key(column):
    def key(x):
        return listing_key(x, F.lit("El Paso"), F.lit("tx"))

    def no_place(x):
        return listing_key(x, F.lit(None).cast("string"), F.lit(None).cast("string"))

    assert column(["A Inc"], key) == ["a|el paso|TX"]
    assert column(["A Inc"], no_place) == ["a||"]


def test_standard_phone(column):
    phones = {
        "8172713700": "(817) 271-3700",
        "1-800-259-3333": "(800) 259-3333",
        "713-837-0311": "(713) 837-0311",
        "+44 20 7946 0958": "+44 20 7946 0958",
        "911": "911",
        "21234567890": "21234567890",
        "": None,
        None: None,
        "٣(21) 4-5": "٣(21) 4-5",
        "٣21 456 7890": "(٣21) 456-7890",
    }
    assert column(list(phones), standard_phone) == list(phones.values())


def test_standard_url(column):
    urls = {
        "a.com": "https://a.com",
        " http://a ": "http://a",
        "\thttps://a\xa0": "https://a",
        "HTTP://a": "https://HTTP://a",
        "ftp://a": "https://ftp://a",
        "   ": "https://",
        "": None,
        None: None,
    }
    assert column(list(urls), standard_url) == list(urls.values())


def test_search_task_id(column):
    assert column(["Fort Worth"], lambda x: search_task_id(F.lit("TX"), x)) == ["search_TX_FortWorth"]
