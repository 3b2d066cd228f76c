"""The dictionary join against one regular expression for each phrase and text."""

import re

import pytest

from newswarden.operators import phrases

ITEMS = [
    ("Acme", "Acme Gateway", ["Acme GW", "A.C.M.E", "C++"], 3, False),
    ("Globex", "Globex", ["globex cloud", None, ""], 1, True),
    ("日本", "製品 X", ["※"], 2, None),
    ("Initech", ".NET Vault", ["e-mail\nhub", "(x|y)", "École"], 5, False),
    ("Globex", "Vault", None, 7, False),
    (None, "Nameless", ["no one"], 9, True),
]
TEXTS = ["Acme gateway and ACME GW", "acmegateway, globexcloud", "a.c.m.e uses c++ well", "C+++", "(Globex Cloud)", "日本 の 製品 x ※", "the .net vault; e-mail\nhub", "x|y (X|Y)", "école ÉCOLE", "vault", "Nameless, no one", "", None, "acme_gw 1acme gw acme gw2", "z " * 9000 + "Acme", "globex" * 3000]


def brute(text):
    """Vendors, products and aliases in the order in which the inventory's items name them."""
    def stands(p):
        return bool(p) and re.search(f"(^|[^a-z0-9]){re.escape(p)}([^a-z0-9]|$)", text or "", re.I) is not None

    vendors, products, aliases = [], [], []
    for vendor, product, names, _, _ in sorted(ITEMS, key=lambda i: i[3]):
        names = [n for n in names or [] if n]
        if stands(vendor) or any(map(stands, names)):
            vendors.append(vendor)
            aliases.append(vendor)
        for n in [product, *names]:
            if stands(n):
                vendors.append(vendor)
                products.append(product)
                aliases.append(n)
    return [list(dict.fromkeys(x for x in found if x is not None)) for found in (vendors, products, aliases)]


@pytest.mark.parametrize("most", [phrases.MOST_BROADCAST, 0])
def test_against_all_pairs(spark, most):
    inventory = spark.createDataFrame(ITEMS + ITEMS[:1], "vendor string, product string, aliases array<string>, place long, noisy boolean")
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string")
    got = {r.key: [r.vendors, r.products, r.aliases] for r in phrases.detected(texts, inventory, most_broadcast=most).collect()}
    assert got == {k: b for k, t in enumerate(TEXTS) if any(b := brute(t))}
    noisy = {r.key for r in phrases.detected(texts, inventory, most_broadcast=most).where("noisy").collect()}
    assert noisy == {4, 10}


def test_a_large_inventory_is_a_join_and_not_an_expression(spark):
    inventory = spark.range(20_000).selectExpr("concat('v', id) AS vendor", "concat('maker ', id) AS product", "array(concat('also ', id, ' known')) AS aliases", "id AS place", "false AS noisy")
    texts = spark.createDataFrame([(1, "also 77 known"), (2, "Maker 19999, maker 5"), (3, "nothing")], "key long, text string")
    found = phrases.detected(texts, inventory)
    assert {r.key: (r.vendors, r.products) for r in found.collect()} == {1: (["v77"], ["maker 77"]), 2: (["v5", "v19999"], ["maker 5", "maker 19999"])}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and len(plan) < 20_000


def test_empty(spark):
    inventory = spark.createDataFrame([], "vendor string, product string, aliases array<string>, place long, noisy boolean")
    texts = spark.createDataFrame([(1, "x")], "key long, text string")
    assert phrases.detected(texts, inventory).collect() == [] and phrases.detected(texts.limit(0), inventory).collect() == []
