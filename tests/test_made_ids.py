"""Ids that are made from addresses, of which two addresses can have the same digits."""

import hashlib
import json

from newswarden.sources import datasets


def address(n: int) -> str:
    return f"https://example.org/{n}"


def clash() -> tuple[str, str]:
    """Two addresses whose digests begin with the same eight digits."""
    seen: dict[str, int] = {}
    for n in range(1_000_000):
        digits = hashlib.sha1(address(n).encode()).hexdigest()[:8]
        if digits in seen:
            return address(seen[digits]), address(n)
        seen[digits] = n
    raise AssertionError("no clash")


def test_addresses_with_the_same_digits_are_different_samples(spark, tmp_path):
    a, b = clash()
    digest = lambda url: hashlib.sha1(url.encode()).hexdigest()
    sample = {"sourceName": "x", "sourceTier": "unknown", "title": "t", "rssSummary": "s", "rssCategories": [], "publishedAt": None, "humanLabel": "RELEVANT", "humanReason": "r"}
    lines = [sample | {"url": a}, sample | {"url": b}, sample | {"url": b}, sample | {"url": a}, sample | {"url": address(-1), "id": f"cf-{digest(a)[:8]}"}, sample | {"url": b, "id": "own"}]
    (tmp_path / "lines.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = {r.line: (r.reason, r.id) for r in datasets.checked(spark, str(tmp_path)).collect()}
    assert got[1] == (None, f"cf-{digest(a)[:8]}") and got[2] == (None, f"cf-{digest(b)}")
    assert [got[n][0] for n in (3, 4, 5, 6)] == ["repeated id, first on line 2", "repeated id, first on line 1", "repeated id, first on line 1", "repeated url, first on line 2"]
