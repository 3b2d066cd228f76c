"""Fingerprints against a byte-by-byte chunker, and neighbours against sorting in Python."""

import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from newswarden.llm import fingerprints as fp


def slow_chunks(data, size=fp.DEFAULT):
    """One byte at a time."""
    out, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(fp.GEARS[byte])) & 0xFFFFFFFF
        n = i + 1 - start
        bits = size.strict if n < size.normal else size.loose
        if (n >= size.least and h >> (32 - bits) == 0) or n == size.most:
            out.append(data[start : i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_chunks(monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    for data in (b"", b"x", b"y" * 5000, prose(1, 3000).encode(), "é🙂".encode() * 300, bytes(range(256)) * 20):
        found = fp.chunks(data)
        assert found == slow_chunks(data) and b"".join(found) == data


def test_an_insertion_moves_only_near_borders():
    a = prose(2, 4000)
    b = a[:9000] + "inserted words " + a[9000:]
    one, two = fp.fingerprint(a.encode()), fp.fingerprint(b.encode())
    assert fp.containment(one, two) > 0.97 and fp.containment(one, fp.fingerprint(prose(3, 4000).encode())) < 0.02
    assert np.array_equal(fp.from_text(fp.as_text(one)), one) and fp.containment(one, one) == 1.0


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)
    order = sorted(rows, key=key, reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        one, two, three = (set(zip(map(sha, c), map(len, c), strict=True)) for c in (slow_chunks(x.encode()) for x in (own, edited, after)))
        share = lambda a, b: sum(n for _, n in a & b) / sum(n for _, n in a) if a else float(not b)
        out.append((i, len(own), sha(edited.encode()), round(share(one, two), 9), round(share(one, three), 9)))
    return out


def sha(x):
    return sha256(x).hexdigest()


@pytest.mark.parametrize("chars", [fp.RANGE_CHARS, 500])
def test_neighbours(spark, chars):
    rows = [(i * 7 % 211, prose(i % 60, i % 90)) for i in range(211)] + [(1000, None), (1001, ""), (1002, "é"), (1003, "🙂ab" * 40), (1004, prose(9, 20000)), (-5, "last one of all"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, fingerprint string").repartition(5)
    out = fp.with_next(docs, range_chars=chars).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out), key=str)
    assert got == sorted(expected(rows), key=str)
    single = {r.doc_id: (r.n_chars, r.fingerprint) for r in fp.fingerprints(docs).collect()}
    assert single == {r.doc_id: (r.n_chars, r.fingerprint) for r in out} and single[1000] == (0, "")


def test_repeated_ids_null_ids_and_text_ids(spark):
    """A third of the rows without an id, and repeated rows: each row meets one that follows it in the order of id, hash and text."""
    rows = [(None, prose(k % 9, 30)) for k in range(300)] + [("same", "one"), ("same", "one"), ("same", "two")] + [(f"k{k}", prose(k, 25)) for k in range(300)]
    out = fp.with_next(spark.createDataFrame(rows, "doc_id string, text string"), range_chars=2000).collect()
    assert len(out) == len(rows) and sorted(r.n_chars for r in out) == sorted(len(t) for _, t in rows)
    # Nine distinct texts without an id stand together: all but nine are followed by their equal.
    assert sum(r.near_next == 1.0 for r in out if r.doc_id is None) >= 291
    named = {i: t for i, t in rows if i and i[0] == "k"}
    order = sorted(named, reverse=True)
    want = {a: sha((named[a][: len(named[a]) - len(named[a]) // 2] + named[b][: len(named[a]) // 2]).encode()) for a, b in zip(order, order[1:], strict=False)}
    assert {r.doc_id: r.edited_sha256 for r in out if r.doc_id in want} == want


def test_few_rows(spark):
    assert fp.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (r,) = fp.with_next(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert (r.edited_sha256, r.near_edited > -1, r.near_next) == (sha(b"abcabc"), True, 1.0)


def test_edited_texts_of_the_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    sql = f"""SELECT doc_id, length(t) AS n, sha256(concat(left(t, length(t) - length(t) // 2), left(coalesce(lead(t) OVER w, first(t) OVER (ORDER BY doc_id DESC)), length(t) // 2))) AS h
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM '{path}') WINDOW w AS (ORDER BY doc_id DESC)"""
    out = fp.with_next(spark.read.parquet(path)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == sorted(duckdb.sql(sql).fetchall())
    # Half of a text stays; of texts made of few repeated lines the stayed half holds nearly every distinct chunk.
    long = [r for r in out if r.n_chars > 400 and r.near_next < 0.1]
    assert all(r.near_edited > 0.2 and r.near_edited >= r.near_next for r in long) and 0.4 < float(np.median([r.near_edited for r in long])) < 0.55
