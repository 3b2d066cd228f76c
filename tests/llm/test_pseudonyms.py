"""Pseudonyms: a Python network gives the same values, the inverse gives the old ones back, and formats stay valid."""

import hashlib
import random
import re
from datetime import date

from newswarden.llm import pseudonyms

KEY = "k"
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *("".join(map(chr, range(low, low + n))) for low, n in pseudonyms.LETTERS)]


def moved(mine, other, r, sign=1):
    out, digest = [], hashlib.sha256(f"{pseudonyms.working_key(KEY)}|{r}|{other}".encode()).hexdigest()
    for i, c in enumerate(mine):
        m = sign * int(hashlib.sha256(f"{digest}|{i}".encode()).hexdigest()[:8], 16)
        for alphabet in CLASSES:
            if c in alphabet:
                c = alphabet[(alphabet.index(c) + m) % len(alphabet)]
                break
        out.append(c)
    return "".join(out)


def permuted(v, back=False):
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    for r in reversed(range(8)) if back else range(8):
        if r % 2 == 0:
            a = moved(a, b, r, -1 if back else 1)
        else:
            b = moved(b, a, r, -1 if back else 1)
    return a + b


def luhn(payload):
    digits = [int(c) for c in payload if c.isdigit()][::-1]
    return (10 - sum((2 * x - 9 * (x > 4)) if i % 2 == 0 else x for i, x in enumerate(digits)) % 10) % 10


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, v int, h string")
    out = pseudonymised(df)
    assert out.columns == [*df.columns, "n"]
    return {r.doc_id: (r.text, r.n) for r in out.collect()}


def pseudonymised(df):
    return pseudonyms.pseudonymised(df, KEY, count_col="n")


def test_numbers_against_python(spark):
    rng = random.Random(1)
    cards = [p + str(luhn(p)) for p in ("".join(rng.choice("0123456789") for _ in range(15)) for _ in range(40))]
    emails = ["réeux.41@mail3.example.com", "a@b.de", "X.y-9+z@sub.host.org", "øü@example.org", "иван.петров@example.org", "王小明@例え.example.org"[:3] + "@example.org", "ŁukÉØ@example.org"]
    phones = ["+1 (337) 555-7349", "(201) 555-0123", "+49 30 1234567"]
    got = run(spark, cards + emails + phones)
    for i, v in enumerate(cards):
        p = got[i][0][:-1]
        assert p == permuted(v[:-1]) and permuted(p, back=True) == v[:-1] and int(got[i][0][-1]) == luhn(p) and got[i][1] == 1
    for i, v in enumerate(emails, len(cards)):
        assert got[i][0] == permuted(v.split("@")[0]) + "@" + v.split("@")[1]
    at, digits = len(cards) + len(emails), lambda x: re.sub("[^0-9]", "", x)
    assert got[at][0].startswith("+1 (") and digits(got[at][0])[1:] == permuted("3375557349") and digits(got[at + 1][0]) == permuted("2015550123")
    assert re.fullmatch(r"\+49 \d\d \d{7}", got[at + 2][0]) and got[at + 2][0] != phones[2]


def test_one_pseudonym_however_it_is_written(spark):
    same = [("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"), ("+1 (337) 555-7349", "+1 337 555 7349", "+1-337-555-7349"), ("GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32")]
    for group in same:
        new = [t for t, _ in run(spark, list(group)).values()]
        assert len({re.sub("[^0-9A-Z]", "", t) for t in new}) == 1 and all(re.sub("[0-9A-Z]", "0", a) == re.sub("[0-9A-Z]", "0", b) != a for a, b in zip(group, new))


def test_social_security_numbers_are_permuted_among_the_valid(spark):
    rng = random.Random(2)
    numbers = sorted({f"{rng.choice([1, 2, 665, 667, 668, 898, 899]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(400)})
    new = run(spark, [" ".join(numbers)])[0][0].split()
    assert len(set(new)) == len(numbers) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new)


def test_unlisted_letters_are_not_left_in_clear(spark):
    (new, n), (again, _) = run(spark, ["ꙮa@example.org", "ꙮa@example.org and"]).values()
    assert re.fullmatch("x[0-9a-f]{16}@example.org", new) and n == 1 and again.startswith(new)


def test_long_repetitions_need_no_stack(spark):
    n = 100_000
    texts = ["a@" + "b." * n + "c", "a." * n + "b@c.de", "key=" + "a" * n, "1." * n, "+1 " + "22 " * n, "GB82" + " ABCD" * n, "1-" * n, "1234 " * n, "1" * n, "(201) " * n, "01.02.2000-" * n, "@" * n, "key=" * n]
    got = run(spark, texts)
    assert len(got) == len(texts) and got[0][0] != texts[0] and got[0][0].endswith("@" + "b." * n + "c")


def test_other_columns_stay_whatever_their_names(spark):
    df = spark.createDataFrame([("a@b.de", "own", 3)], "text string, __nw_hits string, __NW_hits_ int")
    out = pseudonymised(df)
    assert out.columns == [*df.columns, "n"] and out.first()[1:3] == ("own", 3)
    assert KEY not in pseudonyms.working_key(KEY)[7:] or len(KEY) < 8
    assert pseudonyms.working_key(KEY) not in out._jdf.queryExecution().toString()


def test_dates_octets_and_checked_formats(spark):
    days = [date.fromordinal(date(1900, 1, 1).toordinal() + k * 97).isoformat() for k in range(700)]
    got = run(spark, [" ".join(days), "189.251.249.1 189.251.249.1, 0.0.0.0", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "03.07.2021 3/7/2021"])
    new = got[0][0].split()
    assert len(set(new)) == 700 and all("1900-01-01" <= x <= "2099-12-31" and date.fromisoformat(x) for x in new) and sum(a == b for a, b in zip(days, new)) < 3
    a, b, c = re.split("[ ,]+", got[1][0])
    assert a == b != c and all(0 <= int(x) <= 255 for x in f"{a}.{c}".split("."))
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got[2][0]) and got[2][0] != "123-45-6789"
    bare = got[3][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and got[3][0][:2] == "GB" and len(got[3][0]) == 27
    assert got[4][0].split()[0].replace(".", "/") == got[4][0].split()[1]


def test_clean_texts_and_odd_cases_stay(spark):
    clean = ["", None, "no numbers here", "1234567890123456 256.1.1.1 2023-02-30 000-12-3456 v1.2.3", "a@b @ c", "GB82 WEST 1234 5698 7654 33", "é" * 50000, "12 monkeys, 3.14, 10:30"]
    assert run(spark, clean) == {i: (t, 0) for i, t in enumerate(clean)}
    long = "word " * 40000 + "4952935900253052 " * 50
    assert run(spark, [long])[0][1] == 50
    assert run(spark, []) == {}
    secret = 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'
    assert run(spark, [secret])[0][0] != secret
