"""Format-preserving pseudonyms for personal numbers, dates and addresses, with built-in functions only.

Values are found by one pattern and validated (card numbers by Luhn's digit, IBANs
modulo 97, octets by range, dates by the calendar, social security numbers by their
reserved blocks). A valid value is permuted within its format by a keyed Feistel
network of eight rounds: one half of the characters is shifted by a digest of the
other half, digits among digits and letters among the letters of their script. The
separators of numbers are taken out before and put back after, so a number has one
pseudonym however it is written. Check digits are made anew. Days are permuted on a
grid with a few places too many and walk the cycle until a day comes out, which takes
no more steps than there are such places and one; social security numbers are
permuted by their place among the valid ones. The same value has the same pseudonym
in every document, and a different one never has it.

What is not valid stays as it is, so clean texts do not change. Of an e-mail address
the part before the @ is permuted; where it has letters of a script that is not
listed, it becomes a keyed digest of 64 bits. Of a phone number all but the country
code is permuted, if a separator shows where that ends. The network works with a
digest of the caller's key, which `spark.sql.redaction.string.regex` keeps out of
explained plans.

No pattern needs more stack for a longer match: what repeats without a bound is a
character class or possessive.

Defined results: null stays null, an empty text empty; repeated rows change alike;
other columns pass through unread, whatever their names. A text is one value and is
handled whole, however long.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: In order of preference at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.[A-Za-z0-9]++)++",
    "secret": r"(?<=(?:token|secret|key|password)\s{0,2}[=:]\s{0,2}[\"']?)[0-9A-Za-z_-]{16,}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{13,19})(?![0-9])",
}
_FIRST, _DAYS = "1900-01-01", 73049  # to 2099-12-31
_WIDE, _HIGH = 270, 271  # a grid that holds all those days with few gaps
#: Runs of letters, by first code point and number, within which a letter of an address stays.
LETTERS = (
    (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25), (0x410, 32), (0x430, 32), (0x5D0, 27),
    (0x621, 26), (0x641, 10), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0x4E00, 20976), (0xAC00, 11172),
)
#: Marks the working key in plans, for redaction.
_MARKED = "nw-key:[0-9a-f]{64}"


def working_key(key: str) -> str:
    return "nw-key:" + sha256(key.encode()).hexdigest()


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(digest_of: str, digits: int) -> str:
    return f"cast(conv(substring(sha2({digest_of}, 256), 1, {digits}), 16, 10) as bigint)"


def _rounds(a: str, b: str, step_a: str, step_b: str) -> str:
    """Both halves after all rounds; the steps see them as s.a and s.b, and the round as r."""
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', {a}, 'b', {b}), (s, r) -> if(r % 2 = 0, named_struct('a', {step_a}, 'b', s.b), named_struct('a', s.a, 'b', {step_b})))"


def _shifted(key: str, mine: str, other: str, letters: bool) -> str:
    """`mine` with each character moved within its class by a digest of `other`; without `letters` only ASCII moves.

    The other half is digested once, and characters come from one split, so the work grows with the length alone.
    """
    move, code = _number("concat_ws('|', g, i)", 8), "ascii(c)"

    def within(low: int, n: int) -> str:
        return f"char({low} + (({code} - {low}) + {move}) % {n})"

    def beyond(low: int, n: int) -> str:
        return f"when {code} between {low} and {low + n - 1} then decode(unhex(lpad(hex({low} + (({code} - {low}) + {move}) % {n}), 4, '0')), 'UTF-16BE')"

    more = " ".join(beyond(*x) for x in LETTERS) if letters else ""
    char = f"case when c between '0' and '9' then {within(48, 10)} when c between 'a' and 'z' then {within(97, 26)} when c between 'A' and 'Z' then {within(65, 26)} {more} else c end"
    digest = f"sha2(concat_ws('|', {key}, r, {other}), 256)"
    return f"if({mine} = '', '', transform(array({digest}), g -> array_join(transform(split({mine}, ''), (c, i) -> {char}), ''))[0])"


def _permuted(key: str, value: str, letters: bool = False) -> str:
    """Characters within their classes."""
    cut = f"cast(length({value}) div 2 as int)"
    halves = _rounds(f"substring({value}, 1, {cut})", f"substring({value}, {cut} + 1)", _shifted(key, "s.a", "s.b", letters), _shifted(key, "s.b", "s.a", letters))
    return f"transform(array({halves}), h -> concat(h.a, h.b))[0]"


def _dressed(bare: str, like: str) -> str:
    """The characters of `bare` in the places of the digits and letters of `like`."""
    at = f"substring({like}, i, 1)"
    return f"transform(array({bare}), q -> array_join(transform(sequence(1, length({like})), i -> if({at} rlike '[0-9A-Za-z]', substring(q, length({_bare(f'substring({like}, 1, i)')}), 1), {at})), ''))[0]"


def _bare(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9A-Za-z]', '')"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(payload: str) -> str:
    """Check digit of a string of digits."""
    x = "cast(substring(d, length(d) - i, 1) as int)"
    total = f"aggregate(sequence(0, length(d) - 1), 0, (t, i) -> t + if(i % 2 = 0, if({x} > 4, {x} * 2 - 9, {x} * 2), {x}))"
    return f"transform(array({payload}), d -> (10 - {total} % 10) % 10)[0]"


def _mod97(value: str) -> str:
    """A string of digits and capitals, as an IBAN's number, modulo 97."""
    c = "substring(d, i, 1)"
    return f"transform(array({value}), d -> aggregate(sequence(1, length(d)), 0, (t, i) -> if({c} between '0' and '9', (t * 10 + ascii({c}) - 48) % 97, (t * 100 + ascii({c}) - 55) % 97)))[0]"


def _octets(key: str) -> str:
    o = [f"cast(split(v, '[.]')[{k}] as bigint)" for k in range(4)]
    f = [f"(s.{x} + {_number(f"concat_ws('|', {key}, 'ip', r, s.{y})", 8)}) % 65536" for x, y in ("ab", "ba")]
    return f"transform(array({_rounds(f'{o[0]} * 256 + {o[1]}', f'{o[2]} * 256 + {o[3]}', *f)}), h -> concat_ws('.', h.a div 256, h.a % 256, h.b div 256, h.b % 256))[0]"


def _day(key: str, day: str) -> str:
    """Another day of the range: the grid is permuted until a day of the range comes out."""
    f = [f"(s.{x} + {_number(f"concat_ws('|', {key}, 'date', r, s.{y})", 8)}) % {m}" for x, y, m in (("a", "b", _HIGH), ("b", "a", _WIDE))]
    once = f"transform(array({_rounds(f'w.d div {_WIDE}', f'w.d % {_WIDE}', *f)}), h -> h.a * {_WIDE} + h.b)[0]"
    return f"aggregate(sequence(1, {_WIDE * _HIGH - _DAYS + 1}), named_struct('d', cast({day} as bigint), 'go', true), (w, k) -> if(w.go, transform(array({once}), d -> named_struct('d', d, 'go', d >= {_DAYS}))[0], w)).d"


def _ssn_valid(v: str) -> str:
    return f"(substring({v}, 1, 1) <> '9' and substring({v}, 1, 3) not in ('000', '666') and substring({v}, 5, 2) <> '00' and substring({v}, 8, 4) <> '0000')"


def _ssn(key: str) -> str:
    """The place of v among the valid numbers (898 areas by 99 groups, 9,999 serials), permuted."""
    area = "cast(substring(v, 1, 3) as int)"
    a = f"({area} - if({area} > 666, 2, 1)) * 99 + cast(substring(v, 5, 2) as int) - 1"
    f = [f"(s.{x} + {_number(f"concat_ws('|', {key}, 'ssn', r, s.{y})", 8)}) % {m}" for x, y, m in (("a", "b", 898 * 99), ("b", "a", 9999))]
    halves = _rounds(f"cast({a} as bigint)", "cast(substring(v, 8, 4) as bigint) - 1", *f)
    shown = "h.a div 99 + if(h.a div 99 >= 665, 2, 1)"
    return f"transform(array({halves}), h -> concat_ws('-', lpad(cast({shown} as string), 3, '0'), lpad(cast(h.a % 99 + 1 as string), 2, '0'), lpad(cast(h.b + 1 as string), 4, '0')))[0]"


def _pseudonym(key: str) -> str:
    """The pseudonym of a found value v, or v itself if it isn't valid."""
    at = "instr(v, '@')"
    local = f"substring(v, 1, {at} - 1)"
    listed = "".join(f"{chr(low)}-{chr(low + n - 1)}" for low, n in LETTERS)
    digest = f"concat('x', substring(sha2(concat_ws('|', {key}, 'email', {local}), 256), 1, 16))"
    email = f"concat(if({local} rlike {_quoted(f'^[0-9A-Za-z._%+{listed}-]*$')}, {_permuted(key, local, True)}, {digest}), substring(v, {at}))"
    lead = r"regexp_extract(v, '^(?:[+][0-9]{1,3}(?=[ .(-]))?', 0)"
    rest = f"substring(v, length({lead}) + 1)"
    phone = f"concat({lead}, {_dressed(_permuted(key, _bare(rest)), rest)})"
    payload = "substring(c, 1, length(c) - 1)"
    card = f"transform(array({_digits('v')}), c -> if({_luhn(payload)} = cast(right(c, 1) as int), {_dressed(f"transform(array({_permuted(key, payload)}), p -> concat(p, {_luhn('p')}))[0]", 'v')}, v))[0]"
    ssn = f"if({_ssn_valid('v')}, {_ssn(key)}, v)"
    bare = "replace(v, ' ', '')"
    new_check = f"lpad(cast(98 - {_mod97("concat(p, substring(v, 1, 2), '00')")} as string), 2, '0')"
    iban = f"if({_mod97(f'concat(substring({bare}, 5), substring({bare}, 1, 4))')} = 1, {_dressed(f"transform(array({_permuted(key, f'substring({bare}, 5)')}), p -> concat(substring(v, 1, 2), {new_check}, p))[0]", 'v')}, v)"
    iso = f"date_format(date_add(date'{_FIRST}', cast({_day(key, f"datediff(try_to_date(v, 'yyyy-MM-dd'), date'{_FIRST}')")} as int)), 'yyyy-MM-dd')"
    mark = "regexp_extract(v, '[./]', 0)"
    written = f"try_to_date(regexp_replace(v, '[./]', '-'), 'd-M-yyyy')"
    dmy = f"replace(date_format(date_add(date'{_FIRST}', cast({_day(key, f"datediff({written}, date'{_FIRST}')")} as int)), 'dd-MM-yyyy'), '-', {mark})"
    inside = "between date'1900-01-01' and date'2099-12-31'"
    return f"""case
        when {at} > 0 then {email}
        when v rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {_octets(key)}
        when v rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if(try_to_date(v, 'yyyy-MM-dd') {inside}, {iso}, v)
        when v rlike '^[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}$' then if({written} {inside}, {dmy}, v)
        when v rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn}
        when v rlike '^[+(]|^[0-9]{{3}}[ .-][0-9]{{3}}[.-][0-9]{{4}}$' then {phone}
        when v rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]+$' and length({bare}) between 12 and 34 then {iban}
        when v rlike '^[0-9]([ -]?[0-9]){{12,18}}$' then {card}
        else {_permuted(key, 'v')} end"""


def _found(text: str) -> str:
    return f"regexp_extract_all({text}, {_quoted('|'.join(PATTERNS.values()))}, 0)"


def pseudonymised(df: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`df` with the values in `text_col` replaced, and with `count_col`, if named, the number of values that were."""
    hits, spark = shared.unused("hits", df), df.sparkSession
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", _MARKED)
    text = f"`{text_col.replace('`', '``')}`"
    some = f"{text} rlike '[0-9@]|(?:token|secret|key|password)\\\\s{{0,2}}[=:]'"
    k = _quoted(working_key(key))
    fresh: Column = F.expr(f"if({some}, transform({_found(text)}, v -> named_struct('old', v, 'new', {_pseudonym(k)})), null)")
    parts = f"split({text}, {_quoted('|'.join(PATTERNS.values()))}, -1)"
    joined = F.expr(f"if(size({hits}) > 0, array_join(zip_with({parts}, {hits}, (p, h) -> concat(p, coalesce(h.new, ''))), ''), {text})")
    out = df.withColumn(hits, fresh)
    columns = [joined.alias(c) if c == text_col else F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    if count_col:
        columns.append(F.expr(f"cast(coalesce(size(filter({hits}, h -> h.old <> h.new)), 0) as bigint)").alias(count_col))
    return out.select(*columns)
