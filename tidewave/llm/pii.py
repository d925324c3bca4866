"""Format-preserving Feistel pseudonyms for personal numbers, dates and secrets (operator 7).

A text is split at the matches of one pattern; each match that passes its kind's validation is
replaced by a keyed permutation of it within its format, and the parts are joined again. Equal
values get equal pseudonyms in all documents under one key, different values of a kind get different ones, and
with the key the permutation can be undone (reverse=True). Cards, IBANs and telephone numbers are the same value however
their digits are parted.

Kinds, and what of them stays:

- payment cards, 13 to 19 digits, plain or in groups parted by blanks or hyphens, Luhn valid: the first digit; the check digit is made anew
- IBANs in capitals, plain or in groups of four, or plain in small letters, valid modulo 97: the country; check digits are made anew
- social security numbers (123-45-6789, of areas, groups and serials that are given out): the pseudonym is again one of these
- telephone numbers: with + the country code (its first three digits, if it is not parted), with a leading 0 the area code, else
  the first digit; ten digits that nothing parts are no telephone number, as they may be anything
- IPv4 and IPv6 addresses: their layout
- dates from 1800 to 2199, with all digits of the year, as year-month-day, day/month/year or month/day/year (the first if both may be meant; also with
  dots or hyphens), and with month names in English, German, French or Spanish: layout, language, number of digits
- e-mail addresses: the domain, and the place of capitals, small letters, digits and marks of the local part
- access keys (AKIA and 16; ghp_ and the like and 36 or more), secret keys after aws_secret_access_key, quoted tokens of 32 or
  more hex digits, and values after password, passwd or pwd and = or a colon: the kind of each symbol

Numbers that fail the validation, and all else, stay as they are. Eight rounds alternate between the halves of the
value: each symbol of one half is moved within its kind by a SHA-256 of key, kind, round, place and the other half. Where
only some results have the value's format (one digit for the day, say), the permutation is repeated until one has; a
walk that does not end within WALK steps (far less likely than 10^-20) is an error, never a value left in clear.

Null texts stay null; nothing is dropped; extra columns are kept, but for one named n_values, which is replaced.

Only DataFrame functions, no shuffle: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALK = 8, 400
HEX = "0123456789abcdef"
#: 1800-01-01 to 2199-12-31 are 27 x 5411 days; 898 areas and 99 x 9999 numbers in each are given out.
DAYS, NUMBERS = (27, 5411), (898, 989901)

# The names of the months.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "en3": "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
MONTHS["en3"].insert(4, "May")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR = r"(?:1[89]|2[01])[0-9]{2}"
_NAME = "(?:" + "|".join(sorted({m for own in MONTHS.values() for m in own}, key=lambda m: (-len(m), m))) + ")"
_PART = r"[0-3]?[0-9]"
_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_H = "[0-9a-fA-F]{1,4}"
_PASSWORD = "(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd) ?[=:] ?"
#: Kind and pattern; the first that matches at a place counts.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "token": r"\"(?:[0-9a-f]{32,}|[0-9A-F]{32,})\"",
    "access": rf"{_LEFT}AKIA[0-9A-Z]{{16}}{_RIGHT}",
    "granted": rf"{_LEFT}gh[pousr]_[0-9A-Za-z]{{36,}}{_RIGHT}",
    "secret": rf"{_LEFT}aws_secret_access_key ?[=:] ?[0-9A-Za-z/+]{{40}}(?![0-9A-Za-z/+])",
    "password": rf"{_LEFT}{_PASSWORD}[0-9A-Za-z]{{6,}}",
    "iban": rf"{_LEFT}[a-z]{{2}}[0-9]{{2}}[0-9a-z]{{11,30}}{_RIGHT}|{_LEFT}[A-Z]{{2}}[0-9]{{2}}(?:[0-9A-Z]{{11,30}}|(?: [0-9A-Z]{{4}}){{2,7}}(?: [0-9A-Z]{{1,3}})?){_RIGHT}",
    "phone": rf"(?:(?<![0-9A-Za-z+])(?=\+(?:[ .()-]{{0,2}}[0-9]){{8,15}}(?![0-9]))\+[0-9]{{1,3}}(?:[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,12}})){{1,6}}|(?<![0-9A-Za-z.,-])0[1-9][0-9]{{1,3}}[ /-][0-9]{{3,4}}[ -]?[0-9]{{3,5}}|{_LEFT}(?:\([0-9]{{3}}\) ?[0-9]{{3}}[-. ][0-9]{{4}}|[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}})|(?<![0-9A-Za-z.,+-])[0-9]{{3}} [0-9]{{3}} [0-9]{{4}}(?![.,-][0-9])){_RIGHT}",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[a-fA-F:]*[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{1,7}}:|:(?::{_H}){{1,7}})(?![0-9A-Za-z:])",
    "date": rf"(?<![0-9A-Za-z./-])(?:{_YEAR}-[01][0-9]-[0-3][0-9]|{_PART}/{_PART}/{_YEAR}|{_PART}\.{_PART}\.{_YEAR}|{_PART}-{_PART}-{_YEAR}|{_PART}\.? (?:de )?{_NAME},? (?:de )?{_YEAR}|{_NAME}\.? {_PART},? {_YEAR})(?![0-9A-Za-z/-]|\.[0-9])",
    "card": rf"{_LEFT}[1-9](?:[0-9]{{12,18}}|[0-9]{{3}}(?:[ -][0-9]{{4}}){{3}}(?:[ -][0-9]{{1,3}})?|[0-9]{{3}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_RIGHT}",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _by(key: str, kind: str, *parts: str) -> str:
    """SQL for a number from the keyed hash of the parts."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_quoted(key)}, {_quoted(kind)}, {', '.join(parts)}), 256), 1, 12), 16, 10) as bigint)"


def feistel(value: str, key: str, kind: str, reverse: bool = False, hexadecimal: bool = False) -> str:
    """SQL for the keyed permutation of strings of one layout: digits, small letters and capitals stay such, other symbols stay.

    hexadecimal: letters stay within a to f; value is SQL.
    """
    sign, letters = "-" if reverse else "+", 6 if hexadecimal else 26

    def move(x: str, other: str) -> str:
        c, by = f"substr({x}, i, 1)", _by(key, kind, "k", "i", other)
        within = lambda start, size: f"chr({start} + pmod(ascii({c}) - {start} {sign} {by}, {size}))"
        one = f"case when {c} between '0' and '9' then {within(48, 10)} when {c} between 'a' and 'z' then {within(97, letters)} when {c} between 'A' and 'Z' then {within(65, letters)} else {c} end"
        return f"if(length({x}) = 0, '', array_join(transform(sequence(1, greatest(length({x}), 1)), i -> {one}), ''))"

    order = f"sequence({ROUNDS - 1}, 0, -1)" if reverse else f"sequence(0, {ROUNDS - 1})"
    start = f"named_struct('l', substr({value}, 1, cast(length({value}) div 2 as int)), 'r', substr({value}, cast(length({value}) div 2 as int) + 1))"
    step = f"if(k % 2 = 0, named_struct('l', {move('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {move('s.r', 's.l')}))"
    return f"aggregate({order}, {start}, (s, k) -> {step}, s -> concat(s.l, s.r))"


def hex_feistel(value: str, key: str, kind: str, reverse: bool = False) -> str:
    """SQL for the keyed permutation of strings of small hex digits."""
    sign = "-" if reverse else "+"
    move = lambda x, other: f"array_join(transform(sequence(1, length({x})), i -> substr('{HEX}', cast(pmod(locate(substr({x}, i, 1), '{HEX}') - 1 {sign} {_by(key, kind, 'k', 'i', other)}, 16) as int) + 1, 1)), '')"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if reverse else f"sequence(0, {ROUNDS - 1})"
    start = f"named_struct('l', substr({value}, 1, cast(length({value}) div 2 as int)), 'r', substr({value}, cast(length({value}) div 2 as int) + 1))"
    step = f"if(k % 2 = 0, named_struct('l', {move('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {move('s.r', 's.l')}))"
    return f"aggregate({order}, {start}, (s, k) -> {step}, s -> concat(s.l, s.r))"


def number_feistel(value: str, sizes: tuple[int, int], key: str, kind: str, reverse: bool) -> str:
    """SQL for the keyed permutation of the numbers from 0 below the product of two sizes."""
    a, b = sizes
    sign = "-" if reverse else "+"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if reverse else f"sequence(0, {ROUNDS - 1})"
    step = f"if(h % 2 = 0, named_struct('l', pmod(f.l {sign} {_by(key, kind, 'h', 'f.r')}, {a}L), 'r', f.r), named_struct('l', f.l, 'r', pmod(f.r {sign} {_by(key, kind, 'h', 'f.l')}, {b}L)))"
    start = f"named_struct('l', cast({value} as bigint) div {b}L, 'r', cast({value} as bigint) % {b}L)"
    return f"aggregate({order}, {start}, (f, h) -> {step}, f -> f.l * {b}L + f.r)"


def _apart(value: str, key: str, kind: str, reverse: bool) -> str:
    """SQL for the keyed permutation of a value's digits and letters, the same whatever marks part them."""
    nth = "length(regexp_replace(substr(g, 1, i), '[^0-9A-Za-z]', ''))"
    refill = f"array_join(transform(sequence(1, length(g)), i -> if(substr(g, i, 1) rlike '[0-9A-Za-z]', substr(y, {nth}, 1), substr(g, i, 1))), '')"
    return _with("g", value, _with("y", _with("q", "regexp_replace(g, '[^0-9A-Za-z]', '')", feistel("q", key, kind, reverse)), refill))


def _luhn(digits: str) -> str:
    d = f"cast(substr({digits}, length({digits}) - p + 1, 1) as int) * if(p % 2 = 0, 2, 1)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + {d} - if({d} > 9, 9, 0)) % 10"


def _card(v: str, key: str, reverse: bool) -> str:
    digits = lambda x: f"regexp_replace({x}, '[ -]', '')"
    inner = _apart(f"substr({v}, 2, length({v}) - 2)", key, "card", reverse)
    made = _with("y", f"concat(substr({v}, 1, 1), {inner})", f"concat(y, cast((10 - {_with('z', digits('concat(y, 0)'), _luhn('z'))}) % 10 as string))")
    return f"if({_with('z', digits(v), _luhn('z'))} = 0, {made}, {v})"


def _iban_check(country: str, rest: str) -> str:
    """SQL for the two check digits."""
    c = "substr(z, p, 1)"
    modulo = f"aggregate(sequence(1, length(z)), 0, (t, p) -> (t * if({c} between '0' and '9', 10, 100) + if({c} between '0' and '9', ascii({c}) - 48, ascii({c}) - 55)) % 97)"
    return f"lpad(cast(98 - {_with('z', f"upper(concat(replace({rest}, ' ', ''), {country}, '00'))", modulo)} as string), 2, '0')"


def _iban(v: str, key: str, reverse: bool) -> str:
    country, rest = f"substr({v}, 1, 2)", f"substr({v}, 5)"
    made = _with("y", _apart(rest, key, "iban", reverse), f"concat({country}, {_iban_check(country, 'y')}, y)")
    return f"if(substr({v}, 3, 2) = {_iban_check(country, rest)}, {made}, {v})"


def _ssn(v: str, key: str, reverse: bool) -> str:
    area = f"cast(substr({v}, 1, 3) as int)"
    number = f"({area} - 1 - if({area} > 666, 1, 0)) * {NUMBERS[1]}L + (cast(substr({v}, 5, 2) as int) - 1) * 9999 + cast(substr({v}, 8, 4) as int) - 1"
    own = f"cast(y div {NUMBERS[1]}L as int) + 1"
    new = f"{own} + if({own} >= 666, 1, 0)"
    group, serial = f"(y % {NUMBERS[1]}L) div 9999 + 1", f"(y % {NUMBERS[1]}L) % 9999 + 1"
    pad = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
    return _with("y", _with("q", number, number_feistel("q", NUMBERS, key, "ssn", reverse)), f"concat_ws('-', {pad(new, 3)}, {pad(group, 2)}, {pad(serial, 4)})")


def _date(v: str, key: str, reverse: bool) -> str:
    """The permutation of days, until one is written with the same layout, language and numbers of digits."""
    tokens = r"[0-9]+|\p{L}{3,}"
    names = "array(" + ", ".join("array(" + ", ".join(map(_quoted, own)) + ")" for own in MONTHS.values()) + ")"
    named = lambda x: f"regexp_extract({x}, '(\\\\p{{L}}{{3,}})', 1)"
    language = lambda x: f"array_position(transform({names}, o -> array_contains(o, {named(x)})), true)"
    parts = lambda x: f"transform(regexp_extract_all({x}, '[0-9]+', 0), e -> cast(e as int))"
    day = lambda y, m, d: f"if({m} between 1 and 12 and {d} between 1 and 31, datediff(try_to_date(concat_ws('-', {y}, {m}, {d}), 'y-M-d'), date'1800-01-01'), null)"
    dmy, mdy = day("p[2]", "p[1]", "p[0]"), day("p[2]", "p[0]", "p[1]")
    # how a date is written: 0 year first, 1 day first, 2 month first, and with a name 10 and its language
    how = lambda x: _with("p", parts(x), f"case when {named(x)} <> '' then 10 + {language(x)} when p[0] > 31 then 0 when {dmy} is not null then 1 when {mdy} is not null then 2 else 3 end")
    month = f"array_position({names}[cast({language(v)} as int) - 1], {named(v)})"
    number = _with("p", parts(v), f"case when w.how >= 10 then {day('p[1]', month, 'p[0]')} when w.how = 0 then {day('p[0]', 'p[1]', 'p[2]')} when w.how = 1 then {dmy} when w.how = 2 then {mdy} end")
    # the tokens of v in order, with those of the date u in their places
    two = lambda x: f"if(length(e) = 2, lpad(cast({x} as string), 2, '0'), cast({x} as string))"
    first_is_day = "(w.how >= 10 or w.how = 1 and i = 0 or w.how = 2 and i = 1 or w.how = 0 and i = 2)"
    token = f"case when e rlike '[^0-9]' then {names}[cast(w.how as int) - 11][month(u) - 1] when length(e) = 4 then cast(year(u) as string) when {first_is_day} then {two('dayofmonth(u)')} else {two('month(u)')} end"
    written = f"concat_ws('', flatten(zip_with(split({v}, {_quoted(tokens)}, -1), transform(regexp_extract_all({v}, {_quoted(tokens)}, 0), (e, i) -> {token}), (g, t) -> array(g, coalesce(t, '')))))"
    shape = lambda x: f"regexp_replace(regexp_replace({x}, '\\\\p{{L}}{{3,}}', 'L'), '[0-9]', '9')"
    state = lambda n: _with("n", n, _with("u", "date_add(date'1800-01-01', cast(n as int))", _with("r", written, f"named_struct('n', n, 'r', r, 'ok', {shape('r')} = {shape(v)} and {how('r')} = w.how)")))
    again = lambda n: state(number_feistel(n, DAYS, key, "date", reverse))
    walk = f"aggregate(sequence(2, {WALK}), {again('d')}, (a, x) -> if(a.ok, a, {again('a.n')}), a -> if(a.ok, a.r, raise_error('a walk over dates did not end')))"
    days = DAYS[0] * DAYS[1]
    return _with("w", f"named_struct('how', {how(v)})", _with("d", f"cast({number} as bigint)", f"if(coalesce(d, {days}) between 0 and {days - 1}, {walk}, {v})"))


def pseudonym(value: str, key: str, reverse: bool = False) -> str:
    """SQL for the pseudonym of one match of the pattern."""
    whole = lambda kind: f"{value} rlike {_quoted('^(?:' + KINDS[kind] + ')$')}"
    named = lambda part, kind, **how: _with("q", part, feistel("q", key, kind, reverse, **how))
    email = f"concat({named(f"substr({value}, 1, locate('@', {value}) - 1)", 'email')}, substr({value}, locate('@', {value})))"
    either = f"if(q rlike '[A-F]', {feistel('q', key, 'token', reverse, hexadecimal=True)}, {hex_feistel('q', key, 'token', reverse)})"
    token = "concat('\"', " + _with("q", f"substr({value}, 2, length({value}) - 2)", either) + ", '\"')"
    access = f"concat('AKIA', {named(f'substr({value}, 5)', 'access')})"
    after = lambda start, kind: _with("c", f"regexp_extract({value}, {_quoted('^(' + start + ')')}, 1)", f"concat(c, {named(f'substr({value}, length(c) + 1)', kind)})")
    granted, secret, password = after("gh[pousr]_", "granted"), after("aws_secret_access_key ?[=:] ?", "secret"), after(_PASSWORD, "password")
    code = f"regexp_extract({value}, {_quoted(r'^([+][0-9]{1,3}|0[0-9]+[ /-]|[(]?[0-9])')}, 1)"
    phone = _with("c", code, f"concat(c, {_apart(f'substr({value}, length(c) + 1)', key, 'phone', reverse)})")
    hexed = f"array_join(transform(split({value}, '[.]'), o -> lpad(lower(hex(cast(o as bigint))), 2, '0')), '')"
    ip = _with("y", _with("q", hexed, hex_feistel("q", key, "ip", reverse)), "array_join(transform(sequence(1, 7, 2), o -> conv(substr(y, o, 2), 16, 10)), '.')")
    return (
        f"case when {value} like '%@%' then {email} when {value} like '\"%' then {token} when {value} like 'AKIA%' and length({value}) = 20 then {access} when {whole('granted')} then {granted} when {whole('secret')} then {secret} when {whole('password')} then {password} "
        f"when {whole('iban')} then {_iban(value, key, reverse)} when {whole('phone')} then {phone} when {whole('ssn')} then {_ssn(value, key, reverse)} when {whole('ip')} then {ip} "
        f"when {value} like '%:%' then {named(value, 'ip6', hexadecimal=True)} when {whole('date')} then {_date(value, key, reverse)} else {_card(value, key, reverse)} end"
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", reverse: bool = False) -> DataFrame:
    """docs with the text's values replaced, and n_values, the number of values that changed."""
    pattern = _quoted("|".join(f"(?:{p})" for p in KINDS.values()))
    clash = max(map(len, docs.columns))
    old, new = "_" * clash + "found", "_" * clash + "made"
    found = docs.withColumn(old, F.when(F.col(text).rlike("[0-9@=:]|AKIA|gh[pousr]_"), F.expr(f"regexp_extract_all(`{text}`, {pattern}, 0)")))
    some = F.size(old) > 0
    found = found.withColumn(new, F.when(some, F.expr(f"transform({old}, m -> {pseudonym('m', key, reverse)})")))
    parts = F.expr(f"split(`{text}`, {pattern}, -1)")
    joined: Column = F.concat_ws("", F.flatten(F.zip_with(parts, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    changed = F.size(F.expr(f"filter(zip_with({old}, {new}, (a, b) -> a <> b), x -> x)"))
    out = found.withColumn(text, F.when(some, joined).otherwise(F.col(text))).withColumn("n_values", F.when(some, changed).otherwise(0))
    return out.drop(old, new)
