"""Format-preserving pseudonyms for personal data and secrets, in SQL functions only.

A text is split at the values that one pattern finds; each value is checked for its kind and permuted by a keyed Feistel network, and the
text is put together again. Digits stay digits and letters stay letters of the same case, so formats, lengths and layout stay; a value
always gets the same pseudonym, in every document and run, and under the key the permutation can be undone.

- Card numbers (13 to 19 digits with a valid Luhn digit): all digits but the last are permuted, the last is computed. Of the groups
  of digits next to each other, from left to right: usual layouts first (unbroken; groups of four; 4, 6 and 4 or 5), else the longest that make up a
  valid number. A group is not split. Groups without a valid number count as one value found.
- Account numbers (IBAN, valid modulo 97, in capitals or not, unbroken or in groups of four): digits and letters after the check digits are permuted, the
  check digits are computed. Of groups, the longest row from the first on that makes up a valid number counts.
- Dates (1900 to 2099; year-month-day, or day and month first with dots or slashes): the day's number is permuted among the days of its decade.
- Internet addresses (four numbers up to 255): the 32-bit number is permuted.
- Phone numbers with a country code or in the form 555-123-4567 or (555) 123-4567, social security numbers: all digits after the country code are permuted.
- Mail addresses: the part before the @ is permuted, each letter within its alphabet and case (ALPHABETS); a part with other letters is replaced by a keyed
  hash of 16 hexadecimal digits. Access keys, and values of password, token, secret or key: the value is permuted.

The key is a parameter without a default, and reaches the plan as a value of a one-row table, so that no plan shows it; the query takes it from a setting, without which
only a local session gets an example key, and a cluster an error. Values that fail their check are
left as they are, and so are kinds not named here (version 6 and hardware addresses among them). Defined cases: a null text is empty; an empty text stays
empty; rows with equal or null identifiers are rewritten each; very long texts are read whole, with work in proportion to their length; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 6
#: Days of a decade, by whether it has three leap years or two: 13 * 281 and 44 * 83.
DECADES = {3653: (13, 281), 3652: (44, 83)}
#: The setting that holds the query's key, and the key of a session without it.
SETTING, EXAMPLE = "spark.glossarium.pseudonymKey", "example key, for data that needs none"



def _letters(ranges: str, keep) -> str:
    """The characters of ranges of code points, as `430-44F`, for which keep holds."""
    bounds = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return "".join(c for a, b in bounds for c in map(chr, range(a, b + 1)) if c.isalpha() and keep(c))


#: Letters beyond A-Z that mail addresses may have: Latin, Greek and Cyrillic by case, then Hebrew, Arabic, Devanagari, Hiragana and Katakana.
ALPHABETS = [_letters(r, keep) for r in ("B5-24F", "370-3FF", "400-4FF") for keep in (str.islower, str.isupper)]
ALPHABETS += [_letters(r, lambda c: True) for r in ("5D0-5EA", "621-64A", "904-939", "3041-3096", "30A1-30FA")]

#: Fixed formats, most special first.
SECRET = r"(?i:\b(?:password|passwd|token|secret|api[_-]?key)\s*)(?:=\s*\"?[A-Za-z0-9+/_-]{4,}+|:\s*\"?[A-Za-z0-9+/_-]{8,}+)"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
MAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])"
LOCAL = r"(?<![\d-])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)"
DATE = r"(?<![\d.])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?![\d])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
#: A stretch of groups of digits that may hold card numbers, up to where a value of another kind begins.
NEXT = f"[ -](?!{'|'.join((MAIL, LOCAL, DATE, SOCIAL, ADDRESS))})"
DIGITS = rf"(?<!\d)(?=\d(?:(?:{NEXT})?\d){{12}})\d++(?:{NEXT}\d++)*+"
ANY = "|".join((SECRET, ACCESS, MAIL, IBAN, PHONE, LOCAL, DATE, SOCIAL, ADDRESS, DIGITS))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with `name` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _number(key: str, *parts: str) -> str:
    """A keyed number from 0 to 2**60 - 1. `key` is an expression."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, {', '.join(parts)}), 256), 1, 15), 16, 10) as bigint)"


def _shifted(value: str, hexes: str, alphabets: list[str]) -> str:
    """The characters of a value, each moved within its class by a byte of the hexadecimal stream."""
    by = f"cast(conv(substr({hexes}, 2 * (i % 32) + 1, 2), 16, 10) as int)"
    more = " ".join(f"when locate(c, '{a}') > 0 then substr('{a}', (locate(c, '{a}') - 1 + {by}) % {len(a)} + 1, 1)" for a in alphabets)
    return f"""array_join(transform(split({value}, ''), (c, i) -> case
        when c >= '0' and c <= '9' then chr(48 + (ascii(c) - 48 + {by}) % 10)
        when c >= 'a' and c <= 'z' then chr(97 + (ascii(c) - 97 + {by}) % 26)
        when c >= 'A' and c <= 'Z' then chr(65 + (ascii(c) - 65 + {by}) % 26)
        {more} else c end), '')"""


def _characters(value: str, key: str, alphabets: list[str] | None = None) -> str:
    """A permutation of the strings of one format: a Feistel network over their halves. `value` is a name."""
    half = f"cast(length({value}) / 2 as int)"
    stream = f"sha2(concat_ws('|', {key}, cast(r as string), cast(length({value}) as string), z.b), 256)"
    step = _let("h", stream, _shifted("z.a", "h", alphabets or []))
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({value}, 1, {half}), 'b', substr({value}, {half} + 1)),
        (z, r) -> named_struct('a', z.b, 'b', {step}), z -> concat(z.a, z.b))"""


def _pair(value: str, key: str, left: int, right: int) -> str:
    """A permutation of the numbers below left * right: the two remainders are moved in turn."""
    a = f"(z.a + {_number(key, 'cast(r as string)', 'cast(z.b as string)')}) % {left}"
    b = f"(z.b + {_number(key, 'cast(r as string)', 'cast(z.a as string)')}) % {right}"
    return f"""aggregate(sequence(1, {ROUNDS + 2}), named_struct('a', {value} div {right}, 'b', {value} % {right}),
        (z, r) -> case when r % 2 = 1 then named_struct('a', {a}, 'b', z.b) else named_struct('a', z.a, 'b', {b}) end, z -> z.a * {right} + z.b)"""


def _luhn(digits: str) -> str:
    """The sum of a card number's digits by Luhn's rule, the last one undoubled."""
    return f"""aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int)
        when c >= '5' then 2 * cast(c as int) - 9 else 2 * cast(c as int) end), 0, (s, c) -> s + c)"""


def _mod97(account: str) -> str:
    """An account number's remainder, with its first four characters moved to the end and letters as 10 to 35."""
    return f"""aggregate(split(upper(concat(substr({account}, 5), substr({account}, 1, 4))), ''), 0, (s, c) ->
        case when c >= '0' and c <= '9' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"""


def _laid_out(layout: str, digits: str) -> str:
    """The digits in the places of the digits of a layout."""
    return f"""aggregate(split({layout}, ''), named_struct('o', '', 'n', 1), (z, c) -> case when c >= '0' and c <= '9'
        then named_struct('o', concat(z.o, substr({digits}, z.n, 1)), 'n', z.n + 1) else named_struct('o', concat(z.o, c), 'n', z.n) end, z -> z.o)"""


def _kinds(key: str) -> str:
    """The pseudonym of the value `m`; `key` is the name of a column."""
    use = lambda kind: f"concat({key}, '|{kind}')"
    whole = lambda p: f"m rlike {_quoted('^(?:' + p + ')$')}"
    plain = lambda d: f"regexp_replace({d}, '[^0-9]', '')"

    prefix = r"^(?i:(?:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*\"?)"
    secret = _let("p", f"regexp_extract(m, {_quoted(prefix)}, 0)", _let("v", "substr(m, length(p) + 1)", f"concat(p, {_characters('v', use('secret'))})"))
    access = _let("v", "substr(m, 5)", f"concat(substr(m, 1, 4), {_characters('v', use('access'))})")
    known = _quoted("^[\\x00-\\x7F" + "".join(ALPHABETS) + "]*$")
    local_part = f"case when octet_length(v) = length(v) then {_characters('v', use('mail'))} when v rlike {known} then {_characters('v', use('mail'), ALPHABETS)} else substr(sha2(concat_ws('|', {use('mail')}, v), 256), 1, 16) end"
    mail = _let("v", "substring_index(m, '@', 1)", f"concat({local_part}, substr(m, length(v) + 1))")
    body = _let("v", "substr(e, 5)", f"concat(substr(e, 1, 2), '00', {_characters('v', use('iban'))})")
    iban = _let("e", "regexp_replace(array_join(slice(g, 1, n), ''), ' ', '')", _let("w", body, f"concat(substr(w, 1, 2), lpad(cast(98 - {_mod97('w')} as string), 2, '0'), substr(w, 5))"))
    valid = _let("c", "regexp_replace(array_join(slice(g, 1, n), ''), ' ', '')", f"case when length(c) between 15 and 34 then {_mod97('c')} = 1 else false end")
    longest = f"coalesce(array_max(filter(sequence(1, size(g)), n -> {valid})), 0)"
    spaced = "concat(regexp_replace(i, '(.{4})(?=.)', case when n > 1 then '$1 ' else '$1' end), array_join(slice(g, n + 1, size(g) - n), ''))"
    iban = _let("g", "regexp_extract_all(m, ' ?[A-Za-z0-9]+', 0)", _let("n", longest, f"case when n = 0 then m else {_let('i', iban, spaced)} end"))
    country = _let("p", r"regexp_extract(m, '^\\+[0-9]+', 0)", _let("v", plain("substr(m, length(p) + 1)"), _let("w", _characters("v", use("phone")), f"concat(p, {_laid_out('substr(m, length(p) + 1)', 'w')})")))
    local = _let("v", plain("m"), _let("w", _characters("v", use("phone")), _laid_out("m", "w")))
    social = _let("v", plain("m"), _let("w", _characters("v", use("social")), _laid_out("m", "w")))
    day = "coalesce(try_to_timestamp(m, 'yyyy-MM-dd'), try_to_timestamp(translate(m, './', '--'), 'dd-MM-yyyy'), try_to_timestamp(translate(m, './', '--'), 'MM-dd-yyyy'))"
    start = "make_date(cast(floor(year(t) / 10) * 10 as int), 1, 1)"
    days = "datediff(add_months(s, 120), s)"
    among = "case " + " ".join(f"when {days} = {size} then {_pair('n', f'concat({use("date")}, year(s))', *sides)}" for size, sides in DECADES.items()) + " end"
    new = _let("s", start, _let("n", "cast(datediff(cast(t as date), s) as bigint)", f"date_add(s, cast({among} as int))"))
    form = "case when m like '____-%' then 'yyyy-MM-dd' when try_to_timestamp(translate(m, './', '--'), 'dd-MM-yyyy') is not null then concat('dd', substr(m, 3, 1), 'MM', substr(m, 6, 1), 'yyyy') else concat('MM', substr(m, 3, 1), 'dd', substr(m, 6, 1), 'yyyy') end"
    # a date that can be read both ways is read day first
    date = _let("t", day, f"case when t is null then m else {_let('d', new, f'date_format(d, {form})')} end")
    octets = "transform(split(m, '[.]'), x -> cast(x as bigint))"
    four = _let("n", "o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]", _let("w", _pair("n", use("address"), 65536, 65536), "concat_ws('.', w div 16777216, (w div 65536) % 256, (w div 256) % 256, w % 256)"))
    address = _let("o", octets, f"case when exists(o, x -> x > 255) then m else {four} end")
    digits = _let("v", "substr(d, 1, length(d) - 1)", _let("w", _characters("v", use("card")), f"concat(w, cast((10 - {_luhn("concat(w, '0')")} % 10) % 10 as string))"))
    card = lambda m: _let("d", plain(m), _let("e", digits, _laid_out(m, "e")))
    cases = ((SECRET, secret), (ACCESS, access), (MAIL, mail), (IBAN, iban), (PHONE, country), (LOCAL, local), (DATE, date), (SOCIAL, social), (ADDRESS, address))
    one = _let("w", "case " + " ".join(f"when {whole(p)} then {f}" for p, f in cases) + " end", "named_struct('text', w, 'found', 1, 'replaced', cast(w <> m as int))")
    return f"case when {' or '.join(whole(p) for p, _ in cases)} then {one} else {_cards(card)} end"


def _cards(card) -> str:
    """The stretch `m` with the valid card numbers among its groups of digits replaced by `card`, from left to right.

    Of those that begin at one group, a usual layout (unbroken, groups of four, or 4, 6 and 4 or 5) goes first, then the longest that holds no usual one.
    """
    joined = lambda start, n: f"array_join(slice(g, {start}, {n}), '')"
    sizes = _quoted(r"^[ -]?(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5})$")
    valid = lambda n: _let("c", f"regexp_replace({joined('i', n)}, '[^0-9]', '')", f"case when length(c) between 13 and 19 then {_luhn('c')} % 10 = 0 else false end")
    usual = "case " + " ".join(f"when {joined('i', n)} rlike {sizes} and {valid(n)} then {n}" for n in (1, 3, 4)) + " else 0 end"
    inside = "exists(slice(u, i + 1, n - 1), x -> x > 0)"
    longest = f"coalesce(array_max(filter(sequence(1, least(19, size(g) - i + 1)), n -> {valid('n')} and not {inside})), 0)"
    longest = f"case when u[i - 1] > 0 then u[i - 1] else {longest} end"
    step = _let("n", longest, "case when n = 0 then z else named_struct('free', i + n, 'at', concat(z.at, array(named_struct('i', i, 'n', n)))) end")
    start = "named_struct('free', 1, 'at', cast(array() as array<struct<i:int,n:int>>))"
    places = f"aggregate(sequence(1, size(g)), {start}, (z, i) -> case when i < z.free then z else {step} end, z -> z.at)"
    # a group holds the separator before it, which stays in front of the number
    before = "case when x = 0 then 1 else at[x - 1].i + at[x - 1].n end"
    part = _let("b", before, _let("s", joined("p.i", "p.n"), f"concat({joined('b', 'p.i - b')}, {card('s')})"))
    rest = _let("b", "case when size(at) = 0 then 1 else at[size(at) - 1].i + at[size(at) - 1].n end", joined("b", "size(g) - b + 1"))
    made = f"named_struct('text', concat(array_join(transform(at, (p, x) -> {part}), ''), {rest}), 'found', case when size(at) > 0 then size(at) when exists(g, x -> length(x) < 20) then 1 else 0 end, 'replaced', size(filter(at, p -> {_let('s', joined('p.i', 'p.n'), f"{card('s')} <> s")})))"
    return _let("g", "regexp_extract_all(m, '[ -]?[0-9]+', 0)", _let("u", f"transform(sequence(1, size(g)), i -> {usual})", _let("at", places, made)))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_found (values of a known format) and n_replaced."""
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), secret.alias("key"))
    rows = rows.withColumn("found", F.expr(f"regexp_extract_all(body, {_quoted(ANY)}, 0)"))
    rows = rows.withColumn("made", F.expr(f"transform(found, m -> {_kinds("key")})"))
    joined = f"array_join(zip_with(split(body, {_quoted(ANY)}, -1), made, (p, m) -> concat(p, coalesce(m.text, ''))), '')"
    return rows.select(
        "doc_id",
        F.expr(f"case when size(found) = 0 then body else {joined} end").alias("text"),
        F.expr("aggregate(made, 0L, (s, z) -> s + z.found)").alias("n_found"),
        F.expr("aggregate(made, 0L, (s, z) -> s + z.replaced)").alias("n_replaced"),
    )


def key_of(spark: SparkSession) -> str:
    """The session's key. Only a local session may go without: pseudonyms under the example key can be undone by anyone."""
    key = spark.conf.get(SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} isn't set")
    return key or EXAMPLE


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` with its personal data and secrets replaced, under the key of SETTING."""
    return pseudonymised(table(spark, sf_dir, "documents"), key_of(spark))
