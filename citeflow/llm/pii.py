"""Format-preserving pseudonyms by keyed Feistel networks, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.common import table

#: The session's setting that names the key, and the key of sessions that don't set it, as in tests.
KEY_SETTING, TEST_KEY = "spark.citeflow.pseudonymKey", "citeflow"

#: What is looked for, in Java regular expressions, most specific first. Java's
#: matcher recurses over repeated groups, so each has a bound: a domain has 127 labels at most.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}+",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)\d(?:(?:[ -](?!\d{4}-\d{2}-\d{2}(?!\d)))?\d){12,18}(?!\d)",
    "secret": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])|(?i:password|passwd|secret|token|api_key|apikey)\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,}+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
#: Days from 1900-01-01 within which dates are permuted: 270 times 270.
DAYS = 270 * 270
#: Steps of a walk to a date of the same reading; all but one of 10 ** 12 end sooner.
WALKS = 32


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for value, which is then worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(values: str, radices: str, key: str, tweak: str, inverse: bool = False) -> str:
    """SQL for a permutation of arrays of numbers, each from 0 to under its radix.

    An unbalanced Feistel network: in each round the numbers of one half are shifted by
    what a SHA-256 of key, tweak, round and the other half gives, modulo their radices.
    An even number of rounds brings the halves back to their places.
    """
    sign = "-" if inverse else "+"
    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"
    moved, by = ("s.r", "s.l") if inverse else ("s.l", "s.r")
    radix = "s.q" if inverse else "s.p"
    digest = f"sha2(concat_ws('|', {_sql(key)}, {tweak}, cast(i as string), array_join(transform({by}, x -> cast(x as string)), ',')), 256)"
    shifted = _let("h", digest, f"transform({moved}, (x, j) -> cast(pmod(x {sign} cast(conv(substring(h, 1 + 4 * (j % 15), 7), 16, 10) as bigint), element_at({radix}, j + 1)) as int))")
    step = f"named_struct('l', {shifted}, 'r', s.l, 'p', s.q, 'q', s.p)" if inverse else f"named_struct('l', s.r, 'r', {shifted}, 'p', s.q, 'q', s.p)"
    half = "cast((size(v) + 1) div 2 as int)"
    start = "named_struct('l', slice(v, 1, k), 'r', slice(v, k + 1, size(v)), 'p', slice(m, 1, k), 'q', slice(m, k + 1, size(v)))"
    fold = f"aggregate({rounds}, {start}, (s, i) -> {step}, s -> concat(s.l, s.r))"
    return _let("v", values, _let("m", radices, _let("k", half, fold)))


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _characters(text: str, key: str, tweak: str, inverse: bool = False) -> str:
    """Each letter or digit for one of its own class; other characters stay."""
    of = lambda s: f"instr('{s}', c)"
    value = f"transform(cs, c -> case when {of(_DIGIT)} > 0 then {of(_DIGIT)} - 1 when {of(_LOWER)} > 0 then {of(_LOWER)} - 1 when {of(_UPPER)} > 0 then {of(_UPPER)} - 1 else 0 end)"
    radix = f"transform(cs, c -> case when {of(_DIGIT)} > 0 then 10 when {of(_LOWER)} > 0 or {of(_UPPER)} > 0 then 26 else 1 end)"
    back = f"case when {of(_DIGIT)} > 0 then substring('{_DIGIT}', f + 1, 1) when {of(_LOWER)} > 0 then substring('{_LOWER}', f + 1, 1) when {of(_UPPER)} > 0 then substring('{_UPPER}', f + 1, 1) else c end"
    return _let("cs", f"split({text}, '')", f"array_join(zip_with(cs, {feistel(value, radix, key, tweak, inverse)}, (c, f) -> {back}), '')")


def _digits_of(text: str) -> str:
    return f"transform(split(regexp_replace({text}, '[^0-9]', ''), ''), x -> cast(x as int))"


def _luhn(digits: str) -> str:
    """The Luhn sum of an array of digits, modulo 10; valid numbers give 0."""
    return f"aggregate(transform(reverse({digits}), (x, i) -> if(i % 2 = 1, if(x > 4, 2 * x - 9, 2 * x), x)), 0, (a, x) -> a + x) % 10"


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    step = "if(c rlike '[0-9]', named_struct('t', concat(s.t, cast(element_at(ds, s.n) as string)), 'n', s.n + 1), named_struct('t', concat(s.t, c), 'n', s.n))"
    return _let("ds", digits, f"aggregate(split({text}, ''), named_struct('t', '', 'n', 1), (s, c) -> {step}, s -> s.t)")


def _card(text: str, key: str, inverse: bool) -> str:
    """The longest run of whole groups of digits that is a valid number, the first among equals, gets another valid one.

    The permutation goes on until no run before it is valid, so the inverse finds the same run.
    """
    lengths, n = f"transform(split({text}, '[ -]'), x -> length(x))", "cast(size(ls) as int)"
    starts = f"transform(sequence(0, {n} - 1), i -> aggregate(slice(ls, 1, i), 0, (a, x) -> a + x))"
    every = f"flatten(transform(sequence(0, {n} - 1), i -> transform(sequence(i, {n} - 1), j -> named_struct('m', ss[i] - ss[j] - ls[j], 'a', ss[i]))))"
    runs = _let("ls", lengths, _let("ss", starts, f"array_sort(filter({every}, r -> r.m between -19 and -13))"))

    def first(digits: str) -> str:
        return f"get(filter(rs, r -> {_luhn(f'slice({digits}, r.a + 1, -r.m)')} = 0), 0)"

    payload = "slice(w.d, c.a + 1, -c.m - 1)"
    new = feistel(payload, f"transform({payload}, x -> 10)", key, "'card'", inverse)
    checked = _let("e", new, f"concat(slice(w.d, 1, c.a), e, array(cast((10 - {_luhn('concat(e, array(0))')}) % 10 as int)), slice(w.d, c.a - c.m + 1, 19))")
    step = _let("g", checked, f"named_struct('d', g, 'go', {first('g')} <> c)")
    walk = f"aggregate(sequence(1, {WALKS}), named_struct('d', d, 'go', true), (w, z) -> if(w.go, {step}, w), w -> w.d)"
    found = _let("c", first("d"), f"if(c is null, {text}, {_refill(text, walk)})")
    return _let("d", _digits_of(text), _let("rs", runs, found))


def _national(text: str, key: str, inverse: bool) -> str:
    """Area 001 to 899 but 666, group 01 to 99 and serial 0001 to 9999 are permuted among themselves; numbers that break a rule, among those that break the same."""
    good = "(nv[0] between 1 and 899 and nv[0] <> 666)"
    area = f"if({good}, if(nv[0] < 666, nv[0] - 1, nv[0] - 2), if(nv[0] = 0, 0, if(nv[0] = 666, 1, nv[0] - 898)))"
    group = f"if({good} and nv[1] > 0, nv[1] - 1, nv[1])"
    serial = f"if({good} and nv[1] > 0 and nv[2] > 0, nv[2] - 1, nv[2])"
    radices = f"array(if({good}, 898, 102), if({good}, if(nv[1] > 0, 99, 1), 100), if({good} and nv[1] > 0, if(nv[2] > 0, 9999, 1), 10000))"
    back = [f"lpad(cast(if({good}, if(f[0] < 665, f[0] + 1, f[0] + 2), if(f[0] = 0, 0, if(f[0] = 1, 666, f[0] + 898))) as string), 3, '0')",
            f"lpad(cast(if({good} and nv[1] > 0, f[1] + 1, f[1]) as string), 2, '0')",
            f"lpad(cast(if({good} and nv[1] > 0 and nv[2] > 0, f[2] + 1, f[2]) as string), 4, '0')"]
    new = feistel(f"array({area}, {group}, {serial})", radices, key, "'national'", inverse)
    return _let("nv", f"transform(split({text}, '-'), x -> cast(x as int))", _let("f", new, f"concat_ws('-', {', '.join(back)})"))


def _phone(text: str, key: str, inverse: bool) -> str:
    """The country's code stays; area and exchange, which begin with 2 to 9, do so afterwards, and others don't."""
    head = _sql("^([+][0-9]{1,3}(?=[0-9]{10}$)|[+][0-9]+[ .(-])?")
    lead = "(i = size(d) - 10 or i = size(d) - 7)"
    values, radices = f"transform(d, (x, i) -> if({lead} and x > 1, x - 2, x))", f"transform(d, (x, i) -> if({lead}, if(x > 1, 8, 2), 10))"
    new = _let("f", feistel(values, radices, key, "'phone'", inverse), f"transform(d, (x, i) -> if({lead} and x > 1, f[i] + 2, f[i]))")
    return _let("a", f"regexp_extract({text}, {head}, 0)", _let("b2", f"substring({text}, length(a) + 1)", _let("d", _digits_of("b2"), f"concat(a, {_refill('b2', new)})")))


def _iban(text: str, key: str, inverse: bool) -> str:
    """Country and format stay, the check digits are worked out anew; what fails the check modulo 97 stays as it is."""
    def rest(body: str, check: str) -> str:
        number = f"instr('{_DIGIT}{_UPPER}', c) - 1"
        return f"aggregate(transform(split(concat(replace({body}, ' ', ''), substring({text}, 1, 2), {check}), ''), c -> {number}), 0, (s, x) -> if(x > 9, s * 100 + x, s * 10 + x) % 97)"

    body = f"substring({text}, 5)"
    new = _let("n2", _characters(body, key, _sql("iban"), inverse), f"concat(substring({text}, 1, 2), lpad(cast(98 - {rest('n2', _sql('00'))} as string), 2, '0'), n2)")
    return f"if({rest(body, f'substring({text}, 3, 2)')} = 1, {new}, {text})"


def _ip(text: str, key: str, inverse: bool) -> str:
    base = "transform(o, x -> if(x > 99, 100, if(x > 9, 10, 0)))"
    radix = "transform(o, x -> if(x > 99, 156, if(x > 9, 90, 10)))"
    new = feistel(f"zip_with(o, {base}, (x, b) -> x - b)", radix, key, "'ip'", inverse)
    good = f"exists(o, x -> x > 255) or exists(split({text}, '\\\\.'), x -> length(x) > 1 and startswith(x, '0'))"
    return _let("o", f"transform(split({text}, '\\\\.'), x -> cast(x as int))", f"if({good}, {text}, array_join(zip_with({base}, {new}, (b, f) -> cast(b + f as string)), '.'))")


def _date(text: str, key: str, inverse: bool) -> str:
    formats = [("____-__-__", "yyyy-MM-dd"), ("__/__/____", "dd/MM/yyyy"), ("__/__/____", "MM/dd/yyyy"), ("__.__.____", "dd.MM.yyyy")]
    cases = []
    for like, form in formats:
        n = f"datediff(to_date(try_to_timestamp({text}, '{form}')), date'1900-01-01')"
        new = feistel("array(cast(n div 270 as int), cast(n % 270 as int))", "array(270, 270)", key, "'date'", inverse)
        if form == "MM/dd/yyyy":  # only days over 12 are read this way, so permute until there is one again
            again = _let("n", "w.n", _let("f", new, "named_struct('n', f[0] * 270 + f[1], 'go', day(date_add(date'1900-01-01', f[0] * 270 + f[1])) <= 12)"))
            walk = f"aggregate(sequence(1, {WALKS}), named_struct('n', n, 'go', true), (w, z) -> if(w.go, {again}, w), w -> w.n)"
            there = _let("n", n, f"date_format(date_add(date'1900-01-01', {walk}), '{form}')")
        else:
            there = _let("n", n, _let("f", new, f"date_format(date_add(date'1900-01-01', f[0] * 270 + f[1]), '{form}')"))
        cases.append(f"when {text} like '{like}' and {n} between 0 and {DAYS - 1} then {there}")
    return f"case {' '.join(cases)} else {text} end"


def _secret(text: str, key: str, inverse: bool) -> str:
    head = _sql("^(AKIA|[A-Za-z_]+[ ]?[=:][ ]?[\"']?)")
    return _let("a", f"regexp_extract({text}, {head}, 1)", f"concat(a, {_characters(f'substring({text}, length(a) + 1)', key, _sql('secret'), inverse)})")


def pseudonym(text: str, key: str, inverse: bool = False) -> str:
    """SQL for the pseudonym of one match; a number, address or date that isn't valid stays as it is."""
    def whole(name: str) -> str:
        return _sql("^(?:" + PATTERNS[name] + ")$")

    return f"""case
        when {text} rlike {whole('email')} then concat({_characters(f"substring_index({text}, '@', 1)", key, _sql('email'), inverse)}, '@', substring_index({text}, '@', -1))
        when {text} rlike {whole('secret')} then {_secret(text, key, inverse)}
        when {text} rlike {whole('ip')} then {_ip(text, key, inverse)}
        when {text} rlike {whole('date')} then {_date(text, key, inverse)}
        when {text} rlike {whole('national')} then {_national(text, key, inverse)}
        when {text} rlike {whole('phone')} then {_phone(text, key, inverse)}
        when {text} rlike {whole('iban')} then {_iban(text, key, inverse)}
        when {text} rlike {whole('card')} then {_card(text, key, inverse)}
        else {text} end"""


def pseudonymise(docs: DataFrame, key: str, column: str = "text", found: str | None = None, inverse: bool = False) -> DataFrame:
    """docs with the personal values of a text column replaced by pseudonyms of the same format.

    The permutation depends on the key and the kind of value only, so equal values get
    equal pseudonyms in all documents, and different ones stay different; with
    ``inverse`` it is undone. ``found`` names a column for the number of places that
    look personal; a column of that name is replaced. Null texts stay null, empty ones empty, texts
    of any length are read whole; rows are neither dropped nor merged, and other columns stay. An empty
    table gives no rows. Seven-digit local phone numbers are not looked for.
    """
    c = f"`{column}`"
    pattern = _sql(ANY)
    new = _let("t", c, f"array_join(zip_with(split(t, {pattern}, -1), regexp_extract_all(t, {pattern}, 0), (a, b) -> concat(a, coalesce({pseudonym('b', key, inverse)}, ''))), '')")
    maybe = f"{c} rlike '[0-9@=:]'"
    if found:
        docs = docs.withColumn(found, F.expr(f"cast(if(coalesce({maybe}, false), size(regexp_extract_all({c}, {pattern}, 0)), 0) as int)"))
    return docs.withColumn(column, F.expr(f"if(coalesce({maybe}, false), {new}, {c})"))


def key_of(spark: SparkSession) -> str:
    """The key that the session sets, else the tests' key."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark), found="n_found").select("doc_id", "n_found", "text")
