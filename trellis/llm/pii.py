"""Operator 2: format-preserving pseudonyms of personal data, in DataFrame functions only.

A value is found by a pattern, validated, mapped to a number pair (l, r) of the domain
Z_a x Z_b of all valid values of its kind, and permuted there by a keyed Feistel network:
rounds add a keyed hash of one half to the other, modulo a or b in turn.  That is a
permutation, so distinct values get distinct pseudonyms, equal values the same one in
every document and in every notation, and the result is valid again:

* payment cards (13-19 digits, Luhn): the first digit and the length stay, the digits
  between are permuted, the check digit is computed anew; among further numbers (expiry,
  security code) a card is the longest valid span of whole groups from the first group on
  that begins one, and values of the other kinds go first;
* telephone numbers (+1 and ten-digit notations with valid area and exchange codes are
  permuted among such numbers, other numbers after an explicit +1 among the other ones; other
  +numbers keep length and the first two digits);
* IPv4 addresses, social security numbers, and dates from 1900 to 2099 in the notations
  2024-01-31, 31.01.2024 and 31/01/2024, permuted among the days of these years;
* e-mail addresses: the letters and the digits before the @ are permuted, blockwise, with
  the domain as tweak; the domain stays.

Separators stay where they are.  What a check refuses stays as it is.

The key is part of the plan: keep the session's event log and UI as secret as the key.

Defined results: a null text stays null and counts no values, an empty one stays empty; all
other columns and all rows, repeated ones too, pass unchanged.  Very long texts are searched in
steps linear in their length and with a bounded stack; of an e-mail address the domain may have
127 labels, the local part 64 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.scratch import free_name

ROUNDS = 8
# Repeats are possessive or bounded (a domain has 127 labels at most): the engine's stack and steps don't grow with the text.
EMAIL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,24}+(?![\w-])"
IPV4 = r"(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\w|\.[0-9])"
DATE = r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
_CARD_END = r"(?!\w|-(?![0-9]))"
CARD = rf"(?<![\w.-])[0-9](?:[ -]?[0-9]){{12,18}}{_CARD_END}"
#: A group of digits, by itself or after a dash that follows a digit.
GROUP = rf"(?<![\w.])(?<!(?<![0-9])-)[0-9]{{1,19}}+{_CARD_END}"
PHONE = r"(?<![\w+-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"
NORTH = r"(?<![\w+])\+1(?:[ .()-]{0,2}[0-9]){10}(?![\w-])"  # any separators after an explicit +1
ABROAD = r"(?<![\w+])\+[2-9][0-9](?:[ .()-]{0,2}[0-9]){6,13}(?![\w-])"
_OTHERS = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, NORTH, ABROAD))
ANY = f"{_OTHERS}|{CARD}"

_DAYS = (17, 4297)  # 73,049 days from 1900-01-01 to 2099-12-31
_MAX_BLOCK = 10  # letters of a block
_RUN = 256  # tokens of a run


def _hash(key: str, tweak: Column, i: Column, half: Column, modulus: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % modulus


def feistel(key: str, tweak: Column, l: Column, r: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Permute (l, r) of Z_a x Z_b; a struct of l and r."""
    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(((s["l"] + _hash(key, tweak, i, s["r"], a)) % a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _hash(key, tweak, i, s["l"], b)) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambdas are interpreted and would compute it at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _tens(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(18)]), (k + 1).cast("int"))


def _put(shape: Column, pattern: str, values: Column) -> Column:
    """The characters of ``values`` in the places of ``shape`` that match ``pattern``."""

    def put(given: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

        def char(s: Column, c: Column) -> Column:
            taken = F.struct(F.concat(s["text"], F.substring(given, s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next"))
            return F.when(c.rlike(f"[{pattern}]"), taken).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["next"].alias("next")))

        return F.aggregate(F.split(shape, ""), start, char, lambda s: s["text"])

    return _let(values, put)


def _luhn(digits: Column) -> Column:
    def add(s: Column, c: Column) -> Column:
        d = F.ascii(c) - 48
        more = F.when(s["twice"], d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return F.struct((s["total"] + F.when(c == "", 0).otherwise(more)).alias("total"), (~s["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("twice"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda s: s["total"])


def _digits(key: str, tweak: Column, s: Column) -> Column:
    """Permute a string of 2 to 34 digits within its length."""
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    made = feistel(key, tweak, F.substring(s, F.lit(1), u).cast("long"), F.substring(s, u + 1, n - u).cast("long"), _tens(u), _tens(n - u))
    return _let(made, lambda out: F.concat(F.lpad(out["l"].cast("string"), u, "0"), F.lpad(out["r"].cast("string"), n - u, "0")))


def _card(key: str, s: Column) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _digits(key, F.concat(F.lit("card"), F.substring(d, 1, 1)), F.substring(d, F.lit(2), F.length(d) - 2)))
        check = lambda b: (10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10
        return F.when(_luhn(d) % 10 == 0, _put(s, "0-9", _let(body, lambda b: F.concat(b, check(b).cast("string")))))

    return _let(_only_digits(s), new)


def _refused_card(s: Column) -> Column:
    return s.rlike(rf"\A(?:{CARD})\z") & (_luhn(_only_digits(s)) % 10 != 0)


def _span(tokens: Column, pieces: Column, i: Column) -> Column:
    """How many tokens from number i on make the longest valid card of whole groups; null where none does."""
    chained = (F.get(pieces, i) == "-") & (i > 0) & F.get(tokens, i - 1).rlike(r"\A[0-9]+\z")
    start = ~F.endswith(F.get(pieces, i), F.lit("-")) | chained
    # slices would copy the whole array for each token: elements are taken one by one, up to the first that ends every span
    digits = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.get(tokens, i + j)), "")
    open_ = lambda j: F.get(pieces, i + j).isin(" ", "-") & F.get(tokens, i + j).rlike(r"\A[0-9]+\z")
    most = F.aggregate(F.sequence(F.lit(1), F.lit(18)), F.lit(1), lambda k, j: F.when((k == j) & open_(j), k + 1).otherwise(k))
    valid = lambda k: digits(k).rlike(r"\A[0-9]{13,19}\z") & (_luhn(digits(k)) % 10 == 0)
    here = F.get(tokens, i).rlike(r"\A[0-9]+\z") & start
    return F.when(here, F.get(F.filter(F.sequence(most, F.lit(1), F.lit(-1)), valid), F.lit(0)))


def _joined(tokens: Column, pieces: Column, spans: Column) -> Column:
    """For each token the whole span that begins there, with its separators; null where none does."""

    def one(k: Column, i: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.concat(F.when(j > 0, F.get(pieces, i + j)).otherwise(""), F.get(tokens, i + j)))
        return F.when(k.isNotNull(), F.array_join(parts, ""))

    return F.transform(spans, one)


def _left_to_right(tokens: Column, pieces: Column, spans: Column, cards: Column, others: Column) -> Column:
    """Text and number of values replaced: a card uses up its span, other tokens stand for themselves.

    Tokens are taken in runs of ``_RUN``, so that no string or array grows token by token.
    """
    n = F.size(tokens)

    def token(s: Column, i: Column) -> Column:
        lead = F.concat(s["text"], F.get(pieces, i))
        card = F.struct((i + F.get(spans, i)).alias("free"), F.concat(lead, F.get(cards, i)).alias("text"), (s["n"] + 1).alias("n"))
        changed = F.when(F.get(others, i) != F.get(tokens, i), 1).otherwise(0)
        other = F.struct(s["free"].alias("free"), F.concat(lead, F.get(others, i)).alias("text"), (s["n"] + changed).alias("n"))
        return F.when(i < s["free"], s).when(F.get(spans, i).isNotNull(), card).otherwise(other)

    def run(s: Column, c: Column) -> Column:
        begin = F.struct(s["free"].alias("free"), F.lit("").alias("text"), s["n"].alias("n"))
        ends = lambda x: F.struct(x["free"].alias("free"), F.array_append(s["texts"], x["text"]).alias("texts"), x["n"].alias("n"))
        return F.aggregate(F.sequence(c * _RUN, F.least((c + 1) * _RUN, n) - 1), begin, token, ends)

    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("n"))
    ends = lambda x: F.struct(F.concat(F.array_join(x["texts"], ""), F.element_at(pieces, -1)).alias("text"), x["n"].alias("n"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")), start, run, ends)


def _among_numbers(out: DataFrame, key: str, rest_col: str) -> DataFrame:
    """``rest_col`` (tokens, pieces) becomes (text, n), with cards sought among groups of digits.

    Each step is a column of its own, so that none is computed twice.
    """
    names = {n: free_name(out.columns, f"pii_{n}") for n in ("spans", "joined", "cards", "others")}
    rest, c = F.col(rest_col), lambda n: F.col(names[n])
    tokens, pieces = rest["tokens"], rest["pieces"]
    some = lambda x: F.when(rest.isNotNull(), x)
    number = lambda t: t.rlike(r"\A[0-9]+\z")
    out = out.withColumn(names["spans"], some(F.transform(tokens, lambda _, i: _span(tokens, pieces, i))))
    out = out.withColumn(names["joined"], some(_joined(tokens, pieces, c("spans"))))
    out = out.withColumn(names["cards"], some(F.transform(c("joined"), lambda s: F.when(s.isNotNull(), _card(key, s)))))
    out = out.withColumn(names["others"], some(F.transform(tokens, lambda t: F.when(number(t), t).otherwise(pseudonym(key, t)))))
    out = out.withColumn(rest_col, some(_left_to_right(tokens, pieces, c("spans"), c("cards"), c("others"))))
    return out.drop(*names.values())


def _phone(key: str, s: Column) -> Column:
    def new(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        area, exchange, line = (F.substring(ten, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        valid = (area >= 200) & (exchange >= 200)
        # the others: 200 x 1000 with a low area code, then 800 x 200 with a low exchange code alone
        low = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        head = F.when(valid, (area - 200) * 800 + exchange - 200).otherwise(low)
        made = feistel(key, F.when(valid, "phone").otherwise("phone-low"), head, line, F.when(valid, 640_000).otherwise(360_000), F.lit(10_000))

        def spelt(out: Column) -> Column:
            new_low = F.when(out["l"] < 200_000, out["l"]).otherwise(200_000 + F.floor((out["l"] - 200_000) / 200) * 1000 + (out["l"] - 200_000) % 200)
            six = F.when(valid, (F.floor(out["l"] / 800) + 200) * 1000 + out["l"] % 800 + 200).otherwise(new_low)
            return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.lpad(six.cast("string"), 6, "0"), F.lpad(out["r"].cast("string"), 4, "0"))

        return F.when(valid | s.startswith("+1"), _put(s, "0-9", _let(made, spelt)))

    return _let(_only_digits(s), new)


def _abroad(key: str, s: Column) -> Column:
    d = _only_digits(s)
    return _put(s, "0-9", F.concat(F.substring(d, 1, 2), _digits(key, F.concat(F.lit("abroad"), F.substring(d, 1, 2)), F.substring(d, F.lit(3), F.length(d) - 2))))


def _ipv4(key: str, s: Column) -> Column:
    def spelt(out: Column) -> Column:
        parts = [F.floor(out[h] / 256) if k == 0 else out[h] % 256 for h in "lr" for k in (0, 1)]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    def new(o: Column) -> Column:
        return F.when(F.array_max(o) < 256, _let(feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536)), spelt))

    return _let(F.transform(F.split(s, r"\."), lambda x: x.cast("long")), new)


def _ssn(key: str, s: Column) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - F.when(area > 666, 2).otherwise(1)  # 666 and 000 are no areas
    made = feistel(key, F.lit("ssn"), index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def spelt(out: Column) -> Column:
        new = F.floor(out["l"] / 99)
        new = new + F.when(new + 1 >= 666, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((out["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((out["r"] + 1).cast("string"), 4, "0"))

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), _let(made, spelt))


def _date(key: str, s: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def one(form: str) -> Column:
        def spelt(out: Column) -> Column:
            return F.date_format(F.date_add(first, (out["l"] * _DAYS[1] + out["r"]).cast("int")), form)

        def known(day: Column) -> Column:
            made = feistel(key, F.lit("date"), F.floor(day / _DAYS[1]), day % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]))
            return F.when((day >= 0) & (day < _DAYS[0] * _DAYS[1]), _let(made, spelt))

        return _let(F.datediff(F.to_date(F.try_to_timestamp(s, F.lit(form))), first), known)

    forms = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "dd/MM/yyyy"))
    return F.coalesce(*[F.when(s.contains(mark), one(form)) for mark, form in forms])


def _letters(key: str, tweak: Column, s: Column) -> Column:
    """Permute small letters in blocks of up to ten; a block is a number in base 26, split in two halves."""
    a = "abcdefghijklmnopqrstuvwxyz"
    powers = F.array(*[F.lit(26**i) for i in range(_MAX_BLOCK)])
    blocks = lambda x: F.sequence(F.lit(0), F.floor((F.length(x) - 1) / _MAX_BLOCK).cast("int"))
    number = lambda t: F.aggregate(
        F.split(t, ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.when(c == "", F.lit(0)).otherwise(F.ascii(c) - 97).cast("long")
    )
    spell = lambda n, k: F.array_join(
        F.transform(F.sequence(F.lit(1), k), lambda i: F.substring(F.lit(a), (F.floor(n / F.element_at(powers, k - i + 1)) % 26 + 1).cast("int"), F.lit(1))), ""
    )

    def block(t: Column, i: Column) -> Column:
        n = F.length(t)
        u = F.floor(n / 2).cast("int")
        where = F.concat(tweak, i.cast("string"))
        made = feistel(key, where, number(F.substring(t, F.lit(1), u)), number(F.substring(t, u + 1, n - u)), F.element_at(powers, u + 1), F.element_at(powers, n - u + 1))
        single = (number(t) + _hash(key, where, F.lit(0), F.lit(0), F.lit(25)) + 1) % 26
        return F.when(n == 1, spell(single, n)).otherwise(_let(made, lambda out: F.concat(spell(out["l"], u), spell(out["r"], n - u))))

    texts = _let(s, lambda x: F.transform(blocks(x), lambda i: F.substring(x, i * _MAX_BLOCK + 1, F.lit(_MAX_BLOCK))))
    return F.array_join(F.transform(texts, block), "")


def _email(key: str, s: Column) -> Column:
    at = F.instr(s, "@")
    name, domain = F.lower(F.substring(s, F.lit(1), at - 1)), F.substring(s, at, F.length(s))
    letters, digits = F.regexp_replace(name, "[^a-z]", ""), _only_digits(name)
    tweak = F.concat(F.lit("mail"), F.lower(domain))
    one = (digits.cast("long") + _hash(key, tweak, F.lit(0), F.lit(0), F.lit(9)) + 1) % 10
    few, rest = F.substring(digits, 1, 34), F.substring(digits, F.lit(35), F.length(digits))
    digits_new = F.when(F.length(digits) == 1, one.cast("string")).when(F.length(digits) > 1, F.concat(_digits(key, F.concat(tweak, F.lit("d")), few), rest)).otherwise("")
    letters_new = F.when(F.length(letters) > 0, _letters(key, tweak, letters)).otherwise("")
    return F.concat(_put(_put(name, "a-z", letters_new), "0-9", digits_new), domain)


def pseudonym(key: str, s: Column) -> Column:
    """The pseudonym of one matched value; the value itself where validation refuses it."""
    whole = lambda p: s.rlike(rf"\A(?:{p})\z")
    new = F.when(s.contains("@"), _email(key, s))
    kinds = ((IPV4, _ipv4), (DATE, _date), (SSN, _ssn), (f"{PHONE}|{NORTH}", _phone), (ABROAD, _abroad), (CARD, _card))
    for pattern, make in kinds:
        new = new.when(whole(pattern), make(key, s))
    return F.coalesce(new, s)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` (and, if named, the number of values replaced in ``count_col``)."""
    found_col, made_col, rest_col = (free_name(docs.columns, n) for n in ("pii_found", "pii_made", "pii_rest"))
    text, groups = F.col(text_col), f"{_OTHERS}|{GROUP}"
    # every pattern needs a digit or an @
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    out = docs.withColumn(found_col, F.coalesce(found, F.array().cast("array<string>")))
    # only where a card's check fails: the text is searched again, group by group
    again = F.struct(F.regexp_extract_all(text, F.lit(groups), F.lit(0)).alias("tokens"), F.split(text, groups, -1).alias("pieces"))
    out = out.withColumn(rest_col, F.when(F.exists(found_col, _refused_card), again))
    second = F.col(rest_col).isNotNull()
    made = F.transform(F.col(found_col), lambda s: pseudonym(key, s))
    once = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(made_col), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = out.withColumn(made_col, F.when(~second, made))
    out = _among_numbers(out, key, rest_col)
    if count_col is not None:
        count = F.size(F.filter(F.zip_with(found_col, made_col, lambda old, new: old != new), lambda differs: differs))
        count = F.when(second, F.col(rest_col)["n"]).otherwise(count)
        out = out.withColumn(count_col, F.when(text.isNull(), 0).otherwise(count).cast("long"))
    changed = F.when(second, F.col(rest_col)["text"]).when(F.size(found_col) > 0, once).otherwise(text)
    return out.withColumn(text_col, changed).drop(found_col, made_col, rest_col)
