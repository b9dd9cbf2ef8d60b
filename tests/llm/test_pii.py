"""Operator 2 against a plain-Python Feistel network, and on very long texts."""

import datetime
import hashlib
import random
import re
import time

from trellis.llm import pii

KEY = "k"


def feistel(tweak, l, r, a, b):  # noqa: E741
    for i in range(1, 9):
        half, modulus = (r, a) if i % 2 == 0 else (l, b)
        h = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16) % modulus
        l, r = ((l + h) % a, r) if i % 2 == 0 else (l, (r + h) % b)  # noqa: E741
    return l, r


def one(tweak, modulus):
    return int(hashlib.sha256(f"{KEY}|{tweak}|0|0".encode()).hexdigest()[:15], 16) % modulus


def digits_of(tweak, s):
    u, n = len(s) // 2, len(s)
    a, b = feistel(tweak, int(s[:u] or 0), int(s[u:]), 10**u, 10 ** (n - u))
    return str(a).zfill(u) + str(b).zfill(n - u)


def put(shape, kind, values):
    values = iter(values)
    return "".join(next(values) if re.match(f"[{kind}]", c) else c for c in shape)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s)))


def card(s):
    d = re.sub(r"\D", "", s)
    body = d[0] + digits_of("card" + d[0], d[1:-1])
    return put(s, "0-9", body + str(-luhn(body + "0") % 10))


def phone(s):
    d = re.sub(r"\D", "", s)
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    if area >= 200 and exchange >= 200:
        l, r = feistel("phone", (area - 200) * 800 + exchange - 200, line, 640000, 10000)  # noqa: E741
        six = (l // 800 + 200) * 1000 + l % 800 + 200
    elif s.startswith("+1"):
        l, r = feistel("phone-low", area * 1000 + exchange if area < 200 else 200000 + (area - 200) * 200 + exchange, line, 360000, 10000)  # noqa: E741
        six = l if l < 200000 else 200000 + (l - 200000) // 200 * 1000 + (l - 200000) % 200
    else:
        return s
    return put(s, "0-9", d[:-10] + str(six).zfill(6) + str(r).zfill(4))


def mail(s):
    name, domain = s.lower().split("@")[0], s[s.index("@") :]
    tweak = "mail" + domain.lower()
    letters, digits, made = re.sub("[^a-z]", "", name), re.sub("[^0-9]", "", name), ""
    number = lambda t: sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(t)))
    spell = lambda n, k: "".join(chr(97 + n // 26 ** (k - i) % 26) for i in range(1, k + 1))
    for i in range(0, len(letters), 10):
        t, where = letters[i : i + 10], tweak + str(i // 10)
        u = len(t) // 2
        if len(t) == 1:
            made += spell((number(t) + one(where, 25) + 1) % 26, 1)
        else:
            l, r = feistel(where, number(t[:u]), number(t[u:]), 26**u, 26 ** (len(t) - u))  # noqa: E741
            made += spell(l, u) + spell(r, len(t) - u)
    if len(digits) == 1:
        digits = str((int(digits) + one(tweak, 9) + 1) % 10)
    elif digits:
        digits = digits_of(tweak + "d", digits[:34]) + digits[34:]
    return put(put(name, "a-z", made), "0-9", digits) + domain


def ip(s):
    o = list(map(int, s.split(".")))
    if max(o) > 255:
        return s
    l, r = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)  # noqa: E741
    return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def ssn(s):
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if not (0 < a < 900 and a != 666 and g and n):
        return s
    l, r = feistel("ssn", (a - (2 if a > 666 else 1)) * 99 + g - 1, n - 1, 898 * 99, 9999)  # noqa: E741
    a = l // 99
    a += 2 if a + 1 >= 666 else 1
    return f"{a:03d}-{l % 99 + 1:02d}-{r + 1:04d}"


def date(s):
    form = "%Y-%m-%d" if "-" in s else "%d.%m.%Y" if "." in s else "%d/%m/%Y"
    try:
        day = (datetime.datetime.strptime(s, form).date() - datetime.date(1900, 1, 1)).days
    except ValueError:
        return s
    if not 0 <= day < 73049:
        return s
    l, r = feistel("date", day // 4297, day % 4297, 17, 4297)  # noqa: E741
    return (datetime.date(1900, 1, 1) + datetime.timedelta(l * 4297 + r)).strftime(form)


def abroad(s):
    d = re.sub(r"\D", "", s)
    return put(s, "0-9", d[:2] + digits_of("abroad" + d[:2], d[2:]))


KINDS = [(pii.EMAIL, mail), (pii.IPV4, ip), (pii.DATE, date), (pii.SSN, ssn), (pii.PHONE, phone), (pii.NORTH, phone), (pii.ABROAD, abroad)]


def plain(text):
    """The whole operator on one text, a position at a time."""
    kinds = [(re.compile(p, re.ASCII), make) for p, make in KINDS]
    whole, group = re.compile(pii.CARD, re.ASCII), re.compile(pii.GROUP, re.ASCII)
    valid = lambda s: luhn(re.sub(r"\D", "", s)) % 10 == 0

    def tokens(last):
        at = 0
        while at < len(text):
            for pattern, make in [*kinds, (last, None)]:
                m = pattern.match(text, at)
                if m:
                    yield m, make
                    break
            at = m.end() if m and m.end() > at else at + 1

    found = list(tokens(whole))
    again = any(make is None and not valid(m[0]) for m, make in found)
    spans = [(m.start(), m.end(), make or card) for m, make in found]
    if again:
        found, spans, k = list(tokens(group)), [], 0
        while k < len(found):
            m, make = found[k]
            if make is not None:
                spans.append((m.start(), m.end(), make))
                k += 1
                continue
            before = text[found[k - 1][0].end() if k else 0 : m.start()]
            chained = before == "-" and k and found[k - 1][1] is None
            run = [m]
            while k + len(run) < len(found) and found[k + len(run)][1] is None and text[run[-1].end() : found[k + len(run)][0].start()] in (" ", "-"):
                run.append(found[k + len(run)][0])
            best = 0
            for n in range(1, min(19, len(run)) + 1):
                d = "".join(x[0] for x in run[:n])
                if 13 <= len(d) <= 19 and luhn(d) % 10 == 0:
                    best = n
            if best and (chained or not before.endswith("-")):
                spans.append((m.start(), run[best - 1].end(), card))
                k += best
            else:
                k += 1
    out, at, n = [], 0, 0
    for a, b, make in spans:
        new = make(text[a:b])
        n += new != text[a:b]
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], n


def test_equals_plain_python(spark):
    rng = random.Random(5)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def valid_card(n):
        d = rng.choice("3456") + num(n - 2)
        d += str(-luhn(d + "0") % 10)
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, n, 4)), "-".join(d[i : i + 4] for i in range(0, n, 4))])

    makers = [
        lambda: valid_card(rng.choice([13, 15, 16, 19])), lambda: num(rng.randint(1, 21)), lambda: valid_card(16) + rng.choice([" 12/26", " 123", "-999"]),
        lambda: f"{rng.choice(['a', 'Jo.Do1', 'x' + num(36), 'Abcdefghijklm+' + num(2)])}@{rng.choice(['x.org', 'Mail.example.com', 'a.b.c.d-e.net', 'x'])}",
        lambda: f"{rng.randint(0, 300)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        lambda: f"{rng.randint(1890, 2110)}-{rng.randint(0, 13):02d}-{rng.randint(0, 31):02d}", lambda: f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2099)}", lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}",
        lambda: f"+1 {num(3)} {num(3)} {num(4)}", lambda: f"+1{num(10)}", lambda: f"+{rng.randint(20, 99)} {num(rng.randint(6, 13))}", lambda: "word", lambda: num(3) + " " + num(4),
    ]
    texts = ["".join(rng.choice([" ", " ", ", ", "-", "\n", " x ", "."]) + rng.choice(makers)() for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.i: (r.text, r.n) for r in pii.pseudonymise(spark.createDataFrame(rows, "i int, text string"), KEY, count_col="n").collect()}
    for i, t in rows:
        assert got[i] == plain(t), t
    assert sum(n for _, n in got.values()) > 800


def test_very_long_texts(spark):
    rng = random.Random(2)
    texts = [
        "x@" + "a." * 20000 + "com", "1" * 1_000_000, "." * 1_000_000, "@" * 1_000_000, "a" * 1_000_000 + "@x.com", "x@" + ("a" * 63 + ".") * 10000 + "1",
        "+1 " * 100_000, "+44" + "(-" * 300_000, " ".join(str(rng.randrange(10 ** rng.randint(1, 5))) for _ in range(5000)), "x@" + "ab." * 100 + "com",
    ]
    began = time.monotonic()
    out = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), KEY, count_col="n").orderBy("i").collect()
    assert time.monotonic() - began < 120
    assert [len(r.text) for r in out] == [len(t) for t in texts] and [r.n > 0 for r in out] == [False] * 8 + [True, True]
    assert (out[8].text, out[8].n) == plain(texts[8]) and out[9].text == plain(texts[9])[0]
