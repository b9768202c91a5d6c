"""Made-up tokens for training: altered secrets and personal data that patterns miss, and harmless tokens that look like them.

The labels of a sample come from patterns, so a field trained on them alone would only repeat the patterns. Altered
copies keep a span's label and change its form; harmless tokens keep it from taking every odd token for a span.
"""

from __future__ import annotations

import random
import string

ALNUM = string.ascii_letters + string.digits
#: What may stand before a secret in altered copies, and the signs after it.
KEY_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "db_password", "client-secret", "access_token", "private", "bearer", "auth_token", "Secret", "PASSWORD")
SIGNS = ("=", ":", ":=", "=>", "is", "was", "")


def pick(r: random.Random, chars: str, least: int, most: int) -> str:
    return "".join(r.choices(chars, k=r.randint(least, most)))


def secret_value(r: random.Random) -> str:
    """The value of a secret in a form that the patterns need a keyword for, or miss."""
    form = r.randrange(6)
    if form == 0:
        return pick(r, ALNUM, 16, 40)
    if form == 1:
        return pick(r, ALNUM + "+/", 20, 44) + "=" * r.randrange(3)
    if form == 2:
        return pick(r, "0123456789ABCDEF", 1, 1) + pick(r, "0123456789ABCDEF", 23, 63)
    if form == 3:
        return pick(r, ALNUM + "-_", 20, 43)
    if form == 4:
        return pick(r, string.ascii_lowercase, 2, 4) + r.choice("_-") + pick(r, ALNUM, 18, 36)
    return pick(r, string.ascii_uppercase + string.digits, 18, 32)


def word(r: random.Random) -> str:
    return pick(r, "aeiou", 1, 1) + pick(r, "bcdfghlmnprstaeiou", 2, 9)


def url(r: random.Random) -> str:
    part = lambda: r.choice((word(r), word(r), f"{word(r)}-{word(r)}", pick(r, string.ascii_lowercase, 1, 3), str(r.randint(0, 99999)), f"{pick(r, string.ascii_lowercase, 1, 6)}{r.choice(('', '-', '_'))}{r.randint(0, 999)}"))
    host = ".".join([*(part() for _ in range(r.randint(0, 1))), word(r), r.choice(("com", "org", "net", "example", "de", "io"))])
    query = "&".join(f"{r.choice((word(r), pick(r, string.ascii_lowercase, 1, 2)))}={part()}" for _ in range(r.randint(0, 3)))
    return r.choice(("https://", "http://", "www.")) + host + "".join("/" + part() for _ in range(r.randint(0, 5))) + r.choice(("", "", "/", ".html", ".pdf")) + ("?" + query if query else "")


def harmless(r: random.Random) -> str:
    """A token with digits or signs that is neither a secret nor personal data."""
    n = lambda a, b: str(r.randint(a, b))
    forms = (
        lambda: n(0, 10 ** r.randint(1, 12)),
        lambda: f"{n(1, 999)},{r.randint(0, 999):03d}" + r.choice(("", f",{r.randint(0, 999):03d}", ".00")),
        lambda: f"{n(0, 9999)}.{n(0, 999)}" + r.choice(("", "%", "kg", "km", "GB")),
        lambda: f"{n(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(("", f"T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00Z")),
        lambda: f"{n(1, 31)}/{n(1, 12)}/{n(1950, 2030)}",
        lambda: f"{n(0, 23)}:{r.randint(0, 59):02d}" + r.choice(("", f":{r.randint(0, 59):02d}", "pm")),
        lambda: r.choice(("v", "", "V")) + f"{n(0, 20)}.{n(0, 30)}" + r.choice(("", f".{n(0, 40)}", "-rc1", f".{n(0, 9)}-beta")),
        lambda: url(r),
        lambda: url(r),
        lambda: f"{r.randint(100, 999)}-{r.randint(0, 9999):04d}",
        lambda: f"{r.randint(100, 999)}-{r.randint(0, 9999):04d}",
        lambda: "/" + "/".join(word(r) for _ in range(r.randint(2, 5))) + r.choice((n(1, 99), ".py", "")),
        lambda: f"{word(r)}{r.choice(('', '-', '_'))}{n(0, 9999)}",
        lambda: pick(r, string.ascii_uppercase, 1, 5) + r.choice(("", "-")) + n(0, 99999),
        lambda: r.choice(("$", "€", "£", "#", "§", "")) + n(1, 99999) + r.choice(("", ".99", "th", "st", "x", "px", "k")),
        lambda: f"{word(r)}={r.choice((word(r), n(0, 999)))}",
        lambda: f"{word(r)}:{r.choice((word(r), n(0, 999)))}",
        lambda: "".join(word(r).capitalize() for _ in range(r.randint(2, 4))) + n(1, 9),
        lambda: word(r) + "".join(word(r).capitalize() for _ in range(r.randint(1, 3))) + r.choice(("()", "()", n(1, 99))),
        lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}",
        lambda: "_".join(word(r) for _ in range(r.randint(2, 4))) + f"_{n(0, 99)}",
        lambda: "-".join(word(r) for _ in range(r.randint(2, 5))) + f"-{n(0, 99)}",
        lambda: "#" + pick(r, "0123456789abcdef", 6, 6),
        lambda: f"{n(1, 400)}-{n(1, 999)}",
        lambda: f"({n(1, 2030)})",
        lambda: f"[{n(1, 200)}]",
        lambda: f"{n(1, 99)}+{n(1, 99)}={n(2, 200)}",
    )
    got = r.choice(forms)()
    return r.choice(("", "", "", '"', "(", "'")) + got + r.choice(("", "", "", ".", ",", ")", "!!", ";"))


def card_number(r: random.Random, valid: bool = True) -> str:
    """16 digits whose checksum holds, or fails."""
    digits = [r.randrange(10) for _ in range(15)]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
    last = -total % 10
    return "".join(map(str, digits)) + str(last if valid else (last + r.randint(1, 9)) % 10)


def personal_value(r: random.Random, kind: int) -> list[str]:
    """Tokens of personal data (0 email, 1 ip, 2 card, 3 phone) in a form that the patterns miss."""
    if kind == 0:
        word = lambda: pick(r, string.ascii_lowercase, 3, 9)
        at, dot = r.choice((("[at]", "."), ("(at)", "."), ("[at]", "[dot]"), ("(at)", "(dot)")))
        return [f"{word()}{r.choice(('', '.', '_'))}{word()}{r.choice(('', str(r.randint(1, 99))))}{at}{word()}{r.choice(('', str(r.randint(1, 9))))}{dot}{r.choice(('com', 'org', 'net'))}"]
    if kind == 1:
        part = lambda: pick(r, "0123456789abcdef", 1, 4)
        return [":".join(part() for _ in range(8))] if r.random() < 0.5 else [":".join(part() for _ in range(r.randint(1, 4))) + "::" + ":".join(part() for _ in range(r.randint(1, 3)))]
    if kind == 2:
        c = card_number(r)
        sign = r.choice("./")
        return [sign.join(c[i : i + 4] for i in range(0, 16, 4))]
    a, b, c = f"{r.randint(2, 999):03d}", f"{r.randint(100, 999)}", f"{r.randint(0, 9999):04d}"
    return r.choice(([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"({a}){b}-{c}"], [f"{a}.{b}.{c}"], [f"00{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}", f"{c}"]))


def spoken(r: random.Random, words: list[str]) -> list[str]:
    """Tokens with the marks that may stand around them in a text."""
    left, right = r.choice((("", ""), ("", ""), ("", "."), ("", ","), ("(", ")"), ('"', '"'), ("", "!!"), ("", "###")))
    return [(left if i == 0 else "") + w + (right if i == len(words) - 1 else "") for i, w in enumerate(words)]
