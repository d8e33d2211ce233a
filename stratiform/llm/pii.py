"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find emails, IPv4 addresses, card numbers and international phone numbers; their
spans always stay. The field finds what they miss (phone numbers without a country prefix, addresses written with
"at", secrets such as access keys and passwords, cards in other groupings) from the shape of each word and of
its neighbours. It is trained by gradient ascent on the likelihood of a small labelled table and
decoded by Viterbi over numpy batches.

An address in words that the field finds has to hold a sign for @, behind a word that may be a name, and a dot behind it (is_address). Of neighbouring words that it takes for a card
or a phone number only those stretches are spans that can be one (number_spans): 13 to 19 digits in the usual groups that pass Luhn's
check, or 7 to 15 digits that are written as a phone number or follow a word such as "call". Other rows of numbers, such as years, prices or tables, give none.

Every word is scored and decoded. The chain is cut at words that are O on every best path, because no run of
other labels through them can raise the score; only what is between them goes through Viterbi, and
the path is that of the whole text. Null and empty texts have no spans and an empty table gives an empty result; the
same text always has the same spans, in whatever row; of paths with the same score the one with the earlier labels
wins. Texts of any length take time in proportion. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, named, slices

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. Email is searched from each @ outward and ip by whole chains of numbers, so that no
# place is tried twice; the matches are those of [A-Za-z0-9._%+-]+@HOST and [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+).
MAIL_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
NUMBERS = re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
LABELS = ["O", "email", "ip", "card", "phone", "secret"]
NEAR = ["password", "passwd", "pwd", "pass", "passphrase", "token", "key", "api_key", "apikey", "secret", "tel", "phone", "call", "fax", "mobile", "years", "card", "visa", "ip", "host", "mail", "email", "version", "section", "page", "year", "in", "is", "at", "dot", "="]
TLD = "com org net edu gov io dev info biz de fr es it uk us eu ch at ca co".split()
#: Words that follow "password is" and the like in plain sentences.
PLAIN = "the a an my your his her our their this that not no is are was were be been it to of in on at for with by as and or but if so very too also only now then still required needed wrong right correct incorrect invalid valid expired missing empty lost stolen safe strong weak long short good bad new old hard easy never always ready here there".split()


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def email_matches(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches one after another: the longest name before an @ that begins behind the last match, and a host behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(MAIL_NAME))
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def ip_matches(text: str) -> Iterator[tuple[int, int]]:
    """Each four numbers of a dotted chain in turn whose values are at most 255."""
    for m in NUMBERS.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in four)):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; linear in the text. Skipped patterns lack a character that they need."""
    out = []
    if "@" in text:
        out += [("email", *m) for m in email_matches(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m) for m in ip_matches(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = re.sub(r"[^0-9]", "", m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- features -------------------------------------------------------------------------------------------------

def shape(word: str) -> str:
    """Digits 9, capitals A, other letters a, runs shortened to one with a mark."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", re.sub(r"\d", "9", word))
    return re.sub(r"(.)\1+", r"\1+", s)


_MIXED = re.compile(r"[A-Z0-9]{16,}|[0-9a-f]{16,}|(?=.*[A-Z])(?=.*[0-9])(?=.*[a-z])[A-Za-z0-9+/_-]{16,}")
_TURN = re.compile("[a-z][A-Z]|[A-Z]{2}[a-z]")
_AT = re.compile(r"[\[({<](at|dot)[\])}>]", re.I)
#: What an address in words must hold: a sign for @ between two names, and behind it a name after a dot in some form.
_SIGN = re.compile(r"[^\s@](?:@|\s*[\[({<]at[\])}>]\s*|\s+at\s+)(?!(?:at|dot)\b)[^\s@]", re.I)
_DOT = re.compile(r"\w(?:\.|\s+dot\s+|\s*[\[({<]dot[\])}>]\s*)\w", re.I)
#: Words before "at" that are no name.
NOT_NAMES = frozenset(PLAIN) | frozenset("me us you him them we i she he they meet met look looked looking arrive arrived stay stayed see saw call here there now back today tomorrow live lives work works open".split())
#: Words that announce a phone number.
CALLS = frozenset("tel tel. telephone telefon téléphone teléfono phone call calls calling called ring dial fax mobile mobil cell whatsapp sms".split())
_CARD_FORM = re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([ .-])[0-9]{4}){2}(?:\1[0-9]{1,4}){1,2}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{4,5}")
_PHONE_FORM = re.compile(r"\+?\(?[0-9][0-9 ()./-]*[0-9]")
_PHONE_GROUPS = re.compile(r"(?:\+|\().*|[0-9]{2,4}-[0-9]{3,4}-[0-9]{3,5}|[0-9]{3}[ .][0-9]{3}-[0-9]{4}")
SIDES = ("b", "bb", "a", "aa", "aaa")  # before, two before, after, two and three after


def is_address(raw: str) -> bool:
    sign = _SIGN.search(raw)
    if not sign or not _DOT.search(raw, sign.end() - 1):
        return False
    name = raw[: sign.start() + 1].split()[-1:]
    return not (sign.group()[1:2].isspace() and name and name[0].lower() in NOT_NAMES)


def is_card(raw: str) -> bool:
    return bool(_CARD_FORM.fullmatch(raw)) and luhn(re.sub("[^0-9]", "", raw))


def is_phone(raw: str, announced: bool) -> bool:
    return bool(_PHONE_FORM.fullmatch(raw)) and 7 <= len(re.sub("[^0-9]", "", raw)) <= 15 and (announced or bool(_PHONE_GROUPS.fullmatch(raw)))


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The place without outer punctuation; empty if nothing else is there."""
    raw = text[a:b]
    return a + len(raw) - len(raw.lstrip("\"'[{<,.;:!?")), a + len(raw.rstrip("\"']}>,.;:!?"))


def number_spans(kind: str, text: str, words: list[tuple[int, int]], at: int, end: int) -> list[tuple[str, int, int]]:
    """Cards or phones among the neighbouring words at..end, each the longest that can be one from its first word on.

    Bare groups of digits side by side are cards only if cards take all of them, since one in ten rows of numbers passes the check by chance.
    """
    bare = lambda i: 0 <= i < len(words) and text[slice(*words[i])].strip(",.;:").isdigit()
    found = []
    if kind == "card" and (bare(at) and bare(at - 1) or bare(end) and bare(end + 1)):
        return []
    while at <= end:
        best, digits = None, 0
        before = {w.strip("\"'()[]{}<>,;:!?").lower() for w in (text[a:b] for a, b in words[max(0, at - 3) : at]) if len(w) < 20}
        for j in range(at, min(end, at + MOST_WORDS - 1) + 1):
            digits += words[j][1] - words[j][0]
            if digits > MOST_CHARS:
                break
            a, b = trimmed(text, words[at][0], words[j][1])
            if a < b and (is_card(text[a:b]) if kind == "card" else is_phone(text[a:b], not before.isdisjoint(CALLS))):
                best = a, b, j
        if best:
            found.append((kind, best[0], best[1]))
        elif kind == "card" and bare(at):
            return []
        at = best[2] + 1 if best else at + 1
    return found


def own_features(word: str) -> list[str]:
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    core = word.strip("\"'()[]{}<>,.;:!?")
    out = [f"shape={shape(word)}" if len(word) < 100 else "shape=long", f"digits={min(digits, 20)}", f"letters={min(letters, 6)}", f"len={min(len(word), 40) // 4}", f"has_digit={digits > 0}", "bias"]
    out += ["at"] * ("@" in word) + ["eq"] * ("=" in word) + ["dot"] * ("." in core) + ["hyphen"] * ("-" in core) + ["paren"] * ("(" in word) + ["plus"] * (word[:1] == "+") + ["quote"] * ('"' in word or "'" in word)
    value = core.rpartition("=")[2].strip("\"'")
    mixed = bool(_MIXED.fullmatch(value))
    out += ["mixed"] * (mixed and letters > 0)
    out += [f"mixed_letters={letters > 3}"] * mixed
    if len(value) >= 16 and value.replace("_", "").replace("-", "").isascii() and value.replace("_", "").replace("-", "").isalnum():
        out.append(f"turns={min(len(_TURN.findall(value)), 6)}")
        out += [f"known={value[:4]}"] * (value[:4] in ("ghp_", "AKIA", "gho_", "xoxb") or value[:3] == "sk-")
    d = re.sub(r"\D", "", core)
    out += ["luhn"] * (13 <= len(d) <= 19 and luhn(d))
    w = core.lower()
    out += [f"own_word={w}"] * (w in ("at", "dot")) + ["tld"] * (w in TLD) + ["plain"] * (w in PLAIN) + ["slash"] * ("/" in word)
    out += ["tld_end"] * ("." in core and core.lower().rpartition(".")[2] in TLD) + ["inner_at"] * (w != "at" and bool(_AT.search(word)))
    if "=" in word:
        head, _, rest = word.partition("=")
        out += [f"own:{head.lower()}"] + [f"own_value:{head.lower()}"] * bool(rest.strip("\"'"))
    return out


def near_features(name: str, word: str) -> list[str]:
    w = word.lower().strip("\"'(),.;:!?[]{}<>") or word[:1]
    head = w.partition("=")[0]
    out = []
    if name in ("b", "bb", "a") and head in NEAR or head == "dot" or head == "at" and name == "aa":
        out.append(f"{name}:{head}")
        out += [f"{name}:{head}:"] * (word[-1:] in ":=")
    out += [f"{name}:tld"] * (name in ("a", "aa") and ("." in w and w.rpartition(".")[2] in TLD))
    if name in ("b", "bb", "a"):
        out.append(f"{name}:{'num' if any(c.isdigit() for c in w) else 'word' if w else 'none'}")
    return out


def features(word: str, before: str, before2: str, after: str) -> list[str]:
    """after: up to three words. Each feature depends on one word alone, so a word's score is a sum over the words about it."""
    out = own_features(word)
    for name, w in zip(SIDES, [before, before2, *[*after.split(), "", "", ""][:3]], strict=True):
        out += near_features(name, w)
    return out


_WORD = re.compile(r"\S+")


def runs(text: str):
    """The words of the text as one list of (word, start, before, before2, the three after)."""
    found = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    ws = ["", "", *(w for w, _ in found)]
    if found:
        yield [(w, at, ws[i + 1], ws[i], " ".join(ws[i + 3 : i + 6])) for i, (w, at) in enumerate(found)]


# ---- the field --------------------------------------------------------------------------------------------------

def small_labelled_table() -> pd.DataFrame:
    """The labelled sentences that the field learns from: text, and spans as (label, start, end).

    Sentences are drawn from a few patterns with a fixed seed; none comes from any table. 400 are about words with
    a digit or @, 900 about addresses and secrets without, and plain text that looks like them, 300 about rows of numbers and announced phone numbers.
    """
    r = random.Random(7)
    dig = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    low = lambda n: "".join(r.choice(string.ascii_lowercase) for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(n))

    def card() -> str:
        d = "4" + dig(14)
        return next(d + c for c in string.digits if luhn(d + c))

    def filler(n: int) -> str:
        return " ".join(low(r.randint(2, 9)) for _ in range(n))

    def one() -> tuple[str, str]:
        kind = r.choice(["email", "ip", "card", "card", "phone", "phone", "secret", "secret", "secret", "O", "O", "O", "O"])
        c = card()
        pick = {
            "email": [f"{low(6)}.{dig(2)}@mail{dig(1)}.example.com", f"{low(5)}@{low(7)}.org"],
            "ip": [".".join(str(r.randint(1, 255)) for _ in range(4))],
            "card": [c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))],
            "phone": [f"+1 ({dig(3)}) 555-{dig(4)}", f"+{dig(2)} {dig(3)} {dig(3)} {dig(4)}", f"({dig(3)}) {dig(3)}-{dig(4)}", f"{dig(3)}-{dig(3)}-{dig(4)}"],
            "secret": [f"AKIA{upper(16)}", f"password={hexa(18)}", f'"{hexa(40)}"', f"ghp_{upper(36)}"],
            "O": [f"{r.randint(1, 9)}.{r.randint(0, 9)}.", str(r.randint(1900, 2030)), str(r.randint(1, 999)), f"{r.randint(1, 99)}%", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"${r.randint(1, 9999)}.{dig(2)}", f"{r.randint(1, 12)}:{r.randint(10, 59)}", dig(r.randint(5, 12)), f"{r.randint(1, 99)}-{r.randint(100, 199)}", f"{low(4)}{dig(1)}", f"{r.randint(10, 99)},{dig(3)},{dig(3)}", f"2{dig(3)}-{dig(2)}-{dig(2)}", dig(16), f"@{low(6)}", f"{upper(3)}{dig(4)}"],
        }
        return kind, r.choice(pick[kind])

    rows = []
    for _ in range(400):
        text, spans = filler(r.randint(0, 4)), []
        for _ in range(r.randint(1, 3)):
            kind, s = one()
            lead = {"secret": ' token =' if s.startswith('"') else ""}.get(kind, "")
            text += lead + (" " if text or lead else "")
            if kind != "O":
                spans.append((kind, len(text), len(text) + len(s)))
            text += s
            if r.random() < 0.7:
                text += " " + filler(r.randint(1, 5))
        rows.append((text, spans))

    alpha = lambda n: "".join(r.choice(string.ascii_letters) for _ in range(n))
    cue = lambda: r.choice(["password", "Password", "passwd", "pwd", "pass", "passphrase", "token", "key", "secret", "api_key", "apikey"])
    word = lambda: r.choice([low(r.randint(2, 10)), low(r.randint(2, 10)), low(r.randint(3, 9)).capitalize(), low(r.randint(2, 9)) + r.choice(",.;:!?"), r.choice(PLAIN), r.choice(PLAIN), upper(4).translate(str.maketrans(string.digits, "ABCDEFGHIJ"))])
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def hidden() -> tuple[str, str, str]:
        """Label, what leads to it, and the span."""
        at, dot = r.choice([("at", "dot"), ("at", "dot"), ("at", "dot"), ("AT", "DOT"), ("[at]", "[dot]"), ("(at)", "(dot)")])
        name, tld = r.choice([low(r.randint(3, 9)), low(5).capitalize(), f"{low(5)}.{low(5)}", f"{low(5)}_{low(4)}", f"{low(5)} {dot} {low(6)}", f"{low(4)} {dot} {low(5)}"]), r.choice(TLD)
        host = low(r.randint(3, 10))
        i = r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9, 9, 10])
        if i < 4:
            return "email", "", f"{name} {at} {host} {dot} {tld}"
        if i == 4:
            return "email", "", f"{low(6)} {at} {host} {dot} co {dot} {r.choice(TLD)}"
        if i == 5:
            return "email", r.choice(["mail", "email", "e-mail:", "Email"]), f"{r.choice([low(6), low(4) + '.' + low(5)])} {at} {host}.{tld}"
        if i == 6:
            return "email", "", r.choice([f"{low(6)}[at]{host}[dot]{tld}", f"{low(6)}(at){host}(dot){tld}", f"{low(6)}[at]{host}.{tld}"])
        value = r.choice([low(r.randint(4, 14)), low(r.randint(4, 14)), low(7).capitalize() + "!", alpha(r.randint(6, 30)), f"{low(5)}-{low(6)}-{low(4)}"])
        if i == 7:
            return "secret", "", f"{cue()}={r.choice([value, value, chr(34) + value + chr(34)])}"
        if i == 8:
            return "secret", f"{cue()}{r.choice([':', ' =', ' :'])}", value
        if i == 9:
            return "secret", f"{r.choice(['password', 'passphrase', 'passwd', 'pwd', 'token', 'secret'])} is", r.choice([value, f'"{value}"'])
        return "secret", r.choice(["", "token", "key"]), r.choice([alpha(r.randint(20, 40)), f"ghp_{alpha(36)}", "AKIA" + alpha(16).upper(), f"sk-{alpha(32)}"])

    def harmless() -> str:
        return r.choice([
            lambda: f"{word()} at {say(1, 3)}", lambda: f"at {say(1, 2)} the dot {word()}", lambda: f"{word()} dot {word()}", lambda: f"a dot at the {word()}", lambda: f"{word()} at {low(5)}, {word()}", lambda: f"www.{low(7)}.{r.choice(TLD)}", lambda: f"https://{low(6)}.{r.choice(TLD)}/{low(5)}/{low(6)}",
            lambda: " ".join([r.choice([*TLD, "at", "dot", "At", "De", "de,", "es"])] * r.randint(1, 12)), lambda: f"{r.choice(TLD)} {word()} {r.choice(TLD)}, {r.choice(TLD)}", lambda: f"{cue()} {say(1, 3)}", lambda: f"the {cue()} is {r.choice(PLAIN)} {word()}", lambda: f"your {cue()} must be {word()}", lambda: f"{cue()}, {word()}", lambda: f"key to {word()}", lambda: f"{low(5)}={low(4)}", lambda: f'class="{low(6)}"', lambda: f"{low(1)} = {low(5)};", lambda: f"{low(5)}: {word()}",
            lambda: f"{low(4)}{low(5).capitalize()}{low(6).capitalize()}()", lambda: low(r.randint(14, 30)), lambda: f"{low(7)}-{low(5)}-{low(8)}", lambda: f"/{low(4)}/{low(6)}/{low(3)}", lambda: "—", lambda: "*" * r.randint(1, 9), lambda: f'"{say(1, 3)}"', lambda: f"({word()})", lambda: f"{low(4)}'{low(1)}", lambda: upper(9).translate(str.maketrans(string.digits, "ABCDEFGHIJ")), lambda: f"{low(6)}_{low(5)}", lambda: f"<{low(3)}>",
        ])()

    for _ in range(900):
        text, spans = say(0, 6), []
        for _ in range(r.randint(1, 3)):
            kind, lead, s = hidden() if r.random() < 0.4 else ("O", "", harmless())
            text += (" " if text else "") + lead + (" " if lead else "")
            if kind != "O":
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + (r.choice(["", "", ".", ","]) if kind == "email" else "")
            if r.random() < 0.7:
                text += " " + say(1, 6)
        rows.append((text, spans))

    def numbers() -> str:
        """A row of numbers that are nobody's."""
        n = r.randint(2, 9)
        return r.choice([
            lambda: " ".join(str(r.randint(1400, 2060)) for _ in range(n)), lambda: ", ".join(str(r.randint(1400, 2060)) for _ in range(n)), lambda: " ".join(str(r.randint(1, 999)) for _ in range(n)), lambda: " ".join(str(r.randint(1000, 99999)) for _ in range(n)), lambda: " ".join(f"{r.randint(0, 99)},{dig(1)}" for _ in range(n)), lambda: " ".join(f"{r.randint(0, 99)}.{dig(2)}" for _ in range(n)),
            lambda: " ".join(f"{r.randint(1, 99)}%" for _ in range(n)), lambda: " ".join(f"${r.randint(1, 9999)}" for _ in range(n)), lambda: " | ".join(dig(r.randint(1, 6)) for _ in range(n)), lambda: " ".join(f"2{dig(3)}-{r.randint(10, 12)}-{r.randint(10, 28)}" for _ in range(n)), lambda: " ".join(f"{r.randint(0, 23):02}:{r.randint(0, 59):02}" for _ in range(n)), lambda: " ".join(dig(r.randint(6, 12)) for _ in range(n)),
            lambda: " ".join(f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}" for _ in range(n)), lambda: " ".join(f"{dig(1)} {dig(3)} {dig(3)}" for _ in range(n)), lambda: f"{r.randint(1, 400)}-{r.randint(401, 900)}, {r.randint(1, 99)}-{r.randint(100, 200)}", lambda: f"{dig(3)}-{dig(1)}-{dig(2)}-{dig(6)}-{dig(1)}", lambda: " + ".join(dig(2) for _ in range(n)),
        ])()

    call = lambda: r.choice(["call", "Call", "tel", "Tel.", "tel:", "phone", "Phone:", "phone:", "fax", "Fax:", "mobile"])
    for i in range(300):
        lead = r.choice([say(0, 4), say(0, 3) + r.choice([" in", " years", ":", " section", " page"])])
        text, spans = lead, []
        if i % 3 == 0:
            number = r.choice([f"0{dig(3)} {dig(7)}", f"0{dig(2)} {dig(3)} {dig(4)}", f"{dig(3)} {dig(4)}", f"0{dig(1)} {dig(2)} {dig(2)} {dig(2)} {dig(2)}", f"0{dig(10)}", f"0{dig(3)}/{dig(6)}", f"{dig(3)} {dig(3)} {dig(4)}", f"{dig(3)}.{dig(3)}.{dig(4)}"])
            text += (" " if text else "") + call() + " "
            spans.append(("phone", len(text), len(text) + len(number)))
            text += number
        elif i % 10 == 1:
            d = "37" + dig(12)
            d = next(d + c for c in string.digits if luhn(d + c))
            number = r.choice([f"{d[:4]} {d[4:10]} {d[10:]}", f"{d[:4]}-{d[4:10]}-{d[10:]}", d])
            text += (" " if text else "") + r.choice(["card ", "Card: ", "amex ", "card no "])
            spans.append(("card", len(text), len(text) + len(number)))
            text += number
        else:
            text += (" " if text else "") + numbers()
        rows.append((text + r.choice(["", ".", f" {say(1, 5)}", f", {say(1, 5)}"]), spans))
    return pd.DataFrame(rows, columns=["text", "spans"])


MOST_WORDS, MOST_CHARS = 7, 32  # of one card or phone number
KNOWN_WORDS, PIECE = 1 << 18, 1 << 15  # words whose scores are held, and words scored at once


COMMON = frozenset([*NEAR, *TLD, *PLAIN])


def _lower(n: int, tail: str = "") -> tuple:
    return 0, n if n < 6 else 6, (n + len(tail)) // 4, tail, n == 1


_LOWER = [_lower(n) for n in range(15)]


def alike(word: str) -> tuple | str:
    """The same key for words that have the same features: short words of letters in lower case or with one capital, with or without one mark behind. Else the word."""
    if word.islower() and word.isalpha() and len(word) < 15 and word not in COMMON:  # most words
        return _LOWER[len(word)]
    body, tail = (word[:-1], word[-1]) if word[-1:] in (".", ",", ";", ":", "!", "?") else (word, "")
    n = len(body)
    if not 0 < n < 15 or not body.isalpha() or body.lower() in COMMON:
        return word
    if body.islower():
        return _lower(n, tail)
    if n > 1 and body[0].isupper() and body[1:].islower():
        return 1, n if n < 6 else 6, len(word) // 4, tail, n == 2
    return word


class Known(dict):
    """Words' numbers in a table of scores, [number, place, label]; a new word is added when it is asked for."""

    def __init__(self, field: ShapeField):
        super().__init__()
        self.field, self.kinds, self.chars, self.table = field, {}, 0, np.zeros((1024, 1 + len(SIDES), len(LABELS)))

    def __missing__(self, word: str) -> int:
        kind = alike(word)
        i = self.kinds.get(kind)
        if i is None:
            i = self.kinds[kind] = len(self.kinds)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            index = self.field.index
            for place, fs in enumerate([own_features(word), *(near_features(name, word) for name in SIDES)]):
                self.table[i, place] = self.field.unary[[index[f] for f in fs if f in index]].sum(0)
        self.chars += len(word)
        self[word] = i
        return i


class ShapeField:
    """Linear-chain conditional random field. fit() on text and spans; spans() on texts."""

    def __init__(self, l2: float = 0.02, rounds: int = 150, rate: float = 0.15):
        self.l2, self.rounds, self.rate = l2, rounds, rate

    def _encode(self, seqs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers [n, T, F] (the last number is no feature), lengths, and a mask."""
        t = max((len(s) for s in seqs), default=0)
        f = max((len(w) for s in seqs for w in s), default=1)
        x = np.full((len(seqs), t, f), len(self.index), np.int32)
        for i, s in enumerate(seqs):
            for j, w in enumerate(s):
                ids = [self.index[k] for k in w if k in self.index]
                x[i, j, : len(ids)] = ids
        n = np.array([len(s) for s in seqs])
        return x, n, np.arange(t)[None] < n[:, None]

    def fit(self, table: pd.DataFrame) -> ShapeField:
        seqs, gold = [], []
        for text, spans in zip(table["text"], table["spans"], strict=True):
            for run in runs(text):
                seqs.append([features(w, b, bb, a) for w, _, b, bb, a in run])
                gold.append([next((LABELS.index(k) for k, s, e in spans if s < at + len(w) and at < e), 0) for w, at, *_ in run])
        self.index = {k: i for i, k in enumerate(sorted({f for s in seqs for w in s for f in w}))}
        n = np.array([len(q) for q in seqs])
        mask, k = np.arange(n.max())[None] < n[:, None], len(LABELS)
        kinds: dict[frozenset[str], int] = {}
        of = np.array([kinds.setdefault(frozenset(w), len(kinds)) for q in seqs for w in q])
        x = np.zeros((len(kinds), len(self.index)), np.float32)  # the different words' features
        for w, i in kinds.items():
            x[i, [self.index[f] for f in w]] = 1
        onehot = np.zeros((*mask.shape, k))
        onehot[mask] = np.eye(k)[[y for g in gold for y in g]]
        self.unary, self.pair = np.zeros((len(self.index) + 1, k)), np.zeros((k, k))
        theta = [self.unary, self.pair]
        m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        gold_pair = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
        s = np.zeros(onehot.shape)
        for step in range(1, self.rounds + 1):
            s[mask] = (x @ self.unary[:-1].astype(np.float32))[of]
            node, edge = self._marginals(s, n, mask)
            diff = (onehot - node)[mask]
            by_kind = np.stack([np.bincount(of, diff[:, i], len(kinds)) for i in range(k)], 1).astype(np.float32)
            gu = np.concatenate([x.T @ by_kind, np.zeros((1, k))])
            for i, (p, g) in enumerate(zip(theta, (gu, gold_pair - edge), strict=True)):
                g = g - self.l2 * p
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return self.unary[x].sum(2)

    def _marginals(self, s: np.ndarray, n: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product over a padded batch of scores, scaled at each place: node marginals, and edge marginals added up."""
        t = s.shape[1]
        e, pair = np.exp(s - s.max(2, keepdims=True)), np.exp(self.pair)
        unit = lambda a: a / a.sum(1, keepdims=True)
        fwd, bwd = np.zeros_like(s), np.ones_like(s)
        fwd[:, 0] = unit(e[:, 0])
        for i in range(1, t):
            fwd[:, i] = np.where(mask[:, i, None], unit(fwd[:, i - 1] @ pair * e[:, i]), fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(mask[:, i + 1, None], unit((e[:, i + 1] * bwd[:, i + 1]) @ pair.T), 1)
        node = fwd * bwd
        node = node / node.sum(2, keepdims=True) * mask[..., None]
        edge = np.zeros_like(self.pair)
        for i in range(t - 1):
            right = e[:, i + 1] * bwd[:, i + 1]
            total = ((fwd[:, i] @ pair) * right).sum(1)
            edge += fwd[:, i].T @ (right * (mask[:, i + 1] / total)[:, None]) * pair
        return node, edge

    def viterbi(self, seqs: list[list[list[str]]]) -> list[list[int]]:
        """The best labels of each sequence of features."""
        return self.best_paths([self._scores(self._encode([s])[0])[0] for s in seqs])

    def best_paths(self, scores: list[np.ndarray]) -> list[list[int]]:
        """The best labels of each sequence of label scores, by batches of like length."""
        out: list[list[int]] = [[] for _ in scores]
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            longest = max(8, 2 * len(scores[order[at]]))
            take = [i for i in order[at : at + max(1, 40_000 // longest)] if len(scores[i]) <= longest]
            at += len(take)
            n = np.array([len(scores[i]) for i in take])
            s = np.zeros((len(take), n.max(), len(LABELS)))
            for j, i in enumerate(take):
                s[j, : n[j]] = scores[i]
            mask = np.arange(n.max())[None] < n[:, None]
            best, back = s[:, 0], []
            for t in range(1, s.shape[1]):
                c = best[:, :, None] + self.pair
                arg = c.argmax(1)
                new = np.take_along_axis(c, arg[:, None], 1)[:, 0] + s[:, t]
                best = np.where(mask[:, t, None], new, best)
                back.append(np.where(mask[:, t, None], arg, np.arange(len(LABELS))))
            y = best.argmax(1)
            path = [y]
            for b in reversed(back):
                y = b[np.arange(len(y)), y]
                path.append(y)
            path = np.array(path[::-1])
            for j, i in enumerate(take):
                out[i] = path[: n[j], j].tolist()
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in the table of scores (by place and label); the table starts anew when it is full."""
        if not hasattr(self, "_known") or len(self._known) > KNOWN_WORDS or self._known.chars > 64 * KNOWN_WORDS:
            self._known = Known(self)
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def _open(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that may have another label than O on a best path, and their label scores. Texts stand one after another with two empty words before and three after.

        A run of other labels raises the score over O in all its places by at most its first word's gain, those of the words after it and the
        gain of leaving it; a word is O for sure when no run through it can raise the score.
        """
        parts, empty = [], []
        for a in range(2, len(words) - 3, PIECE):
            n = min(PIECE, len(words) - 3 - a)
            ids = self._rows(words[a - 2 : a + n + 3])
            parts.append(sum(self._known.table[ids[2 + by : 2 + by + n], place] for place, by in enumerate((0, -1, -2, 1, 2, 3))))
            empty.append(ids[2 : 2 + n] == self._known[""])
        if not parts:
            return np.zeros(0, int), np.zeros((0, len(LABELS)))
        u, empty = np.concatenate(parts), np.concatenate(empty)
        more = u[:, 1:] - u[:, :1]
        begins, ends = np.concatenate([[True], empty[:-1]]), np.concatenate([empty[1:], [True]])
        stay = self.pair[0, 0]
        after = np.where(empty, -1e4, (more + self.pair[1:, 1:].max(0) - stay).max(1))
        first = np.where(empty, -1e4, np.where(begins, more.max(1), (more + self.pair[0, 1:] - stay).max(1)))
        out = np.where(ends, 0.0, self.pair[1:, 0].max() - stay)
        total = np.cumsum(after)
        best = np.maximum.accumulate(first - total) + np.maximum.accumulate((total + out)[::-1])[::-1]
        left = np.flatnonzero((best > -1e-4) & ~empty)
        return left + 2, u[left]

    def labels(self, texts: list[list[str]]) -> list[dict[int, int]]:
        """For the words of each text: labels other than O, by place."""
        flat, starts = ["", ""], []
        for ws in texts:
            starts.append(len(flat))
            flat += ws
            flat += ["", "", ""]
        at, u = self._open(flat)
        out: list[dict[int, int]] = [{} for _ in texts]
        if not len(at):
            return out
        chains = [(int(at[c[0]]), u[c]) for c in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1)]
        for a, s in chains:  # the words beside a chain, where there are any, are O
            if flat[a - 1]:
                s[0] += self.pair[0]
            if flat[a + len(s)]:
                s[-1] += self.pair[:, 0]
        owner = np.searchsorted(starts, [a for a, _ in chains], side="right") - 1
        for (a, _), i, path in zip(chains, owner.tolist(), self.best_paths([s for _, s in chains]), strict=True):
            out[i].update({a + j - starts[i]: y for j, y in enumerate(path) if y})
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field finds in each text, words of one label side by side joined (of emails, those written in words), outer punctuation left out."""
        out: list[list[tuple[str, int, int]]] = []
        group: list[list[str]] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(t.split())
            size += len(group[-1])
            if size >= PIECE or i == len(texts) - 1:
                out += [self._joined(texts[len(out) + j], ys) for j, ys in enumerate(self.labels(group))]
                group, size = [], 0
        return out

    def _joined(self, text: str, ys: dict[int, int]) -> list[tuple[str, int, int]]:
        if not ys:
            return []
        last = max(ys)
        words = [m.span() for _, m in zip(range(last + 2), _WORD.finditer(text), strict=False)]
        out, at = [], 0
        while at <= last:
            y, end = ys.get(at, 0), at
            while y in (1, 3, 4) and ys.get(end + 1) == y and not (y == 1 and "@" in text[words[end][0] : words[end + 1][1]]):
                end += 1
            if y in (3, 4):
                out += number_spans(LABELS[y], text, words, at, end)
            elif y:
                a, b = trimmed(text, words[at][0], words[end][1])
                if a < b and (y != 1 or is_address(text[a:b])):
                    out.append((LABELS[y], a, b))
            at = end + 1
        return out


def merged(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those added ones that touch none of them, by kind and start."""
    taken: list[list[int]] = []  # places of the base spans, overlapping ones as one
    for _, b, e in sorted(base, key=lambda s: s[1]):
        if taken and b < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([b, e])
    free = []
    for s in added:
        i = bisect_left(taken, s[2], key=lambda t: t[0]) - 1  # the last that begins before the span's end
        if i < 0 or taken[i][1] <= s[1]:
            free.append(s)
    order = [*KINDS, "secret"]
    return sorted([*base, *free], key=lambda s: (order.index(s[0]), s[1], s[2]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's place taken by its kind in angle brackets; overlapping spans make one gap."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@cache
def train() -> ShapeField:
    """The field of the small labelled table; trained once in a program, as it depends on nothing else."""
    return ShapeField().fit(small_labelled_table())


def find(documents: DataFrame, field: ShapeField, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row; one pass without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    docs = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            for s in slices(b, "_text"):
                texts = [t or "" for t in s.column("_text").to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [joined(merged(x, y)) for x, y in zip(base, shared.value.spans(texts), strict=True)]
                counts = [pa.array([sum(k == kind for k, _, _ in x) for x in base], pa.int64()) for kind in KINDS]
                sha = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_documents(documents: DataFrame, field: ShapeField, *, text: str = "text") -> DataFrame:
    """documents with every span masked in the text; other columns and null texts stay."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for s in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            some = s.column("text").to_pylist()
            plain = [t or "" for t in some]
            found = shared.value.spans(plain)
            parts.append(pa.array([None if o is None else mask(t, merged(base_spans(t), f)) for o, t, f in zip(some, plain, found, strict=True)], pa.string()))
        give_back()
        return pa.concat_arrays(parts)

    return documents.withColumn(text, masked(F.col("`" + text.replace("`", "``") + "`"))).select(*named(*documents.columns))
