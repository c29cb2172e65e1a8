"""Labelled findings that the forest of the secret scan learns from.

Each is made from a template: a value of a known kind in a place where it is a secret, or where
it is not. The kinds cover hexadecimal and base64 keys, issuers' keys, signed tokens,
passwords and pass phrases; and digests, identifiers, numbers, names, paths, placeholders, calls and
prose, also such as stand where a secret could. Values are drawn anew from a seed.
"""

from __future__ import annotations

import random
import string

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
_ALNUM = string.ascii_letters + _DIGITS

_NAMES = [
    "token", "api_key", "apiKey", "API_KEY", "secret", "client_secret", "password", "db_password", "passwd", "pwd",
    "access_key", "AWS_SECRET_ACCESS_KEY", "private_key", "auth_token", "credential", "passphrase",
]
_WORDS = (
    "time people water house state world school family group number system program question work night point home "
    "room mother area money story fact month right study book word business issue side kind head service friend "
    "power hour game line member law city name team minute idea body back parent face level office door health art "
    "history party result change morning reason research moment teacher force education value default example user "
    "config server client request response handler index table column parser buffer window message record"
).split()


def _draw(rng: random.Random, letters: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high or low)))


def _syllables(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"]) for _ in range(rng.randint(1, 4)))


def _password(rng: random.Random) -> str:
    word = rng.choice([rng.choice(_WORDS), _syllables(rng), _draw(rng, _LOWER, 3, 7)])
    for a, b in rng.sample([("o", "0"), ("e", "3"), ("a", "4"), ("i", "1"), ("s", "5")], 3):
        word = word.replace(a, b)
    word = word.capitalize() if rng.random() < 0.6 else word
    tail = _draw(rng, _DIGITS, 1, 4) + rng.choice(["", "", "!", "$", "#", "@", "_x", ".q"])
    return rng.choice([word + tail, tail + word, word + rng.choice("!.@#$_-") + _draw(rng, _ALNUM, 3, 8)])


def _secret(rng: random.Random) -> tuple[str, bool]:
    """A secret, and whether it is one wherever it stands."""
    base64 = _ALNUM + "+/"
    url = _ALNUM + "_-"
    kinds = [
        lambda: (_draw(rng, "0123456789abcdef", rng.choice([20, 32, 40, 64])), False),
        lambda: (_draw(rng, base64, 20, 64) + rng.choice(["", "=", "=="]), False),
        lambda: (_draw(rng, string.ascii_letters, 14, 32), False),
        lambda: (_draw(rng, _ALNUM, 10, 40), False),
        lambda: (_password(rng), False),
        lambda: (_password(rng), False),
        lambda: (rng.choice(["AKIA", "ASIA"]) + _draw(rng, _UPPER + _DIGITS, 16), True),
        lambda: (rng.choice(["ghp_", "gho_", "ghs_"]) + _draw(rng, _ALNUM, 36), True),
        lambda: (rng.choice(["sk_live_", "glpat-", "xoxb-", "AIza", "sk-"]) + _draw(rng, url, 24, 40), True),
        lambda: ("eyJ" + _draw(rng, url, 17, 40) + ".eyJ" + _draw(rng, url, 20, 60) + "." + _draw(rng, url, 43), True),
    ]
    return rng.choice(kinds)()


def _before_secret(rng: random.Random) -> tuple[str, str]:
    name = rng.choice(_NAMES)
    return rng.choice([
        (f'{name} = "', '"'), (f"{name} = '", "'"), (f"{name}: ", "\n"), (f"{name}=", " "), (f"export {name}=", "\n"),
        (f'"{name}": "', '",'), (f"{name}:", " and more"), ("Authorization: Bearer ", "\n"), (f'{name} => "', '"'), (f"{name} := `", "`"),
    ])


def _harmless(rng: random.Random) -> tuple[str, str, str]:
    """What stands before, the candidate, and what follows."""
    hexadecimal = "0123456789abcdef"
    word, name = lambda: rng.choice(_WORDS), rng.choice(_NAMES)
    uuid = "-".join(_draw(rng, hexadecimal, n) for n in (8, 4, 4, 4, 12))
    prose = " ".join(rng.choice([word(), _syllables(rng)]) for _ in range(4)) + " "
    long_name = rng.choice(["_", "", "-"]).join(word().capitalize() if rng.random() < 0.5 else word() for _ in range(rng.randint(3, 5)))
    path = "/".join(rng.choice([word(), _syllables(rng), _draw(rng, _DIGITS, 1, 4)]) for _ in range(rng.randint(3, 6)))
    kinds = [
        (rng.choice(["commit ", "sha1: ", "sha256 = ", "md5: ", "checksum ", "digest=", "revision "]), _draw(rng, hexadecimal, rng.choice([32, 40, 64])), rng.choice(["\n", " ", "."])),
        (rng.choice(["id: ", "uuid = ", "guid ", prose, "request "]), uuid, rng.choice(["\n", " ", ","])),
        (rng.choice(["card ", "phone ", "order no. ", prose, "ISBN ", "at "]), _draw(rng, _DIGITS, 16, 22), rng.choice([" ", ".", ","])),
        (rng.choice([prose, "see ", "import ", "call "]), long_name + rng.choice(["", _draw(rng, _DIGITS, 1, 3)]), rng.choice([" ", "(", ".", ","])),
        (rng.choice(["https://", "http://", "at /", prose, "see www."]), path + rng.choice(["", _draw(rng, _DIGITS, 1, 6)]), rng.choice([" ", ".html", "?q=1", "\n"])),
        (rng.choice(["https://a.example/", "/img/"]), _draw(rng, _ALNUM, 16, 40), rng.choice([" ", ".png", "\n"])),
        (f"{name}: ", rng.choice([word(), _syllables(rng), "true", "none", "null", "no", "required", "[]", "it"]), rng.choice([" " + word(), "\n", "."])),
        (f'{name} = "', rng.choice(["changeme", "your-token-here", "example", "<token>", "${TOKEN}", "xxxxxxxx", "placeholder", "********", "", word()]) or "todo", '"'),
        (f"{name} = ", rng.choice([f"get_{word()}()", f"os.environ[{word()}]", f"self.{word()}", f"config.{word()}.{word()}", "None", "nil"]), "\n"),
        (f"{prose}{name}: ", rng.choice([word(), _syllables(rng), "the", "we", _syllables(rng) + ","]), " " + word()),
        (f"{name}: ", _draw(rng, _DIGITS, 1, 3), "\n"),
        (prose, _syllables(rng) + _draw(rng, _DIGITS, 1, 4) + "-" + _syllables(rng) + "-" + _syllables(rng) + _syllables(rng), " "),
    ]
    return rng.choice(kinds)


def examples(each: int = 2_000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """``(before, candidate, after, label)``, ``each`` of either label."""
    rng = random.Random(seed)
    rows = []
    for _ in range(each):
        value, anywhere = _secret(rng)
        before, after = _before_secret(rng)
        if anywhere and rng.random() < 0.4:
            before, after = rng.choice([("see ", " there"), ("\n", "\n"), (_syllables(rng) + " ", ".")])
        rows.append((before, value, after, 1))
        rows.append((*_harmless(rng), 0))
    return rows
