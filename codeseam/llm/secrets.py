"""Credentials embedded in source code and configuration: finding and redacting them.

Method: an Aho-Corasick automaton over keywords and issuer prefixes picks the lines worth a look; on these, issuer
formats, private key blocks, addresses with a password, and assignments to telling names are matched by regular
expressions; each hit is validated by its structure (a JWT's parts must be JSON, Base64 must decode to something that
is no placeholder, a value must not be a reference, a word, a pattern, a path or a checksum). Redaction puts a
placeholder of the same length and alphabet in each hit's place, so that the file stays valid and lines stay in place.

Nothing looks at what the file is for: a key in a test is a key.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeseam.session import broadcast_if_small, checkpointed


class Hit(NamedTuple):
    kind: str
    spans: tuple[tuple[int, int], ...]  # the value's characters; several if the literal is split

    @property
    def start(self) -> int:
        return self.spans[0][0]


# Formats of tokens as their issuers publish them.
ISSUERS = {
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}",
    "gitlab": r"glpat-[A-Za-z0-9_-]{20,}",
    "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "sk_key": r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}",
    "slack": r"xox[abeoprs]-[A-Za-z0-9-]{20,}|https://hooks\.slack\.com/services/[A-Z0-9]+/[A-Z0-9]+/[A-Za-z0-9]{16,}",
    "google": r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])|ya29\.[0-9A-Za-z_-]{30,}",
    "sendgrid": r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])",
    "npm": r"npm_[A-Za-z0-9]{36}",
    "pypi": r"pypi-AgEI[A-Za-z0-9_-]{40,}",
    "hugging_face": r"hf_[A-Za-z0-9]{30,}",
    "digitalocean": r"do[opr]_v1_[0-9a-f]{64}",
    "shopify": r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}",
    "twilio": r"SK[0-9a-f]{32}(?![0-9A-Za-z])",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{16,}",
    "age": r"AGE-SECRET-KEY-1[0-9A-Z]{50,}",
}
#: Beginnings by which the automaton finds them.
ISSUER_PREFIXES = (
    "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ rk_test_ sk- xoxa- xoxb- xoxe- xoxo- xoxp- xoxr- xoxs- "
    "hooks.slack.com AIza ya29. SG. npm_ pypi-AgEI hf_ doo_v1_ dop_v1_ dor_v1_ shpat_ shpca_ shppa_ shpss_ eyJ AGE-SECRET-KEY-"
).split()

#: Words that name a credential, in some languages.
STRONG = set(
    "password passwd passwords passphrase passcode pwd pw pass secret pepper secrets credential credentials passwort kennwort contrasena contraseña clave "
    "motdepasse senha parola wachtwoord haslo hasło heslo salasana lösenord geheimnis geheim secreto segreto segredo пароль 密码 口令 密钥 パスワード 비밀번호".split()
)
WEAK = set("token tokens tok jeton bearer auth apikey authkey authtoken accesstoken accesskey secretkey privatekey signkey токен 令牌 トークン".split())
#: What makes a ``key`` a credential.
KEY_OF = set(
    "api access auth secret private signing sign encryption encrypt storage service deploy master license account shared client server hmac session crypto "
    "tls ssl ssh webhook app root admin host cipher jwt cookie aes rsa".split()
)
#: What makes a ``key`` something else.
KEY_NOT_OF = set("public primary foreign sort cache map partition group row column item index object lookup hot short cut shortcut dedupe composite natural".split())
#: Last words that turn a telling name into something else.
NOT_VALUE = set(
    "name names hint hints rule rules regex regexp pattern patterns path paths label labels message messages msg help header headers field fields min max "
    "length len ttl seconds minutes hours days expiry expires expiration age count limit size type types kind id ids map list url uri host file files dir "
    "prompt placeholder title text description desc error errors policy format prefix suffix digest checksum algorithm alg version required enabled disabled "
    "mode scheme strength reset page form input button index store provider manager handler env var ref template charset table column key_id status state".split()
)

_WORDS = re.compile(r"[A-Z]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[\u0400-\u04ff]+|[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]+")


@lru_cache(maxsize=20_000)
def telling(name: str) -> int:
    """2 if something called so should be a credential, 1 if it may be one, else 0."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while len(words) > 1 and len(words[-1]) == 1:
        words.pop()
    if not words or words[-1] in NOT_VALUE:
        return 0
    if words[-1] in STRONG or words[-1] in WEAK or "".join(words[-3:]) in STRONG:
        return 2
    if words[-1] in ("key", "keys"):
        return 2 if len(words) > 1 and words[-2] in KEY_OF else int(len(words) > 1 and words[-2] not in KEY_NOT_OF)
    if words[-1] in ("value", "setting", "prod", "dev", "staging", "live", "old", "new", "current"):
        return telling("_".join(words[:-1])) if len(words) > 1 else 0
    return 2 if any(w in STRONG for w in words) else 0


_PLACEHOLDER = re.compile(
    r"""(?ix) \byour\b | your[-_ ] | (?<![a-z])example(?![a-z]) | EXAMPLE$ | placeholder | change[-_ ]?(?:me|it|this) | replace[-_ ]?(?:me|this|with) | redacted | insert[-_ ]
      | goes[-_ ]here | dummy | (?<![a-z])todo(?![a-z]) | \bnot[-_ ]?set\b | fill[-_ ]?(?:me|in)\b
      | \$\{ | \$\( | \{\{ | %\( | <%= | \#\{ | ^\$\w+$ | ^%\w+%$ | ^@\w+@$ | ^__\w+__$ | ^[<\[{(].*[>\]})]$
      | (?:process\.env|os\.environ|getenv|System\.getProperty|ENV\[|secrets?\.|vault:|ref\+|arn:aws|!Ref|op://|env:|file:|ssm:|sops:|secretKeyRef)
      | ([xX*.#?•0-])\1{3,} | ^[.…_-]+$ | ^x+$ """
)
_NOTHING = set(
    "password passwd pass secret token none null nil true false undefined empty unset default admin root test guest user string required optional hidden "
    "masked secretref tbd n/a".split()
)


def placeholder(value: str) -> bool:
    return value.strip().lower() in _NOTHING or bool(_PLACEHOLDER.search(value)) or len(set(value)) < 4


_WORDY = re.compile(r"[A-Za-z]+(?:[-_. ][A-Za-z]+)*\d{0,2}")
_NUMBER = re.compile(r"[-+]?[\d._,:]+[a-z%]{0,3}")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PATTERN = re.compile(r"\[[^\]]+\](?:[{+*?]|$)|\\[dwsbDWS]|\(\?|[.)][+*](?:$|\W)|^\^|\(\w+\|")
_PATH = re.compile(r"[./~]*[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+/?|/[\w.-]+(?:/[\w.-]+)*")
_CHECKSUM = re.compile(r"(?i)(?:sha\d{1,3}|md5|blake\w+)[:-]")
_PASSPHRASE = re.compile(r"[A-Za-z]+(?:[-_.][A-Za-z]+){2,}[-_.]?\d+")
_CHARSET = re.compile(r"(?i)abcdefghij|0123456789|qwertyuiop")


def usable(value: str) -> bool:
    """True if a value that a telling name has been given looks like a credential and not like something else."""
    if len(value) < 8 or placeholder(value) or any(c.isspace() for c in value):
        return False
    if _NUMBER.fullmatch(value) or _UUID.fullmatch(value) or _CHECKSUM.match(value) or _PATTERN.search(value) or _CHARSET.search(value):
        return False
    if _PATH.fullmatch(value) or "://" in value or "(" in value and value.endswith(")"):
        return False
    if _PASSPHRASE.fullmatch(value):
        return True
    if _WORDY.fullmatch(value):  # words alone; only a long jumble of cases is more
        changes = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]))
        return len(value) >= 16 and value.isalnum() and changes * 3 >= len(value)
    return any(c.isdigit() for c in value) or any(c in "!@#$%^&*?~+=" for c in value)


_B64 = re.compile(r"[A-Za-z0-9+/]{8,}={0,2}")


def decoded(value: str) -> str | None:
    """The printable text, of one line or several, that a Base64 value stands for, or None."""
    if not _B64.fullmatch(value) or len(value) % 4 or len(value) < 8:
        return None
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError):
        return None
    text = text.strip()
    return text if text.replace("\r", "").replace("\n", "").isprintable() else None


def _json_part(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return None


def _valid(kind: str, value: str) -> bool:
    """The structure behind the format."""
    body = re.sub(r"^[A-Za-z]+[-_.]", "", value)
    if placeholder(value) or len(set(body)) < 8:
        return False
    if kind == "jwt":
        header, payload, _ = value.split(".", 2)
        header, payload = _json_part(header), _json_part(payload)
        return isinstance(header, dict) and "alg" in header and str(header["alg"]).lower() != "none" and isinstance(payload, dict)
    if kind == "sk_key":  # words with hyphens look alike
        return any(c.isdigit() for c in body) and any(c.isupper() for c in body)
    return True


#: Issuers whose beginning is too short for the automaton: it would pick nearly every line.
_SHORT_PREFIX = re.compile(r"(?<![A-Za-z0-9_])(?:" + ISSUERS["twilio"] + ")")
_ISSUER = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in ISSUERS.items()) + ")")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|[\s\"'+,>#*|]|//)*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*(?:\\[nr]|\s)+)*([A-Za-z0-9+/=]{16,}(?:(?:\\[nr]|[\s\"'+,>#*|]|//)+[A-Za-z0-9+/=]+)*)")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s\"'`@]+)@(?=[\w\[])", re.I)
_BASIC = re.compile(r"(?i)\bbasic\s+([A-Za-z0-9+/]{8,}={0,2})")
_BEARER = re.compile(r"(?i)\bbearer\s+([A-Za-z0-9._~+/-]{16,}=*)")
_NAME = r"[A-Za-z_À-ÿ\u0400-\u04ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af][\w.\-]*"
_QUOTED = r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)"
#: Where a name can begin; a later character of the same run gives no other match, so long values are not read again from each.
_AT_NAME = r"(?<![\w.\-])(?:(?![A-Za-z_À-ÿ\u0400-\u04ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af])[\w.\-])*+"
_ASSIGN = re.compile(rf"{_AT_NAME}(?P<k>{_NAME})[\"'`\]]*(?:\s*:\s*(?:[\w<>\[\]|*& ]+))?\s*(?::=|=>|[=:])\s*(?:new\s+\w+\(|[uUrRbBfF]{{1,2}}(?=[\"']))?{_QUOTED}")
_PAIR = re.compile(rf"[\"'](?P<k>{_NAME})[\"']\s*,\s*{_QUOTED}")
_ATTRIBUTE = re.compile(rf"\b(?:name|key|id)\s*=\s*[\"'](?P<k>{_NAME})[\"'][^<>\n]*?\bvalue\s*=\s*{_QUOTED}|<(?P<k2>{_NAME})>(?P<x>[^<\n]+)</")
_PLAIN = re.compile(rf"^[ \t]*(?:(?:export|ENV|ARG|set|setx)[ \t]+|-[ \t]+|//\S+?/?:)?[\"']?(?P<k>{_NAME})[\"']?[ \t]*(?:[=:]|(?<=\w)[ \t](?=\S+$))[ \t]*(?P<v>[^\s\"'`#][^\s\"'`]*)[ \t]*\r?(?:[ \t]#.*)?$")
_BLOCK_SCALAR = re.compile(rf"^[ \t]*(?:-[ \t]+)?[\"']?(?P<k>{_NAME})[\"']?[ \t]*:[ \t]*[|>][-+\d]*[ \t]*\r?$")
_COMMENT = re.compile(r"\s*(?://|#|\*|/\*|--|;|<!--)")
_FALLBACK = re.compile(rf"(?:process\.env\.|import\.meta\.env\.|(?:os\.environ(?:\.get)?|getenv|Getenv|env)[(\[][\"'])(?P<k>{_NAME})[\"')\]]*\s*(?:\|\||\?\?|,|\bor\b)\s*{_QUOTED}")
_FLAG = re.compile(r"(?i)(?<![\w-])--?(?:password|passwd|pass|token|secret|api-?key|access-?key|auth-?token|client-?secret)(?:=|[ \t]+)[\"']?(?P<v>[^\s\"']+)")
_WORD_VALUE = re.compile(r"(?i)\b(?:password|passwd|identified\s+by)\s+(?:'(?P<s>[^'\n]+)'|\"(?P<d>[^\"\n]+)\"|`(?P<b>[^`\n]+)`|(?P<v>[^\s'\"`=:;,]+)(?=\s*\r?$))")
_USERPASS = re.compile(r"(?<!\S)(?:-u|--user)(?:=|[ \t]+)[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")
_PROSE = re.compile(
    rf"(?i)\b(?:{'|'.join(sorted(map(re.escape, STRONG | WEAK | {'key', 'api key'}), key=len, reverse=True))})\b[^\n\"'`=:]{{0,24}}?(?:\b(?:is|was|ist|lautet|est|es|è|é)\b|:)\s*[\"'`]?(?P<v>[^\s\"'`]+)"
)
_PGPASS = re.compile(r"^[^\s:#]+:(?:\d{2,5}|\*):[^\s:]+:[^\s:]+:(?P<v>[^\s]+)\r?$", re.M)
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'")
_JOINED = re.compile(r"([\"'`])[ \t]*\+[ \t\r]*\n?[ \t]*\1")
#: Files whose bare words are expressions, so that only literals can be credentials.
_CODE = re.compile(r"(?i)\.(?:py|js|mjs|cjs|jsx|ts|tsx|go|java|c|h|cc|cpp|hpp|cs|rs|rb|php|kt|scala|swift|json|css|html?|svg|sql)$")


def _encoded(prefixes) -> set[str]:
    """What these beginnings look like inside Base64, at each of the three alignments."""
    out = set()
    for prefix in prefixes:
        for shift in range(3):
            text = base64.b64encode(b"\0" * shift + prefix.encode()).decode().rstrip("=")
            inner = text[-(-shift * 4 // 3) : (len(prefix) + shift) * 4 // 3]
            if len(inner) >= 5:
                out.add(inner)
    return out


_ENCODED_BEGIN = re.compile("|".join(sorted(_encoded(["-----BEGIN"]))))
_B64_ONLY = re.compile(r"[A-Za-z0-9+/=\s]*+")
_B64_RUN = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")
#: Lines of nothing else, in which a long value goes on.
_B64_LINES = re.compile(r"(?:(?:[ \t\r]|\\[nr])*\n[ \t]*[A-Za-z0-9+/]+={0,2}(?=[ \t]*\r?(?:\n|\Z)))*+")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def _key_block(text: str) -> bool:
    """True if a private key block with a body of its own is in the text."""
    return any((body := _PEM_BODY.match(text, m.end())) and len(set(body[1])) >= 8 for m in _PEM.finditer(text))


def _encoded_key(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Where the Base64 characters ``start:end`` and the lines in which they go on hold a private key block, if they do."""
    more = _B64_LINES.match(text, end).end()
    at = [i for i in range(start, more) if text[i].isalnum() or text[i] in "+/"]
    for first in range(min(4, len(at))):  # a path's slash can stand before
        value = "".join(text[i] for i in at[first:])
        inner = base64.b64decode(value[: len(value) // 4 * 4] + (value[len(value) // 4 * 4 :] + "==")[:4] * (len(value) % 4 > 1)).decode("latin-1")
        if _key_block(inner):
            ends = [m.end() for m in _PEM_END.finditer(inner)]
            last = at[min(len(at), first + -(-ends[-1] * 4 // 3)) - 1] + 1 if ends else more
            return at[first], max(last, end)
    return None


def _in_data_uri(line: str, at: int) -> bool:
    """True if nothing but Base64 stands between a data URI's head and this place."""
    head = line.rfind("base64,", 0, at)
    return head >= 0 and _B64_ONLY.fullmatch(line, head + 7, at) is not None


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    names = STRONG | WEAK | {"key", "auth", "login", "identified by", "basic ", "-----begin", "://", "mot_de_passe", "mot-de-passe", "motdepasse", "-u ", "--user"}
    for word in names | set(ISSUER_PREFIXES) | _encoded([*ISSUER_PREFIXES, "-----BEGIN"]):
        a.add_word(word.lower(), len(word))
    a.make_automaton()
    return a


def find(text: str | None, path: str | None = None) -> list[Hit]:
    """The credentials of a text in their order; overlapping matches count as the first and longest of them."""
    if not text:
        return []
    joined = _JOINED.search(text)
    if joined is None:
        return _find(text, path, None)
    kept, at = [], 0  # literals put together, with each character's place
    for m in _JOINED.finditer(text):
        kept.append((at, m.start()))
        at = m.end()
    kept.append((at, len(text)))
    return _find("".join(text[a:b] for a, b in kept), path, kept)


def _find(text: str, path: str | None, kept: list[tuple[int, int]] | None) -> list[Hit]:
    lower = text.lower()
    if len(lower) != len(text):  # few letters change their length; keep offsets right
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
    lines = {bisect_right(breaks, end) - (1 if end not in (breaks[bisect_right(breaks, end) - 1],) else 2) for end, _ in _automaton().iter(lower)}
    lines |= {bisect_right(breaks, m.start() - 1) - 1 for m in _SHORT_PREFIX.finditer(text)}
    found: list[tuple[int, int, str]] = []
    add = lambda kind, a, b: found.append((a, b, kind))
    bare = not (path and _CODE.search(path))
    if ":" in text:
        for m in _PGPASS.finditer(text):
            if not placeholder(m["v"]) and len(m["v"]) >= 6 and "/" not in m["v"]:
                add("pgpass", *m.span("v"))
    for number in sorted(lines):
        a, b = breaks[number] + 1, breaks[number + 1]
        line = text[a:b]
        for m in _PEM.finditer(line):
            body = _PEM_BODY.match(text, a + m.end())
            if body or not text[a + m.end() :].strip():
                add("private_key", a + m.start(), body.end(1) if body else a + m.end())
        for m in _ISSUER.finditer(line):
            if _valid(m.lastgroup, m.group()) and not _in_data_uri(line, m.start()):
                add(m.lastgroup, a + m.start(), a + m.end())
        for m in _URL.finditer(line):
            if not placeholder(m[2]) and len(m[2]) >= 4:
                add("url_password", a + m.start(2), a + m.end(2))
        for m in _BASIC.finditer(line):
            pair = decoded(m[1])
            if pair and ":" in pair and "\n" not in pair and "\r" not in pair and not placeholder(pair.split(":", 1)[1]) and len(pair.split(":", 1)[1]) >= 4:
                add("basic_auth", a + m.start(1), a + m.end(1))
        for m in _BEARER.finditer(line):
            if usable(m[1]):
                add("bearer", a + m.start(1), a + m.end(1))
        for rx in (_ASSIGN, _PAIR, _ATTRIBUTE, _FALLBACK):
            for m in rx.finditer(line):
                name = m["k"] if rx is not _ATTRIBUTE else m["k"] or m["k2"]
                group = next((g for g in ("d", "s", "b", "x") if g in rx.groupindex and m[g] is not None), None)
                if group and _secret(m[group], telling(name)):
                    add("assignment", a + m.start(group), a + m.end(group))
        if bare:
            m = _PLAIN.match(line)
            if m and _secret(m["v"], telling(m["k"])):
                add("assignment", a + m.start("v"), a + m.end("v"))
            m = _BLOCK_SCALAR.match(line)
            if m and number + 2 < len(breaks):  # the value is the next line
                own = text[b + 1 : breaks[number + 2]].rstrip("\r")
                value = own.strip()
                if _secret(value, telling(m["k"])):
                    at = b + 1 + own.index(value)
                    add("assignment", at, at + len(value))
        for rx in (_FLAG, _WORD_VALUE, _USERPASS):
            for m in rx.finditer(line):
                group = next(g for g in ("v", "s", "d", "b") if g in rx.groupindex and m[g] is not None)
                if rx is _WORD_VALUE and group == "v" and not bare:
                    continue
                if _secret(m[group]) or rx is _WORD_VALUE and group != "v" and len(m[group]) >= 6 and not placeholder(m[group]) and not re.search(r"\s", m[group]):
                    add("argument", a + m.start(group), a + m.end(group))
        for m in _PROSE.finditer(line):
            value = m["v"].rstrip(".,;:!?)")
            if _secret(value) and not _WORDY.fullmatch(value) and (bare or _COMMENT.match(line) or re.search(r"\d", value) and re.fullmatch(r"[\w!@#$%^&*?~+=./-]+", value) and not re.search(r"[(){}\[\]]", line)):
                add("prose", a + m.start("v"), a + m.start("v") + len(value))
        for m in _STRING.finditer(line):  # under any name, if it decodes to a token of a known issuer
            value = m[1] or m[2] or ""
            inner = decoded(value) if len(value) >= 20 else None
            if inner and any(_valid(i.lastgroup, i.group()) for i in _ISSUER.finditer(inner)):
                add("encoded_token", a + m.start() + 1, a + m.end() - 1)
        if _ENCODED_BEGIN.search(line):
            for m in _B64_RUN.finditer(line):
                if _ENCODED_BEGIN.search(m[0]) and (span := _encoded_key(text, a + m.start(), a + m.end())):
                    add("encoded_key", *span)
    out: list[Hit] = []
    last = -1
    for x, y, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if x > last or not out:
            out.append(Hit(kind, ((x, y),)))
            last = y - 1
    if kept is None:
        return out
    return [Hit(h.kind, _spread(h.spans[0], kept)) for h in out]


def _spread(span: tuple[int, int], kept: list[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """The parts of the split text in which a span of the joined text lies."""
    spans, at = [], 0
    for a, b in kept:
        x, y = max(span[0], at), min(span[1], at + b - a)
        if x < y:
            spans.append((a + x - at, a + y - at))
        at += b - a
    return tuple(spans)


def _secret(value: str, told: int = 2) -> bool:
    """A telling name's value; where it is Base64 of a text, that text decides. A name that tells less needs a random value."""
    if told < 2 and not (told and len(value) >= 20 and re.search(r"\d", value) and re.fullmatch(r"[A-Za-z0-9+/_=-]+", value) and not _PASSPHRASE.fullmatch(value)):
        return False
    inner = decoded(value) if len(value) >= 8 else None
    if inner and not (value.isalnum() and (value.islower() or value.isupper() or value.isdigit())):
        if _key_block(inner):
            return True
        if "\n" not in inner and "\r" not in inner and placeholder(inner):
            return False
        if usable(inner) or ":" in inner and usable(inner.split(":", 1)[1]) or _ISSUER.search(inner):
            return True
    if _PEM.search(value):
        return False  # found as a block
    return usable(value)


def redact(text: str, hits: list[Hit]) -> str:
    """The text with each hit's letters and digits blanked: as long as before, in the same alphabet, lines in place."""
    if not hits:
        return text
    out = list(text)
    for hit in hits:
        for a, b in hit.spans:
            if hit.kind == "private_key":
                a = text.find("-----", text.find("-----", a) + 5) + 5
            escaped = False
            for i in range(a, b):
                c = out[i]
                if escaped:  # an escape keeps its meaning
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c.isdigit():
                    out[i] = "0"
                elif c.isalpha():
                    out[i] = "X" if c.isupper() else "x"
    return "".join(out)


#: Bytes by which a worker remembers what it has found in texts, so that copies are scanned once; beyond it memory begins
#: anew, which changes the speed only. A text is remembered by its hash.
REMEMBERED_BYTES = 32 * 1024 * 1024
_ENTRY_BYTES, _HIT_BYTES = 250, 400


def _remembering():
    """``find`` with a memory."""
    known: dict[bytes, list[Hit]] = {}
    held = 0

    def run(text: str | None, path: str | None) -> list[Hit]:
        nonlocal held
        if not text:
            return []
        key = xxhash.xxh3_128_digest(f"{bool(path and _CODE.search(path))}{text}".encode("utf-8", "surrogatepass"))
        hits = known.get(key)
        if hits is None:
            hits = find(text, path)
            held += _ENTRY_BYTES + len(hits) * _HIT_BYTES
            if held > REMEMBERED_BYTES:
                known.clear()
                held = 0
            known[key] = hits
        return hits

    return run


def find_credentials(df: DataFrame, key: str = "id", content: str = "content", path: str = "path", start_line: str = "start_line") -> DataFrame:
    """``key, line_no, kind, from_char, to_char``: each credential of each row; offsets are those in ``content``.

    ``line_no`` counts in the file (a null ``start_line`` counts as 1). Null and empty texts have none. A row that is
    repeated gives its credentials again: see ``credential_lines``.
    """
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"), F.col(path).alias("path"), F.coalesce(F.col(start_line), F.lit(1)).cast("bigint").alias("line"))
    schema = T.StructType(
        [rows.schema["key"], T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("from_char", T.IntegerType()), T.StructField("to_char", T.IntegerType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = _remembering()
        for b in batches:
            out = [
                (k, line + text.count("\n", 0, hit.start), hit.kind, hit.start, hit.spans[-1][1])
                for k, text, p, line in zip(b["key"], b["content"], b["path"], b["line"])
                for hit in scan(text, p)
            ]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def credential_lines(df: DataFrame, key: str = "id", **columns: str) -> DataFrame:
    """``key, line_no``: each line on which a credential begins, once."""
    return find_credentials(df, key, **columns).select(key, "line_no").distinct()


_BODY_LINE = re.compile(r"[\s\"'+,>#*|/]*(?:[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]{1,15}={0,2})[\s\"'+,\\nr]*")
_BODY_FIRST = r"^[\s\"'+,>#*|/]*[A-Za-z0-9+/=]{16,}[\s\"'+,\\nr]*(\n|$)"


def _leading_body(text: str) -> tuple[int, int, bool]:
    """Of a text that begins inside a key block: the characters and lines of the block, and whether it goes on at the end."""
    at = lines = 0
    for line in text.split("\n"):
        if not _BODY_LINE.fullmatch(line) or "-----" in line:
            return at, lines, False
        at, lines = at + len(line) + 1, lines + 1
    return len(text), lines, True


def key_continuations(chunks: DataFrame, key: str = "id", content: str = "content", path: str = "path") -> DataFrame:
    """``key, inside``: the rows of ``chunks`` that begin inside a private key block of an earlier chunk of their file, with
    the number of leading characters that belong to it.

    ``chunks`` has ``file_id, start_line, end_line`` as well. Only rows with a key's mark and rows that begin with a line of
    Base64, of files that have such a mark, are looked at; of a file their line numbers are gathered, not their texts.
    """
    rows = chunks.where(F.col(content).isNotNull() & F.col("file_id").isNotNull()).select(
        F.col(key).alias("key"), "file_id", F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col(content).alias("content"), F.col(path).alias("path")
    )
    ddl = "key string, file_id string, first int, last int, goes_on boolean, inside int, opens boolean"

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, f, line, text, p in zip(b["key"], b["file_id"], b["start_line"], b["content"], b["path"]):
                for hit in find(text, p):
                    if hit.kind == "private_key":
                        end = hit.spans[-1][1]
                        last = line + text.count("\n", 0, end)
                        out.append((k, f, int(line + text.count("\n", 0, hit.start)), int(last), not text[end:].strip(), 0, True))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, f, line, text in zip(b["key"], b["file_id"], b["start_line"], b["content"]):
                inside, n, goes_on = _leading_body(text)
                out.append((k, f, int(line), int(line + n - 1), goes_on, inside, False))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    opened = checkpointed(rows.where(F.col("content").contains("PRIVATE KEY")).mapInPandas(marks, ddl))
    begun = rows.where(F.col("content").rlike(_BODY_FIRST)).join(broadcast_if_small(opened.select("file_id").distinct()), "file_id", "left_semi")
    spans = opened.unionByName(begun.select("key", "file_id", "start_line", "content").mapInPandas(leading, ddl))
    per_file = spans.groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct("first", ~F.col("opens"), "last", "goes_on", "inside", "key"))).alias("spans"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for spans_ in b["spans"]:
                since, until = 1, 0  # the lines after the block's first that belong to it, as far as is known
                for first, begins, last, goes_on, inside, k in (tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in spans_):
                    if not begins:
                        since, until = (first, max(until, last + goes_on)) if first <= until else (first, last + goes_on)
                    elif since < first <= until and inside:
                        out.append((k, inside))
                        until = max(until, last + goes_on)
            yield pd.DataFrame(out, columns=["key", "inside"])

    return per_file.mapInPandas(follow, "key string, inside int").groupBy("key").agg(F.max("inside").alias("inside")).withColumnRenamed("key", key)


def redact_credentials(df: DataFrame, content: str = "content", path: str = "path", key: str = "id") -> DataFrame:
    """All rows and columns of ``df`` with redacted ``content`` and the number of credentials that begin there as
    ``n_redacted``, which replaces a column of that name. Null contents stay null with 0 credentials.

    Where ``df`` has ``file_id, start_line, end_line``, a private key that goes on in the next pieces of its file is blanked
    there too.
    """
    df = df.drop("n_redacted", "_inside")
    if {key, "file_id", "start_line", "end_line"} <= set(df.columns):
        more = broadcast_if_small(checkpointed(key_continuations(df, key, content, path)).withColumnsRenamed({key: "_key", "inside": "_inside"}))
        rows = df.join(more, F.col(key) == F.col("_key"), "left").drop("_key")
    else:
        rows = df.withColumn("_inside", F.lit(None).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField("n_redacted", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = _remembering()
        for b in batches:
            texts, numbers = [], []
            for text, p, inside in zip(b[content], b[path], b["_inside"]):
                hits = scan(text, p)
                numbers.append(len(hits))
                if pd.notna(inside):
                    hits = [Hit("encoded_key", ((0, int(inside)),)), *hits]
                texts.append(redact(text, hits) if hits else text)
            yield b.drop(columns=["_inside"]).assign(**{content: texts, "n_redacted": numbers})

    return rows.mapInPandas(run, schema)
