"""Credentials in source text: found by a conditional random field over lexical tokens, redacted in place.

Whole texts are scanned for runs that could be a value (letters and digits mixed, or a private key's BEGIN line), and for what announces one whatever its
shape: a secret name, an auth word, userinfo of an address. Around each, the logical
line (string concatenations over several lines joined, a key block whole, very long lines as a window on either side) is cut into tokens,
each with features of shape, run and context; the Viterbi path tells which characters are a value, and nothing is added to or taken from its spans afterwards. What
is certain beforehand binds the path itself: placeholders, names before = and sums of references carry no value, and a value doesn't end inside its run of
characters. A row's text is never cut off, and nothing outside the labelled tokens changes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.crf import NONE, Crf

MODEL = os.path.join(os.path.dirname(__file__), "credentials_model.json")
REDACTED = "REDACTED"
WINDOW = 200
KEPT = 200_000

RUN = re.compile(r"[^\s\"'`<>(){}\[\],;]{8,}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile(r"\d")
_PLAIN = re.compile(r"[a-z_$.]+\d{1,3}|[a-z\-]+:(?:-?[\d.]+(?:px|r?em|%|m?s|v[hw]|fr)?|#[0-9a-f]{3,8})|\d+[a-z]{1,2}|0x[0-9a-f]+|(?:\\x[0-9a-f]{2})+|[\d.\-e+,:|/*%]+")
TOKEN = re.compile(r"-{5}[A-Z ]+-{5}|(?<![/.@:A-Za-z0-9])[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_\-]{16,}(?:\.[A-Za-z0-9_\-]{16,})+|(?<=\s-)p(?=[^\s\-]{4})|\w+|://|=>|\|\||\S")
BEGIN_PRIVATE = re.compile(r"-{5}BEGIN [A-Z ]*PRIVATE KEY-{5}")
_END = re.compile(r"-{5}END [A-Z ]*PRIVATE KEY-{5}")
_SUB = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Names that announce a secret, in six languages, and names that announce another opaque value.
SECRET = set("password passwd pass pwd passphrase passcode secret secrets token key apikey credential credentials creds auth bearer basic authorization private signing sig senha contrasena clave mot passe kennwort passwort parola login".split())
#: Of these, the ones that still tell when another word is glued to their front.
GLUED = tuple("password passwd passphrase passcode secret token apikey credential credentials passwort kennwort contrasena".split())
#: Of these, the names whose value people choose, so that it may be a plain word.
CHOSEN = set("password passwd pass pwd passphrase passcode secret senha contrasena clave passe kennwort passwort parola".split())
OPAQUE = set("etag commit revision integrity checksum digest hash sha sha256 sha512 md5 build uuid id icon image data public pub version cache blob draft nonce rev fingerprint resolved".split())
PREFIX = ("ghp_", "gho_", "ghs_", "ghu_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "rk_live_", "AKIA", "ASIA", "eyJ", "AIza", "npm_", "pypi-", "SG.")
DUMMY = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|change[-_]?me|replace[-_]?(?:me|this)?|todo|(?:for[-_]?)?example[-_]?(?:only)?|(?:insert|enter|put|paste|your)[-_].*|dummy|placeholder|<.*>|test|none|null|undefined|redacted|secret|password|[A-Za-z0-9_\-]*(?:x{6,}[A-Za-z0-9_\-]*|example))$")


def is_sum(run: str) -> bool:
    """Something like a.b=c.d+12; longer ones are left to the model, as the pattern takes squared time."""
    return len(run) <= 200 and bool(_EXPR.fullmatch(run))


def maybe(run: str) -> bool:
    return bool(_LETTER.search(run) and _DIGIT.search(run)) and not _PLAIN.fullmatch(run) and not is_sum(run)


def _join(line: str, after: str) -> bool:
    """Whether a string goes on in the line after."""
    a, b = line.rstrip(), after.lstrip()
    if not a or not b:
        return False
    if a[-1] in "+\\" or (a[-1] == "." and a[-2:-1] in " \"'"):
        return b[0] in "\"'`+" or a[-1] == "\\"
    return (a[-1] in "\"'" and (b[0] in "\"'" or b[:1] in "+." and b[1:].lstrip()[:1] in tuple("\"'"))) or (a[-1] == "(" and b[0] in "\"'")


def announced(text: str) -> list[tuple[int, int]]:
    """Where a secret name, an auth word or the userinfo of an address stands."""
    low = text.lower()
    if len(low) == len(text):
        at = []
        for w in _STEMS:
            i = low.find(w)
            while i >= 0:
                at.append((i, i + len(w)))
                i = low.find(w, i + len(w))
        at.sort()
    else:  # some capitals are longer in lower case
        at = [m.span() for m in _HOT.finditer(text)]
    if "://" in text:
        at = sorted(at + [m.span() for m in _USERINFO.finditer(text)])
    out: list[tuple[int, int]] = []
    upto = 0  # the end of the name seen last
    for a, b in at:
        if b <= upto:
            continue
        if text[a].isalpha():  # the whole name tells
            first, last = max(0, a - WINDOW), min(len(text), b + WINDOW)
            while a > first and (text[a - 1].isalnum() or text[a - 1] == "_"):
                a -= 1
            while b < last and (text[b].isalnum() or text[b] == "_"):
                b += 1
            upto = b
            if not text[a:b].isascii() or text[a:b].lower() not in _AUTH and _kind(text[a:b]) in ("-", "other", "opaque"):
                continue
        out.append((a, b))
    return out


def _whole(text: str, at: int, step: int) -> int:
    """The edge of a window moved outwards to the end of the word it cuts, by WINDOW characters at most."""
    upto = at + step * WINDOW
    while at != upto and 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
        at += step
    return at


def windows(text: str, dull: set[str]) -> list[tuple[int, int]]:
    """The spans that are worth labelling. dull: runs known not to be, kept over calls; they count where nothing announces a value."""
    runs = set(RUN.findall(text))
    runs -= dull
    new = {r for r in runs if not maybe(r)}
    dull |= new
    runs -= new
    key = "PRIVATE KEY-----" in text
    seeds = announced(text)
    if runs:
        seeds = sorted(seeds + [m.span() for m in RUN.finditer(text) if m.group() in runs])
    if not seeds and not key:
        return []
    spans = []
    a = b = -1
    for start, end in seeds:
        if start < b:  # the same logical line
            spans.append((max(a, start - WINDOW), min(b, end + WINDOW)))
            continue
        a = text.rfind("\n", 0, start) + 1
        b = text.find("\n", end)
        b = len(text) if b < 0 else b
        while a > 0:
            up = text.rfind("\n", 0, a - 1) + 1
            here = text.find("\n", a)
            if not _join(text[up : a - 1], text[a : here if here >= 0 else len(text)]):
                break
            a = up
        while b < len(text):
            down = text.find("\n", b + 1)
            down = len(text) if down < 0 else down
            if not _join(text[text.rfind("\n", 0, b) + 1 : b], text[b + 1 : down]):
                break
            b = down
        spans.append((max(a, start - WINDOW), min(b, end + WINDOW)))
    spans = [(_whole(text, a, -1), _whole(text, b, 1)) for a, b in spans]
    if key:
        for m in BEGIN_PRIVATE.finditer(text):
            a = max(text.rfind("\n", 0, m.start()) + 1, m.start() - WINDOW)
            e = _END.search(text, m.end())
            nxt = BEGIN_PRIVATE.search(text, m.end())
            if e and not (nxt and nxt.start() < e.start()):
                spans.append((a, e.end()))
            else:
                b = text.find("\n\n", m.end())
                spans.append((a, len(text) if b < 0 else b))
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shape(s: str) -> str:
    if not (s[0].isalnum() or len(s) > 3):
        return s
    up, low, dig = any(c.isupper() for c in s), any(c.islower() for c in s), any(c.isdigit() for c in s)
    return "UL"[low and not up] * (up or low) + "m" * (up and low) + "d" * dig or "?"


def _size(n: int) -> str:
    return str(n) if n < 6 else "6-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20-31" if n < 32 else "32-44" if n < 45 else "45-80" if n < 81 else "81+"


_HEX, _UUID = re.compile(r"[0-9a-f]{12,}"), re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_NAME = re.compile(r"[A-Za-z]+(?:[-_.][A-Za-z]+)*")
_VALUE = re.compile(r"[^\s\"'`<>(){}\[\],;]+")
_BODY = re.compile(r"(?:\\[nr]|[\s\"'`+.,\\])*(?:[A-Za-z0-9+/]{24,}|[A-Za-z0-9+/]+={1,2})")
_STOP = set("\"'`<>(){}[],;&@|")
_TURN = re.compile(r"(?=[a-zA-Z]\d|\d[a-zA-Z]|[a-z][A-Z]|[A-Z][a-z])")
_NAMED = re.compile(r"[A-Za-z_\-]+=(?=[^=\s\"'`])")
_BRIDGE = re.compile(r"(?<=[^\s\"'`=(,:])([\"'`]\s*[+.]?\s*\n\s*[+.]?\s*[\"'`])(?=[^\s\"'`])")
_PART = re.compile(r"(?<=[=:])[^=:/@&?\s]+(?=[@&]|$)")
_EXPR = re.compile(r"[\w.$=!&|?:]*[A-Za-z_$][\w.$]*[+*\-]\d{1,4}")
QUOTES = ('"', "'", "`")
_SUM = re.compile(r"(?:^|(?<=[=:&|?]))([A-Za-z_]\w{0,99}\.\w{1,99}\+\d{1,4}(?!\w))")  # without quotes, a reference and a number
_WORD = re.compile(r"[^\W\d_]")
_AUTH = set("pw connect authenticate signin".split())
_STEMS = tuple(sorted(w for w in SECRET | _AUTH | {" -u "} if not any(v != w and v in w for v in SECRET | _AUTH)))
_HOT = re.compile("(?i)" + "|".join(map(re.escape, _STEMS)))
_USERINFO = re.compile(r"://[^/@\s:]{0,200}:[^/@\s]{1,200}@")


@lru_cache(maxsize=200_000)
def _run_features(run: str) -> tuple[str, ...]:
    f = ["r" + _size(len(run))]
    let, dig = bool(_WORD.search(run)), bool(re.search(r"\d", run))
    f.append("rmix" if let and dig else "rlet" if let else "rdig" if dig else "rpun")
    core = run.strip(".:=")
    if _UUID.search(core):
        f.append("ruuid")
    if m := _HEX.search(core):
        f.append(f"rhex{len(m.group())}")
    if _NAME.fullmatch(core):
        f.append("rname")
    if DUMMY.match(core):
        f.append("rdummy")
    if is_sum(run):
        f.append("rexpr")
    if "://" in run:
        f.append("rurl@" if re.search(r"://[^/@\s]+:[^/@\s]+@", run) else "rurl")
    if "$" in run and ("${" in run or run.startswith("$")):
        f.append("rvar")
    for p in PREFIX:
        if p in run:
            f.append("rpre")
            break
    if re.search(r"[!#$%^&*?~]", run):
        f.append("rspec")
    if let and dig and len(run) >= 8 and not any(x[:4] in ("ruui", "rhex", "rnam", "rdum", "rurl", "rvar", "rexp") for x in f):
        f.append("rval")  # mixed, and none of the above
    if any(x.lower() in SECRET for x in _SUB.findall(run[:WINDOW])):
        f.append("rsec")  # speaks of a secret itself, as names of settings do
    if run.startswith(("./", "/", "../")):
        f.append("rpath")
    if let and dig:
        t = len(re.findall(r"[A-Z][a-z]|[a-z]\d|\d[A-Za-z]|[a-z][A-Z]", run))
        f.append("rturn" + ("0" if t < 2 else "1" if t < 4 else "2" if t < 8 else "3"))
        d = sum(c.isdigit() for c in run)
        f.append("rd" + ("1" if d < 2 else "2" if d < 4 else "4" if d < 6 else "6"))
    return tuple(f)


@lru_cache(maxsize=100_000)
def _kind(word: str) -> str:
    subs = [s.lower() for s in _SUB.findall(word)]
    if not subs:
        return "-"
    if any(s in OPAQUE for s in subs) and subs[-1] not in ("password", "secret", "pass", "pwd", "passphrase"):
        return "opaque" if not any(s in SECRET - {"key", "token", "auth", "login"} for s in subs) else "both"
    if any(s in SECRET for s in subs) or subs[-1].endswith(GLUED):
        return "secret" if not (len(subs) == 1 and subs[0] in ("token", "key", "auth", "login", "pass", "basic", "private")) else "weak:" + subs[0]
    return "other"


@lru_cache(maxsize=100_000)
def _chosen(word: str) -> str:
    """Whether a name ends in, has, or lacks a word for something people choose."""
    subs = [s.lower() for s in _SUB.findall(word)]
    return "end" if subs and (subs[-1] in CHOSEN or subs[-1].endswith(GLUED) and not subs[-1].endswith(("token", "apikey"))) else "in" if any(s in CHOSEN for s in subs) else "no"


_PREFIX = re.compile("|".join(map(re.escape, PREFIX)))
_NEAR = set("bearer basic u p mysql login creds user password pwd secret services env environ getenv / : @".split())


def _turns(w: str) -> int:
    """How often letters and digits, or capitals inside a word, take turns."""
    return len(_TURN.findall(w)) if any(c.isdigit() for c in w) else 0


@lru_cache(maxsize=200_000)
def _word(w: str) -> tuple[str, str, str, str, bool, str, bool, bool, str]:
    """Of one token: its shape, its length, how its neighbours see it (near, far), known prefix, as a near word, word, long, mixture."""
    shape, mark = _shape(w), not w[0].isalnum() and len(w) < 4
    low = w.lower()
    size = _size(len(w))
    return shape, size, w if mark else shape, w if mark else "w", bool(_PREFIX.match(w)), low if low in _NEAR else "", bool(_WORD.match(w)) and len(w) < 40, size in ("32-44", "45-80", "81+"), f"t{min(9, _turns(w))}{size}"


def tokens(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(s)]


def features(s: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    word = [s[a:b] for a, b in spans]
    info = [_word(x) for x in word]
    runs = [(m.start(), m.end()) for m in _VALUE.finditer(s)]
    last = len(spans) - 1
    out: list[list[str]] = []
    at, run, own, pre, pem, quote, named, plain = -1, "", (), False, "", "", "no", False
    hot = s.lstrip()[:2]
    comment = "c1" if hot[:1] in ("#", "*") or hot in ("//", "--", "/*") or "//" in s.replace("://", "") else "c0"
    seen_secret, name_kind, before_name, chosen, sign = "n", "none", "none", "no", ""
    no = ("^", "", "^", "^", False, "", False, False, "")
    for i, (a, b) in enumerate(spans):
        w, x = word[i], info[i]
        p1, p2 = info[i - 1] if i else no, info[i - 2] if i > 1 else no
        n1, n2 = info[i + 1][2] if i < last else "$", info[i + 2][3] if i + 1 < last else "$"
        while at + 1 < len(runs) and runs[at + 1][0] <= a:
            at += 1
            run = s[runs[at][0] : runs[at][1]]
            own = _run_features(run)
            named, plain = chosen, "rname" in own and "rsec" not in own
            pre = bool(_PREFIX.match(run))
        if w.startswith("-----BEGIN"):
            pem = ("priv" if "PRIVATE" in w else "pub") if _BODY.match(s, b) else "talk"
        f = ["s" + x[0], "l" + x[1], comment, "q" + quote, "k" + name_kind, "kk" + before_name, "a" + seen_secret, "p" + p1[2], "n" + n1, "pp" + p2[3], "nn" + n2, x[8], x[8] + name_kind]
        if pem:
            f += ["pem" + pem, f"pem{pem}{'x' if x[7] else '-'}"]
            if w.startswith("-----"):
                f.append("mark" + pem + ("b" if "BEGIN" in w else "e"))
        if at >= 0 and a < runs[at][1]:
            start = runs[at][0]
            f += own
            f += [f"ch{named}{own[1]}", f"ch{named}{own[1]}q{quote}{sign}", f"ch{named}{plain}q{quote}{sign}", f"ch{named}{own[0]}", f"n{n1}ch{named}q{quote}"]
            f += ["x" + name_kind + y for y in own[:2]] + ["q" + quote + y for y in own[1:3]] + [f"{y}&k{name_kind}" for y in own[2:]]
            off = a - start
            if off == 0:
                f.append("rb")
            else:
                f.append("rin")
                if spans[i - 1][1] == a:
                    f += ["cont", "cont" + own[1], "cont" + p1[0], "cont" + name_kind]
                head, tail = run[max(0, off - 400) : off], run[off + len(w) : off + 400]  # context, in linear time
                if "://" in head:
                    after = head.split("://", 1)[1]
                    if "@" in tail and "/" not in after:
                        f.append("userinfo" + ("pw" if ":" in after else "u"))
                    else:
                        place = "url" + ("/" * min(6, head.count("/")) if "?" not in head else "?") + ("" if tail else "$")
                        f += [place, place + x[8]]
                if "=" in head:
                    kind = _kind(head.rsplit("=", 1)[0].rsplit("&", 1)[-1].rsplit("?", 1)[-1])
                    f += ["eq" + kind, f"eq{kind}{own[1]}"]
                elif ":" in head and "://" not in head:
                    f.append("col" + _kind(head.rsplit(":", 1)[0].rsplit(":", 1)[-1]) + own[1])
            if x[4] or (pre and off == 0):
                f.append("pre")
        if p1[5]:
            f.append("w1" + p1[5])
        if p2[5]:
            f.append("w2" + p2[5])
        out.append(f)
        # context for the tokens that follow
        if w in ("'", '"', "`"):
            quote = "" if quote == w else quote or w
            if not quote:
                sign = ""
        elif x[6]:
            k = _kind(w) if (not a or s[a - 1].isascii() or not s[a - 1].isalpha()) else "other"  # else the end of a word
            if k != "-":
                before_name, name_kind = name_kind, k
                if not quote or k != "other":
                    chosen, sign = _chosen(w), ""
                if k in ("secret", "both"):
                    seen_secret = "s"
                elif k.startswith("weak") and seen_secret == "n":
                    seen_secret = "w"
        elif w in (";", "{", "&"):
            name_kind = before_name = "none"
            chosen, sign = "no", ""
        elif w in ("=", ":", "=>", "(", ".", "?"):
            sign = w
        elif w.startswith("-----END"):
            pem = ""
    return out


FREE, NEVER, ON, INSIDE = 0, 1, 2, 4


def limits(s: str, spans: list[tuple[int, int]]) -> list[int]:
    """What is certain of each token before decoding, as flags: NEVER part of a value, goes ON with the value before it if there is one, can't begin a value but only stand INSIDE one."""
    out = []
    for i, (a, b) in enumerate(spans):
        x = FREE
        if s[a] in QUOTES:
            x = INSIDE
        elif i and spans[i - 1][1] == a and s[a] not in _STOP and not s.startswith("-----END", spans[i - 1][0]):
            x = ON
        if i and spans[i - 1][1] == a and s[a - 1].isalnum() and not s[a].isalnum():
            x |= INSIDE
        out.append(x)
    if "\n" in s:  # a value joined from literals on several lines goes on in the next
        i = 0
        for m in _BRIDGE.finditer(s):
            while i < len(spans) and spans[i][0] < m.start(1):
                i += 1
            while i < len(spans) and spans[i][0] <= m.end(1):
                out[i] |= ON
                i += 1
    if "-----BEGIN" in s:
        return out
    i = 0
    for m in _VALUE.finditer(s):
        a, b = m.span()
        run = m.group()
        upto = b if DUMMY.match(run.strip(".:=")) else n.end() if (n := _NAMED.match(s, a, b)) else a
        while i < len(spans) and spans[i][0] < a:
            i += 1
        while i < len(spans) and spans[i][1] <= upto:
            out[i] = NEVER
            i += 1
        sums = [] if s[a - 1 : a] in QUOTES else [m.span(1) for m in _SUM.finditer(run)]
        for x, y in sums + [m.span() for m in _PART.finditer(run) if DUMMY.match(m.group())]:
            x, y = a + x, a + y
            if x < y:
                for k in range(i, len(spans)):
                    if spans[k][0] >= y:
                        break
                    if spans[k][0] >= x:
                        out[k] = NEVER
    return out


@lru_cache(maxsize=1)
def model(path: str = MODEL) -> Crf:
    crf = Crf.load(path)
    crf.t_list[0][2] = crf.start_list[2] = NONE  # a value has a beginning
    return crf


class Finder:
    """Value spans of texts; labelled windows are kept up to a bound, as nested chunks repeat them."""

    def __init__(self, path: str = MODEL) -> None:
        self.crf, self.dull, self.known = model(path), set(), {}

    def label(self, todo: list[str]) -> None:
        spans = [tokens(s) for s in todo]
        for s, own, lab in zip(todo, spans, self.crf.viterbi([features(s, x) for s, x in zip(todo, spans)], [limits(s, x) for s, x in zip(todo, spans)])):
            found: list[list[int]] = []
            for (a, b), y in zip(own, lab):
                if y == 1:
                    found.append([a, b])
                elif y == 2:
                    found[-1][1] = b
            self.known[s] = tuple((a, b) for a, b in found)

    def find(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if len(self.dull) > 4 * KEPT:
            self.dull.clear()
        if len(self.known) > KEPT:
            self.known.clear()
        at = [windows(t, self.dull) if t else [] for t in texts]
        todo = {t[a:b] for t, w in zip(texts, at) for a, b in w} - self.known.keys()
        if todo:
            self.label(sorted(todo))
        return [[(a + x, a + y) for a, b in w for x, y in self.known[t[a:b]]] for t, w in zip(texts, at)]


@lru_cache(maxsize=1)
def finder(path: str) -> Finder:
    return Finder(path)


def _pairs(text: str, spans: list[tuple[int, int]]) -> list[int]:
    out, line, last = [], 1, 0
    for a, _ in spans:
        line += text.count("\n", last, a)
        last = a
        if not out or out[-1] != line:
            out.append(line)
    return out


def _rows(b: pa.RecordBatch, step: int = 256) -> Iterator[tuple[list, list[str]]]:
    for at in range(0, len(b), step):
        yield b.column(0).slice(at, step).to_pylist(), [t or "" for t in b.column(1).slice(at, step).to_pylist()]


def found(df: DataFrame, key: str, text: str, path: str = MODEL) -> DataFrame:
    """(row_id long, line_no int): the lines on which a value begins, each once a row. Null and empty texts have none; repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(path)
        for b in batches:
            ids, lines = [], []
            for keys, texts in _rows(b):
                for k, t, spans in zip(keys, texts, f.find(texts)):
                    own = _pairs(t, spans)
                    ids += [k] * len(own)
                    lines += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], ["row_id", "line_no"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null").mapInArrow(run, "row_id long, line_no int")


def redact(df: DataFrame, key: str, text: str, path: str = MODEL, mark: str = REDACTED) -> DataFrame:
    """(row_id long, n_values int, text string) of every row: values replaced by mark, all else as it was; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(path)
        for b in batches:
            out, n = [], []
            for _, texts in _rows(b):
                for t, spans in zip(texts, f.find(texts)):
                    n.append(len(spans))
                    for a, z in reversed(spans):
                        t = t[:a] + mark + t[z:]
                    out.append(t)
            null = b.column(1).is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array([None if x else t for x, t in zip(null, out)], pa.string())], ["row_id", "n_values", "text"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "row_id long, n_values int, text string")
