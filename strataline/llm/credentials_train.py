"""Fits the model of credentials.py: python -m strataline.llm.credentials_train [OUT]. Prints its held-out accuracy.

The labelled rows are written by the rules below (SAMPLE of them, a fixed bound): common ways in which settings, headers, addresses and
command lines hold a value or something that only looks like one. Made-up words keep the model from learning a vocabulary.
"""

from __future__ import annotations

import random
import string
import sys

from strataline.llm.credentials import MODEL, PREFIX, _chosen, features, limits, tokens
from strataline.llm.crf import Crf

SAMPLE, HELD_OUT, SEED = 16_000, 2_000, 7
AL, HX, B64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        c, v = "bcdfghklmnprstvw", "aeiou"
        self.words = ["".join(self.r.choice(c) + self.r.choice(v) + self.r.choice(["", "r", "n", "ck", "st", "l"]) for _ in range(self.r.choice([1, 2, 2, 3]))) for _ in range(900)]

    def s(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def w(self) -> str:
        return self.r.choice(self.words)

    def name(self) -> str:
        a = [self.w() for _ in range(self.r.choice([1, 2, 2, 3]))]
        return self.r.choice([a[0] + "".join(x.title() for x in a[1:]), "_".join(a), "".join(x.title() for x in a), a[0]])

    def secret_name(self) -> str:
        a = self.r.choice("db password|client secret|api key|auth token|access token|signing key|smtp pass|passphrase|private token|webhook secret|master password|secret key|mot de passe|contrasena|senha|kennwort|passwort|pwd|password|secret|clave|user password|refresh token|encryption key|session secret|private key|bot token|admin pass".split("|")).split()
        if self.r.random() < 0.15:
            a = [self.w(), *a]
        if self.r.random() < 0.12:  # glued to what stands before
            n = self.r.choice([self.w(), self.w()[:2], "db", "my", "app"]) + self.r.choice(["password", "passwd", "secret", "passphrase", "token", "apikey"])
            return self.r.choice([n, n.upper()])
        return self.r.choice([a[0] + "".join(x.title() for x in a[1:]), "_".join(a), "_".join(a).upper(), ".".join(a), "-".join(a)])

    def opaque_name(self) -> str:
        return self.r.choice(["etag", "commit", "integrity", "buildId", "build_id", "revision", "checksum", "digest", "hash", "sha256", "icon", "pub", "publicKey", "traceId", "requestId", "version", "md5", "nonce", "fingerprint"])

    def token(self) -> str:
        r, s = self.r, self.s
        return r.choice([
            lambda: r.choice(["ghp_", "gho_", "ghs_"]) + s(AL, 36), lambda: "glpat-" + s(AL, 20), lambda: f"xoxb-{s(string.digits, 11)}-{s(AL, 24)}", lambda: "sk_live_" + s(AL, 24), lambda: "AKIA" + s(string.ascii_uppercase + "234567", 16),
            lambda: f"eyJ{s(AL, r.randrange(20, 36))}.eyJ{s(AL, r.randrange(30, 60))}.{s(AL + '-_', 43)}", lambda: s(AL, r.randrange(20, 44)), lambda: s(B64, 39 + r.randrange(4)) + "=", lambda: s(AL + "-_", r.randrange(22, 44)), lambda: s(r.choice([string.ascii_lowercase, string.ascii_letters]), r.randrange(20, 41)), lambda: s(HX, r.choice([32, 40, 40, 64])),
        ])()

    def password(self) -> str:
        r, s = self.r, self.s
        d = s(string.digits, r.randrange(3, 6))
        a, b = self.w(), self.w()
        return r.choice([
            lambda: a.title() + b + d, lambda: a.title() + b + d + r.choice("!#%*?$"), lambda: f"{a.title()}{r.choice('-#!$.')}{d}{b}", lambda: f"{a.title()}{r.choice('.!')}{b}{r.choice('?$')}{d}", lambda: s(AL, r.randrange(10, 17)),
            lambda: s(AL, r.randrange(8, 13)) + r.choice("!#$%") + s(AL, r.randrange(1, 4)), lambda: a.title() + d + r.choice("xyz"), lambda: a + d + b, lambda: s(string.ascii_letters, r.randrange(9, 16)) + s(string.digits, 1), lambda: s(string.ascii_letters, r.randrange(4, 9)) + s(string.digits, 2) + s(string.ascii_letters, r.randrange(2, 5)),
        ])()

    def plain(self) -> str:
        """What people choose: words, a word with a number, something short."""
        r, s = self.r, self.s
        a, b, c = (self.w() for _ in range(3))
        n = s(string.digits, r.choice([1, 2, 2, 3]))
        return r.choice([
            lambda: a + b, lambda: a + b + c, lambda: a.title() + b.title(), lambda: s(string.ascii_letters, r.randrange(7, 15)), lambda: a + b + n, lambda: a + n, lambda: f"{a.title()}{r.choice('-*+_')}{s(string.digits, 4)}", lambda: f"{a.title()}{r.choice('-*+')}{n}",
            lambda: s(AL, r.randrange(5, 8)), lambda: a.title() + b + r.choice("!?$#"), lambda: r.choice("-_.").join([a, b, c, self.w()][: r.choice([3, 4, 4])]), lambda: s(string.digits, r.randrange(6, 17)), lambda: a.replace("a", "@", 1) + self.foreign() + r.choice(["", "-" + b, n]), lambda: self.foreign() + r.choice(["-", "_", ""]) + self.foreign(),
        ])()

    def foreign(self) -> str:
        """A word with letters beyond ASCII."""
        w = self.w()
        for x, y in self.r.sample([("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "é"), ("i", "í"), ("n", "ñ"), ("s", "ß")], 4):
            w = w.replace(x, y, 1)
        return w if not w.isascii() else w + self.r.choice("äöüéñ")

    def chosen_name(self) -> str:
        while not (n := self.secret_name()) or _chosen(n.replace(".", "_").replace("-", "_")) != "end":
            pass
        return n

    def plain_negative(self) -> str:
        """Plain words beside secret names that are no values."""
        r = self.r
        a, b, c = (self.w() for _ in range(3))
        n, q = self.secret_name().replace(".", "_").replace("-", "_"), r.choice("'\"")
        m, p = r.choice(["Field", "Label", "Hint", "Type", "Name", "Input", "Error", "Key", "Header", "Policy", "Rule"]), r.choice(["password", "passwd", "secret", "pwd", "token", "auth", "apiKey"])
        t = r.choice(["token", "key", "auth", "login", "secret"])
        if r.random() < 0.4:  # code that only carries such words
            t, types = r.choice([t, "token", "token", n]), ["String", "string", "int", "long", "bool", "boolean", "List<String>", a.title(), b.title() + c.title()]
            args = ", ".join(f"{r.choice(types)} {self.w()}" for _ in range(r.randrange(3)))
            minified = "".join(r.choice([f"!function({self.s('abcm', 1)}){{\"use strict\";{self.s('abc', 1)}.{self.w()}={self.s('abc', 1)}.{t}+{r.randrange(300)}}}({self.s('rxu', 1)});", f"{self.s('dmnp', 1)}.{self.name()}=function({self.s('ab', 1)},{self.s('kj', 1)}){{for(var c=0;c<{self.s('ab', 1)}.length;c++){self.s('jk', 1)}.push({self.s('ab', 1)}[c])}};", f"if({self.s('abc', 1)}&&!{self.s('ruz', 1)})throw new Error(\"{r.choice([t, self.w()])}\");", f"var {self.s('ck', 1)}={self.s('uy', 1)}||{{}},{self.s('gjk', 1)}=[];", f"{self.s('ehg', 1)}={self.s('gnp', 1)}=>{self.s('rtp', 1)}({self.s('gnp', 1)},{r.randrange(300)}),", f"function {self.s('b', 1)}(s){{return s.{r.choice([t, self.w()])}?{self.s('g', 1)}(s,2):void 0}}"]) for _ in range(r.randrange(2, 16)))
            typed = [f"{x}: {r.choice([a.title() + b.title(), c.title(), 'number', 'string', f'Map<string,{c}>', c.title() + '[]'])}" for x in (t, self.w(), self.w())[: r.randrange(1, 4)]]
            r.shuffle(typed)
            return r.choice([
                f"{r.choice(['', 'async ', 'function ', 'async function '])}{self.name()}({', '.join(typed)}) {{", f"{r.choice(['', 'async ', 'function ', 'async function '])}{self.name()}({', '.join(typed)}) {{", f"{a}.{b}.{r.choice(['token', 'key', 'auth'])}={r.randrange(9999)}",
                f"private {r.choice(['', '', 'static ', 'final ', 'readonly ', 'async '])}{r.choice(types)} {self.name()}({args}) {{", f"private {r.choice(['', 'static ', 'final ', 'readonly '])}{r.choice(types)} {self.name()}{r.choice([';', f' = {c};', ' = 0;', f': {a.title()};'])}", f"private function {self.name()}(${a}, ${b})", f"{r.choice(['const ', 'let ', 'var ', '$', '', '', a + '.', 'this.'])}{t} {r.choice(['=', '=', ':='])} {self.name()}({r.choice(['', '$', ''])}{c}){r.choice([';', ''])}",
                f"{r.choice(['const ', '$', '', a + '.', ''])}{self.name()} {r.choice(['=', ':='])} {self.name()}({r.choice(['', '$'])}{t}){r.choice([';', ''])}", f"{r.choice(['const ', '$', '', ''])}{self.name()} = {b}.{self.name()}({t}, {self.name()}){r.choice([';', ''])}", f"{t} = {self.name()}{r.choice(['.' + self.name(), '[' + c + ']', ''])}{r.choice([';', ''])}", f"return {self.name()}({t}, {c}){r.choice([';', ''])}", minified, minified,
            ])
        return r.choice([
            f"const {p}{m} = {q}{a}{r.choice(['', '-' + b, b.title(), ' ' + b])}{q};", f"  {p}{m}: {q}{a.title()} {b}{q},", f"<add key=\"{a}_{t}\" value=\"{r.choice([b, f'./{b}/{c}', t, r.randrange(9999), r.randrange(99999)])}\" />", f"{a}_{t} = {q}{r.choice([b, f'./{b}/{c}', r.randrange(9999)])}{q}", f"{a}.{t}={r.choice(['./', ''])}{b}/{c}", f"{a}{r.choice('._')}{t}{r.choice(['=', ': '])}{r.randrange(99999)}", f"{self.s('abcmz', 1)}.{t}={self.s('abcmz', 1)}.{a}+{r.randrange(300)}", f"  {a}_{t}: {r.choice(['./', ''])}{b}/{c}",
            f"  {a}_{t}: {b}", f"{a}.{b}.{t}={c}", f"type: {q}{p}{q},", f"<input type=\"{p}\" name=\"{r.choice([a, p])}\" placeholder=\"{a.title()} {b}\">", f"  \"{a}_{b}/{c}-{t}\": {{", f"{{ key: {q}{a}{q}, label: {q}{b.title()} {c}{q} }},", f"  {n}: {r.choice(['string', 'String', a, a.title(), a + '.' + n, a + b.title()])}{r.choice([';', ',', ''])}",
            f"{n} = {r.choice([a, a + '.' + b, f'{a}.{b}({c})', f'{a}({n})', 'null', 'None', 'true', f'new {a.title()}()'])}{r.choice([';', ''])}", f"{a}({q}{t}.{b}{q}, {c});", f"{a}.{b} = {c}.{self.name()}({n});", f"throw new Error({q}{a.title()} {p} {b}{q});", f"if ({n} === {q}{q} || {n} == {a}) {{", f"form.get({q}{p}{q}).set({q}{a}{q});",
            f"@param {p} the {a} {b} of the {c}", f"// the {p} is {a} {r.choice(['in', 'by', 'from', 'of'])} {b} and {c}", f"# {a} {b} {p} {r.choice(['for', 'of', 'and'])} {c}", f"def {a}_{t}({b}, {n}):", f"{a}.{r.choice(['login', 'connect', 'auth', 'authenticate'])}({b}, {n});", f"{a}.{r.choice(['connect', 'login'])}({q}{b}{q});", f"case {q}{p}{q}: return {a}.{b};",
            f"{a}.setItem({q}{p}{r.choice(['', '_' + b])}{q}, {c});", f"{n} == {q}{a}{q}", f"\"{p}\": {{ \"type\": \"{a}\", \"title\": \"{b.title()}\" }}", f"${n} = ${a}->{b}(${c});", f"$this->{n} = ${n};", f"const {self.name()} = {{ {p}: {a}.{b}, {c} }};", f"https://{a}.example/{p}/{b}?{c}={a}", f"const {a} = {q}{b}{q}; // {p} {c}", f"import {{ {p} }} from {q}./{a}/{b}{q};",
        ])

    def dummy(self) -> str:
        return self.r.choice(["changeme", "xxxxxxxx", "<secret>", "REPLACE_ME", "YOUR_PASSWORD_HERE", "for-example", "enter_password_here", "your-api-key", "", "${DB_PASSWORD}", "${VAULT_TOKEN}", "{{ .Values.token }}", "$CLIENT_SECRET", "%(password)s", "vault:secret/data/app", "x-secret-name", "api_key_header", "session-password-field", "placeholder", "********", "TODO", "<your token>", "{{ lookup('env', 'TOKEN') }}", "x-api-key", "auth_token_v2", "password_field_2"])

    def other(self) -> str:
        r, s = self.r, self.s
        return r.choice([
            lambda: "-".join(s(HX, n) for n in (8, 4, 4, 4, 12)), lambda: s(HX, r.choice([16, 32, 40, 64])), lambda: "sha512-" + s(B64, 86) + "==", lambda: "sha256:" + s(HX, 64), lambda: "data:image/png;base64," + s(B64, r.randrange(60, 200)), lambda: f"{self.w()} {self.w()}",
            lambda: f"./{self.w()}/{self.w()}{r.randrange(99)}", lambda: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(9)}", lambda: f"https://{self.w()}.example/{self.w()}/{self.w()}{r.randrange(99)}", lambda: str(r.randrange(99999)), lambda: f"{self.w()}_{r.randrange(20)}", lambda: ", ".join(f"{self.w()}_{i}" for i in range(9)),
            lambda: f"{self.w()}.{self.w()}{self.w().title()}", lambda: f"2023-0{r.randrange(1, 9)}-1{r.randrange(9)}T10:22:03Z", lambda: f"{self.w()}@{self.w()}.example", lambda: f"#{s(HX, 6)}", lambda: "|".join(self.name() for _ in range(12)), lambda: f"Password must have at least {r.randrange(6, 20)} characters", lambda: f"{self.w()}{self.w().title()}{r.randrange(99)}",
        ])()

    def assign(self, name: str, value: str, split: bool = False) -> tuple[str, str]:
        """Text before and after the value."""
        q = self.r.choice("'\"")
        name2 = name.replace(".", "_").replace("-", "_")
        end = self.r.choice([";", ";", "", "; // " + self.w() + " " + self.w(), " # " + self.w() + " this", ",", "; // " + self.w() + " of the " + self.w()])
        form = self.r.choice([*range(18), 9, 9])
        return [
            (f"const {name2} = {q}", q + end), (f"let {name2} = {q}", q + end), (f"  final String {name2} = \"", '"' + end), (f"    ${name2} = {q}", q + end), (f"{name2} = {q}", q), (f"    {name2} = {q}", q + end), (f"  \"{name}\": \"", '",'), (f"{name}: ", ""), (f"  {name}: \"", '"'),
            (f"  <add key=\"{name}\" value=\"", '" />'), (f"{self.w()}.{name}=", ""), (f"{name2.upper()}=", ""), (f"export {name2.upper()}=\"", '"'), (f"var {name2} = {q}", q + end), (f"const {name2} = process.env.{self.w().upper()}_KEY || {q}", q + end),
            (f"{name2} = os.environ.get('{self.w().upper()}', {q}", q + ")"), (f"  public static {name2} = {q}", q + end), (f"{name2}={q}", q + ")"),
        ][form]

    def positive(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.r
        q = r.choice("'\"")
        p = self.password()
        t = self.token()
        v = r.choice([p, t, t])
        u = r.choice(["admin", "root", "deploy", "app", self.w(), self.w() + "_" + self.w(), self.w()])
        host = f"{self.w()}{r.randrange(9)}.{self.w()}.example"
        c = r.choice(["// ", "# ", "-- ", " * ", ""])
        start = r.choice([f"const {self.name()} = {q}", f"{self.name()} = {q}", f"    ${self.name()} = {q}", f"    final String {self.name()} = {q}"])
        end = q + r.choice([";", "", ")", ");"])
        k = min(r.randrange(19), 16) if r.random() < 0.93 else 14
        if k <= 4:
            if r.random() < 0.38:
                a, b = self.assign(self.chosen_name(), "")
                quoted = a[-1] in "'\""
                v = " ".join(self.w() for _ in range(r.randrange(3, 6))) if quoted and r.random() < 0.12 else self.plain()
                while not quoted and a[-1] != "=" and not (v[-1].isdigit() and len(v) > 7):  # elsewhere a bare word is a name
                    v = self.plain()
                return a + v + b, [(len(a), len(a) + len(v))]
            a, b = self.assign(self.secret_name(), v)
            if r.random() < 0.15 and len(v) > 10 and a[-1] in "'\"":  # joined from two literals
                cut = r.randrange(4, len(v) - 3)
                glue = a[-1] + r.choice([" +\n      ", "\n    + ", " .\n    ", "\n        ", " + "]) + a[-1]
                if r.random() < 0.3:
                    a = a[:-1] + "(" + a[-1]
                text = a + v[:cut] + glue + v[cut:] + b
                return text, [(len(a), len(a) + len(v) + len(glue))]
            return a + v + b, [(len(a), len(a) + len(v))]
        pre, post = {
            5: (f"{start}{r.choice(['postgres', 'mysql', 'redis', 'amqp', 'mongodb', 'https'])}://{u if r.random() < 0.85 else ''}:", f"@{host}:5432/{self.w()}{end}"),
            6: (f"{start}Server={host};Database={self.w()};User Id={u};{r.choice(['Password', 'Pwd', 'PWD'])}=", r.choice([";Timeout=9", ""]) + end),
            7: (f"{c}curl -u {u}:", f" https://{host}/api/{self.w()}") if r.random() < 0.6 else (f"{c}{r.choice(['mysql', 'mysqldump', 'mysql -h ' + host])} -u {u} -p", f" {self.w()}"),
            8: (f"{start}dump --host {host} --user {u} --{r.choice(['password', 'pass', 'token'])}{r.choice(['=', ' '])}", f" --all{end}"),
            9: (f"{start}{{\"login\": \"{u}\", \"{r.choice(['secret', 'password', 'pwd'])}\": \"", f"\"}}{end}") if r.random() < 0.5 else (f"opts = {{'user': '{u}', '{r.choice(['secret', 'password', 'pwd'])}'{r.choice([': ', ' => '])}'", "'}"),
            10: (f"{self.w()}.{r.choice(['login', 'connect', 'authenticate', 'auth'])}('{u}', '", "');"),
            11: (f"headers{r.choice(['[', '.set(', '.put('])}{q}Authorization{q}{r.choice(['] = ', ', ', ': '])}{q}{r.choice(['Bearer ', 'Bearer ', 'token '])}", f"{q});"),
            12: (f"{start}Authorization: {r.choice(['Basic', 'Bearer'])} ", end),
            13: (f"{start}https://{host}/{self.w()}?{self.w()}={self.w()}&{r.choice(['access_token', 'token', 'api_key', 'sig', 'key', 'apikey'])}=", r.choice([f"&v={r.randrange(9)}", ""]) + end),
            14: (f"{start}https://{r.choice(["hooks", "hook", "webhooks", self.w()])}.example/{r.choice(["services", "services", "hooks", self.w()])}/T{self.s(AL.upper(), 8)}/B{self.s(AL.upper(), 8)}/", end),
            15: (r.choice([f"{c}{r.choice([self.w() + ' creds:', self.w() + ' ' + self.w() + ', login is', self.w() + ' password =', self.w() + ' account:', 'login', 'credentials:'])} {u} / ", f"{c}{r.choice(['password for', 'pw of'])} {u} is ", f"{c}{self.w()} {r.choice(['password', 'token', 'key'])}: "]), r.choice(["", " (expires soon)"])),
            16: (r.choice(["", "auth:", "apiKey=", "Bearer ", "token:", "session.set('", f"localStorage.setItem('auth:", f"localStorage.getItem('", f"  sessionStorage.getItem('Bearer ", f"{self.w()}Storage.setItem('apiKey="]), ""),
        }[k]
        if k in (5, 6, 7, 8, 9, 10, 15):
            v = p if r.random() < 0.9 or k == 15 else t
            if r.random() < (0.6 if k == 15 and " / " in pre else 0.35) and not (k == 15 and " is " in pre):
                v = self.w() + self.w() if k == 15 and r.random() < 0.5 else self.plain()
            if k == 9 and "opts" in pre:
                v = p
        elif k == 12:
            v = self.s(B64, r.randrange(20, 44)) + r.choice(["", "=", "=="])
        elif k == 14:
            v = self.s(AL, 24)
        elif k == 16:
            v = t
            while not any(c in v for c in string.digits) or (len(v) in (32, 40, 64) and set(v) <= set(HX) and not pre[-7:].startswith("Bearer")):
                v = self.token()
            while not pre.strip() and not v.startswith(PREFIX):  # alone on a line only a token of known form is a value
                v = self.token()
            if "'" in pre:
                post = r.choice(["');", "', " + self.w() + ");"])
        else:
            v = t if r.random() < 0.85 else p
        return pre + v + post, [(len(pre), len(pre) + len(v))]

    def pem(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.r
        kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]) if r.random() < 0.65 else r.choice(["PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE"])
        nl = r.choice(["\n", "\n", "\n", "\\n", "\n    "])
        body = nl.join(self.s(B64, 64) for _ in range(r.randrange(1, 5))) + nl + self.s(B64, r.randrange(10, 60)) + "=="
        block = f"-----BEGIN {kind}-----{nl}{body}{nl}-----END {kind}-----"
        pre, post = r.choice([("const pem = `", "`;"), ("key = \"\"\"\n", "\n\"\"\""), ("", ""), ("// ", ""), (f"{self.name()} = \"", "\""), ("  private_key: |\n    ", "")])
        if r.random() < 0.15:
            return f"if ({self.w()}.{r.choice(['includes', 'startsWith'])}('-----BEGIN {kind}-----')) return {r.randrange(9)};", []
        if r.random() < 0.1:
            block = f"-----BEGIN {kind}-----{nl}{r.choice(['...', '<key>', 'REPLACE_ME', '(your key here)'])}{nl}-----END {kind}-----"
            return pre + block + post, []
        if r.random() < 0.1:
            block = block.rsplit(nl, 1)[0]
        return pre + block + post, [(len(pre), len(pre) + len(block))] if "PRIVATE" in kind else []

    def negative(self) -> tuple[str, list]:
        r = self.r
        if r.random() < 0.35:
            return self.plain_negative(), []
        k = r.randrange(20)
        q = r.choice("'\"")
        if k < 4:
            a, b = self.assign(self.secret_name(), "")
            return a + self.dummy() + b, []
        if k < 8:
            a, b = self.assign(self.opaque_name(), "")
            o = self.other()
            if r.random() < 0.25:
                b += r.choice(["// checksum of the empty " + self.w(), "# pinned revision", "// pinned revision"])
            return a + o + b, []
        if k < 11:
            a, b = self.assign(self.name(), "")
            return a + self.other() + b, []
        if k == 10 and r.random() < 0.4:  # numbers beside such names
            n = r.choice(["token", "password", "secret", "passwd", "key", "session"])
            m = r.choice(["Count", "Length", "MinLength", "Expiry", "TTL", "Timeout", "Size", "Index", "Limit", "Attempts"])
            return r.choice([f"const {n}{m} = {r.randrange(99999)};", f"{n}_{m.lower()}: {r.randrange(9999999)}", f"max_{n}s = {r.randrange(99999)}", f"{n}{m}={r.randrange(999999)}", f"if ({n}.length > {r.randrange(99)}) {{", f"{n} = {r.randrange(9999)};", f"{n}.{self.w()}({r.randrange(99999)});", f"find . -name '{self.w()}' -print", f"mkdir -parents {self.w()}", f"ssh -port {r.randrange(9999)} {self.w()}@{self.w()}"]), []
        if k == 11:
            n = self.secret_name().replace(".", "_").replace("-", "_")
            return r.choice([f"const {n} = process.env.{self.w().upper()}_TOKEN;", f"{n} = os.environ[\"{self.w().upper()}_TOKEN2\"]", f"var {n} = Environment.GetEnvironmentVariable(\"{self.w().upper()}_TOKEN\");", f"{n} = config.get('{self.w()}.{self.w()}2')", f"$this->{n} = ${self.w()}->{self.w()}2;", f"if ({n} === {self.w()}{r.randrange(99)}) {{", f"const {n} = await vault.read('{self.w()}/{self.w()}{r.randrange(99)}');", f"function {n}({self.w()}, {self.w()}{r.randrange(9)}) {{"]), []
        if k == 12:
            return r.choice([f"const url = \"postgres://user:${{PGPASSWORD}}@{self.w()}:5432/{self.w()}\";", f"  db: https://{self.w()}.example:8{r.randrange(100, 999)}/{self.w()}/{self.w()}", f"curl -u $USER:$PASSWORD https://{self.w()}{r.randrange(9)}.example/", f"see https://{self.w()}.example/{self.w()}?page={r.randrange(99)}&sort={self.w()}", f"git clone git@{self.w()}{r.randrange(99)}.example:{self.w()}/{self.w()}.git", f"dump --host db{r.randrange(9)}.example --user {self.w()} --password=$PASSWORD --all", f"opts = {{'user': 'a{r.randrange(99)}', 'pwd': {self.w()}{r.randrange(99)}}}"]), []
        if k == 13:
            return f"{r.choice(['localStorage', 'sessionStorage'])}.{r.choice(['getItem', 'setItem', 'removeItem'])}({q}" + r.choice([f"draft:{'-'.join(self.s(HX, n) for n in (8, 4, 4, 4, 12))}", f"blob:{self.s(HX, 40)}", f"cache:sha256:{self.s(HX, 64)}", "password_reset_seen", "secret-santa-theme", "api_key_hint", "auth_token", f"{self.w()}.{self.w()}{r.randrange(99)}", f"tokenKey{r.randrange(9)}"]) + f"{q}" + r.choice(["", f", {self.w()}"]) + ");", []
        if k == 14:
            return r.choice([f"draft:{'-'.join(self.s(HX, n) for n in (8, 4, 4, 4, 12))}", f"blob:{self.s(HX, 40)}", f"cache:sha256:{self.s(HX, 64)}", f"[\"{self.w()}{r.randrange(9)}\", {r.random() * 90:.5f}, {-r.random() * 90:.5f}],", f"{r.randrange(99999)},{self.w()},{r.random():.6f},1", self.s(B64, 64), f"const BLOB = \"{self.s(B64, r.randrange(100, 300))}\";", f"\\x{self.s(HX, 2)}\\x{self.s(HX, 2)}\\x{self.s(HX, 2)}", f"\"{self.s(B64, 32)}\";", f"'{self.s(AL, 25)}'"]), []
        if k == 15:
            return f"  \"resolved\": \"https://registry.example/{self.w()}/-/{self.w()}-{r.randrange(9)}.{r.randrange(9)}.1.tgz\", \"integrity\": \"sha512-{self.s(B64, 86)}==\"", []
        if k == 16:
            return f"// {self.w()} {self.w()} {r.choice(['password', 'token', 'secret', 'key'])} {self.w()} in {self.w()}{r.randrange(99)}.{self.w()} and {self.name()}{r.randrange(9)}", []
        if k == 17:
            m = r.choice(["token", "secret", "key", "password", "auth", self.w(), self.w()])
            return "".join(r.choice([f"!function({self.s('abc', 1)}){{\"use strict\";{self.s('abc', 1)}.{m}={self.s('abc', 1)}.{self.w()}+{r.randrange(99)}}}({self.s('xyz', 1)});", f"{self.s('abc', 1)}={self.s('xyz', 1)}=>{self.s('ab', 1)}({m},{r.randrange(999)}),", f"if({self.s('abc', 1)}&&!u)throw new Error(\"{m}\");", f"var {self.s('abc', 1)}={self.s('xyz', 1)}||{{}},{self.s('efg', 1)}=[];", f"{self.s('abc', 1)}.{self.name()}=function(a,b){{for(var c=0;c<a.length;c++)b.push(a[c])}};", f".{self.w()[:2]}{r.randrange(99)}{{margin:{r.randrange(30)}px;color:#{self.s(HX, 3)};flex:0}}"]) for _ in range(3)), []
        if k == 18:
            return f"    expect({self.name()}({self.w()})).toBe({r.randrange(99)}); // {self.name()}{r.randrange(9)}", []
        n = self.name()
        return r.choice([f"const {n} = {self.w()}.{self.name()}{r.randrange(9)}({self.w()}, {r.randrange(99)});", f"function {n}{r.randrange(9)}(token: Token[], key2: string) {{", f"{n}.password = {self.w()}.{self.name()}{r.randrange(9)};", f"return base64Encode64({n}, sha256Hex(token));", f"import {{ {n} }} from './{self.w()}{r.randrange(99)}';"]), []

    def row(self):
        x = self.r.random()
        text, spans = self.positive() if x < 0.48 else self.pem() if x < 0.56 else self.negative()
        if "\n" not in text and self.r.random() < 0.3:  # indentation and a trailing remark
            pad = " " * self.r.randrange(1, 12)
            text, spans = pad + text, [(a + len(pad), b + len(pad)) for a, b in spans]
        own = tokens(text)
        lab = [0] * len(own)
        for a, b in spans:
            inside = [i for i, (x, y) in enumerate(own) if x < b and y > a]
            for i in inside:
                lab[i] = 2
            lab[inside[0]] = 1
        return text, features(text, own), lab


def fit(n: int = SAMPLE, seed: int = SEED, epochs: int = 170) -> Crf:
    m = Maker(seed)
    return Crf.train([m.row()[1:] for _ in range(n)], 3, epochs)


def score(crf: Crf, n: int = HELD_OUT, seed: int = SEED + 1):
    """(precision, recall) of whole rows' spans, and wrong rows."""
    m = Maker(seed)
    rows = [m.row() for _ in range(n)]
    hit = said = true = begun = 0
    wrong = []
    for (text, _, lab), got in zip(rows, crf.viterbi([r[1] for r in rows], [limits(r[0], tokens(r[0])) for r in rows])):
        said += 1 in got or 2 in got
        true += 1 in lab
        hit += 1 in lab and got == lab
        begun += 1 in lab and (1 in got or 2 in got)
        if got != lab:
            wrong.append((text, "".join(map(str, lab)), "".join(map(str, got))))
    print(f"rows with a value found {begun / true:.4f}, rows named rightly {begun / said:.4f}")
    return hit / said, hit / true, wrong


if __name__ == "__main__":
    crf = fit()
    crf.save(sys.argv[1] if len(sys.argv) > 1 else MODEL)
    p, r, wrong = score(crf)
    print(f"precision {p:.4f}, recall {r:.4f}, {len(crf.index)} features")
    for x in wrong[:40]:
        print(*x, sep="\n  ")
