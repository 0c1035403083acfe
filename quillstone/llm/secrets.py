"""Problem 3: credentials in source code and configuration.

First every string of every text is scored: it is *unnatural* if a public tokenizer's vocabulary needs many pieces for
it (few characters per subword).  Only lines that hold an unnatural string are looked at further.  There context rules
say what the string is used as: its name or header, the form of its carrier (URL, key block, provider prefix), and what
only stands for a value (placeholders, references to variables or vaults, digests, ids).  A string that is very
unnatural needs no telling name.  A found value is redacted in place: every character becomes the mask, so offsets,
lines and the code around it stay.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Vocabulary (ranks in tiktoken's format) and where the public tokenizers' files lie; see ``tokenizer``.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters per subword below which a string is looked at, counts as random, and counts as random whatever its name.
SUSPECT, UNNATURAL, RANDOM = 3.4, 2.6, 2.0
#: Length from which a string without a telling name may be a credential.
LONG = 20
#: The strings that are scored.
_STRINGS = re.compile(r"[A-Za-z0-9_+$!#%^*~-]{6,}")
MASK = "X"

#: Words that name a secret, alone or at the end of a run-together word; and those that are a secret's name only after a further word.
_SECRET_WORD = re.compile(
    r"(?:\w*pass(?:w(?:or)?d|phrase|wrd)|\w{0,6}pass|passw|pwd?|\w*secret|\w*token|key|(?:api|access|secret|auth|private|shared|master|service|account|license|deploy|sign|signing|encrypt|encryption|session)key"
    r"|\w*auth(?!or)|authorization|credentials?|cookie|webhook|salt|hmac|bearer|jwt|pat)\w{0,2}|\w*smtpp(?:w|ass)\w{0,3}"
)
#: Words of names that hold a name, a rule or a public value, not a secret.
_PUBLIC_WORDS = set(
    "public field policy bucket column type tokentype name names secretname request trace commit revision rev etag check checksum digest integrity icon hash sha trusted finger fingerprint count limit "
    "length size expiry expires expiration ttl url path file filename regex pattern label title hint prompt placeholder keyword keycolumn uuid guid nonce cert certificate version".split()
)
_PUBLIC_NAME = re.compile(r"(?i)sha\d|primary_?key|foreign_?key|key_?id$|ids?$")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


#: Letters that patterns without case take for i and s.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s"}


@lru_cache(maxsize=100_000)
def _name_kind(name: str) -> str:
    """``secret``, ``public`` or ``plain``: what a name says of its value, by its whole words."""
    name = name.translate(_FOLDED)
    words = [w.lower() for w in (*_NAME_PART.findall(name), *re.split(r"[^A-Za-z]+", name))]
    if _PUBLIC_WORDS.intersection(words) or _PUBLIC_NAME.search(name):
        return "public"
    return "secret" if any(_SECRET_WORD.fullmatch(w) for w in words) else "plain"


#: name <op> "value" in code, JSON, TOML and INI; a header set by index; a default after a lookup; a bare value in YAML and dotenv.
_STRING = r"""(?P<q>["'`])(?P<value>(?:[^"'`\\\n]|\\.){4,}?)(?P=q)"""
_LOOKUP = r"""(?:concat!\(\s*|[bruf]{1,2}(?=["'])|\(\s*|[\w.]+[(\[]\s*["'][\w.-]+["']\s*(?:,|[)\]]\s*(?:\|\||\?\?|\bor\b))\s*|[\w.]+\s*(?:\|\||\?\?|\bor\b)\s*)?"""
_QUOTED_ASSIGN = re.compile(rf"""(?P<name>["']?[A-Za-z_][\w.-]{{0,60}}["']?)(?:\])?\s*(?::[^=\n"']{{1,40}}(?==))?(?:=>|:=|=|:)\s*{_LOOKUP}{_STRING}""")
_PAIR = re.compile(rf"""[(\[{{]\s*["'](?P<name>[\w-]{{2,40}})["']\s*,\s*{_STRING}""")
_MORE = re.compile(r"""\s*[+,.]?\s*(["'`])((?:[^"'`\\\n]|\\.)+?)\1""")
_HEADER = re.compile(r"""(?i)["']?(?P<name>(?:x-)?[\w-]*(?:auth|token|key|secret)[\w-]*):[ ]*(?P<value>[^\s"'<>]{6,})(?=["'])""")
_BARE_ASSIGN = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?(?P<name>[A-Za-z_][\w.-]{1,60})[ \t]*(?:=|:[ \t])[ \t]*(?P<value>[^\s\"'`<>{}()\[\],;#|&][^\s\"'`<>{}()\[\],;]{3,})[ \t]*\r?$")
_BLOCK_ASSIGN = re.compile(r"^([ \t]*)(?P<name>[A-Za-z_][\w.-]{1,60}):[ \t]*[|>][+-]?[ \t]*\r?\n\1[ \t]+(?P<value>\S{6,})[ \t]*\r?$", re.M)
_CALL = re.compile(r"""(?i)(?:set_?auth|login|authenticate|with_?auth|basic_?auth|connect|set_?credentials?|set_?password|set_?token|with_?token|with_?password)\w*\s*\((?P<args>[^()\n]{4,}+)\)""")
#: A value that a comment or a sentence tells: after a colon, a slash or "with", or between backticks.
_TOLD = re.compile(r"""(?i)(?:log ?in|sign(?:ed)? in|token|password|passwd|secret|vault|credential|api key|auth)\b[^\n"'`=]{0,60}?(?::|/|with|is|`)\s*[`"']?(?P<value>[^\s`"'<>]{8,})[`"']?""")
_PROSE = re.compile(r"^\s*(?://|#|\*|--|;|/\*|[A-Z][a-z]+ )")
_ARGUMENT = re.compile(r"""(["'`])((?:[^"'`\\\n]|\\.){6,}?)\1""")
_FLAG = re.compile(r"""(?:(?:^|\s)(?:-p|--password|--token|--secret|--api-key)(?:[ =]))(?P<q>["']?)(?P<value>[^\s"']{6,})(?P=q)|(?:\s-u|--user)[ =]["']?[\w.-]+:(?P<q2>["']?)(?P<value2>[^\s"']{6,})(?P=q2)""")
_BEARER = re.compile(r"(?i)\b(?P<kind>bearer|basic|token)[ ]+(?P<value>[A-Za-z0-9+/=_.~-]{12,})")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@\"'<>$]*+:(?P<value>[^\s/@\"'<>]{3,}+)@[\w.\[-]")
_URL = re.compile(r"(?i)https?://[^\s\"'<>]{3}(?P<rest>[^\s\"'<>]*)")
_QUERY = re.compile(r"(?i)[?&](?:key|sig|signature|access_token|token|api_?key|secret|password|auth|code|client_secret)=(?P<value>[^\s&\"'<>]{6,})")
_HOOK = re.compile(r"https?://[\w.-]*hooks?[\w.-]*/[\w/-]*?/(?P<value>[A-Za-z0-9]{18,})")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<value>(?:(?!-----END)[\s\S])*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)")
#: Public prefixes of providers' tokens, and the shape of a signed web token.
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_])(?P<value>(?:AKIA|ASIA|AGPA|AROA|AIDA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[\w-]{10,}|xapp-\d-[\w-]{10,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9_])")
#: A short lower-case prefix, then a long random tail: tokens of providers nobody has listed.
_OWN_PREFIX = re.compile(r"(?<![\w/+.-])(?P<value>[a-z]{2,5}(?:_(?:live|test|prod|dev|stage))?[_-](?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{20,})(?![\w/+-])")

_REFERENCE = re.compile(r"\$\{|\$\(|(?:^|[:/@=\s])\$[A-Za-z_]|\{\{|%[A-Z_]+%|<[^>]*>|^vault:|^secret://|^arn:|^ref\+|^op://|^env[:.]|\bprocess\.env|os\.environ|getenv|^@|%s|%v|\{\w*\}")
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-+|_+|0{4,}|1234\w*|changeme|change[_-]?(?:it|me)\S*|replace\S*|insert\S*|todo\S*|fixme|your\S*|my[_-]?\S*|dummy\S*|sample\S*|example\S*|placeholder\S*|redacted|removed|hidden|none|null|nil|true|false|undefined|test\S{0,6}|fake\S*|fill\S*|n/?a|password\d{0,3}|secret|token|bearer|basic|standard|default)$|placeholder|redacted|your[_-]|example[_-]?key|<.*>")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+[-:]|md5[-:]|ssh-(?:rsa|ed25519|dss)\b|ecdsa-|data:|urn:|-----BEGIN (?:PUBLIC|CERT))")
_WORDY = re.compile(r"^[A-Za-z]+(?:[ _./:#-][A-Za-z]+)*$")
#: What the rules of ``_in_line`` ask of a line, in small letters: each alternative of each rule holds one of these, or
#: ``_LONG_TAIL``.  Asked after the score and before the rules.
_HINT = re.compile(
    "|".join(
        map(
            re.escape,
            (
                "pass", "pw", "secret", "token", "key", "auth", "bearer", "basic ", "credential", "cookie", "webhook", "salt", "hmac", "jwt", "smtp", "admin", "login", "log in", "sign in", "signed in", "vault", "://", "pat",
                "akia", "asia", "agpa", "aroa", "aida", "eyj", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_", "rk_", "pk_", "xox", "xapp-", "aiza", "npm_", "sg.", "hf_", "connect", "-u ", "-u=", "-p ", "-p=", "--",
            ),
        )
    )
)
_LONG_TAIL = re.compile(r"[_-][a-z0-9]{20}")
def _hinted(part: str) -> bool:
    low = part.lower()
    if not low.isascii():
        low = low.translate(_FOLDED)
    return bool(_HINT.search(low) or _LONG_TAIL.search(low))


@cache
def tokenizer(path: str | None = None):
    """tiktoken's encoding over a public vocabulary file; ``path`` is the directory of the files or None for the installed one."""
    import base64
    import os

    import tiktoken

    if path is None:
        import public_tokenizers

        path, pattern = os.path.dirname(public_tokenizers.__file__), public_tokenizers.PATTERN
    else:
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(os.path.join(path, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chars_per_subword(text: str, tokenizers: str | None = None) -> float:
    return len(text) / max(1, len(tokenizer(tokenizers).encode_ordinary(text)))


#: Scores of strings, remembered by a task.
REMEMBERED = 500_000


class Scorer:
    """Characters per subword of strings; keeps those it has seen."""

    def __init__(self, tokenizers: str | None = None):
        self.encode, self.seen = tokenizer(tokenizers).encode_ordinary, {}

    def score(self, s: str) -> float:
        found = self.seen.get(s)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[s] = len(s) / max(1, len(self.encode(s)))
        return found

    def suspects(self, text: str) -> dict[int, bool]:
        """The starts of the lines that hold an unnatural string, and whether one of them is a random one."""
        lines: dict[int, bool] = {}
        for s in set(_STRINGS.findall(text)):
            score = self.seen.get(s) or self.score(s)
            if score >= SUSPECT or s.isdigit():
                continue
            at = text.find(s)
            while at >= 0:
                line = text.rfind("\n", 0, at) + 1
                lines[line] = lines.get(line, False) or score < RANDOM and len(s) >= LONG
                end = text.find("\n", at)
                at = text.find(s, end) if end >= 0 else -1
        return lines

    def suspect(self, value: str) -> bool:
        """Whether a value holds an unnatural string, or is one as a whole."""
        return any(self.score(s) < SUSPECT for s in _STRINGS.findall(value)) or len(value) >= 6 and self.score(value) < SUSPECT

    def unnatural(self, value: str) -> bool:
        return len(value) >= 8 and self.score(value) < UNNATURAL


def _stands_for_value(v: str) -> bool:
    return bool(_REFERENCE.search(v) or _PLACEHOLDER.search(v) or _DIGEST.match(v) or len(set(v)) < 4)


def _secret_value(v: str, scorer: Scorer) -> bool:
    """Whether a value under a secret's name is one."""
    if len(v) < 6 or " " in v or not scorer.suspect(v) or _stands_for_value(v) or v.isdigit() or _UUID.match(v):
        return False
    if "://" in v:
        return False  # the URL rules judge it
    digit, upper, lower = any(map(str.isdigit, v)), any(map(str.isupper, v)), any(map(str.islower, v))
    symbol = any(not c.isalnum() for c in v)
    if re.fullmatch(r"[0-9a-fA-F]{16,}", v):
        return True
    if scorer.unnatural(v) and (digit + upper + lower >= 2):
        return True
    # a password made of words: letters with a digit, and another class besides
    return len(v) >= 8 and digit and (upper + lower + symbol >= 2) and not re.search(r"[()\[\]{}=,;]|\.(?:go|py|js|ts|rs|json|ya?ml|txt|md)$", v) and "/" not in v


def _random_value(v: str, scorer: Scorer) -> bool:
    """Whether a value is random enough to be a credential whatever its name: three classes of characters, no digest, no path."""
    if len(v) < LONG or not _RANDOM_FORM.fullmatch(v) or scorer.score(v) >= RANDOM or _stands_for_value(v) or _UUID.match(v):
        return False
    return any(map(str.isdigit, v)) and any(map(str.isupper, v)) and any(map(str.islower, v))


_RANDOM_FORM = re.compile(r"[A-Za-z0-9_~.!@#$%^&*+-]+")
_NAMED = re.compile(r"""([A-Za-z_][\w.-]*)["']?\]?\s*(?:=>|:=|=|:)\s*$""")


def _in_line(text: str, line: int, end: int, scorer: Scorer, found: list) -> None:
    part = text[line:end]

    def add(m, group, rule):
        found.append((line + m.start(group), line + m.end(group), rule))

    for m in _PREFIXED.finditer(part):
        if scorer.suspect(m["value"]) and not _PLACEHOLDER.search(m["value"]) and "EXAMPLE" not in m["value"]:
            add(m, "value", "provider_token")
    for m in _OWN_PREFIX.finditer(part):
        if scorer.unnatural(m["value"]) and not _DIGEST.match(m["value"]):
            add(m, "value", "prefixed_token")
    if "://" in part:
        for m in _USERINFO.finditer(part):
            if scorer.suspect(m["value"]) and not _stands_for_value(m["value"]):
                add(m, "value", "url_password")
        for url in _URL.finditer(part):
            for m in _QUERY.finditer(part, *url.span("rest")):
                if not _stands_for_value(m["value"]) and scorer.unnatural(m["value"]):
                    add(m, "value", "url_key")
        for m in _HOOK.finditer(part):
            if scorer.unnatural(m["value"]):
                add(m, "value", "webhook")
    for m in _BEARER.finditer(part):
        v = m["value"]
        if not _stands_for_value(v) and scorer.unnatural(v) and any(map(str.isalpha, v)) and (any(map(str.isdigit, v)) or len(v) > 24):
            add(m, "value", "header")
    for rx in (_QUOTED_ASSIGN, _PAIR):
        for m in rx.finditer(part):
            head = part[m.start("name") : m.start("q")]
            kinds = {_name_kind(w) for w in re.findall(r"[A-Za-z_][\w-]*", head)}
            if "secret" not in kinds or _name_kind(m["name"]) == "public":
                continue
            pieces, at = [m.span("value")], m.end()
            while rx is _QUOTED_ASSIGN and (more := _MORE.match(part, at)) and not re.match(r"\s*[=:]", part[more.end() :]) and "," not in part[at : more.start(1)].replace(",", "", "concat!" in head):
                pieces.append(more.span(2))
                at = more.end()
            if _secret_value("".join(part[a:b] for a, b in pieces), scorer):
                found += [(line + a, line + b, "named_value" if not k else "continued") for k, (a, b) in enumerate(pieces)]
    for m in _HEADER.finditer(part):
        if _name_kind(m["name"]) != "public" and _secret_value(m["value"], scorer):
            add(m, "value", "header")
    if (m := _BARE_ASSIGN.match(part)) and _name_kind(m["name"]) == "secret" and _secret_value(m["value"], scorer):
        add(m, "value", "named_value")
    for m in _CALL.finditer(part):
        for a in _ARGUMENT.finditer(part, m.start("args"), m.end("args")):
            if _secret_value(a[2], scorer):
                found.append((line + a.start(2), line + a.end(2), "argument"))
    for m in _FLAG.finditer(part):
        g = "value" if m["value"] else "value2"
        if _secret_value(m[g], scorer):
            add(m, g, "argument")
    if _PROSE.match(part):
        for m in _TOLD.finditer(part):
            v = m["value"]
            if _secret_value(v, scorer) and any(map(str.isalpha, v)) and any(map(str.isdigit, v)) and not _DIGEST.match(v):
                add(m, "value", "told")


def _random_in_line(text: str, line: int, end: int, scorer: Scorer, found: list) -> None:
    part = text[line:end]
    strings = list(_ARGUMENT.finditer(part))
    for m in strings:
        # several random strings on a line are data
        if _random_value(m[2], scorer) and sum(_random_value(x[2], scorer) for x in strings) == 1:
            name = _NAMED.search(part, 0, m.start())
            if not name or _name_kind(name[1]) != "public":
                found.append((line + m.start(2), line + m.end(2), "random"))


def find(text: str, tokenizers: str | None = None, scorer: Scorer | None = None) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each credential value, without overlaps, in order; the pieces of a value that is put
    together from several strings after the first have the rule ``continued``."""
    if not text:
        return []
    scorer = scorer or Scorer(tokenizers)
    lines = scorer.suspects(text)
    if not lines:
        return []
    found: list[tuple[int, int, str]] = []
    if "PRIVATE KEY" in text:
        for m in _KEY_BLOCK.finditer(text):
            if len(m["value"]) > 40 and scorer.suspect(m["value"]) and not _REFERENCE.search(m["value"][:80]):
                found.append((m.start(), m.end(), "private_key"))
    for m in _BLOCK_ASSIGN.finditer(text) if ": |" in text or ": >" in text else ():
        if _name_kind(m["name"]) == "secret" and _secret_value(m["value"], scorer):
            found.append((*m.span("value"), "named_value"))
    for line, random in sorted(lines.items()):
        end = text.find("\n", line)
        end = len(text) if end < 0 else end
        if _hinted(text[line:end]):
            _in_line(text, line, end, scorer, found)
        if random:
            _random_in_line(text, line, end, scorer, found)
    found.sort(key=lambda x: (x[0], -x[1], x[2] == "random"))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if out and x[0] < out[-1][1]:
            continue
        out.append(x)
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span masked; length, line ends and escapes stay."""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at:a])
        out.append(re.sub(r"\\.|\s|(.)", lambda m: MASK if m[1] else m[0], text[a:b], flags=re.S))
        at = b
    return "".join(out) + text[at:]


FOUND = "file_id bigint, line_no int, start bigint, end bigint, rule string"


def secrets(files: DataFrame, key: str = "file_id", tokenizers: str | None = None) -> DataFrame:
    """One row per credential of each row of ``files`` (key, content): its line, offsets in code points, and the rule.

    Null or empty content gives no row; repeated rows give repeated rows; further columns are ignored.
    """
    kind = dict(files.dtypes)[key]

    def make():
        scorer = Scorer(tokenizers)

        def row(k, text):
            for a, b, rule in find(text, tokenizers, scorer):
                yield k, text.count("\n", 0, a) + 1, a, b, rule

        return row

    return map_rows(files.where(F.col("content").isNotNull()), [key, "content"], FOUND.replace("file_id bigint", f"`{key}` {kind}"), make)


def secrets_found(files: DataFrame, tokenizers: str | None = None) -> DataFrame:
    return secrets(files, tokenizers=tokenizers).where("rule <> 'continued'").select("file_id", "line_no").distinct()


def redacted(table: DataFrame, key: str, tokenizers: str | None = None) -> DataFrame:
    """(key, credentials, content): the rows that hold a credential, with each masked in place."""
    kind = dict(table.dtypes)[key]

    def make():
        scorer = Scorer(tokenizers)

        def row(k, text):
            if spans := find(text, tokenizers, scorer):
                yield k, len(spans), redact(text, spans)

        return row

    return map_rows(table.where(F.col("content").isNotNull()), [key, "content"], f"`{key}` {kind}, credentials int, content string", make)
