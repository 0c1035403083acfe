"""Problem 4: personal information in chat turns and notes.

Regular expressions propose spans, checksums (Luhn, mod 97, EAN-13) confirm numbers that carry one, and words near a
span raise or lower its score; a span is taken from ``ENOUGH`` on.  Found values become placeholders of their type.

What is no name is not listed but counted: a word that the corpus mostly writes in small letters is no part of one.
The counters (``Case``) have a fixed size.  Names whose surroundings say too little, and names in small letters, are
confirmed by the given names and surnames of names that are sure: a join.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .common import map_rows

#: Score from which a span counts.
ENOUGH = 0.5
#: Sure names in which a given name or surname must be seen to confirm one that is not.
LEAST_SEEN = 2
#: Counters of words per hash, and hashes; of a word the least counter is read, so that a clash can only add.
COUNTERS, HASHES, KINDS = 1 << 19, 2, 3
#: A word belongs to names if, for each time it is seen inside a sentence with a capital, it is seen at most this often in
#: small letters, and opens a sentence at most so often.
SMALL_SHARE, OPEN_SHARE = 2.0, 8.0
#: Characters before and after a span in which words are looked for.
BEFORE, NEAR, AFTER = 40, 20, 60
TYPES = ("email", "phone", "id_number", "address", "name")

#: Mailbox names of roles and services (RFC 2142 and common usage).
_ROLES = set(
    "abuse accounts admin administrator alerts all api billing bot build careers ci compliance contact contacts data deploy desk dev devnull "
    "devops do-not-reply donotreply enquiries feedback finance ftp git help helpdesk hello hg hostmaster hr info it jenkins jobs legal list lists "
    "mail mailer mailer-daemon marketing media monitor monitoring network news newsletter nobody no-reply noc noreply notifications office ops "
    "orders postmaster press privacy registry release releases reply robot root sales security service services staff status subscribe support "
    "svc sysadmin system team tech test uucp user users usenet webmaster www".split()
)
_EMAIL = re.compile(r"(?<![\w.+%/:@-])(?:(?<=mailto:)|)[\w.+%'-]*[\w+%]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@-])")
_MAILTO = re.compile(r"(?i)(?<=mailto:)[\w.+%'-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}")
_DOT = r"(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?|[ ]dot[ ])"
_SPELLED = re.compile(rf"(?i)(?<![\w.@])[\w.+-]*[\w+](?:[ ]?(?:\(at\)|\[at\]|\{{at\}}|<at>)[ ]?[\w-]+(?:(?:{_DOT}|\.)[\w-]+)+|[ ]at[ ][\w-]+(?:{_DOT}[\w-]+)+)(?![\w@])")

_PHONE = re.compile(
    r"""(?<![\w.+/-])(?<!\d[ ])(?:
        \+\d{1,3}(?:[ .-]?\(0?\d{1,4}\))?(?:[ ./-]?\d){6,13}
      | 00\d{2,3}(?:[ ./-]?\d){7,12}
      | \(0?\d{2,5}\)[ ]?\d{3}(?:[ -]?\d){3,6}
      | [2-9]\d{2}[-.][2-9]\d{2}[-.]\d{4}
      | 0\d(?:[ .-]\d{2}){4}
      | 0\d{2,5}[ /-]\d{3,8}(?:[ -]\d{2,5})?
      | 0\d{9,10}
      | [2-9]\d{2}-\d{4}
    )(?![\w/-]|\.\d|:\d)""",
    re.X,
)
_PHONE_WORDS = re.compile(r"(?i)\b(?:call(?: me| us| him| her| them)?(?: on| at)?|phone|tel|telephone|mobile|cell|fax|reach(?: \w+)? at|ring|dial|voicemail|on-call|pager?s?|sms|text me|whatsapp|hotline|number is|left)\b|>,\s*$")
_NUMBER_WORDS = re.compile(r"(?i)\b(?:ticket|order|part|code|build|port|version|isbn\S*|issn|serial|commit|revision|line|retry|item|sku|invoice|ref(?:erence)?|id|key|block|page|hash|ip|running|row|offset|batch)\b[ \t]*[#:=]?[ \t]*$")

_ID_LABEL = re.compile(
    r"(?<!\w)(?:social[ -]security(?: (?:number|no\.?|num))?|ssn|itin|national id(?:entity)?(?: (?:number|no\.?|card))?|national insurance(?: (?:number|no\.?))?|nino"
    r"|(?:id|identity) card(?: (?:number|no\.?))?|identity (?:number|no\.?)|passport(?: (?:number|no\.?))?|reisepass(?:nummer)?|personalausweis(?:nummer)?|ausweis(?:nummer)?"
    r"|driv(?:er'?s?|er’s|ing) licen[cs]e(?: (?:number|no\.?))?|f(?:ü|ue)hrerschein(?:nummer)?|personal (?:number|no\.?)|personnummer|tax (?:id|number|identification number)|steuer-?id(?:nummer)?"
    r"|ni (?:number|no\.?)|tin|ahv(?:-?(?:nr\.?|nummer))?|avs|pesel|dni|nie|nif|cpf|bsn|insee|codice fiscale|aadhaar|medicare(?: number)?|iban|(?:credit |debit )?card number)(?!\w)"
)
_ID_VALUE = re.compile(r"[ \t:=#(\"'\[-]{0,6}(?:(?:is|was|nr\.?|no\.?)[ \t:=]{0,3})?(?P<value>[A-Z]{2}(?:[ -]?\d{2}){3}[ -]?[A-D](?!\w)|(?:[A-Z]{0,3}[ -]?)?\d[\dA-Z]*(?:[ ./-]?\d[\dA-Z]*)*(?!\w))")
_AHV = re.compile(r"(?<![\w.])756\.\d{4}\.\d{4}\.\d{2}(?!\w|\.\d)")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]|\.\d)")

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶĹĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΩЁІЇЄА-Я"
_PLACE = rf"[{_UP}][\w]*\.?(?:['’-][\w]+)*"
_HOUSE = r"\d{1,4}(?:[ ]?[A-Za-z](?![\w]))?"
#: Words for streets in the corpus' languages.
_ADDRESS = re.compile(
    rf"""(?<![\w.,/-])(?:
        {_HOUSE}[ ](?:(?:North|South|East|West|Old|New|Upper|Lower)[ ])?(?:{_PLACE}[ ]){{1,3}}(?:(?:Street|Road|Lane|Avenue|Close|Boulevard|Drive|Court|Way|Place|Square|Terrace|Crescent|Hill|Row|Walk|Gardens|Mews|Parade|Rd|Ln|Dr|Ct|Pl|Sq)(?!\w)|(?:Blvd|Ave|St)(?!\w)\.?)
      | \d{{1,4}}(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours)[ ](?:(?:du|de[ ]la|des|de|de[ ]l['’]|d['’]|la|le)[ ]?)?{_PLACE}(?:[ ](?:(?:du|de[ ]la|des|de|et)[ ])?{_PLACE}){{0,3}}
      | (?:Via|Viale|Corso|Piazza|Largo|Vicolo|Calle|Avenida|Plaza|Paseo|Camino|Rua|Travessa|Praça)[ ](?:(?:dei|degli|delle|del|della|dello|di|de[ ]la|de[ ]los|de|do|da|dos|das|la|el)[ ])?{_PLACE}(?:[ ]{_PLACE}){{0,3}},?[ ]{_HOUSE}
      | (?:ul|al|pl|os)\.[ ]{_PLACE}(?:[ ]{_PLACE}){{0,3}}[ ]\d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})?
      | (?:ул\.|улица|просп\.|пр\.|пер\.)[ ]{_PLACE}(?:[ ]{_PLACE}){{0,2}},?[ ](?:д\.[ ]?)?{_HOUSE}
      | [{_UP}]\w*(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ring|ufer|steig|straat|laan|gatan|vägen|gade|vej|veien)[ ]{_HOUSE}
      | (?:Am|An[ ]der|An[ ]den|Im|In[ ]der|Zum|Zur|Auf[ ]der|Unter[ ]den)[ ](?:[{_UP}]\w+[ ]){{1,3}}{_HOUSE}
    )(?![\w/])""",
    re.X,
)

_TITLE = r"(?:Dr|Mr|Mrs|Ms|Mx|Prof|Professor|Herr|Frau|Mme|M|Sr|Sra|Sir|Dame)\.?"
_PARTICLE = r"(?:van|der|den|von|zu|de|da|do|del|della|di|dos|la|le|bin|ibn|al|el|ter|ten|af)"
_TOKEN = rf"(?:[dDlL]['’])?[{_UP}](?:[\w]|['’](?!s(?!\w))|-(?=\w))*"
_NAME = re.compile(rf"(?<![\w.@/<-]){_TOKEN}(?:[ ](?:[{_UP}]\.|{_PARTICLE}|{_TOKEN})){{0,3}}[ ]{_TOKEN}(?![\w@])|(?<![\w.@/<-]){_TOKEN},[ ]{_TOKEN}(?![\w@])")
_LABEL = r"(?:name|author|reviewer|owner|assignee|contact|maintainer|customer|client|patient|employee|manager|sender|recipient|signed-off-by|co-authored-by|reported-by|reviewed-by|attn|from|to|cc)"
#: General words that stand before a person's name, and after it.
_SURE_BEFORE = re.compile(rf"(?i)(?:\b{_LABEL}\s*[:=]\s*[\"']?|\b(?:todo|fixme|xxx|hack)\(|\b{_TITLE}\s+)$")
_BEFORE = re.compile(
    r"(?i)(?:\b(?:with|to|from|by|for|via|and|or|cc|than|thanks|hi|hello|dear|hey|regards|sincerely|cheers|signed|is|was|that|where|when|because|if|whether|says?|said"
    r"|ask(?:ed|s)?|tell|told|tells|met|meet|meets|call(?:ed|s)?|email(?:ed|s)?|ping(?:ed)?|thank(?:ed)?|invite[ds]?|contact(?:ed)?|hire[ds]?|join(?:ed)?|see|saw|help(?:ed)?|visit(?:ed)?|know|knows|knew|remind(?:ed)?|notif(?:y|ied)|pay|paid"
    r"|colleague|friend|boss|manager|engineer|developer|designer|doctor|nurse|patient|teacher|student|lawyer|client|customer|tenant|applicant|candidate|author|owner|reviewer|user|employee|mother|father|brother|sister|wife|husband|partner|son|daughter)(?:[,:]|\s*[-–—])?\s+[\"'(]?"
    r"|[\n(\"'>:;]\s*)$"
)
_SURE_AFTER = re.compile(r"^(?:\s*<[^<>\n]*(?:@|\sat\s|\[at\]|\(at\))|['’]s(?!\w))")
_AFTER = re.compile(r"^(?:\s+(?:is|was|has|had|will|would|can|could|should|may|might|must|did|does|and|who|whose|said|says|wrote|writes|met|left|told|thinks|works|lives|owns|runs|[a-z]{3,}ed)\b|\s*,\s*(?:born|aged|who|her|his|their|the)\b|\s*[-–—(<]|\s*$|\s*[\n])")
#: What comes before names of places and numbered things.
_PLACE_BEFORE = re.compile(r"(?i)(?:\b(?:the|in|at|near|of|into|around|between|city|port|street|town)\s+|\d[,.]?\s*)$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Words that are counted: none of an address, a path, a number or an identifier.
_COUNTED = re.compile(r"(?<![\w@.+/<=-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@]|[.+/-]\w|=)")


class Case:
    """How often the corpus writes a word in small letters, inside a sentence with a capital, and at a sentence's or line's beginning with one."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.seen = counts, {}

    @staticmethod
    def empty() -> Case:
        return Case(np.zeros((KINDS, HASHES, COUNTERS), dtype=np.int32))

    @staticmethod
    def places(word: str) -> list[int]:
        h = xxhash.xxh64_intdigest(word)
        return [(h >> (32 * i)) % COUNTERS for i in range(HASHES)]

    def get(self, word: str) -> tuple[int, int, int]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            at = self.places(word.lower())
            found = self.seen[word] = tuple(min(int(self.counts[k, i, p]) for i, p in enumerate(at)) for k in range(KINDS))
        return found

    def proper(self, word: str) -> bool:
        """Whether a word may be part of a name: one that is mostly written with a capital, or that nobody writes small."""
        small, inside, opening = self.get(word)
        return small <= max(1, SMALL_SHARE * inside) and opening <= OPEN_SHARE * max(1, inside)

    def known(self, word: str) -> bool:
        """Whether a word in small letters is mostly written with a capital elsewhere."""
        return self.get(word)[1] >= LEAST_SEEN and self.proper(word)


def words_seen(text: str) -> tuple[list[str], list[str], list[str]]:
    """The words of a text in small letters; those with a capital inside a sentence; those with one that open a sentence or line."""
    small, inside, opening = [], [], []
    for m in _COUNTED.finditer(text):
        w, at = m[0], m.start()
        if w.islower():
            small.append(w)
        elif w[0].isupper() and not w.isupper():
            before = text[max(0, at - 2) : at]
            (inside if len(before) == 2 and before[1] == " " and before[0] not in ".!?:\n\"'(>#*=-" else opening).append(w.lower())
    return small, inside, opening


def case_counts(records: DataFrame) -> Case:
    """The counters over all records; what reaches the driver is their fixed size at most."""
    import pyarrow as pa

    def run(batches):
        counts = [Counter() for _ in range(KINDS)]
        for b in batches:
            for text in b.column(0).to_pylist():
                for k, words in enumerate(words_seen(text)):
                    counts[k].update(words)
        out: Counter[int] = Counter()
        for k in range(KINDS):
            for w, n in counts[k].items():
                for i, p in enumerate(Case.places(w)):
                    out[(k * HASHES + i) * COUNTERS + p] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], names=["at", "n"])

    rows = records.select("content").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(KINDS * HASHES * COUNTERS, dtype=np.int32)
    counts[rows["at"].to_numpy(dtype=np.int64)] = np.minimum(rows["n"].to_numpy(dtype=np.int64), 2**31 - 1)
    return Case(counts.reshape(KINDS, HASHES, COUNTERS))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ean13(digits: str) -> bool:
    return len(digits) == 13 and sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(digits)) % 10 == 0


def _emails(text):
    if "@" in text:
        for rx in (_EMAIL, _MAILTO):
            for m in rx.finditer(text):
                local, _, host = m[0].strip("'").partition("@")
                start = m.start() + len(m[0]) - len(m[0].lstrip("'"))
                if re.split(r"[+]", local.lower())[0] in _ROLES or text[m.end() : m.end() + 2].startswith(":") and not text[m.end() + 1 : m.end() + 2].isspace():
                    continue
                yield start, start + len(local) + 1 + len(host), "email", 0.9
    if " at " in text or "[at]" in text or "(at)" in text or " AT " in text:
        for m in _SPELLED.finditer(text):
            if re.split(r"[+.]", m[0].lower())[0].split()[0] not in _ROLES:
                yield m.start(), m.end(), "email", 0.7


def _phones(text):
    for m in _PHONE.finditer(text):
        v = m[0]
        digits = re.sub(r"\D", "", v)
        before = text[max(0, m.start() - BEFORE) : m.start()]
        if not 7 <= len(digits) <= 15:
            continue
        score = 0.6 if v[0] in "+(" or v[:2] == "00" or len(digits) >= 9 else 0.3
        if _PHONE_WORDS.search(before):
            score += 0.3
        if _NUMBER_WORDS.search(before) and not re.search(r"(?i)(?:phone|tel)\w*[ \t]*[#:=]?[ \t]*$", before):
            score -= 0.5
        yield m.start(), m.end(), "phone", score


_SIX_DIGITS = re.compile(r"(?:\D*\d){6}")


def _ids(text):
    # no kind of number has fewer than six digits
    if not _SIX_DIGITS.match(text):
        return
    low = text.lower()
    for m in _ID_LABEL.finditer(low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)):
        v = _ID_VALUE.match(text, m.end())
        if v:
            value = v["value"].rstrip(" ./-")
            if sum(map(str.isdigit, value)) >= 6:
                yield v.start("value"), v.start("value") + len(value), "id_number", 0.8
    for m in _AHV.finditer(text):
        if ean13(m[0].replace(".", "")):
            yield m.start(), m.end(), "id_number", 0.9
    for rx, valid in ((_IBAN, mod97), (_CARD, lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s)))):
        for m in rx.finditer(text):
            if valid(m[0]) and not _NUMBER_WORDS.search(text[max(0, m.start() - NEAR) : m.start()]):
                yield m.start(), m.end(), "id_number", 0.8
    for m in _SSN.finditer(text):
        if re.search(r"(?i)\b(?:ssn|social|security|tax|identity)\b", text[max(0, m.start() - BEFORE) : m.start()]):
            yield m.start(), m.end(), "id_number", 0.7


def _addresses(text):
    for m in _ADDRESS.finditer(text):
        yield m.start(), m.end(), "address", 0.8


def _names(text, case):
    at = 0
    while m := _NAME.search(text, at):
        at = m.end()
        if "," in m[0] and not case.proper(m[0].partition(",")[0]):
            # no surname before the comma: the name may begin after it
            at = m.start() + m[0].index(",")
            continue
        # words that the corpus writes small open a sentence or end the name
        run: list[tuple[int, int, str]] = []
        runs = [run]
        listed = "," in m[0]
        for w in _NAME_WORD.finditer(m[0]):
            word = w[0]
            bare = word.rstrip(".")
            if run and (len(bare) < 2 or word.islower()) or len(bare) > 1 and not _TITLES.fullmatch(word) and case.proper(bare):
                run.append((m.start() + w.start(), m.start() + w.end(), word))
            elif run:
                run = []
                runs.append(run)
        for run in runs:
            while run and (len(run[-1][2].rstrip(".")) < 2 or run[-1][2].islower()):
                run.pop()
            if len(run) < 2 or listed and len(runs) > 1:
                continue
            a, b = run[0][0], run[-1][1]
            before, after = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
            # two words that are names and stand as one need little more; what follows "the" or "in" is no person
            score = 0.3 + 0.5 * bool(_SURE_BEFORE.search(before)) + 0.4 * bool(_SURE_AFTER.match(after)) + 0.25 * bool(_BEFORE.search(before) or a == 0) + 0.25 * bool(_AFTER.match(after)) - 0.4 * bool(_PLACE_BEFORE.search(before))
            yield a, b, "name", score


_NAME_WORD = re.compile(r"[^\s,]+")
_TITLES = re.compile(_TITLE)


def _free(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The spans without those that overlap a better scored, then longer, then earlier one; in order."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for x in sorted(spans, key=lambda x: (-x[3], x[0] - x[1], x[0])):
        # what was kept is disjoint, so only the neighbours can overlap
        at = bisect_right(starts, x[0])
        if (at and ends[at - 1] > x[0]) or (at < len(starts) and starts[at] < x[1]):
            continue
        starts.insert(at, x[0])
        ends.insert(at, x[1])
        kept.append(x)
    return sorted(kept)


def find(text: str | None, case: Case | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) of each span, without overlaps, in order.  Of spans that overlap the better scored, then the longer one stays.

    Names may score less than ``ENOUGH``: they are to be confirmed.
    """
    if not text:
        return []
    case = case or Case.empty()
    spans = [x for f in (_emails, _phones, _ids, _addresses) for x in f(text) if x[3] >= ENOUGH]
    return _free([*spans, *_names(text, case)])


def find_lower(text: str | None, taken: list[tuple[int, int, str, float]], case: Case) -> list[tuple[int, int]]:
    """(start, end) of two words in small letters, an initial between them or not, that are written with capitals elsewhere; to be confirmed."""
    out: list[tuple[int, int]] = []
    if not text or not any(case.known(w) for w in set(_WORD.findall(text)) if w.islower()):
        return out
    starts = [x[0] for x in taken]
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    n = 0
    while n + 1 < len(words):
        last = n + 1
        if len(words[last][2]) == 1 and last + 1 < len(words) and text[words[last][1] : words[last + 1][0]] == ". ":
            last += 1
        (a, end, first), (begin, b, family) = words[n], words[last]
        between = text[end:begin]
        if first.islower() and family.islower() and (between == " " or last > n + 1 and between[:1] == " ") and case.known(first) and case.known(family):
            at = bisect_right(starts, a)
            if not (at and taken[at - 1][1] > a) and not (at < len(starts) and starts[at] < b):
                out.append((a, b))
            n = last
        n += 1
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def records(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """Turns and notes as one table (record_kind, record_id, content); rows without text are left out."""
    t = turns.select(F.lit("turn").alias("record_kind"), F.col("turn_id").alias("record_id"), "content")
    n = notes.select(F.lit("note").alias("record_kind"), F.col("note_id").alias("record_id"), "content")
    return t.unionByName(n).where(F.length("content") > 0)


SPANS = "record_kind string, record_id bigint, start int, `end` int, pii_type string, value string, given string, family string, sure boolean"


def _parts(name: str) -> tuple[str, str]:
    """(given name, surname) in small letters."""
    words = name.lower().split(", ")[::-1] if ", " in name else name.lower().split(" ")
    return words[0], words[-1]


def spans(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per span of a delivered record: offsets in code points, type, value.

    A name that its surroundings do not make sure, or that is written in small letters, is kept if its given name and its
    surname are those of at least ``LEAST_SEEN`` sure names each, somewhere in the corpus (a join, so no list of names is held).
    """
    given = records(turns, notes)
    shared = turns.sparkSession.sparkContext.broadcast(case_counts(given).counts)

    def make():
        case = Case(shared.value)

        def row(kind, key, text):
            found = find(text, case)
            for a, b, t, score in found:
                yield kind, key, a, b, t, text[a:b], *(_parts(text[a:b]) if t == "name" else (None, None)), score >= ENOUGH
            for a, b in find_lower(text, found, case):
                yield kind, key, a, b, "name", text[a:b], *_parts(text[a:b]), False

        return row

    # the spans are used several times: they are written once
    every = shared_checkpoint(turns.sparkSession, map_rows(given, ["record_kind", "record_id", "content"], SPANS, make))
    sure, open_ = every.where("sure"), every.where("not sure")
    for part in ("given", "family"):
        seen = sure.where(F.col(part).isNotNull()).groupBy(part).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN).select(part)
        open_ = open_.join(seen, part, "left_semi").select(*every.columns)
    return sure.unionByName(open_)


def pii_found(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per distinct value of a type in a record.  Re-sent records count once; a null or empty text gives none."""
    return spans(turns, notes).select("record_kind", "record_id", "pii_type", "value").distinct()


def pii_redacted(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """(record_kind, record_id, spans, content): the records that hold a span, with placeholders in place of the values.

    A re-sent record comes out once.  Spans are grouped by record, which its own text bounds.
    """
    by_record = spans(turns, notes).groupBy("record_kind", "record_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "pii_type"))).alias("found"))
    texts = records(turns, notes).groupBy("record_kind", "record_id").agg(F.min("content").alias("content"))

    def make():
        def row(kind, key, text, found):
            kept: list[tuple[int, int, str]] = []
            for x in found:
                if not kept or x["start"] >= kept[-1][1]:
                    kept.append((x["start"], x["end"], x["pii_type"]))
            yield kind, key, len(kept), redact(text, kept)

        return row

    return map_rows(texts.join(by_record, ["record_kind", "record_id"]), ["record_kind", "record_id", "content", "found"], "record_kind string, record_id bigint, spans int, content string", make)
