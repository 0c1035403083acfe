"""Problem 9: text that was decoded with the wrong character encoding.

The work is by *units* (sentences and lines).  Units are joined on their skeleton, the unit without its non-ASCII
characters; the commonest unit of a skeleton is the clean twin of the others.  Aligning the characters of a pair
between the ASCII characters that both share gives runs, clean and garbled, and a transformation (true encoding, wrong
encoding) is learned where it turns every clean run of enough pairs into the garbled one.  Only learned transformations
are undone on the remaining units, and a change is taken where it makes the unit's character pairs commoner in the
corpus; where no twin teaches anything, nothing is restored.  U+FFFD, which a decoder itself leaves for what it lost,
needs no twin to be seen.

Character pairs are counted over all documents into a table of fixed size (``BUCKETS``), and there are at most
``len(CHAINS)`` transformations: nothing that reaches the driver grows with the data.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .common import map_rows

#: Size of the table of character pairs.
BUCKETS = 1 << 18
#: Frequency below which a character pair counts as unseen.
RARE = 1e-4
#: Nats that undoing a learned transformation must gain.
GAIN = 3.0
#: Share of a unit's non-ASCII characters inside quotes from which it only quotes garbled text.
QUOTED_SHARE = 0.8
#: Letters a skeleton must have to tell twins by itself, and letters and digits the whole text's must have for those of its units that do not.
LEAST_SKELETON, LEAST_CONTEXT = 12, 6
_ENOUGH, _CONTEXT = re.compile(rf"(?:[^A-Za-z]*[A-Za-z]){{{LEAST_SKELETON}}}"), re.compile(rf"(?:[^A-Za-z0-9]*[A-Za-z0-9]){{{LEAST_CONTEXT}}}")
#: Pairs that must support a transformation, and distinct garbled characters that they must hold.
LEAST_PAIRS, LEAST_CHARS = 3, 2
#: Parts into which the units of one skeleton are split.
SALT = 16

#: Python's names of the encodings that files of the corpus' languages are commonly written or read in.
SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "iso8859-15", "iso8859-5")
MULTI = ("gb18030", "shift_jis", "euc_jp", "big5")
CHAINS: tuple[tuple[str, ...], ...] = (
    *(("utf-8", wrong) for wrong in (*SINGLE, "gb18030", "shift_jis")),
    *(("utf-8", first, "utf-8", second) for first in ("cp1252", "latin-1") for second in ("cp1252", "latin-1")),
    *((true, wrong) for true in SINGLE for wrong in SINGLE if true != wrong and {true, wrong} != {"latin-1", "cp1252"}),
    *((true, wrong) for true in MULTI for wrong in ("latin-1", "cp1252", "cp1251", "koi8-r")),
)

#: Chains that turn every run of non-ASCII characters by itself, and those whose bytes may take in the ASCII character after it.
BY_RUN = tuple(i for i, chain in enumerate(CHAINS) if chain[0] not in MULTI)
BY_STRETCH = tuple(i for i, chain in enumerate(CHAINS) if chain[0] in MULTI)
#: Pieces of units whose gains a task remembers, and characters a remembered piece may have; the same for the run pairs whose chains it remembers.
REMEMBERED, REMEMBERED_CHARS = 20_000, 16
REMEMBERED_RUNS, REMEMBERED_RUN_CHARS = 20_000, 64

_SPLIT = re.compile(r"[^\n][^\n.!?。！？]*+(?:[.!?。！？](?!\s|$|[^\x00-\x7f])[^\n.!?。！？]*+)*+(?:[.!?。！？]|\n|$)", re.M)
#: Sentences and lines by their ASCII marks alone, which garbling leaves as they are.
_SPLIT_ASCII = re.compile(r"[^\n][^\n.!?]*+(?:[.!?](?!\s|$)[^\n.!?]*+)*+(?:[.!?]|\n|$)", re.M)
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_RUNS = re.compile(r"[^\x00-\x7f]+")
#: Non-ASCII characters with single ASCII ones between them: no encoding reads bytes of two such stretches as one character.
_STRETCHES = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]?[^\x00-\x7f])*")
#: Samples of garbled text that a document quotes.
_QUOTED = re.compile("`[^`\n]{1,24}`|“[^“”\n]{1,24}”|‘[^‘’\n]{1,24}’|«[^«»\n]{1,24}»|\"[^\"\n]{1,24}\"|(?<![\\w])'[^'\n]{1,24}'(?!\\w)|\\([^()\\w\n]{1,8}\\)")
_LOST = "�"


@cache
def _to_bytes(codec: str) -> dict[int, int]:
    """Character -> byte; a byte the encoding leaves open is read as the control character of that number."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = b
    return table


@cache
def _to_chars(codec: str) -> str:
    back = {b: c for c, b in _to_bytes(codec).items()}
    return "".join(chr(back.get(b, b)) for b in range(256))


@cache
def _codes(codec: str) -> dict[int, str]:
    return {c: chr(b) for c, b in _to_bytes(codec).items()}


@cache
def _repertoire(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _to_bytes(codec)))


@cache
def _rereading(true: str, wrong: str) -> dict[int, str]:
    """Character as ``wrong`` shows it -> character that ``true`` has for the byte."""
    chars = _to_chars(true)
    return {c: chars[b] for c, b in _to_bytes(wrong).items()}


def _unread(text: str, codec: str) -> bytes | None:
    if codec not in SINGLE:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    return text.translate(_codes(codec)).encode("latin-1") if set(text) <= _repertoire(codec) else None


def _read(data: bytes, codec: str) -> str | None:
    if codec in SINGLE:
        return data.decode("latin-1").translate(_table(codec))
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


@cache
def _table(codec: str) -> dict[int, str]:
    return dict(enumerate(_to_chars(codec)))


def undo(text: str, chain: tuple[str, ...]) -> str | None:
    """The text before ``chain`` garbled it, or None if the chain cannot have given ``text``."""
    for k in range(len(chain) - 1, 0, -2):
        data = _unread(text, chain[k])
        text = None if data is None else _read(data, chain[k - 1])
        if text is None:
            return None
    return text


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """What ``chain`` makes of ``text``."""
    for k in range(0, len(chain), 2):
        try:
            data = text.encode(chain[k])
        except UnicodeEncodeError:
            return None
        text = _read(data, chain[k + 1])
        if text is None:
            return None
    return text


def units(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines."""
    return [m.span() for m in _SPLIT.finditer(text)]


def skeleton(unit: str) -> str:
    return _NON_ASCII.sub("", unit).strip()


def _pairs(text: str) -> np.ndarray:
    """Bucket of each pair of neighbours with a non-ASCII character in it; -1 elsewhere.  One per character but the last."""
    a = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = ((a[:-1] * np.uint64(2654435761) + a[1:] * np.uint64(40503)) >> np.uint64(3)) % np.uint64(BUCKETS)
    return np.where((a[:-1] > 127) | (a[1:] > 127), h.astype(np.int64), -1)


# counting pairs --------------------------------------------------------------------------------------------------


def pair_frequencies(documents: DataFrame) -> np.ndarray:
    """Log frequency, among documents with non-ASCII text, of each bucket of character pairs; shape (BUCKETS + 1,), 0 at the end."""
    import pyarrow as pa

    schema = "bucket int, n bigint"

    def run(batches):
        counts, docs = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and not text.isascii():
                    p = np.unique(_pairs(text))
                    counts[p[p >= 0]] += 1
                    docs += 1
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs, *counts[at].tolist()], pa.int64())], names=["bucket", "n"])

    rows = documents.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table, docs = np.zeros(BUCKETS), 1
    for bucket, n in zip(rows["bucket"], rows["n"]):
        if bucket < 0:
            docs = max(1, int(n))
        else:
            table[bucket] = n
    return np.append(np.log(table / docs + RARE), 0.0)


# learning --------------------------------------------------------------------------------------------------------


def keyed_units(text: str, lost: bool = False) -> list[tuple[int, str]]:
    """(key, unit) of each unit with non-ASCII characters: what garbled and clean twins share; with ``lost`` of those that hold U+FFFD, as they stand.

    The key is the unit's skeleton; where that has too few letters (as in Chinese or Russian) it is the unit's place after
    the last one that has enough, and its place in the skeleton of the whole text.  Else a unit with lost characters has none.
    """
    parts = _SPLIT_ASCII.findall(text)
    out, seen, anchor, at, whole = [], 0, "", 0, None
    for n, part in enumerate(parts):
        if part.isascii():
            continue
        unit = part.strip()
        own = skeleton(unit)
        if _ENOUGH.match(own):
            keys = [own]
        else:
            # the units since the last one that was looked at
            while seen < n:
                s = skeleton(parts[seen])
                if _ENOUGH.match(s):
                    anchor, at = s, seen
                seen += 1
            if whole is None:
                whole = skeleton(text)
                whole = xxhash.xxh64_intdigest(whole) if _CONTEXT.match(whole) else 0
            keys = [f"{anchor}\x01{n - at}\x01{own}"] if anchor else []
            keys += [f"{whole}\x02{n}"] if whole else []
        if lost and _LOST in _QUOTED.sub("", unit):
            out += [(xxhash.xxh64_intdigest(k) - (1 << 63), part) for k in keys]
        elif not lost and _LOST not in unit:
            out += [(xxhash.xxh64_intdigest(k) - (1 << 63), unit) for k in keys]
    return out


def skeletons(documents: DataFrame) -> DataFrame:
    """(skeleton, unit, n): the units with non-ASCII characters by the hash of their key, counted batch by batch in the tasks."""
    import pyarrow as pa

    schema = "skeleton bigint, unit string, n bigint"

    def run(batches):
        for b in batches:
            counts: Counter[tuple[int, str]] = Counter()
            for text in b.column(0).to_pylist():
                if text and not text.isascii():
                    counts.update(keyed_units(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([u for _, u in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["skeleton", "unit", "n"])

    return documents.select("text").mapInArrow(run, schema)


def counted_units(documents: DataFrame) -> DataFrame:
    """(skeleton, unit, n) over all documents, written once."""
    return shared_checkpoint(documents.sparkSession, skeletons(documents).groupBy("skeleton", "unit").agg(F.sum("n").alias("n")))


def twins(counted: DataFrame) -> DataFrame:
    """(unit, clean): each unit with the commonest of its skeleton, where that is another one.

    The commonest is an aggregate that combines before it shuffles, and it meets the units of its skeleton in ``SALT``
    parts, so a skeleton that a third of all units share is no task of its own.
    """
    several = counted.groupBy("skeleton").agg(F.count("*").alias("units")).where("units > 1").select("skeleton")
    met = counted.join(several, "skeleton", "left_semi")
    best = met.groupBy("skeleton").agg(F.max(F.struct("n", -F.length("unit"), "unit"))["unit"].alias("clean"))
    best = best.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALT)))))
    salted = met.select("skeleton", "unit", F.pmod(F.xxhash64("unit"), F.lit(SALT)).cast("int").alias("salt"))
    return salted.join(best, ["skeleton", "salt"]).where(F.col("unit") != F.col("clean")).select("unit", "clean")


def align(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """The runs between the ASCII characters that both texts share, in order; None if they do not line up."""
    g, c = _RUNS.findall(garbled), _RUNS.findall(clean)
    if len(g) != len(c) or _RUNS.split(garbled) != _RUNS.split(clean):
        return None
    return [x for x in zip(g, c) if x[0] != x[1]]


def run_chains(garbled: str, clean: str) -> frozenset[int]:
    """The chains that make the garbled run of the clean one; each true encoding encodes the run once."""
    out, data = [], {}
    for i, chain in enumerate(CHAINS):
        true, wrong = chain[:2]
        if true not in data:
            try:
                data[true] = clean.encode(true)
            except UnicodeEncodeError:
                data[true] = None
        read = data[true]
        if read is None:
            continue
        # a single-byte encoding shows every byte as one character
        if len(chain) == 2 and wrong in SINGLE and (len(read) != len(garbled) or _to_chars(wrong)[read[0]] != garbled[0]):
            continue
        text = _read(read, wrong)
        if text is not None and len(chain) > 2:
            text = garble(text, chain[2:])
        if text == garbled:
            out.append(i)
    return frozenset(out)


def explain_runs(runs: list[tuple[str, str]] | None, seen: dict | None = None) -> list[int]:
    """The chains that make each of the garbled runs of its clean one; ``seen`` holds what is known of run pairs."""
    left: frozenset[int] | None = None
    for run in runs or ():
        found = seen.get(run) if seen is not None else None
        if found is None:
            found = run_chains(*run)
            if seen is not None and len(run[0]) + len(run[1]) <= REMEMBERED_RUN_CHARS:
                if len(seen) >= REMEMBERED_RUNS:
                    seen.clear()
                seen[run] = found
        left = found if left is None else left & found
        if not left:
            break
    return sorted(left or ())


def explain(garbled: str, clean: str) -> list[int]:
    """The chains that make each garbled run of the pair of its clean one."""
    return explain_runs(align(garbled, clean))


def _make_explain():
    seen: dict[tuple[str, str], frozenset[int]] = {}

    def row(one, other):
        runs = align(one, other)
        if not runs:
            return
        # the commoner one may be the garbled one where a skeleton has few records
        for each in (runs, [(c, g) for g, c in runs]):
            if found := explain_runs(each, seen):
                chars = set("".join(g for g, _ in each))
                for i in found:
                    yield i, ""
                    for c in chars:
                        yield i, c

    return row


def learn(counted: DataFrame) -> DataFrame:
    """(chain int, pairs bigint, chars bigint): the twin pairs each transformation explains, and the distinct garbled
    characters in them; at most ``len(CHAINS)`` rows."""
    each = map_rows(twins(counted), ["unit", "clean"], "chain int, char string", _make_explain).groupBy("chain", "char").agg(F.count("*").alias("n"))
    return each.groupBy("chain").agg(F.sum(F.when(F.col("char") == "", F.col("n"))).alias("pairs"), F.count_if(F.col("char") != "").alias("chars"))


def learned(counted: DataFrame) -> tuple[int, ...]:
    """The transformations that enough twins teach, most pairs first."""
    rows = learn(counted).where((F.col("pairs") >= LEAST_PAIRS) & (F.col("chars") >= LEAST_CHARS)).collect()
    return tuple(r.chain for r in sorted(rows, key=lambda r: (-r.pairs, r.chain)))


# applying --------------------------------------------------------------------------------------------------------


_CONTROL = re.compile("[\x7f-\x9f]")


def _sums(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """The log frequencies of each text's pairs, summed; ``logs`` has a 0 after the table for pairs that do not count."""
    each = logs[_pairs("\n".join(texts))]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return np.add.reduceat(each, starts)


def _candidates(piece: str, chains: tuple[int, ...]) -> list[tuple[int, str]]:
    """(position in ``chains``, text before it) for every one of ``chains`` that can have given the piece or leaves it as it is."""
    out, chars = [], set(piece)
    fits = {c for c in SINGLE if chars <= _repertoire(c)}
    data: dict[str, bytes | None] = {}
    for n, i in enumerate(chains):
        chain = CHAINS[i]
        wrong = chain[-1]
        if wrong in SINGLE and wrong not in fits:
            continue
        if len(chain) == 2 and wrong in SINGLE and chain[0] in SINGLE:
            text = piece.translate(_rereading(chain[0], wrong))
        else:
            if wrong not in data:
                data[wrong] = _unread(piece, wrong)
            text = None if data[wrong] is None else _read(data[wrong], chain[-2])
            if text is not None and len(chain) > 2:
                text = undo(text, chain[:-2])
        if text is not None and not _CONTROL.search(text):
            out.append((n, text))
    return out


def _piece_gains(piece: str, chains: tuple[int, ...], logs: np.ndarray) -> np.ndarray:
    """What undoing each of ``chains`` on the piece gains; minus infinity where it cannot be undone."""
    out = np.full(len(chains), -np.inf)
    options = _candidates(piece, chains)
    if options:
        sums = _sums([piece, *(t for _, t in options)], logs)
        out[[n for n, _ in options]] = sums[1:] - sums[0]
    return out


def gains(unit: str, logs: np.ndarray, pieces: dict | None = None, by_run: tuple[int, ...] = BY_RUN, by_stretch: tuple[int, ...] = BY_STRETCH) -> np.ndarray:
    """What undoing each chain on the unit gains; minus infinity where it cannot be undone or is not asked for.

    The sum over the unit's pieces, each with the ASCII characters beside it, is that of the unit: a chain changes
    nothing else, and no pair with a non-ASCII character lies outside.
    """
    total = np.full(len(CHAINS), -np.inf)
    if "\x7f" in unit:
        return total
    padded = "\n" + unit + "\n\n"
    for rx, after, chains in ((_RUNS, 1, by_run), (_STRETCHES, 2, by_stretch)):
        if not chains:
            continue
        part = np.zeros(len(chains))
        for m in rx.finditer(padded):
            key = padded[m.start() - 1 : m.end() + after], after
            found = pieces.get(key) if pieces is not None else None
            if found is None:
                found = _piece_gains(key[0], chains, logs)
                if pieces is not None and len(key[0]) <= REMEMBERED_CHARS:
                    if len(pieces) >= REMEMBERED:
                        pieces.clear()
                    pieces[key] = found
            part += found
        total[list(chains)] = part
    return total


class Mender:
    """Undoes learned transformations; keeps what it has seen of units and pieces."""

    def __init__(self, logs: np.ndarray, chains: tuple[int, ...]):
        self.logs, self.units, self.pieces = logs, {}, {}
        self.by_run, self.by_stretch = tuple(i for i in chains if i in BY_RUN), tuple(i for i in chains if i in BY_STRETCH)

    def mend(self, unit: str) -> tuple[str, float, int]:
        """(text, gain, chain) of the best change of a unit; chain is -1 if nothing gains enough."""
        found = self.units.get(unit)
        if found is None:
            if len(self.units) > 50_000:
                self.units.clear()
            found = self.units[unit] = self._mend(unit)
        return found

    def _mend(self, unit: str) -> tuple[str, float, int]:
        masked = _QUOTED.sub(lambda m: "'" * len(m[0]) if not m[0].isascii() else m[0], unit)
        if len(_NON_ASCII.findall(masked)) < (1 - QUOTED_SHARE) * len(_NON_ASCII.findall(unit)):
            return unit, 0.0, -1
        best = (0.0, -1)
        for tried in dict.fromkeys((unit, masked)):
            each = gains(tried, self.logs, self.pieces, self.by_run, self.by_stretch)
            for i in np.flatnonzero(each > GAIN).tolist():
                if each[i] > best[0] + 1e-3:
                    best = (float(each[i]), i)
            if best[1] >= 0:
                return undo(unit, CHAINS[best[1]]) or undo(tried, CHAINS[best[1]]), *best
        return unit, 0.0, -1


def repair(text: str, mender: Mender) -> tuple[bool, int, int, str, str | None]:
    """(garbled, units mended, units lost, restored text, commonest chain)."""
    if not text or text.isascii():
        return False, 0, 0, text, None
    out, at, mended, lost, used = [], 0, 0, 0, {}
    for a, b in units(text):
        unit = text[a:b]
        if unit.isascii():
            continue
        if _LOST in unit and _LOST in _QUOTED.sub("", unit):
            lost += 1
            continue
        new, _, chain = mender.mend(unit)
        if chain >= 0:
            mended += 1
            used[chain] = used.get(chain, 0) + 1
            out.append(text[at:a] + new)
            at = b
    best = "|".join(CHAINS[max(used, key=used.get)]) if used else None
    return bool(mended or lost), mended, lost, "".join(out) + text[at:], best


RESTORED = "doc_id bigint, garbled boolean, units_restored int, units_lost int, encoding string, text string"


def restore(documents: DataFrame, only_garbled: bool = True, from_twins: bool = True) -> DataFrame:
    """One row per document (doc_id, text): whether it is garbled, what could be restored, and the restored text.

    A null, empty or ASCII text is not garbled.  A unit with U+FFFD outside a quoted sample is garbled and lost, unless
    ``from_twins`` is asked for and a clean twin tells what stood there.
    Repeated rows give repeated rows; further columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(pair_frequencies(documents))
    counted = counted_units(documents)
    chains = learned(counted)

    def make():
        mender = Mender(table.value, chains)

        def row(doc_id, text):
            garbled, mended, lost, new, encoding = repair(text, mender)
            if garbled or not only_garbled:
                yield doc_id, garbled, mended, lost, encoding, new

        return row

    out = map_rows(documents, ["doc_id", "text"], RESTORED, make)
    return filled(out, counted) if from_twins else out


def fits(unit: str, clean: str) -> bool:
    """Whether ``unit`` is ``clean`` with some of its non-ASCII characters lost: all others stand as they are."""
    return bool(re.fullmatch("".join(f"[^\\x00-\\x7f]{{1,{len(x)}}}" if x[0] == _LOST else re.escape(x) for x in re.findall(f"{_LOST}+|[^{_LOST}]+", unit)), clean))


def filled(restored: DataFrame, counted: DataFrame) -> DataFrame:
    """``restored`` with the lost units replaced by the clean twins they fit: a join on the skeleton, of the garbled documents only."""
    restored = shared_checkpoint(restored.sparkSession, restored)

    def make_lost():
        def row(text):
            for key, unit in dict.fromkeys(keyed_units(text, lost=True)):
                yield key, unit

        return row

    def make_fit():
        def row(unit, clean):
            bare = unit.strip()
            if fits(bare, clean):
                yield unit, unit.replace(bare, clean)

        return row

    lost = map_rows(restored.where("units_lost > 0"), ["text"], "skeleton bigint, unit string", make_lost).distinct()
    best = counted.join(lost.select("skeleton").distinct(), "skeleton", "left_semi").groupBy("skeleton").agg(F.max(F.struct("n", -F.length("unit"), "unit"))["unit"].alias("clean"))
    known = map_rows(lost.join(best, "skeleton"), ["unit", "clean"], "unit string, clean string", make_fit).groupBy("unit").agg(F.min("clean").alias("clean"))

    def make_parts():
        def row(doc_id, text):
            for n, part in enumerate(_SPLIT_ASCII.findall(text)):
                if _LOST in part:
                    yield doc_id, xxhash.xxh64_intdigest(text) - (1 << 63), n, part

        return row

    def make_filled():
        def row(doc_id, garbled, mended, lost, encoding, text, parts):
            new = {p["part"]: p["clean"] for p in parts or ()}
            n = 0
            if new:
                pieces, at = [], 0
                for m in _SPLIT_ASCII.finditer(text):
                    if m[0] in new and _LOST in m[0]:
                        pieces += [text[at : m.start()], new[m[0]]]
                        at, n = m.end(), n + 1
                text = "".join(pieces) + text[at:]
            yield doc_id, garbled, mended + n, max(0, lost - n), encoding, text

        return row

    # a text's own units bound its list
    parts = map_rows(restored.where("units_lost > 0"), ["doc_id", "text"], "id bigint, h bigint, n int, part string", make_parts)
    found = parts.join(known.withColumnRenamed("unit", "part"), "part").groupBy("id").agg(F.collect_set(F.struct("part", "clean")).alias("parts"))
    return map_rows(restored.join(found, restored["doc_id"] == found["id"], "left"), [*(c.split()[0] for c in RESTORED.split(", ")), "parts"], RESTORED, make_filled)


def encoding_found(documents: DataFrame) -> DataFrame:
    return restore(documents, from_twins=False).select("doc_id").distinct()
