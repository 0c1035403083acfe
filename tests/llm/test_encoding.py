from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import encoding as E

SENTENCES = [
    "Además, ningún módulo pequeño pasará sin revisión del índice.", "Bitte zuerst Wächter öffnen, danach lässt sich Schlüssel löschen.", "Należy najpierw sprawdzić wskaźnik, później zaś słownik.", "Если индекс пуст, список остаётся без изменений.",
    "Les éléments du répertoire sont triés, puis réunis côté modèle.", "The store isn’t read before the cache is closed — that’s by design.", "请不要删除符号，它被片段引用。", "まず設定を確認し、次に見出しを削除してください。", "NÃO apague o índice; a cópia do módulo é pública.",
]


@pytest.mark.parametrize("chain", E.CHAINS)
def test_round_trip(chain):
    for s in SENTENCES:
        g = E.garble(s, chain)
        if g is not None and g != s:
            assert E.undo(g, chain) == s


def test_most_chains_are_seen():
    seen = [c for c in E.CHAINS if any((g := E.garble(s, c)) is not None and g != s for s in SENTENCES)]
    assert len(seen) > 0.9 * len(E.CHAINS)


def test_alignment():
    assert E.align("mÃ³dulo â€” x", "módulo — x") == [("Ã³", "ó"), ("â€”", "—")]
    assert E.align("mÃ³dulo", "modulo") is None
    assert E.align("a ó", "a ó") == []
    assert ("utf-8", "cp1252") in [E.CHAINS[i] for i in E.explain("mÃ³dulo â€” x", "módulo — x")]


KINDS = [("utf-8", "cp1252"), ("utf-8", "mac-roman"), ("cp1250", "cp1252"), ("koi8-r", "cp1251"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("euc_jp", "latin-1"), ("mac-roman", "cp1252")]
OF = {("utf-8", "cp1252"): (0, 1, 4), ("utf-8", "mac-roman"): (0, 1, 4), ("cp1250", "cp1252"): (2,), ("koi8-r", "cp1251"): (3,), ("utf-8", "cp1252", "utf-8", "cp1252"): (1, 4), ("euc_jp", "latin-1"): (7,), ("mac-roman", "cp1252"): (0, 1, 4)}


def corpus():
    """Clean texts, garbled copies of some of them (their twins), and garbled texts without a twin."""
    clean, bad = {}, {}
    for k, s in enumerate(SENTENCES):
        for i in range(12):
            clean[100 * k + i] = f"# Section {k} number {i}\nNo {i}: {s}\nplain words {i}"
    n = 5000
    for chain in KINDS:
        for k in OF[chain]:
            for i in range(6):
                n += 1
                bad[n] = (f"# Section {k} number {i}\n{E.garble(f'No {i}: ' + SENTENCES[k], chain)}\nplain words {i}", clean[100 * k + i])
            n += 1
            lone = f"Nowhere else {n}: " + SENTENCES[k]
            bad[n] = (E.garble(lone, chain), lone)
    lost = {9000: "Adem�s, ning�n m�dulo.", 9001: "Schl��ssel"}
    fine = {9100: "A typical symptom is `Ð¿Ñ€Ð¸` in the view.", 9101: "U+FFFD (�) marks a byte.", 9102: "If you see “Ã©” or “â€™” in a token, it was read wrongly.", 9103: "na%C3%AFve &eacute; \\u00e9", 9104: "╔══ queue ══╗ █▓▒░ ├─┤", 9105: "", 9106: None, 9107: "ascii only", 9108: SENTENCES[8] * 3000}
    return clean, bad, lost, fine


def test_operator(spark):
    clean, bad, lost, fine = corpus()
    # a text has more clean copies than garbled ones of a kind
    data = [*clean.items(), *((20_000 + k, t) for k, t in clean.items()), *((k, v[0]) for k, v in bad.items()), *lost.items(), *fine.items(), (5001, bad[5001][0])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("unit", F.lit("clash")).withColumn("garbled", F.lit("clash"))
    taught = {E.CHAINS[i] for i in E.learned(E.counted_units(df))}
    assert taught >= set(KINDS) and len(taught) < len(E.CHAINS) / 2
    assert {r.doc_id for r in E.encoding_found(df).collect()} == set(bad) | set(lost)
    got = {r.doc_id: r for r in E.restore(df).collect()}
    for k, (_, want) in bad.items():
        assert got[k].text == want
    assert got[9000].units_lost == 1 and got[9000].text == lost[9000]
    assert E.encoding_found(df.limit(0)).count() == 0


def test_without_twins_nothing_is_learned_and_nothing_found(spark):
    _, bad, _, _ = corpus()
    lone = [(k, t) for k, (t, _) in bad.items() if t.startswith("Nowhere")]
    clean = [(k, f"{s} nr {k}") for k, s in enumerate(SENTENCES * 20)]
    df = spark.createDataFrame([*lone, *((10_000 + k, t) for k, t in clean)], "doc_id bigint, text string")
    assert E.learned(E.counted_units(df)) == ()
    assert E.encoding_found(df).count() == 0


def test_a_hot_skeleton_meets_its_twins_in_parts(spark):
    rows = [(i, f"the same ASCII words é{chr(0xE0 + i % 24)}{chr(0x100 + i // 24)}") for i in range(600)] + [(1000 + i, "the same ASCII words éé") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = E.twins(E.counted_units(df)).collect()
    assert len(got) == 600 and {r.clean for r in got} == {"the same ASCII words éé"}


def test_pair_table_has_a_fixed_size(spark):
    df = spark.createDataFrame([(1, "é à"), (2, None), (3, "x")], "doc_id bigint, text string")
    t = E.pair_frequencies(df)
    assert t.shape == (E.BUCKETS + 1,)
    assert t[-1] == 0 and np.isfinite(t).all()


def test_a_hot_source_garbled_one_way_is_found(spark):
    """Garbled pairs that many documents share are common, and undoing them still gains."""
    clean = [f"nr {i} {SENTENCES[i % 2 * 4]}" for i in range(400)]
    hot = [f"nr {i} {SENTENCES[i % 2 * 4]} nr {i} {SENTENCES[4]}" for i in range(40)]
    df = spark.createDataFrame([*enumerate(clean), *((1000 + i, E.garble(s, ("utf-8", "cp1252"))) for i, s in enumerate(hot))], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in E.restore(df).collect()} == {1000 + i: s for i, s in enumerate(hot)}


def test_gains_of_pieces_add_up_to_those_of_the_unit():
    logs = np.append(np.log(np.random.default_rng(1).random(E.BUCKETS) + E.RARE), 0.0)
    garbled = [g for s in SENTENCES for c in E.CHAINS if (g := E.garble(s, c))]
    for unit in dict.fromkeys([*SENTENCES, *garbled, "é", "9é8ü7", "\x85é", "é\x7f", "ÃÃ a é1é1é"]):
        each = E.gains(unit, logs, {})
        for chain, gain in zip(E.CHAINS, each):
            text = E.undo(unit, chain)
            if text is None or E._CONTROL.search(text):
                assert gain == -np.inf
            else:
                want, had = E._sums([text, unit], logs)
                assert gain == pytest.approx(want - had)


def test_lost_characters_come_back_from_a_twin(spark):
    s = "Bitte zuerst Wächter öffnen, danach lässt sich Schlüssel löschen."
    rows = [(i, f"# Title {i}\n{s}\nend") for i in range(3)]
    rows += [(10, f"# Title 1\n{s.replace('ä', chr(0xFFFD) * 2)}\nend"), (11, s.replace("ü", chr(0xFFFD)) + "\nSchl\ufffdssel in keinem anderen Text."), (12, "Bitte zuerst W\ufffdchter \u00fcffnen, danach l\u00e4sst sich Schl\u00fcssel l\u00f6schen.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in E.restore(df).collect()}
    assert got[10].text == rows[1][1] and got[10].units_lost == 0 and got[10].units_restored == 1
    assert got[11].text == s + "\nSchl\ufffdssel in keinem anderen Text." and got[11].units_lost == 1
    assert got[12].text == rows[-1][1]
    assert {r.doc_id for r in E.encoding_found(df).collect()} == {10, 11, 12}
    assert E.fits("a\ufffdb", "aéb") and not E.fits("a\ufffdb", "ab") and not E.fits("é\ufffd", "öü")


def test_chains_of_a_run_pair_are_those_that_garble_it():
    runs = [(g, c) for s in SENTENCES for c in E._RUNS.findall(s) for chain in E.CHAINS if (g := E.garble(c, chain))]
    for g, c in dict.fromkeys([*runs, *((c, g) for g, c in runs), ("é", "éé"), ("\x85é", "…é"), ("\U0001f600", "ðŸ˜€")]):
        assert E.run_chains(g, c) == {i for i, chain in enumerate(E.CHAINS) if E.garble(c, chain) == g}
        pairs = E.align(f"a {g} b é", f"a {c} b Ã©")
        assert E.explain(f"a {g} b é", f"a {c} b Ã©") == [i for i, chain in enumerate(E.CHAINS) if pairs and all(E.garble(c, chain) == g for g, c in pairs)]


def test_a_run_pair_is_tried_once(monkeypatch):
    reads, read = [], E._read
    monkeypatch.setattr(E, "_read", lambda *a: reads.append(a) or read(*a))
    row = E._make_explain()
    first = list(row("nr 0 mÃ³dulo Ã© â€”", "nr 0 módulo é —"))
    tried = len(reads)
    assert (E.CHAINS.index(("utf-8", "cp1252")), "") in first and 0 < tried <= 6 * len(E.CHAINS)
    for i in range(1, 50):
        assert sorted(row(f"nr {i} mÃ³dulo Ã© â€”", f"nr {i} módulo é —")) == sorted(first)
    assert len(reads) == tried


def test_remembered_run_pairs_stay_few():
    seen = {}
    for i in range(E.REMEMBERED_RUNS + 10):
        E.explain_runs([(chr(0x4E00 + i % 20_000), chr(0x400 + i // 20_000))], seen)
    assert 0 < len(seen) <= E.REMEMBERED_RUNS
    E.explain_runs([("é" * 1_000_000, "ü" * 1_000_000)], seen)
    assert max(len(g) + len(c) for g, c in seen) <= E.REMEMBERED_RUN_CHARS


def test_units_end_where_a_lazy_search_ends_them():
    lazy, lazy_ascii = re.compile(r"[^\n]+?(?:[.!?。！？](?=\s|$|[^\x00-\x7f])|\n|$)", re.M), re.compile(r"[^\n]+?(?:[.!?](?=\s|$)|\n|$)", re.M)
    rnd = random.Random(5)
    for text in ["", "\n", ".", "...", ".\n", "a.\n\nb", "。。a", *("".join(rnd.choice("ab .!?。！？é\n\r\u2028\x85") for _ in range(rnd.randrange(40))) for _ in range(20_000))]:
        assert E.units(text) == [m.span() for m in lazy.finditer(text)]
        assert E._SPLIT_ASCII.findall(text) == lazy_ascii.findall(text)
