from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import mixing, packing, split, tokens


# splitting


def check_pieces(text, limit, overlap):
    spans = split.cut(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(b - c == overlap for (_, b), (c, _) in zip(spans, spans[1:]))
    assert text == text[: spans[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(spans, spans[1:]))
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.;{}é́", min_size=1, max_size=900), st.integers(20, 200), st.integers(0, 15))
def test_pieces_put_together_are_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_cuts_lie_at_natural_boundaries():
    text = "\n\n".join(f"def f{i}():\n" + "    x = 1\n" * 20 for i in range(40))
    spans = check_pieces(text, 2000, 200)
    assert all(text[b - 2 : b] == "\n\n" or text[b - 1] == "\n" for _, b in spans[:-1])
    assert sum(text[b : b + 3] == "def" for _, b in spans[:-1]) == len(spans) - 1


def test_optimal_against_brute_force():
    text = "".join(random.Random(5).choice(["aa bb. ", "cc\n", "\n\n", "dd; "]) for _ in range(40))
    limit, overlap = 60, 10
    spots = [s for s in split.boundaries(text) if s[0] > overlap]
    step = limit - overlap
    even_pieces = -(-(len(text) - overlap) // step)
    even = (len(text) + overlap * (even_pieces - 1)) / even_pieces
    have = dict(spots)

    def cost(spans):
        return sum(have[b] + split.BALANCE * ((b - a - even) / even) ** 2 for a, b in spans)

    best: dict[int, float] = {}
    for p, penalty in spots:  # every chain of spots, shortest first
        options = [penalty + split.BALANCE * ((p - even) / even) ** 2] if p <= limit else []
        options += [c + penalty + split.BALANCE * ((p - q + overlap - even) / even) ** 2 for q, c in best.items() if p - q + overlap <= limit]
        if options:
            best[p] = min(options)
    assert cost(split.cut(text, limit, overlap)) == pytest.approx(best[len(text)])


def test_no_boundary_at_all():
    assert len(check_pieces("x" * 5000, 2000, 200)) == 3
    assert split.cut("", 10, 2) == []
    assert split.cut("short", 10, 2) == [(0, 5)]
    with pytest.raises(ValueError):
        split.cut("x" * 50, 10, 10)


def test_split_operator(spark):
    long = "\n".join(f"line {i}" for i in range(500))
    rows = [("a", long, 10), ("a", long, 3), ("b", "x" * 2000, 1), ("c", "x" * 2001, None), ("d", None, 1), ("e", "", 1), ("f", "é" * 2500, 7), ("g", "word " * 40_000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, start_line int").withColumn("piece", F.lit("clash")).withColumn("pieces", F.lit("clash"))
    out = split.pieces(df).collect()
    assert {r.chunk_id for r in split.split_found(df).collect()} == {"a", "c", "f", "g"}
    first = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.piece)
    assert first[0].start_line == 3
    assert all(long.split("\n")[r.start_line - 3] in r.content.split("\n")[0] or r.content.split("\n")[0] in long.split("\n")[r.start_line - 3] for r in first)
    assert first[-1].end_line == 3 + 499
    assert all(len(r.content) <= 2000 and r.end_char - r.start_char == len(r.content) for r in out)
    assert split.pieces(df.limit(0)).count() == 0


# packing


def slow_sum_of_squares(sizes, capacity):
    """The rule by the book: every open level is tried, the whole sum is taken anew."""
    levels, out, bins, made = [0] * (capacity + 1), [], {}, 0
    for s in sizes:
        best = None
        for h in range(capacity - s + 1):
            if h and not levels[h]:
                continue
            after = list(levels)
            if h:
                after[h] -= 1
            if h + s < capacity:
                after[h + s] += 1
            total = sum(x * x for x in after)
            if best is None or total <= best[0]:
                best = (total, h, after)
        _, h, levels = best
        if h:
            b = bins[h].pop()
        else:
            b, made = made, made + 1
        if h + s < capacity:
            bins.setdefault(h + s, []).append(b)
        out.append(b)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares(sizes):
    p = packing.SumOfSquares(20)
    assert [p.place(s) for s in sizes] == slow_sum_of_squares(sizes, 20)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_packing(spark):
    r = random.Random(1)
    texts = ["word " * r.randint(1, 60) for _ in range(300)] + [None, "", "long " * 1000, "word word"]
    df = docs(spark, texts).withColumn("tokens", F.lit("clash")).withColumn("shard", F.lit("clash"))
    sizes = {i: tokens.count(t) for i, t in enumerate(texts)}
    placed = packing.pack(df, capacity=128).collect()
    by_doc: dict[int, list] = {}
    for p in placed:
        by_doc.setdefault(p.doc_id, []).append((p.token_start, p.token_end))
    assert {k for k, n in sizes.items() if n} == set(by_doc)
    for k, parts in by_doc.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == sizes[k]
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == 1 or sizes[k] > 128
    boxes = packing.containers(packing.pack(df, capacity=128), 128).collect()
    assert all(0 < b.tokens <= 128 for b in boxes)
    assert packing.fill(packing.pack(df, capacity=128), 128).first().filled > 0.95
    assert packing.fill(packing.pack(df.limit(0))).first().filled == 1.0


def test_packing_in_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2_000)
    df = docs(spark, ["word " * (i % 50 + 1) for i in range(400)])
    placed = packing.pack(df, capacity=100)
    assert placed.select((F.col("container_id") / (1 << 32)).cast("int").alias("s")).distinct().count() > 3
    assert placed.count() == 400
    assert packing.fill(placed, 100).first().filled > 0.9


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "some words in a row, 12 of them; " * 50
    whole = tokens.count(text)
    monkeypatch.setattr(tokens, "PART", 100)
    assert tokens.count(text) == whole
    assert tokens.count("x" * 350) >= 1
    assert tokens.count(None) == tokens.count("") == 0


# mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 1000), st.integers(0, 5)), min_size=1, max_size=8))
def test_water_fill(rows):
    sources = [(str(i), w, t, r) for i, (w, t, r) in enumerate(rows)]
    given_ = mixing.water_fill(sources)
    caps = {s: t * r for s, w, t, r in sources if t and r}
    assert set(given_) <= set(caps)
    assert all(g <= caps[s] + 1e-6 for s, g in given_.items())
    total = sum(t for s, w, t, r in sources if s in caps)
    assert sum(given_.values()) == pytest.approx(min(total, sum(caps.values())))
    weights = {s: w for s, w, *_ in sources}
    free = [s for s in given_ if given_[s] < caps[s] - 1e-6]
    # sources below their cap stand in the ratio of their targets, and no clamped one would get less by that ratio
    for a in free:
        for b in free:
            assert given_[a] / weights[a] == pytest.approx(given_[b] / weights[b])
        for b in set(given_) - set(free):
            assert given_[a] / weights[a] >= given_[b] / weights[b] - 1e-6


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(5, 40), "big" if i % 3 else "small" if i % 2 else "tiny") for i in range(1200)] + [(5000, None, "big"), (5001, "", "big"), (5002, "word", None), (5003, "word", "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("class", F.lit("clash")).withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 3), ("tiny", 0.2, 1), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(df, targets)
    caps = {"big": 1, "small": 3, "tiny": 1}
    got = mixture.collect()
    assert all(1 <= m.copies <= caps[m.source] for m in got)
    assert len({m.doc_id for m in got}) == len(got)
    by = {s.source: s for s in shares.collect()}
    assert by["absent"].given == 0 and by["absent"].actual_share == 0
    assert sum(s.actual_share for s in by.values()) == pytest.approx(1, abs=1e-5)
    want = mixing.water_fill([(s, by[s].target_share, by[s].held, by[s].max_repeats) for s in by])
    for s, tokens_ in want.items():
        assert by[s].given == pytest.approx(tokens_, abs=60)
        assert by[s].given == sum(m.tokens * m.copies for m in got if m.source == s)
    again = {(m.doc_id, m.copies) for m in mixing.mix(df, targets)[0].collect()}
    assert again == {(m.doc_id, m.copies) for m in got}
    other = {(m.doc_id, m.copies) for m in mixing.mix(df, targets, seed=7)[0].collect()}
    assert other != again
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
    assert mixing.mix(df, targets.limit(0))[1].count() == 0
