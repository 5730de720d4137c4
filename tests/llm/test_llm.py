"""The training-data operators against brute force, on small tables and on hard cases."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import components as C
from corpuslens.llm import cotrain, decontaminate, fingerprint, licence, mainhtml, packing, simhash, suffix, toxicity, urlfilter
from corpuslens.llm.common import neighbours

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, item_id string"


def documents(spark, rows):
    """documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", "f", "i") for i, t in rows], SCHEMA)


def prose(draw, n, size=400):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared passages."""
    draw = random.Random(11)
    long = prose(draw, 30_000, 3000)
    base = prose(draw, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(draw, 60, 5000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ä ö ü ß 日本 語 x y z"), (6, long), (7, base), (8, " ".join(near)), (9, base), (10, base.upper())]
    rows += [(11, prose(draw, 80) + "\n" + passage + "\n" + prose(draw, 70)), (12, passage), (13, prose(draw, 20) + " " + passage), (14, f"{passage} x {passage}")]
    rows += [(20 + i, prose(draw, draw.randrange(1, 120), 60)) for i in range(40)]
    return [*rows, (7, base), (None, "no id here at all my friend"), (None, None)]


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(-5, 3), (7, 7)]
    low = {}
    for a, b in edges:
        for x in (a, b):
            low.setdefault(x, x)
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = dict(C.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in low.items() if k in got} and set(low) - set(got) <= {7}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_across_partitions(spark):
    draw = random.Random(4)
    rows = [(draw.choice([5, 5, 5, draw.randrange(60)]), draw.randrange(3), d, draw.randrange(9)) for d in range(400)]
    rows += rows[:20]
    table = spark.createDataFrame([(*r, r[2] % 7 == 0) for r in rows], "key long, more long, d long, p int, flag boolean")
    once = sorted(set(rows))

    def want(n):
        count = {}
        for r in once:
            count.setdefault(r[:n], []).append(r)
        return {r: (r == rs[0], len(rs) > 1) for rs in count.values() for r in rs}

    one, two = want(1), want(2)
    got = {(r.key, r.more, r.d, r.p): ((r.leads0, r.matched0), (r.leads1, r.matched1)) for r in neighbours(table, [["key"], ["key", "more"]], ["d", "p"], "t").collect()}
    assert got == {r: (one[r], two[r]) for r in once if one[r][1]}
    got = {(r.key, r.more, r.d, r.p): (r.leads0, r.matched0) for r in neighbours(table, [["key", "more"]], ["d", "p"], "t", always="flag").collect()}
    assert got == {r: two[r] for r in once if two[r][1] or r[2] % 7 == 0}


# --- SimHash


def slow_simhash(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprint(hard):
    assert all(simhash.fingerprint(t) == slow_simhash(t) for _, t in hard)


def test_golay_keys_meet_for_every_pattern():
    draw = np.random.default_rng(3)
    nearest, near = simhash.coset_table(3), simhash.coset_table(4)
    assert (np.diff(nearest[0]) == 1).all() and len(nearest[1]) == 2048
    a = draw.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + draw.integers(0, 2, 3000).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 5), replace=False)) for _ in a], dtype=np.uint64)
    b = a ^ flips

    def keys(x):
        rows, k = simhash.golay_keys(x, nearest, near)
        assert len(set(zip(rows.tolist(), k.tolist(), strict=True))) == len(rows)  # no key twice
        out = [set() for _ in x]
        for r, v in zip(rows.tolist(), k.tolist(), strict=True):
            out[r].add(v)
        return out

    assert all(x & y for x, y in zip(keys(a), keys(b), strict=True))
    exact = [list(zip(*(k.tolist() for k in simhash.exact_keys(x)), strict=True)) for x in (a[:200], b[:200])]
    assert all(any(p == q for p, q in zip(x, y, strict=True)) for x, y in zip(*exact, strict=True))


def test_candidates_grow_little_faster_than_values():
    """Pairs of random values that share a key, for growing numbers of values: far fewer than values."""
    draw = np.random.default_rng(8)
    nearest, near = simhash.coset_table(3), simhash.coset_table(4)
    for n in (20_000, 40_000, 80_000):
        fps = draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        _, sizes = np.unique(simhash.golay_keys(fps, nearest, near)[1], return_counts=True)
        assert (sizes * (sizes - 1) // 2).sum() < n / 5


def rooted(values, pairs):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("most", [simhash.MOST_HELD, 40])
def test_dense_groups_link_by_forests(spark, most):
    """Many values within a few bits of each other, and chains of them: components as by brute force, whether their keys are held whole or get exact keys."""
    draw = random.Random(17)
    values = {draw.getrandbits(64) for _ in range(50)}
    for centre in list(values)[:3]:
        near = [centre]
        for _ in range(150):
            near.append(draw.choice(near) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 3))))
        values.update(near)
    values = sorted(values)
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), most).collect()
    mine = [(r.a % 2**64, r.b % 2**64) for r in found]
    assert {tuple(sorted(x)) for x in mine} <= set(pairs)
    assert rooted(values, mine) == rooted(values, pairs)


def test_dense_keys_make_fewer_rows_than_values():
    """One key over values far wider than four bits: its edges, before any distinct, are fewer than its values; batches may cut it anywhere."""
    import pyarrow as pa

    draw = random.Random(23)
    near = [draw.getrandbits(64)]
    while len(near) < 3000:
        near.append(draw.choice(near) ^ sum(1 << b for b in draw.sample(range(64), 2)))
    values = np.array(sorted(set(near)), np.uint64)
    keys = np.zeros(len(values), np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values.view(np.int64))], names=["key", "fp"])
    out = [x for at in [simhash._forest(simhash.MOST_HELD)] for batch in at(whole.slice(i, 700) for i in range(0, len(values), 700)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert len(out) == len(values) - 1 and len(set(rooted(values.tolist(), [(a % 2**64, b % 2**64) for a, b in out]).values())) == 1
    dense = [x for batch in simhash._forest(1000)(whole.slice(i, 700) for i in range(0, len(values), 700)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert sorted(a for a, _ in dense) == sorted(values.view(np.int64).tolist()) and all(a == b for a, b in dense)


def test_near_duplicates(spark, hard):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(documents(spark, hard)).collect())
    fps = [(i, slow_simhash(t)) for i, t in hard]
    low = {f: min([i for i, g in fps if g == f and i is not None], default=None) for _, f in fps}
    for _ in range(30):
        for f in low:
            for g in low:
                if (f ^ g).bit_count() <= 4:
                    both = [x for x in (low[f], low[g]) if x is not None]
                    low[f] = low[g] = min(both, default=None)
    assert got == sorted((i is None, i or 0, f, low[f]) for i, f in fps)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.one_of_each(documents(spark, [])).count() == 0


def slow_one_of_each(rows):
    """Texts of a component: the row of least doc_id stays, one without doc_id only among its like."""
    prints = [slow_simhash(t) for _, t in rows]
    roots = rooted(sorted(set(prints)), [(f, g) for f in set(prints) for g in set(prints) if f < g and (f ^ g).bit_count() <= 4])
    kept = []
    for root in set(roots.values()):
        mine = [(i is None, i or 0, t) for (i, t), f in zip(rows, prints, strict=True) if roots[f] == root]
        least = min(m[:2] for m in mine)
        kept.append((least, {t for *at, t in mine if tuple(at) == least}))
    return kept


def test_one_of_each(spark, hard):
    draw = random.Random(41)
    text = [prose(draw, 90, 10**5) for _ in range(6)]
    changed = lambda t: t + " tail"
    extra = [
        (103, text[0]), (105, changed(text[0])), (105, text[1]),  # a copy and a text of its own under one doc_id
        (None, text[2]), (None, changed(text[2])), (None, text[2]),  # copies without any doc_id
        (None, changed(text[1])), (106, text[3]), (106, text[3]), (106, text[4]), (None, text[5]),
    ]
    rows = hard + extra
    for table in (rows, rows[::-1], extra):
        kept = simhash.one_of_each(documents(spark, table))
        assert kept.columns == documents(spark, []).columns
        got = [((r.doc_id is None, r.doc_id or 0), r.text) for r in kept.collect()]
        want = slow_one_of_each(table)
        assert len(got) == len(want) and sorted(g[0] for g in got) == sorted(w[0] for w in want)
        for least, texts in want:
            assert any(at == least and t in texts for at, t in got)


# --- packing


def test_packing_round_trip(spark, hard):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    extra = [(90, "  two  spaces \n\n and\ttabs "), (91, "<|endoftext|> it's we'll 'S"), (92, "x " * 5000), (93, "a b  c  d"), (94, " lead"), (95, "tail ")]
    rows = [r for r in hard if r[0] not in (None, 7)] + extra
    got = packing.pack(documents(spark, rows), path).collect()
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for i, text in rows:
        pieces = sorted(docs.pop(i), key=lambda r: r.start)
        want = own.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for p in pieces for x in p.ids] == want and all(p.doc_tokens == len(want) for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    assert not docs
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        size = sum(p.length for p in pieces)
        assert size <= 2048 and size & (size - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(documents(spark, []), path).count() == 0
    assert packing.pack(documents(spark, hard), path, with_ids=False).where("doc_id is null and start = 0").count() == 2


def costs(pieces):
    cost, size = {}, {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
        size[s] = size.get(s, 0) + n
    return cost, size


def in_turn(lengths, most):
    """Pieces of documents that fill one sequence after the other, in the order given."""
    pieces, sequence, used = [], 0, 0
    for d, n in enumerate(lengths):
        start = 0
        while start < n:
            put = min(n - start, most - used)
            pieces.append((d, start, put, sequence, used))
            start, used = start + put, used + put
            if used == most:
                sequence, used = sequence + 1, 0
    return pieces


def test_assign_balances_cost():
    """Sequences of documents that fit cost about the same: far closer to each other than when they are filled in turn, shortest or longest first."""
    draw = random.Random(8)
    lengths = [draw.choice([3, 30, 120, 300, 700, 1500]) for _ in range(600)]
    spread = {}
    for name, pieces in (("ours", packing.assign(lengths)), ("turn", in_turn(lengths, 2048)), ("short", in_turn(sorted(lengths), 2048)), ("long", in_turn(sorted(lengths, reverse=True), 2048))):
        cost, size = costs(pieces)
        assert sum(size.values()) == sum(lengths)
        full = [cost[s] for s in cost if size[s] == 2048]
        spread[name] = np.std(full)
    assert spread["ours"] < 0.85 * min(spread["turn"], spread["short"], spread["long"])
    assert packing.assign([]) == []


def test_assign_takes_the_cheapest_with_room():
    """Each whole document went to the sequence of least cost among those with room for it, as a slow search says."""
    draw = random.Random(9)
    lengths = [draw.randrange(1, 400) for _ in range(60)]
    sizes = packing.capacities(sum(lengths))
    cost, used = [0.0] * len(sizes), [0] * len(sizes)
    want = []
    for d, n in sorted(enumerate(lengths), key=lambda x: (-x[1], 0)):
        start = 0
        while n:
            room = [s for s in range(len(sizes)) if sizes[s] - used[s] >= n]
            at = min(room, key=lambda s: (cost[s], s)) if room else max(range(len(sizes)), key=lambda s: (sizes[s] - used[s], -s))
            put = min(n, sizes[at] - used[at])
            want.append((d, start, put, at, used[at]))
            cost[at] += packing.LINEAR * put + packing.QUADRATIC * put * put
            used[at] += put
            n, start = n - put, start + put
    assert sorted(packing.assign(lengths)) == sorted(want)


def test_encoder_remembers_bounded_bytes():
    encode = packing.Encoder(packing.vocabulary_path())
    draw = random.Random(3)
    encode("x" + " " + "y" * 100_000)
    assert encode.held == 0
    for _ in range(20):
        encode("a " + " ".join(f"{draw.getrandbits(200):x}" for _ in range(5000)))
        assert encode.held <= packing.REMEMBERED + 4000


# --- repeated passages


def covered(rows, n):
    """Words of each row in passages of n words that occur more than once, and in those that aren't the first."""
    seen, out = {}, {}
    for i, h, t in sorted({(i if i is not None else suffix.LAST, xx(t), t or "") for i, t in rows}):
        w = t.split()
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), []).append((i, h, k))
    for places in seen.values():
        for place, (i, h, k) in enumerate(places if len(places) > 1 else ()):
            out.setdefault((i, h, place > 0), set()).update(range(k, k + n))
    return out


def xx(text):
    """Spark's xxhash64 of a text (its seed is the result for null)."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def overlapping(draw):
    """Texts that share passages whose best partners to the left and to the right differ, with ids that are null or shared."""
    a, b, c = (prose(draw, 45, 10**5) for _ in range(3))
    core = prose(draw, 30, 10**5)
    own = lambda: prose(draw, 40, 10**5)
    rows = [(201, f"{own()} {a} {core} {own()}"), (202, f"{own()} {a} {core} {b}"), (203, f"{own()} {core} {b}"), (204, f"{c} {core} {b} {own()}"), (205, f"{c} {core} {own()}")]
    passage = prose(draw, 70, 10**5)
    rows += [(206, passage), (206, own() + " " + own()), (206, own() + " " + passage), (None, own() + " " + passage), (None, own() + " " + own()), (None, passage), (207, passage), (207, passage), (None, passage)]
    return rows


def test_repeats(spark, hard):
    for rows in (hard, overlapping(random.Random(51)), hard + overlapping(random.Random(52))):
        got = {}
        texts = {(i if i is not None else suffix.LAST, xx(t)): t for i, t in rows}
        for r in suffix.spans(documents(spark, rows)).collect():
            got.setdefault((r.row_id, r.tie, r.is_copy), set()).update(range(r.word, r.stop_word))
            text = texts[r.row_id, r.tie]
            assert text[r.start : r.stop].split() == text.split()[r.word : r.stop_word]
        assert got == covered(rows, 50)
    assert any(not c for _, _, c in got) and any(c for _, _, c in got)
    out = suffix.repeats(documents(spark, hard))
    assert out.columns == ["doc_id", "is_copy", "word", "n_words", "start", "stop"] and {(r.doc_id, r.is_copy) for r in out.collect()} >= {(12, True), (11, False), (14, True)}
    assert suffix.repeats(documents(spark, [])).count() == 0


def slow_cut(rows):
    """Texts without the words of copies, as words."""
    copies = covered(rows, 50)
    out = []
    for i, t in rows:
        gone = copies.get((i if i is not None else suffix.LAST, xx(t), True), set())
        left = None if t is None else [w for k, w in enumerate(t.split()) if k not in gone]
        if not gone or left:
            out.append((i is None, i or 0, left))
    return sorted(out, key=repr)


def test_without_copies(spark, hard):
    for rows in (hard, overlapping(random.Random(53))):
        kept = suffix.without_copies(documents(spark, rows))
        assert kept.schema == documents(spark, []).schema
        got = kept.collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0, None if r.text is None else r.text.split()) for r in got), key=repr) == slow_cut(rows)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        uncut = {t for i, t in rows if (i if i is not None else suffix.LAST, xx(t), True) not in covered(rows, 50)}
        assert uncut <= {r.text for r in got}
    assert suffix.without_copies(documents(spark, [])).count() == 0


def test_minimisers_are_content_selected():
    draw = np.random.default_rng(1)
    h = draw.integers(0, 2**63, 200).astype(np.uint64)
    a = suffix.anchors(suffix.Sequences(h).grams(25), 26)
    b = suffix.anchors(suffix.Sequences(np.concatenate([h[:7], h])).grams(25), 26)
    assert (a + 7 == b[7:]).all()


# --- benchmark decontamination


def contain(rows, items):
    import regex

    words = lambda x: regex.findall(r"[\p{L}\p{N}]+", (x or "").lower())
    docs, out = {}, {}
    for i, t in rows:
        docs.setdefault(i, []).append(words(t))
    for j, t in items:
        w = words(t)
        n = min(5, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for i, many in docs.items():
            if i is not None and grams:
                held = {tuple(d[k : k + n]) for d in many for k in range(len(d) - n + 1)}
                if len(grams & held) / len(grams) >= 0.8:
                    out[i, j] = (len(grams & held), len(grams))
    return out


def test_contained(spark, hard):
    draw = random.Random(6)
    texts = dict(hard)
    long = texts[6].split()
    items = [(1, " ".join(long[9000:9040])), (2, texts[12]), (3, "one, TWO!"), (4, ""), (5, None), (6, prose(draw, 40, 9000)), (7, texts[7]), (8, "日本 語 x y z"), (9, " ".join(long[200:400])), (9, "w1"), (None, "one two")]
    changed = texts[12].split()
    changed[3] = "other"
    items += [(10, " ".join(changed)), (11, " ".join(long[50:100] + ["q"] * 40))]
    table = spark.createDataFrame(items, "item_id long, text string")
    one = [x for x in items if x[0] is not None and x[0] != 9]
    got = {(r.doc_id, r.item_id): (r.n_shared, r.item_size) for r in decontaminate.contained(documents(spark, hard), table.where("item_id <> 9")).collect()}
    assert got == contain(hard, one) and (6, 1) in got and (4, 3) in got
    left = {r.doc_id for r in decontaminate.without_leaks(documents(spark, hard), table.where("item_id in (1, 2)")).collect()}
    assert 6 not in left and 12 not in left and {1, 2, 7, None} <= left
    assert decontaminate.contained(documents(spark, hard), table.limit(0)).count() == 0
    assert decontaminate.contained(documents(spark, []), table).count() == 0
    assert decontaminate.without_leaks(documents(spark, hard), table.limit(0)).count() == len(hard)


def test_bands():
    assert (1 - 0.8) ** decontaminate.bands(1) <= 1e-6 and (1 - 0.8**2) ** decontaminate.bands(2) <= 1e-6


# --- fingerprints


def slow_sketch(text, k=fingerprint.SKETCH):
    words = (text or "").lower().split()

    def chained(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return h & (1 << 63) - 1

    if not words:
        return []
    grams = {chained(words[i : i + 5]) for i in range(len(words) - 4)} or {xxhash.xxh64_intdigest(" ".join(words).encode(), seed=42) & (1 << 63) - 1}
    return sorted(grams)[:k]


def near(a, b, k=fingerprint.SKETCH):
    if not a or not b:
        return float(not a and not b)
    union = sorted({*a, *b})
    union = union if len(a) < k and len(b) < k else union[:k]
    return len({*a} & {*b} & {*union}) / len(union)


def test_fingerprints(spark, hard):
    got = fingerprint.neighbours(documents(spark, hard)).select("*", fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("e"), fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("n")).collect()
    assert len(got) == len(hard)
    rows = sorted((r for r in hard if r[0] is not None), key=lambda r: r[0])
    head = {r[1] or "" for r in hard if r[0] is None}
    for at, (i, t) in enumerate(rows):
        t = t or ""
        found = next(r for r in got if r.doc_id == i)
        after = {rows[at + 1][1] or ""} if at + 1 < len(rows) else head
        if i == 7:
            continue  # repeated: the rows follow each other
        half = len(t) // 2
        assert found.edited in {t[: len(t) - half] + x[:half] for x in after}
        assert found.sketch == slow_sketch(t) and found.edited_sketch == slow_sketch(found.edited)
        assert found.e == near(found.sketch, found.edited_sketch) and found.n in {near(found.sketch, slow_sketch(x)) for x in after}
    first = sorted((t or "" for i, t in hard if i is None), key=xx)
    found = {r.text: r.edited for r in got if r.doc_id is None}
    after = [*first[1:], rows[0][1] or ""]
    assert found == {t: t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(first, after, strict=True)}
    assert fingerprint.neighbours(documents(spark, [])).count() == 0
    only = fingerprint.neighbours(documents(spark, [(5, "abcd efgh")])).first()
    assert only.edited == "abcd abcd"


def test_rows_without_an_id_spread_over_ranges(spark):
    """Nulls and repeated ids are dealt by a hash of their text; each row is followed by the next of (doc_id, hash), the last by the first."""
    draw = random.Random(19)
    rows = [(None, prose(draw, 12)) for _ in range(300)] + [(5, prose(draw, 12)) for _ in range(100)] + [(9, "the last one of all")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1])))
    dealt, _ = fingerprint.with_next(documents(spark, rows), 16)
    sizes = [r["count"] for r in dealt.where("real").groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100
    want = sorted(t[: len(t) - len(t) // 2] + ordered[(k + 1) % len(ordered)][1][: len(t) // 2] for k, (_, t) in enumerate(ordered))
    assert sorted(r.edited for r in fingerprint.neighbours(documents(spark, rows)).collect()) == want


def test_sketches_merge_and_estimate(spark):
    draw = random.Random(9)
    a, b = prose(draw, 4000, 10**6), prose(draw, 3000, 10**6)
    parts = spark.createDataFrame([("x", a), ("x", b), ("y", a), ("y", None)], "g string, text string")
    whole = spark.createDataFrame([("x", None)], "g string, text string")
    sketched = fingerprint.with_sketch(parts, "text", "sketch")
    merged = {r.g: r.sketch for r in fingerprint.merged_by(sketched, ["g"], "sketch").collect()}
    sa, sb = slow_sketch(a), slow_sketch(b)
    assert merged == {"x": sorted({*sa, *sb})[:256], "y": sa} and whole.count() == 1
    df = spark.createDataFrame([(merged["x"], sa, [])], "x array<long>, a array<long>, none array<long>")
    x, y, none = F.col("x"), F.col("a"), F.col("none")
    r = df.select(fingerprint.resemblance(x, y), fingerprint.containment(y, x), fingerprint.distinct_shingles(x), fingerprint.distinct_shingles(none), fingerprint.containment(none, x), fingerprint.containment(x, none), fingerprint.merged(y, none)).first()
    assert abs(r[0] - 3996 / 6992) < 0.1 and r[1] > 0.9 and abs(r[2] / 6992 - 1) < 0.25 and r[3] == 0 and r[4] == 1 and r[5] == 0 and r[6] == sa


# --- URL filter


def test_url_filter(spark):
    entries = [("l", "bad.example.com", "add", "2024-01-10"), ("l", "bad.example.com", "add", "2024-01-12"), ("l", "bad.example.com", "remove", "2024-02-01"), ("l", "bad.example.com", "add", "2024-03-01"), ("m", "example.com", "add", "2024-06-01"), ("m", "ok.example.com/x/", "add", "2024-01-01"), ("m", "gone.net", "add", "2024-01-01"), ("m", "gone.net", "remove", "2024-01-01"), (None, "q", "add", "2024-01-01"), ("m", None, "add", None)]
    urls = ["https://BAD.example.com/a", "http://www.bad.example.com:80", "https://notbad.example.com/", "https://u@ok.example.com/x/y?z", "https://ok.example.com/xy", "gone", None, "http://gone.net/"]
    days = ["2024-01-09", "2024-01-10", "2024-01-31", "2024-02-01", "2024-03-01", "2024-07-01"]
    table = spark.createDataFrame(entries, "list_name string, pattern string, action string, at string").withColumn("at", F.to_date("at"))
    captures = spark.createDataFrame([(i, u, d, 1) for i, u in enumerate(urls) for d in [*days, None]], "page_id long, url string, fetched string, pattern int").withColumn("fetched", F.to_date("fetched"))
    both = [urlfilter.evaluate(captures, table)]
    assert both[0].count() == captures.count()
    got = {(r.page_id, str(r.fetched)): (r.list_name, r.pattern) if r.blocked else None for r in both[0].collect()}

    def want(i, d):
        if d == "None" or urls[i] is None or "://" not in urls[i]:
            return None
        active = {2: [], 0: ["bad.example.com"], 1: ["bad.example.com"]}.get(i, [])
        hits = [("l", p) for p in active if "2024-01-10" <= d < "2024-02-01" or d >= "2024-03-01"]
        if i == 3:
            hits.append(("m", "ok.example.com/x/"))
        if i < 5 and d >= "2024-06-01":
            hits.append(("m", "example.com"))
        if i == 7:
            hits.append(("m", "gone.net"))
        return min(hits, key=lambda h: (-len(h[1]), h), default=None)

    assert got == {(i, d): want(i, d) for i, d in got}
    assert urlfilter.evaluate(captures, table.limit(0)).where("blocked").count() == 0 and urlfilter.evaluate(captures.limit(0), table).count() == 0


def test_url_patterns_by_brute_force(spark):
    """Of all domains and leading paths of a URL those that the list holds, with patterns of many lengths and URLs that go on where a pattern ends."""
    import re as plain

    draw = random.Random(37)
    label = lambda: draw.choice(["a", "bb", "x1", "com", "org"])
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{'.'.join(label() for _ in range(draw.randrange(1, 5)))}{draw.choice(['', ':80'])}{'/'.join(['', *(draw.choice(['', 'p', 'qq', 'é']) for _ in range(draw.randrange(4)))])}{draw.choice(['', '?q=/a/', '#f'])}" for _ in range(150)]

    def every(url):
        m = plain.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])[^/?#]*(/[^?#]*)?", url.lower())
        if not m:
            return set()
        h, path = m[1], m[2] or ""
        labels, steps = h.split("."), path.split("/")
        made = {".".join(labels[i:]) for i in range(len(labels))}
        return made | ({h + "/".join(steps[:i]) + "/" for i in range(1, len(steps))} | {h + path} if path else set())

    listed = sorted(draw.sample(sorted({p for u in urls for p in every(u)}), 60)) + ["zz", "b", "com/", "a.com/p/q"]
    lengths = [sorted({len(p) for p in listed if ("/" in p) == want}) for want in (False, True)]
    got = spark.createDataFrame([(u,) for u in [*urls, None, "", "gone"]], "url string").select("url", urlfilter.patterns(F.col("url"), *lengths).alias("p")).collect()
    for r in got:
        want = every(r.url or "") & set(listed)
        assert set(r.p or []) & set(listed) == want and set(r.p or []) <= every(r.url or "") and len(set(r.p or [])) == len(r.p or [])


def test_long_urls_cost_what_the_list_asks(spark):
    """URLs of a megabyte, by path and by host, against a list of a few patterns: as many candidates as the list has lengths."""
    import time

    urls = ["http://bad.example.com" + "/step" * 200_000, "http://" + "sub." * 200_000 + "bad.example.com/", "http://bad.example.com/step/" + "x" * 10**6]
    entries = spark.createDataFrame([("l", "bad.example.com/step/", "add", "2024-01-01"), ("m", "example.com", "add", "2024-01-01")], "list_name string, pattern string, action string, at string").withColumn("at", F.to_date("at"))
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched", F.to_date(F.lit("2024-05-01")))
    began = time.time()
    got = {r.page_id: r.pattern for r in urlfilter.evaluate(captures, entries).select("page_id", "pattern").collect()}
    assert got == {0: "bad.example.com/step/", 1: "example.com", 2: "bad.example.com/step/"} and time.time() - began < 30


def test_url_filter_shuffles_large_lists(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://h{i % 9}.example.org/p") for i in range(60)], "page_id long, url string")
    captures = pages.withColumn("fetched", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("page_id").cast("int")))
    entries = spark.createDataFrame([("l", f"h{i}.example.org", "add", f"2024-01-{10 + i}") for i in range(6)] + [("m", "example.org", "remove", "2024-01-01")], "list_name string, pattern string, action string, at string").withColumn("at", F.to_date("at"))
    a = {tuple(r) for r in urlfilter.evaluate(captures, entries).collect()}
    monkeypatch.setattr(urlfilter, "fits", lambda df: False)
    assert a == {tuple(r) for r in urlfilter.evaluate(captures, entries).collect()} and any(r[3] for r in a)


# --- licences


def test_licences(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "  LICENCED under the apache   licence -- version 2.0\nCopyright (c) 2020 Some One\n", "Copyright 2021 X\nAll rights reserved.", "x\nReleased under the MIT License.\n# released under the mit licence\ny", "", None, dict(licence.KNOWN)["Zlib"].replace("acknowledgment", "acknowledgment,").upper(), "in the sub-license of x", "Released under the MIT License. More."]
    got = {i: r for i, r in enumerate(sorted(licence.scan(documents(spark, list(enumerate(texts))), licence.known_table(spark)).collect(), key=lambda r: r.doc_id))}
    assert [got[i].license_id for i in range(9)] == ["Apache-2.0", "Apache-2.0", None, None, None, None, "Zlib", None, None]
    assert got[3].notices == ["MIT"] and got[0].notices == ["Apache-2.0"] and got[2].digest is None and got[8].notices == []
    twice = licence.scan(documents(spark, [(1, "a"), (1, "a"), (None, "b"), (1, "c")]), licence.known_table(spark).limit(0))
    assert twice.count() == 4 and licence.scan(documents(spark, []), licence.known_table(spark)).count() == 0


def test_lines_by_first_words_miss_nothing(spark):
    """Lines are looked up if their first word may begin a known text: with other spellings, marks and cases before it, as if all were put in canonical form."""
    known = [("A", "Sublicense it to others"), ("B", "percent of the licence"), ("C", "Licensed under X"), ("D", "\u00abThis\u00bb is \u00c9crit")]
    lines = ["Sub-licence it, to others!", "sub license it to others", "## SUBLICENSE it to others", "per cent of the license", "* Per-Cent of the licence.", "licenced under x", "// Licensed under X", "this is \u00c9CRIT", "\u2014 this is \u00e9crit", "under X licensed", "", "Copyright (c) 2020 X"]
    table = spark.createDataFrame(known, "license_id string, text string")
    got = {r.doc_id: r.notices for r in licence.scan(documents(spark, [(i, f"first\n{t}\nlast") for i, t in enumerate(lines)]), table).collect()}
    digests = {r.digest: r.license_id for r in table.select("license_id", licence.digest(F.col("text")).alias("digest")).collect()}
    plain = {r.i: r.d for r in spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", licence.digest(F.col("t")).alias("d")).collect()}
    assert got == {i: [digests[plain[i]]] if plain[i] in digests else [] for i in got} and sum(map(len, got.values())) == 9
    assert licence.first_words(["sublicense", "percent", "license"]) == ["licence", "license", "per", "percent", "sub", "sublicense"]


def test_licence_files_as_published(spark):
    body = {name: max((t for n, t in licence.KNOWN if n == name), key=len) for name in ("MIT", "ISC", "Zlib")}
    file = {f.name.removesuffix(".txt"): f.read_text() for f in licence.FOLDER.glob("*.txt")}
    apache, bsd = file["Apache-2.0"], file["BSD-3-Clause"]
    cases = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + body["MIT"]),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) Foo Inc.\n\n" + body["MIT"]),
        ("MIT", "MIT License\r\n\r\nCopyright <YEAR> <HOLDER>\r\n\r\n" + body["MIT"].replace("\n", "\r\n")),
        ("ISC", "ISC License\n\nCopyright Foo Bar <foo@bar.example>\nCopyright Another\n\n" + body["ISC"]),
        ("Zlib", "zlib License\n\n© Foo\n\n" + body["Zlib"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n" + " ".join(bsd.split())),
        ("BSD-3-Clause", "Copyright [yyyy] [name]\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("Apache-2.0", apache[: apache.index("END OF TERMS AND CONDITIONS")] + "END OF TERMS AND CONDITIONS\n"),
        ("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Foo Inc.")),
        (None, "Copyright laws of the land\n\nand more"),
        (None, "Copyright (c) Foo Inc."),
        (None, "MIT License\n\n" + body["MIT"] + " And more."),
    ]
    cases += [(re.sub(r"\.[a-z]+$", "", name), text) for name, text in file.items()]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= {c[0] for c in cases}
    got = {r.doc_id: r for r in licence.scan(documents(spark, [(i, t) for i, (_, t) in enumerate(cases)]), licence.known_table(spark)).collect()}
    assert [(i, got[i].license_id) for i in range(len(cases))] == [(i, c[0]) for i, c in enumerate(cases)]


def test_leaks_in_rows_without_an_id_of_their_own(spark):
    draw = random.Random(31)
    item = prose(draw, 40, 10**5)
    rows = [(None, prose(draw, 50, 10**5) + " " + item), (None, "clean"), (None, None), (3, "clean too"), (3, item + " and more"), (4, item), (5, "x")]
    left = decontaminate.without_leaks(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "clean"), (3, "clean too"), (5, "x")] and left.columns == documents(spark, []).columns
    halves = [(6, item[: len(item) // 2]), (6, item[len(item) // 2 :])]
    assert decontaminate.without_leaks(documents(spark, halves), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 2


# --- toxicity


def labelled(spark, n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(draw, draw.randrange(20, 80)).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["scum", "vile", "rot"])
        rows.append((i, " ".join(words), toxic))
    docs = documents(spark, [r[:2] for r in rows])
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, 600)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    at, w = toxicity.fit(docs, labels)
    assert len(at) == len(w) < 3000
    left = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert left == {r.doc_id for r in got if not r.predicted}


def slow_ftrl(rows, weight, seed=5):
    """FTRL-proximal a coordinate at a time, over texts, with features as a dictionary of words, pairs and pairs with one word between."""
    import math

    def grams(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {("w", x) for x in w} | {("p", *x) for x in zip(w, w[1:])} | {("s", *x) for x in zip(w, w[2:])}

    z, n = {}, {}
    total = sum(weight[y] for _, y in rows)
    base = sum(weight[y] * y for _, y in rows) / total
    start = math.log(base / (1 - base))

    def value(f):
        zf = z.get(f, 0.0)
        if abs(zf) <= toxicity.L1:
            return 0.0
        return -(zf - math.copysign(toxicity.L1, zf)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    each = [(grams(t), y) for t, y in rows]
    order = np.random.default_rng(seed)
    for _ in range(toxicity.PASSES):
        for k in order.permutation(len(each)):
            found, y = each[k]
            p = 1 / (1 + math.exp(-max(-30, min(30, start + sum(map(value, found))))))
            g = weight[y] * (p - y)
            for f in found:
                w, before = value(f), n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w
                n[f] = before + g * g
    return lambda text: 1 / (1 + math.exp(-max(-30, min(30, start + sum(map(value, grams(text or "")))))))


def test_toxicity_by_brute_force(spark):
    """Scores of all rows as by plain FTRL over unhashed features of the same rows in the same order."""
    docs, labels, truth = labelled(spark, 300, 12)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learnt = [i for i in sorted(truth) if zlib.crc32(str(i).encode()) % 5]
    slow = slow_ftrl([(texts[i], truth[i]) for i in learnt], toxicity.class_weights(labels))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert len(set(got.values())) > 20 and all(abs(got[i] - slow(texts[i])) < 1e-3 for i in got)


def test_toxicity_base_rate_is_that_of_all_labels(spark, monkeypatch):
    docs, labels, truth = labelled(spark, 600)
    learnt = [y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5]
    assert toxicity.class_weights(labels) == {0: 1.0, 1: 1.0}
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 80)
    w = toxicity.class_weights(labels)
    assert abs((60 * w[1] + 80 * w[0]) / 140 - 1) < 1e-9
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs.unionByName(documents(spark, [(10_000, "")])), labels).collect()}
    assert abs(got[10_000] - sum(learnt) / len(learnt)) < 1e-6


def test_toxicity_hard_cases(spark, hard):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1), (9, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(documents(spark, hard), labels).collect()
    assert len(got) == len(hard) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_documents(documents(spark, hard), labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.score_documents(documents(spark, []), labels).count() == 0


# --- quality


def test_cotraining(spark, hard):
    draw = random.Random(5)
    rows = []
    for i in range(500):
        bad = i % 5 == 0
        words = prose(draw, 60).split()
        rows.append((i, " ".join(w + draw.choice(["***", "%%%", "$$$"]) for w in words) if bad else " ".join(words) + ".", int(not bad)))
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    got = cotrain.score_documents(docs, labels).collect()
    assert sum(r.keep == bool(rows[r.doc_id][2]) for r in got) / len(got) > 0.97
    mixed = cotrain.score_documents(documents(spark, hard), spark.createDataFrame([(7, 1), (8, 0), (4, 1), (5, 0)], "doc_id long, quality int"))
    assert mixed.count() == len(hard) and mixed.where("not (score between 0 and 1)").count() == 0
    assert {r.score for r in cotrain.score_documents(documents(spark, hard), labels.limit(0)).collect()} == {0.5}
    assert cotrain.score_documents(documents(spark, []), labels).count() == 0


def measured(text, source, lang, n_chars):
    return [*cotrain.style(text), *cotrain.metadata(source, lang, n_chars), *(b / (10 * cotrain.STEPS) for b in cotrain.words(text))]


def test_views_share_nothing():
    """The text's view doesn't change with the metadata, nor the other one with the text."""
    k = len(cotrain.TEXT)
    row = lambda *x: cotrain.views(np.array([measured(*x)]))[0]
    a, b, c = row("some words", "s", "en", 10), row("some words", "t", "de", 99), row("*** 12\nOther | words", "s", "en", 10)
    assert (a[:k] == b[:k]).all() and (a[k:] != b[k:]).any() and (a[k:] == c[k:]).all() and (a[:k] != c[:k]).any()
    assert (row(None, None, None, None)[:k] == 0).all() and cotrain.words("a b ***") == cotrain.words("*** B a") != cotrain.words("a b c")


def slow_logistic(x, y, weight, penalty=1.0):
    """Weights by plain gradient steps with momentum, until nothing moves."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    step = 1 / (np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 / 4 + penalty)
    w = ahead = np.zeros(x.shape[1])
    for n in range(60_000):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (weight * (p - y)) + ridge * ahead)
        ahead, w, moved = new + n / (n + 3) * (new - w), new, np.abs(new - w).max()
        if moved < 1e-9:
            break
    return w


def test_one_round_by_brute_force(spark):
    """One round: the rows that each view teaches the other, and the views fitted to them, as by whole matrices and a full sort."""
    draw = random.Random(15)
    rows = []
    for i in range(900):
        bad = draw.random() < 0.4
        words = [f"w{draw.randrange(300)}" + (draw.choice(["***", "%%%", ""]) if bad else "") for _ in range(draw.randrange(5, 25))]
        rows.append((i, " ".join(words) + ("" if bad or draw.random() < 0.3 else "."), "forum" if draw.random() < (0.8 if bad else 0.15) else "press", draw.choice(["en", "de"]), None if i % 9 == 0 else 40 * len(words) + draw.randrange(300), int(not bad)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 4 == 1], "doc_id long, quality int")
    found = cotrain.measured(docs, labels)
    held = found.toArrow().combine_chunks().sort_by("doc_id")
    ids, y, tie = held["doc_id"].to_pylist(), held["y"].to_numpy(), held["draw"].to_numpy()
    x = np.array([measured(r[1], r[2], r[3], r[4]) for r in rows])
    assert ids == [r[0] for r in rows] and np.allclose(cotrain.matrix(held["x"]), x)
    every = cotrain.views(x)
    scale = np.where(every.std(0) < 1e-9, 1, every.std(0))
    z = (every - every.mean(0)) / scale
    parts = [z[:, : len(cotrain.TEXT)], z[:, len(cotrain.TEXT) :]]
    fold = np.array([zlib.crc32(str(i).encode()) % cotrain.FOLDS for i in ids])
    known = (y >= 0) & (fold != 0)
    model = cotrain.train(found, x[y >= 0], y[y >= 0], fold[y >= 0], rounds=1)
    first, cuts = model["rounds"][0]
    n = max(1, int((y == -1).sum() * cotrain.TAUGHT / 2))
    low = np.log(cotrain.SURE / (1 - cotrain.SURE))
    for v in (0, 1):
        plain = slow_logistic(parts[v][known], y[known], np.ones(known.sum()))
        assert np.allclose(first[v], plain, atol=1e-4)
    taught = cotrain._taught(model, parts, tie, y)
    for v, other in ((0, 1), (1, 0)):
        o = np.clip(parts[v] @ first[v][:-1] + first[v][-1], -30, 30)
        for label, sure in ((0, -o), (1, o)):
            mine = np.flatnonzero(taught[other] == label)
            could = np.flatnonzero((y == -1) & (sure >= low - 1e-12))
            want = sorted(could, key=lambda i: -sure[i])[:n]
            step = (30 - low) / cotrain.BINS
            assert set(mine) <= set(could) and abs(len(mine) - len(want)) <= 3 * len(want) ** 0.5
            if len(could) > n:  # all above the step of the last one, none below it
                last = sure[want[-1]]
                assert {i for i in could if sure[i] > last + step} <= set(mine) and all(sure[i] >= last - step for i in mine)
            else:
                assert set(mine) == set(want)
        use = taught[other] >= 0
        assert model["taught"][other] == use.sum()
    for v in (0, 1):
        use = taught[v] >= 0
        both = np.vstack([parts[v][known], parts[v][use]])
        want = slow_logistic(both, np.concatenate([y[known], taught[v][use]]), np.concatenate([np.ones(known.sum()), np.full(use.sum(), 0.5)]))
        assert np.allclose(model["views"][v], want, atol=2e-3)
    assert max(model["taught"]) > 0


def test_cotraining_learns_from_all_rows_without_a_label(spark):
    draw = random.Random(6)
    rows = []
    for i in range(12_000):
        bad = i % 4 == 0
        words = [f"w{draw.randrange(400)}" + (draw.choice(["***", "%%%", "$$$"]) if bad else "") for _ in range(12)]
        rows.append((i if i % 50 else None, " ".join(words) + ("" if bad else "."), "rare" if i % 3000 == 7 else "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(1, 1200) if i % 50], "doc_id long, quality int")
    found = cotrain.measured(docs, labels)
    model = cotrain.fit(found)
    every = cotrain.views(np.array([measured(t, s, None, None) for _, t, s in rows]))
    assert np.allclose(model["mean"], every.mean(0)) and np.allclose(model["scale"], np.where(every.std(0) < 1e-9, 1, every.std(0)))
    assert model["pool"] == 12_000 - labels.count() and max(model["taught"]) > 1600
    assert max(model["taught"]) <= 1.1 * cotrain.ROUNDS * cotrain.TAUGHT * model["pool"]


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var x = "</p><p>no";</script></head><body><nav><a href=/>Home</a></nav><div class="cookie">We use cookies on this site, accept them.</div>
<article><h1>A title &amp; more</h1><p>First&nbsp;paragraph with <b>bold</b> words,\n  and\ta <a href="x">link</a> in it.<p>Second: 1 &lt; 2 &#233;.<aside>Read more about other things here today.</aside><section id="comments"><p>Nice post, I liked it a lot, thanks.</p></section></article>
<form><p>Your name and address please</p><input name=a></form><footer>Imprint of the site</footer>"""


def test_main_text(spark):
    tree = mainhtml.train()
    assert mainhtml.main_text(tree, PAGE) == "A title & more\nFirst paragraph with bold words, and a link in it.\nSecond: 1 < 2 é."
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<p>" * 3000 + "<a" * 50, 5), (4, "u", "plain words alone <", 5), (1, "u", PAGE, 5), (5, "u", "<article><p>" + "long text " * 40_000, 5)]
    got = mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[5] == 399_999 and {r.page_id: r.text for r in got}[2] == ""
    assert mainhtml.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_elements_left_open_lose_nothing():
    texts = lambda page: [b.text for b in mainhtml.blocks(page)]
    article = "<article><p>The first words.</p><p>More of them.</p></article>"
    want = ["The first words.", "More of them."]
    for head in (
        "<form><datalist><option value=a><option value=b></datalist></form>", "<form><button>Go</form>", "<div><button>Go<div>", "<select><option>A<option>B</select>", "<select><option>A<option>B", "<p><span><button>Go</span></p>",
        "<object data=x>", "<video src=x>", "<audio>no sound", "<noscript>Switch it on", "<template>", "<iframe src=x>", "<svg><path d=x>", "<canvas>", "<script>var x = '<button>'</script>", "<button><div>Go</div></button>", "<svg><svg></svg><text>no</text></svg>", "<!--<button>-->",
    ):
        assert texts(head + article) == want, head
        assert texts(head + article + "<button>End</button><select><option>c</option></select><object></object>") == want, head
    assert texts("<div><svg>" * 2000 + "</div></svg>" * 2000 + article) == want
    assert texts("<p>a<textarea>b<p>c") == ["a"]


PROSE = "Rain fell over the harbour while the ferries waited for the tide to turn again, and nobody on the quay minded."
ARTICLE = ["The ferry that waited", PROSE, "Nobody minded.", f"{PROSE} {PROSE}", PROSE]
BODY = "<h1>{}</h1><p>{}</p><p>{}</p><p>{}</p><p>{}</p>".format(*ARTICLE)


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="sidebar menu"><div class="page has-sidebar"><div class="article-body">{BODY}</div><div class="sidebar"><p>{PROSE}</p></div></div></body>',
        f'<div class="layout menu-open"><article>{BODY}</article></div>',
        f'<form id="aspnetForm"><input name=x><article>{BODY}</article></form>',
        f'<form id="aspnetForm"><div><a href=/>Home</a> <a href=/b>News</a></div><div>{BODY}</div></form>',
        f'<div id="wrap"><div class="nav-wrapper"><p>All that we write about the sea.</p></div><div id="main">{BODY}</div><div class="site-footer"><p>{PROSE}</p></div></div>',
        f'<article>{BODY}<section class="comment-list"><article class="comment"><div class="content"><p>{PROSE}</p></div></article></section></article>',
        f'<article>{BODY}</article><div><h3>2 comments</h3><div>Anna</div><p>{PROSE}</p><p>I liked it.</p></div>',
        f"<div>{BODY}<div><h4>Kommentare</h4><p>{PROSE}</p></div></div>",
        f'<div class="cookie-consent"><p>{PROSE}</p></div><main>{BODY}<aside><p>{PROSE}</p></aside></main>',
        f"<p><a href=1>One</a></p><p><a href=2>Two of them</a></p><p>Est. 1901</p>{BODY}<p><a href=3>More</a></p><p>Imprint</p>",
        f"<div>{BODY.replace('<p>', '<div>').replace('</p>', '</div>')}</div><div><a href=3>More</a></div>",
        BODY,
    ],
)
def test_pages_unlike_the_labelled_table(page):
    """Page frames of their own, none of them a layout of the training table: the article is found whole and alone."""
    assert mainhtml.main_text(mainhtml.train(), page) == "\n".join(ARTICLE)


def test_tree_looks_at_neighbours():
    def used(tree):
        return {tree[0]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert {"words", "link density", "words before", "words after"} <= {mainhtml.FEATURES[f] for f in used(mainhtml.train())}


@pytest.mark.parametrize("unit", ["a < b <c ", '<a "', '<a x=">" ', "<a ='", "<svg>", "<div><svg>", "<button>", "<option>", "</div>", "<", "<script", "<textarea>", "<!--", "</", "<?", "<p", "&", "<p>some words", "<p>x</div>"])
def test_scanning_takes_time_by_length(unit):
    import time

    tree, took = mainhtml.train(), []
    for size in (100_000, 400_000):
        began = time.process_time()
        mainhtml.main_text(tree, unit * (size // len(unit)))
        mainhtml.main_text(tree, unit * (size // len(unit)) + ">")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 6


def slow_blocks(page):
    """Blocks of a well-formed page by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.parts, self.skip = [], [], 0

        def cut(self):
            text = " ".join("".join(self.parts).split())
            self.out += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title", "select", "svg")
            if tag == "br":
                self.parts.append(" ")
            elif tag in mainhtml.BLOCK:
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title", "select", "svg")
            if tag in mainhtml.BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.cut()
    return reader.out


def test_blocks_by_another_parser():
    draw = random.Random(77)

    def node(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.35:
            return draw.choice(["plain words ", "x &amp; y ", " 1 &lt; 2 ", "caf&eacute; &#233;\n\t z ", "a<br>b ", "<!-- <p>no</p> -->", "<img src='a>b'>", "<script>if (a < b) '</p>'</script>", "<style>p>a{}</style>", "<select><option>no</option></select>", "<svg><text>no</text></svg>"])
        name = draw.choice(["div", "p", "section", "ul", "li", "b", "i", "span", "a", "h2", "table", "td", "blockquote"])
        return f"<{name} data-x=\"{draw.randrange(9)}>\">" + "".join(node(depth - 1) for _ in range(draw.randrange(4))) + f"</{name}>"

    for _ in range(200):
        page = "".join(node(5) for _ in range(5))
        assert [b.text for b in mainhtml.blocks(page)] == slow_blocks(page)


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(21)
    docs, labels, truth = labelled(spark, 300, 4)
    clean = [(1000 + i, prose(draw, 120, 10**5)) for i in range(30)]
    item = prose(draw, 40, 10**5)
    passage = prose(draw, 70, 10**5)
    special = [(2000, clean[0][1]), (2001, clean[1][1] + " zz"), (2002, prose(draw, 50, 10**5) + " " + item + " end"), (2003, prose(draw, 60, 10**5) + " " + passage), (2004, passage + " " + prose(draw, 60, 10**5))]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs.unionByName(documents(spark, clean + special)).select(*cols)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < 4:
            assert out.columns == cols
        out.write.parquet(f"{tmp_path}/stage{n}")
        now = spark.read.parquet(f"{tmp_path}/stage{n}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    ids = {k: set(v) for k, v in seen.items()}
    assert {i for i, y in truth.items() if y} & ids["toxicity"] < set(range(12)) or len({i for i, y in truth.items() if y} & ids["toxicity"]) < 6
    assert {i for i, _ in clean} <= ids["packing"]
    assert not {2000, 2001} & ids["near_copies"] and {2002, 2003, 2004} <= ids["near_copies"]
    assert passage in seen["repeated_passages"][2003].text and passage not in seen["repeated_passages"][2004].text
    assert 2002 not in ids["benchmark_leaks"] and ids["benchmark_leaks"] == ids["repeated_passages"] - {2002}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == ids["packing"]


def test_pipeline_stages_on_hard_rows(spark, hard, tmp_path):
    """Each stage on null, shared and repeated ids, empty and long texts, copies and passages, against brute force over its own input; empty tables pass through all stages."""
    import corpus_pipeline

    draw = random.Random(61)
    docs, labels, truth = labelled(spark, 120, 4)
    toxic = [r.text for r in docs.collect() if truth[r.doc_id]][:2]
    item = prose(draw, 30, 10**5)
    rows = [(i + 10_000, t) for i, t in [tuple(r)[:2] for r in docs.collect()]] + hard + overlapping(draw) + [(None, toxic[0]), (7, toxic[1]), (None, item), (301, item + " more"), (302, "")]
    labels.select((F.col("doc_id") + 10_000).alias("doc_id"), "toxic", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for n, given in enumerate((rows, [])):
        table = documents(spark, given).select("doc_id", "text", "lang", "source", "n_chars")
        now = given
        for name in ("toxicity", "near_copies", "repeated_passages", "benchmark_leaks"):
            out = stages[name](spark, table, str(tmp_path))
            assert out.schema.names == table.schema.names
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            table = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            got = [(r.doc_id, r.text) for r in table.collect()]
            if name == "toxicity":
                scores = toxicity.score_documents(documents(spark, now), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
                assert sorted(map(repr, [g[0] for g in got])) == sorted(repr(r.doc_id) for r in scores if r.score < 0.5)
                assert not n or got == []
            elif name == "near_copies":
                want = slow_one_of_each(now)
                assert sorted((i is None, i or 0) for i, _ in got) == sorted(least for least, _ in want)
                assert all(any((i is None, i or 0) == least and t in texts for i, t in got) for least, texts in want)
            elif name == "repeated_passages":
                assert sorted(((i is None, i or 0, None if t is None else t.split()) for i, t in got), key=repr) == slow_cut(now)
            else:
                leaked = [(i, t) for k, (i, t) in enumerate(now) if contain([(k, t)], [(1, item)])]
                assert sorted(map(repr, got)) == sorted(map(repr, [r for r in now if r not in leaked])) and (bool(leaked) or n)
            now = got
        packed = stages["packing"](spark, table, str(tmp_path)).collect()
        assert sum(r.start == 0 for r in packed) == len(now)
