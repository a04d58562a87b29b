"""Repair of conversations, SimHash and whitening against brute force, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import xxhash

from chainproof.llm import repair, simhash, toxicity, whitening

SPACES = " \t\n\x0b\x0c\r"


# --- repair ---------------------------------------------------------------------------------------


def all_edits(rows, most=2):
    """The least (cost, edits) by trying every sequence of edits; rows are (initial, fault)."""
    best = (10**9, "")

    def go(i, out, audit, cost, put_in):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best, (cost, audit))
        if put_in < most:
            for r in "ua":
                go(i, out + r, audit + "I", cost + 3, put_in + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, out, audit + "D", cost + 4, 0)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 3 if fault == repair.TRUNCATED else 0
                go(i + 1, out + (initial or "?"), audit + "K", cost + more, 0)
                for r in "ua":
                    go(i + 1, out + r, audit + "R", cost + 3 + more, 0)

    go(0, "", "", 0, 0)
    return best


def cheapest(rows, modulus=repair._HASH):
    tree = repair.Prefixes(modulus)
    return repair.best([w and (w[0], tree.text(w[1])) for w in repair.edits(rows, 0, tree)])


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suauat") if rng.random() < 0.9 else "", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 3))]
        want = all_edits(rows)
        assert [cheapest(rows, m) for m in (repair._HASH, 1, 3)] == [want] * 3  # with hashes that all collide, too
        k = rng.randint(0, len(rows))
        assert repair.best(repair.joined(repair.block(rows[:k]), repair.block(rows[k:]))[0]) == want


def test_blocks_of_long_runs_join_to_the_same():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suauat"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(20, 150))]
        cuts = [0, *sorted(rng.sample(range(len(rows)), 3)), len(rows)]
        whole = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = repair.block(rows[a:b])
            whole = own if whole is None else repair.joined(whole, own)
        assert repair.best(whole[0]) == cheapest(rows) == cheapest(rows, 1)


def brute_repair(turns):
    """Everything the operator returns, by conversation, from (conv, turn, role, text)."""
    out = {}
    for conv in dict.fromkeys(t[0] for t in turns):
        rows = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACES)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        known = [t for t, *_ in rows if t is not None]
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
        lines, kept, i, n = [], len(audit) - audit.count("D"), 0, 0
        for e in audit:
            if e in "KR":
                lines.append((rows[i][1] if e == "K" else "ua"[(n - kept) % 2], rows[i][2]))
            elif e == "I":
                lines.append(("ua"[(n - kept) % 2], ""))
            n, i = n + (e != "D"), i + (e != "I")
        text = "\n".join(f"{({'u': 'user', 'a': 'assistant'}).get(r, r)}:{t}" for r, t in lines)
        initials = [r[1][:1] for r in rows]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def conversations():
    rng = random.Random(7)
    turns = []
    for conv in range(120):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            turns.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "yes", "", " \n", None, "Why?  ", "no", "x. "])))
    turns += [(500, t, "user" if t % 2 == 0 else "assistant", f"Number {t}.") for t in range(900)] + [(501, 5, "user", "same.")] * 40
    turns += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (502, None, "user", "a" * 200_000 + " ."), (503, -(1 << 63), "user", "Far."), (503, (1 << 63) - 1, "assistant", "Off.")]
    return turns


def test_repair_of_conversations(spark, monkeypatch):
    turns = conversations()
    table = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, row long, fault string").repartition(5)
    want = brute_repair(turns)
    want[503] = ((1 << 63) - 1, *want[503][1:])
    got = {r[0]: tuple(r)[1:] for r in repair.repair(table).collect()}
    assert got == want and len(got) == len({t[0] for t in turns})
    assert repair.repair(table.where("false")).count() == 0
    rows = repair.with_faults(repair.damaged(table.where("conv_id = 500"))).orderBy("turn", "alike", "row").toArrow().combine_chunks()
    cut = rows.num_rows // 3
    monkeypatch.setattr(repair, "ROWS", 50)
    parts = [list(repair._blocks(iter(rows.slice(at, cut + 1).to_batches()))) for at in range(0, rows.num_rows, cut + 1)]
    import pyarrow as pa

    one = repair._of_blocks(pa.Table.from_batches([b for p in parts for b in p])).to_pylist()[0]
    assert (one["illegal"], one["cost"], one["audit"]) == want[500][4:7] and one["high"] - one["low"] + 1 - one["turns"] == want[500][0]


# --- simhash --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """The smallest position that links of at most two bits reach, by comparing all."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ x) <= 2).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É é ABC d e f g", "x " * 500, "the red ring of the brand\x0b\x0cnew"] + [" ".join(random.Random(i).choices("abcdefgh", k=i)) for i in range(3, 60)]
    assert [simhash.fingerprint(t and t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t and t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_simhash_components(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(250):
        base = rng.choices(words, k=rng.choice([5, 40, 200]))
        rows.append((i, " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 4])):
            other = list(base)
            other[rng.randrange(len(base))] = rng.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(other)))
    rows += [(5000, None), (5001, ""), (4000, rows[0][1]), (4000, "quite another"), (None, rows[0][1]), (None, "alone here with none")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    fps = [brute_fingerprint(t) for _, t in rows]
    root = components(fps)
    smallest = {}
    for (d, _), c in zip(rows, root, strict=True):
        smallest[c] = d if smallest.get(c) is None else min(smallest[c], d if d is not None else smallest[c])
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = sorted([(d, f"{f:016x}", smallest[c]) for (d, _), f, c in zip(rows, fps, root, strict=True)], key=key)
    for crowd in (simhash.CROWD, 1):
        assert sorted(map(tuple, simhash.near_duplicates(table, crowd=crowd).collect()), key=key) == want
    assert simhash.near_duplicates(table.where("false")).count() == 0


def test_links_miss_none_by_any_layout(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    base &= np.uint64(0xFFFF_FFFF_0000_FFFF)  # a group of bits that hardly says anything
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:40] for i, j in rng.integers(0, 63, (6, 2))]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    want = {(int(a), int(b)) for i, a in enumerate(np.sort(x.view(np.int64))) for b in np.sort(x.view(np.int64))[i + 1 :] if np.bitwise_count(np.uint64(a.view(np.uint64) ^ b.view(np.uint64))) <= 2}
    groups = simhash.correlated_groups(simhash.bits_together(fps), len(x))
    assert sorted(sum(groups, [])) == list(range(64)) and {len(g) for g in groups} == {simhash.WIDTH}
    near = simhash.at_distance(simhash.value_counts(fps, groups))
    for per in (1, 2):
        layout = simhash.Layout(groups, near, len(x), per)
        t, cost = layout.thresholds(x)
        assert (t.sum(0) == simhash.BITS + 1 - len(layout.bits)).all() and t.min() >= -1
        expected = layout.expected(x)
        ways = [w for w in np.ndindex(*[4] * len(layout.bits)) if sum(w) == simhash.BITS + 1]
        brute = np.min([sum(expected[p, u] for p, u in enumerate(w)) for w in ways], axis=0)
        assert np.allclose(cost, brute)
        assert {tuple(r) for r in simhash.links(fps, layout=layout).collect()} == want


def test_correlated_bits_are_in_one_group():
    rng = np.random.default_rng(5)
    bits = rng.random((4000, 64)) < 0.5
    for b in (7, 23, 40):
        bits[:, b] = bits[:, 3] ^ (rng.random(4000) < 0.05)
    together = bits.T.astype(float) @ bits
    assert any({3, 7, 23, 40} <= set(g) for g in simhash.correlated_groups(together, 4000))


# --- whitening ------------------------------------------------------------------------------------


def test_leading_eigenvectors():
    rng = np.random.default_rng(6)
    for spectrum in (np.linspace(2, 1, 64), np.r_[1e6, 50, 1.004, 1.002, np.linspace(1, 0.9, 60)], 0.5 ** np.arange(64.0), np.r_[[5.0] * 4, [1.0] * 60]):
        q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        m = (q * spectrum) @ q.T
        e, axes, rest = whitening.leading(lambda b: m @ b, 64, 4)
        assert np.allclose(e, spectrum[:4], rtol=1e-12) and rest < whitening.ROUNDED
        assert np.abs(m @ axes - axes * e).max() < 1e-12 * spectrum[0] and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-13


def test_the_block_grows_where_passes_do_not_do(monkeypatch):
    monkeypatch.setattr(whitening, "PASSES", 5)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((64, 64)))[0]
    m = (q * np.linspace(1.001, 1, 64)) @ q.T
    e, axes, rest = whitening.leading(lambda b: m @ b, 64, 4)
    assert np.allclose(e, np.linspace(1.001, 1, 64)[:4], rtol=1e-13) and np.abs(np.abs(axes.T @ q[:, :4]) - np.eye(4)).max() < 1e-9


def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(6) * [3, 2, 1.5, 1, 0.5, 0.2] / 4]) for i in range(300)]
    return rows + rows[:50] + [(7, [0.5] * 6), (None, [0.25, -0.25]), (900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")]), (904, []), (905, [-0.001] * 6)]


def test_whitening(spark):
    rows = vectors()
    table = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, x int").repartition(5)
    got = whitening.whiten(table).collect()
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.array(v + [0.0] * (6 - len(v)))) for _, v in fine]).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    w = (x - s / n) @ axes[:, :4] / np.sqrt(e[:4])
    deviation = ((n * x - s) ** 2).sum(1)
    assert len(got) == 4 * len(fine) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-12
    for k in range(4):
        own = [r for r in got if r["component"] == k + 1]
        sign = np.sign(sum(r["whitened"] * b for r, b in zip(sorted(own, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"])), [w[i, k] for i in sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, deviation[i]))], strict=True)))
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        a = sorted([(r["vec_id"], r["deviation"], r["whitened"] * sign) for r in own], key=key)
        b = sorted([(i, int(d), v) for (i, _), d, v in zip(fine, deviation, w[:, k], strict=True)], key=key)
        assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-10)
        assert abs(own[0]["explained"] - e[k] / e.sum()) < 1e-12


def test_whitening_at_the_edges(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(table([(1, None), (2, [])])).count() == 0 == whitening.whiten(table([])).count()
    one = whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    two = whitening.whiten(table([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] and round(abs(r["whitened"]), 9)) for r in two) == [(i, c, 1.0 if c == 1 else None) for i in (1, 2) for c in (1, 2, 3)]
    far = whitening.whiten(table([(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [1e14, 5.0])])).collect()
    assert {r["deviation"] for r in far} == {(1 << 63) - 1} and max(r["identity_error"] for r in far) < 1e-9


def test_examples_are_bounded_by_rows(spark, monkeypatch):
    """Many texts under one labelled id do not become as many examples."""
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    clean = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5][:15]
    docs = [(learned, f"bad word{i} word{i + 1} text") for i in range(300)] + [(i, f"good thing{i} said here") for i in clean]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(learned, 1)] + [(i, 0) for i in clean], "doc_id long, toxic int"))
    assert int(model.labels.sum()) == 20 and len(model.labels) == 35
