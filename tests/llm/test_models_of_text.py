"""Language-model scores, token alignment and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivane.llm import align, mixing, periods
from lexivane.llm.ragged import blocks

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed=0, size=60):
    rng = random.Random(seed)
    parts = ["the", "of", "ing", "tion", "er", "An", "ou", "re", "é", "ñ", "x1"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(150)]
    return [" ".join(rng.choices(words, k=rng.randint(1, size))) + rng.choice(["", ".", "\n\nEnd\t"]) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- 11 --------------------------------------------------------------------------------


ODD = ["", None, "a", "\x00\x01", "é" * 40, "the  the\r\nthe", "x" * 3000, "of the the"]


@pytest.fixture(scope="module")
def scored(spark):
    texts = prose(250) + ODD
    df = table(spark, texts)
    rows = {r.doc_id: r for r in mixing.score_texts(df.repartition(5)).collect()}
    return texts, df, rows


def test_base_score_is_the_plain_sum(scored):
    texts, _, rows = scored
    tokens = [[w for w in (t or "").encode().lower().split()] + [None] for t in texts]  # ASCII letters and white space
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert 20 < sum(held) < 60
    for i, ws in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-12)


def test_scores_do_not_depend_on_the_layout(scored):
    _, df, rows = scored
    again = {r.doc_id: r for r in mixing.score_texts(df.orderBy(F.rand(3)).coalesce(1)).collect()}
    for i, r in rows.items():
        assert again[i].score == pytest.approx(r.score, abs=1e-3) and r.score < 0


def test_held_out_text_is_better_than_bytes_alone(scored):
    texts, _, rows = scored
    held = [r for i, r in rows.items() if r.held_out and i < 250]
    assert sum(r.score for r in held) * -math.log2(10) / sum(r.n_bytes for r in held) < 2.5
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / max(r.n_bytes, 1)) for r in rows.values())


def slot_of(k, context, node):
    """The first predictor has a slot for each decision; in the others a context's line holds 64."""
    return node if k == 0 else (context >> (32 - mixing.TABLE_BITS)) ^ ((node * 0x9E3779B1 & 0xFFFFFFFF) >> 26)


def plain_scores(texts, code, counts, weights, refine):
    """Decision by decision, in plain dictionaries; for texts shorter than a chunk."""
    out = []
    for t in texts:
        total = 0.0
        for context, step in plain_steps(t, code):
            node, depth, bit = step >> 3, (step >> 1) & 3, step & 1
            odds = []
            for k, c in enumerate(context):
                zero, one = counts[k].get(slot_of(k, c, node), (0, 0))
                value = math.log((one + mixing.PRIOR) / (zero + mixing.PRIOR))
                odds.append(round(max(-8, min(8, value)) * mixing.ODDS_SCALE) / mixing.ODDS_SCALE)
            gate = 3 * sum(o != 0 for o in odds[1:]) + depth
            z = sum(w * o for w, o in zip(weights[gate], odds))
            place = (max(-7.999, min(7.999, z)) + 8) * 2
            low = int(place)
            mapped = refine[gate][low] + (refine[gate][low + 1] - refine[gate][low]) * (place - low)
            fine = (z + mapped) / 2
            total -= math.log1p(math.exp(-fine if bit else fine))
        out.append(total / math.log(10))
    return out


def plain_contexts(text):
    """Symbol and true contexts at each place."""
    data = text.encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    symbols = [*data, mixing.END]
    for i, s in enumerate(symbols):
        one, two = [*[mixing.END] * 2, *symbols][i : i + 2][::-1]
        before = one + int(mixing._CLASS[two])  # the context of the tree
        done = data[:i]
        word = re.search(rb"[^\x20\x09-\x0D]*\Z", done).group()
        rest = done[: len(done) - len(word)]
        last = re.search(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]?\Z", rest).group()
        yield s, (before, (min(i, 3), done[-3:]), (min(i, 5), done[-5:]), (last, word))


def plain_steps(text, code):
    """Hashed contexts and step of each decision."""
    (block,) = blocks(pa.array([text]))
    hashes = mixing.Symbols(block).hashes
    for i, (s, (before, *_)) in enumerate(plain_contexts(text)):
        entry = code.tree_of[before] * 257 + s
        for step in code.step[code.start[entry] : code.start[entry] + code.length[entry]].tolist():
            yield (before, *(int(h[i]) for h in hashes)), step


def test_hashes_stand_for_contexts():
    """In texts side by side: equal contexts have equal hashes, different ones different hashes."""
    texts = prose(80, 9, 30) + ["", "ab", "abc", "abcd", "abcde f", "  x", "x  y", "\n\n", "the THE", "w" * 200 + " z"]
    seen = [{} for _ in range(mixing.HASHED)], [{} for _ in range(mixing.HASHED)]
    for block in blocks(pa.array(texts)):
        hashes = mixing.Symbols(block).hashes
        for row in range(len(block)):
            for i, (_, context) in enumerate(plain_contexts(texts[block.first + row])):
                for k, h in enumerate(hashes):
                    value = int(h[block.starts[row] + i])
                    assert seen[0][k].setdefault(context[k + 1], value) == value
                    assert seen[1][k].setdefault(value, context[k + 1]) == context[k + 1]


def test_model_is_the_plain_one():
    train, asked = prose(60, 1), prose(12, 2, 20) + ["", "the", "zzz \n ", "Of THE the"]
    pairs = np.zeros(mixing.CLASSES * 257 * 257, np.int64)
    for b in blocks(pa.array(train)):
        s = mixing.Symbols(b)
        pairs += np.bincount(s.context * 257 + s.symbol, minlength=len(pairs))
    code = mixing.build_code(pairs.reshape(-1, 257))
    tally = mixing.Tally(code, mixing.TABLE_BITS)
    for b in blocks(pa.array(train)):
        tally.add(mixing.Symbols(b))
    tally.settle()
    weights, refine = mixing.start_weights()
    model = mixing.Model(code, [mixing.log_odds(mixing.by_decision(code, pairs.reshape(-1, 257))), *map(mixing.log_odds, tally.tables)],
                         mixing.TABLE_BITS, weights, refine)
    mixing.learn(model, list(blocks(pa.array(train))))
    counts = [{} for _ in range(mixing.INPUTS)]
    for t in train:
        for context, step in plain_steps(t, code):
            for k, c in enumerate(context):
                slot = counts[k].setdefault(slot_of(k, c, step >> 3), [0, 0])
                slot[step & 1] += 1
    got = np.concatenate([mixing.score_block(model, b) for b in blocks(pa.array(asked))])
    assert got == pytest.approx(plain_scores(asked, code, counts, model.weights.tolist(), model.refine.tolist()), rel=1e-3)  # the map is read at spaced places


def test_weights_are_learned_from_every_text(spark, monkeypatch):
    """Each text meets the tables of the texts on the other side."""
    texts = prose(120, 3) + ["", "the of " * 150, "x", "copy of a text", "copy of a text"]
    learned = []
    fit = mixing.fit
    monkeypatch.setattr(mixing, "fit", lambda model, met, values: (learned.append((met, values)), fit(model, met, values)))
    pairs = np.zeros(mixing.CLASSES * 257 * 257, np.int64)
    for b in blocks(pa.array(texts)):
        symbol, context, _ = mixing.Symbols.plain(b)
        pairs += np.bincount(context * 257 + symbol, minlength=len(pairs))
    df = table(spark, texts).select("text")
    model = mixing.train(df.repartition(4), pairs.reshape(-1, 257))
    side = dict(df.select("text", F.pmod(F.xxhash64("text"), F.lit(2))).collect())
    tallies = [mixing.Tally(model.code, mixing.TABLE_BITS) for _ in range(2)]
    for t in texts:
        for b in blocks(pa.array([t])):
            tallies[side[t]].add(mixing.Symbols(b))
    for tally in tallies:
        tally.settle()
    odds = [[model.odds[0], *map(mixing.log_odds, tally.tables)] for tally in tallies]
    expected = Counter()
    for t in texts:
        for context, step in plain_steps(t, model.code):
            at = step & 7
            for k, c in enumerate(context):
                value = int(odds[1 - side[t]][k][slot_of(k, c, step >> 3)]) / mixing.ODDS_SCALE
                size = sum(abs(value) > e for e in mixing.LEVEL_EDGES) + 1 if value else 0
                at = at * mixing.LEVELS + mixing.LEVELS // 2 + (size if value > 0 else -size)
            expected[at] += 1
    ((met, values),) = learned
    assert {int(i): int(met[i]) for i in np.flatnonzero(met)} == expected
    assert np.abs(values).max() <= 8
    for a, b, c in zip(model.odds[1:], tallies[0].tables, tallies[1].tables):
        assert (a == mixing.log_odds(b.astype(np.int64) + c)).all()


def test_fitted_weights_and_map_are_the_most_likely_ones():
    """No small change of a weight or of a node of the map makes the outcomes more likely."""
    rng = np.random.default_rng(8)
    met, values = mixing.empty_meetings(), np.sort(rng.normal(0, 2, (mixing.INPUTS, mixing.LEVELS)), axis=1)
    values[1:, mixing.LEVELS // 2] = 0
    met[rng.integers(0, 6 * mixing.LEVELS**mixing.INPUTS, 4000)] = rng.integers(1, 3000, 4000)
    model = mixing.Model(None, [], mixing.TABLE_BITS, *mixing.start_weights())
    start = mixing.Model(None, [], mixing.TABLE_BITS, *mixing.start_weights())
    mixing.fit(model, met, values)
    some = np.flatnonzero(met)
    level = [some // mixing.LEVELS ** (mixing.INPUTS - 1 - k) % mixing.LEVELS for k in range(mixing.INPUTS)]
    x = np.stack([values[k][level[k]] for k in range(mixing.INPUTS)])
    first = some // mixing.LEVELS**mixing.INPUTS
    gate = 3 * sum((level[k] != mixing.LEVELS // 2).astype(int) for k in range(1, mixing.INPUTS)) + first // 2
    y = first % 2 * 2 - 1
    for g in range(12):
        at = gate == g
        if not at.any():
            continue

        def loss(w, m):
            z = w @ x[:, at]
            straight = np.logaddexp(0, -y[at] * z) @ met[some[at]] + mixing.PULL / 2 * ((w - start.weights[g]) ** 2).sum()
            mapped = np.interp(np.clip(model.weights[g] @ x[:, at], -7.999, 7.999), np.linspace(-8, 8, 33), m)
            refined = (model.weights[g] @ x[:, at] + mapped) / 2
            return straight, np.logaddexp(0, -y[at] * refined) @ met[some[at]] + mixing.PULL / 2 * ((m - start.refine[g]) ** 2).sum()

        w, m = model.weights[g].astype(float), model.refine[g].astype(float)
        best = loss(w, m)
        for d in (-0.02, 0.02):
            assert all(loss(w + d * e, m)[0] > best[0] for e in np.eye(mixing.INPUTS))
            assert all(loss(w, m + 5 * d * e)[1] > best[1] - 1e-6 * best[1] for e in np.eye(33))


def test_counts_held_are_few_and_all_added(monkeypatch):
    """A task's tables and what it holds before adding take 50 MB, however much text it counts."""
    pairs = np.zeros(mixing.CLASSES * 257 * 257, np.int64)
    some = list(blocks(pa.array(prose(100, 6) + ["ab" * 5000]), 1 << 14))
    for b in some:
        symbol, context, _ = mixing.Symbols.plain(b)
        pairs += np.bincount(context * 257 + symbol, minlength=len(pairs))
    code = mixing.build_code(pairs.reshape(-1, 257))
    whole = mixing.Tally(code, mixing.TABLE_BITS)
    assert sum(t.nbytes for t in whole.tables) + whole.held.nbytes < 50 << 20
    monkeypatch.setattr(mixing, "HELD", 2048)
    monkeypatch.setattr(mixing, "PIECE", 1024)
    often = mixing.Tally(code, mixing.TABLE_BITS)
    for b in some:
        for tally in (whole, often):
            tally.add(mixing.Symbols(b))
    expected = np.zeros((mixing.HASHED, 2 << mixing.TABLE_BITS), np.int64)
    for b in some:
        symbols = mixing.Symbols(b)
        of, step = mixing.decisions(code, symbols.symbol, symbols.context)
        for k, h in enumerate(symbols.hashes):
            slot = ((h >> np.uint32(32 - mixing.TABLE_BITS))[of] ^ mixing.marks(step)).astype(np.int64)
            np.add.at(expected[k], 2 * slot + (step & 1), 1)
    for tally in (whole, often):
        tally.settle()
        assert all((t == e).all() for t, e in zip(tally.tables, expected))


def test_paths_of_a_tree_are_a_code():
    counts = np.random.default_rng(0).integers(0, 50, (mixing.CLASSES * 257, 257))
    counts[300:900] = 0  # contexts that never occur
    counts[97] *= 1000  # one with a tree of its own
    code = mixing.build_code(counts)
    assert code.n_nodes == 256 * (1 + 257 + (counts.sum(axis=1) * mixing.TREES >= counts.sum()).sum())
    for context in (0, 97, 256, 500, 4000):
        entry = code.tree_of[context] * 257 + np.arange(257)
        assert (0.5 ** code.length[entry]).sum() == pytest.approx(1.0)  # as a complete tree has it


def test_packed_counts_come_back():
    rng = np.random.default_rng(4)
    for high in (2, 300, 1 << 40):
        counts = rng.integers(0, high, 2 * mixing.CELL) * (rng.random(2 * mixing.CELL) < 0.3)
        into = np.ones_like(counts)
        mixing._unpack(mixing._pack(counts), into)
        assert (into == counts + 1).all()


def test_lm_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "some text"), (held, None)], "doc_id long, text string")
    rows = sorted(mixing.score_texts(df).collect(), key=lambda r: r.n_tokens)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert rows[1].score < rows[0].score < 0
    assert mixing.score_texts(df.limit(0)).count() == 0


# --- 12 --------------------------------------------------------------------------------


def plain_alignment(texts):
    a_side, b_side = align.ByteSide(A), align.PieceSide(B)
    per_doc, pairs = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids = a_side.library.encode(" " + (t or ""), add_special_tokens=False).ids, b_side.library.encode(t or "")
        cuts = []
        for side, some in zip((a_side, b_side), ids):
            ends, data = [], b""
            for i in some:
                data += side.tokens[i]
                ends.append(len(data))
            cuts.append(ends)
            if data != whole or not t:
                ids, cuts = ([], []), [[], []]
                break
        links = [(a, b) for a, e in zip(ids[0], cuts[0]) for b, f in zip(ids[1], cuts[1]) if e == f]
        groups, low = [], 0
        for e in sorted(set(cuts[0]) & set(cuts[1])):
            groups.append("|".join(",".join(str(i) for i, x in zip(some, ends) if low < x <= e) for some, ends in zip(ids, cuts)))
            low = e
        spans = [list(zip([0, *ends[:-1]], ends)) for ends in cuts]
        met = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        pairs.update(links)
        per_doc.append((len(ids[0]), len(ids[1]), ";".join(groups), len(groups), links, met))
    best = {}
    for (a, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (n_a, n_b, n_groups, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), text, met)
        for n_a, n_b, text, n_groups, links, met in per_doc
    ]


ALIGNED = prose(60, 5) + ["", None, "<|endoftext|> <s>x</s>", "▁a ▁", "naïve 中文 Ж́", "  two  spaces\n\n", "a\x00b", "don't it's 12,345.67", "x" * 500, "’quoted’ – €5"]


@pytest.mark.parametrize("slots", [1 << 16, 40])
def test_alignment_is_the_plain_one(spark, monkeypatch, slots):
    from lexivane.llm import lookups

    monkeypatch.setattr(align, "look_up", lambda *x: lookups.look_up(*x, slots=slots))  # all pairs frequent, or few
    got = {r.doc_id: r for r in align.alignment_counts(table(spark, ALIGNED).repartition(3), A, B).collect()}
    for i, (n_a, n_b, n_groups, n_links, n_best, count_sum, text, _) in enumerate(plain_alignment(ALIGNED)):
        r = got[i]
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)


def test_overlaps_are_all_pairs_that_share_a_byte(spark):
    got = {r.doc_id: r for r in align.align_tokens(table(spark, ALIGNED), A, B).collect()}
    for i, plain in enumerate(plain_alignment(ALIGNED)):
        assert [tuple(x) for x in got[i].overlaps] == plain[7] and got[i].groups == plain[6]


def test_fast_and_library_encoders_agree():
    side = align.ByteSide(A)
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x2010, 0x2028), 32, 39, 115])) for _ in range(40)) for _ in range(1500)]
    assert side.fast is not None
    assert [list(x) for x in side.encode(texts)] == [side.library.encode(t, add_special_tokens=False).ids for t in texts]


# --- 13 --------------------------------------------------------------------------------


def plain_runs(words):
    n, runs = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                runs.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def repeated(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice("abcd") if rng.random() < 0.3 else f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 10, 24, 90, 300]))]
        for _ in range(rng.randrange(3)):
            if words:
                at, q = rng.randrange(len(words)), rng.randrange(1, 40)
                for i in range(at + q, min(len(words), at + q * rng.randint(1, 9))):
                    words[i] = words[i - q]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


RUNS = repeated(300, 7) + ["", None, "a " * 1000, ("a " * 30 + "b ") * 12, "x" * 5000, "é ü " * 40]


def plain_digest(doc_id, text, alter):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if alter and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return runs, best, " ".join(kept)


def test_runs_are_the_plain_ones(spark):
    rows = {r.doc_id: r for r in periods.detect_runs(table(spark, RUNS).repartition(4)).collect()}
    for i, text in enumerate(RUNS):
        runs, _, kept = plain_digest(i, text, False)
        assert [tuple(r) for r in rows[i].runs] == runs and rows[i].collapsed == kept


def test_run_digests_are_the_plain_ones(spark):
    rows = {r.doc_id: r for r in periods.run_digests(table(spark, RUNS)).collect()}
    altered = 0
    for i, text in enumerate(RUNS):
        runs, best, kept = plain_digest(i, text, True)
        r = rows[i]
        altered += bool(runs) and zlib.crc32(str(i).encode()) % 10 == 0
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), expected)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert altered > 5


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    short, long = rng.integers(0, 3, (20, 16)).astype(np.uint64), rng.integers(0, 3, (20, 32)).astype(np.uint64)
    long[3, 7:23], long[5, 16:] = short[3], short[5]
    got = periods.zero_mismatches(short, long)
    for i in range(20):
        assert got[i].tolist() == [(short[i] == long[i, t : t + 16]).all() for t in range(17)]


def test_runs_where_hashes_collide():
    """A text of two words whose prefixes defeat polynomial hashes modulo a power of two."""
    words = [bin(i).count("1") % 2 for i in range(1 << 12)] * 3 + [2]
    s, e, q = periods.find_runs(np.array(words), len(words))
    assert (s.tolist(), e.tolist(), q.tolist()) == ([0], [3 << 12], [1 << 12])


# --- edges -----------------------------------------------------------------------------


def all_three(df):
    return mixing.score_texts(df), align.alignment_counts(df, A, B), periods.run_digests(df)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", None), (2, None, ""), (None, None, "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").withColumn("word", F.lit("w")).withColumn("pair", F.lit(1)).withColumn("n_runs", F.lit(2))
    for out in all_three(df):
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert len({str(r) for r in got if r.doc_id == 1}) == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert [out.count() for out in all_three(df)] == [0, 0, 0]


def test_paths_side_by_side_are_the_paths():
    counts = np.random.default_rng(3).integers(0, 50, (mixing.CLASSES * 257, 257))
    code = mixing.build_code(counts)
    entry = np.random.default_rng(4).integers(0, len(code.start), 5000)
    value = np.arange(len(entry)) * 3
    of, step = mixing.paths(code, entry)
    steps, values = mixing.side_by_side(code, entry, value)
    assert sorted(zip(steps.tolist(), values.tolist())) == sorted(zip(step.tolist(), value[of].tolist()))
    steps, values = mixing.side_by_side(code, entry[:0], value[:0])
    assert len(steps) == len(values) == 0


def test_words_are_found_by_themselves_not_by_hash_alone(monkeypatch):
    words = pa.array(["the", "of", "été", "x" * 70, "of the"])
    names = pa.array(["of", "été", "ete", "", "x" * 70, "the", "X"])
    expected = [1.0, 2.0, np.nan, np.nan, 3.0, 0.0, np.nan]
    for hashes in (mixing._word_hashes, lambda some: np.full(len(some), 7, np.uint64)):
        monkeypatch.setattr(mixing, "_word_hashes", hashes)
        known = mixing.Known.of(words, np.arange(5.0))
        assert np.array_equal(known.get(names), expected, equal_nan=True)
        assert len(known.get(names[:0])) == 0
        assert np.isnan(mixing.Known.of(words[:0], np.zeros(0)).get(names)).all()


def test_most_words_are_looked_up_where_the_texts_are(spark, monkeypatch):
    """Few words are left for a shuffle, and which ones does not matter."""
    docs = spark.createDataFrame([(i, f"the of w{i % 40} w{i % 40} once{i}") for i in range(200)], "doc_id long, text string")
    counts = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    found = []
    for most, least in ((1 << 19, 1), (42, 10), (41, 200), (2, 200), (1, 201)):
        monkeypatch.setattr(mixing, "HOT_WORDS", most)
        assert mixing._least_hot(counts) == least
        if most in (1 << 19, 42, 1):
            scored = mixing.score_texts(docs).select("doc_id", "n_tokens", "n_known", F.round("base_score", 9).alias("b"))
            found.append(sorted(map(tuple, scored.collect())))
    assert found[0] == found[1] == found[2]
