"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, against brute force."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from pagelake.llm import chat, decontamination, jaccard, lm, mixing, rules, sharding, toxicity, warc, weak
from pagelake.llm.text import ALNUM, LOWER, PLAIN, WordHasher

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 997}" for i in range(300_000))
SHAPE = "doc_id long, text string, source string, size string, shard string, n_words string"
BASE = " ".join(f"word{i}" for i in range(100))
ROWS = [
    (1, BASE, "b", "x", "y", "z"), (2, BASE, "b", "x", "y", "z"), (2, BASE, "b", "x", "y", "z"),
    (3, BASE.replace("word99", "other"), "a", None, None, None), (4, BASE.replace("word50", "other"), "a", "", "", ""),
    (5, None, None, "x", "y", "z"), (6, "", "a", "x", "y", "z"), (None, "Ärger \x0b über\x85all # two", None, "x", "y", "z"),
    (7, " \n\t ", "a", "x", "y", "z"), (8, LONG, "c", "x", "y", "z"), (9, "one two three", "a", "x", "y", "z"), (10, "ONE two  three", "b", "x", "y", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("table,words", [(PLAIN, lambda b: b.split()), (LOWER, lambda b: b.lower().split()), (ALNUM, lambda b: b.translate(ALNUM).split())])
def test_hashes_know_words(table, words):
    texts = [r[1].encode() if r[1] else None for r in ROWS] + [b"x" * 3_000_000 + b" y", b"a\x1cb"]
    hasher, names = WordHasher(table), {}
    for text, hashes in zip(texts, hasher.each(texts)):
        own = words(text or b"")
        assert len(own) == len(hashes)
        for word, value in zip(own, hashes.tolist()):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, 24, docs.count()).collect()
    assert len(out) == len(ROWS) and sharding.shard_documents(none, 24, 0).count() == 0
    slots, shard_of = collections.defaultdict(list), {}
    for r in out:
        assert r.grown_shard in (r.shard, 24) and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] == len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_move_rows_only_where_they_change(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    def at(weights):
        return {r.k: r.shard for r in sharding.assign(keys, "k", len(weights), weights).collect()}
    for n in (11, 12, 24, 25):
        before, after = at([1.0] * n), at([1.0] * (n + 1))
        assert all(after[k] in (before[k], n) for k in before) and abs(sum(s == n for s in after.values()) / 4000 - 1 / (n + 1)) < 0.03
    before, after = at([1.0] * 24), at([1.0] * 5 + [0.0] + [1.0] * 18)
    assert all(before[k] == after[k] or before[k] == 5 for k in before)
    with pytest.raises(ValueError):
        sharding.assign(keys, "k", 2, [0.0, 0.0])


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0] * 25, [1.0, 0.5, 0.0, 2.0, 1.5] * 3])
def test_descent_against_times_of_all_shards(spark, weights):
    """Every shard's time drawn by the rule, in plain Python, and the least of them."""
    ceiling = max(weights)

    def unit(key, what, node):
        return ((xxhash.xxh64_intdigest(f"{key}:{what}:{node}".encode(), seed=42) >> 11) + 0.5) / 2**53

    def wait(key, what, node, rate):
        return -math.log(unit(key, what, node)) / rate

    def time(key, shard):
        rack, region = shard // 4, shard // 12
        out = wait(key, "region", region, 12 * ceiling)
        if rack % 3 != int(unit(key, "first rack", region) * 3):
            out += wait(key, "rack", rack, 4 * ceiling)
        if shard % 4 != int(unit(key, "first shard", rack) * 4):
            out += wait(key, "shard", shard, ceiling)
        if unit(key, "mark", shard) < weights[shard] / ceiling:
            return out
        return out + wait(key, "later", shard, weights[shard]) if weights[shard] else math.inf

    rows = sharding.assign(spark.range(3000).withColumnRenamed("id", "k"), "k", len(weights), weights).collect()
    for r in rows:
        assert r.shard == min(range(len(weights)), key=lambda s: time(r.k, s)) and (r.region, r.rack) == (r.shard // 12, r.shard // 4 % 3)
    found = collections.Counter(r.shard for r in rows)
    assert all(abs(found[s] / 3000 - w / sum(weights)) < 0.03 for s, w in enumerate(weights))


def test_weight_changes_move_rows_of_that_shard_alone(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    def at(weights):
        return {r.k: r.shard for r in sharding.assign(keys, "k", len(weights), weights, ceiling=2.0).collect()}
    light, heavy = at([1.0] * 7 + [0.25] + [1.0] * 9), at([1.0] * 7 + [1.75] + [1.0] * 9)
    assert all(heavy[k] in (light[k], 7) for k in light) and sum(heavy[k] != light[k] for k in light) > 100
    with pytest.raises(ValueError):
        sharding.assign(keys, "k", 2, [1.0, 3.0], ceiling=2.0)


def test_slots_of_a_hot_key(spark):
    rows = [(7, f"text {i}") for i in range(400)] + [(7, "same")] * 5 + [(8, None)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24, 406).collect()
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert len({r.shard for r in placed if r.doc_id == 7}) == 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rules(docs, none):
    out = {(r.doc_id, r.n_words): r for r in rules.ledger(rules.measure(docs)).collect()}
    assert sum(1 for _ in rules.measure(docs).collect()) == len(ROWS) and rules.measure(none).count() == 0
    assert out[5, 0].fail_bits & 1 and out[6, 0].word_chars == 0 and out[1, 100].fail_bits == 0
    odd = out[None, 4]
    assert (odd.word_chars, odd.n_symbols) == (len("Ärgerüber\x85all#two"), 1)
    assert out[8, 300_000].n_repeat_words == 300_000
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 3, 4]
    by_rule = {r.rule: r for r in rules.ablations(rules.ledger(rules.measure(docs)), rules.BASE_POLICY).collect()}
    assert by_rule["repeated_words"].fails_alone == 1 and by_rule["few_words"].kept_without == len(ROWS) - 1
    assert rules.ablations(rules.ledger(rules.measure(none)), rules.BASE_POLICY).first().fails == 0


def brute_components(rows):
    sets = []
    for r in rows:
        words = WORD.findall(low(r[1]))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return sorted(((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, words, share):
    return " ".join(f"e{rng.integers(10**6)}" if rng.random() < share else w for w in words)


def test_similar_documents(spark, docs, none, monkeypatch):
    assert sorted((tuple(r) for r in jaccard.components(docs).collect()), key=repr) == brute_components(ROWS)
    assert jaccard.components(none).count() == 0 and jaccard.keep_one(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 5, 6, 7, 8, 9, None], key=repr)
    # Large groups whose pairs are near the threshold, with every token frequent, and small tiles.
    monkeypatch.setattr(jaccard, "frequent_above", lambda counters: 3)
    monkeypatch.setattr(jaccard, "_TILE", 8)
    rng = np.random.default_rng(4)
    rows = []
    for size in (20, 45, 140, 300):
        base = [f"b{size}.{i}" for i in range(size)]
        rows += [(len(rows) + i, edited(rng, base, share), "s", "", "", "") for i, share in enumerate(np.linspace(0, 0.05, 60))]
    whole = spark.createDataFrame(rows, SHAPE)
    assert sorted((tuple(r) for r in jaccard.components(whole).collect()), key=repr) == brute_components(rows)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        count = lambda t: (t % np.uint64(11)).astype(np.int64)
        for limit in (-1, 4, 20):
            ours = np.concatenate(jaccard.signatures(a, count(a), limit))
            assert len(np.intersect1d(ours, np.concatenate(jaccard.signatures(b, count(b), limit))))


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(f"word{i}" for i in range(40, 60))), (2, "über\x85ALL, two"), (3, None), (4, "--"), (None, "one TWO three"), (5, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.scan(docs, bench, keep=["doc_id", "n_words"]).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(ROWS) and by_id[1].n_hit == 20 and by_id[1].contaminated and by_id[1]["items"] == ["1"]
    assert by_id[9]["items"] == ["5"] and by_id[9].n_hit == 3 and by_id[5].n_words == 0 and not by_id[5].contaminated
    assert by_id[None].n_hit == 2 and by_id[4].n_hit == 0
    blocks = decontamination.scan(docs, bench, keep=["doc_id"], block_windows=3).collect()
    assert sorted((repr(r) for r in blocks)) == sorted(repr(r) for r in decontamination.scan(docs, bench, keep=["doc_id"]).collect())
    assert decontamination.remove_documents(docs, bench).columns == docs.columns
    assert sorted((r.doc_id for r in decontamination.remove_documents(docs, bench).collect()), key=repr) == sorted([4, 5, 6, 7, 8], key=repr)
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert cut[1].split() == [w for i, w in enumerate(BASE.split()) if not 40 <= i < 60] and cut[8] == LONG and cut[5] is None
    assert decontamination.scan(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.scan(docs, bench.limit(0)).collect())


def test_mixing(docs, none):
    out = mixing.mix(docs, docs.count()).collect()
    assert len(out) == len(ROWS) and mixing.mix(none, 0).count() == 0 and mixing.curriculum(none, 0).count() == 0
    for r in out:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken == r.passes * r["size"] <= 2 * r["size"] and r.target <= 2 * r.source_size
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
    assert {r.source for r in out} == {"a", "b", "c", None}
    rows = mixing.curriculum(docs, docs.count())
    assert rows.columns == docs.columns and rows.count() == sum(r.passes for r in out)


def test_mixing_leaves_other_columns_alone(docs):
    clashing = docs.selectExpr("doc_id", "text", "source", "size AS src", "shard AS segments", "n_words AS weight", "doc_id AS target", "doc_id AS own_level")
    out = mixing.mix(clashing, docs.count())
    assert set(clashing.columns) <= set(out.columns)
    plain = {(r.doc_id, r.taken, r.target) for r in mixing.mix(docs, docs.count()).collect()}
    assert {(r.doc_id, r.taken, r.target) for r in out.collect()} == plain
    before = sorted((tuple(r) for r in clashing.select("doc_id", "src", "segments", "weight", "own_level").collect()), key=repr)
    assert sorted((tuple(r) for r in out.select("doc_id", "src", "segments", "weight", "own_level").collect()), key=repr) == before


def test_schedules_are_inverted(spark):
    knots = ((0.0, 0.0), (0.3, 2.0), (0.7, 0.0), (1.0, 1.0))
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "'s' AS source")
    got = sorted(p for r in mixing.mix(docs, 2000, schedules=(knots,), share=(1, 1)).collect() for p in r.positions)
    area = mixing.integral(knots)
    def upto(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(t - t0, 0.0), t1 - t0)
            total += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return total / area
    assert len(got) == 2000 and max(abs(upto(p) - (i + 0.5) / 2000) for i, p in enumerate(got)) < 1e-9
    with pytest.raises(ValueError):
        mixing.check_schedule(((0.0, 1.0), (0.5, 1.0)))


def test_katz(docs, none):
    how = {"least_partitions": 1, "pairs_per_partition": 10**9}
    got = lm.score(docs, **how).collect()
    assert len(got) == len(ROWS) and lm.score(none).count() == 0
    texts = [(r[0], low(r[1]).encode().split() + [b""]) for r in ROWS]
    learnt = [t for i, t in texts if zlib.crc32(str("null" if i is None else i).encode()) % 7 != 2]
    ones, twos, befores = collections.Counter(w for t in learnt for w in t), collections.Counter(), collections.Counter()
    for t in learnt:
        twos.update(zip([b" ", *t], t))
        befores.update([b" ", *t[:-1]])
    def star(counter):
        of = collections.Counter(counter.values())
        low_counts = lm.discounted(np.array([of[r] for r in range(1, 7)]))
        return lambda c: low_counts[c - 1] if c <= 5 else c - lm.TAIL_DISCOUNT
    s1, s2, n = star(ones), star(twos), sum(ones.values())
    unknown = sum(c - s1(c) for c in ones.values()) / n
    p1 = lambda w: s1(ones[w]) / n if w in ones else unknown
    left, used = collections.Counter(), collections.Counter()
    for (h, w), c in twos.items():
        left[h] += c - s2(c)
        used[h] += p1(w)
    def p(h, w):
        if not befores[h]:
            return p1(w)
        return s2(twos[h, w]) / befores[h] if twos[h, w] else left[h] / befores[h] / (1 - used[h]) * p1(w)
    for h in list(befores)[:50]:
        assert abs(sum(p(h, w) for w in ones) + p(h, b"never seen") - 1) < 1e-9
    want = sorted(((i, len(t), round(sum(math.log10(p(h, w)) for h, w in zip([b" ", *t], t)), 4)) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, round(r.score, 4)) for r in got), key=repr) == want
    pieces = lm.score(docs, batch_tokens=1000, **how).collect()
    assert sorted(((r.doc_id, r.n_tokens, round(r.score, 4)) for r in pieces), key=repr) == want


def test_split_contexts_change_nothing(docs, monkeypatch):
    how = {"least_partitions": 1, "pairs_per_partition": 10**9}
    whole = sorted(((r.doc_id, round(r.score, 6)) for r in lm.score(docs, **how).collect()), key=repr)
    monkeypatch.setattr(lm, "TOKENS_PER_CONTEXT_PART", 5)
    assert sorted(((r.doc_id, round(r.score, 6)) for r in lm.score(docs, **how).collect()), key=repr) == whole


def test_katz_is_one_model_over_all_partitions(docs):
    scores = lambda **how: sorted(((r.doc_id, r.score) for r in lm.score(docs, **how).collect()), key=repr)
    whole = scores(least_partitions=1, pairs_per_partition=10**9)
    for how in ({"least_partitions": 7}, {"least_partitions": 48}, {"least_partitions": 7, "context_tokens": 5}, {"least_partitions": 5, "context_tokens": 1, "batch_tokens": 1000}):
        got = scores(**how)
        # The long text's 300 thousand terms round by their order.
        assert [i for i, _ in got] == [i for i, _ in whole] and np.allclose([x for _, x in got], [x for _, x in whole], rtol=0, atol=1e-5), how


def test_packing():
    for values in (np.arange(5), np.array([], np.int64), np.array([1 << 40, 0]), np.array([0.5, -2.0]), np.array([True, False])):
        assert lm.unpack(lm.pack(values)).tolist() == values.tolist()


def test_folding():
    assert toxicity.fold("Y0U 1d10t, Ídıоt!") == " you idiot idiot "
    assert toxicity.fold("p@th€tic $cum") == " paththic scum " or toxicity.fold("p@thetic") == " pathetic "
    assert toxicity.fold("") == toxicity.fold("...") == " "


def test_exceptions_and_heaviest_terms():
    matcher = toxicity.Matcher(toxicity.Model({" trash ": 3.0, " tra": 2.0}, [" trash can "]))
    assert [w for _, w in matcher.hits(toxicity.fold("trash, tr4sh can, traps"))] == [3.0, 2.0]
    assert toxicity.Matcher(toxicity.Model()).hits(" trash ") == []


def test_toxicity_learns(spark, none):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{rng.integers(200)}x" for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[5:5] = [["idiot", "1d1ot", "lowerung"][i % 3]] * 2
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic) if i != 7 else None))
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97 and out[None] < 0.5
    empty = toxicity.learn(none, labels.limit(0))
    assert empty.terms == {} and toxicity.score(none, empty).count() == 0


def test_exceptions_are_learnt(spark):
    rows = [(" an idiot savant sang ", 0)] * 4 + [(" you idiot ", 1)] * 5 + [(" idiot savant ", 0)]
    phrases = toxicity.choose_exceptions(spark.createDataFrame(rows, "folded string, toxic int"), {" idiot ": 4.0})
    assert phrases == [" an idiot ", " idiot savant "]


def test_warc_round_trip(spark):
    long = "ab" * 600
    rows = [(1, "http://a\r\nb%", long), (2, None, long), (2, None, long), (3, "u", ""), (4, "u", None), (None, "u", long), (5, "u", "short"), (6, "u", "short"), (7, "u", "ü" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(pages, payloads=True).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out), key=repr)
    want = sorted(((i, "revisit" if h == long and i != 2 else "response", 2 if h == long and i != 2 else None, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows), key=repr)
    assert got == want and all(bytes(r.payload).decode() == (dict((i, h or "") for i, _, h in rows)[r.page_id]) for r in out if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_not_joined(spark):
    rows = [(i, "short", f"page {i}", "d", "n") for i in range(200)] + [(i, "long", "x" * 1000, "d", "n") for i in range(200, 203)]
    pages = spark.createDataFrame(rows, "page_id long, digest string, html string, refers_to string, id string")
    planned = warc.plan_revisits(pages, "page_id", "html")
    got = {r.id: (r.revisits, r.refers_to) for r in planned.collect()}
    assert got == {i: (i in (200, 201), 202 if i in (200, 201) else None) for i in range(203)}
    assert warc.round_trip(pages).count() == 203


def test_warc_reader_finds_damage():
    records = [warc.format_record(str(i), None, b"x" * i, None, False) for i in (0, 5, 400_000)]
    archive = b"".join(warc.gzip_member(r) for r in records)
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(archive))] == [0, 5, 400_000]
    short = warc.format_record("1", None, b"payload", None, False)
    for bad in (archive[:-9], warc.gzip_member(short.replace(b"payload", b"pay1oad")), warc.gzip_member(short + short), warc.gzip_member(short.replace(b"Length: 7", b"Length: 9")), b"plain text"):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(bad)))


def test_chat_turns(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x\\"), (2, 0, "assistant", "<turn user>\n"), (None, None, "user", ""), (3, 0, "a>\\N\nb", "t")]
    log = chat.events_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv: r for r in chat.digests(chat.segments(log, folds=False)).collect()}
    assert set(out) == {-7, 1, 2, 3, None} and out[2].n_turns == 2
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and out[-7].loss_sha256 == sha(said) and out[-7].loss_chars == len(said)
    assert out[1].turns_sha256 == sha("user\n\nassistant\nb\n") and out[3].turns_sha256 == sha("a>\\N\nb\nt\n") and out[None].loss_sha256 == sha("")
    assert chat.digests(chat.segments(log.limit(0), folds=False)).count() == 0


def test_repeated_chat_turns_keep_their_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, None, "t"), (2, 0, "", "t"), (2, 0, None, "t"), (3, None, "x\x00y", "z"), (3, None, "x", "y\x00z")]
    log = chat.events_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    turns = collections.defaultdict(list)
    for r in chat.segments(log, folds=False).orderBy("conv", "number").collect():
        turns[r.conv].append(chat.parse(r.segment))
    assert turns == {1: [("user", "q")] + [("assistant", "a")] * 3, 2: [(None, "t"), (None, "t"), ("", "t")], 3: [("x", "y\x00z"), ("x\x00y", "z")]}
    got = {r.conv: r for r in chat.digests(chat.segments(log, folds=False)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\n" + b"assistant\na\n" * 3).hexdigest() and got[1].n_turns == 4


def test_chat_events_fold(spark):
    events = [
        (1, 0, 0, "open", "user", "hi "), (1, 1, 0, "delta", None, "there"), (1, 2, 1, "open", "assistant", None), (1, 3, 1, "delta", None, "first"),
        (1, 4, 2, "open", "user", "later"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "second"), (1, 7, 2, "open", "user", "again"),
        (1, 8, 0, "edit", None, "hello"), (1, 9, 3, "open", "assistant", "gone"), (1, 10, 3, "drop", None, None), (2, 0, 0, "open", "user", "left"), (2, 1, 0, "drop", None, None),
        (3, 0, 0, "open", "user", "q"), (3, 1, 1, "open", "assistant", "old"), (3, 2, 0, "regenerate", None, None), (3, 3, 0, "delta", None, "new"),
    ]
    log = spark.createDataFrame(events, "conv long, seq long, turn long, kind string, role string, text string")
    got = [(r.conv, chat.parse(r.segment)) for r in chat.segments(log).orderBy("conv", "number").collect()]
    assert got == [(1, ("user", "hello")), (1, ("assistant", "second")), (1, ("user", "again")), (3, ("user", "new"))]


def test_made_logs_fold_back_into_their_turns(spark):
    rows = [
        (-7, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "answer"), (1, 0, "user", None), (1, 2, "user", "q"), (1, 3, "assistant", "x"), (2, 0, None, "t"), (2, 0, "", "t"), (2, 0, None, "t"),
        (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (3, None, "user", "first"), (None, None, "assistant", ""), (4, -3, "system", "é" * 100_001), (4, 9, "assistant", "ab\n" * 70_000),
    ]
    log = chat.log_of_turns(spark.createDataFrame([(*r, "c", "s") for r in rows], "conv_id long, turn long, role string, text string, conv string, seq string").repartition(3))
    kinds = collections.Counter(r.kind for r in log.collect())
    assert all(kinds[k] for k in ("open", "delta", "edit", "regenerate", "drop"))
    assert log.count() == log.select("conv", "seq").distinct().count()
    turns = collections.defaultdict(list)
    for r in chat.segments(log.orderBy("kind")).orderBy("conv", "number").collect():
        turns[r.conv].append(chat.parse(r.segment))
    want = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        want[conv].append((role, text or ""))
    assert turns == want
    assert chat.log_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0)).count() == 0


def test_escapes_are_reversible():
    for text in ("", "\\", "<turn a>\n", "</turn>\n", "\\<", "### x", "é\\\\#<>"):
        for role in (None, "user", "\\N", "a\nb>"):
            segment, start, end = chat.render(role, text)
            assert chat.parse(segment) == (role, text) and chat.unescape(segment[start:end]) == text
    with pytest.raises(ValueError):
        chat.parse("<turn a>\nx</turn>\ny</turn>\n")


def test_vote_estimate_against_truth():
    rng = np.random.default_rng(3)
    kind = rng.choice(4, 40_000, p=[0.8, 0.1, 0.06, 0.04])
    alarm = np.array([[0.01, 0.005, 0.0], [0.98, 0.3, 0.0], [0.05, 0.98, 0.5], [0.1, 0.2, 0.98]])
    votes = np.where(rng.random((len(kind), 3)) < alarm[kind], weak.BAD, weak.GOOD)
    votes[rng.random(votes.shape) < 0.2] = weak.ABSTAIN
    found, counts = np.unique((votes << (2 * np.arange(3))).sum(1), return_counts=True)
    model = weak.fit_votes(found, counts, 3)
    assert abs(model.shares[0] - 0.8) < 0.03 and np.abs(model.bad[0] - alarm[0]).max() < 0.01
    truth = [((votes[:, i] == weak.GOOD) == (kind == 0))[votes[:, i] != weak.ABSTAIN].mean() for i in range(3)]
    assert np.abs(model.accuracies(found, counts) - truth).max() < 0.03
    # Bayes by hand for every pattern.
    for packed in found:
        odds = model.shares.copy()
        for i, vote in enumerate(weak.unpack(np.array([packed]), 3)[0]):
            odds *= {weak.ABSTAIN: 1.0, weak.GOOD: 1 - model.bad[:, i], weak.BAD: model.bad[:, i]}[vote]
        assert abs(model.posterior(np.array([packed]))[0] - odds[0] / odds.sum()) < 1e-9


def test_vote_estimate_of_labellers_that_err_beats_any_vote():
    """Labellers that call one good text in twenty or fifty bad: the estimate allows for it, and does better than any single bad vote would."""
    rng = np.random.default_rng(5)
    kind = rng.choice(3, 60_000, p=[0.8, 0.12, 0.08])
    alarm = np.array([[0.05, 0.05, 0.05, 0.02, 0.02], [0.9, 0.85, 0.1, 0.9, 0.05], [0.1, 0.1, 0.9, 0.05, 0.9]])
    votes = np.where(rng.random((len(kind), 5)) < alarm[kind], weak.BAD, weak.GOOD)
    votes[rng.random(votes.shape) < 0.1] = weak.ABSTAIN
    packed = (votes << (2 * np.arange(5))).sum(1)
    found, counts = np.unique(packed, return_counts=True)
    model = weak.fit_votes(found, counts, 5)
    right = np.mean((model.posterior(packed) >= 0.5) == (kind == 0))
    any_vote = np.mean(~(votes == weak.BAD).any(1) == (kind == 0))
    assert right > any_vote + 0.03, (right, any_vote)
    assert np.abs(model.bad[0] - alarm[0]).max() < 0.05


def test_measurements_by_hand():
    """Each share from words and lines, without tables of bytes."""
    texts = ["", " \n ", "One two! #three\none TWO.\none TWO.\n\nEnd) of it?", "a b c d e f g h " * 6, "ÄRGER über alles. $$$ <b> ABC!\x0bx"]
    hasher = WordHasher()
    for text, hashes in zip(texts, hasher.each([t.encode() for t in texts])):
        words, got = [w for w in WORD.findall(text)], dict(zip(("words", *weak.SHARES), weak.measure(text.encode(), hashes)))
        n = len(words)
        assert got["words"] == n
        if not n:
            assert not any(got.values())
            continue
        lines = [x.rstrip("\x20\t\x0b\x0c\r") for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
        again = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = {
            "symbols": sum(c in "#*$%&|<>{}[]=_~^\\" for c in text) / n,
            "repeated": len(again) / n,
            "same_lines": 1 - len(set(lines)) / len(lines),
            "distinct": len(set(words)) / n,
            "commonest": max(collections.Counter(words).values()) / n,
            "upper": sum("A" <= c <= "Z" for c in text) / max(sum(c.isascii() and c.isalpha() for c in text), 1),
            "shouts": text.count("!") / n,
            "ended_lines": sum(x[-1] in ".!?\"')" for x in lines) / len(lines),
            "stops": len(re.findall(r"[.!?][\"')]*(?=[ \t-\r]|\Z)", text)) / n,
            "word_length": sum(len(w.encode()) for w in words) / n / 16,
        }
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()), (text, got, want)


def test_scorer_against_newton_steps():
    """The sparse, blocked fit against a dense one to convergence, and scores against dense products."""
    rng = np.random.default_rng(2)
    rows = [(rng.choice(40, 6, replace=False).astype(np.int32), rng.random(6).astype(np.float32)) for _ in range(400)]
    dense = np.zeros((400, 41))
    for i, (places, values) in enumerate(rows):
        dense[i, places] = values
    dense[:, 40] = 1
    targets = 1 / (1 + np.exp(-(dense @ rng.normal(0, 2, 41))))
    model, ridge = weak.fit_scorer(rows, targets, ridge=1e-2, rounds=3000), np.append(np.full(40, 1e-2), 0)
    beta = np.zeros(41)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-dense @ beta))
        slope = dense.T @ (chance - targets) / 400 + ridge * beta
        beta -= np.linalg.solve((dense * (chance * (1 - chance))[:, None]).T @ dense / 400 + np.diag(ridge), slope)
    assert np.abs(model.weights[:40] - beta[:40]).max() < 1e-3 and abs(model.base - beta[40]) < 1e-3 and not model.weights[40:].any()


def test_quality_learns_without_labels(spark, docs, none):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        words = [f"w{rng.integers(3000)}" for _ in range(90)]
        if i % 6 == 0:
            words = [w + "%%%" for w in words] if i % 12 else ["spam", "eggs", "ham"] * 30
        rows.append((i, ". ".join(" ".join(words[j : j + 9]) for j in range(0, 90, 9)) + "."))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    model = weak.learn(made)
    out = {r.doc_id: r.score for r in weak.score(made, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i] >= 0.5) == (i % 6 > 0) for i in held]) > 0.97
    scored = weak.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored) and all(r.posterior < 0.5 for r in scored if not r.n_words)
    empty = weak.learn(none)
    assert weak.score(none, empty).count() == 0 and all(r.score == 0.5 for r in weak.score(docs, empty).collect())
    assert weak.score(docs, weak.learn(docs, most_rows=0)).count() == len(ROWS)
