import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe, components, consensus, frequency, grouped_split, leakage, near_duplicates, packing, pii, shingles, sketch_join, stuffing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- encoding --------------------------------------------------------------------------------

TEXTS = [None, "", " ", "\n\n\t", "It's 3 o'clock, isn't it?", "naïve façade 订单 🙂🙂", "<|endoftext|> x", "a\x1cb \x1d c\x85 d　e", "x" * 5_000, "ab" * 3_000, "  two  spaces ", "١٢٣ ½ Ⅷ"]


def test_encoding_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = bpe.encoder(bpe.vocabulary_path())
    for text in TEXTS:
        assert e.encode(text) == (t.encode(text, add_special_tokens=False).ids if text else [])
        assert e.decode(e.encode(text)).decode() == (text or "") and e.count(text) == len(e.encode(text))


def test_encoding_of_a_table(spark):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, None, "again")], "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(d)
    assert got.count() == len(TEXTS) + 1 and [r["ids"] for r in got.where("doc_id in (0, 1)").collect()] == [[], [], []]
    assert bpe.encode_corpus(d.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------------------


def test_hilbert_neighbours_are_one_step_apart():
    import numpy as np

    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert (abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packing_keeps_everything_once(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * r.choice((0, 1, 30, 300, 3_000))) for i in range(60)] + [(99, None), (5, "again")], "doc_id bigint, text string")
    profiles = spark.createDataFrame([("s", 128), ("l", 1_000), ("none", None), ("zero", 0)], "profile string, capacity_tokens int")
    got = packing.pack_documents(docs, profiles).collect()
    size = {d["doc_id"]: d["n"] for d in bpe.count_tokens(docs.where("text <> ''"), ["doc_id"]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    for profile, capacity in (("s", 128), ("l", 1_000)):
        mine = [g for g in got if g["profile"] == profile]
        for doc, n in size.items():
            assert sum(g["length"] for g in mine if g["doc_id"] == doc) == n
        by = {}
        for g in mine:
            by.setdefault(g["container"], []).append((g["container_offset"], g["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert all(g["piece_start"] == g["piece"] * capacity and (g["length"] == capacity or g["piece"] == 0 or g["length"] < capacity) for g in mine)
        assert len(by) <= sum(size.values()) / capacity * 1.1 + 2
    assert {g["profile"] for g in got} == {"s", "l"}
    assert packing.pack_documents(docs.limit(0), profiles).count() == 0


def test_packing_follows_the_curve(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 20_000)
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 120)))) for i in range(900)] + [(9_000 + i, ("one page " * 64).strip()) for i in range(300)], "doc_id bigint, text string")
    profiles = spark.createDataFrame([("s", 512), ("l", 2_048)], "profile string, capacity_tokens int")
    packed = packing.pack_documents(docs, profiles)
    checks = [r.asDict() for r in packing.packing_checks(packed).collect()]
    assert all(c["documents"] == 1_200 and not c["torn"] and not c["holes"] and not c["overfull"] and c["near"] for c in checks) and len(checks) == 2
    assert {x["profile"]: x["apart"] < 2 * packing.WINDOW and x["fill"] > 0.9 for x in packing.packing_report(packed).collect()} == {"s": True, "l": True}


def test_window_takes_what_leaves_the_least_room():
    window = packing.Window(100, 5)
    assert [window.add(k, n) for k, n in enumerate([60, 30, 25, 40])] == [None] * 4
    assert window.add(4, 39) == [(0, 0), (3, 60)] and window.add(5, 100) == [(5, 0)]
    assert window.fill() == [(1, 0), (4, 30), (2, 69)] and not window.sizes


# --- junk pages ------------------------------------------------------------------------------

NORMAL = "The agent reads the order before it changes anything. The user confirms the refund, and the tool returns the new state. This is checked against the policy of the shop. "


@pytest.mark.parametrize("text,junk", [
    (None, False), ("", False), ("  \n " * 100, False), ("cheap lamps online", False), (NORMAL * 3, False), (NORMAL * 300, False),
    ("buy cheap lamp online best lamp price " * 20, True),
    ("\n".join(f"[best lamp {i}](https://shop{i}.example/lamp/{i})" for i in range(30)), True),
    (" ".join(f"#Lamp{i % 7} #Sale #Blue" for i in range(30)), True),
    ("\n".join(f"Home > Lamps > Lamp {i % 5}" for i in range(40)), True),
    (NORMAL * 3 + "\n#lamp #sale https://shop.example/x", False),
    (NORMAL + "\n" + "buy cheap lamp online best lamp price " * 20, True),
    ("\n".join(f'id: call_{i}\nname: get_order\narguments: {{"order_id": "#W{i}"}}' for i in range(40)), False),
])
def test_junk(text, junk):
    assert (stuffing.junk_share(text) > stuffing.SHARE) == junk


def test_both_coverage_and_want_of_clauses_decide(monkeypatch):
    r = random.Random(6)
    made = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    glossary = "\n".join(f"{a} {b}" for a, b in zip(made[::2], made[1::2]))  # without sentences and repeats
    keywords = "\n".join(f"{r.choice(made[:8])} {r.choice(made[:8])}" for _ in range(200))
    menu = "\n".join(f"{r.choice(made[:3])} :: {a} / {b}" for a, b in zip(made[::2], made[1::2]))
    chorus = "The agent reads the order before it changes anything.\n" * 40  # repeats, of sentences
    assert [stuffing.junk_share(t) > stuffing.SHARE for t in (glossary, keywords, menu, chorus)] == [False, True, True, False]
    monkeypatch.setattr(stuffing, "covered_by_repeats", lambda text: bytearray(b"\1" * len(text)))
    assert [stuffing.junk_share(t) > stuffing.SHARE for t in (glossary, keywords, chorus)] == [True, True, False]
    monkeypatch.setattr(stuffing, "covered_by_repeats", lambda text: bytearray(len(text)))
    assert [stuffing.junk_share(t) for t in (glossary, keywords, menu)] == [0.0] * 3


def test_repeats_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        s = [r.choice("abc") for _ in range(r.randint(0, 25))]
        want = []
        for i in range(len(s)):
            best = 0
            for n in range(1, i + 2):
                part = s[i - n + 1 : i + 1]
                if sum(s[j : j + n] == part for j in range(len(s) - n + 1)) > 1:
                    best = n
            want.append(best)
        assert stuffing.SuffixAutomaton(s).repeats() == want


def test_junk_pages_of_a_table(spark):
    d = spark.createDataFrame([(1, "buy cheap lamp online best lamp price " * 20, 0.1), (2, None, 0.1), (1, "buy cheap lamp online best lamp price " * 20, 0.1)], "doc_id bigint, text string, share double")
    assert [r["doc_id"] for r in stuffing.junk_pages(d).collect()] == [1, 1]
    assert stuffing.junk_pages(d.limit(0)).count() == 0


# --- consensus -------------------------------------------------------------------------------


def votes_of(spark, data):
    return spark.createDataFrame(data, "task_id string, label string, reviewer_id string, reviewed_at timestamp, ingested_at timestamp")


def test_valid_votes(spark):
    from datetime import datetime as d

    a, b = d(2031, 1, 1), d(2031, 1, 2)
    got = consensus.valid_votes(votes_of(spark, [("1", " pass\t", "RV-1 ", a, a), ("1", "FAIL", "rv-1", b, a), ("1", "UNSURE", "rv-1", b, b), ("1", "PASS", " \t", b, b), (None, "PASS", "x", b, b), ("1", None, "y", b, b), ("2", "PASS", None, b, b)]), "review_decisions", "label")
    assert rows(got) == [("review_decisions", "1", "rv-1", "FAIL")]


def test_reliable_minority_beats_plain_count(spark):
    r = random.Random(5)
    data, truth = [], {}
    for t in range(240):
        truth[str(t)] = r.choice(["PASS", "FAIL", "REVIEW"])
        for k in range(7):
            good = k < 3
            wrong = r.choice([x for x in consensus.LABELS["review_decisions"] if x != truth[str(t)]])
            data.append(("review_decisions", str(t), f"r{k}", truth[str(t)] if r.random() < (0.95 if good else 0.25) else wrong))
    votes = spark.createDataFrame(data, "review_kind string, task_id string, reviewer string, label string")
    rel = consensus.reliabilities(votes)
    by = {x["reviewer"]: x["reliability"] for x in rel.collect()}
    assert min(by[f"r{k}"] for k in range(3)) > 0.75 > 0.3 > max(by[f"r{k}"] for k in range(3, 7))
    got = {x["task_id"]: x["label"] for x in consensus.consensus(votes, rel).collect()}
    assert sum(got[t] == v for t, v in truth.items()) / len(truth) > 0.95


@pytest.mark.parametrize("mean", [0.25, 0.7])
def test_reliabilities_converge_to_the_true_ones(spark, mean):
    r = random.Random(3)
    true = {f"a{j}": max(-0.3, min(0.95, r.gauss(mean, 0.2))) for j in range(25)}
    labels, shares, data = ["PASS", "FAIL", "REVIEW"], [0.5, 0.3, 0.2], []
    for i in range(6_000):
        truth = r.choices(labels, shares)[0]
        for a in r.sample(list(true), 5):
            x = r.random()
            data.append(("review_decisions", f"t{i}", a, truth if x < true[a] else r.choice([q for q in labels if q != truth]) if x < -true[a] else r.choices(labels, shares)[0]))
    votes = spark.createDataFrame(data, "review_kind string, task_id string, reviewer string, label string").persist()
    one, more = ({x["reviewer"]: x["reliability"] for x in consensus.reliabilities(votes, residual).collect()} for residual in (1e-4, 1e-6))
    assert max(abs(one[a] - more[a]) for a in true) < 1e-3
    assert sum(abs(more[a] - true[a]) for a in true) / len(true) < 0.04
    assert all(more[a] < 0.1 for a in true if true[a] < 0)


def test_annotators_alone_or_without_agreement(spark):
    kind = "review_kind string, task_id string, reviewer string, label string"
    alone = spark.createDataFrame([("review_decisions", "1", "a", "PASS"), ("review_decisions", "2", "b", "FAIL")], kind)
    assert {x["reliability"] for x in consensus.reliabilities(alone).collect()} == {consensus.PRIOR}
    apart = spark.createDataFrame([("review_decisions", str(t), a, x) for t in range(20) for a, x in (("a", "PASS"), ("b", "FAIL"))], kind)
    assert {x["reliability"] for x in consensus.reliabilities(apart).collect()} == {0.0}
    assert rows(consensus.consensus(apart, consensus.reliabilities(apart)).select("label").distinct()) == [("FAIL",)]
    same = spark.createDataFrame([("review_decisions", str(t), a, "PASS") for t in range(3) for a in "ab"], kind)
    assert rows(consensus.consensus(same, consensus.reliabilities(same)).select("label").distinct()) == [("PASS",)]


def test_consensus_of_nothing(spark):
    empty = spark.createDataFrame([], "review_kind string, task_id string, reviewer string, label string")
    assert consensus.consensus(empty, consensus.reliabilities(empty)).count() == 0


# --- components and splits -------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


TASKS = "task_id string, group_ids array<string>"


def table_at(spark, tmp_path):
    return grouped_split.SplitTable(spark, f"file://{tmp_path}/table")


def test_split_keeps_groups_and_proportions(spark, tmp_path):
    data = [(f"t{i}", [f"u:{i // 3}", " ", None]) for i in range(300)] + [("lone", None), (None, ["u:1"])]
    d = spark.createDataFrame(data, TASKS)
    table = table_at(spark, tmp_path)
    issued = {r["task_id"]: (r["component"], r["split"]) for r in table.update(d).collect()}
    out = {r["task_id"]: (r["component"], r["split"]) for r in table.rows().collect()}
    assert issued == out
    assert len(out) == 301 and all(len({out[f"t{3 * k + j}"] for j in range(3)}) == 1 for k in range(100))
    n = {s: sum(x[1] == s for x in out.values()) for s in grouped_split.TARGETS}
    assert abs(n["TRAIN"] - 241) <= 6 and abs(n["VALIDATION"] - 30) <= 6 and abs(n["TEST"] - 30) <= 6


def test_a_batch_met_again_changes_nothing(spark, tmp_path):
    d = spark.createDataFrame([(f"t{i}", [f"u:{i // 3}"]) for i in range(30)] + [("lone", None)], TASKS)
    table = table_at(spark, tmp_path)
    table.update(d)
    first, sizes = rows(table.rows()), rows(table.tables().splits())
    assert table.update(d).count() == 0 and table.update(d.limit(0)).count() == 0
    assert rows(table.rows()) == first and rows(table.tables().splits()) == sizes and table.version() == 3
    assert sum(x[2] for x in sizes) == 31


def test_components_keep_their_split_and_conflicts_are_quarantined(spark, tmp_path):
    table = table_at(spark, tmp_path)
    table.update(spark.createDataFrame([(f"{c}{j}", [f"u:{c}"]) for c in "abcdefghijklmnop" for j in range(3)], TASKS))
    before = {r["task_id"]: r["split"] for r in table.rows().collect()}
    train, other = (next(c for c in "abcdefghijklmnop" if (before[f"{c}0"] == "TRAIN") == is_train) for is_train in (True, False))
    twin = next(c for c in "abcdefghijklmnop" if c != train and before[f"{c}0"] == "TRAIN")
    # an old record with a new entry, a new one under it, and two components of one split that merge
    issued = {r["task_id"]: r["split"] for r in table.update(spark.createDataFrame([(f"{train}0", ["x:1"]), ("new", ["x:1"]), ("twin", [f"u:{train}", f"u:{twin}"])], TASKS)).collect()}
    assert issued["new"] == issued["twin"] == "TRAIN" and set(issued.values()) == {"TRAIN"} and len(issued) == 5
    out = {r["task_id"]: (r["component"], r["split"]) for r in table.rows().collect()}
    assert out["new"] == out[f"{twin}2"] == out[f"{train}1"] and all(out[t][1] == s for t, s in before.items())
    # a bridge between two splits: all of its rows are issued again, later ones join them
    issued = {r["task_id"]: r["split"] for r in table.update(spark.createDataFrame([("bridge", ["x:1", f"u:{other}"])], TASKS)).collect()}
    assert set(issued.values()) == {grouped_split.QUARANTINE} and {"bridge", "new", f"{other}0", f"{train}0", f"{twin}0"} <= set(issued)
    assert [r["split"] for r in table.update(spark.createDataFrame([("late", [f"u:{twin}"])], TASKS)).collect()] == [grouped_split.QUARANTINE]
    out = {r["task_id"]: (r["component"], r["split"]) for r in table.rows().collect()}
    assert out["late"] == out[f"{other}0"] == out["bridge"] and len(out) == 48 + 4
    assert sum(r["size"] for r in table.tables().splits().collect()) == len(out)


def test_batches_give_the_components_of_the_whole(spark, tmp_path):
    r = random.Random(8)
    data = [(f"t{i}", [f"u:{r.randrange(60)}" for _ in range(r.choice((0, 1, 1, 2)))]) for i in range(90)]
    table = table_at(spark, tmp_path)
    for part in (data[:30], data[30:60], data[60:]):
        table.update(spark.createDataFrame(part, TASKS))
    got = {}
    for x in table.rows().collect():
        got.setdefault(x["component"], set()).add(x["task_id"])
    groups = []
    for t, entries in data:
        joined = [g for g in groups if g[1] & set(entries)]
        groups = [g for g in groups if g not in joined] + [({t}.union(*[g[0] for g in joined]), set(entries).union(*[g[1] for g in joined]))]
    assert sorted(map(sorted, got.values())) == sorted(sorted(g[0]) for g in groups)


# --- near duplicates -------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(400)]


def messages(spark, texts):
    return spark.createDataFrame([(i, c, 0, "user", t, "x") for i, (c, t) in enumerate(texts)], "event_id bigint, candidate_id string, msg_index int, role string, content string, sketch string")


def brute_groups(texts, threshold, width=3):
    sets = {}
    for c, t in texts:
        w = shingles.WORD.findall((t or "").lower())
        sets[c] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    parent = {c: c for c in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * union:
                parent[root(b)] = root(a)
    return {(a, b) for a in names for b in names if a < b and root(a) == root(b)}


def edited(r, words, share):
    return " ".join(w if r.random() > share else r.choice(WORDS) for w in words)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    texts = []
    for k in range(40):
        base = [r.choice(WORDS) for _ in range(120)]
        for j in range(r.choice((1, 1, 2, 4))):
            texts.append((f"c{k:02d}-{j}", edited(r, base, 0.03 * j)))
    mass = [r.choice(WORDS) for _ in range(120)]  # a mass of near-copies, a third of all
    texts += [(f"m{j:02d}", edited(r, mass, 0.03)) for j in range(45)] + [("copy1", "a b c d e f"), ("copy2", "A  b, c d e f!"), ("short", "a b"), ("empty", "")]
    got = {tuple(x) for x in near_duplicates.group_pairs(near_duplicates.conversation_groups(messages(spark, texts))).collect()}
    want = brute_groups(texts, 0.6)
    assert ("copy1", "copy2") in got and got == want


def test_originals_with_many_edited_copies(spark):
    r = random.Random(5)
    texts = []
    for name, share in (("a", 0.07), ("b", 0.085)):  # each near its original, to most others it isn't
        base = [f"{name}{r.randrange(5_000)}" for _ in range(300)]
        copies = [" ".join(w if r.random() > share else f"x{r.randrange(5_000)}" for w in base) for _ in range(220)]
        texts += [(f"{name}{j:03d}", t) for j, t in enumerate([" ".join(base), *copies])]
    groups = near_duplicates.conversation_groups(messages(spark, texts))
    got = {tuple(x) for x in near_duplicates.group_pairs(groups).collect()}
    assert got == brute_groups(texts, 0.6) and len(got) > 30_000


@pytest.mark.parametrize("block", [4_000, 7])
def test_no_link_lost_in_groups_of_independent_edits(spark, monkeypatch, block):
    monkeypatch.setattr(sketch_join, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "PAIR_BLOCK", 5)
    r = random.Random(17)
    texts = {}
    for size in (2, 10, 18, 30, 60):
        base = [f"w{r.randrange(900)}" for _ in range(400)]
        texts |= {f"g{size}-{j:02d}": " ".join(w if r.random() > 0.045 else f"x{r.randrange(900)}" for w in base) for j in range(size)}
    close = brute_pairs(texts)
    groups = near_duplicates.conversation_groups(messages(spark, list(texts.items())))
    links = {c: 0 for c in texts}
    for pair in close:
        for c in pair:
            links[c] += 1
    assert {x["candidate_id"]: x["links"] for x in groups.collect()} == links and len(close) > 500
    assert {tuple(x) for x in near_duplicates.group_pairs(groups).collect()} == brute_groups(list(texts.items()), 0.6)


def test_blocks_of_a_list_all_meet_once(spark):
    import numpy as np

    bits = {f"s{k}": 0 for k in range(sketch_join.BITS // 64)}
    made = spark.createDataFrame([{"doc": 7 + d, "n": 5, "values": [1, 2], "blocks": [4, 1], **bits} for d in range(50)], f"doc bigint, n int, {sketch_join.SKETCH}")
    met = {1: {}, 2: {}}
    listed = sketch_join.inverted_lists(made).collect()
    for a in listed:
        for b in listed:
            if (a["value"], a["group"]) == (b["value"], b["group"]) and a["doc"] < b["doc"] and (a["home"] != b["home"] or a["home"] < 0):
                met[a["value"]][a["doc"], b["doc"]] = met[a["value"]].get((a["doc"], b["doc"]), 0) + 1
    assert all(len(m) == 50 * 49 // 2 and set(m.values()) == {1} for m in met.values())
    assert sketch_join.least_agreement(0.6) > sketch_join.BITS // 2 and len(sketch_join.bits_of(np.arange(9))) == sketch_join.BITS // 64


def test_texts_from_the_same_phrases_seldom_meet(spark):
    r = random.Random(23)
    phrases = [" ".join(f"p{k}x{j}" for j in range(6)) for k in range(400)]
    texts = [(f"c{i:03d}", " ".join(r.sample(phrases, 40))) for i in range(600)]
    made = near_duplicates.conversation_sketches(messages(spark, texts), 0.6).select("values").collect()
    lists = Counter(v for row in made for v in row["values"])
    assert sum(c * (c - 1) // 2 for c in lists.values()) < sum(lists.values()) / 2


def test_wider_keys_for_more_sets_lose_no_more():
    widths = [sketch_join.key_width(10**k, 0.6) for k in range(3, 11)]
    assert widths == sorted(widths) and widths[0] == 3 and widths[-1] > 5
    for sets, width in zip((10**k for k in range(3, 11)), widths):
        keys = sketch_join.keys_needed(0.6, width)
        assert (1 - 0.6**width) ** keys <= sketch_join.LOST and sets / 2 * keys * sketch_join.BACKGROUND**width < 20 * keys


def test_wide_keys_in_rounds_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "key_width", lambda *_: 5)
    assert sketch_join.keys_needed(0.6, 5) > 2 * sketch_join.ROUND
    r = random.Random(29)
    texts = []
    for size in (1, 3, 12, 25):
        base = [f"w{r.randrange(900)}" for _ in range(300)]
        texts += [(f"g{size}-{j:02d}", " ".join(w if r.random() > 0.045 else f"x{r.randrange(900)}" for w in base)) for j in range(size)]
    texts += [("few1", "a b c d e f"), ("few2", "a b c d e f g"), ("few3", "v a b c d e f g")]
    links = Counter(c for pair in brute_pairs(dict(texts)) for c in pair)
    groups = near_duplicates.conversation_groups(messages(spark, texts))
    assert {x["candidate_id"]: x["links"] for x in groups.collect()} == {c: links[c] for c, _ in texts} and links["few1"] > 0 and len(links) > 30


def test_frequent_values_are_found_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(frequency, "CHUNK", 64)
    monkeypatch.setattr(frequency, "SHARE_BITS", 6)
    sets = spark.createDataFrame([([7, 1_000 + j, 2_000 + j],) for j in range(300)], "tokens array<bigint>")
    ranks = frequency.value_ranks(sets, "tokens").value
    assert ranks.values.tolist() == [7] and ranks.levels[0] == int(4 * 8.2288) + 1


def test_conversations_are_joined_in_order_once(spark):
    kind = "event_id bigint, candidate_id string, msg_index int, role string, content string"
    data = [(2, "a", 1, "assistant", "three four"), (1, "a", 0, "user", "one two"), (1, "a", 0, "user", "one two"), (3, "a", 2, "tool", "never"), (4, "b", 0, "user", "one two three four"), (5, "b", 1, "user", None), (6, None, 0, "user", "x y z")]
    groups = near_duplicates.conversation_groups(spark.createDataFrame(data, kind))
    assert rows(near_duplicates.group_pairs(groups)) == [("a", "b")]
    assert near_duplicates.conversation_groups(spark.createDataFrame([], kind)).count() == 0


def test_links_counts_all_direct_links(spark):
    r = random.Random(9)
    base = [f"b{r.randrange(5_000)}" for _ in range(300)]
    texts = {"base": " ".join(base)} | {f"c{j:03d}": " ".join(w if r.random() > 0.05 else f"x{r.randrange(5_000)}" for w in base) for j in range(100)}
    want = dict.fromkeys(texts, 0)
    for pair in brute_pairs(texts):
        for c in pair:
            want[c] += 1
    texts["again"], want["again"] = texts["base"], want["base"]  # a copy adds no link
    groups = near_duplicates.conversation_groups(messages(spark, list(texts.items())))
    got = {x["candidate_id"]: x["links"] for x in groups.collect()}
    assert {c: (n, want[c]) for c, n in got.items() if n != want[c]} == {} and len(got) == len(want) and max(want.values()) > 20


# --- overlaps across splits ------------------------------------------------------------------


def test_winnowing_shares_a_seed_of_any_long_run():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(50):
        run = r.integers(0, 2**60, 6).astype(np.uint64)
        a, b = (np.concatenate([r.integers(0, 2**60, r.integers(0, 20)).astype(np.uint64), run, r.integers(0, 2**60, r.integers(0, 20)).astype(np.uint64)]) for _ in range(2))
        ha, hb = shingles.shingle_hashes(a), shingles.shingle_hashes(b)
        assert set(ha[leakage.winnow(ha)].tolist()) & set(hb[leakage.winnow(hb)].tolist())
        in_a, in_b = leakage.chain(a, b, frequency.Ranks(np.zeros(0, np.int64), np.zeros(0, np.int64)))
        assert in_a.sum() == in_b.sum() >= 6


def test_windows_of_texts_with_the_similarity_meet_as_often_as_told():
    import numpy as np

    r = np.random.default_rng(3)
    windows, shared = leakage.guarantee(0.6)
    assert windows[1] == 1 and windows[200] == leakage.WINDOW and (np.diff(shared) >= 0).all() and shared[400] > 20
    of = frequency.Ranks(np.zeros(0, np.int64), np.zeros(0, np.int64))
    tried = 0
    for _ in range(600):
        n = int(r.integers(3, 160))
        a = r.integers(0, 2**62, n).astype(np.uint64)
        b = a.copy()
        for _ in range(int(r.integers(0, 1 + n // 11))):  # a word changed, added or left out, or two parts exchanged
            at, kind = int(r.integers(0, len(b))), r.integers(0, 4)
            new = r.integers(0, 2**62, 1).astype(np.uint64)
            b = np.concatenate([b[:at], new, b[at + 1 :]] if kind == 0 else [b[:at], new, b[at:]] if kind == 1 else [b[:at], b[at + 1 :]] if kind == 2 and len(b) > 3 else [b[at:], b[:at]])
        ha, hb = shingles.shingle_hashes(a), shingles.shingle_hashes(b)
        union = len(set(ha.tolist()) | set(hb.tolist()))
        if union and len(set(ha.tolist()) & set(hb.tolist())) >= 0.6 * union:
            tried += 1
            minima = [set(leakage.ranked(of, h)[leakage.winnow(leakage.ranked(of, h), int(windows[len(h)]))].tolist()) for h in (ha, hb)]
            assert len(minima[0] & minima[1]) >= max(shared[len(ha)], shared[len(hb)])
    assert tried > 200


def test_leaking_pairs(spark):
    r = random.Random(4)
    base = [r.choice(WORDS) for _ in range(80)]
    tasks = spark.createDataFrame([("1", " ".join(base), None, "x", None, None), ("2", edited(r, base, 0.02), None, "x", None, None), ("3", edited(r, WORDS[:80], 0), None, None, None, None)], "task_id string, reason_for_call string, known_info string, task_instructions string, created_at timestamp, ingested_at timestamp")
    from datetime import datetime as d

    at = lambda n: d(2031, 1, n)
    kind = "candidate_id string, task_id string, split string, source_split string, decided_at timestamp, ingested_at timestamp"
    c = spark.createDataFrame([("t1", "1", " train\t", "TRAIN", at(2), at(2)), ("e1", "1", "VALIDATION", None, at(1), at(1)), ("e2", "2", " ", "test", at(1), at(1)), ("e3", "3", None, "TEST", at(1), at(1)), ("o", "2", "TRAIN", None, at(1), at(1)), ("o", "2", None, "TRAIN", at(3), at(3)), ("n", None, "TRAIN", None, at(1), at(1)), ("u", "9", "TRAIN", None, at(1), at(1)), ("v", "9", None, "TEST", at(1), at(1))], kind)
    decided = leakage.decided(c)
    pairs = leakage.leaking_pairs(decided, leakage.task_links(decided, tasks))
    assert sorted((x["train"], x["evaluation"]) for x in pairs.collect()) == [("t1", "e1"), ("t1", "e2"), ("u", "v")]
    assert leakage.leakage_report(pairs).count() == 3
    empty = leakage.decided(c.limit(0))
    assert leakage.leaking_pairs(empty, leakage.task_links(empty, tasks)).count() == 0


def brute_pairs(texts, threshold=0.6, width=3):
    sets = {}
    for c, t in texts.items():
        w = shingles.WORD.findall(t.lower())
        sets[c] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    names = sorted(c for c in sets if sets[c])
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def linked_tasks(spark, texts):
    """The links found between tasks named t... (training) and e... (evaluation), and all that there are."""
    tasks = spark.createDataFrame([(c, t) for c, t in texts.items()], "task_id string, reason_for_call string").selectExpr(
        "*", "cast(null as string) known_info", "cast(null as string) task_instructions", "cast(null as timestamp) created_at", "cast(null as timestamp) ingested_at")
    sided = spark.createDataFrame([(c, c, "TRAIN" if c[0] == "t" else "EVALUATION") for c in texts], "candidate_id string, task_id string, side string")
    got = {(r["evaluation_task"], r["train_task"]) for r in leakage.task_links(sided, tasks).collect()}
    return got, {(a, b) for a, b in brute_pairs(texts) if a[0] == "e" and b[0] == "t"}


@pytest.mark.parametrize("block", [20_000, 30])
def test_links_inside_a_mass_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK", block)
    r = random.Random(7)
    texts = {f"{'te'[j % 2]}x{j}": " ".join(r.choice(WORDS) for _ in range(r.choice((3, 5, 126)))) for j in range(260)}
    for name, length, share in (("long", 126, 0.04), ("short", 30, 0.05), ("tiny", 5, 0.1)):  # hot groups
        base = [r.choice(WORDS) for _ in range(length)]
        texts |= {f"{'te'[j % 2]}{name}{j}": edited(r, base, share) for j in range(160 if length > 30 else 60)}
    got, want = linked_tasks(spark, texts)
    assert got == want and len(want) > 3_000


@pytest.mark.parametrize("size", [40, 600])
def test_links_do_not_depend_on_the_size_of_the_table(spark, monkeypatch, size):
    monkeypatch.setattr(frequency, "CHUNK", 2_000)
    monkeypatch.setattr(frequency, "SHARE_BITS", 10)
    r = random.Random(3)
    phrases = [[r.choice(WORDS) for _ in range(10)] for _ in range(8)]
    compose = lambda: [w for _ in range(8) for w in r.choice(phrases)]
    texts = {}
    for j in range(30):
        base = compose()
        texts |= {f"tp{j}": " ".join(base), f"ep{j}": edited(r, base, 0.08)}
    texts |= {f"{'te'[j % 2]}f{j}": " ".join(compose()) for j in range(size)}
    got, want = linked_tasks(spark, texts)
    assert got == want and len(want) >= 15


# --- personal information --------------------------------------------------------------------


@pytest.fixture(scope="module")
def crf():
    return pii.trained()


def kinds(crf, text):
    return sorted({k for _, found in pii.entities(pii.Tagger(crf), [text]) for k, _, _ in found})


@pytest.mark.parametrize("text,want", [
    ("My email is anna.berg@posthaus.example", ["EMAIL"]), ("Write to anna.berg at posthaus dot example; I read it daily.", ["EMAIL"]), ("You can text 212-555-0188 if the courier is late.", ["PHONE"]),
    ("For customs they wanted the passport ZZ 1234567.", ["ID_NUMBER"]), ("Please ship it to 12 Hollowmere Street, Tolbridge.", ["ADDRESS"]), ("My name is Anna Bergstrand.", ["NAME"]),
    ('{"user_id": "usr_111111", "status": "pending", "name": {"first_name": "Anna", "last_name": "Bergstrand"}, "phone": "212-555-0188"}', ["NAME", "PHONE"]),
    ("Order #W1234567 is pending and I paid with credit_card_1234567.", []), ("The number on the box is 1234567890.", []), ("Please mask it as [EMAIL] in your notes.", []), ("", []), ("Room 14 at the workshop is where it stands.", []),
])
def test_kinds(crf, text, want):
    assert kinds(crf, text) == want


def test_held_out_accuracy(crf):
    from quernstone.llm.pii_examples import labelled_table

    held = labelled_table(pii.TABLE_SIZE + 400)[pii.TABLE_SIZE :]
    texts = ["".join(t for t, _ in p) for p in held]
    found = {i: sorted({k for k, _, _ in s}) for i, s in pii.entities(pii.Tagger(crf), texts)}
    right = sum(found.get(i, []) == sorted({k for _, k in p if k}) for i, p in enumerate(held))
    assert right / len(held) > 0.9


# sentences unlike those of the labelled table and of the test data; found or not by the model alone
OTHER_WORDING = [
    ("Kindly note that our landlady, Ottilie Vandermeer, keeps a spare key.", ["NAME"]), ("Rechnung bitte an Jürgen Großmann schicken", ["NAME"]), ("Es grüßt Sie Frau Hallstein", ["NAME"]),
    ("The gas engineer parks outside 88 Willow Walk on Tuesdays.", ["ADDRESS"]), ("Our allotment borders 12 Harbour Quay, Selby.", ["ADDRESS"]), ("My aunt swears 5 Kings Row, Dunmere is haunted.", ["ADDRESS"]), ("Removal lorry booked towards 19 Elm Grove, Tarleton", ["ADDRESS"]),
    ("Passport K12345678 was stamped twice at the border", ["ID_NUMBER"]), ("should anything leak, call me at 5551234567", ["PHONE"]), ("whoever finds the dog may ring +44 20 7946 0018", ["PHONE"]), ("minutes of the meeting go to h.lindgren@choirpost.example", ["EMAIL"]),
    ("San Francisco Giants won against Los Angeles Dodgers", []), ("The committee meets on Thursday in the town hall.", []), ("Chapter 12 begins on page 345 of the second volume.", []), ("Water boils at 100 degrees, give or take.", []),
    ("We counted 1234567890 grains, roughly.", []), ("Bank of Northfield raised its fees in March.", []), ("Mix 250 g flour with 3 eggs and rest it for 30 minutes.", []), ("The ferry to Oldhaven leaves from platform 4 at 17:45.", []), ("Version 2.14.1 of the driver fixes bug 4711.", []),
]


def test_other_wording(crf):
    assert sum(kinds(crf, text) == want for text, want in OTHER_WORDING) >= 17


def test_names_are_cut_to_their_capitals():
    text = "Invoice for Priya Raghunathan handled, Ludwig van der Rohe too"
    assert text[slice(*pii.name_within(text, 12, 37))] == "Priya Raghunathan" and text[slice(*pii.name_within(text, 39, 62))] == "Ludwig van der Rohe"
    assert pii.name_within("anna berg", 0, 9) == (0, 9) and pii.name_within("ANNA BERG", 0, 9) == (0, 9)


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    e, a = r.normal(size=(5, 6, 3)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32)
    for i, path in enumerate(pii.viterbi(e, a)):
        score = lambda p: sum(e[i, t, y] for t, y in enumerate(p)) + sum(a[x, y] for x, y in zip(p, p[1:]))  # noqa: E731, B023
        assert abs(score(path) - max(map(score, itertools.product(range(3), repeat=6)))) < 1e-4


def test_redaction_of_a_table(spark, crf):
    d = spark.createDataFrame([(1, "My email is anna.berg@posthaus.example, thanks", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing here", "k")], "event_id bigint, content string, kinds string")
    got = pii.find_personal_information(d, "event_id", "content", crf=crf)
    row = got.first()
    assert got.count() == 1 and row["kinds"] == ["EMAIL"] and "[EMAIL]" in row["redacted"] and "anna.berg" not in row["redacted"] and row["redacted"].endswith("thanks")
    assert pii.find_personal_information(d.limit(0), "event_id", "content", crf=crf).count() == 0


def test_long_text_is_tagged_whole(crf):
    assert kinds(crf, "The lamp is fine. " * 4_000 + "My email is anna.berg@posthaus.example") == ["EMAIL"]
