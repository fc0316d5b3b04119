"""The training-data operators against brute force, exact properties and planted cases."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import abuse, leakage, packing, pii, residue, spam, splits, subset

VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
ENTITIES = {"author": ["author"], "post": ["post_id", "crosspost_parent"]}
QUERY = "query_id string, author string, post_id string, crosspost_parent string, id int, `group` int, n int, component int"


def pad(rows):
    """Extra columns whose names the operators use inside."""
    return [(*r, 1, 2, 3, 4) for r in rows]


# splits


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_random_graphs_and_a_long_chain(spark):
    rng = random.Random(2)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(110))]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"h{i:04d}") for i in range(400)] + [("a", "a")]
    out = {r.node: r.component for r in splits.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = union_find(pairs, {x for p in pairs for x in p})
    assert out == {n: c for n, c in want.items() if n != "a"}


def test_groups_whatever_the_spelling(spark):
    rows = [
        ("q1", "u/Ann_B", "t3_abc", None), ("q2", " ann_b ", "zzz", None), ("q3", None, "https://forum.example/comments/ABC/", None), ("q4", "AutoModerator", "p4", "T3_ZZZ "),
        ("q5", "AutoModerator", "p5", "nan"), ("q6", "[deleted]", "", None), ("q7", "[deleted]", "p5", ""), ("q1", "u/Ann_B", "t3_abc", None), (None, "ann_b", "abc", None), ("q8", None, None, None),
    ]
    df = spark.createDataFrame(pad(rows), QUERY)
    out = {r.id: r.group for r in splits.related_groups(df, "query_id", ENTITIES).collect()}
    assert out == {"q1": "q1", "q2": "q1", "q3": "q1", "q4": "q1", "q5": "q5", "q7": "q5", "q6": "q6", "q8": "q8"}
    assert splits.related_groups(df.limit(0), "query_id", ENTITIES).count() == 0


def test_split_keeps_groups_whole_and_shares_close_with_a_giant_group(spark):
    groups = spark.range(6000).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.when(F.col("id") < 1800, "giant").otherwise(F.concat(F.lit("g"), F.floor(F.col("id") / 3))).alias("group"))
    out = splits.grouped_split(groups, {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert out.count() == 6000 and out.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r.split: r.n / 6000 for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["validation"] - 0.15) < 0.03 and abs(share["test"] - 0.15) < 0.03
    assert splits.grouped_split(groups.limit(0), {"train": 1.0}).count() == 0
    small = spark.range(4000).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.concat(F.lit("g"), F.floor(F.col("id") / 25)).alias("group"))
    n = {r.split: r.n for r in splits.grouped_split(small, {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["train"] - 2800) <= 25 and abs(n["validation"] - 600) <= 25 and abs(n["test"] - 600) <= 25
    assert out.orderBy("id").collect() == splits.grouped_split(groups.repartition(7), {"train": 0.7, "validation": 0.15, "test": 0.15}).orderBy("id").collect()


# subsets


def test_quotas_are_balanced_and_complete():
    counts = {("a", 0): 1000, ("a", 1): 3, ("b", 0): 10, ("c", 1): 2, ("d", 0): 0}
    for size in (1, 4, 8, 50, 2000):
        q = subset.balanced_quotas(counts, size)
        assert sum(q.values()) == min(size, 1015) and all(n <= counts[k] for k, n in q.items())
    assert subset.balanced_quotas(counts, 9)[("a", 0)] <= 4 and subset.balanced_quotas({}, 5) == {}


def test_flow_costs_against_all_distributions():
    import itertools

    cost = lambda n, free: sum(64 * (2 * min(12, -(-(i - free) // max(1, -(-free // 4)))) - 1) for i in range(free + 1, n + 1)) if n > free else 0
    counts = {("a", 0): 6, ("b", 0): 6, ("c", 0): 1}
    q = subset.balanced_quotas(counts, 6)
    best = min((sum(cost(n, min(counts[k], 2)) for k, n in zip(counts, d)), max(d)) for d in itertools.product(range(7), repeat=3) if sum(d) == 6 and all(n <= counts[k] for k, n in zip(counts, d)))
    assert sum(cost(q.get(k, 0), min(counts[k], 2)) for k in counts) == best[0]


def test_subset_avoids_the_large_similar_group(spark):
    rows = [(f"c{i}", 0.85 if i < 900 else i % 100 / 100, 1.0) for i in range(1000)] + [("n1", None, None), ("n2", float("nan"), 1.0), (None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "comment_id string, s double, rank double")
    cats = {"bin": subset.bin_of(F.col("s"), 0.0, 1.0, 10)}
    out = subset.varied_subset(df, [10, 40, 0, 40], "comment_id", cats, [F.round("s", 2)])
    got = out.filter("subset_size = 40").collect()
    assert len(got) == 40 == len({r.comment_id for r in got}) and sum(r.bin == 8 for r in got) <= 5 and len({r.bin for r in got}) == 11
    assert out.filter("subset_size = 10").count() == 10
    assert sorted(out.collect()) == sorted(subset.varied_subset(df.repartition(5), [10, 40], "comment_id", cats, [F.round("s", 2)]).collect())
    assert subset.varied_subset(df.limit(0), [5], "comment_id", cats, [F.col("s")]).count() == 0
    assert subset.varied_subset(df.limit(3), [5000], "comment_id", cats, [F.col("s")]).count() == 3


# packing


@pytest.mark.parametrize("pack", [packing.pack, lambda d, k, s, c, **x: packing.tiered(d, k, s, c, **x)])
def test_windows_hold_everything_once(spark, pack):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 7, 30, 64, 65, 100, 128, 129, 300, 1000, 12]) for _ in range(800)] + [64] * 400
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n long, window_id string")
    out = pack(df, "doc_id", "n", [64, 128], step_windows=8).toPandas()
    for c, g in out.groupby("capacity_tokens"):
        assert g.groupby("window_id").n_tokens.sum().max() <= c
        total, pieces = g.groupby("doc_id").n_tokens.sum(), g.groupby("doc_id").size()
        assert all(total[d] == sizes[d] for d in total.index) and all(sizes[d] > c for d in pieces[pieces > 1].index)
        full = g[g.n_tokens > 0].sort_values(["window_id", "start"])
        end = (full.start + full.n_tokens).shift()
        same = full.window_id.eq(full.window_id.shift())
        assert (full.start[same] == end[same]).all() and (full.start[~same] == 0).all()
    assert set(out.doc_id) == set(range(len(sizes)))


def test_packing_is_as_tight_as_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(20):
        items = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
        rooms = []
        for n in items:
            fit = [r for r in rooms if r >= n]
            if fit:
                r = min(fit)
                rooms.remove(r)
                rooms.append(r - n)
            else:
                rooms.append(100 - n)
        plan = packing.pack_histogram({n: items.count(n) for n in set(items)}, 100, [])
        used = 1 + max(w + many // each - 1 for _, _, many, each, w, _ in plan)
        assert used <= len(rooms) * 1.02 + 1 and sum(p[2] for p in plan) == len(items)


def test_packing_of_nothing_and_of_hashed_buckets(spark):
    df = spark.createDataFrame([(i, 10) for i in range(500)] + [(900, None), (None, 5)], "doc_id long, n long")
    out = packing.pack(df, "doc_id", "n", [64], bucket_rows=50)
    assert out.count() == 501 and out.groupBy("window_id").agg(F.sum("n_tokens").alias("s")).filter("s > 64").count() == 0
    assert out.agg(F.max("window_id")).first()[0] == 83
    assert packing.pack(df.limit(0), "doc_id", "n", [64]).count() == 0 and packing.pack(df, "doc_id", "n", []).count() == 0


def test_gaps_of_long_windows_are_filled_from_shorter_tiers(spark):
    df = spark.createDataFrame([(i, 70) for i in range(40)] + [(100 + i, 50) for i in range(50)] + [(200 + i, 8) for i in range(40)] + [(300, 300)], "doc_id long, n long")
    out = packing.tiered(df, "doc_id", "n", [64, 128], step_windows=5).toPandas()
    windows = out.groupby(["capacity_tokens", "window_id"]).agg(tokens=("n_tokens", "sum"), groups=("step_group", "nunique"), group=("step_group", "first"))
    assert (windows.tokens <= windows.index.get_level_values(0)).all() and (windows.groups == 1).all()
    # two whole windows of the long document, 39 of 70 + 50 + 8, one of 70, the rest of the long one and 8; then 11 of 50
    assert out.n_tokens.sum() == 40 * 70 + 50 * 50 + 40 * 8 + 300 and (windows.tokens == 128).sum() == 41
    assert len(windows.loc[128]) == 42 and len(windows.loc[64]) == 11
    tokens = windows.groupby("group").tokens.sum()
    assert len(tokens) == len(windows) // 5 and tokens.max() - tokens.min() <= 128


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world again"), (2, None), (3, ""), (None, "x"), (4, "word " * 50_000)], "doc_id long, text string")
    out = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text", str(VOCABULARY)).collect()}
    assert out[1] == 3 and out[2] == out[3] == 0 and 50_000 <= out[4] <= 50_002 and len(out) == 4


# leakage


def made_items(n, rng):
    nouns, verbs, places = (["kettle", "drum", "ribbon", "stove", "ladder", "compass", "violin", "basket", "anchor", "lantern"], ["painted", "folded", "buried", "counted", "borrowed", "polished"], ["harbour", "orchard", "attic", "mill", "tunnel", "garden"])
    sentence = lambda: " ".join(f"{rng.choice(['her', 'his', 'one', 'the'])} {rng.choice(nouns)} {rng.choice(verbs)} near {rng.choice(places)} {rng.randrange(900)}" for _ in range(4))
    return [(i, f"Answer in plain words only. Why did {sentence()} and did {sentence()}?", ". ".join(sentence() for _ in range(5)) + ".") for i in range(n)]


def test_leaks_against_exact_coverage_and_planted_cases(spark):
    rng = random.Random(8)
    items = made_items(12, rng)
    filler = lambda n: " ".join(rng.choice("we you they walk talk read write plan list note call wait rest".split()) for _ in range(n))
    docs, want = [], set()
    for d in range(60):
        i, q, p = items[rng.randrange(len(items))]
        kind = d % 6
        q2 = q.split(". ", 1)[1]
        if kind == 0:
            text = filler(2000) + " " + q2.upper().replace(" ", "\n", 5) + " " + filler(3000)
        elif kind == 1:
            s = p.split(". ")
            text = f"{filler(40)} {s[0]} {filler(30)} {s[3]} {filler(20)}"
        elif kind == 2:
            w = q2.split(" ")
            w[6], w[20] = "thing", "place"
            text = " ".join(w)
        elif kind == 3:
            text = p.replace("e", "е").replace("near", "ne\u00adar")  # look-alikes and soft hyphens
        elif kind == 4:
            text = "Answer in plain words only. " + filler(200) + " " + " ".join(p.split()[:6])
        else:
            text = filler(100) + " " + " ".join(q2.split()[:8])
        docs.append((d, text))
        if kind < 4:
            want.add((d, i))
    docs += [(100, docs[0][1]), (100, docs[0][1]), (101, None), (102, ""), (None, docs[0][1])]
    want.add((100, next(i for d, i in want if d == 0)))
    it = spark.createDataFrame(items + [(50, None, None), (51, "", ""), (None, "x", "y"), items[0]], "item_id long, question string, passage string")
    out = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it, "doc_id", "text", "item_id", "question", "passage")
    assert {tuple(r) for r in out.collect()} == want
    old = leakage.BLOCK_WORDS
    try:
        leakage.BLOCK_WORDS = 300  # several blocks of items
        again = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it, "doc_id", "text", "item_id", "question", "passage")
        assert {tuple(r) for r in again.collect()} == want
    finally:
        leakage.BLOCK_WORDS = old
    assert leakage.leaks(spark.createDataFrame(docs[:0], "doc_id long, text string"), it, "doc_id", "text", "item_id", "question", "passage").count() == 0
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it.limit(0), "doc_id", "text", "item_id", "question", "passage").count() == 0


def test_windows_cover_every_segment():
    for n in (1, 16, 17, 48, 49, 200, 1001):
        w = leakage.windows_of(n)
        assert w[0][1] == 0 and w[-1][2] == n
        assert all(any(a <= s and s + 16 <= b for _, a, b in w) for s in range(max(0, n - 16) + (n >= 16)))


# spam


def test_spam_pages(spark):
    rng = random.Random(9)
    prose = "I set a timer before lunch and it helped. My sister says the list can wait, but I did it anyway. When the house is loud, we go for a walk and talk about the plan. "
    words = "cheap buy planner timer focus app best deal online test gummies course review free".split()
    keys = lambda n: " ".join(rng.choice(words) for _ in range(n))
    who, did, where = ["My sister", "The nurse", "A friend", "My coach", "Nobody", "The group"], ["sorted the papers", "forgot the keys", "called about the form", "walked to the lake", "hid the phone", "wrote a list"], ["before lunch", "on a bad day", "after the move", "at the desk", "in the spring", "with some tea"]
    said = lambda: f"{rng.choice(who)} {rng.choice(did)} {rng.choice(where)}, and it {rng.choice(['helped', 'failed', 'took an hour', 'was fine'])} for {rng.randrange(90)} days. "
    good = ["".join(said() for _ in range(k)) for k in range(1, 24)] + [
        "Packing list\n- [ ] keys, on the hook\n- [ ] a snack that survives a bag\n- [ ] the letter from the clinic\n- [ ] water, filled the night before",
        "Links I saved:\n* [clock](https://a.example/x): it helped me to leave on time, and it is free.\n* [lamp](https://b.example/y): my sister uses it when she wakes up at night.",
        prose + "\n\n#smallwins #focus #adhd", "Done is better than perfect.\nI cried about it and then we talked.\n" * 6,
    ]
    bad = [keys(120), ", ".join(keys(3) for _ in range(60)), "\n".join(f"https://shop.example/{w}/{i}" for i, w in enumerate(words * 3)), " ".join(f"#{a}{b}" for a in words for b in words[:4]), prose + "\n\n" + keys(300),
           "\n".join(f"{keys(3)} | SKU {rng.randrange(99999)} | {rng.randrange(99)}.99 | in stock" for _ in range(20)), "Why focus app? Because the focus app is a cheap focus app. With focus app you get more focus app from your focus app. " * 8]
    rows = [(i, t, 1.0) for i, t in enumerate(good)] + [(100 + i, t, 1.0) for i, t in enumerate(bad)] + [(200, None, 1.0), (201, "", 1.0), (None, bad[0], 1.0), (100, bad[0], 1.0), (202, "  \n ", 1.0)]
    out = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string, ratio double"), "doc_id", "text").collect()}
    assert out == {100 + i for i in range(len(bad))}
    assert spam.spam_pages(spark.createDataFrame(rows[:0], "doc_id long, text string, ratio double"), "doc_id", "text").count() == 0


def test_varied_lists_without_sentences_are_no_spam(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiouy") for _ in range(rng.randrange(1, 5)))
    glossary = "\n".join(f"{word()} {word()}: {word()} {word()} {word()}" for _ in range(60))
    foreign = "。".join(" ".join(word() for _ in range(9)) for _ in range(40)) + "。"
    stuffed = " ".join(rng.choice("cheap buy planner timer focus deal".split()) for _ in range(300))
    rows = [(1, glossary), (2, foreign), (3, "."), (4, stuffed)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {4}


def test_prose_of_other_scripts_is_no_spam(spark):
    texts = [
        "今天早上我很早就起床了，然后去公园散步。天气非常好，很多老人在打太极拳。回家以后我做了早饭，和孩子们一起吃。下午我们去了图书馆，借了几本关于历史的书。晚上我丈夫做了鱼，味道不错。睡觉之前我写了一点日记，因为医生说这样有帮助。",
        "今朝は早く起きて、公園まで散歩に行きました。天気がとても良くて、たくさんの人が走っていました。家に帰ってから朝ごはんを作って、子供たちと一緒に食べました。午後は図書館で歴史の本を何冊か借りました。夜は夫が魚を焼いてくれて、とてもおいしかったです。",
        "आज सुबह मैं जल्दी उठा और पार्क में टहलने गया। मौसम बहुत अच्छा था और कई लोग दौड़ रहे थे। घर लौटकर मैंने नाश्ता बनाया और बच्चों के साथ खाया। दोपहर में हम पुस्तकालय गए और इतिहास की कुछ किताबें लीं।",
        "Сегодня утром я рано встал и пошёл гулять в парк. Погода была очень хорошая, и многие люди бегали. Дома я приготовил завтрак и поел вместе с детьми. Днём мы пошли в библиотеку и взяли несколько книг по истории.",
        "استيقظت هذا الصباح مبكرا وذهبت للمشي في الحديقة. كان الطقس جميلا جدا وكان كثير من الناس يركضون. عدت إلى البيت وأعددت الفطور وأكلت مع الأطفال. بعد الظهر ذهبنا إلى المكتبة وأخذنا بعض كتب التاريخ.",
    ]
    rows = list(enumerate(texts)) + [(10, "купить таблетки дешево доставка " * 40), (11, "便宜 计时器 购买 优惠 " * 60)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {10, 11}


def test_blocks_keep_the_whole_text():
    rng = random.Random(1)
    for n in (0, 5, 700, 5000):
        t = "".join(rng.choice("ab c\n") for _ in range(n))
        squeeze = lambda s: "".join(s.split())
        assert squeeze("".join(spam.blocks(t))) == squeeze(t)
    assert len(spam.blocks("x" * 100_000)) > 100


# personal information

FOUND = [
    ("Write to anna.hill@mail.example and wait", {"email"}), ("mail me: anna (at) mail dot example dot org", {"email"}), ("joe AT mail DOT example is mine", {"email"}), ("[x@y.example](mailto:x@y.example)", {"email"}), ("joe＠mail.example", {"email"}),
    ("call me on 07700 900123 after six", {"phone"}), ("ring (415) 555-0147", {"phone"}), ("my number is +49 30 23125 306", {"phone"}), ("text ０７７００-９００-４３８ please", {"phone"}), ("0 1 6 3 2 9 6 0 2 3 1", {"phone"}), ("zero seven seven zero zero nine zero zero one two three is mine", {"phone"}),
    ("My SSN: 970-29-8630 is wrong", {"id_number"}), ("they have my tax ref 6540234474", {"id_number"}), ("DNI 12345678Z", {"id_number"}), ("my passport number B74154066", {"id_number"}), ("QQ 12 34 56 C", {"id_number"}), ("health number 943 476 5919", {"id_number"}),
    ("I live at 34 Maybank Crescent, come by", {"address"}), ("new address: P.O. Box 1766, Hill Town", {"address"}), ("Calle Mayor 23, 2º B", {"address"}), ("we meet in der Lindenstraße 12a", {"address"}), ("12 rue de Rivoli", {"address"}),
    ("My name is Daniel Holovic and I was diagnosed", {"person_name"}), ("Regards, Dr. Ashgate", {"person_name"}), ("Ask for Ollerdahl, Dmitri", {"person_name"}), ("Mi psiquiatra se llama Clara Velridd-Lindil", {"person_name"}), ("simon brackgate runs our group", {"person_name"}),
    ("Best, Omar Pellridd | omar@mail.example | 07700-900-821 | 23 Quarrel Close", {"person_name", "email", "phone", "address"}),
]
CLEAN = [
    "My order number is 59860317 and the parcel has not moved", "ISBN 978-0-4807-4259-6", "Support opened ticket #3509898 and closed it 2024-04-19 09:22", "The lock file says planner-core@3.0.3", "Me@3.am: new hobby", "Track 27 Moonlight Drive, volume up",
    "Stuck on level 40 Sunset Avenue", "studies 2019-2023 with 1170 people", "I take 41 mg at 7:30 and 3 mg at 13:00", "Version 5.5.6.6 broke it", "Serial number SN-2503-2214-81 is on the back", "Anna helped me a lot", "thanks u/quiet_maple62", "On Mondays I walk 10 minutes to the park", "My score went from 747 to 392", "", "😅",
    "The nurse asked about it", "On the way home at 5 I stop",
]


@pytest.mark.parametrize(("text", "kinds"), FOUND)
def test_personal_information_is_found(text, kinds):
    assert {s.kind for s in pii.spans(pii.readable(text))} == kinds


@pytest.mark.parametrize("text", CLEAN)
def test_other_text_is_left_alone(text):
    assert pii.spans(pii.readable(text)) == []


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398714") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.mod11("9434765919") and not pii.mod11("9434765918") and pii.mod23("12345678Z") and not pii.mod23("12345678A") and pii.iso7064("86095742719")


def test_capitals_of_the_whole_text_count(spark):
    for start in ("and then we walked on for a while. " * 15, "AND THEN WE WALKED ON FOR A WHILE. " * 15):
        rest = "Later the weather turned and everybody went home again to have some tea together. " * 12 + "My name is Zebulon Quartermaine and I live here."
        assert [(start + rest)[s.start : s.end] for s in pii.spans(start + rest)] == ["Zebulon Quartermaine"]
        assert [s.kind for s in pii.spans(start + "My name is Zebulon Quartermaine. " + rest)] == ["person_name"] * 2
    assert pii.spans("and then we walked on for a while. " * 15 + "Doctor Quartermaine came. " + "All was well again. " * 9)[0].kind == "person_name"


def test_names_outside_the_list_by_context():
    found = lambda t: [t[s.start : s.end] for s in pii.spans(pii.readable(t)) if s.kind == "person_name"]
    assert found("Yesterday my neighbour Oluwaseun Adeyemi brought soup.") == ["Oluwaseun Adeyemi"]
    assert found("In the end Oluwaseun Adeyemi suggested a walk.") == ["Oluwaseun Adeyemi"]
    assert found("My Machine Learning course says hello.") == [] == found("Then New York called for a change of plan.")


def test_redaction_changes_nothing_else():
    text = "Ⓝo: ﬁne &amp; good\u00ad, call 07700 900123 — or mail joe＠mail.example … “ok” & bye"
    new, n = pii.replaced(text)
    assert n == 2 and new == "Ⓝo: ﬁne &amp; good\u00ad, call [PHONE] — or mail [EMAIL] … “ok” & bye"


def test_redaction_keeps_rows_and_columns(spark):
    rows = [("a", FOUND[0][0], 1), ("a", FOUND[0][0], 1), ("b", None, None), ("c", "", 2), ("d", "nothing here & now", 3), (None, FOUND[5][0], 4), ("e", "x " * 30_000 + FOUND[6][0], 5)]
    df = spark.createDataFrame(rows, "comment_id string, t string, n_replaced int")
    out = pii.redacted(df, "t")
    assert out.columns == ["comment_id", "t", "n_replaced"] and out.count() == 7
    got = sorted((r.comment_id or "", r.t or "", r.n_replaced) for r in out.collect())
    assert ("a", "Write to [EMAIL] and wait", 1) in got and ("d", "nothing here & now", 0) in got and ("", "call me on [PHONE] after six", 1) in got
    assert [x for x in got if x[0] == "e"][0][1].endswith("ring [PHONE]")
    assert {tuple(r) for r in pii.found_types(df, "comment_id", "t").collect()} == {("a", "email"), ("e", "phone")}
    assert pii.found_types(df.limit(0), "comment_id", "t").count() == 0 and pii.redacted(df.limit(0), "t").count() == 0


# abuse


@pytest.fixture(scope="module")
def model():
    return abuse.train([])


def scores(model, texts):
    return [abuse.score_of(p) for p in model.marginals([abuse.TOKEN.findall(abuse.prepared(t)) for t in texts])]


def test_tagger_from_seeds_alone(model):
    bad = ["You stupid idiot, nobody likes you.", "k*ll yourself, l0ser", "You are a d.i.s.g.u.s.t.i.n.g freak", "Du bist ein Idiot, halt die Fresse", "send me your n u d e s, baby", "You are pаthеtic and everyone knows it, moron"]
    good = ["I feel stupid when I lose my keys.", "This bloody printer will be the end of me.", "My boss called me lazy in front of everyone, and it still stings.", "I disagree with you about the dose.", "The pills lower my sex drive.", "Thanks for the list!", "", "😅"]
    assert min(scores(model, bad)) >= 0.5 and max(scores(model, good)) < 0.5


def test_marginals_against_enumeration(model):
    import itertools

    tokens = ["you", "stupid", "cow", "."]
    batch = abuse.Batch([["a"] * 9, tokens, []], model.ids.__getitem__)
    s = batch.sums(model.rows, model.codes, model.pairs)[batch.starts[1] :][:4]
    weight = lambda y: np.exp(sum(s[i] for i in range(4) if y[i]) + (model.chain[0] if y[0] else 0) + sum((0, model.chain[0], model.chain[1], model.chain[2])[2 * y[i - 1] + y[i]] for i in range(1, 4)))
    every = list(itertools.product((0, 1), repeat=4))
    total = sum(weight(y) for y in every)
    want = [sum(weight(y) for y in every if y[i]) / total for i in range(4)]
    assert np.allclose(model.marginals([["a"] * 9, tokens, []])[1], want)


def test_scores_of_nulls_and_offsets(spark, model):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "Fine day. You stupid idiot, shut up! Bye."), ("d", "word " * 20_000)], "comment_id string, t string")
    out = {r.comment_id: r for r in abuse.scored(df, model, "t", ["comment_id"], offsets=True).collect()}
    assert out["a"].score == out["b"].score == 0.0 and out["d"].score < 0.5
    text = "Fine day. You stupid idiot, shut up! Bye."
    assert any("stupid idiot" in text[s.start : s.end] for s in out["c"].spans)
    hidden = "Só\u00ad fine &amp; good ﬁ. Ⓨou s t u p i d   ｉdiot, shut up! B\u0301ye."
    assert abuse.aligned(hidden).text == abuse.prepared(hidden)
    found = [hidden[a:b] for a, b in abuse.spans_of(hidden, model.marginals([abuse.TOKEN.findall(abuse.prepared(hidden))])[0])]
    assert any("Ⓨou s t u p i d   ｉdiot, shut up" in x for x in found) and not any("fine" in x for x in found)
    assert abuse.scored(df.limit(0), model, "t", ["comment_id"]).count() == 0


def test_held_out_accuracy_on_rated_comments(spark):
    d = Path("/root/testdata/sf0.1")
    if not d.exists():
        pytest.skip("no test tables")
    rows = abuse.rated_sample(spark.read.parquet(str(d / "comments.parquet")), spark.read.parquet(str(d / "moderation_labels.parquet")), 3000)
    rated = [r for r in rows if r[1] is not None]
    random.Random(0).shuffle(rated)
    held, rest = rated[:400], rated[400:] + [r for r in rows if r[1] is None]
    s = scores(abuse.train(rest), [t for t, _ in held])
    right = np.mean([(x >= 0.5) == bool(y) for x, (_, y) in zip(s, held)])
    assert right > 0.9  # some ratings are wrong on purpose


# residue


def test_residue(spark):
    bad = ["Hi {{user.name}}, welcome back.", "See {8} for details. I like lists.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "404 Not Found", "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um die Kommentare zu sehen.", "You can find it at [[LINK_HERE]].",
           "Traceback (most recent call last):\n  File \"x.py\", line 3, in reply\nKeyError: 'name'", "asdf asdf asdf jkl", "I set a timer. An unexpected error occurred while loading comments (code 3401)."]
    good = ["My brain returns an error whenever somebody says taxes.", "I got a 404 when I opened the booking page, so I called them instead.", "Turn off JavaScript on news sites, it saved me hours.", "I use {task} and {minutes} as field names in my sheet, works well.", "50% sure, 100% tired.", "[deleted]", "https://notes.example/meds/120",
            "[This guide](https://guide.example/focus) explains it with pictures.", "Danke für den Beitrag, ich fühle mich weniger allein.", ""]
    rows = [("q", f"b{i}", t, 1) for i, t in enumerate(bad)] + [("q", f"g{i}", t, 1) for i, t in enumerate(good)] + [("q", "n", None, 1), ("q", "b0", bad[0], 1)]
    df = spark.createDataFrame(rows, "query_id string, reply_id string, text string, coverage int")
    out = residue.residue(df, residue.fitted(df, "text"), "text", ["query_id", "reply_id"]).collect()
    assert {r.reply_id for r in out if r.excluded} == {f"b{i}" for i in range(len(bad))} and len(out) == len(rows)
    assert all(0 <= r.coverage <= 1 for r in out)
    empty = df.limit(0)
    assert residue.residue(empty, residue.fitted(empty, "text"), "text", ["query_id"]).count() == 0


def test_prose_is_counted_over_all_texts_and_windows_slide_in_long_sentences(spark):
    texts = [f"I took note {i} to my sister and it helped for {i % 9} days" for i in range(4_200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    whole, parts = residue.Model().prose_counts(texts), [residue.Model().prose_counts(texts[i::3]) for i in range(3)]
    assert (whole == sum(parts)).all() and whole[0, 0, : residue.SLOTS[0]].sum() >= sum(map(len, texts))
    a, b = residue.fitted(df, "text"), residue.Model().fit_prose(whole)
    assert all((x == y).all() for x, y in zip(a.words.grams + a.shapes.contexts, b.words.grams + b.shapes.contexts))
    walk = "so we went on and on along the river and through the wood until nobody knew the way home any more "
    long = [walk * 3 + "an unexpected error occurred while loading comments please try again later " + walk * 3, walk * 6]
    assert [residue.excluded(f) for f in b.units(long)] == [True, False]


def test_every_field_of_a_sentence_has_its_stretch():
    text = "hi {{name}}, please call {{phone}} or mail {{email}} about {{topic}} today."
    found = residue.Model().units([text])[0]
    assert all(k == "template" for _, _, k in found) and found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert all(any(a <= text.index(f) + 1 and b >= text.index(f) + len(f) - 1 for a, b, _ in found) for f in ("{{name}}", "{{phone}}", "{{email}}", "{{topic}}"))
    assert residue.Model().units(["", "hi", "we walked home " * 30]) == [[], [], []]


# queries


def test_found_queries_have_their_columns(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test tables")
    from rankloom.llm import queries

    want = {"p1_found": "table_name row_key pii_type", "p2_found": "comment_id", "p4_found": "first_query_id query_id", "p5_found": "query_id reply_id", "p7_found": "doc_id item_id", "p8_found": "doc_id"}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, d)
        assert df.columns == columns.split() and df.count() == df.distinct().count()
