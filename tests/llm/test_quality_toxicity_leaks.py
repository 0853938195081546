import collections
import random

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import decontamination as dc
from tallymark.llm import quality_mcd as qm
from tallymark.llm import toxicity_chain as tc

GAPS = " \t\n\x0b\x0c\r"


def base(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in GAPS:
            words += [now] if now else []
            now = ""
        else:
            now += c
    three = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    held = {j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(GAPS)]
    return len(words), sum(map(len, words)), sum(c in qm.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(held)


def test_base_statistics(spark):
    rnd = random.Random(1)
    cases = ["".join(rnd.choices(["a", "b", "é🙂", " ", "\n", "\t", "#", "<", "\xa0", "a b c "], k=rnd.randint(0, 40))) for _ in range(300)] + [None, "", " \n ", "a a a a", "a b c a b c", "x " * 5000]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in qm.base_statistics(df).collect()}
    assert all(got[k] == base(t) for k, t in enumerate(cases))


def reference_distances(x):
    """The estimate of one group, in numpy."""
    floor = np.array([v**2 for v in qm.FLOORS.values()])
    middle = np.array([np.sort(c)[(len(c) - 1) // 2] for c in x.T])
    spread = np.array([np.sort(np.abs(c - m))[(len(c) - 1) // 2] for c, m in zip(x.T, middle)])
    m, c = middle, np.diag((1.4826 * spread) ** 2)
    dist = lambda: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + np.diag(floor)), x - m)
    last = None
    for _ in range(qm.STEPS):
        now = np.linalg.slogdet(c + np.diag(floor))[1]
        if last is not None and abs(now - last) <= qm.SETTLED:
            break
        d, last = dist(), now
        kind = np.floor(np.log2(np.maximum(d, 1e-300)) * qm.OCTAVE)
        near = kind <= np.sort(kind)[int(np.ceil(qm.COVERED * len(d))) - 1]
        m, c = x[near].mean(axis=0), np.cov(x[near].T, bias=True)
    d = dist()
    return d / max(0.05, np.sort(d)[(len(d) - 1) // 2] / qm.CHI2_MEDIAN)


def test_estimates_match_numpy_and_reject_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [0.6, 0.1, 0.3, 0.05, 0.05]
    x[:20] += [0, 0, 6, 0, 0.9]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, x_words double, x_length double, x_symbols double, x_lines double, x_repeats double")
    est = qm.estimates(rows)
    near = qm.distances(rows.withColumn("k", F.monotonically_increasing_id()), est.drop("scale")).join(est.select("group", "scale"), "group")
    got = sorted((r.x_words, r.d2 / r.scale) for r in near.collect())
    want = sorted(zip(x[:, 0].tolist(), reference_distances(x).tolist()))
    assert np.allclose([d for _, d in got], [d for _, d in want], rtol=1e-6)
    assert min(d for v, d in want if v in set(x[:20, 0].tolist())) > max(d for v, d in want if v not in set(x[:20, 0].tolist()))


def test_groups_beyond_a_broadcast_give_the_same(spark, monkeypatch):
    from tallymark.llm import common

    rng = np.random.default_rng(2)
    rows = [(k, None if k % 7 == 0 else "en", f"s{k % 3}", " ".join(f"w{rng.integers(0, 500)}" for _ in range(int(rng.integers(55, 120))))) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    want = {r.doc_id: (r.kept, r.distance) for r in qm.judged(df).collect()}
    monkeypatch.setattr(common, "MAX_BROADCAST_GROUPS", 0)
    monkeypatch.setattr(qm, "MAX_BROADCAST_GROUPS", 0)
    got = {r.doc_id: (r.kept, r.distance) for r in qm.judged(df.select("*", F.lit(1).alias("group"), F.lit(2).alias("d2"))).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_junk_of_one_kind_goes_where_a_third_of_a_group_is_junk(spark):
    rng = np.random.default_rng(5)
    rows = []
    shifts = {"symbols": [0, 0, 5, 0, 0], "lines": [0, 0, 0, 1.2, 0.45], "length": [0, 2.5, 0, 0, 0]}
    for share in (0.3, 0.4):
        for kind, shift in shifts.items():
            x = rng.normal(size=(1000, 5)) * [0.6, 0.1, 0.3, 0.05, 0.05]
            x[: int(1000 * share)] += shift
            rows += [(f"{kind}{share}", k, k < 1000 * share, *map(float, r)) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "group string, k bigint, junk boolean, x_words double, x_length double, x_symbols double, x_lines double, x_repeats double")
    est = qm.estimates(df)
    got = qm.distances(df, est.drop("scale")).join(est.select("group", "scale"), "group").withColumn("out", F.col("d2") / F.col("scale") > qm.CUTOFF)
    found = {(r.group, r.junk): r.share for r in got.groupBy("group", "junk").agg(F.avg(F.col("out").cast("int")).alias("share")).collect()}
    assert len(found) == 12
    assert all(share >= 0.85 if junk else share == 0 for (_, junk), share in found.items()), found
    assert abs(qm.chi2_cutoff(0.001) - 20.515) < 0.001 and abs(qm.chi2_cutoff(0.5) - qm.CHI2_MEDIAN) < 0.001


def test_junk_goes_and_prose_stays(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(900)]
    rows = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(60, 300))), rnd.choice(["en", None]), "s") for k in range(500)]
    rows += [(1000 + k, " ".join(w + "%%%" for w in rnd.choices(vocab, k=100)), "en", "s") for k in range(15)]
    rows += [(2000, "few words", "en", "s"), (2001, None, "en", "s"), (2002, "same words again and again " * 40, None, None), (None, rows[0][1], "xx", "rare")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("kept", F.lit("x"))
    got = {r.doc_id: r for r in qm.judged(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept for k in range(500)) and not any(got[1000 + k].kept for k in range(15))
    assert got[2000].base_failed and got[2001].base_failed and got[2002].base_failed and got[2000].distance is None and got[None].kept
    assert qm.judged(df.limit(0)).count() == 0


def test_chain_is_accurate_on_held_out_rows(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for k in range(900):
        toxic, poor = rnd.random() < 0.2, rnd.random() < 0.2
        words = rnd.choices(vocab, k=rnd.randint(10, 80)) + (rnd.choices(["grrkab", "grrked", "zornig"], k=2) if toxic else []) + (["buynow"] * 3 if poor else [])
        rnd.shuffle(words)
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(not poor), int(toxic)))
    df = spark.createDataFrame([*rows, (None, None, "en"), rows[0]], "doc_id bigint, text string, p_toxic string")
    seen = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = [r for r in tc.scored(df, tc.chain_for(df, seen)).collect()]
    assert len(got) == len(rows) + 2
    held = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id % 2}
    wrong = sum((held[k].p_toxic >= tc.TOXIC) != bool(t) for k, _, t in labels if k % 2)
    assert wrong <= 0.02 * len(held)
    again = {r.doc_id: r.p_toxic for r in tc.scored(df, tc.chain_for(df, seen)).collect()}
    assert all(again[r.doc_id] == r.p_toxic for r in got)
    nothing = tc.chain_for(df, seen.limit(0))
    assert all(r.p_toxic < tc.TOXIC for r in tc.scored(df.limit(3), nothing).collect()) and tc.scored(df.limit(0), nothing).count() == 0


QUESTION = "Every day Alice picks 12 apples and sells 5 of them to Bob for 3 dollars. How many apples does Alice still have?"


def test_templates():
    found = dc.Matcher([(1, QUESTION)])
    assert found.find("Intro words here. " + QUESTION + " More text")[0] == (1, 1.0)
    other = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "40").replace("5 of", "seven of").replace("3 dollars", "9 euros")
    assert found.find("x y z. " + other) == [(1, 1.0)]
    assert found.find(QUESTION.replace("does Alice", "does Bob")) == [] or found.find(QUESTION.replace("does Alice", "does Bob"))[0][1] < 1.0
    assert found.find("Every day Alice picks 12 apples and then goes home") == [] and found.find("") == []
    assert dc.template("5km", False)[0] == dc.NUM + dc.UNIT and dc.template("$5", False)[0] == dc.NUM + dc.UNIT and dc.template("(seven)", False)[0] == dc.NUM
    assert dc.template("Paris", False)[0] == dc.NAME and dc.template("Paris", True)[0] == "paris"


def test_contaminated_rows(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(k, prose(rnd.randint(3, 40))) for k in range(40)]
    rows, want = [], {}
    for k in range(300):
        held = rnd.sample(items, rnd.choice([0, 0, 1, 2]))
        rows.append((k, " ".join([prose(20), *(x[1] for x in held), prose(5)]), [9]))
        want[k] = {x[0] for x in held if len(x[1].split()) >= 5}
    df = spark.createDataFrame([*rows, (None, None, [1])], "doc_id bigint, text string, items array<int>")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, "x y z")], "item_id bigint, text string")
    for size in (1 << 20, 700):  # one block, and several
        got = {r.doc_id: r for r in dc.contamination(df, bench, block_bytes=size).collect()}
        assert len(got) == 301 and not got[None].contaminated
        assert all(want[k] == set(got[k]["items"]) for k in want) and all(got[k].contaminated == bool(got[k]["items"]) for k in want)
    assert dc.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.contamination(df.limit(0), bench, keep=True).columns == ["doc_id", "text", "items", "share", "contaminated"]


def test_hash_join_equals_a_search_for_every_item(spark, monkeypatch):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6))) for _ in range(60)]
    word = lambda: rnd.choice([rnd.choice(vocab), rnd.choice(vocab), str(rnd.randint(1, 50)), rnd.choice(["Tom", "Anna", "Zoe", "km", "five"])])
    prose = lambda n: " ".join(word() for _ in range(n)) + rnd.choice(["", ".", "?"])
    start = prose(6)  # windows that all items share
    items = [(k, (start + " " if k % 3 else "") + prose(rnd.randint(1, 25))) for k in range(60)] + [(60, "42"), (61, "Yes"), (3, "another text of the same id is here")]
    docs = []
    for k in range(200):
        held = rnd.choice(items)[1]
        text = rnd.choice([held, held.replace("Tom", "Mark"), held.lower(), "".join(str(rnd.randint(0, 9)) if c.isdigit() else c for c in held), prose(12), start])
        docs.append((k, rnd.choice([text, f"{prose(4)} {text} {prose(9)}", f"{text}\n{text}"])))
    docs += [(300, None), (301, ""), (302, "yes"), (303, "yes it is 42"), (None, items[1][1]), (4, docs[4][1]), (305, "x " * 40_000 + items[2][1])]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, items[5]], "item_id bigint, text string")
    matcher = dc.Matcher(items)
    found = [(i, matcher.find(t or "")) for i, t in docs]
    want = sorted((i is None, i or 0, sorted({x for x, _ in got}), max([0.0, *(s for _, s in got)])) for i, got in found)
    rows = lambda: sorted((r.doc_id is None, r.doc_id or 0, list(r["items"]), r.share) for r in dc.contamination(df, bench).collect())
    monkeypatch.setattr(dc, "MAX_BROADCAST_WINDOWS", 0)
    assert rows() == want
    monkeypatch.setattr(dc, "MAX_BROADCAST_WINDOWS", 1_000_000)
    monkeypatch.setattr(dc, "COMMON", 2)
    verbatim = {i: {k for k, t in items if len(t.split()) >= 5 and f" {t} " in f" {text or ''} ".replace("\n", " ")} for i, text in docs}
    for got, all_of in zip(rows(), want):  # left to rarer windows: no other hit, and no verbatim one is lost
        assert got[:2] == all_of[:2] and set(got[2]) <= set(all_of[2]) and (got[0] or verbatim[got[1]] <= set(got[2]))
    assert sum(bool(x[2]) for x in want) > 80


def test_retold_questions_are_found_and_others_not(spark):
    items = [(1, "Tom bought 12 apples at the market. He gave 5 of them to his sister and ate 2. How many apples are left?"), (2, "42"), (3, "Yes"), (4, "Paris")]
    docs = [(1, "Zoe bought 30 apples at the market. He gave 7 of them to his sister and ate 4. How many apples are left?"), (2, "there are 42 of them and yes, Paris is one of the 42 towns"), (3, "yes"), (4, "Tom bought a car. She gave it to her brother, and 12 apples fell from the tree at the market."), (5, "42")]
    got = {r.doc_id: list(r["items"]) for r in dc.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {1: [1], 2: [], 3: [3], 4: [], 5: [2]}


def test_names_at_openings_and_in_other_cases():
    tom = "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"
    found = dc.Matcher([(1, tom)])
    anna = tom.replace("Tom", "Anna").replace("3", "8")
    for text in (anna, anna.lower(), anna.upper(), anna.replace(" ", "\n"), tom.lower(), tom.replace("Tom b", "Anna b").replace("Tom", "Anna")):
        assert found.find("some words before. " + text + " And after.") == [(1, 1.0)], text
    assert found.find(anna.replace("does Anna", "does Bob"))[:1] in ([], [(1, 0.8)]) and found.find(tom.replace("apples", "pears").replace("buys", "sells")) == []
    bob = "Tom has 3 apples. He buys 4 more. How many apples has he now?"  # the name only opens
    for text in (bob.replace("Tom", "Anna"), bob.replace("Tom", "anna"), bob.lower()):
        assert dc.Matcher([(1, bob)]).find(text) == [(1, 1.0)]
    one = "Each morning the baker Alice makes many loaves of bread and sells them all before noon to people of the town"
    for text in (one.lower(), one.upper(), one.replace(" Alice", "\nAlice"), one.replace("baker", "baker.")):
        assert dc.Matcher([(1, one)]).find(text) == [(1, 1.0)]
    assert dc.Matcher([(1, tom.lower())]).find(anna) == [(1, 1.0)] and dc.Matcher([(1, tom.upper())]).find(anna) == [(1, 1.0)]
    few = dc.Matcher([(1, "Die Ber"), (2, "Paris"), (3, "La. De. Der"), (4, "Will pay.\nWho? Nobody. Never. Ever")])
    assert few.find("Hello Big World. Other die words. Ach de ber der La ist. Very Nice Town. People Go Out.") == []
