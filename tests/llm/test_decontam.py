from strata.llm import decontam

ITEM = "A train travels 60 miles in 2 hours while Alice walks 3 miles. How far does the train of Alice go in 5 hours?"
ITEMS = [(1, ITEM), (2, "short words here"), (3, None), (4, ""), (5, "what is the total weight of all the apples in the basket")]


def run(spark, docs, items=ITEMS, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS pos", "3 AS id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS doc_id")
    return {r["doc_id"]: (r["contaminated"], r["item_id"], r["kind"]) for r in decontam.decontaminate(d, b, **more).collect()}


def test_cases(spark):
    docs = [
        (1, f"Some words before. {ITEM} And after."),
        (2, "A train travels 90 miles in 4 hours while Carol walks 7 miles. How far does the train of Carol go in 8 hours?"),
        (3, "A train travels 90 miles in 4 hours while Carol walks 7 miles. How far does the train of David go in 8 hours?"),
        (4, "nothing of the kind is in this one, just plain text that goes on"),
        (5, None),
        (6, ""),
        (7, "SHORT words here"),
        (None, "What is the total weight of all the apples in the basket"),
        (8, "what is the total weight of all the pears in the box"),
        (9, "filler " * 50000 + ITEM),
    ]
    for bound in (2_000_000, 0):
        got = run(spark, docs, max_broadcast=bound)
        assert got[1] == (True, 1, "verbatim") and got[9] == got[1]
        assert got[2] == (True, 1, "reparameterised")
        assert got[7] == (True, 2, "verbatim") and got[None] == (True, 5, "verbatim")
        assert not any(got[k][0] for k in (3, 4, 5, 6, 8))


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, ITEM)], []) == {1: (False, None, None)}


SUBJECTS = [
    (1, "Anna buys 3 apples at the market on Monday. Anna then eats 1 of them with lunch. Anna gives 2 more to a friend. How many apples does Anna have left?"),
    (2, "Natalia sold clips to 48 friends in April. Then Natalia sold half as many in May. Natalia wants to know how many clips were sold in all."),
    (3, "Paul. Karl runs and Paul walks along. Paul sings while the old dog sleeps"),
]


def test_renamed_subjects_that_open_sentences(spark):
    docs = [
        (1, SUBJECTS[0][1].replace("Anna", "Bob")),
        (2, "Before this. " + SUBJECTS[1][1].replace("Natalia", "Robert") + " After this."),
        (3, SUBJECTS[2][1].replace("Paul", "Emil")),
        (4, SUBJECTS[0][1].lower()),
        (5, SUBJECTS[0][1].replace("apples", "pears").replace("market", "shop").replace("lunch", "tea")),
    ]
    for bound in (2_000_000, 0):
        got = run(spark, docs, SUBJECTS, max_broadcast=bound)
        assert [got[k] for k in (1, 2, 3)] == [(True, k, "reparameterised") for k in (1, 2, 3)]
        assert not got[5][0]


def test_windows_in_every_reading():
    token, values, names = decontam.template("Go. Run. Sit 3 km then Bob left")
    at, h, word, read, n = decontam.window_hashes(token, values, names, 5)
    assert n == 5 and sorted(at.tolist()) == [0] * 8 + [1] * 4 + [2] * 2 + [3]
    assert len(set(h.tolist())) == len(h) and not word[(at == 0) & read[:, :3].all(1)].any()


LONG = (
    "On the first day the baker sold 12 loaves of bread to people who came from the old village near the river and on the next day "
    "the shop was closed because of the rain so nobody came to buy anything at all until the owner opened the doors again and sold 12 cakes to the children"
)


def test_one_conflicting_slot_only_costs_its_windows(spark):
    pay = "she pays 2 coins for the red apples and walks home with them along the river before it gets dark then she gives 2 apples to the neighbour and eats the rest with her mother in the small garden behind the house"
    items = [(1, LONG), (2, pay)]
    docs = [
        (1, LONG.replace("12 cakes", "15 cakes")),
        (2, pay.replace("2 coins", "3 coins").replace("2 apples", "5 apples")),
        (3, pay.replace("2 coins", "3 coins").replace("2 apples", "3 apples")),
        (4, LONG),
        (5, " ".join(LONG.split()[:20])),
    ]
    for bound in (2_000_000, 0):
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {r["doc_id"]: r for r in decontam.decontaminate(d, b, max_broadcast=bound).collect()}
        assert got[1]["item_id"] == 1 and 0.8 <= got[1]["coverage"] < 1
        assert got[2]["item_id"] == 2 and 0.8 <= got[2]["coverage"] < 1 and got[2]["kind"] == "reparameterised"
        assert got[3]["coverage"] == 1 and got[3]["kind"] == "reparameterised"
        assert got[4]["coverage"] == 1 and got[4]["kind"] == "verbatim"
        assert not got[5]["contaminated"]


def test_short_items_repeated_rows_and_items(spark):
    items = [(1, "purple zebra"), (2, "a quiet green harbour"), (3, "a quiet green harbour"), (4, ITEM), (None, "the very last train home"), (5, "7 km")]
    docs = [(1, "we saw the purple zebra there today"), (2, "such a quiet green harbour, they said"), (2, "nothing at all here"), (3, "a quiet green"), (4, f"{ITEM} {ITEM}"), (4, f"{ITEM} {ITEM}"), (5, "it is 7 km away from here"), (6, "on the very last train home")]
    for bound in (2_000_000, 0):
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = sorted(((r["doc_id"], r["contaminated"], r["n_items"], r["item_id"]) for r in decontam.decontaminate(d, b, max_broadcast=bound).collect()), key=lambda r: r[0])
        assert got == [(1, True, 1, 1), (2, True, 2, 2), (2, True, 2, 2), (3, False, 0, None), (4, True, 1, 4), (4, True, 1, 4), (5, False, 0, None), (6, True, 1, None)]


def brute(docs, items, window, coverage):
    """Items that every document holds, by trying each diagonal and each reading of every window."""
    import itertools

    def tokens(text):
        out, start, number = [], True, False
        for w in (text or "").split():
            core = w.strip(".,!?:;()-")
            if core:
                digit, low = core[0].isdigit(), core.lower()
                unit = number and low in decontam.UNITS
                kinds = ["num"] if digit or low in decontam.NUMBER_WORDS else ["unit"] if unit else ["name", low] if core[0].isupper() and start else ["name"] if core[0].isupper() else [low]
                out.append((kinds, low))
                number = kinds == ["num"]
            start = w[-1] in ".!?:"
        return out

    def readings(t, i):
        for r in itertools.product(*[k for k, _ in t[i : i + window]]):
            if any(x not in ("num", "unit", "name") for x in r):
                yield r, tuple(v if x in ("num", "unit", "name") else "" for x, (_, v) in zip(r, t[i : i + window], strict=True))

    out = set()
    for item, it in items:
        a = tokens(it)
        n = len(a) - window + 1
        for doc, dt in docs:
            b = tokens(dt)
            good = set()
            for diagonal in range(-n, len(b)):
                hits = {(i, x, y) for i in range(n) if 0 <= i + diagonal <= len(b) - window for r, x in readings(a, i) for s, y in readings(b, i + diagonal) if r == s}
                votes = {}
                for i, x, y in hits:
                    for p, q in zip(x, y, strict=True):
                        if p:
                            votes.setdefault((p, q), set()).add(i)
                best = {}
                for (p, q), at in votes.items():
                    best.setdefault(p, []).append((len(at), p == q, q))
                pick = {p: max(v)[2] for p, v in best.items()}
                ties = {p for p, v in best.items() if sum(x[:2] == max(v)[:2] for x in v) > 1}
                for i, x, y in hits:
                    if x == y or all(not p or (pick[p] == q and p not in ties) for p, q in zip(x, y, strict=True)):
                        good.add(i)
            if n > 0 and len(good) >= coverage * n:
                out.add((doc, item))
    return out


def test_random_reparameterisations_against_brute_force(spark):
    import random

    rng = random.Random(11)
    nouns = "apples coins books stones shells cards stamps pencils cups ropes lamps bricks".split()
    verbs = "buys finds sells counts paints carries hides trades moves packs".split()
    people = "Anna Bob Carla Dev Emil Fatima Goran Hilda Ivan Judit Karim Lena".split()
    units = "km kg hours days minutes liters".split()

    def problem():
        out = []
        for _ in range(rng.randint(3, 5)):
            out.append(rng.choice(["{A} {v} {n} {o} near the old {w} and then walks {m} {u} to see {B}.", "Then {A} {v} {n} of the {o} while {B} waits for {m} {u} beside the {w}.", "How many {o} does {A} still have after {m} {u} with the {w}?"]))
        text = " ".join(out)
        fixed = {"v": rng.choice(verbs), "o": rng.choice(nouns), "w": rng.choice(nouns) + rng.choice("abcdefg")}
        return lambda: text.format(**fixed, A=a[0], B=a[1], n=rng.randint(2, 99), m=rng.randint(100, 999), u=rng.choice(units)) if (a := rng.sample(people, 2)) else ""

    makers = [problem() for _ in range(12)]
    items = [(k, f()) for k, f in enumerate(makers)]
    docs = [(100 + k, f"Some text goes before. {makers[k % 12]()} And some after it.") for k in range(36)]
    docs += [(200 + k, problem()()) for k in range(20)]
    want = brute(docs, items, 5, 0.8)
    for bound in (2_000_000, 0):
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc"], r["item"]) for r in decontam.matches(d, b, max_broadcast=bound).collect()}
        assert got == want
        planted = {(100 + k, k % 12) for k in range(36)}
        assert len(planted & got) >= 0.95 * len(planted)
        assert not {d for d, _ in got} & {d for d, _ in docs if d >= 200}


def test_many_items_of_one_template(spark):
    items = [(k, f"How many apples does the farmer number {k} take to the market on the day after the rain has stopped over {k} fields") for k in range(300)]
    docs = [(k, "How many apples does the farmer number 5 take to the school") for k in range(50)] + [(99, items[7][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(d, b).collect()}
    assert got[99]["contaminated"] and got[99]["n_items"] == 300 and got[99]["item_id"] == 0 and got[99]["coverage"] == 1
    assert not any(got[k]["contaminated"] for k in range(50))
