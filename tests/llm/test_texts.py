import random

from pyspark.sql import functions as F

from veclore.llm import leaks, pii

WORDS = [f"w{i}" for i in range(400)]


def brute(pages, items, n=12):
    out = set()
    for d, t in pages:
        w = leaks.words(t)
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, u in items:
            v = leaks.words(u)
            if any(tuple(v[j : j + n]) in runs for j in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def found(spark, pages, items):
    p = spark.createDataFrame(pages, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("shingle", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    rows = leaks.leaks(p.select("doc_id", "text", "item_id", "pos", "shingle"), i).collect()
    return {(r["doc_id"], r["item_id"]): r["words"] for r in rows}


def test_words():
    assert leaks.words("Ｆｕｌｌ-width_STRASSE straße co­op été ﬁn") == ["full", "width", "strasse", "strasse", "coop", "été", "fin"]
    assert leaks.words(None) == [] and leaks.words("") == []


def test_against_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: [rng.choice(WORDS[:40]) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n)]
    items = [(i, text(rng.choice([11, 12, 13, 40, 80]))) for i in range(40)]
    items.append((90, items[3][1] + text(20)))  # quotes another
    items.append((91, ["same"] * 30))
    pages = []
    for d in range(150):
        w = text(rng.choice([0, 5, 60, 300]))
        if d % 3 == 0:
            _, u = rng.choice(items)
            n = rng.choice([5, 11, 12, 13, 30])
            at = rng.randrange(max(1, len(u) - n + 1))
            w[len(w) // 2 : len(w) // 2] = u[at : at + n]
        pages.append((d, "  ".join(x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "_", "\n"]) for x in w)))
    pages += [(900, None), (901, ""), (902, "same " * 12), (903, "same " * 11), (904, pages[0][1]), (905, "x " * 50_000 + " ".join(items[5][1]))]
    pages.append((904, pages[0][1]))
    items = [(i, " ".join(w)) for i, w in items] + [(95, None), (96, "")]
    got = found(spark, pages, items)
    assert set(got) == brute(pages, items) and got[902, 91] == 12


def test_a_page_that_repeats_a_word_of_an_item(spark):
    """Its hits meet the item's parts only: the work grows with the page, not with its square."""
    pages = [(1, "same " * 60_000), (2, "same other " * 20_000), (3, "same " * 11)]
    assert found(spark, pages, [(7, "same " * 30), (8, "other same " * 6)]) == {(1, 7): 30, (2, 8): 12}


def test_nothing(spark):
    assert found(spark, [(1, "a")], []) == {} and found(spark, [], [(1, "a")]) == {}


# --- personal data: pages made of the sentences such pages have, with names that no list holds ----------------------

GIVEN, FAMILY = ["Ada", "Boris", "Clara", "Dario", "Elena", "Fritz", "Greta", "Hugo", "Ines", "Jonas"], ["Almgren", "Berisha", "Castellan", "Dorfner", "Eskola", "Fontana", "Grabowski", "Halvorsen"]
UNLISTED = [("Quirin", "Zabransky"), ("Wiltrud", "Ostrander"), ("Quirin", "Ostrander")]
FILL = ["The harbour opens early in spring and the market closes late.", "Invoice 2023-5673-10 is closed.", "Order no. 60504281 was shipped.", "Version 4.68.612 fixes the printer.", "The score was 202-492 after extra time.", "Coordinates 47.6243, 8.9353", "Room 14, second floor.", "Follow @harbour_club for news.", "node@3.42 is needed to build it.", "The Fontana Prize goes to a library.", "The route passes Linden Square and Lake Garda."]


def page(rng, people):
    g, f = rng.choice(people)
    truth, parts = [], []

    def say(before, kind, text, after):
        parts.append(before + text + after)
        truth.append((kind, text))

    say(rng.choice(["Posted by ", "Thanks go to ", "Dr. "]), "name", f"{g} {f}", rng.choice([" and the whole team.", " answered the letter.", "\n"]))
    say("Write to ", "email", rng.choice([f"{g.lower()}.{f.lower()}@mail.example", f"{g.lower()} at mail dot example", f"{f.lower()}_7[@]post[.]example"]), " for more.")
    say("Call ", "phone", rng.choice([f"+44 7700 900{rng.randrange(100, 999)}", f"(202) 555-01{rng.randrange(10, 99)}"]), " after six.")
    say("Passport no. ", "id_number", rng.choice([f"ZX{rng.randrange(10**6, 10**7)}", f"{rng.randrange(10**7, 10**8)}-X"]), " was found.")
    say("Address: ", "address", rng.choice([f"{rng.randrange(1, 99)} Mill Road, Dunmere {rng.randrange(1000, 9999)}", f"Lindenweg {rng.randrange(1, 99)}a, D-{rng.randrange(10000, 99999)} Altmoor"]), "\n")
    order = list(range(5))
    rng.shuffle(order)
    return "\n".join(x for i in order for x in (parts[i], rng.choice(FILL))), {truth[i] for i in order}


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    listed = [(g, f) for g in GIVEN for f in FAMILY]
    train = [page(rng, listed + UNLISTED)[0] for _ in range(250)]
    weights, lists = pii.fit(train, {g.lower() for g in GIVEN}, {f.lower() for f in FAMILY})
    hits = misses = wrong = 0
    for _ in range(100):
        text, truth = page(rng, listed + UNLISTED)
        got = {(s.kind, text[s.start : s.end]) for s in pii.best(pii.segments(text, lists), weights)}
        hits, misses, wrong = hits + len(got & truth), misses + len(truth - got), wrong + len(got - truth)
    assert hits / (hits + misses) > 0.95 and hits / (hits + wrong) > 0.95


def test_best_is_the_best_of_all_sets():
    rng = random.Random(6)
    for _ in range(200):
        segs = []
        for _ in range(rng.randrange(1, 9)):
            a = rng.randrange(0, 30)
            segs.append(pii.Segment(a, a + rng.randrange(1, 8), rng.choice(pii.KINDS), [f"f{rng.randrange(6)}"], None))
        segs.sort(key=lambda s: (s.start, s.end))
        weights = {f"f{i}": rng.uniform(-1, 2) for i in range(6)} | {f"{a}|{b}": rng.uniform(-2, 2) for a in pii.KINDS for b in pii.KINDS}

        def score(chosen):
            return sum(weights[s.features[0]] for s in chosen) + sum(pii._step(weights, a, b) for a, b in zip(chosen, chosen[1:]))

        def every(i, chosen):
            if i == len(segs):
                yield chosen
                return
            yield from every(i + 1, chosen)
            if not chosen or chosen[-1].end <= segs[i].start:
                yield from every(i + 1, chosen + [segs[i]])

        top = max(score(c) for c in every(0, []))
        assert abs(score(pii.best(segs, weights)) - top) < 1e-9


def test_redaction_keeps_the_rest(spark):
    docs = [(1, "Łódź 😀 write to ada@mail.example, now. Tel. +44 7700 900123!"), (2, None), (3, ""), (4, "nothing here"), (5, "ada@mail.example ada@mail.example"), (6, "1 " * 20_000 + "x" * 50_000 + " A" * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("found", F.lit("clash")).withColumn("h", F.lit("clash"))
    parts = spark.createDataFrame([("Ada", "given"), (None, "family")], "name_part string, part_kind string")
    model = pii.train(frame.select("doc_id", "text", "found", "h"), parts)
    got = {r["doc_id"]: r["text"] for r in pii.redacted(frame, model).collect()}
    assert got[1].startswith("Łódź 😀 write to [EMAIL], now. Tel. ") and got[1].endswith("!") and got[4] == "nothing here" and got[5] == "[EMAIL] [EMAIL]" and got[6] == docs[5][1] and 2 not in got
    rows = [(r["doc_id"], r["kind"], r["pii_text"]) for r in pii.found_texts(frame, model).collect()]
    assert rows.count((5, "email", "ada@mail.example")) == 1
    empty = frame.where("false")
    assert pii.found_texts(empty, pii.train(empty, parts.where("false"))).count() == 0


def test_words_are_counted_beyond_the_training_rows(spark, monkeypatch):
    rng = random.Random(8)
    texts = [page(rng, [(g, f) for g in GIVEN for f in FAMILY])[0] for _ in range(60)] + ["Ada Zabransky came. Quirin Almgren left.", "Ada Zabransky sang."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    parts = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], "name_part string, part_kind string")
    given, family = {g.lower() for g in GIVEN}, {f.lower() for f in FAMILY}
    few = pii.train(frame, parts, rows=20)
    assert few.lists.near == pii.neighbours(texts, given, family) and few.lists.near["zabransky"]
    whole = sorted(map(tuple, pii.found_texts(frame, few).collect()))
    monkeypatch.setattr(pii, "MAX_WORDS", 3)  # pages are given their words by a join
    many = pii.train(frame, parts, rows=20)
    assert many.words is not None and not many.lists.near and many.weights == few.weights
    assert sorted(map(tuple, pii.found_texts(frame, many).collect())) == whole
